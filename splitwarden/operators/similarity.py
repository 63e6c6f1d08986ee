"""Similarity joins within classes, linkage into clusters, and sweeps over thresholds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import dot, doubles, hamming, norm
from . import linkage, tiles
from .components import connected_components
from .ranking import SLICES, numbered


#: Reference directions of a class, and the slack of angles against rounding.
PIVOTS = 4
_SLACK = 1e-6
#: Items of a component that one task links: 0.3 GB of vectors of 64 dimensions with their sorted copies.
LINKED = 1 << 18


def unit_angles(df: DataFrame, key: str, cls: str, vector: str) -> DataFrame:
    """key, cls, v, len and angles: those to PIVOTS vectors of the class, the ones of the least hashed keys."""
    unit = df.select(F.col(key).alias("key"), F.col(cls).alias("cls"), doubles(F.col(vector)).alias("v")).withColumn("len", norm(F.col("v")))
    order = F.xxhash64("key")
    chosen = unit.where("len > 0").withColumn("__r", F.row_number().over(Window.partitionBy("cls").orderBy(order, "key"))).where(F.col("__r") <= PIVOTS)
    pivots = chosen.groupBy("cls").agg(F.collect_list(F.struct("__r", "v", "len")).alias("__p")).select(F.col("cls").alias("__cls"), F.array_sort("__p").alias("__p"))
    cosine = lambda p: dot(F.col("v"), p["v"]) / F.nullif(F.col("len") * p["len"], F.lit(0.0))
    angles = F.transform("__p", lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(p)))))
    return unit.join(pivots, unit["cls"] == pivots["__cls"]).select("key", "cls", "v", "len", angles.alias("angles"))


def close_candidates(df: DataFrame, key: str, cls: str, vector: str, least: float) -> DataFrame:
    """Pairs (a < b) of a class that may reach a cosine: by the triangle inequality, the angles of two vectors to any
    third one differ by no more than the angle between them. Bands as wide as that angle, of the angle to the first
    pivot, are the join key beside the class; the angles to the others are compared before any product.

    For vectors in tight clusters and high thresholds; cosine_pairs takes tiles, which cost the same for all vectors."""
    reach = math.acos(max(-1.0, min(1.0, least))) + _SLACK
    rows = unit_angles(df, key, cls, vector).where("len > 0").withColumn("band", F.floor(F.col("angles")[0] / reach))
    a = rows.select(F.col("key").alias("a"), "cls", F.col("v").alias("va"), F.col("len").alias("la"), F.col("angles").alias("ga"), F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"))
    b = rows.select(F.col("key").alias("b"), "cls", F.col("v").alias("vb"), F.col("len").alias("lb"), F.col("angles").alias("gb"), "band")
    near = F.forall(F.zip_with("ga", "gb", lambda x, y: F.abs(x - y) <= reach), lambda x: x)
    return a.join(b, ["cls", "band"]).where((F.col("a") < F.col("b")) & near)


def cosine_pairs(df: DataFrame, key: str, cls: str, vector: str, least: float | None = None, linking: bool = False) -> DataFrame:
    """a, b, cls, score of pairs (a < b) within a class, of those with a score of at least ``least``.

    With a threshold, pairs are entries of matrix products of tiles (see tiles), and only those that reach it become
    rows; linking: only a forest of them, which links the same items at each threshold from ``least`` on. Without a
    threshold, all pairs of a class are the result, and rows. Pairs with a vector of length 0 have no score and no place
    among those of a threshold.
    """
    if least is not None:
        return tiles.cosine_pairs(df, key, cls, vector, least, linking)
    score = dot(F.col("va"), F.col("vb")) / F.nullif(F.col("la") * F.col("lb"), F.lit(0.0))
    unit = df.select(F.col(key).alias("key"), F.col(cls).alias("cls"), doubles(F.col(vector)).alias("v")).withColumn("len", norm(F.col("v")))
    a, b = unit.select(F.col("key").alias("a"), "cls", F.col("v").alias("va"), F.col("len").alias("la")), unit.select(F.col("key").alias("b"), "cls", F.col("v").alias("vb"), F.col("len").alias("lb"))
    return a.join(b, "cls").where("a < b").withColumn("score", score).select("a", "b", "cls", "score")


def hamming_pairs(df: DataFrame, key: str, cls: str | None, bits: str, most: int, banded: bool | None = None, width: int = 64, linking: bool = False) -> DataFrame:
    """a, b (a < b), cls, distance of pairs at most so many bits apart, within a class or over all.

    banded: hashes within t bits agree in one of t + 1 bands, so bands are equi-joined and pairs rechecked; by default
    up to t = 6, where bands are selective. Beyond, bands of 64 bits rule out a fixed share of the pairs whatever their
    number, and tiles count the differing bits of all of them without a row per pair. linking: only a forest of the
    pairs, which links the same items up to each distance.
    """
    if not (most <= 6 if banded is None else banded):
        return tiles.hamming_pairs(df, key, cls, bits, most, linking)
    base = df.select(F.col(key).alias("key"), (F.col(cls) if cls else F.lit(0)).alias("cls"), F.col(bits).alias("h")).where("h is not null")
    n = most + 1
    edges = [round(i * width / n) for i in range(n + 1)]
    bands = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("h", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 63 else -1)).alias("x")) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))))
    base = base.withColumn("band", F.explode(bands))
    a, b = base.selectExpr("key as a", "cls", "h as ha", "band"), base.selectExpr("key as b", "cls", "h as hb", "band")
    pairs = a.join(b, ["cls", "band"]).where("a < b").withColumn("distance", hamming(F.col("ha"), F.col("hb"))).where(F.col("distance") <= most)
    return pairs.select("a", "b", "cls", "distance").distinct()


def near_held_out(df: DataFrame, key: str, cls: str, bits: str, digest: str, split: str, most: int) -> DataFrame:
    """Held-out rows near train rows of any class, contents differing, with the distance. Keys name rows.

    Classes do not matter: tiles of all rows meet, and only pairs that are near become rows.
    """
    rows = df.where(F.col(bits).isNotNull()).withColumn("__held", F.col(split) != "train")
    near = tiles.hamming_across(rows, key, cls, bits, "__held", most)
    own = lambda p: rows.select(F.col(key).alias(f"{p}_key"), F.col(cls).alias(f"{p}_cls"), F.col(digest).alias(f"{p}_digest"), F.col("__held").alias(f"{p}_held"))
    held, train = own("held").where("held_held").drop("held_held"), own("train").where("not train_held").drop("train_held")
    near = near.select(F.col("a").alias("held_key"), F.col("b").alias("train_key"), "distance").distinct().join(held, "held_key").join(train, "train_key").where("held_digest <> train_digest")
    return near.select("held_key", "train_key", "held_cls", "train_cls", "distance").distinct().withColumn("same_class", F.col("held_cls") == F.col("train_cls"))


def near_across_splits(pairs: DataFrame, items: DataFrame, key: str, cls: str, split: str, heavy: float = 20.0) -> DataFrame:
    """For each class: near pairs whose splits differ, the distinct items in them, and whether they are many."""
    s = items.select(F.col(key), F.col(split))
    torn = pairs.join(s.toDF("a", "split_a"), "a").join(s.toDF("b", "split_b"), "b").where("split_a <> split_b")
    n = torn.groupBy("cls").agg(F.count(F.lit(1)).alias("n_pairs"))
    images = torn.select("cls", F.explode(F.array("a", "b")).alias("key")).groupBy("cls").agg(F.countDistinct("key").alias("n_items"))
    whole = items.groupBy(F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("n_class"))
    return n.join(images, "cls").join(whole, "cls").withColumn("pct", 100.0 * F.col("n_items") / F.col("n_class")).withColumn("heavy", F.col("pct") > heavy)


def single_linkage(items: DataFrame, pairs: DataFrame, key: str, cls: str, tag: str = "s") -> DataFrame:
    """key, cls, cluster: components of the pairs; names count clusters in order of their least key in a class."""
    comp = connected_components(pairs, "a", "b").withColumnRenamed("node", "__node")
    base = items.select(F.col(key).alias("key"), F.col(cls).alias("cls"))
    joined = base.join(comp, base["key"] == comp["__node"], "left").select("key", "cls", F.coalesce("component", "key").alias("first"))
    return _named(joined, ["cls"], tag).select("key", "cls", "cluster")


def _named(rows: DataFrame, by: list[str], tag: str) -> DataFrame:
    """Adds cluster: the class and the place of first among the class's distinct ones."""
    names = numbered(rows.select(*by, "first").distinct(), by, F.col("first"), count=None)
    names = names.select(*(F.col(c).alias(f"__{c}") for c in [*by, "first"]), F.concat(F.col("cls").cast("string"), F.lit(f":{tag}"), (F.col("__r") - 1).cast("string")).alias("cluster"))
    same = rows["first"] == names["__first"]
    for c in by:
        same = same & rows[c].eqNullSafe(names[f"__{c}"])
    return rows.join(names, same).select(rows["*"], "cluster")


def greedy_linkage(items: DataFrame, key: str, cls: str, vector: str, threshold: float, how: str = "complete", as_shipped: bool = False, most: int = LINKED) -> DataFrame:
    """key, cls, cluster by greedy first-fit merging in each class: the first pair of clusters, in order, whose
    similarities all (complete) or on average (average) reach the threshold is merged, until none does.

    vector: an array (cosine) or a 64-bit hash, for which the threshold is a distance. as_shipped compares
    negative mean distances with the positive threshold, as a known defect does: nothing merges.
    A merge needs a pair that reaches the threshold by itself, so that items fall apart into the components of those
    pairs (found from forests, without a row per pair), and merging in one does not touch another: each component is a
    task of its own, in memory that grows with its items (see linkage). One of more than ``most`` items is refused before
    any task starts. Clusters are named by their least key. Items without a vector, or of length 0, stay alone.
    """
    hashed = dict(items.dtypes)[vector] == "bigint"
    least = -threshold if hashed else threshold - 1e-12
    if hashed:
        pairs = hamming_pairs(items, key, cls, vector, int(threshold), linking=True)
        if as_shipped and how == "average":
            pairs = pairs.limit(0)
    else:
        pairs = cosine_pairs(items, key, cls, vector, least, linking=True)

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys, v = table["key"].combine_chunks(), table["v"].combine_chunks()
        if hashed:
            data = v.cast(pa.int64()).to_numpy().view(np.uint64)
            if how == "complete":
                of = linkage.first_fit(data, lambda x, y: np.bitwise_count(y ^ x) <= threshold)
            else:
                of = linkage.averaged(data, least, lambda x, y: -np.bitwise_count(y ^ x).astype(np.int64), linkage.bit_counts, linkage.by_bits)
        else:
            data = v.flatten().to_numpy().astype(float).reshape(len(keys), -1)
            data /= np.linalg.norm(data, axis=1, keepdims=True)
            if how == "complete":
                of = linkage.first_fit(data, lambda x, y: y @ x >= least)
            else:
                of = linkage.averaged(data, least, lambda x, y: y @ x, lambda x: x, linkage.by_vectors)
        return pa.table({"key": keys, "first": keys.take(pa.array(of))})

    comp = connected_components(pairs, "a", "b").withColumnRenamed("node", "__node")
    largest = comp.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a component of {largest} items, more than {most}: raise the threshold, or most where tasks have the time of n * n similarities")
    base = items.select(F.col(key).alias("key"), F.col(cls).alias("cls"), F.col(vector).alias("v"))
    kind = dict(base.dtypes)["key"]
    # Components are little data and much work: by number, so that Spark does not join them into one task by their bytes.
    session = items.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    dealt = base.join(comp, base["key"] == comp["__node"]).select("key", "v", "component").repartition(parts, "component")
    merged = dealt.groupBy("component").applyInArrow(link, f"key {kind}, first {kind}")
    return base.select("key", "cls").join(merged, "key", "left").select("key", "cls", F.concat_ws(":", F.col("cls").cast("string"), F.coalesce("first", "key").cast("string")).alias("cluster"))


def sweep(items: DataFrame, pairs: DataFrame, key: str, cls: str, score: str, thresholds: list[float], at_most: bool = False) -> DataFrame:
    """threshold, key, cls, cluster: single linkage at every threshold over pairs scored once.

    Nodes of the thresholds are kept apart, so that all are solved in the same rounds: whole keys (below 2**63 divided
    by the number of thresholds) by their place in a multiple, others by a pair of threshold and key.
    """
    steps = sorted(float(x) for x in thresholds)
    t = F.explode(F.array(*(F.lit(x) for x in steps)))
    many = pairs.withColumn("threshold", t)
    many = many.where(F.col(score) <= F.col("threshold") if at_most else F.col(score) >= F.col("threshold"))
    if dict(pairs.dtypes)["a"] in ("bigint", "int"):
        place = F.array_position(F.array(*(F.lit(x) for x in steps)), F.col("threshold")) - 1
        node = lambda c: F.col(c).cast("long") * len(steps) + place
        comp = connected_components(many.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
        part = lambda c: F.expr(f"({c} - pmod({c}, {len(steps)})) div {len(steps)}")
        comp = comp.select(F.get(F.array(*(F.lit(x) for x in steps)), F.expr(f"cast(pmod(node, {len(steps)}) as int)")).alias("threshold"), part("node").alias("__node"), part("component").alias("component"))
    else:
        node = lambda c: F.struct(F.col("threshold").alias("t"), F.col(c).alias("k"))
        comp = connected_components(many.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
        comp = comp.select(F.col("node.t").alias("threshold"), F.col("node.k").alias("__node"), F.col("component.k").alias("component"))
    base = items.select(F.col(key).alias("key"), F.col(cls).alias("cls")).withColumn("threshold", t)
    joined = base.join(comp, (base["threshold"] == comp["threshold"]) & (base["key"] == comp["__node"]), "left").select(base["*"], F.coalesce("component", "key").alias("first"))
    return _named(joined, ["threshold", "cls"], "s").select("threshold", "key", "cls", "cluster")


def score_profile(df: DataFrame, key: str, cls: str, vector: str, least: float) -> DataFrame:
    """n_pairs of the classes, median and the share of pairs that reach a threshold, of cosines.

    Tiles count scores in widths; only the scores of the widths that hold the middle become rows and are sorted.
    """
    width = 2.0 / SLICES
    slices = lambda s: np.clip(np.floor((s + 1) / width), 0, SLICES - 1).astype(np.int64)
    told = tiles.cosine_counts(df, key, cls, vector, lambda s: slices(s) * 2 + (s >= least)).collect()  # two rows a width
    n = sum(r["n"] for r in told)
    reached = sum(r["n"] for r in told if r["bin"] % 2)
    by_slice = np.bincount([r["bin"] // 2 for r in told], [r["n"] for r in told], SLICES).astype(np.int64) if told else np.zeros(SLICES, np.int64)
    upto = np.cumsum(by_slice)
    first, last = (int(np.searchsorted(upto, m)) for m in ((n + 1) // 2, n // 2 + 1))
    whole = df.where(F.col(key).isNotNull()).groupBy(F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("m")).where("cls is not null").agg(F.coalesce(F.sum(F.expr("m * (m - 1) div 2")), F.lit(0)).alias("n_pairs"))
    if not n:
        return whole.select("n_pairs", F.lit(None).cast("double").alias("median"), F.lit(None).cast("double").alias("share"))
    before = int(upto[first - 1]) if first else 0
    scores = tiles.cosine_pairs(df, key, cls, vector, -2.0, between=(first, last, width)).select("score")
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("score")) + before)  # the scores of two widths
    middle = ranked.where(F.col("r").isin((n + 1) // 2, n // 2 + 1)).agg(F.avg("score").alias("median"))
    return whole.crossJoin(middle).select("n_pairs", "median", F.lit(reached / n).alias("share"))  # one row each


def histogram(df: DataFrame, key: str, cls: str, vector: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin (0 to bins - 1) and n, of the cosines of all pairs of a class."""
    width = (hi - lo) / bins
    return tiles.cosine_counts(df, key, cls, vector, lambda s: np.clip(np.floor((s - lo) / width), 0, bins - 1).astype(np.int64))


def sampled_pairs(df: DataFrame, key: str, cls: str, k: int, seed: int = 0) -> DataFrame:
    """k pairs (a, b) of a class without replacement, in md5 order. No pair becomes a row but the first k of a cell."""
    return tiles.first_pairs(df, key, cls, k, seed)


def strided(df: DataFrame, by: str, order: str, sample: int) -> DataFrame:
    """Every (n div sample)-th row of each class with more than sample rows."""
    r = numbered(df, [by], F.col(order))
    step = F.greatest(F.floor(F.col("__n") / sample), F.lit(1))
    return r.where((F.col("__n") <= sample) | (F.pmod(F.col("__r") - 1, step) == 0)).drop("__r", "__n")
