"""A predicted grouping against a reference: pair counts, indices, degeneracy, detection, operating point.

Undefined ratios are null, never 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .leakage import sibling_flags


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def _sum(df: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("p", _pairs(F.col("n")))
    return (g.groupBy(*by) if by else g.groupBy()).agg(F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias(name))


def pair_counts(df: DataFrame, truth: str, pred: str, cls: str | None = None, by: list[str] | None = None) -> DataFrame:
    """tp, same_truth, same_pred, all_pairs (within classes, if cls is given), for each value of by."""
    by = by or []
    within = [*by, *([cls] if cls else [])]
    parts = [_sum(df, [*within, truth, pred], by, "tp"), _sum(df, [*within, truth], by, "same_truth"), _sum(df, [*within, pred], by, "same_pred")]
    whole = df.withColumn("__one", F.lit(1))
    parts.append(_sum(whole, within or ["__one"], by, "all_pairs"))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by) if by else out.crossJoin(p)  # one row each
    return out


def pair_scores(counts: DataFrame) -> DataFrame:
    """Adds recall, precision, f1, chance (the base rate) and lift."""
    out = counts.withColumn("recall", ratio(F.col("tp"), F.col("same_truth"))).withColumn("precision", ratio(F.col("tp"), F.col("same_pred")))
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("chance", ratio(F.col("same_truth"), F.col("all_pairs")))
    return out.withColumn("lift", ratio(F.col("precision"), F.col("chance")))


def adjusted_rand(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """ari over all items."""
    c = pair_counts(df, truth, pred, None, by)
    expected = ratio(F.col("same_truth").cast("double") * F.col("same_pred"), F.col("all_pairs"))
    most = (F.col("same_truth") + F.col("same_pred")) / 2.0
    return c.select(*(by or []), F.coalesce(ratio(F.col("tp") - expected, most - expected), F.lit(1.0)).alias("ari"))


#: Distinct sizes of a side that meet in one task, and pairs of them that are taken at once.
_SIZES, _AT_ONCE = 1024, 1 << 17
#: Weights below this share of the greatest one are left out: their sum is below the last digit of a double.
_NOTHING = 1e-19


def expected_information(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each pair of groups' share of the expected mutual information: sizes a and b of n items, whose overlap k has the
    hypergeometric distribution.

    Weights are relative to the one at the mode and follow by their ratios, upwards and downwards until nothing is left;
    their sum makes them probabilities, so that no factorial is needed and no digits cancel.
    """
    a, b, n = (np.asarray(x, float) for x in (a, b, n))
    lo, hi = np.maximum(0, a + b - n), np.minimum(a, b)
    mode = np.clip(np.floor((a + 1) * (b + 1) / (n + 2)), lo, hi)
    total, mass = np.zeros(len(a)), np.zeros(len(a))

    def add(at: np.ndarray, k: np.ndarray, weight: np.ndarray) -> None:
        mass[at] += weight
        some = k > 0
        x, y = at[some], k[some]
        total[x] += weight[some] * y / n[x] * np.log(n[x] * y / (a[x] * b[x]))

    whole = np.arange(len(a))
    add(whole, mode, np.ones(len(a)))
    for step in (1, -1):
        at, k, weight = whole, mode, np.ones(len(a))
        while len(at):
            x, y, m = a[at], b[at], n[at]
            # The ratio of neighbouring weights is 0 beyond the ends.
            ratio = (x - k) * (y - k) / ((k + 1) * (m - x - y + k + 1)) if step > 0 else k * (m - x - y + k) / ((x - k + 1) * (y - k + 1))
            weight, k = weight * ratio, k + step
            on = weight > _NOTHING
            at, k, weight = at[on], k[on], weight[on]
            add(at, k, weight)
    return total / mass


def adjusted_mutual_information(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """ami with the arithmetic normaliser, for each value of by.

    The expected mutual information depends on the margins' sizes alone: of n items there are sqrt(2n) distinct ones at
    most, however many groups there are. Both sides' sizes are dealt to ranges, each two of which meet in one task, where
    their pairs are entries of arrays.
    """
    import pyarrow as pa

    keys = [*(by or [])]
    base = df if keys else df.withColumn("__one", F.lit(1))
    keys = keys or ["__one"]
    cells = base.groupBy(*keys, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    a = cells.groupBy(*keys, "t").agg(F.sum("n").alias("a"))
    b = cells.groupBy(*keys, "p").agg(F.sum("n").alias("b"))
    whole = cells.groupBy(*keys).agg(F.sum("n").alias("all"))
    share = lambda c: F.col(c) / F.col("all")
    joint = cells.join(a, [*keys, "t"]).join(b, [*keys, "p"]).join(whole, keys)
    mi = joint.groupBy(*keys).agg(F.sum(share("n") * F.log(F.col("all").cast("double") * F.col("n") / (F.col("a").cast("double") * F.col("b")))).alias("mi"))
    entropy = lambda g, c, name: g.join(whole, keys).groupBy(*keys).agg(F.sum(-share(c) * F.log(share(c))).alias(name))
    rows = a.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("ka"))
    others = b.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("kb"))
    ranges = lambda side, name: side.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / _SIZES).cast("int").alias(name))
    many = ranges(rows, "ni").join(ranges(others, "nj"), keys).join(whole, keys)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.join(many, keys).select(*keys, "all", F.pmod("a", "ni").cast("int").alias("i"), every("nj").alias("j"), F.lit(True).alias("left"), F.col("a").alias("size"), F.col("ka").alias("many"))
    right = others.join(many, keys).select(*keys, "all", every("ni").alias("i"), F.pmod("b", "nj").cast("int").alias("j"), F.lit(False).alias("left"), F.col("b").alias("size"), F.col("kb").alias("many"))

    def expected(table: pa.Table) -> pa.Table:
        side, size, times, n = (table[c].to_numpy() for c in ("left", "size", "many", "all"))
        x, y, out = np.flatnonzero(side), np.flatnonzero(~side), 0.0
        block = max(1, _AT_ONCE // max(len(y), 1))
        for s in range(0, len(x), block):
            p, q = (v.ravel() for v in np.meshgrid(x[s : s + block], y, indexing="ij"))
            out += float((expected_information(size[p], size[q], n[p]) * times[p] * times[q]).sum())
        return table.select(keys).slice(0, 1).append_column("e", pa.array([out]))

    cells = left.unionByName(right)
    schema = ", ".join(f"`{c}` {dict(cells.dtypes)[c]}" for c in keys) + ", e double"
    emi = cells.groupBy(*keys, "i", "j").applyInArrow(expected, schema).groupBy(*keys).agg(F.sum("e").alias("emi"))
    one = mi.join(entropy(a, "a", "ha"), keys).join(entropy(b, "b", "hb"), keys).join(emi, keys)
    top = (F.col("ha") + F.col("hb")) / 2 - F.col("emi")
    return one.select(*(by or []), F.when(top == 0, 1.0).otherwise((F.col("mi") - F.col("emi")) / F.nullif(top, F.lit(0.0))).alias("ami"))


def structural_degeneracy(df: DataFrame, cls: str, group: str, by: list[str] | None = None, mean_size: float = 10.0, share: float = 0.25) -> DataFrame:
    """n_groups, degenerate, reason: groups too large on average, or one too large for its class."""
    by = by or []
    g = df.groupBy(*by, cls, group).agg(F.count(F.lit(1)).alias("n"))
    per = g.groupBy(*by, cls).agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest"))
    mean = F.sum("items") / F.sum("groups")
    first = F.min_by(F.concat(F.lit("large group in "), F.col(cls).cast("string")), F.when(F.col("largest") > share * F.col("items"), F.col(cls)))
    aggs = [F.sum("groups").alias("n_groups"), F.when(mean > mean_size, "mean size").otherwise(first).alias("reason")]
    out = per.groupBy(*by).agg(*aggs) if by else per.agg(*aggs)
    return out.select(*by, "n_groups", F.col("reason").isNotNull().alias("degenerate"), "reason")


def truth_degeneracy(n_pred: Column, n_true: Column, leak: Column, true_leak: Column) -> Column:
    """Fewer than half the true groups, or more leakage than the truth has."""
    return (n_pred < 0.5 * n_true) | (leak > true_leak + 1e-9)


def detection(df: DataFrame, truth: str, pred: str, by: list[str] | None = None, split: str = "split", seed: str = "seed") -> DataFrame:
    """tp, fp, fn, tn over all seeds; recall, precision, f1; means over seeds of both marginal rates, and their
    ratio under a name that warns: it is no detection rate."""
    by = by or []
    a = sibling_flags(df, truth, [*by, seed], split).withColumnRenamed("hit", "rf")
    train = df.where(F.col(split) == "train").select(*by, seed, pred).distinct().withColumn("pf", F.lit(True))
    both = a.join(train, [*by, seed, pred], "left").withColumn("pf", F.coalesce("pf", F.lit(False)))
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    r, p = F.col("rf"), F.col("pf")
    per = both.groupBy(*by, seed).agg(n(r & p, "tp"), n(~r & p, "fp"), n(r & ~p, "fn"), n(~r & ~p, "tn"), F.avg(r.cast("double")).alias("rr"), F.avg(p.cast("double")).alias("pr"))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")] + [F.avg("rr").alias("reference_rate"), F.avg("pr").alias("predicted_rate")]
    out = per.groupBy(*by).agg(*sums) if by else per.agg(*sums)
    out = out.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("marginal_ratio_not_a_detection_rate", ratio(F.col("predicted_rate"), F.col("reference_rate")))


def operating_point(rows: DataFrame, score: str, order: str, degenerate: str | None = None, by: list[str] | None = None) -> DataFrame:
    """The first row (by order) with the best score; rows that are not degenerate come before all others."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    keys = [*([F.col(degenerate).cast("int")] if degenerate else []), F.desc_nulls_last(score), F.col(order)]
    return rows.withColumn("__r", F.row_number().over(w.orderBy(*keys))).where("__r = 1").drop("__r")


def recovery_verdict(recall: Column, lift: Column) -> Column:
    return F.when((recall >= 0.6) & (lift >= 2), "recovered").when((recall < 0.2) | (lift < 1.5), "fails").otherwise("partial")
