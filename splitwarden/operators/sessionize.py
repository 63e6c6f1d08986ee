"""Groups of items: gap-based runs, recorded groups, dates and places."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import capture_key
from ..functions.kernels import haversine, metres_apart
from ..sources.shared import remove, written
from .components import connected_components
from .ranking import numbered, parts_of, runs

#: Items of an island that place_leaders takes as one sequence.
LEADERS = 1_000_000
#: Items of a place that are paired with those of another at a time.
BLOCK = 2048
#: Pairs that a task of place_links makes, about.
TASK_PAIRS = 1 << 26

#: The rules of the sensitivity table: name, gap, across classes.
RULES = (("gap1", 1, False), ("gap3", 3, False), ("gap3_cross", 3, True), ("gap10", 10, False), ("gap10_cross", 10, True))


def gap_runs(df: DataFrame, by: list[str], num: str, gap: float, tie: str, out: str = "run", parts: int | None = None) -> DataFrame:
    """Adds the number of the run within by: a new run begins where num exceeds the one before by more than gap."""
    return runs(df, by, num, tie, [gap], "__runs", parts).withColumn(out, F.get("__runs", F.lit(0))).drop("__runs")


def group_name(kind: str | Column, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, *(p.cast("string") for p in parts))


def sessions(df: DataFrame, cls: str, prefix: str, num: str, key: str, gap: float, cross_class: bool = False, out: str = "session", parts: int | None = None) -> DataFrame:
    """Adds a group name to numbered items; cross_class lets runs go over class borders."""
    by = [prefix] if cross_class else [cls, prefix]
    return gap_runs(df, by, num, gap, key, "__run", parts).withColumn(out, group_name("burst", *(F.col(c) for c in by), F.col("__run"))).drop("__run")


def _keyed(items: DataFrame, file: str, bounded: bool = True) -> DataFrame:
    """The items with kind, key and number of their names, written: names are parsed once for all steps that read them."""
    parsed = items.withColumn("__k", capture_key(F.col(file), bounded)).select(*(F.col(f"`{c}`") for c in items.columns), F.col("__k.kind").alias("__kind"), F.col("__k.key").alias("__key"), F.col("__k.num").alias("__num"))
    return written(parsed, "captures")


def sessions_from_names(items: DataFrame, gap: int = 3, cls: str = "cls", file: str = "file", bounded: bool = True) -> DataFrame:
    """Adds session to items by their file names: runs of numbered ones, videos, messenger dates and singles."""
    parsed = _keyed(items, file, bounded)
    seq = sessions(parsed.where("__kind = 'seq'"), cls, "__key", "__num", file, gap, parts=parts_of(parsed))
    rest = parsed.where("__kind <> 'seq'").withColumn("session", group_name(F.col("__kind"), F.col(cls), F.col("__key")))
    return seq.unionByName(rest).drop("__kind", "__key", "__num")


def regrouped(manifest: DataFrame, gap: int, cross_class: bool, cls: str = "cls", file: str = "file", session: str = "session") -> DataFrame:
    """Adds session_new: numbered bursts and singles are grouped anew, all others keep their session."""
    base = _keyed(manifest, file)
    again = (F.split(session, ":")[0].isin("burst", "single")) & F.col("__num").isNotNull()
    base = base.withColumn("__again", F.coalesce(again, F.lit(False)))
    new = sessions(base.where("__again"), cls, "__key", "__num", file, gap, cross_class, "session_new", parts_of(base))
    old = base.where(~F.col("__again")).withColumn("session_new", F.col(session))
    return new.unionByName(old).drop("__kind", "__key", "__num", "__again")


def by_rules(df: DataFrame, cls: str, prefix: str, num: str, key: str, rules: Iterable[tuple[str, float, bool]] = RULES) -> DataFrame:
    """The items once for each rule, with rule and session."""
    # Rules over the same classes share one dealing and one scan.
    rules, out, parts = list(rules), None, parts_of(df)
    for cross in sorted({c for _, _, c in rules}):
        by, own = [prefix] if cross else [cls, prefix], [(n, g) for n, g, c in rules if c == cross]
        seen = runs(df, by, num, key, [g for _, g in own], "__runs", parts)
        each = F.array(*(F.struct(F.lit(n).alias("rule"), F.get("__runs", F.lit(i)).alias("run")) for i, (n, _) in enumerate(own)))
        part = seen.select(*df.columns, F.explode(each).alias("__run"))
        part = part.select(*df.columns, group_name("burst", *(F.col(c) for c in by), F.col("__run.run")).alias("session"), F.col("__run.rule").alias("rule"))
        out = part if out is None else out.unionByName(part)
    return out


def absorbed(items: DataFrame, fine: str, coarse: str, cls: str) -> DataFrame:
    """Coarse groups with the number of fine ones they hold, their items and classes."""
    return items.groupBy(coarse).agg(F.countDistinct(fine).alias("n_fine"), F.count(F.lit(1)).alias("n_items"), F.countDistinct(cls).alias("n_classes"))


def recorded_groups(items: DataFrame, leaves: DataFrame, cls: str = "cls", key: str = "key") -> DataFrame:
    """Adds session to items by a recorded map (cls, key, leaf); items without an entry have none."""
    known = leaves.select("cls", "key", "leaf").groupBy("cls", "key").agg(F.min("leaf").alias("leaf"))
    joined = items.join(known, (items[cls] == known["cls"]) & (items[key] == known["key"]), "left").select(items["*"], known["leaf"])
    return joined.withColumn("session", F.when(F.col("leaf").isNotNull(), group_name("leaf", F.col(cls), F.col("leaf")))).drop("leaf")


def unmatched(items: DataFrame, cls: str = "cls", session: str = "session") -> DataFrame:
    """cls, n_items, n_unmatched: items of each class that recorded_groups found no entry for."""
    return items.groupBy(F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col(session).isNull()).alias("n_unmatched"))


def date_groups(df: DataFrame, stamp: str, out: str = "day") -> DataFrame:
    """The part of a time string before the first space."""
    return df.withColumn(out, F.split(F.col(stamp).cast("string"), " ")[0])


def _grid(metres: float) -> tuple[float, Callable[[Column], Column], Callable[[Column, Column], Column]]:
    """size (degrees of latitude of a band), parts(band): into how many parts a band's circle of longitude is cut, and
    part(longitude, parts). Two places within the distance are in one part, or in parts next to each other.

    Bands near a pole, where a part would be more than a third of the circle, are one part.
    """
    size = metres / 111_194.0 * 1.001

    def parts(band: Column) -> Column:
        # The widest a band's neighbours get: a point of it, or of the bands next to it, this near a pole.
        edge = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * size + 2 * size, F.lit(90.0))
        reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(size / 2))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9)))))
        many = F.floor(F.lit(360.0) / reach)
        return F.when((edge >= 90) | (many < 3), 1).otherwise(many).cast("long")

    def part(y: Column, many: Column) -> Column:
        return F.least(F.floor(F.pmod(y + 180, F.lit(360.0)) / 360 * many), many - 1).cast("long")

    return size, parts, part


def _around(x: Column, y: Column, metres: float) -> Column:
    """The parts (band, part) that a place's neighbours may be in, its own included."""
    size, parts, part = _grid(metres)
    bands = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: (F.floor(x / size) + i).cast("long"))
    near = lambda b: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(part(y, parts(b)) + d, parts(b))))
    return F.flatten(F.transform(bands, lambda b: F.transform(near(b), lambda q: F.struct(b.alias("band"), q.alias("part")))))


#: Levels of the grids that boxes meet in: each has twice the width of the one before, the last one is the globe.
_LEVELS = 30


def _touching(boxes: DataFrame, metres: float) -> DataFrame:
    """u, v: boxes of one area (id, area, lo_x, hi_x, lo_y, hi_y) that may hold points within the distance of each other.

    A box is widened by the distance, and cut at the 180th meridian. It is on the level whose parts are as wide as it,
    so that it lies in four of them at most; boxes meet in the parts of the larger one's level.
    """
    size = metres / 111_194.0 * 1.001
    far = F.least(F.greatest(F.abs("lo_x"), F.abs("hi_x")) + 2 * size, F.lit(90.0))
    ratio = F.sin(F.radians(F.lit(size))) / F.greatest(F.cos(F.radians(far)), F.lit(1e-9))
    reach = F.when(ratio >= 1, 360.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    wide = boxes.select("id", "area", (F.col("lo_x") - size).alias("a"), (F.col("hi_x") + size).alias("b"), (F.col("lo_y") - reach).alias("c"), (F.col("hi_y") + reach).alias("d"))
    turned = F.array(*(F.struct((F.greatest(F.col("c") + t, F.lit(-180.0))).alias("c"), F.least(F.col("d") + t, F.lit(180.0)).alias("d")) for t in (0.0, 360.0, -360.0)))
    wide = wide.select("id", "area", "a", "b", F.inline(turned)).where("c <= d")
    plain = boxes.select("id", "area", F.col("lo_x").alias("a"), F.col("hi_x").alias("b"), F.col("lo_y").alias("c"), F.col("hi_y").alias("d"))

    def on_levels(df: DataFrame, side: str, all_levels: bool) -> DataFrame:
        extent = F.greatest(F.col("b") - F.col("a"), F.col("d") - F.col("c"))
        own = F.greatest(F.lit(0), F.least(F.lit(_LEVELS), F.ceil(F.log2(F.greatest(extent / size, F.lit(1.0)))))).cast("int")
        levels = F.sequence(own, F.lit(_LEVELS)) if all_levels else F.array(own)
        each = df.withColumn("level", F.explode(levels)).withColumn("w", F.pow(F.lit(2.0), F.col("level")) * size)
        at = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / F.col("w")), F.floor(F.col(hi) / F.col("w"))))
        each = each.withColumn("i", at("a", "b")).withColumn("j", at("c", "d"))
        return each.select("area", "level", "i", "j", *(F.col(x).alias(f"{side}_{x}") for x in ("id", "a", "b", "c", "d")))

    found = None
    for large, small in ((on_levels(wide, "u", False), on_levels(plain, "v", True)), (on_levels(wide, "u", True), on_levels(plain, "v", False))):
        met = large.join(small, ["area", "level", "i", "j"]).where("u_id <> v_id and u_a <= v_b and v_a <= u_b and u_c <= v_d and v_c <= u_d")
        met = met.select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def islands(df: DataFrame, lat: str, lon: str, metres: float, area: str) -> DataFrame:
    """Adds __island to rows with a place: the bounding boxes of two islands of an area are further apart than the distance.

    Parts of a fine grid that are occupied and next to each other are linked; the boxes of what is linked are joined
    while they are near. Only parts and boxes are joined, never places with places.
    """
    size, parts, part = _grid(metres)
    x, y = F.col(lat).cast("double"), F.col(lon).cast("double")
    node = lambda band, q: F.xxhash64(area, band.cast("long"), q)  # noqa: E731  (two parts of one hash only make an island larger)
    placed = df.withColumn("__node", node(F.floor(x / size), part(y, parts(F.floor(x / size)))))
    near = placed.select(F.col("__node").alias("u"), F.col(area).alias(area), F.explode(_around(x, y, metres)).alias("c"))
    near = near.select("u", node(F.col("c.band"), F.col("c.part")).alias("v")).distinct()
    there = placed.select(F.col("__node").alias("v")).distinct()
    comp = connected_components(near.join(there, "v"), "u", "v")
    while True:
        told = placed.join(comp, placed["__node"] == comp["node"]).groupBy(F.col("component").alias("id"), F.col(area).alias("area"))
        boxes = written(told.agg(F.min(x).alias("lo_x"), F.max(x).alias("hi_x"), F.min(y).alias("lo_y"), F.max(y).alias("hi_y")), "boxes")
        links = written(_touching(boxes, metres), "near_boxes")
        merged = links.limit(1).count() > 0
        if merged:
            joined = connected_components(links, "u", "v").select(F.col("node").alias("component"), F.col("component").alias("least"))
            before, comp = comp, written(comp.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "islands")
            remove(before)
        remove(boxes)
        remove(links)
        if not merged:
            return placed.join(comp, placed["__node"] == comp["node"]).select(*df.columns, F.col("component").alias("__island"))


def _followed(pdf: pd.DataFrame, metres: float) -> pd.DataFrame:
    """Leader clustering of one island in key order: key, area, island and the key of the cluster's first item."""
    pdf = pdf.sort_values("__key", kind="stable").reset_index(drop=True)
    centres, labels = np.zeros((len(pdf), 3)), np.zeros(len(pdf), np.int64)
    n, first = 0, []
    for row, (a, b) in enumerate(zip(pdf["__lat"], pdf["__lon"], strict=True)):
        near = metres_apart(a, b, centres[:n, 0], centres[:n, 1]) <= metres
        at = int(near.argmax()) if near.any() else n
        if at == n:
            first.append(row)
            n += 1
        many = centres[at, 2]
        centres[at] = (centres[at, 0] * many + a) / (many + 1), (centres[at, 1] * many + b) / (many + 1), many + 1
        labels[row] = at
    pdf["__first"] = pdf["__key"].to_numpy()[np.array(first, int)[labels]]
    return pdf[["__key", "__area", "__island", "__first"]]


def place_leaders(df: DataFrame, key: str, lat: str, lon: str, metres: float = 300.0, by: str | None = None) -> DataFrame:
    """Adds place: leader clustering in key order, each item to the first cluster whose running centroid is near.

    The result depends on the order of items that can meet: a centroid stays in the bounding box of its items, so that
    islands whose boxes are further apart than the distance (see islands), within each area if ``by`` names one, are
    sequences of their own, each a task. An island of more than LEADERS items is refused beforehand. Clusters are
    numbered by size, then by their first item; keys must name items. Items without a place have none.
    """
    x, y = F.col(lat).cast("double"), F.col(lon).cast("double")
    there = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    area = F.struct(F.col(by)) if by else F.struct(F.lit(1))
    items = df.where(there).select(F.col(key).alias("__key"), area.alias("__area"), x.alias("__lat"), y.alias("__lon"))
    split = written(islands(items, "__lat", "__lon", metres, "__area"), "places")
    largest = split.groupBy("__area", "__island").count().agg(F.max("count")).first()[0] or 0
    if largest > LEADERS:
        raise ValueError(f"an island of {largest} items, more than {LEADERS}: name areas in by, each of which is divided by itself")
    kinds = dict(split.dtypes)
    schema = f"__key {kinds['__key']}, __area {kinds['__area']}, __island long, __first {kinds['__key']}"
    found = split.groupBy("__area", "__island").applyInPandas(lambda pdf: _followed(pdf, metres), schema)
    found = written(found.drop("__island"), "leaders")
    remove(split)
    clusters = found.groupBy("__area", "__first").agg(F.count(F.lit(1)).alias("__size"))
    named = numbered(clusters, ["__area"], F.struct(-F.col("__size"), F.col("__first")), ["__first"], count=None)
    labels = found.join(named.select("__area", "__first", (F.col("__r") - 1).alias("place")), ["__area", "__first"]).select("__key", F.col("__area").alias("__of"), "place")
    whole = df.withColumn("__by", area)
    return whole.join(labels, (whole[key] == labels["__key"]) & (whole["__by"] == labels["__of"]), "left").select(*(whole[c] for c in df.columns), "place")


def place_links(df: DataFrame, key: str, lat: str, lon: str, metres: float = 300.0) -> DataFrame:
    """Pairs of items within a distance, by a grid join of distinct places on cells at least as large as the distance.

    A cell is a band of latitude and, within it, a part of the circle of longitude, whose number wraps around at the
    180th meridian. Distances are taken between places; their items are dealt to blocks, and each two blocks of near
    places make their pairs in one row's reach, so that no place is one task however many items it has. Partitions
    follow the pairs, about as many as all items of a cell make.
    """
    size, parts, part = _grid(metres)
    items = written(df.select(F.col(key).alias("a"), F.col(lat).alias("x"), F.col(lon).alias("y")).where("a is not null and x is not null and y is not null"), "places")
    spots = items.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    here = spots.select("x", "y", F.floor(F.col("x") / size).alias("band")).withColumn("part", part(F.col("y"), parts(F.col("band"))))
    around = spots.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.inline(_around(F.col("x"), F.col("y"), metres)))
    near = here.join(around, ["band", "part"]).where(F.struct("x", "y") <= F.struct("x2", "y2"))
    near = near.withColumn("metres", haversine(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))).where(F.col("metres") <= metres).select("x", "y", "x2", "y2", "metres")
    blocks = items.join(spots, ["x", "y"]).groupBy("x", "y", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("i")).agg(F.collect_list("a").alias("a"))
    others = blocks.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("i").alias("i2"), F.col("a").alias("b"))
    one = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))
    both = near.join(blocks, ["x", "y"]).join(others, ["x2", "y2"]).where(~one | (F.col("i") <= F.col("i2")))
    band = F.floor(F.col("x") / size)
    cells = items.groupBy(band.alias("band"), part(F.col("y"), parts(band)).alias("part")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    made = cells.agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0
    many = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(made // TASK_PAIRS) + 1)
    both = both.repartition(many, "x", "y", "i", "x2", "y2", "i2").select("a", "b", "metres", (one & (F.col("i") == F.col("i2"))).alias("own"))
    # coalesce merges nothing here: it parts the two explodes, which else are one loop that copies all pairs of two blocks
    # before it hands on the first of them.
    heads = both.select(F.explode("a").alias("a"), "b", "metres", "own").coalesce(many)
    pairs = heads.select("a", F.explode("b").alias("b"), "metres", "own")
    pairs = pairs.where(F.when(F.col("own"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "metres")
