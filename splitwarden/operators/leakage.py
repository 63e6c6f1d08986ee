"""How partitions tear groups apart: sibling leakage, straddling, overlap, exposure, group shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import numbered


def manifest_join(items: DataFrame, manifest: DataFrame, on: list[str], unmapped: str = "keep") -> DataFrame:
    """Items with their session. unmapped: keep (as groups of one, unmapped:...), drop, or fail if there are any."""
    m = manifest.select(*on, "session").dropDuplicates(on)
    if unmapped == "drop":
        return items.join(m, on, "inner")
    if unmapped == "fail":
        lacking = items.join(m, on, "left_anti").limit(1).count()
        if lacking:
            raise ValueError("the manifest lacks items of the table")
    return items.join(m, on, "left").withColumn("session", F.coalesce("session", F.concat_ws(":", F.lit("unmapped"), *(F.col(c).cast("string") for c in on))))


def missing_keys(items: DataFrame, manifest: DataFrame, on: list[str]) -> DataFrame:
    return items.join(manifest.select(*on).distinct(), on, "left_anti")


def sibling_flags(df: DataFrame, group: str, by: list[str] | None = None, split: str = "split") -> DataFrame:
    """Test items with hit: whether an item of their group is in train. One shuffle on the group."""
    keys = [*(by or []), group]
    train = df.where(F.col(split) == "train").select(*keys).distinct().withColumn("hit", F.lit(True))
    return df.where(F.col(split) == "test").join(train, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def sibling_leakage(df: DataFrame, group: str, by: list[str] | None = None, split: str = "split") -> DataFrame:
    """n_test, n_leaked, leak_pct and shared_groups; without test items the rate is null."""
    flags = sibling_flags(df, group, by, split)
    rate = (100.0 * F.sum(F.col("hit").cast("int")) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("leak_pct")
    aggs = [F.count(F.lit(1)).alias("n_test"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("n_leaked"), rate, F.countDistinct(F.when(F.col("hit"), F.col(group))).alias("shared_groups")]
    return flags.groupBy(*by).agg(*aggs) if by else flags.agg(*aggs)


def leakage_by_seed(df: DataFrame, group: str, by: list[str], splits: dict[int, str], parts: int | None = None) -> DataFrame:
    """by, seed, n_test, n_leaked, leak_pct, n_groups, largest for items whose split of each seed is a column (splits: seed to column).

    Groups are counted once for all seeds: neither items by seed nor a join of them are shuffled. parts: partitions of the groups.
    """
    df = df.repartition(parts, *by, group) if parts else df
    each = [F.struct(F.lit(s).alias("seed"), F.count_if(F.col(c) == "test").alias("test"), F.coalesce(F.bool_or(F.col(c) == "train"), F.lit(False)).alias("hit")) for s, c in splits.items()]
    groups = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), *(x.alias(f"s{i}") for i, x in enumerate(each)))
    told = [F.struct(F.lit(s).alias("seed"), F.sum(f"s{i}.test").alias("n_test"), F.sum(F.when(F.col(f"s{i}.hit"), F.col(f"s{i}.test")).otherwise(0)).alias("n_leaked")) for i, s in enumerate(splits)]
    rates = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"), F.array(*told).alias("seeds"))
    rates = rates.select(*by, "n_groups", "largest", F.inline("seeds"))
    return rates.select(*by, "seed", "n_test", "n_leaked", (100.0 * F.col("n_leaked") / F.nullif(F.col("n_test"), F.lit(0))).alias("leak_pct"), "n_groups", "largest")


def over_seeds(rates: DataFrame, value: str, by: list[str], sample: bool = True) -> DataFrame:
    """mean and sd of a value over seeds; sample: n - 1 in the denominator, else n."""
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    aggs = [F.count(F.lit(1)).alias("n_seeds"), F.avg(value).alias("mean"), sd.alias("sd")]
    return rates.groupBy(*by).agg(*aggs) if by else rates.agg(*aggs)


def _spread(df: DataFrame, group: str, split: str) -> DataFrame:
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n_items"))


def straddling(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """n_groups, n_straddling, n_items, items_straddling, pct: groups that lie in more than one split."""
    s = _spread(df, group, split)
    torn = F.col("n_splits") > 1
    return s.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum(torn.cast("long")), F.lit(0)).alias("n_straddling"),
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"),
        F.coalesce(F.sum(F.when(torn, F.col("n_items"))), F.lit(0)).alias("items_straddling"),
        (100.0 * F.coalesce(F.sum(F.when(torn, F.col("n_items"))), F.lit(0)) / F.nullif(F.sum("n_items"), F.lit(0))).alias("pct"),
    )


def _first(df: DataFrame, by: list[str], key: str, most: int, out: str) -> DataFrame:
    """The least keys of each group. Each task keeps the first ones of its rows before the shuffle, so that no
    list is longer than most."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    return df.select(*by, key).withColumn("__r", rank).where(F.col("__r") <= most).groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias(out))


def layout(df: DataFrame, group: str, key: str, split: str = "split", most: int = 12) -> DataFrame:
    """For each straddling group and split: items, and the first of them (a listing, most long)."""
    torn = df.join(_spread(df, group, split).where("n_splits > 1").select(group), group)
    return torn.groupBy(group, split).agg(F.count(F.lit(1)).alias("n_items")).join(_first(torn, [group, split], key, most, "first_items"), [group, split])


def exposure(df: DataFrame, cls: str, group: str, split: str = "split") -> DataFrame:
    """For each class: items, groups, and the items in straddling groups."""
    torn = _spread(df, group, split).where("n_splits > 1").select(group, F.lit(1).alias("torn"))
    return df.join(torn, group, "left").groupBy(cls).agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct(group).alias("n_groups"), F.coalesce(F.sum("torn"), F.lit(0)).cast("long").alias("leaky_items"))


def split_overlap(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """from_split, to_split, n_items, n_shared, pct: items of one split whose group also lies in another."""
    per = df.groupBy(group, F.col(split).alias("from_split")).agg(F.count(F.lit(1)).alias("n"))
    other = per.select(group, F.col("from_split").alias("to_split"))
    shared = per.join(other, group).where("from_split <> to_split").groupBy("from_split", "to_split").agg(F.sum("n").alias("n_shared"))
    whole = per.groupBy("from_split").agg(F.sum("n").alias("n_items"))
    return shared.join(whole, "from_split").select("from_split", "to_split", "n_items", "n_shared", (100.0 * F.col("n_shared") / F.col("n_items")).alias("pct"))


def group_shape(df: DataFrame, group: str) -> DataFrame:
    """n_items, n_groups, mean_size, singleton_pct, largest."""
    s = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.count(F.lit(1)).alias("n_groups"), F.avg("n").alias("mean_size"), (100.0 * F.avg((F.col("n") == 1).cast("double"))).alias("singleton_pct"), F.max("n").alias("largest"))


def group_ranks(df: DataFrame, group: str, cls: str) -> DataFrame:
    """Groups by size: rank within the class, share of the class."""
    s = df.groupBy(cls, group).agg(F.count(F.lit(1)).alias("n"))
    whole = df.groupBy(cls).agg(F.count(F.lit(1)).alias("__all")).withColumnRenamed(cls, "__cls")
    ranked = numbered(s, [cls], -F.col("n"), [group], "size_rank", None)
    return ranked.join(whole, ranked[cls].eqNullSafe(whole["__cls"])).select(ranked["*"], (F.col("n") / F.col("__all")).alias("share"))


def group_structure(df: DataFrame, group: str, top: int = 10) -> DataFrame:
    """n_groups, n_items, median_size, largest, top_items, top_share, n_singletons."""
    s = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    best = s.orderBy(F.desc("n"), group).limit(top).agg(F.sum("n").alias("top_items"))
    # The median comes from the table of distinct sizes, which is short however many groups there are.
    sizes = s.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    whole = sizes.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_groups"), F.sum(F.col("n") * F.col("k")).alias("n_items"), F.percentile("n", F.lit(0.5), F.col("k")).alias("median_size"), F.max("n").alias("largest"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("k"))), F.lit(0)).alias("n_singletons"))
    return whole.crossJoin(best).withColumn("top_share", 100.0 * F.col("top_items") / F.col("n_items"))


def listing(df: DataFrame, group: str, key: str, split: str, k: int = 10, files: int = 4) -> DataFrame:
    """The k largest groups with their items in each split and some names."""
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col(split) == s).cast("long")).alias(f"n_{s}") for s in ("train", "val", "test")))
    top = per.orderBy(F.desc("n"), group).limit(k)
    return top.join(_first(df.join(top.select(group), group, "left_semi"), [group], key, files, "names"), group)
