"""Exact and loose duplicates: groups, label conflicts, overlap of whole splits, redundancy, numbering, clean export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered


def duplicate_groups(df: DataFrame, digest: str, split: str) -> DataFrame:
    """digest, n, n_splits, spans_splits of contents that occur more than once."""
    return df.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(split).alias("n_splits")).where("n > 1").withColumn("spans_splits", F.col("n_splits") > 1)


def label_conflicts(df: DataFrame, digest: str, cls: str, split: str) -> DataFrame:
    """digest, n, n_classes, verdict: conflict (several classes), split_duplicate (one class, several splits) or copy."""
    g = df.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(cls).alias("n_classes"), F.countDistinct(split).alias("n_splits")).where("n > 1")
    return g.select(digest, "n", "n_classes", F.when(F.col("n_classes") > 1, "conflict").when(F.col("n_splits") > 1, "split_duplicate").otherwise("copy").alias("verdict"))


def class_pairs(df: DataFrame, digest: str, cls: str, top: int = 15) -> DataFrame:
    """class_a, class_b, n: contents that both classes have, the most frequent pairs."""
    d = df.select(digest, cls).distinct()
    a, b = d.select(digest, F.col(cls).alias("class_a")), d.select(digest, F.col(cls).alias("class_b"))
    return a.join(b, digest).where("class_a < class_b").groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class_a", "class_b").limit(top)


def conflicting_copies(df: DataFrame, digest: str, cls: str) -> DataFrame:
    """For each class, its items whose content another class has too."""
    bad = df.groupBy(digest).agg(F.countDistinct(cls).alias("k")).where("k > 1").select(digest)
    return df.join(bad, digest, "left_semi").groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def train_without_test(df: DataFrame, digest: str, split: str = "split") -> DataFrame:
    """Train rows whose content is not in test."""
    return df.where(F.col(split) == "train").join(df.where(F.col(split) == "test").select(digest).distinct(), digest, "left_anti")


def whole_split_overlap(df: DataFrame, digest: str, cls: str, split: str = "split", same: float = 95.0) -> DataFrame:
    """cls, split_a, split_b, n_a, n_b, n_both, pct_a, pct_b, same_set over distinct contents."""
    d = df.select(cls, split, digest).distinct()
    n = d.groupBy(cls, split).agg(F.count(F.lit(1)).alias("n"))
    a, b = d.withColumnRenamed(split, "split_a"), d.withColumnRenamed(split, "split_b")
    both = a.join(b, [cls, digest]).where("split_a < split_b").groupBy(cls, "split_a", "split_b").agg(F.count(F.lit(1)).alias("n_both"))
    out = both.join(n.select(cls, F.col(split).alias("split_a"), F.col("n").alias("n_a")), [cls, "split_a"]).join(n.select(cls, F.col(split).alias("split_b"), F.col("n").alias("n_b")), [cls, "split_b"])
    out = out.withColumn("pct_a", 100.0 * F.col("n_both") / F.col("n_a")).withColumn("pct_b", 100.0 * F.col("n_both") / F.col("n_b"))
    return out.withColumn("same_set", (F.col("pct_a") > same) & (F.col("pct_b") > same))


def redundancy(df: DataFrame, cluster: str, digest: str, loose: str, cls: str, split: str, null_is_value: bool = False) -> DataFrame:
    """For clusters of two or more: byte copies, re-encoded copies, distinct shots, and how many splits they span.

    null_is_value: an unknown digest counts as one more value; else it counts as none.
    """
    distinct = lambda c: F.countDistinct(c) + (F.max(F.col(c).isNull().cast("int")) if null_is_value else F.lit(0))
    g = df.groupBy(cluster).agg(F.min(cls).alias("cls"), F.count(F.lit(1)).alias("n"), distinct(digest).alias("d"), distinct(loose).alias("p"), F.countDistinct(split).alias("n_splits")).where("n > 1")
    g = g.withColumn("byte", F.col("n") - F.col("d")).withColumn("reenc", F.greatest(F.col("n") - F.col("p") - F.col("byte"), F.lit(0)))
    return g.withColumn("shots", F.greatest(F.col("n") - 1 - F.col("byte") - F.col("reenc"), F.lit(0))).select(cluster, "cls", "n", "byte", "reenc", "shots", "n_splits")


def redundancy_kind(clusters: DataFrame, by: list[str]) -> DataFrame:
    """copy_share and kind: none, copy-dominated (> 0.7), burst-dominated (< 0.3) or mixed."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("byte", "reenc", "shots")]
    g = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clusters"), *sums) if by else clusters.agg(F.count(F.lit(1)).alias("n_clusters"), *sums)
    share = (F.col("byte") + F.col("reenc")) / F.nullif((F.col("byte") + F.col("reenc") + F.col("shots")).cast("double"), F.lit(0.0))
    g = g.withColumn("copy_share", share)
    return g.withColumn("kind", F.when(F.col("copy_share").isNull(), "none").when(F.col("copy_share") > 0.7, "copy-dominated").when(F.col("copy_share") < 0.3, "burst-dominated").otherwise("mixed"))


def cross_split_composition(clusters: DataFrame) -> DataFrame:
    """n_clusters, n_straddling, copies, distinct: of redundancy()'s clusters those in several splits, and what they
    hold beyond one item each. Copies across splits are a fault of assembly, distinct items one of partitioning."""
    torn = F.col("n_splits") > 1
    beyond = lambda *c: F.coalesce(F.sum(F.when(torn, sum(F.col(x) for x in c))), F.lit(0))
    return clusters.agg(F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.sum(torn.cast("long")), F.lit(0)).alias("n_straddling"), beyond("byte", "reenc").alias("copies"), beyond("shots").alias("distinct"))


def clean_export(df: DataFrame, key: str, digest: str, cls: str, split: str, near: DataFrame | None = None, same_class_only: bool = False) -> DataFrame:
    """The rows that stay: no content under several classes, no copy outside train of a content that train has,
    and no held-out row with a near hit in train (near: held_key, held_cls, train_cls).

    By default a near hit counts whatever the classes; same_class_only restricts it.
    """
    conflict = df.groupBy(digest).agg(F.countDistinct(cls).alias("k")).where("k > 1").select(digest)
    train = df.where(F.col(split) == "train").select(digest).distinct()
    stay = df.join(conflict, digest, "left_anti")
    held = stay.where(F.col(split) != "train").join(train, digest, "left_anti")
    if near is not None:
        hits = near.where(F.col("held_cls") == F.col("train_cls")) if same_class_only else near
        held = held.join(hits.select(F.col("held_key").alias(key)).distinct(), key, "left_anti")
    return stay.where(F.col(split) == "train").unionByName(held)


def number_conflicts(df: DataFrame, prefix: str, num: str, cls: str) -> DataFrame:
    """Numbers that several classes use under one prefix."""
    return df.groupBy(prefix, num).agg(F.countDistinct(cls).alias("n_classes"), F.count(F.lit(1)).alias("n")).where("n_classes > 1")


def adjacent_across(df: DataFrame, key: str, prefix: str, num: str, cls: str) -> DataFrame:
    """Pairs of items numbered n and n + 1 under one prefix in different classes."""
    a = df.select(F.col(prefix).alias("prefix"), F.col(num).alias("num"), F.col(key).alias("key_a"), F.col(cls).alias("cls_a"))
    b = df.select(F.col(prefix).alias("prefix"), (F.col(num) - 1).alias("num"), F.col(key).alias("key_b"), F.col(cls).alias("cls_b"))
    return a.join(b, ["prefix", "num"]).where("cls_a <> cls_b")


def adjacent_straddling(pairs: DataFrame, parts: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Of such pairs, those with one side in train and the other in test."""
    a = parts.select(F.col(key).alias("key_a"), F.col(split).alias("split_a"))
    b = parts.select(F.col(key).alias("key_b"), F.col(split).alias("split_b"))
    return pairs.join(a, "key_a").join(b, "key_b").where("(split_a = 'train' and split_b = 'test') or (split_a = 'test' and split_b = 'train')")


def numbering_adjacency(df: DataFrame, by: list[str], num: str, split: str, order: str, limit: float = 20.0) -> DataFrame:
    """n_pairs, n_crossing, pct, image_level: consecutive numbers whose splits differ. The last row (by order)
    of a number sets its split; a class with many crossings was split item by item."""
    one = df.groupBy(*by, num).agg(F.max_by(split, order).alias("split"))
    after = one.select(*by, (F.col(num) - 1).alias(num), F.col("split").alias("__s"))
    g = one.join(after, [*by, num]).groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum((F.col("split") != F.col("__s")).cast("long")).alias("n_crossing"))
    return g.withColumn("pct", 100.0 * F.col("n_crossing") / F.col("n_pairs")).withColumn("image_level", F.col("pct") > limit)


def format_mix(df: DataFrame, cls: str, form: str, size: str) -> DataFrame:
    """For each class: items, formats, sizes, and whether formats are mixed."""
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(form).alias("n_formats"), F.countDistinct(size).alias("n_sizes")).withColumn("mixed", F.col("n_formats") > 1)


def top_values(df: DataFrame, cls: str, value: str, k: int = 3) -> DataFrame:
    """The k most frequent values of each class."""
    n = df.groupBy(cls, value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(cls).orderBy(F.desc("n"), value))).where(F.col("rank") <= k)


def frequent_forms(df: DataFrame, forms: list[str], k: int = 8) -> DataFrame:
    """form, value, n: the k most frequent values of each column."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("form"), F.col(f).cast("string").alias("value")) for f in forms))).alias("x")).select("x.*")
    n = rows.groupBy("form", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("__r", F.row_number().over(Window.partitionBy("form").orderBy(F.desc("n"), "value"))).where(F.col("__r") <= k).drop("__r")


def value_profile(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, least, upper_median (element n div 2 in order) and largest of a value."""
    r = numbered(df.where(F.col(value).isNotNull()), [by], F.col(value))
    return r.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(F.when(F.col("__r") == F.floor(F.col("__n") / 2) + 1, F.col(value))).alias("upper_median"), F.max(value).alias("largest"))
