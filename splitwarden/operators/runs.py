"""Tables of many runs: summaries, regime contrasts, pivots, spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


def run_summary(df: DataFrame, keys: list[str], metrics: list[str] | None = None) -> DataFrame:
    """mean, sd (sample) and count of every numeric column that is no key."""
    metrics = metrics or [c for c, t in df.dtypes if c not in keys and (t in NUMERIC or t.startswith("decimal"))]
    aggs = [f(c).alias(f"{c}_{name}") for c in metrics for name, f in (("mean", F.avg), ("sd", F.stddev_samp), ("n", F.count))]
    return df.groupBy(*keys).agg(*aggs)


def headline(columns: list[str]) -> str:
    """The first column with F1 in its name, else the first."""
    return next((c for c in columns if "F1" in c), columns[0])


def paired_inflation(df: DataFrame, model: str, mode: str, value: str, grouped: str = "group", imaged: str = "image") -> DataFrame:
    """model, group_mean, image_mean, inflation_pp."""
    p = df.groupBy(model).pivot(mode, [grouped, imaged]).agg(F.avg(value))
    return p.select(model, F.col(f"`{grouped}`").alias("group_mean"), F.col(f"`{imaged}`").alias("image_mean"), (F.col(f"`{imaged}`") - F.col(f"`{grouped}`")).alias("inflation_pp"))


def inflation_range(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("inflation_pp").alias("mean_pp"), F.min("inflation_pp").alias("least_pp"), F.max("inflation_pp").alias("most_pp"))


def usable(df: DataFrame, degenerate: str, kind: str) -> DataFrame:
    """Rows that are neither degenerate nor dominated by copies."""
    return df.where(~F.col(degenerate) & (F.col(kind) != "copy-dominated"))


def comparable(df: DataFrame, degenerate: str, kind: str, least: int = 5) -> DataFrame:
    """n_usable, n_rows and few: whether too few rows are usable to fit a relationship across them."""
    use = F.count_if(~F.col(degenerate) & (F.col(kind) != "copy-dominated"))
    return df.agg(use.alias("n_usable"), F.count(F.lit(1)).alias("n_rows")).withColumn("few", F.col("n_usable") < least)


def sweep_spread(df: DataFrame, value: str, by: list[str], degenerate: str | None = None, wide: float = 15.0, stable: float = 10.0) -> DataFrame:
    """n, least, most, spread and verdict of a value over rows that are not degenerate."""
    rows = df if degenerate is None else df.where(~F.col(degenerate))
    aggs = [F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most")]
    out = (rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)).withColumn("spread", F.col("most") - F.col("least"))
    return out.withColumn("verdict", F.when(F.col("spread") > wide, "wide").when(F.col("spread") <= stable, "stable").otherwise("moderate"))


def pivoted(df: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))


def transfer_gap(df: DataFrame, model: str, domain: str, value: str, source: str, target: str) -> DataFrame:
    """model, source_mean, target_mean, gap, gap_pct."""
    p = df.groupBy(model).agg(F.avg(F.when(F.col(domain) == source, F.col(value))).alias("source_mean"), F.avg(F.when(F.col(domain) == target, F.col(value))).alias("target_mean"))
    p = p.withColumn("gap", F.col("source_mean") - F.col("target_mean"))
    return p.withColumn("gap_pct", 100.0 * F.col("gap") / F.nullif(F.col("source_mean"), F.lit(0.0)))


def narrowing(before: DataFrame, after: DataFrame, model: str) -> DataFrame:
    """How much of a gap a second condition closes, in percent."""
    b, a = before.select(model, F.col("gap").alias("gap_before")), after.select(model, F.col("gap").alias("gap_after"))
    return b.join(a, model).withColumn("narrowed_pct", 100.0 * (F.col("gap_before") - F.col("gap_after")) / F.nullif(F.col("gap_before"), F.lit(0.0)))


def mean_sd_text(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.format_string("%.2f±%.2f", F.avg(value), F.stddev_samp(value)).alias(value))


def replaced(df: DataFrame, new: DataFrame, model: str) -> DataFrame:
    """Rows of the new table take the place of all rows of its models."""
    return df.join(new.select(model).distinct(), model, "left_anti").select(*df.columns).unionByName(new, allowMissingColumns=True)


def condition_bands(df: DataFrame, by: list[str], value: str, high: float = 70.0, middle: float = 45.0) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("band", F.when(F.col("mean") > high, "high").when(F.col("mean") > middle, "middle").otherwise("low"))


def histories(df: DataFrame, by: list[str]) -> DataFrame:
    """One row an epoch from arrays train_loss, val_loss, train_acc, val_acc."""
    names = ["train_loss", "val_loss", "train_acc", "val_acc"]
    return df.select(*by, F.posexplode(F.arrays_zip(*names)).alias("epoch", "x")).select(*by, "epoch", *(F.col(f"x.{c}").alias(c) for c in names))
