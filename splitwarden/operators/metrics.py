"""Classification metrics over an explicit label set, from a long confusion table, and paired statistics.

Three macro averages differ by their label set and are three functions: the union of true and predicted labels,
a given set, and a given set over the rows whose true label is in it. Zero denominators give 0 in precision,
recall and F1, and null elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .ranking import average_ranks


def confusion(df: DataFrame, y_true: str, y_pred: str, by: list[str] | None = None) -> DataFrame:
    """by, y_true, y_pred, n of the cells that occur."""
    return df.groupBy(*(by or []), F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def dense_confusion(cells: DataFrame, labels: list, by: list[str] | None = None) -> DataFrame:
    """Every cell of the label set, with row shares (0 for empty rows)."""
    by = by or []
    frame = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    values = F.array(*(F.lit(x) for x in labels))
    grid = frame.withColumn("y_true", F.explode(values)).withColumn("y_pred", F.explode(values))
    full = grid.join(cells, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    row = F.sum("n").over(Window.partitionBy(*by, "y_true"))
    return full.withColumn("row_share", F.coalesce(F.col("n") / F.nullif(row.cast("double"), F.lit(0.0)), F.lit(0.0)))


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def per_class(cells: DataFrame, by: list[str] | None = None, labels: list | None = None) -> DataFrame:
    """by, label, tp, support, predicted, precision, recall, f1; labels: exactly these, absent ones with zeros."""
    by = by or []
    rows = cells.select(*by, F.col("y_true").alias("label"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"))
    cols = cells.select(*by, F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))
    if labels is not None:
        frame = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
        zero = frame.withColumn("label", F.explode(F.array(*(F.lit(x) for x in labels)))).select(*by, "label", *(F.lit(0).cast("long").alias(c) for c in ("tp", "support", "predicted")))
        rows, cols = rows.where(F.col("label").isin(*labels)).unionByName(zero), cols.where(F.col("label").isin(*labels))
    g = rows.unionByName(cols).groupBy(*by, "label").agg(*(F.sum(c).alias(c) for c in ("tp", "support", "predicted")))
    g = g.withColumn("precision", _safe(F.col("tp"), F.col("predicted"))).withColumn("recall", _safe(F.col("tp"), F.col("support")))
    return g.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(cells: DataFrame, by: list[str] | None = None, labels: list | None = None) -> DataFrame:
    """n, accuracy, macro_precision, macro_recall, macro_f1, n_absent (predictions outside the label set)."""
    by = by or []
    p = per_class(cells, by, labels)
    avgs = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    outside = F.lit(0) if labels is None else F.when(~F.col("y_pred").isin(*labels), F.col("n")).otherwise(0)
    whole = [F.sum("n").alias("n"), (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum(outside).cast("long").alias("n_absent")]
    if by:
        return cells.groupBy(*by).agg(*whole).join(p.groupBy(*by).agg(*avgs), by)
    return cells.agg(*whole).crossJoin(p.agg(*avgs))


def macro_union(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    return macro(cells, by)


def macro_labels(cells: DataFrame, labels: list, by: list[str] | None = None) -> DataFrame:
    return macro(cells, by, labels)


def macro_subset(cells: DataFrame, labels: list, by: list[str] | None = None) -> DataFrame:
    return macro(cells.where(F.col("y_true").isin(*labels)), by, labels)


def label_set_artefact(cells: DataFrame, labels: list, by: list[str]) -> DataFrame:
    """Both macro F1 of the rows with a true label in the set, and their difference."""
    own = cells.where(F.col("y_true").isin(*labels))
    a = macro_union(own, by).select(*by, F.col("macro_f1").alias("f1_union"))
    return a.join(macro_labels(own, labels, by).select(*by, F.col("macro_f1").alias("f1_labels")), by).withColumn("artefact", F.col("f1_labels") - F.col("f1_union"))


def chance(counts: DataFrame, n: str = "n") -> DataFrame:
    """k, uniform, prior, majority macro F1 of guessing, from class counts."""
    w = counts.agg(F.sum(n).alias("__all"), F.count(F.lit(1)).alias("k"), F.max(n).alias("__most"))
    p = counts.crossJoin(F.broadcast(w)).withColumn("p", F.col(n) / F.col("__all"))
    q = 1.0 / F.col("k")
    out = p.groupBy("k").agg(F.avg(2 * F.col("p") * q / (F.col("p") + q)).alias("uniform"), F.avg("p").alias("prior"), F.max("p").alias("__p"))
    return out.select("k", "uniform", "prior", (2 * F.col("__p") / (1 + F.col("__p")) / F.col("k")).alias("majority"))


def error_spread(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each true label: n, recall, worst destination and its share of errors, normalised entropy of errors.

    The entropy is divided by the log of the number of wrong cells with errors; 0 with one, null without errors.
    """
    keys = [*(by or []), "y_true"]
    wrong = F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0)
    c = cells.withColumn("wrong", wrong).withColumn("__w", F.sum("wrong").over(Window.partitionBy(*keys)))
    share = F.when(F.col("wrong") > 0, F.col("wrong") / F.col("__w"))
    g = c.withColumn("__p", share).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"),
        F.max(F.when(F.col("wrong") > 0, F.struct(F.col("wrong"), F.col("y_pred")))).alias("__worst"),
        F.max("__p").alias("worst_share"),
        F.sum(-F.col("__p") * F.log("__p")).alias("__h"),
        F.count("__p").alias("__k"),
    )
    return g.select(*keys, "n", "recall", F.col("__worst.y_pred").alias("worst"), "worst_share", F.when(F.col("__k") == 1, 0.0).when(F.col("__k") > 1, F.col("__h") / F.log("__k")).alias("entropy"))


def mapping_verdict(recall: Column, control_mean: Column, worst_share: Column, entropy: Column) -> Column:
    """Percent recall against the controls' mean, and whether errors concentrate."""
    worse, concentrated = recall < control_mean - 10, (worst_share > 60) | (entropy < 0.6)
    return F.when(worse & concentrated, "mapping suspect").when(worse, "hard class").when(concentrated, "one confusion").otherwise("consistent")


def mcnemar(df: DataFrame, right_a: str, right_b: str, by: list[str] | None = None, p_value: bool = False) -> DataFrame:
    """b, c, chi2 with continuity correction (null without discordant items), and p on demand."""
    from ..functions.kernels import chi2_sf_one

    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    aggs = [n(F.col(right_a) & ~F.col(right_b)).alias("b"), n(~F.col(right_a) & F.col(right_b)).alias("c")]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    out = out.withColumn("chi2", F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / F.nullif((F.col("b") + F.col("c")).cast("double"), F.lit(0.0)))
    return out.withColumn("p", chi2_sf_one(F.col("chi2"))) if p_value else out


def one_way_anova(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """f, df_between, df_within and p of the hypothesis that all groups have one mean. Null values and rows without a
    group are left out; f and p are null with fewer than two groups, without spare items, or without variance within.

    Groups are summed before anything meets: one row a group, then one row for each value of by.
    """
    from ..functions.kernels import f_sf

    by = by or []
    known = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    per = known.groupBy(*by, group).agg(F.count(F.lit(1)).alias("__n"), F.avg(value).alias("__mean"), F.var_pop(value).alias("__var"))
    mean = F.sum(F.col("__n") * F.col("__mean")) / F.sum("__n")
    aggs = [F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__k"), mean.alias("__whole"), F.sum(F.col("__n") * F.col("__var")).alias("__within")]
    told = per.groupBy(*by).agg(*aggs) if by else per.agg(*aggs)
    # Deviations from the whole mean, not differences of squares.
    apart = F.sum(F.col("__n") * F.pow(F.col("__mean") - F.col("__whole"), 2)).alias("__between")
    if by:
        joined = per.join(told.select(*by, "__whole"), by).groupBy(*by).agg(apart).join(told.select(*by, F.col("__n"), "__k", "__within"), by)
    else:
        joined = per.crossJoin(F.broadcast(told.select("__whole"))).agg(apart).crossJoin(told.select("__n", "__k", "__within"))  # one row
    ratio = (F.col("__between") / F.nullif(F.col("__k") - 1, F.lit(0))) / F.nullif(F.col("__within") / F.nullif(F.col("__n") - F.col("__k"), F.lit(0)), F.lit(0.0))
    out = joined.select(*by, ratio.alias("f"), (F.col("__k") - 1).alias("df_between"), (F.col("__n") - F.col("__k")).alias("df_within"))
    return out.withColumn("p", f_sf(F.col("f"), F.col("df_between").cast("double"), F.col("df_within").cast("double")))


#: 97.5 % quantiles of Student's t for 1 to 30 degrees of freedom.
T_975 = (12.7062, 4.30265, 3.18245, 2.77645, 2.57058, 2.44691, 2.36462, 2.30600, 2.26216, 2.22814, 2.20099, 2.17881, 2.16037, 2.14479, 2.13145, 2.11991, 2.10982, 2.10092, 2.09302, 2.08596, 2.07961, 2.07387, 2.06866, 2.06390, 2.05954, 2.05553, 2.05183, 2.04841, 2.04523, 2.04227)


def paired_contrast(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean, lo, hi: 95 % interval of b - a with n - 1 degrees of freedom (1.96 beyond 30)."""
    d = pairs.select((F.col(b) - F.col(a)).alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    t = F.when(F.col("n") > 31, 1.96).otherwise(F.get(F.array(*(F.lit(x) for x in T_975)), (F.col("n") - 2).cast("int")))
    half = t * F.col("sd") / F.sqrt("n")
    return d.select("n", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def replicate_differences(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean_difference, largest_difference of |b - a| over replicates that have both."""
    d = F.abs(F.col(b) - F.col(a))
    return pairs.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.max(d).alias("largest_difference"))


def average_rank(value: Column, by: list[str], partition_rows: Column) -> Column:
    """Descending rank with ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value.desc())) + (F.count(F.lit(1)).over(Window.partitionBy(*by, partition_rows)) - 1) / 2.0


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, pearson, spearman (correlation of average ranks) of rows that have both values.

    The values are written first: ranks are joined by them, and means and sums that are computed again, their parts
    arriving in another order, may differ in the last bit.
    """
    r = written(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("__a"), F.col(b).alias("__b")), "values")
    r = r.join(average_ranks(r, "__a", "__ra"), "__a").join(average_ranks(r, "__b", "__rb"), "__b")
    return r.agg(F.count(F.lit(1)).alias("n"), F.corr("__a", "__b").alias("pearson"), F.corr("__ra", "__rb").alias("spearman"))
