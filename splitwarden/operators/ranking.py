"""Row numbers and runs within classes without sorting a class in one task.

Rows are dealt to slices of the order, each slice is numbered by itself, and the sizes of the slices before it
are added. Slices are the first digits of an order that is spread evenly, as an MD5 is, or the parts of a range
partitioning over class, order and ties, whose bounds Spark samples: they are of about one size however skewed the
values are, and rows of one value are split by their ties. Such a dealing is written, so that all later steps, and
tasks that are run again, see one and the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

SLICES = 4096
#: Rows of a partition where their number follows the input.
TASK_ROWS = 100_000


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def parts_of(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Partitions of so many rows at most, the session's number at least. Counts df, which is best a written table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def dealt(df: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """Adds __slice, which ascends with the order: rows in range partitions, written."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *order).withColumn("__slice", F.spark_partition_id()), "slices")


def numbered(df: DataFrame, by: list[str], order: Column, tie: list[Column | str] | None = None, rank: str = "__r", count: str | None = "__n", even: bool = False) -> DataFrame:
    """Adds rank, from 1, in ascending order (nulls first) within by, and the number of rows of the class.

    tie settles equal values of order; without it a hash of the row does. Equal rows are numbered in no defined order. even: the order is a string
    whose first three characters are spread evenly, such as an MD5.
    """
    by, tie = [*by], list(tie or [F.xxhash64(*(F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")))])
    base = df.withColumn("__order", order)
    if even:
        base = base.withColumn("__slice", F.coalesce(F.substring(F.col("__order").cast("string"), 1, 3), F.lit("")))
    else:
        base = dealt(base, *by, "__order", *tie)
    w = Window.partitionBy(*by, "__slice")
    sizes = base.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__m"))
    classes = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    told = [F.coalesce(F.sum("__m").over(classes.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")]
    if count:
        told.append(F.sum("__m").over(classes).alias(count))
    offsets = sizes.select(*by, "__slice", *told)
    local = base.withColumn("__local", F.row_number().over(w.orderBy("__order", *tie)))
    out = local.join(offsets, _same(local, offsets, [*by, "__slice"]), "left").select(*(local[c] for c in df.columns if c != rank), (F.col("__local") + F.col("__before")).alias(rank), *([offsets[count]] if count else []))
    return out


def runs(df: DataFrame, by: list[str], num: str, tie: str, gaps: list[float], out: str = "__runs", parts: int | None = None) -> DataFrame:
    """Adds an array with the number of the run within by for each gap, from 0: in the order of num and tie a new run
    begins where num exceeds the one before by more than the gap.

    A segmented scan: each slice of the order counts its own runs; the last number and the runs of the slices before are
    carried forward in a table of one row for each slice of a class. No class is one group of rows. parts: slices and
    partitions, for inputs that outgrow the session's number.
    """
    base = dealt(df.withColumn("__by", F.struct(*by)), "__by", num, tie, parts=parts)
    base = base.repartition(parts, "__by", "__slice") if parts else base
    w = Window.partitionBy("__by", "__slice").orderBy(num, tie)
    base = base.withColumn("__gap", F.col(num) - F.lag(num).over(w))
    begun = lambda gap, g: F.when(gap > g, 1).otherwise(0)
    local = base.withColumn("__local", F.array(*(F.sum(begun(F.col("__gap"), g)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long") for g in gaps)))
    ends = local.groupBy("__by", "__slice").agg(F.min(num).alias("lo"), F.max(num).alias("hi"), *(F.max(F.get("__local", F.lit(i))).alias(f"n{i}") for i in range(len(gaps))))
    order = Window.partitionBy("__by").orderBy("__slice")
    step = F.col("lo") - F.lag("hi").over(order)
    ends = ends.select("__by", "__slice", *(f"n{i}" for i in range(len(gaps))), *(begun(step, g).alias(f"s{i}") for i, g in enumerate(gaps)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = ends.select("__by", "__slice", F.array(*((F.sum(F.col(f"n{i}") + F.col(f"s{i}")).over(upto) - F.col(f"n{i}")).cast("long") for i in range(len(gaps)))).alias("__before"))
    joined = local.join(before, ["__by", "__slice"])
    return joined.select(*df.columns, F.zip_with("__local", "__before", lambda x, y: x + y).alias(out))


def average_ranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """value, out: each distinct value with the mean place, from 1, that its rows have in ascending order.

    Values are counted before they are dealt, so that one that nearly all rows have is one row.
    """
    per = dealt(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__m")), value)
    local = per.withColumn("__upto", F.sum("__m").over(Window.partitionBy("__slice").orderBy(value)))
    sizes = per.groupBy("__slice").agg(F.sum("__m").alias("__all"))  # one row a partition
    sizes = sizes.select("__slice", (F.sum("__all").over(Window.partitionBy(F.lit(1)).orderBy("__slice")) - F.col("__all")).alias("__before"))
    return local.join(F.broadcast(sizes), "__slice").select(value, (F.col("__before") + F.col("__upto") - (F.col("__m") - 1) / 2.0).alias(out))


def median(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """median: one row, exact. Counts of equal widths from lo to hi tell which of them hold the middle; only their
    rows are sorted. Null values are left out; values beyond lo and hi count in the outer widths."""
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    x = x.withColumn("slice", F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.floor((F.col("x") - lo) * (SLICES / (hi - lo))))))
    one = Window.partitionBy(F.lit(1))  # SLICES rows
    sizes = x.groupBy("slice").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.sum("m").over(one.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).withColumn("n", F.sum("m").over(one))
    first, last = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    middle = sizes.where((F.col("before") < last) & (F.col("before") + F.col("m") >= first))
    rows = x.join(F.broadcast(middle), "slice")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("slice").orderBy("x")) + F.col("before"))
    return ranked.where((F.col("r") == first) | (F.col("r") == last)).agg(F.avg("x").alias("median"))
