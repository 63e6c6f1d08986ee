"""Tables that cut lineage: written to the shared folder that spark.checkpoint.dir names.

A result may read such tables until its action has ended, so that an operator cannot delete the last ones by itself.
A scope owns all that is written within it, deletes it at its end, and shares tables that are asked for again:

    with shared.scope(spark):
        jaccard_join.components(documents).write.parquet(path)
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local master gets a temporary one; a cluster must name
    a folder that all its executors share."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if not where and sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc._jsc.sc().getCheckpointDir().get()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="splitwarden-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


class Scope:
    """What was written within a scope, by one thread."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.tables: list[str] = []
        self.kept: dict[tuple, DataFrame] = {}

    def close(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in self.paths:
            _delete(self.spark, path)


_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Within it, all that this module's functions write is owned by it and goes at its end, whatever ends it. Results
    are to be used before. A scope within a scope owns its own."""
    own = Scope(spark)
    before = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(before)
        own.close()


def kept(name: str, inputs: DataFrame, parameters: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives; within a scope it is written once for the same input files and parameters, and read from then on."""
    own = _scope.get()
    if own is None:
        return make()
    key = (name, tuple(sorted(inputs.inputFiles())), parameters)
    if key not in own.kept:
        own.kept[key] = written(make(), name)
    return own.kept[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has, owned by the scope if there is one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if own := _scope.get():
        own.paths.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, a write's shuffle files go as soon as it has ended: what it wrote takes their place."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Within it, Python tasks get batches of size bytes at most, or of one row: batches of 10,000 long texts or sets take
    tens of MB, several times over, in the JVM and in each worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder."""
    path = new_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextmanager
def partly_keyed(spark: SparkSession) -> Iterator[None]:
    """Within it, plans join tables on more columns than they are bucketed on without a shuffle."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written_bucketed(df: DataFrame, name: str, column: str, buckets: int, *order: str) -> DataFrame:
    """The same rows as a table bucketed on a column, sorted by it (and by order). One file a bucket, if df is
    hash-partitioned on the column into as many partitions, as after repartition(buckets, column)."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = new_path(spark, name)
    if own := _scope.get():
        own.tables.append(table)
    with tidy(spark):
        df.write.bucketBy(buckets, column).sortBy(column, *order).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._written_to, out._table = path, table
    return out


def remove(df: DataFrame) -> None:
    """Deletes a table that written() or written_bucketed() made, once no later plan reads it."""
    spark = df.sparkSession
    if table := getattr(df, "_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    _delete(spark, df._written_to)
