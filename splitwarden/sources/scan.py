"""Trees of files as item tables: split/class/file layouts, archives, problems, resumable runs.

Listings use Spark's binaryFile source without the content column, so that no file is opened for its name.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import EXTENSIONS, has_extension, split_of
from . import ranges

NO_SPLIT = "__none__"


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, rel (below root), bytes, modified (and content)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/").split("://")[-1].lstrip("/"))
    at = F.instr(F.col("path"), base)
    rel = F.expr("substring(path, __at + length(__base) + 1)")
    out = df.withColumn("__base", base).withColumn("__at", at).withColumn("rel", rel)
    return out.select("path", "rel", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def _parts(rel: Column) -> Column:
    return F.split(rel, "/")


def scan_dataset(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, exclude: list[str] | None = None, content: bool = False) -> DataFrame:
    """split, cls, file, path (bytes, modified, content): items of root/[split/]class/.../file.

    Split folders are known by name, and there must be two of them at least; else every top folder is a class
    and the split is __none__. Files may lie in folders below their class.
    """
    f = files(spark, root, content).withColumn("p", _parts(F.ltrim(F.col("rel"), F.lit("/"))))
    f = f.where(has_extension(F.col("rel"), extensions) & (F.size("p") >= 2))
    named = f.select(split_of(F.col("p")[0]).alias("s")).where("s is not null").distinct().count()
    if named >= 2:
        f = f.where(split_of(F.col("p")[0]).isNotNull() & (F.size("p") >= 3)).withColumn("split", split_of(F.col("p")[0])).withColumn("cls", F.trim(F.col("p")[1]))
    else:
        f = f.withColumn("split", F.lit(NO_SPLIT)).withColumn("cls", F.trim(F.col("p")[0]))
    if exclude:
        f = f.where(~F.lower("cls").isin(*(c.lower() for c in exclude)))
    return f.select("split", "cls", F.element_at("p", -1).alias("file"), "path", "bytes", "modified", *(["content"] if content else []))


def scan_positional(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The same for root/split/class/file where any first folder is a split, whatever its name."""
    f = files(spark, root).withColumn("p", _parts(F.ltrim(F.col("rel"), F.lit("/")))).where(has_extension(F.col("rel"), extensions) & (F.size("p") == 3))
    return f.select(F.col("p")[0].alias("split"), F.trim(F.col("p")[1]).alias("cls"), F.col("p")[2].alias("file"), "path", "bytes", "modified")


def scan_splits(spark: SparkSession, root: str, classes: list[str], extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Items of train, val and test with a class of the list (case folded); doubled tells doubled extensions."""
    f = scan_positional(spark, root, extensions).where(F.col("split").isin("train", "val", "test") & F.lower("cls").isin(*(c.lower() for c in classes)))
    pattern = "(?i)(\\.(" + "|".join(extensions) + ")){2,}$"
    return f.withColumn("doubled", F.col("file").rlike(pattern))


# How image files begin, in hexadecimal (JPEG, PNG, BMP, TIFF, WEBP; HEIC has its mark after a length).
SIGNATURES = ("FFD8FF", "89504E47", "424D", "49492A00", "4D4D002A", "52494646")


def scan_with_problems(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "val", "test"), extensions: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(items, problems): problems have kind (MISSING_SPLIT, NON_IMAGE, UNREADABLE), path and message.

    Files are told by their first bytes, which are all that is read of them (see ranges). A file that cannot be opened is
    UNREADABLE. Files without any byte are not listed by the source.
    """
    image = has_extension(F.col("rel"), extensions)
    if ranges.reachable(root):
        listed = files(spark, root)
        begun = ranges.first_bytes(listed.where(image), 8).withColumnRenamed("path", "__path")
        f = listed.join(begun, F.col("path") == F.col("__path"), "left").drop("__path")
    else:
        f = files(spark, root, True).withColumn("start", F.substring("content", 1, 8)).drop("content")
    f = f.withColumn("p", _parts(F.ltrim(F.col("rel"), F.lit("/"))))
    start = F.hex("start")
    known = start.rlike("^(" + "|".join(SIGNATURES) + ")") | start.rlike("^.{8}66747970")
    looked = f.withColumn("good", F.coalesce(known, F.lit(False))).drop("start")
    items = looked.where(image & F.col("good") & (F.size("p") == 3)).select(F.col("p")[0].alias("split"), F.trim(F.col("p")[1]).alias("cls"), F.col("p")[2].alias("file"), "path", "bytes", "modified")
    odd = looked.where(~image).select(F.lit("NON_IMAGE").alias("kind"), "path", F.lit("no image extension").alias("message"))
    broken = looked.where(image & ~F.col("good")).select(F.lit("UNREADABLE").alias("kind"), "path", F.lit("no image signature").alias("message"))
    asked = spark.createDataFrame([(s,) for s in splits], "split string")
    lacking = asked.join(items.select("split").distinct(), "split", "left_anti").select(F.lit("MISSING_SPLIT").alias("kind"), F.concat(F.lit(root.rstrip("/") + "/"), "split").alias("path"), F.lit("no items").alias("message"))
    return items, odd.unionByName(broken).unionByName(lacking)


def split_keys(items: DataFrame) -> DataFrame:
    return items.select("split", "cls", "file").distinct()


def partition_roots(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """root: every folder below that holds train, val and test."""
    f = files(spark, root).where(has_extension(F.col("rel"), extensions)).select(F.regexp_extract("path", "^(.*)/(train|val|test)/[^/]+/[^/]+$", 1).alias("root"), F.regexp_extract("path", "^(.*)/(train|val|test)/[^/]+/[^/]+$", 2).alias("split"))
    return f.where("root <> ''").groupBy("root").agg(F.countDistinct("split").alias("n")).where("n = 3").select("root")


def mapped_classes(items: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Items whose class folder is in the map, with label."""
    known = items.sparkSession.createDataFrame(list(classes.items()), "cls string, label string")
    # A map of some thousand classes goes to all tasks; a longer one is joined as Spark sees fit.
    return items.join(F.broadcast(known) if len(classes) <= 10_000 else known, "cls")


def archive_members(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """archive, member, content: loose files (archive is null) and members of zip archives, read in tasks one by one
    (see ranges). Where tasks cannot open files by themselves, a whole archive is a row."""
    wanted = tuple(f".{e}" for e in extensions)
    if ranges.reachable(root):
        return ranges.members(files(spark, root), wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if path.lower().endswith((*wanted, ".zip")):
                    rows = list(ranges.parts_of(path, wanted, lambda _, data=data: io.BytesIO(data.as_buffer())))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], names=["archive", "member", "content"])

    return files(spark, root, True).select("path", "content").mapInArrow(read, "archive string, member string, content binary")


def dropped(problems: DataFrame) -> DataFrame:
    """kind, n: how many files a scan with problems has left out, by kind of problem."""
    return problems.where("kind <> 'MISSING_SPLIT'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def stored(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """A cache: rows of df whose keys the table at path lacks are added to it; the whole table is returned."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        df.join(spark.read.parquet(path).select(*keys), keys, "left_anti").write.mode("append").parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.parquet(path)
