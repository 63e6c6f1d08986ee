"""Readers and writers of the library's tables. Schemas are explicit, columns are found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MANIFEST = StructType([StructField(c, StringType()) for c in ("cls", "file", "session")])


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV of any column order, all columns as strings; a byte order mark is ignored."""
    return required(spark.read.option("header", "true").csv(path), ["cls", "file", "session"])


def read_results(spark: SparkSession, path: str, text: tuple[str, ...] = (), summary: tuple[str, str] | None = None) -> DataFrame:
    """A results CSV: columns but ``text`` become double. summary: (column, prefix) of summary rows to leave out."""
    df = spark.read.option("header", "true").csv(path)
    if summary:
        df = df.where(~F.coalesce(F.col(f"`{summary[0]}`").startswith(summary[1]), F.lit(False)))
    return df.select(*(F.col(f"`{c}`") if c in text else F.expr(f"try_cast(`{c}` as double)").alias(c) for c in df.columns))


def read_runs(spark: SparkSession, root: str, table: str, text: tuple[str, ...] = (), summary: tuple[str, str] | None = None, done: str | None = "DONE") -> DataFrame:
    """A table of all run folders {mode}_s{seed}, with mode and seed; only of finished runs, unless done is None."""
    raw = spark.read.option("header", "true").csv(f"{root.rstrip('/')}/*/{table}").withColumn("run", F.regexp_extract(F.input_file_name(), "/([^/]+)/[^/]+$", 1))
    if summary:
        raw = raw.where(~F.coalesce(F.col(f"`{summary[0]}`").startswith(summary[1]), F.lit(False)))
    if done:
        marks = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/{done}").select(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("run"))
        raw = raw.join(marks, "run", "left_semi")
    named = raw.withColumn("mode", F.regexp_extract("run", "^(group|image)_s(\\d+)$", 1)).withColumn("seed", F.regexp_extract("run", "^(group|image)_s(\\d+)$", 2).cast("int")).where("mode <> ''")
    plain = (*text, "mode", "run")
    return named.select(*(F.col(f"`{c}`") if c in plain or c == "seed" else F.expr(f"try_cast(`{c}` as double)").alias(c) for c in named.columns))


def read_leaf_map(spark: SparkSession, path: str) -> DataFrame:
    """cls, key, leaf from JSON {image key: ["Class:::leaf", ...]}."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("key", "leaves"))
    one = raw.select(F.lower(F.trim("key")).alias("key"), F.explode("leaves").alias("x"))
    return one.select(F.split("x", ":::")[0].alias("cls"), "key", F.split("x", ":::")[1].alias("leaf"))


def read_confusion(spark: SparkSession, path: str) -> DataFrame:
    """model, y_true, y_pred (names), n from JSON {class_names, confusion: {model: matrix}}."""
    shape = "struct<class_names:array<string>,confusion:map<string,array<array<bigint>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("j")).select("j.class_names", F.explode("j.confusion").alias("model", "m"))
    rows = raw.select("class_names", "model", F.posexplode("m").alias("i", "row")).select("class_names", "model", "i", F.posexplode("row").alias("j", "n"))
    return rows.select("model", F.get("class_names", F.col("i")).alias("y_true"), F.get("class_names", F.col("j")).alias("y_pred"), "n")


def read_confusion_csv(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """y_true, y_pred, n from a matrix without header, rows true. A small file: its rows keep their order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("i", "row"))
    cells = lines.select("i", F.posexplode(F.split("row", ",")).alias("j", "n"))
    names = F.array(*(F.lit(x) for x in labels))
    return cells.select(F.get(names, F.col("i")).alias("y_true"), F.get(names, F.col("j")).alias("y_pred"), F.trim("n").cast("long").alias("n"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """model (file name) and arrays train_loss, val_loss, train_acc, val_acc of training histories."""
    shape = "struct<train_loss:array<double>,val_loss:array<double>,train_acc:array<double>,val_acc:array<double>>"
    raw = spark.read.text(path, wholetext=True).withColumn("model", F.regexp_extract(F.input_file_name(), "([^/]+)\\.json$", 1))
    return raw.select("model", F.from_json("value", shape).alias("h")).select("model", "h.*")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """path, embedding, weights from .npz archives with E, paths and weights; each archive is read in a task."""

    def load(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                with np.load(io.BytesIO(data), allow_pickle=False) as z:
                    e, names, tag = z["E"].astype("float32"), [str(x) for x in z["paths"]], str(z["weights"]) if "weights" in z else None
                yield pd.DataFrame({"path": names, "embedding": list(e), "weights": tag})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "path string, embedding array<float>, weights string")


def embeddings_for(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Items with their unit vectors; an item without one is an error."""
    from ..functions.kernels import normalised

    if items.join(vectors, "path", "left_anti").limit(1).count():
        raise ValueError("items without an embedding")
    return items.join(vectors.select("path", normalised(F.col("embedding")).alias("embedding"), "weights"), "path")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """sheet, row, column, value of all sheets of a workbook, first row as header. Read from its XML parts."""

    def load(batches):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = z.namelist()
                    shared = []
                    if "xl/sharedStrings.xml" in names:
                        shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(si) == "si"]
                    for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
                        header: dict[str, str] = {}
                        for i, r in enumerate(e for e in ElementTree.fromstring(z.read(name)).iter() if tag(e) == "row"):
                            for c in (e for e in r if tag(e) == "c"):
                                text = next((v.text for v in c.iter() if tag(v) in ("v", "t")), None)
                                value = shared[int(text)] if c.get("t") == "s" and text is not None else text
                                col = re.sub(r"\d", "", c.get("r", ""))
                                if i == 0:
                                    header[col] = value or col
                                else:
                                    rows.append((name, i, header.get(col, col), value))
                yield pd.DataFrame(rows, columns=["sheet", "row", "column", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "sheet string, row long, column string, value string")


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", "true").csv(path)


def sorted_manifest(df: DataFrame) -> DataFrame:
    """Manifest rows in the order that they are written in: class, session, file."""
    return df.orderBy("cls", "session", "file")


def write_tree(df: DataFrame, path: str) -> None:
    """Items (with content) as a table in folders split=/cls=."""
    required(df, ["split", "cls"]).write.mode("overwrite").partitionBy("split", "cls").parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; longer ones are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "—" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *([show(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
