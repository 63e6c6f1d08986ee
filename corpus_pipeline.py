"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and reread as
the next one's input. All but the last keep the columns of documents, further ones and those of clashing names
included; the last adds copy and mix_key in place of columns of these names.

Rows with null or empty texts pass all filters. Null ids and null sources are values like others. Rows that repeat
another are judged alike; of equal texts with words one row stays after the third stage. Empty tables give empty
results, an empty table of labels or of benchmark items rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwarden.llm import ftrl, jaccard_join, line_spread, poisson_mix, templates
from splitwarden.sources.shared import remove, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _free(name: str, docs: DataFrame) -> str:
    """A column name that the table does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go. The model is fitted on the labelled documents of the
    table, without the held-out part. Texts without features score the model's bias."""
    labels = _table(spark, sf_dir, "labels").where(~ftrl.held_out(F.col("doc_id"), 5, 0))
    model = ftrl.fit(_table(spark, sf_dir, "documents"), labels, "toxic", ftrl.TOXICITY)
    score = _free("toxicity", docs)
    return ftrl.score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten sites and ten different texts have go; n_chars follows the text. No document goes; null texts
    stay null."""
    own = {c: _free(c, docs) for c in ("n_lines", "n_removed_lines") if c in docs.columns}
    cleaned = line_spread.remove_spread_lines(docs.withColumnsRenamed(own))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.drop("n_lines", "n_removed_lines").withColumnsRenamed({new: c for c, new in own.items()}).select(*(f"`{c}`" for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (75 % of their 5-word shingles) one stays, the row of the smallest doc_id. Rows
    without words all stay."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item, or of its template with consistent slots, go. Null items and
    items below six tokens match nothing."""
    return templates.without_contaminated(docs, _table(spark, sf_dir, "benchmark"), least_words=templates.PLAIN)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get equal weights by Poisson replication; the rows are in global random order. A null source is one."""
    return poisson_mix.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_spread_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: The model and the components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is deleted once the next one's is written."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
            if before is not None:
                remove(before)
            before = docs
    return docs
