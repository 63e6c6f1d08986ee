"""Removal of boilerplate lines by how widely they are spread over sites.

Lines are split at newlines and compared without spaces, tabs and carriage returns at their ends. For each
line a HyperLogLog sketch of its sites and one of the texts that hold it are aggregated (partial sketches
merge before and after the shuffle, so a line that a third of all documents have is no hot group). Lines
whose estimates lie far from the threshold are decided by them; those near it get exact distinct counts.
A line goes if at least ``least`` sites and at least ``least_texts`` different texts have it: copies of one text
alone do not make its lines boilerplate. The lines' hashes are written once; the texts are not split again for
either count.

Null texts stay null and have no lines. A null site counts for no site, a null doc_id like any other. Empty
lines are never removed. Rows that repeat another are spread no wider. All columns stay; n_lines and
n_removed_lines are added (a table that has them already loses its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, written
from ._text import same_row

#: log2 of a sketch's buckets. Below some hundred distinct values the sketch still lists them, nearly exactly.
LG_K = 12
#: Estimates between least * NEAR[0] and least * NEAR[1] are counted exactly: over ten standard errors.
NEAR = (0.8, 1.25)
_TRIMMED = " \t\r"


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """k, doc_id, site, t (the text's hash), pos and the line's key: two independent hashes, 96 bits."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    each = docs.select(F.xxhash64(doc_id, text).alias("k"), doc_id.alias("doc_id"), F.col(site).cast("string").alias("site"), F.xxhash64(text).alias("t"), F.split(text, "\n").alias("lines"))
    each = each.select("k", "doc_id", "site", "t", F.posexplode("lines").alias("pos", "line"))
    line = F.btrim(F.col("line"), F.lit(_TRIMMED))
    return each.where(line != "").select("k", "doc_id", "site", "t", "pos", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def spread_lines(lines: DataFrame, least: int = 10, least_texts: int = 10) -> DataFrame:
    """(h1, h2) of the lines to remove, from lines_of(). Each count is decided by its sketch or, near its threshold, exactly."""
    estimate = lambda c, name: F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LG_K))), F.lit(0)).alias(name)
    sketched = lines.groupBy("h1", "h2").agg(estimate("site", "sites"), estimate("t", "texts"))
    guess = sketched.where((F.col("sites") >= least * NEAR[0]) & (F.col("texts") >= least_texts * NEAR[0]))
    sure = (F.col("sites") > least * NEAR[1]) & (F.col("texts") > least_texts * NEAR[1])
    exact = lines.join(guess.where(~sure).select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", "site", "t").distinct().groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"), F.countDistinct("t").alias("texts"))
    return guess.where(sure).select("h1", "h2").unionByName(exact.where((F.col("sites") >= least) & (F.col("texts") >= least_texts)).select("h1", "h2"))


def remove_spread_lines(docs: DataFrame, site: str = "source", least: int = 10, least_texts: int = 10) -> DataFrame:
    """The documents without the lines that spread_lines finds, and with their counts of lines.

    least: sites that a line must stand on. least_texts: different texts that must hold it; 1 leaves sites alone to decide.
    """
    lines = written(lines_of(docs, site), "lines")
    wide = spread_lines(lines, least, least_texts)
    places = lines.select("k", "doc_id", "pos", "h1", "h2").join(wide, ["h1", "h2"], "left_semi").groupBy("k", "doc_id").agg(F.collect_set("pos").alias("gone"))
    gone = written(places, "spread_lines")
    remove(lines)
    docs = docs.drop("n_lines", "n_removed_lines")
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("k"))
    # Equal rows have one key and lose the same lines.
    joined = keyed.join(gone, same_row(keyed, gone), "left").select("row", "gone")
    text = F.col("row")["text"].cast("string")
    lines = F.split(text, "\n")
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        *(F.when(F.col("gone").isNull(), text).otherwise(rest).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"),
    )


SQL = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, source, text, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d WHERE text IS NOT NULL),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
wide AS (SELECT key FROM t WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 10 AND count(DISTINCT text) >= 10),
kept AS (SELECT t.doc_id, count(*) AS n_lines, count(*) FILTER (w.key IS NOT NULL) AS n_removed_lines,
                string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (w.key IS NULL) AS rest
         FROM t LEFT JOIN wide w ON w.key = t.key GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(rest, '')) END AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
