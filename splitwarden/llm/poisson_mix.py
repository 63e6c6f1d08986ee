"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of n of all N documents with target weight w gets the mean repetition rate w * N / n. Each document
draws its number of copies from the Poisson distribution of that mean: a hash of seed and doc_id, taken as a
number u between 0 and 1, is inverted through the cumulative distribution. Copies depend on nothing else, so
a lost executor draws the same again. Documents are exploded by their counts, and a hash of seed, doc_id and
copy gives the global order.

Large means are drawn as sums of several Poisson numbers of at most 100 each. Without target weights all
sources weigh the same; weights are scaled to a sum of 1, and sources without one get none. A null source is a
source of its own (weight under the key None). A null doc_id is drawn like an id of its own, and equal ids are
drawn alike. All columns stay, whatever their names; copy and mix_key are added (a table that has them already
loses its own).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources whose rates may be broadcast; with more of them the rates are joined by a shuffle.
MANY = 10_000
#: The mean of one Poisson number; 60 standard deviations above it the distribution ends in double precision.
MEAN = 100.0
_TAIL = 40


def _unit(*parts: Column) -> Column:
    """52 bits of an MD5 as a number from 0 to below 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _cumulative(mean: Column) -> Column:
    """The cumulative distribution for 0, 1, ... up to where it no longer grows."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + _TAIL).cast("int")
    start = F.struct(F.array(F.exp(-mean)).alias("all"), F.exp(-mean).alias("p"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.struct(F.concat(s["all"], F.array(F.element_at(s["all"], -1) + p)).alias("all"), p.alias("p"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["all"])


def rates(docs: DataFrame, source: str = "source", weights: Mapping[str | None, float] | None = None) -> tuple[DataFrame, int]:
    """mix_source, rate, draws and cdf: one row a source, and the number of sources."""
    counts = docs.groupBy(F.col(f"`{source}`").cast("string").alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    total, sources = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if weights is None:
        weight = F.lit(1.0 / max(1, sources))
    else:
        if not weights or min(weights.values()) < 0 or not sum(weights.values()) > 0:
            raise ValueError("weights must be positive")
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), w / sum(weights.values())).otherwise(weight)
    rate = weight * F.lit(float(total)) / F.col("n")
    known = counts.select("mix_source", rate.alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN).cast("int")))
    return known.withColumn("cdf", _cumulative(F.col("rate") / F.col("draws"))), sources


def mix(docs: DataFrame, source: str = "source", weights: Mapping[str | None, float] | None = None, seed: int = 1) -> DataFrame:
    """The documents in global random order, each as often as drawn; copy counts from 1.

    A document's columns travel as one, so that none of them can clash with those of the draw.
    """
    docs = docs.drop("copy", "mix_key")
    known, sources = rates(docs, source, weights)
    column = lambda c: F.col(f"`{c}`")
    rows = docs.select(F.struct(*(column(c) for c in docs.columns)).alias("row"), F.coalesce(column("doc_id").cast("string"), F.lit("")).alias("id"), column(source).cast("string").alias("own_source"))
    u = lambda j: _unit(F.lit(str(seed)), j, F.col("id"))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= u(j))))
    joined = rows.join(F.broadcast(known) if sources <= MANY else known, F.col("own_source").eqNullSafe(F.col("mix_source")))
    copies = joined.select("row", "id", drawn.alias("n")).where("n > 0").select("row", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    ordered = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.col("copy").cast("string"), F.col("id")).cast("binary"))).orderBy("mix_key", F.col("row")["doc_id"])
    return ordered.select("row.*", "copy", "mix_key")


SQL = """
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM s)) * (SELECT count(*) FROM documents)::DOUBLE / n AS rate FROM s),
c AS (SELECT source, rate, 0 AS i, exp(-rate) AS p, exp(-rate) AS cdf FROM r
      UNION ALL
      SELECT source, rate, i + 1, p * rate / (i + 1), cdf + p * rate / (i + 1) FROM c WHERE i < ceil(rate + 12 * sqrt(rate) + 40)),
u AS (SELECT *, ('0x' || substr(md5('1|1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
k AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, l.n FROM u JOIN (SELECT source, list(cdf) AS cdf FROM c GROUP BY source) x ON x.source IS NOT DISTINCT FROM u.source,
      LATERAL (SELECT len(list_filter(x.cdf, lambda v: v <= u.u)) AS n) l)
SELECT doc_id, text, lang, source, n_chars, copy, md5('order 1|' || copy || '|' || coalesce(doc_id::VARCHAR, '')) AS mix_key
FROM (SELECT *, unnest(generate_series(1, n))::INTEGER AS copy FROM k WHERE n > 0)
"""
