"""How the sources of a language differ from each other in their terms, and by which terms.

A term is a run of letters A-Z and of code points beyond ASCII, A-Z lower-cased. Each language keeps the terms that at
least ``least`` of its documents (rows) hold; V of them. With N the occurrences of kept terms in a group (a source's
documents of a language, or all of the language), a term that occurs c times there has p = 1 + floor(10^9 (c + 2) / (N + 2V)).
Two groups differ in it by f(p, q) = floor((p - q)^2 / (p + q)), a symmetric chi-square of smoothed shares.

1. Sketch: tasks count the documents of each (language, term) in a count-min sketch, whose cells are merged by addition.
   A cell holds at least what any of its terms counts (it stops at 255, which is above any asked-for least count that is
   compared), so that a term whose least cell is below ``least`` cannot be kept.
2. Exact counts: the texts are read again; terms that the merged sketch rules out are dropped before the shuffle, the
   others counted exactly by language, source and term. The sketch alone decides nothing.
3. Sparse pairs: only terms that both groups of a pair hold are joined, by language and term. For those, the sum of f
   is corrected by what the pair would have with the term missing on either side; the missing ones are summed from how
   many terms a group holds with each p, which needs no row per term and pair.

All arithmetic is in integers: shares in longs or decimals of 38 digits, sums in longs. Null texts, languages and sources are
read as ''. Rows that repeat another count again. Groups without terms, and languages that keep none, have pairs too (of
value 0, if none is kept), but no terms. A source that is alone in its language has no pairs. An empty table gives an
empty result. Other columns are not read. The broadcast sketch has depth x width bytes, whatever the input; beyond about
width distinct terms it rules out fewer, and more rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import _text as T

#: Rows and cells of the sketch.
DEPTH, WIDTH = 3, 1 << 22
_BLOCK = 1 << 16
_MOST = 255
#: Bytes of text whose terms are counted together.
_CHUNK = 3 << 20

_IS_TERM = np.zeros(256, bool)
_IS_TERM[65:91] = _IS_TERM[97:123] = _IS_TERM[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _coded(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.Array]:
    """Each row's code, and what codes stand for; null is ''."""
    found = batch.column(batch.schema.get_field_index(column)).cast(pa.string()).fill_null("").dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray]:
    """Row and code of each term of a chunk, in text order, and the distinct terms."""
    starts, ends, first = T.word_spans(data, offs, _IS_TERM)
    letters = _FOLD[data[_IS_TERM[data]]]
    upto = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(upto), pa.py_buffer(letters)).dictionary_encode()
    return np.repeat(np.arange(len(offs) - 1), np.diff(first)), words.indices.to_numpy().astype(np.int64), words.dictionary


def _hashes(strings: pa.Array) -> np.ndarray:
    strings = strings.cast(pa.large_string())
    n, bufs = len(strings), strings.buffers()
    if not n:
        return np.zeros(0, np.uint64)
    offs = np.frombuffer(bufs[1], np.int64, n + 1, strings.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    empty = offs[1:] == offs[:-1]
    out = np.zeros(n, np.uint64)
    out[~empty] = T.word_hashes(data, offs[:-1][~empty], offs[1:][~empty])
    return out


def cells(lang: np.ndarray, term: np.ndarray, depth: int, width: int) -> np.ndarray:
    """The cell of each (language, term), given their hashes, in each of the sketch's rows."""
    h = T.mix(lang * np.uint64(0x9E3779B97F4A7C15) ^ term)
    return np.stack([(T.mix(h + np.uint64(i + 1)) % np.uint64(width)).astype(np.int64) for i in range(depth)])


def _counted(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For each chunk: (group, code) of terms, occurrences, documents; the distinct terms, and each group's (lang, source)."""
    lang, langs = _coded(batch, "lang")
    source, sources = _coded(batch, "source")
    groups, group = np.unique(lang * max(len(sources), 1) + source, return_inverse=True)
    of = (groups // max(len(sources), 1), groups % max(len(sources), 1))
    for rows, data, offs in T.chunks(batch, size=_CHUNK):
        row, code, known = terms(data, offs)
        if not len(row):
            continue
        d, own = len(known), group[rows]
        key, n = np.unique(own[row] * d + code, return_counts=True)
        each = np.sort(row * d + code)
        each = each[np.append(True, each[1:] != each[:-1])]
        docs = np.unique(own[each // d] * d + each % d, return_counts=True)[1]
        yield key // d, key % d, n, docs, known, of, langs, sources


def _by_lang(group: np.ndarray, code: np.ndarray, of, langs: pa.Array, known: pa.Array, depth: int, width: int) -> np.ndarray:
    return cells(_hashes(langs)[of[0][group]], _hashes(known)[code], depth, width)


def _sketch(depth: int, width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((depth, width), np.uint8)
        for batch in batches:
            for group, code, _, docs, known, of, langs, sources in _counted(batch):
                for row, at in zip(held, _by_lang(group, code, of, langs, known, depth, width), strict=True):
                    where, inverse = np.unique(at, return_inverse=True)
                    more = np.bincount(inverse, docs, len(where))
                    row[where] = np.minimum(row[where] + more, _MOST)
        yield from _sparse(held.ravel(), 0)

    return sketch


def _sparse(values: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """Blocks of cells: where they are not zero, and what they hold."""
    for a in range(0, len(values), _BLOCK):
        block = values[a : a + _BLOCK]
        at = np.flatnonzero(block)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([first + a // _BLOCK], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([block[at].tobytes()], pa.binary())], names=["block", "at", "n"])


def _add(held: np.ndarray, at: bytes, n: bytes) -> None:
    where = np.frombuffer(at, "<u2").astype(np.int64)
    held[where] = np.minimum(held[where] + np.frombuffer(n, np.uint8).astype(np.int64), _MOST)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            _add(held.setdefault(block, np.zeros(_BLOCK, np.uint8)), at, n)
    for block, values in held.items():
        yield from _sparse(values, block)


def merged_sketch(texts: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> np.ndarray:
    """Documents of (language, term) by cell, depth x width bytes, 255 for 255 and more. texts: lang, source, text."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "block int, at binary, n binary"
    found = texts.mapInArrow(_sketch(depth, width), schema).repartition(parts, "block").mapInArrow(_merge, schema).toArrow()
    out = np.zeros(-(-depth * width // _BLOCK) * _BLOCK, np.uint8)
    for block, at, n in zip(*(found[c].to_pylist() for c in ("block", "at", "n")), strict=True):
        _add(out[block * _BLOCK : (block + 1) * _BLOCK], at, n)
    return out[: depth * width].reshape(depth, width)


def _survivors(shared, least: int):
    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            for group, code, n, docs, known, of, langs, sources in _counted(batch):
                at = _by_lang(group, code, of, langs, known, *sketch.shape)
                most = np.min([row[i] for row, i in zip(sketch, at, strict=True)], axis=0)
                may = np.flatnonzero(most >= min(least, _MOST))
                take = lambda values, i: values.take(pa.array(i, pa.int64())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([take(langs, of[0][group[may]]), take(sources, of[1][group[may]]), take(known, code[may]), T.long_array(n[may]), T.long_array(docs[may])], names=["lang", "source", "term", "n", "docs"])

    return survivors


def kept_terms(docs: DataFrame, least: int = 10, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """lang, source, term, n (occurrences in the group), total (in the language), lead (on one row of each kept term of a
    language): the terms that at least so many documents of a language hold, in the groups that hold them."""
    texts = docs.select("lang", "source", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(merged_sketch(texts, depth, width))
    counts = texts.mapInArrow(_survivors(shared, least), "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A key has a row for each source by now.
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("total", F.sum("n").over(term)).withColumn("in_docs", F.sum("docs").over(term)).withColumn("lead", F.row_number().over(term.orderBy("source")) == 1)
    return counts.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "total", "lead")


def _p(n: str, size: str, terms: str):
    """Null without kept terms. Decimals only where a long would not hold the product."""
    wide = f"(cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div nullif(cast({size} + 2 * {terms} as decimal(20,0)), 0)"
    return F.expr(f"1 + if({n} < 9000000000, (1000000000L * ({n} + 2)) div nullif({size} + 2 * {terms}, 0), {wide})")


def _f(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergence(docs: DataFrame, least: int = 10, top: int = 10, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: all other sources of the language, the most different first.
    Part term: the top terms whose share in the source is above that in the language."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kept = written(kept_terms(docs, least, depth, width), "kept_terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("held"))
    wholes = kept.groupBy("lang").agg(F.sum("n").alias("whole"), F.count(F.when(F.col("lead"), 1)).alias("terms"))
    groups = docs.select(named("lang"), named("source")).distinct().join(sizes, ["lang", "source"], "left").join(wholes, "lang", "left").fillna(0)
    groups = written(groups.withColumn("p0", _p("0", "size", "terms")), "term_groups")

    held = kept.join(groups, ["lang", "source"]).withColumn("p", _p("n", "size", "terms"))
    over = held.withColumn("q", _p("total", "whole", "terms")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))

    # Sums over a group's terms as if the other group, known by its p0 alone, held none of them.
    bars = held.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    zeros = groups.select("lang", F.col("p0").alias("zero")).distinct()
    alone = bars.join(zeros, "lang").groupBy("lang", "source", "zero").agg(F.sum(F.col("m") * _f("p", "zero")).alias("value"))

    side = lambda df, s, *columns: df.select("lang", *(F.col(c).alias(f"{s}_{c}") for c in columns))
    of = held.select("lang", "source", "term", "p", "p0")
    both = of.select("lang", "term", *(F.col(c).alias(f"a_{c}") for c in ("source", "p", "p0"))).join(of.select("lang", "term", *(F.col(c).alias(f"b_{c}") for c in ("source", "p", "p0"))), ["lang", "term"]).where("a_source < b_source")
    correction = _f("a_p", "b_p") - _f("a_p", "b_p0") - _f("a_p0", "b_p") + _f("a_p0", "b_p0")
    shared = both.groupBy("lang", "a_source", "b_source").agg(F.sum(correction).alias("more"))

    columns = ("source", "held", "p0")
    pairs = side(groups, "a", *columns, "terms").join(side(groups, "b", *columns), "lang").where("a_source < b_source")
    for s, o in (("a", "b"), ("b", "a")):
        pairs = pairs.join(alone.select("lang", F.col("source").alias(f"{s}_source"), F.col("zero").alias(f"{o}_p0"), F.col("value").alias(f"{s}_alone")), ["lang", f"{s}_source", f"{o}_p0"], "left")
    pairs = pairs.join(shared, ["lang", "a_source", "b_source"], "left")
    missing = (F.col("a_terms") - F.col("a_held") - F.col("b_held")) * _f("a_p0", "b_p0")
    value = F.coalesce(missing, F.lit(0)) + F.coalesce("a_alone", F.lit(0)) + F.coalesce("b_alone", F.lit(0)) + F.coalesce("more", F.lit(0))
    ways = F.inline(F.array(*(F.struct(F.col(f"{s}_source").alias("source"), F.col(f"{o}_source").alias("item")) for s, o in (("a", "b"), ("b", "a")))))
    others = pairs.select("lang", value.alias("value"), ways).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return others.withColumn("rank", rank).unionByName(over.withColumn("rank", rank).where(F.col("rank") <= top)).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS whole FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS size FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.size + 2 * v.v))::HUGEINT AS p,
             (1 + (1000000000::HUGEINT * (k.total + 2)) // (v.whole + 2 * v.v))::HUGEINT AS q
      FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
         FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
         LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
         GROUP BY a.lang, a.source, b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= 10
"""
