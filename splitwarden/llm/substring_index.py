"""Substring deduplication on a log-structured index of window fingerprints.

The index holds sorted, immutable runs, one for each batch of documents. A run has one row for each distinct
anchored stretch of windows (see ``_text.anchored``): the anchor ``fp``, a hash ``rh`` of all words that the
stretch's windows span, how often it stands in the batch, and one place. Equal windows have equal anchors, so a
window can repeat only where its anchor does, and about one row in fourteen windows is enough to find every repeat.

* ``append`` sorts a batch into a new run and merge-joins it with the historical runs; it returns the anchors that
  now repeat. Before that, runs of one size are merged two by two (``compact``), so that b batches meet log2(b)
  historical runs at most, and a row is rewritten as often at most, however many batches come after it.
* ``repeated`` verifies the anchors that appends have returned, and only those: stretches whose whole word sequence
  (fp and rh, 128 bits) occurs again are settled; where one anchor stands in different stretches, one of each goes
  back to its text and is compared window by window (fp and a 64-bit window hash).
* ``merge_runs`` compacts: a merge join of sorted runs that adds the counts of equal stretches.

Hot passages are counted in each batch of rows before they are shuffled, and never gathered; only distinct stretches
are compared.

Nulls and edges: null or empty texts have no windows; texts shorter than a window neither; rows that repeat a
doc_id are documents of their own (equal rows are two places, so both lose what they share); empty tables
give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ..sources.shared import partly_keyed, remove, written, written_bucketed

STRETCH = "fp long, rh long, doc_id long, k long, start int, n int, inner boolean, c long"
_PLACE = ("doc_id", "k", "start", "n")
#: Stretches that are counted together before a shuffle.
_COUNTED = 1 << 19


def _stretches(width: int, gram: int, counted: bool):
    """Stretches of windows; counted: each distinct one once for a batch of rows, with how often it stands there."""

    def told(some: list[list[np.ndarray]]) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*some, strict=True)]
        n = np.ones(len(cols[0]), np.int64)
        if counted:
            order = np.lexsort((cols[1], cols[0]))
            cols = [x[order] for x in cols]
            at = np.flatnonzero(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
            n = np.diff(np.append(at, len(order)))
            inner = np.logical_or.reduceat(cols[7], at) if len(at) else cols[7]
            cols = [x[at] for x in cols[:7]] + [inner]
        fp, rh, ids, null, keys, start, many, inner = cols
        return pa.RecordBatch.from_arrays([T.long_array(fp), T.long_array(rh), T.long_array(ids, null), T.long_array(keys), pa.array(start, pa.int32()), pa.array(many, pa.int32()), pa.array(inner), T.long_array(n)], names=["fp", "rh", *_PLACE, "inner", "c"])

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for batch in batches:
            ids, null = T.ints(batch, "doc_id")
            keys, _ = T.ints(batch, "k")
            for rows, data, offs in T.chunks(batch):
                starts, ends, first = T.word_spans(data, offs)
                words = T.word_hashes(data, starts, ends)
                fp, row, start, n, inner = T.anchored(words, first, width, gram)
                lo = first[row] + start
                rh = T.spans_hash(words, lo, lo + n + (width - 1))
                at = row + rows.start
                some.append([fp, rh, ids[at], null[at], keys[at], start, n, inner])
                held += len(fp)
                if held >= _COUNTED or not counted:
                    yield told(some)
                    some, held = [], 0
        if some:
            yield told(some)

    return fingerprints


def _added(df: DataFrame) -> DataFrame:
    """One row for each distinct stretch. The places of one row stay together: all are those of the same first row."""
    return df.groupBy("fp", "rh").agg(F.sum("c").alias("c"), F.max("inner").alias("inner"), *(F.first(x).alias(x) for x in _PLACE))


class WindowIndex:
    """Runs of window fingerprints in the shared folder; documents may be appended batch after batch."""

    def __init__(self, spark: SparkSession, width: int = 35, gram: int = 8, buckets: int | None = None):
        if not 0 < gram <= width:
            raise ValueError("gram must be between 1 and width")
        self.spark, self.width, self.gram = spark, width, gram
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[DataFrame] = []
        #: For each run how often its rows have been merged: it holds about 2 ** level batches.
        self.levels: list[int] = []
        self.docs: list[DataFrame] = []
        self.hits: list[DataFrame] = []

    def _save(self, df: DataFrame) -> DataFrame:
        return written_bucketed(df, "window_run", "fp", self.buckets, "rh")

    def fingerprints(self, docs: DataFrame, counted: bool = False) -> DataFrame:
        return T.keyed(docs).mapInArrow(_stretches(self.width, self.gram, counted), STRETCH)

    def append(self, docs: DataFrame) -> DataFrame:
        """Adds a batch as a new run. Returns the anchors of this batch that repeat, in it or in historical runs.

        The joins are merge joins of bucketed runs, of which neither side is shuffled.
        """
        self.compact()
        new = self._save(_added(self.fingerprints(docs, counted=True).repartition(self.buckets, "fp")))
        seen = new.groupBy("fp").agg(F.count(F.lit(1)).alias("variants"), F.sum("c").alias("c"), F.max("inner").alias("inner"), F.lit(False).alias("old"))
        for run in self.runs:
            past = run.select("fp").distinct().withColumn("here", F.lit(True)).hint("merge")
            seen = seen.join(past, "fp", "left").select("fp", "variants", "c", "inner", (F.col("old") | F.col("here").isNotNull()).alias("old"))
        hits = written(seen.where("old or variants > 1 or c > 1 or inner").select("fp"), "window_hits")
        self.runs.append(new)
        self.levels.append(0)
        self.docs.append(docs)
        self.hits.append(hits)
        return hits

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """A merge join of two runs that adds the counts of equal stretches; the runs go."""
        other = b.select(*(F.col(x).alias(f"b_{x}") for x in b.columns)).hint("merge")
        both = a.join(other, (a["fp"] == other["b_fp"]) & (a["rh"] == other["b_rh"]), "full")
        here = F.col("fp").isNotNull()
        place = [F.when(here, F.col(x)).otherwise(F.col(f"b_{x}")).alias(x) for x in ("fp", "rh", *_PLACE)]
        inner = (F.coalesce("inner", F.lit(False)) | F.coalesce("b_inner", F.lit(False))).alias("inner")
        with partly_keyed(self.spark):
            out = self._save(both.select(*place, inner, (F.coalesce("c", F.lit(0)) + F.coalesce("b_c", F.lit(0))).alias("c")))
        remove(a)
        remove(b)
        return out

    def compact(self) -> None:
        """Merges runs of one level, as carries in a binary number."""
        while len(self.runs) > 1 and self.levels[-1] == self.levels[-2]:
            self.runs[-2:] = [self._merged(*self.runs[-2:])]
            self.levels[-2:] = [self.levels[-1] + 1]

    def merge_runs(self) -> None:
        """Compacts all runs into one sorted run, the latest first, which are the smallest."""
        while len(self.runs) > 1:
            self.runs[-2:] = [self._merged(*self.runs[-2:])]
            self.levels[-2:] = [max(self.levels[-2:]) + 1]

    def repeated(self, hits: DataFrame | None = None) -> DataFrame:
        """Verified places of windows that stand elsewhere too: doc_id, k, start, n (n windows from start).

        hits: what an append returned, for its anchors alone; else those of all appends.
        """
        hits = (reduce(DataFrame.union, self.hits) if hits is None else hits).distinct()
        rows = reduce(DataFrame.unionByName, [run.join(hits.hint("merge"), "fp", "left_semi") for run in self.runs])
        level = written(_added(rows), "window_level")
        several = level.groupBy("fp").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select("fp")
        rivals = level.join(several, "fp", "left_semi").unionByName(level.where("inner").join(several, "fp", "left_anti"))
        asked = rivals.groupBy("k", "doc_id").agg(F.collect_list(F.struct("fp", "c", "start", "n")).alias("asked"))
        texts = T.keyed(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.docs))
        # Equal rows have one key and answer alike.
        found = texts.join(asked, T.same_row(texts, asked)).select(texts["doc_id"], texts["k"], "text", "asked")
        windows = written(found.mapInArrow(_windows(self.width), "fp long, h long, c long, doc_id long, k long, start int"), "windows")
        again = windows.groupBy("fp", "h").agg(F.sum("c").alias("total")).where("total > 1").select("fp", "h")
        single = windows.where("c = 1").join(again, ["fp", "h"], "left_semi").select("doc_id", "k", "start", F.lit(1).alias("n"))
        postings = texts.mapInArrow(_stretches(self.width, self.gram, False), STRETCH)
        whole = postings.join(level.where("c > 1").select("fp", "rh"), ["fp", "rh"], "left_semi").select("doc_id", "k", "start", "n")
        places = written(whole.unionByName(single), "window_places")
        remove(level)
        remove(windows)
        return places

    def close(self) -> None:
        """Deletes the runs and what appends have returned."""
        for table in self.runs + self.hits:
            remove(table)
        self.runs, self.levels, self.hits, self.docs = [], [], [], []


def _windows(width: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = T.ints(batch, "k")
            ids, null = T.ints(batch, "doc_id")
            asked = batch.column(batch.schema.get_field_index("asked"))
            upto, item = asked.offsets.to_numpy(), asked.values
            fp, c, start, n = (item.field(x).to_numpy(zero_copy_only=False) for x in ("fp", "c", "start", "n"))
            for rows, data, offs in T.chunks(batch):
                starts, ends, first = T.word_spans(data, offs)
                h = T.rolled(T.word_hashes(data, starts, ends), width)
                a, b = upto[rows.start], upto[rows.stop]
                doc = np.repeat(np.arange(rows.start, rows.stop), np.diff(upto[rows.start : rows.stop + 1]))
                many = n[a:b].astype(np.int64)
                which = np.repeat(np.arange(a, b), many)
                step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                doc, begin = np.repeat(doc, many), start[which] + step
                got = h[first[doc - rows.start] + begin]
                yield pa.RecordBatch.from_arrays([T.long_array(fp[which]), T.long_array(got), T.long_array(c[which]), T.long_array(ids[doc], null[doc]), T.long_array(keys[doc]), pa.array(begin, pa.int32())], names=["fp", "h", "c", "doc_id", "k", "start"])

    return hashes


def _kept(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, null = T.ints(batch, "doc_id")
            texts = batch.column(batch.schema.get_field_index("text")).fill_null("").to_pylist()
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            rows = []
            for text, span in zip(texts, spans, strict=True):
                words = text.encode().split()
                if not span:
                    rows.append((len(words), 0, b" ".join(words).decode()))
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                start = np.array([x["start"] for x in span])
                np.add.at(edge, start, 1)
                np.subtract.at(edge, np.minimum(len(words), start + np.array([x["n"] for x in span]) + width - 1), 1)
                gone = np.cumsum(edge)[:-1] > 0
                rows.append((len(words), int(gone.sum()), b" ".join(words[i] for i in np.flatnonzero(~gone)).decode()))
            n, removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([T.long_array(ids, null), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return cut


def remove_repeats(docs: DataFrame, width: int = 35, gram: int = 8, batches: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each document without the words of windows that stand anywhere else.

    The documents enter a WindowIndex in batches; whichever batch a copy came in, all its copies lose it.
    """
    index = WindowIndex(docs.sparkSession, width, gram)
    key = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for i in range(batches):
        index.append(docs.where(F.coalesce(key, F.lit(0)) == i) if batches > 1 else docs)
    spans = index.repeated().groupBy("k", "doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    index.close()
    texts = T.keyed(docs)
    joined = texts.join(spans, T.same_row(texts, spans), "left").select(texts["doc_id"], "text", "spans")
    return joined.mapInArrow(_kept(width), "doc_id long, n_words long, n_removed long, kept string")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
p AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER f = 35 THEN md5(string_agg(word, ' ') OVER f) END AS h FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
d AS (SELECT h FROM p WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
c AS (SELECT p.doc_id, p.i, p.word, coalesce(max(CASE WHEN d.h IS NOT NULL THEN p.i END) OVER (PARTITION BY p.doc_id ORDER BY p.i) >= p.i - 34, false) AS gone FROM p LEFT JOIN d ON d.h = p.h),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
