"""Flat numpy views of Arrow text columns, shared by the corpus operators.

A batch of texts is one byte array with row offsets; words, hashes and windows are arrays over the whole
batch, so that no Python loop runs per row or per word. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once; one longer text is handled alone.
CHUNK = 2 << 20
_BLOCK = 1 << 19
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ASCII white space that separates words: \x20 and \x09-\x0D.
SPACES = (9, 10, 11, 12, 13, 32)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and k, a 64-bit hash of both: rows that repeat a doc_id stay apart, null ids included."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))


def same_row(left: DataFrame, right: DataFrame):
    """Join condition on the key that keyed() gives."""
    return (left["k"] == right["k"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 at least and those of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _powers[i] = p
    return _powers[0], _powers[1]


def chunks(batch: pa.RecordBatch, column: str = "text", most_rows: int = 1 << 20, size: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows, up to size bytes and most_rows rows, or one row."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + size, "right")) - 1
        b = min(n, max(b, a + 1), a + most_rows)
        yield slice(a, b), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def ints(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and which are null."""
    col = batch.column(batch.schema.get_field_index(column))
    null = col.is_null().to_numpy(zero_copy_only=False)
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, for mapInArrow; at a task's end its worker gives back the memory that this and earlier tasks have freed, as
    it stays for later ones and else holds it meanwhile."""

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return worked


def long_array(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64(), mask=null)


def word_spans(data: np.ndarray, offs: np.ndarray, of_words: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more entry at the end).

    of_words: which of the 256 bytes words consist of.
    """
    w = of_words[data]
    before = np.zeros(len(w), bool)
    after = np.zeros(len(w), bool)
    before[1:] = w[:-1]
    after[:-1] = w[1:]
    cut = offs[1:-1]
    before[cut[cut < len(w)]] = False
    after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; fold: with A-Z as a-z."""
    table, out, a = _FOLDED if fold else _BYTE, np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _BLOCK, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        p, inv = powers(hi - lo + 1)
        s = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * p[: hi - lo], out=s[1:])
        x, y = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((s[y] - s[x]) * inv[x] + (y - x).astype(np.uint64))
        a = b
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    """A random odd number for each byte, for hashes of byte strings."""
    return _BYTE[data]


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inv = powers(len(values) + 1)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=s[1:])
    return mix((s[width:] - s[:-width]) * inv[:n])


def spans_hash(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of values[lo:hi] for each pair."""
    p, inv = powers(len(values) + 1)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=s[1:])
    return mix((s[hi] - s[lo]) * inv[lo] ^ mix((hi - lo).astype(np.uint64)))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width consecutive values."""
    n, step, y = len(values) - width + 1, 1, values
    if n <= 0:
        return values[:0]
    while step * 2 <= width:
        y = np.minimum(y[:-step], y[step:])
        step *= 2
    return np.minimum(y[:n], y[width - step : width - step + n])


def anchored(values: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that have one anchor: anchor, row, first window (from the row's start), windows, inner.

    A window is width consecutive values of one row; its anchor is the least hash of the grams of gram values
    within it. Equal windows have equal anchors, and neighbours mostly share theirs, so that one entry stands
    for about (width - gram) / 2 windows. inner: the run may hold two equal windows itself, as its anchor's
    gram stands in it twice; where it is false the run's windows differ.
    """
    n, span = len(values) - width + 1, width - gram + 1
    none = (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    if n <= 0:
        return none
    grams = rolled(values, gram)
    low = least(grams, span)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    ok = np.flatnonzero(np.arange(n) + width <= first[row + 1])
    if not len(ok):
        return none
    # A gram is the least of some window if it equals the greatest anchor of the windows around it.
    around = ~least(np.concatenate([np.full(span - 1, ~np.uint64(0)), ~low, np.full(span - 1, ~np.uint64(0))]), span)
    seen = np.flatnonzero(grams == around)
    twice = np.flatnonzero((grams[seen[1:]] == grams[seen[:-1]]) & (np.diff(seen) <= span))
    low, row = low[ok], row[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    marks = np.zeros(len(at) + 1, np.int64)
    np.add.at(marks, np.maximum(np.searchsorted(ok[at], seen[twice + 1] - span + 1, "right") - 1, 0), 1)
    np.add.at(marks, np.maximum(np.searchsorted(ok[at], seen[twice], "right"), 1), -1)
    return low[at], row[at], ok[at] - first[row[at]], np.diff(np.append(at, len(ok))), np.cumsum(marks)[:-1] > 0
