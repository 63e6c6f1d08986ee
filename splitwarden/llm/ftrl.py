"""Text classifiers: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

A text's tokens are its maximal runs of letters, digits and non-ASCII characters (A-Z folded) and of ASCII
punctuation. Features are hashes of single tokens, of neighbours (n-grams) and, where asked for, of token
pairs with a gap (skip-grams); a feature counts once a text, with the value
tokens**-power, if least_rows rows of the fit hold it. The
proximal update keeps a learning rate for each coordinate, and its L1 term leaves most weights at zero, so
that the model is a short list of (bucket, weight) that is broadcast: at most 2**bits entries, whatever the
corpus. Scores are sparse dot products over flat arrays of a batch.

The fit takes at most ``max_rows`` labelled rows, those with the least hash of doc_id: all tasks hash their texts,
one task goes through their features; scoring reads every row. Null and empty texts have no features and score the model's bias. Rows that repeat a doc_id
are scored one by one; of those a fit takes the smallest text, and of repeated labels the largest. Rows with
a null label take no part in the fit. Without any row to fit, every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import remove, written
from . import _text as T

_KIND = np.full(256, 2, np.uint8)
_KIND[list(T.SPACES)] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1


@dataclass(frozen=True)
class Settings:
    """grams: longest n-gram; skips: gaps of token pairs. max_rows bounds the labelled rows of a fit.

    positive_weight: rows with label 1 count so often, for labels that are rare.
    """

    bits: int = 20
    grams: int = 2
    skips: tuple[int, ...] = ()
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.05
    epochs: int = 4
    least_rows: int = 3
    power: float = 0.5
    positive_weight: float = 1.0
    max_rows: int = 20_000
    rows_hash_seed: int = 17


@dataclass(frozen=True)
class Model:
    settings: Settings
    bias: float | None
    buckets: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, and the index of each row's first token."""
    kind = _KIND[data]
    before = np.zeros(len(kind), np.uint8)
    before[1:] = kind[:-1]
    cut = offs[1:-1]
    before[cut[cut < len(kind)]] = 0
    starts = np.flatnonzero((kind != before) & (kind != 0))
    after = np.zeros(len(kind), np.uint8)
    after[:-1] = kind[1:]
    after[cut[cut > 0] - 1] = 0
    ends = np.flatnonzero((kind != after) & (kind != 0)) + 1
    return T.word_hashes(data, starts, ends, fold=True), np.searchsorted(starts, offs)


def features(data: np.ndarray, offs: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) arrays, one pair for each kind of feature; a feature may come more than once a row."""
    h, first = tokens(data, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    shift = np.uint64(64 - s.bits)
    yield row, (h >> shift).astype(np.int64)
    for gap, kind in [(g, 0) for g in range(1, s.grams)] + [(g + 1, 1) for g in s.skips]:
        if len(h) <= gap:
            continue
        if kind == 0:
            joint, same = T.rolled(h, gap + 1), row[gap:] == row[:-gap]
        else:
            joint, same = T.mix(h[:-gap] * np.uint64(2 * gap + 1) ^ T.mix(h[gap:] + np.uint64(gap))), row[gap:] == row[:-gap]
        yield row[:-gap][same], (joint[same] >> shift).astype(np.int64)


def _distinct(row: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row << bits | bucket)
    return both >> bits, both & ((1 << bits) - 1)


def _scale(data: np.ndarray, offs: np.ndarray, s: Settings) -> np.ndarray:
    if not s.power:
        return np.ones(len(offs) - 1)
    return np.maximum(1, np.diff(tokens(data, offs)[1])) ** -s.power


def _sparse(data: np.ndarray, offs: np.ndarray, s: Settings, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct features of a chunk, of those that are wanted."""
    pairs = list(features(data, offs, s))
    if wanted is not None:
        pairs = [(r[k], b[k]) for r, b in pairs for k in [wanted[b]]]
    return _distinct(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), s.bits)


class _Packed(Sequence):
    """Rows of ascending buckets in two bytes each: counts of each higher part, then all lower 16 bits."""

    def __init__(self, rows: list[np.ndarray], bits: int):
        self.rows, self.parts = rows, 1 << max(0, bits - 16)

    @staticmethod
    def bytes_of(bucket: np.ndarray, bits: int) -> bytes:
        return np.bincount(bucket >> 16, minlength=1 << max(0, bits - 16)).astype("<u4").tobytes() + (bucket & 0xFFFF).astype("<u2").tobytes()

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        many, low = self.rows[i][: 4 * self.parts].view("<u4"), self.rows[i][4 * self.parts :].view("<u2")
        return np.repeat(np.arange(self.parts) << 16, many) + low


def fit_sparse(buckets: Sequence[np.ndarray], scales: np.ndarray, labels: np.ndarray, s: Settings) -> Model:
    """The updates themselves, over rows of distinct features that fit into one task."""
    size = 1 << s.bits
    # z: sums of gradients less what the weights' moves undo; root: roots of the sums of squared gradients. Last: bias.
    z, root = np.zeros(size), np.zeros(size)
    zb = rb = 0.0
    order = np.random.default_rng(s.rows_hash_seed)
    for _ in range(s.epochs):
        for i in order.permutation(len(buckets)):
            at, v, y = buckets[i], scales[i], labels[i]
            zi, ri = z[at], root[at]
            # What the L1 term leaves of z; it spares the bias.
            w = np.clip(zi, -s.l1, s.l1)
            w -= zi
            w /= (s.beta + ri) / s.alpha + s.l2
            wb = -zb / ((s.beta + rb) / s.alpha + s.l2)
            p = 1 / (1 + np.exp(-min(35.0, max(-35.0, v * w.sum() + wb))))
            g = (p - y) * (s.positive_weight if y else 1.0)
            now = np.sqrt(ri * ri + (g * v) ** 2)
            w *= (now - ri) / s.alpha
            zi -= w
            zi += g * v
            z[at], root[at] = zi, now
            step = math.sqrt(rb * rb + g * g)
            zb, rb = zb + g - (step - rb) / s.alpha * wb, step
    w = np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + root) / s.alpha + s.l2))
    at = np.flatnonzero(w)
    return Model(s, float(-zb / ((s.beta + rb) / s.alpha + s.l2)), at, w[at])


def fit_rows(texts: list[str], labels: np.ndarray, s: Settings) -> Model:
    """A fit of texts in memory."""
    if not texts:
        return Model(s, None, np.zeros(0, np.int64), np.zeros(0))
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    seen = np.zeros(1 << s.bits, np.int64)
    for _, data, offs in T.chunks(batch):
        seen += np.bincount(_sparse(data, offs, s)[1], minlength=len(seen))
    rows, scales = [], []
    for _, data, offs in T.chunks(batch):
        row, bucket = _sparse(data, offs, s, seen >= s.least_rows)
        rows += np.split(bucket, np.searchsorted(row, np.arange(1, len(offs) - 1)))
        scales.append(_scale(data, offs, s))
    return fit_sparse(rows, np.concatenate(scales), labels, s)


def fit(docs: DataFrame, labels: DataFrame, label: str, settings: Settings) -> Model:
    """Fits on documents joined with labels(doc_id, label): at most settings.max_rows of them.

    Texts are hashed by all tasks, twice: to count the rows of each feature, and for the rows' features themselves,
    without those of too few rows. The one task that fits reads lists of features, never a text.
    """
    s = settings
    spark = docs.sparkSession
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
                    .where("doc_id is not null and y is not null")
                    .groupBy("doc_id").agg(F.max("y").alias("y"))
                    .orderBy(F.xxhash64("doc_id", F.lit(s.rows_hash_seed)), "doc_id").limit(s.max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The chosen ids are bounded by max_rows, so they may be broadcast.
    rows = written(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << s.bits, np.int64)
        for batch in batches:
            for _, data, offs in T.chunks(batch):
                seen += np.bincount(_sparse(data, offs, s)[1], minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([T.long_array(at), T.long_array(seen[at])], names=["bucket", "n"])

    # 2**bits features at most, whatever the corpus.
    often = rows.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least_rows).select("bucket").toArrow()
    wanted = np.zeros(1 << s.bits, bool)
    wanted[often["bucket"].to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(wanted))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for at, data, offs in T.chunks(batch):
                row, bucket = _sparse(data, offs, s, keep)
                upto = np.searchsorted(row, np.arange(len(offs)))
                lists = [_Packed.bytes_of(bucket[a:b], s.bits) for a, b in zip(upto[:-1], upto[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at.start : at.stop], batch.column("y")[at.start : at.stop], pa.array(lists, pa.binary()), pa.array(_scale(data, offs, s))], names=["doc_id", "y", "features", "scale"])

    def in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels_, scales, buckets = [], [], [], []
        for batch in batches:
            lists = batch.column("features").cast(pa.large_binary())
            offs = np.frombuffer(lists.buffers()[1], np.int64, len(lists) + 1, lists.offset * 8)
            # One copy of a batch's features, two bytes each; rows are views of it.
            flat = np.frombuffer(lists.buffers()[2], np.uint8)[offs[0] : offs[-1]].copy()
            buckets += [flat[a - offs[0] : b - offs[0]] for a, b in zip(offs[:-1], offs[1:], strict=True)]
            for held, c in ((ids, "doc_id"), (labels_, "y"), (scales, "scale")):
                held += batch.column(c).to_pylist()
        if not ids:
            return
        by = np.argsort(ids)
        model = fit_sparse(_Packed([buckets[i] for i in by], s.bits), np.array(scales)[by], np.array(labels_, float)[by], s)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(model.buckets, -1), pa.int64()), pa.array(np.append(model.weights, model.bias), pa.float64())], names=["bucket", "weight"])

    sparse = rows.mapInArrow(hashed, "doc_id long, y int, features binary, scale double")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "500")  # a batch of long rows is held twice on its way to the task
    try:
        model = sparse.repartition(1, "doc_id").mapInArrow(in_one_task, "bucket long, weight double").toPandas()
    finally:
        spark.conf.set(key, before)
    shared.destroy()
    remove(rows)
    bias = model.weight[model.bucket == -1]
    model = model[model.bucket >= 0].sort_values("bucket")
    return Model(s, float(bias.iloc[0]) if len(bias) else None, model.bucket.to_numpy(np.int64), model.weight.to_numpy(np.float64))


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """All columns of docs and the probability of label 1. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if out in docs.columns:
        raise ValueError(f"the table has a column {out} already")

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = np.zeros(1 << m.settings.bits, np.float32)
        w[m.buckets] = m.weights
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for rows, data, offs in T.chunks(batch, text):
                if m.bias is None:
                    continue
                some = []
                for row, bucket in features(data, offs, m.settings):
                    at = np.flatnonzero(w[bucket])
                    some.append((row[at], bucket[at]))
                row, bucket = _distinct(np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some]), m.settings.bits)
                total = np.bincount(row, w[bucket], len(offs) - 1) * _scale(data, offs, m.settings) + m.bias
                p[rows] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out])

    return docs.mapInArrow(probabilities, StructType([*docs.schema.fields]).add(out, "double"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into the part that no label may be learned from; null ids do not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


QUALITY = Settings(grams=2, alpha=4.0, l1=0.3, epochs=3)
TOXICITY = Settings(grams=2, skips=(1, 2), alpha=2.0, l1=12.0, power=0.0, least_rows=8, max_rows=40_000)


def classified(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, parts: int, part: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted without the held-out part, applied to every document."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"), parts, part)), label, settings)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
