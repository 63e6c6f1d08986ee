"""Vectors as short codes: product quantisation with exact nearest entries by annular norm pruning.

Vectors become integers, floor(scale * x), and are cut into equal parts; each part position has a codebook of at most
256 entries. A codebook starts as that part of the vectors of the smallest keys and goes through a fixed number of
rounds: every part goes to its nearest entry (squared distance, ties to the lower index), then each entry becomes the
componentwise floor of its parts' mean. Unused entries stay. All arithmetic is exact, so that neither partitioning nor
a repeated task changes a result.

* Nearest entry: entries are sorted by norm. An entry whose norm differs from the part's by more than the best distance
  so far cannot be as near (triangle inequality), so binary searches of the norms bound an annulus that must be
  evaluated, and nothing else has to be. A task sorts a batch's parts by norm and takes them in blocks, whose annuli
  nearly coincide; each block starts with the entries next to its norms and evaluates further ones, as matrix
  products, until its annulus, which shrinks with each better distance, is covered (bounds included).
* A round is one pass over the vectors: tasks hand on (part, entry, count, sums) once a batch, Spark adds them up.
  The driver holds the codebooks alone: entries x dimensions integers. Nothing is written.

Left out: vectors that are null or hold null or non-finite components, and those of another length than the vector of
the smallest key (whose length must be a multiple of parts, else ValueError). Null keys come last; among equal keys the
lesser vector comes first. Rows that repeat another each have a code and a weight. With fewer vectors than entries,
codebooks are shorter. An empty table gives an empty result. A label's error adds up over equal labels, nulls together.
Components whose squared distances would not fit a long are refused (OverflowError). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from . import _text as T

#: Parts that are compared with a slice of a codebook at once.
BLOCK = 256
#: Entries next to a block's norms that it starts with.
FIRST = 32
_EXACT = float(1 << 53)


def integers(column: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat components as int64, each row's offset (one more at the end), and which rows are sound."""
    n = len(column)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    upto = np.append(0, np.cumsum(lengths))
    values = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale)  # null components become NaN
    sound = column.is_valid().to_numpy(zero_copy_only=False).copy()
    bad = ~np.isfinite(values)
    sound[np.repeat(np.arange(n), lengths)[bad]] = False
    values[bad] = 0
    if len(values) and float(np.abs(values).max()) >= 1 << 62:
        raise OverflowError("components are too large for exact distances")
    return values.astype(np.int64), upto, sound


def _refused(largest: int, width: int) -> None:
    if 4 * largest * largest * max(width, 1) >= 1 << 61:  # four parts' errors add up
        raise OverflowError("components are too large for exact distances")


class Codebook:
    """Entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        square = np.einsum("ij,ij->i", entries, entries)
        by = np.argsort(square, kind="stable")
        self.index, self.entries, self.square = by, entries[by], square[by]
        self.norm = np.sqrt(self.square.astype(np.float64))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry and squared distance of each part, and how many distances were evaluated."""
        n, k, seen = len(parts), len(self.index), 0
        best, found = np.full(n, np.iinfo(np.int64).max), np.full(n, 256)
        square = np.einsum("ij,ij->i", parts, parts)
        norm = np.sqrt(square.astype(np.float64))
        order = np.argsort(norm)
        slack = 1e-9 * (1 + max(norm.max(initial=0), self.norm.max(initial=0)))
        exact = 2 * norm.max(initial=0) * self.norm.max(initial=0) < _EXACT / 4
        entries = self.entries.astype(np.float64) if exact else self.entries
        for a in range(0, n, BLOCK):
            rows = order[a : a + BLOCK]
            own = parts[rows].astype(np.float64) if exact else parts[rows]

            def evaluate(lo: int, hi: int) -> int:
                distance = square[rows, None] + self.square[lo:hi] - 2 * (own @ entries[lo:hi].T).astype(np.int64)  # noqa: B023
                least = distance.min(1)
                index = np.where(distance == least[:, None], self.index[lo:hi], 256).min(1)
                tie, less = least == best[rows], least < best[rows]  # noqa: B023
                found[rows] = np.where(less, index, np.where(tie, np.minimum(index, found[rows]), found[rows]))  # noqa: B023
                best[rows] = np.minimum(best[rows], least)  # noqa: B023
                return distance.size

            first, last = norm[rows[0]], norm[rows[-1]]
            lo = max(0, min(int(np.searchsorted(self.norm, first)) - FIRST // 2, k - FIRST))
            hi = min(k, max(int(np.searchsorted(self.norm, last)) + FIRST // 2, FIRST))
            seen += evaluate(lo, hi)
            while True:
                reach = np.sqrt(best[rows].astype(np.float64)) + slack
                low = int(np.searchsorted(self.norm, (norm[rows] - reach).min(), "left"))
                high = int(np.searchsorted(self.norm, (norm[rows] + reach).max(), "right"))
                if low >= lo and high <= hi:
                    break
                # The nearer entries first, so that the annulus may shrink before the others are due.
                if low < lo:
                    down = max(low, lo - FIRST)
                    seen, lo = seen + evaluate(down, lo), down
                if high > hi:
                    up = min(high, hi + FIRST)
                    seen, hi = seen + evaluate(hi, up), up
        return found, best, seen


@dataclass(frozen=True)
class Codebooks:
    """entries: for each part position, one row of integers per entry."""

    entries: tuple[np.ndarray, ...]
    scale: int

    @property
    def dimension(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()

    def decoded(self, code: str) -> list[int]:
        """The entries that a code names, one after the other."""
        return [x for i, e in enumerate(self.entries) for x in e[int(code[2 * i : 2 * i + 2], 16)].tolist()]


def _kept(batch: pa.RecordBatch, dimension: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that take part and their vectors."""
    values, upto, sound = integers(batch.column(batch.schema.get_field_index("vector")), scale)
    rows = np.flatnonzero(sound & (np.diff(upto) == dimension))
    return rows, values[upto[rows][:, None] + np.arange(dimension)]


def _assign(books: Codebooks, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry (row, part) and squared distance (row, part)."""
    width = books.dimension // len(books.entries)
    largest = max([int(np.abs(vectors).max(initial=0)), *(int(np.abs(e).max(initial=0)) for e in books.entries)])
    _refused(largest, width)
    found = [Codebook(e).nearest(np.ascontiguousarray(vectors[:, i * width : (i + 1) * width])) for i, e in enumerate(books.entries)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(shared):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            _, vectors = _kept(batch, books.dimension, books.scale)
            entry, _ = _assign(books, vectors)
            part, index, count, total = [], [], [], []
            width = books.dimension // len(books.entries)
            for i in range(len(books.entries)):
                by = np.argsort(entry[:, i], kind="stable")
                used, first, n = np.unique(entry[by, i], return_index=True, return_counts=True)
                if len(used):
                    part += [i] * len(used)
                    index += used.tolist()
                    count += n.tolist()
                    total += np.add.reduceat(vectors[by, i * width : (i + 1) * width], first).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(index, pa.int32()), pa.array(count, pa.int64()), pa.array(total, pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return sums


def _encode(shared):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            rows, vectors = _kept(batch, books.dimension, books.scale)
            entry, distance = _assign(books, vectors)
            codes = [bytes(x).hex() for x in entry.astype(np.uint8)]
            own = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows, pa.int64())) for c in ("key", "label")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(codes, pa.string()), T.long_array(distance.sum(1))], names=["key", "label", "code", "error"])

    return encode


def _first(vectors: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The codebooks before the first round."""
    component = lambda x: F.floor(x.cast("double") * scale)
    # A null array fails as well: forall of null is null.
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = vectors.where(sound).select("key", F.transform("vector", component).alias("v"))
    order = [F.col("key").asc_nulls_last(), F.col("v")]
    start = whole.orderBy(*order).limit(1).collect()
    if not start:
        return None
    dimension = len(start[0]["v"])
    if not dimension or dimension % parts:
        raise ValueError(f"{dimension} components cannot be cut into {parts} equal parts")
    rows = whole.where(F.size("v") == dimension).orderBy(*order).limit(entries).collect()
    matrix = np.array([r["v"] for r in rows], np.int64)
    return Codebooks(tuple(np.split(matrix, parts, axis=1)), scale)


def codebooks(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """The codebooks after all rounds; None without any sound vector."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    vectors = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"))
    books = _first(vectors, parts, entries, scale)
    sc = df.sparkSession.sparkContext
    for _ in range(rounds if books is not None else 0):
        shared = sc.broadcast(books)
        width = books.dimension // parts
        handed = vectors.select("vector").mapInArrow(_sums(shared), "part int, entry int, n long, total array<long>")
        each = handed.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)))
        new = [e.copy() for e in books.entries]
        for r in each.collect():  # entries x parts rows at most
            new[r["part"]][r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
        shared.destroy()
        books = Codebooks(tuple(new), scale)
    return books


def compressed(df: DataFrame, books: Codebooks | None, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label, code, error (squared distance to what the code stands for) and label_error, of all sound vectors."""
    vectors = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    types = {f.name: f.dataType for f in vectors.schema.fields}
    schema = Ty.StructType([Ty.StructField("key", types["key"]), Ty.StructField("label", types["label"]), Ty.StructField("code", Ty.StringType()), Ty.StructField("error", Ty.LongType())])
    if books is None:
        coded = vectors.where("false").select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = vectors.mapInArrow(_encode(df.sparkSession.sparkContext.broadcast(books)), schema)
    # Sums are made a task first, so that a label of a third of all rows is no hot group; no window holds a label's rows.
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"]), "left").select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error")


def digest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and the digest of the final codebooks."""
    books = codebooks(df, key, vector)
    return compressed(df, books, key, vector, label).select(F.col(key).alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256() if books is not None else "").alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """a{i}: each part's nearest entry of the codebook b{i}."""
    return f"""
a{i} AS MATERIALIZED (SELECT rid, part, min(error * 256 + entry) AS best, any_value(x) AS x FROM (
  SELECT p.rid, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS error
  FROM p JOIN b{i} b USING (part)) GROUP BY rid, part)"""


def _mean_sql(i: int) -> str:
    return f"""
m{i} AS MATERIALIZED (SELECT part, entry, list(floored ORDER BY k) AS c FROM (
  SELECT part, best % 256 AS entry, k, ((sum(x[k]) - (((sum(x[k]) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS floored
  FROM a{i}, LATERAL (SELECT unnest(range(1, len(a{i}.x) + 1)) AS k) GROUP BY part, best % 256, k) GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (part, entry))"""


SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, q) AS rid, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)),
p AS MATERIALIZED (SELECT rid, part, q[part * (len(q) // 4) + 1 : (part + 1) * (len(q) // 4)] AS x FROM v, range(4) t(part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS c FROM p WHERE rid <= 256),
{",".join(_round_sql(i) + "," + _mean_sql(i) for i in range(4))},
{_round_sql(4)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4),
e AS (SELECT rid, string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (rid), h
"""
