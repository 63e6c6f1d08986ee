"""Exact top-k search by inner product on a pivot-distance index.

Vectors become integers, floor(scale * x). Scores are inner products; the index works with distances, so each
vector x gets one more coordinate sqrt(M - |x|^2), M the largest squared norm, and each query a zero: the
nearest in that space have the largest products, as |q - x|^2 = |q|^2 + M - 2 q.x.

* Index: pivots are chosen far apart from a bounded sample; every vector is keyed by its nearest pivot and its
  distance to it. Sorted by that key, consecutive rows form rings (annuli) of at most ``ring`` vectors. Equal
  vectors, as many as there are, spread over rings by their ids.
* Search: a ring around pivot p from lo to hi holds nothing nearer to q than max(lo - d(q,p), d(q,p) - hi)
  (triangle inequality), nor than (d(q,p) - d(q,p')) / 2 for another pivot p'. The first expansion evaluates
  the rings with the least bounds until they hold enough vectors, which gives each query a k-th best score; the
  second one those rings, and only those, whose bound does not exceed it. Rings left out cannot hold a result.
* Bounds are computed from the rings' five numbers, in blocks of queries and rings. What is left is one row for a block
  of queries and a ring, with the places of the queries in their block; the block's vectors and the ring's meet there
  as a matrix product and hand on k rows a query. No row stands for a query and a ring, but in the first expansion.

Scores are exact integers: float64 products where they stay below 2**53, int64 otherwise. Vectors that are
null or hold null or non-finite components take no part; shorter vectors count as padded with zeros. Of rows
that repeat a vec_id, the best-scoring one counts, and none of them answers its own id. Rows with a null
vec_id are left out. Ties go to the smaller vec_id. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

_EXACT = float(1 << 53)
#: Rings whose bounds are compared with a block of queries at once.
_RINGS = 8192


def _matrix(column: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """Rows of int64; lists without nulls and non-finite numbers only."""
    upto = column.offsets.to_numpy()
    flat = np.floor(column.values.to_numpy(zero_copy_only=False)[upto[0] : upto[-1]].astype(np.float64) * scale)
    n = np.diff(upto)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(upto[:-1] - upto[0], n)] = flat.astype(np.int64)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _distances(a: np.ndarray, b: np.ndarray, most: float, query: bool) -> np.ndarray:
    """Between lifted vectors; query: rows of a have zero as their further coordinate."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    own = np.einsum("ij,ij->i", a, a)
    up = np.sqrt(np.maximum(most - np.einsum("ij,ij->i", b, b), 0))
    mine = np.zeros(len(a)) if query else np.sqrt(np.maximum(most - own, 0))
    square = (own + mine**2)[:, None] + most - 2 * (a @ b.T + mine[:, None] * up)
    return np.sqrt(np.maximum(square, 0))


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    chosen = [0]
    gap = np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]).astype(np.float64) ** 2).sum(1))
        if not gap.max() > 0:
            break
        chosen.append(int(gap.argmax()))
    return sample[chosen]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best different ids, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        if len(np.unique(ids[near])) < k:
            near = np.arange(len(scores))
    else:
        near = np.arange(len(scores))
    near = near[np.lexsort((ids[near], -scores[near]))]
    _, first = np.unique(ids[near], return_index=True)
    return near[np.sort(first)[:k]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, pivots: int = 32, sample: int = 2048, ring: int = 2048, block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors for each query; both tables have vec_id, embedding.

    sample bounds the rows that pivots are chosen from, those of the least hash; every vector is indexed.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        whole = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))

    rows, asked = sound(vectors), sound(queries)
    square = F.aggregate("e", F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    width, most = rows.agg(F.max(F.size("e")), F.max(square)).first()
    query_width = asked.agg(F.max(F.size("e"))).first()[0]
    out_schema = "query_id long, rank int, vec_id long, score long"
    if width is None or query_width is None:
        return spark.createDataFrame([], out_schema)
    width, most = max(width, query_width, 1), float(most)
    picked = rows.select(F.xxhash64("vec_id", "e").alias("h"), "e").orderBy("h").limit(sample).select("e").toPandas().e
    picked = _matrix(pa.array(list(picked), pa.list_(pa.float64())), width, scale)
    centres = _far_apart(picked, pivots)
    slack = 1e-6 * (1 + np.sqrt(most))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), width, scale)
            d = _distances(m, centres, most, False)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32()), pa.array(d[np.arange(len(m)), near]), pa.array([r.tobytes() for r in m], pa.binary())], names=["vec_id", "pivot", "d", "v"])

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ringed(part: pa.Table) -> Iterator[pa.RecordBatch]:
            pivot, d = part["pivot"].to_numpy(), part["d"].to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])), len(pivot))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                ids, v = part["vec_id"].to_numpy()[a:b], b"".join(part["v"].to_pylist()[a:b])
                name = int(ids[0]) ^ int(np.float64(d[a]).view(np.int64)) ^ (int(pivot[a]) << 40)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([pivot[a]], pa.int32()), pa.array([d[a]]), pa.array([d[b - 1]]), pa.array([b - a], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([v], pa.binary())], names=["ring", "pivot", "lo", "hi", "n", "ids", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, ring):
                yield from ringed(pa.Table.from_batches([batch.slice(at, ring)]))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = rows.mapInArrow(keyed, "vec_id long, pivot int, d double, v binary").repartitionByRange(parts, "pivot", "d", "vec_id").sortWithinPartitions("pivot", "d", "vec_id")
    index = written(index.mapInArrow(rings, "ring long, pivot int, lo double, hi double, n int, ids binary, v binary"), "rings")

    summary = index.select("ring", "pivot", "lo", "hi", "n")
    ring_blocks = max(1, -(-index.count() // _RINGS))
    total = asked.count()
    query_blocks = max(1, -(-total // block))
    # Rows that repeat a vec_id with another vector are queries of their own; equal ones are one.
    asked = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "e").alias("row"), "e").dropDuplicates(["query_id", "row"])
    in_blocks = summary.groupBy(F.pmod(F.xxhash64("ring"), F.lit(ring_blocks)).alias("rings_of")).agg(F.collect_list(F.struct("ring", "pivot", "lo", "hi", "n")).alias("rings"))

    def in_query_blocks(queries: DataFrame, *more: str) -> DataFrame:
        """of, qs: the queries of a block, in one order whatever is known of them."""
        return queries.groupBy(F.pmod("row", F.lit(query_blocks)).alias("of")).agg(F.array_sort(F.collect_list(F.struct("query_id", "row", "e", *more))).alias("qs"))

    def bounded(queries: DataFrame, chosen, schema: str) -> DataFrame:
        """What chosen takes from the bounds of a block of queries and a block of rings; vectors stay behind."""
        met = in_query_blocks(queries, "reach").select("of", "qs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ring_blocks - 1).cast("long"))).alias("rings_of")).join(in_blocks, "rings_of")

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, qs, rs = batch.columns
                q_at, r_at = qs.offsets.to_numpy(), rs.offsets.to_numpy()
                for i in range(batch.num_rows):
                    q, r = qs.values.slice(q_at[i], q_at[i + 1] - q_at[i]), rs.values.slice(r_at[i], r_at[i + 1] - r_at[i])
                    name, pivot, lo, hi, n = (r.field(c).to_numpy(zero_copy_only=False) for c in range(5))
                    m = _matrix(q.field(2), width, scale)
                    d = _distances(m, centres, most, True)
                    away, half = d[:, pivot], ((d - d.min(1, keepdims=True)) / 2)[:, pivot]
                    bound = np.maximum(np.maximum(lo - away, away - hi), np.maximum(half, 0))
                    # A score of at least reach lies within the distance sqrt(|q|^2 + M - 2 reach).
                    reach = q.field(3).to_numpy(zero_copy_only=False).astype(float)
                    norm = np.einsum("ij,ij->i", m.astype(np.float64), m.astype(np.float64))
                    limit = np.where(np.isnan(reach), np.inf, np.sqrt(np.maximum(norm + most - 2.0 * np.nan_to_num(reach), 0)) + slack)
                    yield chosen(of[i].as_py(), q, name, n, bound, limit)

        return met.select("of", "qs", "rings").mapInArrow(bounds, schema)

    blocks = written(in_query_blocks(asked), "query_blocks")

    def evaluated(pairs: DataFrame) -> DataFrame:
        """The k best of each ring for the queries of a block that stand at the places; pairs: of, ring, places."""

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                qs, places = batch.column(2), batch.column(3)
                at, upto = qs.offsets.to_numpy(), places.offsets.to_numpy()
                for i in range(batch.num_rows):
                    ids = np.frombuffer(batch.column(0)[i].as_py(), np.int64)
                    v = np.frombuffer(batch.column(1)[i].as_py(), np.int64).reshape(len(ids), width)
                    q = qs.values.slice(at[i], at[i + 1] - at[i]).take(places.values.slice(upto[i], upto[i + 1] - upto[i]))
                    got = _products(_matrix(q.field(2), width, scale), v)
                    found = []
                    for x, row in zip(q.field(0).to_pylist(), got, strict=True):
                        other = ids != x
                        best = _best(ids[other], row[other], k)
                        found.append((np.full(len(best), x), ids[other][best], row[other][best]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

        return pairs.join(blocks, "of").join(index, "ring").select("ids", "v", "qs", "places").mapInArrow(scores, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    def nearest(of: int, q: pa.StructArray, name: np.ndarray, n: np.ndarray, bound: np.ndarray, limit: np.ndarray) -> pa.RecordBatch:
        """Of each query the rings of least bound until they hold more than k vectors."""
        order = np.argsort(bound, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        x, place = np.nonzero(before <= k)
        y = order[x, place]
        own = [q.field(c).take(pa.array(x, pa.int64())) for c in range(2)]
        return pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(x), of), pa.int64()), pa.array(x, pa.int32()), pa.array(name[y]), pa.array(bound[x, y]), pa.array(n[y], pa.int32())], names=["query_id", "row", "of", "place", "ring", "bound", "n"])

    def within(of: int, q: pa.StructArray, name: np.ndarray, n: np.ndarray, bound: np.ndarray, limit: np.ndarray) -> pa.RecordBatch:
        """Of each ring the queries that may have a result in it."""
        y, x = np.nonzero((bound <= limit[:, None]).T)
        rings_of, upto = np.unique(y, return_index=True)
        places = pa.ListArray.from_arrays(pa.array(np.append(upto, len(x)), pa.int32()), pa.array(x, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rings_of), of), pa.int64()), pa.array(name[rings_of]), places], names=["of", "ring", "places"])

    # The first expansion: rings by bound until those before hold more than k vectors, one of which may be the query's own.
    near = bounded(asked.withColumn("reach", F.lit(None).cast("long")), nearest, "query_id long, row long, of long, place int, ring long, bound double, n int")
    held = F.sum("n").over(Window.partitionBy("of", "place").orderBy("bound", "ring").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    first = written(near.withColumn("held", held).where(F.col("held") <= k).select("query_id", "row", "of", "place", "ring"), "first_rings")
    first = first.groupBy("of", "ring").agg(F.collect_list("place").alias("places"))
    start = written(evaluated(first), "first_scores")
    reach = best(start).groupBy("query_id").agg(F.count(F.lit(1)).alias("got"), F.min("score").alias("least"))
    # The second one: the rings within reach of the k-th best score so far, or all of them where there are fewer.
    told = asked.join(reach, "query_id", "left").select("query_id", "row", "e", F.when(F.col("got") >= k, F.col("least")).alias("reach"))
    again = bounded(told, within, "of long, ring long, places array<int>")
    done = best(start.unionByName(evaluated(again)))
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
