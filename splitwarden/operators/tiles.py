"""All pairs of a class without a row per pair: rows are dealt to tiles, and each two tiles meet in one task.

A class of n rows has ceil(n / size) tiles, to which rows are dealt by a hash; a cell is a pair of tiles. A row goes to
as many cells as its class has tiles, so that n * n / size rows are shuffled instead of n * n / 2 formed, no cell holds
more than about two tiles, whatever the class, and the number of cells grows with the square of a class: a class that
holds a third of all rows is spread like any other. In a cell pairs are blocks of a matrix (products, or differing
bits); what leaves it are the pairs that reach a threshold, a forest of them, counts, or the few first in an order.

Pairs are (a, b) with a < b. Rows with a null class or key have none. Rows that repeat a key have no pair with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from ..functions.kernels import dot, doubles, norm
from .components import least_reachable

#: Rows of a tile, of the blocks that a cell is taken in, and of those whose pairs are hashed at once.
SIZE, BLOCK, HASHED = 2048, 512, 32


def cells(df: DataFrame, size: int = SIZE) -> DataFrame:
    """key, cls and further columns, with the row's tile and the cells (i <= j) that it goes to."""
    rows = df.where("key is not null and cls is not null")
    tiles = rows.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("tiles"))
    dealt = rows.join(tiles, "cls").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    columns = [c for c in dealt.columns if c not in ("tiles", "other")]
    placed = dealt.select(*columns, other).select(*columns, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    # Cells are little data and much work: a number of partitions keeps Spark from joining them into a few tasks by their bytes.
    session = df.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return placed.repartition(parts, "cls", "i", "j")


class Cell:
    """The rows of a cell: keys, their order, and the blocks of pairs in it."""

    def __init__(self, table: pa.Table):
        self.table = table
        keys = table["key"].combine_chunks()
        self.keys = keys.to_numpy(zero_copy_only=False)
        self.order = np.unique(self.keys, return_inverse=True)[1]
        tile, i, j = (table[c].to_numpy() for c in ("tile", "i", "j"))
        self.left, self.right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        self.same = bool(len(i)) and i[0] == j[0]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, other rows, and which of their pairs count, each once."""
        right = self.order[self.right]
        for s in range(0, len(self.left), BLOCK):
            x = self.left[s : s + BLOCK]
            mine = self.order[x][:, None]
            yield x, self.right, mine < right if self.same else mine != right

    def pairs(self, values: Callable[[np.ndarray, np.ndarray], np.ndarray], kept: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the lesser and of the greater key of the pairs whose values are kept, and the values."""
        out = []
        for x, y, ok in self.blocks():
            v = values(x, y)
            at, to = np.nonzero(ok & kept(v))
            a, b = x[at], y[to]
            turned = self.order[a] > self.order[b]
            out.append((np.where(turned, b, a), np.where(turned, a, b), v[at, to]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none, none.astype(float))

    def column(self, name: str) -> np.ndarray:
        return self.table[name].combine_chunks().to_numpy(zero_copy_only=False)

    def matrix(self, name: str) -> np.ndarray:
        return self.table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(self.table.num_rows, -1)


def vectors_of(df: DataFrame, key: str, cls: str, vector: str) -> DataFrame:
    """key, cls, v (of length 1) and its dimension: rows without a vector, or of length 0, have no place."""
    unit = df.select(F.col(key).alias("key"), F.col(cls).alias("cls"), doubles(F.col(vector)).alias("v")).withColumn("len", norm(F.col("v"))).where("len > 0")
    return unit.select("key", "cls", "v", "len", F.size("v").alias("dim"))


def _cosines(cell: Cell) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    v, size = cell.matrix("v"), cell.column("len")
    return lambda x, y: (v[x] @ v[y].T) / (size[x][:, None] * size[y])


def _bits(cell: Cell) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    h = cell.column("h").astype(np.int64).view(np.uint64)
    return lambda x, y: np.bitwise_count(h[x][:, None] ^ h[y]).astype(np.int64)


def _made(cell: Cell, a: np.ndarray, b: np.ndarray, **more: np.ndarray) -> pa.Table:
    take = lambda i: cell.table["key"].combine_chunks().take(pa.array(i, pa.int64()))
    cls = cell.table["cls"].combine_chunks().take(pa.array(a, pa.int64()))
    return pa.table({"a": take(a), "b": take(b), "cls": cls, **more})


def _schema(df: DataFrame, more: str) -> str:
    kinds = dict(df.dtypes)
    return f"a {kinds['key']}, b {kinds['key']}, cls {kinds['cls']}, {more}"


def forest(a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which edges make a forest that joins, at each rank, what the edges up to that rank join.

    Each round keeps the first edge at every component (Boruvka); ranks differ, so that no cycle closes.
    """
    by = np.argsort(rank, kind="stable")
    nodes, ends = np.unique(np.concatenate([a[by], b[by]]), return_inverse=True)
    u, v, own = ends[: len(a)], ends[len(a) :], by
    label, kept = np.arange(len(nodes)), []
    while len(u):
        first = np.full(len(nodes), -1)
        # Written from the last to the first, so that the first edge at a component stays.
        at = np.arange(len(u))[::-1]
        first[u[::-1]] = at
        other = np.full(len(nodes), -1)
        other[v[::-1]] = at
        both = np.where(first < 0, other, np.where(other < 0, first, np.minimum(first, other)))
        chosen = np.unique(both[both >= 0])
        kept.append(own[chosen])
        found, least = least_reachable(u[chosen], v[chosen])
        label = np.arange(len(nodes))
        label[found] = least
        u, v = label[u], label[v]
        open_ = u != v
        u, v, own = u[open_], v[open_], own[open_]
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


def cosine_pairs(df: DataFrame, key: str, cls: str, vector: str, least: float, linking: bool = False, size: int = SIZE, between: tuple[int, int, float] | None = None) -> DataFrame:
    """a, b, cls, score of the pairs with a score of at least ``least``.

    linking: only as many of them as link the same items at every threshold from ``least`` on, a forest in each cell.
    between: (first, last, width): only scores of these widths, counted from -1 (the outer ones hold what lies beyond).
    """
    units = vectors_of(df, key, cls, vector)

    def work(table: pa.Table) -> pa.Table:
        cell = Cell(table)
        if between is None:
            kept = lambda s: s >= least
        else:
            first, last, width = between
            slices = lambda s: np.clip(np.floor((s + 1) / width), 0, round(2 / width) - 1)
            kept = lambda s: (slices(s) == first) | (slices(s) == last)
        a, b, score = cell.pairs(_cosines(cell), kept)
        if linking and len(a):
            at = forest(a, b, -score)
            a, b, score = a[at], b[at], score[at]
        return _made(cell, a, b, score=pa.array(score, pa.float64()))

    return cells(units, size).groupBy("cls", "dim", "i", "j").applyInArrow(work, _schema(units, "score double"))


def hamming_pairs(df: DataFrame, key: str, cls: str | None, bits: str, most: int, linking: bool = False, size: int = 2 * SIZE) -> DataFrame:
    """a, b, cls, distance of the pairs that are at most so many bits apart, within a class or over all (cls 0)."""
    hashes = df.select(F.col(key).alias("key"), (F.col(cls) if cls else F.lit(0)).alias("cls"), F.col(bits).cast("long").alias("h")).where("h is not null")

    def work(table: pa.Table) -> pa.Table:
        cell = Cell(table)
        a, b, distance = cell.pairs(_bits(cell), lambda d: d <= most)
        if linking and len(a):
            at = forest(a, b, distance)
            a, b, distance = a[at], b[at], distance[at]
        return _made(cell, a, b, distance=pa.array(distance, pa.int32()))

    return cells(hashes, size).groupBy("cls", "i", "j").applyInArrow(work, _schema(hashes, "distance int"))


def hamming_across(df: DataFrame, key: str, cls: str, bits: str, side: str, most: int, size: int = 2 * SIZE) -> DataFrame:
    """a, b, distance: rows whose side is true with rows whose side is not, over all classes, most bits apart at most."""
    hashes = df.select(F.col(key).alias("key"), F.lit(0).alias("cls"), F.col(bits).cast("long").alias("h"), F.col(side).alias("side")).where("h is not null and side is not null")
    kind = dict(hashes.dtypes)["key"]

    def work(table: pa.Table) -> pa.Table:
        cell = Cell(table)
        side, far = cell.column("side").astype(bool), _bits(cell)
        # A side's rows that repeat a key are rows of their own.
        cell.order = np.arange(len(side))
        found = []
        for x, y, ok in cell.blocks():
            d = far(x, y)
            at, to = np.nonzero(ok & (d <= most) & (side[x][:, None] != side[y]))
            a, b = x[at], y[to]
            found.append((np.where(side[a], a, b), np.where(side[a], b, a), d[at, to]))
        a, b, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        take = lambda i: table["key"].combine_chunks().take(pa.array(i, pa.int64()))
        return pa.table({"a": take(a), "b": take(b), "distance": pa.array(d, pa.int32())})

    return cells(hashes, size).groupBy("cls", "i", "j").applyInArrow(work, f"a {kind}, b {kind}, distance int")


def cosine_counts(df: DataFrame, key: str, cls: str, vector: str, edges: Callable[[np.ndarray], np.ndarray], size: int = SIZE) -> DataFrame:
    """bin, n: how many pairs of a class have their score in each bin; edges gives the bins of scores."""
    units = vectors_of(df, key, cls, vector)

    def work(table: pa.Table) -> pa.Table:
        cell = Cell(table)
        scores, told = _cosines(cell), {}
        for x, y, ok in cell.blocks():
            bins, n = np.unique(edges(scores(x, y)[ok]), return_counts=True)
            for k, m in zip(bins.tolist(), n.tolist(), strict=True):
                told[k] = told.get(k, 0) + m
        return pa.table({"bin": pa.array([*told], pa.int64()), "n": pa.array([*told.values()], pa.int64())})

    return cells(units, size).groupBy("cls", "dim", "i", "j").applyInArrow(work, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def _first_of(names: list[bytes], lesser: np.ndarray, greater: np.ndarray, mark: bytes, k: int, best: list[tuple[str, int, int]], order: np.ndarray) -> list[tuple[str, int, int]]:
    """The k first of best and the pairs of a row of lesser with a row of greater behind it in order.

    lesser and greater are in order. The first 32 bits of the digests, taken for blocks of pairs, tell which may be
    among the first; only those are hashed whole.
    """
    heads = [mark + n + b"|" for n in names]
    head, tail = np.array([len(h) for h in heads]), np.array([len(n) for n in names])
    least = int(best[-1][0][:8], 16) if len(best) == k else 1 << 32
    behind = order[greater]
    for s in range(0, len(lesser), HASHED):
        x = lesser[s : s + HASHED]
        y = greater[np.searchsorted(behind, order[x[0]], "right") :]
        for many in np.unique(head[x]):
            own = x[head[x] == many]
            for more in np.unique(tail[y]):
                other = y[tail[y] == more]
                if many + more <= digests.LONGEST:
                    value = digests.md5_heads([heads[i] for i in own], [names[i] for i in other])
                    value = np.where(order[own][:, None] < order[other], value, np.int64(1) << 32)
                    few = value.ravel()
                    limit = min(least, int(np.partition(few, k - 1)[k - 1])) if len(few) > k else least
                    at, to = np.nonzero((value <= limit) & (value < 1 << 32))
                else:
                    at, to = np.nonzero(order[own][:, None] < order[other])
                found = [(hashlib.md5(heads[p] + names[q]).hexdigest(), p, q) for p, q in zip(own[at].tolist(), other[to].tolist(), strict=True)]
                if found:
                    best = sorted([*best, *found], key=lambda r: (r[0], order[r[1]], order[r[2]]))[:k]
                    least = int(best[-1][0][:8], 16) if len(best) == k else 1 << 32
    return best


def first_pairs(df: DataFrame, key: str, cls: str, k: int, seed: int = 0, size: int = SIZE) -> DataFrame:
    """a, b: of all pairs of a class the k first in md5 order (seed|a|b). Each cell hands on k pairs at most."""
    rows = df.select(F.col(key).alias("key"), F.col(cls).alias("cls"))
    kind = dict(rows.dtypes)["key"]

    def work(table: pa.Table) -> pa.Table:
        cell = Cell(table)
        names = [str(x).encode() for x in cell.keys.tolist()]
        sides = [side[np.argsort(cell.order[side], kind="stable")] for side in (cell.left, cell.right)]
        best = _first_of(names, *sides, f"{seed}|".encode(), k, [], cell.order) if k > 0 else []
        if not cell.same and k > 0:
            best = _first_of(names, *sides[::-1], f"{seed}|".encode(), k, best, cell.order)
        take = lambda i: table["key"].combine_chunks().take(pa.array(i, pa.int64()))
        return pa.table({"a": take([p for _, p, _ in best]), "b": take([q for _, _, q in best]), "o": pa.array([o for o, _, _ in best], pa.string())})

    return cells(rows, size).groupBy("cls", "i", "j").applyInArrow(work, f"a {kind}, b {kind}, o string").orderBy("o", "a", "b").limit(k).select("a", "b")
