"""Similarity join of documents on word shingles: a grouped prefix join.

A document's set holds hashes of its distinct shingles. With one order of all shingles, rare ones first, two
sets of Jaccard similarity t share a shingle within their prefixes: the first |x| - ceil(t|x|) + 1 of the
larger and the first |y| - ceil(2t/(1+t)|y|) + 1 of the smaller one. The order decides the work, never the
result: shingles that repeat within some chunk of the distinct sets are counted over all chunks, the most frequent
of them (``most_frequent`` at most, so that they can be broadcast) come last, by their count, the others before
them by their hash.

* Documents of equal sets are one set (two 64-bit hashes and the size decide that); the sets are written once, sorted.
* Sets of one size with the same prefix form a group, named by one of them, its head. Each other member is verified
  against the head; members that are not linked with it become groups of their own, so that a group is always within
  one component. Its radius is the largest symmetric difference of the head and a member. Only groups enter the join.
* Prefix entries are shuffled by shingle; shingles that only one group has leave at once.
* First, in a few turns, every group proposes one hub of another component: of the first groups, in an order that
  changes each turn, of its shingles the one with which it shares most. Verified links of heads join components, so
  that large sets of near copies grow together without all pairs among their members.
* Twice, where there still are links, every group proposes the group of another component, among those of its shingles,
  whose bitmap is nearest. Groups that met no hub of theirs join their component so, and a large set of near copies does
  not leave pairs that grow with its square; both turns decide the work only.
* Then, for shingles that still stand in several components, each entry outside the shingle's largest component
  is compared with all entries of other components: by size, by position and by bitmaps that bound the
  difference of the sets from below, less the radii of the two groups. Entries of a frequent shingle are dealt out as a
  grid of cells of bounded size. Pairs within one component cannot change it.
* Pairs of groups that pass are expanded: the members of one side are verified against the other side's head; where
  none is linked, those that its radius leaves in reach are verified against its other members.

Verification intersects the whole sets. Every document of the input has one row in the result.

Null and empty texts have an empty set, link with nothing and are their own component. Texts shorter than a
shingle have one shingle, the whole sequence. Rows that repeat a doc_id are documents of their own, and the
component takes the smallest doc_id of its rows; a null doc_id counts only where there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.shared import remove, small_batches, written, written_bucketed
from . import _text as T

#: Rows of a chunk: their number takes the highest bits of sort keys, the shingle the others.
_ROWS = 1 << 9
_TOKEN_BITS = 55
_LEVEL_BITS = 12
_SET_BYTES = 6
#: Bits of the bitmaps that bound differences, and entries on each side of a cell.
_BITS = 1024
_CELL = 4096
#: Turns of verification against the nearest candidates.
_NEAREST = 2
#: Shingles that are counted together, and those (or pairs of bitmaps) that are handled at once.
_COUNTED = 1 << 22
_AT_ONCE = 1 << 18
_BITMAPS = 1 << 16
_LOOKUP_BITS = 22


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, row, shingle) with each row's distinct shingles in ascending order."""
    for rows, data, offs in T.chunks(batch, most_rows=_ROWS):
        starts, ends, first = T.word_spans(data, offs)
        words = T.word_hashes(data, starts, ends, fold=True)
        count = np.diff(first)
        row = np.repeat(np.arange(len(count)), np.maximum(count - width + 1, np.minimum(count, 1)))
        upto = np.searchsorted(row, np.arange(len(count)))
        lo = first[row] + np.arange(len(row)) - upto[row]
        h = T.spans_hash(words, lo, np.minimum(lo + width, first[row + 1]))
        both = np.unique(row.astype(np.uint64) << np.uint64(_TOKEN_BITS) | h >> np.uint64(64 - _TOKEN_BITS))
        yield rows, (both >> np.uint64(_TOKEN_BITS)).astype(np.int64), both & np.uint64((1 << _TOKEN_BITS) - 1)


def _sums(per_row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums of consecutive values modulo 2**64, per_row[i] of them in row i."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    upto = np.append(0, np.cumsum(per_row))
    return total[upto[1:]] - total[upto[:-1]]


def _groups_of(row: np.ndarray, token: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set, a hash of it with so many bits (0 for the empty set), and a name for those sets whose hash
    another set has too: 64 bits of both this hash and a second, independent one."""
    size = np.bincount(row, minlength=n)
    mixed = T.mix(token)
    whole = T.mix(_sums(size, mixed) + size.astype(np.uint64)) >> np.uint64(64 - bits)
    whole = np.where(size > 0, whole, np.uint64(0))
    return size, whole, T.mix(whole ^ T.mix(_sums(size, T.mix(~mixed)) + size.astype(np.uint64)))


def _summaries(width: int, bits: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, null = T.ints(batch, "doc_id")
            keys, _ = T.ints(batch, "k")
            for rows, row, token in _sets(batch, width):
                size, whole, name = _groups_of(row, token, rows.stop - rows.start, bits)
                yield pa.RecordBatch.from_arrays([T.long_array(ids[rows], null[rows]), T.long_array(keys[rows]), pa.array(size, pa.int32()), T.long_array(whole), T.long_array(name)], names=["doc_id", "k", "size", "grp", "name"])

    return summarise


def _whole_sets(width: int, bits: int, clashing: np.ndarray):
    """grp, items: each set that is not empty, six bytes a shingle, once in a chunk."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, row, token in _sets(batch, width):
                size, whole, name = _groups_of(row, token, rows.stop - rows.start, bits)
                whole = np.where(np.isin(whole, clashing), name, whole) if len(clashing) else whole
                flat = np.ascontiguousarray((token >> np.uint64(_TOKEN_BITS - 8 * _SET_BYTES)).astype("<u8")[:, None].view(np.uint8)[:, :_SET_BYTES])
                items = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size * _SET_BYTES)).astype(np.int64)), pa.py_buffer(flat)])
                once = np.unique(whole, return_index=True)[1]
                once = pa.array(once[size[once] > 0])
                yield pa.RecordBatch.from_arrays([T.long_array(whole).take(once), items.take(once).cast(pa.binary())], names=["grp", "items"])

    return sets


def _items(data: np.ndarray) -> np.ndarray:
    """Shingles of bytes that _whole_sets wrote."""
    flat = np.zeros((len(data) // _SET_BYTES, 8), np.uint8)
    flat[:, :_SET_BYTES] = data.reshape(-1, _SET_BYTES)
    return flat.view("<u8").ravel()


def _decoded(batch: pa.RecordBatch, most: int = _AT_ONCE) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, size, shingles) of consecutive rows of a column items: up to _ROWS rows and most shingles, or one row."""
    col = batch.column(batch.schema.get_field_index("items")).cast(pa.large_binary())
    n, bufs = len(col), col.buffers()
    if not n:
        return
    offs, data = np.frombuffer(bufs[1], np.int64, n + 1, col.offset * 8), np.frombuffer(bufs[2], np.uint8)
    a = 0
    while a < n:
        b = min(n, a + _ROWS, max(a + 1, int(np.searchsorted(offs, offs[a] + most * _SET_BYTES, "right")) - 1))
        yield slice(a, b), np.diff(offs[a : b + 1]) // _SET_BYTES, _items(data[offs[a] : offs[b]])
        a = b


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of shingles that several sets of a chunk hold."""

    def counted(token: np.ndarray) -> pa.RecordBatch:
        token.sort()  # in place; only those that repeat are copied
        same = token[1:] == token[:-1]
        first = np.flatnonzero(same & np.append(True, ~same[:-1]))
        n = np.flatnonzero(same & np.append(~same[1:], True)) - first + 2
        return pa.RecordBatch.from_arrays([T.long_array(token[first]), T.long_array(n)], names=["token", "n"])

    held, some = 0, np.empty(_COUNTED + _AT_ONCE, np.uint64)
    for batch in batches:
        for _, _, token in _decoded(batch):
            if held + len(token) > len(some):  # one very long set
                some = np.append(some[:held], np.empty(len(token), np.uint64))
            some[held : held + len(token)] = token
            held += len(token)
            if held >= _COUNTED:
                yield counted(some[:held])
                held = 0
    if held:
        yield counted(some[:held])


@dataclass(frozen=True)
class _Order:
    """The frequent shingles in ascending order, their levels, and a table that rules most others out."""

    token: np.ndarray
    level: np.ndarray
    seen: np.ndarray

    def levels(self, token: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token), np.uint64)
        if len(self.token):
            at = np.flatnonzero(self.seen[(token & np.uint64((1 << _LOOKUP_BITS) - 1)).astype(np.int64)])
            place = np.searchsorted(self.token, token[at])
            place[place == len(self.token)] = 0
            hit = self.token[place] == token[at]
            out[at[hit]] = self.level[place[hit]]
        return out


def _order(sets: DataFrame, most: int) -> _Order:
    counts = written(sets.select("items").mapInArrow(T.lean(_repeats), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    level = F.least(F.floor(64 * F.log2("n")), F.lit((1 << _LEVEL_BITS) - 1)).cast("int")
    by_level = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    least, held = 1 << _LEVEL_BITS, 0
    for x in by_level:
        if (held := held + x["count"]) > most:
            break
        least = x["level"]
    got = counts.where(level >= least).select("token", level.alias("level")).toArrow()
    remove(counts)
    token, levels = got["token"].to_numpy().view(np.uint64), got["level"].to_numpy()
    by = np.argsort(token)
    seen = np.zeros(1 << _LOOKUP_BITS, bool)
    seen[(token & np.uint64((1 << _LOOKUP_BITS) - 1)).astype(np.int64)] = True
    return _Order(token[by], levels[by].astype(np.uint64), seen)


def _least_overlap(size: np.ndarray, percent: int, both: bool) -> np.ndarray:
    """Shingles that a set shares at least with a linked smaller one (both: with one of its own size or larger)."""
    top, bottom = (2 * percent, 100 + percent) if both else (percent, 100)
    return (top * size + bottom - 1) // bottom


def _prefixes(batch: pa.RecordBatch, percent: int, order: _Order) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, size, row, pos, token) with the prefixes of consecutive rows."""
    short = np.uint64(_TOKEN_BITS - _LEVEL_BITS)
    for rows, size, token in _decoded(batch):
        row = np.repeat(np.arange(len(size)), size)
        # Level, then the shingle's highest bits; rows stay apart by the highest bits of all.
        key = row.astype(np.uint64) << np.uint64(_TOKEN_BITS) | order.levels(token) << short | token >> np.uint64(8 * _SET_BYTES) - short
        key.sort()
        pos = np.arange(len(key)) - np.append(0, np.cumsum(size))[row]
        at = np.flatnonzero(pos < (size - _least_overlap(size, percent, False) + 1)[row])
        yield rows, size, row[at], pos[at], key[at] & np.uint64((1 << _TOKEN_BITS) - 1)


def _entries(percent: int, order):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, _ = T.ints(batch, "grp")
            for rows, size, row, pos, token in _prefixes(batch, percent, order.value):
                yield pa.RecordBatch.from_arrays([T.long_array(token), T.long_array(groups[rows][row]), pa.array(size[row], pa.int32()), pa.array(pos, pa.int32())], names=["token", "grp", "size", "pos"])

    return entries


def _alike(percent: int, order):
    """grp, alike: each set with a hash of its size and prefix. Equal hashes only propose members."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, _ = T.ints(batch, "grp")
            for rows, size, row, _, token in _prefixes(batch, percent, order.value):
                alike = T.mix(_sums(np.bincount(row, minlength=len(size)), T.mix(token)) + size.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([T.long_array(groups[rows]), T.long_array(alike)], names=["grp", "alike"])

    return hashed


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, group and place those whose token another group has, one for each token and group.

    No list of a token is held: a row waits for the next one only.
    """
    last, told = None, False  # the row before, as a batch of one, and whether it is out already
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        token, grp = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        at = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])))
        twin = token[at[1:]] == token[at[:-1]]
        again = np.append(False, twin) | np.append(twin, False)
        out = at[again]
        yield rows.take(pa.array(out[1:] if told and again[0] else out))
        last, told = rows.slice(int(at[-1]), 1), bool(again[-1]) or (told and len(at) == 1)


def _fits(size_y, pos_y, size_x, pos_x, percent: int) -> np.ndarray:
    """Whether sets of these sizes (y not larger) that share entries at these places first may be linked."""
    size_y, pos_y, size_x, pos_x = (x.astype(np.int64) for x in (size_y, pos_y, size_x, pos_x))
    need = -(-percent * (size_x + size_y) // (100 + percent))
    near = (100 * size_y >= percent * size_x) & (pos_y < size_y - _least_overlap(size_y, percent, True) + 1)
    return near & (1 + np.minimum(size_x - pos_x - 1, size_y - pos_y - 1) >= need)


def _may_link(size: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """_fits for rows a and b in either order."""
    small = size[a] <= size[b]
    y, x = np.where(small, a, b), np.where(small, b, a)
    return _fits(size[y], pos[y], size[x], pos[x], percent)


def _hubs(percent: int):
    """Of rows sorted by token and turn each one's proposal: the first group of its token, if it is of another component."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_row = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(5)]
            if hub_row is not None:
                cols = [np.append(h, c) for h, c in zip(hub_row, cols, strict=True)]
            token, grp, size, pos, comp = cols
            start = np.append(True, token[1:] != token[:-1])
            hub = np.flatnonzero(start)[np.cumsum(start) - 1]
            hub_row = [c[hub[-1]] for c in cols]
            ok = np.flatnonzero(comp[hub] != comp)
            ok = ok[_may_link(size, pos, hub[ok], ok, percent)]
            pair, n = np.unique(np.stack([grp[hub[ok]], grp[ok]]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(n, pa.int64())], names=["hub", "x", "n"])

    return pairs


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set, of each of _BITS parts of all shingles, whether it holds an odd number."""
    for batch in batches:
        groups, _ = T.ints(batch, "grp")
        for rows, size, token in _decoded(batch):
            n = len(size)
            cell = np.repeat(np.arange(n), size) * _BITS + (token & np.uint64(_BITS - 1)).astype(np.int64)
            odd = np.packbits((np.bincount(cell, minlength=n * _BITS) & 1).astype(np.uint8))
            offs = np.arange(0, len(odd) + 1, _BITS // 8, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([T.long_array(groups[rows]), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(odd)])], names=["grp", "bits"])


def _compared(percent: int, nearest: bool = False, most: int = 1 << 18):
    """Candidate pairs of different components. Rows are sorted by cell (token, i, j); each row with asks is compared
    with each row with answers of its cell; of two rows outside their token's largest component one asks.

    nearest: of each group that asks only the candidate whose bitmap is nearest, with the difference as ``apart``; x asks."""

    def flush(found: list) -> pa.RecordBatch:
        if nearest:
            y, x, apart = np.concatenate(found, axis=1)
            by = np.lexsort([y, apart, x])
            by = by[np.append(True, x[by][1:] != x[by][:-1])]
            return pa.RecordBatch.from_arrays([pa.array(y[by]), pa.array(x[by]), pa.array(apart[by])], names=["y", "x", "apart"])
        pair = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["y", "x"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = [rows.column(i).to_numpy() for i in range(3)]
            cut = np.append(0, np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1)
            if len(cut) > 1:
                yield rows.slice(0, int(cut[-1])), cut
            rest = rows.slice(int(cut[-1]))
        if rest is not None:
            yield rest, np.array([0, rest.num_rows])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for rows, cut in cells(batches):
            grp, size, pos, comp = (rows.column(i).to_numpy() for i in range(3, 7))
            other, asks, answers = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(7, 10))
            radius = rows.column(11).to_numpy()
            raw = rows.column(10).cast(pa.large_binary())
            # The bytes of a slice begin where its own first offset says.
            first = int(np.frombuffer(raw.buffers()[1], np.int64)[raw.offset]) // 8
            bits = np.frombuffer(raw.buffers()[2], np.uint64)[first : first + len(grp) * _BITS // 64].reshape(len(grp), _BITS // 64)
            asking = np.flatnonzero(asks)
            cell = np.searchsorted(cut, asking, "right") - 1
            upto = np.append(0, np.cumsum((cut[cell + 1] - cut[cell])))
            a = 0
            while a < len(asking):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + _BITMAPS, "right")) - 1)
                many = np.diff(upto[a : b + 1])
                x = np.repeat(asking[a:b], many)
                y = np.arange(upto[b] - upto[a]) - np.repeat(upto[a:b] - upto[a] - cut[cell[a:b]], many)
                ok = np.flatnonzero(answers[y] & (comp[y] != comp[x]) & (~other[y] | (grp[x] < grp[y])))
                ok = ok[_may_link(size, pos, y[ok], x[ok], percent)]
                y, x, a = y[ok], x[ok], b
                apart = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64) - radius[y] - radius[x]
                ok = apart * (100 + percent) <= (size[y].astype(np.int64) + size[x]) * (100 - percent)
                if ok.any():
                    y, x = grp[y[ok]], grp[x[ok]]
                    found.append(np.stack([y, x, apart[ok]] if nearest else [np.minimum(y, x), np.maximum(y, x)]))
                    held += len(y)
                if held >= most:
                    yield flush(found)
                    found, held = [], 0
        if found:
            yield flush(found)

    return pairs


def _verified(percent: int):
    """Of pairs y, x with their sets the links, and those that may come as near by ``slack``, if there is such a column."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for batch in batches:
            ys, xs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            apart, total = np.zeros(len(ys), np.int64), np.zeros(len(ys), np.int64)
            for i in range(len(ys)):
                if last != ys[i]:
                    last, a = ys[i], _items(np.frombuffer(batch.column(2)[i].as_py(), np.uint8))
                b = _items(np.frombuffer(batch.column(3)[i].as_py(), np.uint8))
                small, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                total[i] = len(a) + len(b)
                apart[i] = total[i] - 2 * int(np.count_nonzero(large[at] == small))
            # 100 * intersection >= percent * union, in terms of the symmetric difference and both sizes.
            linked = apart * (100 + percent) <= total * (100 - percent)
            slack = batch.schema.get_field_index("slack")
            keep = linked if slack < 0 else (apart - batch.column(slack).to_numpy()) * (100 + percent) <= total * (100 - percent)
            if keep.any():
                out = [pa.array(ys), pa.array(xs), pa.array(apart, pa.int32()), pa.array(linked), *batch.columns[4:]]
                yield pa.RecordBatch.from_arrays(out, names=["y", "x", "apart", "linked", *batch.schema.names[4:]]).filter(pa.array(keep))

    return links


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """y, x, apart, linked and the further columns of the pairs that _verified keeps.

    The sets are bucketed: only the pairs, and one side's sets with them, are shuffled."""
    further = [x for x in pairs.dtypes if x[0] not in ("y", "x")]
    a, b = sets.select(F.col("grp").alias("y"), F.col("items").alias("a")), sets.select(F.col("grp").alias("x"), F.col("items").alias("b"))
    both = pairs.join(b, "x").join(a, "y").select("y", "x", "a", "b", *(c for c, _ in further))
    return both.mapInArrow(T.lean(_verified(percent)), ", ".join(["y long, x long, apart int, linked boolean", *(f"{c} {t}" for c, t in further)]))


def _expanded(pairs: DataFrame, kin: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(y, x of linked groups, tables that this reads) for pairs y, x, ry, rx of groups, one of them with members besides its head."""
    members = kin.select("head", F.col("grp").alias("member"))
    members = members.unionByName(members.select("head", F.col("head").alias("member")).distinct())
    left = pairs.join(members.withColumnRenamed("head", "y"), "y", "left")
    left = left.select(F.coalesce("member", "y").alias("y"), "x", F.col("y").alias("gy"), "rx", F.coalesce("rx", F.lit(0)).alias("slack"))
    near = written(_links(left, sets, percent).select("y", "x", "gy", "rx", "linked"), "near_heads")
    found = near.where("linked").select("gy", "x").distinct()
    open_ = near.where("rx is not null").join(found, ["gy", "x"], "left_anti").withColumnRenamed("x", "gx")
    right = open_.join(kin.select(F.col("head").alias("gx"), F.col("grp").alias("x")), "gx").select("y", "x", "gy", "gx")
    more = _links(right, sets, percent).select("gy", F.col("gx").alias("x"))
    return found.unionByName(more).select(F.col("gy").alias("y"), "x").distinct(), [near]


def _candidates(entries: DataFrame, sets: DataFrame, radius: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """All pairs (y, x) of groups of different components that may hold a link, from entries with their component;
    nearest: one pair for each group that asks."""
    tokens = entries.groupBy("token", "comp").count().groupBy("token").agg(F.sum("count").alias("n"), F.max("count").alias("largest"), F.max_by("comp", F.struct("count", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = entries.join(tokens, "token").withColumn("other", F.col("comp") != F.col("top"))
    bits = sets.join(mixed.select("grp").distinct(), "grp", "left_semi").mapInArrow(T.lean(_bitmaps), "grp long, bits binary")
    bits = bits.join(radius, "grp", "left").select("grp", "bits", F.coalesce("radius", F.lit(0)).alias("radius"))
    # A grid of cells for each token: its rows deal out all entries, its columns those outside the largest component.
    rows, columns = F.ceil(F.col("n") / _CELL).cast("int"), F.ceil((F.col("n") - F.col("largest")) / _CELL).cast("int")
    i, j = F.pmod(F.xxhash64("grp", F.lit(1)), rows).cast("int"), F.pmod(F.xxhash64("grp", F.lit(2)), columns).cast("int")

    def place(i, j, asks, answers):
        return F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), answers.alias("answers"))

    answering = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: place(F.col("i"), c, F.col("other") & (c == F.col("j")), F.lit(True)))
    asking = F.transform(F.filter(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.col("other") & (r != F.col("i"))), lambda r: place(r, F.col("j"), F.lit(True), F.lit(False)))
    dealt = mixed.select("token", "grp", "size", "pos", "comp", "other", rows.alias("rows"), columns.alias("columns"), i.alias("i"), j.alias("j"))
    dealt = dealt.select("token", "grp", "size", "pos", "comp", "other", F.inline(F.concat(answering, asking))).join(bits, "grp")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("token", "i", "j", "grp", "size", "pos", "comp", "other", "asks", "answers", "bits", "radius").repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j")
    if nearest:
        told = dealt.mapInArrow(T.lean(_compared(percent, True)), "y long, x long, apart long").groupBy("x").agg(F.min_by("y", F.struct("apart", "y")).alias("y"))
        return told.select(F.least("y", "x").alias("y"), F.greatest("y", "x").alias("x")).distinct()
    return dealt.mapInArrow(T.lean(_compared(percent)), "y long, x long").distinct()


def classes(docs: DataFrame, percent: int = 75, width: int = 5, turns: int = 3, most_frequent: int = 1 << 20, hash_bits: int = 64) -> DataFrame:
    """doc_id, k, n_shingles, grp (documents of equal sets) and comp (documents joined by links), one row each.

    Two documents are linked when 100 * |intersection| >= percent * |union|. k is the key of _text.keyed.
    turns: rounds of verification against hubs before all remaining pairs; it decides the work only.
    most_frequent: shingles whose order follows their count; it decides the work only.
    hash_bits: of a set's first hash. Hashes that sets with different second hashes share are told to all tasks: of n
    different sets about n * n / 2 ** (hash_bits + 1), 3 at 10**10 sets; over 65,536 of them are refused.
    """
    with small_batches(docs.sparkSession):
        return _classes(docs, percent, width, turns, most_frequent, hash_bits)


def _classes(docs: DataFrame, percent: int, width: int, turns: int, most_frequent: int, hash_bits: int) -> DataFrame:
    spark = docs.sparkSession
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = T.keyed(docs)
    summary = written(texts.mapInArrow(T.lean(_summaries(width, hash_bits)), "doc_id long, k long, size int, grp long, name long"), "shingle_groups")
    clashing = [r.grp for r in summary.groupBy("grp").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b").select("grp").limit((1 << 16) + 1).collect()]
    if len(clashing) > 1 << 16:
        raise ValueError("too many sets share a hash: hash_bits is too small")
    summary = summary.select("doc_id", "k", "size", (F.when(F.col("grp").isin(clashing), F.col("name")).otherwise(F.col("grp")) if clashing else F.col("grp")).alias("grp"))
    found = texts.select("text").mapInArrow(T.lean(_whole_sets(width, hash_bits, np.array(clashing, np.int64).view(np.uint64))), "grp long, items binary")
    sets = written_bucketed(found.repartition(parts, "grp").dropDuplicates(["grp"]), "shingle_sets", "grp", parts)

    order = spark.sparkContext.broadcast(_order(sets, most_frequent))
    alike = written(sets.mapInArrow(T.lean(_alike(percent, order)), "grp long, alike long"), "alike")
    heads = alike.groupBy("alike").agg(F.min("grp").alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1")
    proposed = alike.join(heads, "alike").where("grp <> y").select("y", F.col("grp").alias("x"))
    kin = written(_links(proposed, sets, percent).select(F.col("y").alias("head"), F.col("x").alias("grp"), "apart"), "kin")
    remove(alike)
    radius = kin.groupBy(F.col("head").alias("grp")).agg(F.max("apart").alias("radius"))

    entries = sets.join(kin.select("grp"), "grp", "left_anti").mapInArrow(T.lean(_entries(percent, order)), "token long, grp long, size int, pos int")
    shared = written(entries.repartition(parts, "token").sortWithinPartitions("token", "grp", "pos").mapInArrow(T.lean(_shared_tokens), "token long, grp long, size int, pos int"), "prefixes")

    comp = tested = None
    done = [sets, shared]

    def entries_now() -> DataFrame:
        if comp is None:
            return shared.withColumn("comp", F.col("grp"))
        return shared.join(comp.withColumnRenamed("node", "grp"), "grp", "left").select("token", "grp", "size", "pos", F.coalesce("component", "grp").alias("comp"))

    def joined(links: DataFrame) -> DataFrame:
        if comp is not None:
            links = links.unionByName(comp.where("node <> component").select(F.col("node").alias("x"), F.col("component").alias("y")))
            done.append(comp)
        return connected_components(links, "y", "x")

    def verified(best: DataFrame) -> DataFrame:
        """Links of pairs that were not tested before."""
        nonlocal tested
        best = written(best if tested is None else best.join(tested, ["y", "x"], "left_anti"), "tested")
        done.append(best)
        tested = best if tested is None else tested.unionByName(best)
        return _links(best, sets, percent).select("y", "x")

    for turn in range(turns):
        near = entries_now().repartition(parts, "token").sortWithinPartitions("token", F.xxhash64("grp", F.lit(turn)))
        near = near.mapInArrow(T.lean(_hubs(percent)), "hub long, x long, n long").groupBy("hub", "x").agg(F.sum("n").alias("n"))
        best = near.groupBy("x").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")).select(F.least("hub", "x").alias("y"), F.greatest("hub", "x").alias("x")).distinct()
        comp = joined(verified(best))
    # Near copies that met no hub of theirs grow together by their nearest candidates before all candidates are rows.
    for _ in range(min(turns, _NEAREST)):
        links = written(verified(_candidates(entries_now(), sets, radius, percent, True)), "nearest")
        done.append(links)
        if not links.count():
            break
        comp = joined(links)

    rest = _candidates(entries_now(), sets, radius, percent)
    for side in ("y", "x"):
        rest = rest.join(radius.select(F.col("grp").alias(side), F.col("radius").alias(f"r{side}")), side, "left")
    rest = written(rest, "group_pairs")
    alone = rest.where("ry is null and rx is null").select("y", "x")
    alone = alone if tested is None else alone.join(tested, ["y", "x"], "left_anti")
    wide, read = _expanded(rest.where("ry is not null or rx is not null"), kin, sets, percent)
    done += [rest, *read]
    comp = joined(_links(alone, sets, percent).select("y", "x").unionByName(wide))
    comp = comp.unionByName(kin.join(comp, kin["head"] == comp["node"], "left").select(kin["grp"].alias("node"), F.coalesce("component", "head").alias("component")))
    order.destroy()
    for table in done:
        remove(table)
    return summary.join(comp.withColumnRenamed("node", "grp"), "grp", "left").select("doc_id", "k", F.col("size").cast("long").alias("n_shingles"), "grp", F.when(F.col("size") > 0, F.coalesce("component", "grp")).alias("comp"))


def components(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    rows = classes(docs, percent, width)
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """The documents without all but one of each component: the row of the smallest (doc_id, text key) stays,
    one without an id only where no other is there.

    Rows without a word are in no component: all stay. Of equal rows with words one stays, whatever their other
    columns. Columns of any name may be there.
    """
    rows = classes(docs, percent, width)
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("of")).select("of.doc_id", "of.k").distinct()
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.where(worded).select(F.struct(*docs.columns).alias("row"), doc_id.alias("doc_id"), F.xxhash64(doc_id, F.col("text").cast("string")).alias("k"))
    # Equal rows have equal keys and ids; the join has dealt the rows by both, so that this takes no further shuffle.
    kept = keyed.join(first, T.same_row(keyed, first), "left_semi").dropDuplicates(["k", "doc_id"])
    return kept.select("row.*").unionByName(docs.where(~worded))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, least(len(words), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT b.a, b.b FROM b JOIN n x ON x.doc_id = b.a JOIN n y ON y.doc_id = b.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
m AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
