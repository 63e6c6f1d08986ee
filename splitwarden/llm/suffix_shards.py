"""Substring deduplication by suffix arrays of shards.

Every byte that lies in a string of ``width`` bytes that starts earlier too (in a smaller doc_id, or before in
the same document) is removed.

1. Anchors (see ``_text.anchored``) of all windows of all texts are counted. Equal windows have equal anchors,
   so stretches whose anchor stands once hold no repeated string; the others go on. This only spares work. Anchors
   that stand often are looked for beforehand, so that their places are spread over tasks.
2. Documents with such stretches are dealt to shards by their least repeated anchor, which brings copies
   together; large groups are split. Each shard sorts the suffixes of its stretches by Larsson-Sadakane
   refinement (doubling ranks, only unsorted groups are sorted again), finds the common prefixes of neighbours
   as Kasai does in text order, and removes all but the earliest place of each class of equal windows.
3. Cross-shard merging: stretches that hold an earliest place while their anchor stands outside the shard too
   are dealt by anchor, with their windows in the order that the suffixes have in the shard. Each shard's windows are a
   sorted run, and runs are merged by binary search: what an earlier place has already is removed. Windows of an anchor
   with more than ``Limits.hot`` places, counted exactly over all of them, are compared by two 64-bit hashes in a
   shuffle instead, which no task holds whole. All places of an anchor go one way.

Null texts count as empty. Texts below ``width`` bytes stay whole. Rows that repeat a doc_id are ordered by a
hash of their text; equal rows are one place, so that they do not remove each other. A null doc_id comes last.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import remove, written
from . import _text as T

_SMALL = 1 << 18
#: Comparisons of suffixes that are finished one by one.
_FEW = 256


@dataclass(frozen=True)
class Limits:
    """Sizes that decide how the work is dealt, never the result."""

    #: Bytes of text whose suffixes one shard sorts.
    shard: int = 1 << 20
    #: Anchors that are counted together beforehand; those that stand told times there are heard of.
    counted: int = 1 << 20
    told: int = 2
    #: Anchors that are known as frequent: so many at most, of so many places at least, as far as they were heard of.
    most_frequent: int = 1 << 18
    frequent: int = 2000
    #: Places of an anchor whose windows are merged by suffix order.
    hot: int = 20_000


def _anchors(width: int, gram: int, known):
    """Places of anchors; total: how often a known frequent anchor was heard of, 0 for others."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, often = known.value
        for batch in batches:
            keys, _ = T.ints(batch, "k")
            ids, null = T.ints(batch, "doc_id")
            for rows, data, offs in T.chunks(batch, size=_SMALL):
                fp, row, start, n, inner = T.anchored(T.byte_values(data), offs, width, gram)
                total = np.zeros(len(fp), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, fp), len(hot) - 1)
                    total = np.where(hot[at] == fp, often[at], 0)
                own = row + rows.start
                yield pa.RecordBatch.from_arrays([T.long_array(fp), T.long_array(keys[own]), T.long_array(ids[own], null[own]), pa.array(start, pa.int32()), pa.array(np.where(inner, -n, n), pa.int32()), T.long_array(total)], names=["fp", "k", "doc_id", "start", "n", "total"])

    return anchors


def _frequent(width: int, gram: int, limits: Limits):
    """Counts of anchors that stand in several stretches of a chunk."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(some: list[np.ndarray]) -> pa.RecordBatch:
            fp, n = np.unique(np.concatenate(some), return_counts=True)
            return pa.RecordBatch.from_arrays([T.long_array(fp[n >= limits.told]), T.long_array(n[n >= limits.told])], names=["fp", "n"])

        some, held = [], 0
        for batch in batches:
            for _, data, offs in T.chunks(batch, size=_SMALL):
                some.append(T.anchored(T.byte_values(data), offs, width, gram)[0])
                held += len(some[-1])
                if held >= limits.counted:
                    yield told(some)
                    some, held = [], 0
        if some:
            yield told(some)

    return counted


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number that sorts like them (zeros after the end)."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = wide[:-8].copy() if len(data) else wide[:0]
    for i in range(1, 8):
        out <<= np.uint64(8)
        out |= wide[i : i + len(data)]
    return out


def suffix_array(data: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, compared over at least depth bytes."""
    n = len(data)
    order = np.argsort(words)
    head = np.ones(n, bool)
    sorted_words = words[order]
    head[1:] = sorted_words[1:] != sorted_words[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 8
    while h < depth:
        single = head.copy()
        single[:-1] &= head[1:]
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        at = order[open_]
        after = np.zeros(len(at), np.int64)
        inside = at + h < n
        after[inside] = rank[at[inside] + h] + 1
        key = rank[at] << 32 | after
        # Groups are in order already, so that a merge sort has little to move.
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[open_] = at[by]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head[open_] = new
        rank[order[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, enough: int, least: int = 0) -> np.ndarray:
    """For each place in text order, the bytes that its suffix shares with the one before it in the order.

    Where both move on by one byte together the value falls by one, so only the other places are compared,
    eight bytes at a time, and no further than until all of their run have enough. Values below least may be
    given as less.
    """
    n = len(words)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0)
    heads = np.flatnonzero(fresh)
    run = np.diff(np.append(heads, n))
    other = before[heads]
    most = np.where(other < 0, 0, n - np.maximum(heads, other))
    need = np.minimum(most, run + enough)
    shared = np.zeros(len(heads), np.int64)
    active = np.flatnonzero(need >= max(least, 1))
    if least >= 8:
        last = words[heads[active] + least - 8] == words[other[active] + least - 8]
        active = active[last]
        active = active[words[heads[active]] == words[other[active]]]
    while len(active):
        if len(active) <= _FEW:
            # The few that go on, mostly long runs, are passed over in one step each, to the word that differs or the end.
            for i in active.tolist():
                a, b, left = heads[i] + shared[i], other[i] + shared[i], need[i] - shared[i]
                apart = words[a : a + left : 8] != words[b : b + left : 8]
                shared[i] += 8 * (int(apart.argmax()) if apart.any() else len(apart))
            active = active[shared[active] < need[active]]
        a, b = heads[active] + shared[active], other[active] + shared[active]
        differ = words[a] ^ words[b]
        same = differ == 0
        part = active[~same]
        if len(part):
            # Leading zero bytes, from the exponent of the highest differing byte.
            high = (differ[~same] >> np.uint64(32)).astype(np.float64)
            low = (differ[~same] & np.uint64(0xFFFFFFFF)).astype(np.float64)
            bits = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
            shared[part] += (64 - bits) // 8
        active = active[same]
        shared[active] += 8
        active = active[shared[active] < need[active]]
    shared = np.minimum(shared, most)
    return np.maximum(np.repeat(shared, run) - (np.arange(n) - np.repeat(heads, run)), 0)


def _runs(doc: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that windows from these places cover; places ascend within a document."""
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > width)
    at = np.flatnonzero(new)
    return doc[at], start[at], start[np.append(at[1:], len(start)) - 1] + width


FOUND = "k long, doc_id long, lo int, hi int, fp long, hot boolean, bytes binary, at binary, shard long"


def _found(k, doc_id, null, lo, hi, handed: dict | None = None) -> pa.RecordBatch:
    """Removed runs of bytes, or (handed) stretches for the merge across shards."""
    n = len(k)
    cols = [T.long_array(k), T.long_array(doc_id, null), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())]
    more = {"fp": pa.int64(), "hot": pa.bool_(), "bytes": pa.binary(), "at": pa.binary(), "shard": pa.int64()}
    cols += [pa.nulls(n, t) if handed is None else pa.array(handed[c], t) for c, t in more.items()]
    return pa.RecordBatch.from_arrays(cols, names=["k", "doc_id", "lo", "hi", *more])


def _shard(docs: list[tuple], width: int, limits: Limits, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """docs: (k, doc_id, text bytes, fp, start, n, total) with the last four as arrays of the document's stretches.

    total: the anchor's places, if it was not known as frequent beforehand, else less than 0. hot: those of the known
    ones that have more than limits.hot places."""
    k = np.array([d[0] for d in docs], np.int64)
    null = np.array([d[1] is None for d in docs])
    doc_id = np.array([d[1] or 0 for d in docs], np.int64)
    place = np.empty(len(docs), np.int64)
    place[np.lexsort((k, doc_id, null))] = np.arange(len(docs))

    doc = np.repeat(np.arange(len(docs)), [len(d[3]) for d in docs])
    fp, start, n, total = (np.concatenate([d[i] for d in docs]).astype(np.int64) for i in (3, 4, 5, 6))
    by = np.lexsort((start, doc))
    doc, fp, start, n, total = doc[by], fp[by], start[by], n[by], total[by]
    # Stretches whose bytes touch make one region; regions stand one after the other in the shard's text.
    end = start + n + width - 1
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    r_doc, r_lo, r_hi = doc[at], start[at], np.maximum.reduceat(end, at)
    raw = [np.frombuffer(d[2], np.uint8) for d in docs]
    data = np.concatenate([raw[d][a:b] for d, a, b in zip(r_doc, r_lo, r_hi, strict=True)])
    r_at = np.append(0, np.cumsum(r_hi - r_lo))
    region = np.repeat(np.arange(len(r_doc)), r_hi - r_lo)
    here = np.arange(len(data)) - r_at[region]
    whole = here + width <= (r_hi - r_lo)[region]

    words = packed(data)
    order = suffix_array(data, words, width)
    equal = common_prefixes(words, order, width, width)[order] >= width
    kind = np.cumsum(~equal)
    kept = whole[order]
    order, kind = order[kept], kind[kept]
    where = place[r_doc[region[order]]] << 32 | (r_lo[region[order]] + here[order])
    head = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    least = np.repeat(np.minimum.reduceat(where, head), np.diff(np.append(head, len(kind))))
    later = np.zeros(len(data), bool)
    later[order[where > least]] = True
    marked = np.flatnonzero(later)
    if len(marked):
        d, lo, hi = _runs(r_doc[region[marked]], r_lo[region[marked]] + here[marked], width)
        yield _found(k[d], doc_id[d], null[d], lo, hi)

    kinds, inverse, count = np.unique(fp, return_inverse=True, return_counts=True)
    stretch_at = r_at[np.cumsum(new) - 1] + start - np.repeat(r_lo, np.diff(np.append(at, len(doc))))
    mine = ~later & whole
    firsts = np.append(0, np.cumsum(mine))
    # A known frequent anchor goes on in any case.
    out = np.flatnonzero(((total > count[inverse]) | (total < 0)) & (firsts[stretch_at + n] > firsts[stretch_at]))
    if len(out):
        d = doc[out]
        rank = np.zeros(len(data), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        # All stretches' own places at once, by stretch and then by rank.
        many = n[out]
        which = np.repeat(np.arange(len(out)), many)
        step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(stretch_at[out], many) + step
        own = np.flatnonzero(mine[at])
        own = own[np.lexsort((rank[at[own]], which[own]))]
        step, ends = step[own], np.cumsum(np.bincount(which[own], minlength=len(out)))
        short = step.astype("<u2")
        sorted_places = [(short[a:b] if m <= 0xFFFF else step[a:b].astype("<u4")).tobytes() for a, b, m in zip(np.append(0, ends[:-1]), ends, many, strict=True)]
        handed = {
            "fp": fp[out],
            "hot": np.where(total[out] < 0, np.isin(fp[out], hot), total[out] > limits.hot),
            "bytes": [data[a : a + m].tobytes() for a, m in zip(stretch_at[out], n[out] + width - 1, strict=True)],
            "at": sorted_places,
            "shard": np.full(len(out), k[0]),
        }
        yield _found(k[d], doc_id[d], null[d], start[out], start[out] + n[out], handed)


def _shards(width: int, limits: Limits, known):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, hot = [], 0, None, known.value
        for batch in batches:
            asked = batch.column(batch.schema.get_field_index("asked"))
            upto = asked.offsets.to_numpy()
            fp, start, n, total = (asked.values.field(x).to_numpy(zero_copy_only=False) for x in ("fp", "start", "n", "total"))
            keys, ids, texts = (batch.column(batch.schema.get_field_index(x)) for x in ("k", "doc_id", "text"))
            for i in range(batch.num_rows):
                key = (keys[i].as_py(), ids[i].as_py())
                if key == last:  # an equal row
                    continue
                last, a, b = key, upto[i], upto[i + 1]
                text = texts[i].as_buffer()
                held.append((*key, text.to_pybytes(), fp[a:b], start[a:b], n[a:b], total[a:b]))
                size += int(n[a:b].sum()) + width * 2
                if size >= limits.shard:
                    yield from _shard(held, width, limits, hot)
                    held, size = [], 0
        if held:
            yield from _shard(held, width, limits, hot)

    return shards


#: What a stretch hands on, as columns and as tuples.
HANDED = ("fp", "shard", "k", "doc_id", "lo", "hi", "bytes", "at")


def _places(at: bytes, lo: int, hi: int) -> np.ndarray:
    """The windows that a stretch hands on, in the order of their suffixes."""
    return np.frombuffer(at, "<u2" if hi - lo <= 0xFFFF else "<u4").astype(np.int64)


def merged_runs(rows: list[tuple], width: int) -> list[tuple]:
    """(null, doc_id, k, place) of windows that an earlier place of another shard has too, of one anchor's rows.

    A shard's windows differ, and those of each stretch come sorted: a stable sort only merges the stretches of a shard.
    The runs of shards are merged by binary search, two at a time.
    """
    docs = sorted({(r[3] is None, r[3] or 0, r[2]) for r in rows})
    number = {x: i for i, x in enumerate(docs)}
    runs: dict[int, list[tuple]] = {}
    for _, shard, k, doc_id, lo, hi, data, at in rows:
        places = _places(at, lo, hi)
        text = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), width)[places]
        runs.setdefault(shard, []).append((text, places + ((number[(doc_id is None, doc_id or 0, k)] << 32) + lo)))
    sorted_runs, out = [], []
    for run in runs.values():
        text, owner = run[0] if len(run) == 1 else (np.concatenate(x) for x in zip(*run, strict=True))
        windows = np.ascontiguousarray(text).view(f"S{width}").ravel()
        if len(run) > 1:
            by = np.argsort(windows, kind="stable")
            windows, owner = windows[by], owner[by]
        sorted_runs.append((len(windows), len(sorted_runs), windows, owner))
    # The two shortest first, so that no window is moved more often than the logarithm of the number of runs.
    heapq.heapify(sorted_runs)
    while len(sorted_runs) > 1:
        (_, _, windows, owner), (_, turn, index, owners) = heapq.heappop(sorted_runs), heapq.heappop(sorted_runs)
        place = np.searchsorted(index, windows)
        known = index[np.minimum(place, len(index) - 1)] == windows
        old = owners[place[known]]
        out += [docs[p >> 32] + (p & 0xFFFFFFFF,) for p in np.maximum(old, owner[known]).tolist()]
        owners[place[known]] = np.minimum(old, owner[known])
        if not known.all():
            index, owners = np.insert(index, place[~known], windows[~known]), np.insert(owners, place[~known], owner[~known])
        heapq.heappush(sorted_runs, (len(index), turn, index, owners))
    return out


def _merged(width: int):
    """Removed runs of bytes from rows that come sorted by anchor."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows = sorted(set(merged_runs(group, width))) if len({r[1] for r in group}) > 1 else []
            if rows:
                null, ids, keys, start = (np.array(x) for x in zip(*rows, strict=True))
                text = np.cumsum(np.append(0, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])))
                doc, lo, hi = _runs(text, start.astype(np.int64), width)
                own = np.searchsorted(text, doc)
                yield pa.RecordBatch.from_arrays([T.long_array(keys[own]), T.long_array(ids[own], null[own]), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["k", "doc_id", "lo", "hi"])

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(HANDED))), strict=True):
                if group and row[0] != group[0][0]:
                    yield from flush(group)
                    group = []
                group.append(row)
        if group:
            yield from flush(group)

    return merged


def _hashed(width: int):
    """h1, h2, null, doc_id, k, place of each window that a stretch hands on."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = _places(row["at"], row["lo"], row["hi"])
                values = T.byte_values(np.frombuffer(row["bytes"], np.uint8))
                n = len(at)
                yield pa.RecordBatch.from_arrays([T.long_array(T.rolled(values, width)[at]), T.long_array(T.rolled(T.mix(values), width)[at]), pa.array(np.full(n, row["doc_id"] is None)), pa.array([row["doc_id"]] * n, pa.int64()), pa.array(np.full(n, row["k"])), pa.array((row["lo"] + at).astype(np.int32))], names=["h1", "h2", "no_id", "doc_id", "k", "place"])

    return hashes


def _hot_copies(rows: DataFrame, width: int) -> DataFrame:
    """k, doc_id, lo, hi of windows of frequent anchors that stand earlier in another shard."""
    windows = rows.select("doc_id", "k", "lo", "hi", "bytes", "at").mapInArrow(_hashed(width), "h1 long, h2 long, no_id boolean, doc_id long, k long, place int")
    place = F.struct("no_id", "doc_id", "k", "place")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("k", "doc_id", F.col("place").alias("lo"), (F.col("place") + width).alias("hi"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).fill_null(b"")
        spans = batch.column(batch.schema.get_field_index("spans"))
        hit = spans.is_valid()
        at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
        runs, rest = np.zeros(len(texts), np.int64), []
        for i, span in zip(at.tolist(), spans.take(pa.array(at, pa.int64())).to_pylist(), strict=True):
            data, kept, upto = texts[i].as_buffer().to_pybytes(), [], 0
            for lo, hi in sorted((x["lo"], x["hi"]) for x in span):
                if lo > upto or not runs[i]:
                    kept.append(data[upto:lo])
                    runs[i] += 1
                upto = max(upto, hi)
            rest.append(b"".join([*kept, data[upto:]]))
        # Texts without spans go through as they are.
        kept = pc.replace_with_mask(texts, hit, pa.array(rest, pa.large_binary())) if rest else texts
        size = pc.binary_length(texts)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), size, pc.subtract(size, pc.binary_length(kept)), T.long_array(runs), kept.cast(pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _counted_anchors(texts: DataFrame, width: int, gram: int, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that were heard of often, sorted, and how often."""
    heard = texts.select("text").mapInArrow(_frequent(width, gram, limits), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= limits.frequent)
    heard = heard.orderBy(F.desc("n"), "fp").limit(limits.most_frequent).toArrow()
    fp = heard["fp"].to_numpy().view(np.uint64)
    by = np.argsort(fp)
    return fp[by], heard["n"].to_numpy()[by]


def stretches(texts: DataFrame, width: int, gram: int, group: int, limits: Limits) -> tuple[DataFrame, np.ndarray]:
    """The stretches of repeated anchors by document, written, with the group that deals it; and the hot ones of the
    anchors that were known beforehand. texts: as keyed() gives them."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = spark.sparkContext.broadcast(_counted_anchors(texts, width, gram, limits))
    places = texts.mapInArrow(_anchors(width, gram, known), "fp long, k long, doc_id long, start int, n int, total long")
    # One shuffle of all places. Those of a known anchor are spread; the others are counted, all of them in one place:
    # an anchor that was not heard of has told - 1 places in each chunk at most, and the window spills.
    spread = F.col("total") > 0
    places = places.withColumn("part", F.when(spread, F.pmod(F.xxhash64("k"), F.ceil(F.col("total") / limits.frequent))).otherwise(0)).repartition(parts, "fp", "part")
    same = Window.partitionBy("fp", "part")
    often = places.withColumn("total", F.when(spread, -F.col("total")).otherwise(F.count(F.lit(1)).over(same))).withColumn("m", F.min("n").over(same)).where("total <> 1 or m < 0")
    hits = often.groupBy("k", "doc_id").agg(F.collect_list(F.struct("fp", "start", F.abs("n").alias("n"), "total")).alias("asked"), F.min(F.struct("fp", "total")).alias("g"))
    # One anchor in many documents is dealt to several shards; the merge below joins them again.
    # Written first, so that the shuffle of all places is gone before texts are shuffled.
    hits = hits.select("k", "doc_id", "asked", F.col("g.fp").alias("g"), F.pmod(F.xxhash64("k"), F.ceil(F.abs("g.total") / group)).alias("salt"))
    hits = written(hits, "repeated_stretches")
    # One decision for all places of a known anchor, from their exact number; there are most_frequent anchors at most.
    exact = hits.select(F.inline("asked")).where("total < 0").groupBy("fp").count().where(F.col("count") > limits.hot).select("fp").toArrow()
    known.destroy()
    return hits, exact["fp"].to_numpy()


def remove_later_copies(docs: DataFrame, width: int = 100, gram: int = 20, group: int = 1000, limits: Limits | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): each text without what starts earlier elsewhere.

    group: about so many documents that share an anchor are dealt together; larger groups are split.
    """
    spark, limits = docs.sparkSession, limits or Limits()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = T.keyed(docs)
    hits, hot = stretches(texts, width, gram, group, limits)
    hot = spark.sparkContext.broadcast(hot)
    dealt = texts.join(hits, T.same_row(texts, hits)).select(texts["k"], texts["doc_id"], "text", "asked", "g", "salt")
    found = written(dealt.repartition(parts, "g", "salt").sortWithinPartitions("g", "salt", "k", "doc_id").mapInArrow(_shards(width, limits, hot), FOUND), "suffix_shards")
    handed = found.where("fp is not null")
    across = handed.where("not hot").select(*HANDED).repartition(parts, "fp").sortWithinPartitions("fp").mapInArrow(_merged(width), "k long, doc_id long, lo int, hi int")
    runs = found.where("fp is null").select("k", "doc_id", "lo", "hi").unionByName(across).unionByName(_hot_copies(handed.where("hot"), width))
    spans = written(runs.groupBy("k", "doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suffix_spans")
    hot.destroy()
    remove(hits)
    remove(found)
    return texts.join(spans, T.same_row(texts, spans), "left").select(texts["doc_id"], "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
