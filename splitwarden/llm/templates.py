"""Benchmark decontamination by template windows.

Texts become tokens: runs of letters (A-Z folded) and runs of digits; other characters only separate. In the
template form numbers (with inner points and commas), units after numbers and names (capitalised words within
a sentence; several in a row are one) are typed placeholders. In a second template form capitalised words that
open a sentence, unless they are ``OPENERS``, and words in capitals are names too, and ``NUMBERS`` in words are
numbers. Windows of ``width`` tokens of
benchmark items and documents, in the plain and in the template forms, are hash-joined. A template match then needs consistent
slots: in a window equal values of the item stand for equal values of the document; different ones may coincide.
Where they do not, the slots at odds also rule out the other windows of that alignment that hold one of them, and
no more. In a run of windows with twice ``width`` plain tokens slots may be at odds. So re-parameterised questions
are found, and texts that share only their layout are not.
Template windows count only with a slot and at least ``least_words`` tokens that are none, one by default: slots
alone are no template, and how many more words there are is left to the slot check. Where all values of a window differ
the slot check has nothing to go by: the query and the pipeline ask for ``PLAIN`` words, so that two lists of numbers
that share one word beside them are not taken for one another.

Items shorter than a window are one window of their own length; items below ``shortest`` tokens (6 by default) never match.
Null and empty texts have no windows. Rows that repeat a doc_id or item_id are texts of their own; the result
names the id once. A null id is an id.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: Units that follow numbers.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz t ton tons ml l litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents pound pounds percent degrees celsius fahrenheit k hz khz mhz ghz w kw mw v a kb mb gb tb"
#: Capitalised words that open sentences and are no names.
OPENERS = "a about after all an and another are as at because before both but by can could did do does during each every find for from give given has have her here his how however if in into is it its many most my name no not now of on once one only or our over same she he since so some such than that the their then there these they this those though through to two three four five six seven eight nine ten under until up was we were what when where whether which while who whom whose why with without would you your le la les un une des du ce cette il elle ils elles nous vous si et ou mais dans sur pour quand que qui combien quel quelle der die das ein eine den dem und oder aber wenn wie was wer wo warum wann in im mit von zu auf es er sie wir el los las una unos unas y o pero cuando donde como quien cuanto cuantos por para con en su"
#: Numbers in words.
NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice thrice"
#: Tokens that are no slots, in template windows of the query and the pipeline.
PLAIN = 2
#: Window hashes that may be broadcast to skip documents' windows early: 16 MB.
MANY = 2_000_000

_KIND = np.full(256, 0, np.uint8)
_KIND[65:91] = _KIND[97:123] = _KIND[128:256] = 1
_KIND[48:58] = 2
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in '.!?:;\n"']] = True
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x51ED270B9F3C1D27, 0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99))
WINDOW = "h long, form int, pos int, places array<int>, slots array<long>"


@cache
def _listed(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    starts, ends, _ = T.word_spans(data, np.array([0, len(data)]))
    return np.sort(T.word_hashes(data, starts, ends, fold=True))


def _within(h: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h


@cache
def _capitals() -> np.ndarray:
    """Of each code point, whether it is a capital; the last stands for all beyond."""
    return np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x1F000)] + [False])


def _beyond_ascii(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of two letters at least whose first is a capital outside ASCII."""
    out = np.zeros(len(starts), bool)
    at = np.flatnonzero(data[starts] >= 0xC3)
    a, b, c, d = (data[np.minimum(starts[at] + i, len(data) - 1)].astype(np.int64) for i in range(4))
    two, three = a < 0xE0, a < 0xF0
    code = np.where(two, (a & 31) << 6 | b & 63, np.where(three, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63))
    table = _capitals()
    out[at] = table[np.minimum(code, len(table) - 1)] & (ends[at] - starts[at] > np.where(two, 2, np.where(three, 3, 4)))
    return out


def tokens(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Of the plain and the two template forms: hashes, values, slot flags, and first tokens of the rows."""
    kind = _KIND[data]
    before, after = np.zeros(len(kind), np.uint8), np.zeros(len(kind), np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    cut = offs[1:-1]
    before[cut[cut < len(kind)]] = 0
    after[cut[cut > 0] - 1] = 0
    starts = np.flatnonzero((kind != before) & (kind != 0))
    ends = np.flatnonzero((kind != after) & (kind != 0)) + 1
    h = T.word_hashes(data, starts, ends, fold=True)
    first = np.searchsorted(starts, offs)
    n = len(h)
    if not n:
        return [(h, h, np.zeros(0, bool), first)] * 3
    opening = np.zeros(n, bool)
    opening[first[:-1][np.diff(first) > 0]] = True
    number = kind[starts] == 2
    joined = np.zeros(n, bool)
    joined[1:] = number[1:] & number[:-1] & (starts[1:] == ends[:-1] + 1) & ~opening[1:]
    at = np.flatnonzero(joined)
    joined[at] = np.isin(data[starts[at] - 1], (44, 46))
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & ~number[1:] & ~opening[1:]
    at = np.flatnonzero(unit)
    unit[at] = _within(h[at], _listed(UNITS))
    stops = np.append(0, np.cumsum(_STOP[data]))
    sentence = opening.copy()
    sentence[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    upper = (data[starts] >= 65) & (data[starts] <= 90) & (ends - starts > 1)
    beyond = _beyond_ascii(data, starts, ends)
    inner = (upper & ~((second >= 65) & (second <= 90)) | beyond) & ~sentence
    at = np.flatnonzero(upper | beyond)
    named = np.zeros(n, bool)
    named[at] = ~_within(h[at], _listed(OPENERS))
    out = [(h, h, np.zeros(n, bool), first)]
    worded = number | _within(h, _listed(NUMBERS))
    for name, number in ((inner, number), (inner | named, worded)):
        name = name & ~number & ~unit
        again = joined.copy()
        again[1:] |= name[1:] & name[:-1] & ~sentence[1:]
        form = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, h)))
        keep = ~again
        # A slot's value covers all tokens that it stands for.
        group = np.cumsum(keep) - 1
        value = np.zeros(int(group[-1]) + 1, np.uint64)
        np.add.at(value, group, T.mix(h + np.arange(n).astype(np.uint64) - np.flatnonzero(keep)[group].astype(np.uint64)))
        out.append((form[keep], value, (number | unit | name)[keep], np.append(0, np.cumsum(keep))[first]))
    return out


def windows(data: np.ndarray, offs: np.ndarray, width: int, least_words: int, lengths: tuple[int, ...], whole: bool, shortest: int = 6, parsed=None):
    """(form, width, row, hash, place in the row, place) of all forms. whole: rows shorter than width are one window of their length."""
    for form, (values, _, slot, upto) in enumerate(tokens(data, offs) if parsed is None else parsed):
        count = np.diff(upto)
        for w in sorted({width, *lengths}):
            n = len(values) - w + 1
            if n <= 0 or w < shortest:
                continue
            row = np.repeat(np.arange(len(count)), count)[:n]
            ok = np.arange(n) + w <= upto[row + 1]
            if whole and w < width:
                ok &= (count == w)[row]
            if form:
                slots = np.append(0, np.cumsum(slot))
                many = slots[w:] - slots[:-w]
                ok &= (many > 0) & (w - many >= min(least_words, w))
            at = np.flatnonzero(ok)
            yield form, w, row[at], T.mix(T.rolled(values, w)[at] + np.uint64(3 * w + form)), at - upto[row[at]], at


def _emitted(width: int, least_words: int, lengths: tuple[int, ...], whole: bool, keys: tuple[str, ...], known=None, shortest: int = 6):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if known is None else known.value
        for batch in batches:
            named = [T.ints(batch, key) for key in keys]
            for rows, data, offs in T.chunks(batch):
                parsed = tokens(data, offs)
                for form, w, row, h, pos, at in windows(data, offs, width, least_words, lengths, whole, shortest, parsed):
                    if wanted is not None:
                        if not len(wanted):
                            continue
                        hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                        row, h, pos, at = row[hit], h[hit], pos[hit], at[hit]
                    _, values, slot, _ = parsed[form]
                    # Matched windows have their slots at the same places; the items' side tells them.
                    places = [np.flatnonzero(slot[a : a + w]).astype(np.int32) for a in at] if whole else [None] * len(at)
                    slots = [values[a : a + w][slot[a : a + w]].view(np.int64) for a in at]
                    own = [T.long_array(x[row + rows.start], null[row + rows.start]) for x, null in named]
                    yield pa.RecordBatch.from_arrays([*own, T.long_array(h), pa.array(np.full(len(at), form), pa.int32()), pa.array(pos, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(slots, pa.list_(pa.int64()))], names=[*keys, "h", "form", "pos", "places", "slots"])

    return emit


def consistent(found: list[tuple], width: int) -> int:
    """How many windows of one alignment count; found: (place in the item, slots' places in the window, the item's values, the document's)."""
    odd = set()
    for pos, places, ours, theirs in found:
        means = {}
        for a, b in zip(ours, theirs):
            means.setdefault(a, set()).add(b)
        odd |= {pos + p for p, a in zip(places, ours) if len(means[a]) > 1}
    if not odd:
        return len({x[0] for x in found})
    good = {pos for pos, places, *_ in found if not any(pos + p in odd for p in places)}
    # An alignment with slots at odds has windows of width tokens, or one that is shorter.
    at = sorted({x[0] for x in found})
    slots = sorted({x[0] + p for x in found for p in x[1]})
    begin = 0
    for i in range(1, len(at) + 1):
        if i == len(at) or at[i] != at[i - 1] + 1:
            lo, hi = at[begin], at[i - 1] + width
            if i - begin > 1 and hi - lo - (bisect_left(slots, hi) - bisect_left(slots, lo)) >= 2 * width:
                good.update(at[begin:i])
            begin = i
    return len(good)


def _judged(width: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [consistent([tuple(x.values()) for x in found], width) for found in batch.column("windows").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k", "item_id")), pa.array(n, pa.int64())], names=["doc_id", "k", "item_id", "n_windows"])

    return judge


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, least_words: int = 1, shortest: int = 6) -> DataFrame:
    """doc_id, k, item_id, n_windows: texts and the items of which one alignment holds so many different windows."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in T.chunks(batch):
                n = np.unique(np.concatenate([np.diff(upto) for *_, upto in tokens(data, offs)]))
                yield pa.RecordBatch.from_arrays([pa.array(n[n < width], pa.int64())], names=["n"])

    # Lengths of short items: fewer than width different ones.
    lengths = tuple(r.n for r in items.mapInArrow(counted, "n long").distinct().collect())
    schema = f"item_id long, {WINDOW}"
    asked = items.mapInArrow(_emitted(width, least_words, lengths, True, ("item_id",), shortest=shortest), schema)
    some = asked.select("h").distinct().limit(MANY + 1).toPandas().h.to_numpy(np.int64)
    # A benchmark of bounded size spares the shuffle of all windows; a larger one is joined by the hash alone.
    known = spark.sparkContext.broadcast(np.sort(some.view(np.uint64))) if len(some) <= MANY else None
    texts = T.keyed(docs)
    found = texts.mapInArrow(_emitted(width, least_words, lengths, False, ("doc_id", "k"), known, shortest), f"doc_id long, k long, {WINDOW}")
    both = found.drop("places").withColumnsRenamed({"pos": "at", "slots": "values"}).join(asked, ["h", "form"])
    # Windows of one alignment of a text with an item are judged together. Windows of the plain form have no slots.
    aligned = both.where(F.size("slots") == F.size("values")).groupBy("doc_id", "k", "item_id", "form", (F.col("at") - F.col("pos")).alias("shift"))
    judged = aligned.agg(F.collect_set(F.struct("pos", "places", "slots", "values")).alias("windows")).mapInArrow(_judged(width), "doc_id long, k long, item_id long, n_windows long")
    return judged.where("n_windows > 0").groupBy("doc_id", "k", "item_id").agg(F.max("n_windows").alias("n_windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13, least_words: int = 1, least_windows: int = 1, shortest: int = 6) -> DataFrame:
    """doc_id, item_id, n_windows: one row for each document and item that it holds at least in part."""
    hits = matches(docs, benchmark, width, least_words, shortest).where(F.col("n_windows") >= least_windows)
    return hits.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13, least_words: int = 1, least_windows: int = 1, shortest: int = 6) -> DataFrame:
    """The documents that hold no item, with all their columns, whatever their names."""
    hits = matches(docs, benchmark, width, least_words, shortest).where(F.col("n_windows") >= least_windows).select("doc_id", "k").distinct()
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc_id.alias("doc_id"), F.xxhash64(doc_id, F.col("text").cast("string")).alias("k"))
    return keyed.join(hits, T.same_row(keyed, hits), "left_anti").select("row.*")
