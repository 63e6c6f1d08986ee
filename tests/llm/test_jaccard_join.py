import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from splitwarden.llm import jaccard_join
from splitwarden.llm.jaccard_join import components, keep_one

SCHEMA = "doc_id long, text string, k string, size int, comp string"


def shingles(text, width=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=75, width=5):
    sets = [shingles(r[1], width) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for j, x in enumerate(rows) if root(j) == root(i) and x[0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def fixture(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["É", "ÉA", "Ab", "aB"]
    common = rnd.choices(words, k=40)
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 90)))) for i in range(n)]
    for i in range(n, 2 * n):  # edits of earlier texts, chains among them
        w = (rnd.choice(rows)[1] or "x").split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join(common + rnd.choices(words, k=rnd.randint(5, 20)))) for i in range(15)]
    rows += [(600 + i, " ".join(w if rnd.random() > 0.02 else "new" for w in common * 2)) for i in range(25)]
    rows += [(700, None), (701, ""), (702, " \t"), (703, "A b"), (704, "a B"), (705, "a b c d e"), (706, "A B C D E"), (707, "x y " * 500), (708, "x y " * 700), (None, "a b"), (None, "only null here now yes"), (3, rows[3][1]), (3, rows[3][1]), (4, "another text under one id now")]
    return [(*r, "k", 1, "c") for r in rows]


def test_against_brute_force(spark):
    rows = fixture(1)
    got = sorted((tuple(r) for r in components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    assert got == brute(rows)


def test_links_at_the_threshold(spark):
    """Pairs that share exactly three quarters, found in the last cell of a task."""
    rows = fixture(6, 40)
    got = sorted((tuple(r) for r in components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    assert got == brute(rows)


def test_other_thresholds(spark):
    rows = fixture(3, 30)
    got = sorted((tuple(r) for r in components(spark.createDataFrame(rows, SCHEMA), 60, 3).collect()), key=str)
    assert got == brute(rows, 60, 3)


def test_keep_one(spark):
    rows = [r for r in fixture(4, 30) if r[0] is not None]
    kept = keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "k", "size", "comp"}
    want = {c for _, n, c in brute(rows) if n} | {700, 701, 702}
    assert {r.doc_id for r in kept} == want and len(kept) <= len(want) + 2  # two ids are repeated


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert components(empty).count() == 0 and keep_one(empty).count() == 0


def test_rows_without_words_all_stay(spark):
    rows = [(x, t, "k", 1, "c") for x, t in [(1, None), (1, None), (None, None), (None, None), (2, ""), (2, ""), (3, " \n\t"), (4, "one text"), (4, "one text"), (5, "one text")]]
    kept = [r.doc_id for r in keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(kept, key=str) == [1, 1, 2, 2, 3, 4, None, None]


def test_no_turns_and_small_cells(spark, monkeypatch):
    """The exhaustive comparison alone finds every link, also where a shingle's entries are dealt out as a grid."""
    monkeypatch.setattr(jaccard_join, "_CELL", 4)
    rows = fixture(5, 50)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for turns in (0, 1):
        rows_of = jaccard_join.classes(frame, turns=turns, most_frequent=10)
        least = rows_of.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("c"))
        got = sorted((tuple(r) for r in rows_of.join(least, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("c"))).collect()), key=str)
        assert got == brute(rows)


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 70001}" for i in range(120_000))
    other = " ".join(f"v{i}" for i in range(80_000))
    rows = [(1, long, "k", 1, "c"), (2, long + " and more", "k", 1, "c"), (3, other, "k", 1, "c"), (4, other.replace("v777 ", "changed "), "k", 1, "c"), (5, long + " " + other, "k", 1, "c")]
    got = {r.doc_id: r.component_id for r in components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def found(rows_of):
    least = rows_of.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("c"))
    ids = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("c"))
    return sorted((tuple(r) for r in rows_of.join(least, "comp", "left").select("doc_id", "n_shingles", ids).collect()), key=str)


def variants(seed, n=14, each=24):
    """Texts of 60 words, a third of them with one of two words changed within, and up to four changed at their end: in
    hash order, many sets of one size share their prefixes, and a text with changes at its end only is linked with more
    texts of another group than its neighbours are. Short texts that share six words share prefixes without links."""
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        base = [f"c{c}x{i}" for i in range(60)]
        for s in range(each):
            w = list(base)
            if at := rnd.choice([0, 20, 35]):
                w[at] = f"c{c}y{at}"
            for i in range(rnd.randint(0, 4)):
                w[59 - i] = f"c{c}s{s}e{i}"
            rows.append((1000 * c + s, " ".join(w)))
    rows += [(50000 + i, f"one two three four five six t{i} u{i}") for i in range(60)]
    rnd.shuffle(rows)
    return [(*r, "k", 1, "c") for r in rows]


def test_groups_by_prefix_and_size(spark, monkeypatch):
    """Groups are formed, members that their head has no link with stand alone, and pairs of groups are expanded to find
    links that their heads have not."""
    seen = {"pairs": 0, "links": 0, "members": 0}
    expanded = jaccard_join._expanded

    def told(pairs, kin, sets, percent):
        links, read = expanded(pairs, kin, sets, percent)
        heads = jaccard_join._links(pairs.select("y", "x"), sets, percent).where("linked").select("y", "x")
        seen["pairs"] += pairs.count()
        seen["links"] += links.join(heads, ["y", "x"], "left_anti").count()
        seen["members"] += kin.count()
        return links, read

    monkeypatch.setattr(jaccard_join, "_expanded", told)
    rows = variants(1)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for turns in (0, 3):
        assert found(jaccard_join.classes(frame, turns=turns, most_frequent=0)) == brute(rows), turns
    assert seen["members"] > 40 and seen["pairs"] > 40 and seen["links"] > 0, seen


def test_sets_that_share_a_hash(spark):
    rows = fixture(6, 40)
    assert found(jaccard_join.classes(spark.createDataFrame(rows, SCHEMA).repartition(3), hash_bits=5)) == brute(rows)


def test_near_copies_leave_few_pairs(spark, monkeypatch):
    """Copies with one changed word are linked where the changes are near each other, so that hubs miss many; what is
    left for the exhaustive comparison does not grow with the square of their number."""
    rnd, seen, candidates = random.Random(9), [], jaccard_join._candidates

    def told(*args):
        pairs = candidates(*args)
        if not any(a is True for a in args):
            seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard_join, "_candidates", told)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(240):
        at = rnd.randrange(4, 56)
        rows.append((i, " ".join([*base[:at], f"n{i}", *base[at + 1 :]]), "k", 1, "c"))
    assert found(jaccard_join.classes(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)
    assert len(seen) == 1 and seen[0] < 240, seen


def sets_of(rows):
    """A batch as the table of sets has them, six bytes a shingle."""
    items = [np.ascontiguousarray(np.sort(r).astype("<u8")[:, None].view(np.uint8)[:, :6]).tobytes() for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(items, pa.binary())], names=["items"])


def most_memory(work, *args):
    tracemalloc.start()
    try:
        out = [pa.Table.from_batches([b]).to_pydict() for b in work(*args)]
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_shingles_are_counted_within_memory():
    """Eight bytes a shingle of a chunk and not several times as much; sets longer than a chunk are counted whole."""
    rnd = np.random.default_rng(3)
    draw = lambda n: rnd.integers(0, 1 << 47, n, dtype=np.uint64)
    common = draw(500)
    rows = [np.append(draw(60_000), common[: i * 5]) for i in range(80)]
    batches = [sets_of(rows[i : i + 8]) for i in range(0, 80, 8)]
    (whole, *rest), mb = most_memory(jaccard_join._repeats, iter(batches))
    ends = np.cumsum([x for b in batches for x in (rows_.stop - rows_.start for rows_, _, _ in jaccard_join._decoded(b))])
    upto = next(int(i) for i in ends if sum(map(len, rows[:i])) >= jaccard_join._COUNTED)
    assert mb < 90, mb
    for got, part in ((whole, rows[:upto]), (rest[0], rows[upto:])):
        token, n = np.unique(np.concatenate(part), return_counts=True)
        assert dict(zip(got["token"], got["n"], strict=True)) == dict(zip(token[n > 1].tolist(), n[n > 1].tolist(), strict=True))
    assert len(rest) == 1
    long = np.arange(jaccard_join._COUNTED + jaccard_join._AT_ONCE + 5, dtype=np.uint64)
    got = [b.to_pydict() for b in jaccard_join._repeats(iter([sets_of([long[:3], long, long[1:2]])]))]
    assert [sorted(zip(b["token"], b["n"], strict=True)) for b in got] in ([[(0, 2), (1, 2), (2, 2)], []], [[(0, 2), (1, 3), (2, 2)]])


def test_bitmaps_are_compared_within_memory():
    """A cell of near copies, all pairs of which pass the bounds by size and place."""
    n = 700
    one = pa.array(np.ones(n, np.int64))
    ids, yes = pa.array(np.arange(n)), pa.array(np.ones(n, bool))
    bits = pa.array([bytes(jaccard_join._BITS // 8)] * n, pa.binary())
    size, pos = pa.array(np.full(n, 50, np.int32)), pa.array(np.zeros(n, np.int32))
    names = ["token", "i", "j", "grp", "size", "pos", "comp", "other", "asks", "answers", "bits", "radius"]
    cell = pa.RecordBatch.from_arrays([one, one, one, ids, size, pos, ids, yes, yes, yes, bits, pa.array(np.zeros(n, np.int32))], names=names)
    got, mb = most_memory(jaccard_join._compared(75), iter([cell]))
    assert sum(len(b["y"]) for b in got) == n * (n - 1) // 2 and mb < 35, mb


def test_batches_are_small(spark, monkeypatch):
    """Sets and texts reach Python in batches of a few MB; the session's own setting is as before afterwards."""
    key, seen, order = "spark.sql.execution.arrow.maxBytesPerBatch", [], jaccard_join._order

    def told(sets, most):
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
        seen.extend(r.n for r in sets.mapInArrow(sizes, "n long").collect())
        return order(sets, most)

    monkeypatch.setattr(jaccard_join, "_order", told)
    before = spark.conf.get(key)
    docs = spark.range(240).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.xxhash64("id", i).cast("string")), " ").alias("text"))
    rows = components(docs.repartition(2)).collect()
    assert len({r.component_id for r in rows}) == 240 and {r.n_shingles for r in rows} == {29_996}
    assert sum(seen) > 240 * 29_996 * 6 and max(seen) < 9 << 20, max(seen)
    assert spark.conf.get(key) == before
