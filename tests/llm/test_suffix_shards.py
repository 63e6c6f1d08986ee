import hashlib
import random

import numpy as np
from splitwarden.llm import suffix_shards as S

SCHEMA = "doc_id long, text string, k string, fp long, spans string"


def brute(rows, width):
    """rows must not repeat a doc_id."""
    first, out = {}, []
    docs = sorted(((r[0], (r[1] or "").encode()) for r in rows), key=lambda x: (x[0] is None, x[0] or 0))
    for doc_id, data in docs:
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - width + 1):
            if data[i : i + width] in first:
                gone[i : i + width] = True
            else:
                first[data[i : i + width]] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(data)))
        out.append((doc_id, len(data), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture(seed):
    rnd = random.Random(seed)
    words = [f"wörd{i}" for i in range(50)] + ["a", "\n", "\x00", "ß"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    shared = text(60)
    rows = [(i * 7 % 97, text(rnd.randint(0, 90))) for i in range(40)]
    rows += [(100 + i, text(rnd.randint(0, 9)) + shared + text(8)) for i in range(14)]
    rows += [(200, "ab" * 300), (201, "ab" * 90 + "x" + "ab" * 80), (202, None), (203, ""), (204, shared[:99]), (205, shared), (206, "zz" + shared + shared), (None, shared + "q"), (207, rows[5][1]), (208, "\x00" * 130)]
    return [(*r, "k", 1, "s") for r in rows]


def check(spark, rows, width, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, S.digest(S.remove_later_copies(df, width, **kw)).collect()), key=str)
    assert got == brute(rows, width)


def test_against_brute_force(spark):
    check(spark, fixture(0), 100)


def test_split_groups_are_merged(spark):
    check(spark, fixture(1), 40, gram=9, group=2, limits=S.Limits(shard=500))


def test_equal_rows_and_empty_table(spark):
    text = "nothing else has this text " * 3 + "0123456789" * 12
    rows = [(1, text, "", 0, ""), (1, text, "", 0, ""), (2, text, "", 0, "")]
    got = sorted(map(tuple, S.digest(S.remove_later_copies(spark.createDataFrame(rows, SCHEMA))).collect()))
    one, two = brute([rows[0], rows[2]], 100)
    # Equal rows are one place: each loses what the text itself repeats, and no more.
    assert got == [one, one, two] and 0 < one[2] < one[1] == two[2]
    assert S.remove_later_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(5)
    for data in (rng.integers(97, 99, 700).astype(np.uint8), np.frombuffer(b"abcabcab" * 60 + b"xyz" + b"abcabcab" * 30, np.uint8)):
        words = S.packed(data)
        order = S.suffix_array(data, words, 4 * len(data))
        raw = data.tobytes()
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        shared = S.common_prefixes(words, order, 10**6)
        for a, b in zip(order[:-1], order[1:], strict=True):
            n = 0
            while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert shared[b] == n


def handed(spark, rows, width, gram, group, limits, monkeypatch):
    """The flags of each anchor that goes to the merge across shards."""
    kept = []
    monkeypatch.setattr(S, "remove", lambda df: kept.append(df))
    check(spark, rows, width, gram=gram, group=group, limits=limits)
    monkeypatch.undo()
    found = next(df for df in kept if "hot" in df.columns).where("fp is not null").select("fp", "hot").distinct().collect()
    flags = {}
    for r in found:
        flags.setdefault(r["fp"], set()).add(r["hot"])
    return flags


def test_frequent_anchors_are_spread_and_merged_by_hashes(spark, monkeypatch):
    rows = fixture(2)
    shared = rows[45][1]
    rows += [(3000 + i, f"{i} {shared} {i * i}", "k", 1, "s") for i in range(60)]
    for hot, want in ((0, {True}), (10**9, {False})):
        flags = handed(spark, rows, 40, 9, 3, S.Limits(frequent=8, hot=hot, shard=500), monkeypatch)
        assert len(flags) > 20 and set.union(*flags.values()) == want


def test_anchors_around_the_limit_go_one_way(spark, monkeypatch):
    """Many places in one chunk and few in each other one: what was heard of beforehand is less than there is."""
    rnd = random.Random(8)
    text = lambda n: " ".join(f"{rnd.randrange(10**6)}" for _ in range(n))
    shared = text(20)
    for n in (40, 41):
        rows = [(i, f"{text(3)} {shared} {text(3)}" if i < n else text(30), "k", 1, "s") for i in range(n + 20)]
        rnd.shuffle(rows)
        for told in (1, 2, 8):
            flags = handed(spark, rows, 40, 9, 5, S.Limits(frequent=5, hot=20, counted=200, told=told, shard=500), monkeypatch)
            assert any(flags.values()) and all(len(f) == 1 for f in flags.values())
            assert {True} in flags.values()


def test_a_very_long_text(spark):
    rnd = random.Random(4)
    passage = " ".join(f"{rnd.randrange(10**9)}" for _ in range(400))
    long = " ".join(f"{rnd.randrange(10**7)}" for _ in range(90_000))
    rows = [(1, f"{passage} {long[:300_000]} {passage[:700]} {long[300_000:]}", "k", 1, "s"), (2, f"x{passage}y", "k", 1, "s"), (3, long[250_000:400_000], "k", 1, "s")]
    check(spark, rows, 100)
