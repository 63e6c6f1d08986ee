import hashlib
import math
import random

import numpy as np
import pytest
from splitwarden.operators import similarity, tiles
from splitwarden.operators.components import least_reachable

SIZE = 7


def rows(kind):
    rnd = random.Random(6)
    name = (lambda i: f"é{i * 37 % 101}") if kind == "string" else (lambda i: i * 37 % 101)
    centres = [[rnd.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    out = [(name(i), rnd.choice("aab"), [x + rnd.gauss(0, 0.4) for x in centres[i % 4]], rnd.getrandbits(63)) for i in range(90)]
    out += [(name(i), "a", out[3][2], out[3][3]) for i in range(90, 96)]
    return out + [(name(96), "a", [0.0] * 5, None), (name(97), "b", None, 0), (name(98), None, [1.0] * 5, 5), (None, "a", [1.0] * 5, 5), (name(99), "c", [1.0] * 5, -1), (name(100), "a", [1.0, 2.0], 1)]


def frame(spark, kind):
    return spark.createDataFrame(rows(kind), f"k {kind}, c string, v array<double>, h bigint").repartition(4)


def all_pairs(kind):
    """a, b, cls, cosine, distance."""
    known = sorted((r for r in rows(kind) if r[0] is not None and r[1] is not None), key=lambda r: r[0])
    for n, x in enumerate(known):
        for y in known[n + 1 :]:
            if x[1] == y[1]:
                sizes = [math.sqrt(sum(z * z for z in r[2])) if r[2] else 0 for r in (x, y)]
                cosine = sum(p * q for p, q in zip(x[2], y[2], strict=True)) / (sizes[0] * sizes[1]) if all(sizes) and len(x[2]) == len(y[2]) else None
                yield x[0], y[0], x[1], cosine, ((x[3] ^ y[3]) & ((1 << 64) - 1)).bit_count() if x[3] is not None and y[3] is not None else None


def linked(pairs):
    ends = {x: i for i, x in enumerate(sorted({e for p in pairs for e in p[:2]}))}
    if not pairs:
        return set()
    nodes, least = least_reachable(np.array([ends[p[0]] for p in pairs]), np.array([ends[p[1]] for p in pairs]))
    back = {i: x for x, i in ends.items()}
    return {(back[n], back[m]) for n, m in zip(nodes.tolist(), least.tolist(), strict=True)}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_pairs_against_all_pairs(spark, kind):
    df = frame(spark, kind)
    got = sorted((r.a, r.b, r.cls, round(r.score, 9)) for r in tiles.cosine_pairs(df, "k", "c", "v", 0.4, size=SIZE).collect())
    assert got == sorted((a, b, c, round(s, 9)) for a, b, c, s, _ in all_pairs(kind) if s is not None and s >= 0.4) and len(got) > 300
    for by in ("c", None):
        got = sorted((r.a, r.b, r.distance) for r in tiles.hamming_pairs(df.where("c is not null"), "k", by, "h", 29, size=SIZE).collect())
        if by:
            assert got == sorted((a, b, d) for a, b, _, _, d in all_pairs(kind) if d is not None and d <= 29) and got
        else:
            known = sorted((r[0], r[3]) for r in rows(kind) if r[0] is not None and r[1] is not None and r[3] is not None)
            assert got == [(a, b, ((x ^ y) & ((1 << 64) - 1)).bit_count()) for n, (a, x) in enumerate(known) for b, y in known[n + 1 :] if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 29]


def test_forests_link_the_same_at_every_threshold(spark):
    df = frame(spark, "bigint")
    some = [tuple(r) for r in tiles.cosine_pairs(df, "k", "c", "v", 0.1, linking=True, size=SIZE).collect()]
    whole = [(a, b, c, s) for a, b, c, s, _ in all_pairs("bigint") if s is not None and s >= 0.1]
    assert len(some) < len(whole) * 0.6
    for t in (0.1, 0.3, 0.5, 0.7, 0.9, 0.99, 1 - 1e-12):
        assert linked([p for p in some if p[3] >= t]) == linked([p for p in whole if p[3] >= t - 1e-14])
    some = [tuple(r) for r in tiles.hamming_pairs(df, "k", "c", "h", 32, linking=True, size=SIZE).collect()]
    for t in (0, 20, 25, 28, 32):
        assert linked([p for p in some if p[3] <= t]) == linked([(a, b, c, d) for a, b, c, _, d in all_pairs("bigint") if d is not None and d <= t])


def test_counts_and_samples(spark):
    df = frame(spark, "bigint")
    scores = [s for *_, s, _ in all_pairs("bigint") if s is not None]
    bins = {r.bin: r.n for r in tiles.cosine_counts(df, "k", "c", "v", lambda s: np.floor(s * 10 + 1e-9).astype(np.int64), size=SIZE).collect()}
    assert sum(bins.values()) == len(scores) and bins[9] == sum(0.9 <= s + 1e-10 < 1 for s in scores)
    told = similarity.score_profile(df, "k", "c", "v", 0.5).first()
    assert told.median == pytest.approx(float(np.median(scores))) and told.share == pytest.approx(sum(s >= 0.5 for s in scores) / len(scores))
    assert told.n_pairs == sum(1 for _ in all_pairs("bigint"))
    want = sorted((hashlib.md5(f"3|{a}|{b}".encode()).hexdigest(), a, b) for a, b, *_ in all_pairs("bigint"))[:40]
    assert [(r.a, r.b) for r in tiles.first_pairs(df, "k", "c", 40, 3, size=SIZE).collect()] == [(a, b) for _, a, b in want]


def test_no_row_per_pair_and_even_cells(spark):
    """A class that holds nearly all rows is spread over cells of bounded size; only tiles are copied."""
    n = 4000
    df = spark.range(n).selectExpr("id as key", "if(id < 3900, 'hot', 'cold') as cls", "array(cast(id as double), 1D) as v")
    dealt = tiles.cells(df, 500)
    cells = dealt.groupBy("cls", "i", "j").count().collect()
    tiles_of_hot = math.ceil(3900 / 500)
    assert sum(r["count"] for r in cells) <= n * tiles_of_hot
    assert len([r for r in cells if r.cls == "hot"]) == tiles_of_hot * (tiles_of_hot + 1) // 2 and max(r["count"] for r in cells) < 1.5 * 2 * 500
    plan = tiles.cosine_pairs(df, "key", "cls", "v", 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "a < b" not in plan and "FlatMapGroupsInArrow" in plan


def test_empty_tables(spark):
    df = frame(spark, "bigint").limit(0)
    assert tiles.cosine_pairs(df, "k", "c", "v", 0.1).collect() == [] and tiles.hamming_pairs(df, "k", None, "h", 9).collect() == []
    assert tiles.first_pairs(df, "k", "c", 5).collect() == [] and tiles.cosine_counts(df, "k", "c", "v", lambda s: s.astype(np.int64)).collect() == []
    assert tuple(similarity.score_profile(df, "k", "c", "v", 0.5).first()) == (0, None, None)
