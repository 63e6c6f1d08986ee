import math

import numpy as np
from splitwarden.llm.pivot_search import top_k

SCHEMA = "vec_id long, embedding array<float>, score long, ring int"


def brute(rows, asked, k):
    sound = [(r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for q in {i for i, _ in sound if asked(i)}:
        best = {}
        for qi, qv in sound:
            if qi != q:
                continue
            for i, v in sound:
                if i != q:
                    s = sum(a * b for a, b in zip(qv, v, strict=False))
                    best[i] = max(best.get(i, s), s)
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def run(spark, rows, k=10, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = top_k(df, df.where("vec_id % 10 = 0"), k, **kw).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 10 == 0, k)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.1 * rng.normal(size=6)]) for i in range(300)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(80)]  # a hot vector: ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2010, [float("inf")] * 6), (2003, []), (2004, [1.5]), (None, same), (20, same), (20, rows[20][1]), (5, rows[5][1])]
    run(spark, [(*r, 1, 2) for r in rows], ring=16, pivots=4, block=8)


def test_few_rows_and_large_numbers(spark):
    run(spark, [(0, [1e6, -2e6], 1, 1), (10, [3e6, 1e6], 1, 1), (3, [1e6, 1e6], 1, 1)])
    empty = spark.createDataFrame([], SCHEMA)
    assert top_k(empty, empty).count() == 0


def test_far_rings_are_left_out(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in (1 if i % 2 else -1) * (3 + 0.01 * rng.normal(size=4))], 1, 1) for i in range(200)]
    run(spark, rows, k=3, pivots=2, ring=10)


def test_first_expansion_goes_on_until_rings_hold_enough(spark, monkeypatch):
    """Rings of one vector: more than two of them are taken before any score is known, and few in all."""
    from splitwarden.llm import pivot_search

    pairs, written = {}, pivot_search.written

    def noted(df, name):
        out = written(df, name)
        pairs[name] = out
        return out

    monkeypatch.setattr(pivot_search, "written", noted)
    monkeypatch.setattr(pivot_search, "_RINGS", 7)
    rng = np.random.default_rng(2)
    centres = 10 * rng.normal(size=(8, 3))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.01 * rng.normal(size=3)], 1, 1) for i in range(240)]
    rows += [(20, [5.0, 5.0, 5.0], 1, 1), (20, rows[20][1], 1, 1)]  # one id with two vectors, one of them twice
    run(spark, rows, k=4, pivots=8, ring=1)
    each = {(r.query_id, r.row): r["count"] for r in pairs["first_rings"].groupBy("query_id", "row").count().collect()}
    assert set(each.values()) == {5} and sum(q == 20 for q, _ in each) == 2
