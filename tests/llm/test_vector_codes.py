import hashlib
import math

import numpy as np
import pytest
from splitwarden.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error double"


def brute(rows, parts=4, entries=256, rounds=4):
    """From the contract, in Python integers."""
    sound = [(r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]], r[2]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not sound:
        return []
    w = len(sound[0][1]) // parts
    cut = [[v[i * w : (i + 1) * w] for i in range(parts)] for _, v, _ in sound]
    books = [[c[i] for c in cut[:entries]] for i in range(parts)]

    def nearest(part, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[part]))

    for _ in range(rounds):
        got = [[nearest(i, c[i])[1] for i in range(parts)] for c in cut]
        new = []
        for i in range(parts):
            mine = [[c[i] for c, g in zip(cut, got, strict=True) if g[i] == j] for j in range(len(books[i]))]
            new.append([[sum(col) // len(m) for col in zip(*m, strict=True)] if m else old for m, old in zip(mine, books[i], strict=True)])
        books = new
    last = [[nearest(i, c[i]) for i in range(parts)] for c in cut]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = {}
    for (_, _, label), found in zip(sound, last, strict=True):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in found)
    return [(key, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), errors[label], sha) for (key, _, label), found in zip(sound, last, strict=True)]


def fixture(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=dim) * (spread if i % 3 else 0.05)], int(i) % 4 if i % 5 else None) for i in rng.permutation(n)]
    same = rows[3][1]
    rows += [(n + i, same, 1) for i in range(40)] + [(n + 50 + i, [0.0] * dim, 2) for i in range(5)]
    bad = [(n + 100, None, 1), (n + 101, [None] + same[1:], 1), (n + 102, [float("nan")] + same[1:], 1), (n + 103, [float("-inf")] + same[1:], 2)]
    rows += [*bad, (None, same, None), (None, rows[5][1], 0), (7, rows[9][1], 3), (7, rows[9][1], 3), (n + 104, [-1e5] * dim, 3)]
    return [(*r, "c", 0.5) for r in rows]


def test_against_brute_force(spark):
    for rows in (fixture(500, 8, 1), fixture(90, 4, 2)):
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert sorted(map(tuple, V.digest(df).collect()), key=str) == sorted(brute(rows), key=str)


def test_fewer_vectors_other_shapes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [0.5] * 4, 1, "", 0.0)], SCHEMA)
    assert [tuple(r)[:4] for r in V.digest(df).collect()] == [(1, "00000000", 0, 0)]
    none = df.limit(0)
    assert V.codebooks(none) is None and V.digest(none).collect() == []
    more = df.unionByName(spark.createDataFrame([(2, [0.1] * 8, 1, "", 0.0), (3, [], None, "", 0.0)], SCHEMA))
    assert [r["vec_id"] for r in V.digest(more).collect()] == [1]
    with pytest.raises(ValueError, match="equal parts"):
        V.codebooks(more.where("vec_id = 1"), parts=3)
    with pytest.raises(Exception, match="too large"):
        V.digest(spark.createDataFrame([(1, [3e38] * 4, 1, "", 0.0)], SCHEMA)).collect()


def test_codes_stand_for_entries(spark):
    rows = fixture(300, 8, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    books = V.codebooks(df, parts=2, entries=16, rounds=2)
    vectors = {r[0]: [math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in rows if r[0] is not None and r[0] < 300 and r[0] != 7}
    got = V.compressed(df, books).where("vec_id < 300 and vec_id <> 7").collect()
    assert len(got) == 299
    for r in got:
        assert len(r["code"]) == 4 and r["error"] == sum((a - b) ** 2 for a, b in zip(vectors[r["vec_id"]], books.decoded(r["code"]), strict=True))


def test_annulus_is_exact_and_spares_entries():
    rng = np.random.default_rng(0)
    entries = (rng.normal(size=(256, 6)) * rng.uniform(1, 4000, size=(256, 1))).astype(np.int64)
    entries[40:60] = entries[10]
    parts = (rng.normal(size=(3000, 6)) * rng.uniform(1, 4000, size=(3000, 1))).astype(np.int64)
    parts[:200] = entries[rng.integers(0, 256, 200)]
    for factor in (1, 1 << 13):  # beyond float64's integers in the second turn
        a, b = parts * factor, entries * factor
        index, distance, seen = V.Codebook(b).nearest(a)
        whole = ((a[:, None, :] - b[None]) ** 2).sum(2)
        assert (distance == whole.min(1)).all() and (index == whole.argmin(1)).all()
        assert seen < 0.75 * whole.size
