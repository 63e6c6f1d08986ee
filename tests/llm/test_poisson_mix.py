import hashlib
import math
from collections import Counter

import pytest
from splitwarden.llm import poisson_mix

SCHEMA = "doc_id long, text string, source string, copy string, n int"


def draws(doc_id, rate, seed=1):
    total, parts = 0, max(1, math.ceil(rate / poisson_mix.MEAN))
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}|{j}|{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        p = c = math.exp(-rate / parts)
        k = 0
        while c <= u and k < 1000:
            k += 1
            p = p * (rate / parts) / k
            c += p
        total += k
    return total


def test_counts_follow_the_distribution(spark):
    docs = [(i, f"t{i}", "hot" if i % 3 else "a" if i % 2 else None, "clash", 1) for i in range(300)] + [(None, None, "b", "c", 1), (7, "again", "hot", "c", 1), (1000, "x" * 200000, "c", "c", 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    n = Counter(d[2] for d in docs)
    out = poisson_mix.mix(df).collect()
    got = Counter((r.doc_id, r.text) for r in out)
    want = {(d[0], d[1]): draws(d[0], len(docs) / len(n) / n[d[2]]) for d in docs}
    assert got == {k: v for k, v in want.items() if v}
    keys = [r.mix_key for r in out]
    assert keys == sorted(keys) and {r.copy for r in out if r.doc_id == 1000} == set(range(1, want[(1000, "x" * 200000)] + 1))
    assert [tuple(r) for r in poisson_mix.mix(df.repartition(5)).collect()] == [tuple(r) for r in out]


def test_target_weights_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(poisson_mix, "MANY", 1)
    docs = spark.createDataFrame([(i, "t", "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    n = Counter(r.source for r in poisson_mix.mix(docs, weights={"a": 3, "b": 1, "none": 0}).collect())
    assert "c" not in n and 550 < n["a"] < 800 and 150 < n["b"] < 300
    with pytest.raises(ValueError, match="positive"):
        poisson_mix.mix(docs, weights={"a": -1})
    assert poisson_mix.mix(docs.limit(0)).count() == 0


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "t", "a")], "doc_id long, text string, source string")
    plan = poisson_mix.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns_and_odd_rows(spark):
    names = "doc_id long, text string, source string, rate double, draws int, cdf string, mix_source string, id string, row int, n int, own_source int, __n int, mix_key string"
    rows = [(i, "t", "ab"[i % 2], 0.5, 1, "c", "m", "i", 2, 3, 4, 5, "k") for i in range(60)] + [(None, None, None, *(None,) * 10), (1, "", "a", *(None,) * 10), (1, "", "a", *(None,) * 10)]
    df = spark.createDataFrame(rows, names)
    out = poisson_mix.mix(df)
    assert out.columns == [*df.drop("mix_key").columns, "copy", "mix_key"]
    plain = poisson_mix.mix(df.select("doc_id", "text", "source"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, out.select("doc_id", "text", "source", "copy", "mix_key").collect())) and plain.count()
    assert {(r.rate, r["__n"]) for r in out.where("doc_id > 1").collect()} == {(0.5, 5)}
    assert poisson_mix.mix(df.limit(0)).count() == 0
