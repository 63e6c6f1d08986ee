"""Values that a second computation may change, and rows that an order leaves equal."""

import hashlib
import os

from pyspark.sql import functions as F
from splitwarden.functions import digests
from splitwarden.operators import leakage, metrics, sessionize, tiles


def test_correlation_of_values_that_differ_when_computed_again(spark):
    # As sums of doubles do in the last bit when their parts arrive in another order.
    drawn = F.udf(lambda k: k + int.from_bytes(os.urandom(4), "big") * 2.0**-40, "double").asNondeterministic()
    df = spark.range(40).select(drawn("id").alias("a"), drawn("id").alias("b"))
    got = metrics.correlations(df, "a", "b").first()
    assert got.n == 40 and abs(got.spearman - 1) < 1e-12


def test_equal_names_share_a_session(spark):
    rows = [(i, "c", f"IMG_{n:05d}.jpg") for i, n in enumerate([100, 100, 100, 500, 500, 500, 500, 502, 900, 900])]
    got = sessionize.sessions_from_names(spark.createDataFrame(rows, "id long, cls string, file string").repartition(4), 3).collect()
    assert {r.id: r.session.split(":")[-1] for r in got} == dict(enumerate("0001111122"))


def test_links_of_places_with_many_items(spark, monkeypatch):
    """Places are compared, not their items, and a place's items are in many rows: 800 items at four places, three near."""
    monkeypatch.setattr(sessionize, "BLOCK", 30)
    at = [(1.0, 2.0), (1.0, 2.0005), (1.0003, 2.0), (5.0, 5.0)]
    df = spark.createDataFrame([(i, *at[i % 4]) for i in range(800)], "key long, lat double, lon double")
    links = sessionize.place_links(df, "key", "lat", "lon", 150.0)
    assert sorted((r.a, r.b) for r in links.collect()) == [(a, b) for a in range(800) for b in range(a + 1, 800) if (a % 4 == 3) == (b % 4 == 3)]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "(a#" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_partitions_of_links_follow_the_pairs(spark, monkeypatch):
    """1,500 items in two places make about 560,000 pairs: more partitions than the session's four, each with its part, and
    no loop that holds the pairs of two blocks."""
    monkeypatch.setattr(sessionize, "BLOCK", 100)
    monkeypatch.setattr(sessionize, "TASK_PAIRS", 30_000, raising=False)
    df = spark.range(1500).selectExpr("id as key", "(id % 2) * 10.0D as lat", "1.0D as lon")
    links = sessionize.place_links(df, "key", "lat", "lon", 150.0)
    told = links.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in told) == 750 * 749 and len(told) > 10 and max(r["count"] for r in told) < 200_000
    lines = [x for x in links._jdf.queryExecution().sparkPlan().toString().splitlines() if "Generate explode" in x or "Coalesce" in x]
    assert ["Coalesce" in x for x in lines[:3]] == [False, True, False]
    assert links.where("a >= b or (a - b) % 2 <> 0").count() == 0 and links.distinct().count() == 750 * 749


def test_first_pairs_hash_few_pairs_whole(spark):
    """Keys of several lengths, some beyond one block of MD5, and far fewer whole digests than pairs."""
    names = [str(i * i * 37) for i in range(150)] + ["é" * 12 + str(i) for i in range(6)] + ["x" * 40 + str(i) for i in range(6)]
    df = spark.createDataFrame([(n, i % 2) for i, n in enumerate(names)], "k string, c int")
    pairs = [(min(x, y), max(x, y)) for i, x in enumerate(names) for y in names[i + 2 :: 2]]
    want = sorted((hashlib.md5(f"0|{a}|{b}".encode()).hexdigest(), a, b) for a, b in pairs)[:30]
    assert [(r.a, r.b) for r in tiles.first_pairs(df, "k", "c", 30, size=50).collect()] == [(a, b) for _, a, b in want]
    heads, tails = [b"0|%d|" % i for i in range(100, 140)], [b"%d" % i for i in range(1000, 1050)]
    whole = [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails] for h in heads]
    assert digests.md5_heads(heads, tails).tolist() == whole


def test_leakage_by_seed_is_that_of_each_seed(spark):
    rows = [(i, f"g{i * i % 23}", ["train", "val", "test", None][i % 4], ["test", "train", "test"][i % 3]) for i in range(90)]
    df = spark.createDataFrame([(r, *x) for x in rows for r in ("a", "b") if r == "a" or x[0] % 5], "rule string, key long, session string, s0 string, s7 string")
    got = leakage.leakage_by_seed(df, "session", ["rule"], {0: "s0", 7: "s7"})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    long = df.selectExpr("rule", "session", "stack(2, 0, s0, 7, s7) as (seed, split)")
    want = leakage.sibling_leakage(long, "session", ["rule", "seed"]).select("rule", "seed", "n_test", "n_leaked", "leak_pct")
    shape = {r.rule: (r.n, r.m) for r in df.groupBy("rule", "session").count().groupBy("rule").agg(F.count("*").alias("n"), F.max("count").alias("m")).collect()}
    rows = got.collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(tuple(r) for r in want.collect()) and {r.rule: (r.n_groups, r.largest) for r in rows} == shape
