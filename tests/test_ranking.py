import random

from pyspark.sql import Window
from pyspark.sql import functions as F
from splitwarden.operators import ranking, sessionize


def plain_runs(rows, by, gap):
    """rows: dicts with num and key; by: their columns."""
    out, last = {}, {}
    for r in sorted(rows, key=lambda r: (r["num"] is not None, r["num"] or 0, r["key"])):
        group = tuple(r[c] for c in by)
        before, run = last.get(group, (None, 0))
        run += before is not None and r["num"] is not None and r["num"] - before > gap
        last[group] = r["num"], run
        out[r["key"]] = run
    return out


def test_runs_of_a_hot_class_are_scanned_in_slices(spark):
    rnd = random.Random(9)
    rows = [{"key": i, "cls": rnd.choice(["a", "a", "b", None]), "prefix": "hot" if i % 5 else rnd.choice(["x", "y", None]), "num": rnd.choice([None, *range(0, 4000, 3)])} for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, cls string, prefix string, num long").repartition(5)
    for by in (["prefix"], ["cls", "prefix"]):
        got = ranking.runs(df, by, "num", "key", [0, 3, 6, 30])
        found = {r.key: r["__runs"] for r in got.collect()}
        for i, gap in enumerate((0, 3, 6, 30)):
            assert {k: v[i] for k, v in found.items()} == plain_runs(rows, by, gap)
        # Every window of rows is one of a slice.
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert all("__slice" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window") and "__gap" in line)
    dealt = ranking.dealt(df, "prefix", "num", "key").groupBy("__slice").count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 2 * 3000 / 4
    assert sessionize.gap_runs(df.limit(0), ["cls"], "num", 3, "key").collect() == []


def test_ranks_of_skewed_numbers(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 < 99, 1).otherwise(F.col("id")).alias("x"), F.lit("c").alias("cls"))
    sizes = [r["count"] for r in ranking.dealt(df, "cls", "x", "id").groupBy("__slice").count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) == 4
    want = df.select("id", F.row_number().over(Window.partitionBy("cls").orderBy("x", "id")).alias("r"))
    assert ranking.numbered(df, ["cls"], F.col("x"), ["id"]).select("id", "__r").exceptAll(want).count() == 0


def test_average_ranks(spark):
    rnd = random.Random(2)
    values = [rnd.choice([1.5, 1.5, 1.5, 2.0, -0.5, rnd.random()]) for _ in range(500)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    known = sorted(v for v in values if v is not None)
    want = {v: (2 * known.index(v) + known.count(v) + 1) / 2 for v in known}
    assert {r.x: r["rank"] for r in ranking.average_ranks(df, "x").collect()} == want
    assert ranking.average_ranks(df.limit(0), "x").collect() == []
