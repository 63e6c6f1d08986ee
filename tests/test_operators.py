import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from splitwarden.functions import kernels, keys
from splitwarden.operators import calibrate, duplicates, leakage, linkage, metrics, partition, ranking, runs, sessionize, similarity
from splitwarden.operators.components import connected_components


def test_capture_keys(spark):
    cases = {
        "IMG_9954_frame00648.jpg": ("video", "IMG_9954", None),
        "WhatsApp Image 2026-06-10 at 1.jpg": ("whatsapp", "2026-06-10", None),
        "IMG_2155.HEIC.jpg": ("seq", "IMG_", 2155),
        "2.jpg": ("single", "2", None),
        "020dddb7-69a3-464d-ba4d-dfcf787a3de4.jpg": ("single", "020dddb7-69a3-464d-ba4d-dfcf787a3de4", None),
        "1234.jpg": ("seq", "IMG", 1234),
    }
    df = spark.createDataFrame([(f,) for f in cases], "file string")
    got = {r.file: tuple(r.k) for r in df.select("file", keys.capture_key(F.col("file")).alias("k")).collect()}
    assert got == cases
    loose = df.select("file", keys.capture_key(F.col("file"), False).alias("k")).where("file like '020%'").first().k
    assert loose.kind == "seq"


def test_sessions_from_names(spark):
    names = ["IMG_100.jpg", "IMG_103.jpg", "IMG_107.jpg", "clip_frame001.jpg", "clip_frame900.jpg", "1.jpg"]
    df = spark.createDataFrame([("a", n) for n in names] + [("b", "IMG_101.jpg")], "cls string, file string")
    got = {(r.cls, r.file): r.session for r in sessionize.sessions_from_names(df, 3).collect()}
    assert got[("a", "IMG_100.jpg")] == got[("a", "IMG_103.jpg")] != got[("a", "IMG_107.jpg")]
    assert got[("a", "clip_frame001.jpg")] == "video:a:clip" == got[("a", "clip_frame900.jpg")] and got[("a", "1.jpg")] == "single:a:1"
    assert got[("b", "IMG_101.jpg")] != got[("a", "IMG_100.jpg")]
    manifest = spark.createDataFrame([(*k, v) for k, v in got.items()], "cls string, file string, session string")
    new = {(r.cls, r.file): r.session_new for r in sessionize.regrouped(manifest, 10, True).collect()}
    assert len({new[k] for k in new if "IMG" in k[1]}) == 1 and new[("a", "clip_frame001.jpg")] == "video:a:clip"


def test_names_are_parsed_once(spark):
    """Steps that read a name's kind, key or number do not search it again."""
    searches = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower().count("rlike")
    df = spark.createDataFrame([("a", "IMG_100.jpg"), ("a", None), ("b", "clip_frame001.jpg")], "cls string, file string")
    assert searches(df.select(keys.capture_key(F.col("file")).alias("k")).select("k.*")) == 3
    first = sessionize.sessions_from_names(df, 3)
    assert searches(first) == 0 == searches(sessionize.regrouped(first, 10, True))
    assert {(r.file, r.session) for r in first.collect()} == {("IMG_100.jpg", "burst:a:IMG_:0"), (None, "single:a"), ("clip_frame001.jpg", "video:b:clip")}


def test_components_do_not_depend_on_order(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102), (200, 200), (None, 5)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and {got[i] for i in (100, 101, 102)} == {100} and got[200] == 200
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chance_and_mcnemar(spark):
    four = metrics.chance(spark.createDataFrame([(70,), (126,), (63,), (61,)], "n long")).first()
    three = metrics.chance(spark.createDataFrame([(70,), (126,), (63,)], "n long")).first()
    assert round(100 * four.uniform, 3) == 24.394 and round(100 * three.uniform, 3) == 32.512 and four.prior == 0.25
    p = spark.createDataFrame([(0.8,), (25 / 6,)], "x double").select(kernels.chi2_sf_one(F.col("x")).alias("p")).collect()
    assert [round(r.p, 6) for r in p] == [0.371093, 0.041227]
    none = metrics.mcnemar(spark.createDataFrame([(True, True)], "a boolean, b boolean"), "a", "b").first()
    assert (none.b, none.c, none.chi2) == (0, 0, None)


def test_macro_averages_differ_by_label_set(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b"), ("d", "a")], "t string, p string")
    cells = metrics.confusion(df, "t", "p")
    union, fixed, subset = (metrics.macro_union(cells).first(), metrics.macro_labels(cells, ["a", "b"]).first(), metrics.macro_subset(cells, ["a", "b"]).first())
    assert union.macro_f1 == pytest.approx((0.5 + 1 + 0 + 0) / 4) and fixed.macro_f1 == pytest.approx(0.75) and fixed.n_absent == 1
    assert subset.macro_f1 == pytest.approx((2 / 3 + 1) / 2)


def test_grouped_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([("x", f"g{i % 9}", i) for i in range(200)] + [("y", "only", 999)], "cls string, grp string, key long")
    out = partition.grouped_split(df, "cls", "grp")
    assert out.count() == 201 and leakage.straddling(out, "grp").first().n_straddling == 0
    assert leakage.sibling_leakage(out, "grp").first().n_leaked == 0
    assert {r.split for r in out.where("cls = 'x'").collect()} == {"train", "val", "test"}
    folds = partition.group_folds(df, "cls", "grp", 3)
    assert folds.groupBy("grp").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0 and folds.select("fold").distinct().count() == 3


def test_trivial_grouping_has_the_base_rate(spark):
    df = spark.createDataFrame([(c, f"{c}{i % 3}") for c in "ab" for i in range(20)], "cls string, truth string").withColumn("pred", F.col("cls"))
    s = calibrate.pair_scores(calibrate.pair_counts(df, "truth", "pred", "cls")).first()
    assert s.precision == pytest.approx(s.chance) and s.recall == 1 and s.lift == pytest.approx(1)
    same = df.withColumn("pred", F.col("truth"))
    assert calibrate.adjusted_rand(same, "truth", "pred").first().ari == pytest.approx(1) and calibrate.adjusted_mutual_information(same, "truth", "pred").first().ami == pytest.approx(1)


def test_linkage(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, "a", [1.0, 0.02 * i]) for i in range(6)] + [(10 + i, "a", [-1.0, 0.02 * i]) for i in range(4)], "key long, cls string, v array<double>")
    for threshold in (0.9, 0.999):
        pairs = similarity.cosine_pairs(df, "key", "cls", "v", threshold)
        assert similarity.single_linkage(df, pairs, "key", "cls").select("cluster").distinct().count() == 2
    assert similarity.greedy_linkage(df, "key", "cls", "v", 0.9).select("cluster").distinct().count() == 2
    h = spark.createDataFrame([(i, "a", rnd.getrandbits(63)) for i in range(40)] + [(100, "a", 7), (101, "a", 5), (102, "b", 5)], "key long, cls string, h long")
    plain = {(r.a, r.b) for r in similarity.hamming_pairs(h, "key", "cls", "h", 4, banded=False).collect()}
    assert {(r.a, r.b) for r in similarity.hamming_pairs(h, "key", "cls", "h", 4).collect()} == plain == {(100, 101)}
    assert (101, 102) in {(r.a, r.b) for r in similarity.hamming_pairs(h, "key", None, "h", 4).collect()}
    assert similarity.greedy_linkage(h, "key", "cls", "h", 3, "average", True).select("cluster").distinct().count() == 43


def test_redundancy_nulls(spark):
    df = spark.createDataFrame([("k", "c", "d1", None, "train"), ("k", "c", "d1", None, "test"), ("k", "c", "d2", "p", "test")], "cluster string, cls string, d string, p string, split string")
    a, b = (duplicates.redundancy(df, "cluster", "d", "p", "cls", "split", x).first() for x in (False, True))
    assert (a.byte, a.reenc, a.shots) == (1, 1, 0) and (b.byte, b.reenc, b.shots) == (1, 0, 1)


def test_clean_export_guard(spark):
    df = spark.createDataFrame([(1, "x", "a", "train"), (2, "y", "a", "test"), (3, "z", "b", "test"), (4, "x", "a", "test")], "key long, d string, cls string, split string")
    near = spark.createDataFrame([(3, "b", "a")], "held_key long, held_cls string, train_cls string")
    keep = lambda **kw: {r.key for r in duplicates.clean_export(df, "key", "d", "cls", "split", near, **kw).collect()}
    assert keep() == {1, 2} and keep(same_class_only=True) == {1, 2, 3}


def test_places(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.001, 20.0), (3, 11.0, 20.0), (4, None, 1.0)], "key long, lat double, lon double")
    got = {r.key: r.place for r in sessionize.place_leaders(df, "key", "lat", "lon").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: None}
    link = sessionize.place_links(df, "key", "lat", "lon").first()
    assert (link.a, link.b) == (1, 2) and math.isclose(link.metres, 111.19, abs_tol=0.1)


def test_runs(spark):
    df = spark.createDataFrame([("m", "group", 1, 50.0), ("m", "image", 1, 62.0), ("n", "group", 1, 60.0), ("n", "image", 1, 65.0)], "model string, mode string, seed int, `Macro F1 (%)` double")
    value = runs.headline([c for c in df.columns if c not in ("model", "mode", "seed")])
    got = {r.model: r.inflation_pp for r in runs.paired_inflation(df.withColumnRenamed(value, "f"), "model", "mode", "f").collect()}
    assert got == {"m": 12.0, "n": 5.0}
    c = metrics.paired_contrast(spark.createDataFrame([(0.0, 1.0), (0.0, 3.0), (0.0, 2.0)], "a double, b double"), "a", "b").first()
    assert c.mean == 2 and c.hi - c.lo == pytest.approx(2 * 4.30265 / math.sqrt(3))


def test_manifest_join(spark):
    items, manifest = spark.createDataFrame([("a", "1"), ("a", "2")], "cls string, file string"), spark.createDataFrame([("a", "1", "s")], "cls string, file string, session string")
    assert {r.session for r in leakage.manifest_join(items, manifest, ["cls", "file"]).collect()} == {"s", "unmapped:a:2"}
    with pytest.raises(ValueError, match="lacks"):
        leakage.manifest_join(items, manifest, ["cls", "file"], "fail")


def test_places_across_the_meridian_and_near_the_poles(spark):
    rnd = random.Random(4)
    spots = [(0.0, 179.9995), (0.0, -179.9995), (0.0, 179.0), (89.9999, 10.0), (89.9999, -170.0), (89.99, 0.0), (89.99, 1.0), (-90.0, 0.0), (-89.999, 77.0), (60.0, 180.0), (60.0, -180.0)]
    spots += [(lat + rnd.uniform(-0.01, 0.01), lon + rnd.uniform(-0.02, 0.02)) for lat, lon in ((0, 180), (45, -180), (70, 10), (-89.9, 50)) for _ in range(40)]
    rows = [(i, x, (y + 180) % 360 - 180) for i, (x, y) in enumerate(spots)]
    got = {(r.a, r.b) for r in sessionize.place_links(spark.createDataFrame(rows, "key long, lat double, lon double"), "key", "lat", "lon").collect()}

    def apart(p, q):
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))

    assert got == {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and apart(p, q) <= 300.0} and (0, 1) in got and (3, 4) in got


def test_too_many_items_for_one_sequence(spark, monkeypatch):
    monkeypatch.setattr(sessionize, "LEADERS", 3)
    df = spark.createDataFrame([(i, 1.0, 1.0, i % 2) for i in range(6)], "key long, lat double, lon double, area long")
    with pytest.raises(ValueError, match="name areas"):
        sessionize.place_leaders(df, "key", "lat", "lon")
    assert {r.place for r in sessionize.place_leaders(df, "key", "lat", "lon", by="area").collect()} == {0}


def test_components_by_rounds_and_in_one_task(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000), (7, 7)]
    rnd.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    want = {x: root(x) for x in parent}
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    for bound in (0, 150, 1 << 20):
        rows = connected_components(df, in_one_task=bound).collect()
        assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def naive_linkage(sims, least, how):
    parts = [[i] for i in range(len(sims))]
    value = lambda p, q: (min if how == "complete" else lambda x: sum(x) / len(x))([sims[i][j] for i in p for j in q])
    while True:
        found = next(((p, q) for k, p in enumerate(parts) for q in parts[k + 1 :] if value(p, q) >= least), None)
        if found is None:
            return sorted(sorted(p) for p in parts)
        found[0].extend(found[1])
        parts = [p for p in parts if p is not found[1]]


@pytest.mark.parametrize("how", ["complete", "average"])
def test_greedy_linkage_against_the_definition(spark, how):
    rnd = random.Random(11)
    v = [(i, "ab"[i % 2], [rnd.gauss(0, 1) for _ in range(4)], rnd.getrandbits(6) | rnd.getrandbits(6) << 40) for i in range(60)] + [(99, "a", None, None)]
    df = spark.createDataFrame(v, "key long, cls string, v array<double>, h long")
    unit = {k: [x / math.sqrt(sum(y * y for y in w)) for x in w] for k, _, w, _ in v if w}
    for column, threshold, sim, least in (("v", 0.5, lambda i, j: sum(a * b for a, b in zip(unit[i], unit[j], strict=True)), 0.5 - 1e-12), ("h", 4, lambda i, j: -(v[i][3] ^ v[j][3]).bit_count(), -4)):
        groups = {}
        for r in similarity.greedy_linkage(df, "key", "cls", column, threshold, how).collect():
            groups.setdefault(r.cluster, []).append(r.key)
        want = [[99]]
        for c in (0, 1):
            own = list(range(c, 60, 2))
            want += [[own[i] for i in p] for p in naive_linkage([[sim(i, j) for j in own] for i in own], least, how)]
        assert sorted(sorted(x) for x in groups.values()) == sorted(want)


def test_close_pairs_are_pruned_and_whole(spark):
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, "a" if i % 3 else "b", [x + rnd.gauss(0, 0.1) for x in centres[i % 12]]) for i in range(240)] + [(900, "a", [0.0] * 8), (901, "a", None)]
    df = spark.createDataFrame(rows, "key long, cls string, v array<double>")
    whole = {(r.a, r.b) for r in similarity.cosine_pairs(df, "key", "cls", "v").where("score >= 0.9").collect()}
    assert {(r.a, r.b) for r in similarity.cosine_pairs(df, "key", "cls", "v", 0.9).collect()} == whole and whole
    made, all_pairs = similarity.close_candidates(df, "key", "cls", "v", 0.9).count(), similarity.cosine_pairs(df, "key", "cls", "v").count()
    assert made < all_pairs / 3


def test_numbered(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, *range(-5, 40)]), f"{rnd.randrange(30):02d}x") for i in range(300)]
    df = spark.createDataFrame(rows, "key long, cls string, x long, s string")
    for order in ("x", "s"):
        w = Window.partitionBy("cls").orderBy(order, "key")
        want = {r.key: (r.r, r.n) for r in df.select("key", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("cls")).alias("n")).collect()}
        assert {r.key: (r["__r"], r["__n"]) for r in ranking.numbered(df, ["cls"], F.col(order), ["key"]).collect()} == want
    whole = ranking.numbered(df, [], F.col("x"), ["key"], count=None).collect()
    assert [r.key for r in sorted(whole, key=lambda r: r["__r"])] == [r.key for r in df.orderBy("x", "key").collect()]
    assert ranking.numbered(df.limit(0), ["cls"], F.col("x")).count() == 0
    plan = partition.stratified_split(df, "cls", "key")._jdf.queryExecution().executedPlan().toString()
    assert "__slice" in plan


def test_many_alike_groups_are_dealt_as_one_by_one():
    def plain(load, counts, many, whole):
        got = [0] * len(load)
        for _ in range(many):
            found = []
            for f in range(len(load)):
                tries = load.copy()
                tries[f] += counts
                found.append((((tries - load.min(0)) / whole).std(0).mean(), tries[f].sum(), f))
            at = min(found)[2]
            load[at] += counts
            got[at] += 1
        return got

    rnd = np.random.default_rng(1)
    cases = [(rnd.integers(0, 500, (k, c)).astype(float), rnd.integers(0, 9, c).astype(float), m) for k, c, m in ((2, 1, 700), (3, 2, 1000), (5, 3, 900), (4, 6, 400), (5, 4, 1), (3, 1, 7))]
    cases.append((np.array([[5000.0, 0.0], [0.0, 0.0], [3.0, 70.0]]), np.array([1.0, 0.0]), 9000))
    for load, counts, many in cases:
        counts[0] += not counts.any()
        whole = load.sum(0) + counts * many + 1
        want, mine = load.copy(), load.copy()
        assert partition.dealt_evenly(mine, counts, many, whole).tolist() == plain(want, counts, many, whole)
        assert (mine == want).all()
    # 10^5 alike groups: as many steps as until the loads' differences come back.
    load, counts = np.array([[0.0, 30.0], [7.0, 0.0], [0.0, 0.0]]), np.array([2.0, 3.0])
    whole, want, mine = np.array([2e5, 3e5]), load.copy(), load.copy()
    assert partition.dealt_evenly(mine, counts, 100_000, whole).tolist() == plain(want, counts, 100_000, whole)


@pytest.mark.parametrize("how", ["complete", "average"])
def test_bit_graph_linkage(how):
    """Against the definition on random graphs, and on a component of 20,000 items in bounded memory."""
    rnd = np.random.default_rng(3)
    for n, least in ((40, 0.2), (57, 0.5), (64, -0.1), (9, 0.0)):
        v = rnd.normal(size=(n, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        of = linkage.complete(linkage.cosine_graph(v, least)) if how == "complete" else linkage.average(linkage.cosine_graph(v, least), v, least, linkage.by_vectors)
        groups = {}
        for i, first in enumerate(of.tolist()):
            groups.setdefault(first, []).append(i)
        assert all(min(g) == first for first, g in groups.items())
        assert sorted(groups.values()) == naive_linkage((v @ v.T).tolist(), least, how)
    if how == "complete":
        n = 20_000
        v = np.stack([np.cos(np.arange(n) * 0.0001), np.sin(np.arange(n) * 0.0001)], 1)
        near = linkage.cosine_graph(v, math.cos(0.05))
        assert near.nbytes == n * n // 8
        of = linkage.complete(near)
        assert len(np.unique(of)) == math.ceil(n * 0.0001 / 0.05) and (np.diff(of) >= 0).all()


@pytest.mark.parametrize("how", ["complete", "average"])
def test_linkage_without_a_graph(spark, how):
    """The same clusters as on a graph of all pairs, in memory that grows with the items: a graph of 6,000 has 4.5 MB."""
    rng = np.random.default_rng(8)
    one, sums = lambda x, y: -np.bitwise_count(y ^ x).astype(np.int64), linkage.bit_counts
    for n, bits, most in [(1, 3, 2), (2, 1, 9), *((int(rng.integers(3, 150)), int(rng.integers(1, 7)), int(rng.integers(0, 6))) for _ in range(60))]:
        h = rng.integers(0, 1 << 6, n).astype(np.uint64) | rng.integers(0, 1 << bits, n).astype(np.uint64) << np.uint64(40)
        near = linkage.hash_graph(h, most)
        if how == "complete":
            assert linkage.first_fit(h, lambda x, y: np.bitwise_count(y ^ x) <= most).tolist() == linkage.complete(near).tolist()  # noqa: B023
        else:
            assert linkage.averaged(h, -most, one, sums, linkage.by_bits).tolist() == linkage.average(near, sums(h), -most, linkage.by_bits).tolist()
    seen = []
    for n in (1500, 6000):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        tracemalloc.start()
        if how == "complete":
            linkage.first_fit(h, lambda x, y: np.bitwise_count(y ^ x) <= 26)
        else:
            linkage.averaged(h, -26, one, sums, linkage.by_bits)
        seen.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert seen[1] < 5 * seen[0] and seen[1] < 6000 * 6000 / 8
    # As the queries run it.
    df = spark.createDataFrame([(i, "a", int(x)) for i, x in enumerate(h[:300] >> np.uint64(1))], "key long, cls string, h long")
    got = {r.key: int(r.cluster.split(":")[1]) for r in similarity.greedy_linkage(df, "key", "cls", "h", 26, how).collect()}
    near = linkage.hash_graph(h[:300] >> np.uint64(1), 26)
    want = linkage.complete(near) if how == "complete" else linkage.average(near, sums(h[:300] >> np.uint64(1)), -26, linkage.by_bits)
    assert [got[i] for i in range(300)] == want.tolist()


def test_a_component_beyond_a_task_is_refused_beforehand(spark):
    df = spark.range(30).select(F.col("id").alias("key"), F.lit("a").alias("cls"), F.array(F.lit(1.0), F.lit(0.5)).alias("v"))
    assert similarity.greedy_linkage(df, "key", "cls", "v", 0.9, most=30).select("cluster").distinct().count() == 1
    with pytest.raises(ValueError, match="component of 30"):
        similarity.greedy_linkage(df, "key", "cls", "v", 0.9, most=29)


def test_expected_information_against_the_sum():
    def plain(a, b, n):
        f, out = math.lgamma, 0.0
        for k in range(max(1, a + b - n), min(a, b) + 1):
            p = f(a + 1) + f(b + 1) + f(n - a + 1) + f(n - b + 1) - f(n + 1) - f(k + 1) - f(a - k + 1) - f(b - k + 1) - f(n - a - b + k + 1)
            out += k / n * math.log(n * k / (a * b)) * math.exp(p)
        return out

    cases = [(a, b, n) for n in (1, 2, 30, 777) for a in (1, 2, n // 3, n // 2, n - 1, n) for b in (1, 5, n // 2, n) if 0 < a <= n and 0 < b <= n]
    got = calibrate.expected_information(*np.array(cases).T)
    assert got.tolist() == pytest.approx([plain(*c) for c in cases], rel=1e-9, abs=1e-13)
    # Large sizes: the four cells of two groups and their complements have (1 / 2n) of information to first order.
    a, b, n = 300_000, 400_000, 1_000_000
    four = calibrate.expected_information([a, a, n - a, n - a], [b, n - b, b, n - b], [n] * 4).sum()
    assert four == pytest.approx(1 / (2 * (n - 1)), rel=1e-3)


def test_mutual_information_of_many_sizes(spark, monkeypatch):
    """Sizes are dealt to ranges, and no row holds a list of them."""
    monkeypatch.setattr(calibrate, "_SIZES", 100)
    df = spark.range(1, 1201).select(F.col("id").alias("truth"), F.explode(F.sequence(F.lit(1), F.col("id").cast("int"))).alias("i"))
    df = df.select("truth", F.floor(F.sqrt(F.pmod(F.xxhash64("truth", "i"), F.lit(900)).cast("double"))).alias("pred"))
    found = calibrate.adjusted_mutual_information(df, "truth", "pred")
    cells = df.groupBy("truth", "pred").count().toPandas()
    n = cells["count"].sum()
    a, b = cells.groupby("truth")["count"].sum(), cells.groupby("pred")["count"].sum()
    x, y = (v.ravel() for v in np.meshgrid(a.to_numpy(), b.to_numpy()))
    emi = calibrate.expected_information(x, y, np.full(len(x), n)).sum()
    mi = (cells["count"] / n * np.log(n * cells["count"] / (cells.truth.map(a) * cells.pred.map(b)))).sum()
    top = sum(-(v / n * np.log(v / n)).sum() for v in (a, b)) / 2
    assert found.first().ami == pytest.approx((mi - emi) / (top - emi), abs=1e-9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "FlatMapGroupsInArrow" in plan
    # 10,000 sizes against one another: 10^8 pairs would take as many entries at once as there are pairs in a block.
    sizes = np.arange(1, 10_001)
    assert np.isfinite(calibrate.expected_information(sizes, sizes[::-1], np.full(10_000, sizes.sum()))).all()


def test_one_way_anova(spark):
    rows = [("a", x) for x in (6.0, 8.0, 4.0, 5.0, 3.0, 4.0)] + [("b", x) for x in (8.0, 12.0, 9.0, 11.0, 6.0, 8.0)] + [("c", x) for x in (13.0, 9.0, 11.0, 8.0, 7.0, 12.0)] + [("c", None), (None, 4.0)]
    got = metrics.one_way_anova(spark.createDataFrame(rows, "g string, x double"), "g", "x").first()
    assert got.f == pytest.approx(9.264706, abs=1e-6) and (got.df_between, got.df_within) == (2, 15)
    assert got.p == pytest.approx((1 + 2 * got.f / 15) ** -7.5, rel=1e-10)  # the tail with two degrees of freedom
    odd = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 2.0), ("q", "a", 1.0), ("q", "a", 2.0), ("r", "a", 1.0), ("r", "a", 1.0), ("r", "b", 2.0)], "k string, g string, x double")
    assert {(r.k, r.f, r.p) for r in metrics.one_way_anova(odd, "g", "x", ["k"]).collect()} == {("p", None, None), ("q", None, None), ("r", None, None)}
    # Against a numerical integral of the density, tails and odd degrees of freedom included.
    for f, m, n in ((0.3, 3, 7), (2.5, 5, 40), (9.0, 1, 3), (1.0, 7, 300)):
        z = np.linspace(0, 1, 400_001)[1:-1]  # t / (1 + t) of the F variable
        t = z / (1 - z)
        log = (m / 2) * math.log(m / n) + (m / 2 - 1) * np.log(t) - (m + n) / 2 * np.log1p(m * t / n) - 2 * np.log1p(-z)
        density = np.exp(log - math.lgamma(m / 2) - math.lgamma(n / 2) + math.lgamma((m + n) / 2))
        tail = density[t >= f].sum() / 400_000
        assert kernels._beta_tail(n / (n + m * f), n / 2, m / 2) == pytest.approx(tail, abs=2e-3 if m == 1 else 2e-5)


def one_after_the_other(rows, metres):
    """key -> (first key of its cluster), and the numbers of clusters by size."""
    centres, of = [], {}
    for key, lat, lon in sorted(rows):
        at = next((i for i, (x, y, *_) in enumerate(centres) if kernels.metres_apart(lat, lon, np.array([x]), np.array([y]))[0] <= metres), None)
        if at is None:
            centres.append([lat, lon, 1, key])
            at = len(centres) - 1
        else:
            x, y, n, first = centres[at]
            centres[at] = [(x * n + lat) / (n + 1), (y * n + lon) / (n + 1), n + 1, first]
        of[key] = at
    place = {at: i for i, at in enumerate(sorted(range(len(centres)), key=lambda i: (-centres[i][2], i)))}
    return {k: place[at] for k, at in of.items()}


def test_leaders_by_islands_are_those_of_one_sequence(spark):
    rnd = random.Random(7)
    spots = [(rnd.gauss(10, 0.01), rnd.gauss(20, 0.01)) for _ in range(150)]  # one island
    spots += [(a + rnd.uniform(-0.004, 0.004), b + rnd.uniform(-0.004, 0.004)) for a, b in ((50, 8), (50, 8.5), (-33, 151), (0, 0)) for _ in range(25)]
    spots += [(rnd.uniform(-0.002, 0.002), rnd.choice([179.999, -179.999]) + rnd.uniform(-0.0009, 0.0009)) for _ in range(30)]  # centroids far from their items
    spots += [(0.0, 60.0 + 0.001 * i) for i in range(3)]  # inside the box that the island across the meridian has
    spots += [(89.999, rnd.uniform(-180, 180)) for _ in range(10)] + [(45 + 0.002 * i, 5 + 0.002 * i) for i in range(40)] + [(45.04, 5.001), (45.002, 5.078)]
    rows = [(i, *x) for i, x in enumerate(rnd.sample(spots, len(spots)))]
    df = spark.createDataFrame([*rows, (9000, None, 1.0), (9001, float("nan"), 1.0)], "key long, lat double, lon double").repartition(3)
    got = {r.key: r.place for r in sessionize.place_leaders(df, "key", "lat", "lon").collect()}
    assert got.pop(9000) is None and got.pop(9001) is None
    assert got == one_after_the_other(rows, 300.0)
    split = sessionize.islands(df.where("key < 9000").withColumn("area", F.lit(1)), "lat", "lon", 300.0, "area").groupBy("__island").count().collect()
    assert len(split) >= 6 and max(r["count"] for r in split) < 200
    assert sessionize.place_leaders(df.limit(0), "key", "lat", "lon").collect() == []
