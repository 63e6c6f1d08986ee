"""Further queries over the driver's tables: splits by their properties, linkage, mutual information, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import keys
from ..operators import calibrate, duplicates, leakage, metrics, partition, provenance, runs, sessionize, similarity
from . import catalogue as C
from .registry import SQL, Tables, query, rounded


# --- groups and splits ----------------------------------------------------------------------------------------
def recorded(t: Tables) -> DataFrame:
    d = C.docs(t).select("key", "cls")
    leaves = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").where("lang <> 'de'").select(F.col("lang").alias("cls"), F.col("doc_id").alias("key"), F.col("quality").cast("string").alias("leaf"))
    return sessionize.recorded_groups(d, leaves)


_RECORDED = "(SELECT d.doc_id AS key, lang AS cls, 'leaf:' || lang || ':' || quality AS session FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND lang <> 'de')"


@query(f"SELECT key, cls, session FROM {_RECORDED}")
def g6_recorded_groups(t):
    return recorded(t)


@query(f"SELECT cls, count(*) AS n_items, count(*) FILTER (session IS NULL) AS n_unmatched FROM {_RECORDED} GROUP BY cls")
def g6_unmatched(t):
    return sessionize.unmatched(recorded(t))


@query()
def g7_place_leaders(t):
    """Leader clusters of made-up places, each nation's customers in order of their keys."""
    at = F.pmod(F.xxhash64("c_custkey"), F.lit(1000)) / 1000.0
    p = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("area"), (F.col("c_nationkey") + at * 0.02).alias("lat"), (F.col("c_acctbal") / 1e6).alias("lon"))
    return sessionize.place_leaders(p, "key", "lat", "lon", 300.0, "area").select("key", "area", "place")


_SPOTS = "(SELECT c_custkey AS key, c_nationkey AS area, c_nationkey + (c_custkey * 7919 % 997) / 60000.0::DOUBLE AS lat, (c_custkey * 104729 % 1009) / 60000.0::DOUBLE AS lon FROM customer)"
_NEAR = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians(z.x) - radians(s.lat)) / 2), 2) + cos(radians(s.lat)) * cos(radians(z.x)) * pow(sin((radians(z.y) - radians(s.lon)) / 2), 2)))) <= 300"


# One item after the other, for all areas spot once: the centroids so far are a list, and the first near one takes the item.
@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY key) AS i FROM {_SPOTS}),
  r(area, i, key, spot, centres) AS (
    SELECT area, i, key, 1::BIGINT, [struct_pack(x := lat, y := lon, n := 1::DOUBLE)] FROM s WHERE i = 1
    UNION ALL
    SELECT area, i, key, spot, CASE WHEN spot > len(centres) THEN list_append(centres, struct_pack(x := lat, y := lon, n := 1::DOUBLE))
           ELSE list_concat(list_append(centres[:spot - 1], struct_pack(x := (centres[spot].x * centres[spot].n + lat) / (centres[spot].n + 1), y := (centres[spot].y * centres[spot].n + lon) / (centres[spot].n + 1), n := centres[spot].n + 1)), centres[spot + 1:]) END
    FROM (SELECT s.area, s.i, s.key, s.lat, s.lon, r.centres, coalesce(list_position(list_transform(r.centres, lambda z: {_NEAR}), true), len(r.centres) + 1)::BIGINT AS spot FROM r JOIN s ON s.area = r.area AND s.i = r.i + 1)),
  c AS (SELECT area, spot, row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, spot) - 1 AS place FROM r GROUP BY area, spot)
  SELECT r.key, r.area, c.place FROM r JOIN c ON c.area = r.area AND c.spot = r.spot""")
def g7_place_leaders_spots(t):
    """Leader clusters of places spread over some kilometres in each nation."""
    k = F.col("c_custkey")
    p = t.customer.select(k.alias("key"), F.col("c_nationkey").alias("area"), (F.col("c_nationkey") + (k * 7919 % 997) / 60000.0).alias("lat"), ((k * 104729 % 1009) / 60000.0).alias("lon"))
    return sessionize.place_leaders(p, "key", "lat", "lon", 300.0, "area").select("key", "area", "place")


_PLACES = "(SELECT c_custkey AS key, (c_custkey % 90)::DOUBLE AS lat, CASE WHEN c_custkey % 2 = 0 THEN 179.999 ELSE -179.9995 END::DOUBLE + (c_custkey % 7) / 10000.0::DOUBLE AS lon FROM customer)"


@query(f"""SELECT * FROM (SELECT a.key AS a, b.key AS b, CASE WHEN 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) <= 150 THEN true ELSE false END AS near
  FROM {_PLACES} a JOIN {_PLACES} b ON a.lat = b.lat AND a.key < b.key) WHERE near""")
def k7_place_links(t):
    """Pairs of places within 150 m, many of them across the 180th meridian."""
    k = F.col("c_custkey")
    p = t.customer.select(k.alias("key"), (k % 90).cast("double").alias("lat"), (F.when(k % 2 == 0, 179.999).otherwise(-179.9995) + (k % 7) / 10000.0).alias("lon"))
    return sessionize.place_links(p, "key", "lat", "lon", 150.0).select("a", "b", F.lit(True).alias("near"))


def two_kinds(t: Tables) -> DataFrame:
    """Bursts of events and single orders."""
    single = C.orders(t).select("key", "cls", sessionize.group_name("single", F.col("cls"), F.col("key")).alias("session"))
    return C.ev_sessions(t).select("key", "cls", "session").unionByName(single)


_TWO = f"(SELECT key, cls, session FROM {C._EVS} UNION ALL SELECT o_orderkey, o_orderpriority, 'single:' || o_orderpriority || ':' || o_orderkey FROM orders)"


@query(f"SELECT split_part(session, ':', 1) AS kind, count(*) AS n_items, count(DISTINCT session) AS n_sessions FROM {_TWO} GROUP BY 1")
def a2_sessions_by_kind(t):
    return two_kinds(t).groupBy(keys.kind_of(F.col("session")).alias("kind")).agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("session").alias("n_sessions"))


@query(f"SELECT key, split_part(session, ':', 1) AS kind FROM {_TWO}")
def p9_kinds(t):
    return two_kinds(t).select("key", keys.kind_of(F.col("session")).alias("kind"))


@query("SELECT d.doc_id AS key, lang AS cls, coalesce('known:' || l.quality, concat_ws(':', 'unmapped', lang, d.doc_id)) AS session FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND lang = CASE WHEN l.toxic = 1 THEN 'en' ELSE lang END")
def j14_two_keys(t):
    manifest = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(F.when(F.col("toxic") == 1, "en").otherwise(F.col("lang")).alias("cls"), F.col("doc_id").alias("key"), F.concat(F.lit("known:"), F.col("quality").cast("string")).alias("session"))
    return leakage.manifest_join(C.docs(t).select("cls", "key"), manifest, ["cls", "key"]).select("key", "cls", "session")


_CV = ["en", "fr", "es"]


@query(f"SELECT key, split, cls, (list_position({_CV}, cls) - 1)::BIGINT AS label, coalesce('known:' || l.quality, 'unmapped:' || key) AS session FROM {C._DOCP} LEFT JOIN labels l ON l.doc_id = key WHERE cls IN ('en', 'fr', 'es')")
def t8_cv_index(t):
    manifest = t.labels.select(F.col("doc_id").alias("key"), F.concat(F.lit("known:"), F.col("quality").cast("string")).alias("session"))
    return partition.cv_index(C.doc_split(t).select("key", "split", "cls"), manifest, _CV, ["key"]).select("key", "split", "cls", "label", "session")


@query(f"SELECT key, split FROM {C._DOCP}")
def t9_verified_split(t):
    """The split, once its parts have the sizes that rounding each class by itself gives."""
    expected = {"train": 0, "val": 0, "test": 0}
    for r in t.documents.groupBy("lang").count().collect():
        a, b = round(r["count"] * 0.8), round(r["count"] * 0.1)
        for s, n in (("train", a), ("val", b), ("test", r["count"] - a - b)):
            expected[s] += n
    return partition.verified(C.doc_split(t), "split", {s: n for s, n in expected.items() if n}).select("key", "split")


@query(rounded("SELECT doc_id AS key, (SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * n) AS weight FROM documents JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang)", "weight"))
def t11_item_weights(t):
    return partition.item_weights(C.docs(t).select("key", "cls"), "cls").select("key", "weight")


_SOURCES = "(SELECT doc_id % 200 AS fold, source AS cls FROM documents)"


@query(f"SELECT k.fold, c.cls FROM (SELECT DISTINCT fold FROM {_SOURCES}) k, (SELECT DISTINCT cls FROM {_SOURCES}) c WHERE NOT EXISTS (SELECT 1 FROM {_SOURCES} x WHERE x.fold = k.fold AND x.cls = c.cls)")
def t7_missing_classes(t):
    return partition.missing_in_folds(t.documents.select((F.col("doc_id") % 200).alias("fold"), F.col("source").alias("cls")), "cls")


@query(f"SELECT cls, count(*) AS n_items, count(DISTINCT session) AS n_groups, 0::BIGINT AS n_torn, true AS all_parts, true AS near_target FROM {C._EVS} GROUP BY cls")
def t2_split_properties(t):
    """Of the group-wise split: no group in two parts, all parts in each class, shares off by one group at most."""
    s = partition.grouped_split(C.ev_sessions(t), "cls", "session")
    per = s.groupBy("cls", "session").agg(F.countDistinct("split").alias("parts"), F.count(F.lit(1)).alias("n"), F.min("split").alias("split"))
    share = lambda x: F.sum(F.when(F.col("split") == x, F.col("n")).otherwise(0)) / F.sum("n")
    near = F.lit(True)
    for x, want in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        near = near & (F.abs(share(x) - want) <= F.max("n") / F.sum("n"))
    return per.groupBy("cls").agg(F.sum("n").alias("n_items"), F.countDistinct("session").alias("n_groups"), F.sum((F.col("parts") > 1).cast("long")).alias("n_torn"), (F.countDistinct("split") == 3).alias("all_parts"), near.alias("near_target"))


@query(f"SELECT cls, count(*) AS n_items, count(DISTINCT prefix) AS n_groups, 0::BIGINT AS n_torn, 4::BIGINT AS n_folds, true AS even FROM {C._EVS} GROUP BY cls")
def t4_fold_properties(t):
    """Of the group-wise folds: no group in two folds, all folds in each class, none with over 1.5 times its share."""
    f = partition.group_folds(C.ev_sessions(t), "cls", "prefix", 4)
    torn = f.groupBy("prefix").agg(F.countDistinct("fold").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n_torn"))
    groups = f.groupBy("cls").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("prefix").alias("n_groups"), F.countDistinct("fold").alias("n_folds"))
    even = f.groupBy("cls", "fold").agg(F.count(F.lit(1)).alias("n")).groupBy("cls").agg((F.max("n") <= 1.5 * F.avg("n")).alias("even"))
    return groups.join(even, "cls").crossJoin(F.broadcast(torn)).select("cls", "n_items", "n_groups", "n_torn", "n_folds", "even")


_HALF_EVEN = "round_even(n * 0.15::DOUBLE, 0)"


@query(f"SELECT fold, sum(1)::BIGINT AS n_units, greatest(1, round_even(count(*) * 0.15::DOUBLE, 0))::BIGINT AS n_val FROM (SELECT k.fold, u.source FROM (SELECT unnest([0, 1, 2, 3, 4]) AS fold) k JOIN (SELECT DISTINCT source, fold FROM {C._FOLD}) u ON u.fold <> k.fold GROUP BY ALL) GROUP BY fold")
def t6_inner_units(t):
    """For each fold as test: the other folds' units, and how many of them are for validation."""
    folds = partition.folds(C.docs(t).select("key", "cls", "source"), "image", "cls", "key", "source", 5)
    out = None
    for k in range(5):
        part = partition.inner_validation(folds, k, "source").where("part <> 'test'").groupBy(F.lit(k).alias("fold")).agg(F.countDistinct("source").alias("n_units"), F.countDistinct(F.when(F.col("part") == "val", F.col("source"))).alias("n_val"))
        out = part if out is None else out.unionByName(part)
    return out


# --- duplicates and similarity --------------------------------------------------------------------------------
_FORMED = "(SELECT *, CASE WHEN key % 3 = 0 THEN loose ELSE cls || ':' || n_chars // 200 END AS cluster FROM " + C._DOCP + ")"
_MIXED = f"(SELECT *, greatest(n - 1 - byte - reenc, 0) AS shots FROM (SELECT *, greatest(n - p - byte, 0) AS reenc FROM (SELECT cluster, min(cls) AS cls, count(*) AS n, count(*) - count(DISTINCT digest) AS byte, count(DISTINCT loose) AS p, count(DISTINCT split) AS n_splits FROM {_FORMED} GROUP BY cluster HAVING count(*) > 1)))"


def mixed_clusters(t: Tables) -> DataFrame:
    """Clusters of copies and, of the texts of like length, of distinct items."""
    cluster = F.when(F.col("key") % 3 == 0, F.col("loose")).otherwise(F.concat(F.col("cls"), F.lit(":"), F.floor(F.col("n_chars") / 200).cast("string")))
    return duplicates.redundancy(C.doc_split(t).withColumn("cluster", cluster), "cluster", "digest", "loose", "cls", "split")


_MIXED_KINDS = f"(SELECT cls, {C._KIND} FROM (SELECT *, (byte + reenc) / nullif(byte + reenc + shots, 0)::DOUBLE AS copy_share FROM (SELECT cls, sum(byte)::BIGINT AS byte, sum(reenc)::BIGINT AS reenc, sum(shots)::BIGINT AS shots FROM {_MIXED} GROUP BY cls)))"


def mixed_kinds(t: Tables) -> DataFrame:
    return duplicates.redundancy_kind(mixed_clusters(t), ["cls"]).withColumn("degenerate", F.col("cls") == "es")


@query(f"SELECT cls, kind FROM {_MIXED_KINDS} WHERE kind <> 'copy-dominated' AND cls <> 'es'")
def r3_usable_kinds(t):
    return runs.usable(mixed_kinds(t), "degenerate", "kind").select("cls", "kind")


@query(f"SELECT count(*) FILTER (kind <> 'copy-dominated' AND cls <> 'es') AS n_usable, count(*) AS n_rows, count(*) FILTER (kind <> 'copy-dominated' AND cls <> 'es') < 5 AS few FROM {_MIXED_KINDS}")
def r3_comparable(t):
    return runs.comparable(mixed_kinds(t), "degenerate", "kind")


@query(f"SELECT count(*) AS n_clusters, count(*) FILTER (n_splits > 1) AS n_straddling, coalesce(sum(byte + reenc) FILTER (n_splits > 1), 0)::BIGINT AS copies, coalesce(sum(shots) FILTER (n_splits > 1), 0)::BIGINT AS \"distinct\" FROM {_MIXED}")
def a11_cross_split(t):
    return duplicates.cross_split_composition(mixed_clusters(t))


@query(f"SELECT form, value, n FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY n DESC, value) AS r FROM (SELECT 'form' AS form, form AS value, count(*) AS n FROM {C._PG} GROUP BY 2 UNION ALL SELECT 'size', size::VARCHAR, count(*) FROM {C._PG} GROUP BY 2)) WHERE r <= 8")
def a25_frequent_forms(t):
    return duplicates.frequent_forms(C.page_forms(t), ["form", "size"])


def _merged(name: str, items: str, sims: str, least: str, how: str) -> str:
    """Greedy first-fit linkage as a recursion over the list of clusters of all classes: each step merges the first
    pair of clusters, by their first members, whose least (complete) or mean (average) similarity reaches least."""
    value = "min(s)" if how == "complete" else "avg(s)"
    return f"""WITH RECURSIVE sim AS MATERIALIZED (SELECT a, b, s FROM {sims} UNION ALL SELECT b, a, s FROM {sims}),
      step(n, member, first) AS (SELECT 0, key, key FROM {items} UNION ALL
        SELECT n + 1, member, CASE WHEN first = pb THEN pa ELSE first END FROM step, (
          SELECT x.first AS pa, y.first AS pb FROM step x JOIN sim ON sim.a = x.member JOIN step y ON y.member = sim.b WHERE x.first < y.first GROUP BY 1, 2 HAVING {value} >= {least} ORDER BY 1, 2 LIMIT 1))
      SELECT i.key, i.cls, i.cls || ':' || first AS cluster FROM step JOIN {items} i ON i.key = member WHERE n = (SELECT max(n) FROM step)"""


_FEW = "(SELECT n_nationkey AS key, (n_regionkey % 2)::BIGINT AS cls, [cos(n_nationkey * 0.9::DOUBLE), sin(n_nationkey * 0.9::DOUBLE), (n_regionkey - 2) / 4.0::DOUBLE] AS v, (n_nationkey * 2654435761) % 255 AS h FROM nation)"
_FEW_SIMS = f"(SELECT x.key AS a, y.key AS b, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) AS s FROM {_FEW} x JOIN {_FEW} y ON x.cls = y.cls AND x.key < y.key)"
_FEW_HAMS = f"(SELECT x.key AS a, y.key AS b, -bit_count(xor(x.h, y.h))::DOUBLE AS s FROM {_FEW} x JOIN {_FEW} y ON x.cls = y.cls AND x.key < y.key)"


def few(t: Tables) -> DataFrame:
    """Nations as points on circles and as short hashes."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    return t.nation.select(k.cast("long").alias("key"), (r % 2).cast("long").alias("cls"), F.array(F.cos(k * 0.9), F.sin(k * 0.9), (r - 2) / 4.0).alias("v"), ((k.cast("long") * 2654435761) % 255).alias("h"))


@query(_merged("c", _FEW, _FEW_SIMS, "0.3 - 1e-12", "complete"))
def c3_complete_by_steps(t):
    return similarity.greedy_linkage(few(t), "key", "cls", "v", 0.3)


@query(_merged("c", _FEW, _FEW_SIMS, "0.3 - 1e-12", "average"))
def c4_average_by_steps(t):
    return similarity.greedy_linkage(few(t), "key", "cls", "v", 0.3, "average")


@query(_merged("c", _FEW, _FEW_HAMS, "-3", "complete"))
def c3_complete_hashes(t):
    return similarity.greedy_linkage(few(t), "key", "cls", "h", 3)


@query(_merged("c", _FEW, _FEW_HAMS, "-3", "average"))
def c4_average_hashes(t):
    return similarity.greedy_linkage(few(t), "key", "cls", "h", 3, "average")


# --- calibration and metrics ----------------------------------------------------------------------------------
_AMI = f"""WITH c AS MATERIALIZED (SELECT threshold, truth, cluster, count(*) AS n FROM {C._CAL} GROUP BY ALL), a AS (SELECT threshold, truth, sum(n)::BIGINT AS a FROM c GROUP BY ALL), b AS (SELECT threshold, cluster, sum(n)::BIGINT AS b FROM c GROUP BY ALL), w AS (SELECT threshold, sum(n)::DOUBLE AS w FROM c GROUP BY ALL),
  mi AS (SELECT threshold, sum(n / w * ln(w * n / (a::DOUBLE * b))) AS mi FROM c JOIN a USING (threshold, truth) JOIN b USING (threshold, cluster) JOIN w USING (threshold) GROUP BY threshold),
  ha AS (SELECT threshold, sum(-a / w * ln(a / w)) AS h FROM a JOIN w USING (threshold) GROUP BY threshold), hb AS (SELECT threshold, sum(-b / w * ln(b / w)) AS h FROM b JOIN w USING (threshold) GROUP BY threshold),
  s AS (SELECT threshold, a, b, w, ka * kb AS k FROM (SELECT threshold, a, count(*) AS ka FROM a GROUP BY ALL) JOIN (SELECT threshold, b, count(*) AS kb FROM b GROUP BY ALL) USING (threshold) JOIN w USING (threshold)),
  x AS (SELECT *, unnest(generate_series(greatest(1, a + b - w::BIGINT), least(a, b))) AS i FROM s),
  e AS (SELECT threshold, sum(k * i / w * ln(w * i / (a::DOUBLE * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(w - a + 1) + lgamma(w - b + 1) - lgamma(w + 1) - lgamma(i + 1) - lgamma(a - i + 1) - lgamma(b - i + 1) - lgamma(w - a - b + i + 1))) AS e FROM x GROUP BY threshold)
  SELECT threshold, (mi - e) / ((ha.h + hb.h) / 2 - e) AS ami FROM mi JOIN ha USING (threshold) JOIN hb USING (threshold) JOIN e USING (threshold)"""


@query(rounded(_AMI, "ami"))
def a16_ami_sweep(t):
    return calibrate.adjusted_mutual_information(C.calibrated(t), "truth", "cluster", ["threshold"])


SQL["a16_ami"] = rounded(f"SELECT ami FROM ({_AMI}) WHERE threshold = 0.25", "ami")


@query(f"SELECT threshold, n.p < 0.5 * n.q OR predicted_rate > reference_rate + 1e-9 AS degenerate FROM ({C._DET}) JOIN (SELECT threshold, count(DISTINCT cluster) AS p, count(DISTINCT truth) AS q FROM {C._CAL} GROUP BY threshold) n USING (threshold)")
def a13_leaking_truth(t):
    """With the leakage that the predicted groups show against that of the true ones."""
    n = C.calibrated(t).groupBy("threshold").agg(F.countDistinct("cluster").alias("p"), F.countDistinct("truth").alias("q"))
    both = n.join(C.detected(t), "threshold")
    return both.select("threshold", calibrate.truth_degeneracy(F.col("p"), F.col("q"), F.col("predicted_rate"), F.col("reference_rate")).alias("degenerate"))


@query(rounded("""SELECT b, c, chi2, greatest(0, 1 - sqrt(2 / pi()) * (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(sqrt(chi2) * i / 4000, 2) / 2)) * sqrt(chi2) / 12000 FROM (SELECT unnest(generate_series(0, 4000)) AS i))) AS p
  FROM (SELECT *, pow(abs(b - c) - 1, 2) / nullif(b + c, 0)::DOUBLE AS chi2 FROM (SELECT count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM (SELECT n_nationkey % 3 = 0 AS x, n_regionkey % 2 = 0 AS y FROM nation)))""", "chi2", "p"))
def m10_mcnemar_p(t):
    """The p value; SQL integrates the normal density by Simpson's rule."""
    return metrics.mcnemar(t.nation.select((F.col("n_nationkey") % 3 == 0).alias("x"), (F.col("n_regionkey") % 2 == 0).alias("y")), "x", "y", p_value=True)


@query(rounded(f"SELECT count(d) AS n, avg(abs(d)) AS mean_difference, max(abs(d)) AS largest_difference FROM (SELECT avg(macro_F1) FILTER (mode = 'image') - avg(macro_F1) FILTER (mode = 'group') AS d FROM {C._RUN} GROUP BY seed)", "mean_difference", "largest_difference"))
def m15_replicate_differences(t):
    p = C.line_runs(t).groupBy("seed").pivot("mode", ["group", "image"]).agg(F.avg("macro_F1"))
    return metrics.replicate_differences(p, "group", "image")


@query("""SELECT doc_id AS key, CASE WHEN b < 1024 THEN format('{:.1f} B', b::DOUBLE) WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN format('{:.1f} MB', b / 1048576.0::DOUBLE) ELSE format('{:.1f} GB', b / 1073741824.0::DOUBLE) END AS size
  FROM (SELECT doc_id, strlen(text) * 129 AS b FROM documents)""")
def k13_readable_bytes(t):
    return t.documents.select(F.col("doc_id").alias("key"), K.readable_bytes(F.octet_length("text").cast("long") * 129).alias("size"))


@query(rounded("SELECT lang AS cls, sum(strlen(text))::DOUBLE / greatest(sum(length(trim(text))), 1) AS ratio FROM documents GROUP BY lang", "ratio"))
def k13_compression_ratio(t):
    s = t.documents.groupBy(F.col("lang").alias("cls")).agg(F.sum(F.octet_length("text")).alias("before"), F.sum(F.length(F.trim("text"))).alias("after"))
    return s.select("cls", K.compression_ratio(F.col("before"), F.col("after")).alias("ratio"))


# --- provenance -----------------------------------------------------------------------------------------------
def _short(n: Column, digits: int) -> Column:
    """A big-endian number of so many hexadecimal digits."""
    return F.lpad(F.hex(n.cast("long")), digits, "0")


def exif_files(t: Tables) -> DataFrame:
    """Events as TIFF blocks: the time and the type as EXIF text, and where value is known a place in degrees."""
    e = t.events.select(F.col("event_id").cast("string").alias("path"), F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("time"), F.rpad("event_type", 12, " ").alias("model"), (F.col("event_id") % 90).alias("d"), (F.col("event_id") % 60).alias("m"), F.col("value").isNotNull().alias("placed"))
    entry = lambda tag, kind, count, value: F.concat(F.lit(f"{tag:04X}{kind:04X}{count:08X}"), value)
    # Offsets: folder at 8 with three entries (42 bytes), texts at 50 (20) and 70 (12), places at 84 (54 bytes), numbers at 138.
    at = lambda n: F.lit(f"{n:08X}")
    main = F.concat(F.lit("0003"), entry(0x0110, 2, 12, at(70)), entry(0x0132, 2, 20, at(50)), entry(0x8825, 4, 1, at(84)), at(0))
    texts = F.concat(F.hex("time"), F.lit("00"), F.hex("model"), F.lit("0000"))
    gps = F.concat(F.lit("0004"), entry(1, 2, 2, F.lit("4E000000")), entry(2, 5, 3, at(138)), entry(3, 2, 2, F.lit("57000000")), entry(4, 5, 3, at(138)), at(0))
    numbers = F.concat(_short(F.col("d"), 8), F.lit("00000001"), _short(F.col("m"), 8), F.lit("00000001"), F.lit("0000000000000001"))
    none = F.lit("0000" + "0" * 8)
    return e.select("path", F.unhex(F.concat(F.lit("4D4D002A00000008"), main, texts, F.when(F.col("placed"), F.concat(gps, numbers)).otherwise(none))).alias("content"))


_EXIF = "(SELECT event_id::VARCHAR AS path, strftime(ts, '%Y:%m:%d %H:%M:%S') AS datetime, event_type AS model, CASE WHEN value IS NOT NULL THEN event_id % 90 + event_id % 60 / 60.0::DOUBLE END AS lat, CASE WHEN value IS NOT NULL THEN 0 - (event_id % 90 + event_id % 60 / 60.0::DOUBLE) END AS lon FROM events)"


@query(rounded(f"SELECT * FROM {_EXIF}", "lat", "lon"))
def k8_exif(t):
    return provenance.exif_table(exif_files(t)).select("path", "datetime", "model", "lat", "lon")


@query(f"SELECT datetime[:7] AS month, model, count(*) AS n, count(lat) AS n_gps FROM {_EXIF} GROUP BY ALL")
def a26_exif_summary(t):
    return provenance.capture_summary(provenance.exif_table(exif_files(t)))


_ANOVA = """SELECT status, (between_ / (k - 1)) / (within_ / (n - k)) AS f, k - 1 AS df_between, n - k AS df_within FROM (
  SELECT status, sum(m) AS n, count(*) AS k, sum(m * (mean - whole) * (mean - whole)) AS between_, sum(ss) AS within_ FROM (
    SELECT o_orderstatus AS status, o_orderpriority, count(*) AS m, avg(o_totalprice::DOUBLE) AS mean, var_pop(o_totalprice::DOUBLE) * count(*) AS ss,
           sum(sum(o_totalprice::DOUBLE)) OVER (PARTITION BY o_orderstatus) / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS whole
    FROM orders GROUP BY o_orderstatus, o_orderpriority) GROUP BY status)"""


# With five groups the tail is a closed form: x^h (1 + h (1 - x)), where x = df_within / (df_within + 4 f), h = df_within / 2.
@query(rounded(f"SELECT status, f, df_between::BIGINT AS df_between, df_within::BIGINT AS df_within, pow(x, h) * (1 + h * (1 - x)) AS p FROM (SELECT *, df_within / (df_within + df_between * f) AS x, df_within / 2.0::DOUBLE AS h FROM ({_ANOVA}))", "f", "p"))
def m16_one_way_anova(t):
    """Do orders of different priorities differ in price, for each status."""
    o = t.orders.select(F.col("o_orderstatus").alias("status"), "o_orderpriority", F.col("o_totalprice").cast("double").alias("price"))
    return metrics.one_way_anova(o, "o_orderpriority", "price", ["status"])
