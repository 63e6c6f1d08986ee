"""The library's operators over the driver's tables.

Carriers: events as captures of (event_type, user_id) by time; orders as numbered items; documents by language
with md5 as content; embeddings by label; labels as true and predicted classes; lineitem as runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import keys
from ..operators import calibrate, duplicates, leakage, metrics, partition, ranking, runs, sessionize, similarity
from ..sources.shared import kept, written
from .registry import Tables, query, rounded

DAY = 86_400_000_000
RULES = (("gap1", 1000, False), ("gap3", 3000, False), ("gap3_cross", 3000, True), ("gap10", 10_000, False), ("gap10_cross", 10_000, True))
SEEDS = [0, 1, 2]


# --- carriers -------------------------------------------------------------------------------------------------
def ev(t: Tables) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return t.events.select(F.col("event_id").alias("key"), F.col("event_type").alias("cls"), F.col("user_id").alias("prefix"), micros.alias("num"))


def ev_sessions(t: Tables) -> DataFrame:
    return sessionize.sessions(ev(t), "cls", "prefix", "num", "key", DAY)


def ev_split(t: Tables) -> DataFrame:
    return partition.stratified_split(ev_sessions(t), "cls", "key")


def orders(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("cls"), F.col("o_custkey").alias("prefix"), F.col("o_orderkey").alias("num"))


def docs(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("key"), F.col("lang").alias("cls"), F.col("source").alias("source"), "text", "n_chars")
    return d.withColumn("digest", K.digest(F.col("text"))).withColumn("loose", K.loose_digest(F.col("text")))


def doc_split(t: Tables) -> DataFrame:
    return partition.stratified_split(docs(t), "cls", "key").drop("text")


def vectors(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("key"), F.col("label").alias("cls"), K.doubles(F.col("embedding")).alias("v"))
    return v.withColumn("h", K.difference_hash(F.col("v")))


def predictions(t: Tables) -> DataFrame:
    """model, item, y_true, y_pred of three fixed rules."""
    d = t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id").where("quality is not null")
    rules = F.array(*(F.struct(F.lit(m).alias("model"), p.cast("int").alias("y_pred")) for m, p in (("m1", F.col("n_chars") > 500), ("m2", F.col("lang") == "en"), ("m3", F.col("toxic") == 0))))
    return d.select(F.col("doc_id").alias("item"), F.col("quality").alias("y_true"), F.explode(rules).alias("r")).select("item", "y_true", "r.*")


def order_predictions(t: Tables) -> DataFrame:
    """Three-class predictions: order status against a rule on the price; model by year parity."""
    o = t.orders
    pred = F.when(F.col("o_totalprice") > 250_000, "O").when(F.col("o_totalprice") > 150_000, "F").otherwise("P")
    return o.select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("y_true"), pred.alias("y_pred"), F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"))


def line_runs(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.when(F.col("l_linestatus") == "O", "group").otherwise("image").alias("mode"), F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_quantity").alias("macro_F1"), F.avg("l_discount").alias("accuracy"))


# --- the same in SQL ------------------------------------------------------------------------------------------
def _runs(source: str, by: str, gap: int, names: str | None = None) -> str:
    return f"""SELECT * EXCLUDE (prev, run), concat_ws(':', 'burst', {names or by}, run::BIGINT) AS session FROM (
      SELECT *, sum(CASE WHEN num - prev > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY num, key ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, lag(num) OVER (PARTITION BY {by} ORDER BY num, key) AS prev FROM {source}))"""


def _split(source: str, seed: str = "0", by: str = "cls") -> str:
    return f"""SELECT * EXCLUDE (r, n), CASE WHEN r <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN r <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(concat_ws('|', {seed}, cls, key)), key) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {source})"""


_EV = "(SELECT event_id AS key, event_type AS cls, user_id AS prefix, epoch_us(ts) AS num FROM events)"
_EVS = f"({_runs(_EV, 'cls, prefix', DAY)})"
_EVP = f"({_split(_EVS)})"
_OR = "(SELECT o_orderkey AS key, o_orderpriority AS cls, o_custkey AS prefix, o_orderkey AS num FROM orders)"
_DOC = r"(SELECT doc_id AS key, lang AS cls, source, n_chars, md5(text) AS digest, md5(lower(regexp_replace(text, '\s+', '', 'g'))) AS loose FROM documents)"
_DOCP = f"({_split(_DOC)})"
_EM = "(SELECT vec_id AS key, label AS cls, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_EMH = f"(SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(generate_series(1, 63), lambda i: coalesce((v[i] > v[i + 1])::BIGINT, 0))), lambda s, b: 2 * s + b) AS h FROM {_EM})"
_PR = """(SELECT l.doc_id AS item, quality AS y_true, r.model, r.y_pred FROM labels l JOIN documents d USING (doc_id),
  LATERAL (SELECT unnest(['m1', 'm2', 'm3']) AS model, unnest([(n_chars > 500)::INT, (lang = 'en')::INT, (toxic = 0)::INT]) AS y_pred) r WHERE quality IS NOT NULL)"""
_OP = "(SELECT o_orderkey AS item, o_orderstatus AS y_true, CASE WHEN o_totalprice > 250000 THEN 'O' WHEN o_totalprice > 150000 THEN 'F' ELSE 'P' END AS y_pred, 'm' || (o_custkey % 3) AS model FROM orders)"
_RUN = "(SELECT CASE WHEN l_linestatus = 'O' THEN 'group' ELSE 'image' END AS mode, l_returnflag AS model, l_linenumber AS seed, avg(l_quantity) AS macro_F1, avg(l_discount) AS accuracy FROM lineitem GROUP BY ALL)"
_PAIRS = f"(SELECT x.key AS a, y.key AS b, x.cls, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) AS score FROM {_EM} x JOIN {_EM} y ON x.cls = y.cls AND x.key < y.key)"
_HPAIRS = f"(SELECT x.key AS a, y.key AS b, x.cls, bit_count(xor(x.h, y.h))::INT AS distance FROM {_EMH} x JOIN {_EMH} y ON x.cls = y.cls AND x.key < y.key)"


def _linked(pairs: str, items: str, where: str) -> str:
    return f"""WITH RECURSIVE p AS (SELECT a, b FROM {pairs} WHERE {where}), e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
      r(n, c) AS (SELECT key, key FROM {items} UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.n),
      m AS (SELECT n AS key, min(c) AS first FROM r GROUP BY n)
      SELECT i.key, i.cls, i.cls::VARCHAR || ':s' || (dense_rank() OVER (PARTITION BY i.cls ORDER BY m.first) - 1) AS cluster FROM {items} i JOIN m ON m.key = i.key"""


_CONF = f"(SELECT model, y_true, y_pred, count(*) AS n FROM {_PR} GROUP BY ALL)"
_OCONF = f"(SELECT model, y_true, y_pred, count(*) AS n FROM {_OP} GROUP BY ALL)"


def _per_class(cells: str, labels: str | None = None) -> str:
    """labels: a select of (label)."""
    keep = labels or f"SELECT y_true AS label FROM {cells} UNION SELECT y_pred FROM {cells}"
    scope = f"(SELECT model, label FROM (SELECT DISTINCT model FROM {cells}), ({keep}))"
    if labels is None:
        scope = f"(SELECT model, y_true AS label FROM {cells} UNION SELECT model, y_pred FROM {cells})"
    return f"""SELECT model, label, tp, support, predicted, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
      SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall FROM (
        SELECT s.model, s.label, coalesce(sum(c.n) FILTER (c.y_true = s.label AND c.y_pred = s.label), 0)::BIGINT AS tp, coalesce(sum(c.n) FILTER (c.y_true = s.label), 0)::BIGINT AS support, coalesce(sum(c.n) FILTER (c.y_pred = s.label), 0)::BIGINT AS predicted
        FROM {scope} s JOIN {cells} c ON c.model = s.model GROUP BY s.model, s.label))"""


def _macro(cells: str, labels: str | None = None) -> str:
    absent = "0" if labels is None else f"CASE WHEN y_pred NOT IN ({labels}) THEN n ELSE 0 END"
    return rounded(f"""SELECT w.*, macro_precision, macro_recall, macro_f1 FROM
      (SELECT model, sum(n)::BIGINT AS n, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n)::DOUBLE AS accuracy, sum({absent})::BIGINT AS n_absent FROM {cells} GROUP BY model) w JOIN
      (SELECT model, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM ({_per_class(cells, labels)}) GROUP BY model) p USING (model)""", "accuracy", "macro_precision", "macro_recall", "macro_f1")  # fmt: skip


# --- groups ---------------------------------------------------------------------------------------------------
@query(f"SELECT key, session FROM {_EVS}")
def g1_sessionize_gap(t):
    return ev_sessions(t).select("key", "session")


@query(f"SELECT key, session FROM ({_runs(_OR, 'prefix', 3000)})")
def g3_sessionize_cross_class(t):
    return sessionize.sessions(orders(t), "cls", "prefix", "num", "key", 3000, True).select("key", "session")


_RULED = " UNION ALL ".join(f"SELECT '{n}' AS rule, key, cls, session FROM ({_runs(_OR, 'prefix' if x else 'cls, prefix', g)})" for n, g, x in RULES)
_RSEED = f"(SELECT * FROM ({_RULED}), (SELECT unnest([0, 1, 2]) AS seed))"


@query(rounded(f"""WITH p AS ({_split(_RSEED, 'seed', 'rule, seed, cls')}), tr AS (SELECT DISTINCT rule, seed, session FROM p WHERE split = 'train'),
  l AS (SELECT p.rule, p.seed, 100.0 * count(tr.session) / count(*) AS leak FROM p LEFT JOIN tr ON tr.rule = p.rule AND tr.seed = p.seed AND tr.session = p.session WHERE p.split = 'test' GROUP BY ALL),
  g AS (SELECT rule, count(*) AS n_groups, max(n) AS largest FROM (SELECT rule, session, count(*) AS n FROM ({_RULED}) GROUP BY ALL) GROUP BY rule)
  SELECT g.rule, n_groups, largest, avg(leak) AS mean, stddev_samp(leak) AS sd FROM g JOIN l ON l.rule = g.rule GROUP BY ALL""", "mean", "sd"))  # fmt: skip
def g4_grouping_sensitivity(t):
    parts = partition.stratified_split(orders(t), "cls", "key", SEEDS)
    splits = {s: f"split_{s}" for s in SEEDS}
    items = parts.groupBy("key", "cls", "prefix", "num").agg(*(F.max(F.when(F.col("seed") == s, F.col("split"))).alias(c) for s, c in splits.items()))
    items = written(items, "split_items")
    ruled = sessionize.by_rules(items, "cls", "prefix", "num", "key", RULES)
    rates = leakage.leakage_by_seed(ruled, "session", ["rule"], splits, len(RULES) * ranking.parts_of(items))
    return leakage.over_seeds(rates, "leak_pct", ["rule", "n_groups", "largest"]).select("rule", "n_groups", "largest", "mean", "sd")


@query(f"""WITH f AS {_EVS}, c AS (SELECT key, session AS coarse FROM ({_runs(_EV, 'prefix', DAY)})), g AS (SELECT coarse, count(DISTINCT session) AS n_fine, count(*) AS n_items, count(DISTINCT cls) AS n_classes FROM f JOIN c USING (key) GROUP BY coarse)
  SELECT * FROM g WHERE n_fine > 1""")
def g5_cross_group_joins(t):
    both = sessionize.sessions(ev_sessions(t), "cls", "prefix", "num", "key", DAY, True, "coarse")
    return sessionize.absorbed(both, "session", "coarse", "cls").where("n_fine > 1")


@query("SELECT event_type AS cls, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def g8_date_groups(t):
    return sessionize.date_groups(t.events.withColumn("cls", F.col("event_type")), "ts").groupBy("cls", "day").agg(F.count(F.lit(1)).alias("n"))


@query(rounded("SELECT s.cls AS cls, s.same AS same_group, w.n * (w.n - 1) // 2 AS pairs FROM (SELECT label AS cls, count(*) AS n, count(*) * (count(*) - 1) // 2 AS same FROM embeddings GROUP BY label) s JOIN (SELECT label AS cls, count(*) AS n FROM embeddings GROUP BY label) w USING (cls)", "cls"))
def g9_trivial_grouping(t):
    p = vectors(t).withColumn("trivial", F.col("cls"))
    return calibrate.pair_counts(p, "cls", "trivial", "cls", ["cls"]).select("cls", F.col("same_truth").alias("same_group"), F.col("all_pairs").alias("pairs"))


# --- names and keys -------------------------------------------------------------------------------------------
_NAMES = "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier"


@query(rf"SELECT id, name, regexp_replace(name, '\d+$', '') AS prefix, CASE WHEN regexp_extract(name, '(\d+)$', 1) <> '' THEN regexp_extract(name, '(\d+)$', 1)::BIGINT END AS num FROM ({_NAMES})")
def p2_name_key_parse(t):
    names = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return names.withColumn("k", keys.numbered(F.col("name"))).select("id", "name", "k.prefix", "k.num")


@query("SELECT doc_id AS key, n_chars, coalesce('known:' || l.quality, 'unmapped:' || d.doc_id) AS session FROM documents d LEFT JOIN labels l USING (doc_id)")
def p7_unmapped_fallback(t):
    manifest = t.labels.select(F.col("doc_id").alias("key"), F.concat(F.lit("known:"), F.col("quality").cast("string")).alias("session"))
    return leakage.manifest_join(docs(t).select("key", "n_chars"), manifest, ["key"])


@query("SELECT doc_id AS key, n_chars, 'known:' || l.quality AS session FROM documents d JOIN labels l USING (doc_id)")
def j1_manifest_join(t):
    manifest = t.labels.select(F.col("doc_id").alias("key"), F.concat(F.lit("known:"), F.col("quality").cast("string")).alias("session"))
    return leakage.manifest_join(docs(t).select("key", "n_chars"), manifest, ["key"], "drop")


@query("SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def p8_missing_keys(t):
    return leakage.missing_keys(docs(t).select("key"), t.labels.select(F.col("doc_id").alias("key")), ["key"])


@query("SELECT split_part(cluster, ':', 1) AS kind, count(*) AS n FROM (SELECT 'burst:' || event_type || ':' || user_id AS cluster FROM events) GROUP BY 1")
def p9_kind_of(t):
    return ev(t).select(keys.kind_of(sessionize.group_name("burst", F.col("cls"), F.col("prefix"))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS cls, count(*) AS n FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '5-low') GROUP BY 1")
def p4_class_filter(t):
    return orders(t).where(keys.in_classes(F.col("cls"), ["1-URGENT", "5-low"])).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT x AS cls FROM (SELECT unnest(['en', 'xx', 'de', 'yy']) AS x) WHERE x NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)")
def p3_missing_classes(t):
    return keys.missing_classes(docs(t).select("cls"), ["en", "xx", "de", "yy"])


@query(f"SELECT key, cls FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY key) - 1 AS r, count(*) OVER (PARTITION BY cls) AS n FROM {_DOC}) WHERE n <= 100 OR r % (n // 100) = 0")
def p11_stride_sample(t):
    return similarity.strided(docs(t).select("key", "cls"), "cls", "key", 100)


@query(f"SELECT a, b FROM {_PAIRS} ORDER BY md5(concat_ws('|', 0, a, b)), a, b LIMIT 200")
def p12_pair_sample(t):
    return similarity.sampled_pairs(vectors(t), "key", "cls", 200)


@query("SELECT 'source' AS \"column\", source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 20")
def p13_location_values(t):
    return keys.location_values(t.documents)


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def p14_class_rename(t):
    return t.orders.groupBy(keys.renamed(F.col("o_orderstatus"), {"O": "open", "F": "filled"}).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- partitions -----------------------------------------------------------------------------------------------
@query(f"SELECT key, cls, split FROM {_DOCP}")
def t1_stratified_split(t):
    return doc_split(t).select("key", "cls", "split")


@query()
def t2_group_greedy_split(t):
    return partition.grouped_split(ev_sessions(t), "cls", "session").select("key", "cls", "session", "split")


@query(f"SELECT min(n) AS least_groups, greatest(2, least(5, min(n)))::BIGINT AS usable_k FROM (SELECT cls, count(DISTINCT session) AS n FROM {_EVS} GROUP BY cls)")
def t3_max_usable_k(t):
    return partition.usable_folds(ev_sessions(t), "cls", "session")


@query()
def t4_group_folds(t):
    return partition.group_folds(ev_sessions(t), "cls", "prefix", 4).select("key", "cls", "prefix", "fold")


_FOLD = f"(SELECT key, cls, source, (row_number() OVER (PARTITION BY cls ORDER BY md5(concat_ws('|', 0, cls, key)), key) - 1) % 5 AS fold FROM {_DOC})"


@query(f"SELECT key, cls, fold FROM {_FOLD}")
def t5_kfold_item(t):
    return partition.item_folds(docs(t), "cls", "key", 5).select("key", "cls", "fold")


@query(f"""WITH f AS {_FOLD} SELECT k.fold, CASE WHEN f.fold = k.fold THEN 'test' ELSE 'train' END AS part, count(*) AS n_items, count(DISTINCT source) AS n_groups, (SELECT count(DISTINCT cls) FROM f) - count(DISTINCT cls) AS n_missing
  FROM f, (SELECT DISTINCT fold FROM f) k GROUP BY ALL""")
def t7_fold_composition(t):
    return partition.fold_composition(partition.folds(docs(t), "image", "cls", "key", "source", 5), "cls", "source")


@query()
def t6_inner_validation(t):
    folds = partition.folds(ev_sessions(t), "group", "cls", "key", "prefix", 4)
    return partition.inner_validation(folds, 0, "prefix").select("key", "fold", "part")


@query("SELECT doc_id AS key FROM documents ORDER BY md5(concat_ws('|', 0, doc_id)), doc_id LIMIT 100")
def t10_few_shot(t):
    return partition.few_shot(docs(t).select("key", "cls"), "key", "cls", 100).select("key")


@query(rounded("SELECT lang AS cls, count(*) AS n, (SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * count(*)) AS weight FROM documents GROUP BY lang", "weight"))
def t11_class_weights(t):
    return partition.class_weights(docs(t), "cls")


@query("SELECT o_orderpriority AS cls, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS id FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def t12_label_ids(t):
    return partition.label_ids(orders(t), "cls")


# --- leakage --------------------------------------------------------------------------------------------------
@query(rounded(f"""WITH p AS {_EVP}, tr AS (SELECT DISTINCT session FROM p WHERE split = 'train')
  SELECT p.cls, count(*) AS n_test, count(tr.session) AS n_leaked, 100.0 * count(tr.session) / count(*) AS leak_pct, count(DISTINCT tr.session) AS shared_groups FROM p LEFT JOIN tr USING (session) WHERE split = 'test' GROUP BY p.cls""", "leak_pct"))
def j2_sibling_leakage(t):
    flags = leakage.sibling_flags(ev_split(t), "session")
    return flags.groupBy("cls").agg(F.count(F.lit(1)).alias("n_test"), F.sum(F.col("hit").cast("long")).alias("n_leaked"), (100.0 * F.avg(F.col("hit").cast("double"))).alias("leak_pct"), F.countDistinct(F.when(F.col("hit"), F.col("session"))).alias("shared_groups"))


_SEEDED = f"(SELECT * FROM {_EVS}, (SELECT unnest([0, 1, 2]) AS seed))"


@query(rounded(f"""WITH p AS ({_split(_SEEDED, 'seed', 'seed, cls')}), tr AS (SELECT DISTINCT seed, session FROM p WHERE split = 'train'),
  l AS (SELECT p.seed, 100.0 * count(tr.session) / count(*) AS leak FROM p LEFT JOIN tr ON tr.seed = p.seed AND tr.session = p.session WHERE split = 'test' GROUP BY p.seed)
  SELECT count(*) AS n_seeds, avg(leak) AS mean, stddev_pop(leak) AS sd_pop, stddev_samp(leak) AS sd_samp FROM l""", "mean", "sd_pop", "sd_samp"))
def a7_leakage_over_seeds(t):
    parts = partition.stratified_split(ev_sessions(t), "cls", "key", SEEDS)
    leak = leakage.sibling_leakage(parts, "session", ["seed"])
    pop, samp = leakage.over_seeds(leak, "leak_pct", [], False), leakage.over_seeds(leak, "leak_pct", [])
    return pop.select("n_seeds", "mean", F.col("sd").alias("sd_pop")).crossJoin(samp.select(F.col("sd").alias("sd_samp")))


_TORN = f"(SELECT session, count(DISTINCT split) AS k, count(*) AS n FROM {_EVP} GROUP BY session)"


@query(rounded(f"SELECT count(*) AS n_groups, count(*) FILTER (k > 1) AS n_straddling, sum(n)::BIGINT AS n_items, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS items_straddling, 100.0 * coalesce(sum(n) FILTER (k > 1), 0) / sum(n) AS pct FROM {_TORN}", "pct"))
def a3_straddling(t):
    return leakage.straddling(ev_split(t), "session")


@query(f"SELECT session, split, count(*) AS n_items, array_to_string(list_slice(list_sort(list(key)), 1, 12), ',') AS first_items FROM {_EVP} WHERE session IN (SELECT session FROM {_TORN} WHERE k > 1) GROUP BY ALL")
def a4_straddle_layout(t):
    rows = leakage.layout(ev_split(t), "session", "key")
    return rows.withColumn("first_items", F.array_join(F.col("first_items").cast("array<string>"), ","))


@query(f"SELECT p.cls, count(*) AS n_items, count(DISTINCT p.session) AS n_groups, count(*) FILTER (x.k > 1) AS leaky_items FROM {_EVP} p JOIN {_TORN} x USING (session) GROUP BY p.cls")
def a5_class_exposure(t):
    return leakage.exposure(ev_split(t), "cls", "session")


@query(f"SELECT count(*) FILTER (k > 1) AS n_straddling, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS items_straddling FROM {_TORN}")
def a30_any_boundary(t):
    return leakage.straddling(ev_split(t), "session").select("n_straddling", "items_straddling")


@query(rounded(f"""WITH p AS (SELECT session, split, count(*) AS n FROM {_EVP} GROUP BY ALL), w AS (SELECT split, sum(n)::BIGINT AS n_items FROM p GROUP BY split)
  SELECT a.split AS from_split, b.split AS to_split, any_value(w.n_items) AS n_items, sum(a.n)::BIGINT AS n_shared, 100.0 * sum(a.n) / any_value(w.n_items) AS pct FROM p a JOIN p b ON a.session = b.session AND a.split <> b.split JOIN w ON w.split = a.split GROUP BY 1, 2""", "pct"))
def j10_split_overlap(t):
    return leakage.split_overlap(ev_split(t), "session")


_SIZES = f"(SELECT session, cls, count(*) AS n FROM {_EVS} GROUP BY ALL)"


@query(rounded(f"SELECT sum(n)::BIGINT AS n_items, count(*) AS n_groups, avg(n) AS mean_size, 100.0 * avg((n = 1)::INT) AS singleton_pct, max(n) AS largest FROM {_SIZES}", "mean_size", "singleton_pct"))
def a8_cluster_shape(t):
    return leakage.group_shape(ev_sessions(t), "session")


@query(rounded(f"SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_items, quantile_cont(n, 0.5)::DOUBLE AS median_size, max(n) AS largest, count(*) FILTER (n = 1) AS n_singletons, (SELECT sum(n)::BIGINT FROM (SELECT n FROM {_SIZES} ORDER BY n DESC, session LIMIT 10)) AS top_items, 100.0 * (SELECT sum(n) FROM (SELECT n FROM {_SIZES} ORDER BY n DESC, session LIMIT 10)) / sum(n) AS top_share FROM {_SIZES}", "median_size", "top_share"))
def a27_session_structure(t):
    return leakage.group_structure(ev_sessions(t), "session")


@query(rounded(f"SELECT * FROM (SELECT cls, session, n, row_number() OVER (PARTITION BY cls ORDER BY n DESC, session) AS size_rank, n / sum(n) OVER (PARTITION BY cls)::DOUBLE AS share FROM {_SIZES}) WHERE size_rank <= 20", "share"))
def w5_size_ranks(t):
    return leakage.group_ranks(ev_sessions(t), "session", "cls").where("size_rank <= 20").withColumn("size_rank", F.col("size_rank").cast("long"))


@query(f"""SELECT session, count(*) AS n, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, array_to_string(list_slice(list_sort(list(key)), 1, 4), ',') AS names FROM {_EVP} GROUP BY session ORDER BY n DESC, session LIMIT 10""")
def o3_topk_listing(t):
    return leakage.listing(ev_split(t), "session", "key", "split").withColumn("names", F.array_join(F.col("names").cast("array<string>"), ","))


@query(f"SELECT cls, split, count(*) AS n FROM {_DOCP} GROUP BY ROLLUP (cls, split) HAVING grouping(cls) = 1 OR grouping(split) = 0")
def s19_rollup_counts(t):
    r = doc_split(t).rollup("cls", "split").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return r.where("g <> 1").select("cls", "split", "n")


@query(f"SELECT cls, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total, count(*) >= 100 AS expected_met FROM {_DOCP} GROUP BY cls")
def a1_class_split_counts(t):
    d = doc_split(t)
    p = d.groupBy("cls").agg(*(F.sum((F.col("split") == s).cast("long")).alias(s) for s in partition.SPLITS), F.count(F.lit(1)).alias("total"))
    return p.withColumn("expected_met", F.col("total") >= 100)


@query(f"SELECT split_part(session, ':', 1) AS kind, count(*) AS n_items, count(DISTINCT session) AS n_sessions FROM {_EVS} GROUP BY 1")
def a2_session_summary(t):
    return ev_sessions(t).groupBy(keys.kind_of(F.col("session")).alias("kind")).agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("session").alias("n_sessions"))


# --- duplicates -----------------------------------------------------------------------------------------------
@query(f"SELECT digest, count(*) AS n, count(DISTINCT split) AS n_splits, count(DISTINCT split) > 1 AS spans_splits FROM {_DOCP} GROUP BY digest HAVING count(*) > 1")
def a19_exact_duplicates(t):
    return duplicates.duplicate_groups(doc_split(t), "digest", "split")


_CLASSED = f"(SELECT * REPLACE (source AS cls) FROM {_DOCP})"


def by_source(t: Tables) -> DataFrame:
    """Sources as classes, so that one content may stand under several."""
    return doc_split(t).withColumn("cls", F.col("source"))


@query(f"SELECT digest, count(*) AS n, count(DISTINCT cls) AS n_classes, CASE WHEN count(DISTINCT cls) > 1 THEN 'conflict' WHEN count(DISTINCT split) > 1 THEN 'split_duplicate' ELSE 'copy' END AS verdict FROM {_CLASSED} GROUP BY digest HAVING count(*) > 1")
def a20_label_conflicts(t):
    return duplicates.label_conflicts(by_source(t), "digest", "cls", "split")


@query(f"WITH d AS (SELECT DISTINCT digest, cls FROM {_CLASSED}) SELECT a.cls AS class_a, b.cls AS class_b, count(*) AS n FROM d a JOIN d b ON a.digest = b.digest AND a.cls < b.cls GROUP BY 1, 2 ORDER BY n DESC, class_a, class_b LIMIT 15")
def a21_class_pairs(t):
    return duplicates.class_pairs(by_source(t), "digest", "cls")


@query(f"SELECT cls, count(*) AS n FROM {_CLASSED} WHERE digest IN (SELECT digest FROM {_CLASSED} GROUP BY digest HAVING count(DISTINCT cls) > 1) GROUP BY cls")
def a21_conflicting_copies(t):
    return duplicates.conflicting_copies(by_source(t), "digest", "cls")


@query(f"SELECT key, cls FROM {_DOCP} a WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM {_DOCP} b WHERE b.split = 'test' AND b.digest = a.digest)")
def j3_dedupe_train(t):
    return duplicates.train_without_test(doc_split(t), "digest").select("key", "cls")


@query(rounded(f"""WITH d AS (SELECT DISTINCT cls, split, digest FROM {_DOCP}), n AS (SELECT cls, split, count(*) AS n FROM d GROUP BY ALL)
  SELECT a.cls, a.split AS split_a, b.split AS split_b, any_value(x.n) AS n_a, any_value(y.n) AS n_b, count(*) AS n_both, 100.0 * count(*) / any_value(x.n) AS pct_a, 100.0 * count(*) / any_value(y.n) AS pct_b, (100.0 * count(*) / any_value(x.n) > 95 AND 100.0 * count(*) / any_value(y.n) > 95) AS same_set
  FROM d a JOIN d b ON a.cls = b.cls AND a.digest = b.digest AND a.split < b.split JOIN n x ON x.cls = a.cls AND x.split = a.split JOIN n y ON y.cls = b.cls AND y.split = b.split GROUP BY 1, 2, 3""", "pct_a", "pct_b"))
def j11_whole_split_overlap(t):
    return duplicates.whole_split_overlap(doc_split(t), "digest", "cls")


_RED = f"""(SELECT *, greatest(n - 1 - byte - reenc, 0) AS shots FROM (SELECT *, greatest(n - p - byte, 0) AS reenc FROM (SELECT loose AS cluster, min(cls) AS cls, count(*) AS n, count(*) - count(DISTINCT digest) AS byte, count(DISTINCT loose) AS p, count(DISTINCT split) AS n_splits FROM {_DOCP} GROUP BY loose HAVING count(*) > 1)))"""
_KIND = "copy_share, CASE WHEN copy_share IS NULL THEN 'none' WHEN copy_share > 0.7 THEN 'copy-dominated' WHEN copy_share < 0.3 THEN 'burst-dominated' ELSE 'mixed' END AS kind"


def _kinds(by: str) -> str:
    return rounded(f"SELECT {by} n_clusters, byte, reenc, shots, {_KIND} FROM (SELECT *, (byte + reenc) / nullif(byte + reenc + shots, 0)::DOUBLE AS copy_share FROM (SELECT {by} count(*) AS n_clusters, sum(byte)::BIGINT AS byte, sum(reenc)::BIGINT AS reenc, sum(shots)::BIGINT AS shots FROM {_RED} {'GROUP BY ' + by.rstrip(', ') if by else ''}))", "copy_share")


def doc_clusters(t: Tables) -> DataFrame:
    return duplicates.redundancy(doc_split(t).withColumn("cluster", F.col("loose")), "cluster", "digest", "loose", "cls", "split")


@query(f"SELECT cluster, cls, n, byte, reenc, shots, n_splits FROM {_RED}")
def a9_redundancy(t):
    return doc_clusters(t)


@query(_kinds(""))
def a10_redundancy_kind(t):
    return duplicates.redundancy_kind(doc_clusters(t), [])


@query(_kinds("cls, "))
def a11_redundancy_by_class(t):
    return duplicates.redundancy_kind(doc_clusters(t), ["cls"])


@query(f"""WITH bad AS (SELECT digest FROM {_CLASSED} GROUP BY digest HAVING count(DISTINCT cls) > 1), stay AS (SELECT * FROM {_CLASSED} WHERE digest NOT IN (SELECT digest FROM bad))
  SELECT key, cls, split FROM stay WHERE split = 'train' OR digest NOT IN (SELECT digest FROM stay WHERE split = 'train')""")
def u4_clean_export(t):
    return duplicates.clean_export(by_source(t), "key", "digest", "cls", "split").select("key", "cls", "split")


_NUMBERED = "(SELECT o_orderkey AS key, o_orderpriority AS cls, o_custkey % 50 AS prefix, o_orderkey // 2 AS num FROM orders)"


def numbered_orders(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("cls"), (F.col("o_custkey") % 50).alias("prefix"), F.floor(F.col("o_orderkey") / 2).alias("num"))


@query(f"SELECT prefix, num, count(DISTINCT cls) AS n_classes, count(*) AS n FROM {_NUMBERED} GROUP BY ALL HAVING count(DISTINCT cls) > 1")
def a22_number_conflict(t):
    return duplicates.number_conflicts(numbered_orders(t), "prefix", "num", "cls")


_ADJ = f"(SELECT a.prefix, a.num, a.key AS key_a, a.cls AS cls_a, b.key AS key_b, b.cls AS cls_b FROM {_NUMBERED} a JOIN {_NUMBERED} b ON a.prefix = b.prefix AND b.num = a.num + 1 AND a.cls <> b.cls)"


@query(f"SELECT * FROM {_ADJ}")
def j8_adjacent_cross_class(t):
    return duplicates.adjacent_across(numbered_orders(t), "key", "prefix", "num", "cls")


@query(f"WITH p AS ({_split(_NUMBERED)}) SELECT x.key_a, x.key_b FROM {_ADJ} x JOIN p a ON a.key = key_a JOIN p b ON b.key = key_b WHERE (a.split = 'train' AND b.split = 'test') OR (a.split = 'test' AND b.split = 'train')")
def j9_adjacent_straddle(t):
    parts = partition.stratified_split(numbered_orders(t), "cls", "key").select("key", "split")
    return duplicates.adjacent_straddling(duplicates.adjacent_across(numbered_orders(t), "key", "prefix", "num", "cls"), parts, "key").select("key_a", "key_b")


@query(rounded(f"""WITH p AS ({_split(_OR)}), one AS (SELECT cls, num, arg_max(split, key) AS split FROM p GROUP BY ALL), n AS (SELECT *, lead(num) OVER w AS nn, lead(split) OVER w AS ns FROM one WINDOW w AS (PARTITION BY cls ORDER BY num))
  SELECT cls, count(*) AS n_pairs, count(*) FILTER (split <> ns) AS n_crossing, 100.0 * count(*) FILTER (split <> ns) / count(*) AS pct, 100.0 * count(*) FILTER (split <> ns) / count(*) > 20 AS image_level FROM n WHERE nn - num = 1 GROUP BY cls""", "pct"))
def a23_numbering_adjacency(t):
    return duplicates.numbering_adjacency(partition.stratified_split(orders(t), "cls", "key"), ["cls"], "num", "split", "key")


_PG = r"(SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS cls, CASE WHEN url LIKE '%?%' THEN 'query' ELSE 'plain' END AS form, (length(html) // 1000)::BIGINT AS size FROM pages)"


def page_forms(t: Tables) -> DataFrame:
    form = F.when(F.col("url").like("%?%"), "query").otherwise("plain")
    return t.pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("cls"), form.alias("form"), F.floor(F.length("html") / 1000).alias("size"))


@query(f"SELECT cls, count(*) AS n, count(DISTINCT form) AS n_formats, count(DISTINCT size) AS n_sizes, count(DISTINCT form) > 1 AS mixed FROM {_PG} GROUP BY cls")
def a24_format_mix(t):
    return duplicates.format_mix(page_forms(t), "cls", "form", "size")


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, size) AS rank FROM (SELECT cls, size, count(*) AS n FROM {_PG} GROUP BY ALL)) WHERE rank <= 3")
def a24_top_sizes(t):
    return duplicates.top_values(page_forms(t), "cls", "size").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT o_orderpriority AS cls, count(*) AS n, min(o_totalprice) AS least, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS upper_median, max(o_totalprice) AS largest FROM orders GROUP BY 1")
def a25_value_profile(t):
    return duplicates.value_profile(t.orders.select(F.col("o_orderpriority").alias("cls"), "o_totalprice"), "cls", "o_totalprice")


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type AS model, count(*) AS n, count(value) AS n_gps FROM events GROUP BY ALL")
def a26_capture_summary(t):
    return t.events.groupBy(F.substring(F.col("ts").cast("string"), 1, 7).alias("month"), F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_gps"))


@query(rounded("SELECT lang AS cls, count(*) AS n_items, count(DISTINCT source) AS n_groups, count(*) / count(DISTINCT source)::DOUBLE AS ratio FROM documents GROUP BY lang ORDER BY ratio DESC, lang LIMIT 10", "ratio"))
def a28_class_groups(t):
    g = docs(t).groupBy("cls").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("source").alias("n_groups"))
    return g.withColumn("ratio", F.col("n_items") / F.col("n_groups")).orderBy(F.desc("ratio"), "cls").limit(10)


# --- similarity -----------------------------------------------------------------------------------------------
@query(f"SELECT key, h FROM {_EMH}")
def k1_sign_hash(t):
    return vectors(t).select("key", "h")


@query(f"SELECT a, b, cls, distance FROM {_HPAIRS} WHERE distance <= 20")
def k2_hamming_pairs(t):
    return similarity.hamming_pairs(vectors(t), "key", "cls", "h", 20).select("a", "b", "cls", "distance")


@query("SELECT doc_id AS key, md5(text) AS digest, md5(lower(regexp_replace(text, '\\s+', '', 'g'))) AS loose FROM documents".replace("\\\\", "\\"))
def k3_digests(t):
    return docs(t).select("key", "digest", "loose")


@query(rounded(f"SELECT key, list_sum(list_transform(v, lambda x: (x / (sqrt(list_dot_product(v, v)) + 1e-9)) * (x / (sqrt(list_dot_product(v, v)) + 1e-9)))) AS square FROM {_EM}", "square"))
def k5_unit_vectors(t):
    return vectors(t).withColumn("u", K.normalised(F.col("v"))).select("key", K.dot(F.col("u"), F.col("u")).alias("square"))


@query(rounded(f"SELECT a, b, cls, score FROM {_PAIRS} WHERE score >= 0.25", "score"))
def k6_cosine_pairs(t):
    return similarity.cosine_pairs(vectors(t), "key", "cls", "v", 0.25)


_PLACE = "(SELECT c_custkey AS key, c_custkey % 180 - 90.0::DOUBLE AS lat, (c_custkey * 7) % 360 - 180.0::DOUBLE AS lon FROM customer)"


@query(rounded(f"SELECT a.key, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) AS metres FROM {_PLACE} a JOIN {_PLACE} b ON b.key = a.key + 1", "metres"))
def k7_haversine(t):
    p = t.customer.select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 180 - 90.0).alias("lat"), ((F.col("c_custkey") * 7) % 360 - 180.0).alias("lon"))
    q = p.select((F.col("key") - 1).alias("key"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return p.join(q, "key").select("key", K.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("metres"))


@query(f"SELECT floor((score + 1) / (2.0::DOUBLE / 80))::BIGINT AS bin, count(*) AS n FROM {_PAIRS} GROUP BY 1")
def a29_similarity_hist(t):
    return similarity.histogram(vectors(t), "key", "cls", "v", -1.0, 1.0, 80)


@query(rounded(f"SELECT count(*) AS n_pairs, quantile_cont(score, 0.5) AS median, avg((score >= 0.25)::INT) AS share FROM {_PAIRS}", "median", "share"))
def a29_similarity_profile(t):
    return similarity.score_profile(vectors(t), "key", "cls", "v", 0.25)


_EMP = f"({_split(_EMH)})"


@query(f"SELECT a.key AS held_key, b.key AS train_key, a.cls AS held_cls, b.cls AS train_cls, bit_count(xor(a.h, b.h))::INT AS distance, a.cls = b.cls AS same_class FROM {_EMP} a JOIN {_EMP} b ON a.split <> 'train' AND b.split = 'train' AND bit_count(xor(a.h, b.h)) <= 16 AND a.key <> b.key")
def j6_heldout_vs_train_near(t):
    v = partition.stratified_split(vectors(t), "cls", "key")
    return similarity.near_held_out(v, "key", "cls", "h", "key", "split", 16)


@query(rounded(f"""WITH s AS {_EMP}, torn AS (SELECT p.* FROM {_HPAIRS} p JOIN s x ON x.key = p.a JOIN s y ON y.key = p.b WHERE p.distance <= 22 AND x.split <> y.split),
  n AS (SELECT cls, count(*) AS n_pairs FROM torn GROUP BY cls), i AS (SELECT cls, count(DISTINCT k) AS n_items FROM (SELECT cls, unnest([a, b]) AS k FROM torn) GROUP BY cls), w AS (SELECT cls, count(*) AS n_class FROM s GROUP BY cls)
  SELECT cls, n_pairs, n_items, n_class, 100.0 * n_items / n_class AS pct, 100.0 * n_items / n_class > 20 AS heavy FROM n JOIN i USING (cls) JOIN w USING (cls)""", "pct"))
def j7_near_within_class(t):
    v = partition.stratified_split(vectors(t), "cls", "key").drop("v")
    return similarity.near_across_splits(similarity.hamming_pairs(vectors(t), "key", "cls", "h", 22), v, "key", "cls", "split")


@query(_linked(_PAIRS, _EM, "score >= 0.25"))
def c2_single_linkage_cosine(t):
    v = vectors(t)
    return similarity.single_linkage(v, similarity.cosine_pairs(v, "key", "cls", "v", 0.25, linking=True), "key", "cls")


@query(_linked(_HPAIRS, _EM, "distance <= 20"))
def c2_single_linkage_hamming(t):
    v = vectors(t)
    return similarity.single_linkage(v, similarity.hamming_pairs(v, "key", "cls", "h", 20, linking=True), "key", "cls")


TAUS = [0.2, 0.25, 0.3, 0.35, 0.4]


def swept(t: Tables) -> DataFrame:
    """Written once within a scope, for all queries that ask for it."""
    v = vectors(t)
    return kept("sweep", t.embeddings, tuple(TAUS), lambda: similarity.sweep(v, similarity.cosine_pairs(v, "key", "cls", "v", min(TAUS), linking=True), "key", "cls", "score", TAUS))


_SWEPT = "(" + " UNION ALL ".join(f"SELECT {x}::DOUBLE AS threshold, * FROM ({_linked(_PAIRS, _EM, f'score >= {x}')})" for x in TAUS) + ")"


@query(f"SELECT threshold, count(DISTINCT cluster) AS n_clusters, count(*) AS n_items FROM {_SWEPT} GROUP BY threshold")
def c6_threshold_sweep(t):
    return swept(t).groupBy("threshold").agg(F.countDistinct("cluster").alias("n_clusters"), F.count(F.lit(1)).alias("n_items"))


@query()
def c3_complete_linkage(t):
    return similarity.greedy_linkage(vectors(t), "key", "cls", "v", 0.2)


@query()
def c4_average_linkage(t):
    return similarity.greedy_linkage(vectors(t), "key", "cls", "h", 26, "average")


# --- calibration ----------------------------------------------------------------------------------------------
_CAL = f"(SELECT *, concat_ws(':', cls, key % 7) AS truth FROM {_SWEPT})"


def calibrated(t: Tables) -> DataFrame:
    return swept(t).withColumn("truth", F.concat_ws(":", F.col("cls").cast("string"), (F.col("key") % 7).cast("string")))


@query(f"""WITH g AS (SELECT threshold, cls, cluster, count(*) AS n FROM {_SWEPT} GROUP BY ALL), p AS (SELECT threshold, cls, sum(n) AS items, count(*) AS groups, max(n) AS largest FROM g GROUP BY ALL),
  r AS (SELECT threshold, sum(groups)::BIGINT AS n_groups, CASE WHEN sum(items) / sum(groups) > 10 THEN 'mean size' ELSE arg_min('large group in ' || cls, cls) FILTER (largest > 0.25 * items) END AS reason FROM p GROUP BY threshold)
  SELECT threshold, n_groups, reason IS NOT NULL AS degenerate, reason FROM r""")
def a12_structural_degeneracy(t):
    return calibrate.structural_degeneracy(swept(t), "cls", "cluster", ["threshold"])


_C2 = "n * (n - 1) // 2"


def _paired(within: str) -> str:
    return f"""(SELECT threshold, tp, same_truth, same_pred, all_pairs FROM
    (SELECT threshold, sum({_C2})::BIGINT AS tp FROM (SELECT threshold, truth, cluster, count(*) AS n FROM {_CAL} GROUP BY ALL) GROUP BY 1) JOIN
    (SELECT threshold, sum({_C2})::BIGINT AS same_truth FROM (SELECT threshold, truth, count(*) AS n FROM {_CAL} GROUP BY ALL) GROUP BY 1) USING (threshold) JOIN
    (SELECT threshold, sum({_C2})::BIGINT AS same_pred FROM (SELECT threshold, cluster, count(*) AS n FROM {_CAL} GROUP BY ALL) GROUP BY 1) USING (threshold) JOIN
    (SELECT threshold, sum({_C2})::BIGINT AS all_pairs FROM (SELECT threshold, {within} count(*) AS n FROM {_CAL} GROUP BY ALL) GROUP BY 1) USING (threshold))"""


_SCORED = f"(SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1, precision / nullif(chance, 0) AS lift FROM (SELECT *, tp / nullif(same_truth, 0)::DOUBLE AS recall, tp / nullif(same_pred, 0)::DOUBLE AS precision, same_truth / nullif(all_pairs, 0)::DOUBLE AS chance FROM {_paired('cls,')}))"


@query(rounded(f"SELECT threshold, tp, same_truth, same_pred, all_pairs, recall, precision, f1, chance, lift FROM {_SCORED}", "recall", "precision", "f1", "chance", "lift"))
def a14_pair_scores(t):
    return calibrate.pair_scores(calibrate.pair_counts(calibrated(t), "truth", "cluster", "cls", ["threshold"]))


@query(rounded(f"SELECT threshold, (tp - e) / ((same_truth + same_pred) / 2.0::DOUBLE - e) AS ari FROM (SELECT *, same_truth::DOUBLE * same_pred / all_pairs AS e FROM {_paired('')})", "ari"))
def a15_ari(t):
    return calibrate.adjusted_rand(calibrated(t), "truth", "cluster", ["threshold"])


@query()
def a16_ami(t):
    return calibrate.adjusted_mutual_information(calibrated(t).where("threshold = 0.25"), "truth", "cluster")


_CSEED = f"(SELECT * FROM {_CAL}, (SELECT unnest([0, 1, 2]) AS seed))"
_DET = f"""WITH p AS ({_split(_CSEED, 'seed', 'threshold, seed, cls')}), rt AS (SELECT DISTINCT threshold, seed, truth FROM p WHERE split = 'train'), pt AS (SELECT DISTINCT threshold, seed, cluster FROM p WHERE split = 'train'),
  f AS (SELECT p.threshold, p.seed, rt.truth IS NOT NULL AS r, pt.cluster IS NOT NULL AS q FROM p LEFT JOIN rt ON rt.threshold = p.threshold AND rt.seed = p.seed AND rt.truth = p.truth LEFT JOIN pt ON pt.threshold = p.threshold AND pt.seed = p.seed AND pt.cluster = p.cluster WHERE split = 'test'),
  s AS (SELECT threshold, seed, count(*) FILTER (r AND q) AS tp, count(*) FILTER (NOT r AND q) AS fp, count(*) FILTER (r AND NOT q) AS fn, count(*) FILTER (NOT r AND NOT q) AS tn, avg(r::INT) AS rr, avg(q::INT) AS pr FROM f GROUP BY ALL),
  d AS (SELECT threshold, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, avg(rr) AS reference_rate, avg(pr) AS predicted_rate FROM s GROUP BY threshold),
  e AS (SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS recall, tp / nullif(tp + fp, 0)::DOUBLE AS precision FROM d)
  SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1, predicted_rate / nullif(reference_rate, 0) AS marginal_ratio_not_a_detection_rate FROM e"""


def detected(t: Tables) -> DataFrame:
    parts = partition.stratified_split(vectors(t).select("key", "cls"), "cls", "key", SEEDS).select("key", "seed", "split")
    return calibrate.detection(calibrated(t).join(parts, "key"), "truth", "cluster", ["threshold"])


@query(rounded(_DET, "reference_rate", "predicted_rate", "recall", "precision", "f1", "marginal_ratio_not_a_detection_rate"))
def a17_detection_contingency(t):
    return detected(t)


@query(rounded(f"SELECT threshold, f1 FROM ({_DET}) ORDER BY f1 DESC NULLS LAST, threshold LIMIT 1", "f1"))
def a18_operating_point(t):
    return calibrate.operating_point(detected(t), "f1", "threshold").select("threshold", "f1")


@query(f"SELECT threshold, count(DISTINCT cluster) < 0.5 * count(DISTINCT truth) AS degenerate FROM {_CAL} GROUP BY threshold")
def a13_truth_degeneracy(t):
    n = calibrated(t).groupBy("threshold").agg(F.countDistinct("cluster").alias("p"), F.countDistinct("truth").alias("q"))
    return n.select("threshold", calibrate.truth_degeneracy(F.col("p"), F.col("q"), F.lit(0.0), F.lit(0.0)).alias("degenerate"))


@query(f"SELECT threshold, CASE WHEN recall >= 0.6 AND lift >= 2 THEN 'recovered' WHEN recall < 0.2 OR lift < 1.5 THEN 'fails' ELSE 'partial' END AS verdict FROM {_SCORED}")
def m17_recovery_verdict(t):
    s = calibrate.pair_scores(calibrate.pair_counts(calibrated(t), "truth", "cluster", "cls", ["threshold"]))
    return s.select("threshold", calibrate.recovery_verdict(F.col("recall"), F.col("lift")).alias("verdict"))


# --- metrics --------------------------------------------------------------------------------------------------
def cells(t: Tables) -> DataFrame:
    return metrics.confusion(predictions(t), "y_true", "y_pred", ["model"])


def order_cells(t: Tables) -> DataFrame:
    return metrics.confusion(order_predictions(t), "y_true", "y_pred", ["model"])


@query(_macro(_CONF))
def m1_macro_union(t):
    return metrics.macro_union(cells(t), ["model"])


@query(_macro(_OCONF, "SELECT unnest(['O', 'F']) AS label"))
def m2_macro_labelset(t):
    return metrics.macro_labels(order_cells(t), ["O", "F"], ["model"])


@query(_macro(f"(SELECT * FROM {_OCONF} WHERE y_true IN ('O', 'F'))", "SELECT unnest(['O', 'F']) AS label"))
def m3_macro_subset(t):
    return metrics.macro_subset(order_cells(t), ["O", "F"], ["model"])


_OWN = f"(SELECT * FROM {_OCONF} WHERE y_true IN ('O', 'F'))"
_OF = "SELECT unnest(['O', 'F']) AS label"


@query(rounded(f"SELECT a.model, a.f AS f1_union, b.f AS f1_labels, b.f - a.f AS artefact FROM (SELECT model, avg(f1) AS f FROM ({_per_class(_OWN)}) GROUP BY 1) a JOIN (SELECT model, avg(f1) AS f FROM ({_per_class(_OWN, _OF)}) GROUP BY 1) b USING (model)", "f1_union", "f1_labels", "artefact"))
def m2_label_set_artefact(t):
    return metrics.label_set_artefact(order_cells(t), ["O", "F"], ["model"])


@query(rounded(f"SELECT m.model, x.y_true, y.y_pred, coalesce(c.n, 0) AS n, coalesce(coalesce(c.n, 0) / nullif(sum(coalesce(c.n, 0)) OVER (PARTITION BY m.model, x.y_true), 0)::DOUBLE, 0) AS row_share FROM (SELECT DISTINCT model FROM {_OCONF}) m, (SELECT unnest(['F', 'O', 'P']) AS y_true) x, (SELECT unnest(['F', 'O', 'P']) AS y_pred) y LEFT JOIN {_OCONF} c ON c.model = m.model AND c.y_true = x.y_true AND c.y_pred = y.y_pred", "row_share"))
def m4_confusion(t):
    return metrics.dense_confusion(order_cells(t), ["F", "O", "P"], ["model"])


@query(rounded(_per_class(_OCONF), "precision", "recall", "f1"))
def m5_per_class(t):
    return metrics.per_class(order_cells(t), ["model"])


@query(rounded("SELECT k, avg(2 * p / k / (p + 1.0::DOUBLE / k)) AS uniform, avg(p) AS prior, 2 * max(p) / (1 + max(p)) / k AS majority FROM (SELECT n / sum(n) OVER ()::DOUBLE AS p, count(*) OVER () AS k FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)) GROUP BY k", "uniform", "prior", "majority"))
def m6_chance_baselines(t):
    return metrics.chance(docs(t).groupBy("cls").agg(F.count(F.lit(1)).alias("n")))


_POOL = f"(SELECT y_true, y_pred, sum(n) AS n FROM {_OCONF} GROUP BY ALL)"
_SPREAD = f"""SELECT y_true, sum(n)::BIGINT AS n, sum(n) FILTER (y_true = y_pred) / sum(n)::DOUBLE AS recall, arg_max(y_pred, n * 1000 + ascii(y_pred)) FILTER (y_true <> y_pred) AS worst, max(p) AS worst_share, CASE WHEN count(p) = 1 THEN 0 WHEN count(p) > 1 THEN sum(-p * ln(p)) / ln(count(p)) END AS entropy
  FROM (SELECT *, CASE WHEN y_true <> y_pred THEN n / sum(CASE WHEN y_true <> y_pred THEN n END) OVER (PARTITION BY y_true)::DOUBLE END AS p FROM {_POOL}) GROUP BY y_true"""


def pooled(t: Tables) -> DataFrame:
    return order_cells(t).groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))


@query(rounded(f"SELECT y_true, n, recall, worst, worst_share FROM ({_SPREAD})", "recall", "worst_share"))
def m7_pooled_confusion(t):
    return metrics.error_spread(pooled(t)).select("y_true", "n", "recall", "worst", "worst_share")


@query(rounded(f"SELECT y_true, entropy FROM ({_SPREAD})", "entropy"))
def k9_error_entropy(t):
    return metrics.error_spread(pooled(t)).select("y_true", "entropy")


@query(rounded(f"SELECT model, y_true, sum(n)::BIGINT AS n, sum(n) FILTER (y_true = y_pred) / sum(n)::DOUBLE AS recall FROM {_OCONF} WHERE y_true = 'F' GROUP BY ALL", "recall"))
def m8_target_rows(t):
    return metrics.error_spread(order_cells(t).where("y_true = 'F'"), ["model"]).select("model", "y_true", "n", "recall").orderBy("recall")


@query(f"""WITH s AS ({_SPREAD}), c AS (SELECT avg(100 * recall) AS m FROM s) SELECT y_true, CASE WHEN 100 * recall < m - 10 AND (100 * worst_share > 60 OR entropy < 0.6) THEN 'mapping suspect' WHEN 100 * recall < m - 10 THEN 'hard class' WHEN 100 * worst_share > 60 OR entropy < 0.6 THEN 'one confusion' ELSE 'consistent' END AS verdict FROM s, c""")
def m9_mapping_verdict(t):
    s = metrics.error_spread(pooled(t))
    mean = s.agg(F.avg(100 * F.col("recall")).alias("m"))
    return s.crossJoin(F.broadcast(mean)).select("y_true", metrics.mapping_verdict(100 * F.col("recall"), F.col("m"), 100 * F.col("worst_share"), F.col("entropy")).alias("verdict"))


@query(rounded(f"SELECT b, c, pow(abs(b - c) - 1, 2) / nullif(b + c, 0)::DOUBLE AS chi2 FROM (SELECT count(*) FILTER (x.r AND NOT y.r) AS b, count(*) FILTER (NOT x.r AND y.r) AS c FROM (SELECT item, y_true = y_pred AS r FROM {_PR} WHERE model = 'm1') x JOIN (SELECT item, y_true = y_pred AS r FROM {_PR} WHERE model = 'm2') y USING (item))", "chi2"))
def m10_mcnemar(t):
    p = predictions(t).where("y_pred is not null").withColumn("r", F.col("y_true") == F.col("y_pred"))
    both = p.where("model = 'm1'").select("item", F.col("r").alias("ra")).join(p.where("model = 'm2'").select("item", F.col("r").alias("rb")), "item")
    return metrics.mcnemar(both, "ra", "rb")


@query(f"SELECT mode, model, format('{{:.2f}}±{{:.2f}}', avg(macro_F1), stddev_samp(macro_F1)) AS macro_F1 FROM {_RUN} GROUP BY ALL")
def m11_mean_sd_text(t):
    return runs.mean_sd_text(line_runs(t), ["mode", "model"], "macro_F1")


@query(rounded(f"SELECT model, avg(macro_F1) FILTER (seed = 1) AS s1, avg(macro_F1) FILTER (seed = 2) AS s2, avg(macro_F1) FILTER (seed = 3) AS s3 FROM {_RUN} GROUP BY model", "s1", "s2", "s3"))
def m12_pivot(t):
    return runs.pivoted(line_runs(t), "model", "seed", "macro_F1", [1, 2, 3]).toDF("model", "s1", "s2", "s3")


@query(rounded(f"SELECT *, source_mean - target_mean AS gap, 100.0 * (source_mean - target_mean) / nullif(source_mean, 0) AS gap_pct FROM (SELECT model, avg(macro_F1) FILTER (mode = 'image') AS source_mean, avg(macro_F1) FILTER (mode = 'group') AS target_mean FROM {_RUN} GROUP BY model)", "source_mean", "target_mean", "gap", "gap_pct"))
def m13_gap(t):
    return runs.transfer_gap(line_runs(t), "model", "mode", "macro_F1", "image", "group")


def _avg_rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(rounded(f"SELECT count(*) AS n, corr(macro_F1, accuracy) AS pearson, corr(ra, rb) AS spearman FROM (SELECT *, {_avg_rank('macro_F1')} AS ra, {_avg_rank('accuracy')} AS rb FROM {_RUN})", "pearson", "spearman"))
def m14_correlation(t):
    return metrics.correlations(line_runs(t), "macro_F1", "accuracy")


@query(rounded(f"""WITH p AS (SELECT seed, avg(macro_F1) FILTER (mode = 'image') - avg(macro_F1) FILTER (mode = 'group') AS d FROM {_RUN} GROUP BY seed)
  SELECT count(d) AS n, avg(d) AS mean, avg(d) - 2.44691 * stddev_samp(d) / sqrt(count(d)) AS lo, avg(d) + 2.44691 * stddev_samp(d) / sqrt(count(d)) AS hi FROM p""", "mean", "lo", "hi"))
def m15_paired_contrast(t):
    p = line_runs(t).groupBy("seed").pivot("mode", ["group", "image"]).agg(F.avg("macro_F1"))
    return metrics.paired_contrast(p, "group", "image")


@query(rounded(f"SELECT mode, model, {_avg_rank('f').replace('OVER (ORDER', 'OVER (PARTITION BY mode ORDER').replace('PARTITION BY f', 'PARTITION BY mode, f')} AS rank FROM (SELECT mode, model, avg(macro_F1) AS f FROM {_RUN} GROUP BY ALL)", "rank"))
def w4_regime_ranks(t):
    m = line_runs(t).groupBy("mode", "model").agg(F.avg("macro_F1").alias("f"))
    return m.select("mode", "model", metrics.average_rank(F.col("f"), ["mode"], F.col("f")).alias("rank"))


# --- runs -----------------------------------------------------------------------------------------------------
@query(rounded(f"SELECT mode, model, avg(macro_F1) AS macro_F1_mean, stddev_samp(macro_F1) AS macro_F1_sd, count(macro_F1) AS macro_F1_n, avg(accuracy) AS accuracy_mean, stddev_samp(accuracy) AS accuracy_sd, count(accuracy) AS accuracy_n FROM {_RUN} GROUP BY ALL", "macro_F1_mean", "macro_F1_sd", "accuracy_mean", "accuracy_sd"))
def r1_run_summary(t):
    return runs.run_summary(line_runs(t).drop("seed"), ["mode", "model"])


_INFL = f"(SELECT model, avg(macro_F1) FILTER (mode = 'group') AS group_mean, avg(macro_F1) FILTER (mode = 'image') AS image_mean, avg(macro_F1) FILTER (mode = 'image') - avg(macro_F1) FILTER (mode = 'group') AS inflation_pp FROM {_RUN} GROUP BY model)"


@query(rounded(f"SELECT * FROM {_INFL}", "group_mean", "image_mean", "inflation_pp"))
def r2_paired_inflation(t):
    r = line_runs(t)
    return runs.paired_inflation(r, "model", "mode", runs.headline([c for c in r.columns if c not in ("mode", "model", "seed")]))


@query(rounded(f"SELECT avg(inflation_pp) AS mean_pp, min(inflation_pp) AS least_pp, max(inflation_pp) AS most_pp FROM {_INFL}", "mean_pp", "least_pp", "most_pp"))
def r2_inflation_range(t):
    return runs.inflation_range(runs.paired_inflation(line_runs(t), "model", "mode", "macro_F1"))


@query(rounded(f"SELECT *, CASE WHEN spread > 15 THEN 'wide' WHEN spread <= 10 THEN 'stable' ELSE 'moderate' END AS verdict FROM (SELECT model, count(*) AS n, min(macro_F1) AS least, max(macro_F1) AS most, max(macro_F1) - min(macro_F1) AS spread FROM {_RUN} GROUP BY model)", "least", "most", "spread"))
def r4_sweep_spread(t):
    return runs.sweep_spread(line_runs(t), "macro_F1", ["model"])


@query(f"WITH k AS ({_kinds('cls, ')}) SELECT cls, kind FROM k WHERE kind <> 'copy-dominated'")
def r3_usable_rows(t):
    kinds = duplicates.redundancy_kind(doc_clusters(t), ["cls"]).withColumn("degenerate", F.lit(False))
    return runs.usable(kinds, "degenerate", "kind").select("cls", "kind")


@query(rounded(f"SELECT mode, count(*) AS n, avg(macro_F1) AS mean, stddev_samp(macro_F1) AS sd, CASE WHEN avg(macro_F1) > 70 THEN 'high' WHEN avg(macro_F1) > 45 THEN 'middle' ELSE 'low' END AS band FROM {_RUN} GROUP BY mode", "mean", "sd"))
def r5_condition_bands(t):
    return runs.condition_bands(line_runs(t), ["mode"], "macro_F1")


@query(rounded(f"SELECT * FROM {_RUN} WHERE model <> 'A' UNION ALL SELECT mode, model, seed, macro_F1 + 1, accuracy FROM {_RUN} WHERE model = 'A'", "macro_F1", "accuracy"))
def u2_replace_model_rows(t):
    r = line_runs(t)
    return runs.replaced(r, r.where("model = 'A'").withColumn("macro_F1", F.col("macro_F1") + 1), "model")


def flagship(t: Tables) -> DataFrame:
    """Events grouped by gaps, split item by item: how many test events have a sibling in train."""
    return j2_sibling_leakage(t)


from . import files, further  # noqa: E402, F401  (they register their queries, made of the carriers above)
