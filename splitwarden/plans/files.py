"""Queries over files: trees, manifests, archives and workbooks made of table rows, read back by the sources.

Small trees take their names from nation and region and are written by the driver; tables of any size are written
and read back by Spark. Everything goes to the shared folder.
"""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import keys
from ..operators import sessionize
from ..sources import scan, tables
from ..sources.shared import new_path
from . import catalogue as C
from .registry import Tables, query, rounded

JPEG = b"\xff\xd8\xff\xe0"
_N = "(SELECT n_nationkey AS k, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey)"
_S = "CASE WHEN k % 5 = 0 THEN 'test' WHEN k % 5 = 1 THEN 'val' ELSE 'train' END"


def nations(t: Tables) -> list:
    """k, n, r: the 25 nations with their regions."""
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"), F.col("r_name").alias("r")).orderBy("k").collect()


def split_of(k: int) -> str:
    return "test" if k % 5 == 0 else "val" if k % 5 == 1 else "train"


def tree(t: Tables, files: dict[str, bytes]) -> str:
    """A new folder with these files."""
    root, sc = new_path(t.spark, "tree"), t.spark.sparkContext
    fs = None
    for name, data in files.items():
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        fs = fs or path.getFileSystem(sc._jsc.hadoopConfiguration())
        out = fs.create(path)
        out.write(bytearray(data))
        out.close()
    return root


def last(path, n: int = 1):
    """The n-th name of a path from its end."""
    return F.element_at(F.split(path, "/"), -n)


# --- scans ----------------------------------------------------------------------------------------------------
@query(f"SELECT {_S} AS split, r AS cls, n || '.JPG' AS file FROM {_N} WHERE k % 7 <> 3")
def s1_scan_dataset(t):
    folder = {"train": "Training", "val": "valid", "test": "Test-Set"}
    files = {f"{folder[split_of(x.k)]}/{x.r}/{'more/' if x.k % 3 == 0 else ''}{x.n}.{'txt' if x.k % 7 == 3 else 'JPG'}": JPEG for x in nations(t)}
    return scan.scan_dataset(t.spark, tree(t, files)).select("split", "cls", "file")


@query(f"SELECT '__none__' AS split, r AS cls, n || '.png' AS file FROM {_N}")
def s1a_scan_flat(t):
    return scan.scan_dataset(t.spark, tree(t, {f"{x.r}/{x.n}.png": b"x" for x in nations(t)})).select("split", "cls", "file")


@query(f"SELECT 'part' || (k % 3) AS split, r AS cls, n || '.bmp' AS file FROM {_N} WHERE k % 4 <> 0")
def s2_scan_positional(t):
    files = {f"part{x.k % 3}/{x.r}/{'deep/' if x.k % 4 == 0 else ''}{x.n}.bmp": b"x" for x in nations(t)}
    return scan.scan_positional(t.spark, tree(t, files)).select("split", "cls", "file")


@query(f"SELECT {_S} AS split, r AS cls, n || CASE WHEN k % 2 = 0 THEN '.jpg.jpg' ELSE '.jpg' END AS file, k % 2 = 0 AS doubled FROM {_N} WHERE r IN ('AFRICA', 'EUROPE')")
def s3_scan_splits(t):
    files = {f"{split_of(x.k)}/{x.r}/{x.n}.jpg{'.jpg' if x.k % 2 == 0 else ''}": b"x" for x in nations(t)} | {"other/AFRICA/no.jpg": b"x"}
    return scan.scan_splits(t.spark, tree(t, files), ["africa", "Europe"]).select("split", "cls", "file", "doubled")


@query(f"SELECT r AS cls, n || '.png' AS file, md5(n) AS digest FROM {_N} WHERE r <> 'ASIA'")
def s4_scan_excluded(t):
    items = scan.scan_dataset(t.spark, tree(t, {f"{x.r}/{x.n}.png": x.n.encode() for x in nations(t)}), exclude=["Asia"], content=True)
    return items.select("cls", "file", K.digest(F.col("content")).alias("digest"))


@query(f"""SELECT CASE WHEN k % 6 = 1 THEN 'UNREADABLE' ELSE 'NON_IMAGE' END AS kind, n || CASE WHEN k % 6 = 1 THEN '.jpg' ELSE '.txt' END AS file FROM {_N} WHERE k % 6 IN (1, 2) UNION ALL SELECT 'MISSING_SPLIT', 'extra'""")
def s5_scan_problems(t):
    files = {f"{split_of(x.k)}/{x.r}/{x.n}.{'txt' if x.k % 6 == 2 else 'jpg'}": b"GIF89a" if x.k % 6 == 1 else JPEG for x in nations(t)}
    problems = scan.scan_with_problems(t.spark, tree(t, files), ("train", "val", "test", "extra"))[1]
    return problems.select("kind", last(F.col("path")).alias("file"))


@query(f"SELECT CASE WHEN k % 6 = 1 THEN 'UNREADABLE' ELSE 'NON_IMAGE' END AS kind, count(*) AS n FROM {_N} WHERE k % 6 IN (1, 2) GROUP BY 1")
def p6_dropped_files(t):
    """How many files a scan sets aside, by the kind of problem; the others are items."""
    files = {f"{split_of(x.k)}/{x.r}/{x.n}.{'txt' if x.k % 6 == 2 else 'jpg'}": b"GIF89a" if x.k % 6 == 1 else JPEG for x in nations(t)}
    return scan.dropped(scan.scan_with_problems(t.spark, tree(t, files))[1])


@query(f"SELECT DISTINCT {_S} AS split, r AS cls, n[:1] || '.jpg' AS file FROM {_N}")
def s6_split_keys(t):
    files = {f"{split_of(x.k)}/{x.r}/copy{x.k}/{x.n[:1]}.jpg": b"x" for x in nations(t)}
    return scan.split_keys(scan.scan_dataset(t.spark, tree(t, files)))


@query(f"SELECT DISTINCT 'set' || k % 4 AS root FROM {_N} WHERE k % 4 > 0")
def s7_partition_roots(t):
    """Three partitions, and a folder without a test part."""
    files = {f"set{x.k % 4}/{split_of(x.k) if x.k % 4 else 'train'}/c/{x.n}.jpg": b"x" for x in nations(t)}
    return scan.partition_roots(t.spark, tree(t, files)).select(last(F.col("root")).alias("root"))


@query(f"SELECT CASE WHEN k % 5 > 0 THEN r || '.zip' END AS archive, n || '.jpg' AS member, n AS content FROM {_N}")
def s8_archive_members(t):
    rows, files = nations(t), {}
    for region in sorted({x.r for x in rows}):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("in/readme.md", "no image")
            for x in rows:
                if x.r == region and x.k % 5:
                    z.writestr(f"in/{x.n}.jpg", x.n)
        files[f"{region}.zip"] = data.getvalue()
    files |= {f"loose/{x.n}.jpg": x.n.encode() for x in rows if x.k % 5 == 0}
    found = scan.archive_members(t.spark, tree(t, files))
    return found.select(last(F.col("archive")).alias("archive"), last(F.col("member")).alias("member"), F.col("content").cast("string").alias("content"))


@query(f"SELECT r AS cls, n || '.png' AS file, CASE r WHEN 'ASIA' THEN 'east' ELSE 'west' END AS label FROM {_N} WHERE r IN ('ASIA', 'EUROPE', 'AMERICA')")
def s16_mapped_classes(t):
    items = scan.scan_dataset(t.spark, tree(t, {f"{x.r}/{x.n}.png": b"x" for x in nations(t)}))
    return scan.mapped_classes(items, {"ASIA": "east", "EUROPE": "west", "AMERICA": "west"}).select("cls", "file", "label")


@query(f"SELECT key, digest FROM {C._DOC}")
def s18_cached_digests(t):
    """A cache of digests, half of it from an earlier call: only rows that it lacks are added."""
    items, path = C.docs(t).select("key", "digest"), new_path(t.spark, "cache")
    scan.stored(items.where("key % 2 = 0"), path, ["key"])
    return scan.stored(items, path, ["key"]).select("key", "digest")


# --- readers and sinks ----------------------------------------------------------------------------------------
def manifest_of(t: Tables) -> DataFrame:
    return t.documents.select(F.concat(F.lit("s:"), "source").alias("session"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file"), F.col("lang").alias("cls"))


_MANIFEST = "(SELECT lang AS cls, doc_id || '.jpg' AS file, 's:' || source AS session FROM documents)"


@query(f"SELECT * FROM {_MANIFEST}")
def s9_read_manifest(t):
    path = new_path(t.spark, "manifest")
    tables.write_csv(manifest_of(t), path)
    return tables.read_manifest(t.spark, path).select("cls", "file", "session")


@query(f"SELECT k + 1 AS row, unnest(['nation', 'region', 'key']) AS \"column\", unnest([n, r, k::VARCHAR]) AS value FROM {_N}")
def s10_read_xlsx(t):
    rows = nations(t)
    shared = sorted({x.r for x in rows} | {"nation", "region", "key"})
    cell = lambda c, i, v: f'<c r="{c}{i}" t="s"><v>{shared.index(v)}</v></c>' if v in shared else f'<c r="{c}{i}"><v>{v}</v></c>' if v.isdigit() else f'<c r="{c}{i}" t="inlineStr"><is><t>{v}</t></is></c>'
    lines = [("nation", "region", "key"), *((x.n, x.r, str(x.k)) for x in rows)]
    body = "".join(f'<row r="{i}">' + "".join(cell(c, i, v) for c, v in zip("ABC", line, strict=True)) + "</row>" for i, line in enumerate(lines, 1))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return tables.read_xlsx(t.spark, tree(t, {"book.xlsx": data.getvalue()}) + "/book.xlsx").select("row", "column", "value")


@query(f"SELECT r AS cls, lower(n) AS key, 'leaf' || (k % 4) AS leaf FROM {_N} UNION ALL SELECT 'second', lower(n), 'leaf9' FROM {_N} WHERE k % 6 = 0")
def s11_read_leaf_map(t):
    leaves = {f" {x.n} ": [f"{x.r}:::leaf{x.k % 4}"] + (["second:::leaf9"] if x.k % 6 == 0 else []) for x in nations(t)}
    return tables.read_leaf_map(t.spark, tree(t, {"map.json": json.dumps(leaves).encode()}))


@query(f"SELECT m.model, x.y_true, y.y_pred, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT model FROM {C._OCONF}) m, (SELECT unnest(['F', 'O', 'P']) AS y_true) x, (SELECT unnest(['F', 'O', 'P']) AS y_pred) y LEFT JOIN {C._OCONF} c ON c.model = m.model AND c.y_true = x.y_true AND c.y_pred = y.y_pred")
def s11_read_confusion(t):
    names = ["F", "O", "P"]
    cells = {(x.model, x.y_true, x.y_pred): x.n for x in C.order_cells(t).collect()}
    data = {"class_names": names, "confusion": {m: [[cells.get((m, a, b), 0) for b in names] for a in names] for m in sorted({m for m, _, _ in cells})}}
    return tables.read_confusion(t.spark, tree(t, {"confusion.json": json.dumps(data).encode()}) + "/confusion.json")


@query(f"SELECT x.y_true, y.y_pred, coalesce(sum(c.n), 0)::BIGINT AS n FROM (SELECT unnest(['F', 'O', 'P']) AS y_true) x, (SELECT unnest(['F', 'O', 'P']) AS y_pred) y LEFT JOIN {C._OCONF} c ON c.y_true = x.y_true AND c.y_pred = y.y_pred GROUP BY ALL")
def s11_read_confusion_csv(t):
    """The pooled matrix of all models, written without a header."""
    names = ["F", "O", "P"]
    cells = {(x.y_true, x.y_pred): x.n for x in C.order_cells(t).groupBy("y_true", "y_pred").agg(F.sum("n").alias("n")).collect()}
    lines = "\n".join(",".join(str(cells.get((a, b), 0)) for b in names) for a in names)
    return tables.read_confusion_csv(t.spark, tree(t, {"matrix.csv": lines.encode()}) + "/matrix.csv", names)


@query(rounded("SELECT l_returnflag AS model, l_linenumber - 1 AS epoch, avg(l_quantity) AS train_loss, avg(l_discount) AS val_loss, avg(l_tax) AS train_acc, count(*)::DOUBLE AS val_acc FROM lineitem GROUP BY ALL", "train_loss", "val_loss", "train_acc", "val_acc"))
def s11b_read_history(t):
    rows = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("train_loss"), F.avg("l_discount").alias("val_loss"), F.avg("l_tax").alias("train_acc"), F.count(F.lit(1)).cast("double").alias("val_acc")).orderBy("l_linenumber").collect()
    names = ("train_loss", "val_loss", "train_acc", "val_acc")
    files = {f"{m}.json": json.dumps({c: [x[c] for x in rows if x.l_returnflag == m] for c in names}).encode() for m in {x.l_returnflag for x in rows}}
    from ..operators.runs import histories

    return histories(tables.read_history(t.spark, tree(t, files)), ["model"]).select("model", "epoch", *names)


@query(rounded(f"SELECT n AS path, (k + 1) / (sqrt((k + 1) * (k + 1) + 4.0::DOUBLE) + 1e-9) AS x, 2 / (sqrt((k + 1) * (k + 1) + 4.0::DOUBLE) + 1e-9) AS y, 'w1' AS weights FROM {_N}", "x", "y"))
def s12_read_npz(t):
    rows = nations(t)
    data = io.BytesIO()
    np.savez(data, E=np.array([[x.k + 1, 2] for x in rows], np.float32), paths=np.array([x.n for x in rows]), weights="w1")
    items = t.nation.select(F.col("n_name").alias("path"))
    got = tables.embeddings_for(items, tables.read_npz(t.spark, tree(t, {"e.npz": data.getvalue()}) + "/e.npz"))
    return got.select("path", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), "weights")


@query(rounded(f"SELECT mode, seed, model, macro_F1 FROM {C._RUN} WHERE seed <> 3", "macro_F1"))
def s13_run_folders(t):
    rows, files = C.line_runs(t).collect(), {}
    for mode, seed in {(x["mode"], x.seed) for x in rows}:
        own = [x for x in rows if (x["mode"], x.seed) == (mode, seed)]
        files[f"{mode}_s{seed}/table.csv"] = ("model,macro_F1\n" + "".join(f"{x.model},{x.macro_F1!r}\n" for x in own) + "mean ± sd,1\n").encode()
        if seed != 3:
            files[f"{mode}_s{seed}/DONE"] = b"done"
    files["notes_s1/table.csv"] = b"model,macro_F1\nx,1\n"
    return tables.read_runs(t.spark, tree(t, files), "table.csv", ("model",), ("model", "mean")).select("mode", "seed", "model", "macro_F1")


@query(rounded(f"SELECT mode, model, seed::DOUBLE AS seed, macro_F1, accuracy FROM {C._RUN}", "macro_F1", "accuracy"))
def s14_csv_sink(t):
    path = new_path(t.spark, "results")
    tables.write_csv(C.line_runs(t), path)
    return tables.read_results(t.spark, path, ("mode", "model"))


@query("SELECT line FROM (SELECT 0 AS i, '| region | n |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT 2, '| ' || r || ' | ' || count(*) || ' |' FROM " + _N + " GROUP BY r)")
def s14_markdown(t):
    table = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    return t.spark.createDataFrame([(x,) for x in tables.markdown(table).split("\n")], "line string")


@query(f"SELECT key, cls, split FROM {C._DOCP}")
def s15_tree_sink(t):
    path = new_path(t.spark, "tree")
    tables.write_tree(C.doc_split(t).select("key", "cls", "split"), path)
    return t.spark.read.parquet(path).select("key", "cls", "split")


@query(f"SELECT row_number() OVER (ORDER BY cls, session, file) AS place, cls, session, file FROM {_MANIFEST}")
def o2_sorted_manifest(t):
    """The place of each row in the file that a sorted manifest is written to."""
    path = new_path(t.spark, "manifest")
    tables.sorted_manifest(manifest_of(t)).write.parquet(path)
    # Parts are named in order; rows keep theirs within a part.
    back = t.spark.read.parquet(path).select("cls", "session", "file", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("at"))
    sizes = back.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.m"), F.lit(0)).alias("before"))
    return back.join(F.broadcast(before), "part").select((F.col("before") + F.col("at") + 1).alias("place"), "cls", "session", "file")


# --- names ----------------------------------------------------------------------------------------------------
@query("SELECT c_custkey AS id, lower(c_name) AS key FROM customer")
def s17_key_after_mark(t):
    return t.customer.select(F.col("c_custkey").alias("id"), keys.key_after_mark(F.concat(F.lit("0a-b___ "), "c_name", F.lit(" .JPG"))).alias("key"))


_EXT = "CASE c_custkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.HEIC.jpg' WHEN 2 THEN '.Png.JPEG.tif' ELSE '.gif' END"


def named(t: Tables) -> DataFrame:
    ext = F.when(F.col("c_custkey") % 4 == 0, ".jpg").when(F.col("c_custkey") % 4 == 1, ".HEIC.jpg").when(F.col("c_custkey") % 4 == 2, ".Png.JPEG.tif").otherwise(".gif")
    return t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.col("c_name"), ext).alias("file"))


@query(f"SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 4 = 3 THEN '.gif' ELSE '' END AS stem FROM customer")
def p1_stem(t):
    return named(t).select("id", keys.stem(F.col("file")).alias("stem"))


@query(f"SELECT c_custkey AS id, c_custkey % 4 <> 3 AS image FROM customer")
def p5_extension(t):
    return named(t).select("id", keys.has_extension(F.col("file")).alias("image"))


@query("SELECT DISTINCT lang AS cls, source FROM documents WHERE lang IN ('de', 'fr') AND source IN (SELECT DISTINCT source FROM documents)")
def p10_options(t):
    """Options are plain arguments; those that name what is not there are errors, as in required()."""
    try:
        tables.required(t.documents, ["doc_id", "no_such_column"])
    except ValueError:
        return t.documents.where(keys.in_classes(F.col("lang"), "de,fr".split(","))).select(F.col("lang").alias("cls"), "source").distinct()
    raise AssertionError("a missing column was not told")


_NUM = "lpad((event_id % 100000)::VARCHAR, 5, '0')"
_FILE = f"""CASE event_id % 5 WHEN 0 THEN 'IMG_' || {_NUM} || '.HEIC.jpg' WHEN 1 THEN 'clip' || user_id || '_frame' || {_NUM} || '.jpg' WHEN 2 THEN 'WhatsApp Image ' || strftime(ts, '%Y-%m-%d') || ' at ' || event_id || '.jpg'
  WHEN 3 THEN 'photo-' || event_id || '.png' ELSE {_NUM} || '.jpg' END"""
_KEYED = f"""SELECT event_id AS id, event_type AS cls, {_FILE} AS file, CASE event_id % 5 WHEN 1 THEN 'video' WHEN 2 THEN 'whatsapp' WHEN 3 THEN 'single' ELSE 'seq' END AS kind,
  CASE event_id % 5 WHEN 0 THEN 'IMG_' WHEN 1 THEN 'clip' || user_id WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN 'photo-' || event_id ELSE 'IMG' END AS key, CASE WHEN event_id % 5 IN (0, 4) THEN event_id % 100000 END AS num FROM events"""


def captures(t: Tables) -> DataFrame:
    """Events under file names of all four kinds."""
    num, which = F.lpad((F.col("event_id") % 100000).cast("string"), 5, "0"), F.col("event_id") % 5
    file = (
        F.when(which == 0, F.concat(F.lit("IMG_"), num, F.lit(".HEIC.jpg")))
        .when(which == 1, F.concat(F.lit("clip"), F.col("user_id").cast("string"), F.lit("_frame"), num, F.lit(".jpg")))
        .when(which == 2, F.concat(F.lit("WhatsApp Image "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" at "), F.col("event_id").cast("string"), F.lit(".jpg")))
        .when(which == 3, F.concat(F.lit("photo-"), F.col("event_id").cast("string"), F.lit(".png")))
        .otherwise(F.concat(num, F.lit(".jpg")))
    )
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("cls"), file.alias("file"))


@query(f"SELECT id, kind, key, num FROM ({_KEYED})")
def p2_capture_key(t):
    return captures(t).select("id", keys.capture_key(F.col("file")).alias("k")).select("id", "k.*")


@query(f"SELECT id, kind, CASE WHEN kind = 'seq' AND key = 'IMG' THEN '' ELSE key END AS key, num FROM ({_KEYED}) UNION ALL SELECT c_custkey, 'seq', '', 12345678 FROM customer")
def g2_unbounded_keys(t):
    """Without bounds long digit runs count, as at the start of a UUID, and an empty prefix stays."""
    uuids = t.customer.select(F.col("c_custkey").alias("id"), F.lit("12345678-ab12-4c").alias("file"))
    both = captures(t).select("id", "file").unionByName(uuids)
    return both.select("id", keys.capture_key(F.col("file"), False).alias("k")).select("id", "k.*")


_SEQ = f"(SELECT id, cls, key AS prefix, num, file AS key FROM ({_KEYED}) WHERE kind = 'seq')"
_OTHER = f"SELECT id, concat_ws(':', kind, cls, key) AS session FROM ({_KEYED}) WHERE kind <> 'seq'"


@query(f"SELECT id, session FROM ({C._runs(_SEQ, 'cls, prefix', 3)}) UNION ALL {_OTHER}")
def g1_sessions_from_names(t):
    return sessionize.sessions_from_names(captures(t), 3).select("id", "session")


@query(f"SELECT id, session AS session_new FROM ({C._runs(_SEQ, 'prefix', 10)}) UNION ALL {_OTHER}")
def g3_regrouped(t):
    """Bursts grouped anew across classes with a gap of 10; all other sessions stay."""
    manifest = sessionize.sessions_from_names(captures(t), 3)
    return sessionize.regrouped(manifest, 10, True).select("id", "session_new")
