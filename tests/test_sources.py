import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from splitwarden.operators import provenance, runs
from splitwarden.sources import ranges, scan, tables
from splitwarden.streaming import sessions


def put(root, *names, data=b"x"):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def test_scans(spark, tmp_path):
    put(tmp_path / "d", "Train/cat /1.jpg", "train_set2/x/1.jpg", "TEST-SET/cat/sub/2.PNG", "valid/dog/3.jpg.jpg", "valid/dog/notes.txt")
    root = str(tmp_path / "d")
    got = {(r.split, r.cls, r.file) for r in scan.scan_dataset(spark, root).collect()}
    assert got == {("train", "cat", "1.jpg"), ("test", "cat", "2.PNG"), ("val", "dog", "3.jpg.jpg")}  # train_set2 is no known name
    put(tmp_path / "e", "cat/1.jpg", "dog/2.jpg")
    flat = {(r.split, r.cls) for r in scan.scan_dataset(spark, str(tmp_path / "e"), exclude=["DOG"]).collect()}
    assert flat == {("__none__", "cat")}
    put(tmp_path / "f/deep", "train/a/1.jpg", "val/a/2.jpg", "test/a/3.jpg.jpg")
    put(tmp_path / "f/deep", "test/a/broken.jpg", data=b"GIF8")
    put(tmp_path / "f/deep", "train/a/1.jpg", "val/a/2.jpg", "test/a/3.jpg.jpg", data=b"\xff\xd8\xff\xe0")
    put(tmp_path / "f/deep", "test/a/notes.txt")
    assert [r.root.endswith("/f/deep") for r in scan.partition_roots(spark, str(tmp_path / "f")).collect()] == [True]
    items = scan.scan_splits(spark, str(tmp_path / "f/deep"), ["A"])
    assert {(r.file, r.doubled) for r in items.collect()} >= {("3.jpg.jpg", True), ("1.jpg", False)}
    good, bad = scan.scan_with_problems(spark, str(tmp_path / "f/deep"), ("train", "val", "test", "extra"))
    assert good.count() == 3 and {r.kind for r in bad.collect()} == {"UNREADABLE", "MISSING_SPLIT", "NON_IMAGE"}
    mapped = scan.mapped_classes(scan.scan_dataset(spark, str(tmp_path / "e")), {"cat": "animal"})
    assert [(r.cls, r.label) for r in mapped.collect()] == [("cat", "animal")]


def test_archives_and_cache(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("in/a.jpg", b"aa")
        z.writestr("b.txt", b"bb")
    put(tmp_path / "z", "m.zip", data=buffer.getvalue())
    put(tmp_path / "z", "loose.jpg")
    assert {(r.archive is None, bytes(r.content)) for r in scan.archive_members(spark, str(tmp_path / "z")).collect()} == {(False, b"aa"), (True, b"x")}
    one, two = spark.range(3), spark.range(5)
    assert scan.stored(one, f"{tmp_path}/cache", ["id"]).count() == 3 and scan.stored(two, f"{tmp_path}/cache", ["id"]).count() == 5


def test_readers(spark, tmp_path):
    put(tmp_path, "m.csv", data="﻿file,cls,session\n1.jpg,a,s1\n".encode())
    assert tables.read_manifest(spark, f"{tmp_path}/m.csv").select("cls", "file", "session").first()[:] == ("a", "1.jpg", "s1")
    put(tmp_path, "bad.csv", data=b"file,cls\n1,a\n")
    with pytest.raises(ValueError, match="session"):
        tables.read_manifest(spark, f"{tmp_path}/bad.csv")
    for mode, seed, f1 in (("group", 1, 50), ("image", 1, 60), ("image", 2, 70)):
        put(tmp_path / "r", f"{mode}_s{seed}/cv.csv", data=f"Fold,Macro F1\nFold 1,{f1}\nMean±Std,{f1}.0±1.0\n".encode())
        if seed == 1:
            put(tmp_path / "r", f"{mode}_s{seed}/DONE")
    got = {(r["mode"], r.seed, r["Macro F1"]) for r in tables.read_runs(spark, f"{tmp_path}/r", "cv.csv", ("Fold",), ("Fold", "Mean")).collect()}
    assert got == {("group", 1, 50.0), ("image", 1, 60.0)}
    put(tmp_path, "leaf.json", data=json.dumps({" Key1 ": ["A:::l1", "B:::l2"]}).encode())
    assert {tuple(r) for r in tables.read_leaf_map(spark, f"{tmp_path}/leaf.json").collect()} == {("A", "key1", "l1"), ("B", "key1", "l2")}
    put(tmp_path, "c.json", data=json.dumps({"class_names": ["a", "b"], "confusion": {"m": [[1, 2], [3, 4]]}}).encode())
    assert {tuple(r) for r in tables.read_confusion(spark, f"{tmp_path}/c.json").collect()} == {("m", "a", "a", 1), ("m", "a", "b", 2), ("m", "b", "a", 3), ("m", "b", "b", 4)}
    put(tmp_path, "c.csv", data=b"1,2\n3,4\n")
    assert ("b", "a", 3) in {tuple(r) for r in tables.read_confusion_csv(spark, f"{tmp_path}/c.csv", ["a", "b"]).collect()}
    put(tmp_path, "h/net.json", data=json.dumps({"train_loss": [2, 1], "val_loss": [3, 2], "train_acc": [0.1, 0.2], "val_acc": [0.1, 0.3]}).encode())
    assert [r.val_acc for r in runs.histories(tables.read_history(spark, f"{tmp_path}/h"), ["model"]).orderBy("epoch").collect()] == [0.1, 0.3]
    np.savez(tmp_path / "e.npz", E=np.array([[3.0, 4.0]], "float32"), paths=np.array(["p1"]), weights=np.array("w"))
    vectors = tables.read_npz(spark, f"{tmp_path}/e.npz")
    assert tables.embeddings_for(spark.createDataFrame([("p1",)], "path string"), vectors).first().embedding == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError, match="without"):
        tables.embeddings_for(spark.createDataFrame([("p2",)], "path string"), vectors)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", 1.5), ("test", "b", None)], "split string, cls string, x double")
    tables.write_tree(df, f"{tmp_path}/tree")
    assert spark.read.parquet(f"{tmp_path}/tree").count() == 2 and (tmp_path / "tree/split=train/cls=a").is_dir()
    assert tables.markdown(df.orderBy("split")).splitlines()[2] == "| test | b | — |"


def test_exif(spark):
    def entry(tag, kind, count, value):
        return struct.pack("<HHI", tag, kind, count) + value

    dms = struct.pack("<6I", 10, 1, 30, 1, 0, 1)
    head = b"II*\0" + struct.pack("<I", 8)
    main = struct.pack("<H", 2) + entry(0x0110, 2, 3, b"Cam\0") + entry(0x8825, 4, 1, struct.pack("<I", 38)) + b"\0" * 4
    gps = struct.pack("<H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, struct.pack("<I", 92)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, struct.pack("<I", 92)) + b"\0" * 4
    block = head + main + gps
    block += b"\0" * (92 - len(block)) + dms
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda"
    df = spark.createDataFrame([("p", bytearray(jpeg)), ("q", bytearray(b"junk"))], "path string, content binary")
    got = {r.path: r for r in provenance.exif_table(df).collect()}
    assert got["p"].model == "Cam" and got["p"].lat == -10.5 and got["p"].lon == 10.5 and got["q"].model is None


def test_streamed_sessions_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (1, 60), (1, 121), (2, 5), (1, 4000), (2, 9000)], "user long, s long").select("user", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = {(r.user, r.n, r.end) for r in sessions.gap_sessions(df, "ts", ["user"], "60 seconds", "1 second").collect()}
    assert {(u, n) for u, n, _ in batch} == {(1, 2), (1, 1), (2, 1)}
    stream = spark.readStream.schema("user long, ts timestamp").parquet(f"{tmp_path}/in")
    q = sessions.write_sessions(sessions.gap_sessions(stream, "ts", ["user"], "60 seconds", "1 second"), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    q.processAllAvailable()
    q.stop()
    assert {(r.user, r.n, r.end) for r in spark.read.parquet(f"{tmp_path}/out").collect()} <= batch


class Counted(io.RawIOBase):
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.data, self.at, self.bytes_read = data, 0, 0

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, to, whence=0):
        self.at = to + (0, self.at, len(self.data))[whence]
        return self.at

    def tell(self):
        return self.at

    def read(self, n=-1):
        out = self.data[self.at :] if n is None or n < 0 else self.data[self.at : self.at + n]
        self.at += len(out)
        self.bytes_read += len(out)
        return out


def test_single_members_are_read_by_the_directory():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("large.bin", bytes(5_000_000))
        for i in range(20):
            z.writestr(f"in/{i}.jpg", b"%d" % i * 100)
    f = Counted(buffer.getvalue())
    got = list(ranges.parts_of("x/m.ZIP", (".jpg",), lambda _: f))
    assert [(a, m, len(c)) for a, m, c in got] == [("x/m.ZIP", f"in/{i}.jpg", len(str(i)) * 100) for i in range(20)]
    assert f.bytes_read < 100_000 < len(f.data)


def test_first_bytes_of_files_that_no_row_could_hold(spark, tmp_path):
    put(tmp_path / "big", "train/a b/1.jpg", "val/a/2.jpg", "test/a/3.jpg", data=b"\xff\xd8\xff\xe0")
    with open(tmp_path / "big/train/a b/1.jpg", "r+b") as f:
        f.truncate(5 << 30)  # 5 GB without a block on disk
    put(tmp_path / "big", "val/a/bad.jpg", data=b"GIF8")
    items, problems = scan.scan_with_problems(spark, str(tmp_path / "big"))
    assert sorted((r.split, r.cls, r.bytes) for r in items.collect()) == [("test", "a", 4), ("train", "a b", 5 << 30), ("val", "a", 4)]
    assert [tuple(r) for r in scan.dropped(problems).collect()] == [("UNREADABLE", 1)]
    assert ranges.reachable("file:///x") and ranges.reachable("/x") and ranges.reachable("s3a://b/x") and not ranges.reachable("viewfs://s/x")
    gone = spark.createDataFrame([("file:/nowhere/x.jpg",)], "path string")
    assert ranges.first_bytes(gone, 8).first()["start"] is None
