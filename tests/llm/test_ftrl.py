import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from splitwarden.llm import _text as T
from splitwarden.llm import ftrl


def corpus(n=400):
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w, y = rnd.choices(words, k=rnd.randint(3, 200)), int(rnd.random() < 0.3)
        for _ in range(y * 3):
            w.insert(rnd.randrange(len(w)), rnd.choice(["Vile", "awful"]))
        rows.append((i, " ".join(w), "x", 0.5))
        labels.append((i, y, 1 - y))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, label double"


@pytest.mark.parametrize(("label", "settings"), [("toxic", ftrl.TOXICITY), ("quality", ftrl.QUALITY)])
def test_held_out_accuracy(spark, label, settings):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = ftrl.classified(docs, marks, label, settings, 5, 0, 0.5).collect()
    truth = {i: (t if label == "toxic" else q) for i, t, q in labels}
    assert len(out) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_labels_of_the_held_out_part_do_not_matter(spark):
    rows, labels = corpus(150)
    flipped = [(i, 1 - t, q) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, t, q) for i, t, q in labels]
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(ftrl.classified(docs, spark.createDataFrame(x, "doc_id long, toxic int, quality int"), "toxic", ftrl.TOXICITY, 5, 0, 0.5).collect()) for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    rows, labels = corpus(120)
    odd = [(None, "Vile awful", None, None), (1000, None, "x", None), (1001, "", "x", None), (1001, "", "x", None), (1002, "word1 " * 60000, "x", None), (3, "again", "x", None)]
    marks = [*labels, (None, 1, 1), (5, None, None), (7, 1, 1), (1001, 0, 0)]
    docs, marks = spark.createDataFrame(rows + odd, SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    out = ftrl.classified(docs, marks, "toxic", ftrl.TOXICITY, 5, 0, 0.5).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    empty = {r.score for r in out if r.doc_id in (1000, 1001)}
    assert len(empty) == 1
    none = ftrl.classified(docs, marks.limit(0), "toxic", ftrl.TOXICITY, 5, 0, 0.5).collect()
    assert {r.score for r in none} == {0.0}
    assert ftrl.classified(docs.limit(0), marks, "toxic", ftrl.TOXICITY, 5, 0, 0.5).count() == 0


def test_score_keeps_columns_and_refuses_a_clash(spark):
    rows, _ = corpus(10)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = ftrl.fit_rows(["a b", "c d"] * 10, np.array([0.0, 1.0] * 10), ftrl.QUALITY)
    assert ftrl.score(docs, model).columns == [*docs.columns, "score"]
    with pytest.raises(ValueError, match="lang"):
        ftrl.score(docs, model, "lang")


def test_fit_is_bounded(spark):
    rows, labels = corpus(60)
    s = ftrl.Settings(max_rows=5, least_rows=1)
    model = ftrl.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), "toxic", s)
    assert model.bias is not None and len(model.buckets) <= 5 * 500


def plain(texts, labels, s):
    """The updates of McMahan et al. (2013), row by row and coordinate by coordinate."""
    rows, scales = [], []
    for text in texts:
        batch = pa.RecordBatch.from_pydict({"text": pa.array([text])})
        for _, data, offs in T.chunks(batch):
            rows.append({int(b) for _, bucket in ftrl.features(data, offs, s) for b in bucket})
            scales.append(max(1, len(ftrl.tokens(data, offs)[0])) ** -s.power)
    seen = Counter(b for r in rows for b in r)
    rows = [{b for b in r if seen[b] >= s.least_rows} for r in rows]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if i == "bias":
            return -z[i] / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    order = np.random.default_rng(s.rows_hash_seed)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            x = {b: scales[i] for b in rows[i]} | {"bias": 1.0}
            w = {b: weight(b) for b in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[b] * v for b, v in x.items())))))
            for b, v in x.items():
                g = (p - labels[i]) * v * (s.positive_weight if labels[i] else 1.0)
                step = (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / s.alpha
                z[b] += g - step * w[b]
                n[b] += g * g
    return {b: weight(b) for b in z if b != "bias" and weight(b)}, weight("bias")


@pytest.mark.parametrize("settings", [ftrl.Settings(epochs=3, l1=0.1, least_rows=2), ftrl.Settings(skips=(1, 2), power=0.0, l1=0.4, least_rows=1, positive_weight=2.0)])
def test_same_as_plain_updates(settings):
    rows, labels = corpus(50)
    texts, y = [r[1] for r in rows] + [""], np.array([x[1] for x in labels] + [0], float)
    model = ftrl.fit_rows(texts, y, settings)
    weights, bias = plain(texts, y, settings)
    assert model.buckets.tolist() == sorted(weights) and model.bias == pytest.approx(bias)
    assert model.weights == pytest.approx([weights[b] for b in model.buckets.tolist()])


def test_fit_in_tasks_is_the_fit_in_memory(spark):
    rows, labels = corpus(120)
    docs, marks = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    a = ftrl.fit(docs, marks, "toxic", ftrl.TOXICITY)
    b = ftrl.fit_rows([r[1] for r in rows], np.array([x[1] for x in labels], float), ftrl.TOXICITY)
    assert a.buckets.tolist() == b.buckets.tolist() and a.weights == pytest.approx(b.weights) and a.bias == pytest.approx(b.bias)


def test_recall_of_held_out_toxic_rows(spark):
    rows, labels = corpus(900)
    out = ftrl.classified(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), "toxic", ftrl.TOXICITY, 5, 0, 0.5).where("held_out").collect()
    toxic = {i for i, t, _ in labels if t}
    assert sum(r.predicted for r in out if r.doc_id in toxic) >= 0.9 * sum(r.doc_id in toxic for r in out)
    assert sum(r.predicted for r in out if r.doc_id not in toxic) <= 0.03 * len(out)
