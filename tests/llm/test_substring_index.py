import hashlib
import random
from collections import Counter

from splitwarden.llm import substring_index
from splitwarden.llm.substring_index import WindowIndex, digest, remove_repeats

SCHEMA = "doc_id long, text string, lang string, k string, start int"


def brute(rows, width):
    docs = [(r[0], (r[1] or "").encode().split()) for r in rows]
    count = Counter(tuple(w[i : i + width]) for _, w in docs for i in range(len(w) - width + 1))
    out = []
    for doc_id, w in docs:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture(seed=0):
    rnd = random.Random(seed)
    words = [f"w{i}é" for i in range(60)]
    shared = " ".join(rnd.choices(words, k=50))
    text = lambda n: " ".join(rnd.choices(words, k=n))
    rows = [(i, text(rnd.randint(0, 120))) for i in range(30)]
    rows += [(100 + i, f"{text(20)}\t{shared}\x0b{text(15)}") for i in range(12)]
    rows += [(200, "a " * 90), (201, "a b " * 60), (202, None), (203, ""), (204, " \n "), (None, shared), (None, shared), (205, rows[3][1]), (205, rows[3][1]), (206, shared + " x " + shared)]
    rows += [(300 + i, shared[: 40 + 9 * i] + text(40)) for i in range(8)]
    rows += [(400, "x y " * 40), (401, text(9000)), (7, rows[7][1] + " tail")]
    return [(*r, "en", "clash", 1) for r in rows]


def check(spark, rows, width, **kw):
    got = digest(remove_repeats(spark.createDataFrame(rows, SCHEMA), width, **kw)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width)


def test_against_brute_force(spark):
    check(spark, fixture(), 35)


def test_short_windows_and_other_batches(spark):
    check(spark, fixture(1), 6, gram=3, batches=3)
    check(spark, fixture(2), 5, gram=5, batches=1)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_append_reports_what_repeats_in_history(spark):
    rows = [(1, "a b c d e f g h"), (2, "p q r s t u v w")]
    index = WindowIndex(spark, 4, 2)
    assert index.append(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert index.append(spark.createDataFrame([(3, "z c d e f z")], "doc_id long, text string")).count() >= 1
    places = {(r.k, r.start + i) for r in index.repeated().collect() for i in range(r.n)}
    assert sorted(start for _, start in places) == [1, 2] and len({k for k, _ in places}) == 2
    index.merge_runs()
    assert len(index.runs) == 1 and {(r.k, r.start + i) for r in index.repeated().collect() for i in range(r.n)} == places


def test_history_is_merge_joined(spark, monkeypatch):
    """What repeats across batches only is found by the merge join of a batch with the runs, without a shuffle."""
    plans, written = [], substring_index.written

    def noted(df, name):
        if name == "window_hits":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(substring_index, "written", noted)
    rows = fixture(3)
    check(spark, rows, 35, batches=3)
    assert len(plans) == 3 and all("SortMergeJoin" in p and "Exchange" not in p for p in plans[1:])

    # Without what the join finds nothing that stands once in each batch is removed.
    text = " ".join(f"w{i}" for i in range(50))
    twice = spark.createDataFrame([(i, text) for i in range(40, 60)], "doc_id long, text string")
    assert {r.n_removed for r in remove_repeats(twice).collect()} == {50}
    monkeypatch.setattr(substring_index, "written", lambda df, name: written(df.limit(0) if name == "window_hits" else df, name))
    assert {r.n_removed for r in remove_repeats(twice).collect()} == {0}


def test_tables_are_removed(spark):
    before = {t.name for t in spark.catalog.listTables()}
    remove_repeats(spark.createDataFrame(fixture(4), SCHEMA)).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_runs_are_compacted_in_tiers(spark, monkeypatch):
    """Eight batches: a batch's rows are rewritten three times at most, not with each batch after it."""
    index, saved = WindowIndex(spark, 4, 2, buckets=2), []
    save = WindowIndex._save
    monkeypatch.setattr(WindowIndex, "_save", lambda self, df: saved.append(out := save(self, df)) or out)
    seen = []
    for i in range(8):
        index.append(spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))), (100 + i, "all of them have these words")], "doc_id long, text string"))
        seen.append([*index.levels])
    assert seen == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0], [2, 0, 0], [2, 1, 0], [2, 1, 0, 0]]
    assert len(saved) == 8 + 4
    places = [(r.k, r.start + i) for r in index.repeated().collect() for i in range(r.n)]
    assert len({k for k, _ in places}) == 8 and len(places) == 8 * 3
    index.close()
