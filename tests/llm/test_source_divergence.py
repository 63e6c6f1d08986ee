import random
import re
from collections import Counter, defaultdict

import numpy as np
from splitwarden.llm import source_divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, total int, p int, value long, rank int"


def brute(rows, least=10, top=10):
    """From the contract: (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), l or "", s or "") for t, l, s in rows]
    out = []
    for lang in {l for _, l, _ in docs}:
        df, total, per = Counter(), Counter(), defaultdict(Counter)
        for words, l, s in docs:
            if l == lang:
                df.update(set(words))
                per[s].update(words)
        kept = sorted(t for t in df if df[t] >= least)
        for c in per.values():
            total.update({t: c[t] for t in kept})
        share = lambda c: [1 + 1000000000 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept]
        p, q = {s: share(c) for s, c in per.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in per:
            pairs = sorted((-sum(map(f, p[s], p[o])), o.encode(), o) for o in per if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            over = sorted((-f(a, b), t.encode(), t) for a, b, t in zip(p[s], q, kept, strict=True) if per[s][t] and a > b)[:top]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(over)]
    return sorted(out)


def fixture(seed):
    rnd = random.Random(seed)
    words = [f"{'abcdefghij'[i % 10]}w{'xyz'[i % 3] * (i // 10 + 1)}" for i in range(60)] + ["Éa", "éa", "ÉA", "日本", "Zed", "zed", "\U0001f600", "ﬀ", "ｆ", "İ"]
    rows = []
    for i in range(400):
        lang, source = rnd.choice(["en", "en", "fr", None, ""]), rnd.choice(["s0"] * 6 + ["s1", "s2", "Ü", None, ""])
        mine = words if source == "s0" else words[:40] if source == "s1" else words[25:]
        rows.append((rnd.choice([" ", "-", "1", "\n"]).join(rnd.choices(mine, weights=[1 / (j + 1) for j in range(len(mine))], k=rnd.randint(0, 40))), lang, source))
    rows += [(None, "en", "s9"), ("", "xx", "s0"), ("only one", "yy", "s1"), ("12 3 [_]`{", "en", "s8"), (None, None, None)] + [("common phrase here", "de", "hot")] * 50 + [("common words", "de", f"t{i}") for i in range(12)]
    rows.append(("word " * 30_000 + "Zed " * 3000, "en", "s2"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i % 50, t, l, s, "k", 1, 2, 3, 4, 5) for i, (t, l, s) in enumerate(rows)], SCHEMA).repartition(5)


def test_against_brute_force(spark):
    rows = fixture(1)
    want = brute(rows)
    assert sorted(map(tuple, D.divergence(frame(spark, rows)).collect())) == want
    assert {w[2] for w in want} == {"pair", "term"} and any(w[4] == 0 for w in want)


def test_a_full_sketch_changes_no_result(spark):
    rows = fixture(2)
    got = D.divergence(frame(spark, rows), least=4, top=3, depth=2, width=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 3)


def test_sketch_never_underestimates_and_spares_rows(spark):
    rnd = random.Random(5)
    rows = [(" ".join([f"often{'abc'[i % 3]}"] * 2 + ["u" + "".join(rnd.choices("abcdefgh", k=9)) for _ in range(20)]), "en", f"s{i % 4}") for i in range(300)]
    texts = frame(spark, rows).select("lang", "source", "text")
    sketch = D.merged_sketch(texts, 2, 1 << 18)
    df = Counter(w for t, _, _ in rows for w in set(re.findall(r"[a-z]+", t)))
    import pyarrow as pa

    known = pa.array(list(df))
    at = D.cells(np.repeat(D._hashes(pa.array(["en"])), len(df)), D._hashes(known), 2, 1 << 18)
    low = np.min([r[i] for r, i in zip(sketch, at, strict=True)], axis=0)
    assert (low >= np.minimum(list(df.values()), 255)).all()
    shared = spark.sparkContext.broadcast(sketch)
    handed = texts.mapInArrow(D._survivors(shared, 10), "lang string, source string, term string, n long, docs long").select("term").distinct().count()
    assert 3 <= handed < 30 < len(df)


def test_empty_table(spark):
    assert D.divergence(frame(spark, fixture(1)).limit(0)).collect() == []


def test_shares_beyond_longs(spark):
    big = [(n, 3 * n, 7, 1 + 1000000000 * (n + 2) // (3 * n + 14)) for n in (0, 8999999999, 9000000000, 10**13)] + [(0, 0, 0, None)]
    df = spark.createDataFrame(big, "n long, size long, terms long, want long")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", D._p("n", "size", "terms")).collect())
