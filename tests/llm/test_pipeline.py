import corpus_pipeline as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_decide_and_keep_columns(spark, tmp_path):
    from test_jaccard_join import brute

    words = lambda i, n=30: " ".join(f"w{(i * 37 + j * j * 11 + j) % 997}x{i}" for j in range(n))
    leak = "how many roads must one person walk down before others call them wise and free"
    rows = [(i, words(i), "en", f"s{i % 12}") for i in range(60)]
    rows += [(100 + i, "Footer line for all\n" + words(100 + i), "en", f"s{i}") for i in range(12)]
    rows += [(200 + i, words(200) + (" end" if i else ""), "en", "s0") for i in range(3)]
    rows += [(300 + i, words(300 + i, 12) + " vile awful horrid " + words(400 + i, 9), "en", "s1") for i in range(30)]
    rows += [(500, words(500) + " " + leak + " " + words(501), "en", "s2"), (600, None, None, None), (601, "", "en", "s3")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(300 <= r[0] < 400)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(P.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(P.STAGES) - 1:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids[name] = now.collect()
    left = {r.doc_id for r in ids["toxicity"]}
    assert not {i for i in left if 300 <= i < 400} and left >= set(range(60)) | {500, 600, 601}
    assert not any("Footer" in (r.text or "") for r in ids["line dedup"]) and len(ids["line dedup"]) == len(ids["toxicity"])
    near = [(r.doc_id, r.text) for r in ids["line dedup"]]
    kept = {r.doc_id for r in ids["n-gram Jaccard join"]}
    assert kept == {c for _, n, c in brute(near) if n} | {600, 601} and len(kept & {200, 201, 202}) == 1
    assert {r.doc_id for r in ids["benchmark decontamination"]} == kept - {500}
    assert {r.doc_id for r in ids["mixing sources"]} <= kept - {500}
    again = P.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, ids["mixing sources"])) and again


CLASH = "doc_id long, text string, lang string, source string, n_chars long, toxicity int, _toxicity int, n_lines string, n_removed_lines int, k string, row int, gone string, rate int, id string, score double"


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text, None, None), (None, text, "en", "b"), (None, None, None, None), (None, None, None, None), (3, "", "en", "a"), (3, "", "en", "a"), (4, "\n\n", "en", "b"), (5, "x " * 60_000, "en", "a"), (6, "one two", "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "lines", 3, "key", 4, "gone", 5, "id", 0.5) for r in rows], CLASH)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "too short"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(P.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(now.collect())
    assert all(r.n_lines == "lines" and r.n_removed_lines == 3 and r.toxicity == 1 and r.score == 0.5 for rows in seen for r in rows)
    assert len(seen[0]) == len(seen[1]) == len(rows)
    kept = sorted((str(r.doc_id), (r.text or "")[:5]) for r in seen[2])
    assert kept == sorted([("1", "w0 w1"), ("None", ""), ("None", ""), ("3", ""), ("3", ""), ("4", "\n\n"), ("5", "x x x"), ("6", "one t")]) and len(seen[3]) == len(kept)
    mixed = P.STAGES[-1][1](spark, now, str(tmp_path))
    assert mixed.columns == [*docs.columns, "copy", "mix_key"] and {str(r.doc_id) for r in mixed.collect()} <= {k for k, _ in kept}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(1, "some text here", "en", "a", 14)], DOCS)
    for _, stage in P.STAGES[:-1]:
        some = stage(spark, some, str(tmp_path))
        assert [tuple(r) for r in some.collect()] == [(1, "some text here", "en", "a", 14)]
