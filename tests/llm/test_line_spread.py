from splitwarden.llm.line_spread import remove_spread_lines

SCHEMA = "doc_id long, text string, source string, n_lines string, gone int, k int"


def test_spread(spark):
    docs = [(i, f"own line {i}\n  Shared line \nrare\n\nlast {i}", f"s{i % 6}") for i in range(12)]
    docs += [(100 + i, "copy line one\ncopy line two", f"s{i % 7}") for i in range(9)]  # one text on many sites
    docs += [(200 + i, f"one site only\nx{i}", "s0") for i in range(9)]
    docs += [(300, None, "s1"), (301, "", None), (302, "Shared line", None), (None, "Shared line\nz", "s1"), (303, "\n" * 30000 + "Shared line\r\nend", "s2"), (304, "y", "s1"), (304, "y", "s1")]
    df = spark.createDataFrame([(*d, "clash", 1, 2) for d in docs], SCHEMA).repartition(3)
    out = {(r.doc_id, r.source): r for r in remove_spread_lines(df, least=5).collect()}
    assert remove_spread_lines(df, least=5).count() == len(docs)
    assert out[(3, "s3")].text == "own line 3\n\nlast 3" and out[(3, "s3")].n_lines == 5 and out[(3, "s3")].n_removed_lines == 2
    assert out[(100, "s0")].text == "copy line one\ncopy line two" and out[(200, "s0")].n_removed_lines == 0
    assert out[(300, "s1")].text is None and out[(300, "s1")].n_lines == 0 and out[(301, None)].text == ""
    assert out[(302, None)].text == "" and out[(None, "s1")].text == "z" and out[(303, "s2")].text.endswith("\nend")
    assert out[(3, "s3")].gone == 1 and out[(3, "s3")].k == 2


def test_threshold_is_exact(spark):
    docs = [(i, f"at threshold\nbelow\nmine {i}" if i < 9 else f"at threshold\nmine {i}", f"s{i}") for i in range(10)]
    out = remove_spread_lines(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert all(r.text == ("below\n" if r.doc_id < 9 else "") + f"mine {r.doc_id}" for r in out)


def test_empty_table(spark):
    assert remove_spread_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sites_alone_may_decide(spark):
    docs = [(i, "copy line\nother line", f"s{i}") for i in range(9)] + [(50, None, None), (51, "copy line", "s0"), (51, "copy line", "s0")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert {r.n_removed_lines for r in remove_spread_lines(df, least=9).collect()} == {0}
    alone = remove_spread_lines(df, least=9, least_texts=1).collect()
    assert {(r.doc_id, r.text) for r in alone} == {*((i, "") for i in range(9)), (50, None), (51, "")} and len(alone) == len(docs)
