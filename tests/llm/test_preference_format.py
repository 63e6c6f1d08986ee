from splitwarden.llm.preference_format import preference_pairs, rotated, swapped

SCHEMA = "conv_id long, turn long, role string, text string, pair_id string, prompt int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(2)


def unmask(text, spans):
    return [text[s["from"] : s["to"]] for s in spans]


def test_prefix_and_masks(spark):
    common = [(1, 0, "system", "be nice"), (1, 1, "user", "héllo")]
    chosen = [*common, (1, 2, "assistant", "yes\n😀"), (1, 3, "user", "ok"), (1, 4, "assistant", "bye")]
    rejected = [*common, (1, 2, "assistant", "no")]
    r = preference_pairs(frame(spark, chosen), frame(spark, rejected)).first()
    assert r.n_common == 2 and r.prompt == "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>user\nhéllo<|im_end|>\n"
    assert unmask(r.chosen, r.chosen_mask) == ["yes\n😀<|im_end|>", "bye<|im_end|>"] and unmask(r.rejected, r.rejected_mask) == ["no<|im_end|>"]


def test_odd_rows(spark):
    a = [(1, 0, "user", "x"), (2, 0, "user", None), (2, 1, None, "y"), (3, 0, "user", "only here"), (None, 0, "user", "q"), (4, 0, "user", "p"), (4, 0, "user", "p"), (4, 1, "assistant", "z" * 300000)]
    b = [(1, 0, "user", "x"), (2, 0, "user", None), (2, 1, None, "n"), (4, 0, "user", "p"), (4, 0, "user", "p")]
    out = {r.pair_id: r for r in preference_pairs(frame(spark, a), frame(spark, b)).collect()}
    assert set(out) == {1, 2, 4}
    assert out[1].n_common == 1 and out[1].chosen == out[1].rejected == "" and out[1].chosen_mask == []
    assert out[2].n_common == 1 and out[2].chosen_mask == []
    assert out[4].n_common == 2 and out[4].rejected == "" and len(out[4].chosen) > 300000
    empty = frame(spark, []) if False else spark.createDataFrame([], SCHEMA)
    assert preference_pairs(empty, empty).count() == 0


def test_swapped(spark):
    rows = [(2, 0, "user", "a"), (2, 1, "assistant", "A"), (3, 0, "user", "b"), (3, 1, "assistant", "B"), (3, 2, "user", "c"), (4, 0, "assistant", "lonely"), (6, 0, "user", "none")]
    out = sorted((r.conv_id, r.turn, r.text) for r in swapped(frame(spark, rows)).collect())
    assert out == [(2, 0, "a"), (2, 1, "B"), (3, 0, "b"), (3, 1, "A"), (3, 2, "c")]


def test_rotated_pairs_every_answered_conversation(spark):
    rows = [(i, t, r, f"{r}{i}") for i in range(0, 40, 2) for t, r in enumerate(("user", "assistant"))] + [(1, 0, "user", "none"), (None, 0, "assistant", "x")]
    for buckets in (1, 3, 1024):
        out = {r.conv_id: r.text for r in rotated(frame(spark, rows), buckets=buckets).collect() if r.role == "assistant"}
        assert set(out) == set(range(0, 40, 2)) and sorted(out.values()) == sorted(f"assistant{i}" for i in out) and all(out[i] != f"assistant{i}" for i in out)
    pairs = preference_pairs(frame(spark, rows), rotated(frame(spark, rows)))
    assert pairs.count() == 20 and pairs.where("chosen = rejected").count() == 0
    assert rotated(frame(spark, rows[:2])).count() == 0
