from splitwarden.llm import templates
from splitwarden.llm.templates import contaminated, without_contaminated

DOCS = "doc_id long, text string, k string, h long, pos int"
PLAIN = "the quick movement of seven rivers under old stone bridges makes quiet music for all travellers"
QUESTION = "A train leaves Springfield with 120 passengers and after 45 km it meets another train of 120 passengers near Ogdenville so how many travel now"


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "k", 1, 2) for x in docs], DOCS).repartition(2)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    left = without_contaminated(d, b, **kw)
    assert left.columns == d.columns
    return {(r.doc_id, r.item_id) for r in contaminated(d, b, **kw).collect()}, {r.doc_id for r in left.collect()}


def test_plain_and_reparameterised(spark):
    filler = "some words before it that no one asked about "
    docs = [
        (1, filler + PLAIN.upper() + "! and more"),
        (2, filler + QUESTION.replace("120", "77").replace("45", "8,5").replace("Springfield", "Old Shelbyville").replace("Ogdenville", "Capital City")),
        (3, filler + QUESTION.replace("120 passengers near", "99 passengers near")),  # one slot value stands for two; the windows without it count
        (4, filler * 5), (5, None), (6, ""), (7, "short one here"), (7, PLAIN), (None, PLAIN), (8, "so this is a short item of words indeed"), (9, "x " * 50000 + PLAIN),
    ]
    items = [(10, PLAIN), (11, QUESTION), (12, "this is a short item of words"), (13, "too short"), (14, None), (10, PLAIN)]
    hits, left = found(spark, docs, items)
    assert hits == {(1, 10), (2, 11), (3, 11), (7, 10), (None, 10), (8, 12), (9, 10)}
    assert left == {4, 5, 6, 7}


def test_inconsistent_slots_do_not_match(spark):
    item = "if there are 5 birds and then again 5 birds come while other 7 birds leave how many stay"
    same = item.replace("5", "31").replace("7", "4")
    other = item.replace("5 birds and", "31 birds and").replace("again 5", "again 32").replace("7", "4")
    hits, _ = found(spark, [(1, same), (2, other)], [(1, item)])
    assert hits == {(1, 1)}


def test_large_benchmark_is_joined_without_broadcast(spark, monkeypatch):
    from splitwarden.llm import templates

    monkeypatch.setattr(templates, "MANY", 3)
    hits, _ = found(spark, [(1, "a b " + PLAIN), (2, "nothing")], [(10, PLAIN)])
    assert hits == {(1, 10)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, PLAIN)]) == (set(), set())
    assert found(spark, [(1, PLAIN)], []) == (set(), {1})


def test_short_and_number_dense_items(spark):
    items = [(1, "What is 48 times 37 plus 12?"), (2, "Name 3 rivers of 2 Old Towns"), (3, "sum 1 2 3 4 5 6 7 and 8 9 10 11 12 13 14 of all"), (4, "21 22 23 24 25 26 27 28 29 30 31 32 33")]
    docs = [
        (1, "so then: What is 51 times 62 plus 70? and on"), (2, "please: Name 8 rivers of 9 New Lands too"), (3, "sum 20 30 40 50 60 70 80 and 90 21 31 41 51 61 71 of all"),
        (4, "What is 51 over 62 plus 70?"), (5, "41 42 43 44 45 46 47 48 49 50 51 52 53 54 55"),
    ]
    assert found(spark, docs, items) == ({(1, 1), (2, 2), (3, 3)}, {4, 5})


def test_names_that_open_sentences_in_capitals_or_beyond_ascii(spark):
    items = [(1, "Tom has 5 red apples. Tom buys 3 more of them. Lee eats 2."), (2, "Tom Lee sold 6 big lamps at noon"), (3, "then a friend of ÉLODIE or of NASA met Örjan near 4 trees")]
    docs = [
        (1, 'It asks: "Ann has 7 red apples. Ann buys 4 more of them. Kim eats 6." and so on'), (2, "and Ann sold 9 big lamps at noon"),
        (3, "then a friend of Zoé or of UNESCO met Åsa near 8 trees"), (4, "Ann had 7 red apples. Ann buys 4 more of those. Kim eats 6."),
    ]
    assert found(spark, docs, items) == ({(1, 1), (2, 2), (3, 3)}, {4})


def test_slots_are_judged_by_window(spark):
    far = "the 5 old ships sailed 9 miles past many green 8 hills and small towns 7 until every sailor had seen all 5 lights"
    long = "there were 5 red and 5 blue birds in a tall tree by our house when 8 cats came over from some far off field and 9 dogs ran after them so that all birds flew up"
    items = [(1, "buy 3 ripe apples and then 5 ripe pears"), (2, far), (3, long), (4, "buy 3 ripe plums and then 3 ripe limes")]
    docs = [
        (1, "buy 4 ripe apples and then 4 ripe pears"), (2, "the 31 old ships sailed 12 miles past many green 14 hills and small towns 16 until every sailor had seen all 33 lights"),
        (3, long.replace("5 red", "31 red").replace("5 blue", "32 blue").replace("8", "11").replace("9", "12")), (4, "buy 4 ripe plums and then 5 ripe limes"),
    ]
    assert found(spark, docs, items) == ({(1, 1), (2, 2), (3, 3)}, {4})
    assert found(spark, docs[2:3], items[2:3], least_windows=25)[0] == {(3, 3)}


def test_numbers_in_words_and_null_items(spark):
    items = [(1, "Ann sold three red and twelve blue kites"), (None, PLAIN), (3, None), (3, None)]
    docs = [(1, "so Kim sold seventeen red and two blue kites"), (2, "Kim sold some red and many blue kites"), (3, PLAIN), (3, PLAIN)]
    assert found(spark, docs, items) == ({(1, 1), (3, None)}, {2})


def test_lists_that_share_one_word_are_not_taken_for_one_another(spark):
    numbers = lambda first, step: " ".join(str(first + step * i) for i in range(12))
    items = [(1, f"Table {numbers(3, 5)} total"), (2, QUESTION), (3, "sum 1 2 3 4 5 6 7 and 8 9 10 11 12 13 14 of all"), (4, "What is 48 times 37 plus 12?")]
    docs = [
        (1, f"Row {numbers(101, 7)} total"), (2, QUESTION.replace("120", "77").replace("45", "8,5")), (3, "sum 20 30 40 50 60 70 80 and 90 21 31 41 51 61 71 of all"),
        (4, "so then: What is 51 times 62 plus 70? and on"), (5, f"Table {numbers(3, 5)} total"),
    ]
    strict = {"least_words": templates.PLAIN}
    assert found(spark, docs, items, **strict) == ({(2, 2), (3, 3), (4, 4), (5, 1)}, {1})
    assert (1, 1) in found(spark, docs[:1], items)[0]


def test_shortest_items(spark):
    items, docs = [(1, "add 4 and 5")], [(1, "now add 4 and 5 again"), (2, "add 7 and 9"), (3, "add them")]
    assert found(spark, docs, items)[0] == set()
    assert found(spark, docs, items, shortest=4)[0] == {(1, 1), (2, 1)}
