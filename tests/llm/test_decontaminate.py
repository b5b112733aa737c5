import random

import duckdb

from credence.llm import decontaminate as dc
from credence.llm._common import read_table

ITEM = "In the morning Robert Miller walked 12 km to the old market and bought 12 red apples for his sister before lunch."
SHORT = "What grows under seven quiet hills?"


def run(spark, docs, items=((1, ITEM), (2, SHORT), (3, None), (4, "Too short"))):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in dc.contamination(d, b).collect()}


def test_kinds_and_edges(spark):
    pad = "Some other words stand here before all of it. "
    docs = [
        (1, pad + ITEM + " And then more.", 0),
        (2, pad + ITEM.replace("12", "40").replace("Robert Miller", "Anna Kowalski").replace("km", "miles"), 0),
        (3, pad + ITEM.replace("12 km", "40 km").replace("12 red", "41 red"), 0),  # one value of the item would have two
        (4, pad, 0), (5, None, 0), (None, ITEM, 0), (1, pad + ITEM + " And then more.", 0),
        (6, "Well, what GROWS under seven quiet hills? Nothing.", 0),
        (7, " ".join(ITEM.split()[3:11]), 0),  # eight tokens only
        (8, ("filler words of no use " * 30_000) + ITEM, 0),
        (9, "Too short", 0),
    ]
    assert run(spark, docs) == {(1, 1): "exact", (2, 1): "reparameterised", (None, 1): "exact", (6, 2): "exact", (8, 1): "exact"}
    assert run(spark, docs[:1], items=[(None, None)]) == {}
    kept = dc.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "item_id"] and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 9]


def test_join_without_broadcast_agrees(spark):
    docs, bench = read_table(spark, "/root/testdata/sf0.001", "documents"), read_table(spark, "/root/testdata/sf0.001", "benchmark")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(dc.contamination(docs, bench)) == key(dc.contamination(docs, bench, broadcast_windows=10))


def test_catches_the_verbatim_passages_and_no_clean_document(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id for r in dc.contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")).collect()}
    want = {r[0] for r in duckdb.connect().execute(f"select distinct doc_id from '{sf}/documents.parquet' d join '{sf}/benchmark.parquet' b on contains(d.text, b.text)").fetchall()}
    assert got == want


def test_items_rich_in_numbers_and_names(spark):
    items = [
        (1, "Calculate 12 + 30 * 4 - 18 / 6 and round to 2 digits."),
        (2, "Find the mean of 12, 15, 18, 21, 24, 27 and 30."),
        (3, "Which cities did Anna Maria Keller, John Smith and Peter Paul Rubens visit?"),
        (4, "Sort 5 3 9 1 7 2"),
        (5, "Table of 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 squares"),
    ]
    pad, found = "Some other words stand here before all of it. ", {}
    docs = [(i, pad + text + " And then more.", 0) for i, text in items]
    found |= {(i, i): "exact" for i, _ in items}
    docs += [(11, pad + items[0][1].replace("12", "55").replace("30", "77"), 0), (12, pad + items[1][1].replace("24", "99"), 0), (13, pad + items[2][1].replace("Smith", "Miller"), 0)]
    found |= {(10 + i, i): "reparameterised" for i in (1, 2, 3)}
    docs += [(24, pad + items[3][1].replace("9", "8"), 0), (25, pad + "We counted " + " ".join(map(str, range(40, 60))), 0)]  # lists of other numbers
    assert run(spark, docs, items) == found


def test_first_word_after_text_without_a_sentence_end(spark):
    items = [(1, SHORT), (2, "In which year did the old tower fall?"), (3, "days pass slowly in the old harbour"), (4, "Days are longer in the far north")]
    before = ["", "Question 5\n", "Question five\n", "5. ", "5) ", "A heading "]
    docs = [(10 * i + k, b + text, 0) for i, text in items for k, b in enumerate(before)]
    docs += [(91, "Question 5\n" + SHORT.replace("What", "Nothing"), 0), (92, "5. " + items[1][1].replace("In", "Cm"), 0)]  # other first words
    assert run(spark, docs, items) == {(10 * i + k, i): "exact" for i, _ in items for k in range(len(before))}


def test_names_at_sentence_starts_and_of_several_words(spark):
    items = [(1, "Robert walked 12 km to the market and bought 3 apples."), (2, "Anna Maria Keller has 7 cats and gives 2 of them to her brother."), (3, "A ship left Port Louis at 9 and sailed 40 miles a day until Friday.")]
    docs = [
        (11, "Once more. Anna walked 40 km to the market and bought 8 apples.", 0), (21, "Then came this. Tom has 5 cats and gives 1 of them to her brother. The end.", 0), (22, "Here Anna Maria Keller has 7 cats and gives 2 of them to her brother.", 0),
        (31, "A ship left Rotterdam at 6 and sailed 55 miles a day until Monday.", 0), (41, "Nobody walked home to the market and bought old apples.", 0),
    ]
    assert run(spark, docs, items) == {(11, 1): "reparameterised", (21, 2): "reparameterised", (22, 2): "exact", (31, 3): "reparameterised"}


def test_recall_of_items_with_other_parameters_and_no_false_finds(spark):
    """Made-up items whose numbers, names and units are drawn anew, within prose; at least 0.9 are found, and no prose alone."""
    rng = random.Random(8)
    names, places = ["Robert", "Anna", "Tom Miller", "Maria Lopez Diaz", "Kim", "Olga Petrova"], ["Oslo", "New York", "Lima", "Port Louis"]
    units, verbs, things = ["km", "miles", "m"], ["walks", "drives", "rides"], ["apples", "books", "coins", "stones", "lamps"]
    forms = [
        lambda v, t: lambda: f"{rng.choice(names)} {v} {rng.randrange(2, 99)} {rng.choice(units)} from {rng.choice(places)} and buys {rng.randrange(2, 99)} {t} for {rng.choice(names)} each week.",
        lambda v, t: lambda: f"Calculate {rng.randrange(99)} + {rng.randrange(99)} * {rng.randrange(99)} and give the number of {t} that remain after she {v}.",
        lambda v, t: lambda: f"If {rng.choice(names)} {v} at {rng.randrange(2, 99)} {rng.choice(units)} an hour, how many {t} are passed in {rng.randrange(2, 20)} hours?",
        lambda v, t: lambda: f"A box holds {rng.randrange(2, 99)} {t} and {rng.choice(names)} {v} with {rng.randrange(2, 99)} of these boxes to {rng.choice(places)}; how many {t} are there?",
    ]
    makers = [form(v, t) for form in forms for v in verbs for t in things]
    word = lambda: "".join(rng.choices("aeiourstln", k=rng.randrange(2, 9)))
    prose = lambda: " ".join([word().capitalize(), *(word() for _ in range(11))]) + ". "
    items = [(i, make()) for i, make in enumerate(makers)]
    docs = [(i, prose() + make() + " " + prose(), 0) for i, make in enumerate(makers)] + [(1000 + i, "".join(prose() for _ in range(9)), 0) for i in range(200)]
    got = run(spark, docs, items)
    assert sum((i, i) in got for i, _ in items) >= 0.9 * len(items) and all(d < 1000 for d, _ in got)
