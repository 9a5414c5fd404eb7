from corpusflow.llm import templates as T

DOCS = "doc_id long, text string, gone string, h int"
ITEMS = "item_id long, text string"
QUESTION = "Last week our friend Anna Berg had 12 apples and gave 5 kg to her neighbour Tom, so Anna Berg kept 7 for the pie that she makes."


def found(spark, docs, items, **settings):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
    return {(r.doc_id, r.item_id): r for r in T.contaminated(d, spark.createDataFrame(items, ITEMS), **settings).collect()}


def test_template():
    words, places, values = T.template("The 3 km to New York City cost $5.50. Berlin is far, says Anna. NASA 7")
    assert words == ["the", T.NUMBER, T.UNIT, "to", T.NAME, "cost", "$", T.NUMBER, "berlin", "is", "far", "says", T.NAME, "nasa", T.NUMBER]
    assert [words[p] for p in places] == [T.NUMBER, T.UNIT, T.NAME, T.NUMBER, T.NAME, T.NUMBER]
    assert values == ["3", "km", "new york city", "5.50", "anna", "7"]
    assert T.template(None) == T.template("") == ([], [], [])


def test_windows_are_those_of_their_words():
    make = T.Windows(4)
    a, b = make.of(list("abcdefgh")), make.of(list("xxcdefyy"))
    assert a[2] == b[2] and len(set(a.tolist()) & set(b.tolist())) == 1
    assert len(make.of(list("ab"))) == 1 and make.of(list("ab"))[0] not in a and len(make.of([])) == 0


def test_reparameterised_question_is_found(spark):
    other = QUESTION.replace("Anna Berg", "Otto").replace("Tom", "Mia Lang").replace("12", "40").replace("5 kg", "15 lb").replace("7", "25")
    mixed = QUESTION.replace("Anna Berg", "Otto", 1)  # one name for two: no consistent reading of the whole
    docs = [
        (1, "Some words before. " + QUESTION + " And after it."), (2, "before " * 50 + other), (3, mixed), (4, "Something else with 12 apples and Anna in it, of no length."),
        (5, None), (6, ""), (None, QUESTION), (7, QUESTION.upper()), (7, QUESTION), (8, ("x " * 30_000) + QUESTION),
    ]
    got = found(spark, docs, [(10, QUESTION), (10, QUESTION), (11, None), (12, ""), (None, QUESTION), (13, "An other item of no length at all in here.")])
    assert set(k for k in got if k[0] != 3) == {(1, 10), (2, 10), (7, 10), (8, 10)}
    assert got[1, 10].changed_slots == 0 and got[2, 10].changed_slots >= 4 and got[1, 10].coverage > 0.8


def test_inconsistent_slots_do_not_match(spark):
    item = "we know that 3 is less than 9 and that 3 is odd while 9 is odd and 3 goes into 9"
    docs = [(1, item), (2, item.replace("3", "5").replace("9", "25")), (3, "we know that 1 is less than 2 and that 8 is odd while 7 is odd and 6 goes into 4")]
    assert set(found(spark, docs, [(1, item)])) == {(1, 1), (2, 1)}


def test_values_that_become_equal_and_parts_of_names(spark):
    kept = "the farmer who lives by the old river sold {} of his sheep and then bought {} of the brown cows at the market"
    twice = "on the table by the door there are {} kg of flour and also {} apples that we want to use for the cake"
    names = "in the morning {} went down to the river with a net and in the evening {} came back to the house with nothing"
    items = [(1, kept.format(3, 9)), (2, twice.format(5, 5)), (3, names.format("Anna Berg", "Anna"))]
    docs = [(1, kept.format(4, 4)), (2, twice.format(7, 2)), (3, names.format("Otto", "Otto")), (4, names.format("Otto Lang", "Otto"))]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 2), (3, 3), (4, 3)}


def test_short_items_and_windows_of_their_length(spark):
    docs = [(1, "he said what is the capital of france and left"), (2, "what is the capital of france"), (3, "what is the capital of spain then")]
    assert set(found(spark, docs, [(1, "What is the capital of france?"), (2, "Yes or no?")])) == {(1, 1), (2, 1)}


def test_items_of_numbers_and_names(spark):
    items = [(1, "2 + 2 = ?"), (2, "Who wrote Hamlet?"), (3, "What is 12 + 7?"), (4, "Anna, 12 March 2004; Tom, 13 May 2005; Eva, 14 June 2006; Otto, 15 July 2007"),
             (5, "Der Mann sah Haus, Hund, Katze, Maus und Baum im Garten bei Regen, Wind und Schnee am Abend")]
    docs = [(i, f"he said this to us: {t} and so it was") for i, t in items] + [(10, "there were 2, 2 or 3 of them"), (11, "what is 12, 7 or 5"), (12, "who wrote 7")]
    assert set(found(spark, docs, items)) == {(i, i) for i, _ in items}
    assert set(found(spark, [(1, "so 12+7 is: What is 12 +7?")], items)) == {(1, 3)}


def test_items_within_lines_and_in_other_cases(spark):
    items = [(1, "What is the capital of France?"), (2, "How many of the 12 boxes are in Berlin now?")]
    docs = [(1, "Q: What is the capital of France?"), (2, "what is the capital of france"), (3, "so Anna (What is the capital of France) said"), (4, "7 What is the capital of Spain"),
            (5, "Q: How many of the 30 boxes are in Paris now"), (6, "how many of the 30 boxes are in berlin now"), (7, 'he said "How many of the 12 boxes are in Berlin now"'), (8, "WHAT IS THE CAPITAL OF FRANCE"),
            (9, "what is the capital of spain"), (10, "how few of the 30 boxes are in berlin then")]
    got = set(found(spark, docs, items))
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 1), (5, 2), (6, 2), (7, 2)}


def test_drop(spark):
    d = spark.createDataFrame([(1, QUESTION, "a", 1), (2, "fine", "b", 2), (None, QUESTION, "c", 3)], DOCS)
    kept = T.drop_contaminated(d, spark.createDataFrame([(1, QUESTION)], ITEMS))
    assert kept.columns == d.columns and sorted(r.gone for r in kept.collect()) == ["b", "c"]
    nothing = spark.createDataFrame([], ITEMS)
    assert T.drop_contaminated(d, nothing).count() == 3 and T.drop_contaminated(d.limit(0), nothing).count() == 0


def test_documents_against_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id for r in T.contaminated(docs, items).collect()}
    squeezed = lambda t: " ".join(t.lower().split())
    texts = [squeezed(r.text) for r in items.collect()]
    assert got == {r.doc_id for r in docs.collect() if any(t in squeezed(r.text) for t in texts)}


def test_many_texts_are_read_as_each_alone():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    parts = ["3", "km", "Anna", "Berg", "the", "NASA", ".", "!", "\n", "+7", "in", "Y", "$", "house", "it’s", "5.50", "12", ",", "°"]
    texts = [" ".join(rng.choice(parts, n)) for n in rng.integers(0, 40, 300)] + [None, "", ". . .", "Anna", "3 km", ". km"]
    readings = {T.TEMPLATE: {}, T.WITHIN: {"begins": False}}
    for _, held in T.slices(pd.Series(range(len(texts))), pd.Series(texts), T.Pieces()):
        for reading in (T.TEMPLATE, T.WITHIN, T.LOWERED, T.SPELLED):
            words = held.words(reading)
            for t, text in enumerate(held.texts):
                pieces = T.pieces_of(text)
                lowered = [(T.PLAIN if k == T.CAPITAL else k, low, h) for k, low, h in pieces]
                begin, n = int(words.offsets[t]), int(words.counts[t])
                got = words.hashes[begin : begin + n].tolist()
                if reading == T.SPELLED:
                    assert got == T.spelled(pieces)
                    continue
                _, places, values, hashes = T.template_of(lowered if reading == T.LOWERED else pieces, **readings.get(reading, {}))
                assert got == hashes and held.values(words, begin, begin + n) == values
                assert np.flatnonzero(np.diff(words.slots_before[begin : begin + n + 1])).tolist() == places
                if reading != T.TEMPLATE:
                    assert held.differs(reading)[t] == ((hashes, values) != (T.template_of(pieces)[3], T.template_of(pieces)[2]))
