import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusflow.operators import textometry as tx


def sections(spark, *texts):
    return spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "section_id long, label string, text string")


def test_tokens_keep_the_empty_edge(spark):
    row = tx.tokenize(sections(spark, "été l'année ñandú 123, foo_bar a/b. ")).first()
    assert row.tokens == ["été", "l", "année", "ñandú", "123", "foo_bar", "a/b", ""]


def test_cooccurrences_of_a_small_section(spark):
    got = {(r.x, r.y): r.cooc for r in tx.cooccurrences(tx.tokenize(sections(spark, "a b a c")), 3).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("a", "a"): 2, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}


def naive_windows(tokens, n, every):
    counts = Counter()
    for start in range(len(tokens) - n + 1):
        window = tokens[start : start + n]
        for i in range(n):
            for j in range(n):
                newest = start == 0 or n - 1 in (i, j)
                if i != j and (every or newest):
                    counts[window[i], window[j]] += 1
    return counts


def test_cooccurrences_equal_windows(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(4, 30))) for _ in range(40)]
    tokens = tx.tokenize(sections(spark, *texts))
    for every, fn in ((False, tx.cooccurrences), (True, tx.cooccurrences_multi)):
        want = sum((naive_windows(t.split(), 4, every) for t in texts), Counter())
        assert {(r.x, r.y): r.cooc for r in fn(tokens, 4).collect()} == dict(want)


def test_groups_give_the_tokens_of_the_joined_text(spark, monkeypatch):
    monkeypatch.setattr(tx, "STRETCH", 7)
    rng = random.Random(11)
    rows = [(rng.choice("xyz"), i, rng.choice(["", " ", ", ", "a b", "b c a.", " d", "e e e", "f"])) for i in range(120)]
    pieces = tx.sections_by_group(spark.createDataFrame(rows, "g string, i int, t string"), "g", ["i"], ["t"])
    tokens = tx.tokenize_groups(pieces, ["i"])
    bows, pairs = Counter(), Counter()
    for g in "xyz":
        whole = re.split(r"[^\w\/]+", "".join(t + "\n" for k, _, t in rows if k == g))
        bows.update((g, t) for t in whole)
        for i, a in enumerate(whole):
            for b in whole[i + 1 : i + 4]:
                pairs[a, b] += 1
                pairs[b, a] += 1
    assert {(r.section_id, r.token): r.freq for r in tx.bag_of_words(tokens).collect()} == dict(bows)
    got = tx.cooccurrences(tx.stretches(tokens, 4), 4)
    assert {(r.x, r.y): r.cooc for r in got.collect()} == dict(pairs)


def test_specificity_lists_absent_but_significant_cells(spark):
    bow = spark.createDataFrame(
        [(1, "x", 60), (1, "y", 40), (2, "y", 60), (2, "z", 40)], "section_id long, token string, freq long"
    )
    got = {(r.section_id, r.token): (r.freq, r.spec) for r in tx.specificity(bow).collect()}
    assert got[2, "x"][0] == 0 and got[2, "x"][1] < 0
    assert got[1, "x"][1] > 0 and got[1, "z"][1] < 0
    margins = tx.section_sizes(bow).agg(F.sum("size")).first()[0]
    assert margins == tx.vocabulary(bow).agg(F.sum("totfreq")).first()[0] == 200


def test_hot_token_takes_the_bounded_way(spark):
    bow = spark.range(5000).select(
        F.col("id").alias("section_id"), F.explode(F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id").cast("string")))).alias("token"),
        F.lit(1).cast("long").alias("freq"),
    )
    table = tx.lexical_table(bow)
    assert table.count() == 10000
    assert table.where("token = 'the'").select("totfreq").distinct().first()[0] == 5000


def test_graph_levels(spark):
    spec = spark.createDataFrame(
        [("a", "b", 9), ("a", "c", 8), ("b", "d", 7), ("b", "a", 6), ("c", "e", 5), ("d", "x", 4)],
        "token string, collocate string, spec int",
    )
    edges = tx.collocation_graph(spec, "a", k=2, depth=1)
    assert {(r.source, r.target) for r in edges.collect()} == {("a", "b"), ("a", "c"), ("b", "d"), ("b", "a"), ("c", "e")}
    assert {r.label: r.level for r in tx.graph_levels(edges, "a").collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2}


def test_describe_symbols(spark):
    vocab = spark.createDataFrame([("§€", 2), ("a", 1), ("\x07", 1)], "token string, totfreq long")
    got = {r.token: r.names for r in tx.describe_symbols(vocab).collect()}
    assert got == {"§€": "SECTION SIGN - EURO SIGN", "\x07": "Cc:7"}
