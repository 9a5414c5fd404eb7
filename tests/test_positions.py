"""The stored index answers as the scans do, and reads the blocks of the word it is asked for."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import concordance as kwic
from corpusflow.operators import positions
from corpusflow.operators import textometry as tx


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    words = ["the", "cat", "sat", "on", "mat", "É", "a/b", "x_y"] + [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(rng.choice(words[:8] if rng.random() < 0.5 else words) for _ in range(rng.randrange(80)))) for i in range(120)]
    texts += [(200, ""), (201, "the " * 9000), (202, "The/cat sat."), (203, "…the…")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    tokens = tx.tokenize(tx.sections_by_row(docs, "doc_id", "doc_id", ["text"]))
    path = str(tmp_path_factory.mktemp("index") / "words")
    positions.write_index(tokens, path, 4, row_group_bytes=4096, files=4)
    return docs, tokens, positions.read_index(spark, path, 4)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_positions_and_phrases(corpus):
    _, tokens, index = corpus
    texts = {r.section_id: r.tokens for r in tokens.collect()}
    for word in ("the", "w7", "none", ""):
        assert rows(positions.token_positions(index, word)) == sorted([(s, i) for s, t in texts.items() for i, w in enumerate(t) if w == word], key=repr)
    wanted = [(s, i) for s, t in texts.items() for i in range(len(t) - 1) if t[i : i + 2] == ["the", "cat"]]
    assert rows(positions.phrase(index, ["the", "cat"])) == sorted(wanted, key=repr)
    assert index.postings.select(F.max(F.size("positions"))).first()[0] == positions.BLOCK


@pytest.mark.parametrize("word", ["the", "w7", "none"])
def test_as_the_scans(corpus, word):
    docs, tokens, index = corpus
    bow = tx.bag_of_words(tokens)
    assert rows(positions.sections_with_token(index, word)) == rows(tx.sections_with_token(bow, word))
    assert rows(positions.token_evolution(index, word)) == rows(tx.token_evolution(bow, word))
    assert rows(positions.concordance(index, docs, "doc_id", "text", word)) == rows(kwic.concordance(docs, "doc_id", "text", word))
    cooc, vocab = tx.cooccurrences(tokens, 4), tx.vocabulary(bow)
    every = tx.collocation_specificity(cooc, vocab, 4)
    assert rows(positions.collocation_table(index, word)) == rows(tx.collocation_table(every, vocab, word))
    assert rows(positions.collocation_graph(index, word, 2, 2)) == rows(tx.collocation_graph(every, word, 2, 2).select(*positions.collocation_graph(index, word, 2, 2).columns))


def scanned(df):
    """Rows that the scans of a plan have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf if not hasattr(leaf, "plan") else leaf
        total += leaf.metrics().apply("numOutputRows").value()
    return total


def test_a_word_is_pushed_down_and_few_rows_are_read(spark, corpus):
    index = corpus[2]
    one = index.postings.where(F.col("token") == "w7").select("section_id")
    assert "EqualTo(token,w7)" in one._jdf.queryExecution().executedPlan().toString()
    assert scanned(one) < index.postings.count() / 4
    assert scanned(index.pairs.where(F.col("x") == "w7").select("y")) < index.pairs.count() / 4
