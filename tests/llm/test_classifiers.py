import random

import numpy as np
from pyspark.sql import functions as F

from corpusflow.llm import ordinal_quality as Q
from corpusflow.llm import toxicity as T
from corpusflow.llm.common import in_fold
from corpusflow.llm.features import labelled_sample

DOCS = "doc_id long, text string, lang string, label string, score int"


def toxic_texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("mor", "tal", "ken", "ri", "so") for b in ("a", "en", "ost", "il", "ur", "em")]
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randrange(1, 9))]
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["Vile", "scumbag"])
        rows.append((i, ". ".join(sentences), int(bad)))
    return rows


def test_offending_sentences_are_found(spark):
    rows = toxic_texts(400)
    model = T.train(spark.createDataFrame([(i, t, y) for i, t, y in rows[:300]], "_id long, text string, label int"))
    got = {r.doc_id: r for r in T.score_toxicity(spark.createDataFrame([(i, t, "x", "y", 0) for i, t, _ in rows[300:]], DOCS), model).collect()}
    for i, text, y in rows[300:]:
        assert (got[i].score >= 0.3) == bool(y)
        assert [bool({"vile", "scumbag"} & set(text[s.start : s.end].lower().split())) for s in got[i].spans] == [True] * y


def test_toxicity_of_odd_rows(spark):
    model = T.train(spark.createDataFrame([(i, t, y) for i, t, y in toxic_texts(300)], "_id long, text string, label int"))
    rows = [(1, None), (2, ""), (None, "vile"), (3, "mora " * 100_000 + "vile"), (3, "...!?\n"), (4, "morA " * 100_000)]
    got = T.score_toxicity(spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], DOCS), model).collect()
    assert [r.score >= 0.3 for r in got] == [False, False, True, True, False, False] and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score
    nothing = T.train(spark.createDataFrame([], "_id long, text string, label int"))
    assert all(r.score < 0.01 for r in T.score_toxicity(spark.createDataFrame([(1, "vile", "x", "y", 0)], DOCS), nothing).collect())
    assert T.score_toxicity(spark.createDataFrame([], DOCS), model).collect() == []


def test_grades_are_ordered(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        grade = i % 4
        words = [rng.choice(["good", "fine"]) if rng.random() < grade / 3 else rng.choice(["bad", "poor"]) for _ in range(30)]
        rows.append((i, " ".join(words), grade + 1))
    model = Q.train(spark.createDataFrame(rows[:700], "_id long, text string, label int"))
    assert model.grades == [1, 2, 3, 4] and (np.diff(model.thresholds) > 0).all()
    test = spark.createDataFrame([(i, t, "x", "y", 0) for i, t, _ in rows[700:]], DOCS)
    for wanted in (2, 3, 4):
        got = {r.doc_id: r for r in Q.grade_texts(test, model, wanted).collect()}
        assert np.mean([(got[i].tail_probability >= 0.5) == (g >= wanted) for i, _, g in rows[700:]]) > 0.9
        assert all(0 <= r.tail_probability <= 1 and 1 <= r.expected_grade <= 4 for r in got.values())
    assert np.corrcoef([got[i].expected_grade for i, _, _ in rows[700:]], [g for *_, g in rows[700:]])[0, 1] > 0.9
    assert all(r.tail_probability == 1 for r in Q.grade_texts(test, model, 1).collect())
    assert all(r.tail_probability == 0 for r in Q.grade_texts(test, model, 5).collect())


def test_gradient_of_the_ordinal_likelihood(spark):
    """With one feature for all the thresholds alone must meet the shares of the grades."""
    rows = [(i, "", g) for i, g in enumerate([0] * 50 + [1] * 30 + [5] * 20)]
    model = Q.train(spark.createDataFrame(rows, "_id long, text string, label int"), epochs=600)
    below = 1 / (1 + np.exp(-model.thresholds))
    assert np.allclose(below, [0.5, 0.8], atol=0.02)


def test_quality_of_odd_rows(spark):
    one = Q.train(spark.createDataFrame([(1, "a b", 1)], "_id long, text string, label int"))
    none = Q.train(spark.createDataFrame([], "_id long, text string, label int"))
    rows = [(1, None), (2, ""), (None, "x"), (3, "x y " * 100_000), (3, "z")]
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], DOCS)
    assert [r.tail_probability for r in Q.grade_texts(df, one, 1).collect()] == [1.0] * 5
    assert len(Q.grade_texts(df, none, 1).collect()) == 5 and Q.grade_texts(df.limit(0), one, 1).collect() == []
    kept = Q.drop_rejected(df, one)
    assert kept.columns == df.columns and kept.count() == 5


def test_sample_is_bounded_and_independent_of_order(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("x").alias("label"))
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"), F.lit(1).alias("toxic"))
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (5, None, 1), (4, 1, 1)], "doc_id long, quality long, toxic int"))
    take = lambda l: sorted((r._id, r.label) for r in labelled_sample(docs, l, "quality", 300, ~in_fold("_id")).collect())
    rows = take(labels)
    assert 200 < len(rows) < 400 and rows == take(labels.repartition(7)) and len({i for i, _ in rows}) == len(rows)
    assert len(labelled_sample(docs, labels, "quality", 10_000, F.lit(True)).collect()) == 2000


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.op9_quality(spark, sf).where("held_out").join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.98 and sum(r.kept for r in rows if r.quality == 0) <= len(rows) * 0.05
    rows = T.op8_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.08 * len(rows)
    assert np.mean([r.score for r in rows if r.toxic == 1]) > 3 * np.mean([r.score for r in rows if r.toxic == 0])
