from corpusflow.llm import compression_langid as C
from corpusflow.llm.common import in_fold

SCHEMA = "doc_id long, text string, lang string, best string"


def test_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = C.identify_language(docs, C.train_dictionaries(docs.where(~in_fold())))
    rows = [r for r in found.where(in_fold()).join(docs.select("doc_id", docs.lang.alias("true"), "n_chars"), "doc_id").collect()]
    assert sum(r.best == r.true for r in rows) / len(rows) > 0.97
    assert all(r.best == r.true for r in rows if r.n_chars > 1000 and r.margin > 0.02)
    assert all((r.lang == "und") == (r.margin < 0.01) and 0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    train = [(i, t, l, "x") for i, (t, l) in enumerate([("the cat sat on the mat " * 9, "en"), ("le chat est sur la table " * 9, "fr"), ("x", None), (None, "en"), ("12", "zz")] * 3)]
    dictionaries = C.train_dictionaries(spark.createDataFrame(train, SCHEMA))
    assert set(dictionaries) == {"en", "fr"}
    rows = [(1, None, None, "x"), (2, "", "en", "x"), (3, "12 ,. 3", "en", "x"), (None, "the cat sat on the", None, "x"), (4, "le chat est sur la " * 20_000, None, "x"), (4, "z", None, "x")]
    got = C.identify_language(spark.createDataFrame(rows, SCHEMA), dictionaries).collect()
    assert [r.best for r in got] == ["und", "und", "und", "en", "fr", got[5].best] and got[0].score == 0 and got[5].best in dictionaries
    empty = spark.createDataFrame([], SCHEMA)
    assert C.train_dictionaries(empty) == {} and C.identify_language(empty, dictionaries).collect() == []
    assert {r.best for r in C.identify_language(spark.createDataFrame(rows, SCHEMA), {}).collect()} == {"und"}


def test_dictionaries_are_bounded(spark):
    train = [(i, f"{i} " + "words of many kinds " * 30, "en" if i % 3 else "fr", "x") for i in range(2000)]
    df = spark.createDataFrame(train, SCHEMA)
    found = C.train_dictionaries(df, dictionary_bytes=4096)
    assert set(found) == {"en", "fr"} and all(len(d) <= 4096 for d in found.values())
    assert found == C.train_dictionaries(df.repartition(7), dictionary_bytes=4096)


def test_much_copied_language_is_learned(spark):
    train = [(i, "le chat est sur la table et le chien dort " * 4, "fr", "x") for i in range(3000)]
    train += [(i, f"{i} the cat sat on the mat and the dog sleeps " * 4, "en", "x") for i in range(3000)]
    dictionaries = C.train_dictionaries(spark.createDataFrame(train, SCHEMA))
    assert set(dictionaries) == {"en", "fr"}
    got = C.identify_language(spark.createDataFrame([(1, "le chien est sur la table", None, "x")], SCHEMA), dictionaries)
    assert got.first().best == "fr"
