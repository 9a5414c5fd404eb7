"""Work that must not grow with a batch, a partition or a table: one test for each step that was changed for it."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from corpusflow.functions import html
from corpusflow.llm import common
from corpusflow.operators import langid, positions
from corpusflow.operators import textometry as tx
from corpusflow.operators import texttools as tt
from corpusflow.queries import base
from corpusflow.sources import readers


def test_features_leave_in_bounded_batches(monkeypatch):
    texts = [f"word{i} and other{i * 7} words" for i in range(200)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts, "seen": texts})
    whole = list(langid._feature_batches([batch], 3, 500))
    monkeypatch.setattr(langid, "BATCH_GRAMS", 100)
    parts = list(langid._feature_batches([batch], 3, 500))
    assert len(parts) > 30 and max(len(r) for p in parts for r in [p.column("grams").flatten()]) < 150
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(whole).to_pylist()


@pytest.mark.parametrize("name", ["stream_dedup_urls", "stream_dedup_urls_within"])
def test_streams_read_tables_of_many_files(spark, tmp_path, name):
    rows = [(i, f"http://h/{i % 5}", "<p>x</p>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = contract.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(r.url for r in got) == [f"http://h/{i}" for i in range(5)]


@pytest.mark.parametrize("name", ["stream_stats", "stream_host_rate"])
def test_event_streams_read_tables_of_many_files(spark, tmp_path, name):
    events = spark.range(40).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"),
    )
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert contract.queries()[name](spark, str(tmp_path)).agg(F.sum("n")).first()[0] == 40


def counted_by_hand(rows, n, every_window=False):
    counts = {}
    for tokens in rows:
        tokens = tokens or []
        spans = [range(s, s + n) for s in range(len(tokens) - n + 1)] if every_window else [range(len(tokens))]
        for span in spans:
            for i in span:
                for j in span:
                    if i != j and abs(i - j) < n:
                        counts[tokens[i], tokens[j]] = counts.get((tokens[i], tokens[j]), 0) + 1
    return counts


TOKEN_ROWS = [["b", "a", "b", "é", "", "z"], ["a"], [], None, ["x\0y", "a", "b", "a", "\U0001f600", "￮", "a", "a"]] * 3


@pytest.mark.parametrize("bound", [1, 7, 1 << 20])
def test_pairs_are_counted_in_tasks(spark, monkeypatch, bound):
    monkeypatch.setattr(tx, "PAIR_TOKENS", bound)
    tokens = spark.createDataFrame(list(enumerate(TOKEN_ROWS)), "section_id long, tokens array<string>").coalesce(1)
    for n in (2, 4):
        want = counted_by_hand(TOKEN_ROWS, n)
        for df in (tx.cooccurrences(tokens, n), tx.packed_cooccurrences(tokens, n), tx.packed_cooccurrences(tokens, n, 3)):
            assert {(r.x, r.y): r.cooc for r in df.collect()} == want
        assert {(r.x, r.y): r.cooc for r in tx.cooccurrences(tokens, n, ["a", "é"]).collect()} == {k: v for k, v in want.items() if k[0] in ("a", "é")}
        assert {(r.x, r.y): r.cooc for r in tx.cooccurrences_multi(tokens, n).collect()} == counted_by_hand(TOKEN_ROWS, n, True)
    # few rows leave a task, not one for each pair of places
    rows = tx._by_arrow(spark.createDataFrame([(1, ["a", "b"] * 500)], "section_id long, tokens array<string>"), 5, False).toArrow().to_batches()
    assert sum(len(key) for _, key, _ in tx._pair_counts(iter(rows), 5, False)) == 3


def test_postings_of_sections_in_several_rows(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["a"]), (None, ["b"]), (None, ["b", "a"]), (2, ["", "a"]), (3, []), (4, None)]
    tokens = spark.createDataFrame(rows, "section_id long, tokens array<string>")
    got = {(r.token, r.section_id, r.part): r.positions for r in positions.postings_of(tokens, 2).collect()}
    assert got == {
        ("a", 1, 0): [0, 0], ("a", 1, 1): [2], ("b", 1, 0): [1], ("b", None, 0): [0, 0], ("a", None, 0): [1], ("", 2, 0): [0], ("a", 2, 0): [1],
    }


def test_an_index_shuffles_tokens_once(spark, tmp_path):
    tokens = spark.createDataFrame([(i, f"the word {i % 3} of the text".split()) for i in range(50)], "section_id long, tokens array<string>")
    assert positions.postings_of(tokens)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    positions.write_index(tokens, str(tmp_path), 3)
    index = positions.read_index(spark, str(tmp_path), 3)
    assert {(r.section_id, r.size, r.n_types) for r in index.sizes.collect()} == {(i, 6, 5) for i in range(50)}
    assert {r.token: r.totfreq for r in index.vocabulary.collect()}["the"] == 100
    assert {(r.x, r.y): r.cooc for r in index.pairs.collect()} == {(r.x, r.y): r.cooc for r in tx.cooccurrences(tokens, 3).collect()}


def test_heavy_tables_get_tasks_by_their_size(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id AS doc_id", "repeat('x', 10) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    assert base.heavy(spark, str(tmp_path), "documents").count() == 1000
    monkeypatch.setattr(base, "TASK_BYTES", 500)
    assert base.heavy(spark, str(tmp_path), "documents").rdd.getNumPartitions() > 4


def test_profiles_count_the_grams_of_each_text(spark, monkeypatch):
    rows = [("a", "ab ab"), ("a", "x"), ("a", ""), ("a", None), ("b", "\U0001f600 é\n\tab　c"), (None, "zzzz"), ("b", "b"), ("b", " ")]
    want = {}
    for lang, text in rows:
        padded = re.sub(r"\s+", "_", f" {text} ") if text else ""
        for i in range(len(padded) - 3):
            want[lang, padded[i : i + 3]] = want.get((lang, padded[i : i + 3]), 0) + 1
    for bound in (1, 1 << 22):
        monkeypatch.setattr(langid, "BATCH_CHARS", bound)
        batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows if r[1]], "text": [r[1] for r in rows if r[1]]})
        got = {}
        for r in (r for part in langid._gram_counts(iter([batch])) for r in part.to_pylist()):
            got[r["lang"], r["gram"]] = got.get((r["lang"], r["gram"]), 0) + r["n"]
        assert got == want


class Told(str):
    """A text that counts how often a piece of it is taken."""

    taken = 0

    def __getitem__(self, part):
        Told.taken += 1
        return str.__getitem__(self, part)


def test_segmentation_tries_lengths_of_words_that_may_begin():
    words = {"ab", "abcd", "x" * 60, "é\U0001f600é", "c"}
    assert tt._longest_first("abcdabcé\U0001f600éz" + "x" * 61 + "ab", words) == " ".join(["abcd", "ab", "c", "é\U0001f600é", "z", "x" * 60, "x", "ab"])
    Told.taken = 0
    tt._longest_first(Told("z" * 100), words)
    assert Told.taken <= 200


def test_hidden_files_are_found_without_listing_all(spark, tmp_path):
    for name in ["a.txt", "_b.txt", ".c.txt", "d/_e.txt", "d/f.txt", "d/_g/h.txt", "d/_g/.i.txt", ".j/k/_l.txt", "d/m/n/_o.txt"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = sorted(p.split(f"{tmp_path}/")[1] for p in readers._hidden_files(spark, str(tmp_path)))
    assert got == [".j/k/_l.txt", "_b.txt", "d/_e.txt", "d/_g/h.txt", "d/m/n/_o.txt"]


@pytest.mark.parametrize("bound", [1, 7, 1 << 20])
def test_tokens_are_replaced_by_a_row_s_own_forms(monkeypatch, bound):
    monkeypatch.setattr(tt, "SAID_TOKENS", bound)
    rows = [
        (1, ["a", "b", "a", "é", ""], ["é", "a"], ["E f", "A"]), (2, ["a", "b"], None, None), (3, None, None, None), (4, [""], [""], ["-"]),
        (5, [], None, None), (None, ["b"], ["b"], [""]), (7, ["a"] * 9 + ["z"], ["z", "a"], ["a", "z"]),
    ]
    batch = pa.RecordBatch.from_pydict(dict(zip(("k", "_tokens", "_forms", "_said"), map(list, zip(*rows)))))
    got = [r for b in tt._said_batches(iter([batch.slice(0, 0), batch, batch.slice(1, 4)]), "out") for r in b.to_pylist()]
    want = [{"k": k, "out": None if t is None else " ".join(dict(zip(f or [], s or [])).get(w, w) for w in t)} for k, t, f, s in rows]
    assert got == want + want[1:5]


@pytest.mark.parametrize("few", [0, 2, 64])
def test_distinct_entities_are_decoded_once(spark, monkeypatch, few):
    monkeypatch.setattr(html, "FEW_ENTITIES", few)
    texts = {
        "&amp;&lt;&amp;x&gt;&eacute;": "&<&x>é", "&#233;&#xE9;&#146;&bogus;&#233;é": "éé’ éé", "&#1114112;&#55296;|&#128512;": "  |\U0001f600",
        "&": "&", "": "", "a & b;c": "a  c", "&\n;": "&\n;", "no": "no",
    }
    df = spark.createDataFrame([*[(t,) for t in texts], (None,)], "t string")
    assert {r.t: r.d for r in df.select("t", html.decode_entities(F.col("t")).alias("d")).collect()} == texts | {None: None}


def test_rows_that_surely_stay_are_not_shuffled(spark):
    docs = spark.range(2000).selectExpr("CASE WHEN id % 100 = 0 THEN NULL ELSE id END AS doc_id", "repeat('x', 100) AS text")
    docs = docs.unionAll(docs.where("doc_id = 7"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = common.without(docs, spark.range(5, 15).unionAll(spark.range(5, 6)).toDF("gone"), "doc_id")
        ids = [r.doc_id for r in kept.collect()]
        waiting, moved = [kept._jdf.queryExecution().executedPlan()], []
        while waiting:
            node = waiting.pop()
            if node.nodeName() == "Exchange":
                moved.append(node.metrics().apply("shuffleRecordsWritten").value())
            waiting += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ids.count(None) == 20 and sorted(i for i in ids if i is not None) == [i for i in range(2000) if i % 100 and not 5 <= i < 15]
    assert kept.columns == ["doc_id", "text"] and sum(moved) < 200


@pytest.mark.parametrize("top", [0, 3, 1 << 16])
def test_pairs_bring_their_totals(spark, monkeypatch, top):
    monkeypatch.setattr(tx, "TOP_WORDS", top)
    monkeypatch.setattr(tx, "TASK_TOKENS", 10)
    tokens = spark.createDataFrame(list(enumerate(TOKEN_ROWS)), "section_id long, tokens array<string>")
    vocab = tx.vocabulary(tx.bag_of_words(tokens))
    totals = {r.token: r.totfreq for r in vocab.collect()}
    cooc = tx.cooccurrences_with_totals(tokens, vocab, 4)
    want = {(x, y, n, totals[x], totals[y]) for (x, y), n in counted_by_hand(TOKEN_ROWS, 4).items()}
    assert len(rows := cooc.collect()) == len(want) and {tuple(r) for r in rows} == want
    assert not tx.cooccurrences_with_totals(tokens.limit(0), vocab.limit(0), 4).collect()
    old = tx.collocation_specificity(tx.cooccurrences(tokens, 4), vocab, 4, 30.0)
    new = tx.collocation_specificity(cooc, vocab, 4, 30.0)
    assert new.schema == old.schema and sorted(new.collect()) == sorted(old.collect()) != []


def test_pairs_are_shuffled_once_for_their_sums_and_totals(spark):
    tokens = spark.createDataFrame(list(enumerate(TOKEN_ROWS)), "section_id long, tokens array<string>").localCheckpoint()
    vocab = tx.vocabulary(tx.bag_of_words(tokens)).localCheckpoint()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tx.cooccurrences_with_totals(tokens, vocab, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [line for line in plan.splitlines() if re.search(r"\bExchange hashpartitioning", line) and "ReusedExchange" not in line]
    # packed pairs, totals, pairs of two rare tokens; the rest is read again
    assert len(lines) == 3 and "ReusedExchange" in plan
