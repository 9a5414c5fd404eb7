"""Work that must stay within the memory, disk or time of a task: one test for each step that was changed for it."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from corpusflow.operators import langid, positions
from corpusflow.operators import textometry as tx
from corpusflow.queries import base, streams


def batches_of(rows, size=7):
    core = [len(r) for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), pa.array(core, pa.int32())], names=["tokens", "core"])
    return [batch.slice(i, size) for i in range(0, len(rows), size)]


def random_rows():
    rng = random.Random(4)
    rows = [[f"w{int(rng.paretovariate(0.5)) % 500}" for _ in range(rng.randrange(40))] for _ in range(60)]
    return rows + [[f"w{i * 7 % 300}" for i in range(1000)]]


@pytest.mark.parametrize(("every_window", "mirrored"), [(False, False), (True, False), (False, True)])
def test_pairs_are_counted_and_leave_in_bounded_batches(monkeypatch, every_window, mirrored):
    """F1 to F8: neither the pairs that are counted at a time nor those that leave at a time grow with a task or a text."""
    rows = random_rows()

    def found():
        counted = list(tx._pair_counts(iter(batches_of(rows)), 5, every_window))
        assert all((np.diff(key) > 0).all() for _, key, _ in counted)
        parts = [r for counts in counted for r in tx._packed_rows(*counts, mirrored)]
        sums = {}
        for r in pa.Table.from_batches(parts).to_pylist():
            for y, n in zip(r["joined"].split("\0"), r["ns"], strict=True):
                sums[r["x"], y] = sums.get((r["x"], y), 0) + n
        return counted, parts, sums

    _, _, whole = found()
    for name, bound in (("PAIR_TOKENS", 200), ("PIECE_TOKENS", 200), ("PAIR_PLACES", 64), ("PAIR_ROWS", 50)):
        monkeypatch.setattr(tx, name, bound)
    counted, parts, sums = found()
    assert sums == whole
    assert max(len(key) for _, key, _ in counted) <= 4 * 300
    assert max(len(p.column("ns").flatten()) for p in parts if p.num_rows > 1) < 200


def test_cooccurrences_travel_packed(spark):
    """one exchange, of a row per token with its collocates and not of a row per pair."""
    tokens = spark.createDataFrame([(i, [f"w{j}" for j in range(50)]) for i in range(20)], "section_id long, tokens array<string>").coalesce(1)
    for counted in (tx._counted(tokens, 5, False), tx._counted(tokens, 5, True)):
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "joined" in plan[plan.index("Exchange"):]


def page_rows(spark):
    rows = [(i, f"http://h/{i}", f"<html><body><h1>t{i}</h1><p>One line. Two.</p></body></html>") for i in range(24)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_many_files_are_ingested_in_one_batch(spark, tmp_path, monkeypatch):
    """a batch is more than one file, so more than one task works on it; the second arrivals come later."""
    page_rows(spark).repartition(6).write.parquet(f"{tmp_path}/pages.parquet")
    seen = []
    plain = streams.ingest.latest_pages

    def latest(session, target):
        seen.extend(r.asDict() for r in session.read.parquet(target).groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("text").contains(" again")).alias("changed")).collect())
        return plain(session, target)

    monkeypatch.setattr(base, "TASK_BYTES", 500)
    monkeypatch.setattr(streams.ingest, "latest_pages", latest)
    got = contract.queries()["stream_ingest"](spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got) == list(range(24)) and min(r.nb_characters for r in got) >= len("t1 again\nOne line. Two.")
    assert sorted((r["batch"], r["n"], r["changed"]) for r in seen) == [(0, 24, 0), (1, 24, 24)]


def test_arrivals_are_made_by_all_tasks(spark):
    """the one task that writes the file of a batch does not make its rows."""
    made = spark.sparkContext.accumulator(0)

    def mark(batches):
        made.add(1)
        yield from batches

    rows = spark.range(40).repartition(4).mapInPandas(mark, "id long")
    streams.arriving(spark, rows)
    assert made.value == 4


def test_scores_of_lines_travel_without_grams(spark):
    """equal to a join of all grams with the profiles, also for repeated ids and grams; no gram leaves a task."""
    texts = spark.createDataFrame([(1, "der hund und die katze"), (2, "the dog"), (2, "the dog"), (None, "xyz"), (3, ""), (4, None)], "id long, text string")
    profiles = spark.createDataFrame(
        [("de", "er_", 5000), ("de", "und", 90000), ("de", "und", 7), ("en", "the", 400000), ("en", "", 3), (None, "xyz", 1), ("fr", None, 4), ("it", "und", None)],
        "lang string, gram string, weight long",
    )
    features, _ = langid.scored_features(texts, profiles)
    assert "grams" not in features.columns
    grams = langid.text_features(texts).where("chars > 0").collect()
    known = [(r.lang, r.gram, r.weight) for r in profiles.collect()]
    want = {}
    for r in grams:
        for lang in {k[0] for k in known}:
            own = [*((g.gram, g.weight) for g in r.grams), ("", 0)]
            shift = sum(abs(w - v) - v for g, v in own for at, k, w in known if at == lang and k == g and w is not None)
            key = (r.id, lang)
            want[key] = (r.chars, r.total, want.get(key, (0, 0, 0))[2] + shift)
    got = {(r.id, r.lang): r.score for r in langid.profile_distance(texts, profiles).collect()}
    assert got.keys() == want.keys()
    for key, (chars, total, shift) in want.items():
        weight = max(1, langid.SCALE // chars)
        assert got[key] == pytest.approx(((total + shift) / weight / chars - 1) * -100, abs=1e-9)
    assert langid.profile_distance(texts, profiles.limit(0)).count() == 0


def test_sizes_come_with_the_bags(spark, tmp_path):
    """the same cells, absent ones too, and null and repeated sections; the bags need no exchange but that of their sections."""
    rng = random.Random(9)
    rows = [(i % 30 or None, [f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randrange(1, 200))]) for i in range(45)]
    spark.createDataFrame(rows, "section_id long, tokens array<string>").write.parquet(f"{tmp_path}/t")
    tokens = spark.read.parquet(f"{tmp_path}/t").repartition(4, "section_id")
    sized = tx.sized_bag(tokens)
    assert sized._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = tx.specificity(sized, threshold=20.0).collect()
    want = tx.specificity(tx.bag_of_words(tokens), threshold=20.0).select(got[0].__fields__).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert any(r.freq == 0 for r in got)
    plan = tx.lexical_table(sized)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # the hot and the other tokens, no sizes
