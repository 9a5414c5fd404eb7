"""State of the streams: rests of hosts, corrected totals, visited URLs that expire."""

import datetime

from pyspark.sql import functions as F

from corpusflow.operators import crawl
from corpusflow.queries.streams import arriving, emitted
from corpusflow.streaming import ingest

START = datetime.datetime(2024, 1, 1)


def log(spark, rows):
    """Rows of (second, id, host)."""
    made = [(START + datetime.timedelta(seconds=s), i, f"http://{h}/p{i}") for s, i, h in rows]
    return spark.createDataFrame(made, "ts timestamp, id long, url string")


def schedule(spark, batches, delay, late="1 hour"):
    stream = arriving(spark, *[log(spark, b) for b in batches])
    rows = emitted(ingest.stream_host_schedule(stream, "ts", "id", "url", delay, late)).collect()
    return {r.id: (r.start - START).total_seconds() for r in rows}


def by_loop(rows, delay):
    free, out = {}, {}
    for s, i, h in rows:
        out[i] = max(s, free.get(h, 0))
        free[h] = out[i] + delay
    return out


def test_hosts_rest_over_batches(spark):
    batches = [[(0, 1, "a"), (1, 2, "a"), (1, 3, "b")], [(2, 4, "a"), (50, 5, "a"), (50, 6, "c"), (50, 7, "c")], [(51, 8, "b"), (51, 9, "c"), (300, 10, "a")]]
    assert schedule(spark, batches, 10) == by_loop([r for b in batches for r in b], 10)
    # the order of rows within a batch is that of time and id
    assert schedule(spark, [list(reversed(b)) for b in batches], 10) == by_loop([r for b in batches for r in b], 10)


def test_schedule_of_links_that_all_wait_is_the_batch_one(spark):
    links = [(0, i, f"h{i % 3}") for i in range(30)]
    got = schedule(spark, [links[:13], links[13:]], 2)
    wanted = crawl.polite_schedule(log(spark, links), "id", "url", 2.0).collect()
    assert got == {r.id: r.start_second for r in wanted}


def test_rested_hosts_leave_the_state_and_late_rows_go(spark):
    batches = [[(0, 1, "a")], [(1000, 2, "b")], [(2000, 3, "b")], [(5, 4, "a"), (3000, 5, "a")]]
    stream = arriving(spark, *[log(spark, b) for b in batches])
    started = (
        ingest.stream_host_schedule(stream, "ts", "id", "url", 10, "1 minute").writeStream.outputMode("update").format("memory")
        .queryName("rested").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in started.recentProgress if p["stateOperators"]]
    assert states[0] == 1 and max(states) <= 2 and states[-1] <= 1
    assert {r.id for r in spark.table("rested").collect()} == {1, 2, 3, 5}


def test_totals_are_corrected(spark):
    schema = "url string, nb_sentences long, nb_characters long, n long"
    first = spark.createDataFrame([("a", 1, 10, 1), ("b", 2, 0, 2), ("a", 3, 30, 3), ("n", None, None, 1)], schema)
    second = spark.createDataFrame([("a", 2, 25, 4), ("c", 1, 5, 5)], schema)
    rows = emitted(ingest.stream_stats_delta(arriving(spark, first, second), "n"))
    total = rows.groupBy("batch").agg(*[F.sum(c) for c in rows.columns if c not in ("url", "batch")]).orderBy("batch").collect()
    assert [tuple(r) for r in total] == [(0, 3, 1, 5, 30, 2), (1, 1, 1, 0, 0, 2)]


def test_one_page_as_the_batch_delta(spark):
    schema = "url string, nb_sentences long, nb_characters long, n long"
    old = spark.createDataFrame([(f"u{i}", i, i * 10, 0) for i in range(0, 40, 2)], schema)
    new = spark.createDataFrame([(f"u{i}", i + 1, i * 11, 1) for i in range(40)], schema)
    rows = emitted(ingest.stream_stats_delta(arriving(spark, old, new), "n")).where("batch = 1")
    wanted = crawl.crawl_stats_delta(old, new)
    assert tuple(rows.agg(*[F.sum(c) for c in wanted.columns]).first()) == tuple(wanted.first())


def test_visited_urls_expire(spark):
    batches = [log(spark, [(0, 1, "a"), (1, 1, "a")]), log(spark, [(5000, 2, "b")]), log(spark, [(5001, 3, "c")]), log(spark, [(9000, 1, "a")])]
    started = (
        ingest.stream_dedup_urls_within(arriving(spark, *batches), "ts", "10 minutes").writeStream.outputMode("append").format("memory")
        .queryName("visited").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in started.recentProgress if p["stateOperators"]]
    assert max(states) <= 3 and states[-1] <= 2
    assert sorted(r.id for r in spark.table("visited").collect()) == [1, 1, 2, 3]
