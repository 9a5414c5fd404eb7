import uuid

from corpusflow.plans.checkpoints import scratch_path
from corpusflow.sources import readers

PAGES = "url string, time long, html string"


def test_upsert_leaves_the_old_pages_where_they_are(spark):
    old = spark.createDataFrame([(f"u{i}", 1, f"old {i}") for i in range(50)], PAGES)
    new = spark.createDataFrame([("u1", 2, "a"), ("u1", 3, "b"), ("u1", 3, "b"), ("n", None, "c"), ("n", 1, "d"), (None, 1, "e"), (None, None, "f")], PAGES)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = readers.store_by_url(old, f"pages_{uuid.uuid4().hex}", scratch_path(spark, "by_url"))
        merged = readers.ingest_pages(stored, new, "overwrite")
        plan = merged._jdf.queryExecution().sparkPlan().toString()
        executed = merged._jdf.queryExecution().executedPlan().toString()
        rows = merged.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "WindowGroupLimit" in plan and "max_by" not in plan
    # the old side goes from its scan to the join without an exchange
    before_scan = executed[: executed.index("Bucketed: true")]
    join = before_scan[before_scan.rindex("SortMergeJoin") :]
    assert "Exchange" not in join
    found = {(r.url, r.time, r.html) for r in rows}
    assert len(rows) == 52 and {("u1", 3, "b"), ("n", 1, "d"), (None, 1, "e"), ("u2", 1, "old 2")} <= found


def test_no_new_pages(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 1, "y")], PAGES)
    none = spark.createDataFrame([], PAGES)
    assert len(readers.ingest_pages(old, none, "overwrite").collect()) == 2 and readers.ingest_pages(none, none, "overwrite").collect() == []
