"""Paths to seeds, depth-first order, and rows of one file on all cores."""

import random

from corpusflow.operators import crawl
from corpusflow.queries.base import heavy


def paths_by_loop(rows):
    parent = {r: p for r, _, p in rows}
    url = {r: u for r, u, _ in rows}
    out = []
    for r in parent:
        way, at = [r], r
        while len(way) <= len(rows) and parent[at] in parent and parent[at] != at:
            at = parent[at]
            way.append(at)
        if len(way) > len(rows):
            out.append((r, url[r], None, None, None))
        else:
            out.append((r, url[r], len(way) - 1, at, [url[x] for x in reversed(way)]))
    return out


def check_paths(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "rowid long, url string, link_origin_rowid long, path string").repartition(4)
    got = crawl.link_path(df).select("rowid", "url", "depth", "seed", "path").collect()
    order = lambda r: r[0]
    assert sorted(map(tuple, got), key=order) == sorted(paths_by_loop(rows), key=order)


def test_paths_to_seeds(spark):
    rng = random.Random(1)
    tree = [(i, f"u{i}", rng.choice([None, -1, i, *range(i)]) if i < 3 else rng.randrange(i)) for i in range(200)]
    cycle = [(1000, "c0", 1001), (1001, "c1", 1002), (1002, "c2", 1000), (1003, "behind", 1001)]
    check_paths(spark, tree + cycle)


def test_path_of_a_long_chain_and_of_a_star(spark):
    check_paths(spark, [(i, f"u{i}", i - 1) for i in range(1000)])
    check_paths(spark, [(0, "s", None)] + [(i, f"u{i}", 0) for i in range(1, 300)])


def test_no_sources(spark):
    assert crawl.link_path(spark.createDataFrame([], "rowid long, url string, link_origin_rowid long")).collect() == []
    assert crawl.depth_first_order(spark.createDataFrame([], "rowid long, parent long, pos long")).collect() == []


def stack_order(rows):
    stored = {r for r, _, _ in rows}
    children = {}
    for r, p, pos in rows:
        children.setdefault(p if p in stored else None, []).append((pos, r))
    stack, out = sorted(children.get(None, []), reverse=True), {}
    while stack:
        _, r = stack.pop()
        out[r] = len(out) + 1
        stack += sorted(children.get(r, []), reverse=True)
    return out


def test_depth_first_order(spark):
    rng = random.Random(2)
    rows = [(i * 3, rng.choice([None, 999_999]) if i < 4 else rng.randrange(i) * 3, rng.randrange(3)) for i in range(300)]
    rows += [(i, i - 3, 0) for i in range(3000, 3120, 3)]  # a chain
    loop = [(5000, 5001, 0), (5001, 5000, 0), (5002, 5001, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + loop], "rowid long, parent long, pos long, nth string").repartition(3)
    wanted = stack_order(rows + loop)
    got = crawl.depth_first_order(df).collect()
    assert len(got) == len(rows) + 3
    assert {r.rowid: r.visit_no for r in got} == {r: wanted.get(r) for r, _, _ in rows + loop}


def test_rows_of_one_row_group_go_to_all_cores(spark, tmp_path):
    text = "concat_ws(' ', transform(sequence(1, 40), i -> sha2(string(id * 100 + i), 256))) AS text"
    spark.range(4000).selectExpr("id", text).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    sizes = heavy(spark, str(tmp_path), "one").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 4000 and sum(n > 400 for n in sizes) >= spark.sparkContext.defaultParallelism
