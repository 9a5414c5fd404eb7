from math import exp, log

import pytest

from corpusflow.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, weight string, copy int"


def docs(spark, sizes):
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((n, "w " * (n % 7 + 1), source, "x", 1))
            n += 1
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_exponent(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10), ("d", 0)], "source string, tokens long")
    e = M.exponent_for(sources, repetition_limit=4.0)
    assert 100 ** (1 - e) == pytest.approx(4.0, abs=1e-6) and 100 ** (1 - e) <= 4.0
    target = 0.9
    e = M.exponent_for(sources, target_entropy=target)
    mass = [n**e for n in (1000, 100, 10)]
    assert -sum(m / sum(mass) * log(m / sum(mass)) for m in mass) == pytest.approx(target, abs=1e-6)
    assert M.exponent_for(sources, target_entropy=5.0) == 0.0 and M.exponent_for(sources, repetition_limit=1e9) == 0.0
    assert M.exponent_for(sources, target_entropy=0.0) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        M.exponent_for(sources)


def test_weights(spark):
    sources = spark.createDataFrame([("a", 1000), (None, 100), ("c", 0)], "source string, tokens long")
    rows = {r.source: r for r in M.mixture(sources, 0.5).collect()}
    assert rows["a"].weight + rows[None].weight == pytest.approx(1) and rows["a"].repeats == pytest.approx(1)
    assert rows[None].repeats == pytest.approx(exp(0.5 * log(10))) and (rows["c"].weight, rows["c"].repeats) == (0.0, 1.0)
    assert {r.source: r.repeats for r in M.mixture(sources, 1.0, budget=550).collect()}["a"] == pytest.approx(0.5)


def test_readings(spark):
    sizes = {"big": 800, "small": 80, "=": 40, None: 30}
    table = docs(spark, sizes)
    got = M.mix(table, repetition_limit=3.0, block_tokens=500).collect()
    assert len({(r.doc_id, r["copy"]) for r in got}) == len(got) and {r.doc_id for r in got} == set(range(950))
    tokens = {r.doc_id: r.tokens for r in got}
    total = {s: sum(tokens[i] for i in range(950) if i in ids) for s, ids in by_source(got).items()}
    largest, smallest = max(total.values()), min(total.values())
    for source, n in total.items():
        read = sum(r.tokens for r in got if r.source == source)
        want = n * (largest / n) ** (log(3) / log(largest / smallest))
        assert abs(read - want) <= 8, source  # up to one unit
    blocks = max(r.block for r in got) + 1
    for source, n in total.items():
        read = [sum(r.tokens for r in got if r.source == source and r.block == b) for b in range(blocks)]
        assert max(read) - min(read) <= 16, source


def by_source(rows):
    found = {}
    for r in rows:
        found.setdefault(r.source, set()).add(r.doc_id)
    return found


def test_odd_rows(spark):
    rows = [(1, None, None, "x", 1), (2, "", "a", "x", 1), (3, "w", "a", "x", 1), (3, "w w", "a", "x", 1), (None, "w", "a", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id, r.source, r.tokens) for r in M.mix(df).collect() if r["copy"] == 0) == [(1, None, 0), (2, "a", 0), (3, "a", 3)]
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns and sorted((r.doc_id or 0) for r in mixed.collect()) == [0, 1, 2, 3, 3]
    assert M.mix(df.limit(0)).collect() == [] and M.mixed_documents(df.limit(0)).collect() == []
