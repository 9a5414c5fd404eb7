import hashlib
import re

import pytest
from pyspark.sql import types as T

from corpusflow.plans import bloom
from corpusflow.llm.exact_dedup import exact_duplicates

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("sha", T.StringType()),
                       T.StructField("maybe", T.BooleanType())])


def brute(rows):
    groups = {}
    for n, (key, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((key is None, key or 0, n, key))
    out = []
    for text, members in groups.items():
        first = min(members)
        for m in members:
            out.append((m[3], first[3], len(members), m[2] == first[2], hashlib.sha256(text.encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)


@pytest.mark.parametrize("max_bits", [bloom.MAX_BITS, 1 << 18])
def test_groups(spark, max_bits):
    texts = ["a b", "a  b", "a\tb", "a b", "", None, " ", "x" * 50_000, "x" * 50_000, "ä", "hot", "lone"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, "hot") for i in range(300)] + [(None, "ä"), (None, "n"), (None, "n"), (7, "same"), (7, "same")]
    rows += [(1000 + i, f"text {i}") for i in range(17_000 if max_bits < bloom.MAX_BITS else 50)]
    df = spark.createDataFrame([(a, b, "extra", None) for a, b in rows], SCHEMA).repartition(5)
    got = exact_duplicates(df, max_filter_bits=max_bits).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, brute(rows)))


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rounds_follow_the_bound():
    assert bloom.map_bits(10, 16, 1 << 29) == (bloom.PAGE * 8, 1)
    bits, rounds = bloom.map_bits(10**10)
    assert bits == bloom.MAX_BITS and rounds * bits >= 16 * 10**10
