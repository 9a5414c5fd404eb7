import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from corpusflow.llm import source_audit

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "lang", "source", "prefix", "n", "value")])
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= least}
        groups = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if t in kept) for s in {d[1] for d in docs if d[0] == lang}}
        whole = sum(groups.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: E731, B023
        for s, c in groups.items():
            pair = [(o, sum(abs(p(c, t) - p(d, t)) for t in kept)) for o, d in groups.items() if o != s]
            term = [(t, p(c, t) - p(whole, t)) for t in c if c[t] and p(c, t) > p(whole, t)]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return out


def run(spark, rows, least=3, top=7):
    df = spark.createDataFrame([(*r, "p", "n", "v") for r in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, source_audit.source_divergence(df, least_docs=least, top=top).collect()))
    assert got == sorted(brute(rows, least, top))
    return got


def some_rows(seed, sources):
    rng = random.Random(seed)
    words = ["a", "Ab", "abc", "abcd", "abcde", "abcdefghijkl", "abcdefghijklm", "É", "éé", "日本", "x" * 40, "x" * 41, "x" * 300, "ab\0cd", "don't", "1", "zz9zz", "İ", "😀"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(12))), rng.choice(["en", "de", None]), rng.choice(sources)) for _ in range(150)]
    return rows + [(None, "en", None), ("", "xx", "alone"), ("one two", "yy", "p"), ("one", "yy", "q"), ("same", "en", "s0"), ("same", "en", "s0"), ("word " * 50_000, "de", "s1")]


def test_against_a_plain_loop(spark):
    got = run(spark, some_rows(1, ["s0", "s1", "S2", "é", None]))
    assert any(r[0] == "yy" and r[4] == 0 for r in got)
    run(spark, some_rows(2, ["s0", "s1"]), least=1, top=50)


def test_blocks_of_sources_and_small_memories(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "BLOCK_SOURCES", 2)
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", 3)
    monkeypatch.setattr(source_audit, "MOST_ENTRIES", 5)
    run(spark, some_rows(3, [f"s{i}" for i in range(7)]))


def test_full_bit_maps_lose_and_add_nothing(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "MAX_BITS", 64)
    run(spark, some_rows(4, ["a", "b"]))


def test_no_rows(spark):
    assert source_audit.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("size", [0, 1, 2**20, 2**20 + 5, 3 * 2**20])
def test_pieces_end_between_terms(monkeypatch, size):
    monkeypatch.setattr(source_audit, "SLICE", 2**20)
    text = (b"Ab cde f" * (size // 8 + 1))[:size] + b" end" + b"x" * size
    words = text.lower().split()
    cut = list(source_audit.pieces(text))
    assert all(len(p) <= 2**20 + 8 or b"\0" not in p[2**20 :] for p in cut)
    for least in (0, 4, 12):
        found = [source_audit.marked_terms([p], least)[1].to_pylist() for p in cut]
        assert [t for part in found for t in part] == [w + b"\0" for w in words if len(w) >= least]


def test_terms_belong_to_their_texts():
    of, terms = source_audit.marked_terms([b"", b"ab\0\0c", b"\0\0", b"\0d", b""])
    assert list(zip(of.tolist(), terms.to_pylist())) == [(1, b"ab\0"), (1, b"c\0"), (3, b"d\0")]
    of, terms = source_audit.marked_terms([])
    assert not len(of) and not len(terms)


def test_a_text_in_pieces_holds_a_prefix_once(monkeypatch):
    monkeypatch.setattr(source_audit, "SLICE", 6)
    texts = [b"abcde abcdf xy abcde abcde", b"abcde", b"", b"xy"]
    prefixes, docs = source_audit._held(texts, 4, 0)
    assert dict(zip(prefixes.to_pylist(), docs.tolist())) == {b"abcd": 2, b"xy\0": 2}
    schema = ["lang", "source", "text"]
    batch = pa.RecordBatch.from_pylist([dict(zip(schema, r)) for r in [("a", "s", "x y"), ("b", "s", "z" * 30), ("a", "t", "v w u"), ("c", "s", "")]])
    got = [(lang, s, t) for lang, sources, held in source_audit.slices(iter([batch])) for s, t in zip(sources, held)]
    assert sorted(got) == [("a", "s", b"x y"), ("a", "t", b"v w u"), ("b", "s", b"z" * 30), ("c", "s", b"")]
