import random

import numpy as np
import pytest
from pyspark.sql import types as T

from corpusflow.llm import suffix_dedup as sd

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("doc", T.StringType()), ("same", T.LongType()), ("hash", T.StringType()), ("windows", T.StringType()))])
NONE = 1 << 63


def brute(rows):
    first = {}
    for key, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, NONE + 1), NONE if key is None else key)
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < (NONE if key is None else key):
                gone[p : p + 50] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])))
        out.append((key, len(raw), list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def check(spark, rows, parts=5):
    df = spark.createDataFrame([(k, t, "x", 1, "h", "w") for k, t in rows], SCHEMA).repartition(parts)
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in sd.remove_repeated_passages(df).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted(brute(rows), key=order)
    return got


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    pool = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 5))]
        text = "\n".join(parts)
        if rng.random() < 0.5 and text:  # one edit
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("xyz日") + text[at + rng.randrange(3) :]
        texts.append(text[rng.randrange(20) :])
    return texts


def odd():
    base = "the quick brown fox jumps over the lazy dog and runs away again"
    return [None, "", base[:49], base[:50], base[:51], base[:50], "=" * 500, "=" * 49, "=" * 130, "ab" * 200, "ba" * 90, "é" * 60, "日本語" * 40, "\0" * 70, base + base, "x" + base]


def test_shared_passages(spark):
    got = check(spark, list(enumerate(passages(1))))
    assert sum(len(r[2]) for r in got) > 50


def test_odd_texts_ids_and_repeated_rows(spark):
    rows = list(enumerate(odd())) + [(7, "=" * 200), (7, "=" * 200), (3, passages(2)[0])] + [(None, t) for t in passages(2)[:4]] + [(-5, passages(2)[1])]
    check(spark, rows + [(1000 + i, t) for i, t in enumerate(passages(2))])


def test_hot_anchors_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 3)
    monkeypatch.setattr(sd, "CHUNK", 50)
    line = "this line stands in every document of the table, whatever its text may be"
    rows = [(i, f"{t}\n{line}\n{t[::-1]}") for i, t in enumerate(passages(3))]
    check(spark, rows)


def test_near_copies_and_a_long_text(spark):
    rng = random.Random(4)
    words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(400)) for _ in range(300)]
    rows = []
    for i in range(40):
        copy = list(words)
        for _ in range(i % 4):
            copy[rng.randrange(300)] = "edit"
        rows.append((i, " ".join(copy)))
    long = " ".join(str(rng.randrange(10**9)) for _ in range(40_000))
    assert len(long) > sd.BLOCK_BYTES
    check(spark, rows + [(100, long), (101, "some words in front " + long[5:]), (102, long[sd.BLOCK_BYTES - 60 : sd.BLOCK_BYTES + 60])])


def test_empty_table_and_no_repeats(spark):
    assert sd.remove_repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []
    check(spark, [(1, "a"), (2, None)])


def strings(seed, alphabet):
    rng = random.Random(seed)
    raw = bytes(rng.choice(alphabet) for _ in range(3000))
    start = np.array(sorted(rng.randrange(3000) for _ in range(700)))
    end = np.minimum(start + np.array([rng.randrange(1, 90) for _ in start]), 3000)
    return raw, start, end


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh"])
def test_suffix_sort(alphabet):
    raw, start, end = strings(1, alphabet)
    group = np.sort(np.random.default_rng(2).integers(0, 9, len(start)))
    text = sd.Hashed(np.frombuffer(raw, np.uint8))
    order = sd.sorted_suffixes(text, start, end, group)
    key = lambda i: (group[i], raw[start[i] : end[i]])
    assert [key(i) for i in order] == sorted(map(key, range(len(start))))
    shared, right = sd.neighbours(text, start, end, group, order)
    assert right
    for (a, b), n in zip(zip(order, order[1:]), shared[1:]):
        x, y = raw[start[a] : end[a]], raw[start[b] : end[b]]
        same = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
        assert n == (same if group[a] == group[b] else 0)


def test_collisions_are_seen_and_mended(monkeypatch):
    whole = sd._base

    def weak(seed):
        numbers, base, inverse = whole(seed)
        if seed == 1:  # hashes that see only whether a byte is below "d"
            return (np.arange(256) >= 100).astype(np.uint64) + np.uint64(1), 1, 1
        return numbers, base, inverse

    raw = [t.encode() for t in passages(5)[:30]]
    fragments = [f for r in raw for f in [r[i : i + 84] for i in range(0, len(r), 84)] if len(f) >= 50]
    data, bounds = np.frombuffer(b"".join(fragments), np.uint8), np.concatenate([[0], np.cumsum([len(f) for f in fragments])])
    starts, ends = bounds[:-1], bounds[1:]
    monkeypatch.setattr(sd, "_base", weak)
    sd._powers.pop(1, None)
    text = sd.Hashed(data, 1)
    group = np.zeros(len(starts), np.int64)
    assert not sd.neighbours(text, starts, ends, group, sd.sorted_suffixes(text, starts, ends, group))[1]
    least = np.arange(len(starts))
    assert (sd.earlier_windows(data, bounds, group, least, 1) == sd.earlier_windows(data, bounds, group, least, 2)).all()
    sd._powers.pop(1, None)


def test_each_window_is_in_one_fragment_whose_anchor_depends_on_it_alone():
    texts = [t.encode() for t in passages(6)[:25] + [o or "" for o in odd()]]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = sd.Fragments(data, bounds)
    windows, anchor = set(), {}
    for a, lo, n, of in zip(found.anchor.tolist(), found.lo.tolist(), found.count.tolist(), found.of.tolist()):
        assert n <= sd.SPAN
        for p in range(lo, lo + n):
            assert p not in windows and p + 50 <= bounds[of + 1]
            windows.add(p)
            assert anchor.setdefault(bytes(data[p : p + 50]), a) == a
    assert len(windows) == sum(max(len(t) - 49, 0) for t in texts)
