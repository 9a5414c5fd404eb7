import random

import numpy as np
import pytest
import xxhash

from corpusflow.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, component_id int"


def components(ids, pairs):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_shingles_and_fingerprint():
    words = S.words_of("One two\tTHREE four É")
    assert words == ["one".encode(), b"two", b"three", b"four", "É".encode()]
    assert S.shingle_hashes(words, 3)[1] == xxhash.xxh64_intdigest(b"two three four", 42)
    assert list(S.shingle_hashes(words[:2], 3)) == [xxhash.xxh64_intdigest(b"one two", 42)]
    assert S.fingerprint(S.shingle_hashes([], 3)) == 0
    hashes = np.array([0b111, 0b110, 0b100], np.uint64)
    assert S.fingerprint(hashes) == 0b110
    assert S.fingerprint(hashes[:2]) == 0b110  # a bit set in exactly half is zero
    many = np.arange(200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    want = sum(1 << i for i in range(64) if int(((many >> np.uint64(i)) & np.uint64(1)).sum()) * 2 > len(many))
    assert S.fingerprint(many) == want


def test_tree_finds_all_within_radius():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(5)]
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for radius in (0, 2, 20):
        for q in values[::7]:
            assert sorted(tree.within(q, radius)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]


@pytest.mark.parametrize("block", [2048, 3])
def test_fingerprint_groups(spark, block):
    rng = random.Random(block)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(150):
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps += [fps[0]] * 60 + [0, 0, 1]
    rows = list(enumerate(fps))
    rows += [(3, fps[9]), (None, fps[5]), (None, 12345)]  # an id twice, and rows without id
    got = S.fingerprint_groups(spark.createDataFrame([(i, S.signed(f)) for i, f in rows], "doc_id long, fp long"), block=block).collect()
    known = [(i, f) for i, f in rows if i is not None]
    pairs = [(i, j) for i, f in known for j, g in known if i < j and (f ^ g).bit_count() <= 2]
    want = components({i for i, _ in known}, pairs + [(3, j) for j, g in known if (fps[9] ^ g).bit_count() <= 2])
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
        else:
            assert r.component_id == (want[5] if r.fp == S.signed(fps[5]) else None)


def test_fingerprints_of_odd_texts(spark):
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, " \t", "x", 0), (4, "a", "x", 0), (None, "A", "x", 0), (5, "w " * 70_000, "x", 0)]
    got = {r.doc_id: r.fp for r in S.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == got[2] == got[3] == 0 and got[4] == got[None] and got[5] == S.signed(xxhash.xxh64_intdigest(b"w w w", 42))
    assert S.fingerprint_groups(S.fingerprints(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, block):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [text(rng.randrange(1, 120)) for _ in range(25)]
    for t in list(texts):
        for _ in range(rng.randrange(4)):
            copy = list(t)
            for _ in range(rng.randrange(1, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    shared = text(60)
    texts += [shared + text(200) for _ in range(6)]  # a common passage is no duplicate
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, texts[3] and " ".join(texts[3]).upper()), (901, None), (902, " "), (None, "x y")]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), block=block).collect()}
    sets = {i: set(S.shingle_hashes(S.words_of(t), 5).tolist()) for i, t in rows if i is not None}
    similar = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = components(sets, [(i, j) for i in sets for j in sets if i < j and similar(sets[i], sets[j]) >= 0.8])
    assert got == want
    assert sum(i != c for i, c in want.items()) > 10


def test_repeats_do_not_hide_near_duplicates(spark):
    rng = random.Random(11)
    shared = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    footer = "all rights of the page are reserved".split()
    rows = [(1, " ".join(shared)), (2, " ".join(shared + footer * 50)), (3, " ".join(shared[:100] + ["again"] * 40)), (4, " ".join(shared[:100]))]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    assert got[2] == 1 and got[4] == 3


@pytest.mark.parametrize("block", [512, 2])
def test_far_fingerprints_are_compared_too(spark, block):
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 32, 500, dtype=np.uint32))
    sets = [base, base[:-20], base[30:], rng.permutation(base)[:300], base[:0]]
    rows = [(7, i, S.signed(rng.integers(0, 1 << 64, dtype=np.uint64).item()), np.sort(s).tobytes()) for i, s in enumerate(sets)]
    entries = spark.createDataFrame(rows, "key long, id long, fp long, shingles binary")
    links = S.tree_links(entries, ["key"], 0, block, 0.8).collect()
    assert components(range(5), [(r.a, r.b) for r in links]) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_drop_keeps_columns_and_null_ids(spark):
    rows = [(1, "a b c d e f", "p", 1), (2, "a b c d e f", "q", 2), (None, "a b c d e f", "r", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, component_id int")
    got = S.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r.gone for r in got.collect()) == ["p", "r"]
    assert S.drop_near_duplicates(df.limit(0)).collect() == []
