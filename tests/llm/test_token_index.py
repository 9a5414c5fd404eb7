import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusflow.llm import token_index as X
from corpusflow.llm.common import scratch_path

DOCS = "doc_id long, text string, shard string, row int"


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.int64)).view(np.uint64)
        mph = X.PerfectHash.build(keys)
        assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
        assert sum(mph.sizes) <= 4.5 * n + 10


def test_encoder_equals_the_tokenizer():
    path = X.tokenizer_path()
    tokenizer, encode = Tokenizer.from_file(path), X.word_encoder(path, "<u2")
    texts = [
        "", " ", "Hello, world!! It's 12.5% <|endoftext|> a<|startoftext|>b\n\n\tNEW  LINE's", "İstanbul ΣΑΣ Straße éa ﬁn ǅ", "a b c　d",
        "x\x1cy \x1f z", "###a### ...b don't DON'T we'll! 'tis", "日本語 テキスト 123", "(end.) [x] {y}; \"q\"", "a" * 5000, "naïve café's, ÀÉÎ ʼn ĳ", "\u0085a\u0085",
    ]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    for text, ids in zip(texts, want):
        assert encode([text])[0].tolist() == ids, text
    ids, n = encode(texts)
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
    assert [len(x) for x in encode([])] == [0, 0]


def test_encoder_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(X, "MOST_WORDS", 5)
    encode, plain = X.word_encoder.__wrapped__(X.tokenizer_path(), "<u2"), X.plain_encoder(X.tokenizer_path(), "<u2")
    for n in range(30):
        text = " ".join(f"word{chr(97 + (n * i) % 26)} stem{chr(97 + i)}, w{i}" for i in range(n % 9))
        got, want = encode([text, "", text + " end"]), plain([text, "", text + " end"])
        assert all((a == b).all() for a, b in zip(got, want))


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(X, "SLICE", 7)
    texts = ["", "ab cd ef gh ij kl", "x" * 30, "a b", "x" * 9 + " y", ""]
    held = list(X.slices(texts, True))
    for number, text in enumerate(texts):
        cut = [t for part in held for i, t in part if i == number]
        assert "".join(cut) == text and all(t[0] == " " for t in cut[1:])
    assert sum(len(part) for part in X.slices(texts, False)) == len(texts)


@pytest.mark.parametrize("shards", [1, 4])
def test_round_trip(spark, shards, monkeypatch):
    monkeypatch.setattr(X, "SLICE", 40 * shards)
    rows = [(i * 3, f"Text number {i}, " * (i % 5)) for i in range(-20, 60)] + [(9, "again"), (9, "again"), (None, "no key"), (1000, None), (1001, ""), (1002, "long words " * 60_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3)
    folder = scratch_path(spark, "test-tokens")
    manifest = X.write_shards(df, folder, X.tokenizer_path(), shards=shards)
    tokenizer = Tokenizer.from_file(X.tokenizer_path())
    want = {}
    for key, text in rows:
        want.setdefault(key, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    got = X.read_documents(X.locate(df, folder), folder).collect()
    assert len(got) == len(rows) - 1
    at, ordered = len(want[None][0]), sorted(got, key=lambda r: (r.doc_id, r.start))
    for r in ordered:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in want[r.doc_id] and r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += len(ids)
    assert at == sum(s["tokens"] for s in manifest["shards"])
    some = spark.createDataFrame([(9,), (9,), (10,), (None,), (-60,), (123456,)], "doc_id long")
    found = X.read_documents(X.locate(some, folder), folder, payload=False).collect()
    assert sorted(r.doc_id for r in found) == [-60, 9, 9, 9]


def test_empty_table(spark):
    df, folder = spark.createDataFrame([], DOCS), scratch_path(spark, "test-tokens")
    assert X.write_shards(df, folder, X.tokenizer_path())["shards"] == []
    assert X.read_documents(X.locate(spark.createDataFrame([(1,)], "doc_id long"), folder), folder).collect() == []


def test_other_tokenizers_by_whole_texts(spark):
    path, folder = X.tokenizer_path("byte_bpe_50k.json"), scratch_path(spark, "test-tokens")
    df = spark.createDataFrame([(1, "Some text,  spaced\n", "x", 1)], DOCS)
    X.write_shards(df, folder, path, end_id=50256, by_words=False)
    (row,) = X.read_documents(X.locate(df, folder), folder).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == Tokenizer.from_file(path).encode("Some text,  spaced\n").ids + [50256]
