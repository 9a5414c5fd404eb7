from collections import Counter

import corpus_pipeline as P
from tokenizers import Tokenizer

from corpusflow.llm import simhash as S
from corpusflow.llm import token_index
from corpusflow.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in P.STAGES[:4]:
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in kept[0] for i, q in labels.items() if q == 1)
    assert sum(i in kept[0] for i, q in labels.items() if q == 0) <= 2
    # near-duplicates: the smallest of each group of similar shingles
    sets = {i: set(S.shingle_hashes(S.words_of(r.text), 5).tolist()) for i, r in kept[0].items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert set(kept[1]) == {i for i in sets if root(i) == i}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(kept[2]) == {i for i, r in kept[1].items() if not any(t in " ".join(r.text.lower().split()) for t in items)}
    assert set(kept[3]) == set(kept[2])
    times = Counter(r.doc_id for r in docs.collect())
    assert set(times.values()) <= {1, 2}
    tokens = P.STAGES[4][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in tokens) == times
    tokenizer = Tokenizer.from_file(token_index.tokenizer_path())
    lengths = {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in kept[3].items()}
    at = 0
    for r in sorted(tokens, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (at, lengths[r.doc_id])
        at += r.n_tokens


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g h", "en", "s", 1, "x", "y"), (2, None, None, None, None, None, None), (None, "a b c", None, "s", 1, "x", "y"), (2, "", "en", "s", 0, "x", "y"),
            (3, "a b c d e f g h", "en", "s", 1, "x", "y"), (3, "a b c d e f g h", "en", "s", 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone string, unit string")
    for df in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(P.STAGES):
            df = stored(stage(spark, df, SF), "test-stage")
            if i < 4:
                assert df.columns == docs.columns
        assert {r.doc_id for r in df.collect()} <= {1, 2, 3}
