import hashlib
import random
import re

import numpy as np
from pyspark.sql import types as T

from corpusflow.llm import fill_middle

SCHEMA = T.StructType([T.StructField(c, t) for c, t in
                       (("doc_id", T.LongType()), ("text", T.StringType()), ("cut", T.StringType()), ("_h", T.LongType()), ("n", T.StringType()))])
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, percent=50, spm=80):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return key, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return key, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(5)
    texts = [None, "", " ", "\n\t ", "a", " a", "a ", "é", " x y z", "😀 b😀c\n\nd ", "a<P>b c", "x <M> y", "<S", "P> <S <P M> x", "\0 \0a",
             "word " * 60_000, "w" * 200_000, " " * 5_000 + "x"]
    return texts + ["".join(rng.choice("ab \n\té😀<>PSM") for _ in range(rng.randrange(60))) for _ in range(600)]


def check(spark, rows, **parameters):
    df = spark.createDataFrame([(k, t, "c", 1, "n") for k, t in rows], SCHEMA).repartition(3)
    got = fill_middle.fill_in_middle(df, percent=parameters.get("percent", 50), spm_percent=parameters.get("spm", 80))
    got = got.withColumn("back", fill_middle.restored(got.output, got.form)).collect()
    wanted = [(*brute(k, t, **parameters), t or "") for k, t in rows]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(wanted, key=order)


def test_against_a_plain_loop(spark):
    texts = odd_texts()
    check(spark, list(enumerate(texts)) + [(None, "no id at all"), (7, "same row"), (7, "same row")])


def test_all_texts_rearranged(spark):
    check(spark, list(enumerate(odd_texts())), percent=100, spm=50)


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rank_and_select_of_the_matrix():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(symbols, 3)
        at = np.arange(size + 1)
        for symbol in range(8):
            places = np.flatnonzero(symbols == symbol)
            assert (matrix.rank(symbol, at) == np.searchsorted(places, at)).all()
            nth = np.arange(1, len(places) + 1)
            assert (matrix.select(symbol, nth, np.zeros(len(places), int), np.full(len(places), size)) == places).all()


def test_blocks_end_between_texts(spark, monkeypatch):
    texts = ["a b c", "", "é é é é", " x", "y " * 40]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    draws = np.array([2, 0, 3, 1, 17]), np.array([1, 5, 1, 9, 30])
    whole = fill_middle.cuts_of(data, offsets, *draws)
    for i in range(len(texts)):
        one = fill_middle.cuts_of(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2], draws[0][i : i + 1], draws[1][i : i + 1])
        assert [int(c[0]) for c in one] == [int(c[i]) for c in whole]
