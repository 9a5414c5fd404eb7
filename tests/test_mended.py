"""Inputs that the given tables do not hold."""

import os

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import crawl, extract, langid, views
from corpusflow.operators import textometry as tx
from corpusflow.operators import texttools as tt
from corpusflow.plans.checkpoints import scratch_path
from corpusflow.sources import readers, writers


def test_a_chain_is_crawled_to_its_end(spark):
    pages = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "rowid long, url string")
    links = spark.createDataFrame([(i, f"p{i + 1}") for i in range(12)], "rowid long, link string")
    got = crawl.crawl_expand(spark.createDataFrame([("p0",)], "url string"), pages, links).collect()
    assert {r.url: (r.level, r.done) for r in got} == {f"p{i}": (i, i < 12) for i in range(13)}


def test_a_page_with_half_of_all_links(spark):
    pages = spark.createDataFrame([(i, f"p{i}") for i in range(60)], "rowid long, url string")
    rows = [(0, f"p{i}") for i in range(60)] + [(i, f"q{i}") for i in range(60)]
    got = crawl.crawl_expand(spark.createDataFrame([("p0",)], "url string"), pages, spark.createDataFrame(rows, "rowid long, link string")).collect()
    assert {(r.url, r.level) for r in got} == {("p0", 0)} | {(f"p{i}", 1) for i in range(1, 60)} | {("q0", 1)} | {(f"q{i}", 2) for i in range(1, 60)}


def test_links_in_comments_scripts_and_styles(spark):
    html = "<!-- <a href='/hidden'>x</a> --><script>'<a href=\"/s\">'</script><STYLE><a href='/t'></STYLE ><a href='/seen'>y</a><!-- <a href='/open'>"
    df = spark.createDataFrame([(1, "http://h/", html)], "id long, url string, html string")
    assert [r.link for r in extract.extract_links(df, "id").collect()] == ["http://h/seen"]


def test_file_names_meet_no_other(spark):
    urls = ["http://h/a", "http://h/a", "http://h/a__1", "http://h/a__1__1", "http://h/b"] + ["http://h/" + "x" * 300] * 3
    df = spark.createDataFrame(list(enumerate(urls)), "id long, url string")
    names = [r.file_name for r in writers.file_names(df, "id", "url").collect()]
    assert len(set(names)) == len(urls) and all(len(n) <= 255 for n in names)
    twice = spark.createDataFrame([("a.txt", "1"), ("a.txt", "2")], "file_name string, content string")
    with pytest.raises(ValueError):
        writers.write_files(twice, scratch_path(spark, "twice"))


def test_robots_records_of_several_agents(spark):
    content = "User-agent: *\nUser-agent: other\nDisallow: /x\nUser-agent: third\nDisallow: /\n"
    rules = crawl.robots_rules(spark.createDataFrame([("h", content)], "host string, content string"))
    links = spark.createDataFrame([("http://h/x/1",), ("http://h/y",), ("http://g/x",)], "url string")
    assert {r.url for r in crawl.robots_filter(links, "url", rules).collect()} == {"http://h/y", "http://g/x"}


def test_politeness_without_delay(spark):
    log = spark.createDataFrame([("h", "2024-01-01 00:00:00", 1), ("h", "2024-01-01 00:00:00", 2)], "host string, ts string, id long")
    assert crawl.politeness_audit(log, "host", "ts", "id", 0).collect()[0][:] == ("h", 2, 0)


def test_first_link_where_every_host_is_over_its_limit(spark):
    links = spark.createDataFrame([(1, "http://a/1"), (2, "http://b/1")], "pos long, url string")
    over = spark.createDataFrame([("a", 9), ("b", 9)], "host string, n_visited long")
    assert [r.pos for r in crawl.per_host_cap(links, "pos", "url", 2, over).collect()] == [1]
    assert [r.pos for r in crawl.per_host_cap(links, "pos", "url", 2, over.where("host = 'a'")).collect()] == [2]


def test_folder_with_odd_names_and_bytes(spark, tmp_path):
    (tmp_path / ".hid").mkdir()
    for name, content in {"_a.html": b"under", "b.txt": "é".encode("latin-1"), ".c.html": b"dot", ".hid/d.html": b"below", "e.bin": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    rows = readers.scan_folder(spark, str(tmp_path)).collect()
    assert {os.path.basename(r.url): r.source for r in rows} == {"_a.html": "under", "b.txt": "�", "d.html": "below"}
    assert {r.source for r in readers.scan_folder(spark, str(tmp_path), "latin-1").collect()} == {"under", "é", "below"}


def test_conditions_with_a_backslash(spark):
    df = spark.createDataFrame([("a\\b",), ("ab",)], "t string")
    assert [r.t for r in views.filter_rows(df, [views.Condition("t", "contains", "a\\")]).collect()] == ["a\\b"]


def test_lexicon_with_several_readings(spark):
    lexicon = spark.createDataFrame([("saw", "see", "V"), ("saw", "saw", "N"), ("the", "the", "D")], "form string, lemma string, tag string")
    df = spark.createDataFrame([(1, "the saw cut"), (2, None), (3, "")], "id long, t string")
    for mode, want in (("lemma", "the saw cut"), ("tag", "D N cut"), ("lemma-tag", "the-D saw-N cut")):
        assert {r.id: r.out for r in tt.lemmatize_with(df, "id", "t", lexicon, "out", mode).collect()}[1] == want


def test_seeds_that_name_a_host(spark):
    df = spark.createDataFrame([("//h/x h/y https://h/z",)], "t string")
    assert {r.url for r in readers.scan_seeds(df, "t").collect()} == {"//h/x", "http://h/y", "https://h/z"}


def test_windows_longer_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(tx, "STRETCH", 3)
    words = [chr(97 + i % 5) for i in range(40)]
    pieces = tx.sections_by_group(spark.createDataFrame([("g", i, w) for i, w in enumerate(words)], "g string, i int, t string"), "g", ["i"], ["t"])
    whole = [*words, ""]
    want = {}
    for i, a in enumerate(whole):
        for b in whole[i + 1 : i + 11]:
            want[a, b] = want.get((a, b), 0) + 1
            want[b, a] = want.get((b, a), 0) + 1
    got = tx.cooccurrences(tx.stretches(tx.tokenize_groups(pieces, ["i"]), 11), 11)
    assert {(r.x, r.y): r.cooc for r in got.collect()} == want


def test_absent_cells_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = [(s, t, rng.randrange(1, 60)) for s in range(40) for t in "abcdefgh" if rng.random() < 0.6]
    bow = spark.createDataFrame(rows, "section_id long, token string, freq long")
    got = {(r.section_id, r.token) for r in tx.absent_cells(bow, sections_per_block=7).collect()}
    import math

    total, size, corpus = {}, {}, sum(f for *_, f in rows)
    for s, t, f in rows:
        total[t], size[s] = total.get(t, 0) + f, size.get(s, 0) + f
    def rare(t, s):
        share = size[s] / (corpus - total[t] + 1)
        return share >= 1 or -total[t] * math.log1p(-share) >= math.log(20)
    seen = {(s, t) for s, t, _ in rows}
    assert got == {(s, t) for s in size for t in total if (s, t) not in seen and rare(t, s)}


def test_every_language_has_its_name(spark):
    names = {r.c: r.n for r in spark.createDataFrame([("eu",), ("zh-tw",), ("xx",)], "c string").select("c", langid.language_name(F.col("c")).alias("n")).collect()}
    assert names == {"eu": "Basque", "zh-tw": "Traditional Chinese", "xx": None}
    profiles = langid.train_profiles(spark.createDataFrame([("en", "the cat sat on the mat")], "lang string, text string"))
    texts = spark.createDataFrame([(1, "Это русский текст"), (2, "これはとてもよいことばです"), (3, "ᚠᚢᚦᚨ"), (4, "")], "id long, text string")
    named = {r.id: r.name for r in langid.guess_language_name(texts, profiles).collect()}
    assert named[1] == "English" and named[2] == "Japanese" and named[3] == "an unknown language, maybe ('Lo', 'RUNIC')"


def test_right_to_left(spark):
    profiles = langid.train_profiles(spark.createDataFrame([("fa", "این یک متن فارسی است"), ("en", "this is text")], "lang string, text string"))
    texts = spark.createDataFrame([(1, "این یک متن فارسی است"), (2, "this is a text in latin"), (3, "متن")], "id long, text string")
    assert {r.id: r.direction for r in langid.text_direction(texts, profiles).collect()} == {1: "RTL", 2: "LTR", 3: "LTR"}


def test_segments_against_a_loop(spark):
    import random

    rng = random.Random(9)
    words = {"".join(rng.choice("abc😀é") for _ in range(rng.randrange(1, 7))) for _ in range(60)} | {"a" * 40}
    lexicon = spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "form string")
    texts = ["".join(rng.choice("abc😀é") for _ in range(rng.randrange(0, 200))) for _ in range(30)] + ["a" * 100, None]
    got = {r.id: r.s for r in tt.segment_with(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", lexicon, "s").collect()}
    for i, text in enumerate(texts):
        out, at = [], 0
        while text and at < len(text):
            size = next((k for k in range(40, 1, -1) if text[at : at + k] in words and at + k <= len(text)), 1)
            out.append(text[at : at + size])
            at += size
        assert got[i] == (None if text is None else " ".join(out))
    empty = tt.segment_with(spark.createDataFrame([(1, "ab")], "id long, t string"), "id", "t", lexicon.limit(0), "s").collect()
    assert empty[0].s == "a b"


def test_counts_of_a_replacement_come_from_the_pass_that_writes(spark):
    rows = [(1, "the then", None), (2, "", "no"), (3, "THE", "the\nthe"), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, a string, b string").repartition(3)
    replaced, counts = tt.replace_counted(df, ["a", "b"], "(th)(e)", r"\2\1")
    assert counts == {"replacements": 5, "replaced_cells": 3}
    assert counts == tt.replacement_counts(df, ["a", "b"], "(th)(e)").first().asDict()
    want = [(1, "eth ethn", None), (2, "", "no"), (3, "ETH", "eth\neth"), (4, None, None)]
    assert sorted(map(tuple, replaced.collect())) == want
    none, counts = tt.replace_counted(df.limit(0), ["a", "b"], "(th)(e)", r"\2\1")
    assert none.collect() == [] and counts == {"replacements": 0, "replaced_cells": 0}
