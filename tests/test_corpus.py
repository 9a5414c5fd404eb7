import os
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from corpusflow.operators import concordance as kwic
from corpusflow.operators import crawl, langid, views
from corpusflow.operators import texttools as tt
from corpusflow.plans.ordered import running_total
from corpusflow.sources import readers, writers


def test_running_total_of_a_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"))
    rows = running_total(df, ["g"], ["id"], F.col("id"), "before", ranges=7).collect()
    sums = Counter()
    for r in sorted(rows, key=lambda r: r.id):
        assert r.before == sums[r.g]
        sums[r.g] += r.id


def test_group_by_capture(spark):
    df = spark.createDataFrame([(1, "http://a.org/1"), (2, "http://A.org/2"), (3, "ftp:x")], "rowid long, url string")
    sizes = views.group_sizes(views.group_by_capture(df, "rowid", "url", "http://([^/]+)/", True))
    assert [(r.group_key, r.n_rows) for r in sizes.collect()] == [("a.org", 2), ("_other_", 1)]


def test_duplicates(spark):
    df = spark.createDataFrame(
        [(1, "u/long", "t"), (2, "u", "t"), (3, "v", "z"), (4, "w", None), (5, "w", None)], "rowid long, url string, text string"
    )
    def gone(mode):
        return {r.rowid for r in views.select_duplicates(df, "rowid", ["text"], mode).collect()}
    assert gone(views.KEEP_FIRST) == {2} and gone(views.KEEP_LAST) == {1}
    assert gone(views.KEEP_SHORTEST) == {1} and gone(views.KEEP_LONGEST) == {2}
    assert views.duplicate_summary(df, ["text"]).first()[:] == (1, 1)


def test_crawl_levels_of_a_small_graph(spark):
    pages = spark.createDataFrame([(i, f"p{i}") for i in (1, 2, 3, 4)], "rowid long, url string")
    links = spark.createDataFrame(
        [(1, "p2"), (1, "p3"), (2, "p3"), (2, "p4"), (3, "p1"), (4, "p5")], "rowid long, link string"
    )
    seeds = spark.createDataFrame([("p1",)], "url string")
    got = {r.url: (r.level, r.origin, r.done) for r in crawl.crawl_expand(seeds, pages, links).collect()}
    assert got == {"p1": (0, 0, True), "p2": (1, 1, True), "p3": (1, 1, True), "p4": (2, 2, True), "p5": (3, 4, False)}
    assert "p5" not in {r.url for r in crawl.crawl_expand(seeds, pages, links, level_to=2).collect()}


def test_nice_time(spark):
    df = spark.createDataFrame([(59,), (61,), (3600,), (90000,)], "s long")
    got = [r[0] for r in df.select(crawl.nice_time(F.col("s"))).collect()]
    assert got[0] == "1 minute 59 seconds " and got[1] == "1 minute 1 second " and got[2] == "1 hour "


def test_concordance_trims_cut_words(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat")], "id long, t string")
    rows = kwic.concordance(df, "id", "t", "the", 5, 5).orderBy("pos").collect()
    assert (rows[0].left, rows[0].match, rows[0].right) == ("", "the", "")
    assert (rows[1].left, rows[1].match, rows[1].right) == ("on", "the", " mat")


def test_concordance_of_dense_matches(spark):
    text = "ab" * 300 + "c" + "ab" * 10
    df = spark.createDataFrame([(1, text)], "id long, t string")
    import re
    rows = kwic.concordance(df, "id", "t", "a", 7, 9, whole_word=False, trim=False).orderBy("pos").collect()
    spans = [m.span() for m in re.finditer("a", text)]
    assert [(r.left, r.right) for r in rows] == [(text[max(0, s - 7) : s], text[e : e + 9]) for s, e in spans]


def brute_script(text):
    squeezed = " ".join(text.split()) if not text[:1].isspace() else " " + " ".join(text.split())
    counts = Counter(squeezed[:-1])
    top = sorted(((n, c) for c, n in counts.items()), reverse=True)[:200]
    def best(values):
        bag = {}
        for v in values:
            bag[v] = bag.get(v, 0) + 1
        return max((n, i, v) for i, (v, n) in enumerate(bag.items()))[2]
    return (
        best([unicodedata.category(c) for _, c in top]),
        best([unicodedata.name(c).split()[0] for _, c in top if unicodedata.name(c, "")]),
    )


SAMPLES = [
    ("fr", "Le petit chat dort sur la chaise de la cuisine, et il rêve"), ("de", "Die Katze schläft auf dem Stuhl in der Küche"),
    ("el", "Η γάτα κοιμάται στην καρέκλα της κουζίνας"), ("ja", "ねこはだいどころのいすのうえでねています"), ("ko", "고양이가 부엌 의자에서 자고 있습니다"),
    ("zh", "猫在厨房的椅子上睡觉"), ("th", "แมวนอนหลับบนเก้าอี้ในครัว"),
]


def test_scripts_and_rules(spark):
    texts = spark.createDataFrame(list(enumerate(t for _, t in SAMPLES)), "id long, text string")
    got = {r.id: (r.category, r.script) for r in langid.dominant_script(texts).collect()}
    assert got == {i: brute_script(t) for i, (_, t) in enumerate(SAMPLES)}
    profiles = langid.train_profiles(spark.createDataFrame(SAMPLES[:2], "lang string, text string"))
    guessed = {r.id: (r.lang, r.score) for r in langid.guess_language(texts, profiles).collect()}
    assert [guessed[i][0] for i in range(len(SAMPLES))] == [lang for lang, _ in SAMPLES]
    assert guessed[2][1] == 100.0


def test_unknown_language_and_unmatched_profile(spark):
    texts = spark.createDataFrame([(1, "1"), (2, ""), (3, "qqqq wwww zzzz")], "id long, text string")
    profiles = spark.createDataFrame([("aa", "abc", 5000), ("bb", "def", 100)], "lang string, gram string, weight long")
    guessed = {r.id: r.lang for r in langid.guess_language(texts, profiles).collect()}
    assert guessed[1].startswith("unknown") and guessed[2].startswith("unknown") and guessed[3] == "bb"


def test_paragraphs_of_a_language(spark):
    profiles = langid.train_profiles(spark.createDataFrame(SAMPLES[:2], "lang string, text string"))
    texts = spark.createDataFrame([(1, SAMPLES[0][1] + "\n" + SAMPLES[1][1] + "\n" + SAMPLES[0][1])], "id long, text string")
    got = langid.keep_language_paragraphs(texts, profiles, "fr").first().text
    assert got == (SAMPLES[0][1] + "\n") * 2


def test_annotation_and_segmentation(spark):
    df = spark.createDataFrame([("The/DT/B-NP/O/O/the cat/NN/I-NP/O/O/cat broken/tok",)], "a string")
    got = [df.select(tt.project_annotation(F.col("a"), m)).first()[0] for m in ("lemma", "tag", "lemma-tag")]
    assert got == ["the cat \n", "DT NN \n", "the-DT cat-NN \n"]
    lexicon = spark.createDataFrame([("中国",), ("中国人",), ("人民",)], "form string")
    out = tt.segment_with(spark.createDataFrame([(1, "中国人民好")], "id long, t string"), "id", "t", lexicon, "s").first().s
    assert out == "中国人 民 好"


def test_tsv_over_many_blocks(spark, tmp_path):
    lines = ["x", "t1\tbody", "a\tb\tbody2", ""] + [f"title {i}\ttext {i}" for i in range(3000)]
    file = tmp_path / "in.tsv"
    file.write_text("\n".join(lines) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.scan_tsv(spark, str(file)).orderBy("rowid").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.rowid for r in rows] == list(range(1, len(lines) + 1))
    assert [(r.title, r.text) for r in rows[:4]] == [("1", "x"), ("t1", "body"), ("a b", "body2"), ("4", "")]
    assert rows[-1].title == "title 2999"


def test_corpus_tables_and_folder(spark, tmp_path):
    readers.create_corpus(spark, str(tmp_path / "c"))
    tables = readers.open_corpus(spark, str(tmp_path / "c"))
    assert tables["sources"].count() == 0 and tables["textcolumns"].count() == 2
    folder = tmp_path / "f" / "sub"
    os.makedirs(folder)
    for name in ("a.txt", ".b.txt", "c.html", "d.bin", "e.pdf"):
        (folder / name).write_text("été")
    rows = {r.url.rsplit("/", 1)[1]: r.source for r in readers.scan_folder(spark, str(tmp_path / "f")).collect()}
    assert rows == {"a.txt": "été", "c.html": "été", "e.pdf": None}


def test_combined_export_is_in_order(spark, tmp_path):
    pages = spark.range(500).select("id", F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("\n")).alias("page"))
    writers.write_combined(pages, ["id"], str(tmp_path / "out"))
    parts = sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part"))
    text = "".join((tmp_path / "out" / p).read_text() for p in parts)
    assert text == "".join(f"p{i}\n" for i in range(500))
