import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from corpusflow.functions import cells, html, urls
from corpusflow.operators import extract

PAGE = (
    "<html><head><title>A &amp; B</title></head><body><div class=\"ad\">x<div>y</div></div><script>var a=1;</script>"
    "<!-- c --><p>&copy; &#8364; &#x1F600; &#146; &bogus; /* z */</p>"
    "<a href='#top'>t</a><a href=\"/x/index.html\">i</a><A HREF=//h/y>h</A><a href=\"mailto:a@b\">m</a>"
    "<a href=\"../z\">z</a><area href=\"q?a=1#f\"></body></html>"
)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_sentence_breaks(spark):
    text = "Hello world. M. K. Gandhi said hi! Really?\nNew line | next。再见 … fin. "
    assert one(spark, cells.sentence_breaks(F.col("t")), t=text) == 7


def test_page_to_text(spark):
    text = one(spark, html.html_to_text(html.clean_html(F.col("h"))), h=PAGE)
    assert "© € 😀 ’" in text and "bogus" not in text and "var" not in text and "/*" not in text
    assert one(spark, html.page_title(F.col("h"), F.col("u")), h=PAGE, u="http://a/b") == "A & B"
    assert one(spark, html.page_title(F.col("h"), F.col("u")), h="<p>", u="http://a/b.pdf") == "b"


def test_links_of_a_page(spark):
    pages = spark.createDataFrame([(1, "http://s/d/e/p.html", PAGE)], "id long, url string, html string")
    links = [r.link for r in extract.extract_links(pages, "id").orderBy("pos").collect()]
    assert links == ["http://s/d/e/p.html", "http://s/x", "http://h/y", "http://s/d/z", "http://s/d/e/q?a=1"]


def test_resolve_equals_urljoin(spark):
    bases = ["http://h.org/a/b/c.html", "http://h.org", "https://h.org/", "http://h.org/a/?x=1"]
    links = ["", "x", "x/y", "/x", "/x/../y", "../x", "../../x", "./x", "x/./y", "?q=1", "//o.org/z", "http://o.org/z", "x/", "a/../b?c=../d"]
    df = spark.createDataFrame([(b, l) for b in bases for l in links], "b string, l string")
    for r in df.select("b", "l", urls.resolve(F.col("b"), F.col("l")).alias("got")).collect():
        assert r.got == urljoin(r.b, r.l), (r.b, r.l)


def test_select_links_ignores_deny_without_allow(spark):
    links = spark.createDataFrame([(1, 0, "http://a/x"), (1, 1, "http://a/y"), (1, 2, "http://a/x")], "id long, pos int, link string")
    known = spark.createDataFrame([("http://a/y",)], "url string")
    assert [r.link for r in extract.select_links(links, "id", known, True, None, "x").collect()] == ["http://a/x"]
    assert extract.select_links(links, "id", known, True, "a", "x").count() == 0


def test_extract_field(spark):
    pages = spark.createDataFrame([(1, PAGE)], "id long, html string")
    got = extract.extract_field(pages, "ad", class_="ad", as_text=False).first().ad
    assert got == '<html>\n<div class="ad">x<div>y</div></div> \n</html>'
    assert "x y" in re.sub(r"\s+", " ", extract.extract_field(pages, "ad", tag="div", class_="ad").first().ad + " ")
    assert extract.extract_field(pages, "ad").first().ad == ""


def test_subdomain(spark):
    assert one(spark, urls.subdomain(F.col("u")), u="https://a.b.example.org/x") == "a.b"
    assert one(spark, urls.subdomain(F.col("u")), u="http://example.org/x") == ""
