import pytest

from corpusflow.llm.extraction import blocks_of, extract_main_text, label_blocks, main_text

PROSE = "It was the best of times, it was the worst of times, it was the age of wisdom"
SOUP = f"""<!DOCTYPE html><html><head><title>t</title><script>if (a<b) "</p><p>{PROSE}"</script><style>p{{}}</style></head>
<body class="has-sidebar"><header class="site"><p>{PROSE}</p></header><div id="cookie-notice">{PROSE} <button>OK</button></div>
<nav><ul><li><a href=x>Home</a></li><li><a href=y>The news of the day and of the week and of all the years</a></li></ul></nav>
<div class="content with-sidebar"><h1>The title</h1><p>{PROSE}, it was <a href=y>the age</a> of foolishness.</p><p>Short&nbsp;one.</p>
<p>{PROSE} &amp; so&hellip;</p></div><aside>{PROSE}</aside><form>{PROSE}<input></form><!-- <p>{PROSE}</p> -->
<ol class="commentlist"><li>{PROSE}</li></ol><div>&copy; 2020</div><footer>{PROSE}</footer>"""


def test_page_without_article_element():
    assert main_text(SOUP)[0] == f"The title\n{PROSE}, it was the age of foolishness.\nShort one.\n{PROSE} & so…"


def test_article_element_keeps_short_blocks_and_drops_parts():
    page = (
        f"<body><div class=ad>{PROSE}</div><article><header><h1>A</h1></header><p>B<b>c</b> d<br>e<p>F<div class='share-buttons'>{PROSE}</div>"
        f"<section id=comments><article><p>{PROSE}</p></article></section><p>G</p></article><p>{PROSE}</p>"
    )
    assert main_text(page)[0] == "A\nBc d e\nF\nG"


def test_article_within_main_and_readers_articles():
    page = (
        f"<main><p>{PROSE}</p><article class='post has-comments'><h1>A</h1><p>B</p><article class='comment-7'><p>{PROSE}</p></article></article></main>"
        f"<div id=content><p>{PROSE}</p></div>"
    )
    assert main_text(page)[0] == "A\nB"
    assert main_text(f"<p>{PROSE}</p><div id=content><p>B</p><div class=sidebar>{PROSE}</div></div>")[0] == "B"


@pytest.mark.parametrize("body", ["<main>{}</main>", "<div id=content>{}</div>", "<div>{}</div>"])
def test_a_teaser_is_not_the_article(body):
    text = f"<h1>The title</h1><p>{PROSE}, he said.</p><p>{PROSE}</p><p>{PROSE}, they say.</p>"
    want = f"The title\n{PROSE}, he said.\n{PROSE}\n{PROSE}, they say."
    assert want in main_text(f"{body.format(text)}<article class=card><h2>More</h2><p>Read it</p></article>")[0]
    assert want in main_text(f"<article class=card><a href=x>More</a></article>{body.format(text)}")[0]


@pytest.mark.parametrize("wrapper", ["<form id=aspnetForm>{}</form>", "<div class='layout sidebar-right'>{}</div>", "<form><div class='page sidebar-left'>{}</div></form>"])
def test_a_wrapper_of_the_page_is_no_part_around_it(wrapper):
    text = f"<div class=header-menu>Menu</div><h1>The title</h1><p>{PROSE}, he said.</p><p>{PROSE}</p><p>{PROSE}, we say.</p><p>{PROSE}, they say.</p>"
    page = wrapper.format(f"{text}<div class=sidebar>Words of the side</div><div class=newsletter>{PROSE}</div>") + "<footer>Foot</footer>"
    assert main_text(page)[0] == f"The title\n{PROSE}, he said.\n{PROSE}\n{PROSE}, we say.\n{PROSE}, they say."


def test_link_lists_are_menus():
    links = "".join(f"<p><a href=x>The one of the {i} and of all the others that there are to be had</a></p>" for i in range(4))
    assert main_text(f"<div>{links}</div><div><p>{PROSE}</p><p>{PROSE}</p></div>")[0] == f"{PROSE}\n{PROSE}"


def test_open_blocks_take_the_nearest_label():
    blocks = blocks_of(f"<p>{PROSE}</p><p>near</p><p>x</p><footer>{PROSE}</footer>")
    label_blocks(blocks)
    assert [b.label for b in blocks] == ["good", "good", "bad", "bad"]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<b", "a"), ("a < b &amp;&lt;", "a < b &<"), ('<p class="x>abc</p>def', "abc\ndef"),
    ("<p>a</p><script>never ends <p>b", "a"), ("<![CDATA[x]]>", "x"), ("<p>&#x41;&#66;&bogus;&copy</p>", "AB&bogus;©"), ("<title>t</title>", ""),
    ("<div hidden>x</div><div style='display: none'>y</div>z", "z"), ("<svg><text>x</text></svg>y", "y"),
])
def test_odd_pages(page, text):
    assert main_text(page)[0] == text


def test_table_of_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>", "x", "y"), (None, None, None, None, None), (1, "u", "", "x", "y"), (2, "v", "<p>" + "é " * 300_000, "x", "y")]
    got = sorted(extract_main_text(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(None, None, 0), (1, "u", 0), (1, "u", len(PROSE)), (2, "v", 599_999)]
    assert extract_main_text(spark.createDataFrame([], schema)).collect() == []


def test_articles_of_the_given_pages(spark):
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for row in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", row.html, re.S).group(1).replace("<br>", " ")
        pieces = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert main_text(row.html)[0] == "\n".join(p for p in pieces if p)
