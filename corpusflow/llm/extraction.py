"""Main text of web pages by two passes of rules over blocks.

A page becomes a list of blocks (text between block-level tags). Pass one decides blocks by what
they are: where they stand, their length, the share of their words inside links and the share of
stop words. Short blocks without a clear sign stay open. Pass two gives each open block the
label of its nearest decided neighbour.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answer, table

# Elements whose content is never text of the page, elements that start a new block,
# elements without content, and elements and attribute words that mark parts around the article.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button head title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
WORDS_AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion breadcrumb breadcrumbs "
    "comment comments respond replies disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login sidebar side widget widgets nav navbar navigation menu footer masthead topbar toolbar share sharing "
    "social related recommended recommendations pagination pager search copyright disclaimer hidden".split()
)
#: Beginnings that say the same in compound names.
STEMS = ("comment", "advert", "sponsor", "cookie", "sidebar", "newsletter", "promo", "banner", "footer", "breadcrumb", "nav")
#: Names of the article itself: a header or banner of these is part of it.
WORDS_ARTICLE = frozenset("article content entry post story main body page".split())
SOFT = frozenset("header banner side".split())
#: Elements where a word of the attribute speaks about the whole page, and words that turn it round.
WHOLE = frozenset("html body main".split())
TURNED = frozenset("has with no without".split())

# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was "
    "were which will with you au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que "
    "qui sa se ses son sont sur un une vous aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es "
    "für hat ich ihr im ist mit nach nicht noch oder sich sie sind so und unter vom von vor war wenn wie wird zu zum zur al como con cuando del "
    "el ella entre era esta este fue ha hay la las lo los más mi muy no o para pero por sin sobre son su sus también todo tu una y ya".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z)"
    r"|</[^>]*+(?:>|\Z)",
    re.S,
)
#: Elements whose content holds no markup at all: without an end they take the rest of the page.
RAW = frozenset("script style textarea title".split())
END = {n: re.compile(rf"</{n}(?:[\s/][^>]*)?(?:>|\Z)" + (r"|(?=<body\b)" if n == "head" else ""), re.I) for n in SKIPPED}
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WORD = re.compile(r"[^\W\d_]+")

#: A block with more of its words in links is not prose.
LINK_DENSITY = 0.5
#: Fewer words are too few to judge by stop words.
SHORT = 12
#: Share of stop words in prose.
STOP_DENSITY = 0.1
#: Words that an article element must hold to be taken for the article.
ARTICLE_WORDS = 1
#: Share of the page's prose that article elements must hold to be taken for the article, and words
#: of other prose up to which one with the page's heading is taken for it anyway.
ARTICLE_SHARE = 0.25
LITTLE = 50
#: Shares of the page's prose and of its unlinked words in a form or a named part that wraps the page.
WRAPPED_PROSE = 0.8
WRAPPED_WORDS = 0.5


@dataclass
class Block:
    tag: str
    outside: bool  # within a part around the article
    article: int  # within an article (2) or a main part (1)
    part: int = 0  # within a main part (1), articles aside
    fixed: bool = False  # outside by more than forms and names
    wrappers: tuple[int, ...] = ()  # numbers of the forms and named parts that make it outside
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    words: int = 0
    link_words: int = 0
    stops: int = 0
    label: str = ""

    def close(self) -> None:
        self.text = " ".join("".join(self.pieces).split())
        words = WORD.findall(self.text.lower())
        self.words = len(words)
        self.stops = sum(w in STOP_WORDS for w in words)
        self.link_words = len(WORD.findall(" ".join(self.linked))) if self.linked else 0


def is_around(tag: str, attributes: str, in_article: bool) -> bool:
    """Does the start tag open a part around the article?"""
    if tag in AROUND or (tag == "header" and not in_article):
        return True
    if not attributes or tag in WHOLE:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id"):
            for one in value.split():
                parts = {p.lower() for p in PART.findall(one)}
                told = {p for p in parts if p in WORDS_AROUND or (p.startswith(STEMS) and p != "commentary") or p == "header"}
                if parts & TURNED:
                    continue
                if tag == "article":
                    # an article of its own unless it is a reader's or an advertiser's
                    told = {p for p in told if p.startswith(("comment", "advert", "sponsor", "promo")) or p in ("ad", "ads", "reply", "replies")}
                if told - SOFT or (told and not in_article and not parts & WORDS_ARTICLE):
                    return True
    return False


def is_fixed(tag: str, attributes: str, in_article: bool) -> bool:
    """Is it around the article by more than a form or a name, which may also wrap a whole page?"""
    unnamed = ATTRIBUTE.sub(lambda m: "" if m[1].lower() in ("class", "id") else m[0], attributes)
    return tag == "p" or is_around("div" if tag == "form" else tag, unnamed, in_article)


def article_level(tag: str, attributes: str) -> int:
    """2 where the start tag says that an article follows, 1 where it says so of the main part, else 0."""
    if tag == "article":
        return 2
    if tag == "main":
        return 1
    if "class" not in attributes and "id" not in attributes:
        return 0
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for one in "".join(values).split():
                parts = {p.lower() for p in PART.findall(one)}
                if (parts & {"article", "entry", "post", "story"} and parts & {"content", "body", "text"}) or (
                    name.lower() == "id" and one.lower() in ("article", "content", "main", "main-content")
                ):
                    return 1
    return 0


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    found: list[Block] = []
    top = Block("", False, 0)
    stack: list[tuple[str, Block]] = []  # open elements: name, what holds for their text
    block = Block("", False, 0)
    paragraph_outside, in_link, at, wrappers = False, False, 0, 0

    def add(text: str) -> None:
        if text:
            decoded = html.unescape(text) if "&" in text else text
            block.pieces.append(decoded)
            if in_link:
                block.linked.append(decoded)

    def turn(tag: str) -> None:
        nonlocal block
        block.close()
        if block.text:
            found.append(block)
        here = stack[-1][1] if stack else top
        block = Block(tag, here.outside or paragraph_outside, here.article, here.part, here.fixed or paragraph_outside, here.wrappers)

    while token := TOKEN.search(page, at):
        add(page[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            if token["cdata"]:
                block.pieces.append(token["cdata"])
            continue
        closing = bool(token["close"])
        if name in SKIPPED:
            if not closing and not token["rest"].endswith("/"):
                stop = END[name].search(page, at)
                if stop:
                    at = stop.end()
                elif name in RAW:
                    at = len(page)
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            add(" ")
        if name in BLOCKS:
            paragraph_outside, in_link = False, in_link and not closing
        if closing:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
                turn(name)
            elif name in BLOCKS:
                turn(name)
        elif name in EMPTY:
            if name in BLOCKS:
                turn(name)
        else:
            here = stack[-1][1] if stack else top
            around = is_around(name, token["rest"], here.article > 0)
            if name == "p":
                paragraph_outside = around
                turn(name)
            elif name in BLOCKS or around:
                level = article_level(name, token["rest"])
                fixed = around and is_fixed(name, token["rest"], here.article > 0)
                wrappers += around
                inner = Block(name, here.outside or around, max(here.article, level), max(here.part, level % 2), here.fixed or fixed)
                inner.wrappers = (*here.wrappers, wrappers) if around and not fixed else here.wrappers
                stack.append((name, inner))
                turn(name)
    add(page[at:])
    turn("")
    return found


def unlinked(b: Block) -> int:
    return b.words - b.link_words


def is_prose(b: Block) -> bool:
    return b.words >= SHORT and b.link_words <= LINK_DENSITY * b.words


def unwrap(blocks: list[Block]) -> None:
    """A form or a named part that holds nearly all prose of the page is no part around it."""
    if not any(b.wrappers for b in blocks):
        return
    open_ = [b for b in blocks if not b.fixed]
    prose, words = sum(b.words for b in open_ if is_prose(b)), sum(map(unlinked, open_))
    held: dict[int, list[int]] = {}
    for b in open_:
        for w in b.wrappers:
            counts = held.setdefault(w, [0, 0])
            counts[0] += b.words if is_prose(b) else 0
            counts[1] += unlinked(b)
    whole = {w for w, (p, n) in held.items() if p and p >= WRAPPED_PROSE * prose and n >= WRAPPED_WORDS * words}
    for b in blocks:
        b.wrappers = tuple(w for w in b.wrappers if w not in whole)
        b.outside = b.fixed or bool(b.wrappers)


def weigh_articles(blocks: list[Block]) -> None:
    """Article elements that hold too little of the page's prose, such as teasers, count as what they stand in."""
    inside = [b for b in blocks if b.article == 2 and not b.outside]
    own = sum(map(unlinked, inside))
    other = sum(b.words for b in blocks if b.article < 2 and not b.outside and is_prose(b))
    if own >= ARTICLE_SHARE * (own + other) or (other <= LITTLE and any(b.tag == "h1" for b in inside)):
        return
    for b in blocks:
        b.article = b.part


def label_blocks(blocks: list[Block]) -> None:
    """Both passes; sets ``label`` to "good" or "bad"."""
    unwrap(blocks)
    weigh_articles(blocks)
    # the closest thing to an article that the page names
    level = max((b.article for b in blocks if not b.outside), default=0)
    for b in blocks:
        b.article = int(b.article == level > 0)
    inside = [b for b in blocks if b.article and not b.outside]
    has_article = sum(b.words for b in inside) >= ARTICLE_WORDS
    # in a language without known function words their absence says nothing
    around = [b for b in blocks if not b.outside]
    served = sum(b.stops for b in around) >= STOP_DENSITY / 4 * sum(b.words for b in around)
    for i, b in enumerate(blocks):
        density = b.link_words / b.words if b.words else 0.0
        if b.outside or (has_article and not b.article):
            b.label = "bad"
        elif density > LINK_DENSITY:
            # one linked line may belong to the text; a row of them is a menu
            row = [n for n in blocks[max(0, i - 1) : i + 2] if n.words and n.link_words / n.words > LINK_DENSITY]
            b.label = "bad" if b.tag == "li" or len(row) > 1 or not b.article else ""
        elif b.article and has_article:
            b.label = "good" if b.words >= SHORT else ""
        elif b.words >= SHORT:
            b.label = "good" if not served or b.stops / b.words >= STOP_DENSITY else "bad"
        elif re.match(r"(?:©|\(c\)|copyright\b)", b.text, re.I):
            b.label = "bad"
    if not any(b.label == "good" for b in blocks):
        # no prose at all: what no rule has spoken against is the text
        for b in blocks:
            b.label = b.label or "good"
    before: list[tuple[int, str] | None] = []
    last = None
    for i, b in enumerate(blocks):
        last = (i, b.label) if b.label else last
        before.append(last)
    after: list[tuple[int, str] | None] = [None] * len(blocks)
    last = None
    for i in range(len(blocks) - 1, -1, -1):
        last = (i, blocks[i].label) if blocks[i].label else last
        after[i] = last
    for i, b in enumerate(blocks):
        if b.label:
            continue
        if b.article and has_article:
            # the element itself is the nearest neighbour of its own short blocks
            near = [x for x in (before[i], after[i]) if x and blocks[x[0]].article and not blocks[x[0]].outside]
            b.label = "good" if not near or any(label == "good" for _, label in near) or b.link_words == 0 else "bad"
            continue
        left, right = before[i], after[i]
        if left and right and left[1] != right[1]:
            d = (i - left[0]) - (right[0] - i)
            # a heading belongs to what follows it; otherwise the nearer one counts, and prose wins a tie
            b.label = right[1] if re.fullmatch(r"h[1-6]", b.tag) or d > 0 else left[1] if d < 0 else "good"
        else:
            b.label = (left or right or (0, "good"))[1]


def main_text(page: str | None) -> tuple[str, int, int]:
    """Text of the good blocks joined by newlines, number of blocks, number of good ones."""
    blocks = blocks_of(page or "")
    label_blocks(blocks)
    good = [b.text for b in blocks if b.label == "good"]
    return "\n".join(good), len(blocks), len(good)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_kept`` for every row.

    The whole page is read. A null or empty page, or one without text, gives the empty text. Ids and
    urls pass through as they are, null and repeated ones too; other columns are not read.
    ``n_chars`` counts code points.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, blocks, kept = zip(*map(main_text, batch["html"])) if len(batch) else ((), (), ())
            yield pd.DataFrame({
                "page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts],
                "n_blocks": blocks, "n_kept": kept,
            })

    chosen = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    kind = chosen.schema["page_id"].dataType.simpleString()
    return chosen.mapInPandas(extract, f"page_id {kind}, url string, text string, n_chars long, n_blocks int, n_kept int")


@answer()
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
