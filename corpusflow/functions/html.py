"""HTML to clean source, text and title as Column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import spark_regex

# Tags that end a line, the typographic characters behind the codes
# 130-159, elements that are dropped, and what counts as an entity or an advert's anchor.
NEWLINE_TAGS = [
    "</div>", "<table>", "</td>", "</tr>", "</h1>", "</h2>", "</h3>", "<br>", "<br/>",
    "</p>", "<p>", "<hr>", "<hr/>", "<center>", "</center>", "<ul>", "</ul>",
]
WINDOWS_CHARS = {
    130: "‚", 131: "ƒ", 132: "„", 133: "…", 134: "†", 135: "‡", 136: "ˆ", 137: "‰",
    138: "Š", 139: "‹", 140: "Œ", 145: "‘", 146: "’", 147: "“", 148: "”", 149: "•",
    150: "–", 151: "—", 152: "˜", 153: "™", 154: "š", 155: "›", 156: "œ", 159: "Ÿ",
}
DROPPED_ELEMENTS = [
    "<script.*?</script>", "<style.*?</style>", "<rss.*?</rss>", "<!--.*?-->", "<img.*?>",
]
ENTITY = "&.+?;"
FEW_ENTITIES = 64  # distinct entities of a text that are looked up along a list
AD_ANCHOR = "&lt;a .*?/a&gt;"


def clean_html(html: Column) -> Column:
    """The source on one line, without scripts, styles, feeds, comments and images."""
    out = F.regexp_replace(html, spark_regex(r"\s+"), " ")
    for pattern in DROPPED_ELEMENTS:
        out = F.regexp_replace(out, spark_regex(pattern, ignore_case=True), " ")
    return out


def _character(code: Column) -> Column:
    """The character of a code point; a blank where there is none."""
    usable = (code >= 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    safe = F.when(usable, code).otherwise(F.lit(32))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def _named_characters() -> Column:
    pairs: list[Column] = []
    for name, code in name2codepoint.items():
        pairs += [F.lit(name), F.lit(chr(code))]
    return F.create_map(*pairs)


def _entity_character(body: Column) -> Column:
    """Replacement of one entity, given what stands between ``&`` and ``;``."""
    windows = F.create_map(*[F.lit(v) for pair in WINDOWS_CHARS.items() for v in pair])
    hex_code = F.conv(F.substring(body, 3, 10), 16, 10).cast("long")
    dec_code = F.try_to_number(F.substring(body, 2, 12), F.lit("999999999999")).cast("long")
    return (
        F.when(body == "amp", "&")
        .when(body == "lt", "<")
        .when(body == "gt", ">")
        .when(body.rlike("^#x[0-9a-fA-F]{1,8}$"), _character(hex_code))
        .when(
            body.rlike("^#[0-9]{1,10}$"),
            F.coalesce(F.try_element_at(windows, dec_code.cast("int")), _character(dec_code)),
        )
        .otherwise(F.coalesce(F.try_element_at(_named_characters(), body), F.lit(" ")))
    )


def _entity_characters(entities: Column) -> Column:
    """Replacements of the entities of a text; each distinct one is decoded once, unless they are many."""

    def decoded(all: Column) -> Column:
        return F.transform(all, lambda e: _entity_character(F.substring(e, F.lit(2), F.length(e) - 2)))

    def looked_up(pair: Column) -> Column:
        # a look-up runs along the distinct ones
        return F.when(
            F.size(pair["distinct"]) <= FEW_ENTITIES,
            F.flatten(F.transform(
                F.array(F.map_from_arrays(pair["distinct"], decoded(pair["distinct"]))),
                lambda known: F.transform(pair["all"], lambda e: F.element_at(known, e)),
            )),
        ).otherwise(decoded(pair["all"]))

    return F.flatten(F.transform(F.array(F.struct(entities.alias("all"), F.array_distinct(entities).alias("distinct"))), looked_up))


def decode_entities(text: Column) -> Column:
    """Numeric and named entities become characters, unknown ones a blank."""
    pattern = spark_regex(ENTITY)
    between = F.split(text, pattern)
    bodies = _entity_characters(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    # the text before each entity, the entity, and the text after the last one
    woven = F.zip_with(
        between, bodies, lambda plain, char: F.concat(plain, F.coalesce(char, F.lit("")))
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(woven, "")).otherwise(text)


def fix_windows_chars(text: Column) -> Column:
    codes = "".join(chr(c) for c in WINDOWS_CHARS)
    return F.translate(text, codes, "".join(WINDOWS_CHARS.values()))


def strip_ad_anchors(text: Column) -> Column:
    return F.regexp_replace(text, spark_regex(AD_ANCHOR, ignore_case=True), " ")


def _squeeze(text: Column) -> Column:
    out = F.regexp_replace(text, r"[ \t\r\f\x0B\n]*\n+[ \t\r\f\x0B\n]*", "\n")
    out = F.regexp_replace(out, r"[ \t\r\f\x0B]+", " ")
    return F.substring(out, F.lit(2), F.greatest(F.length(out) - 2, F.lit(0)))


def _without_tags(html: Column) -> Column:
    out = F.regexp_replace(html, spark_regex("|".join(NEWLINE_TAGS), ignore_case=True), "\n")
    return F.regexp_replace(out, spark_regex("<.*?>"), " ")


def html_to_text(html: Column) -> Column:
    """Plain text of a page source."""
    out = fix_windows_chars(decode_entities(_without_tags(html)))
    out = F.regexp_replace(out, r"/\*|\*/", " ")
    return _squeeze(out)


def field_to_text(html: Column) -> Column:
    """Plain text of selected elements: cleaned first, escaped anchors dropped."""
    out = decode_entities(strip_ad_anchors(_without_tags(clean_html(html))))
    out = F.regexp_replace(out, r"/\*|\*/", " ")
    return _squeeze(out)


def page_title(html: Column, url: Column) -> Column:
    """Text of the title element, else the last segment of the URL without ``.pdf``."""
    pattern = r"(?is)<title[^>]*>(.*?)</title>"
    name = F.element_at(F.split(url, "/"), -1)
    return F.when(
        html.rlike(pattern), decode_entities(F.regexp_extract(html, pattern, 1))
    ).otherwise(F.regexp_replace(name, r"\.pdf$", ""))
