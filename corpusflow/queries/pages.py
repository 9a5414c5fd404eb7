"""Extraction from stored pages, links and readers of text tables."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from ..functions import cells, html, urls
from ..operators import extract
from ..sources import readers
from .base import SQL_WHITE, heavy, query, sql_breaks, sql_line_breaks, table

ALLOW, DENY = "example", "/(the|de|of)$"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_entities(text: str) -> str:
    """Entities of ``text`` decoded: the parts between them woven with their characters."""
    named = "map {" + ", ".join(f"{sql_text(n)}: chr({c})" for n, c in sorted(name2codepoint.items())) + "}"
    windows = "map {" + ", ".join(f"{c}: {sql_text(v)}" for c, v in html.WINDOWS_CHARS.items()) + "}"
    body = f"""CASE
      WHEN regexp_full_match(b, '#x[0-9a-fA-F]{{1,8}}') THEN chr(('0x' || b[3:])::BIGINT::INTEGER)
      WHEN regexp_full_match(b, '#[0-9]{{1,10}}') THEN coalesce({windows}[b[2:]::INTEGER], chr(b[2:]::INTEGER))
      ELSE coalesce({named}[b], ' ') END"""
    return f"""array_to_string(list_transform(
      list_zip(string_split_regex({text}, '&[^\\n]+?;'),
               list_transform(regexp_extract_all({text}, '&([^\\n]+?);', 1), lambda b: {body})),
      lambda p: p[1] || coalesce(p[2], '')), '')"""


def sql_replace(text: str, *pairs: tuple[str, str, str]) -> str:
    for pattern, new, flags in pairs:
        text = f"regexp_replace({text}, {sql_text(pattern)}, {new}, '{flags}')"
    return text


def sql_clean(text: str) -> str:
    dropped = [(p, "' '", "gi") for p in html.DROPPED_ELEMENTS]
    return sql_replace(text, (SQL_WHITE + "+", "' '", "g"), *dropped)


def sql_untagged(text: str) -> str:
    return sql_replace(text, ("|".join(html.NEWLINE_TAGS), "chr(10)", "gi"), ("<[^\\n]*?>", "' '", "g"))


SQUEEZE = (
    ("/\\*|\\*/", "' '", "g"),
    ("[ \\t\\r\\f\\v\\n]*\\n+[ \\t\\r\\f\\v\\n]*", "chr(10)", "g"),
    ("[ \\t\\r\\f\\v]+", "' '", "g"),
)
_CODES = "".join(f" || chr({c})" for c in html.WINDOWS_CHARS)
SQL_WINDOWS = "translate({}, ''" + _CODES + ", " + sql_text("".join(html.WINDOWS_CHARS.values())) + ")"

SQL_TEXTS = f"""cleaned AS (SELECT page_id, url, html, {sql_clean('html')} AS clean FROM pages),
untagged AS (SELECT page_id, url, html, {sql_untagged('clean')} AS u FROM cleaned),
decoded AS (SELECT page_id, url, html, {SQL_WINDOWS.format('(' + sql_entities('u') + ')')} AS d FROM untagged),
squeezed AS (SELECT page_id, url, html, {sql_replace('d', *SQUEEZE)} AS s FROM decoded),
titled AS (SELECT *, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>(.*?)</title>')
    THEN regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END AS t,
    regexp_replace(string_split(url, '/')[-1], '\\.pdf$', '') AS name FROM squeezed),
texts AS (SELECT page_id, url, s[2:-2] AS text, CASE WHEN t IS NULL THEN name ELSE {sql_entities('t')} END AS title FROM titled)"""


@query(f"SELECT page_id, {sql_clean('html')} AS clean FROM pages")
def clean_html(spark, sf):
    return heavy(spark, sf, "pages").select("page_id", html.clean_html(F.col("html")).alias("clean"))


@query(f"WITH {SQL_TEXTS} SELECT page_id, text FROM texts")
def html_to_text(spark, sf):
    return heavy(spark, sf, "pages").select(
        "page_id", html.html_to_text(html.clean_html(F.col("html"))).alias("text")
    )


@query(f"WITH p AS (SELECT page_id, replace(html, 'e', '&eacute;&#233;&#xE9;&#146;&bogus;') AS html FROM pages) SELECT page_id, {sql_entities('html')} AS decoded FROM p")
def decode_entities(spark, sf):
    marked = F.replace("html", F.lit("e"), F.lit("&eacute;&#233;&#xE9;&#146;&bogus;"))
    return heavy(spark, sf, "pages").select("page_id", html.decode_entities(marked).alias("decoded"))


@query("WITH p AS (SELECT doc_id, translate(text, 'eant', '' || chr(130) || chr(133) || chr(146) || chr(159)) AS text FROM documents) "
       f"SELECT doc_id, {SQL_WINDOWS.format('text')} AS text FROM p")
def fix_windows_chars(spark, sf):
    broken = F.translate("text", "eant", "\x82\x85\x92\x9f")
    return table(spark, sf, "documents").select("doc_id", html.fix_windows_chars(broken).alias("text"))


@query(f"WITH {SQL_TEXTS} SELECT page_id, title FROM texts")
def page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.page_title(F.col("html"), F.col("url")).alias("title"))


@query(f"""WITH {SQL_TEXTS} SELECT page_id, length(text) AS nb_characters, {sql_line_breaks('text')} AS nb_sentences,
  length(title) AS title_nb_characters, greatest(1, {sql_breaks('title')})::BIGINT AS title_nb_sentences FROM texts""")
def page_stats(spark, sf):
    return extract.page_texts(heavy(spark, sf, "pages")).select(
        "page_id", "nb_characters", "nb_sentences", "title_nb_characters", "title_nb_sentences"
    )


# Links of the table are absolute paths, absolute URLs or relative names without dots.
SQL_LINKS = f"""found AS (
  SELECT page_id, url, unnest(tags) AS tag, unnest(range(len(tags))) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<(?:a|area)[\\s/][^>]*?href=[ ]*(?:["''].*?["'']|[^\\s"''>]+)') AS tags FROM pages)),
hrefs AS (SELECT page_id, url, pos, string_split(coalesce(nullif(regexp_extract(tag, '(?is)href=[ ]*["''](.*?)["'']', 1), ''),
            regexp_extract(tag, '(?is)href=[ ]*([^\\s"''>]+)', 1)), '#')[1] AS raw FROM found),
wanted AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, raw FROM (
    SELECT page_id, url, pos, {sql_entities('raw')} AS raw FROM hrefs)
  WHERE NOT regexp_matches(lower(trim(raw)), '^(javascript|mailto):')),
absolute AS (SELECT page_id, pos::INTEGER AS pos, CASE
    WHEN raw = '' THEN url
    WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN raw
    WHEN starts_with(raw, '//') THEN regexp_extract(url, '^[A-Za-z]+:') || raw
    WHEN starts_with(raw, '/') THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || raw
    ELSE regexp_extract(url, '^([A-Za-z]+://[^?#]*/)', 1) || raw END AS link FROM wanted),
links AS (SELECT page_id, pos, regexp_replace(regexp_replace(link, '^([a-zA-Z]+://[^/?#]*)/$', '\\1'),
    '(?i)/(index\\.(html|htm|cgi|xml|rxml|php|asp|aspx|shtml)|default\\.(asp|aspx))$', '') AS link FROM absolute)"""


@query(f"WITH {SQL_LINKS} SELECT * FROM links")
def extract_links(spark, sf):
    return extract.extract_links(heavy(spark, sf, "pages"), "page_id")


@query(f"""WITH {SQL_LINKS} SELECT page_id, link, min(pos) AS pos FROM links
WHERE regexp_matches(link, '{ALLOW}') AND NOT regexp_matches(link, '{DENY}') AND link NOT IN (SELECT url FROM pages)
GROUP BY page_id, link""")
def select_links(spark, sf):
    pages = heavy(spark, sf, "pages")
    return extract.select_links(extract.extract_links(pages, "page_id"), "page_id", pages.select("url"), True, ALLOW, DENY)


@query("""WITH h AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.') AS l FROM pages)
SELECT page_id, array_to_string(l[:len(l) - 2], '.') AS subdomain FROM h""")
def subdomain(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.subdomain(F.col("url")).alias("subdomain"))


@query(f"SELECT doc_id, {sql_breaks('text')} AS nb_sentences, length(text) AS nb_characters FROM documents")
def cell_stats(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", cells.sentence_breaks(F.col("text")).cast("long").alias("nb_sentences"),
        F.length("text").cast("long").alias("nb_characters"),
    )


CONTINUA = "length(replace({0}, ' ', '')) / (length({0}) + 1.0) > 0.9"


@query(f"""SELECT doc_id, CASE WHEN {CONTINUA.format('text')} THEN length(text) ELSE len(string_split_regex(text, '{SQL_WHITE}+')) END AS text_nb_words,
  {sql_line_breaks('text')} AS text_nb_sentences FROM documents""")
def field_stats(spark, sf):
    return extract.field_stats(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query(f"SELECT doc_id, {CONTINUA.format('text')} AS continua FROM documents")
def is_lingua_continua(spark, sf):
    return table(spark, sf, "documents").select("doc_id", cells.is_lingua_continua(F.col("text")).alias("continua"))


@query(f"SELECT lang, sum({sql_breaks('text')})::BIGINT AS breaks FROM documents GROUP BY lang")
def sentence_splitter(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.sum(cells.sentence_breaks(F.col("text"))).cast("long").alias("breaks"))


FOOTER = "array_to_string(list_transform(regexp_extract_all(html, '(?s)<footer>.*?</footer>'), lambda f: f || ' '), '')"


@query(f"SELECT page_id, '<html>' || chr(10) || {FOOTER} || chr(10) || '</html>' AS footer FROM pages")
def extract_field_source(spark, sf):
    return extract.extract_field(table(spark, sf, "pages"), "footer", tag="footer", as_text=False).select("page_id", "footer")


@query(f"""WITH f AS (SELECT page_id, {sql_untagged(sql_clean(FOOTER))} AS u FROM pages),
d AS (SELECT page_id, {sql_entities('u')} AS d FROM f)
SELECT page_id, ({sql_replace('d', *SQUEEZE)})[2:-2] AS footer FROM d""")
def extract_field(spark, sf):
    return extract.extract_field(heavy(spark, sf, "pages"), "footer", tag="footer").select("page_id", "footer")


@query("SELECT starts_with(t, '<html>') AS is_source FROM (SELECT page_id, lower(html) AS t FROM pages WHERE html <> '' ORDER BY page_id LIMIT 1)")
def is_source_column(spark, sf):
    pages = table(spark, sf, "pages").withColumn("html", F.lower("html"))
    return extract.is_source_column(pages, "html", "page_id")


@query(f"""WITH p AS (SELECT page_id, replace(replace(html, '<a ', '&lt;a '), '</a>', '&lt;/a&gt;') AS html FROM pages)
SELECT page_id, regexp_replace(html, '{html.AD_ANCHOR}', ' ', 'gi') AS html FROM p""")
def strip_ad_anchors(spark, sf):
    escaped = F.replace(F.replace("html", F.lit("<a "), F.lit("&lt;a ")), F.lit("</a>"), F.lit("&lt;/a&gt;"))
    return table(spark, sf, "pages").select("page_id", html.strip_ad_anchors(escaped).alias("html"))


# ------------------------------------------------------------------ readers on derived tables


def line_table(spark, sf):
    """Lines of all documents as lines of one file per document, commas as tabs."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("i", "line")
    ).select("file", (F.col("i") + 1).alias("line_no"), F.translate("line", ",", "\t").alias("line"))


@query(r"""WITH l AS (SELECT doc_id::VARCHAR AS url, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) + 1 AS rowid FROM documents),
f AS (SELECT url, rowid, string_split(regexp_replace(translate(line, ',', chr(9)), '^\s+|\s+$', '', 'g'), chr(9)) AS f FROM l)
SELECT rowid, url, -1::BIGINT AS link_origin_rowid, CASE WHEN len(f) > 1 THEN array_to_string(f[:-2], ' ') ELSE rowid::VARCHAR END AS title, f[-1] AS text FROM f""")
def scan_tsv(spark, sf):
    return readers.parse_tsv(line_table(spark, sf))


@query(r"""WITH p AS (SELECT page_id, string_split(translate(coalesce(html, ''), ' ' || chr(13), chr(9)), chr(10)) AS l FROM pages),
l AS (SELECT page_id || '.tsv' AS name, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM p),
n AS (SELECT name, unnest(l) AS line, unnest(range(len(l))) + 1 AS rowid FROM l),
f AS (SELECT name, rowid, string_split(regexp_replace(line, '^\s+|\s+$', '', 'g'), chr(9)) AS f FROM n)
SELECT name, rowid, CASE WHEN len(f) > 1 THEN array_to_string(f[:-2], ' ') ELSE rowid::VARCHAR END AS title, f[-1] AS text FROM f""")
def scan_tsv_files(spark, sf):
    """Pages are written as one tab-separated file each, blanks as tabs, and read with running line numbers."""
    from ..plans.checkpoints import scratch_path
    from ..sources.writers import write_files

    name = F.concat(F.col("page_id").cast("string"), F.lit(".tsv")).alias("file_name")
    content = F.translate(F.coalesce("html", F.lit("")), " \r", "\t").alias("content")
    folder = scratch_path(spark, "tsv")
    write_files(table(spark, sf, "pages").select(name, content), folder).count()
    rows = readers.scan_tsv(spark, folder)
    return rows.select(F.element_at(F.split("url", "/"), -1).alias("name"), "rowid", "title", "text")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
           FROM (SELECT doc_id, replace(replace(text, '. ', chr(10)), ', ', chr(10) || doc_id || chr(10) || chr(10) || chr(10)) AS text FROM documents)),
m AS (SELECT *, sum(regexp_matches(trim(line), '^\d+$')::BIGINT) OVER (PARTITION BY doc_id ORDER BY line_no) AS chunk, trim(line) = '' AS blank FROM l),
b AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS after_blank FROM m)
SELECT doc_id, chunk::BIGINT AS chunk, line_no, line FROM b WHERE NOT (blank AND after_blank)""")
def segment_by_marker(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id",
        F.replace(
            F.replace("text", F.lit(". "), F.lit("\n")), F.lit(", "),
            F.concat(F.lit("\n"), F.col("doc_id").cast("string"), F.lit("\n\n\n")),
        ).alias("text"),
    )
    return readers.segment_by_marker(d, "doc_id", "text")


@query(r"""WITH w AS (SELECT unnest(string_split_regex(replace(url, 'https://', ''), '[/?&=]')) AS w FROM pages)
SELECT CASE WHEN regexp_matches(w, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN w ELSE 'http://' || w END AS url, 0 AS level, 0::BIGINT AS origin FROM w WHERE w <> ''""")
def scan_seeds(spark, sf):
    words = table(spark, sf, "pages").select(
        F.regexp_replace(F.replace("url", F.lit("https://"), F.lit("")), "[/?&=]", " ").alias("t")
    )
    return readers.scan_seeds(words, "t")


@query("SELECT url, 0 AS level, -1::BIGINT AS origin FROM pages WHERE regexp_matches(url, 'example\\.com')")
def seed_from_results(spark, sf):
    return readers.seed_from_results(table(spark, sf, "pages"), "url", r"example\.com")


@query("SELECT doc_id, text FROM documents")
def decode_bytes(spark, sf):
    stored = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-16BE").alias("content"))
    return stored.select("doc_id", readers.decode_bytes(F.col("content"), "UTF-16BE").alias("text"))


@query("SELECT doc_id, text || chr(65533) AS utf8, text || chr(65533) AS utf16 FROM documents")
def decode_bytes_malformed(spark, sf):
    """A byte that no encoding allows at the end becomes the replacement sign."""
    stored = table(spark, sf, "documents").select("doc_id", *[
        F.concat(F.encode("text", e), F.lit(bytearray(b"\xff"))).alias(e) for e in ("UTF-8", "UTF-16BE")
    ])
    return stored.select("doc_id", readers.decode_bytes(F.col("UTF-8")).alias("utf8"), readers.decode_bytes(F.col("UTF-16BE"), "UTF-16BE").alias("utf16"))


def sql_folder(kept: str) -> str:
    return f"SELECT page_id || '.html' AS name, 'text/html' AS mime, html AS source FROM pages WHERE {kept}"


@query(sql_folder("NOT starts_with(url, 'https://m.')"))
def scan_folder(spark, sf):
    """Pages are written as one file each, some as dot-files or of other kinds, and scanned."""
    from ..plans.checkpoints import scratch_path
    from ..sources.writers import write_files

    pages = table(spark, sf, "pages")
    mobile = F.startswith(F.col("url"), F.lit("https://m."))
    number = F.col("page_id").cast("string")
    name = F.when(mobile & (F.col("page_id") < 100), F.concat(F.lit("."), number, F.lit(".html"))).when(
        mobile, F.concat(number, F.lit(".bin"))
    ).otherwise(F.concat(number, F.lit(".html")))
    folder = scratch_path(spark, "folder")
    write_files(pages.select(name.alias("file_name"), F.col("html").alias("content")), folder).count()
    return readers.scan_folder(spark, folder).select(F.element_at(F.split("url", "/"), -1).alias("name"), "mime", "source")


@query("SELECT 'http://x/' || page_id AS url, 0 AS level, 0::BIGINT AS origin FROM pages")
def scan_seed_file(spark, sf):
    """URLs are written one per line, with blanks around them, and read back."""
    from ..plans.checkpoints import scratch_path

    path = scratch_path(spark, "seeds")
    table(spark, sf, "pages").select(F.concat(F.lit("  http://x/"), F.col("page_id").cast("string"), F.lit(" "))).write.text(path)
    return readers.scan_seed_file(spark, path)
