"""Concordances and exports of documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concordance as kwic
from ..operators import positions
from ..plans.checkpoints import scratch_path
from ..sources import writers
from .base import SQL_CORPUS, corpus, heavy, query, table
from .textometry import doc_index

WORD, BEFORE, AFTER = "the", 60, 40
RE = "(?i)\\bthe\\b"


def sql_concordance(source: str, key: str, trim: bool) -> str:
    left = "text[greatest(1, s - {b}):s - 1]".format(b=BEFORE)
    right = "text[s + length(m):s + length(m) + {a} - 1]".format(a=AFTER)
    if trim:
        words = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
        left = f"CASE WHEN s - 1 > {BEFORE} THEN array_to_string({words.format(left)}[2:], ' ') ELSE {left} END"
        right = f"""CASE WHEN length(text) >= s - 1 + length(m) + {AFTER}
          THEN array_to_string({words.format(right)}[:-2], ' ') ELSE {right} END"""
    return f"""cut AS (SELECT {key} AS id, text, string_split_regex(text, '{RE}') AS seg, regexp_extract_all(text, '{RE}') AS mat FROM {source}),
one AS (SELECT id, text, seg, mat, unnest(mat) AS m, unnest(range(len(mat))) AS pos FROM cut),
located AS (SELECT id, text, pos, m, 1 + list_sum(list_transform(seg[:pos + 1], lambda t: length(t)))::BIGINT
    + coalesce(list_sum(list_transform(mat[:pos], lambda t: length(t))), 0)::BIGINT AS s FROM one),
kwic AS (SELECT id, pos, {left} AS "left", m AS match, {right} AS "right" FROM located)"""


@query(f"WITH {sql_concordance('documents', 'doc_id', True)} SELECT id AS doc_id, pos, \"left\", match, \"right\" FROM kwic")
def concordance(spark, sf):
    return kwic.concordance(heavy(spark, sf, "documents"), "doc_id", "text", WORD, BEFORE, AFTER)


@query(f"WITH {sql_concordance('documents', 'doc_id', True)} SELECT id AS doc_id, pos, \"left\", match, \"right\" FROM kwic")
def index_concordance(spark, sf):
    """Only the documents that the stored index names are searched."""
    docs = table(spark, sf, "documents")
    return positions.concordance(doc_index(spark, sf), docs, "doc_id", "text", WORD, BEFORE, AFTER)


@query(f"""WITH {sql_concordance('documents', 'doc_id', False)} SELECT id AS doc_id, pos, "left", match, "right", row_number() OVER (ORDER BY id, pos) AS number FROM kwic""")
def numbered_concordance(spark, sf):
    return kwic.numbered_concordance(
        heavy(spark, sf, "documents"), "doc_id", "text", WORD, before=BEFORE, after=AFTER, trim=False
    )


@query("SELECT doc_id, regexp_replace(text, '(?i)ion', '[\\0$1]', 'g') AS text FROM documents")
def mark_matches(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", kwic.mark_matches(F.col("text"), "ion", "[", "$1]", whole_word=False).alias("text")
    )


SQL_PAGE = """'<page name="page" id="' || rowid || '" url="' || url || '" time="' || strftime(time, '%Y-%m-%d %H:%M:%S') || '" {g}>' || chr(10)
  || '<title>' || chr(10) || title || chr(10) || chr(10) || '</title>' || chr(10)
  || '<text>' || chr(10) || text || chr(10) || chr(10) || '</text>' || chr(10) || '</page>' || chr(10) || chr(10)"""


@query(f"WITH {SQL_CORPUS} SELECT rowid, {SQL_PAGE.format(g='')} AS page FROM corpus")
def export_text(spark, sf):
    return writers.export_text(corpus(spark, sf), "rowid", "url", "time", ["title", "text"])


GROUP_ATTRIBUTE = "group=\"' || site || '\""


@query(f"""WITH {SQL_CORPUS} SELECT rowid, site AS group_key, {SQL_PAGE.format(g=GROUP_ATTRIBUTE)} AS page, 1 AS rank FROM corpus
UNION ALL SELECT DISTINCT NULL, site, '<group name="' || site || '">' || chr(10), 0 FROM corpus
UNION ALL SELECT DISTINCT NULL, site, '</group>' || chr(10) || chr(10), 2 FROM corpus""")
def export_text_groups(spark, sf):
    pages = writers.export_text(corpus(spark, sf), "rowid", "url", "time", ["title", "text"], group="site")
    return writers.with_group_lines(pages, "rowid")


SQL_ESCAPED = "replace(regexp_replace(replace(replace({}, '<', '&lt;'), '>', '&gt;'), '(?i)\\b(?:{})\\b', '<span class=''match''>\\0</span>', 'g'), chr(10), '<br/>')"


@query(f"""WITH {SQL_CORPUS} SELECT rowid, '<div name="page" id="' || rowid || '" url="' || url || '" time="' || strftime(time, '%Y-%m-%d %H:%M:%S') || '" >'
  || '<div name=''title'' style=''color: #{writers.column_colours(2)[0]};''>' || chr(10) || {SQL_ESCAPED.format('title', WORD)} || chr(10) || '</div>' || chr(10)
  || '<div name=''text'' style=''color: #000;''>' || chr(10) || {SQL_ESCAPED.format('text', WORD)} || chr(10) || '</div>' || chr(10) || '</div>' || chr(10) AS page FROM corpus""")
def export_html(spark, sf):
    return writers.export_html(corpus(spark, sf), "rowid", "url", "time", ["title", "text"], match=WORD)


FRAME = "<html dir='%dir%'><head><title>%name% %date%</title></head><body>%info%\n%corpus%</body></html>"


@query(f"""WITH {SQL_CORPUS} SELECT rowid, site AS group_key, 1 AS rank, '<div name="page" id="' || rowid || '" url="' || url || '" time="' || strftime(time, '%Y-%m-%d %H:%M:%S') || '" group="' || site || '">'
  || '<div name=''title'' style=''color: #{writers.column_colours(2)[0]};''>' || chr(10) || {SQL_ESCAPED.format('title', WORD)} || chr(10) || '</div>' || chr(10)
  || '<div name=''text'' style=''color: #000;''>' || chr(10) || {SQL_ESCAPED.format('text', WORD)} || chr(10) || '</div>' || chr(10) || '</div>' || chr(10) AS page FROM corpus
UNION ALL SELECT DISTINCT NULL, site, 0, '<group name="' || site || '">' || chr(10) FROM corpus
UNION ALL SELECT DISTINCT NULL, site, 2, '</group>' || chr(10) || chr(10) FROM corpus
UNION ALL SELECT NULL, NULL, -1, '<html dir=''ltr''><head><title>documents 2024-01-01</title></head><body>by site' || chr(10)
UNION ALL SELECT NULL, NULL, 3, '</body></html>'""")
def export_html_groups(spark, sf):
    """Pages by site, with lines that open and close each group, in the head and foot of a template."""
    pages = writers.export_html(corpus(spark, sf), "rowid", "url", "time", ["title", "text"], group="site", match=WORD)
    head, foot = writers.html_frame(FRAME, "documents", "by site", "2024-01-01", "ltr")
    return writers.with_frame(writers.with_group_lines(pages, "rowid"), "rowid", head, foot)


@query("SELECT page_id, url || '<hr>' || chr(10) || html || '<hr>' || chr(10) || chr(10) AS page FROM pages WHERE contains(url, '.com')")
def export_sources(spark, sf):
    pages = table(spark, sf, "pages")
    return writers.export_sources(pages, pages.where(F.col("url").contains(".com")), "page_id", source="html")


# Names by site and language only, so that most of them clash.
CLASHING = "SELECT doc_id, 'http://' || source || '/' || lang || '/' || repeat('x', CASE WHEN n_chars > 6000 THEN 300 ELSE 1 END) AS url FROM documents"


@query(f"""WITH u AS ({CLASHING}), n AS (SELECT doc_id, replace(string_split(url, '//')[2], '/', '---') AS name FROM u),
s AS (SELECT doc_id, name || repeat('__1', (row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1)::BIGINT) || '.txt' AS f FROM n),
c AS (SELECT doc_id, f[:247] || '-ETC.txt' AS f FROM s WHERE length(f) > 255),
k AS (SELECT doc_id, f, (row_number() OVER (PARTITION BY f ORDER BY doc_id) - 1)::VARCHAR AS k FROM c)
SELECT doc_id, f AS file_name FROM s WHERE length(f) <= 255
UNION ALL SELECT doc_id, CASE WHEN k = '0' THEN f ELSE f[:length(f) - length(k)] || k END FROM k""")
def file_names(spark, sf):
    url = F.concat(
        F.lit("http://"), "source", F.lit("/"), "lang", F.lit("/"),
        F.repeat(F.lit("x"), F.when(F.col("n_chars") > 6000, 300).otherwise(1)),
    )
    return writers.file_names(table(spark, sf, "documents").select("doc_id", url.alias("url")), "doc_id", "url")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) || '.txt' AS file_name FROM documents")
def file_names_numbered(spark, sf):
    return writers.file_names(table(spark, sf, "documents"), "doc_id", overwrite=True)


@query(f"WITH {SQL_CORPUS} SELECT rowid, '<title>' || chr(10) || title || chr(10) || '<text>' || chr(10) || text || chr(10) AS content FROM corpus")
def file_contents(spark, sf):
    return writers.file_contents(corpus(spark, sf), "rowid", ["title", "text"], "angle")


@query(f"WITH {SQL_CORPUS} SELECT rowid || '.txt' AS file_name, length(title || chr(10) || text || chr(10)) AS n_chars FROM corpus")
def export_files(spark, sf):
    c = corpus(spark, sf)
    contents = writers.file_contents(c, "rowid", ["title", "text"]).select(
        F.concat(F.col("rowid").cast("string"), F.lit(".txt")).alias("file_name"), "content"
    )
    folder = scratch_path(spark, "files")
    return writers.write_files(contents, folder)


@query(f"WITH {SQL_CORPUS} SELECT rowid, url, translate(text, chr(10) || chr(9), '↩⇥') AS text FROM corpus")
def save_table(spark, sf):
    """A table is written with a header and read back."""
    path = scratch_path(spark, "table")
    writers.save_table(corpus(spark, sf).select("rowid", "url", "text"), path)
    schema = "rowid long, url string, text string"
    return spark.read.option("sep", "\t").option("header", "true").option("quote", "").schema(schema).csv(path)
