"""Views, filters, groups, duplicates and reductions over documents."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions.cells import escape_tags as escape_column
from ..operators import views
from ..operators.views import Condition, SavedSelection, Visible
from ..sources import readers
from .base import SQL_CORPUS, corpus, heavy, query, sql_breaks, table

TEXT_COLUMNS = {1: "title", 2: "text"}
SQL_CELLS = f"""cells AS (
  SELECT rowid AS sourceid, 1 AS textualid, columnid, text, {sql_breaks('text')} AS nb_sentences, length(text) AS nb_characters
  FROM (SELECT rowid, 1 AS columnid, title AS text FROM corpus UNION ALL SELECT rowid, 2, text FROM corpus))"""
# a cell is missing where its text is short: such sources drop out of the view
LONG = 120
CUT = datetime.datetime(2024, 1, 1, 5, 0)


def cells(spark, sf):
    return views.cells_of(corpus(spark, sf, heavy), "rowid", TEXT_COLUMNS)


def some_cells(spark, sf):
    return cells(spark, sf).where((F.col("columnid") == 1) | (F.col("nb_characters") > LONG))


SOME = SQL_CELLS.replace("cells AS", "all_cells AS") + f""",
cells AS (SELECT * FROM all_cells WHERE columnid = 1 OR nb_characters > {LONG})"""


def definitions(spark):
    """Column definitions as a corpus registers them: fixed by its schema, not data."""
    names = spark.createDataFrame([(1, "title"), (2, "text"), (3, "lemma")], readers.NAMES)
    registry = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2)], readers.REGISTRY)
    return names, registry


@query(f"WITH {SQL_CORPUS}, {SQL_CELLS} SELECT * FROM cells")
def corpus_tables(spark, sf):
    """Write the long cells with the schema of a corpus and read them back."""
    from ..plans.checkpoints import scratch_path

    path = scratch_path(spark, "texts")
    cells(spark, sf).write.parquet(path)
    return spark.read.schema(readers.TEXTS).parquet(path)


@query(f"""WITH {SQL_CORPUS}, {SOME}
SELECT rowid, url, link_origin_rowid, time, t.nb_characters AS title_nb_characters, t.nb_sentences AS title_nb_sentences, t.text AS title,
  x.nb_characters AS text_nb_characters, x.nb_sentences AS text_nb_sentences, x.text AS text
FROM corpus JOIN cells t ON t.sourceid = rowid AND t.columnid = 1 JOIN cells x ON x.sourceid = rowid AND x.columnid = 2""")
def textualize(spark, sf):
    sources = corpus(spark, sf).select("rowid", "url", "link_origin_rowid", "time")
    return views.textualize(sources, some_cells(spark, sf), TEXT_COLUMNS, 1)


@query(f"WITH {SQL_CORPUS} SELECT rowid, url, title, text FROM corpus")
def project_columns(spark, sf):
    c = corpus(spark, sf)
    return Visible.of(c).only("rowid", "url", "title", "text").apply(c)


@query(f"WITH {SQL_CORPUS} SELECT link_origin_rowid, time, text, n_chars FROM corpus")
def invert_columns(spark, sf):
    c = corpus(spark, sf)
    chosen = Visible.of(c).only("rowid", "url", "title", "lang", "site", "text").hide("text").invert()
    return chosen.apply(c)


CONDITIONS = [
    Condition("text", "contains", "THE"), Condition("text", "whole word", "and"), Condition("n_chars", ">=", 300),
    Condition("n_chars", "!=", 1000), Condition("lang", "equals", "en"), Condition("time", "after", CUT),
]
SQL_CONDITIONS = """text ILIKE '%THE%' AND text ILIKE '% and %' AND n_chars >= 300 AND n_chars <> 1000 AND lang = 'en'
  AND time >= TIMESTAMP '2024-01-01 05:00:00'"""


@query(f"WITH {SQL_CORPUS} SELECT rowid, url FROM corpus WHERE {SQL_CONDITIONS}")
def filter_rows(spark, sf):
    return views.filter_rows(corpus(spark, sf), CONDITIONS).select("rowid", "url")


@query("""SELECT l.doc_id, d.lang FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1 AND toxic <= 0 AND n_chars <= 2000""")
def filter_numbers(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return views.filter_rows(
        joined, [Condition("quality", "=", 1), Condition("toxic", "<=", 0), Condition("n_chars", "<=", 2000)]
    ).select("doc_id", "lang")


@query("SELECT event_id, event_type FROM events WHERE ts <= TIMESTAMP '2024-01-05 12:00:00' AND ts >= TIMESTAMP '2024-01-02 00:00:00'")
def filter_time(spark, sf):
    return views.filter_rows(
        table(spark, sf, "events"),
        [Condition("ts", "before", datetime.datetime(2024, 1, 5, 12)), Condition("ts", "after", datetime.datetime(2024, 1, 2))],
    ).select("event_id", "event_type")


@query(f"WITH {SQL_CORPUS} SELECT count(*) AS n_rows FROM corpus WHERE {SQL_CONDITIONS}")
def count_filtered(spark, sf):
    return views.count_filtered(corpus(spark, sf), CONDITIONS)


@query(f"WITH {SQL_CORPUS} SELECT title, text, lang, site FROM corpus")
def text_columns_of(spark, sf):
    # n_chars is a number by its name's last word; url is asked to be left out
    c = corpus(spark, sf).withColumnRenamed("n_chars", "doc_nb_characters")
    return c.select(*[x for x in views.text_columns_of(c, without=("url",)) if x != "time"])


GROUPS = r"www\.(SRC[01]?\d)\."
SQL_GROUPS = f"""{SQL_CORPUS}, grouped AS (
  SELECT lower(CASE WHEN regexp_matches(url, '(?i){GROUPS}') THEN regexp_extract(url, '(?i){GROUPS}', 1) ELSE '_other_' END) AS group_key, rowid FROM corpus)"""


def grouped(spark, sf):
    return views.group_by_capture(corpus(spark, sf), "rowid", "url", GROUPS, True)


@query(f"WITH {SQL_GROUPS} SELECT * FROM grouped")
def group_by_capture(spark, sf):
    return grouped(spark, sf)


@query(f"WITH {SQL_GROUPS} SELECT group_key, count(*) AS n_rows FROM grouped GROUP BY group_key")
def group_sizes(spark, sf):
    return views.group_sizes(grouped(spark, sf))


@query(f"WITH {SQL_GROUPS} SELECT rowid, title FROM corpus WHERE rowid IN (SELECT rowid FROM grouped WHERE group_key IN ('src3', '_other_'))")
def rows_of_groups(spark, sf):
    return views.rows_of_groups(corpus(spark, sf), "rowid", grouped(spark, sf), ["src3", "_other_"]).select("rowid", "title")


# ------------------------------------------------------------------ duplicates


def sql_duplicates(order: str) -> str:
    return f"""WITH {SQL_CORPUS} SELECT rowid FROM (
  SELECT rowid, row_number() OVER (PARTITION BY title, text ORDER BY {order}) AS n FROM corpus WHERE title IS NOT NULL AND text IS NOT NULL) WHERE n > 1"""


def _duplicates(spark, sf, mode):
    return views.select_duplicates(corpus(spark, sf), "rowid", ["title", "text"], mode)


@query(sql_duplicates("rowid"))
def select_duplicates(spark, sf):
    return _duplicates(spark, sf, views.KEEP_FIRST)


@query(sql_duplicates("rowid DESC"))
def select_duplicates_last(spark, sf):
    return _duplicates(spark, sf, views.KEEP_LAST)


@query(sql_duplicates("length(url), rowid"))
def select_duplicates_shortest(spark, sf):
    return _duplicates(spark, sf, views.KEEP_SHORTEST)


@query(sql_duplicates("length(url) DESC, rowid DESC"))
def select_duplicates_longest(spark, sf):
    return _duplicates(spark, sf, views.KEEP_LONGEST)


@query(f"""WITH {SQL_CORPUS} SELECT count(*) AS duplicate_groups, coalesce(sum(n - 1), 0)::BIGINT AS removable_rows
FROM (SELECT count(*) AS n FROM corpus GROUP BY title, text HAVING count(*) > 1)""")
def duplicate_summary(spark, sf):
    return views.duplicate_summary(corpus(spark, sf), ["title", "text"])


# ------------------------------------------------------------------ reductions


@query(f"WITH {SQL_CORPUS} SELECT rowid, lang FROM corpus WHERE {SQL_CONDITIONS}")
def keep_rows(spark, sf):
    return views.keep_rows(corpus(spark, sf), views.all_of(CONDITIONS)).select("rowid", "lang")


@query(f"WITH {SQL_CORPUS} SELECT rowid, lang FROM corpus WHERE NOT ({SQL_CONDITIONS})")
def remove_rows(spark, sf):
    return views.remove_rows(corpus(spark, sf), views.all_of(CONDITIONS)).select("rowid", "lang")


@query(f"WITH {SQL_CORPUS} SELECT rowid, lang FROM corpus WHERE rowid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def remove_ids(spark, sf):
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("rowid"))
    return views.remove_ids(corpus(spark, sf), "rowid", toxic).select("rowid", "lang")


@query(f"""WITH {SQL_CORPUS}, {SQL_CELLS}, kept AS (SELECT * FROM cells WHERE sourceid NOT IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT 'cells' AS what, count(*) AS n, sum(nb_characters)::BIGINT AS chars FROM kept
UNION ALL SELECT 'sources', count(*), sum(n_chars)::BIGINT FROM corpus WHERE rowid IN (SELECT sourceid FROM kept)""")
def reduce_corpus(spark, sf):
    bad = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("rowid"))
    sources, texts = views.reduce_corpus(corpus(spark, sf), cells(spark, sf), bad, 1)
    a = texts.agg(F.lit("cells").alias("what"), F.count("*").alias("n"), F.sum("nb_characters").alias("chars"))
    b = sources.agg(F.lit("sources").alias("what"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return a.unionByName(b)


@query(f"WITH {SQL_CORPUS}, {SQL_CELLS} SELECT sourceid, columnid, nb_characters FROM cells WHERE columnid <> 1")
def drop_columns(spark, sf):
    names, _ = definitions(spark)
    _, texts, _ = views.drop_columns(corpus(spark, sf), cells(spark, sf), names, ["title", "time"])
    return texts.select("sourceid", "columnid", "nb_characters")


@query(f"WITH {SQL_CORPUS}, {SQL_CELLS} SELECT sourceid, 2 AS textualid, columnid FROM cells WHERE columnid = 2")
def drop_view(spark, sf):
    names, _ = definitions(spark)
    second = cells(spark, sf).where("columnid = 2").withColumn("textualid", F.lit(2))
    texts, _ = views.drop_view(cells(spark, sf).unionByName(second), names, 1)
    return texts.select("sourceid", "textualid", "columnid")


def entered(spark, sf):
    """Quality labels as texts entered into the title column, the second entry being the valid one."""
    labels = table(spark, sf, "labels")
    once = labels.select(
        F.col("doc_id").alias("sourceid"), F.lit(1).alias("textualid"), (F.col("quality") * 2 + 1).alias("columnid"),
        F.inline(F.array(
            F.struct(F.lit(1).alias("seq"), F.lit("draft").alias("text")),
            F.struct(F.lit(2).alias("seq"), F.concat(F.lit("label "), F.col("toxic").cast("string")).alias("text")),
        )),
    )
    return views.with_cell_stats(once)


SQL_ENTERED = """entered AS (SELECT doc_id AS sourceid, 1 AS textualid, quality * 2 + 1 AS columnid, 'label ' || toxic AS text FROM labels)"""


@query(f"""WITH {SQL_CORPUS}, {SQL_CELLS}, {SQL_ENTERED}
SELECT sourceid, columnid, text FROM cells WHERE (sourceid, columnid) NOT IN (SELECT (sourceid, columnid) FROM entered)
UNION ALL SELECT sourceid, columnid, text FROM entered""")
def upsert_cells(spark, sf):
    return views.upsert_cells(cells(spark, sf), entered(spark, sf)).select("sourceid", "columnid", "text")


@query(f"""WITH {SQL_CORPUS}, {SQL_CELLS}, {SQL_ENTERED}
SELECT sourceid, columnid, text FROM cells
UNION ALL SELECT sourceid, columnid, text FROM entered WHERE (sourceid, columnid) NOT IN (SELECT (sourceid, columnid) FROM cells)""")
def insert_cells(spark, sf):
    return views.upsert_cells(cells(spark, sf), entered(spark, sf), overwrite=False).select("sourceid", "columnid", "text")


@query(f"WITH {SQL_CORPUS} SELECT rowid, url, NULL::BIGINT AS nb_sentences, n_chars AS nb_characters FROM corpus")
def repair_schema(spark, sf):
    old = corpus(spark, sf).select("url", "rowid", F.col("n_chars").alias("nb_characters"))
    current = corpus(spark, sf).select(
        "rowid", "url", F.lit(0).cast("long").alias("nb_sentences"), F.lit(0).cast("long").alias("nb_characters")
    )
    return views.repair_schema(old, current)


@query(f"WITH {SQL_CORPUS}, {SQL_CELLS} SELECT DISTINCT columnid FROM cells")
def distinct_columns(spark, sf):
    return views.distinct_columns(cells(spark, sf))


@query(f"WITH {SQL_CORPUS}, {SQL_CELLS} SELECT DISTINCT columnid, CASE columnid WHEN 1 THEN 'title' ELSE 'text' END AS name FROM cells")
def view_columns(spark, sf):
    names, registry = definitions(spark)
    return views.view_columns(cells(spark, sf), registry, names, 1)


@query(f"""WITH {SQL_CORPUS} SELECT count(*) AS nb_pages, sum(length(text))::BIGINT AS nb_characters, sum({sql_breaks('text')})::BIGINT AS nb_sentences,
  (SELECT count(*) FROM pages) AS nb_links_todo, (SELECT count(*) FROM labels) AS nb_links_done FROM corpus""")
def recompute_stats(spark, sf):
    view = views.textualize(corpus(spark, sf).select("rowid", "url"), cells(spark, sf), TEXT_COLUMNS, 1)
    return views.recompute_stats(view, "text", table(spark, sf, "pages"), table(spark, sf, "labels"))


@query(f"WITH {SQL_CORPUS} SELECT rowid, url, title FROM corpus WHERE rowid > 17 ORDER BY rowid LIMIT 1")
def next_source(spark, sf):
    return views.next_source(corpus(spark, sf).select("rowid", "url", "title"), "rowid", 17)


@query(f"WITH {SQL_CORPUS} SELECT rowid, url, title FROM corpus WHERE rowid < 17 ORDER BY rowid DESC LIMIT 1")
def prev_source(spark, sf):
    return views.prev_source(corpus(spark, sf).select("rowid", "url", "title"), "rowid", 17)


@query("SELECT page_id, url FROM pages WHERE url = (SELECT max(url) FROM pages)")
def source_by_url(spark, sf):
    pages = table(spark, sf, "pages")
    url = pages.agg(F.max("url")).first()[0]
    return views.source_by_url(pages, url).select("page_id", "url")


@query("SELECT page_id, url FROM pages WHERE page_id = 42")
def source_by_id(spark, sf):
    return views.source_by_id(table(spark, sf, "pages"), "page_id", 42).select("page_id", "url")


@query("""SELECT string_agg(text, '' ORDER BY doc_id) AS sample FROM (
  SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM documents) WHERE before < 5000""")
def sample_prefix(spark, sf):
    return views.sample_prefix(table(spark, sf, "documents"), "doc_id", "text", 5000)


@query(f"WITH {SQL_CORPUS} SELECT rowid, title, lang FROM corpus WHERE {SQL_CONDITIONS}")
def saved_selection(spark, sf):
    chosen = SavedSelection("english_pages", ("rowid", "title", "lang"), tuple(CONDITIONS))
    chosen.register(corpus(spark, sf))
    return spark.table("english_pages")


@query(f"""WITH {SQL_CORPUS}, p AS (SELECT *, epoch(time)::BIGINT AS t FROM corpus)
SELECT rowid, url, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS time,
  CASE WHEN length(text) > 200 THEN left(text, 100) || chr(10) || ' ... ' || chr(10) || right(text, 100) ELSE text END AS text FROM p""")
def preview_cell(spark, sf):
    c = corpus(spark, sf).select("rowid", "url", F.unix_timestamp("time").alias("time"), "text")
    return views.preview_rows(c)


@query("SELECT page_id, replace(replace(html, '<', '&lt;'), '>', '&gt;') AS html FROM pages")
def escape_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", escape_column(F.col("html")).alias("html"))
