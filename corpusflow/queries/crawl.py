"""Crawl decisions over the link tree of the documents, the pages and the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import crawl, extract
from ..plans.checkpoints import scratch_path
from ..sources import readers
from .base import SQL, SQL_CORPUS, corpus, query, sql_breaks, sql_line_breaks, table
from .pages import SQL_TEXTS

ALLOW, DENY = r"/(en|de)/", r"src1\d"

# Every document is linked from document d div 4, and links on to document 7d + 3.
SQL_GRAPH = SQL_CORPUS + """,
stored AS (SELECT rowid, url FROM corpus WHERE n_chars > 300 OR rowid = 0),
links AS (SELECT link_origin_rowid AS rowid, url AS link FROM corpus WHERE rowid > 0
          UNION ALL SELECT a.rowid, b.url FROM corpus a JOIN corpus b ON b.rowid = a.rowid * 7 + 3)"""


def graph(spark, sf):
    c = corpus(spark, sf)
    stored = c.where("n_chars > 300 OR rowid = 0").select("rowid", "url")
    tree = c.where("rowid > 0").select(F.col("link_origin_rowid").alias("rowid"), F.col("url").alias("link"))
    across = c.select(F.col("rowid").alias("a"), (F.col("rowid") * 7 + 3).alias("rowid")).join(
        c.select("rowid", F.col("url").alias("link")), "rowid"
    ).select(F.col("a").alias("rowid"), "link")
    return stored, tree.unionByName(across)


@query(f"""WITH RECURSIVE {SQL_GRAPH},
edges AS (SELECT s.url, l.rowid, l.link FROM stored s JOIN links l USING (rowid)),
reach(url, level) USING KEY (url) AS (
  SELECT url, 0 FROM corpus WHERE rowid = 0
  UNION SELECT e.link, min(r.level) + 1 FROM reach r JOIN edges e ON e.url = r.url
  WHERE NOT EXISTS (SELECT 1 FROM recurring.reach k WHERE k.url = e.link) GROUP BY e.link),
first AS (SELECT url, min(level)::INTEGER AS level FROM reach GROUP BY url)
SELECT f.url, f.level, coalesce(min(e.rowid), 0)::BIGINT AS origin, f.url IN (SELECT url FROM stored) AS done
FROM first f LEFT JOIN (SELECT e.link, e.rowid, p.level FROM edges e JOIN first p ON p.url = e.url) e
  ON e.link = f.url AND e.level = f.level - 1
GROUP BY f.url, f.level""")
def crawl_expand(spark, sf):
    stored, links = graph(spark, sf)
    seeds = stored.where("rowid = 0").select("url")
    return crawl.crawl_expand(seeds, stored, links)


TURNS = "SELECT conv_id || '/' || turn AS url, turn AS level, conv_id AS batch, turn AS pos FROM conversations"


def turns(spark, sf):
    return table(spark, sf, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("url"), F.col("turn").alias("level"),
        F.col("conv_id").alias("batch"), F.col("turn").alias("pos"),
    )


@query(f"WITH t AS ({TURNS}) SELECT *, row_number() OVER (ORDER BY level, batch, pos, url) AS visit_no FROM t")
def visit_order_breadth(spark, sf):
    return crawl.visit_order(turns(spark, sf))


@query(f"WITH t AS ({TURNS}) SELECT *, row_number() OVER (ORDER BY level DESC, batch DESC, pos, url) AS visit_no FROM t")
def visit_order_depth(spark, sf):
    return crawl.visit_order(turns(spark, sf), depth_first=True)


# Each turn links to the two turns after twice its number; a conversation is found from the first turn of conversation div 3.
SQL_TALK = """talk AS (SELECT conv_id * 1000 + turn AS rowid, CASE WHEN turn > 0 THEN conv_id * 1000 + (turn - 1) // 2
  WHEN conv_id > 0 THEN conv_id // 3 * 1000 END AS parent, (conv_id * 7 + turn * 5) % 11 AS pos FROM conversations)"""


def talk(spark, sf):
    turn, conv = F.col("turn"), F.col("conv_id")
    return table(spark, sf, "conversations").select(
        (conv * 1000 + turn).alias("rowid"),
        F.when(turn > 0, conv * 1000 + F.floor((turn - 1) / 2)).when(conv > 0, F.floor(conv / 3) * 1000).alias("parent"),
        ((conv * 7 + turn * 5) % 11).alias("pos"),
    )


@query(f"""WITH RECURSIVE {SQL_TALK}, stored AS (
  SELECT rowid, pos, CASE WHEN parent IN (SELECT rowid FROM talk) THEN parent END AS parent FROM talk),
way AS (SELECT rowid, [pos, rowid] AS way FROM stored WHERE parent IS NULL
  UNION ALL SELECT s.rowid, way || [s.pos, s.rowid] FROM stored s JOIN way w ON s.parent = w.rowid)
SELECT rowid, parent, pos, row_number() OVER (ORDER BY way) AS visit_no FROM talk JOIN way USING (rowid)""")
def depth_first_order(spark, sf):
    return crawl.depth_first_order(talk(spark, sf))


@query(f"WITH t AS ({TURNS}) SELECT url, level, level >= 2 AS keep_page, level + 1 <= 4 AS take_links FROM t")
def level_filter(spark, sf):
    return crawl.level_filter(turns(spark, sf).select("url", "level"), 2, 4)


@query(f"WITH {SQL_CORPUS} SELECT rowid, url FROM corpus WHERE regexp_matches(url, '{ALLOW}') AND NOT regexp_matches(url, '{DENY}')")
def url_allow_deny(spark, sf):
    return crawl.url_allow_deny(corpus(spark, sf).select("rowid", "url"), "url", ALLOW, DENY)


@query(f"""WITH {SQL_CORPUS} SELECT rowid, list_bool_and([regexp_matches(u, '{ALLOW}') AND NOT regexp_matches(u, '{DENY}')
  FOR u IN [url, replace(url, '/en/', '/fr/'), url || '?from=1']]) AS ok FROM corpus""")
def redirect_chain_ok(spark, sf):
    chain = F.array("url", F.replace("url", F.lit("/en/"), F.lit("/fr/")), F.concat("url", F.lit("?from=1")))
    return corpus(spark, sf).select("rowid", crawl.redirect_chain_ok(chain, ALLOW, DENY).alias("ok"))


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)token = \"[0-9a-f]+')")
def content_filter(spark, sf):
    return crawl.content_filter(table(spark, sf, "documents"), "text", 'TOKEN = "[0-9A-F]+', True).select("doc_id", "lang")


def with_stats(spark, sf):
    from ..functions.cells import sentence_breaks

    return corpus(spark, sf).select(
        "rowid", "url", "time", "link_origin_rowid",
        F.when(F.col("n_chars") < 100, 0).otherwise(F.col("n_chars")).alias("nb_characters"),
        sentence_breaks(F.col("text")).cast("long").alias("nb_sentences"),
    )


SQL_STATS = f"""{SQL_CORPUS}, stats AS (SELECT rowid, url, time, link_origin_rowid, CASE WHEN n_chars < 100 THEN 0 ELSE n_chars END AS nb_characters,
  {sql_breaks('text')} AS nb_sentences, regexp_extract(url, '//(.*)\\.example', 1) AS sub FROM corpus)"""
EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(f"""WITH {SQL_STATS}, subs AS (SELECT sub FROM stats GROUP BY sub ORDER BY min(rowid) LIMIT 7),
run AS (SELECT rowid, url, coalesce(sum((nb_characters > 0)::INTEGER) OVER (ORDER BY rowid {EARLIER}), 0) AS p,
  coalesce(sum(CASE WHEN nb_characters > 0 THEN nb_sentences ELSE 0 END) OVER (ORDER BY rowid {EARLIER}), 0) AS s
  FROM stats WHERE sub IN (SELECT sub FROM subs))
SELECT rowid, url FROM run WHERE p < 250 AND s < 6000""")
def crawl_caps(spark, sf):
    pages = with_stats(spark, sf)
    return crawl.crawl_caps(pages, "rowid", "url", 250, 6000, 7).select("rowid", "url")


@query("""WITH h AS (SELECT doc_id AS rowid, 'www.' || source || '.example.org' AS host FROM documents)
SELECT rowid, host, row_number() OVER (PARTITION BY host ORDER BY rowid)::INTEGER AS host_rank FROM h QUALIFY host_rank <= 5""")
def per_host_cap(spark, sf):
    return crawl.per_host_cap(corpus(spark, sf).select("rowid", "url"), "rowid", "url", 5).drop("url")


@query("""WITH h AS (SELECT doc_id AS rowid, 'www.' || source || '.example.org' AS host FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rowid) AS host_rank FROM h)
SELECT rowid, host, host_rank, (host_rank - 1) * 2.5 AS start_second FROM r""")
def polite_schedule(spark, sf):
    return crawl.polite_schedule(corpus(spark, sf), "rowid", "url", 2.5)


@query("""WITH g AS (SELECT user_id::VARCHAR AS host, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT host, count(*) AS n_accesses, count(*) FILTER (gap < 3600000000) AS too_soon FROM g GROUP BY host""")
def politeness_audit(spark, sf):
    log = table(spark, sf, "events").withColumn("host", F.col("user_id").cast("string"))
    return crawl.politeness_audit(log, "host", "ts", "event_id", 3600)


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /fr/1\nDisallow: /fr/ # french\nDisallow: /de/\n"


@query("""SELECT doc_id AS rowid FROM documents
WHERE source NOT LIKE 'src1%' OR (lang = 'fr' AND doc_id::VARCHAR LIKE '1%') OR lang NOT IN ('fr', 'de')""")
def robots_filter(spark, sf):
    c = corpus(spark, sf).select("rowid", "url", "site")
    robots = c.where(F.col("site").like("src1%")).select(
        F.concat(F.lit("www."), "site", F.lit(".example.org")).alias("host"), F.lit(ROBOTS).alias("content")
    ).distinct()
    return crawl.robots_filter(c, "url", crawl.robots_rules(robots)).select("rowid")


SQL_LOG = "log AS (SELECT 'http://u' || user_id || '.net/' AS url, event_type, value, ts, event_id FROM events)"


def log(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("http://u"), F.col("user_id").cast("string"), F.lit(".net/")).alias("url"),
        "event_type", "value", "ts", "event_id",
    )


@query(f"""WITH {SQL_LOG} SELECT url, 1 AS level, min(event_id) AS origin, count(*) AS n_failed FROM log
WHERE event_type = 'error' AND url NOT IN (SELECT url FROM log WHERE value > 300) GROUP BY url HAVING count(*) <= 20""")
def retry_queue(spark, sf):
    events = log(spark, sf)
    failures = events.where("event_type = 'error'").select("url", F.lit(1).alias("level"), F.col("event_id").alias("origin"))
    return crawl.retry_queue(failures, events.where("value > 300"), 20)


@query(f"WITH {SQL_LOG} SELECT url, min(event_id) AS event_id FROM log GROUP BY url")
def dedup_keep_order(spark, sf):
    return crawl.dedup_keep_order(log(spark, sf), "url", "event_id")


@query(f"""WITH {SQL_GRAPH} SELECT (SELECT count(*) FROM links WHERE link NOT IN (SELECT url FROM stored)) AS nb_links_todo,
  (SELECT count(*) FROM stored) AS nb_links_done""")
def link_status(spark, sf):
    stored, links = graph(spark, sf)
    todo = links.select(F.col("link").alias("url")).join(stored.select("url"), "url", "left_anti")
    return crawl.link_status(todo, stored)


@query(f"""WITH {SQL_GRAPH} SELECT url, 1 AS level, min(l.rowid)::BIGINT AS origin FROM links l JOIN corpus ON url = link
WHERE url NOT IN (SELECT url FROM stored) GROUP BY url""")
def resume_frontier(spark, sf):
    stored, links = graph(spark, sf)
    todo = links.groupBy(F.col("link").alias("url")).agg(F.min("rowid").alias("origin"))
    return readers.resume_frontier(todo.select("url", F.lit(1).alias("level"), "origin"), stored)


@query(f"""WITH {SQL_STATS}, old AS (SELECT s.url, quality * 3 AS os, quality * 50 AS oc FROM stats s JOIN labels ON doc_id = rowid)
SELECT count(*) FILTER (oc IS NULL) AS new_pages, count(*) FILTER (oc IS NOT NULL) AS updated_pages,
  sum(nb_sentences - coalesce(os, 0))::BIGINT AS sentences_delta, sum(nb_characters - coalesce(oc, 0))::BIGINT AS characters_delta,
  count(*) FILTER (nb_characters > 0) AS good_pages FROM stats LEFT JOIN old USING (url)""")
def crawl_stats_delta(spark, sf):
    new = with_stats(spark, sf)
    old = new.join(table(spark, sf, "labels"), F.col("rowid") == F.col("doc_id")).select(
        "url", (F.col("quality") * 3).alias("nb_sentences"), (F.col("quality") * 50).alias("nb_characters")
    )
    return crawl.crawl_stats_delta(old, new)


@query(f"""WITH {SQL_STATS}, t AS (SELECT greatest(1, epoch(max(time))::BIGINT - epoch(min(time))::BIGINT) AS seconds, count(*) AS pages,
  count(*) FILTER (nb_characters > 0) AS good_pages, sum(nb_sentences)::BIGINT AS sentences, sum(nb_characters)::BIGINT AS characters FROM stats),
u AS (SELECT *, round_even(seconds / 60.0, 0)::BIGINT AS m, round_even(round_even(seconds / 60.0, 0) / 60.0, 0)::BIGINT AS h,
  round_even(round_even(round_even(seconds / 60.0, 0) / 60.0, 0) / 24.0, 0)::BIGINT AS d FROM t),
w AS (SELECT *, [round_even(d / 365.0, 0)::BIGINT, d % 365, h % 24, m % 60, seconds % 60] AS parts FROM u)
SELECT seconds, pages, good_pages, sentences, characters,
  round_even(sentences / seconds * 60, 0)::BIGINT AS sentences_min, round_even(characters / seconds * 60, 0)::BIGINT AS characters_min,
  round_even(pages / seconds * 60, 2) AS pages_min, round_even(good_pages / seconds * 60, 2) AS good_pages_min,
  array_to_string(list_transform(list_zip(parts, ['year', 'day', 'hour', 'minute', 'second']),
    lambda p: CASE WHEN p[1] = 0 THEN '' ELSE p[1] || ' ' || p[2] || CASE WHEN p[1] > 1 THEN 's ' ELSE ' ' END END), '') AS elapsed FROM w""")
def throughput(spark, sf):
    return crawl.throughput(with_stats(spark, sf), "time", "nb_sentences", "nb_characters")


@query(f"""WITH {SQL_CORPUS} SELECT c.rowid, c.url, c.link_origin_rowid, p.url AS origin_url
FROM corpus c LEFT JOIN corpus p ON p.rowid = c.link_origin_rowid""")
def link_lineage(spark, sf):
    return crawl.link_lineage(corpus(spark, sf))


@query(f"""WITH RECURSIVE {SQL_CORPUS},
way AS (SELECT rowid, url, 0::BIGINT AS depth, rowid AS seed, [url] AS path FROM corpus
    WHERE link_origin_rowid = rowid OR link_origin_rowid NOT IN (SELECT rowid FROM corpus)
  UNION ALL SELECT c.rowid, c.url, depth + 1, seed, path || [c.url]
    FROM corpus c JOIN way w ON c.link_origin_rowid = w.rowid AND c.rowid <> w.rowid)
SELECT rowid, url, depth, seed, path FROM way""")
def link_path(spark, sf):
    return crawl.link_path(corpus(spark, sf))


# ------------------------------------------------------------------ ingest


def page_rows(spark, sf):
    """Stored pages as sources; a second, newer fetch of every other host follows."""
    return table(spark, sf, "pages").select(
        "url", F.length("html").alias("nb_characters"), F.col("page_id").alias("time"), F.lit("old").alias("state")
    )


def newer_rows(spark, sf):
    fetched = page_rows(spark, sf).where(F.col("url").contains(".com/")).withColumn("state", F.lit("new"))
    twice = fetched.unionByName(fetched.withColumn("time", F.col("time") + 100000).withColumn("state", F.lit("newest")))
    other = corpus(spark, sf).select("url", F.col("n_chars").alias("nb_characters"), F.col("rowid").alias("time"), F.lit("new").alias("state"))
    return twice.unionByName(other)


SQL_INGEST = f"""{SQL_CORPUS}, old AS (SELECT url, length(html) AS nb_characters, page_id AS time, 'old' AS state FROM pages),
new AS (SELECT url, nb_characters, time, 'new' AS state FROM old WHERE contains(url, '.com/')
  UNION ALL SELECT url, nb_characters, time + 100000, 'newest' FROM old WHERE contains(url, '.com/')
  UNION ALL SELECT url, n_chars, rowid, 'new' FROM corpus)"""


@query(f"""WITH {SQL_INGEST} SELECT url, nb_characters::BIGINT AS nb_characters, time, state FROM old WHERE url NOT IN (SELECT url FROM new)
UNION ALL SELECT url, nb_characters, time, state FROM new QUALIFY row_number() OVER (PARTITION BY url ORDER BY time DESC) = 1""")
def ingest_pages_overwrite(spark, sf):
    return readers.ingest_pages(page_rows(spark, sf), newer_rows(spark, sf), "overwrite")


@query(SQL["ingest_pages_overwrite"])
def ingest_pages_stored(spark, sf):
    """The same from a table that is bucketed by URL."""
    old = readers.store_by_url(page_rows(spark, sf), f"pages_{uuid.uuid4().hex}", scratch_path(spark, "by_url"))
    return readers.ingest_pages(old, newer_rows(spark, sf), "overwrite")


@query(f"WITH {SQL_INGEST} SELECT * FROM old UNION ALL SELECT * FROM new")
def ingest_pages_append(spark, sf):
    return readers.ingest_pages(page_rows(spark, sf), newer_rows(spark, sf), "append")


@query(f"WITH {SQL_INGEST} SELECT * FROM new")
def ingest_pages_erase(spark, sf):
    return readers.ingest_pages(page_rows(spark, sf), newer_rows(spark, sf), "erase")


@query(f"""WITH {SQL_INGEST} SELECT DISTINCT url, 3 AS old_sentences, o.nb_characters AS old_characters
FROM new LEFT JOIN old o USING (url) WHERE o.url IS NOT NULL UNION ALL SELECT DISTINCT url, NULL, NULL FROM new WHERE url NOT IN (SELECT url FROM old)""")
def replaced_counts(spark, sf):
    return readers.replaced_counts(page_rows(spark, sf).withColumn("nb_sentences", F.lit(3)), newer_rows(spark, sf))


@query(f"""WITH {SQL_TEXTS}
SELECT page_id AS sourceid, 1 AS textualid, 1 AS columnid, title AS text, greatest(1, {sql_breaks('title')})::BIGINT AS nb_sentences, length(title) AS nb_characters FROM texts
UNION ALL SELECT page_id, 1, 2, text, {sql_line_breaks('text')}, length(text) FROM texts""")
def page_cells(spark, sf):
    pages = extract.page_texts(table(spark, sf, "pages"))
    return readers.page_cells(pages, "page_id")
