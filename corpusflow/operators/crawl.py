"""Decisions of a crawl over stored pages and link tables.

Nothing is fetched here. A link is ``(url, level, origin)``: its distance from a
seed and the row that linked to it (0 for a seed, -1 for a search result or import).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.checkpoints import cut
from ..plans.ordered import running_rank, running_total
from ..functions.patterns import spark_regex
from ..plans.skew import HOT_SHARE, lookup_join

# ------------------------------------------------------------------ expansion


def crawl_expand(seeds: DataFrame, pages: DataFrame, links: DataFrame, level_to: int = -1) -> DataFrame:
    """Breadth-first closure: every reachable URL with its level, origin and state.

    ``seeds(url)``, ``pages(rowid, url)``, ``links(rowid, link)``. A link gets the
    smallest level at which it is found and the smallest origin of that level; it is
    done if its page is stored, else it stays to do. The crawl goes on until no new link is
    found, or to ``level_to`` if that is given. One shuffle join and one aggregation
    per level; each level is checkpointed, so plans stay short and lost executors
    cost one level. Links of pages with very many of them stay where they are: of such pages
    there are so few that those visited are broadcast.
    """
    per_page = links.groupBy("rowid").agg(F.count("*").alias("n"))
    total = links.select(F.count("*")).scalar()
    hot = cut(per_page.where(F.col("n") * HOT_SHARE > total).select("rowid"))  # at most HOT_SHARE rows
    few = cut(links.select("rowid", "link").join(F.broadcast(hot), "rowid"))
    rest = cut(links.select("rowid", "link").join(F.broadcast(hot), "rowid", "left_anti"))
    level = 0
    frontier = cut(
        seeds.select("url").distinct().select("url", F.lit(0).alias("level"), F.lit(0).cast("long").alias("origin"))
    )
    found = frontier
    while level_to < 0 or level + 1 <= level_to:
        visited = cut(frontier.join(pages.select("rowid", "url"), "url").select("rowid"))
        followed = rest.join(visited, "rowid").unionByName(
            few.join(F.broadcast(visited.join(F.broadcast(hot), "rowid", "left_semi")), "rowid")
        )
        frontier = cut(
            followed.groupBy(F.col("link").alias("url"))
            .agg(F.min("rowid").alias("origin"))
            .join(found.select("url"), "url", "left_anti")
            .select("url", F.lit(level + 1).alias("level"), "origin")
        )
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        level += 1
    stored = pages.select("url").withColumn("_stored", F.lit(True))
    return found.join(stored, "url", "left").select(
        "url", "level", "origin", F.coalesce("_stored", F.lit(False)).alias("done")
    )


def visit_order(frontier: DataFrame, depth_first: bool = False) -> DataFrame:
    """Position of each link ``(url, level, batch, pos)`` in the queue.

    Breadth-first appends each batch of new links; depth-first puts it in front.
    """
    order = (
        [F.desc("level"), F.desc("batch"), F.asc("pos")] if depth_first else [F.asc("level"), F.asc("batch"), F.asc("pos")]
    )
    return running_rank(frontier, [], [*order, F.asc("url")], "visit_no")


def depth_first_order(tree: DataFrame, order: str = "pos") -> DataFrame:
    """Position of each page ``(rowid, parent, order)`` when a page's links are visited before all that was queued earlier.

    This is the preorder of the forest; pages without a stored parent are its roots, siblings stand by ``order``, then by rowid.
    No task holds a tree: a tour enters and leaves each page, and how much of it lies ahead
    is found by pointer doubling, in as many joins on unique keys as the number of pages has binary digits. Pages that
    only a cycle leads to have no position.
    """
    pages = tree.select("rowid", "parent", F.col(order).alias("_pos"))
    known = pages.select(F.col("rowid").alias("parent"), F.explode(F.array(F.lit(True))).alias("_known"))
    children = pages.groupBy("parent").agg(F.count("*").alias("_n")).join(known, "parent")
    # roots are the children of no page
    placed = lookup_join(pages, children, "parent", "_known", F.col("_n"), F.col("rowid"), "left").select(
        "rowid", "_pos", F.when(F.col("_known"), F.col("parent")).alias("parent")
    )
    ranked = cut(
        running_rank(placed.withColumn("_root", F.col("parent").isNull()).withColumn("parent", F.coalesce("parent", F.lit(0))),
                     ["_root", "parent"], ["_pos", "rowid"], "nth")
    )
    heads = ranked.where("nth = 1 AND NOT _root").select(F.col("parent").alias("rowid"), F.col("rowid").alias("child"))
    siblings = ranked.select("_root", "parent", (F.col("nth") - 1).alias("nth"), F.col("rowid").alias("sibling"))
    step = lambda page, leaves: F.struct(page.alias("page"), F.lit(leaves).alias("leaves"))
    page = F.col("rowid")
    enter = ranked.join(heads, "rowid", "left").select(
        step(page, False).alias("at"),
        F.when(F.col("child").isNotNull(), step(F.col("child"), False)).otherwise(step(page, True)).alias("next"),
        F.lit(1).cast("long").alias("ahead"),
    )
    leave = ranked.join(siblings, ["_root", "parent", "nth"], "left").select(
        step(page, True).alias("at"),
        F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), False)).when(~F.col("_root"), step(F.col("parent"), True)).alias("next"),
        F.lit(0).cast("long").alias("ahead"),
    )
    tour = cut(enter.unionByName(leave))
    for _ in range(tour.count().bit_length()):
        if tour.where("next IS NOT NULL").isEmpty():
            break
        jump = tour.select(F.col("at").alias("next"), F.col("next").alias("_next"), F.col("ahead").alias("_ahead"))
        tour = cut(tour.join(jump, "next", "left").select("at", F.col("_next").alias("next"), (F.col("ahead") + F.coalesce("_ahead", F.lit(0))).alias("ahead")))
    ended = tour.where("next IS NULL AND NOT at.leaves").select(F.col("at.page").alias("rowid"), "ahead")
    numbered = ended.withColumn("_all", ended.select(F.max("ahead")).scalar())
    return tree.join(numbered, "rowid", "left").select(
        *[tree[c] for c in tree.columns], (F.col("_all") - F.col("ahead") + 1).alias("visit_no")
    )


def level_filter(pages: DataFrame, level_from: int = 0, level_to: int = -1) -> DataFrame:
    """Whether the page is kept and whether its links are taken."""
    return pages.select(
        "*",
        (F.col("level") >= level_from).alias("keep_page"),
        (F.lit(level_to < 0) | (F.col("level") + 1 <= level_to)).alias("take_links"),
    )


def url_allow_deny(df: DataFrame, url: str, allow: str | None, deny: str | None) -> DataFrame:
    return df.where(urls.allowed(F.col(url), allow, deny))


def redirect_chain_ok(chain: Column, allow: str | None, deny: str | None) -> Column:
    """Every URL on the way to the page must be allowed."""
    return F.forall(chain, lambda u: urls.allowed(u, allow, deny))


def content_filter(df: DataFrame, text: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    return df.where(F.col(text).rlike(spark_regex(pattern, ignore_case)))


# ------------------------------------------------------------------ limits


def crawl_caps(
    pages: DataFrame,
    order: str,
    url: str,
    max_pages: int = 0,
    max_sentences: int = 0,
    max_subdomains: int = 0,
) -> DataFrame:
    """Pages that a crawl in this order takes before its limits are reached; 0 is no limit.

    A page is good if it has characters. A subdomain beyond the first N is skipped;
    pages and sentences stop the crawl. ``pages`` has ``nb_characters``, ``nb_sentences``.
    """
    slim = pages.select(order, urls.subdomain(F.col(url)).alias("_sub"), "nb_characters", "nb_sentences")
    if max_subdomains:
        # the limit is the parameter, so the list of accepted subdomains is bounded by it
        accepted = (
            slim.groupBy("_sub").agg(F.min(order).alias("_seen")).orderBy("_seen").limit(max_subdomains)
        )
        slim = slim.join(accepted.select("_sub"), "_sub", "left_semi")
    good = F.col("nb_characters") > 0
    if max_pages:
        slim = running_total(slim, [], [order], F.when(good, 1).otherwise(0), "_pages").where(
            F.col("_pages") < max_pages
        )
    if max_sentences:
        slim = running_total(
            slim, [], [order], F.when(good, F.col("nb_sentences")).otherwise(0), "_sentences"
        ).where(F.col("_sentences") < max_sentences)
    return pages.join(slim.select(order), order, "left_semi")


def per_host_cap(links: DataFrame, order: str, url: str, n: int, visited: DataFrame | None = None) -> DataFrame:
    """The first ``n`` links of each host. The rank limit is applied before the shuffle too.

    ``visited(host, n_visited)`` counts what was opened before. If no link is within the limit
    then, the very first link is taken.
    """
    w = Window.partitionBy("host").orderBy(order)
    ranked = links.withColumn("host", urls.host(F.col(url))).withColumn("host_rank", F.row_number().over(w)).where(F.col("host_rank") <= n)
    if visited is None:
        return ranked
    kept = (
        ranked.join(visited.select("host", "n_visited"), "host", "left")
        .withColumn("_left", F.col("host_rank") + F.coalesce("n_visited", F.lit(0)) <= n)
    )
    good = kept.where("_left").drop("n_visited", "_left")
    first = ranked.orderBy(order).limit(1).withColumn("_good", good.select(F.count("*")).scalar()).where("_good = 0").drop("_good")
    return good.unionByName(first.select(*good.columns))


def polite_schedule(links: DataFrame, order: str, url: str, delay: float) -> DataFrame:
    """Earliest second at which each link may be opened if a host rests ``delay`` seconds."""
    slim = links.select(order, urls.host(F.col(url)).alias("host"))
    ranked = running_rank(slim, ["host"], [order], "host_rank")
    return ranked.select(order, "host", "host_rank", ((F.col("host_rank") - 1) * F.lit(delay)).alias("start_second"))


def politeness_audit(log: DataFrame, host: str, ts: str, id_col: str, delay: float) -> DataFrame:
    """Accesses of a log that came sooner after the host's last one than ``delay`` seconds.

    Only an access in the same or the previous slot of ``delay`` seconds can be too
    close, so the log is compared slot by slot; a slot of a host is one aggregation.
    """
    if delay <= 0:
        return log.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_accesses"), F.lit(0).cast("long").alias("too_soon"))
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = log.select(
        F.col(host).alias("host"), F.col(id_col).alias("id"), us.alias("us"),
        F.floor(us / F.lit(int(delay * 1_000_000))).alias("slot"),
    )
    # the last access of each slot, moved to the next one
    ends = slots.groupBy("host", (F.col("slot") + 1).alias("slot")).agg(F.max("us").alias("end"))
    # all but the first access of a slot are too close to the one before
    starts = slots.groupBy("host", "slot").agg(F.min(F.struct("us", "id")).alias("start"), F.count("*").alias("n"))
    first = starts.join(ends, ["host", "slot"], "left").select(
        "host",
        F.col("n").alias("n_accesses"),
        (F.col("n") - 1 + F.when(F.col("start.us") - F.col("end") < F.lit(int(delay * 1_000_000)), 1).otherwise(0)).alias("too_soon"),
    )
    return first.groupBy("host").agg(
        F.sum("n_accesses").alias("n_accesses"), F.sum("too_soon").cast("long").alias("too_soon")
    )


def robots_rules(robots: DataFrame, host: str = "host", content: str = "content") -> DataFrame:
    """``robots.txt`` files to rows ``(host, pos, allow, prefix)`` that hold for every agent."""
    lines = robots.select(F.col(host).alias("host"), F.posexplode(F.split(F.col(content), r"\r?\n")).alias("pos", "line"))
    plain = lines.select("host", "pos", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line"))
    keyed = plain.select(
        "host", "pos",
        F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"),
        F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"),
    )
    # agents that follow each other share the rules after them; a file is small, one host each
    w = Window.partitionBy("host").orderBy("pos")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    record = Window.partitionBy("host", "record")
    return (
        keyed.where("field <> ''")
        .withColumn("record", F.when(starts, 1).otherwise(0))
        .withColumn("record", F.sum("record").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("every", F.coalesce(F.bool_or(is_agent & (F.col("value") == "*")).over(record), F.lit(False)))
        .where(F.col("every") & F.col("field").isin("allow", "disallow"))
        # an empty disallow allows everything
        .select("host", "pos", ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("prefix"))
    )


def robots_filter(links: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """Links that the first matching rule of their host allows; no rule means allowed.

    The rules of a host travel as one array (a robots file is bounded), so links are
    joined once and never multiplied by the number of rules.
    """
    per_host = rules.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("pos", "allow", "prefix"))).alias("_rules")
    )
    hosted = links.withColumn("host", urls.host(F.col(url)))
    counted = per_host.join(hosted.groupBy("host").agg(F.count("*").alias("_n")), "host")
    target = F.when(urls.path(F.col(url)) == "", F.lit("/")).otherwise(
        F.regexp_replace(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    )
    # a host may hold a large share of the links
    joined = lookup_join(hosted, counted, "host", "_rules", F.col("_n"), F.col(url), "left")
    first = F.element_at(
        F.filter("_rules", lambda r: F.startswith(target, r["prefix"])), 1
    )["allow"]
    matched = F.coalesce(F.exists("_rules", lambda r: F.startswith(target, r["prefix"])), F.lit(False))
    return joined.where(F.when(matched, first).otherwise(F.lit(True))).drop("_rules")


# ------------------------------------------------------------------ queue and statistics


def retry_queue(failures: DataFrame, todo: DataFrame, try_times: int) -> DataFrame:
    """Failed links ``(url, level, origin)`` that may be tried again and are not queued."""
    counted = failures.groupBy("url").agg(
        F.count("*").alias("n_failed"), F.min(F.struct("level", "origin")).alias("link")
    )
    return (
        counted.where(F.col("n_failed") <= try_times)
        .join(todo.select("url"), "url", "left_anti")
        .select("url", "link.level", "link.origin", "n_failed")
    )


def dedup_keep_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value once, at its first position."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def link_status(todo: DataFrame, done: DataFrame) -> DataFrame:
    return todo.agg(F.count("*").alias("nb_links_todo")).withColumn(
        "nb_links_done", done.select(F.count("*")).scalar()
    )


def crawl_stats_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change of the corpus totals when ``new`` pages are put in; both are keyed by ``url``."""
    o = old.select("url", F.col("nb_sentences").alias("old_s"), F.col("nb_characters").alias("old_c"))
    n = new.select("url", F.col("nb_sentences").alias("new_s"), F.col("nb_characters").alias("new_c"))
    good = F.col("new_c") > 0
    return n.join(o, "url", "left").agg(
        F.count_if(F.col("old_c").isNull()).alias("new_pages"),
        F.count_if(F.col("old_c").isNotNull()).alias("updated_pages"),
        F.sum(F.col("new_s") - F.coalesce("old_s", F.lit(0))).alias("sentences_delta"),
        F.sum(F.col("new_c") - F.coalesce("old_c", F.lit(0))).alias("characters_delta"),
        F.count_if(good).alias("good_pages"),
    )


def _rounded_part(seconds: Column) -> list[Column]:
    """Years to seconds; each unit is the rounded number of the smaller ones, ties to even."""
    minutes = F.bround(seconds / 60)
    hours = F.bround(minutes / 60)
    days = F.bround(hours / 24)
    return [F.bround(days / 365), days % 365, hours % 24, minutes % 60, seconds % 60]


def nice_time(seconds: Column) -> Column:
    """Elapsed time in words, such as ``1 day 2 hours``, with a blank at the end."""
    names = ["year", "day", "hour", "minute", "second"]
    words = [
        F.when(
            part > 0,
            F.concat(part.cast("long").cast("string"), F.lit(f" {name}"), F.when(part > 1, "s ").otherwise(" ")),
        ).otherwise("")
        for part, name in zip(_rounded_part(seconds), names)
    ]
    return F.concat(*words)


def throughput(log: DataFrame, ts: str, sentences: str, characters: str) -> DataFrame:
    """Rates per minute over the time from the first to the last fetch, one second at least."""
    seconds = F.greatest(F.lit(1).cast("long"), F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts)))
    totals = log.agg(
        seconds.alias("seconds"),
        F.count("*").alias("pages"),
        F.count_if(F.col(characters) > 0).alias("good_pages"),
        F.sum(sentences).alias("sentences"),
        F.sum(characters).alias("characters"),
    )

    def rate(name: str) -> Column:
        return F.col(name) / F.col("seconds") * 60

    return totals.select(
        "seconds", "pages", "good_pages", "sentences", "characters",
        F.bround(rate("sentences")).cast("long").alias("sentences_min"),
        F.bround(rate("characters")).cast("long").alias("characters_min"),
        F.bround(rate("pages"), 2).alias("pages_min"),
        F.bround(rate("good_pages"), 2).alias("good_pages_min"),
        nice_time(F.col("seconds")).alias("elapsed"),
    )


def link_lineage(sources: DataFrame) -> DataFrame:
    """Each source with the source that linked to it.

    The parent side is keyed by the unique rowid; a page that gave very many links is spread.
    """
    children = sources.groupBy("link_origin_rowid").agg(F.count("*").alias("n"))
    parents = sources.select(F.col("rowid").alias("link_origin_rowid"), F.col("url").alias("origin_url")).join(children, "link_origin_rowid")
    return lookup_join(
        sources.select("rowid", "url", "link_origin_rowid"), parents, "link_origin_rowid", "origin_url", F.col("n"), F.col("rowid"), "left"
    ).select("rowid", "url", "link_origin_rowid", "origin_url")


def link_path(sources: DataFrame) -> DataFrame:
    """Each source ``(rowid, url, link_origin_rowid)`` with ``depth``, ``seed`` and the ``path`` of URLs from its seed to itself.

    A source without stored origin, or with itself as origin, is a seed. Pointers are doubled: after k joins a source knows its
    ancestor 2^k links away, so a chain of any length takes as many joins as its length has binary digits. The
    first run finds seeds and depths; what still has no seed after enough joins for all rows hangs on a cycle and gets nulls. The second run
    adds the paths, without the rows of cycles.
    """
    pages = sources.select("rowid", "url", "link_origin_rowid")
    known = pages.select(F.col("rowid").alias("link_origin_rowid"), F.col("rowid").alias("_parent"))
    children = known.join(pages.groupBy("link_origin_rowid").agg(F.count("*").alias("_n")), "link_origin_rowid")
    linked = lookup_join(pages, children, "link_origin_rowid", "_parent", F.col("_n"), F.col("rowid"), "left")
    own = F.coalesce("_parent", "rowid")
    base = cut(linked.select("rowid", "url", own.alias("at"), (own == F.col("rowid")).alias("ended")))
    start = base.select("rowid", "at", "ended", (~F.col("ended")).cast("long").alias("depth"))
    found = _pointers(start, "depth", lambda far, near: far + near, base.count().bit_length() + 1)
    seeds = found.where("ended").select("rowid", "depth", F.col("at").alias("seed"))
    acyclic = base.join(seeds.select("rowid"), "rowid", "left_semi").select("rowid", "at", "ended", F.array("url").alias("path"))
    paths = _pointers(acyclic, "path", F.concat, None).select("rowid", "path")
    return pages.select("rowid", "url").join(seeds, "rowid", "left").join(paths, "rowid", "left")


def _pointers(rows: DataFrame, value: str, joined: Callable[[Column, Column], Column], most: int | None) -> DataFrame:
    """Double the pointers ``at`` of ``(rowid, at, ended, value)`` until all have ended, ``most`` times at most.

    ``value`` sums up the way from ``at``, without it, to the row; where the way has ended it takes in all of it. A row that very many
    point to is answered by a bounded broadcast.
    """
    rows = cut(rows)
    for _ in range(most if most is not None else 64):
        open_ = rows.where("NOT ended")
        if open_.isEmpty():
            break
        asked = open_.groupBy("at").agg(F.count("*").alias("_n"))
        far = rows.select(F.col("rowid").alias("at"), F.struct("at", "ended", value).alias("_far")).join(asked, "at")
        moved = lookup_join(open_, far, "at", "_far", F.col("_n"), F.col("rowid"))
        rows = cut(
            rows.where("ended").unionByName(
                moved.select("rowid", F.col("_far.at").alias("at"), F.col("_far.ended").alias("ended"), joined(F.col(f"_far.{value}"), F.col(value)).alias(value))
            )
        )
    return rows
