"""Streaming twins: pages arriving as files, events arriving as a log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from ..functions import urls
from ..operators.extract import page_texts

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
])


def read_pages(spark: SparkSession, folder: str, pattern: str = "*", per_batch: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(PAGES)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_batch)
        .parquet(folder)
    )


def stream_dedup_urls(pages: DataFrame) -> DataFrame:
    """Only the first arrival of each URL; the set of visited URLs is the state."""
    return pages.dropDuplicates(["url"])


def stream_dedup_urls_within(pages: DataFrame, ts: str, late: str) -> DataFrame:
    """Only the first arrival of each URL within ``late`` of event time; older URLs leave the state."""
    return pages.withWatermark(ts, late).dropDuplicatesWithinWatermark(["url"])


def stream_ingest(pages: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """Extract text, title and statistics, and write each batch into the store.

    A batch has a folder of its own that is replaced as a whole, so a batch that runs again
    after a failure leaves one copy. :func:`latest_pages` gives the upserted table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        page_texts(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest_pages(spark: SparkSession, target: str) -> DataFrame:
    """One row per URL: the one of the latest batch, then of the highest page id.

    The row is chosen by its keys alone; the pages join once. In a batch, a page id stands once per URL.
    """
    rows = spark.read.parquet(target)
    latest = rows.groupBy("url").agg(F.max(F.struct("batch", "page_id")).alias("v")).select("url", "v.*")
    return rows.join(latest, ["url", "batch", "page_id"]).drop("batch")


def stream_stats(events: DataFrame, ts: str, key: str, value: str, window: str, late: str) -> DataFrame:
    """Running totals per time window and key."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), F.col(key))
        .agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
        .select(F.col("w.start").alias("window_start"), key, "n", "total")
    )


def stream_host_rate(log: DataFrame, ts: str, url: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Accesses per host and window."""
    return (
        log.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), urls.host(F.col(url)).alias("host"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "host", "n")
    )


def stream_host_schedule(log: DataFrame, ts: str, id_col: str, url: str, delay: float, late: str = "10 minutes") -> DataFrame:
    """``host, id, start``: when each access may start if a host rests ``delay`` seconds between two.

    An access starts when it arrives, or when its host has rested since the start before it. State is one slot per
    host, the earliest next start; it is dropped when the watermark has passed that, since it then holds nobody back. Accesses of a
    batch stand by time, then by id.
    """
    rest = int(delay * 1_000_000)

    def place(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(chunks)).sort_values(["us", "id"])
        arrived = rows["us"].to_numpy(np.int64)
        if state.exists:
            arrived = np.maximum(arrived, state.get[0])
        # start = n * rest + the largest of (arrival - n * rest) so far
        rests = np.arange(len(arrived)) * rest
        start = np.maximum.accumulate(arrived - rests) + rests
        state.update((int(start[-1]) + rest,))
        state.setTimeoutTimestamp(max((int(start[-1]) + rest) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"host": key[0], "id": rows["id"].to_numpy(), "us": start})

    slim = log.withWatermark(ts, late).select(
        urls.host(F.col(url)).alias("host"), F.col(id_col).cast("long").alias("id"), F.unix_micros(ts).alias("us"), F.col(ts).alias("_time")
    )
    placed = slim.groupBy("host").applyInPandasWithState(place, "host string, id long, us long", "next long", "update", "EventTimeTimeout")
    return placed.select("host", "id", F.timestamp_micros("us").alias("start"))


def stream_stats_delta(pages: DataFrame, order: str) -> DataFrame:
    """What each arrival of a page changes in the totals of the corpus: its counts less those of the arrival before it.

    ``pages(url, nb_sentences, nb_characters, order)``; arrivals of a batch stand by ``order``. State is one pair of counts per URL. The sums of all
    rows are the running totals, whatever the batches.
    """
    counts = ["nb_sentences", "nb_characters"]

    def corrected(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(chunks)
        rows = rows[0] if len(rows) == 1 else pd.concat(rows)
        if len(rows) > 1:  # most URLs come once in a batch
            rows = rows.sort_values(["_order", *counts])
        new = rows[counts].to_numpy(np.int64)
        known = state.exists
        old = np.concatenate([[state.get if known else (0, 0)], new[:-1]])
        state.update(tuple(int(n) for n in new[-1]))
        first = np.arange(len(new)) == (-1 if known else 0)
        yield pd.DataFrame({
            "url": key[0], "new_pages": first.astype(np.int64), "updated_pages": (~first).astype(np.int64),
            "sentences_delta": new[:, 0] - old[:, 0], "characters_delta": new[:, 1] - old[:, 1], "good_pages": (new[:, 1] > 0).astype(np.int64),
        })

    slim = pages.select("url", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in counts], F.col(order).alias("_order"))
    schema = "url string, new_pages long, updated_pages long, sentences_delta long, characters_delta long, good_pages long"
    return slim.groupBy("url").applyInPandasWithState(corrected, schema, "s long, c long", "update", "NoTimeout")
