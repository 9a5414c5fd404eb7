"""Registry of the queries over the given tables and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import SQL_INITIAL, SQL_SENTENCE_SPLIT

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files of a table for one task of heavy work.
TASK_BYTES = 8 << 20


def heavy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows need much work each, dealt out by its first column, the id.

    The given files have a single row group, which one task would read and work on alone. A large table gets more
    tasks than a shuffle has, so that what a task holds does not grow with the table.
    """
    rows = table(spark, sf_dir, name)
    tasks = -(-table_bytes(spark, f"{sf_dir}/{name}.parquet") // TASK_BYTES)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        return rows.repartition(tasks, rows.columns[0])
    return rows.repartition(rows.columns[0])


def table_bytes(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


# ------------------------------------------------------------------ documents as a corpus

BASE_URL = "http://www.{}.example.org/"


def corpus(spark: SparkSession, sf_dir: str, load: Callable[..., DataFrame] = table) -> DataFrame:
    """Documents as rows of a view: url, origin, time, title (first line) and text.

    Links form a tree: document d is linked from document d div 4.
    """
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("rowid"),
        F.concat(F.lit("http://www."), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.floor(F.col("doc_id") / 4).alias("link_origin_rowid"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("time"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text", "lang", F.col("source").alias("site"), "n_chars",
    )


SQL_CORPUS = """corpus AS (
  SELECT doc_id AS rowid,
    'http://www.' || source || '.example.org/' || lang || '/' || doc_id AS url,
    doc_id // 4 AS link_origin_rowid,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS time,
    string_split(text, chr(10))[1] AS title,
    text, lang, source AS site, n_chars
  FROM documents)"""


# ------------------------------------------------------------------ pieces of SQL

SQL_WHITE = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SQL_NON_WORD = r"[^\p{L}\p{M}\p{N}_/]+"


def sql_tokens(text: str) -> str:
    return f"string_split_regex(lower({text}), '{SQL_NON_WORD}')"


def sql_breaks(text: str) -> str:
    """Number of matches of the sentence splitter."""
    return (
        f"len(regexp_extract_all(regexp_replace({text}, '{SQL_INITIAL}', '\\1', 'g'), '{SQL_SENTENCE_SPLIT}'))"
    )


def sql_line_breaks(text: str) -> str:
    return (
        f"list_sum(list_transform(string_split({text}, chr(10)), lambda l: greatest(1, {sql_breaks('l')})))::BIGINT"
    )
