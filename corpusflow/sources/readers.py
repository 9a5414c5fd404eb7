"""Reading corpora: folders, tab-separated files, URL lists, profiles, stored tables."""

from __future__ import annotations

import codecs
import mimetypes
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import host
from ..operators.views import with_cell_stats

SOURCES = T.StructType([
    T.StructField("rowid", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("link_origin_rowid", T.LongType()),
    T.StructField("nb_sentences", T.LongType()),
    T.StructField("nb_characters", T.LongType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("source", T.StringType()),
])
TEXTS = T.StructType([
    T.StructField("sourceid", T.LongType()),
    T.StructField("textualid", T.IntegerType()),
    T.StructField("columnid", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("nb_sentences", T.LongType()),
    T.StructField("nb_characters", T.LongType()),
])
NAMES = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
REGISTRY = T.StructType([T.StructField("textualid", T.IntegerType()), T.StructField("columnid", T.IntegerType())])
LINKS_TODO = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("origin", T.LongType()),
])
LINKS_DONE = T.StructType([T.StructField("url", T.StringType())])
TABLES = {
    "sources": SOURCES, "texts": TEXTS, "textualizations": NAMES, "textcolumns": NAMES,
    "textualcolumns": REGISTRY, "links_todo": LINKS_TODO, "links_done": LINKS_DONE,
}


def create_corpus(spark: SparkSession, path: str) -> None:
    """An empty corpus with the columns title and text in the view ``standard``."""
    rows = {
        "textualizations": [(1, "standard")],
        "textcolumns": [(1, "title"), (2, "text")],
        "textualcolumns": [(1, 1), (1, 2)],
    }
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{path}/{name}")


def open_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}


# ------------------------------------------------------------------ files


def readable_mime(path: Column) -> Column:
    """Type by extension, for the kinds that are imported; null for all others."""
    kinds = {
        ext[1:]: kind
        for ext, kind in mimetypes.types_map.items()
        if kind.startswith("text/") or kind == "application/pdf"
    }
    table = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def scan_folder(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Every importable file below the folder as a source; dot-files are left out.

    The content of PDF files is not decoded and stays null. Files that a folder scan hides, because
    their name or a folder above begins with ``_`` or ``.``, are read by their own paths.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hidden = _hidden_files(spark, path)
    files = (
        (found.unionByName(_read_files(spark, hidden)) if hidden else found)
        .withColumn("mime", readable_mime(F.col("path")))
        .where(F.col("mime").isNotNull() & ~F.col("path").rlike(r"/\.[^/]*$"))
    )
    return files.select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("url"),
        F.lit(-1).cast("long").alias("link_origin_rowid"),
        "mime",
        F.col("modificationTime").alias("time"),
        F.when(F.col("mime") != "application/pdf", decode_bytes(F.col("content"), encoding)).alias("source"),
    )


def _hidden_files(spark: SparkSession, path: str) -> list[str]:
    """Paths below the folder that are no dot-files themselves but that a scan of it would not show."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    level, found = system.makeQualified(place(path)).toString().rstrip("/"), []

    def add(file: str) -> None:
        if not file.rsplit("/", 1)[-1].startswith("."):
            found.append(file)

    # only what is hidden is told to the driver's Python, not every file of the folder
    while len(system.globStatus(place(f"{level}/*")) or ()):
        for hit in system.globStatus(place(f"{level}/[_.]*")) or ():
            if hit.isFile():
                add(hit.getPath().toString())
            else:
                listed = system.listFiles(hit.getPath(), True)
                while listed.hasNext():
                    add(listed.next().getPath().toString())
        level += "/[!_.]*"
    return found


def _read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The given files in the columns of a binary scan, opened by the tasks."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, place = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                info = system.get_file_info(place)
                with system.open_input_file(place) as f:
                    content = f.read()
                yield pd.DataFrame({"path": [path], "modificationTime": [info.mtime], "length": [info.size], "content": [content]})

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), spark.sparkContext.defaultParallelism))
    return listed.mapInPandas(read, "path string, modificationTime timestamp, length long, content binary")


def decode_bytes(content: Column, encoding: str = "utf-8") -> Column:
    """Text of stored bytes; what the encoding does not allow becomes the replacement sign."""
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        return F.make_valid_utf8(content.cast("string"))
    name = codecs.lookup(encoding).name

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(name, "replace"))

    return decoded(content)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of text files, numbered from 1 in each file.

    A file is read in blocks; lines are numbered in their block and the blocks before it are
    counted, so no file is ever numbered in one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_order"),
        F.col("value").alias("line"),
    )
    in_block = Window.partitionBy("file", "block").orderBy("_order")
    blocks_before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        lines.groupBy("file", "block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(blocks_before), F.lit(0)))
        .drop("_n")
    )
    return (
        lines.withColumn("_in_block", F.row_number().over(in_block))
        .join(starts, ["file", "block"])
        .select("file", (F.col("_start") + F.col("_in_block")).alias("line_no"), "line")
    )


def parse_tsv(lines: DataFrame) -> DataFrame:
    """Lines ``(file, line_no, line)`` of a tab-separated file to sources with title and text.

    One field is a text whose title is its number; else the last field is the text and all
    fields before it are the title. A blank line is a row too.
    """
    stripped = F.regexp_replace("line", r"^\s+|\s+$", "")
    fields = F.split(stripped, "\t")
    many = F.size("f") > 1
    return lines.select("file", "line_no", fields.alias("f")).select(
        F.col("line_no").cast("long").alias("rowid"),
        F.col("file").alias("url"),
        F.lit(-1).cast("long").alias("link_origin_rowid"),
        F.when(many, F.array_join(F.slice("f", F.lit(1), F.greatest(F.size("f") - 1, F.lit(0))), " "))
        .otherwise(F.col("line_no").cast("string"))
        .alias("title"),
        F.element_at("f", -1).alias("text"),
    )


def scan_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_tsv(numbered_lines(spark, path))


def segment_by_marker(texts: DataFrame, id_col: str, column: str) -> DataFrame:
    """``(id, chunk, line_no, line)``: a line of digits only starts the next chunk.

    Of a run of blank lines the first stays. Lines are ordered within their own text.
    """
    lines = texts.select(id_col, F.posexplode(F.split(F.col(column), "\n")).alias("line_no", "line"))
    w = Window.partitionBy(id_col).orderBy("line_no")
    blank = F.trim(F.regexp_replace("line", r"\s+", " ")) == ""
    marker = F.trim("line").rlike(r"^\d+$")
    return (
        lines.withColumn("chunk", F.sum(marker.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_blank", blank)
        .withColumn("_after_blank", F.coalesce(F.lag("_blank").over(w), F.lit(True)))
        .where(~(F.col("_blank") & F.col("_after_blank")))
        .select(id_col, "chunk", F.col("line_no").cast("long").alias("line_no"), "line")
    )


# ------------------------------------------------------------------ links and profiles


def _with_scheme(url: Column) -> Column:
    """As it is where it names a host, after a scheme or after two slashes alone."""
    return F.when(host(url) != "", url).otherwise(F.concat(F.lit("http://"), url))


def _as_seeds(urls: DataFrame, origin: int) -> DataFrame:
    return urls.select("url", F.lit(0).alias("level"), F.lit(origin).cast("long").alias("origin"))


def scan_seeds(texts: DataFrame, column: str) -> DataFrame:
    """Start URLs from text split at white space."""
    words = texts.select(F.explode(F.split(F.col(column), r"\s+")).alias("w")).where(F.col("w") != "")
    return _as_seeds(words.select(_with_scheme(F.col("w")).alias("url")), 0)


def scan_seed_file(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return _as_seeds(lines.where(F.col("url") != ""), 0)


def seed_from_results(results: DataFrame, column: str, pattern: str | None) -> DataFrame:
    kept = results if not pattern else results.where(F.col(column).rlike(pattern))
    return _as_seeds(kept.select(F.col(column).alias("url")), -1)


def resume_frontier(todo: DataFrame, done: DataFrame) -> DataFrame:
    return todo.join(done.select("url"), "url", "left_anti")


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Files ``<code>.ng`` of ``gram TAB weight`` lines; lines of another form are skipped."""
    lines = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("lang"), F.split("value", "\t").alias("f")
    )
    weight = F.when(F.get("f", 1).rlike(r"^\s*-?\d+\s*$"), F.trim(F.get("f", 1)).cast("long"))
    return lines.where(F.size("f") == 2).select("lang", F.get("f", 0).alias("gram"), weight.alias("weight")).where(
        F.col("weight").isNotNull()
    )


# ------------------------------------------------------------------ ingest


def ingest_pages(old: DataFrame, new: DataFrame, mode: str) -> DataFrame:
    """Sources after new pages came in: ``append``, ``overwrite`` by URL, or ``erase``.

    Both sides have ``url`` and ``time``. When overwriting, the latest of several new pages
    of one URL wins; of equal times, the one with the larger hash of its values. Each task passes at most one
    page of a URL on. Where ``old`` is a table of ``store_by_url``, its pages are not shuffled.
    """
    if mode == "erase":
        return new
    if mode == "append":
        return old.unionByName(new, allowMissingColumns=True)
    if mode != "overwrite":
        raise ValueError(f"unknown mode {mode!r}")
    values = [f.name for f in new.schema if "map<" not in f.dataType.simpleString()]
    place = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("time"), F.desc(F.xxhash64(*values))))
    latest = new.withColumn("_place", place).where("_place = 1").drop("_place")
    return old.join(latest.select("url"), "url", "left_anti").unionByName(latest, allowMissingColumns=True)


def store_by_url(pages: DataFrame, name: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Pages as a table bucketed by URL: joins and anti joins on ``url`` read it without an exchange.

    There are as many buckets as shuffle partitions unless told otherwise; fewer would be shuffled again.
    """
    spark = pages.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one task a bucket, or every task would write a file for every bucket
    writer = pages.repartition(count, "url").write.bucketBy(count, "url").sortBy("url").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def replaced_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each new URL the old counts it replaces, null for a page that is new."""
    return new.select("url").distinct().join(
        old.select("url", F.col("nb_sentences").alias("old_sentences"), F.col("nb_characters").alias("old_characters")),
        "url", "left",
    )


def page_cells(pages: DataFrame, id_col: str = "rowid", view_id: int = 1) -> DataFrame:
    """The title and text cells that every page writes, with their statistics."""
    entries = F.array(
        F.struct(F.lit(1).alias("columnid"), F.col("title").alias("text"),
                 F.col("title_nb_sentences").alias("nb_sentences"), F.col("title_nb_characters").alias("nb_characters")),
        F.struct(F.lit(2).alias("columnid"), F.col("text").alias("text"),
                 F.col("nb_sentences").alias("nb_sentences"), F.col("nb_characters").alias("nb_characters")),
    )
    return pages.select(F.col(id_col).alias("sourceid"), F.lit(view_id).alias("textualid"), F.inline(entries))
