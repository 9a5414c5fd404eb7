"""Text columns: replacement, derivation, annotation, lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import texttools as tt
from .base import SQL_CORPUS, SQL_WHITE, corpus, heavy, query, sql_breaks, table

FIND, REPLACE = r"(th)(e\w*)", r"\2-\1$"


@query(f"""WITH {SQL_CORPUS} SELECT rowid, regexp_replace(title, '(?i)(th)(e\\w*)', '\\2-\\1$', 'g') AS title,
  regexp_replace(text, '(?i)(th)(e[\\p{{L}}\\p{{M}}\\p{{N}}_]*)', '\\2-\\1$', 'g') AS text FROM (SELECT rowid, text,
  title FROM corpus)""".replace("(e\\w*)', '\\2-\\1$', 'g') AS title", "(e[\\p{L}\\p{M}\\p{N}_]*)', '\\2-\\1$', 'g') AS title"))
def regex_replace_columns(spark, sf):
    c = corpus(spark, sf).select("rowid", "title", "text")
    return tt.regex_replace_columns(c, ["title", "text"], FIND, REPLACE)


@query(f"""WITH {SQL_CORPUS}, n AS (SELECT len(regexp_extract_all(t, '(?i)(th)(e)')) AS n FROM (SELECT title AS t FROM corpus UNION ALL SELECT text FROM corpus))
SELECT sum(n)::BIGINT AS replacements, count(*) FILTER (n > 0) AS replaced_cells FROM n""")
def replacement_counts(spark, sf):
    return tt.replacement_counts(corpus(spark, sf), ["title", "text"], "(th)(e)")


@query(f"""WITH {SQL_CORPUS}, n AS (SELECT rowid, title, text, len(regexp_extract_all(title, '(?i)(th)(e)')) AS a, len(regexp_extract_all(text, '(?i)(th)(e)')) AS b FROM corpus)
SELECT rowid, regexp_replace(title, '(?i)(th)(e)', '\\2\\1', 'g') AS title, regexp_replace(text, '(?i)(th)(e)', '\\2\\1', 'g') AS text,
  (SELECT sum(a + b) FROM n)::BIGINT AS replacements, (SELECT count(*) FILTER (a > 0) + count(*) FILTER (b > 0) FROM n) AS replaced_cells FROM n""")
def replace_counted(spark, sf):
    """The replaced cells, each row with the counts that the same pass over the texts gave."""
    c = corpus(spark, sf).select("rowid", "title", "text")
    replaced, counts = tt.replace_counted(c, ["title", "text"], "(th)(e)", r"\2\1")
    return replaced.withColumns({name: F.lit(n).cast("long") for name, n in counts.items()})


@query("""WITH m AS (SELECT doc_id, text, regexp_extract(text, '(?i)on[a-z]+') AS m, regexp_matches(text, '(?i)on[a-z]+') AS hit,
  length(string_split_regex(text, '(?i)on[a-z]+')[1]) AS s FROM documents)
SELECT doc_id, CASE WHEN hit THEN regexp_replace(text[greatest(1, s - 9):s] || m || text[s + length(m) + 1:s + length(m) + 10], '\\n+', ' ', 'g') END AS found FROM m""")
def find_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tt.find_preview(F.col("text"), "on[a-z]+").alias("found"))


@query(f"""WITH {SQL_CORPUS}, u AS (SELECT rowid, title, text, upper(title) AS title_up, upper(text) AS text_up FROM corpus)
SELECT *, {sql_breaks('title_up')} AS title_up_nb_sentences, length(title_up) AS title_up_nb_characters,
  {sql_breaks('text_up')} AS text_up_nb_sentences, length(text_up) AS text_up_nb_characters
FROM (SELECT rowid, title, text, replace(title, ' ', '. ') AS title_up, replace(text, ' ', '. ') AS text_up FROM u)""")
def derive_columns(spark, sf):
    c = corpus(spark, sf).select("rowid", "title", "text")
    return tt.derive_columns(c, ["title", "text"], lambda t: F.replace(t, F.lit(" "), F.lit(". ")), "_up")


def annotated(spark, sf):
    """Words as slash-annotated tokens with their length as tag and themselves in lower case as lemma."""
    def annotate(word):
        safe = F.replace(word, F.lit("/"), F.lit("&slash;"))
        # words of two letters are malformed tokens
        return F.when(F.length(word) == 2, F.concat(safe, F.lit("/x"))).otherwise(
            F.concat(safe, F.lit("/T"), F.length(word).cast("string"), F.lit("/B-NP/O/O/"), F.lower(safe))
        )

    line = F.transform(F.split("text", "\n"), lambda l: F.array_join(F.transform(F.split(l, " "), annotate), " "))
    return table(spark, sf, "documents").select("doc_id", F.array_join(line, "\n").alias("annotated"))


def sql_annotation(shown: str) -> str:
    return f"""SELECT doc_id, coalesce(array_to_string(list_transform(
    list_filter(list_transform(string_split(text, chr(10)), lambda l: list_filter(string_split_regex(l, '{SQL_WHITE}+'), lambda w: true)), lambda t: true),
    lambda words: array_to_string(list_transform(list_filter(words, lambda w: length(w) <> 2), lambda w: {shown} || ' '), '') || chr(10)), ''), '') AS out FROM documents"""


@query(sql_annotation("lower(w)"))
def project_annotation_lemma(spark, sf):
    a = annotated(spark, sf)
    return a.select("doc_id", tt.project_annotation(F.col("annotated"), "lemma").alias("out"))


@query(sql_annotation("'T' || length(w)"))
def project_annotation_tag(spark, sf):
    return annotated(spark, sf).select("doc_id", tt.project_annotation(F.col("annotated"), "tag").alias("out"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_transform(string_split(l, ' '),
  lambda w: w || CASE WHEN length(w) = 2 THEN '/x' ELSE '/T' || length(w) || '/B-NP/O/O/' || lower(w) END), ' ')), chr(10)) AS out FROM documents""")
def project_annotation_complete(spark, sf):
    """Malformed tokens stay, protected slashes are slashes again."""
    return annotated(spark, sf).select("doc_id", tt.project_annotation(F.col("annotated"), "complete").alias("out"))


@query(sql_annotation("lower(w) || '-T' || length(w)"))
def project_annotation_both(spark, sf):
    a = annotated(spark, sf)
    return a.select("doc_id", tt.project_annotation(F.col("annotated"), "lemma-tag").alias("out"))


@query(f"""WITH lex AS (SELECT DISTINCT w AS form, 'L:' || w[:3] AS lemma FROM (SELECT unnest(string_split_regex(text, '{SQL_WHITE}+')) AS w FROM benchmark)),
words AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, string_split_regex(text, '{SQL_WHITE}+') AS w FROM documents))
SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS text_lem FROM words LEFT JOIN lex ON form = w GROUP BY doc_id""")
def lemmatize_with(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", r"(?U)\s+")).alias("form")).distinct()
    lexicon = words.select("form", F.concat(F.lit("L:"), F.substring("form", 1, 3)).alias("lemma"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tt.lemmatize_with(docs, "doc_id", "text", lexicon, "text_lem").select("doc_id", "text_lem")


# An alternation takes the first branch that matches: with the longest forms in front it cuts the same way.
@query(f"""WITH forms AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '{SQL_WHITE}+')) AS w FROM benchmark) WHERE length(w) > 1),
pattern AS (SELECT '(?s)' || string_agg(regexp_escape(w), '|' ORDER BY length(w) DESC, w) || '|.' AS p FROM forms)
SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(text, '{SQL_WHITE}+', '', 'g'), p), ' ') AS segmented FROM documents, pattern""")
def segment_with(spark, sf):
    """Documents without blanks are cut again into the words of the benchmark texts."""
    lexicon = table(spark, sf, "benchmark").select(F.explode(F.split("text", r"(?U)\s+")).alias("form"))
    docs = heavy(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"(?U)\s+", "").alias("text"))
    return tt.segment_with(docs, "doc_id", "text", lexicon, "segmented").select("doc_id", "segmented")


@query(f"SELECT doc_id, translate(replace(regexp_replace(text, '{SQL_WHITE}+', ' ', 'g'), '...', '…'), '‘’', '''''') AS text FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tt.normalize_text(F.col("text")).alias("text"))


@query(f"""WITH n AS (SELECT doc_id, translate(replace(regexp_replace(text, '{SQL_WHITE}+', ' ', 'g'), '...', '…'), '‘’', '''''') AS t FROM documents),
p AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\\p{{L}}\\p{{M}}\\p{{N}}_])([!,?.:;»«])', '\\1 \\2', 'g'), '([''(»«‘’])', '\\1 ', 'g') AS t FROM n)
SELECT doc_id, array_to_string(list_filter(string_split_regex(t, ' +'), lambda w: w <> ''), '|') AS tokens FROM p""")
def punct_tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(tt.punct_tokenize(F.col("text")), "|").alias("tokens"))
