"""Language identification of documents with profiles trained on documents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..operators import langid
from ..plans.checkpoints import scratch_path, stored
from ..sources.readers import load_profiles as read_profiles
from .base import SQL_WHITE, heavy, query, table


def texts(spark, sf):
    return heavy(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def profiles(spark, sf):
    """Profiles are used several times by a query: at most 500 rows per language, stored once."""
    return stored(langid.train_profiles(heavy(spark, sf, "documents").select("lang", "text")), "profiles")


def sql_grams(key: str, source: str) -> str:
    return f"""(SELECT {key}, unnest(list_transform(range(1, greatest(len(c) - 2, 1)), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
  FROM (SELECT {key}, string_split(regexp_replace(' ' || text || ' ', '{SQL_WHITE}+', '_', 'g'), '') AS c FROM {source} WHERE text <> ''))"""


def sql_characters() -> str:
    """A table of the characters up to Latin Extended-A: all that occur in the given tables."""
    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    rows = []
    for code in (9, 10, *range(32, 127), *range(161, 384)):
        name = unicodedata.name(chr(code), "")
        word = quoted(name.partition(" ")[0]) if name else "NULL"
        rows.append(f"({code}, {quoted(unicodedata.category(chr(code)))}, {word}, {quoted(name)})")
    return f"""characters AS (SELECT chr(code) AS char, category, script_word, char_name
  FROM (VALUES {', '.join(rows)}) AS t(code, category, script_word, char_name))"""


def sql_scripts(source: str) -> str:
    """``scripts(id, category, script)`` of ``source(id, text)``."""
    return f"""{sql_characters()},
script_chars AS (SELECT id, unnest(c[:-2]) AS char FROM (
  SELECT id, string_split(regexp_replace(text, '{SQL_WHITE}+', ' ', 'g'), '') AS c FROM {source} WHERE length(text) >= 2)),
script_ranks AS (SELECT id, char, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, char DESC) AS place
  FROM script_chars GROUP BY id, char QUALIFY place <= 200),
script_facts AS (SELECT id, place, unnest(['category', 'script']) AS kind, unnest([category, script_word]) AS value FROM script_ranks JOIN characters USING (char)),
script_best AS (SELECT id, kind, value FROM script_facts WHERE value IS NOT NULL GROUP BY id, kind, value
  QUALIFY row_number() OVER (PARTITION BY id, kind ORDER BY count(*) DESC, min(place) DESC) = 1),
scripts AS (SELECT id, coalesce(c.value, '') AS category, coalesce(k.value, '') AS script FROM (SELECT id FROM {source})
  LEFT JOIN (SELECT id, value FROM script_best WHERE kind = 'category') c USING (id) LEFT JOIN (SELECT id, value FROM script_best WHERE kind = 'script') k USING (id))"""


SQL_PROFILES = f"""lang_sizes AS (SELECT lang, sum(length(text)) AS chars FROM documents GROUP BY lang),
lang_grams AS (SELECT lang, gram, count(*) AS n FROM {sql_grams('lang', 'documents')} GROUP BY lang, gram),
profiles AS (SELECT lang, gram, CASE WHEN chars <= 1000000 THEN n * (1000000 // chars) ELSE (1000000 * n) // chars END::BIGINT AS weight
  FROM (SELECT * FROM lang_grams QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram DESC) <= 500) JOIN lang_sizes USING (lang))"""
SQL_DOC_GRAMS = f"""doc_grams AS (SELECT doc_id AS id, gram, n * greatest(1, 1000000 // length(text)) AS weight,
    row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram DESC) AS gram_rank
  FROM (SELECT doc_id, gram, count(*) AS n FROM {sql_grams('doc_id', 'documents')} GROUP BY doc_id, gram) JOIN documents USING (doc_id)
  QUALIFY gram_rank <= 500)"""
SQL_DISTANCES = f"""{SQL_PROFILES}, {SQL_DOC_GRAMS},
distances AS (SELECT id, l.lang, sum(abs(coalesce(p.weight, 0) - g.weight)) AS distance
  FROM doc_grams g CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.gram = g.gram GROUP BY ALL),
scores AS (SELECT id, lang, (distance / greatest(1, 1000000 // length(text)) / length(text) - 1) * -100 AS score
  FROM distances JOIN (SELECT doc_id AS id, text FROM documents) USING (id))"""


@query(f"WITH {SQL_PROFILES} SELECT * FROM profiles")
def train_profiles(spark, sf):
    return langid.train_profiles(heavy(spark, sf, "documents").select("lang", "text"))


@query(f"WITH {SQL_DOC_GRAMS} SELECT id, gram, weight::BIGINT AS weight, gram_rank FROM doc_grams")
def char_ngrams(spark, sf):
    return langid.char_ngrams(texts(spark, sf))


@query(f"WITH {SQL_DISTANCES} SELECT id, lang, round(score, 6) AS score FROM scores")
def profile_distance(spark, sf):
    return langid.profile_distance(texts(spark, sf), profiles(spark, sf)).select("id", "lang", F.round("score", 6).alias("score"))


@query(f"WITH texts AS (SELECT doc_id AS id, text FROM documents), {sql_scripts('texts')} SELECT * FROM scripts")
def dominant_script(spark, sf):
    return langid.dominant_script(texts(spark, sf))


# All documents are in Latin script: the best profile decides.
@query(f"WITH {SQL_DISTANCES} SELECT id, lang, round(score, 6) AS score FROM scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, lang DESC) = 1")
def guess_language(spark, sf):
    return langid.guess_language(texts(spark, sf), profiles(spark, sf)).select("id", "lang", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_DISTANCES} SELECT id, lang, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang DESC)::INTEGER AS place FROM scores")
def guess_language_list(spark, sf):
    return langid.guess_language_list(texts(spark, sf), profiles(spark, sf)).select("id", "lang", "place")


SQL_BEST = f"{SQL_DISTANCES}, best AS (SELECT id, lang FROM scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, lang DESC) = 1)"


@query(f"WITH {SQL_BEST} SELECT id FROM best WHERE lang = 'fr'")
def language_filter(spark, sf):
    return langid.language_filter(texts(spark, sf), profiles(spark, sf), "French").select("id")


# A line is judged by itself: its script must leave the choice to the profiles, and German must be the best.
@query(f"""WITH {SQL_PROFILES},
doc_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
texts AS (SELECT DISTINCT line AS id, line AS text FROM doc_lines), {sql_scripts('texts')},
line_grams AS (SELECT id, gram, n * greatest(1, 1000000 // length(id)) AS weight FROM (
  SELECT id, gram, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, gram DESC) AS k FROM {sql_grams('id', 'texts')} GROUP BY id, gram) WHERE k <= 500),
line_scores AS (SELECT id, l.lang, (sum(abs(coalesce(p.weight, 0) - g.weight)) / greatest(1, 1000000 // length(id)) / length(id) - 1) * -100 AS score
  FROM line_grams g CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.gram = g.gram GROUP BY id, l.lang),
line_best AS (SELECT id FROM line_scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, lang DESC) = 1 AND lang = 'de'),
good AS (SELECT id FROM line_best JOIN scripts USING (id) WHERE category IN ('Ll', 'Lu') AND script = 'LATIN')
SELECT doc_id AS id, coalesce(string_agg(CASE WHEN line IN (SELECT id FROM good) THEN line || chr(10) END, '' ORDER BY pos), '') AS text FROM doc_lines GROUP BY doc_id""")
def keep_language_paragraphs(spark, sf):
    return langid.keep_language_paragraphs(texts(spark, sf), profiles(spark, sf), "de")


@query(f"WITH {SQL_PROFILES} SELECT lang, count(*) AS n, sum(weight)::BIGINT AS total FROM profiles GROUP BY lang "
       "UNION ALL SELECT 'xx', (SELECT count(*) FROM profiles WHERE lang = 'en'), (SELECT sum(weight)::BIGINT FROM profiles WHERE lang = 'en')")
def register_language(spark, sf):
    english = table(spark, sf, "documents").where("lang = 'en'")
    more = langid.register_language(profiles(spark, sf), "xx", english.select("text"))
    return more.groupBy("lang").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))


@query(f"WITH {SQL_PROFILES} SELECT * FROM profiles")
def load_profiles(spark, sf):
    """Profiles are written as one file per language and read back."""
    from ..sources.writers import write_files

    trained = profiles(spark, sf)
    lines = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "gram", "weight"))),
        lambda r: F.concat(r["gram"], F.lit("\t"), r["weight"].cast("string")),
    ), "\n")
    files = trained.groupBy("lang").agg(lines.alias("content")).select(F.concat("lang", F.lit(".ng")).alias("file_name"), "content")
    folder = scratch_path(spark, "profiles")
    write_files(files, folder).count()
    return read_profiles(spark, folder)


@query("SELECT 'doc' AS id, 'LTR' AS direction FROM documents LIMIT 1")
def text_direction(spark, sf):
    from ..operators.views import sample_prefix

    sample = sample_prefix(table(spark, sf, "documents"), "doc_id", "text", 1000).select(F.lit("doc").alias("id"), F.col("sample").alias("text"))
    return langid.text_direction(sample, profiles(spark, sf))


@query("""SELECT DISTINCT lang, n AS name FROM (SELECT lang, CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' END AS n FROM documents
UNION ALL SELECT unnest(['bn', 'dv', 'el', 'gu', 'ja', 'ka', 'ko', 'ta', 'th', 'zh']), unnest(['Bengali', 'Dhivehi', 'Greek', 'Gujarati', 'Japanese', 'Georgian', 'Korean', 'Tamil', 'Thai', 'Chinese']))""")
def supported_languages(spark, sf):
    return langid.supported_languages(spark, profiles(spark, sf))


@query("SELECT doc_id, regexp_replace(text, '(\\d|[^\\p{L}\\p{M}\\p{N}_])+', ' ', 'g') AS text FROM documents")
def strip_digits_punct(spark, sf):
    return table(spark, sf, "documents").select("doc_id", langid.strip_digits_punct(F.col("text")).alias("text"))


@query(f"""WITH train AS (SELECT * FROM documents WHERE doc_id % 2 = 0), tested AS (SELECT * FROM documents WHERE doc_id % 2 = 1),
{SQL_PROFILES.replace("documents", "train")}{SQL_BEST.removeprefix(SQL_PROFILES).replace("documents", "tested")}
SELECT d.lang, b.lang AS guess, count(*) AS n FROM best b JOIN tested d ON doc_id = id GROUP BY ALL""")
def language_confusion(spark, sf):
    """Profiles of the documents with even ids are tested on the others."""
    even = F.col("doc_id") % 2 == 0
    trained = stored(langid.train_profiles(heavy(spark, sf, "documents").where(even).select("lang", "text")), "profiles")
    guesses = langid.guess_language(texts(spark, sf).where("id % 2 = 1"), trained)
    gold = table(spark, sf, "documents").where(~even).select(F.col("doc_id").alias("id"), "lang")
    return langid.language_confusion(guesses, gold)
