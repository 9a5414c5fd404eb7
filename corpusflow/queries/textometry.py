"""Textometry over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import positions
from ..operators import textometry as tx
from ..operators.concordance import highlight as highlight_column
from ..plans.checkpoints import scratch_path, stored
from .base import SQL_NON_WORD, heavy, query, sql_tokens, table
from .langid import sql_characters

WORD = "the"
SELECTION = ["src1", "src2", "src3"]
WINDOW = 5


def doc_sections(spark: SparkSession, sf: str) -> DataFrame:
    return tx.sections_by_row(heavy(spark, sf, "documents"), "doc_id", "source", ["text"])


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tx.tokenize(doc_sections(spark, sf))


def doc_bow(spark: SparkSession, sf: str) -> DataFrame:
    return tx.bag_of_words(doc_tokens(spark, sf))


def source_bow(spark: SparkSession, sf: str) -> DataFrame:
    pieces = tx.sections_by_group(heavy(spark, sf, "documents"), "source", ["doc_id"], ["text"])
    return tx.bag_of_words(tx.tokenize_groups(pieces, ["doc_id"]))


TOKENS = f"tok AS (SELECT doc_id AS section_id, {sql_tokens('text')} AS tokens FROM documents)"
BOW = TOKENS + """,
bow AS (SELECT section_id, token, count(*) AS freq
        FROM (SELECT section_id, unnest(tokens) AS token FROM tok) GROUP BY ALL)"""
SOURCE_BOW = f"""tok AS (
  SELECT source AS section_id, {sql_tokens("string_agg(text || chr(10), '' ORDER BY doc_id)")} AS tokens
  FROM documents GROUP BY source),
bow AS (SELECT section_id, token, count(*) AS freq
        FROM (SELECT section_id, unnest(tokens) AS token FROM tok) GROUP BY ALL)"""
VOCAB = "vocab AS (SELECT token, sum(freq)::BIGINT AS totfreq FROM bow GROUP BY token)"
SIZES = "sizes AS (SELECT section_id, sum(freq)::BIGINT AS size, count(*) AS n_types FROM bow GROUP BY section_id)"
CELLS = """cells AS (
  SELECT token, section_id, freq, totfreq, size FROM bow JOIN vocab USING (token) JOIN sizes USING (section_id)
  UNION ALL
  SELECT token, section_id, 0, totfreq, size
  FROM (SELECT k, n FROM (SELECT DISTINCT totfreq AS k FROM vocab), (SELECT DISTINCT size AS n FROM sizes),
               (SELECT sum(freq) AS c FROM bow)
        WHERE c - k - n < 0
           OR lgamma(c - k + 1) - lgamma(c - k - n + 1) - lgamma(c + 1) + lgamma(c - n + 1) <= ln(0.05) + 1e-6)
  JOIN vocab ON totfreq = k JOIN sizes ON size = n
  ANTI JOIN bow USING (section_id, token))"""


def sql_scored(cells: str, corpus: str, section: str, freq: str = "freq", total: str = "totfreq") -> str:
    """CTE ``scored``: ``cells`` with spec and log10p, by log-gammas and a full sum.

    The probability depends on three numbers, so it is computed once for each triple.
    """
    # lgamma of every factor; k runs over the tail, terms are relative to the first
    term = (
        "-lgamma({k} + 1) - lgamma(kk - {k} + 1) - lgamma(n - {k} + 1) - lgamma(c - kk - n + {k} + 1)"
    )
    return f"""triples AS (SELECT DISTINCT {section} AS tn, {total} AS tk, {freq} AS tf FROM {cells}),
law AS (SELECT *, least(tn, c) AS n, tk AS kk FROM triples, (SELECT ({corpus})::BIGINT AS c)),
bounds AS (SELECT *, greatest(0, n + kk - c) AS lo, least(n, kk) AS hi FROM law),
place AS (SELECT *, greatest(least(tf, hi), lo) AS x,
                 greatest(least(tf, hi), lo)::DOUBLE * c >= kk::DOUBLE * n AS up,
                 ceil(40 * sqrt(n::DOUBLE * kk / c + 1) + 60)::BIGINT AS far FROM bounds),
tail AS (SELECT *, CASE WHEN lo = hi THEN 0.0 ELSE
    ({term.format(k='x')} + lgamma(kk + 1) + lgamma(c - kk + 1) - lgamma(c + 1) + lgamma(n + 1) + lgamma(c - n + 1)
     + ln(list_sum(list_transform(
         CASE WHEN up THEN range(x, least(hi, x + far) + 1) ELSE range(greatest(lo, x - far), x + 1) END,
         lambda k: exp(({term.format(k='k')}) - ({term.format(k='x')})))))) / ln(10) END AS l FROM place),
result AS (SELECT tn, tk, tf,
    CASE WHEN round(l, 9) > round(log10(0.05), 9) THEN 0
         ELSE (CASE WHEN up THEN 1 ELSE -1 END) * greatest(1, -floor(round(l, 9)))::INTEGER END AS spec,
    CASE WHEN round(l, 9) > round(log10(0.05), 9) THEN 0.0 ELSE l END AS log10p FROM tail),
scored AS (SELECT {cells}.*, spec, round(log10p, 2) + 0.0 AS log10p FROM {cells}
           JOIN result ON {section} = tn AND {total} = tk AND {freq} = tf)"""


def shown(df: DataFrame) -> DataFrame:
    """Logarithms rounded for display, without a negative zero."""
    return df.withColumn("log10p", F.round("log10p", 2) + 0.0)


# ------------------------------------------------------------------ sections and tokens


@query("SELECT doc_id AS section_id, source AS label, source || chr(10) || lang || chr(10) || text AS text FROM documents")
def make_sections_by_row(spark, sf):
    return tx.sections_by_row(table(spark, sf, "documents"), "doc_id", "source", ["source", "lang", "text"])


@query("SELECT role AS section_id, conv_id, turn, role || chr(10) || text || chr(10) AS text FROM conversations")
def make_sections_by_group(spark, sf):
    return tx.sections_by_group(table(spark, sf, "conversations"), "role", ["conv_id", "turn"], ["role", "text"])


@query("SELECT source AS section_id, count(*) AS n_rows FROM documents GROUP BY source")
def group_order(spark, sf):
    return tx.group_order(table(spark, sf, "documents"), "source")


@query(f"WITH {TOKENS} SELECT section_id, len(tokens) AS n_tokens, array_to_string(tokens, '|') AS joined FROM tok")
def tokenize(spark, sf):
    return doc_tokens(spark, sf).select(
        "section_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", "|").alias("joined")
    )


@query(f"WITH {SOURCE_BOW} SELECT * FROM bow")
def tokenize_groups(spark, sf):
    return source_bow(spark, sf)


@query(f"WITH {BOW} SELECT * FROM bow")
def bag_of_words(spark, sf):
    return doc_bow(spark, sf)


@query(f"WITH {BOW}, {VOCAB} SELECT row_number() OVER (ORDER BY token) - 1 AS token_id, token, totfreq FROM vocab")
def vocabulary(spark, sf):
    return tx.vocabulary_ids(doc_bow(spark, sf))


@query(f"WITH {BOW}, {SIZES} SELECT * FROM sizes")
def section_sizes(spark, sf):
    return tx.section_sizes(doc_bow(spark, sf))


@query(f"WITH {TOKENS} SELECT sum(len(tokens))::BIGINT AS corpus_size, count(*) AS n_sections FROM tok")
def corpus_size(spark, sf):
    return tx.corpus_size(doc_tokens(spark, sf))


@query(f"WITH {BOW}, {VOCAB}, {SIZES} SELECT token, section_id, freq, totfreq, size FROM bow JOIN vocab USING (token) JOIN sizes USING (section_id)")
def lexical_table(spark, sf):
    return tx.lexical_table(stored(doc_bow(spark, sf), "bags"))


MATRIX_LANGS = ["de", "en", "es", "fr"]


@query(f"""SELECT token, {', '.join(f"count(*) FILTER (lang = '{lang}') AS {lang}" for lang in MATRIX_LANGS)}
FROM (SELECT lang, unnest({sql_tokens('text')}) AS token FROM documents WHERE lang IN ({', '.join(f"'{lang}'" for lang in MATRIX_LANGS)})) GROUP BY token""")
def lexical_matrix(spark, sf):
    """One column for each of the languages that are asked for."""
    docs = heavy(spark, sf, "documents").where(F.col("lang").isin(MATRIX_LANGS))
    by_lang = tx.sections_by_row(docs, "lang", "lang", ["text"])
    return tx.lexical_matrix(tx.bag_of_words(tx.tokenize(by_lang)), MATRIX_LANGS)


# ------------------------------------------------------------------ specificity


@query(f"""WITH {BOW}, {VOCAB}, {SIZES}, {CELLS}, {sql_scored('cells', 'SELECT sum(freq) FROM bow', 'size')}
SELECT section_id, token, freq, totfreq, spec, log10p FROM scored WHERE freq > 0 OR spec <> 0""")
def specificity(spark, sf):
    return shown(tx.specificity(tx.sized_bag(doc_tokens(spark, sf)))).drop("size")


@query(f"""WITH {SOURCE_BOW}, {VOCAB}, {SIZES}, {CELLS}, {sql_scored('cells', 'SELECT sum(freq) FROM bow', 'size')}
SELECT section_id, token, freq, totfreq, size, spec, log10p FROM scored WHERE freq > 0 OR spec <> 0""")
def specificity_by_group(spark, sf):
    return shown(tx.specificity(source_bow(spark, sf)))


IN_SELECTION = "section_id IN ('src1', 'src2', 'src3')"
SELECTED = f"""{SOURCE_BOW}, totals AS (
  SELECT token, sum(freq)::BIGINT AS totfreq, coalesce(sum(freq) FILTER ({IN_SELECTION}), 0)::BIGINT AS freq FROM bow GROUP BY token),
selected AS (SELECT *, (SELECT sum(freq) FROM totals)::BIGINT AS size FROM totals),
{sql_scored('selected', 'SELECT sum(totfreq) FROM totals', 'size')}"""


@query(f"WITH {SELECTED} SELECT token, freq, totfreq, spec, log10p FROM scored")
def specificity_of_selection(spark, sf):
    return shown(tx.specificity_of_selection(source_bow(spark, sf), F.col("section_id").isin(SELECTION)))


@query(f"WITH {SELECTED} SELECT token, freq, totfreq, spec FROM scored WHERE regexp_matches(token, '^th')")
def token_table(spark, sf):
    return tx.token_table(source_bow(spark, sf), F.col("section_id").isin(SELECTION), "^th").drop("log10p")


@query(f"WITH {BOW} SELECT section_id, freq FROM bow WHERE token = '{WORD}'")
def sections_with_token(spark, sf):
    return tx.sections_with_token(doc_bow(spark, sf), WORD)


EVOLUTION = f"""{SOURCE_BOW}, per AS (
  SELECT section_id, sum(freq)::BIGINT AS size, coalesce(sum(freq) FILTER (token = '{WORD}'), 0)::BIGINT AS freq FROM bow GROUP BY section_id),
whole AS (SELECT *, (SELECT sum(freq) FROM per)::BIGINT AS totfreq FROM per),
{sql_scored('whole', 'SELECT sum(size) FROM per', 'size')}"""


@query(f"""WITH {EVOLUTION} SELECT section_id, size, freq, spec, log10p, min(spec) OVER () AS min_spec,
  max(spec) OVER () AS max_spec, max(freq) OVER () AS max_freq FROM scored""")
def token_evolution(spark, sf):
    return shown(tx.token_evolution(source_bow(spark, sf), WORD))


@query(f"WITH {EVOLUTION} SELECT section_id, freq, spec FROM scored WHERE spec > 0")
def sections_specific_over(spark, sf):
    return tx.sections_specific(tx.specificity(source_bow(spark, sf)), WORD, 1)


@query(f"WITH {EVOLUTION} SELECT section_id, freq, spec FROM scored WHERE spec < 0")
def sections_specific_under(spark, sf):
    return tx.sections_specific(tx.specificity(source_bow(spark, sf)), WORD, -1)


@query(f"""WITH {TOKENS} SELECT coalesce(sum(len(tokens)) FILTER (len(tokens) > 200), 0)::BIGINT AS selected_tokens,
  count(*) FILTER (len(tokens) > 200) AS selected_sections, sum(len(tokens))::BIGINT AS corpus_size FROM tok""")
def selection_summary(spark, sf):
    return tx.selection_summary(doc_tokens(spark, sf), F.size("tokens") > 200)


# ------------------------------------------------------------------ co-occurrence


@query(f"""WITH {TOKENS}, g AS (SELECT section_id, tokens, unnest(range(0, greatest(len(tokens) - 2, 0))) AS pos FROM tok)
SELECT section_id, pos::INTEGER AS pos, tokens[pos + 1] || ' ' || tokens[pos + 2] || ' ' || tokens[pos + 3] AS ngram FROM g""")
def token_ngrams(spark, sf):
    return tx.token_ngrams(doc_tokens(spark, sf), 3)


PAIRS = f"""pos AS (SELECT section_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i, len(tokens) AS size FROM tok),
dist AS (SELECT unnest(range(1, {WINDOW})) AS d),
near AS (SELECT a.token AS x, b.token AS y, a.i AS i, b.i AS j, a.size AS size
         FROM (SELECT * FROM pos, dist) a JOIN pos b ON a.section_id = b.section_id AND b.i = a.i + a.d)"""
COOC = TOKENS + ", " + PAIRS + """,
cooc AS (SELECT x, y, count(*) AS cooc FROM (SELECT x, y FROM near UNION ALL SELECT y, x FROM near) GROUP BY ALL)"""


@query(f"WITH {COOC} SELECT * FROM cooc")
def cooccurrences(spark, sf):
    return tx.cooccurrences(doc_tokens(spark, sf), WINDOW)


@query(f"""WITH {TOKENS}, {PAIRS}, w AS (
  SELECT x, y, greatest(0, least(i, size - {WINDOW}) - greatest(0, j - {WINDOW} + 1) + 1) AS n FROM near)
SELECT x, y, sum(n)::BIGINT AS cooc FROM (SELECT * FROM w UNION ALL SELECT y, x, n FROM w) WHERE n > 0 GROUP BY x, y""")
def cooccurrences_multi(spark, sf):
    return tx.cooccurrences_multi(doc_tokens(spark, sf), WINDOW)


GROUP_TOKENS = f"""tok AS (
  SELECT role AS section_id, string_split_regex(lower(string_agg(text || chr(10), '' ORDER BY conv_id, turn)), '{SQL_NON_WORD}') AS tokens
  FROM conversations GROUP BY role)"""


@query(f"""WITH {GROUP_TOKENS}, {PAIRS}
SELECT x, y, count(*) AS cooc FROM (SELECT x, y FROM near UNION ALL SELECT y, x FROM near) GROUP BY ALL""")
def cooccurrences_of_groups(spark, sf):
    pieces = tx.sections_by_group(table(spark, sf, "conversations"), "role", ["conv_id", "turn"], ["text"])
    tokens = tx.tokenize_groups(pieces, ["conv_id", "turn"])
    return tx.cooccurrences(tx.stretches(tokens, WINDOW), WINDOW)


def pairs(spark, sf, of=None):
    tokens = doc_tokens(spark, sf)
    return tx.cooccurrences(tokens, WINDOW, of), tx.vocabulary(tx.bag_of_words(tokens))


COLLOC = COOC + f""",
vocab AS (SELECT token, count(*) AS totfreq FROM pos GROUP BY token),
ccells AS (SELECT x AS token, y AS collocate, a.totfreq AS totfreq, b.totfreq AS collocate_freq,
             b.totfreq * {WINDOW} AS around, cooc
           FROM cooc JOIN vocab a ON x = a.token JOIN vocab b ON y = b.token),
{sql_scored('ccells', 'SELECT sum(totfreq) FROM vocab', 'around', 'cooc')}"""


@query(f"WITH {COLLOC} SELECT token, collocate, totfreq, cooc, spec, log10p FROM scored WHERE spec <> 0")
def collocation_specificity(spark, sf):
    tokens = doc_tokens(spark, sf)
    vocab = stored(tx.vocabulary(tx.bag_of_words(tokens)), "vocabulary")
    return shown(tx.collocation_specificity(tx.cooccurrences_with_totals(tokens, vocab, WINDOW), vocab, WINDOW))


@query(f"WITH {COLLOC} SELECT collocate, collocate_freq, cooc, spec FROM scored WHERE spec <> 0 AND token = '{WORD}' AND regexp_matches(collocate, 'e')")
def collocation_table(spark, sf):
    cooc, vocab = pairs(spark, sf, [WORD])
    vocab = stored(vocab, "vocabulary")
    spec = tx.collocation_specificity(cooc, vocab, WINDOW)
    return tx.collocation_table(spec, vocab, WORD, "e")


def word_graph(spark, sf):
    tokens = doc_tokens(spark, sf)
    vocab = stored(tx.vocabulary(tx.bag_of_words(tokens)), "vocabulary")  # read for each level
    return tx.collocation_graph_of(lambda words: stored(tx.cooccurrences(tokens, WINDOW, words), "pairs"), vocab, WINDOW, WORD)


GRAPH = COLLOC + f""",
best AS (SELECT token AS source, collocate AS target, spec,
           row_number() OVER (PARTITION BY token ORDER BY spec DESC, collocate DESC)::INTEGER AS rank FROM scored WHERE spec <> 0
         QUALIFY rank <= 5),
edges AS (SELECT *, 0 AS level, 'suit' AS type FROM best WHERE source = '{WORD}'
          UNION ALL
          SELECT *, 1, 'suit' FROM best WHERE source IN (SELECT target FROM best WHERE source = '{WORD}'))"""


@query(f"WITH {GRAPH} SELECT * FROM edges")
def collocation_graph(spark, sf):
    return word_graph(spark, sf)


@query(f"""WITH {GRAPH} SELECT label, min(level)::INTEGER AS level FROM (
  SELECT source AS label, level FROM edges UNION ALL SELECT target, level + 1 FROM edges) GROUP BY label""")
def graph_levels(spark, sf):
    return tx.graph_levels(word_graph(spark, sf), WORD)


@query(f"""WITH {GRAPH}, levels AS (SELECT label, min(level) AS level FROM (
  SELECT source AS label, level FROM edges UNION ALL SELECT target, level + 1 FROM edges) GROUP BY label)
SELECT (SELECT '[' || string_agg('{{"source":"' || source || '","target":"' || target || '","spec":' || spec || ',"type":"suit"}}', ',' ORDER BY level, source, rank) || ']' FROM edges) AS links,
  (SELECT '{{' || string_agg('"' || label || '":' || level, ',' ORDER BY label) || '}}' FROM levels) AS levels""")
def graph_json(spark, sf):
    return tx.graph_json(word_graph(spark, sf), WORD)


# ------------------------------------------------------------------ the stored index


def doc_index(spark, sf):
    path = scratch_path(spark, "index")
    positions.write_index(stored(doc_tokens(spark, sf), "tokens"), path, WINDOW)
    return positions.read_index(spark, path, WINDOW)


@query(f"WITH {TOKENS}, pos AS (SELECT section_id, unnest(tokens) AS token, unnest(range(len(tokens)))::INTEGER AS pos FROM tok) SELECT section_id, pos FROM pos WHERE token = '{WORD}'")
def token_positions(spark, sf):
    return positions.token_positions(doc_index(spark, sf), WORD)


@query(f"WITH {BOW} SELECT section_id, freq FROM bow WHERE token = '{WORD}'")
def index_sections_with_token(spark, sf):
    return positions.sections_with_token(doc_index(spark, sf), WORD)


@query(f"""WITH {BOW}, per AS (
  SELECT section_id, sum(freq)::BIGINT AS size, coalesce(sum(freq) FILTER (token = '{WORD}'), 0)::BIGINT AS freq FROM bow GROUP BY section_id),
whole AS (SELECT *, (SELECT sum(freq) FROM per)::BIGINT AS totfreq FROM per),
{sql_scored('whole', 'SELECT sum(size) FROM per', 'size')}
SELECT section_id, size, freq, spec, log10p, min(spec) OVER () AS min_spec, max(spec) OVER () AS max_spec, max(freq) OVER () AS max_freq FROM scored""")
def index_token_evolution(spark, sf):
    return shown(positions.token_evolution(doc_index(spark, sf), WORD))


@query(f"""WITH {TOKENS}, pos AS (SELECT section_id, tokens, unnest(range(len(tokens)))::INTEGER AS pos FROM tok)
SELECT section_id, pos FROM pos WHERE tokens[pos + 1] = 'of' AND tokens[pos + 2] = '{WORD}'""")
def index_phrase(spark, sf):
    return positions.phrase(doc_index(spark, sf), ["of", WORD])


@query(f"WITH {COLLOC} SELECT collocate, collocate_freq, cooc, spec FROM scored WHERE spec <> 0 AND token = '{WORD}' AND regexp_matches(collocate, 'e')")
def index_collocation_table(spark, sf):
    return positions.collocation_table(doc_index(spark, sf), WORD, "e")


# ------------------------------------------------------------------ display


@query(f"""WITH {sql_characters()},
words AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS token FROM documents) GROUP BY token),
symbols AS (SELECT * FROM words WHERE regexp_matches(token, '^[^\\p{{L}}\\p{{M}}\\p{{N}}_]+$')),
parts AS (SELECT token, unnest(string_split(token, '')) AS char, unnest(range(len(string_split(token, '')))) AS pos FROM symbols)
SELECT token, n, names FROM symbols JOIN (SELECT token, string_agg(char_name, ' - ' ORDER BY pos) AS names FROM parts JOIN characters USING (char) GROUP BY token) USING (token)""")
def describe_symbols(spark, sf):
    """Names of the characters of all tokens that consist of other signs than letters."""
    words = table(spark, sf, "documents").select(F.explode_outer(F.split("text", r"\s+")).alias("token"))
    return tx.describe_symbols(words.groupBy("token").agg(F.count("*").alias("n")))


# Word borders of the SQL engine are ASCII: the text is split into words and gaps instead.
@query(f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'),
  lambda w: CASE WHEN w = 'in' THEN '<span style=''color:red''>in</span>' ELSE w END), '') AS text FROM documents""")
def highlight(spark, sf):
    return table(spark, sf, "documents").select("doc_id", highlight_column(F.col("text"), "in").alias("text"))
