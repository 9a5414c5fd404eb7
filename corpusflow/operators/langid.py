"""Language identification: script rules, then character-trigram profiles.

Texts are ``(id, text)`` with unique ids. Grams and characters are counted and ranked within the row by one
Arrow function, so a text is read once and never shuffled; scores are sums over its known grams.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import spark_regex
from ..plans.checkpoints import stored
from ..plans.skew import lookup_join

# Gram length, profile size, number of characters looked at for
# the script, weight scale.
GRAM = 3
PROFILE_SIZE = 500
SCRIPT_CHARS = 200
SCALE = 1_000_000
# Fixed values: (category, first word of the character name) -> language, or
# "ngram" where profiles decide.
SCRIPT_RULES = [
    ("Lo", "CJK", "zh"),
    ("Lo", "HANGUL", "ko"),
    ("Lo", "HIRAGANA", "ja"),
    ("Lo", "KATAKANA", "ja"),
    ("Ll", "GREEK", "el"),
    ("Lu", "GREEK", "el"),
    ("Lo", "GUJARATI", "gu"),
    ("Lo", "GEORGIAN", "ka"),
    ("Lo", "BENGALI", "bn"),
    ("Lo", "TAMIL", "ta"),
    ("Lo", "THAI", "th"),
    ("Lo", "THAANA", "dv"),
    ("Lo", "DEVANAGARI", "ngram"),
    ("Ll", "CYRILLIC", "ngram"),
    ("Lu", "CYRILLIC", "ngram"),
    ("Lo", "ARABIC", "ngram"),
    ("Ll", "LATIN", "ngram"),
    ("Lu", "LATIN", "ngram"),
]
# Names of languages by code.
LANGUAGE_NAMES = {
    "af": "Afrikaans", "als": "Alsatian", "ar": "Arabic", "az": "Azerbaijan", "be": "Belorussian", "bg": "Bulgarian", "bi": "Bislama",
    "bn": "Bengali", "br": "Breton", "bs": "Bosnian", "ca": "Catalan", "cdo": "Cantonese (Roman script)", "chr": "Cherokee",
    "co": "Corsican", "cs": "Czech", "csb": "Kashubian", "cy": "Welsh", "da": "Danish", "de": "German", "dk": "Danish", "dv": "Dhivehi",
    "el": "Greek", "en": "English", "eo": "Esperanto", "es": "Spanish", "et": "Estonian", "eu": "Basque", "fa": "Persian",
    "fi": "Finnish", "fo": "Faroese", "fr": "French", "fy": "Frisian", "ga": "Irish Gaelic", "gd": "Scottish Gaelic", "gl": "Galician",
    "gn": "Guarani", "gu": "Gujarati", "gv": "Manx", "he": "Hebrew", "hi": "Hindi", "hr": "Croatian", "hu": "Hungarian",
    "ia": "Interlingua", "id": "Indonesian", "io": "Ido", "is": "Icelandic", "it": "Italian", "ja": "Japanese", "jv": "Javanese",
    "ka": "Georgian", "km": "Khmer", "ko": "Korean", "ks": "Kashmiri", "ku": "Kurdish", "la": "Latin", "lt": "Latvian", "lv": "Livonian",
    "mg": "Malagasy", "mi": "Maori", "minnan": "Min-Nan", "mk": "Macedonian", "ml": "Malayalam", "mn": "Mongolian", "mr": "Marathi",
    "ms": "Malay", "na": "Nauruan", "nah": "Nahuatl", "nb": "Norwegian (Bokmal)", "nds": "Lower Saxon", "nl": "Dutch", "no": "Norwegian",
    "nn": "Norwegian (Nynorsk)", "oc": "Occitan", "om": "Oromo", "pcm": "Naija", "pl": "Polish", "ps": "Pashto", "pt": "Portuguese",
    "ro": "Romanian", "roa-rup": "Aromanian", "ru": "Russian", "sa": "Sanskrit", "sh": "OBSOLETE, Serbocroatian", "si": "Sinhalese",
    "simple": "Simple English", "sk": "Slovakian", "sl": "Slovenian", "sq": "Albanian", "sr": "Serbian", "st": "Sesotho", "su": "Sundanese",
    "sv": "Swedish", "sw": "Swahili", "ta": "Tamil", "th": "Thai", "tl": "Tagalog", "tlh": "Klingon", "tokipona": "Toki Pona",
    "tpi": "Tok Pisin", "tr": "Turkish", "tt": "Tatar", "uk": "Ukrainian", "ur": "Urdu", "uz": "Uzbek", "vi": "Vietnamese", "vo": "Volapuk",
    "wa": "Walon", "xh": "isiXhosa", "yi": "Yiddish", "yo": "Yoruba", "wo": "Wolof", "za": "Zhuang", "zh": "Chinese",
    "zh-cn": "Simplified Chinese", "zh-tw": "Traditional Chinese",
}
# What is said of a text or a code without known language.
UNKNOWN_LANGUAGE = "unknown language! information: "
UNKNOWN_NAME = "an unknown language, maybe "
RIGHT_TO_LEFT = ["Arabic", "Hebrew", "Pashto", "Persian", "Urdu"]


# ------------------------------------------------------------------ grams and profiles


def _weight(length: Column) -> Column:
    """What one gram adds; at least 1, so very long texts keep their grams."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.lit(SCALE) / length))


FEATURES = "id {id}, chars long, total long, category string, script string, grams array<struct<gram:string,weight:long,gram_rank:int>>"
#: Grams of a batch that leaves a task: the features of 10,000 texts at once take gigabytes as Python values.
BATCH_GRAMS = 1 << 16
#: Characters whose grams are counted at a time for a profile.
BATCH_CHARS = 1 << 22
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _script_of(text: str) -> tuple[str, str]:
    """Category and first word of the name that are most common among the most frequent characters."""
    if len(text) < 2:
        return "", ""
    # the last character is not counted, as for all n-grams
    counts = Counter(re.sub(f"[{SPACES}]+", " ", text)[:-1])
    ranked = sorted(counts.items(), key=lambda c: (c[1], c[0]), reverse=True)[:SCRIPT_CHARS]
    best = []
    for fact in (unicodedata.category, lambda c: unicodedata.name(c, "").partition(" ")[0]):
        seen: dict[str, list[int]] = {}
        for place, (char, _) in enumerate(ranked):
            if value := fact(char):
                seen.setdefault(value, []).append(place)
        # on a tie the value that appears later in the ranking wins
        best.append(max(seen, key=lambda v: (len(seen[v]), seen[v][0]), default=""))
    return best[0], best[1]


def _feature_batches(batches: Iterator[pa.RecordBatch], n: int, top: int | None) -> Iterator[pa.RecordBatch]:
    """Features of batches ``(id, text, seen)``; a text is a Python value only while it is read, and a batch that leaves has about ``BATCH_GRAMS`` grams."""
    blanks = re.compile(f"[{SPACES}]+")
    for batch in batches:
        start, facts, ends = 0, [], [0]
        grams, weights, ranks = [], array("q"), array("i")
        for i in range(batch.num_rows):
            text, seen = batch.column("text")[i].as_py(), batch.column("seen")[i].as_py()
            total = 0
            if text:
                padded = blanks.sub("_", f" {text} ")
                counts = Counter(map("".join, zip(*[padded[j : len(padded) - n + j] for j in range(n)])))
                heaviest = sorted(counts.items(), key=lambda g: (g[1], g[0]), reverse=True)[:top]
                add = max(1, SCALE // len(text))
                grams += [g for g, _ in heaviest]
                weights.extend(c * add for _, c in heaviest)
                ranks.extend(range(1, len(heaviest) + 1))
                total = add * sum(c for _, c in heaviest)
            facts.append((len(text or ""), total, *_script_of(seen or "")))
            ends.append(len(grams))
            if len(grams) >= BATCH_GRAMS or i + 1 == batch.num_rows:
                entries = pa.StructArray.from_arrays(
                    [pa.array(grams, pa.string()), pa.array(weights, pa.int64()), pa.array(ranks, pa.int32())], names=["gram", "weight", "gram_rank"]
                )
                columns = [pa.array(c, t) for c, t in zip(zip(*facts), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, len(facts)), *columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)],
                    names=["id", "chars", "total", "category", "script", "grams"],
                )
                start, facts, ends = i + 1, [], [0]
                grams, weights, ranks = [], array("q"), array("i")


def text_features(texts: DataFrame, n: int = GRAM, top: int | None = PROFILE_SIZE, looked_at: Column | None = None) -> DataFrame:
    """``(id, chars, total, category, script, grams)``: what is known of a text by itself.

    ``grams`` are its heaviest ``top`` with their weights and ranks, ties by gram; ``total`` sums the weights; the script is that of
    ``looked_at``, or of the text.
    """
    chosen = texts.select("id", "text", (F.col("text") if looked_at is None else looked_at).alias("seen"))
    schema = FEATURES.format(id=chosen.schema["id"].dataType.simpleString())
    return chosen.mapInArrow(lambda batches: _feature_batches(batches, n, top), schema)


def known_grams(profiles: DataFrame) -> tuple[list[str | None], list[int], dict[str, dict[int, int]]]:
    """Languages, the language of each column, and the weights of each gram by column; ``PROFILE_SIZE`` grams of a language at most.

    A gram that a profile lists again has a further column.
    """
    langs: dict[str | None, int] = {}
    columns: dict[tuple[str | None, int], int] = {}
    known: dict[str, dict[int, int]] = {}
    for lang, gram, weight in profiles.select("lang", "gram", F.col("weight").cast("long")).toLocalIterator():
        langs.setdefault(lang, len(langs))
        if gram is not None and weight is not None:
            again = 0
            while columns.setdefault((lang, again), len(columns)) in known.setdefault(gram, {}):
                again += 1
            known[gram][columns[lang, again]] = weight
    return list(langs), [langs[lang] for lang, _ in columns], known


def _shift_batches(batches: Iterator[pa.RecordBatch], langs: int, owners: list[int], known: dict[str, dict[int, int]]) -> Iterator[pa.RecordBatch]:
    """Batches of :func:`_feature_batches` with, in place of the grams, the sum of ``|profile - weight| - weight`` over known grams by language."""
    names = pa.array([*known], pa.string())
    weights, there = np.zeros((len(owners), len(known)), np.int64), np.zeros((len(owners), len(known)), bool)
    for i, columns in enumerate(known.values()):
        for column, weight in columns.items():
            weights[column, i], there[column, i] = weight, True
    for batch in batches:
        grams = batch.column("grams")
        ends = np.asarray(grams.offsets) - grams.offsets[0].as_py()
        entries = grams.flatten()
        found = pc.index_in(entries.field("gram"), value_set=names)
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        gram = found.drop_null().to_numpy().astype(np.int64)
        weight = entries.field("weight").to_numpy()[at]
        row = np.searchsorted(ends[1:], at, side="right")
        sums = np.zeros((batch.num_rows, langs), np.int64)
        for column, owner in enumerate(owners):
            has = there[column, gram]
            shift = np.abs(weights[column, gram[has]] - weight[has]) - weight[has]
            np.add.at(sums[:, owner], row[has], shift)
            # every text has the empty gram, with weight 0
            sums[:, owner] += abs(known.get("", {}).get(column, 0))
        offsets = pa.array(np.arange(batch.num_rows + 1) * langs, pa.int32())
        shifts = pa.ListArray.from_arrays(offsets, pa.array(sums.ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], shifts], names=[*batch.schema.names[:-1], "shifts"])


def scored_features(texts: DataFrame, profiles: DataFrame, looked_at: Column | None = None) -> tuple[DataFrame, list[str | None]]:
    """As :func:`text_features`, with ``shifts`` in place of the grams, which never leave the task: a number for each of the languages."""
    langs, owners, known = known_grams(profiles)
    chosen = texts.select("id", "text", (F.col("text") if looked_at is None else looked_at).alias("seen"))
    schema = f"id {chosen.schema['id'].dataType.simpleString()}, chars long, total long, category string, script string, shifts array<long>"
    return chosen.mapInArrow(lambda batches: _shift_batches(_feature_batches(batches, GRAM, PROFILE_SIZE), len(langs), owners, known), schema), langs


def char_ngrams(texts: DataFrame, n: int = GRAM, top: int | None = PROFILE_SIZE) -> DataFrame:
    """``(id, gram, weight, gram_rank)`` of each non-empty text, the heaviest ``top`` with ties by gram."""
    return text_features(texts, n, top).select("id", F.inline("grams"))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, gram, n`` of batches ``(lang, text)``: all grams of a text but the last one, as numbers of three code points."""
    blanks = re.compile(f"[{SPACES}]+")

    def counted(lang: str | None, texts: list[str]) -> pa.RecordBatch:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        keys = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
        # a gram that would reach into the next text, or be the last of its own, is none
        ends = np.cumsum([len(t) for t in texts])
        kept = np.ones(len(points), bool)
        for back in range(1, GRAM + 1):
            kept[ends - back] = False
        found, n = np.unique(keys[kept[: len(keys)]], return_counts=True)
        codes = np.stack([found >> 42, (found >> 21) & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype("<u4")
        whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
        grams = [whole[i : i + GRAM] for i in range(0, len(whole), GRAM)]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    for batch in batches:
        texts: dict[str | None, list[str]] = {}
        sizes: Counter[str | None] = Counter()
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            lang, padded = lang.as_py(), blanks.sub("_", f" {text.as_py()} ")
            if len(padded) <= GRAM:  # only a last gram, or none
                continue
            texts.setdefault(lang, []).append(padded)
            sizes[lang] += len(padded)
            if sizes[lang] >= BATCH_CHARS:
                yield counted(lang, texts.pop(lang))
                del sizes[lang]
        for lang, rest in texts.items():
            yield counted(lang, rest)


def train_profiles(labelled: DataFrame) -> DataFrame:
    """``(lang, gram, weight)``: the heaviest grams of all texts ``(lang, text)`` of a language.

    Each text is padded on its own and the weight of a gram is scaled by the characters of the
    language. Counts are combined before the shuffle and the ranking is limited before it too.
    """
    sizes = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    counted = (
        labelled.where(F.length("text") > 0).select("lang", "text").mapInArrow(_gram_counts, "lang string, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    w = Window.partitionBy("lang").orderBy(F.desc("n"), F.desc("gram"))
    top = counted.withColumn("gram_rank", F.row_number().over(w)).where(F.col("gram_rank") <= PROFILE_SIZE)
    return top.join(sizes, "lang").select(
        "lang",
        "gram",
        # beyond SCALE characters the rounded weight of one gram would be 0
        F.when(F.col("chars") <= SCALE, F.col("n") * F.floor(F.lit(SCALE) / F.col("chars")))
        .otherwise(F.floor(F.lit(SCALE) * F.col("n") / F.col("chars")))
        .alias("weight"),
    )


def register_language(profiles: DataFrame, code: str, text: DataFrame) -> DataFrame:
    """Add or replace one profile, trained on ``text(text)``."""
    new = train_profiles(text.select(F.lit(code).alias("lang"), "text"))
    return profiles.where(F.col("lang") != code).unionByName(new)


# ------------------------------------------------------------------ distances


def profile_distance(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(id, lang, score)`` for every language, 100 at best."""
    return _distances(*scored_features(texts, profiles))


def _distances(features: DataFrame, langs: list[str | None]) -> DataFrame:
    """Scores from :func:`scored_features`.

    The distance sums |profile - text| over the text's heaviest grams. Grams that a profile does not know
    contribute their own weight, which is one sum per text; what the known ones change comes with the text,
    for all languages in one row.
    """
    sums = F.array(*[F.sum(F.get("shifts", F.lit(i))) for i in range(len(langs))]).cast("array<long>").alias("shifts")
    languages = F.array(*[F.lit(lang) for lang in langs]).cast("array<string>")
    distance = F.col("total") + F.col("shift")
    return (
        features.where(F.col("chars") > 0)
        .groupBy("id", "chars", "total").agg(F.count("*").alias("n"), sums)
        .select("id", "chars", "total", F.inline(F.arrays_zip(languages.alias("lang"), F.col("shifts").alias("shift"))).alias("lang", "shift"))
        .select("id", "lang", ((distance / _weight(F.col("chars")) / F.col("chars") - 1) * -100).alias("score"))
    )


def best_profile(distances: DataFrame) -> DataFrame:
    best = F.max(F.struct("score", "lang")).alias("b")
    return distances.groupBy("id").agg(best).select("id", "b.score", "b.lang")


# ------------------------------------------------------------------ scripts


def strip_digits_punct(text: Column) -> Column:
    return F.regexp_replace(text, spark_regex(r"[\d\W]+"), " ")


def dominant_script(texts: DataFrame) -> DataFrame:
    """``(id, category, script)``: most common among a text's most frequent characters.

    Each distinct character counts once. On a tie the value that appears later in the
    ranking of characters wins. Texts of fewer than two characters have neither.
    """
    return text_features(texts, top=0).select("id", "category", "script")


# ------------------------------------------------------------------ guesses


def _rule(category: Column, script: Column) -> Column:
    out = F.lit(None).cast("string")
    for cat, word, lang in reversed(SCRIPT_RULES):
        out = F.when((category == cat) & (script == word), F.lit(lang)).otherwise(out)
    return out


def _ruled(texts: DataFrame, profiles: DataFrame, remove_punct: bool) -> tuple[DataFrame, list[str | None]]:
    """Features with the rule of the script; read twice, so they are stored: a number for each language, not the grams."""
    looked_at = strip_digits_punct(F.col("text")) if remove_punct else None
    features, langs = scored_features(texts, profiles, looked_at)
    return stored(features, "features").withColumn("rule", _rule(F.col("category"), F.col("script"))), langs


def guess_language(texts: DataFrame, profiles: DataFrame, remove_punct: bool = False) -> DataFrame:
    """``(id, score, lang)``: by script rule where one is certain, else the best profile."""
    ruled, langs = _ruled(texts, profiles, remove_punct)
    best = best_profile(_distances(ruled.where("rule = 'ngram'"), langs)).select(
        "id", F.col("score").alias("best_score"), F.col("lang").alias("best_lang")
    )
    unknown = F.concat(F.lit(UNKNOWN_LANGUAGE), F.col("category"), F.lit(" "), F.col("script"))
    by_profile = (F.col("rule") == "ngram") & F.col("best_lang").isNotNull()
    certain = F.col("rule") != "ngram"
    return ruled.select("id", "category", "script", "rule").join(best, "id", "left").select(
        "id",
        F.when(by_profile, F.col("best_score")).when(certain, F.lit(100.0)).otherwise(F.lit(0.0)).alias("score"),
        F.when(by_profile, F.col("best_lang")).when(certain, F.col("rule")).otherwise(unknown).alias("lang"),
    )


def guess_language_list(texts: DataFrame, profiles: DataFrame, remove_punct: bool = False) -> DataFrame:
    """Like :func:`guess_language` but with every profile, best first by ``place``."""
    ruled, langs = _ruled(texts, profiles, remove_punct)
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("lang"))
    by_profile = _distances(ruled.where("rule = 'ngram'"), langs).select("id", F.row_number().over(w).alias("place"), "score", "lang")
    unknown = F.concat(F.lit(UNKNOWN_LANGUAGE), F.col("category"), F.lit(" "), F.col("script"))
    others = ruled.where(F.coalesce(F.col("rule") != "ngram", F.lit(True))).select(
        "id", F.lit(1).alias("place"),
        F.when(F.col("rule").isNotNull(), F.lit(100.0)).otherwise(F.lit(0.0)).alias("score"),
        F.coalesce("rule", unknown).alias("lang"),
    )
    return by_profile.unionByName(others)


def language_name(code: Column, names: dict[str, str] = LANGUAGE_NAMES) -> Column:
    """The name of a code; null for a code without name."""
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.try_element_at(table, code)


def guess_language_name(texts: DataFrame, profiles: DataFrame, names: dict[str, str] = LANGUAGE_NAMES) -> DataFrame:
    """``(id, name)``: the guessed language by its name; an unknown one is told by category and script."""
    facts = dominant_script(texts).select("id", F.concat(F.lit("('"), "category", F.lit("', '"), "script", F.lit("')")).alias("_facts"))
    return guess_language(texts, profiles).join(facts, "id").select(
        "id", F.coalesce(language_name(F.col("lang"), names), F.concat(F.lit(UNKNOWN_NAME), "_facts")).alias("name")
    )


def language_filter(texts: DataFrame, profiles: DataFrame, name: str, names: dict[str, str] = LANGUAGE_NAMES) -> DataFrame:
    """Ids of the texts whose language has this name, punctuation not counted for the script."""
    return guess_language(texts, profiles, remove_punct=True).where(language_name(F.col("lang"), names) == name)


def keep_language_paragraphs(texts: DataFrame, profiles: DataFrame, lang: str) -> DataFrame:
    """Only the lines of a text that are in the language, each with its newline.

    Equal lines are judged once per corpus, and lines go back to their own text only.
    """
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.withColumn("line_key", F.substring(F.unhex(F.sha2("line", 256)), 1, 16))
    # 128 bits of a line and its number travel; its text is judged where it was counted
    distinct = stored(keyed.groupBy("line_key", "line").agg(F.count("*").alias("n")), "lines")
    guessed = guess_language(distinct.select(F.col("line_key").alias("id"), F.col("line").alias("text")), profiles)
    good = guessed.where(F.col("lang") == lang).select(F.col("id").alias("line_key"))
    counted = good.join(distinct.select("line_key", "n"), "line_key").withColumn("good", F.lit(True))
    # one line may be repeated in a large share of all texts
    kept = (
        lookup_join(keyed, counted, "line_key", "good", F.col("n"), F.hash("id", "pos"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
        .select("id", F.array_join(F.transform("l", lambda s: F.concat(s["line"], F.lit("\n"))), "").alias("text"))
    )
    return texts.select("id").join(kept, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def text_direction(sample: DataFrame, profiles: DataFrame) -> DataFrame:
    """RTL for a sample ``(id, text)`` in a right-to-left language; short samples are LTR."""
    guessed = guess_language(sample, profiles)
    return sample.join(guessed, "id").select(
        "id",
        F.when(
            (F.length("text") >= 10) & language_name(F.col("lang")).isin(RIGHT_TO_LEFT), "RTL"
        ).otherwise("LTR").alias("direction"),
    )


def supported_languages(spark: SparkSession, profiles: DataFrame) -> DataFrame:
    """Codes that rules or profiles can give, with their names."""
    fixed = spark.createDataFrame([(lang,) for _, _, lang in SCRIPT_RULES if lang != "ngram"], "lang string")
    codes = fixed.unionByName(profiles.select("lang")).distinct()
    return codes.select("lang", F.coalesce(language_name(F.col("lang")), "lang").alias("name")).orderBy("lang")


def language_confusion(guesses: DataFrame, gold: DataFrame) -> DataFrame:
    """Counts of ``(lang, guess)`` for labelled texts ``(id, lang)``."""
    return (
        gold.join(guesses.select("id", F.col("lang").alias("guess")), "id")
        .groupBy("lang", "guess")
        .agg(F.count("*").alias("n"))
    )
