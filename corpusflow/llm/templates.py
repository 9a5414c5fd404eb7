"""Benchmark decontamination by templates: the same question with other numbers or names is still found.

A text becomes a sequence of template words: numbers, names and units give way to typed
placeholders. Windows of template words are joined with the benchmark's by their hash. Along a
line (document position minus item position) the values behind the placeholders must fit: a
value of the item stands for the same value of the document in most of its places.

Windows of few plain words would meet by chance, so they are not templates. For these, and for texts in
other cases, the pieces themselves are joined a second time, in lower case and with their values.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import bloom
from ..plans.checkpoints import cut
from .common import answer, stored, table, unused, without
from .features import CACHE

#: Template words of a window. Shorter texts are one window as they are.
WINDOW = 8
#: A window with fewer plain words says too little, unless its values are the item's.
LEAST_PLAIN = 4
#: Share of an item's windows that a document must hold.
COVERAGE = 0.4
#: Share of the placeholders along a line that must fit.
FITTING = 0.5

# Units that may follow a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres g kg mg t ton tons pound pounds ounce ounces lb lbs oz l ml "
    "liter liters litre litres gallon gallons s sec second seconds minute minutes min h hour hours day days week weeks month months year years "
    "percent % ° degrees degree dollar dollars cent cents euro euros $ € £ km/h mph kmh hz khz mhz ghz w kw v volts watts j joule joules "
    "tage tag stunden stunde minuten jahre jahr meter kilometer jours jour heures heure ans an mètres horas hora días día años año metros".split()
)
PIECE = re.compile(r"[-+]?\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[$€£%°]|[.!?\n…。！？]+")
ENDS = frozenset(".!?\n…。！？")
NUMBER, NAME, UNIT = "\x01number", "\x01name", "\x01unit"
#: Signs that tell short texts of numbers apart, where they stand between the pieces.
SIGN = re.compile(r"[-+*/=<>^×÷−%$€£]")
PLAIN, END, CAPITAL, DIGITS, MEASURE = range(5)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7)


HOLDER_HASHES = {word: word_hash(word) for word in (NUMBER, NAME, UNIT)}


def described(piece: str) -> tuple[int, str, int]:
    """What a piece of text can be, its form for comparison, and the hash of that."""
    kind, low = kind_of(piece)
    return kind, low, word_hash(low)


def kind_of(piece: str) -> tuple[int, str]:
    first = piece[0]
    if first in ENDS:
        return END, ""
    if first.isdigit() or first in "+-":
        return DIGITS, piece.lstrip("+")
    low = piece.lower()
    if low in UNITS:
        return MEASURE, low
    # words in capitals only are plain, and so are single letters
    return CAPITAL if first.isupper() and piece[1:].islower() else PLAIN, low


def pieces_of(text: str | None, known=described) -> list[tuple[int, str, int]]:
    return list(map(known, PIECE.findall(text or "")))


def template(text: str | None, known=described) -> tuple[list[str], list[int], list[str]]:
    """Template words of a text, the places of its placeholders, and the values that they stand for."""
    return template_of(pieces_of(text, known))[:3]


def template_of(pieces: list[tuple[int, str, int]], begins: bool = True) -> tuple[list[str], list[int], list[str], list[int]]:
    """The same from the pieces, and the hashes of the words.

    A capitalised word is a name unless it begins a sentence. Names that follow each other are one. A
    unit is one only right after a number.
    """
    words: list[str] = []
    places: list[int] = []
    values: list[str] = []
    hashes: list[int] = []
    for kind, low, hashed in pieces:
        if kind == PLAIN:
            words.append(low)
            hashes.append(hashed)
            begins = False
            continue
        if kind == END:
            begins = True
            continue
        if kind == DIGITS or (kind == MEASURE and words and words[-1] is NUMBER) or (kind == CAPITAL and not begins):
            word = NUMBER if kind == DIGITS else UNIT if kind == MEASURE else NAME
            if word is NAME and words and words[-1] is NAME:
                values[-1] += " " + low
            else:
                places.append(len(words))
                values.append(low)
                words.append(word)
                hashes.append(HOLDER_HASHES[word])
        else:
            words.append(low)
            hashes.append(hashed)
        begins = False
    return words, places, values, hashes


def other_readings(pieces: list[tuple[int, str, int]]) -> list[tuple[int, tuple]]:
    """How else a text may stand in another: within a line, where its first word may be a name, or in lower case."""
    lowered = [(PLAIN if kind == CAPITAL else kind, low, hashed) for kind, low, hashed in pieces]
    first = template_of(pieces)
    found = [(WITHIN, template_of(pieces, begins=False)), (LOWERED, template_of(lowered))]
    return [r for r in found if r[1] != first]


def spelled(pieces: list[tuple[int, str, int]]) -> list[int]:
    """The hashes of the pieces of a text in lower case, without ends of sentences."""
    return [hashed for kind, _, hashed in pieces if kind != END]


def signs_of(text: str, starts: list[int], length: int) -> list[str]:
    """The signs within the windows of ``length`` pieces that begin at ``starts``."""
    spans = [m.span() for m in PIECE.finditer(text) if m[0][0] not in ENDS]
    gaps = ["".join(SIGN.findall(text[a[1] : b[0]])) for a, b in zip(spans, spans[1:])]
    # a plus before a number may be taken for a part of it
    lead = ["+" if text[a] == "+" else "" for a, _ in spans]
    return [" ".join(gaps[k - 1] + lead[k] for k in range(i + 1, i + length)) for i in starts]


def judged(slots: list[tuple[int, str, str]]) -> tuple[float, int]:
    """Share of a line's ``(number, item's value, document's value)`` that fit, and the item's values that changed.

    A slot fits if it holds what its value stands for most often. Names are compared by their parts, so a
    full name and a part of it may stand for the same. Two values of the item may become one.
    """
    stands: dict[str, Counter] = {}
    split = [(a.split(" "), set(b.split(" "))) for _, a, b in slots]
    for parts, others in split:
        for part in parts:
            stands.setdefault(part, Counter()).update(others)
    usual = {part: min(c, key=lambda o: (-c[o], o)) for part, c in stands.items()}
    return sum(any(usual[p] in others for p in parts) for parts, others in split) / len(slots), len({a for _, a, b in slots if a != b})


class Windows:
    """Hashes of all windows of a text, by a polynomial over word hashes."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.powers = np.array([pow(0x9E3779B97F4A7C15 | 1, i, 1 << 64) for i in range(size)], np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        return self.of_hashes(list(map(word_hash, words)))

    def of_hashes(self, hashes: list[int], salt: int = 0) -> np.ndarray:
        n = len(hashes)
        size = min(self.size, n)
        if not n:
            return np.zeros(0, np.uint64)
        h = np.array(hashes, np.uint64)
        if size & (size - 1) == 0:
            # each round joins two halves of twice the length
            total, half = h, 1
            while half < size:
                total, half = total[:-half] + total[half:] * self.powers[half], half * 2
        else:
            total = np.zeros(n - size + 1, np.uint64)
            for i in range(size):
                total += h[i : n - size + 1 + i] * self.powers[i]
        # windows of another length must not meet these
        return (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size + salt)


#: Ways to read an item: as a template, by its pieces themselves, and as ``other_readings``.
TEMPLATE, SPELLED, WITHIN, LOWERED = range(4)
SALT = 1 << 32
SCHEMA = "_id long, reading int, pos int, h long, first int, slots array<string>, signs string, n int"
#: Pieces that are read together; a longer text stands alone.
SLICE = 1 << 17


class Pieces(dict):
    """Numbers for the different pieces of texts, and by number what ``described`` says of them."""

    def __init__(self) -> None:
        super().__init__()
        self.kinds, self.hashes, self.lows = np.zeros(1 << 16, np.int8), np.zeros(1 << 16, np.uint64), []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self.lows)
        if number == len(self.kinds):
            self.kinds, self.hashes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.kinds, self.hashes))
        self.kinds[number], low, self.hashes[number] = described(piece)
        self.lows.append(low)
        return number

    def bounded(self) -> None:
        """Forget all if that is much; numbers given before mean nothing then."""
        if len(self.lows) >= CACHE:
            self.clear()
            self.lows.clear()


def slices(keys: pd.Series, texts: pd.Series, known: Pieces) -> Iterator[tuple[list, Held]]:
    """Keys and pieces of some texts at a time."""
    held_keys, held_texts, numbers, total = [], [], [], 0
    for key, text in zip(keys, texts):
        found = PIECE.findall(text or "")
        if not found:
            continue
        held_keys.append(key)
        held_texts.append(text)
        numbers.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
        total += len(found)
        if total >= SLICE:
            yield held_keys, Held(held_texts, numbers, known)
            held_keys, held_texts, numbers, total = [], [], [], 0
            known.bounded()
    if held_keys:
        yield held_keys, Held(held_texts, numbers, known)
        known.bounded()


class Words:
    """Words of several texts, one after the other: hash, whether it is a placeholder, text, and first piece."""

    def __init__(self, hashes: np.ndarray, slot: np.ndarray, text: np.ndarray, piece: np.ndarray, texts: int) -> None:
        self.hashes, self.text, self.piece = hashes, text, piece
        self.slots_before = np.concatenate([[0], np.cumsum(slot)])
        self.counts = np.bincount(text, minlength=texts)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])[:-1]

    def windows(self, maker: Windows, shorter: bool, least_plain: int, salt: int, ask) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, first words and hashes of the maker's windows that have enough plain words and that ``ask`` lets pass.

        ``shorter``: a text of fewer words than a window is one window as it is.
        """
        size = maker.size
        if len(self.hashes) >= size:
            last = len(self.hashes) - size + 1
            yield from self._told(size, np.flatnonzero(self.text[:last] == self.text[size - 1 :]), maker.of_hashes(self.hashes, salt), least_plain, ask)
        for length in range(1, size) if shorter else ():
            at = self.offsets[self.counts == length]
            if len(at):
                hashes = np.zeros(len(self.hashes), np.uint64)
                hashes[at] = [Windows.of_hashes(maker, self.hashes[i : i + length], salt)[0] for i in at.tolist()]
                yield from self._told(length, at, hashes, least_plain, ask)

    def _told(self, length: int, at: np.ndarray, hashes: np.ndarray, least_plain: int, ask) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        slots = self.slots_before[at + length] - self.slots_before[at]
        at = at[length - slots >= min(least_plain, length)]
        if ask is not None and len(at):
            at = at[ask(hashes[at])]
        if len(at):
            yield length, at, hashes[at]


class Held:
    """The pieces of several texts, read as ``template_of`` reads those of one."""

    def __init__(self, texts: list[str], numbers: list[np.ndarray], known: Pieces) -> None:
        self.texts, self.known = texts, known
        all_numbers, text = np.concatenate(numbers), np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
        kinds = known.kinds[all_numbers]
        first = np.concatenate([[True], text[1:] != text[:-1]])
        ended = np.concatenate([[False], kinds[:-1] == END]) & ~first
        real = kinds != END
        # only the pieces that are words or parts of them; ``same``: the piece before is of the same text
        self.numbers, self.text, self.kinds = all_numbers[real], text[real], kinds[real]
        self.first, self.ended = first[real], ended[real]
        self.same = np.concatenate([[False], self.text[1:] == self.text[:-1]])[: len(self.text)]

    def words(self, reading: int) -> Words:
        hashes = self.known.hashes[self.numbers]
        n = len(hashes)
        if reading == SPELLED:
            return Words(hashes, np.zeros(n, bool), self.text, np.arange(n), len(self.texts))
        kinds = np.where(self.kinds == CAPITAL, np.int8(PLAIN), self.kinds) if reading == LOWERED else self.kinds
        begins = self.ended if reading == WITHIN else self.first | self.ended
        number, name = kinds == DIGITS, (kinds == CAPITAL) & ~begins
        before = np.concatenate([[False], number[:-1]])[:n] & self.same
        unit = (kinds == MEASURE) & before
        joined = name & self.same & np.concatenate([[False], name[:-1]])[:n]
        for told, word in ((number, NUMBER), (unit, UNIT), (name, NAME)):
            hashes[told] = HOLDER_HASHES[word]
        own = np.flatnonzero(~joined)
        return Words(hashes[own], (number | unit | name)[own], self.text[own], own, len(self.texts))

    def differs(self, reading: int) -> np.ndarray:
        """By text: is it read otherwise than as a template?"""
        if reading in (TEMPLATE, SPELLED):
            return np.ones(len(self.texts), bool)
        capital = self.kinds == CAPITAL
        told = capital & self.first if reading == WITHIN else capital & ~(self.first | self.ended)
        return np.bincount(self.text[told], minlength=len(self.texts)) > 0

    def values(self, words: Words, begin: int, end: int) -> list[str]:
        """What the placeholders among some words stand for."""
        before = words.slots_before
        if before[end] == before[begin]:
            return []
        borders = [*words.piece[begin : end + 1].tolist(), len(self.numbers)]
        return [
            " ".join(self.known.lows[k] for k in self.numbers[borders[i] : borders[i + 1]].tolist())
            for i in range(end - begin) if before[begin + i + 1] > before[begin + i]
        ]

    def signs(self, words: Words, at: np.ndarray, length: int) -> list[str]:
        found, of = [], words.text[at]
        for t in np.unique(of).tolist():
            found += signs_of(self.texts[t], (at[of == t] - words.offsets[t]).tolist(), length)
        return found


def windows_of(
    texts: DataFrame, size: int, least_plain: int, ask=None, short: tuple[int, ...] = (), spelled_short: tuple[int, ...] = ()
) -> DataFrame:
    """``_id, reading, pos, h, first, slots, signs, n``: windows of ``_id, text`` that ``ask`` lets pass; n windows in all.

    ``first`` is the number of the first of the ``slots`` within the text. ``signs`` are those within a
    spelled window of less than ``size`` pieces. ``short`` and ``spelled_short`` add windows of these lengths
    for texts that have more words (or pieces) than that.
    """

    lengths = {TEMPLATE: short, SPELLED: spelled_short}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        makers = {reading: [Windows(s) for s in sorted({size, *more}, reverse=True)] for reading, more in lengths.items()}
        known = Pieces()
        for batch in batches:
            for keys, held in slices(batch["_id"], batch["text"], known):
                out: dict[str, list] = {"_id": [], "reading": [], "pos": [], "h": [], "first": [], "slots": [], "signs": [], "n": []}
                # every reading of an item is looked up, so a document needs one only
                for reading in (TEMPLATE, SPELLED) if ask is not None else (TEMPLATE, WITHIN, LOWERED, SPELLED):
                    words = held.words(reading)
                    other = held.differs(reading)
                    least = 0 if reading == SPELLED else least_plain
                    for maker in makers[SPELLED if reading == SPELLED else TEMPLATE]:
                        for length, at, hashes in words.windows(maker, maker.size == size, least, SALT if reading == SPELLED else 0, ask):
                            kept = other[words.text[at]]
                            at, hashes = at[kept], hashes[kept]
                            signs = held.signs(words, at, length) if reading == SPELLED and length < size else [None] * len(at)
                            text, before = words.text[at], words.slots_before
                            out["_id"] += [keys[t] for t in text.tolist()]
                            out["reading"] += [reading] * len(at)
                            out["pos"] += (at - words.offsets[text]).tolist()
                            out["h"] += hashes.view(np.int64).tolist()
                            out["first"] += (before[at] - before[words.offsets[text]]).tolist()
                            out["slots"] += [held.values(words, i, i + length) for i in at.tolist()]
                            out["signs"] += signs
                            out["n"] += np.bincount(text)[text].tolist() if ask is None else [0] * len(at)
                if out["h"]:  # an empty column of lists has no type
                    kinds = {"_id": "int64", "reading": "int32", "pos": "int32", "h": "int64", "first": "int32", "n": "int32"}
                    yield pd.DataFrame(out).astype(kinds)

    return texts.mapInPandas(run, SCHEMA)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    coverage: float = COVERAGE,
    least_plain: int = LEAST_PLAIN,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    fitting: float = FITTING,
) -> DataFrame:
    """``doc_id, item_id, n_windows, coverage, changed_slots`` of documents that hold an item's template.

    A document holds an item if windows with the item's very values, or on lines where at least ``fitting``
    of the slots are consistent, cover at least ``coverage`` of the item's windows. ``changed_slots`` counts the item's values that stand for another one there: over
    zero, the question was re-parameterised. The same share of windows of the text as it is spelled, whatever
    the case, will do as well: so an item of fewer than ``least_plain`` plain words is found with its own
    values. An item is read as the start of a sentence, as a part of one and in lower case, each with its own
    windows. The largest coverage is given. Rows without id and null or empty texts match nothing. Rows that repeat an id are one document (or item).

    The benchmark's window hashes go into a bit map of bounded size, whatever the benchmark's; only
    windows of documents that pass it are joined, by hash, with the windows themselves.
    """
    pick = lambda df, key, text: df.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("text")).where("_id IS NOT NULL")
    items = stored(windows_of(pick(benchmark, item_col, text_col), size, least_plain), "items")
    items = items.groupBy("_id", "reading", "pos", "h", "first", "slots", "signs").agg(F.max("n").alias("n"))
    lengths = pick(benchmark, item_col, text_col).mapInPandas(_short_lengths(size), "reading int, length int").distinct().collect()
    short, spelled_short = (tuple(sorted(r.length for r in lengths if r.reading == k)) for k in (TEMPLATE, SPELLED))  # at most size - 1 each
    hashes = items.select("h")
    bits, _ = bloom.map_bits(hashes.count(), 64)  # every window of a document is asked: few should pass by chance
    ask = bloom.asks(docs, bloom.repeated_map(stored(hashes.unionAll(hashes), "hashes"), "h", bits))
    found = windows_of(pick(docs, id_col, text_col), size, least_plain, ask, short, spelled_short)
    wanted = items.select(F.col("_id").alias("item_id"), "reading", F.col("pos").alias("at"), "h", "first", F.col("slots").alias("item_slots"), F.col("signs").alias("item_signs"), "n")
    met = cut(
        found.select("_id", "pos", "h", "slots", "signs").join(wanted, "h")
        .where((F.size("slots") == F.size("item_slots")) & F.col("signs").eqNullSafe(F.col("item_signs")))
        .withColumn("line", F.col("pos") - F.col("at"))
    )
    keys = ["_id", "item_id", "reading", "line"]
    zipped = met.select(*keys, "first", F.posexplode(F.arrays_zip("item_slots", "slots")).alias("i", "s"))
    slots = zipped.groupBy(*keys).agg(F.collect_set(F.struct((F.col("first") + F.col("i")).alias("number"), "s.item_slots", "s.slots")).alias("line_slots"))
    judge = F.udf(judged, "share double, changed int")  # a line has no more slots than the item
    lines = slots.withColumn("told", judge("line_slots")).select(*keys, (F.col("told.share") >= fitting).alias("fits"), "told.changed")
    # what is the item's to the letter needs no other slots to fit
    same = F.col("slots") == F.col("item_slots")
    held = met.join(lines, keys, "left").where(same | F.col("fits")).withColumn("changed", F.when(same, 0).otherwise(F.col("changed")))
    share = F.col("n_windows") / F.col("n")
    return (
        held.groupBy("_id", "item_id", "reading", "at").agg(F.max("n").alias("n"), F.min(F.coalesce("changed", F.lit(0))).alias("changed"))
        .groupBy("_id", "item_id", "reading").agg(F.count("*").alias("n_windows"), F.max("n").alias("n"), F.max("changed").alias("changed_slots"))
        .groupBy("_id", "item_id").agg(F.max(F.struct(share.alias("coverage"), -F.col("changed_slots"), "n_windows", "changed_slots")).alias("best"))
        .where(F.col("best.coverage") >= coverage)
        .select(F.col("_id").alias("doc_id"), "item_id", "best.n_windows", "best.coverage", "best.changed_slots")
    )


def _short_lengths(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = set()
            for pieces in map(pieces_of, batch["text"]):
                found |= {(TEMPLATE, len(r[1][0])) for r in [(TEMPLATE, template_of(pieces)), *other_readings(pieces)]} | {(SPELLED, len(spelled(pieces)))}
            yield pd.DataFrame([p for p in sorted(found) if 0 < p[1] < size], columns=["reading", "length"]).astype("int32")

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    gone = contaminated(docs, benchmark, id_col=id_col, **settings).select(F.col("doc_id").alias(unused(docs, "gone")))
    return without(docs, gone, id_col)


@answer()
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
