"""Token-id shards with a minimal perfect hash index for access by document key.

Files below one folder, all little-endian:

``shards/<name>.ids``   ids of the shard's documents one after the other, 16-bit where every id fits, else 32-bit
``shards/<name>.off``   64-bit starts of the documents within the shard, and its length at the end
``index/<part>.mph``    minimal perfect hash of the keys of one part of the key space, and one entry per key
``rows``                Parquet table of (doc_id, shard, row, n_tokens), the input of the index
``manifest.json``       width of ids, shards in order with their first token, index parts

A shard holds a range of keys in ascending order, so all shards in order hold all documents in
order. The index stores for each slot a fingerprint of the key, the shard, the row, and the number
of documents with that key (they are neighbours). A look-up reads one slot whatever the number of keys.

Tasks write under a name of their own attempt; the manifest names the files of the attempts that
counted, so a task that ran twice leaves an unused file and nothing else.
"""

from __future__ import annotations

import json
import re
import string
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answer, scratch_path, table, text_of

ROWS = "doc_id long, shard long, row long, n_tokens long, file string"
#: Keys of one index part: bounds the memory of the task that builds it or reads it.
KEYS_PER_PART = 100_000
#: Words that each of the two memories of a worker keeps.
MOST_WORDS = 600_000
#: Code points of text that are encoded at a time.
SLICE = 1 << 22
#: Bytes between words: of ASCII white space, which the tokenizer drops and never joins across.
#: Letters that the tokenizer's lower case may compose or split; words of them are not cut.
SPECIAL = r"[^\x00-\x{12F}\x{131}-\x{24F}]"
WHITE = re.compile(r"[\t-\r ]")
BETWEEN = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Slots per key and level of the perfect hash.
LOAD = 2.0


# ------------------------------------------------------------------ files


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_file(uri: str, chunks: Iterator[bytes] | list[bytes]) -> None:
    fs, path = _fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)


def read_file(uri: str) -> bytes:
    fs, path = _fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


# ------------------------------------------------------------------ encoding


#: Encodes pieces of text: all ids one after the other, and their number for each piece.
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class Remembered:
    """A bounded memory of two generations: what was asked for lately outlives the rest."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def __getitem__(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self[key] = found
        return found

    def __setitem__(self, key, value) -> None:
        if len(self.young) >= MOST_WORDS // 2:
            self.old, self.young = self.young, {}
        self.young[key] = value


def words_between(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII white space, each with the byte behind it: the number of each one's text, and the words."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = ~BETWEEN[joined]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    first, mark = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), first, "right")
    inside[mark] = True
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(mark - first + 1, out=offsets[1:])
    return of, pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])])


def parted(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Stem of letters in lower case, and the ASCII punctuation behind it; a word of another kind is all tail."""
    stems = pc.ascii_rtrim(words, characters=string.punctuation)
    plain = pc.and_(pc.utf8_is_alpha(stems), pc.invert(pc.match_substring_regex(stems, SPECIAL)))
    stems = pc.if_else(plain, stems, "")
    length, begins = pc.binary_length(stems).to_numpy(), np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: begins[-1]]
    edge = np.bincount(begins[:-1] + length, minlength=len(data) + 1) - np.bincount(begins[1:], minlength=len(data) + 1)
    offsets = np.concatenate([[0], np.cumsum(np.diff(begins) - length)]).astype(np.int32)
    tails = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(edge)[:-1] > 0])])
    return pc.utf8_lower(stems), tails


@lru_cache(maxsize=2)  # a worker keeps its memories from task to task
def word_encoder(tokenizer_file: str, dtype: str) -> Encoder:
    """Ids of texts by a tokenizer that ends tokens at white space, which encodes each distinct word once.

    The tokenizer of this kind drops white space and never joins across it, so a text's ids are the
    ids of its words in order. A word of letters with ASCII punctuation after it is again two pieces.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    known = Remembered()

    def ids_of(each: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype).tobytes() for e in tokenizer.encode_batch_fast(each, add_special_tokens=False)]

    stop = ids_of(["."])[0]

    def ids_of_stems(stems: list[str]) -> list[bytes]:
        """Words of letters are pieces of their own for the tokenizer: all of them go through it as one text, with a stop between two."""
        ids = np.array(tokenizer.encode_batch_fast([".".join(stems)], add_special_tokens=False)[0].ids, dtype)
        stops = np.flatnonzero(ids == np.frombuffer(stop, dtype)[0])
        if len(stop) != ids.itemsize or len(stops) != len(stems) - 1:  # a tokenizer that has no token for it alone
            return ids_of(stems)
        raw, size = ids.tobytes(), ids.itemsize
        return [raw[a:b] for a, b in zip([0, *((stops + 1) * size).tolist()], [*(stops * size).tolist(), len(raw)])]

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        of, found = words_between(texts)
        coded = found.dictionary_encode()
        stems, tails = parted(pc.ascii_rtrim_whitespace(coded.dictionary.cast(pa.string())))
        parts = pa.concat_arrays([stems, tails]).dictionary_encode()
        each = parts.dictionary.to_pylist()
        ids = [known[p] if p else b"" for p in each]
        as_stems = np.zeros(len(each), bool)
        as_stems[parts.indices.to_numpy()[: len(stems)]] = True
        new = [i for i, have in enumerate(ids) if have is None]
        for encode_all, chosen in ((ids_of_stems, [i for i in new if as_stems[i]]), (ids_of, [i for i in new if not as_stems[i]])):
            for i, have in zip(chosen, encode_all([each[i] for i in chosen]) if chosen else ()):
                ids[i] = known[each[i]] = have
        flat, lengths = np.frombuffer(b"".join(ids), dtype), np.array([len(i) for i in ids], np.int64) // np.dtype(dtype).itemsize
        part = parts.indices.to_numpy().reshape(2, -1).T[coded.indices.to_numpy()]
        n = lengths[part]
        sizes, n, part = n.sum(axis=1), n.ravel(), part.ravel()
        at = np.repeat((np.cumsum(lengths) - lengths)[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return flat[at], np.bincount(of, sizes, minlength=len(texts)).astype(np.int64)

    return encode


def plain_encoder(tokenizer_file: str, dtype: str) -> Encoder:
    """Ids of texts by any tokenizer file of the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, dtype) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype), *ids]), np.array([len(i) for i in ids], np.int64)

    return encode


def slices(texts: list[str], by_words: bool) -> Iterator[list[tuple[int, str]]]:
    """Texts by their number in lists of bounded size; where words are encoded, a longer text is cut between words."""
    held, size = [], 0
    for number, text in enumerate(texts):
        start = 0
        while by_words and len(text) - start > SLICE and (blank := WHITE.search(text, start + SLICE)):
            held.append((number, text[start : blank.start()]))
            yield held
            held, size, start = [], 0, blank.start()
        held.append((number, text[start:]))
        size += len(text) - start
        if size > SLICE:
            yield held
            held, size = [], 0
    yield held


# ------------------------------------------------------------------ writing


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer_file: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    by_words: bool = True,
) -> dict:
    """Encode every whole text into shards below ``folder`` and index them; gives the manifest.

    A null text is empty and has the end id only. Rows with a null key are written before all
    others and have no index entry. Rows that repeat a key stay neighbours, ordered by a hash of the
    text. An empty table gives a manifest without shards. Other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dtype = "<u2" if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
    make = word_encoder if by_words else plain_encoder

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"{shard:07d}-{uuid.uuid4().hex}"
        encode = make(tokenizer_file, dtype)
        starts, at, row, out = [], 0, 0, None
        for batch in batches:
            if out is None:
                fs, path = _fs(f"{folder}/shards/{name}")
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path + ".ids")
            sizes = np.ones(len(batch), np.int64)
            last = -1
            for held in slices(batch["text"].tolist(), by_words):
                ids, n = encode([text for _, text in held])
                number = np.array([i for i, _ in held], np.int64)
                np.add.at(sizes, number, n)
                # a text ends where the next one begins
                ended = np.flatnonzero(np.diff(number, prepend=last))
                ended = ended[number[ended] > 0]
                out.write(np.insert(ids, (np.cumsum(n) - n)[ended], end_id).tobytes())
                last = int(number[-1]) if len(number) else last
            if len(batch):
                out.write(np.array([end_id], dtype).tobytes())
            starts.append(at + np.cumsum(sizes) - sizes)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "shard": shard, "row": np.arange(row, row + len(sizes)), "n_tokens": sizes, "file": name})
            at, row = at + int(sizes.sum()), row + len(sizes)
        if out is not None:
            out.close()
            write_file(f"{folder}/shards/{name}.off", [np.concatenate([*starts, [at]]).astype("<u8").tobytes()])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    placed = chosen.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    placed.mapInPandas(write, ROWS).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")

    base, listed = 0, []
    for s in rows.groupBy("shard", "file").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).orderBy("shard").toLocalIterator():
        listed.append({"shard": s.shard, "file": s.file, "docs": s.docs, "tokens": s.tokens, "first": base})
        base += s.tokens
    parts = max(1, -(-sum(s["docs"] for s in listed) // KEYS_PER_PART))
    build_index(rows, folder, parts)
    manifest = {"dtype": dtype, "end_id": end_id, "parts": parts, "shards": listed}
    write_file(f"{folder}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


# ------------------------------------------------------------------ minimal perfect hash


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Another hash of 64-bit keys for each level."""
    x = keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys onto 0..n-1: levels of bits, a key sits on the first level where it is alone.

    The slot of a key is the number of set bits before its own. A key takes under two levels on average.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, load: float = LOAD) -> PerfectHash:
        rest, sizes, levels = np.unique(keys), [], []
        while len(rest):
            size = max(1, int(len(rest) * load))
            at = (mixed(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level holds it. A foreign key may get any slot."""
        found, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + start
            hit = self.bits[at]
            found[left[hit]] = self.ranks[at[hit]]
            left, start = left[~hit], start + size
        return found


ENTRY = np.dtype([("print", "<u4"), ("copies", "<u4"), ("shard", "<u4"), ("row", "<u8")])


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build_index(rows: DataFrame, folder: str, parts: int) -> None:
    """One index file per part of the key space; null keys are left out."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = part["doc_id"].to_numpy(np.int64).view(np.uint64)
        mph = PerfectHash.build(keys)
        entries = np.zeros(len(keys), ENTRY)
        at = mph.slots(keys)
        entries["print"][at] = fingerprints(keys)
        for field in ("copies", "shard", "row"):
            entries[field][at] = part[field].to_numpy()
        head = json.dumps({"sizes": mph.sizes, "keys": len(keys)}).encode()
        number = int(part["part"].iloc[0])
        # the content follows from the keys alone, so a repeated task writes the same file
        partial = f"{folder}/index/.{uuid.uuid4().hex}"
        write_file(partial, [len(head).to_bytes(8, "little"), head, np.packbits(mph.bits).tobytes(), entries.tobytes()])
        fs, path = _fs(partial)
        fs.move(path, f"{path.rsplit('/', 1)[0]}/{number:07d}.mph")
        return pd.DataFrame({"part": [number], "keys": [len(keys)]})

    keys = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("shard", "row")).alias("at"), F.count("*").alias("copies"))
    built = keys.select("doc_id", "copies", "at.*", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"))
    built.groupBy("part").applyInPandas(build, "part long, keys long").write.mode("overwrite").parquet(f"{folder}/index_parts")


class IndexPart:
    """One index file in memory."""

    def __init__(self, raw: bytes) -> None:
        length = int.from_bytes(raw[:8], "little")
        head = json.loads(raw[8 : 8 + length])
        n, at = sum(head["sizes"]), 8 + length
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        self.mph = PerfectHash(head["sizes"], bits)
        self.entries = np.frombuffer(raw, ENTRY, head["keys"], at + (n + 7) // 8)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, by fingerprint, and the entries of those."""
        at = self.mph.slots(keys)
        known = at >= 0
        known[known] = self.entries["print"][at[known]] == fingerprints(keys[known])
        return known, self.entries[at[known]]


# ------------------------------------------------------------------ reading


def locate(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """``doc_id, shard, row`` of every document under the given keys, by the index.

    Unknown keys give no row (a foreign key passes its fingerprint once in 2^32). Keys are dealt by
    index part, split further where there are many, so each task reads the parts of its keys once.
    """
    manifest = json.loads(read_file(f"{folder}/manifest.json"))
    parts = manifest["parts"]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, part = -1, None
        for batch in batches:
            for p, group in batch.groupby("part", sort=False):
                if p != number:
                    fs, path = _fs(f"{folder}/index/{p:07d}.mph")
                    if fs.get_file_info(path).type == pafs.FileType.NotFound:
                        continue
                    number, part = p, IndexPart(read_file(f"{folder}/index/{p:07d}.mph"))
                keys = group["doc_id"].to_numpy(np.int64)
                known, entries = part.find(keys.view(np.uint64))
                copies = entries["copies"].astype(np.int64)
                each = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                yield pd.DataFrame({
                    "doc_id": np.repeat(keys[known], copies), "shard": np.repeat(entries["shard"].astype(np.int64), copies),
                    "row": np.repeat(entries["row"].astype(np.int64), copies) + each,
                })

    wanted = keys.select(F.col(key).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    dealt = wanted.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).withColumn("_salt", F.pmod(F.hash("doc_id"), F.lit(8)))
    return dealt.repartition("part", "_salt").sortWithinPartitions("part").select("doc_id", "part").mapInPandas(probe, "doc_id long, shard long, row long")


def read_documents(located: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of located documents, read from the shards.

    ``start`` counts the ids of all documents before. With ``payload`` also ``ids``: 32-bit
    little-endian ids as binary. Each shard is read by ranged reads in ascending order.
    """
    manifest = json.loads(read_file(f"{folder}/manifest.json"))
    shards = {s["shard"]: s for s in manifest["shards"]}
    dtype = np.dtype(manifest["dtype"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened, offsets, first = -1, None, None, 0
        for batch in batches:
            for shard, group in batch.groupby("shard", sort=False):
                if shard != current:
                    if opened is not None:
                        opened.close()
                    place = f"{folder}/shards/{shards[shard]['file']}"
                    fs, path = _fs(place + ".ids")
                    current, opened, first = shard, fs.open_input_file(path), shards[shard]["first"]
                    offsets = np.frombuffer(read_file(place + ".off"), "<u8").astype(np.int64)
                rows = group["row"].to_numpy()
                starts, ends = offsets[rows], offsets[rows + 1]
                crcs, raws = [], []
                for a, b in zip(starts.tolist(), ends.tolist()):
                    opened.seek(a * dtype.itemsize)
                    ids = np.frombuffer(opened.read((b - a) * dtype.itemsize), dtype).astype("<u4").tobytes()
                    crcs.append(zlib.crc32(ids))
                    if payload:
                        raws.append(ids)
                out = {"doc_id": group["doc_id"].to_numpy(), "start": starts + first, "n_tokens": ends - starts, "ids_crc32": np.array(crcs, np.int64)}
                yield pd.DataFrame(out | ({"ids": raws} if payload else {}))
        if opened is not None:
            opened.close()

    ordered = located.repartition("shard").sortWithinPartitions("shard", "row")
    return ordered.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if payload else ""))


# ------------------------------------------------------------------ query


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@answer()
def op10_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, then looks every document up by its key and reads it back."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "tokens")
    write_shards(docs, folder, tokenizer_path())
    return read_documents(locate(docs, folder), folder, payload=False)
