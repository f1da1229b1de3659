"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last 32 bytes cuts every text where its content says so, so a passage that many
documents share is cut alike in all of them.  A chunk's digest stands for its inner ids: those of the words
between its first and its last white space.  The chunks that save most over the whole corpus are found by a
count, encoded once and sent to all tasks, in a number that is a parameter; every other chunk is encoded
once in each task that meets it, as long as its ids are held.  The count of kept chunks decides on work,
never on results.

A chunk's outer words depend on its neighbours.  At each join the text from the last white space of the
left chunk to the first of the right one is encoded again, and a chunk without white space draws the next
one in: the window grows until both its ends stand at white space.  There the ids agree with those of the
whole text, since the vocabulary's tokens never cross white space; that property is tested when the
vocabulary is loaded, and one without it is refused.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, prepare, read_table

VOCABULARY = "word_bpe_49k"
#: Bytes of a chunk: least, most, and the bits of the hash that are zero at a cut (1024 bytes between cuts).
LEAST, MOST, BITS = 256, 4096, 10
#: Chunks that are encoded once for all tasks: their ids, at most a token a byte, take 64 MB at most.
SHARED = 4096
#: Words and chunks whose ids a task holds, and chunk digests that it counts at a time.
WORDS, CHUNKS, COUNTED = 400_000, 16_384, 100_000
#: Bytes that are hashed at a time.
_BLOCK = 1 << 20
#: White space that texts are cut at: others stay inside words, where the tokenizer sees to them.
_BLANK = bytes.maketrans(b"\t\n\r", b"   ")
#: Fixed value: the pattern that a lower-casing vocabulary splits its words by.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these letters are one token run for that pattern, in lower case and in any normal form.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Ends of words that the pattern splits off after a letter or digit, and the byte that marks a word's end.
_TAIL, _END = b".,;:!?", b"\xff"


def _gear() -> np.ndarray:
    """A random-looking 32-bit number a byte value (the mixing step of SplitMix64)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def cut(raw: bytes) -> list[int]:
    """The ends of the chunks of a UTF-8 text; none of an empty one.

    A cut stands where the rolling hash of the 32 bytes before it has BITS zeros, LEAST bytes or more after
    the last one and never inside a character; after MOST bytes one is made anyway."""
    found = []
    for lo in range(0, len(raw), _BLOCK):
        near = np.frombuffer(raw, dtype=np.uint8, count=min(len(raw), lo + _BLOCK) - max(0, lo - 31), offset=max(0, lo - 31))
        h, width = _GEAR[near], 1
        while width < 32:  # sums of the last 2 * width bytes from those of the last width
            more = h.copy()
            more[width:] += h[:-width] << np.uint32(width)
            h, width = more, 2 * width
        found.extend((np.flatnonzero((h[min(lo, 31) :] >> np.uint32(32 - BITS)) == 0) + lo + 1).tolist())
    ends, last = [], 0
    for at in [*found, len(raw)]:
        while at - last > MOST:
            last += MOST
            while last < len(raw) and raw[last] & 0xC0 == 0x80:
                last += 1
            ends.append(last)
        if at == len(raw):
            break
        if at - last >= LEAST and raw[at] & 0xC0 != 0x80:
            ends.append(at)
            last = at
    if len(raw) > last:
        ends.append(len(raw))
    return ends


def _key(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


class Words(dict):
    """Ids of words, made when they are first asked for; at most WORDS are held."""

    def __init__(self, make: Callable[[bytes], bytes]):
        super().__init__({b"": b""})
        self.make = make

    def __missing__(self, word: bytes) -> bytes:
        ids = self.make(word)
        if len(self) >= WORDS:
            self.clear()
        self[word] = ids
        return ids


class ChunkEncoder:
    """Ids of texts (little-endian unsigned 32-bit) as the vocabulary's JSON tokenizer gives them, chunk by chunk."""

    def __init__(self, name: str = VOCABULARY, folder: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import public_tokenizers as P
        from tokenizers import Tokenizer

        path = f"{folder}/{name}.json" if folder else P.path(f"{name}.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        for left, right in (("a", "b"), ("don't", "!?"), ("x.", "É1"), ("\u0301", "\u0301z"), ("", "")):
            for blank in (" ", "\n", "\t \r"):
                if ids(left + blank + right) != ids(left) + ids(right):
                    raise ValueError(f"tokens of {name} cross white space, so its chunks cannot be joined")
        self.ranks = self._rank_encoder(form)
        self.words, self.chunks = Words(self._word), {}
        self.plain = form["decoder"] is None
        self.tokens: list[bytes | None] = [None] * (max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
        for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.tokens[i] = t.encode()

    @staticmethod
    def _rank_encoder(form: dict) -> Callable[[bytes], list[int]] | None:
        """The vocabulary's merges as byte ranks, if it is a lower-casing BPE with word ends whose ids follow its merges.

        A word's end is one more byte that no UTF-8 text has; it joins the last byte first, as its ranks are lowest."""
        import tiktoken

        model, steps = form["model"], (form["normalizer"] or {}).get("normalizers", [])
        split = ((form["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        known = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": _SPLIT} and model.get("end_of_word_suffix") == "</w>"
        if not known or model["type"] != "BPE":
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level vocabularies
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        as_bytes = lambda t: bytes(byte[c] for c in t.removesuffix("</w>")) + _END * t.endswith("</w>")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"]["".join(m)] != 512 + k for k, m in enumerate(pairs)):
            return None
        ranks = {as_bytes(t): i for t, i in model["vocab"].items()}
        ranks[_END] = len(ranks)
        return tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _word(self, word: bytes) -> bytes:
        """Ids of what stands between two white spaces."""
        if self.ranks:
            body = word.rstrip(_TAIL)
            if body and len(body) < len(word) and body[-1:].isalnum():  # such a tail is a token of its own, or several
                return self.words[body] + self.words[word[len(body) :]]
            text = word.decode("utf-8", "replace")
            if _LETTERS.fullmatch(text):
                return array("I", self.ranks(text.lower().encode() + _END)).tobytes()
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def inner(self, raw: bytes) -> bytes:
        """Ids of a stretch of whole words."""
        return b"".join(map(self.words.__getitem__, raw.split(b" ")))

    def encode(self, raw: bytes, shared: dict[bytes, bytes]) -> bytes:
        raw, out, open_, lo = raw.translate(_BLANK), [], 0, 0
        for hi in cut(raw):
            first = raw.find(b" ", lo, hi)
            if first >= 0:
                last = raw.rfind(b" ", lo, hi)
                out.append(self.inner(raw[open_:first]))  # the word across the join
                if last > first + 1:
                    key = _key(raw[lo:hi])
                    ids = shared.get(key) or self.chunks.get(key)
                    if ids is None:
                        ids = self.inner(raw[first + 1 : last])
                        if len(self.chunks) >= CHUNKS:
                            self.chunks.clear()
                        self.chunks[key] = ids
                    out.append(ids)
                open_ = last + 1
            lo = hi
        out.append(self.inner(raw[open_:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """What the library's decode(ids, skip_special_tokens=False) gives; without a decoder it joins the tokens by spaces."""
        numbers = np.frombuffer(ids, dtype="<u4")
        if not self.plain:
            return self.tokenizer.decode(numbers.tolist(), skip_special_tokens=False).encode()
        found = list(map(self.tokens.__getitem__, numbers[numbers < len(self.tokens)].tolist()))
        return b" ".join(found if None not in found else [t for t in found if t is not None])


_encoders: dict = {}


def _encoder(name: str, folder: str | None) -> ChunkEncoder:
    if (name, folder) not in _encoders:
        _encoders[name, folder] = ChunkEncoder(name, folder)
    return _encoders[name, folder]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, text) a chunk with inner words; the text of those that this task met again only."""
    counts: dict[bytes, int] = {}
    again: dict[bytes, bytes] = {}

    def emit():
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64()), pa.array([again.get(k) for k in counts], pa.binary())], names=["key", "n", "text"])
        counts.clear()
        again.clear()
        return out

    for b in batches:
        for raw in _texts(b.column(0)):
            raw, lo = raw.translate(_BLANK), 0
            for hi in cut(raw):
                chunk = raw[lo:hi]
                lo = hi
                if chunk.rfind(b" ") > chunk.find(b" ") + 1:
                    key = _key(chunk)
                    counts[key] = n = counts.get(key, 0) + 1
                    if n == 2:
                        again[key] = chunk
                    if len(counts) >= COUNTED:
                        yield emit()
    if counts:
        yield emit()


def shared_chunks(texts: DataFrame, most: int = SHARED, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """(key, ids) of the ``most`` chunks whose reuse saves most bytes over the one text column, each encoded once.

    All chunks of all texts are counted.  Ties of savings go by digest."""
    counted = map_arrow(texts, _count_chunks, "key binary, n long, text binary")
    counted = counted.groupBy("key").agg(F.sum("n").alias("n"), F.max("text").alias("text"))
    best = counted.where("n > 1 AND text IS NOT NULL").orderBy(((F.col("n") - 1) * F.octet_length("text")).desc(), "key").limit(most)

    def encode(batches):
        e = _encoder(vocabulary, folder)
        for b in batches:
            ids = [e.inner(t[t.find(b" ") + 1 : t.rfind(b" ")]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    return map_arrow(best.select("key", "text").repartition("key"), encode, "key binary, ids binary")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None, most: int = SHARED) -> DataFrame:
    """(id, ids) a row: the ids of its whole text as little-endian unsigned 32-bit integers, as the library's
    encode(text, add_special_tokens=False) gives them.

    Null texts are empty, empty ones have no ids; strings of special tokens are special.  Repeated rows and
    ids are encoded each, null ids stay null, other columns are not read, and an empty table gives none."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = shared_chunks(rows.select("text"), most, vocabulary, folder).collect() if most else []  # ``most`` rows, 64 MB at most by default
    shared = spark.sparkContext.broadcast({bytes(r["key"]): bytes(r["ids"]) for r in found})

    def encode(batches):
        e, known = _encoder(vocabulary, folder), shared.value
        for b in batches:
            ids = [e.encode(t, known) for t in _texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return map_arrow(rows, encode, "id long, ids binary").withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """``rows`` with their ids (little-endian unsigned 32-bit, null: none) decoded in a last column ``decoded``.

    Special tokens are kept; an id that the vocabulary lacks is passed over, as the library does."""
    fields = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e: Callable = _encoder(vocabulary, folder).decode
        for b in batches:
            texts = [e(x or b"") for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*b.schema.names, "decoded"])

    return map_arrow(rows, decode, fields)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_ids(encode_texts(read_table(spark, sf_dir, "documents")))
    n = F.octet_length("ids") / 4
    return out.select("doc_id", n.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
