"""Byte-pair encoding by forced-boundary splitting, and decoding.

A pair of adjacent bytes that stands inside no vocabulary token can never be merged away, so a word may be cut between
them for certain. Words are cut at all such pairs, the fragments are encoded independently, and their ids are
concatenated; the result is that of encoding the word as a whole.

Edge cases: null and empty texts give no ids and decode to the empty text; texts of any length are encoded whole, word by
word; repeated rows repeat; an empty table gives an empty result; other columns are kept by neither operator.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map
from .common import documents, texts

#: Words, and fragments within words, that a worker remembers in each of two generations.
REMEMBERED = 125_000

# The pattern that finds words, from the tokenizer file; what it comes to on ASCII text in lower case.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\v\f\r\x20a-z0-9]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Remembered(dict):
    """Values by key, made when first asked for. A full store becomes the old one; what is asked for again moves to the new one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ForcedBoundaryBpe:
    """Encoder of a byte-level BPE vocabulary with word ends."""

    def __init__(self, source: bytes):
        from tokenizers.models import BPE

        told = json.loads(source)
        model = told["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab, merges = model["vocab"], [tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.letters = byte_letters()
        #: Adjacent letters inside some token; between any other two a cut is certain.
        self.inside = {a + b for t in vocab for a, b in pairwise(t.removesuffix(self.end))}
        self.middle, self.last = BPE(vocab, merges), BPE(vocab, merges, end_of_word_suffix=self.end)
        self.words, self.ascii_words = regex.compile(WORDS), re.compile(ASCII_WORDS)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.middles = Remembered(lambda x: self.ids(self.middle, x))
        self.encoded = Remembered(self.encode_word)

    @staticmethod
    def ids(model, fragment: str) -> bytes:
        return array("i", [t.id for t in model.tokenize(fragment)]).tobytes()

    def fragments(self, letters: str) -> list[str]:
        """Letters of a word, cut at all forced boundaries."""
        inside = self.inside
        cuts = [i for i in range(1, len(letters)) if letters[i - 1 : i + 1] not in inside]
        return [letters[a:b] for a, b in pairwise([0, *cuts, len(letters)])] if cuts else [letters]

    def encode_word(self, word: str) -> bytes:
        *middle, last = self.fragments(word if word.isascii() and word.isalnum() else "".join(self.letters[b] for b in word.encode()))
        return b"".join([*map(self.middles.__getitem__, middle), self.ids(self.last, last)])

    def plain(self, text: str) -> bytes:
        import unicodedata

        words = self.ascii_words
        if not text.isascii():
            # Lower case letter by letter: a sigma that ends a word isn't special.
            words, text = self.words, unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.encoded.__getitem__, words.findall(text.lower())))

    def forget(self) -> None:
        """Drop the words remembered, so that an idle worker holds the vocabulary alone."""
        for store in (self.encoded, self.middles):
            store.clear()
            store.old = {}

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers. Special tokens' strings in the text become their ids."""
        if "<|" not in text or not self.specials:
            return self.plain(text)
        parts = self.specials.split(text)
        return b"".join(np.int32(self.special[p]).tobytes() if p in self.special else self.plain(p) for p in parts)


class TokenDecoder:
    """Decoder of a vocabulary: the tokens joined by spaces, as the vocabulary's file names no decoder."""

    def __init__(self, source: bytes):
        told = json.loads(source)
        self.tokens = {i: t for t, i in told["model"]["vocab"].items()} | {t["id"]: t["content"] for t in told["added_tokens"]}

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_models: dict[type, tuple[int, ForcedBoundaryBpe | TokenDecoder]] = {}


def model_of(kind: type, shared) -> ForcedBoundaryBpe | TokenDecoder:
    """The worker's encoder or decoder of a broadcast vocabulary file; one of each kind is kept."""
    key = hash(shared.value)
    if kind not in _models or _models[kind][0] != key:
        _models[kind] = key, kind(shared.value)
    return _models[kind][1]


def encode(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """doc_id and ids of each text. The vocabulary file, a few megabytes whatever the data, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(ForcedBoundaryBpe, shared)
        for batch in batches:
            ids = [model.encode(t) for t in texts(batch["text"])]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])
        model.forget()

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: bytes) -> DataFrame:
    """doc_id, ids and decoded text of each row of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(TokenDecoder, shared)
        for batch in batches:
            column = batch["ids"]
            text = pa.array([model.decode(column[i].values.to_numpy(zero_copy_only=False).tolist()) for i in range(len(column))], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], column, text], ["doc_id", "ids", "decoded"])

    return arrow_map(encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), run, "doc_id bigint, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """decode(encode(docs)) in one pass, so that a task needs one Python worker and ids cross to it once."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = model_of(ForcedBoundaryBpe, shared), model_of(TokenDecoder, shared)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t), np.int32) for t in texts(batch["text"])]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            decoded = pa.array([decoder.decode(i.tolist()) for i in ids], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, decoded], ["doc_id", "ids", "decoded"])
        encoder.forget()

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, ids array<int>, decoded string")


def vocabulary_file(name: str = "word_bpe_49k.json") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def digests(decoded: DataFrame) -> DataFrame:
    as_text = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(as_text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(documents(spark, sf_dir), vocabulary_file()))
