"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is bound as the product of its
letters' vectors, the first permuted twice, the second once; a text is the bundle (sum) of its trigrams, a language the
bundle of its texts, and a text goes to the language whose prototype has the largest cosine with it. The mean of the
prototypes is taken off them, as what all languages share tells none from another.

Words are runs of letters in lower case; a trigram may start or end with one space. Edge cases: a null text, or one
without a letter, is ``und`` with score 0; rows without a language teach nothing; ties go to the language that comes first
by code point; a repeated row repeats; very long texts are bundled whole, piece by piece; with no labelled row, or an empty
table, every text with letters is ``und`` too; all other columns stay, but those named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map
from .common import Workspace, crc_bucket, documents, texts

#: Dimensions of all vectors, and the seed of the letters' vectors.
DIMENSIONS, SEED = 1024, 11
#: Code points of text bundled at once.
PIECE = 1 << 20
#: Prototypes that the driver and a task hold at a time; more go in blocks, each a pass over the texts.
MOST_LANGUAGES = 2000
UNKNOWN = "und"


@cache
def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def letter_vector(code: int) -> np.ndarray:
    """The random vector of a code point; the same on every machine."""
    return np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def trigrams(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of the batch: the row numbers of the trigrams' texts, the trigrams' numbers in the piece, and their vectors."""
    start = 0
    while start < len(batch):
        end, size = start, 0
        while end < len(batch) and (end == start or size + len(batch[end]) <= PIECE):
            size, end = size + len(batch[end]), end + 1
        yield from piece_trigrams(batch[start:end], start)
        start = end


def numbered(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below ``most`` in ascending order, and the number of each value among them; by tables, unless they were too large."""
    if most > 1 << 24:
        return np.unique(values, return_inverse=True)
    there = np.zeros(most, bool)
    there[values] = True
    distinct = np.flatnonzero(there)
    number = np.empty(most, np.int32)
    number[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, number[values]


def piece_trigrams(rows: list[str], first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    low = [" " + t.lower() + " " for t in rows]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(first, first + len(low), dtype=np.int32), [*map(len, low)])
    codes = np.where(letter_table()[codes], codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (row[1:] != row[:-1])
    codes, row = codes[keep], row[keep]
    for at in range(0, max(len(codes) - 2, 0), PIECE):
        c, r = codes[at : at + PIECE + 2], row[at : at + PIECE + 2]
        seen, number = numbered(c, 0x110000)
        ok = (r[2:] == r[:-2]) & (c[1:-1] != 32)
        n = len(seen)
        number = number.astype(np.int64)
        which, gram = numbered(((number[:-2] * n + number[1:-1]) * n + number[2:])[ok], n**3)
        letters = np.stack([letter_vector(int(x)) for x in seen])
        bound = np.roll(letters, 2, axis=1)[which // (n * n)] * np.roll(letters, 1, axis=1)[which // n % n] * letters[which % n]
        yield r[2:][ok], gram, bound


def bundle(batch: list[str], groups: np.ndarray, n: int) -> np.ndarray:
    """The bundles of n groups of texts; groups: the group of each text, or -1."""
    out = np.zeros((n, DIMENSIONS), np.float32)
    for row, gram, bound in trigrams(batch):
        group = groups[row]
        ok = group >= 0
        group, gram = group[ok], gram[ok]
        if not len(group):
            continue
        low, high = int(group.min()), int(group.max()) + 1
        for a in range(low, high, 128):  # so many rows of counts at a time
            b = min(a + 128, high)
            own = (group >= a) & (group < b)
            counts = np.bincount((group[own] - a) * np.int64(len(bound)) + gram[own], minlength=(b - a) * len(bound)).reshape(b - a, -1)
            for g in range(0, len(bound), 2048):
                out[a:b] += counts[:, g : g + 2048].astype(np.float32) @ bound[g : g + 2048].astype(np.float32)
    return out


def learn(docs: DataFrame) -> dict[str, np.ndarray] | DataFrame:
    """The prototypes of the languages in docs, from text and lang: by name, or a table (lang, v) of more than MOST_LANGUAGES.

    Every task sends a vector for each language it has, and holds MOST_LANGUAGES at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, vector in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(vector)], ["lang", "at", "value"])
            sums.clear()

        for batch in batches:
            langs = batch["lang"].to_pylist()
            known = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            vectors = bundle(texts(batch["text"]), np.array([known[x] for x in langs], np.int64), len(known))
            for lang, i in known.items():
                sums[lang] = sums.get(lang, 0) + vectors[i].astype(np.float64)
            if len(sums) > MOST_LANGUAGES:
                yield from sent()
        yield from sent()

    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = arrow_map(labelled, run, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    vectors = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("v"))
    table = Workspace(docs.sparkSession, "languages").put("prototypes", vectors)
    rows = table.limit(MOST_LANGUAGES + 1).collect()
    return table if len(rows) > MOST_LANGUAGES else named(rows)


def named(rows: list) -> dict[str, np.ndarray]:
    """Prototypes by name, in the order of the names."""
    return {r["lang"]: np.array(r["v"]) for r in sorted(rows, key=lambda r: r["lang"])}


def blocks_of(prototypes: dict[str, np.ndarray] | DataFrame) -> tuple[list, np.ndarray, int]:
    """What gives each block of prototypes, the mean of all unit prototypes, and their number. The driver holds one block at a time."""
    if isinstance(prototypes, dict):
        blocks, n = [lambda: prototypes] if prototypes else [], len(prototypes)
    else:
        n = prototypes.count()
        parts = -(-n // MOST_LANGUAGES)
        part = F.pmod(F.xxhash64("lang"), F.lit(parts))
        blocks = [lambda k=k: named(prototypes.filter(part == k).collect()) for k in range(parts)]
    total = np.zeros(DIMENSIONS)
    for block in blocks:
        if held := block():
            total += unit(np.stack([*held.values()])).sum(axis=0)
    return blocks, total / max(n, 1), n


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-12)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray] | DataFrame, into: tuple = ("lang_pred", "score")) -> DataFrame:
    """The columns of docs with the language said and its score; columns of these two names are replaced.

    Of more than one block of prototypes the best so far goes from pass to pass, with the rows in a table of the shared folder.
    """
    docs = docs.drop(*into)
    spark, at = docs.sparkSession, docs.columns.index("text")
    blocks, mean, n = blocks_of(prototypes)
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    found = inner.select("*", F.lit(UNKNOWN).alias("p"), F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("b"))
    store = Workspace(spark, "languages")
    for k, block in enumerate(blocks):
        held = block()
        profiles = unit(np.stack([*held.values()])) if held else np.zeros((0, DIMENSIONS))
        shared = spark.sparkContext.broadcast(([*held], profiles, unit(profiles - mean) if n > 1 else profiles))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, profiles, centred = shared.value
            for batch in batches:
                if not names:
                    yield batch
                    continue
                rows = texts(batch.column(at))
                vectors = unit(bundle(rows, np.arange(len(rows)), len(rows)).astype(np.float64))
                cosines = vectors @ centred.T
                best = cosines.argmax(axis=1)
                value, before = cosines[np.arange(len(rows)), best], batch["b"].to_numpy()
                own, score = np.array(names, object)[best], np.clip(np.einsum("ij,ij->i", vectors, profiles[best]), 0, 1)
                said = np.array(batch["p"].to_pylist(), object)
                better = vectors.any(axis=1) & ((value > before) | ((value == before) & (own < said)))
                after = [np.where(better, own, said), np.where(better, score, batch["s"].to_numpy()), np.where(better, value, before)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(after[0], pa.string()), pa.array(after[1]), pa.array(after[2])], batch.schema.names)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
        found = arrow_map(found, run, schema)
        if k + 1 < len(blocks):
            found = store.put(f"pass-{k}", found)
    return found.drop("b").toDF(*docs.columns, *into)


def op6_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))
    prototypes = learn(docs.filter(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), prototypes).drop("text")
