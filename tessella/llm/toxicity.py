"""Toxicity by a counterfactually regularised classifier.

Features are the presence of words and of words' beginnings. The most telling ones are chosen from labelled texts, and a
logistic regression is fitted to them. In each labelled text that names a group of people, the identity terms are swapped
for others of their kind; the square of the change in the score that a swap makes is a penalty of the fit, so neutral
mentions of a group don't raise the score.

Edge cases: null and empty texts have the score of a text without features; texts are read whole; equal texts have equal
scores; a repeated row repeats; rows whose label is null teach nothing; other columns, whatever their names, aren't kept; with no label of either kind every score is the share of toxic labels (0
without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map
from .common import byte_view, crc_bucket, documents, prefix_hash, span_hash, word_spans

#: Labelled texts that teach, at most; features kept; lengths of beginnings in bytes; fewest texts with a feature.
TAUGHT, FEATURES, BEGINNINGS, LEAST_TEXTS = 20_000, 512, (4, 5, 6), 5
#: Weights of the penalties on the coefficients and on score changes by swaps; score from which a text counts as toxic.
RIDGE, SWAP, THRESHOLD = 0.1, 10.0, 0.3

# Identity terms by kind; any may stand for any other of its row.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("mexican", "chinese", "american", "indian", "german", "french"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
)

#: Capital ASCII letters made small; what isn't a letter, digit or part of a longer code point parts words.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 32


@cache
def term_hashes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the identity terms: hashes in ascending order, row in IDENTITY, place in that row."""
    terms = [(t, i, j) for i, row in enumerate(IDENTITY) for j, t in enumerate(row)]
    data, at = byte_view(pa.array([t for t, _, _ in terms]))
    hashes = span_hash(prefix_hash(data), at[:-1], at[1:])
    order = np.argsort(hashes)
    return hashes[order], np.array([i for _, i, _ in terms])[order], np.array([j for _, _, j in terms])[order]


def swap_table(shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms' hashes, and for each the hash of the term ``shift`` places on in its row."""
    hashes, kind, place = term_hashes()
    where = {(k, p): h for h, k, p in zip(hashes.tolist(), kind.tolist(), place.tolist(), strict=True)}
    return hashes, np.array([where[k, (p + shift) % len(IDENTITY[k])] for k, p in zip(kind.tolist(), place.tolist(), strict=True)], np.uint64)


def text_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rows of the features, words first; how many of them are words. Identity terms count as whole words only."""
    data = _FOLD[data]
    starts, ends, rows = word_spans(data, at)
    prefix = prefix_hash(data)
    hashes, of = [span_hash(prefix, starts, ends)], [rows]
    plain = np.ones(len(rows), bool)
    plain[found(hashes[0], term_hashes()[0])[0]] = False
    for n in BEGINNINGS:
        longer = plain & (ends - starts > n)
        # A beginning is told from a word of the same letters.
        hashes.append(~span_hash(prefix, starts[longer], starts[longer] + n))
        of.append(rows[longer])
    return np.concatenate(hashes), np.concatenate(of), len(starts)


def found(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the hashes that are in wanted (ascending), and their places there. A table of leading bits comes first."""
    table = np.zeros(1 << 16, bool)
    table[(wanted >> np.uint64(48)).astype(np.int64)] = True
    near = np.flatnonzero(table[(hashes >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(wanted, hashes[near]), max(len(wanted) - 1, 0))
    hit = wanted[place] == hashes[near] if len(wanted) else np.zeros(0, bool)
    return (near[hit], place[hit]) if len(wanted) else (near[:0], near[:0])


def taught(docs: DataFrame, labels: DataFrame, most: int = TAUGHT) -> DataFrame:
    """text and toxic of at most ``most`` labelled documents, chosen by a hash of the id: one row for each id, however often it stands in either table.

    Of several labels of an id the least counts, of several texts the first by code point.
    """
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def telling(rows: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, int, int]:
    """The features whose shares in toxic and other texts differ most, as signed 64-bit hashes; the numbers of either texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, of, _ = text_features(*byte_view(batch["text"]))
            toxic = batch["toxic"].to_numpy(zero_copy_only=False) == 1
            order = np.lexsort((of, hashes))
            hashes, of = hashes[order], of[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
            hashes, of = hashes[new], of[new]
            each, at = np.unique(hashes, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(np.bincount(at, minlength=len(each))), pa.array(np.bincount(at, weights=toxic[of], minlength=len(each)).astype(np.int64))], ["feature", "texts", "toxic"])

    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    n, bad = total["n"], total["toxic"]
    if not 0 < bad < n:
        return np.zeros(0, np.int64), n, bad
    counts = arrow_map(rows, run, "feature bigint, texts bigint, toxic bigint").groupBy("feature").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))
    share = F.col("texts") / n
    gap = F.abs(F.col("toxic") / bad - (F.col("texts") - F.col("toxic")) / (n - bad)) / F.sqrt(share * (1 - share) + 1e-9)
    best = counts.filter(F.col("texts") >= LEAST_TEXTS).orderBy(gap.desc(), "feature").limit(features).select("feature").toArrow()
    return best["feature"].to_numpy(), n, bad


def examples(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """toxic, and for each text the places of its features in wanted, as it stands and with its identity terms swapped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, (hashes, of, words) = len(batch), text_features(*byte_view(batch["text"]))
            terms, to = swap_table(1)
            at, which = found(hashes[:words], terms)
            swapped = hashes.copy()
            swapped[at] = to[which]
            named = np.zeros(n, bool)
            named[of[at]] = True

            def places(h: np.ndarray) -> list[list[int]]:
                hit, place = found(h, wanted)
                pairs = np.unique(of[hit].astype(np.int64) * (len(wanted) + 1) + place)
                lists = np.split(pairs % (len(wanted) + 1), np.searchsorted(pairs // (len(wanted) + 1), np.arange(1, n)))
                return [x.tolist() for x in lists]

            other = [x if k else None for x, k in zip(places(swapped), named.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["toxic"].cast(pa.int32()), pa.array(places(hashes), pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], ["toxic", "own", "other"])

    return arrow_map(rows, run, "toxic int, own array<int>, other array<int>")


def fit(toxic: np.ndarray, own: list, other: list, n_features: int, swap: float = SWAP) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps on log loss + ridge + swap * mean square of score changes."""
    x = np.zeros((len(own), n_features + 1), np.float32)
    x[:, -1] = 1
    for i, places in enumerate(own):
        x[i, places] = 1
    pairs = [i for i, o in enumerate(other) if o is not None]
    d = x[pairs].astype(np.float64)
    for k, i in enumerate(pairs):
        d[k, other[i]] -= 1
        d[k, -1] = 0
    penalty = swap * len(own) / max(len(pairs), 1) * (d.T @ d) / 4 + RIDGE * np.diag([*[1.0] * n_features, 1e-6])
    w = np.zeros(n_features + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(np.float64)))
        slope = x.T @ (p - toxic).astype(np.float32) + penalty @ w
        bend = x.T @ (x * (p * (1 - p) + 1e-6).astype(np.float32)[:, None]) + penalty
        step = np.linalg.solve(bend.astype(np.float64), slope.astype(np.float64))
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, swap: float = SWAP) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features in ascending order, and coefficients with the constant last."""
    rows = taught(docs, labels)
    chosen, n, bad = telling(rows)
    if not len(chosen):
        share = min(max(bad / n if n else 0.0, 1e-9), 1 - 1e-9)
        return np.zeros(0, np.uint64), np.array([np.log(share / (1 - share))])
    wanted = np.unique(np.concatenate([chosen.view(np.uint64), term_hashes()[0]]))
    got = examples(rows, wanted).toArrow()  # at most TAUGHT rows
    # In an order of their own, so that sums don't depend on partitions.
    told = sorted(zip(got["toxic"].to_pylist(), got["own"].to_pylist(), got["other"].to_pylist(), strict=True), key=lambda r: (r[0], r[1], r[2] or []))
    toxic, own, other = map(list, zip(*told, strict=True))
    return wanted, fit(np.array(toxic) == 1, own, other, len(wanted), swap)


def score(docs: DataFrame, wanted: np.ndarray, weights: np.ndarray) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = shared.value
        for batch in batches:
            n, (hashes, of, _) = len(batch), text_features(*byte_view(batch["text"]))
            hit, place = found(hashes, wanted)
            pairs = np.unique(of[hit].astype(np.int64) * (len(wanted) + 1) + place)
            total = np.bincount(pairs // (len(wanted) + 1), weights=weights[pairs % (len(wanted) + 1)], minlength=n) + weights[-1]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, score double")


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, *train(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
