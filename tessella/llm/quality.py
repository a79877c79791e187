"""Quality rules: a hashed n-gram log-likelihood ratio, after counts that any reader can check.

Words and pairs of words are hashed into a fixed number of bins, whatever the corpus's size. Two multinomials
over the bins are counted, one over the trusted target (documents labelled good), one over the whole raw corpus; a document's
ratio is the mean, over its n-grams, of the difference of the bins' log probabilities. Every document is judged by one
threshold: no sampling. A quarter of the labelled documents, by the CRC-32 of the id, doesn't teach the target but sets the
threshold, where the weighted shares of good documents below and of bad ones above it are least.

Words are runs of bytes other than ASCII white space. Edge cases: a null or empty text has no words, ratio 0, and fails
the base rules; long texts are counted whole; repeated rows repeat, and teach as often as they stand there; labels without an
id or a quality say nothing, and of different labels of one id the worse counts; without a trusted document the target is
flat; without good and bad documents that set it, the threshold is FALLBACK; an empty table gives an empty result; other
columns, whatever their names, aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map
from ..operators.matrix import sum_vectors, vectors
from .common import SPACE, Workspace, byte_view, crc_bucket, documents, id_filter, marked, per_row, prefix_hash, span_hash, windows, word_spans

#: Bins of the n-grams, and those that a task sends as one vector (as powers of two); n-grams counted.
BITS, BLOCK_BITS, GRAMS = 18, 12, (1, 2)
#: The threshold: parts of an id's CRC-32, that part which sets it, how much a good document dropped counts against a bad one
#: kept (as shares of either kind), steps of a ratio of 1, and the threshold where labels say nothing.
PARTS, SETS, GOOD_WEIGHT, STEPS, FALLBACK = 4, 3, 4.0, 1000, -0.2
#: Base rules: least words, words of a repeated window, most of the words in such windows in percent.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True


def repeats(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each hash, whether it stands twice or more in its row."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.lexsort((hashes, rows)) if len(np.unique(rows)) > 1 else np.argsort(hashes)
    h, r = hashes[order], rows[order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def base_counts(data: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base counts of each row; the words' hashes and rows."""
    n = len(at) - 1
    starts, ends, rows = word_spans(data, at)
    prefix = prefix_hash(data)
    hashes = span_hash(prefix, starts, ends)
    win, first = windows(hashes, rows, WINDOW)
    first = first[repeats(win, rows[first])]
    cover = np.bincount(first, minlength=len(starts) + 1) - np.bincount(first + WINDOW, minlength=len(starts) + 1)
    covered = np.cumsum(cover)[:-1] > 0
    # Lines: they end before a line feed, or with the row.
    feeds = np.flatnonzero(data == 10)
    begin, stop = np.sort(np.concatenate([at[:-1], feeds + 1])), np.sort(np.concatenate([feeds, at[1:]]))
    line_row = np.sort(np.concatenate([np.arange(n), np.searchsorted(at, feeds, "right") - 1]))
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    lines, line_row = span_hash(prefix, begin[worded], stop[worded]), line_row[worded]
    order = np.lexsort((lines, line_row))
    again = (lines[order][1:] == lines[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    counts = {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": per_row(~SPACE[data] & ((data & 0xC0) != 0x80), at),
        "n_symbols": per_row(_SYMBOL[data], at),
        "n_dup_lines": np.bincount(line_row[order][1:][again], minlength=n),
        "n_repeat_words": np.bincount(rows[covered], minlength=n),
    }
    return counts, hashes, rows


def grams(hashes: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and rows of all n-grams."""
    bins, of = [], []
    for n in GRAMS:
        h, first = windows(hashes, rows, n)
        bins.append((h >> np.uint64(64 - bits)).astype(np.int64))
        of.append(rows[first])
    return np.concatenate(bins), np.concatenate(of)


def count_grams(docs: DataFrame) -> np.ndarray:
    """Counts of the bins over all texts of docs. A task sends whole vectors of neighbouring bins, which are summed in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            data, at = byte_view(batch["text"])
            starts, ends, rows = word_spans(data, at)
            bins, _ = grams(span_hash(prefix_hash(data), starts, ends), rows, BITS)
            sums += np.bincount(bins, minlength=1 << BITS)
        blocks = sums.reshape(-1, 1 << min(BITS, BLOCK_BITS))
        full = np.flatnonzero(blocks.any(axis=1))
        for k in full.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), vectors(blocks[[k]].astype(np.float64))], ["key", "x"])

    rows = sum_vectors(arrow_map(docs.select("text"), run, "key bigint, x array<double>")).toArrow()  # 1 << BITS numbers
    out = np.zeros((1 << BITS - min(BITS, BLOCK_BITS), 1 << min(BITS, BLOCK_BITS)))
    for k, x in zip(rows["key"].to_pylist(), rows["x"], strict=True):
        out[k] = x.values.to_numpy()
    return out.ravel()


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bin, the log of its probability in the target over that in the raw corpus, with one added to each count."""
    raw, target = raw + 1.0, target + 1.0
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def learn(store: Workspace, docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """The bins' log ratios: the texts of trusted ids (column good_id, distinct) against all texts.

    The raw side is counted without a join. Of the other side only texts that pass a filter of fixed size are moved.
    """
    near = marked(docs, "doc_id", store.put("bits", id_filter(F.col("good_id"), trusted)), "near").filter("near")
    return log_ratios(count_grams(docs), count_grams(near.join(trusted.hint("merge"), F.col("doc_id") == F.col("good_id"), "left_semi")))


def judge(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, base counts and ratio of each row."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(ratios), len(ratios).bit_length() - 1
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            data, at = byte_view(batch["text"])
            counts, hashes, rows = base_counts(data, at)
            bins, of = grams(hashes, rows, bits)
            n = len(at) - 1
            ratio = np.bincount(of, weights=weights[bins], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(counts[x].astype(np.int64)) for x in names), pa.array(ratio)], ["doc_id", *names, "ratio"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, " + "".join(f"{x} bigint, " for x in names) + "ratio double")


def qualities(labels: DataFrame) -> DataFrame:
    """labelled_id, its quality, and whether it sets the threshold instead of teaching the target."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("labelled_id")).agg(F.min("quality").alias("quality"))
    return known.withColumn("sets", crc_bucket("labelled_id", PARTS) == SETS)


def threshold(judged: DataFrame, labelled: DataFrame) -> float:
    """The ratio at which the weighted shares of good documents below and bad ones not below it are least; the middle of such ratios."""
    known = judged.filter("not base_failed").join(labelled.filter("sets"), F.col("doc_id") == F.col("labelled_id"))
    # Ratios lie within a few times ten, so their steps are a bounded table.
    steps = known.groupBy(F.floor(F.col("ratio") * STEPS).alias("step")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")).orderBy("step").toArrow()
    step, good, bad = (steps[c].to_numpy() for c in ("step", "good", "bad"))
    if not good.sum() or not bad.sum():
        return FALLBACK
    below = np.append(0, np.cumsum(good)) / good.sum()
    above = 1 - np.append(0, np.cumsum(bad)) / bad.sum()
    loss = GOOD_WEIGHT * below + above
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    # A cut before the k-th step lies anywhere above the step before it.
    k = int(best[0])
    high = step[k] if k < len(step) else step[-1] + 1
    low = step[k - 1] + 1 if k else step[0]
    return float(low + high) / 2 / STEPS


def verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base counts, ratio, base_failed and kept of each row."""
    store = Workspace(spark, "quality")
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    labelled = store.put("labelled", qualities(labels))
    ratios = learn(store, docs, labelled.filter("quality = 1 and not sets").select(F.col("labelled_id").alias("good_id")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = store.put("judged", judge(docs, ratios).withColumn("base_failed", failed))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold(judged, labelled)))


def op5_log_ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
