"""Fill-in-middle transformation by overlapping-chunk decomposition, and its inverse.

A text is cut into units at two drawn ranks, and its middle moved to the end behind a mark. Where units begin is told by a
predicate on adjacent bytes, so a text falls into chunks, each read with the byte before it, whose boundaries are counted
independently, all chunks of a batch at once. Prefix sums over a text's chunks then route both ranks to the chunks that own
them, and only those are scanned again for the byte at which the unit begins.

Units are code points, words (each with the white space after it) or lines. Ranks and forms follow from the id alone, so a
rerun gives the same result.

Edge cases: null and empty texts, and texts that hold a mark, keep their plain form; texts of any length are cut whole; equal
rows are cut alike, as the draw depends on the id only; a null id draws as the id ''; an empty table gives an empty result;
other columns, whatever their names, aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map
from .common import SPACE, byte_view, documents

# The marks, the share of texts that are transformed, and of those the share with the suffix first, in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SUFFIX_FIRST, SEED = 90, 20, "1"
#: Bytes of a chunk.
CHUNK = 1 << 14


def begins(before: np.ndarray, own: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte, from it and the byte before; what follows the start of a text has a line feed before it."""
    if unit == "chars":
        return (own & 0xC0) != 0x80
    if unit == "words":
        return SPACE[before] & ~SPACE[own]
    if unit == "lines":
        return before == 0x0A
    raise ValueError(f"no unit is called {unit}")


class Chunked:
    """The texts of a batch (their bytes, and the offsets of rows) in chunks, with the number of units that begin in each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, unit: str = "chars"):
        self.data, self.at, self.unit = data, at, unit
        sizes = np.diff(at)
        per_row = -(-sizes // CHUNK)
        #: The first chunk of each row; each chunk's first byte.
        self.first = np.concatenate([[0], np.cumsum(per_row)])
        inside = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_row)
        self.starts = np.repeat(at[:-1], per_row) + inside * CHUNK
        self.ends = np.minimum(self.starts + CHUNK, np.repeat(at[1:], per_row))
        self.leads = inside == 0
        counts = np.fromiter((np.count_nonzero(self.flags(c)) for c in range(len(self.starts))), np.int64, len(self.starts))
        #: Units before each chunk, over all rows, and in all.
        self.sums = np.concatenate([[0], np.cumsum(counts)])
        self.units = self.sums[self.first[1:]] - self.sums[self.first[:-1]]

    def flags(self, chunk: int) -> np.ndarray:
        """Where units begin in a chunk, read with the byte before it. A text that isn't empty begins with a unit."""
        a, b = self.starts[chunk], self.ends[chunk]
        own = self.data[a:b]
        before = np.empty_like(own)
        before[0] = 0x0A if self.leads[chunk] else self.data[a - 1]
        before[1:] = own[:-1]
        flags = begins(before, own, self.unit)
        if self.leads[chunk]:
            flags[0] = True
        return flags

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """For each row the byte, within it, at which the unit of its rank (from 0) begins; its end for the rank after the last."""
        wanted = self.sums[self.first[:-1]] + ranks
        owner = np.searchsorted(self.sums, wanted, "right") - 1
        out = np.diff(self.at)
        for row in np.flatnonzero(ranks < self.units):
            chunk = owner[row]
            place = np.flatnonzero(self.flags(chunk))[wanted[row] - self.sums[chunk]]
            out[row] = self.starts[chunk] + place - self.at[row]
        return out


def drawn(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, text (null: empty) and h, four 32-bit numbers of each row, from its id and the seed."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)))
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))


def transform(docs: DataFrame, unit: str = "chars", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), the units of prefix and middle (null if plain), and the output text.

    ``rate`` percent of the texts are transformed, of which ``suffix_first`` percent have the suffix first.
    """
    held = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | held | (F.col("h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = drawn(docs, seed).select("doc_id", "text", form.alias("form"), F.col("h")[0].alias("h1"), F.col("h")[1].alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_view(batch["text"])
            chunked = Chunked(data, at, unit)
            n = chunked.units
            ranks = np.sort(np.stack([batch[h].to_numpy() % (n + 1) for h in ("h1", "h2")]), axis=0)
            low, high = (at[:-1] + chunked.offsets(r) for r in ranks)
            forms = batch["form"].to_pylist()
            view = memoryview(data)
            out = []
            for form, a, b, c, d in zip(forms, at[:-1].tolist(), low.tolist(), high.tolist(), at[1:].tolist(), strict=True):
                if form == "plain":
                    out.append(bytes(view[a:d]))
                elif form == "psm":
                    out.append(b"".join([PREFIX.encode(), view[a:b], SUFFIX.encode(), view[c:d], MIDDLE.encode(), view[b:c]]))
                else:
                    out.append(b"".join([SUFFIX.encode(), view[c:d], PREFIX.encode(), view[a:b], MIDDLE.encode(), view[b:c]]))
            moved = np.array([f != "plain" for f in forms], bool)
            count = lambda x: pa.array(x, pa.int64(), mask=~moved)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), batch["form"], count(ranks[0]), count(ranks[1] - ranks[0]), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    return arrow_map(rows, run, "doc_id bigint, n bigint, form string, prefix_units bigint, middle_units bigint, output string")


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text from its output and form, by the marks; the parts hold none."""

    def between(begin: int, end: F.Column) -> F.Column:
        return F.substring(output, F.lit(begin), end - begin)

    first, last = F.instr(output, MIDDLE), F.length(output)
    suffix, prefix = F.instr(output, SUFFIX), F.instr(output, PREFIX)
    middle = F.substring(output, first + len(MIDDLE), last)
    psm = F.concat(between(len(PREFIX) + 1, suffix), middle, F.substring(output, suffix + len(SUFFIX), first - suffix - len(SUFFIX)))
    spm = F.concat(F.substring(output, prefix + len(PREFIX), first - prefix - len(PREFIX)), middle, between(len(SUFFIX) + 1, prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def op12_chunked_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = transform(documents(spark, sf_dir))
    back = restored(F.col("output"), F.col("form"))
    return moved.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


#: op12_chunked_infill in DuckDB: the parts by substrings of code points.
ORACLE = f"""
WITH said AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (SELECT doc_id, t, len(t)::BIGINT AS n, {", ".join(f"('0x' || substr(d, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM said),
ranked AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM ranked)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM cut
"""
