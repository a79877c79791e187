"""Benchmark decontamination: a generalised suffix automaton of the test items, through which training text is streamed.

Items are lower-cased (A-Z) and cut into words; the automaton of all items, over words, knows every sequence of words that
stands in some item. A document's words are streamed through it while the length of the longest match that ends at each word
is tracked. Where that length reaches the limit (``window`` words; for an item of fewer words its own length) the words are
hit, and the states passed name the items.

A filter of fixed size tells first which adjacent words stand side by side in some item. A match can only lie in a stretch
whose neighbours all do, so only such stretches, if long enough for some window, are streamed; no match is lost, and the
words themselves decide in the automaton. Items are dealt to automata of about BLOCK_WORDS words; each worker holds one at a
time. More of them take a further pass over the stretches, not over the texts.

Edge cases: null and empty texts have no words, an item without words has no window; texts of any length are taken whole; a
repeated row repeats; equal items are all named, an item_id that comes twice is named once and one that is null hits words but
isn't named; an empty table on either side gives rows without hits, or none. ``scan`` keeps no other column than doc_id, so
clashing names don't matter; ``cleaned`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..arrow import arrow_map
from .common import FACTOR, Workspace, byte_view, column, documents, mixed, prefix_hash, span_hash, word_spans

#: Words of a window, and the share of a document's words above which the document goes as a whole.
WINDOW, MOST_COVERED = 10, 0.5
#: Words of the items of one automaton, about; those of a piece of a long item; bytes whose word hashes are formed at a time.
BLOCK_WORDS, PIECE_WORDS, HASH_BYTES = 100_000, 20_000, 4 << 20
#: Bits of the filter of word pairs, as a power of two, and those of one of its rows: 8 MB at most, whatever the items.
PAIR_BITS, ROW_BITS = 26, 15
#: Fixed value: what sets words that are an item by themselves apart from pairs.
ALONE = np.uint64(0x5851F42D4C957F2D)

#: Each byte as it counts in words: A-Z in lower case, all that parts words as a space.
NORMAL = np.full(256, 0x20, np.uint8)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    NORMAL[_first : _last + 1] = np.arange(_first, _last + 1)
NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)

SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
STRETCH = pa.struct([("start", pa.int32()), ("words", pa.string())])
FOUND = "n_words bigint, hits array<struct<start: int, end: int>>, longest int, items array<bigint>, stretches array<struct<start: int, words: string>>"


class SuffixAutomaton:
    """The generalised suffix automaton of items, which are (id, list of words).

    ``window_items`` has, for the state of each window, the ids of the items with that window; ``short`` has, for a state, the
    items of fewer words that end where its strings end, longest first.
    """

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extended(last, w)
        self._mark(items)

    def _new(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: bytes) -> int:
        """The state of p's longest string followed by w, made apart from longer ones if need be."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extended(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def _mark(self, items: list[tuple[int | None, list[bytes]]]) -> None:
        link, length, window = self.link, self.length, self.window
        #: For each state with strings of window words or more, the state of its suffix of just so many.
        self.at_window = list(range(len(link)))
        order = sorted(range(1, len(link)), key=length.__getitem__)
        for s in order:
            if length[link[s]] >= window:
                self.at_window[s] = self.at_window[link[s]]
        own: dict[int, set] = {}
        self.window_items: dict[int, set] = {}
        for item, words in items:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.window_items.setdefault(self.at_window[state], set()).add(item)
            if 0 < len(words) < window:
                own.setdefault(state, set()).add((len(words), item))
        self.short: dict[int, list[tuple[int, int | None]]] = {}
        if own:
            for s in order:
                told = [*own.get(s, ()), *self.short.get(link[s], ())]
                if told:
                    self.short[s] = sorted(told, key=lambda x: -x[0])

    def lengths(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """For each word the state, and the length of the longest match that ends there."""
        following, link, length = self.next, self.link, self.length
        state = n = 0
        for w in words:
            while state and w not in following[state]:
                state = link[state]
                n = length[state]
            after = following[state].get(w)
            state, n = (0, 0) if after is None else (after, n + 1)
            yield state, n

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Maximal spans of words that windows cover, the items with such windows, and the longest match."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        longest = 0
        for i, (state, n) in enumerate(self.lengths(words)):
            longest = max(longest, n)
            covered = 0
            if n >= self.window:
                covered = self.window
                items |= self.window_items[self.at_window[state]]
            for size, item in self.short.get(state, ()):
                if size <= n:
                    covered = max(covered, size)
                    items.add(item)
            if covered:
                start = i + 1 - covered
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items, longest


def normal_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The normalised bytes, and starts, ends and rows of the words."""
    normal = NORMAL[data]
    return normal, *word_spans(normal, at)


def joined_words(normal: np.ndarray, start: int, end: int) -> str:
    """The words between two positions, with one space between them."""
    return " ".join(w for w in bytes(normal[start:end]).decode().split(" ") if w)


def word_hashes(normal: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word; a piece of the bytes at a time, cut between words."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        end = max(first + 1, int(np.searchsorted(ends, starts[first] + HASH_BYTES, "right")))
        low = starts[first]
        prefix = prefix_hash(normal[low : ends[end - 1]])
        out[first:end] = span_hash(prefix, starts[first:end] - low, ends[first:end] - low)
        first = end
    return out


def pieces_of(items: DataFrame, window: int) -> DataFrame:
    """item_id, words (joined by spaces), n (of the whole item, up to the window) and pairs (hashes for the filter) of each piece of an item.

    Long items are cut into pieces that overlap by a word less than a window, so that each window lies in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["item_id"].to_pylist()
            normal, starts, ends, rows = normal_words(*byte_view(batch["text"]))
            hashes = word_hashes(normal, starts, ends)
            bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
            out: list[tuple] = []
            for k, item in enumerate(ids):
                low, high = int(bounds[k]), int(bounds[k + 1])
                for a in range(low, max(low + 1, high - window + 1) if high > low else low, PIECE_WORDS):
                    b = min(a + PIECE_WORDS + window - 1, high)
                    pairs = pair_hashes(hashes[a:b]) if b - a > 1 and window > 1 else mixed(hashes[a:b] ^ ALONE)
                    out.append((item, joined_words(normal, starts[a], ends[b - 1]), b - a, min(high - low, window), np.unique(pairs & np.uint64((1 << PAIR_BITS) - 1)).astype(np.int64)))
            columns = [*zip(*out, strict=True)] or [()] * 5
            types = pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item_id", "words", "size", "n", "pairs"])

    return arrow_map(items.select(F.col("item_id").cast("bigint"), "text"), run, "item_id bigint, words string, size bigint, n int, pairs array<bigint>")


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes[:-1] * FACTOR + hashes[1:])


def pair_filter(pieces: DataFrame) -> np.ndarray:
    """The bitmap of all pairs: formed in the cluster in rows of fixed size, of which there are 2 ** (PAIR_BITS - ROW_BITS) at most."""
    rows = pieces.select(F.explode("pairs").alias("h")).select(F.shiftright("h", ROW_BITS).alias("row"), F.col("h").bitwiseAND((1 << ROW_BITS) - 1).alias("bit"))
    bits = np.zeros(1 << (PAIR_BITS - 3), np.uint8)
    size = 1 << (ROW_BITS - 3)
    for r in rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[r["row"] * size : (r["row"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)[:size]
    return bits


def stretches_of(data: np.ndarray, at: np.ndarray, bits: np.ndarray, least: int, alone: bool) -> tuple[np.ndarray, list[list[tuple[int, str]]]]:
    """The number of words of each row, and its stretches (number of the first word, words joined by spaces).

    A stretch's neighbours all stand in the filter; it has ``least`` words or more, or one that is an item by itself.
    """
    normal, starts, ends, rows = normal_words(data, at)
    counts = np.bincount(rows, minlength=len(at) - 1)
    found: list[list[tuple[int, str]]] = [[] for _ in counts]
    if not len(starts):
        return counts, found
    hashes = word_hashes(normal, starts, ends)
    low = np.uint64((1 << PAIR_BITS) - 1)
    stands = lambda h: (bits[(h & low) >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    joined = np.zeros(len(starts), bool)  # to the word before
    joined[1:] = stands(pair_hashes(hashes)) & (rows[1:] == rows[:-1])
    first = np.flatnonzero(~joined)
    end = np.append(first[1:], len(starts))
    keep = end - first >= max(least, 2)
    if alone:
        keep |= np.logical_or.reduceat(stands(mixed(hashes ^ ALONE)), first)
    base = np.cumsum(counts) - counts
    for a, b in zip(first[keep].tolist(), end[keep].tolist(), strict=True):
        row = int(rows[a])
        found[row].append((a - int(base[row]), joined_words(normal, starts[a], ends[b - 1])))
    return counts, found


_automata: dict[str, tuple[int, SuffixAutomaton]] = {}


def automaton_of(shared, window: int) -> SuffixAutomaton:
    """The worker's automaton of a broadcast block of items; one is kept."""
    key = hash((shared.value, window))
    if _automata.get("kept", (None,))[0] != key:
        _automata["kept"] = key, SuffixAutomaton([(i, w.encode().split(b" ")) for i, w in pickle.loads(shared.value)], window)
    return _automata["kept"][1]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they meet or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def arrays_of(counts: list[int], told: list[tuple[list, int, list]], stretches: list[list[tuple[int, str]]]) -> list[pa.Array]:
    """The columns of FOUND from each row's spans, longest match and items, and its stretches."""
    spans = [[{"start": a, "end": b} for a, b in s] for s, _, _ in told]
    kept = [[{"start": a, "words": w} for a, w in s] for s in stretches]
    return [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array([n for _, n, _ in told], pa.int32()), pa.array([i for _, _, i in told], pa.list_(pa.int64())), pa.array(kept, pa.list_(STRETCH))]


def streamed(stretches: list[tuple[int, str]], automaton: SuffixAutomaton, before: tuple[list, int, list] = ([], 0, [])) -> tuple[list, int, list]:
    """Spans, longest match and ids of items of a row, joined with what is known of it before."""
    spans, longest, items = list(before[0]), before[1], set(before[2])
    for start, words in stretches:
        own, named, n = automaton.hits(words.encode().split(b" "))
        spans += [(start + a, start + b) for a, b in own]
        items |= named
        longest = max(longest, n)
    items.discard(None)
    return merged(spans), longest, sorted(items)


def scan_columns(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """docs (a column ``text`` and others, none of them named as in FOUND) without text, with the columns of FOUND.

    Beyond one automaton the rows are written between passes, with their stretches; then a pass reads those alone.
    """
    store = Workspace(spark, "decontaminate")
    pieces = store.put("pieces", pieces_of(items, window))
    told = pieces.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.min(F.when(F.col("n") > 1, F.col("n"))).alias("least"), F.count_if(F.col("n") == 1).alias("alone")).first()
    blocks = max(1, -(-told["words"] // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks))
    context = spark.sparkContext
    bits, least, alone = context.broadcast(pair_filter(pieces)), told["least"] or window, bool(told["alone"])
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), FOUND])

    def shared_block(k: int):
        own = pieces.filter(block == k).select("item_id", "words").collect()  # about BLOCK_WORDS words
        return context.broadcast(pickle.dumps(sorted(((r[0], r[1]) for r in own), key=lambda r: (r[0] is None, r))))

    first = shared_block(0)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(first, window)
        for batch in batches:
            counts, stretches = stretches_of(*byte_view(batch["text"]), bits.value, least, alone)
            rows = [streamed(s, automaton) for s in stretches]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *arrays_of(counts.tolist(), rows, stretches if blocks > 1 else [[] for _ in rows])], [*kept, "n_words", "hits", "longest", "items", "stretches"])

    found = arrow_map(docs, begin, schema)
    for k in range(1, blocks):
        found = store.put(f"pass-{k}", found)

        def go_on(batches: Iterator[pa.RecordBatch], shared=shared_block(k)) -> Iterator[pa.RecordBatch]:
            automaton = automaton_of(shared, window)
            for batch in batches:
                stretches = [[(s["start"], s["words"]) for s in row] for row in batch["stretches"].to_pylist()]
                before = [([(s["start"], s["end"]) for s in h], n, i) for h, n, i in zip(batch["hits"].to_pylist(), batch["longest"].to_pylist(), batch["items"].to_pylist(), strict=True)]
                rows = [streamed(s, automaton, b) for s, b in zip(stretches, before, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *arrays_of(batch["n_words"].to_pylist(), rows, stretches)], [*kept, "n_words", "hits", "longest", "items", "stretches"])

        found = arrow_map(found, go_on, schema)
    return found.drop("stretches")


def scan(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (spans of words, the end exclusive), longest (the longest match in words, of those in stretches that could hold a window) and items of each document."""
    return scan_columns(spark, docs.select(F.col("doc_id").cast("bigint"), "text"), items, window)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without what stands between them; what stands around them stays."""
    raw = np.frombuffer(text.encode(), np.uint8)
    _, starts, ends, _ = normal_words(raw, np.array([0, len(raw)]))
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : starts[a]].tobytes())
        at = int(ends[b - 1])
    return b"".join([*parts, raw[at:].tobytes()]).decode()


def cleaned(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, most_covered: float = MOST_COVERED) -> DataFrame:
    """docs without the spans that benchmark windows cover; documents of which more than ``most_covered`` of the words are covered go.

    n_chars follows the text if there is such a column.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    inner = docs.toDF(*names)
    found = scan_columns(spark, inner.withColumn("text", F.col(names[at])), items, window)
    covered = F.aggregate("hits", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    left = found.filter(covered <= F.col("n_words") * F.lit(float(most_covered))).select(*names, "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(s["start"], s["end"]) for s in row] for row in batch["hits"].to_pylist()]
            texts = [cut(t, s) if s else t for t, s in zip(batch[names[at]].to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == names[at] else batch[n] for n in names], names)

    out = arrow_map(left, run, T.StructType([T.StructField(f.name, f.dataType) for f in inner.schema])).toDF(*docs.columns)
    if "n_chars" not in docs.columns:
        return out
    length = F.when(F.col("text").isNull(), column("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(length.alias(c) if c == "n_chars" else column(c) for c in docs.columns))


def digests(found: DataFrame) -> DataFrame:
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op11_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def _words_sql(table: str, key: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


#: op11_suffix_automaton in DuckDB: every window of every document is looked up among those of the items.
ORACLE = f"""
WITH words AS ({_words_sql("documents", "doc_id")}), items AS ({_words_sql("benchmark", "item_id")}),
places AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM places),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS said FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
