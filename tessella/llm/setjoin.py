"""N-gram Jaccard self-join by chosen paths, and near-duplicate classes.

Documents are sets of word shingles; two are linked if the Jaccard similarity of their sets is at least the threshold.

1. Copies: documents with equal sets become one set with a count, before anything else is shuffled.
2. Chosen paths: a set is embedded as its minimal hash values under many hash functions, one token each. A run starts
   with one node that holds all sets. A node samples coordinates, 1 / threshold of them on average, and splits its sets by
   their token there, so a set follows each path on which it shares all tokens chosen. Nodes of bounded size are
   compared by brute force on the tokens; larger ones are split again. Runs repeat until a pair at the threshold is met
   with the target probability.
3. Nodes that don't shrink to that size hold much alike sets, or sets with a long passage in common. They are compared in
   parts of bounded size, each together with a few leaders of the whole node; then all sets of a node that aren't joined
   by then are compared with each other, in blocks of bounded size, so a large node loses no pair. For sets that stay
   unlike this takes of the order of n * n comparisons of tokens in a node of n sets.
4. Pairs that look alike join their sets to candidate groups (connected components). Within each group all sets are
   compared exactly, in blocks of bounded size, from the texts; a group larger than a block is cut by size first, and only
   sets of neighbouring sizes meet, as others can't be linked. Blocks yield counts of links and a spanning forest, never the
   pairs.

Ids pass a filter of fixed size before tokens or texts are moved, and no key of a join makes a task of its own (see common).

Edge cases: a document of fewer words than a shingle is one shingle of all its words; null and wordless texts have no
links and are a class of their own; rows without an id are linked to nothing but are counted as copies, and have class
null unless a copy has an id; rows with equal ids are one document; ties in size or hash are broken by id; texts of any
length are used whole; an empty table gives an empty result; other columns, whatever their names, aren't kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map
from .common import FACTOR, Workspace, byte_view, documents, id_filter, look_up, marked, mixed, prefix_hash, row_pieces, span_hash, windows, word_spans

#: Words of a shingle; least similarity; probability to meet a pair at that similarity.
SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Tokens of a set; deepest split; most sets of a node that is compared whole; leaders of a node that isn't.
TOKENS, DEPTH, BUCKET, LEADERS = 128, 3, 200, 4
#: Sets whose tokens agree so much less than the threshold are no candidates: four deviations of the estimate.
SLACK = 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / TOKENS)
#: Sets and shingles of a block of exact comparison.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000
#: Sets of a block in which the sets of a large node are compared by their tokens.
NODE_SETS = 2048
#: Sets whose sizes differ by a larger factor are never linked; a little over 1 / THRESHOLD, so neighbours among its powers suffice.
SIZE_STEP = 1.0001 / THRESHOLD

_RANDOM = np.random.default_rng(5)
_MULTIPLY = (_RANDOM.integers(0, 1 << 31, TOKENS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RANDOM.integers(0, 1 << 32, TOKENS).astype(np.uint32)


def lost(threshold: float, depth: int) -> float:
    """The probability that a run parts a pair at the threshold: a branching process; a node samples one coordinate, or two."""
    two = 1 / threshold - 1
    gone = 0.0
    for _ in range(depth):
        one = 1 - threshold + threshold * gone
        gone = (1 - two) * one + two * one * one
    return gone


def runs_for(threshold: float = THRESHOLD, depth: int = DEPTH, recall: float = RECALL) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost(threshold, depth))))


def roots(runs: int, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(run, coordinate) of the first splits; a run samples one coordinate, and a second one with what is left of 1 / threshold."""
    rng = np.random.default_rng(17)
    picked = rng.permutation(TOKENS)[: 2 * runs]
    second = (np.arange(runs) * (1 / threshold - 1)) % 1 + (1 / threshold - 1) >= 1
    return [(r, int(picked[2 * r + k])) for r in range(runs) for k in range(2 if second[r] else 1)]


def shingles(data: np.ndarray, at: np.ndarray, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ordered by row and hash, and their rows."""
    parts = [(a, piece_shingles(data[at[a] : at[b]], at[a : b + 1] - at[a], words)) for a, b in row_pieces(at)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for _, (h, _) in parts]), np.concatenate([r + a for a, (_, r) in parts])


def piece_shingles(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_spans(data, at)
    hashes = span_hash(prefix_hash(data), starts, ends)
    count = np.bincount(rows, minlength=len(at) - 1)[rows]
    out, of = [], []
    for n in range(1, words + 1):
        own = count >= n if n == words else count == n
        h, first = windows(hashes[own], rows[own], n)
        out.append(h)
        of.append(rows[own][first])
    h, r = np.concatenate(out), np.concatenate(of)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def embed(docs: DataFrame, runs: int) -> DataFrame:
    """doc_id, size and 128-bit name of each row's set, its tokens and its first nodes."""
    first = roots(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            h, rows = shingles(*byte_view(batch["text"]))
            size = np.bincount(rows, minlength=n)
            full = np.flatnonzero(size)
            begin = np.concatenate([[0], np.cumsum(size)])[full].astype(np.int64)
            low = (h >> np.uint64(32)).astype(np.uint32)
            tokens, names = np.zeros((n, TOKENS), np.uint32), np.zeros((2, n), np.uint64)
            if len(full):
                for k in range(TOKENS):
                    tokens[full, k] = np.minimum.reduceat(low * _MULTIPLY[k] + _ADD[k], begin)
                names[0, full], names[1, full] = np.add.reduceat(mixed(h), begin), np.add.reduceat(mixed(h ^ FACTOR), begin)
            nodes = np.stack([mixed(tokens[:, c].astype(np.uint64) * FACTOR + np.uint64(r * TOKENS + c)) for r, c in first], axis=1).view(np.int64)
            none = size == 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(first)), pa.array(nodes.ravel()))
            raw = pa.array([None if e else t.tobytes() for e, t in zip(none.tolist(), tokens, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size.astype(np.int64)), pa.array(names[0].view(np.int64), mask=none), pa.array(names[1].view(np.int64), mask=none), raw, lists], ["doc_id", "size", "a", "b", "tokens", "nodes"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, size bigint, a bigint, b bigint, tokens binary, nodes array<bigint>")


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches ordered by the key; the last key that has come waits for more of its rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or (held and last != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def forest(n: int, left: np.ndarray, right: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name in the connected component of each of n points."""
    label = names.copy()
    while True:
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        if np.array_equal(before, label):
            return label


def likely(members: DataFrame) -> DataFrame:
    """Candidate links (u, v) from rows of node, rep, size and tokens: a spanning forest of each node's likely pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "node"):
            reps, sizes = table["rep"].to_numpy(), table["size"].to_numpy()
            tokens = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint32).reshape(-1, TOKENS)
            u, v = [], []
            at = bounds(table["node"].to_numpy())
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                t, s = tokens[a:b], sizes[a:b]
                least = (THRESHOLD - SLACK) * TOKENS
                left, right = [], []
                for i in range(b - a - 1):
                    near = np.flatnonzero(((t[i + 1 :] == t[i]).sum(axis=1) >= least) & (np.minimum(s[i + 1 :], s[i]) >= THRESHOLD * np.maximum(s[i + 1 :], s[i])))
                    left.append(np.full(len(near), i))
                    right.append(near + i + 1)
                if left and any(map(len, left)):
                    label = forest(b - a, np.concatenate(left), np.concatenate(right), reps[a:b])
                    other = label != reps[a:b]
                    u.append(reps[a:b][other])
                    v.append(label[other])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return arrow_map(members.select("node", "rep", "size", "tokens").repartition("node").sortWithinPartitions("node"), run, "u bigint, v bigint").filter("u <> v").distinct()


def likely_apart(members: DataFrame) -> DataFrame:
    """Candidate links (u, v) from rows of block, side, rep, root, size and tokens: likely pairs of unlike roots, as a spanning forest of each block.

    Rows of side 0 and 1 are compared with each other only; those of side 2, all with all.
    """

    def compare(side: np.ndarray, reps: np.ndarray, roots: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # By size, what is large enough for a set comes right before it.
        order = np.argsort(sizes, kind="stable")
        side, reps, roots, sizes, tokens = side[order], reps[order], roots[order], sizes[order], tokens[order]
        begin = np.searchsorted(sizes, THRESHOLD * sizes - 1e-6)
        left, right = [], []
        for i in range(1, len(reps)):
            other = slice(int(begin[i]), i)
            at = np.flatnonzero((roots[other] != roots[i]) & ((side[other] != side[i]) | (side[i] == 2))) + other.start
            near = at[(tokens[at] == tokens[i]).sum(axis=1) >= (THRESHOLD - SLACK) * TOKENS]
            left.append(np.full(len(near), i))
            right.append(near)
        if not any(map(len, left)):
            return reps[:0], reps[:0]
        label = forest(len(reps), np.concatenate(left), np.concatenate(right), reps)
        return reps[label != reps], label[label != reps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "block"):
            side, reps, roots, sizes = (table[c].to_numpy() for c in ("side", "rep", "root", "size"))
            tokens = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint32).reshape(-1, TOKENS)
            at = bounds(table["block"].to_numpy())
            found = [compare(side[a:b], reps[a:b], roots[a:b], sizes[a:b], tokens[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(2)], ["u", "v"])

    return arrow_map(members.select("block", "side", "rep", "root", "size", "tokens").repartition("block").sortWithinPartitions("block"), run, "u bigint, v bigint").distinct()


def components(store: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """node and the least node (root) of its connected component, from edges (u, v); large-star and small-star steps.

    Every step writes its edges to the shared folder, which also ends the lineage. It is the last one if each node has one
    edge, to a node that has none of its own.
    """
    current = store.put(f"{name}-0", edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    step = 0
    while True:
        degrees = current.groupBy("u").agg(F.count("*").alias("n"))
        if degrees.filter("n > 1").isEmpty() and current.join(degrees.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        step += 1
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        # Large star: to the least neighbour go all greater ones.
        large = look_up(both.filter("v > u"), "u", least, 2 * current.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = store.put(f"{name}-large-{step}", large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # Small star: to the least go the node and its lesser neighbours.
        small = look_up(large, "u", low, large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = store.put(f"{name}-{step}", small)
        store.drop(f"{name}-{step - 1}", f"{name}-large-{step}")


def exact(members: DataFrame) -> DataFrame:
    """rep, links and label of each set in each of its blocks, from rows of block, side, rep, copies and text.

    links: copies of the sets in the block that are linked to it; label: least rep that links reach within the block.
    Rows of side 0 and 1 are compared with each other only; those of side 2, all with all.
    """

    def compare(side: np.ndarray, reps: np.ndarray, copies: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Of rows with one id, the first counts.
        place = np.full(len(reps), -1)
        kept = np.sort(np.unique(reps, return_index=True)[1])
        place[kept] = np.arange(len(kept))
        h, rows = h[place[rows] >= 0], place[rows][place[rows] >= 0]
        side, reps, copies = side[kept], reps[kept], copies[kept]
        n, size = len(reps), np.bincount(rows, minlength=len(reps))
        each, at, times = np.unique(h, return_inverse=True, return_counts=True)
        shared = times > 1
        column = np.cumsum(shared) - 1
        use = shared[at]
        column, row = column[at[use]], rows[use]
        both = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        width = 4096
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            part = slice(*np.searchsorted(column, [c, c + width]))
            x = np.zeros((n, width), np.float32)
            x[row[part], column[part] - c] = 1
            both += x @ x.T
        linked = both >= THRESHOLD * (size[:, None] + size[None, :] - both) - 1e-6
        linked &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
        np.fill_diagonal(linked, False)
        left, right = np.nonzero(np.triu(linked))
        return reps, linked @ copies, forest(n, left, right, reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "block"):
            table = table.combine_chunks()
            reps, copies, side = (table[c].to_numpy() for c in ("rep", "copies", "side"))
            at = bounds(table["block"].to_numpy())
            h, rows = shingles(*byte_view(table["text"].chunk(0)))
            ends = np.searchsorted(rows, at)
            found = [compare(side[a:b], reps[a:b], copies[a:b], h[p:q], rows[p:q] - a) for a, b, p, q in zip(at[:-1].tolist(), at[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]).astype(np.int64)) for k in range(3)], ["rep", "links", "label"])

    return arrow_map(members.select("block", "side", "rep", "copies", "text").repartition("block").sortWithinPartitions("block"), run, "rep bigint, links bigint, label bigint")


def candidates(store: Workspace, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """node and root of the candidate groups of sets, by chosen paths."""
    tokens = rows.select(F.col("doc_id").alias("rep"), "size", "tokens").filter("size > 0")
    nodes = sets.select("rep", F.explode("nodes").alias("node"))
    parts, large = [], None
    for depth in range(1, DEPTH + 1):
        count = nodes.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("who")).filter("n > 1")
        count = store.put(f"count-{depth}", count)
        # The same few sets meet in many runs; one such node is enough.
        few = count.filter(F.col("n") <= BUCKET).groupBy("n", "who").agg(F.min("node").alias("node"))
        parts.append(nodes.join(few.select("node"), "node").select("node", "rep"))
        many = count.filter(F.col("n") > BUCKET)
        if many.isEmpty():
            break
        held = nodes.join(many.select("node", "n"), "node")
        if depth == DEPTH:
            large = store.put("large", held.select("node", "rep"))
            parts.append(in_parts(held))
            break
        # A child is named by its parent, the coordinate sampled there and the token.
        coordinate = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(TOKENS)).cast("int")
        child = lambda k: F.xxhash64("node", coordinate(k), F.substring("tokens", coordinate(k) * 4 + 1, F.lit(4)))
        second = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(1_000_000)) < int((1 / THRESHOLD - 1) * 1_000_000)
        split = held.join(tokens, "rep").select("rep", F.explode(F.when(second, F.array(child(1), child(2))).otherwise(F.array(child(1)))).alias("node"))
        nodes = store.put(f"nodes-{depth}", split.distinct())
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    members = store.put("members", members)
    # Most sets meet nobody: a filter of fixed size keeps their tokens from being moved.
    tokens = marked(tokens, "rep", store.put("meeting", id_filter(F.col("rep"), members)), "meets").filter("meets").drop("meets")
    edges = store.put("edges", likely(members.join(tokens, "rep")))
    grouped = components(store, edges, "near")
    if large is not None:
        further = store.put("further", still_apart(store, large, grouped, tokens))
        if not further.isEmpty():
            # The groups as stars and what joins them: far fewer steps than from the links.
            grouped = components(store, grouped.toDF("u", "v").union(further), "groups")
    store.drop("large", "blocks", "members", "meeting", *(f"{name}-{k}" for name in ("count", "nodes") for k in range(1, DEPTH + 1)))
    return grouped


def in_parts(held: DataFrame) -> DataFrame:
    """node and rep for nodes too large to compare whole: parts of bounded size, each with the leaders of its node."""
    leaders = held.groupBy("node").agg(F.first("n").alias("n"), F.array_distinct(F.array(*(F.min_by("rep", F.xxhash64("rep", F.lit(k))) for k in range(LEADERS)))).alias("leaders"))
    parts = F.ceil(F.col("n") / BUCKET)
    own = held.select(F.xxhash64("node", F.pmod(F.xxhash64("rep", "node"), parts)).alias("node"), "rep")
    led = leaders.select("node", "leaders", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    return own.union(led.select(F.xxhash64("node", "part").alias("node"), F.explode("leaders").alias("rep"))).distinct()


def still_apart(store: Workspace, large: DataFrame, near: DataFrame, tokens: DataFrame) -> DataFrame:
    """Candidate links (u, v) between those sets of large nodes (node, rep) that aren't in one group (node, root) yet."""
    rooted = large.join(near.select(F.col("node").alias("rep"), "root"), "rep", "left").select("node", "rep", F.coalesce("root", "rep").alias("root"))
    count = rooted.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.min("root").alias("low"), F.max("root").alias("high"))
    count = count.filter("low <> high").groupBy("n", "who").agg(F.min("node").alias("node"))
    parts = count.select("node", F.ceil(F.col("n") / NODE_SETS).alias("blocks"))
    mine, other = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    spread = rooted.join(parts, "node").withColumn("mine", mine).withColumn("other", other)
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    blocks = store.put("blocks", spread.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), side.alias("side"), "rep", "root"))
    return likely_apart(blocks.join(tokens, "rep"))


def join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and n_links (other documents linked) of each row."""
    store = Workspace(spark, "setjoin")
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    rows = store.put("rows", embed(docs, runs_for()))
    sets = rows.filter("size > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("nodes").alias("nodes"), F.first("size").alias("size"))
    sets = store.put("sets", sets)
    named = sets.filter("rep is not null")
    grouped = candidates(store, rows, named)
    grouped = store.put("grouped", grouped.union(grouped.select("root", "root").distinct()).toDF("rep", "root"))
    held = store.put("sized", grouped.join(named.groupBy("rep").agg(F.sum("copies").alias("copies"), F.max("size").alias("size")), "rep"))
    # Groups above a block are cut by size, as only sets of neighbouring sizes can be linked, and then by hash.
    full = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    step = F.floor(F.log("size") / math.log(SIZE_STEP)).cast("int")
    load = held.groupBy("root", step.alias("step")).agg(full.alias("parts"), F.count("*").alias("n"), F.sum("size").alias("size"))
    several = (F.sum("n") > BLOCK_SETS) | (F.sum("size") > BLOCK_SHINGLES)
    load = store.put("load", load.groupBy("root").agg(F.when(several, F.map_from_entries(F.collect_list(F.struct("step", "parts")))).alias("parts"), F.sum("n").alias("n")))
    held = look_up(held, "root", load, held.count()).withColumn("step", step)
    at = lambda step, part: f"{step} * {1 << 40}L + {part}"
    held = held.withColumn("mine", F.expr(f"if(parts is null, 0L, {at('step', 'pmod(xxhash64(rep), parts[step])')})"))
    steps = "filter(array(step - 1, step, step + 1), s -> map_contains_key(parts, s))"
    held = held.withColumn("others", F.expr(f"if(parts is null, array(0L), flatten(transform({steps}, s -> transform(sequence(0L, parts[s] - 1), p -> {at('s', 'p')}))))"))
    held = store.put("held", held.select("rep", "root", "copies", "mine", "others", F.col("parts").isNotNull().alias("split")))
    near = marked(docs, "doc_id", store.put("held-bits", id_filter(F.col("rep"), held)), "near").filter("near").select("doc_id", "text")
    texts = near.join(held.hint("merge"), F.col("doc_id") == F.col("rep"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    spread = texts.withColumn("other", F.explode("others"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    judged = store.put("judged", exact(spread.select(F.xxhash64("root", low, high).alias("block"), side.alias("side"), "rep", "copies", "text")))
    links = judged.groupBy("rep").agg(F.sum("links").alias("links"))
    # Labels of groups in one block are final; the others' are edges of one more search.
    several = held.filter("split").select("rep")
    whole = judged.join(several, "rep", "left_anti").select("rep", F.col("label").alias("class"))
    across = judged.join(several.distinct(), "rep", "left_semi").filter("rep <> label").select(F.col("rep").alias("u"), F.col("label").alias("v"))
    if not across.isEmpty():
        whole = whole.union(components(store, across, "classes"))
    found = links.join(whole, "rep", "left")
    known = sets.join(found, "rep", "left").select("a", "b", "copies", F.coalesce("class", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    known = store.put("known", known)
    store.drop("sets", "edges", "further", "grouped", "sized", "load", "held", "judged", "classes")
    return rows.select("doc_id", "a", "b").join(known, ["a", "b"], "left").select("doc_id", F.coalesce("class_id", F.when(F.col("a").isNull(), F.col("doc_id"))).alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"))


def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, documents(spark, sf_dir))


#: op10_chosen_path_join in DuckDB: all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE common.n >= 0.8::DOUBLE * (x.n + y.n - common.n)),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other),
classes AS (SELECT doc_id, min(other) AS class_id FROM reached GROUP BY 1),
links AS (SELECT a AS doc_id, count(*) AS n_links FROM edges GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links FROM documents LEFT JOIN classes USING (doc_id) LEFT JOIN links USING (doc_id)
"""
