"""Removal of repeated substrings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if a string of LENGTH bytes covers it that also starts earlier (in a document of lesser id, or earlier
in the same one). Strings never cross documents and are judged on the input.

No task sees the corpus, so the starts are dealt out first. Each string of LENGTH bytes has an anchor, its ANCHOR-byte
piece of least hash: equal strings have equal anchors at equal places, so all starts of a string meet under its anchor's
hash. Consecutive starts with one anchor form a fragment. Equal fragments, told by a 128-bit digest of their bytes, are
copies, and the first of them stands for all: its text goes into the transform once, with the number of its copies as weight.
The different fragments of an anchor that has several, or copies, are concatenated and their Burrows-Wheeler transform is
formed (of suffixes sorted by their first LENGTH bytes or more, as no longer prefix matters): breadth-first backward extension
of intervals derives the lengths of the common prefixes of neighbouring suffixes, by increasing length, and stops at LENGTH.
What is then still undivided are the groups of equal strings. A group whose weight is above one is repeated: all but its first
start are repeats, those in copies too, which lie where they lie in the fragment that stands for them.

A transform takes up to CHUNK bytes. An anchor with more fragments than fit is lengthened: a string whose anchor stands in
its first half has more common bytes after the anchor, one whose anchor stands in its second half has more before it. So
each fragment is cut into two, by the anchor's place, and the longer pieces that all strings of such a half have in common
are the new anchors; copies are merged again, and halves that are still crowded are cut again, until a half is one place.

Skew: up to IN_BATCH copies of a fragment in a batch, and COPIES in all, go by the transform; further ones, copies of heavy
fragments, and those of crowded anchors are repeats by their digest alone. A first pass counts anchors and fragments in a sketch of fixed size;
what is far above the mean there is heavy. Copies of heavy fragments are merged over a whole task, and fragments of
heavy anchors are dealt out by their own hash and lengthened at once, so a passage that all documents share is a row of each
task, and its edges are nobody's hot key. The sketch decides where rows go, never what is found.

Edge cases: null and empty texts, and texts below LENGTH bytes, lose nothing; texts of any length are read whole; rows
without an id lose nothing and are nobody's earlier document; equal rows with one id are one document; different texts
under one id are documents of their own, in the order of their tags (TAG_BITS bits of the text's CRC-32); an empty table
gives an empty result; other columns, whatever their names, aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..arrow import arrow_map
from .common import FACTOR, FACTOR_2, INVERSE, Workspace, byte_view, documents, mixed, powers, prefix_hash, row_pieces, span_hash
from .setjoin import bounds

#: Bytes of a repeat; bytes of an anchor.
LENGTH, ANCHOR = 100, 32
#: Bytes of text hashed at once; bytes that are transformed at once; most fragments of an anchor that isn't crowded, so that they fit.
PIECE, CHUNK, MANY = 1 << 16, 1 << 19, 1000
#: Copies of a fragment, in a batch and in all, of which the transform's intervals decide; the digest decides of further ones.
IN_BATCH, COPIES = 8, 64
#: Bins of the sketch, as a power of two. A bin is heavy above so many times the mean, and above this share of a partition's rows.
SKETCH_BITS, ABOVE_MEAN, OF_PARTITION = 18, 2, 0.1
#: Keys that are broadcast as heavy, at most; parts in which copies are merged before they meet.
MOST_HEAVY, SALTS = 10_000, 64
#: Bits of a text's tag; it shares a number with a start (31 bits), an anchor's place and a count of starts (7 bits each).
TAG_BITS = 18
#: Bytes that UTF-8 never has: after each fragment, and at the very end.
PART, STOP = 0xFF, 0xFE


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive numbers, from running minima of blocks in both directions."""
    whole = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(x)] = x
    blocks = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def fragments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, two fragment hashes, row, first and last start and place of the anchor after the first start, of all fragments of the rows."""
    none = (*(np.zeros(0, np.uint64) for _ in range(3)), *(np.zeros(0, np.int64) for _ in range(4)))
    if len(data) < LENGTH:
        return none
    prefix = prefix_hash(data)
    n = len(data) - ANCHOR + 1
    pieces = mixed((prefix[ANCHOR:] - prefix[:-ANCHOR]) * powers(INVERSE[FACTOR], len(prefix))[:n])
    # The place in the low bits: of equal hashes the leftmost is least.
    bits = np.uint64((2 * PIECE).bit_length())
    least = sliding_least(pieces >> bits << bits | np.arange(n, dtype=np.uint64), LENGTH - ANCHOR + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(at)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= at[row + 1])
    if not len(start):
        return none
    a = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last, a = start[begin], start[np.append(begin[1:], len(start)) - 1], a[begin]
    second = span_hash(prefix_hash(data, FACTOR_2), first, last + LENGTH, FACTOR_2)
    return pieces[a], span_hash(prefix, first, last + LENGTH), second, row[first], first - at[row[first]], last - at[row[first]], a - first


def all_fragments(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """fragments() of a batch by pieces. A row longer than a piece is cut between two starts, which may part a fragment but loses no string."""
    found = []
    for a, b in row_pieces(at, PIECE):
        begin, end = int(at[a]), int(at[b])
        if end - begin <= PIECE + LENGTH:
            got = fragments(data[begin:end], at[a : b + 1] - begin)
            found.append((*got[:3], got[3] + a, *got[4:]))
            continue
        for o in range(0, end - begin - LENGTH + 1, PIECE):
            piece = data[begin + o : min(begin + o + PIECE + LENGTH - 1, end)]
            got = fragments(piece, np.array([0, len(piece)]))
            found.append((*got[:3], got[3] + a, got[4] + o, got[5] + o, got[6]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [*fragments(data[:0], at[:1])]


def first_fragments(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of a batch: anchor, fragment (two hashes), doc_id and packed place of its fragments; doc_id, tag, first and last of runs of repeats.

    Of copies in the batch the first IN_BATCH stay; all starts of the others are repeats.
    """
    data, at = byte_view(batch["text"])
    anchor, f, g, row, first, last, place = all_fragments(data, at)
    doc, tag = batch["doc_id"].to_numpy()[row], batch["tag"].to_numpy()[row].astype(np.int64)
    order = np.lexsort((first, tag, doc, g, f))
    anchor, f, g, doc, tag, first, last, place = (x[order] for x in (anchor, f, g, doc, tag, first, last, place))
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (g[1:] != g[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    other = ~new & ~((doc == doc[head]) & (tag == tag[head]) & (first == first[head]))  # the rest are equal rows
    again = other & (np.arange(len(f)) - head >= IN_BATCH)
    packed = tag << 45 | first << 14 | place << 7 | (last - first)
    return [x[new | other & ~again] for x in (anchor, f, g, doc, packed)], joined_runs(doc[again], tag[again], first[again], last[again])


def joined_runs(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Starts that follow each other in a document joined to runs."""
    order = np.lexsort((last, first, tag, doc))
    doc, tag, first, last = doc[order], tag[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (first[1:] > last[:-1] + 1)
    begin = np.flatnonzero(new)
    return [doc[begin], tag[begin], first[begin], np.maximum.reduceat(last, begin) if len(begin) else last]


def bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def heavy_bins(docs: DataFrame) -> np.ndarray:
    """Which bins of anchors (row 0) and of fragments (row 1) hold far more first fragments of batches than the mean.

    A task sends only the bins that stand above its own mean, so what it sends doesn't grow with its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << SKETCH_BITS), np.int64)
        for batch in batches:
            (anchor, f, *_), _ = first_fragments(batch)
            counts[0] += np.bincount(bins(anchor), minlength=1 << SKETCH_BITS)
            counts[1] += np.bincount(bins(f), minlength=1 << SKETCH_BITS)
        total = counts[0].sum()
        flat = counts.ravel()
        above = np.flatnonzero(flat > max(1, ABOVE_MEAN * total / (1 << SKETCH_BITS)))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(above, -1)), pa.array(np.append(flat[above], total))], ["bin", "n"])

    found = arrow_map(docs, run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # a row for each bin at most
    bin_, n = found["bin"].to_numpy(), found["n"].to_numpy()
    total = n[bin_ < 0].sum()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(ABOVE_MEAN * total / (1 << SKETCH_BITS), OF_PARTITION * total / partitions, 1)
    out = np.zeros(2 << SKETCH_BITS, bool)
    out[bin_[(bin_ >= 0) & (n > least)]] = True
    return out.reshape(2, -1)


#: Kinds of rows that find() sends: fragments of common anchors, fragments of heavy ones, runs of repeats.
COMMON, HEAVY, REPEAT = 0, 1, 2


def find(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """Fragments and runs of repeats: kind, place (where rows meet), anchor, fragment (f, g), doc_id, at (packed). A run's last start is in anchor."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(heavy))
    schema = "kind tinyint, place bigint, anchor bigint, f bigint, g bigint, doc_id bigint, at bigint"

    def rows(kind: np.ndarray, anchor: np.ndarray, f: np.ndarray, g: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        place = np.where(kind == COMMON, anchor, mixed(anchor ^ f))
        columns = [pa.array(kind, pa.int8()), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (place, anchor, f, g, doc, at))]
        return pa.RecordBatch.from_arrays(columns, ["kind", "place", "anchor", "f", "g", "doc_id", "at"])

    def repeat_rows(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        return rows(np.full(len(doc), REPEAT), last.astype(np.uint64), mixed(doc.astype(np.uint64)), np.zeros(len(doc), np.uint64), doc, tag << 45 | first << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool).reshape(2, -1)
        waiting: dict[tuple[int, int], tuple[int, int, int]] = {}  # of each heavy fragment, the first of the task so far
        for batch in batches:
            (anchor, f, g, doc, at), repeats = first_fragments(batch)
            common = known[1][bins(f)]
            more = []
            for a, x, y, d, p in zip(*(v[common].tolist() for v in (anchor, f, g, doc, at)), strict=True):
                other = waiting.get((x, y))
                if other is None or (d, p >> 14) < (other[0], other[1] >> 14):
                    waiting[x, y] = d, p, a
                    if other is None:
                        continue
                    d, p = other[:2]
                elif (d, p >> 14) == (other[0], other[1] >> 14):  # an equal row
                    continue
                more.append((d, p >> 45, p >> 14 & 0x7FFFFFFF, (p >> 14 & 0x7FFFFFFF) + (p & 127)))
            if more:
                extra = np.array(more, np.int64).T
                repeats = joined_runs(*(np.concatenate([a, b]) for a, b in zip(repeats, extra, strict=True)))
            anchor, f, g, doc, at = (v[~common] for v in (anchor, f, g, doc, at))
            yield rows(np.where(known[0][bins(anchor)], HEAVY, COMMON), anchor, f, g, doc, at)
            yield repeat_rows(*repeats)
        if waiting:
            anchor = np.array([v[2] for v in waiting.values()], np.uint64)
            f, g = np.array([*waiting], np.uint64).T
            doc, at = (np.array([v[k] for v in waiting.values()], np.int64) for k in range(2))
            yield rows(np.where(known[0][bins(anchor)], HEAVY, COMMON), anchor, f, g, doc, at)

    return arrow_map(docs, run, schema)


def meet(found: DataFrame) -> DataFrame:
    """Of the fragments: repeats (anchor null), and the fragments of anchors that have several or are heavy (crowded).

    Equal fragments of an anchor have one number; the first has ``copy`` false. Rows come in the order of anchor and fragment and
    are passed one batch at a time; of the last fragment its first row is kept in mind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last fragment's first row, its number, and how many rows followed it; whether it was sent on; whether its anchor has another.
        head, number_, followed, told, several = None, 0, 0, True, False
        for batch in batches:
            kind, place, anchor, f, g, doc, at = (batch[c].to_numpy() for c in ("kind", "place", "anchor", "f", "g", "doc_id", "at"))
            done = kind == REPEAT
            runs_ = [doc[done], at[done], anchor[done]]
            kind, place, anchor, f, g, doc, at = (x[~done] for x in (kind, place, anchor, f, g, doc, at))
            out = [runs_]
            asked: list = []
            if len(kind):
                if head is not None:
                    kind, place, anchor, f, g, doc, at = (np.concatenate([[h], x]) for h, x in zip(head, (kind, place, anchor, f, g, doc, at), strict=True))
                new_anchor, new = np.ones(len(kind), bool), np.ones(len(kind), bool)
                new_anchor[1:] = (place[1:] != place[:-1]) | (anchor[1:] != anchor[:-1])
                new[1:] = new_anchor[1:] | (f[1:] != f[:-1]) | (g[1:] != g[:-1])
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                start = at >> 14
                other = ~new & ~((doc == doc[lead]) & (start == start[lead]))
                rank = np.arange(len(kind)) - lead + np.where(lead == 0, followed, 0)
                copy = other & (kind == COMMON) & (rank <= COPIES)
                again = other & ~copy
                group = np.cumsum(new_anchor) - 1
                many = np.bincount(group, weights=new | copy) > 1
                if head is not None:
                    many[0] |= several
                many |= kind[new_anchor] == HEAVY
                send = new & many[group] | copy
                if head is not None and told:
                    send[0] = False
                out.append([doc[again], start[again] << 14, (start[again] & 0x7FFFFFFF) + (at[again] & 127)])
                number = number_ + np.cumsum(new) - 1
                asked = [x[send] for x in (doc, at, anchor, kind, number, copy)]
                before = head is not None and told
                last = int(lead[-1])
                followed = len(kind) - 1 - last + (followed if last == 0 else 0)
                several = bool(many[-1])
                told = several or (last == 0 and before)
                head, number_ = tuple(x[last] for x in (kind, place, anchor, f, g, doc, at)), int(number[-1])
            doc_, at_, last_ = (np.concatenate([o[k] for o in out]) for k in range(3))
            n = len(doc_)
            if n:
                none = [pa.nulls(n, x) for x in (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_), pa.array((at_ >> 45).astype(np.int32)), pa.array((at_ >> 14 & 0x7FFFFFFF).astype(np.int32)), pa.array(last_.astype(np.int32)), *none], names)
            if len(asked) and len(asked[0]):
                doc_, at_, anchor_, kind_, of, copy = asked
                first = at_ >> 14 & 0x7FFFFFFF
                yield pa.RecordBatch.from_arrays([pa.array(doc_), pa.array((at_ >> 45).astype(np.int32)), pa.array(first.astype(np.int32)), pa.array((first + (at_ & 127)).astype(np.int32)), pa.array(anchor_), pa.array((at_ >> 7 & 127).astype(np.int32)), pa.array(kind_ == HEAVY), pa.array(of), pa.array(copy)], names)

    names = ["doc_id", "tag", "first", "last", "anchor", "place", "crowded", "number", "copy"]
    schema = "doc_id bigint, tag int, first int, last int, anchor bigint, place int, crowded boolean, number bigint, copy boolean"
    return arrow_map(found.repartition("place").sortWithinPartitions("place", "anchor", "f", "g", "doc_id", "at"), run, schema)


def fetch(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """key (the anchor), place, crowded, number, doc_id, tag, first, last and bytes of the fragments asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = batch["asks"]
            sizes = np.diff(asks.offsets.to_numpy())
            flat = asks.flatten()
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            row = np.repeat(np.arange(len(batch)), sizes)
            data, at = byte_view(batch["text"])
            raw = data.tobytes()
            begin = at[row] + first
            strings = [raw[a:b] for a, b in zip(begin.tolist(), (begin + last - first + LENGTH).tolist(), strict=True)]
            of = pa.array(row)
            columns = [flat.field("anchor"), flat.field("place"), flat.field("crowded"), flat.field("number"), batch["doc_id"].take(of), batch["tag"].take(of), flat.field("first"), flat.field("last"), pa.array(strings, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "place", "crowded", "number", "doc_id", "tag", "first", "last", "bytes"])

    lists = asked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "place", "crowded", "number", "first", "last")).alias("asks"))
    joined = docs.join(lists, ["doc_id", "tag"]).select("doc_id", "tag", "text", "asks")
    return arrow_map(joined, run, "key bigint, place int, crowded boolean, number bigint, doc_id bigint, tag int, first int, last int, bytes binary")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first LENGTH bytes or more; what is equal so far stays in any order.

    Ranks by a few bytes are doubled in reach; a rank, that of what follows and the place are sorted as one number.
    """
    n = len(text)
    width = n.bit_length()
    if 3 * width > 63:
        raise ValueError(f"{n} bytes are too many to transform at once")
    place, mask = np.arange(n, dtype=np.uint64), np.uint64((1 << width) - 1)
    there = np.zeros(256, bool)
    there[text] = True
    number = np.cumsum(there).astype(np.uint64)  # from 1, as 0 stands for the end
    letter, bits = number[text], int(number[-1]).bit_length()
    reach = (64 - width) // bits
    key = letter.copy()
    for k in range(1, reach):
        key <<= np.uint64(bits)
        key[: n - k] |= letter[k:]
    key = key << np.uint64(width) | place
    while True:
        key.sort()
        order = (key & mask).astype(np.int64)
        if reach >= LENGTH:
            return order
        key >>= np.uint64(width)
        step = np.zeros(n, np.uint64)
        np.cumsum(key[1:] != key[:-1], out=step[1:])
        if step[-1] == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = step
        key = rank << np.uint64(2 * width) | place
        key[: n - reach] |= (rank[reach:] + np.uint64(1)) << np.uint64(width)
        reach *= 2


def undivided(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and for each whether it shares LENGTH bytes or more with the one before.

    ``text`` ends with STOP. The search holds intervals of suffixes that begin with a common string. It extends all strings
    of one length by each byte that stands before them; where an extended interval ends at a place that no shorter string
    has divided, the common prefix there has that length, and the interval goes on. It stops before LENGTH.
    """
    n = len(text)
    order = suffix_order(text)
    before = text[order - 1]
    stable = np.argsort(before, kind="stable")
    step = np.empty(n, np.int32)  # where the suffix that is one byte longer stands
    step[stable] = np.arange(n, dtype=np.int32)
    after = np.full(n, n, np.int32)  # the next place with the same byte before it
    same = before[stable[1:]] == before[stable[:-1]]
    after[stable[:-1][same]] = stable[1:][same]
    earlier = np.full(n, -1, np.int32)
    earlier[stable[1:][same]] = stable[:-1][same]
    divided = np.zeros(n + 1, bool)
    divided[[0, n]] = True
    low, high = np.zeros(1, np.int32), np.full(1, n - 1, np.int32)
    for _ in range(LENGTH):
        one = low == high
        alone = step[low[one]]
        low, high = low[~one], high[~one]
        size = high - low + 1
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)
        last = after[place] > np.repeat(high, size)
        first = earlier[place] < np.repeat(low, size)
        # An extended interval goes from the step of its byte's first place to that of its last. Those of one length are
        # disjoint, so in order the first places belong to the last ones.
        low = np.sort(np.concatenate([alone, step[place[first]]]))
        high = np.sort(np.concatenate([alone, step[place[last]]]))
        fresh = ~divided[high + 1]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        divided[high + 1] = True
    return order, ~divided[:n]


def repeats_in(strings: list[bytes], doc: np.ndarray, tag: np.ndarray, first: np.ndarray, last: np.ndarray, copies: list[np.ndarray]) -> list[np.ndarray]:
    """Runs (doc_id, tag, first, last) of the strings of LENGTH bytes that start earlier in another place of these fragments.

    ``copies`` are doc_id, tag and first start of further places of fragments, and the fragments' places in ``strings``.
    """
    sizes = np.array([*map(len, strings)]) + 1
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(bytes([PART]).join([*strings, bytes([STOP])]), np.uint8)
    order, joined = undivided(text)
    number = np.cumsum(~joined) - 1
    fragment = np.append(np.repeat(np.arange(len(strings)), sizes), 0)
    start = np.arange(len(text)) - begin[fragment] + first[fragment]
    valid = start <= last[fragment]
    valid[-1] = False
    weight = 1 + np.bincount(copies[3], minlength=len(strings))
    width = np.bincount(number, weights=np.where(valid, weight[fragment], 0)[order])
    use = (width[number] > 1) & valid[order]
    places, g = order[use], number[use]
    of = fragment[places]
    d, t, s = doc[of], tag[of], start[places]
    by = np.lexsort((s, t, d, g))
    of, g, d, t, s = of[by], g[by], d[by], t[by], s[by]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = ~((d == d[head]) & (t == t[head]) & (s == s[head]))
    # What is repeated in a fragment that has copies is, in each copy, a repeat of its first start.
    its, _, a, b = joined_runs(of, np.zeros_like(of), s, s)
    low, high = np.searchsorted(its, copies[3]), np.searchsorted(its, copies[3], "right")
    c = np.repeat(np.arange(len(low)), high - low)
    r = np.arange(len(c)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[c]
    shift = copies[2][c] - first[copies[3][c]]
    parts = (d[again], copies[0][c]), (t[again], copies[1][c]), (s[again], a[r] + shift), (s[again], b[r] + shift)
    return joined_runs(*map(np.concatenate, parts))


def whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole groups, from batches ordered by key, and (True) tables of rows of groups with more than ``most`` rows."""
    held: list[pa.RecordBatch] = []
    last, over = None, False
    for batch in batches:
        if not len(batch):
            continue
        at = bounds(batch["key"].to_numpy())
        begin = 0
        if last == batch["key"][0].as_py():
            begin = int(at[1])
            held.append(batch.slice(0, begin))
            if over or sum(map(len, held)) > most:
                yield pa.Table.from_batches(held), True
                held, over = [], True
        if begin == len(batch):
            continue
        if held:
            yield pa.Table.from_batches(held), False
        end = int(at[-2])
        if end > begin:
            middle = batch.slice(begin, end - begin)
            sizes = np.diff(at[(at >= begin) & (at <= end)])
            crowded = pa.array(np.repeat(sizes > most, sizes))
            for mask, large in ((pc.invert(crowded), False), (crowded, True)):
                part = middle.filter(mask)
                if len(part):
                    yield pa.Table.from_batches([part]), large
        held, last, over = [batch.slice(end)], batch["key"][-1].as_py(), False
        if len(held[0]) > most:
            yield pa.Table.from_batches(held), True
            held, over = [], True
    if held:
        yield pa.Table.from_batches(held), False


def compare(fetched: DataFrame) -> DataFrame:
    """Runs of repeated starts (bytes null) among the fragments of each key, and the fragments of crowded keys as they came.

    Rows without bytes are copies of the fragment of their key and number; copies of a crowded key are repeats.
    """
    names = ["place", "doc_id", "tag", "first", "last", "bytes"]

    def runs(columns: list[np.ndarray]) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(columns[0]), *(pa.array(x.astype(np.int32)) for x in columns[1:]), pa.nulls(n, pa.binary())], names)

    def transformed(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(tables)
        copy = table["bytes"].is_null().to_numpy()
        key, number = table["key"].to_numpy(), table["number"].to_numpy()
        order = np.lexsort((copy, number, key))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(number[order]) != 0)
        stands = np.empty(len(order), np.int64)
        stands[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        columns = [table[c].to_numpy() for c in ("doc_id", "tag", "first", "last")]
        copies = [x[copy] for x in (*columns[:3], (np.cumsum(~copy) - 1)[stands])]
        found = repeats_in(table.filter(pa.array(~copy))["bytes"].to_pylist(), *(x[~copy] for x in columns), copies)
        if len(found[0]):
            yield runs(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size = [], 0
        for table, crowded in whole_groups(batches, MANY):
            if crowded:
                yield from table.select(names).combine_chunks().to_batches()
                continue
            at = bounds(table["key"].to_numpy())
            sizes = np.diff(at)
            table = table.filter(pa.array(np.repeat(sizes > 1, sizes)))  # one fragment has nobody to be compared with
            if not len(table):
                continue
            ready.append(table)
            size += table["bytes"].nbytes
            if size >= CHUNK:
                yield from transformed(ready)
                ready, size = [], 0
        if ready:
            yield from transformed(ready)

    return arrow_map(fetched.select("key", "number", *names).repartition("key").sortWithinPartitions("key"), run, "place int, doc_id bigint, tag int, first int, last int, bytes binary")


def lengthened(rows: DataFrame) -> DataFrame:
    """Fragments of crowded anchors, each cut into two by the anchor's place in its strings (low to high), with the new anchors' hashes as keys.

    All strings whose anchor stands between places a and b have the bytes from a before the anchor to LENGTH - b after its start in common.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b"))))
    least, most = F.greatest("half.a", F.col("place") - (F.col("last") - F.col("first"))), F.least("half.b", "place")
    cut = rows.filter("low < high").withColumn("half", half).withColumn("least", least).withColumn("most", most).filter("least <= most")
    cut = cut.select(
        F.col("half.a").alias("low"),
        F.col("half.b").alias("high"),
        F.col("most").alias("place"),
        "doc_id",
        "tag",
        (F.col("first") + F.col("place") - F.col("most")).alias("first"),
        (F.col("first") + F.col("place") - F.col("least")).alias("last"),
        F.substring(F.col("bytes"), F.col("place") - F.col("most") + 1, F.col("most") - F.col("least") + LENGTH).alias("bytes"),
    )
    core = F.substring(F.col("bytes"), F.col("place") - F.col("low") + 1, LENGTH - F.col("high") + F.col("low"))
    return cut.select(F.xxhash64("low", core).alias("key"), "*")


def first_of_copies(rows: DataFrame) -> DataFrame:
    """rows with ``again``: whether equal bytes start earlier. Copies are merged in parts first, so no task takes all copies of a fragment."""
    order = ["doc_id", "tag", "first"]
    rows = rows.withColumn("digest", F.md5("bytes")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    rows = rows.withColumn("of_part", F.rank().over(W.partitionBy("digest", "part").orderBy(*order)))
    alone = F.when(F.col("of_part") > 1, F.xxhash64(*order))
    rows = rows.withColumn("alone", alone).withColumn("of_all", F.rank().over(W.partitionBy("digest", "alone").orderBy(*order)))
    return rows.withColumn("again", (F.col("of_part") > 1) | (F.col("of_all") > 1)).drop("digest", "part", "of_part", "alone", "of_all")


def all_repeats(store: Workspace, fetched: DataFrame, copies: DataFrame) -> DataFrame:
    """Runs of repeats among the fetched fragments and their copies; crowded anchors are lengthened step by step."""
    run = ("doc_id", "tag", "first", "last")
    ends = lambda df, low, high: df.withColumn("low", F.lit(low)).withColumn("high", F.lit(high))
    done = store.put("compared-0", compare(fetched.filter("not crowded").unionByName(copies.withColumnRenamed("anchor", "key"), True)))
    found = done.filter("bytes is null").select(*run)
    crowd = ends(done.filter("bytes is not null").unionByName(fetched.filter("crowded").drop("key", "crowded", "number")), 0, LENGTH - ANCHOR)
    for step in range(1, 9):
        if crowd.isEmpty():
            return found
        halves = store.put(f"halves-{step}", first_of_copies(lengthened(crowd)))
        found = found.unionByName(halves.filter("again").select(*run))
        rest = halves.filter("not again and low < high")
        if rest.isEmpty():
            return found
        keys = rest.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > MANY)
        keys = store.put(f"keys-{step}", keys.orderBy(F.desc("n"), "key").limit(MOST_HEAVY).select("key"))
        heavy = rest.join(F.broadcast(keys), "key", "left_semi")
        # All rows of a step have halves of one width, and a key is of one half.
        common = rest.join(F.broadcast(keys), "key", "left_anti").withColumn("place", F.col("place") * 256 + F.col("low")).withColumn("place", F.col("place") * 256 + F.col("high"))
        done = store.put(f"compared-{step}", compare(common.withColumn("number", F.monotonically_increasing_id())))
        found = found.unionByName(done.filter("bytes is null").select(*run))
        passed = done.filter("bytes is not null").select(F.floor(F.col("place") / 65536).cast("int").alias("place"), *run, "bytes", (F.floor(F.col("place") / 256) % 256).cast("int").alias("low"), (F.col("place") % 256).cast("int").alias("high"))
        crowd = passed.unionByName(heavy.select("place", *run, "bytes", "low", "high"))
    return found


def runs_of(repeats: DataFrame) -> DataFrame:
    """doc_id, tag and runs of removed bytes (start, end), from starts of repeated strings."""
    w = "partition by doc_id, tag order by first, last"
    reach = repeats.selectExpr("doc_id", "tag", "first", f"last + {LENGTH} as end", f"max(last + {LENGTH}) over ({w} rows between unbounded preceding and 1 preceding) as reached")
    marked = reach.selectExpr("doc_id", "tag", "first", "end", "sum(if(reached >= first, 0, 1)) over (partition by doc_id, tag order by first, end rows between unbounded preceding and current row) as run")
    merged = marked.groupBy("doc_id", "tag", "run").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def remove(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, raw bytes and runs of all rows, and the bytes that remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for raw, spans in zip(batch["raw"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                at, parts = 0, []
                for s in spans or ():
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                kept.append(b"".join([*parts, raw[at:]]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["raw"], batch["runs"], pa.array(kept, pa.binary())], ["doc_id", "raw", "runs", "kept"])

    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    # Rows without an id find no runs, and are spread by their text.
    rows = docs.select("doc_id", raw.alias("raw"), F.coalesce("doc_id", F.xxhash64("text")).alias("id"), F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("tag")).alias("its_tag"))
    joined = rows.join(runs.toDF("of", "tag", "runs"), (F.col("id") == F.col("of")) & (F.col("its_tag") == F.col("tag")), "left").select("doc_id", "raw", "runs")
    return arrow_map(joined, run, "doc_id bigint, raw binary, runs array<struct<start: int, end: int>>, kept binary")


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, raw bytes, removed runs and kept bytes of each row."""
    store = Workspace(spark, "substrings")
    tag = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).bitwiseAND((1 << TAG_BITS) - 1).cast("int")
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", tag.alias("tag"))
    known = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    met = store.put("met", meet(find(known, heavy_bins(known))))
    fetched = store.put("fetched", fetch(known, met.filter("anchor is not null and not copy")))
    further = all_repeats(store, fetched, met.filter("copy").drop("copy"))
    runs = store.put("runs", runs_of(met.filter("anchor is null").select("doc_id", "tag", "first", "last").unionByName(further)))
    store.drop("met", "fetched", *(f"{name}-{k}" for name in ("compared", "halves", "keys") for k in range(9)))
    return remove(docs, runs)


def op8_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate(spark, documents(spark, sf_dir))
    size = F.octet_length("raw").cast("bigint")
    return done.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.coalesce(F.size("runs"), F.lit(0)).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: op8_interval_expansion in DuckDB: all strings of 100 bytes, as hex, ordered by document and start.
ORACLE = r"""
WITH told AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM told WHERE n >= 100)),
again AS (SELECT doc_id, p FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
begun AS (SELECT doc_id, p, p > coalesce(max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100, -1) AS new FROM again),
numbered AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM begun),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY 1),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (coalesce(g.b, n) - g.a)), '' ORDER BY g.a) AS h FROM gaps g JOIN told USING (doc_id) GROUP BY 1),
gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT t.doc_id, t.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM told t LEFT JOIN gone USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
