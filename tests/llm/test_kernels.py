"""The byte kernels against plain Python, on generated input."""

import itertools

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe, common, media, quality, secrets, setjoin, substrings

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b\x1c日", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words(rows):
    data, at = common.byte_view(pa.array(rows, pa.string()))
    starts, ends, of = common.word_spans(data, at)
    raw = data.tobytes()
    expected = [(i, w) for i, t in enumerate(rows) for w in (t or "").encode().split()]
    assert [(int(r), raw[a:b]) for a, b, r in zip(starts, ends, of, strict=True)] == expected
    hashes = common.span_hash(common.prefix_hash(data), starts, ends)
    for (i, (_, v)), (j, (_, w)) in itertools.combinations(enumerate(expected), 2):
        assert (hashes[i] == hashes[j]) == (v == w)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingles(rows, words):
    data, at = common.byte_view(pa.array(rows, pa.string()))
    _, of = setjoin.shingles(data, at, words)
    for i, t in enumerate(rows):
        w = (t or "").encode().split()
        plain = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
        assert (of == i).sum() == len(plain)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), max_size=30))
def test_repeats(pairs):
    hashes, rows = (np.array([p[k] for p in pairs], np.uint64 if k == 0 else np.int64) for k in range(2))
    assert quality.repeats(hashes, rows).tolist() == [pairs.count(p) > 1 for p in pairs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=20), st.integers(1, 7))
def test_groups_stay_whole(sizes, batch):
    keys = [k for k, n in enumerate(sizes) for _ in range(n)]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + batch], pa.int64())], ["k"]) for i in range(0, len(keys), batch)]
    tables = [t["k"].to_pylist() for t in setjoin.groups_of(iter(batches), "k")]
    assert list(itertools.chain(*tables)) == keys
    seen = [set(t) for t in tables]
    assert sum(map(len, seen)) == len(set().union(*seen)) if seen else not keys


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 12))
def test_sliding_least(values, width):
    if width <= len(values):
        got = substrings.sliding_least(np.array(values, np.uint64), width)
        assert got.tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=3000))
def test_any_bytes_through_ogg(raw):
    payload = raw + media.PAD * (-len(raw) % media.UNIT)
    streams, faulty = media.read_ogg(media.write_ogg(payload))
    assert not faulty and media.samples_of(streams) == payload


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400))
def test_junk_is_no_ogg(raw):
    streams, _ = media.read_ogg(raw)
    assert media.samples_of(streams) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="tokensecrpawdi=: '\"_AKIA019afİ", max_size=60))
def test_secret_spans_lie_in_the_text(text):
    keywords = secrets.automaton()
    spans = secrets.scan_text(text, keywords)
    assert all(0 <= a < b <= len(text) for a, _, b in spans) and spans == sorted(spans, key=lambda s: (s[0], secrets.KINDS.index(s[1])))
    hidden = secrets.redacted(text, spans, "")
    assert len(hidden) == len(text) - len({i for a, _, b in spans for i in range(a, b)})


def test_remembered_keeps_what_is_asked_for(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    made = []
    store = bpe.Remembered(lambda k: made.append(k) or -k)
    for k in [1, 2, 3, 4, 1, 5, 1, 6, 7, 1]:
        assert store[k] == -k
    assert made.count(1) == 1 and len(store) <= 3
