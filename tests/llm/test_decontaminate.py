"""Benchmark decontamination against brute force over all windows."""

import hashlib
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tessella.llm import common, decontaminate

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window):
    """(words, words hit, items) by comparing every window with every place."""
    words = words_of(text)
    hit, named = set(), set()
    for item, said in items:
        own = words_of(said)
        n = min(len(own), window)
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    named.add(item)
    return len(words), hit, sorted(i for i in named if i is not None)


def holds(spark, frame, texts, items, window=10):
    docs = frame(list(enumerate(texts)))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan(spark, docs, table, window).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        n, hit, named = plain(t, items, window)
        assert (got[d]["n_words"], {p for s in got[d]["hits"] for p in range(s["start"], s["end"])}, got[d]["items"]) == (n, hit, named)
        spans = [(s["start"], s["end"]) for s in got[d]["hits"]]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and all(a < b for a, b in spans)
    return got


ITEMS = [(7, "one two three four five six seven eight nine ten eleven"), (12, "One, TWO: three four five six seven eight nine ten!"), (3, "short item"), (30, "alone"), (30, "alone again"), (None, "nobody asks for this"), (8, None), (9, " .,;"), (10, "ÄÖ ß日本 naïve x é")]


def test_odd_texts_and_items(spark, frame, odd):
    base = "one two three four five six seven eight nine ten"
    texts = [*odd, base, base.upper().replace(" ", "\t- "), f"{base} {base} eleven", "two three four five six seven eight nine ten eleven", "short short item alone", "x alone. y", "nobody asks for this", "ÄÖ ß日本 naïve x é", "Äö ß日本 naïve x é", "one two three four five six seven eight nine"]
    got = holds(spark, frame, texts, ITEMS)
    assert got[len(odd)]["longest"] == 10 and got[len(odd)]["items"] == [7, 12]


def test_no_windows_and_empty_tables(spark, frame):
    assert holds(spark, frame, ["a b", None], [(1, None), (2, "")])[0]["hits"] == []
    docs, none = frame([(1, "a b c")]), spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.digests(decontaminate.scan(spark, docs, none)).collect()] == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert decontaminate.scan(spark, docs.limit(0), none).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 10])
@pytest.mark.parametrize("block", [100_000, 15])
def test_random_words_in_one_and_many_automata(spark, frame, monkeypatch, window, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    rng = random.Random(window)
    said = lambda n, k: " ".join(rng.choice("abcde"[:k]) for _ in range(n))
    items = [(i, said(rng.choice([0, 1, 2, 5, 9, 10, 11, 30]), 4 if i % 2 else 5)) for i in range(12)]
    texts = [said(rng.randint(0, 60), 5) for _ in range(20)] + [said(20, 5) + " " + t + " " + said(5, 5) for _, t in items]
    holds(spark, frame, texts, items, window)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), min_size=1, max_size=4), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30))
def test_longest_match_at_each_word(items, words):
    automaton = decontaminate.SuffixAutomaton(list(enumerate(items)), 3)
    inside = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a, len(i) + 1)} | {()}
    lengths = [n for _, n in automaton.lengths(words)]
    assert lengths == [next(n for n in range(i + 1, -1, -1) if tuple(words[i + 1 - n : i + 1]) in inside) for i in range(len(words))]
    assert len(automaton.link) <= 2 * sum(map(len, items)) + 1


def test_word_hashes_in_pieces(monkeypatch):
    normal, starts, ends, _ = decontaminate.normal_words(*common.byte_view(__import__("pyarrow").array(["aa b aa" + " aa" * 50 + " " + "z" * 99, "b"])))
    whole = decontaminate.word_hashes(normal, starts, ends)
    monkeypatch.setattr(decontaminate, "HASH_BYTES", 5)
    assert (decontaminate.word_hashes(normal, starts, ends) == whole).all() and len(set(whole.tolist())) == 3


def test_cleaned(spark, frame):
    base = "one two three four five six seven eight nine ten"
    docs = frame([(1, f"Before it: {base}; after it, much more is said than was said before it."), (2, base), (3, None), (4, "nothing"), (4, "nothing"), (None, "x")])
    for c in ("hits", "n_words", "text_", "c0", "a.b", "items"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = decontaminate.cleaned(spark, docs, spark.createDataFrame(ITEMS, "item_id bigint, text string"), most_covered=0.6)
    rows = out.collect()
    assert out.columns == docs.columns and all(r["a.b"] == r["hits"] == r["c0"] == "clash" for r in rows)
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in rows) == [(0, "x"), (1, "Before it: ; after it, much more is said than was said before it."), (3, ""), (4, "nothing"), (4, "nothing")]
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)


def test_query_is_the_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    found = duck.sql(contract.oracle_sql()["op11_suffix_automaton"])
    got = contract.queries()["op11_suffix_automaton"](spark, SMALL).select(*found.columns)
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall()) and any(r[-1] for r in found.fetchall())
