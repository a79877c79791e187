"""Fill-in-middle against plain slices, and back."""

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tessella.llm import common, infill

SMALL = "/root/testdata/sf0.001"


def plain_units(text, unit):
    if unit == "chars":
        return list(text)
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+$", text)
    starts = [0, *(i for i in range(1, len(text)) if text[i - 1] in " \t\n\v\f\r" and text[i] not in " \t\n\v\f\r")] if text else []
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def plain(doc_id, text, unit="chars"):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = plain_units(text, unit)
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", ["chars", "words", "lines"])
@pytest.mark.parametrize("chunk", [1 << 14, 3])
def test_odd_texts(spark, frame, odd, monkeypatch, unit, chunk):
    monkeypatch.setattr(infill, "CHUNK", chunk)
    texts = [t for t in odd if "\x85" not in (t or "")] + ["a<P>b", "x<", "<S", ">M<", "é" * 5000, "a\n\n b\tc  d\n", " lead", "<M>"] + ["one two\nthree é日🎉 four\n" * k for k in range(1, 30)]
    rows = [*enumerate(texts), (None, "no id"), (3, "word"), (None, None)]
    docs = frame(rows)
    for c in ("h", "n", "form", "output", "a.b"):
        docs = docs.withColumn(c, F.lit("clash"))
    moved = infill.transform(docs, unit).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"], r["back"]) for r in moved.collect()), key=repr)
    expected = sorted(((d is None, d or 0, *plain(d, t, unit), t or "") for d, t in rows), key=repr)
    assert got == expected and len({r[3] for r in got}) == 3


def test_empty_table_and_unknown_unit(spark, frame):
    assert infill.transform(frame([(1, "x")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.begins(np.zeros(1, np.uint8), np.zeros(1, np.uint8), "pages")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5), st.integers(1, 9), st.sampled_from(["chars", "words", "lines"]), st.data())
def test_ranks_are_routed_to_their_chunks(texts, size, unit, data):
    before, infill.CHUNK = infill.CHUNK, size
    try:
        chunked = infill.Chunked(*common.byte_view(pa.array(texts)), unit)
        parts = [plain_units(t, unit) for t in texts]
        assert chunked.units.tolist() == [len(p) for p in parts]
        ranks = np.array([data.draw(st.integers(0, len(p))) for p in parts])
        assert chunked.offsets(ranks).tolist() == [len("".join(p[:r]).encode()) for p, r in zip(parts, ranks, strict=True)]
    finally:
        infill.CHUNK = before


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    monkeypatch.setattr(infill, "CHUNK", 16)
    chunked = infill.Chunked(*common.byte_view(pa.array(["x" * 1000, "é" * 1000])))
    asked = []
    monkeypatch.setattr(chunked, "flags", lambda c, f=chunked.flags: asked.append(c) or f(c))
    assert chunked.offsets(np.array([500, 500])).tolist() == [500, 1000] and len(asked) == 2


def test_query_is_the_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = duck.sql(contract.oracle_sql()["op12_chunked_infill"])
    got = contract.queries()["op12_chunked_infill"](spark, SMALL).select(*found.columns)
    rows = found.fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in got.collect():
        n, form, a, m, output = plain(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, a, m, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())
