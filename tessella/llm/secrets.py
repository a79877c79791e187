"""Secret scans: keyword automaton, anchored expressions near its hits, then checksums inside the tokens.

One Aho-Corasick automaton finds all keywords of a text in one pass; an expression is tried only where a keyword
stands. Tokens that carry a checksum (a CRC-32 in base 62, as code hosts and package registries issue them) are kept
only if it holds. Runs of hex digits have no keyword; a regular expression finds them directly.

Spans are in code points, the end exclusive, in the order of start, then of KINDS. Edge cases: null and empty texts have
no spans; long texts are scanned whole; repeated rows repeat; an empty table gives an empty result. ``scan`` keeps no other
columns; ``redact`` keeps all of them, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..arrow import arrow_map
from .common import crc32_sql, documents, texts

# The kinds in their order, keywords, expressions and least lengths of the base, and the checksummed tokens.
KINDS = ("assign", "access", "hex", "checked")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked"}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPANS = "array<struct<kind: string, start: int, end: int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base62(number: int, width: int) -> str:
    out = ""
    while number or len(out) < width:
        number, digit = divmod(number, 62)
        out = DIGITS[digit] + out
    return out


def checksum_holds(body: str, check: str) -> bool:
    return base62(zlib.crc32(body.encode()), 6) == check


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def lowered(text: str) -> str:
    """Lower case of the same length, so that positions hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def scan_text(text: str, keywords) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret."""
    found: list[tuple[int, str, int]] = []
    free = dict.fromkeys(KINDS, 0)  # matches of a kind don't overlap, whether they are kept or not
    for last, (kind, length) in keywords.iter(lowered(text)):
        start = last - length + 1
        if start < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                free[kind] = m.end()
                if len(m[1]) >= LEAST_VALUE:
                    found.append((start, kind, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                free[kind] = m.end()
                if m.end() - start >= LEAST_ACCESS:
                    found.append((start, kind, m.end()))
        elif (m := CHECKED.match(text, start)) and checksum_holds(m[1], m[2]):
            free[kind] = m.end()
            found.append((start, kind, m.end()))
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return found


def redacted(text: str, spans: list[tuple[int, str, int]], mark: str) -> str:
    """The text with each maximal run of spans replaced."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for a, k, b in scan_text(t, keywords)] for t in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, SPAN_TYPE)], ["doc_id", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, f"doc_id bigint, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret replaced by the mark, n_chars following if there is such a column; null texts stay null."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            clean = [t and redacted(t, scan_text(t, keywords), mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), pa.array(clean, pa.string()))

    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    out = arrow_map(inner, run, T.StructType([T.StructField(f.name, f.dataType) for f in inner.schema])).toDF(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def digests(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(documents(spark, sf_dir)))


def _matches_sql(kind: str, pattern: str, group: int = 0) -> str:
    """Table expressions: a span for each match of a kind. Before the k-th match stand k parts between matches and k - 1 matches."""
    return f"""{kind}_found AS (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS parts, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {group}) AS value FROM told),
{kind}_spans AS (SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind) + 1} AS turn, value[k] AS value, len(found[k]) AS size, (len(array_to_string(parts[1:k], '')) + len(array_to_string(found[1:k - 1], '')))::BIGINT AS a FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM {kind}_found))"""


def _oracle() -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    assign = f"""(?:{"|".join(map(either, ("password", "passwd", "secret", "token")))}|{either("api")}_?{either("key")})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    digits = " || ".join(f"substr('{DIGITS}', (crc // {62**k} % 62 + 1)::INT, 1)" for k in range(5, -1, -1))
    return f"""
WITH told AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_matches_sql("assign", assign, 1)},
{_matches_sql("access", "AKIA[A-Z0-9]+")},
{_matches_sql("hex", "[0-9a-f]{24,}")},
{_matches_sql("checked", "(?:gh[pousr]|npm)_([A-Za-z0-9]{36,})", 1)},
issued AS (SELECT *, {crc32_sql("hex(encode(substr(value, 1, 30)))", "30")} AS crc FROM checked_spans WHERE len(value) = 36),
spans AS (SELECT doc_id, kind, turn, a, a + size AS b FROM assign_spans WHERE len(value) >= {LEAST_VALUE} UNION ALL SELECT doc_id, kind, turn, a, a + size FROM access_spans WHERE size >= {LEAST_ACCESS}
    UNION ALL SELECT doc_id, kind, turn, a, a + size FROM hex_spans UNION ALL SELECT doc_id, kind, turn, a, a + size FROM issued WHERE {digits} = substr(value, 31)),
joined AS (SELECT doc_id, count(*) FILTER (turn = 1) AS n_assign, count(*) FILTER (turn = 2) AS n_access, count(*) FILTER (turn = 3) AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, turn) FILTER (turn <= 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, turn) AS spans FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM told LEFT JOIN joined USING (doc_id)
"""


#: op3_secret_scan in DuckDB: the expressions over whole texts, without the automaton.
ORACLE = _oracle()
