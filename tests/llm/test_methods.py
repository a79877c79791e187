"""Each operator against brute force, a round trip, or held-out accuracy."""

import collections
import hashlib
import math
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tessella.llm import bpe, common, langid, media, mixing, quality, registry, secrets, setjoin, sharding, substrings, toxicity

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in common.documents(spark, SMALL).select("doc_id", "text").orderBy("doc_id").collect()]


def result(spark, name, folder=SMALL):
    return {r["doc_id"]: r for r in contract.queries()[name](spark, folder).collect()}


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_bpe_is_the_librarys(spark, docs, odd, frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = result(spark, "op1_forced_boundary_bpe")
    for d, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids) and got[d]["ids_sha256"] == sha(" ".join(map(str, ids))) and got[d]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
    special = [*odd, "<|endoftext|>Straße ΑΣ İstanbul it's <|startoftext|>½ Ⅷ ﬁ á́", "<|ENDOFTEXT|>", "".join(map(chr, range(128))) * 2, "it's WE'LL a_b 12'd\x1c\x1d x\x1e\x1fy"]
    vocabulary = bpe.vocabulary_file()
    rows = bpe.decode(bpe.encode(frame(list(enumerate(special))), vocabulary), vocabulary).collect()
    for r in rows:
        ids = library.encode(special[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_are_inside_no_token():
    model = bpe.ForcedBoundaryBpe(bpe.vocabulary_file())
    parts = model.fragments("aqzxqjkb")
    assert "".join(parts) == "aqzxqjkb" and len(parts) > 1


def test_ogg_round_trip_and_faults():
    rng = random.Random(1)
    for n in (576, 1152, 576 * 9, 576 * 400):
        payload = rng.randbytes(n)
        data = media.write_ogg(payload)
        streams, faulty = media.read_ogg(data)
        assert faulty == 0 and len(streams) == media.TRACKS and media.samples_of(streams) == payload
        assert sum(s["granule"] for s in streams.values()) == n
        broken = bytearray(data)
        broken[-10] ^= 1
        streams, faulty = media.read_ogg(bytes(broken))
        assert faulty == 1 and media.samples_of(streams) is None
        assert media.samples_of(media.read_ogg(b"junk" + data)[0]) == payload
    assert media.read_ogg(b"OggS") == ({}, 1) and media.read_ogg(b"") == ({}, 0)


def test_ogg_packets_over_pages():
    packets = [b"head", bytes(70_000), b"", bytes(255), bytes(510)]
    pages = media.pages_of(9, packets, [0, 70_000, 70_000, 70_255, 70_765])
    assert len(pages) > 2
    streams, faulty = media.read_ogg(b"".join(pages))
    assert not faulty and streams[9]["packets"] == packets and streams[9]["granule"] == 70_765
    assert media.page_crc(b"123456789") == 0x89A1897F


def test_ogg_query(spark, docs):
    got = result(spark, "op2_ogg_media")
    for d, t in docs:
        raw = t.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == sha(media.write_ogg(payload)) and r["media_bytes"] == len(media.write_ogg(payload))


PLAIN_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(t):
    out = [(m.start(), 0, "assign", m.end()) for m in PLAIN_ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secrets_query(spark):
    got = result(spark, "op3_secret_scan", SF)
    rows = common.documents(spark, SF).select("doc_id", "text").collect()
    total = 0
    for d, t in rows:
        spans = plain_spans(t)
        total += len(spans)
        kinds = collections.Counter(k for k, _, _ in spans)
        assert got[d]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert (got[d]["n_assign"], got[d]["n_access"], got[d]["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
    assert total


def test_secrets_on_hard_texts():
    body = "aZ09" * 7 + "bb"
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()), 6)
    rng = random.Random(2)
    pieces = ["token", "TOKEN", "secret", "=", ": ", " ", "'", '"', "abc", "apikey", "api_key", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef", "İ", "\n", "password", "passwd", ".-_"]
    keywords = secrets.automaton()
    for _ in range(2000):
        t = "".join(rng.choice(pieces) for _ in range(12))
        assert [(k, a, b) for a, k, b in secrets.scan_text(t, keywords)] == plain_spans(t), t
    found = secrets.scan_text(f"x {good} ghp_{body}000000", keywords)
    assert [k for _, k, _ in found] == ["checked"]
    assert secrets.redacted(f"x {good} y", found, "[secret]") == "x [secret] y"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_on_hard_rows(spark, tmp_path, name):
    """The queries against their SQL on made documents: secrets of all kinds next to each other, shared passages, copies, null sources."""
    rng = random.Random(14)
    body = lambda: "".join(rng.choice(secrets.DIGITS) for _ in range(30))
    issued = lambda b: f"{rng.choice(['ghp', 'gho', 'ghs', 'npm'])}_{b}{secrets.base62(zlib.crc32(b.encode()), 6)}"
    bits = ["token", "TOKEN = abcdefgh ", "Api_Key: 'x1x2x3x4'", "AKIA" + "A1" * 9, "0123456789abcdef" * 2, "é日", "\n", "secret", "=", " ", "password:short ", "#*$"]
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(60))
    rows = []
    for i in range(150):
        text = " ".join(rng.choice([*bits, issued(body()), f"ghp_{body()}000000", f"word{rng.randrange(30)}"]) for _ in range(rng.randrange(30)))
        if i % 3 == 0:
            text = f"{text[:40]} {passage} {i if i % 2 else ''}"
        rows.append((i, text if i % 50 else None, "en", [None, "a", "b", "c"][i % 4], len(text)))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, expected = contract.queries()[name](spark, str(tmp_path)), duck.sql(contract.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(expected.columns)
    listed = lambda rows, of: sorted(repr(tuple(r[of.index(n)] for n in names)) for r in rows)
    assert listed(got.collect(), got.columns) == listed(expected.fetchall(), expected.columns)
    if name == "op3_secret_scan":
        assert got.filter("spans like '%checked%'").count() > 20 and got.agg(F.min("n_hex"), F.max("n_access")).first()[1] > 0


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = contract.queries()["op4_counterfactual_toxicity"](spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r["toxic"]]
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) > 0.9 * len(toxic)
    assert sum(r["predicted"] for r in clean) < 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_swaps_lower_the_score_of_neutral_mentions(spark, frame):
    rng = random.Random(4)
    words = ["table", "green", "river", "paper", "cloud", "stone", "music", "garden"]
    rows, marks = [], []
    for i in range(600):
        bad = i % 3 == 0
        text = [rng.choice(words) for _ in range(12)]
        if bad:
            text.insert(3, "vile" if rng.random() < 0.6 else rng.choice(words))
        if rng.random() < (0.7 if bad else 0.1):
            text.insert(1, "muslim")  # named far more often in toxic texts
        elif rng.random() < 0.3:
            text.insert(1, rng.choice(["christian", "hindu", "buddhist"]))
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    docs, labels = frame(rows), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    probe = frame([(0, "river paper muslim garden"), (1, "river paper christian garden"), (2, "river vile paper garden")])

    def gap(swap):
        s = {r["doc_id"]: r["score"] for r in toxicity.score(probe, *toxicity.train(docs, labels, swap)).collect()}
        return s[0] - s[1], s

    (free, _), (held, scores) = gap(0.0), gap(toxicity.SWAP)
    assert held < 0.5 * free and scores[2] > 0.8


def plain_features(text):
    """Words and their beginnings, as marked strings."""
    out = set()
    terms = {t for row in toxicity.IDENTITY for t in row}
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))):
        out.add(b"=" + w)
        if w.decode("utf-8", "replace") not in terms:
            out |= {b"^" + w[:n] for n in toxicity.BEGINNINGS if len(w) > n}
    return out


def plain_hash(feature):
    data = np.frombuffer(feature[1:], np.uint8)
    h = common.span_hash(common.prefix_hash(data), np.array([0]), np.array([len(data)]))[0]
    return int(h if feature[:1] == b"=" else ~h)


def test_toxicity_scores_by_brute_force(spark):
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    docs, labels = common.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    teaching = labels.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) != 2)
    wanted, weights = toxicity.train(docs, teaching)
    weight = dict(zip(wanted.tolist(), weights.tolist(), strict=False))
    got = result(spark, "op4_counterfactual_toxicity", SF)
    for d, t in docs.select("doc_id", "text").collect():
        total = sum(weight.get(plain_hash(f), 0.0) for f in plain_features(t)) + weights[-1]
        assert got[d]["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)
        assert got[d]["held_out"] == held(d) and got[d]["predicted"] == int(got[d]["score"] >= 0.3)


def test_toxicity_fit_is_the_minimum():
    """Of the stated loss: log loss + ridge + swap * mean square of score changes; by dense gradients, and the swaps' share in it."""
    rng = np.random.default_rng(3)
    n, k = 60, 9
    x = (rng.random((n, k)) < 0.4).astype(float)
    toxic = rng.random(n) < 0.2 + 0.5 * x[:, 0]
    named = rng.random(n) < 0.5
    other = x.copy()
    other[:, [7, 8]] = x[:, [8, 7]]
    lists = lambda m: [np.flatnonzero(r).tolist() for r in m]
    w = toxicity.fit(toxic, lists(x), [o if k else None for o, k in zip(lists(other), named, strict=True)], k)
    full = np.hstack([x, np.ones((n, 1))])
    ridge = toxicity.RIDGE * np.array([1.0] * k + [1e-6])

    def loss(w):
        z = full @ w
        swaps = (x - other)[named] @ w[:-1]
        return np.log1p(np.exp(z)).sum() - z[toxic].sum() + (ridge * w * w).sum() / 2 + toxicity.SWAP * n * (swaps**2).mean() / 8

    steps = np.eye(k + 1) * 1e-4
    slope = np.array([(loss(w + s) - loss(w - s)) / 2e-4 for s in steps])
    assert np.abs(slope).max() < 1e-2 and all(loss(w + s * 300) > loss(w) and loss(w - s * 300) > loss(w) for s in steps)
    free = toxicity.fit(toxic, lists(x), [None] * n, k)
    assert abs(w[7] - w[8]) <= abs(free[7] - free[8])


def plain_quality(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))


def test_quality_counts(spark, docs, odd, frame):
    got = result(spark, "op5_log_ratio_quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for d, t in docs:
        assert tuple(got[d][n] for n in names) == plain_quality(t)
        failed = got[d]["n_words"] < 20 or 100 * got[d]["n_repeat_words"] > 30 * got[d]["n_words"]
        assert got[d]["base_failed"] == failed and not (failed and got[d]["kept"])
    rows = quality.judge(frame(list(enumerate(odd))), np.zeros(1 << quality.BITS)).collect()
    for r in rows:
        assert tuple(r[n] for n in names) == plain_quality(odd[r["doc_id"]] or "")


def test_quality_ratio_by_hand(spark, frame, monkeypatch):
    """Counts by words themselves, in so many bins that n-grams don't share one."""
    monkeypatch.setattr(quality, "BITS", 24)
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("the of a river stone cloud spam win prize".split()[: 6 if i % 3 else 9]) for _ in range(30))) for i in range(12)]
    good = [i for i in range(12) if i % 3]
    trusted = spark.createDataFrame([(d,) for d in good], "good_id bigint")
    ratios = quality.learn(common.Workspace(spark, "t"), frame(rows), trusted)
    assert len(ratios) == 1 << 24
    each = {d: [*t.split(), *zip(t.split(), t.split()[1:], strict=False)] for d, t in rows}
    raw = collections.Counter(g for x in each.values() for g in x)
    target = collections.Counter(g for d in good for g in each[d])
    n_raw, n_target = (sum(c.values()) + (1 << 24) for c in (raw, target))
    got = {r["doc_id"]: r["ratio"] for r in quality.judge(frame(rows), ratios).collect()}
    for d, x in each.items():
        assert got[d] == pytest.approx(np.mean([np.log((target[g] + 1) / n_target) - np.log((raw[g] + 1) / n_raw) for g in x]), abs=1e-4)


def test_quality_threshold_by_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, rng.gauss(-0.1 if i % 4 else 0.1, 0.08), i % 9 == 0) for i in range(800)]
    judged = spark.createDataFrame(rows, "doc_id bigint, ratio double, base_failed boolean")
    labelled = spark.createDataFrame([(i, int(i % 4 == 0), i % 3 == 0) for i in range(800)], "labelled_id bigint, quality int, sets boolean")
    t = quality.threshold(judged, labelled)
    used = [(r, i % 4 == 0) for i, r, failed in rows if not failed and i % 3 == 0]

    def loss(t):
        good, bad = [r for r, g in used if g], [r for r, g in used if not g]
        return quality.GOOD_WEIGHT * np.mean([r < t for r in good]) + np.mean([r >= t for r in bad])

    assert loss(t) <= min(loss(k / quality.STEPS) for k in range(-400, 400)) + 1e-9
    assert quality.threshold(judged, labelled.filter("quality = 1")) == quality.FALLBACK


def plain_hash(raw):
    """Of bytes, by whole numbers; and the stirring of its bits."""
    factor, mask = int(common.FACTOR), (1 << 64) - 1
    return plain_mixed(sum((b + 1) * pow(factor, k, 1 << 64) for k, b in enumerate(raw)) & mask ^ len(raw) * factor & mask)


def plain_mixed(h):
    for _ in range(2):
        h = (h ^ h >> 32) * int(common.MIXER) & (1 << 64) - 1
    return h ^ h >> 32


def test_quality_kept_by_brute_force(spark, docs):
    """kept of all documents from the tables alone: bins, ratios, threshold and verdicts by dictionaries and loops."""
    folder = SMALL
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["quality"] is not None]
    quality_of = {}
    for d, q in labels:
        quality_of[d] = min(q, quality_of.get(d, q))
    sets = {d for d in quality_of if zlib.crc32(str(d).encode()) % 4 == 3}
    bins = {}
    for d, t in docs:
        h = [plain_hash(w) for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if w]
        pairs = [(a * int(common.FACTOR) + b) & (1 << 64) - 1 for a, b in zip(h, h[1:], strict=False)]
        bins[d] = [plain_mixed(x) >> 64 - 18 for x in h + pairs]
    raw = collections.Counter(b for x in bins.values() for b in x)
    target = collections.Counter(b for d, x in bins.items() if quality_of.get(d) == 1 and d not in sets for b in x)
    n_raw, n_target = (sum(c.values()) + (1 << 18) for c in (raw, target))
    weight = {b: np.log((target[b] + 1) / n_target) - np.log((raw[b] + 1) / n_raw) for b in raw}
    ratio = {d: sum(weight[b] for b in x) / max(len(x), 1) for d, x in bins.items()}
    plain = {d: plain_quality(t or "") for d, t in docs}
    failed = {d: p[0] < 20 or 100 * p[4] > 30 * p[0] for d, p in plain.items()}
    step = {d: int(np.floor(ratio[d] * 1000)) for d in ratio}
    good, bad = ([step[d] for d in sets if d in step and not failed[d] and (quality_of[d] == 1) == g] for g in (True, False))
    cut = -0.2
    if good and bad:
        steps = sorted({*good, *bad})
        losses = [4 * np.mean([x < c for x in good]) + np.mean([x >= c for x in bad]) for c in [*steps, steps[-1] + 1]]
        k = min(k for k, loss in enumerate(losses) if loss <= min(losses) + 1e-12)
        high = steps[k] if k < len(steps) else steps[-1] + 1
        cut = (high + (steps[k - 1] + 1 if k else steps[0])) / 2000
    got = result(spark, "op5_log_ratio_quality", folder)
    for d, r in got.items():
        assert r["ratio"] == pytest.approx(ratio[d], abs=1e-5)
        assert r["kept"] == (not failed[d] and r["ratio"] >= cut)
    assert len(got) == len(docs) and any(r["kept"] for r in got.values())


def test_the_bins_are_fixed(spark, frame):
    """Their number doesn't depend on the corpus, and tasks' vectors add up."""
    for rows in ([], [(1, "a b a")], [(i, "a b a") for i in range(300)]):
        counts = quality.count_grams(frame(rows).repartition(3))
        assert len(counts) == 1 << quality.BITS and counts.sum() == 5 * len(rows) and (counts > 0).sum() == (4 if rows else 0)


def test_quality_keeps_good_and_drops_bad(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = contract.queries()["op5_log_ratio_quality"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["quality"]], [r["kept"] for r in rows if not r["quality"]]
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.15 * len(bad)


def test_languages_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in common.documents(spark, SF).select("doc_id", "lang").collect()}
    rows = [r for r in contract.queries()["op6_language_profiles"](spark, SF).collect() if r["held_out"]]
    assert len(rows) > 250 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) > 0.98 * len(rows)


def plain_bundle(text, known):
    out = np.zeros(langid.DIMENSIONS)
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    letters = re.sub(" +", " ", letters)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        if b != " ":
            if (a, b, c) not in known:
                known[a, b, c] = np.roll(langid.letter_vector(ord(a)).astype(int), 2) * np.roll(langid.letter_vector(ord(b)).astype(int), 1) * langid.letter_vector(ord(c))
            out += known[a, b, c]
    return out


def test_languages_by_brute_force(spark):
    rows = common.documents(spark, SMALL).select("doc_id", "text", "lang").collect()
    known, sums = {}, {}
    vectors = {d: plain_bundle(t, known) for d, t, _ in rows}
    for d, _, lang in rows:
        if zlib.crc32(str(d).encode()) % 3 != 1 and lang is not None:
            sums[lang] = sums.get(lang, 0) + vectors[d]
    names = sorted(sums)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    profiles = [unit(sums[x]) for x in names]
    centred = [unit(p - np.mean(profiles, axis=0)) for p in profiles]
    for d, r in result(spark, "op6_language_profiles").items():
        v = unit(vectors[d])
        best = int(np.argmax([v @ c for c in centred]))
        assert r["lang_pred"] == names[best] and r["score"] == pytest.approx(min(max(v @ profiles[best], 0), 1), abs=1e-5)


def test_equal_cosines_go_to_the_first_language(spark, frame):
    docs = frame([(1, "ab ab", "b", "s", 5), (2, "ab ab", "a", "s", 5)])
    rows = langid.predict(docs, langid.learn(docs)).collect()
    assert {r["lang_pred"] for r in rows} == {"a"}


def test_language_bundles_by_hand():
    got = langid.bundle(["Ab, c", "", "1"], np.arange(3), 3)
    expected = np.zeros(langid.DIMENSIONS)
    for gram in (" ab", "ab ", " c "):
        a, b, c = (langid.letter_vector(ord(x)).astype(int) for x in gram)
        expected += np.roll(a, 2) * np.roll(b, 1) * c
    assert (got[0] == expected).all() and not got[1:].any()
    together = langid.bundle(["ab", "cd"], np.array([0, 0]), 1)
    assert (together[0] == langid.bundle(["ab", "cd"], np.arange(2), 2).sum(axis=0)).all()


def test_shards(spark, docs):
    got = result(spark, "op7_virtual_slots", SF)
    rows = common.documents(spark, SF).select("doc_id", "text").collect()
    for d, t in rows:
        assert got[d]["size"] == len(t.encode()) + 1 and got[d]["text_crc32"] == zlib.crc32(t.encode())
    sizes = collections.Counter()
    places = collections.defaultdict(list)
    for r in got.values():
        sizes[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) < 1.01 * min(sizes.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def plain_slot(doc_id):
    return int(hashlib.md5(str(doc_id).encode()).hexdigest()[:8], 16) % sharding.SLOTS


def plain_rebalance(held, sizes, shards):
    """Slots to shards: each keeps its largest as far as they fit into an equal share, the rest goes to the lightest."""
    share, out, loads, pool = sum(sizes) / shards, dict(held), [0] * shards, []
    for k in {*held.values()}:
        total = 0
        for slot in sorted((s for s in held if held[s] == k), key=lambda s: (-sizes[s], s)):
            total += sizes[slot]
            if k < shards and (total <= share or not sizes[slot]):
                loads[k] += sizes[slot]
            else:
                pool.append(slot)
    for slot in sorted(pool, key=lambda s: (-sizes[s], s)):
        k = loads.index(min(loads))
        out[slot], loads[k] = k, loads[k] + sizes[slot]
    return out


def test_shards_by_brute_force(spark):
    got = result(spark, "op7_virtual_slots", SF)
    rows = sorted((plain_slot(d), d, len(t.encode()) + 1) for d, t in common.documents(spark, SF).select("doc_id", "text").collect())
    sizes = [0] * sharding.SLOTS
    for slot, _, size in rows:
        sizes[slot] += size
    shard_of = plain_rebalance({s: s % 8 for s in range(sharding.SLOTS)}, sizes, 8)
    place = collections.Counter()
    for slot, d, _ in rows:
        k = shard_of[slot]
        assert (got[d]["vslot"], got[d]["shard"], got[d]["slot"]) == (slot, k, place[k])
        place[k] += 1


def test_a_stored_map_is_edited(spark, frame, tmp_path):
    """Who shards again loads the map; it is edited only if shards have grown apart, and then only slots that must go move."""
    path = str(tmp_path / "map")
    docs = frame([(i, "x" * (i % 50)) for i in range(4000)])
    first = {r["doc_id"]: r["shard"] for r in sharding.shard(spark, docs, path).collect()}
    versions = lambda: sorted(p.name for p in (tmp_path / "map").iterdir())
    before = versions()
    assert {r["doc_id"]: r["shard"] for r in sharding.shard(spark, docs, path).collect()} == first and versions() == before
    old = {r["vslot"]: r["shard"] for r in sharding.latest(spark, path).collect()}
    more = docs.union(frame([(5000 + i, "y" * 3000) for i in range(100)]))
    second = sharding.shard(spark, more, path).collect()
    assert len(versions()) == len(before) + 1
    stored = {r["vslot"]: r for r in sharding.latest(spark, path).collect()}
    assert {s: r["shard"] for s, r in stored.items()} == plain_rebalance(old, [stored[s]["bytes"] for s in range(sharding.SLOTS)], 8)
    moved = sum(r["bytes"] for s, r in stored.items() if r["shard"] != old[s])
    loads = collections.Counter()
    for r in second:
        loads[r["shard"]] += r["size"]
    assert 0 < moved < 0.5 * sum(loads.values()) and max(loads.values()) < 1.05 * min(loads.values())
    fewer = sharding.shard(spark, docs, path, shards=5).collect()
    assert {r["shard"] for r in fewer} == set(range(5))


def test_many_equal_rows_take_consecutive_places(spark, frame):
    """Rows without id and text, and rows of one id, are far more than a run; they are shuffled as one row each."""
    copies = spark.range(100_000).selectExpr("cast(null as bigint) as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "'s' as source", "0L as n_chars")
    again = spark.range(25_000).selectExpr("7L as doc_id", "'same' as text", "'en' as lang", "'s' as source", "4L as n_chars")
    docs = copies.unionByName(again).unionByName(frame([(i, "x" * (i % 9)) for i in range(300)]))
    assert sharding.counted(sharding.with_slots(docs)).count() == 302
    got = sharding.shard(spark, docs)
    told = got.groupBy("shard").agg(F.count("*"), F.countDistinct("slot"), F.min("slot"), F.max("slot")).collect()
    assert all((n, 0, n - 1) == (distinct, low, high) for _, n, distinct, low, high in told) and sum(r[1] for r in told) == 125_300
    assert sorted(r[0] for r in got.groupBy("doc_id", "size").count().select("count").collect())[-2:] == [25_000, 100_000]
    assert got.filter("doc_id is null").select("shard", "vslot").distinct().count() == 1


def test_growing_moves_slots_into_the_new_shard_only(spark):
    rows = sharding.with_slots(common.documents(spark, SF))
    old = sharding.rebalance(sharding.first_map(sharding.slot_totals(rows), 8), 8)
    new = {r["vslot"]: r for r in sharding.grow(old, 8).collect()}
    load = collections.Counter()
    for r in old.collect():
        assert new[r["vslot"]]["shard"] in (r["shard"], 8) and new[r["vslot"]]["version"] == 2
        load[new[r["vslot"]]["shard"]] += r["bytes"]
    assert max(load.values()) < 1.2 * min(load.values())


def plain_removal(docs):
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), runs, sha(np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return out


def test_substrings_query(spark, docs):
    got = result(spark, "op8_interval_expansion")
    expected = plain_removal(docs)
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == expected
    assert any(e[1] for e in expected.values())


@pytest.mark.parametrize(("many", "heavy"), [(3000, None), (2, None), (3000, True), (2, False)])
def test_substrings_on_repetitive_texts(spark, frame, monkeypatch, many, heavy):
    """However crowded or heavy an anchor is said to be, the result is that of brute force."""
    monkeypatch.setattr(substrings, "MANY", many)
    if heavy is not None:
        monkeypatch.setattr(substrings, "heavy_bins", lambda docs: np.full((2, 1 << substrings.SKETCH_BITS), heavy))
    rng = random.Random(7)
    base = ["".join(rng.choice("ab é") for _ in range(300)) for _ in range(3)]
    docs = [(i, "".join(rng.choice([rng.choice(base)[rng.randrange(150) :], "x" * rng.randrange(130), "ab" * rng.randrange(90)]) for _ in range(4))) for i in range(60)]
    done = substrings.deduplicate(spark, frame([*docs, docs[5], (None, docs[7][1])]).repartition(5)).collect()
    expected = plain_removal(docs)
    assert len(done) == 62
    for r in done:
        if r["doc_id"] is not None:
            assert (len(r["raw"]), len(r["raw"]) - len(r["kept"]), len(r["runs"] or []), sha(bytes(r["kept"]))) == expected[r["doc_id"]]
        else:
            assert r["kept"] == r["raw"] and r["runs"] is None


@pytest.mark.parametrize(("in_batch", "copies"), [(8, 64), (0, 0), (1, 1), (3, 2)])
def test_copies_by_the_weight_of_their_fragment(spark, frame, monkeypatch, in_batch, copies):
    """Whether the transform's intervals or digests decide of copies, the result is that of brute force; within the bounds no digest does."""
    monkeypatch.setattr(substrings, "IN_BATCH", in_batch)
    monkeypatch.setattr(substrings, "COPIES", copies)
    rng = random.Random(31)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    base = [text(400) for _ in range(6)]
    docs = [(i, base[i % 6] if i % 4 else text(90) + base[i % 6][50:300] + text(120)) for i in range(40)]
    rows = [*docs, docs[3], docs[7]]
    for parts in (1, 5):
        done = substrings.deduplicate(spark, frame(rows).repartition(parts)).collect()
        expected = plain_removal(docs)
        assert len(done) == len(rows)
        for r in done:
            assert (len(r["raw"]), len(r["raw"]) - len(r["kept"]), len(r["runs"] or []), sha(bytes(r["kept"]))) == expected[r["doc_id"]]
    known = frame(rows).withColumn("tag", F.lit(0)).repartition(5)
    none = np.zeros((2, 1 << substrings.SKETCH_BITS), bool)
    met = substrings.meet(substrings.find(known, none)).collect()
    assert any(r["anchor"] is None for r in met) == (copies < 64)
    assert any(r["copy"] for r in met) == (in_batch > 0)


def test_one_passage_in_every_document(spark, frame):
    """A passage that all documents share, over many batches: the first keeps it, the others lose it and no more."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    passage = " ".join(word() for _ in range(40))
    docs = [(i, f"{word()} {word()} {passage} {word()} {word()}") for i in range(4000)]
    found = substrings.heavy_bins(frame(docs).withColumn("tag", F.lit(0)).repartition(8))
    assert found[0].any() and not found[1].any() and found.mean() < 0.001  # a task merges what is inside the passage
    done = {r["doc_id"]: r for r in substrings.deduplicate(spark, frame(docs).repartition(8)).collect()}
    expected = plain_removal(docs)
    assert {d: (len(r["raw"]), len(r["raw"]) - len(r["kept"]), len(r["runs"] or []), sha(bytes(r["kept"]))) for d, r in done.items()} == expected


def test_different_texts_under_one_id(spark, frame):
    """They are documents of their own; the one with the lesser tag comes first."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(1, text), (1, text[100:] + "tail"), (2, text[:150])]
    done = {bytes(r["raw"]).decode(): bytes(r["kept"]).decode() for r in substrings.deduplicate(spark, frame(rows)).collect()}
    tag = lambda t: zlib.crc32(t.encode()) & ((1 << substrings.TAG_BITS) - 1)
    first, second = sorted((rows[0][1], rows[1][1]), key=tag)
    assert done[first] == first and done[second] == second.replace(text[100:], "") and done[text[:150]] == ""


def test_long_texts_are_cut_between_starts(monkeypatch):
    rng = random.Random(10)
    raw = bytes(rng.choice(b"abcdefgh") for _ in range(5000))
    data, at = common.byte_view(pa.array([raw.decode(), raw[1000:2000].decode()]))
    monkeypatch.setattr(substrings, "PIECE", 700)
    _, _, _, row, first, last, _ = substrings.all_fragments(data, at)
    for r, n in ((0, 5000), (1, 1000)):
        starts = [s for f, e in zip(first[row == r], last[row == r], strict=True) for s in range(f, e + 1)]
        assert sorted(starts) == list(range(n - 99))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=20), st.integers(1, 7), st.integers(1, 6))
def test_groups_are_whole_or_crowded(sizes, batch, most):
    keys = [k for k, n in enumerate(sizes) for _ in range(n)]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + batch], pa.int64())], ["key"]) for i in range(0, len(keys), batch)]
    whole, crowded = [], []
    for table, large in substrings.whole_groups(iter(batches), most):
        (crowded if large else whole).append(table["key"].to_pylist())
    assert sorted(k for t in whole for k in t) == [k for k in keys if sizes[k] <= most]
    assert sorted(k for t in crowded for k in t) == [k for k in keys if sizes[k] > most]
    assert len([k for t in whole for k in set(t)]) == len({k for t in whole for k in t})


def test_interval_expansion_by_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        letters = rng.choice([b"ab", b"abcdefgh"])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(100, 300))) for _ in range(2)]
        parts = []
        for _ in range(rng.randint(1, 8)):
            part = bytearray(rng.choice(base))
            part[rng.randrange(len(part))] = rng.choice(letters)
            parts.append(bytes(part))
        text = b"\xff".join([*parts, b"\xfe"])
        order, joined = substrings.undivided(np.frombuffer(text, np.uint8))
        at = [text[o : o + 100] for o in order]
        assert joined.tolist() == [False] + [len(b) == 100 and a == b for a, b in zip(at, at[1:], strict=False)]


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, rest, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while rest > 1e-9 and free:
        share = rest / sum(weight[s] for s in free)
        full = {s for s in free if target[s] + share * weight[s] >= 2 * sizes[s]}
        rest = 0.0
        for s in free:
            target[s] += share * weight[s]
        for s in full:
            rest += target[s] - 2 * sizes[s]
            target[s] = 2.0 * sizes[s]
        free -= full
    return target


def test_mix(spark):
    rows = {r["doc_id"]: r for r in mixing.mix(spark, common.documents(spark, SF)).collect()}
    again = {r["doc_id"]: r for r in mixing.mix(spark, common.documents(spark, SF).repartition(5)).collect()}
    assert rows == again
    text = {r["doc_id"]: r for r in common.documents(spark, SF).collect()}
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for d, r in rows.items():
        assert r["size"] == len([w for w in re.split(r"[\x20\x09-\x0D]+", text[d]["text"]) if w]) and r["source"] == text[d]["source"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    target = plain_targets(sizes)
    for r in rows.values():
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


def plain_quality_weight(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    variety = math.log(len(set(words)) + 1) / math.log(len(words) + 1) if words else 1
    return (len(words) + 1) / (len(words) + symbols + 1) * variety


def plain_draw(doc_id):
    return -math.log((int(hashlib.md5(f"7|{doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48)


def plain_mix(rows):
    """doc_id to words taken, of (doc_id, text, source) rows with different ids."""
    size = {d: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t, _ in rows}
    sizes, keyed, taken = collections.Counter(), collections.defaultdict(list), {}
    for d, t, s in rows:
        keyed[s].append((plain_draw(d) / plain_quality_weight(t), d))
        sizes[s] += size[d]
    for s, target in plain_targets(sizes).items():
        whole = int(target // sizes[s]) if sizes[s] else 0
        before, budget = 0, target - whole * sizes[s]
        for _, d in sorted(keyed[s]):
            taken[d] = size[d] * (whole + (before + size[d] / 2 < budget))
            before += size[d]
    return taken


@pytest.mark.parametrize("bins", [1, 2, 64, 4096])
def test_mix_by_brute_force(spark, monkeypatch, bins):
    """The same documents are taken however many bins there are, that is, wherever a budget ends."""
    monkeypatch.setattr(mixing, "BINS", bins)
    docs = common.documents(spark, SMALL)
    expected = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(spark, docs).collect()} == expected


def test_mix_of_one_source(spark, frame):
    docs = frame([(i, " ".join(f"w{k % (i % 7 + 2)}" for k in range(i % 40)), "en", "only", 0) for i in range(1500)])
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(spark, docs).collect()} == plain_mix(rows)


def test_weights_of_a_mix_differ(spark, frame):
    """Few documents share a weight, and texts that repeat themselves or are full of symbols weigh less."""
    weights = {r["doc_id"]: (r["text"], plain_draw(r["doc_id"]) / r["key"]) for r in mixing.measure(common.documents(spark, SF)).select("doc_id", "text", "key").collect()}
    assert all(w == pytest.approx(plain_quality_weight(t)) for t, w in weights.values())
    assert collections.Counter(round(w, 9) for _, w in weights.values()).most_common(1)[0][1] < 0.1 * len(weights)
    texts = ["one two three four five six", "one two one two one two", "one # two $ three %% four five six"]
    plain, again, noisy = (plain_draw(r["doc_id"]) / r["key"] for r in mixing.measure(frame([*enumerate(texts)])).orderBy("doc_id").collect())
    assert plain == pytest.approx(1) and again < 1 and noisy < 1


def test_mix_of_many_sources(spark, frame, monkeypatch):
    """Sources too many to broadcast are looked up, with the same result; the mix and its copies agree."""
    rng = random.Random(16)
    docs = frame([(i, "w " * rng.randrange(12), "en", None if i % 11 == 0 else f"s{rng.randrange(40) if i % 2 else 0}", 0) for i in range(600)])
    first = sorted(map(repr, mixing.mix(spark, docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    monkeypatch.setattr(common, "HEAVY_KEYS", 5)
    rows = mixing.mix(spark, docs).collect()
    assert sorted(map(repr, rows)) == first
    copies = collections.Counter(r["doc_id"] for r in mixing.repeated(spark, docs).collect())
    assert copies == collections.Counter({r["doc_id"]: r["taken"] // r["size"] for r in rows if r["taken"]})


def test_mix_with_null_source_and_one_source(spark, frame):
    docs = frame([(i, "w " * (i + 1), "en", s, 0) for i, s in enumerate(["a", "a", None, "b", None])])
    got = mixing.mix(spark, docs).collect()
    target = plain_targets({"a": 3, "b": 4, None: 8})
    assert all(r["target"] == pytest.approx(target[r["source"]]) for r in got)
    assert {r["target"] for r in mixing.mix(spark, frame([(1, "a b"), (2, "c d")])).collect()} == {6.0}


def plain_links(docs):
    sets = {d: frozenset(tuple(w[i : i + 5]) for w in [t.encode().split()] for i in range(max(1, len(w) - 4))) for d, t in docs if t and t.split()}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    both = collections.Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    links, parent = collections.Counter(), {d: d for d, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    return {d: (top(d), links[d]) for d, _ in docs}


def test_setjoin_query(spark, docs):
    got = result(spark, "op10_chosen_path_join")
    assert {d: (r["class_id"], r["n_links"]) for d, r in got.items()} == plain_links(docs)


def test_a_step_of_components_writes_two_tables(spark, monkeypatch):
    written, put = [], common.Workspace.put
    monkeypatch.setattr(common.Workspace, "put", lambda self, name, df: written.append(name) or put(self, name, df))
    edges = spark.createDataFrame([(2, 1), (3, 2), (9, 8)], "u bigint, v bigint")
    got = setjoin.components(common.Workspace(spark, "components"), edges, "c")
    assert sorted(map(tuple, got.collect())) == [(2, 1), (3, 1), (9, 8)]
    assert written[0] == "c-0" and len(written) > 1 and all(n.startswith(("c-large-", "c-")) and "least" not in n and "low" not in n for n in written)


def test_setjoin_recall_at_a_larger_scale(spark):
    """All pairs at 0.8 or more of the 10,000 documents, those near the threshold among them."""
    folder = "/root/testdata/sf0.1"
    expected = plain_links([(r["doc_id"], r["text"]) for r in common.documents(spark, folder).select("doc_id", "text").collect()])
    got = {d: (r["class_id"], r["n_links"]) for d, r in result(spark, "op10_chosen_path_join", folder).items()}
    wanted = sum(n for _, n in expected.values())
    assert wanted > 3000 and sum(min(got[d][1], n) for d, (_, n) in expected.items()) >= 0.999 * wanted
    assert all(got[d][1] <= n for d, (_, n) in expected.items())


@pytest.mark.parametrize(("bucket", "block"), [(200, 512), (8, 7)])
def test_setjoin_on_a_large_group(spark, frame, monkeypatch, bucket, block):
    """With small buckets and blocks a group is split, led and compared in parts; nothing is lost."""
    monkeypatch.setattr(setjoin, "BUCKET", bucket)
    monkeypatch.setattr(setjoin, "BLOCK_SETS", block)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(120)] = rng.choice(words)
        docs.append((i, " ".join(t)))
    docs += [(100 + i, " ".join(rng.choice(words) for _ in range(80))) for i in range(40)] + [(200, "a b"), (201, "a b"), (202, "a"), (203, ""), (204, "")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in setjoin.join(spark, frame(docs)).collect()}
    assert got == plain_links(docs)


@pytest.mark.parametrize("block", [2048, 30])
def test_setjoin_of_unlike_documents_with_one_passage(spark, frame, monkeypatch, block):
    """Documents at 0.45 by a common passage fill nodes that splits don't empty; the pairs among them are found all the same."""
    monkeypatch.setattr(setjoin, "DEPTH", 1)
    monkeypatch.setattr(setjoin, "BUCKET", 5)
    monkeypatch.setattr(setjoin, "NODE_SETS", block)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(66)]
    docs = []
    for i in range(200):
        own = [f"d{rng.randrange(10**6)}" for _ in range(38)]
        docs.append((i, " ".join(passage + own)))
        docs.append((1000 + i, " ".join(passage + own[:-9] + [f"e{rng.randrange(10**6)}" for _ in range(9)])))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in setjoin.join(spark, frame(docs)).collect()}
    expected = plain_links(docs)
    assert all(expected[i] == (i, 1) for i in range(200))
    assert got == expected


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for p in pairs for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    found = setjoin.components(common.Workspace(spark, "t"), spark.createDataFrame(pairs, "u bigint, v bigint"), "c")
    expected = {(x, top(x)) for x in parent if top(x) != x}
    assert {(r["node"], r["root"]) for r in found.collect()} == expected


def test_recall_model():
    assert setjoin.lost(0.8, 1) == pytest.approx(0.16)
    assert setjoin.lost(0.8, setjoin.DEPTH) ** setjoin.runs_for() <= 1 - setjoin.RECALL
    assert len(setjoin.roots(8)) == 10


def test_pipeline_by_brute_force(spark):
    """The stages one after another on the small table, each against a plain version on its own input."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = common.documents(spark, SMALL)
    before = {r["doc_id"]: r for r in docs.collect()}
    one = p.identify_language(spark, docs, SMALL).cache()
    assert {r["doc_id"] for r in one.collect()} == set(before)  # all of them have letters
    two = p.drop_near_duplicates(spark, one, SMALL).cache()
    classes = plain_links([(r["doc_id"], r["text"]) for r in one.collect()])
    assert {r["doc_id"] for r in two.collect()} == {d for d, (c, _) in classes.items() if d == c}
    three = p.redact_secrets(spark, two, SMALL).cache()
    for r in three.collect():
        text, expected = before[r["doc_id"]]["text"], []
        at = 0
        for _, a, b in plain_spans(text):
            if a >= at:
                expected += [text[at:a], "[secret]"]
            at = max(at, b)
        assert r["text"] == "".join([*expected, text[at:]]) and r["n_chars"] == len(r["text"])
    four = p.mix_to_targets(spark, three, SMALL).cache()
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mix(spark, three).collect()}
    assert collections.Counter(r["doc_id"] for r in four.collect()) == collections.Counter({d: n for d, n in taken.items() if n})
    for r, source in zip(p.encode_texts(spark, four, SMALL).orderBy("doc_id").collect(), four.orderBy("doc_id").collect(), strict=True):
        ids = library.encode(source["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids)))
    assert p.run(spark, SMALL).count() == four.count()


def test_more_languages_than_a_task_holds(spark, frame, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = [(k, " ".join(word() for _ in range(5)), f"l{k:04d}", "s", 1) for k in range(70)]
    docs = frame([*rows, (900, None, "l0001", "s", 1), (901, "12", None, "s", 1)])
    expected = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.predict(docs, langid.learn(docs)).collect()}
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 30)
    table = langid.learn(docs)
    assert not isinstance(table, dict) and table.count() == 70
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.predict(docs, table).collect()} == expected
    assert expected[900] == expected[901] == ("und", 0.0) and sum(expected[k][0] == f"l{k:04d}" for k in range(70)) == 70


def test_one_text_teaches_for_an_id(spark, frame):
    docs = frame([(1, f"text {k}", "en", "s", 1) for k in range(3000)] + [(2, "b"), (3, "c"), (None, "d")])
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 1), (2, 0, 1), (None, 0, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    assert sorted(map(tuple, toxicity.taught(docs, labels).collect())) == [("b", 1), ("text 0", 0)]
    assert toxicity.taught(docs, labels, 1).count() == 1


def test_pipeline_keeps_texts_of_an_untaught_script(spark, frame):
    """Only texts without letters are rejected by the language stage, however short or foreign the others are."""
    import corpus_pipeline as p

    rng = random.Random(6)
    taught = [(0, "the house of the old man", "en", "s", 24), (1, "la maison de la vieille femme", "fr", "s", 29), (2, "the", "en", "s", 3)]
    foreign = [(10 + i, "".join(chr(rng.randrange(0x10A0, 0x10C5)) for _ in range(12)), None, "s", 12) for i in range(30)]
    got = p.identify_language(spark, frame([*taught, *foreign, (90, "12 34", "en", "s", 5), (91, None, "en", "s", 0)]), SMALL).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2} | {10 + i for i in range(30)}
    assert {r["lang"] for r in got} <= {"en", "fr"}


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(1 for d in dirs for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_") and n.endswith(".data"))


def test_shuffle_files_go_with_their_step(spark):
    before = shuffle_files(spark)
    table = common.Workspace(spark, "t").put("t", spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert table.count() == 7 and shuffle_files(spark) <= before + 1  # that of the count just now


def test_filter_of_ids_misses_none(spark, frame):
    """However full the filter is, and whatever the ids; null ids never pass."""
    ids = spark.createDataFrame([(i * 7919 - 50_000,) for i in range(500)], "own bigint")
    docs = frame([(i * 7919 - 50_000, "t") for i in range(900)] + [(None, "t")])
    for bits in (26, 10):
        old = common.FILTER_BITS, common.ROW_BITS
        common.FILTER_BITS, common.ROW_BITS = bits, min(bits, 15)
        try:
            found = common.marked(docs, "doc_id", common.id_filter(F.col("own"), ids), "mark")
            assert found.columns == [*docs.columns, "mark"] and found.count() == 901
            near = {r["doc_id"] for r in found.filter("mark").collect()}
        finally:
            common.FILTER_BITS, common.ROW_BITS = old
        assert {r["own"] for r in ids.collect()} <= near and None not in near and (len(near) < 510) == (bits == 26)


@pytest.mark.parametrize("heavy", [1, 10_000])
def test_look_up_with_heavy_keys(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY_KEYS", heavy)
    rows = [(i % 5 if i % 3 else 0, i) for i in range(200)] + [(None, 1), (99, 2)]
    df = spark.createDataFrame(rows, "k bigint, v bigint")
    counts = collections.Counter(k for k, _ in rows)
    table = spark.createDataFrame([(k, f"x{k}", n) for k, n in counts.items() if k not in (None, 99)], "k bigint, v bigint, n bigint".replace("v bigint", "v string"))
    got = sorted(map(tuple, common.look_up(df, "k", table.withColumnRenamed("v", "said"), 202).collect()), key=repr)
    assert got == sorted(((k, v, f"x{k}" if k in (0, 1, 2, 3, 4) else None) for k, v in rows), key=repr)


def test_running_sums_in_ranges(spark):
    rng = random.Random(15)
    rows = [(f"s{i}", rng.randrange(50)) for i in range(300)] + [(None, 4)]
    df = spark.createDataFrame(rows, "name string, v bigint").repartition(6)
    got = common.running(common.Workspace(spark, "t"), "r", df, [F.col("v").asc(), F.col("name").asc_nulls_last()], {"before": F.col("v"), "rank": F.lit(1)}).collect()
    total = 0
    order = sorted(rows, key=lambda r: (r[1], r[0] is None, r[0]))
    for k, (name, v) in enumerate(order):
        r = next(x for x in got if x["name"] == name)
        assert (r["before"], r["rank"]) == (total, k)
        total += v


def test_scan_reads_only_what_it_needs(spark):
    plan = sharding.with_slots(common.documents(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Python" not in plan and "Arrow" not in plan
    assert F is not None
