"""Every operator and stage on null, empty and long texts, repeated rows, null keys, ties, empty tables and clashing columns: defined values, not only no crash."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, langid, media, mixing, quality, secrets, setjoin, sharding, substrings, toxicity

from test_methods import plain_links, plain_quality, plain_removal, plain_spans

VOCABULARY = bpe.vocabulary_file()
#: Names that operators use inside, and one that must be quoted.
CLASH = ["score", "lang_pred", "vslot", "size", "key", "bin", "spans", "ids", "media", "node", "class_id", "raw", "runs", "times", "time", "shard", "name", "told", "mark", "of", "near", "row", "bits", "tag", "u", "symbols", "n", "rep", "a.b"]


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "bpe": lambda s, d: bpe.digests(bpe.round_trip(d, VOCABULARY)),
    "media": lambda s, d: media.read(media.store(d)),
    "secrets": lambda s, d: secrets.digests(secrets.scan(d)),
    "redact": lambda s, d: secrets.redact(d),
    "toxicity": lambda s, d: toxicity.score(d, *toxicity.train(d, labels(s))),
    "quality": lambda s, d: quality.verdicts(s, d, labels(s)),
    "langid": lambda s, d: langid.predict(d, langid.learn(d)),
    "sharding": lambda s, d: sharding.shard(s, d),
    "substrings": lambda s, d: substrings.deduplicate(s, d),
    "mixing": lambda s, d: mixing.mix(s, d),
    "setjoin": lambda s, d: setjoin.join(s, d),
}


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else bytes(data)).hexdigest()


@pytest.fixture(scope="module")
def rows(odd):
    """Ids with texts: those at the edges, rows without id, an equal row, a row of nulls, a tie of equal texts."""
    return [*enumerate(odd), (None, "word"), (None, None), (3, "word"), (100, "nothing else"), (101, "nothing else"), (102, "🎉" * 60_000)]


@pytest.fixture(scope="module")
def crowded(spark, frame, rows):
    docs = frame([(*r, None, None, None) if r[0] == 100 else r for r in rows])
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


@pytest.fixture(scope="module")
def by_text(spark, crowded, rows):
    """The result of an operator as lists of rows by id, complete and without strange ids."""
    made = {}

    def run(name):
        if name not in made:
            out = collections.defaultdict(list)
            for r in OPERATORS[name](spark, crowded).collect():
                out[r["doc_id"]].append(r)
            assert collections.Counter(d for d, rs in out.items() for _ in rs) == collections.Counter(d for d, _ in rows)
            made[name] = out
        return made[name]

    return run


def texts_by_id(rows):
    out = {}
    for d, t in rows:
        out.setdefault(d, []).append(t or "")
    return out


def test_bpe(by_text, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_text("bpe")
    for d, texts in texts_by_id(rows).items():
        ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert sorted((r["n_tokens"], r["ids_sha256"]) for r in got[d]) == sorted((len(i), sha(" ".join(map(str, i)))) for i in ids)
    assert got[0][0]["n_tokens"] == got[1][0]["n_tokens"] == 0 and got[0][0]["decoded_sha256"] == sha("")


def test_media(by_text, rows):
    got = by_text("media")
    for d, texts in texts_by_id(rows).items():
        payloads = [t.encode() + b"\xff" * (-len(t.encode()) % 576 if t else 576) for t in texts]
        assert sorted((r["n_bytes"], bytes(r["payload"])) for r in got[d]) == sorted((len(t.encode()), p) for t, p in zip(texts, payloads, strict=True))
    assert got[100][0]["media"] == got[101][0]["media"]


def test_secrets(by_text, rows):
    for name in ("secrets", "redact"):
        got = by_text(name)
        for d, texts in texts_by_id(rows).items():
            spans = [plain_spans(t) for t in texts]
            if name == "secrets":
                assert sorted(r["base_sha256"] for r in got[d]) == sorted(sha(",".join(f"{k}:{a}:{b}" for k, a, b in s)) for s in spans)
            else:
                assert sorted(r["text"] or "" for r in got[d]) == sorted(t[: s[0][1]] + "[secret]" + t[s[-1][2] :] if s else t for t, s in zip(texts, spans, strict=True))
                assert all(r["a.b"] == r["spans"] == "clash" for r in got[d])
    assert got[0][0]["text"] is None


def test_toxicity(by_text):
    got = by_text("toxicity")
    assert got[0][0]["score"] == got[1][0]["score"] == got[2][0]["score"]  # no features
    assert len({r["score"] for d in (3, 4, None) for r in got[d] if d is not None}) == 1
    assert got[100][0]["score"] == got[101][0]["score"] and all(0 <= r["score"] <= 1 for rs in got.values() for r in rs)


def test_quality(by_text, rows):
    got = by_text("quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for d, texts in texts_by_id(rows).items():
        assert sorted(tuple(r[n] for n in names) for r in got[d]) == sorted(map(plain_quality, texts))
    assert all(got[d][0]["base_failed"] and not got[d][0]["kept"] and got[d][0]["ratio"] == 0 for d in (0, 1, 2))


def test_langid(by_text):
    got = by_text("langid")
    assert all((got[d][0]["lang_pred"], got[d][0]["score"]) == ("und", 0.0) for d in (0, 1, 2))
    assert got[3][0]["lang_pred"] == got[7][0]["lang_pred"] == "en" and got[102][0]["lang_pred"] == "und"
    assert all(r["a.b"] == r["vslot"] == "clash" for rs in got.values() for r in rs)


def test_sharding(by_text, rows):
    got = by_text("sharding")
    for d, texts in texts_by_id(rows).items():
        assert sorted((r["size"], r["text_crc32"]) for r in got[d]) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts)
    places = collections.defaultdict(list)
    for rs in got.values():
        for r in rs:
            places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_substrings(by_text, rows):
    got = by_text("substrings")
    expected = plain_removal({d: (d, t or "") for d, t in rows if d is not None}.values())
    for d, rs in got.items():
        for r in rs:
            if d is None:
                assert r["kept"] == r["raw"] and r["runs"] is None
            else:
                assert (len(r["raw"]), len(r["raw"]) - len(r["kept"]), len(r["runs"] or []), sha(r["kept"])) == expected[d]


def test_mixing(by_text, rows):
    got = by_text("mixing")
    for d, texts in texts_by_id(rows).items():
        assert sorted(r["size"] for r in got[d]) == sorted(plain_quality(t)[0] for t in texts)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got[d])
    assert {r["source"] for r in got[100]} == {None} and got[100][0]["source_size"] == 2
    assert len({r["taken"] for r in got[3]}) == 1


def test_setjoin(by_text, rows):
    got = by_text("setjoin")
    expected = plain_links([*{d: (d, t) for d, t in rows if d is not None}.values()])
    # An equal row under id 3 and one without an id are copies of 3 and 4.
    assert {r["class_id"] for d in (3, 4) for r in got[d]} == {3} and all(r["n_links"] == 3 for d in (3, 4) for r in got[d])
    assert {d: got[d][0]["class_id"] for d in got if d not in (3, 4, None)} == {d: c for d, (c, _) in expected.items() if d not in (3, 4)}
    assert sorted((r["class_id"] is None, r["n_links"]) for r in got[None]) == [(False, 3), (True, 0)]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, frame, name):
    assert OPERATORS[name](spark, frame([(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_clashing_columns(spark, crowded, rows, stage):
    """Stages on odd rows and on an empty table; what isn't theirs comes through unchanged."""
    docs = crowded
    for i, c in enumerate(CLASH):
        docs = docs.withColumn(c, F.concat_ws("-", F.lit(i), "doc_id"))
    _, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, "").collect()
    assert f(spark, docs.limit(0), "").count() == 0
    if stage == 4:
        assert len(out) == len(rows)
        return
    assert out and all(r.__fields__ == docs.columns for r in out)
    assert all(r[c] == (f"{i}-{r['doc_id']}" if r["doc_id"] is not None else str(i)) for r in out for i, c in enumerate(CLASH))
    ids = collections.Counter(r["doc_id"] for r in out)
    if stage == 0:
        assert ids == collections.Counter(d for d, t in rows if any(c.isalpha() for c in t or "")) and {r["lang"] for r in out} == {"en"}
    if stage == 1:
        assert ids == collections.Counter([*{d for d, _ in rows if d is not None} - {4, 101}, None, None])
    if stage == 2:
        assert ids == collections.Counter(d for d, _ in rows)
        assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] is not None and r["doc_id"] != 0)
