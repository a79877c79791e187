"""A corpus pipeline of five stages on the operators of tessella.llm.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run() writes each stage's result
to the shared folder and reads it back as the next one's docs. All but the last return the columns of documents.

Rows without an id pass the second stage as single documents, and the mix draws them by their text; null texts are rejected by
the first stage; an empty table passes as an empty table; further columns, whatever their names, pass all stages but the last
as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, mixing, secrets, setjoin
from tessella.llm.common import Workspace, column, fresh, id_filter, marked


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letters; lang becomes the nearest language taught.

    No score rejects a document: what is in a language or script that wasn't taught stays too, and its lang is a taught one.
    """
    columns = docs.columns
    said, score = fresh(columns, "lang_pred", "score")
    kept = langid.predict(docs, langid.learn(docs), (said, score)).filter(F.col(said) != langid.UNKNOWN)
    return kept.select(*(F.col(said).alias(c) if c == "lang" else column(c) for c in columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least id stays, once.

    A filter of fixed size tells which texts may have to go; only those are moved to be compared with the ids.
    """
    columns = docs.columns
    mark, of = fresh(columns, "mark", "of")
    store = Workspace(spark, "classes")
    ids = store.put("ids", setjoin.join(spark, docs).filter("doc_id is not null"))
    others = store.put("others", ids.filter("doc_id <> class_id").select(F.col("doc_id").alias(of)).distinct())
    rows = marked(docs, "doc_id", store.put("bits", id_filter(F.col(of), others)), mark)
    asked = rows.filter(F.col(mark)).join(others.hint("merge"), F.col("doc_id") == F.col(of), "left_anti")
    kept = rows.filter(~F.col(mark)).unionByName(asked).select(*(column(c) for c in columns))
    repeated = ids.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(of))
    if repeated.isEmpty():
        return kept
    repeated = store.put("repeated", repeated)
    rows = marked(kept, "doc_id", store.put("repeated-bits", id_filter(F.col(of), repeated)), mark)
    once = rows.filter(F.col(mark)).dropDuplicates(["doc_id"])
    return rows.filter(~F.col(mark)).unionByName(once).select(*(column(c) for c in columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret in its text replaced by a mark."""
    return secrets.redact(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(spark, docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return bpe.digests(bpe.round_trip(docs, bpe.vocabulary_file()))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_to_targets),
    ("BPE encoding and decoding", encode_texts),
]

#: SQL can express neither the profiles nor the chosen paths; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for all documents."""
    store = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.put(f"stage-{k}", stage(spark, docs, sf_dir))
        if k:
            store.drop(f"stage-{k - 1}")
    return docs
