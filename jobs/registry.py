"""The jobs as queries: each runs twice into one new folder of the shared one, and its output is read back. DuckDB SQL tells the same rows."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import tables as T
from tessella.sources.store import shared_dir

from . import annotate_texts, profile_arrivals

FOLDER = os.path.dirname(os.path.abspath(__file__))


def configured(job) -> object:
    """The settings in the job's configuration file."""
    with open(os.path.join(FOLDER, f"{job.__name__.rpartition('.')[2]}.json")) as file:
        return job.Settings(**json.load(file))


def twice(spark: SparkSession, job, **inputs: str) -> DataFrame:
    """Run the job twice into a new folder, which stays."""
    output = f"{shared_dir(spark)}/{job.__name__.rpartition('.')[2]}-{uuid.uuid4().hex}"
    for _ in range(2):
        out = job.run(spark, output=output, settings=configured(job), **inputs)
    return out


def job1_annotate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twice(spark, annotate_texts, documents=f"{sf_dir}/documents.parquet", conversations=f"{sf_dir}/conversations.parquet")


def job2_profile_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twice(spark, profile_arrivals, cells=f"{sf_dir}/embeddings.parquet")


def _annotated_sql(settings: annotate_texts.Settings) -> str:
    code = "CASE lang " + " ".join(f"WHEN '{name}' THEN {k}" for name, k in settings.codes.items()) + " ELSE 0 END"
    named = "CASE predicted " + " ".join(f"WHEN {k} THEN '{name}'" for name, k in settings.codes.items()) + " END"
    start = "SELECT cell_id, pos, CASE WHEN data_set = 'conversations' AND pos IN (SELECT pos FROM lacking) THEN 0.0::DOUBLE ELSE 2 * b - 1 END AS x FROM bits"
    return f"""
WITH rows AS (SELECT doc_id::VARCHAR AS cell_id, 'documents' AS data_set, ({code})::INT AS label, lower(text) AS t FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT conv_id || ':' || turn, 'conversations', 0, lower(text) FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
said AS (SELECT data_set, cell_id, unnest(list_distinct(regexp_extract_all(t, '\\pL+'))) AS w FROM rows),
top AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS pos FROM (SELECT w, count(*) AS n FROM said WHERE data_set = 'documents' GROUP BY 1) QUALIFY pos <= {settings.features}),
held AS (SELECT DISTINCT data_set, cell_id, pos FROM said JOIN top USING (w)),
lacking AS (SELECT pos FROM top WHERE pos NOT IN (SELECT pos FROM held WHERE data_set = 'conversations')),
texts AS (SELECT data_set, cell_id, min(label) AS label FROM rows GROUP BY 1, 2),
bits AS (SELECT c.data_set, c.cell_id, c.label, t.pos, (h.pos IS NOT NULL)::INT::DOUBLE AS b FROM texts c CROSS JOIN top t LEFT JOIN held h ON h.data_set = c.data_set AND h.cell_id = c.cell_id AND h.pos = t.pos),
{T.SQL_PATTERNS}, {T.sql_recall(start, beta=settings.beta, steps=settings.steps)},
recalled_bits AS (SELECT cell_id, pos, CASE WHEN x > {settings.threshold}::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM recalled),
apart AS (SELECT r.cell_id, q.pattern_id, q.cls, sum((r.b <> q.b)::INT)::BIGINT AS mismatches, sum(r.b)::BIGINT AS active_recall FROM recalled_bits r JOIN patterns q USING (pos) GROUP BY 1, 2, 3),
nearest AS (SELECT cell_id, cls AS predicted, mismatches, active_recall FROM apart QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY mismatches, pattern_id) = 1)
SELECT cell_id, label, predicted, mismatches, active_recall, data_set, {named} AS class FROM texts JOIN nearest USING (cell_id)
"""


_PROFILED = """
WITH bits AS (SELECT coalesce(label, 0)::INT AS label, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
counts AS (SELECT pos, count(*) AS cells, sum((v > 0 AND NOT isnan(v))::INT)::BIGINT AS ones, label FROM bits GROUP BY label, pos)
SELECT pos, cells, ones, round(ones / cells, 6) AS mean, (2 * ones > cells)::INT AS major, label FROM counts
"""

QUERIES = {f.__name__: f for f in (job1_annotate_texts, job2_profile_arrivals)}
ORACLES = {"job1_annotate_texts": _annotated_sql(configured(annotate_texts)), "job2_profile_arrivals": _PROFILED}
