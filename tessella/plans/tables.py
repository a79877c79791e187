"""How the driver's tables stand for cells, features, dictionaries and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import binarise
from ..operators import cluster

WIDTH = 64
#: Features that data set M lacks: one position of every five.
LACKING = (5, 2)
CLASSES = (1, 3, 4, 5, 6, 7)
CODES = {"click": 1, "view": 2, "purchase": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), "label", F.col("embedding").cast("array<double>").alias("x"))


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumn("x", binarise("x"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority profile of each labelled class."""
    return cluster.majority_profiles(bits(spark, sf_dir).filter("label <> 0"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cells, parts as features, quantities as values; a place may come several times."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("pos"), F.col("l_quantity").alias("value"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one value for each place."""
    return lines(spark, sf_dir).groupBy("cell_id", "pos").agg(F.sum("value").alias("value"))


def dictionary(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Dictionary F or M: parts by size, in the order of their keys."""
    own = F.col("p_size") <= 40 if which == "F" else F.col("p_size") > 10
    return table(spark, sf_dir, "part").filter(own).select(F.col("p_partkey").alias("line_no"), F.col("p_partkey").cast("string").alias("feature_id"), F.col("p_name").alias("feature_name"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("feature_name"), F.col("p_partkey").alias("pos"))


def square_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """(i, j, value) of a small matrix."""
    i, j = np.indices(matrix.shape)
    return spark.createDataFrame(pa.table({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "value": matrix.ravel()}))


def lacking(spark: SparkSession) -> DataFrame:
    return spark.range(WIDTH).filter(F.col("id") % LACKING[0] == LACKING[1]).select(F.col("id").cast("int").alias("pos"))


# DuckDB counterparts of the above, as common table expressions.

SQL_CELLS = """cells AS (SELECT vec_id AS cell_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
bits AS (SELECT cell_id, label, pos, CASE WHEN v > 0 AND NOT isnan(v) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM cells)"""

SQL_PATTERNS = """profile AS (SELECT label AS cls, pos, CASE WHEN avg(b) > 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM bits WHERE label <> 0 GROUP BY label, pos),
patterns AS (SELECT dense_rank() OVER (ORDER BY cls) - 1 AS pattern_id, cls, pos, b, 2 * b - 1 AS p FROM profile)"""

SQL_COUNTS = "counts AS (SELECT l_suppkey AS cell_id, l_partkey AS pos, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"

SQL_DICTIONARIES = """raw_f AS (SELECT p_partkey AS line_no, p_partkey::VARCHAR AS feature_id, p_name AS feature_name FROM part WHERE p_size <= 40),
raw_m AS (SELECT p_partkey AS line_no, p_partkey::VARCHAR AS feature_id, p_name AS feature_name FROM part WHERE p_size > 10),
dict_f AS (SELECT feature_name, arg_min(feature_id, line_no) AS feature_id, min(line_no) AS line_no FROM raw_f GROUP BY 1),
dict_m AS (SELECT feature_name, arg_min(feature_id, line_no) AS feature_id, min(line_no) AS line_no FROM raw_m GROUP BY 1),
named AS (SELECT p.p_partkey AS pos, p.p_name AS feature_name, coalesce(d.feature_id, p.p_name) AS feature_id FROM part p LEFT JOIN dict_f d ON d.feature_name = p.p_name),
canonical AS (SELECT feature_id, row_number() OVER (ORDER BY min(pos), feature_id) - 1 AS pos FROM named GROUP BY feature_id)"""


def sql_recall(start: str = "SELECT cell_id, pos, 2 * b - 1 AS x FROM bits", patterns: str = "patterns", value: str = "p", beta: float = 8.0, steps: int = 1) -> str:
    """Common table expressions; the last, recalled, has cell_id, pos and x."""
    out = [f"x0 AS ({start})"]
    for k in range(1, steps + 1):
        out.append(f"""s{k} AS (SELECT c.cell_id, q.pattern_id, round(sum(c.x * q.{value}), 9) AS s FROM x{k - 1} c JOIN {patterns} q USING (pos) GROUP BY 1, 2),
e{k} AS (SELECT cell_id, pattern_id, exp({beta}::DOUBLE * (s - max(s) OVER (PARTITION BY cell_id))) AS e FROM s{k}),
w{k} AS (SELECT cell_id, pattern_id, e / sum(e) OVER (PARTITION BY cell_id) AS w FROM e{k}),
x{k} AS (SELECT w.cell_id, q.pos, round(sum(w.w * q.{value}), 9) AS x FROM w{k} w JOIN {patterns} q USING (pattern_id) GROUP BY 1, 2)""")
    return ",\n".join([*out, f"recalled AS (SELECT * FROM x{steps})"])


def sql_judged(threshold: float = 0.0, patterns: str = "patterns") -> str:
    """Common table expressions; the last, judged, has cell_id, label, predicted, pattern_id, mismatches and width."""
    return f"""recalled_bits AS (SELECT cell_id, pos, CASE WHEN x > {threshold}::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM recalled),
apart AS (SELECT r.cell_id, q.pattern_id, q.cls, sum((r.b <> q.b)::INT)::BIGINT AS mismatches, sum(q.b)::BIGINT AS active_pattern, sum(r.b)::BIGINT AS active_recall, count(*) AS width FROM recalled_bits r JOIN {patterns} q USING (pos) GROUP BY 1, 2, 3),
nearest AS (SELECT * FROM apart QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY mismatches, pattern_id) = 1),
judged AS (SELECT n.cell_id, l.label, n.cls AS predicted, n.pattern_id, n.mismatches, n.active_pattern, n.active_recall, n.width FROM nearest n JOIN (SELECT vec_id AS cell_id, label FROM embeddings) l USING (cell_id))"""


SQL_METRICS = """truth AS (SELECT label AS cls, count(*) AS support FROM judged WHERE {where} GROUP BY 1),
said AS (SELECT predicted AS cls, count(*) AS said FROM judged WHERE {where} GROUP BY 1),
hits AS (SELECT label AS cls, count(*) AS hits FROM judged WHERE label = predicted AND {where} GROUP BY 1),
per_class AS (SELECT cls, coalesce(support, 0) AS support, coalesce(coalesce(hits, 0)::DOUBLE / nullif(coalesce(said, 0), 0), 0) AS precision, coalesce(coalesce(hits, 0)::DOUBLE / nullif(coalesce(support, 0), 0), 0) AS recall, coalesce(2.0::DOUBLE * coalesce(hits, 0) / nullif(coalesce(said, 0) + coalesce(support, 0), 0), 0) AS f1 FROM truth FULL JOIN said USING (cls) LEFT JOIN hits USING (cls))"""

SQL_SUMMARY = """SELECT count(*) AS n, round(avg((label = predicted)::INT), 6) AS accuracy, round(1 - avg((label = predicted)::INT), 6) AS error, (SELECT round(avg(f1), 6) FROM per_class) AS f1_macro, (SELECT round(sum(f1 * support) / sum(support), 6) FROM per_class) AS f1_weighted, round(avg((mismatches = 0)::INT), 6) AS exact_rate, round(avg(1 - mismatches / width), 6) AS similarity FROM judged WHERE {where}"""
