"""Queries through files: what a source reads back is held against the tables that a sink wrote."""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Workflow
from ..operators import cluster, matrix, prepare, project
from ..sources import dataset, h5ad, store, text
from . import tables as T
from . import workflow
from .catalogue import _BASIS, _PROJECTED, W, as_text, query, rounded

_ROWS = "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS line FROM embeddings"


@query(f"{W}{T.SQL_CELLS}, lines AS ({_ROWS}) SELECT line AS cell_id, string_agg(b::INT::VARCHAR, '' ORDER BY pos) AS bits FROM bits JOIN lines ON vec_id = cell_id GROUP BY 1")
def matrix_as_text(spark: SparkSession, d: str) -> DataFrame:
    """A matrix written as numeric text and read by its lines."""
    path = store.temporary(spark, "matrix")
    text.write_matrix(T.bits(spark, d), path)
    return text.read_matrix(spark, f"{path}/rows").select("cell_id", as_text().alias("bits"))


@query(f"{W}{T.SQL_CELLS} SELECT pos::INT AS pos, 'f' || pos AS feature_name, sum(b)::BIGINT AS active FROM bits GROUP BY 1, 2")
def header_names(spark: SparkSession, d: str) -> DataFrame:
    """The names of a matrix from its header alone, and the ones in the column below each."""
    path = store.temporary(spark, "header")
    text.write_matrix(T.bits(spark, d), path, [f"f{i}" for i in range(T.WIDTH)])
    names = spark.createDataFrame(list(enumerate(text.read_header(spark, f"{path}/header"))), "pos int, feature_name string")
    sums = text.read_matrix(spark, f"{path}/rows").select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum("v").cast("bigint").alias("active"))
    return names.join(sums, "pos")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line_no, p_partkey::VARCHAR AS feature_id, p_name AS feature_name FROM part WHERE p_size <= 40")
def dictionary_as_text(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary as gzipped, tab-separated text with a further column."""
    path = store.temporary(spark, "dictionary")
    lines = T.dictionary(spark, d, "F").orderBy("line_no").select(F.concat_ws("\t", "feature_id", "feature_name", F.lit("further")).alias("value"))
    lines.write.mode("overwrite").option("compression", "gzip").text(path)
    return text.read_dictionary(spark, path)


@query(f"SELECT line AS cell_id, label FROM embeddings JOIN ({_ROWS}) USING (vec_id)")
def labels_as_text(spark: SparkSession, d: str) -> DataFrame:
    """Labels, one in each line."""
    path = store.temporary(spark, "labels")
    T.cells(spark, d).orderBy("cell_id").select(F.col("label").cast("string")).write.mode("overwrite").text(path)
    return text.read_labels(spark, path)


@query("SELECT 'd.' || doc_id AS cell_key, lang, source, n_chars FROM documents")
def metadata_as_csv(spark: SparkSession, d: str) -> DataFrame:
    """Metadata with an index column, out and in again."""
    path = store.temporary(spark, "metadata")
    rows = T.table(spark, d, "documents").select(F.concat(F.lit("d."), "doc_id").alias("cell_key"), "lang", "source", "n_chars")
    text.write_csv(rows, path, index="cell_key")
    return text.read_indexed(spark, path, "lang string, source string, n_chars bigint")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_as_csv(spark: SparkSession, d: str) -> DataFrame:
    """A narrow table with a header, read under a given schema."""
    path = store.temporary(spark, "nation")
    text.write_csv(T.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return dataset.read_table(spark, path, "n_nationkey int, n_name string, n_regionkey int")


def _data_set(spark: SparkSession, d: str) -> dataset.DataSet:
    cells = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), "s_name")
    return dataset.DataSet(cells, T.features(spark, d), T.counts(spark, d))


@query(f"{W}{T.SQL_COUNTS} SELECT s_name, count(value) AS entries, round(coalesce(sum(value), 0), 6) AS total FROM supplier LEFT JOIN counts ON cell_id = s_suppkey GROUP BY 1")
def data_set_as_tables(spark: SparkSession, d: str) -> DataFrame:
    """A data set written and read lazily: cells with the sums of their entries."""
    path = store.temporary(spark, "data-set")
    _data_set(spark, d).write(path, "overwrite")
    back = dataset.read_dataset(spark, path)
    joined = back.cells.join(back.entries, "cell_id", "left").groupBy("s_name")
    return joined.agg(F.count("value").alias("entries"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("total"))


@query(f"{W}{T.SQL_COUNTS} SELECT s_name AS cell_key, p_name AS feature_name, round(value, 6) AS value FROM counts JOIN supplier ON cell_id = s_suppkey JOIN part ON pos = p_partkey WHERE value <> 0")
def matrix_as_h5ad(spark: SparkSession, d: str) -> DataFrame:
    """A data set as .h5ad files, a range of cells in each, and read back by ranges of rows. The shared folder must be one that tasks can open."""
    path = store.temporary(spark, "h5ad")
    h5ad.write_h5ad(_data_set(spark, d), path, "s_name")
    back = h5ad.read_h5ad(spark, path)
    named = back.entries.join(back.cells, "cell_id").join(back.features, "pos")
    return named.select("cell_key", "feature_name", F.round("value", 6).alias("value"))


@query("SELECT p_name AS feature_name, (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS pos FROM part")
def features_of_h5ad(spark: SparkSession, d: str) -> DataFrame:
    """The names of features in a file, without a read of its matrix."""
    path = store.temporary(spark, "h5ad")
    h5ad.write_h5ad(_data_set(spark, d), path, "s_name")
    return h5ad.read_h5ad(spark, path).features


@query("SELECT p_name AS feature_name, p_partkey AS pos FROM part")
def features_alone(spark: SparkSession, d: str) -> DataFrame:
    """The names of a stored data set, without a read of its matrix."""
    path = store.temporary(spark, "features")
    _data_set(spark, d).write(path, "overwrite")
    return dataset.read_features(spark, path)


@query("SELECT label, count(*) AS n, 1::BIGINT AS made FROM embeddings GROUP BY 1")
def published_once(spark: SparkSession, d: str) -> DataFrame:
    """A table published under its settings: the second call reads what the first one made."""
    folder, made = store.temporary(spark, "published"), []

    def make() -> DataFrame:
        made.append(d)
        return T.cells(spark, d).groupBy("label").agg(F.count("*").alias("n"))

    for _ in range(2):
        table = store.published(spark, folder, "sizes", {"sf": d}, make)
    return table.withColumn("made", F.lit(len(made)).cast("bigint"))


@query("SELECT r_regionkey, r_name, 'second' AS place FROM region")
def first_of_paths(spark: SparkSession, d: str) -> DataFrame:
    """Of several places the first that is there: the rows in it, and which it is."""
    root = store.temporary(spark, "places")
    paths = {f"{root}/{name}": name for name in ("first", "second", "third")}
    regions = T.table(spark, d, "region")
    for path, name in paths.items():
        if name != "first":
            regions.filter(F.lit(name == "second")).write.parquet(path)  # the third is empty
    if store.missing(spark, paths) != [f"{root}/first"]:
        raise AssertionError("only the first place should be missing")
    found = store.first_existing(spark, paths)
    return spark.read.parquet(found).select("r_regionkey", "r_name", F.lit(paths[found]).alias("place"))


@query(_PROJECTED)
def projection_from_file(spark: SparkSession, d: str) -> DataFrame:
    """The projection on a basis that comes from a file of the driver's."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "basis.npy")
        np.save(path, project.hadamard_basis(T.WIDTH, 16))
        basis = text.read_basis(path)
    z = project.project(T.bits(spark, d), basis)
    return rounded(z.select("cell_id", F.posexplode("x").alias("component", "value")), "value")


# Prototypes of cells clustered in a given projection; classes that aren't there are skipped.

_ASKED = (7, 99, 3)


def _space_sql(clusters: int = 2, steps: int = 3) -> str:
    out = [
        f"own AS (SELECT cell_id, label, component AS pos, sum(b * weight) AS v FROM bits JOIN basis USING (pos) WHERE label IN {_ASKED} GROUP BY 1, 2, 3)",
        f"first AS (SELECT label, cell_id, row_number() OVER (PARTITION BY label ORDER BY cell_id) - 1 AS cluster FROM (SELECT DISTINCT label, cell_id FROM own) QUALIFY cluster < {clusters})",
        "c0 AS (SELECT o.label, f.cluster, o.pos, o.v AS c FROM own o JOIN first f USING (label, cell_id))",
    ]
    for k in range(steps):
        out += [
            f"d{k} AS (SELECT o.label, o.cell_id, c.cluster, round(sum((o.v - c.c) * (o.v - c.c)), 9) AS d FROM own o JOIN c{k} c USING (label, pos) GROUP BY 1, 2, 3)",
            f"a{k} AS (SELECT label, cell_id, cluster FROM d{k} QUALIFY row_number() OVER (PARTITION BY label, cell_id ORDER BY d, cluster) = 1)",
            f"c{k + 1} AS (SELECT label, cluster, pos, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT o.label, a.cluster, o.pos, round(avg(o.v), 9) AS c FROM own o JOIN a{k} a USING (label, cell_id) GROUP BY 1, 2, 3) m USING (label, cluster, pos))",
        ]
    return ", ".join(out)


@query(f"""{W}{T.SQL_CELLS}, {_BASIS}, {_space_sql()},
near AS (SELECT o.label, c.cluster, o.cell_id, round(sum((o.v - c.c) * (o.v - c.c)), 9) AS d FROM own o JOIN c3 c USING (label, pos) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY o.label, c.cluster ORDER BY d, o.cell_id) = 1),
shown AS (SELECT n.label, n.cluster, n.cell_id, string_agg(b.b::INT::VARCHAR, '' ORDER BY b.pos) AS bits FROM near n JOIN bits b USING (cell_id) GROUP BY 1, 2, 3)
SELECT (row_number() OVER (ORDER BY list_position({list(_ASKED)}, label), cluster) - 1)::INT AS pattern_id, label AS cls, cell_id AS source_cell_id, bits FROM shown""")
def prototypes_in_space(spark: SparkSession, d: str) -> DataFrame:
    cells = T.bits(spark, d)
    space = project.project(cells.select("cell_id", "x"), project.hadamard_basis(T.WIDTH, 16))
    return cluster.prototypes(cells, 2, 1, 3, _ASKED, space).select("pattern_id", "cls", "source_cell_id", as_text("p").alias("bits"))


@query(f"""{W}{T.SQL_DICTIONARIES}, own AS (SELECT DISTINCT coalesce(m.feature_id, p.p_name) AS feature_id FROM part p LEFT JOIN dict_m m ON m.feature_name = p.p_name WHERE p_size > 10)
SELECT o.feature_id, o.pos::INT AS pos, 0.5::DOUBLE AS filled, o.feature_id IN (SELECT feature_id FROM dict_f EXCEPT SELECT feature_id FROM dict_m) AS tracked FROM canonical o WHERE o.feature_id NOT IN (SELECT feature_id FROM own)""")
def filled_features(spark: SparkSession, d: str) -> DataFrame:
    """What is filled in the second data set, whether tracked or not."""
    second = T.table(spark, d, "part").filter("p_size > 10").select(F.col("p_name").alias("feature_name"), F.col("p_partkey").alias("pos"))
    sets = [dataset.DataSet(T.cells(spark, d).select("cell_id"), f, T.counts(spark, d)) for f in (T.features(spark, d), second)]
    aligned = workflow.align_pair(*sets, *(T.dictionary(spark, d, w) for w in "FM"))
    return aligned.filled.select("feature_id", "pos", "filled", "tracked")


@query("SELECT label, count(*) AS n FROM embeddings WHERE label IN (1, 3, 4, 5, 6, 7) GROUP BY 1")
def classes_of_the_workflow(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the classes that the settings name, from the coordinate layout and back."""
    cells = T.bits(spark, d)
    vectors = matrix.to_vectors(matrix.to_coordinates(cells), T.WIDTH, cells).join(cells.select("cell_id", "label"), "cell_id")
    return prepare.of_classes(vectors, Workflow().classes).groupBy("label").agg(F.count("*").alias("n"))
