"""Every query of the library with its DuckDB counterpart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import vectors as V
from ..operators import cluster, evaluate, harmonise, matrix, memory, neighbours, packed, prepare, project, select, sweep
from ..sources import store
from ..streaming import recall as streams
from . import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def as_text(x: Column | str = "x") -> Column:
    """A vector of bits as a string of digits."""
    return F.array_join(F.transform(x, lambda v: v.cast("int").cast("string")), "")


W = "WITH "


# Layouts, binarising, frequencies, selection.


@query(f"{W}{T.SQL_CELLS} SELECT cell_id, sum(b)::BIGINT AS active FROM bits GROUP BY 1")
def binarize_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.bits(spark, d).select("cell_id", V.total("x").cast("bigint").alias("active"))


@query(f"{W}{T.SQL_CELLS} SELECT pos::INT AS pos, round(sum(b), 6) AS frequency FROM bits GROUP BY 1")
def feature_frequency(spark: SparkSession, d: str) -> DataFrame:
    every = spark.range(T.WIDTH).select(F.col("id").cast("int").alias("pos"))
    return rounded(select.feature_frequency(prepare.binarise_entries(matrix.to_coordinates(T.cells(spark, d))), every), "frequency")


@query(f"""{W}{T.SQL_COUNTS}, f AS (SELECT p_partkey AS pos, coalesce(n, 0)::DOUBLE AS frequency FROM part LEFT JOIN (SELECT pos, count(*) AS n FROM counts WHERE value > 0 GROUP BY 1) ON pos = p_partkey)
SELECT pos, frequency, row_number() OVER (ORDER BY frequency DESC, pos)::INT AS rank FROM f ORDER BY frequency DESC, pos LIMIT 100""")
def feature_frequency_topn(spark: SparkSession, d: str) -> DataFrame:
    parts = T.table(spark, d, "part").select(F.col("p_partkey").alias("pos"))
    return select.top_features(select.feature_frequency(prepare.binarise_entries(T.counts(spark, d)), parts), 100)


@query(f"{W}{T.SQL_CELLS} SELECT 'f' || pos AS feature_id, round(sum(b), 6) AS frequency FROM bits GROUP BY pos")
def unpivot_sums(spark: SparkSession, d: str) -> DataFrame:
    wide = T.bits(spark, d).agg(*(F.round(F.sum(F.get("x", F.lit(i))), 6).alias(f"f{i}") for i in range(T.WIDTH)))
    return matrix.unpivot_sums(wide)


_TOP = f"{W}{T.SQL_CELLS}, f AS (SELECT pos, sum(b) AS n FROM bits GROUP BY 1), top AS (SELECT pos, row_number() OVER (ORDER BY n DESC, pos) AS rank FROM f QUALIFY rank <= 16)"


def _selected(spark: SparkSession, d: str, by: str) -> DataFrame:
    every = spark.range(T.WIDTH).select(F.col("id").cast("int").alias("pos"))
    entries = prepare.binarise_entries(matrix.to_coordinates(T.cells(spark, d)))
    top = select.top_features(select.feature_frequency(entries, every), 16)
    chosen = matrix.to_vectors(select.keep_features(entries, top, by), 16, T.cells(spark, d))
    return chosen.select("cell_id", as_text().alias("bits"))


@query(f"{_TOP} SELECT cell_id, string_agg(b::INT::VARCHAR, '' ORDER BY pos) AS bits FROM bits JOIN top USING (pos) GROUP BY 1")
def select_columns_file_order(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d, "pos")


@query(f"{_TOP} SELECT cell_id, string_agg(b::INT::VARCHAR, '' ORDER BY rank) AS bits FROM bits JOIN top USING (pos) GROUP BY 1")
def select_columns_freq_order(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d, "rank")


@query("SELECT vec_id AS cell_id, round(embedding[6]::DOUBLE, 6) AS a, round(embedding[1]::DOUBLE, 6) AS b, round(embedding[33]::DOUBLE, 6) AS c FROM embeddings")
def gather_columns(spark: SparkSession, d: str) -> DataFrame:
    x = select.keep_columns(T.cells(spark, d), [5, 0, 32])
    return x.select("cell_id", *(F.round(V.element("x", i + 1), 6).alias(n) for i, n in enumerate("abc")))


@query("SELECT vec_id AS cell_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[2]::DOUBLE, 6) AS second, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def element_access(spark: SparkSession, d: str) -> DataFrame:
    return T.cells(spark, d).select("cell_id", F.round(V.element("x", 1), 6).alias("first"), F.round(V.element("x", "SECOND"), 6).alias("second"), F.round(V.element("x", 0), 6).alias("last"))


@query(f"{W}{T.SQL_CELLS} SELECT cell_id, string_agg(pos::VARCHAR, ',' ORDER BY v DESC, pos DESC) AS falling FROM cells GROUP BY 1")
def argsort_features(spark: SparkSession, d: str) -> DataFrame:
    return T.cells(spark, d).select("cell_id", F.array_join(V.argsort("x", descending=True).cast("array<string>"), ",").alias("falling"))


@query(f"{W}{T.SQL_CELLS} SELECT cell_id, string_agg(b::INT::VARCHAR, '' ORDER BY pos) AS bits FROM bits GROUP BY 1")
def row_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates and back: cells without an active feature come back as zeros."""
    entries = matrix.to_coordinates(T.bits(spark, d))
    return matrix.to_vectors(entries, T.WIDTH, T.cells(spark, d)).select("cell_id", as_text().alias("bits"))


@query(f"{W}{T.SQL_CELLS} SELECT round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean, sum(isnan(v)::INT)::BIGINT AS nans FROM cells")
def sanity_stats(spark: SparkSession, d: str) -> DataFrame:
    v = T.cells(spark, d).select(F.explode("x").alias("v"))
    return v.agg(F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), F.round(F.avg("v"), 6).alias("mean"), F.count_if(F.isnan("v")).alias("nans"))


# Dictionaries and harmonisation.


@query(f"{W}{T.SQL_DICTIONARIES} SELECT feature_name, feature_id, line_no FROM dict_f")
def dictionary_first(spark: SparkSession, d: str) -> DataFrame:
    return harmonise.first_names(T.dictionary(spark, d, "F"))


@query(f"{W}{T.SQL_DICTIONARIES} SELECT feature_name, feature_id FROM (SELECT feature_id, arg_max(feature_name, line_no) AS feature_name FROM raw_f GROUP BY 1)")
def dictionary_inverse(spark: SparkSession, d: str) -> DataFrame:
    return harmonise.last_names(T.dictionary(spark, d, "F")).select("feature_name", "feature_id")


@query(f"{W}{T.SQL_DICTIONARIES} SELECT feature_id, pos::INT AS pos FROM canonical")
def canonical_order(spark: SparkSession, d: str) -> DataFrame:
    return harmonise.canonical_order(T.features(spark, d), harmonise.first_names(T.dictionary(spark, d, "F")))


@query(f"{W}{T.SQL_DICTIONARIES} SELECT sum((f.feature_id IS NOT NULL AND m.feature_id IS NOT NULL)::INT)::BIGINT AS common, sum((m.feature_id IS NULL)::INT)::BIGINT AS only_first, sum((f.feature_id IS NULL)::INT)::BIGINT AS only_second FROM (SELECT DISTINCT feature_id FROM dict_f) f FULL JOIN (SELECT DISTINCT feature_id FROM dict_m) m ON f.feature_id = m.feature_id")
def overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return harmonise.overlap(*(harmonise.first_names(T.dictionary(spark, d, w)) for w in "FM"))


@query(f"{W}{T.SQL_DICTIONARIES} (SELECT feature_id, 'common' AS side FROM dict_f INTERSECT SELECT feature_id, 'common' FROM dict_m) UNION ALL (SELECT feature_id, 'only_f' FROM dict_f EXCEPT SELECT feature_id, 'only_f' FROM dict_m) UNION ALL (SELECT feature_id, 'only_m' FROM dict_m EXCEPT SELECT feature_id, 'only_m' FROM dict_f)")
def overlap_ids(spark: SparkSession, d: str) -> DataFrame:
    f, m = (harmonise.first_names(T.dictionary(spark, d, w)) for w in "FM")
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(harmonise.common_ids(f, m), "common").union(side(harmonise.ids_only_in(f, m), "only_f")).union(side(harmonise.ids_only_in(m, f), "only_m"))


@query(f"{W}{T.SQL_DICTIONARIES}, {T.SQL_COUNTS} SELECT cell_id, o.pos::INT AS pos, round(sum(value), 6) AS value FROM counts c JOIN named n ON n.pos = c.pos JOIN canonical o USING (feature_id) GROUP BY 1, 2")
def align_sum_duplicates(spark: SparkSession, d: str) -> DataFrame:
    names = harmonise.first_names(T.dictionary(spark, d, "F"))
    order = harmonise.canonical_order(T.features(spark, d), names)
    # Alignment sums what meets at a place, so the lines need no sum before it.
    return rounded(harmonise.align(T.lines(spark, d), T.features(spark, d), names, order), "value")


@query(f"{W}{T.SQL_DICTIONARIES} SELECT feature_id, pos::INT AS pos FROM canonical WHERE feature_id NOT IN (SELECT coalesce(d.feature_id, p.p_name) FROM part p LEFT JOIN dict_m d ON d.feature_name = p.p_name WHERE p.p_size > 10)")
def missing_positions(spark: SparkSession, d: str) -> DataFrame:
    order = harmonise.canonical_order(T.features(spark, d), harmonise.first_names(T.dictionary(spark, d, "F")))
    own = T.table(spark, d, "part").filter("p_size > 10").select(F.col("p_name").alias("feature_name"), F.col("p_partkey").alias("pos"))
    return harmonise.absent(own, harmonise.first_names(T.dictionary(spark, d, "M")), order).select("feature_id", "pos")


@query(f"{W}{T.SQL_CELLS} SELECT pos::INT AS pos, round(sum(CASE WHEN pos % 5 = 2 THEN 0.5::DOUBLE ELSE b END), 6) AS frequency, sum((pos % 5 = 2 OR b <> 0)::INT)::BIGINT AS entries FROM bits GROUP BY 1")
def align_with_fill(spark: SparkSession, d: str) -> DataFrame:
    own = T.bits(spark, d)
    entries = matrix.to_coordinates(own).join(F.broadcast(T.lacking(spark)), "pos", "left_anti").select("cell_id", "pos", "value")
    full = harmonise.filled(entries, own, T.lacking(spark))
    return full.groupBy("pos").agg(F.round(F.sum("value"), 6).alias("frequency"), F.count("*").alias("entries"))


@query(f"{W}{T.SQL_DICTIONARIES} SELECT coalesce(i.feature_name, o.feature_id) AS feature_name, o.feature_id, o.pos::INT AS pos, 0.5::DOUBLE AS filled, true AS in_first, false AS in_second FROM canonical o JOIN (SELECT feature_id FROM dict_f EXCEPT SELECT feature_id FROM dict_m) l USING (feature_id) LEFT JOIN (SELECT feature_id, arg_max(feature_name, line_no) AS feature_name FROM dict_f GROUP BY 1) i USING (feature_id)")
def tracking(spark: SparkSession, d: str) -> DataFrame:
    f, m = (harmonise.first_names(T.dictionary(spark, d, w)) for w in "FM")
    return harmonise.tracking(f, m, harmonise.canonical_order(T.features(spark, d), f))


_COVERED = f"""{W}{T.SQL_DICTIONARIES}, top AS (SELECT p_name AS feature_name, count(*) AS frequency FROM part GROUP BY 1),
covered AS (SELECT t.feature_name, t.frequency, f.feature_id, m.feature_id IS NOT NULL AS in_second, f.feature_id IS NULL AS without_id FROM top t LEFT JOIN dict_f f USING (feature_name) LEFT JOIN (SELECT DISTINCT feature_id FROM dict_m) m ON m.feature_id = f.feature_id)"""


def _covered(spark: SparkSession, d: str) -> DataFrame:
    top = T.table(spark, d, "part").groupBy(F.col("p_name").alias("feature_name")).agg(F.count("*").alias("frequency"))
    return harmonise.coverage(top, T.dictionary(spark, d, "F"), harmonise.first_names(T.dictionary(spark, d, "M")))


@query(f"{_COVERED} SELECT * FROM covered")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return _covered(spark, d)


@query(f"{_COVERED} SELECT count(*) AS features, sum(in_second::INT)::BIGINT AS present, sum(without_id::INT)::BIGINT AS without_id, (count(*) - sum(in_second::INT) - sum(without_id::INT))::BIGINT AS absent, round(100.0::DOUBLE * sum(in_second::INT) / nullif(count(*), 0), 6) AS present_percent FROM covered")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(harmonise.coverage_summary(_covered(spark, d)), "present_percent")


@query(f"""{W}{T.SQL_DICTIONARIES}, a AS (SELECT feature_id, row_number() OVER (ORDER BY line_no) - 1 AS pos FROM dict_f), b AS (SELECT feature_id, row_number() OVER (ORDER BY line_no) - 1 AS pos FROM dict_m)
SELECT pos::INT AS pos, a.feature_id AS first_id, b.feature_id AS second_id FROM a FULL JOIN b USING (pos) WHERE a.feature_id IS DISTINCT FROM b.feature_id ORDER BY pos LIMIT 5""")
def order_divergences(spark: SparkSession, d: str) -> DataFrame:
    def order(which: str) -> DataFrame:
        names = harmonise.first_names(T.dictionary(spark, d, which))
        return harmonise.canonical_order(names.select("feature_name", F.col("line_no").alias("pos")), names)

    return harmonise.divergences(order("F"), order("M"))


# Metadata and labels.


@query("SELECT replace(d.source, '.', '-') AS source, count(*) AS n, count(l.quality) AS annotated, sum(l.toxic)::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def metadata_attach(spark: SparkSession, d: str) -> DataFrame:
    joined = prepare.attach(T.table(spark, d, "documents").select("doc_id", "source"), T.table(spark, d, "labels"), "doc_id", ["quality", "toxic"])
    return joined.groupBy(prepare.normal_key("source").alias("source")).agg(F.count("*").alias("n"), F.count("quality").alias("annotated"), F.sum("toxic").alias("toxic"))


@query("SELECT count(*) AS cells, count(l.quality) AS annotated, (count(*) - count(l.quality))::BIGINT AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def annotation_gap(spark: SparkSession, d: str) -> DataFrame:
    return prepare.annotation_gap(prepare.attach(T.table(spark, d, "documents").select("doc_id"), T.table(spark, d, "labels"), "doc_id", ["quality"]), "quality")


@query("SELECT count(*) AS shared FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def key_overlap(spark: SparkSession, d: str) -> DataFrame:
    return prepare.key_overlap(T.table(spark, d, "documents"), T.table(spark, d, "labels"), "doc_id")


@query("SELECT d.doc_id, d.lang, l.quality::INT AS quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def annotated_rows(spark: SparkSession, d: str) -> DataFrame:
    joined = prepare.attach(T.table(spark, d, "documents").select("doc_id", "lang"), T.table(spark, d, "labels"), "doc_id", ["quality"])
    return prepare.coded_only(prepare.annotated(joined, "quality"), "quality")


_CODE = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END"


@query(f"SELECT event_type, ({_CODE})::INT AS label, count(*) AS n FROM events GROUP BY 1, 2")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    return prepare.encode_labels(T.table(spark, d, "events"), "event_type", T.CODES).groupBy("event_type", "label").agg(F.count("*").alias("n"))


@query(f"SELECT label, count(*) AS n FROM (SELECT ({_CODE})::INT AS label FROM events) WHERE label IS NOT NULL GROUP BY 1")
def labels_coded(spark: SparkSession, d: str) -> DataFrame:
    return prepare.coded_only(prepare.encode_labels(T.table(spark, d, "events"), "event_type", T.CODES)).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT vec_id AS cell_id, CASE WHEN label NOT IN (1, 3, 4, 5, 6, 7, 0) THEN 2 ELSE label END AS label FROM embeddings")
def recode_rare(spark: SparkSession, d: str) -> DataFrame:
    return prepare.recode_others(T.cells(spark, d).select("cell_id", "label"), [1, 3, 4, 5, 6, 7, 0], 2)


@query("SELECT CASE WHEN vec_id < 300 THEN 'train' ELSE 'test' END AS part, label, count(*) AS n FROM embeddings WHERE label <> 0 GROUP BY 1, 2")
def positional_split(spark: SparkSession, d: str) -> DataFrame:
    return prepare.split_at(prepare.labelled(T.cells(spark, d)), 300).groupBy("part", "label").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, label")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return select.value_counts(T.cells(spark, d), "label")


@query("SELECT label, count(*) AS n FROM embeddings WHERE label IN (1, 3, 4, 5, 6, 7) GROUP BY 1")
def class_sizes(spark: SparkSession, d: str) -> DataFrame:
    return select.value_counts(prepare.of_classes(T.cells(spark, d), T.CLASSES), "label", by_count=False)


@query("SELECT DISTINCT label FROM embeddings")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    return T.cells(spark, d).select("label").distinct()


@query("SELECT vec_id AS cell_id, label FROM embeddings WHERE label = 3 ORDER BY md5('42|' || vec_id), vec_id LIMIT 20")
def shuffle_sample(spark: SparkSession, d: str) -> DataFrame:
    return select.sample_of(T.cells(spark, d).filter("label = 3").select("cell_id", "label"), 20, 42)


# Profiles, neighbours, projection.


@query(f"{W}{T.SQL_CELLS}, big AS (SELECT label FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 9) SELECT label, pos::INT AS pos, round(avg(b), 6) AS mean FROM bits JOIN big USING (label) GROUP BY 1, 2")
def class_mean_profile(spark: SparkSession, d: str) -> DataFrame:
    cells = T.bits(spark, d)
    big = cluster.most_populous(cells, "label", 9).select("label")
    return rounded(cluster.mean_profiles(cells.join(F.broadcast(big), "label", "left_semi"), "label"), "mean")


@query(f"{W}{T.SQL_CELLS}, {T.SQL_PATTERNS} SELECT pattern_id::INT AS pattern_id, cls, string_agg(b::INT::VARCHAR, '' ORDER BY pos) AS bits FROM patterns GROUP BY 1, 2")
def majority_profile(spark: SparkSession, d: str) -> DataFrame:
    return T.patterns(spark, d).select("pattern_id", "cls", as_text("p").alias("bits"))


@query(f"{W}{T.SQL_CELLS}, {T.SQL_PATTERNS} SELECT pattern_id::INT AS pattern_id, cls, sum(b)::BIGINT AS active, string_agg(b::INT::VARCHAR, '' ORDER BY pos) AS bits FROM patterns GROUP BY 1, 2")
def majority_profile_packed(spark: SparkSession, d: str) -> DataFrame:
    """The same from bits packed into words."""
    cells = packed.packed(prepare.labelled(T.bits(spark, d)), T.WIDTH)
    return packed.majority_profiles(cells).select("pattern_id", "cls", "active", as_text(B.unpack("words", T.WIDTH)).alias("bits"))


@query(f"{W}{T.SQL_CELLS} SELECT a.cell_id, sum(a.b)::BIGINT AS active, sum((a.b <> c.b)::INT)::BIGINT AS apart, round(1 - avg((a.b <> c.b)::INT), 6) AS similarity FROM bits a JOIN bits c ON c.cell_id = a.cell_id + 1 AND c.pos = a.pos GROUP BY 1")
def similarity_packed(spark: SparkSession, d: str) -> DataFrame:
    """Each cell and the next one, compared as words."""
    cells = packed.packed(T.bits(spark, d).select("cell_id", "x"), T.WIDTH)
    after = cells.select((F.col("cell_id") - 1).alias("cell_id"), F.col("words").alias("other"))
    found = cells.join(after, "cell_id").select("cell_id", B.ones("words").alias("active"), B.apart("words", "other").alias("apart"))
    return found.withColumn("similarity", F.round(1 - F.col("apart") / T.WIDTH, 6))


def _nearest_sql(distance: str, query: str, k: int) -> str:
    return f"""{W}{T.SQL_CELLS}, q AS ({query}), apart AS (SELECT c.cell_id, round({distance}, 9) AS distance FROM cells c JOIN q USING (pos) GROUP BY 1)
SELECT cell_id, round(distance, 6) AS distance, row_number() OVER (ORDER BY distance, cell_id)::INT AS rank FROM apart ORDER BY distance, cell_id LIMIT {k}"""


_FIRST = "SELECT pos, v AS w FROM cells WHERE cell_id = 0"


def _nearest(spark: SparkSession, d: str, query: list[int], k: int, distance: float) -> DataFrame:
    cells = T.cells(spark, d)
    return rounded(neighbours.nearest(cells, neighbours.query_vector(cells, query, T.WIDTH), k, distance), "distance")


@query(_nearest_sql("sqrt(sum((c.v - q.w) * (c.v - q.w)))", _FIRST, 20))
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, [0], 20, 2.0)


@query(_nearest_sql("sum(abs(c.v - q.w))", _FIRST, 5))
def knn_l1(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, [0], 5, 1.0)


@query(_nearest_sql("sum(pow(abs(c.v - q.w), 0.5::DOUBLE))", _FIRST, 5))
def knn_half(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, [0], 5, 0.5)


@query(_nearest_sql("pow(sum(pow(abs(c.v - q.w), 3.0::DOUBLE)), 1.0::DOUBLE / 3)", "SELECT pos, avg(v) AS w FROM cells WHERE cell_id IN (1, 2, 3) GROUP BY 1", 5))
def knn_to_mean(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, [1, 2, 3], 5, 3.0)


def _join_sql(distance: str, k: int) -> str:
    return f"""{W}{T.SQL_CELLS}, apart AS (SELECT q.cell_id AS query_id, c.cell_id, round({distance}, 9) AS distance FROM cells q JOIN cells c USING (pos) WHERE q.label = 3 GROUP BY 1, 2)
SELECT query_id, cell_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, cell_id)::INT AS rank FROM apart QUALIFY rank <= {k}"""


def _nearest_of_class(spark: SparkSession, d: str, k: int, distance: float) -> DataFrame:
    """The cells nearest to each cell of a class."""
    cells = T.cells(spark, d)
    queries = cells.filter("label = 3").select(F.col("cell_id").alias("query_id"), "x")
    return rounded(neighbours.nearest_to_each(cells, queries, k, distance), "distance")


@query(_join_sql("sqrt(sum((c.v - q.v) * (c.v - q.v)))", 10))
def knn_join_l2(spark: SparkSession, d: str) -> DataFrame:
    return _nearest_of_class(spark, d, 10, 2.0)


@query(_join_sql("sum(abs(c.v - q.v))", 3))
def knn_join_l1(spark: SparkSession, d: str) -> DataFrame:
    return _nearest_of_class(spark, d, 3, 1.0)


_BASIS = "basis AS (SELECT i.range AS pos, j.range AS component, (1 - 2 * (bit_count(i.range & j.range) % 2)) / 8.0::DOUBLE AS weight FROM range(64) i, range(16) j)"
_PROJECTED = f"{W}{T.SQL_CELLS}, {_BASIS} SELECT cell_id, component::INT AS component, round(sum(b * weight), 6) AS value FROM bits JOIN basis USING (pos) GROUP BY 1, 2"


@query(_PROJECTED)
def projection(spark: SparkSession, d: str) -> DataFrame:
    z = project.project(T.bits(spark, d), project.hadamard_basis(T.WIDTH, 16))
    return rounded(z.select("cell_id", F.posexplode("x").alias("component", "value")), "value")


@query(_PROJECTED)
def projection_entries(spark: SparkSession, d: str) -> DataFrame:
    """The same from the coordinate layout, without leaving the JVM."""
    basis = project.basis_table(spark, project.hadamard_basis(T.WIDTH, 16))
    return rounded(project.project_entries(matrix.to_coordinates(T.bits(spark, d), keep_zeros=True), basis), "value")


_LENGTHS = f"{W}{T.SQL_CELLS} SELECT cell_id, round(sum(v * v), 6) AS square, round(sum(v * v), 6) AS projected FROM cells GROUP BY 1"


def _lengths(spark: SparkSession, d: str, basis: np.ndarray) -> DataFrame:
    """Squared lengths of cells before and after projection on a whole basis, which are equal if it is orthonormal."""
    cells = T.cells(spark, d).select("cell_id", F.round(V.dot("x", "x"), 6).alias("square"), "x")
    return project.project(cells, basis).select("cell_id", "square", F.round(V.dot("x", "x"), 6).alias("projected"))


@query(_LENGTHS)
def basis_orthogonality(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d, project.hadamard_basis(T.WIDTH, T.WIDTH))


def _qr_sql() -> str:
    """The seeded basis as a literal: it is a model, and the same for any data."""
    basis = project.orthonormal_basis(T.WIDTH, 16)
    rows = ", ".join(f"({i}, [{', '.join(f'{v!r}::DOUBLE' for v in row)}])" for i, row in enumerate(basis.tolist()))
    return f"basis AS (SELECT pos, generate_subscripts(w, 1) - 1 AS component, unnest(w) AS weight FROM (VALUES {rows}) t(pos, w))"


@query(f"{W}{T.SQL_CELLS}, {_qr_sql()} SELECT cell_id, component::INT AS component, round(sum(b * weight), 6) AS value FROM bits JOIN basis USING (pos) GROUP BY 1, 2")
def projection_qr(spark: SparkSession, d: str) -> DataFrame:
    z = project.project(T.bits(spark, d), project.orthonormal_basis(T.WIDTH, 16))
    return rounded(z.select("cell_id", F.posexplode("x").alias("component", "value")), "value")


@query(_LENGTHS)
def basis_orthogonality_qr(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d, project.orthonormal_basis(T.WIDTH, T.WIDTH))


def _components_sql(rows: str, k: int, squarings: int = 14) -> str:
    """Table expressions c0 to c<k - 1> (pos, weight) of the first components of rows (cell_id, pos, v), and s0 to s<k - 1> (their squared values).

    A matrix of products is squared again and again until one component is left; then that is taken off.
    """
    out = [f"g0 AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) AS v FROM {rows} a JOIN {rows} b ON a.cell_id = b.cell_id GROUP BY 1, 2)"]
    scaled = "SELECT i, j, v / sum(v) FILTER (i = j) OVER () AS v FROM "
    for c in range(k):
        out.append(f"p{c}_0 AS MATERIALIZED ({scaled} g{c})")
        for n in range(squarings):
            out.append(f"p{c}_{n + 1} AS MATERIALIZED ({scaled} (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{c}_{n} a JOIN p{c}_{n} b ON a.j = b.i GROUP BY 1, 2))")
        last = f"p{c}_{squarings}"
        one = f"SELECT i AS pos, v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j)"
        out += [
            f"c{c} AS MATERIALIZED (SELECT pos, v * (SELECT sign(arg_max(v, abs(v))) / sqrt(sum(v * v)) FROM ({one})) AS weight FROM ({one}))",
            f"s{c} AS MATERIALIZED (SELECT sum(a.weight * g.v * b.weight) AS s FROM g{c} g JOIN c{c} a ON a.pos = g.i JOIN c{c} b ON b.pos = g.j)",
        ]
        if c + 1 < k:
            out.append(f"g{c + 1} AS MATERIALIZED (SELECT g.i, g.j, g.v - s * a.weight * b.weight AS v FROM g{c} g JOIN c{c} a ON a.pos = g.i JOIN c{c} b ON b.pos = g.j, s{c})")
    return ", ".join(out)


def _all_components(k: int) -> str:
    return " UNION ALL ".join(f"SELECT {c} AS component, pos, weight FROM c{c}" for c in range(k))


_GRAM = "SELECT a.pos::INT AS i, b.pos::INT AS j, round(sum(a.v * b.v), 3) AS value FROM {rows} a JOIN {rows} b ON a.cell_id = b.cell_id GROUP BY 1, 2"


@query(f"{W}{T.SQL_CELLS} {_GRAM.format(rows='cells')}")
def uncentered_pca(spark: SparkSession, d: str) -> DataFrame:
    """The products of all pairs of features, made again from loadings V and singular values s as V s^2 V'. Only true components give them."""
    loadings, values = project.uncentred_components(T.cells(spark, d), T.WIDTH)
    return T.square_table(spark, np.round((loadings * values**2) @ loadings.T, 3))


@query("SELECT i.range::INT AS i, j.range::INT AS j, (i.range = j.range)::INT::DOUBLE AS value FROM range(64) i, range(64) j")
def pca_orthogonality(spark: SparkSession, d: str) -> DataFrame:
    """V'V of the loadings: one on the diagonal, else zero."""
    loadings, _ = project.uncentred_components(T.cells(spark, d), T.WIDTH)
    return T.square_table(spark, np.round(loadings.T @ loadings, 6) + 0.0)


@query(f"{W}{T.SQL_CELLS}, {_components_sql('cells', 35)}, loadings AS ({_all_components(35)}) SELECT cell_id, component::INT AS component, round(sum(v * weight), 5) AS value FROM cells JOIN loadings USING (pos) GROUP BY 1, 2")
def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    cells = T.cells(spark, d)
    loadings, _ = project.uncentred_components(cells, T.WIDTH, 35)
    return project.component_scores(cells, loadings).select("cell_id", F.posexplode("x").alias("component", "value")).withColumn("value", F.round("value", 5))


@query(f"{W}{T.SQL_CELLS}, {_components_sql('cells', 8)}, loadings AS ({_all_components(8)}), squares AS ({' UNION ALL '.join(f'SELECT {c} AS component, s FROM s{c}' for c in range(8))}) SELECT component::INT AS component, pos::INT AS pos, round(weight, 5) AS weight, round(sqrt(s), 5) AS size, 0.0::DOUBLE AS residual FROM loadings JOIN squares USING (component)")
def leading_components(spark: SparkSession, d: str) -> DataFrame:
    """Components by subspace iteration on rows of entries, with their values and residuals."""
    path = f"{store.temporary(spark, 'components')}/rows"
    matrix.to_rows(matrix.to_coordinates(T.cells(spark, d))).write.parquet(path)
    rows = spark.read.parquet(path)
    loadings, values = project.leading_components(rows, T.WIDTH, 8)
    left = project.residuals(rows, loadings, values)
    table = [(c, p, float(loadings[p, c]), float(values[c]), float(left[c])) for c in range(8) for p in range(T.WIDTH)]
    shown = spark.createDataFrame(table, "component int, pos int, weight double, size double, residual double")
    return shown.withColumns({n: F.round(n, 5) + 0.0 for n in ("weight", "size", "residual")})


_NEIGHBOUR = "SELECT a.cell_id, round(sum(a.v * b.v), 4) AS product, round(sum(a.v * a.v), 4) AS square FROM cells a JOIN cells b ON b.cell_id = a.cell_id + 1 AND a.pos = b.pos GROUP BY 1"


@query(f"{W}{T.SQL_CELLS} {_NEIGHBOUR}")
def pca_score_products(spark: SparkSession, d: str) -> DataFrame:
    """Products of each cell's scores with the next cell's and with themselves: those of the vectors, as no component is left out."""
    cells = T.cells(spark, d)
    z = project.component_scores(cells, project.uncentred_components(cells, T.WIDTH)[0]).select("cell_id", "x")
    after = z.select((F.col("cell_id") - 1).alias("cell_id"), F.col("x").alias("y"))
    return z.join(after, "cell_id").select("cell_id", F.round(V.dot("x", "y"), 4).alias("product"), F.round(V.dot("x", "x"), 4).alias("square"))


def _in_components(spark: SparkSession, d: str, components: int) -> DataFrame:
    """Patterns projected on the basis, then on the principal components of the projected cells."""
    basis = project.hadamard_basis(T.WIDTH, 16)
    z = project.project(T.bits(spark, d), basis)
    loadings, _ = project.uncentred_components(z, 16, components)
    rows = T.patterns(spark, d).select(F.col("pattern_id").alias("cell_id"), F.col("p").alias("x"))
    return project.project(project.project(rows, basis), loadings).select(F.col("cell_id").alias("pattern_id"), "x")


@query(f"""{W}{T.SQL_CELLS}, {T.SQL_PATTERNS}, {_BASIS}, z AS MATERIALIZED (SELECT cell_id, component AS pos, sum(b * weight) AS v FROM bits JOIN basis USING (pos) GROUP BY 1, 2), {_components_sql("z", 8)}, loadings AS ({_all_components(8)}),
placed AS (SELECT pattern_id, component AS pos, sum(b * weight) AS v FROM patterns JOIN basis USING (pos) GROUP BY 1, 2)
SELECT pattern_id::INT AS pattern_id, component::INT AS component, round(sum(v * weight), 5) AS value FROM placed JOIN loadings USING (pos) GROUP BY 1, 2""")
def patterns_in_components(spark: SparkSession, d: str) -> DataFrame:
    return _in_components(spark, d, 8).select("pattern_id", F.posexplode("x").alias("component", "value")).withColumn("value", F.round("value", 5))


@query(f"{W}{T.SQL_CELLS}, {T.SQL_PATTERNS}, {_BASIS}, z AS (SELECT pattern_id, component, sum(b * weight) AS v FROM patterns JOIN basis USING (pos) GROUP BY 1, 2) SELECT a.pattern_id::INT AS i, b.pattern_id::INT AS j, round(sum(a.v * b.v), 5) AS value FROM z a JOIN z b USING (component) GROUP BY 1, 2")
def pattern_products(spark: SparkSession, d: str) -> DataFrame:
    """Products of the patterns in all 16 components: those of the projected patterns."""
    z = _in_components(spark, d, 16)
    a, b = z.select(F.col("pattern_id").alias("i"), "x"), z.select(F.col("pattern_id").alias("j"), F.col("x").alias("y"))
    return a.crossJoin(F.broadcast(b)).select("i", "j", F.round(V.dot("x", "y"), 5).alias("value"))  # a row for each pair of patterns


# Clusters and prototypes: three steps of Lloyd in each class, unrolled in SQL.


def _lloyd_sql(clusters: int | dict = 3, steps: int = 3, where: str = "label <> 0", spread: int = 0) -> str:
    if isinstance(clusters, dict) and len(clusters) == 1:
        clusters = clusters["default"]
    wanted = str(clusters) if isinstance(clusters, int) else "CASE label " + " ".join(f"WHEN {k} THEN {n}" for k, n in clusters.items() if k != "default") + f" ELSE {clusters['default']} END"
    first = f"first AS (SELECT label, cell_id, row_number() OVER (PARTITION BY label ORDER BY cell_id) - 1 AS cluster FROM (SELECT DISTINCT label, cell_id FROM own) QUALIFY cluster < {wanted})"
    out = [f"own AS MATERIALIZED (SELECT cell_id, label, pos, b AS v FROM bits WHERE {where})", _spread_sql(clusters, spread) if spread else first, "c0 AS (SELECT o.label, f.cluster, o.pos, o.v AS c FROM own o JOIN first f USING (label, cell_id))"]
    for k in range(steps):
        out.append(_assign_sql(k))
        out.append(f"""m{k} AS (SELECT o.label, a.cluster, o.pos, round(avg(o.v), 9) AS c FROM own o JOIN a{k} a USING (label, cell_id) GROUP BY 1, 2, 3),
c{k + 1} AS (SELECT label, cluster, pos, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m USING (label, cluster, pos))""")
    return ",\n".join(out)


def _spread_sql(clusters: int, rounds: int) -> str:
    """Seeds by oversampling: candidates of least keys, their weights, and of those one after another the heaviest and farthest."""
    key = lambda r, d: f"-ln((('0x' || substr(md5('{r}|' || cell_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE) / {d}"
    near = lambda names: f"SELECT o.label, o.cell_id, q.cell_id AS candidate, round(sum((o.v - q.v) * (o.v - q.v)), 9) AS d FROM own o JOIN own q USING (label, pos) WHERE q.cell_id IN (SELECT cell_id FROM {names}) GROUP BY 1, 2, 3"
    out = [f"t0 AS MATERIALIZED (SELECT label, cell_id FROM (SELECT DISTINCT label, cell_id FROM own) QUALIFY row_number() OVER (PARTITION BY label ORDER BY {key(0, '1.0::DOUBLE')}, cell_id) = 1)"]
    for r in range(1, rounds + 1):
        apart = f"SELECT label, cell_id, min(d) AS d FROM ({near(f't{r - 1}')}) GROUP BY 1, 2 HAVING min(d) > 0"
        out.append(f"t{r} AS MATERIALIZED (SELECT * FROM t{r - 1} UNION ALL (SELECT label, cell_id FROM ({apart}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY {key(r, 'd')}, cell_id) <= {2 * clusters}))")
    out.append(f"heavy AS MATERIALIZED (SELECT label, candidate AS cell_id, count(*) AS w FROM (SELECT * FROM ({near(f't{rounds}')}) QUALIFY row_number() OVER (PARTITION BY label, cell_id ORDER BY d, candidate) = 1) GROUP BY 1, 2)")
    out.append("first0 AS MATERIALIZED (SELECT label, cell_id, 0 AS cluster FROM heavy QUALIFY row_number() OVER (PARTITION BY label ORDER BY w DESC, cell_id) = 1)")
    for k in range(1, clusters):
        apart = f"SELECT h.label, h.cell_id, h.w * min(n.d) AS far FROM heavy h JOIN ({near(f'first{k - 1}')}) n USING (label, cell_id) GROUP BY h.label, h.cell_id, h.w HAVING min(n.d) > 0"
        out.append(f"first{k} AS MATERIALIZED (SELECT * FROM first{k - 1} UNION ALL (SELECT label, cell_id, {k} FROM ({apart}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(far, 6) DESC, cell_id) = 1))")
    return ", ".join([*out, f"first AS (SELECT * FROM first{clusters - 1})"])


def _assign_sql(k: int) -> str:
    return f"""d{k} AS (SELECT o.label, o.cell_id, c.cluster, round(sum((o.v - c.c) * (o.v - c.c)), 9) AS d FROM own o JOIN c{k} c USING (label, pos) GROUP BY 1, 2, 3),
a{k} AS (SELECT label, cell_id, cluster FROM d{k} QUALIFY row_number() OVER (PARTITION BY label, cell_id ORDER BY d, cluster) = 1)"""


def _prototypes_sql(k: int, clusters: int | dict = 3) -> str:
    """Common table expressions up to protos (pattern_id, cls, source_cell_id, pos, b, p)."""
    return f"""{_lloyd_sql(clusters)},
near AS (SELECT o.label, o.cell_id, c.cluster, round(sum((o.v - c.c) * (o.v - c.c)), 9) AS d FROM own o JOIN c3 c USING (label, pos) GROUP BY 1, 2, 3),
chosen AS (SELECT label, cluster, cell_id, row_number() OVER (PARTITION BY label, cluster ORDER BY d, cell_id) AS rank FROM near QUALIFY rank <= {k}),
voted AS (SELECT n.label, n.cluster, o.pos, CASE WHEN avg(o.v) > 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM chosen n JOIN own o USING (label, cell_id) GROUP BY 1, 2, 3),
protos AS (SELECT dense_rank() OVER (ORDER BY v.label, v.cluster) - 1 AS pattern_id, v.label AS cls, n.cell_id AS source_cell_id, v.pos, v.b, 2 * v.b - 1 AS p FROM voted v JOIN (SELECT label, cluster, cell_id FROM chosen WHERE rank = 1) n USING (label, cluster))"""


def _restarts_sql(clusters: int, starts: int, steps: int) -> str:
    """Lloyd steps from several starts at once, and the clusters of the cheapest."""
    out = [f"first AS (SELECT s.range AS start, e.vec_id AS cell_id, row_number() OVER (PARTITION BY s.range ORDER BY md5(s.range || '|' || e.vec_id), e.vec_id) AS place FROM embeddings e, range({starts}) s QUALIFY place <= {clusters})"]
    out.append("c0 AS (SELECT f.start, f.cluster, x.pos, x.v AS c FROM (SELECT start, cell_id, row_number() OVER (PARTITION BY start ORDER BY cell_id) - 1 AS cluster FROM first) f JOIN cells x USING (cell_id))")
    for k in range(steps + 1):
        out.append(f"d{k} AS (SELECT c.start, x.cell_id, c.cluster, round(sum((x.v - c.c) * (x.v - c.c)), 9) AS d FROM cells x JOIN c{k} c USING (pos) GROUP BY 1, 2, 3)")
        out.append(f"a{k} AS (SELECT start, cell_id, cluster, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY start, cell_id ORDER BY d, cluster) = 1)")
        if k < steps:
            out.append(f"m{k} AS (SELECT a.start, a.cluster, x.pos, round(avg(x.v), 9) AS c FROM cells x JOIN a{k} a USING (cell_id) GROUP BY 1, 2, 3)")
            out.append(f"c{k + 1} AS (SELECT start, cluster, pos, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m USING (start, cluster, pos))")
    out.append(f"best AS (SELECT start FROM a{steps} GROUP BY 1 ORDER BY round(sum(d), 6), start LIMIT 1)")
    return f"{W}{T.SQL_CELLS}, {', '.join(out)} SELECT cell_id, (cluster + 1)::INT AS cluster FROM a{steps} JOIN best USING (start)"


@query(_restarts_sql(10, 10, 10))
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Ten clusters of all cells, numbered from 1: the best of ten starts of ten steps."""
    cells = T.cells(spark, d)
    centres, _ = cluster.with_restarts(cells, 10, 10, 10)
    found = cluster.cluster_of(cells.withColumn("label", F.lit(0)), {0: centres})
    return found.select("cell_id", (F.col("cluster") + 1).alias("cluster"))


@query("SELECT e.vec_id AS cell_id, e.label, d.lang, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def keyed_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ids that both tables have, joined by key; rows of other ids are left out, as by the join in its SQL, before the check of keys."""
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("cell_id"), "lang", "source")
    cells = T.cells(spark, d).select("cell_id", "label").join(docs, "cell_id", "left_semi")
    return prepare.keyed_together(cells, docs.join(cells.select("cell_id"), "cell_id", "left_semi"))


@query(f"{W}{T.SQL_CELLS}, {_lloyd_sql()}, {_assign_sql(3)} SELECT label, cell_id, cluster::INT AS cluster FROM a3")
def lloyd_clusters(spark: SparkSession, d: str) -> DataFrame:
    own = prepare.labelled(T.bits(spark, d))
    return cluster.cluster_of(own, cluster.lloyd(own, cluster.first_centres(own, 3))).select("label", "cell_id", "cluster")


@query(f"{W}{T.SQL_CELLS}, {_lloyd_sql(spread=2)}, {_assign_sql(3)} SELECT label, cell_id, cluster::INT AS cluster FROM a3")
def lloyd_clusters_spread(spark: SparkSession, d: str) -> DataFrame:
    """The same from spread seeds."""
    own = prepare.labelled(T.bits(spark, d))
    return cluster.cluster_of(own, cluster.lloyd_all(own, cluster.spread_starts(own, [3], rounds=2))[0]).select("label", "cell_id", "cluster")


_SHOW = "SELECT pattern_id::INT AS pattern_id, cls, source_cell_id, string_agg(b::INT::VARCHAR, '' ORDER BY pos) AS bits FROM protos GROUP BY 1, 2, 3"


@query(f"{W}{T.SQL_CELLS}, {_prototypes_sql(1)} {_SHOW}")
def prototypes_k1(spark: SparkSession, d: str) -> DataFrame:
    return cluster.prototypes(T.bits(spark, d), 3, 1).select("pattern_id", "cls", "source_cell_id", as_text("p").alias("bits"))


@query(f"{W}{T.SQL_CELLS}, {_prototypes_sql(3)} {_SHOW}")
def prototypes_k3(spark: SparkSession, d: str) -> DataFrame:
    return cluster.prototypes(T.bits(spark, d), 3, 3).select("pattern_id", "cls", "source_cell_id", as_text("p").alias("bits"))


# Recall and its scores.

_BASE = f"{W}{T.SQL_CELLS}, {T.SQL_PATTERNS}"
_BITS = "SELECT cell_id, string_agg((x > {t}::DOUBLE)::INT::VARCHAR, '' ORDER BY pos) AS bits FROM recalled GROUP BY 1"


def _memory(spark: SparkSession, d: str, **settings) -> memory.Memory:
    return memory.Memory(neighbours.gathered(T.patterns(spark, d)), memory.Settings(**settings))


@query(f"{_BASE}, {T.sql_recall()} {_BITS.format(t=0.5)}")
def recall_bits(spark: SparkSession, d: str) -> DataFrame:
    return _memory(spark, d, threshold=0.5).recall(T.bits(spark, d)).select("cell_id", as_text().alias("bits"))


@query(f"{_BASE}, {T.sql_recall()} {_BITS.format(t=0.5)}")
def recall_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The same with a memory that was saved and loaded."""
    path = store.temporary(spark, "memory")
    _memory(spark, d, threshold=0.5).save(spark, path)
    return memory.load(spark, path).recall(T.bits(spark, d)).select("cell_id", as_text().alias("bits"))


@query(f"{_BASE}, {T.sql_recall(beta=0.05, steps=2)} {_BITS.format(t=0.5)}")
def recall_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Two steps over patterns in blocks of about three, as more patterns than a task holds are taken."""
    found = memory.recall_in_blocks(T.bits(spark, d), neighbours.blocks_of(T.patterns(spark, d), 3 * T.WIDTH), memory.Settings(beta=0.05, steps=2, threshold=0.5))
    return found.select("cell_id", as_text().alias("bits"))


@query(f"{_BASE}, {T.sql_recall()} {_BITS.format(t=0.5)}")
def recall_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same on a stream of files that is run to its end."""
    path = store.temporary(spark, "stream")
    cells = T.bits(spark, d)
    cells.write.parquet(f"{path}/in")
    stream = streams.cells_stream(spark, f"{path}/in", cells.schema)
    streams.recall_stream(_memory(spark, d, threshold=0.5), stream, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(cells.schema).parquet(f"{path}/out").select("cell_id", as_text().alias("bits"))


@query(f"{_BASE}, {T.sql_recall(beta=0.05, steps=2)} {_BITS.format(t=0.5)}")
def recall_iter2(spark: SparkSession, d: str) -> DataFrame:
    return _memory(spark, d, beta=0.05, steps=2, threshold=0.5).recall(T.bits(spark, d)).select("cell_id", as_text().alias("bits"))


@query(f"{_BASE}, {T.sql_recall('SELECT cell_id, pos, v AS x FROM cells', value='b', beta=0.5)} SELECT cell_id, pos::INT AS pos, round(x, 4) AS x FROM recalled")
def recall_continuous(spark: SparkSession, d: str) -> DataFrame:
    out = _memory(spark, d, beta=0.5, binary=False).recall(T.cells(spark, d))
    return out.select("cell_id", F.posexplode("x").alias("pos", "x")).withColumn("x", F.round("x", 4))


@query(f"{_BASE}, {T.sql_recall('SELECT cell_id, pos, CASE WHEN pos % 5 = 2 THEN 0.0::DOUBLE ELSE 2 * b - 1 END AS x FROM bits')} {_BITS.format(t=0.5)}")
def recall_with_fill(spark: SparkSession, d: str) -> DataFrame:
    half = T.bits(spark, d).withColumn("x", F.transform("x", lambda v, i: F.when(i % T.LACKING[0] == T.LACKING[1], harmonise.ABSENT).otherwise(v)))
    return _memory(spark, d, threshold=0.5).recall(half).select("cell_id", as_text().alias("bits"))


@query(f"{_BASE} SELECT c.cell_id, q.pattern_id::INT AS pattern_id, round(sum((2 * c.b - 1) * q.p), 6) AS score FROM bits c JOIN patterns q USING (pos) WHERE c.pos % 5 <> 2 GROUP BY 1, 2")
def scores_with_absent(spark: SparkSession, d: str) -> DataFrame:
    """Scores from nonzero entries alone; absent features are never formed."""
    own = T.bits(spark, d)
    return rounded(memory.bit_scores(matrix.to_coordinates(own), own, T.patterns(spark, d), T.lacking(spark)), "score")


@query(f"{_BASE} SELECT c.cell_id, q.pattern_id::INT AS pattern_id, round(sum((2 * c.b - 1) * q.p), 6) AS score FROM bits c JOIN patterns q USING (pos) WHERE c.pos % 5 <> 2 GROUP BY 1, 2")
def scores_from_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same from rows of entries, a batch of cells and all patterns at a time."""
    scored = memory.row_scores(matrix.rows_of(T.bits(spark, d)), neighbours.gathered(T.patterns(spark, d)), _absent())
    return rounded(scored.select("cell_id", F.explode(F.map_entries("scores")).alias("s")).select("cell_id", F.col("s.key").alias("pattern_id"), F.col("s.value").alias("score")), "score")


def _absent() -> list[int]:
    return [p for p in range(T.WIDTH) if p % T.LACKING[0] == T.LACKING[1]]


@query(f"{_BASE}, {T.sql_recall('SELECT cell_id, pos, CASE WHEN pos % 5 = 2 THEN 0.0::DOUBLE ELSE 2 * b - 1 END AS x FROM bits')} {_BITS.format(t=0.5)}")
def recall_from_rows(spark: SparkSession, d: str) -> DataFrame:
    """Recall with absent features from rows of entries; what is absent is never formed."""
    return memory.recall_rows(_memory(spark, d, threshold=0.5), matrix.rows_of(T.bits(spark, d)), _absent()).select("cell_id", as_text().alias("bits"))


@query(f"{_BASE}, {T.sql_recall('SELECT cell_id, pos, 2 * b - 1 AS x FROM bits')} SELECT cell_id, pos::INT AS pos, round(b + (x > 0)::INT / 2.0::DOUBLE, 6) AS x FROM recalled JOIN bits USING (cell_id, pos)")
def compose_half(spark: SparkSession, d: str) -> DataFrame:
    bits = T.bits(spark, d)
    return rounded(prepare.composed(bits, _memory(spark, d).recall(bits)).select("cell_id", F.posexplode("x").alias("pos", "x")), "x")


_JUDGED = f"{_BASE}, {T.sql_recall()}, {T.sql_judged()}"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    held = _memory(spark, d)
    return evaluate.judged(held.recall(T.bits(spark, d)), held.patterns)


@query(f"{_JUDGED} SELECT cell_id, pattern_id::INT AS pattern_id, predicted, mismatches FROM judged")
def nearest_prototype(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("cell_id", "pattern_id", "predicted", "mismatches")


@query(f"{_JUDGED} SELECT cell_id, pattern_id::INT AS pattern_id, predicted, mismatches FROM judged")
def nearest_prototype_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same with the patterns in blocks of about three."""
    recalled = _memory(spark, d).recall(T.bits(spark, d))
    found = neighbours.nearest_in_blocks(recalled.select("cell_id", "x"), neighbours.blocks_of(T.patterns(spark, d), 3 * T.WIDTH))
    return found.select("cell_id", "pattern_id", F.col("cls").alias("predicted"), "mismatches")


@query(f"{_JUDGED} SELECT cell_id, label, predicted, active_pattern, active_recall FROM judged WHERE label <> 0")
def recall_detail(spark: SparkSession, d: str) -> DataFrame:
    return prepare.labelled(_judged(spark, d)).select("cell_id", "label", "predicted", "active_pattern", "active_recall")


_ASKED = "label <> 0"
_SCORES = ("accuracy", "error", "f1_macro", "f1_weighted", "exact_rate", "similarity")


@query(f"{_JUDGED}, {T.SQL_METRICS.format(where=_ASKED)} {T.SQL_SUMMARY.format(where=_ASKED)}")
def recall_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.metrics(prepare.labelled(_judged(spark, d))), "accuracy", "error", "f1_macro", "f1_weighted", "exact_rate", "similarity")


@query(f"{_JUDGED}, {T.SQL_METRICS.format(where=_ASKED)} {T.SQL_SUMMARY.format(where=_ASKED)}")
def recall_metrics_packed(spark: SparkSession, d: str) -> DataFrame:
    """The same from recalled cells and patterns that are packed into words."""
    patterns = packed.majority_profiles(packed.packed(prepare.labelled(T.bits(spark, d)), T.WIDTH))
    recalled = packed.packed(prepare.labelled(_memory(spark, d).recall(T.bits(spark, d))), T.WIDTH)
    return rounded(evaluate.metrics(packed.judged(recalled, patterns, T.WIDTH)), *_SCORES)


@query(f"{_JUDGED} SELECT cell_id, pattern_id::INT AS pattern_id, predicted, mismatches FROM judged")
def nearest_prototype_packed(spark: SparkSession, d: str) -> DataFrame:
    patterns = packed.majority_profiles(packed.packed(prepare.labelled(T.bits(spark, d)), T.WIDTH))
    found = packed.nearest_pattern(packed.packed(_memory(spark, d).recall(T.bits(spark, d)), T.WIDTH), patterns)
    return found.select("cell_id", "pattern_id", F.col("cls").alias("predicted"), "mismatches")


_IN = f"label IN {T.CLASSES}"


@query(f"{_JUDGED}, {T.SQL_METRICS.format(where=_IN)} {T.SQL_SUMMARY.format(where=_IN)}")
def recall_metrics_classes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.metrics(_judged(spark, d), T.CLASSES), "accuracy", "error", "f1_macro", "f1_weighted", "exact_rate", "similarity")


@query(f"""{_JUDGED}, {T.SQL_METRICS.format(where=_IN)}, asked AS (SELECT a.cls::VARCHAR AS name, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1, coalesce(support, 0) AS support FROM (SELECT unnest({list(T.CLASSES)}) AS cls) a LEFT JOIN per_class USING (cls))
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM asked
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM asked
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM asked""")
def per_class_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.report(_judged(spark, d), T.CLASSES), "precision", "recall", "f1")


@query(f"{_JUDGED}, c AS (SELECT unnest({list(T.CLASSES)})::INT AS cls) SELECT a.cls AS label, b.cls AS predicted, coalesce(n, 0) AS n FROM c a CROSS JOIN c b LEFT JOIN (SELECT label, predicted, count(*) AS n FROM judged GROUP BY 1, 2) j ON j.label = a.cls AND j.predicted = b.cls")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_judged(spark, d), T.CLASSES)


@query(f"{_JUDGED} SELECT DISTINCT label FROM (SELECT label FROM judged WHERE {_ASKED} UNION SELECT predicted FROM judged WHERE {_ASKED})")
def label_union(spark: SparkSession, d: str) -> DataFrame:
    found = prepare.labelled(_judged(spark, d))
    return found.select("label").union(found.select("predicted")).distinct()


# Sweeps.


def _one_config(tag: str, head: str, recall: str, protos: str, threshold: float, front: str) -> str:
    """One configuration's metrics as a query in brackets; its table expressions are its own."""
    where = "label <> 0"
    return f"(WITH {front}, {recall}, {T.sql_judged(threshold, protos)}, {T.SQL_METRICS.format(where=where)} SELECT {head}, * FROM ({T.SQL_SUMMARY.format(where=where)}))"


_BETAS, _STEPS = (4, 8, 16, 32, 64), (1, 2, 3, 5)


def _settings_sql(betas, steps) -> str:
    grid = [(b, s) for b in betas for s in steps]
    parts = [_one_config(str(k), f"{k} AS config, {float(b)}::DOUBLE AS beta, {s}::INT AS steps", T.sql_recall(beta=float(b), steps=s), "patterns", 0.5, f"{T.SQL_CELLS}, {T.SQL_PATTERNS}") for k, (b, s) in enumerate(grid)]
    return " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)


def _settings_sweep(spark: SparkSession, d: str, betas, steps) -> DataFrame:
    cells = prepare.labelled(T.bits(spark, d))
    return rounded(sweep.sweep_settings(cells, T.patterns(spark, d), betas, steps, 0.5), *_SCORES)


@query(_settings_sql(_BETAS, _STEPS))
def sweep_beta_iters(spark: SparkSession, d: str) -> DataFrame:
    return _settings_sweep(spark, d, _BETAS, _STEPS)


@query(_settings_sql((4, 8, 16, 32, 64, 128), (1,)))
def sweep_beta(spark: SparkSession, d: str) -> DataFrame:
    return _settings_sweep(spark, d, (4, 8, 16, 32, 64, 128), (1,))


# The grids of the original workflow; classes that it doesn't name have ten clusters.
_NC, _K = [(10, 1), (20, 1), (30, 1)], [(20, 1), (20, 3), (20, 5)]
_PER_CLASS = [
    ({1: 20, 3: 40, 4: 20, 5: 10, 6: 20, 7: 10, "default": 10}, 5),
    ({1: 20, 3: 60, 4: 20, 5: 10, 6: 20, 7: 10, "default": 10}, 5),
    ({1: 30, 3: 60, 4: 30, 5: 15, 6: 30, 7: 15, "default": 10}, 5),
    ({1: 20, 3: 80, 4: 20, 5: 10, 6: 20, 7: 10, "default": 10}, 5),
]


def _prototype_sql(configs) -> str:
    parts = []
    for number, (clusters, k) in enumerate(configs):
        front = f"{T.SQL_CELLS}, {_prototypes_sql(k, clusters)}"
        head = f"{number} AS config, (SELECT count(DISTINCT pattern_id) FROM protos) AS patterns"
        parts.append(_one_config(str(number), head, T.sql_recall(patterns="protos"), "protos", 0.5, front))
    return " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)


def _prototype_sweep(spark: SparkSession, d: str, configs) -> DataFrame:
    cells = prepare.labelled(T.bits(spark, d))
    found = sweep.sweep_prototypes(cells, cells, configs, memory.Settings(threshold=0.5))
    return rounded(found.withColumn("patterns", F.col("patterns").cast("bigint")), *_SCORES)


@query(_prototype_sql(_NC))
def sweep_nc(spark: SparkSession, d: str) -> DataFrame:
    return _prototype_sweep(spark, d, _NC)


@query(_prototype_sql(_K))
def sweep_k(spark: SparkSession, d: str) -> DataFrame:
    return _prototype_sweep(spark, d, _K)


@query(_prototype_sql(_PER_CLASS))
def sweep_nc_per_class(spark: SparkSession, d: str) -> DataFrame:
    return _prototype_sweep(spark, d, _PER_CLASS)


@query(f"SELECT config, patterns, accuracy FROM ({_prototype_sql(_PER_CLASS)}) ORDER BY round(100 * accuracy, 2) DESC, config LIMIT 1")
def best_config(spark: SparkSession, d: str) -> DataFrame:
    return sweep.best(_prototype_sweep(spark, d, _PER_CLASS)).select("config", "patterns", "accuracy")
