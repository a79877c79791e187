"""Annotate texts by associative recall: learn the classes of an annotated data set, and give each text of a second one a class.

    python -m jobs.annotate_texts --config jobs/annotate_texts.json --documents DOCUMENTS --conversations CONVERSATIONS --output OUTPUT

Documents are the annotated cells and words their features: a text has a word or not. The words that stand in most documents
are the features of both data sets. The majority profile of each annotated class goes into a memory, against which every
document and every turn of the conversations is recalled; the class of the pattern nearest to the recall is its annotation. A
word that no turn has is absent from the second data set and stands at one half there.

Below ``output`` are, each in place of what an earlier run wrote: ``features`` (word, frequency, rank), ``vectors`` by
data_set, ``model``, and ``annotations`` by data_set and class. Nothing depends on order or time, so a rerun gives the same.

Rows of one id are taken as one cell, which has the words of all of them and the least of their labels; rows without an id are
left out, and their number is logged. Null texts have no words. Texts whose class has no code teach nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.bits import unpack
from tessella.operators import cluster, evaluate, harmonise, memory, packed, prepare, select
from tessella.operators.neighbours import gathered

from .command import LOG, main, written

#: Fixed value: what a word is. Features that a run may have at most: each has a flag in the plan.
WORD, MOST_FEATURES = r"\p{L}+", 8192


@dataclass(frozen=True)
class Settings:
    """Codes of the annotated classes from 1, number of features, and the memory's settings."""

    codes: Mapping[str, int]
    features: int = 256
    beta: float = 8.0
    steps: int = 1
    threshold: float = 0.5

    def __post_init__(self):
        if not 0 < self.features <= MOST_FEATURES:
            raise ValueError(f"{self.features} features: from 1 to {MOST_FEATURES} are possible")


def cells_of(rows: DataFrame, *key: str) -> DataFrame:
    """cell_id (the key's parts, joined), text and the other columns of rows with a whole key."""
    return rows.filter(F.concat(*(F.col(k).cast("string") for k in key)).isNotNull()).withColumn("cell_id", F.concat_ws(":", *key))


def words_of(text: str) -> Column:
    """The words of a text, as often as they stand there.

    To be exploded as it is: of a column of its own Spark would first ask whether it is empty, and cut every text into words again.
    """
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def entries_of(cells: DataFrame) -> DataFrame:
    """(cell_id, pos, value) with a word in place of a position: ones for the words that a text has."""
    return cells.select("cell_id", F.explode(F.array_distinct(words_of("text"))).alias("pos"), F.lit(1.0).alias("value"))


def labelled_cells(cells: DataFrame, label: F.Column) -> DataFrame:
    """A row for each cell_id, with its label; 0 is no label."""
    return cells.groupBy("cell_id").agg(F.min(label).alias("label")).fillna(0, ["label"])


def chosen(cells: DataFrame, top: DataFrame) -> DataFrame:
    """(cell_id, pos) of the chosen words, at their places in order of the words; a word that a text repeats comes as often.

    The chosen words, as many as the settings say, are broadcast and met where a text is read; no other word leaves that task.
    """
    places = top.select("pos", (F.row_number().over(W.orderBy("pos")) - 1).alias("place"))
    said = cells.select("cell_id", F.explode(words_of("text")).alias("pos"))
    return said.join(F.broadcast(places), "pos").select("cell_id", F.col("place").alias("pos"))


def run(spark: SparkSession, documents: str, conversations: str, output: str, settings: Settings) -> DataFrame:
    """Run the job; returns the annotations as they stand in their folder."""
    docs, turns = spark.read.parquet(documents), spark.read.parquet(conversations)
    for path, rows, key in ((documents, docs, ["doc_id"]), (conversations, turns, ["conv_id", "turn"])):
        n = rows.select(F.count("*").alias("n"), F.count_if(F.coalesce(*(F.when(F.col(k).isNull(), True) for k in key), F.lit(False))).alias("lost")).first()
        LOG.info("read %s rows of %s, %s of them without an id", n["n"], path, n["lost"])
    first, second = cells_of(docs, "doc_id"), cells_of(turns, "conv_id", "turn")

    frequency = entries_of(first).groupBy("pos").agg(F.sum("value").alias("frequency"))
    top = written(select.top_features(frequency, settings.features), f"{output}/features")
    width = top.count()
    coded = prepare.encode_labels(first, "lang", settings.codes)
    own, others = chosen(coded, top), chosen(second, top)
    used = {r["pos"] for r in others.select("pos").distinct().collect()}  # a flag for each chosen feature
    absent = F.array(*(F.lit(k not in used) for k in range(width))) if width else F.array().cast("array<boolean>")
    bits = packed.from_entries(own, width, labelled_cells(coded, F.col("label"))).withColumn("data_set", F.lit("documents"))
    recalled = packed.from_entries(others, width, labelled_cells(second, F.lit(0))).withColumn("data_set", F.lit("conversations"))
    # Packed cells are so small that few tasks would hold them all, and form all vectors; so they are dealt out to all tasks, by
    # more than the id, by which they lie already. They are put in order of data sets: the writer, which needs that order, then sorts no vectors.
    rows = bits.unionByName(recalled).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "data_set", "cell_id").sortWithinPartitions("data_set")
    x = unpack("words", width)
    x = F.when(F.col("data_set") == "documents", x).otherwise(F.zip_with(x, absent, lambda v, m: F.when(m, harmonise.ABSENT).otherwise(v)))
    vectors = written(rows.select("cell_id", "label", x.alias("x"), "data_set"), f"{output}/vectors", "data_set")

    taught = prepare.labelled(vectors.filter("data_set = 'documents'"))
    held = memory.Memory(gathered(cluster.majority_profiles(taught)), memory.Settings(settings.beta, settings.steps, True, settings.threshold))
    LOG.info("a memory of %s patterns over %s features", len(held.patterns), width)
    held.save(spark, f"{output}/model")

    def annotated(data_set: str) -> DataFrame:
        return evaluate.judged(held.recall(vectors.filter(F.col("data_set") == data_set)), held.patterns).withColumn("data_set", F.lit(data_set))

    found = annotated("documents").unionByName(annotated("conversations"))
    named = prepare.name_labels(found, settings.codes, "predicted", "class")
    out = written(named.select("cell_id", "label", "predicted", "mismatches", "active_recall", "data_set", "class"), f"{output}/annotations", "data_set", "class")
    told = evaluate.metrics(prepare.labelled(out.withColumn("width", F.lit(width)))).first()
    LOG.info("of %s annotated documents %.4f have their own class; macro f1 %.4f, similarity %.4f", told["n"], told["accuracy"] or 0, told["f1_macro"] or 0, told["similarity"] or 0)
    return out


if __name__ == "__main__":
    main(__doc__, ("documents", "conversations"), Settings, run)
