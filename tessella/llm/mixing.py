"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a target number of words. Complete epochs of a source come first; what is left of its target is
filled by weighted sampling without replacement: each document draws the exponential key ``-ln(u) / quality``, the
source's documents are taken in the order of the keys, and a prefix sum stops at the budget. ``u`` comes from a hash
of the id, so reruns agree. The quality of a text falls with symbols among its words and with words that it repeats.

No task sorts a source. Keys fall into a fixed number of bins, each of which has as many finer ones; sums show in which
bin, then in which finer bin of that, the budget ends, and only the rows of that finer bin of each source, one of 16 million,
are ordered. What comes of it is a plan, a row for each source: whole epochs, and the last key, id and size that the rest of
the budget reaches. Any scan can tell from it what a document gives, so texts are never joined with their share.

Edge cases: a null text has no words and is never taken; null sources form one source, the last; a null id draws by its
text; rows that are equal in key, id and size are taken together or not at all; a source without words has target 0; an
empty table gives an empty result. ``mix`` keeps no other columns than id and source; ``repeated`` keeps all of them, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, column, documents, fresh, look_up, running

#: Weights dealt to the sources in turn, the words wanted in all as a share of all words, and the most epochs of a source.
WEIGHTS, TOTAL, EPOCHS = (5, 2, 1), 1.5, 2.0
#: Bins of the keys in each source, and finer bins in each of these.
BINS = 4096
#: Above this many sources, their table is joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"


def spot_of(key: F.Column) -> F.Column:
    """The finer bin of a key, counted through all bins."""
    return F.least(F.floor((1 - F.exp(-key)) * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("int")


def source_name() -> F.Column:
    """The source after a mark, so that the null source has a name too."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def measure(docs: DataFrame, seed: int = 7, into: tuple = ("size", "key")) -> DataFrame:
    """docs with size in words and key of each row.

    Quality is the share of words among words and symbols, times ln(1 + different words) / ln(1 + words), which is 1 for
    texts that repeat no word and, unlike the share of different words, falls little with length alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    drawn = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary"))))
    u, symbols, words = fresh([*docs.columns, *into], "u", "symbols", "words")
    size, key = into
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = F.struct(F.size(found).cast("bigint").alias("all"), F.size(F.array_distinct(found)).alias("different"))
    rows = docs.withColumns({words: counts, symbols: F.regexp_count(text, F.lit(SYMBOL)), u: (F.conv(F.substring(F.md5(drawn.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)})
    n, different = F.col(words)["all"], F.col(words)["different"]
    variety = F.when(n > 0, F.log(different + 1.0) / F.log(n + 1.0)).otherwise(1.0)
    quality = (n + 1.0) / (n + F.col(symbols) + 1.0) * variety
    return rows.select(*(column(c) for c in docs.columns), n.alias(size), (-F.log(u) / quality).alias(key))


def measured(store: Workspace, docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, key and finer bin (spot) of each row, as a table."""
    rows = measure(docs.select("doc_id", "source", "text"), seed)
    return store.put("rows", rows.select("doc_id", "source", "size", "key", spot_of(F.col("key")).alias("spot")))


def targets(store: Workspace, sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, target and n from source, source_size and n.

    A source gets its weight's share until it reaches ``epochs`` times its size; the excess is shared again among the
    others. The end of that is: min(cap, level * weight), with one level for all. Sources fill up in the order of
    cap / weight, so the level follows from prefix sums in that order.
    """
    rows = running(store, "dealt", sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("fill", F.col("cap") / F.col("weight"))
    rows = running(store, "filled", rows.drop("rank"), [F.col("fill").asc(), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "weights": F.col("weight")})
    every = rows.agg(F.sum("source_size").alias("words"), F.sum("cap").alias("caps"), F.sum("weight").alias("weights")).first()
    wanted = min((every["words"] or 0) * float(total), every["caps"] or 0.0)
    level = (F.lit(wanted) - F.col("caps")) / (F.lit(every["weights"] or 0.0) - F.col("weights"))
    # The first source, in this order, that the level doesn't fill sets the level of all after it.
    first = rows.withColumn("level", level).filter(F.col("cap") > F.col("level") * F.col("weight")).agg(F.min(F.struct("fill", "level")).alias("open")).first()["open"]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first["level"]) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"), "n")


def closing(bins: DataFrame, told: DataFrame, many: int | None) -> DataFrame:
    """name, n and end: the bin on which a source's budget ends and what it may still give. Sources that give all have no row.

    bins: name, bin and words; told: name, n and budget of each source. Bins before the last are taken whole.
    """
    until = F.sum("words").over(W.partitionBy("name").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    ends = with_plan(bins.withColumn("until", until), told, many).filter(F.col("until") > F.col("budget"))
    ends = ends.groupBy("name").agg(F.min(F.struct("bin", (F.col("budget") - F.col("until") + F.col("words")).alias("rest"))).alias("end"))
    return ends.join(told.select("name", "n"), "name")


def plan(store: Workspace, rows: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, epochs: float = EPOCHS) -> tuple[DataFrame, int | None]:
    """Of each source of measured rows: name, source_size, target, whole epochs, and what the rest of the budget reaches; the number of rows if the table is too large to broadcast.

    name is the source after a mark, so that the null source has one too. until: the finer bin on which the budget ends, null if
    it takes all; last: the last (key, doc_id, size) in that bin that is taken, null if none is.
    """
    bin_ = (F.col("spot") / BINS).cast("int")
    bins = store.put("bins", rows.groupBy("source", bin_.alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    sources = targets(store, bins.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n")), weights, total, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = sources.select(source_name().alias("name"), "source_size", "target", "n", whole.alias("whole"))
    sources = store.put("sources", sources.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    known = sources.agg(F.count("*").alias("sources"), F.sum("n").alias("n")).first()
    many = None if known["sources"] <= BROADCAST_SOURCES else known["n"]
    ends = store.put("ends", closing(bins.select(source_name().alias("name"), "bin", "words"), sources.select("name", "n", "budget"), many))
    inside = with_plan(rows.select("doc_id", "size", "key", "spot", source_name().alias("name")), ends, many).filter(bin_ == F.col("end.bin"))
    finer = inside.groupBy("name", F.col("spot").alias("bin")).agg(F.sum("size").alias("words"))
    ends = store.put("finer-ends", closing(finer, ends.select("name", "n", F.col("end.rest").alias("budget")), many))
    inside = with_plan(rows.select("doc_id", "size", "key", "spot", source_name().alias("name")), ends, many).filter(F.col("spot") == F.col("end.bin"))
    # Equal rows are one; the document on which the budget ends is taken if more than half of it fits.
    peers = inside.groupBy("name", "key", "doc_id", "size", "end").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("name").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = peers.withColumn("before", before).filter(F.col("before") + F.col("size") / 2.0 < F.col("end.rest")).groupBy("name").agg(F.max(F.struct("key", "doc_id", "size")).alias("last"))
    out = sources.join(ends.select("name", F.col("end.bin").alias("until")), "name", "left").join(last, "name", "left")
    return store.put("plan", out), many


def with_plan(rows: DataFrame, table: DataFrame, many: int | None, name: str = "name") -> DataFrame:
    """rows with what the table says of their name."""
    table = table.withColumnRenamed("name", name)
    if many is not None:
        return look_up(rows, name, table, many)
    return rows.join(F.broadcast(table.drop("n")), name, "left")


def epochs_of(key: F.Column, doc_id: F.Column, size: F.Column, told: F.Column) -> F.Column:
    """How often the mix takes a document, from its source's plan (a struct)."""
    spot = spot_of(key)
    reached = F.coalesce(F.struct(key.alias("key"), doc_id.alias("doc_id"), size.alias("size")) <= told["last"], F.lit(False))
    extra = told["until"].isNull() | (spot < told["until"]) | ((spot == told["until"]) & reached)
    return told["whole"] + (extra & (told["budget"] > 0)).cast("bigint")


def mix(spark: SparkSession, docs: DataFrame, seed: int = 7, weights: tuple = WEIGHTS, total: float = TOTAL, epochs: float = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row."""
    store = Workspace(spark, "mix")
    rows = measured(store, docs, seed)
    table, many = plan(store, rows, weights, total, epochs)
    told = table.select("name", F.struct("source_size", "target", "whole", "budget", "until", "last").alias("told"), "n")
    joined = with_plan(rows.withColumn("name", source_name()), told, many)
    times = epochs_of(F.col("key"), F.col("doc_id"), F.col("size"), F.col("told"))
    return joined.select("doc_id", "source", "size", F.col("told.source_size").alias("source_size"), F.col("told.target").alias("target"), (F.col("size") * times).alias("taken"))


def repeated(spark: SparkSession, docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with each row as often as the mix takes it; rows without words go. Columns of any name stay as they are."""
    columns = docs.columns
    size, key, name, told, times, time = fresh(columns, "size", "key", "name", "told", "times", "time")
    store = Workspace(spark, "mix")
    table, many = plan(store, measured(store, docs, seed))
    told_of = table.select("name", F.struct("whole", "budget", "until", "last").alias(told), "n")
    rows = with_plan(measure(docs, seed, (size, key)).withColumn(name, source_name()), told_of, many, name)
    rows = rows.withColumn(times, F.when(F.col(size) > 0, epochs_of(F.col(key), F.col("doc_id"), F.col(size), F.col(told))).otherwise(0).cast("int"))
    copies = rows.filter(F.col(times) > 0).withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.select(*(column(c) for c in columns))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


#: op9_mix_sources in DuckDB: the same keys, targets by the same prefix sums, and one prefix sum over each source.
ORACLE = r"""
WITH measured AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols,
        len(list_distinct(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS different,
        (('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
    FROM documents),
keyed AS (
    SELECT doc_id, source, size, -ln(u) / ((size + 1)::DOUBLE / (size + symbols + 1)::DOUBLE * CASE WHEN size > 0 THEN ln(different + 1) / ln(size + 1) ELSE 1 END) AS key
    FROM measured),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY 1),
weighed AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sizes),
filling AS (
    SELECT *, (least(1.5::DOUBLE * sum(source_size) OVER (), sum(cap) OVER ()) - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT arg_min(level, cap / weight) AS level FROM filling WHERE cap > level * weight),
targets AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM levelled) * weight), cap) AS target FROM filling),
planned AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
running AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before FROM keyed)
SELECT r.doc_id, r.size, p.source_size, round(p.target, 6) AS target,
    (r.size * (p.whole + (r.before + r.size / 2.0::DOUBLE < p.target - p.whole * p.source_size)::INT))::BIGINT AS taken
FROM running r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source
"""
