"""Sharding by fixed virtual slots, with DataFrame and SQL functions only.

Records are hashed into a fixed number of slots, bytes are summed per slot, and a versioned table says which shard
holds each slot. Rebalancing edits that table: it moves as few slots as it can and never rehashes a record.
The law kept is ``bytes``: the shards' sizes are near equal.

A data set's map lives in a folder of its own, a version each time it is edited; versions are never overwritten. Who shards
again loads the last version, and a new one is stored only if a slot has to move.

Edge cases: a null text has size 1 (its one end byte) and the CRC of no bytes; a null id is hashed by its text's CRC
instead; repeated rows get a place each; an empty table gives an empty result; other columns are ignored.

Skew: rows that are equal in id, size and CRC (all rows without an id and text, for instance) are counted before they are
shuffled and travel as one row; their places are dealt out again at the end, in runs that are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import exists
from .common import Workspace, crc32_sql, documents

#: Number of virtual slots. It never changes while a data set lives, and bounds the slot map, which is broadcast.
SLOTS = 8192
#: By how much a shard may exceed an equal share before a stored map is edited.
TOLERANCE = 0.01
#: Places that one row deals out at once. More equal rows than that make several runs, which are spread over the tasks.
RUN = 10_000


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    hashed = F.md5(F.coalesce("doc_id", "text_crc32").cast("string").cast("binary"))
    return rows.withColumn("vslot", (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint") % slots).cast("int"))


def counted(rows: DataFrame) -> DataFrame:
    """One row for all equal ones, with their number ``n``; partial counts are formed before the shuffle."""
    return rows.groupBy("vslot", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty slots included; partial sums are formed before the shuffle. Rows may be counted ones."""
    n = F.col("n") if "n" in rows.columns else F.lit(1).cast("bigint")
    sums = rows.groupBy("vslot").agg(F.sum(F.col("size") * n).alias("bytes"), F.sum(n).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(sums), "vslot", "left").fillna(0, ["bytes", "rows"])  # sums has a row for each slot at most


def first_map(totals: DataFrame, shards: int) -> DataFrame:
    """Version 0: slots dealt round the shards, whatever they hold."""
    return totals.select(F.lit(0).alias("version"), "vslot", (F.col("vslot") % shards).alias("shard"), "bytes", "rows")


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version of the map stored below path; None if there is none. Unfinished versions don't count."""
    if not exists(spark, path):
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(where)]
    versions = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and exists(spark, f"{path}/{n}/_SUCCESS"))
    return spark.read.parquet(f"{path}/version={versions[-1]}").withColumn("version", F.lit(versions[-1])) if versions else None


def publish(spark: SparkSession, path: str, slot_map: DataFrame, version: int) -> DataFrame:
    """Store a map as this version, which must be new, and read it back."""
    slot_map.select("vslot", "shard", "bytes", "rows").coalesce(1).write.parquet(f"{path}/version={version}")
    return latest(spark, path)


def refreshed(slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """The map with the slots' present bytes and rows; no slot moves."""
    return slot_map.select("version", "vslot", "shard").join(F.broadcast(totals), "vslot").select("version", "vslot", "shard", "bytes", "rows")


def uneven(slot_map: DataFrame, shards: int, tolerance: float = TOLERANCE) -> bool:
    """Whether a shard exceeds an equal share by more than the tolerance, or the number of shards has changed."""
    loads = [r["bytes"] for r in slot_map.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()]  # a row for each shard
    return len(loads) != shards or max(loads) > sum(loads) / shards * (1 + tolerance)


def rebalance(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, edited towards equal bytes.

    Each shard keeps its largest slots as far as they fit into an equal share; the excess goes, largest slot first,
    to the shard that is lightest at that moment. Slots that no shard has to give stay where they are; those of a shard that
    is no more all go.
    """
    share = F.sum("bytes").over(W.partitionBy(F.lit(1))) / shards
    held = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, 0))
    judged = slot_map.withColumn("stays", (F.col("shard") < shards) & ((held <= share) | (F.col("bytes") == 0)))
    lightest = "array_position(s.loads, array_min(s.loads))"
    moves = (
        judged.agg(
            F.array(*(F.coalesce(F.sum(F.expr(f"if(stays and shard = {k}, bytes, 0)")), F.lit(0)).cast("bigint") for k in range(shards))).alias("loads"),
            F.array_sort(F.collect_list(F.expr("if(not stays, struct(-bytes as less, vslot), null)"))).alias("pool"),
        )
        .select(
            F.explode(
                F.expr(f"""aggregate(pool,
                    named_struct('loads', loads, 'moves', cast(array() as array<struct<vslot: int, target: int>>)),
                    (s, x) -> named_struct(
                        'loads', transform(s.loads, (v, i) -> if(i + 1 = {lightest}, v - x.less, v)),
                        'moves', concat(s.moves, array(named_struct('vslot', x.vslot, 'target', cast({lightest} - 1 as int))))),
                    s -> s.moves)""")
            ).alias("move")
        )
        .select("move.*")
    )
    return judged.join(F.broadcast(moves), "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("target", "shard").alias("shard"), "bytes", "rows")


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard, number ``shards``: slots move into it and nowhere else."""
    share = F.sum("bytes").over(W.partitionBy(F.lit(1))) / (shards + 1)
    after = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, 0))
    return slot_map.select((F.col("version") + 1).alias("version"), "vslot", F.when((after > share) & (F.col("bytes") > 0), shards).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "rows")


def place(equal: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of each of the counted rows and its place in the shard, gapless from 0.

    A row's place is the number of rows in earlier slots of its shard, from the map, plus its place in its own slot, so
    no task ever sorts a shard: the largest sort is that of the different rows of a slot. Equal rows take consecutive places.
    """
    before = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lookup = slot_map.select("vslot", "shard", before.alias("before"))
    earlier = F.sum("n").over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1))
    found = equal.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(lookup), "vslot").withColumn("slot", F.col("before") + F.col("earlier"))
    kept = ("doc_id", "size", "text_crc32", "vslot", "shard")
    single = found.filter("n = 1").select(*kept, "slot")
    # A run is short, whatever the number of equal rows; runs go to tasks by their first place.
    runs = found.filter("n > 1").select(*kept, (F.col("slot") + F.col("n") - 1).alias("end"), F.explode(F.expr(f"sequence(slot, slot + n - 1, {RUN}L)")).alias("begin")).repartition("shard", "begin")
    dealt = runs.select(*kept, F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + (RUN - 1), F.col("end")))).alias("slot"))
    return single.unionByName(dealt)


def shard(spark: SparkSession, docs: DataFrame, path: str | None = None, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """Place every row by the map stored below path, which is made at first and edited when shards have grown apart.

    Without a path the map lives as long as the application.
    """
    store = Workspace(spark, "shards")
    path = path or store.folder("slot-map")
    rows = store.put("rows", counted(with_slots(docs, slots)))
    totals = store.put("totals", slot_totals(rows, slots))
    last = latest(spark, path)
    if last is None:
        last = publish(spark, path, first_map(totals, shards), 0)
    current = refreshed(last, totals)
    if uneven(current, shards):
        current = refreshed(publish(spark, path, rebalance(current, shards), last.first()["version"] + 1), totals)
    return place(rows, current)


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark, documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard"), "vslot")


#: op7_virtual_slots in DuckDB: slots dealt round, then edited slot by slot in a recursion whose state is the shards' loads.
ORACLE = f"""
WITH RECURSIVE told AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
measured AS (SELECT doc_id, len(h) // 2 + 1 AS size, {crc32_sql("h", "len(h) // 2")} AS text_crc32 FROM told),
slotted AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id, text_crc32)::VARCHAR), 1, 8))::BIGINT % {SLOTS})::INT AS vslot FROM measured),
totals AS (SELECT s.range::INT AS vslot, coalesce(sum(size), 0)::BIGINT AS bytes, count(size) AS rows FROM range({SLOTS}) s LEFT JOIN slotted ON vslot = s.range GROUP BY 1),
dealt AS (SELECT *, vslot % 8 AS shard, sum(bytes) OVER () / 8 AS share, sum(bytes) OVER (PARTITION BY vslot % 8 ORDER BY bytes DESC, vslot ROWS UNBOUNDED PRECEDING) AS held, sum(bytes) OVER (PARTITION BY vslot % 8) AS load FROM totals),
judged AS (SELECT *, (SELECT max(load) <= {1 + TOLERANCE}::DOUBLE * max(share) FROM dealt) OR held <= share OR bytes = 0 AS stays FROM dealt),
pool AS (SELECT vslot, bytes, row_number() OVER (ORDER BY bytes DESC, vslot) AS turn FROM judged WHERE NOT stays),
moves AS (
    SELECT 0::BIGINT AS turn, (SELECT list(load ORDER BY shard) FROM (SELECT shard, sum(CASE WHEN stays THEN bytes ELSE 0 END)::BIGINT AS load FROM judged GROUP BY 1)) AS loads, NULL::INT AS vslot, NULL::INT AS shard
    UNION ALL
    SELECT p.turn, list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + p.bytes ELSE v END), p.vslot, (list_position(loads, list_min(loads)) - 1)::INT
    FROM moves m JOIN pool p ON p.turn = m.turn + 1),
placed AS (SELECT j.vslot, coalesce(m.shard, j.shard)::INT AS shard, rows FROM judged j LEFT JOIN moves m USING (vslot)),
counted AS (SELECT vslot, shard, coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY vslot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (before + row_number() OVER (PARTITION BY s.vslot ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, NULL::INT AS grown_shard, s.vslot
FROM slotted s JOIN counted USING (vslot)
"""
