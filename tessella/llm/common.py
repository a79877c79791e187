"""What the operators of this subpackage share: tables in the shared folder, lookups without hot keys, byte kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..arrow import BATCH_BYTES, settings
from ..sources.store import temporary

#: Bits of a filter of ids, as a power of two, and those of one of its rows. It is 8 MB whatever the data, so it is always broadcast.
FILTER_BITS, ROW_BITS = 26, 15
#: Keys that are looked up by a broadcast because very many rows ask for them, at most.
HEAVY_KEYS = 10_000


class Workspace:
    """Named Parquet tables in the shared folder. They cut lineage and survive lost executors.

    Spark deletes the shuffle files of a table's query once the table is written. The tables are deleted when the application
    ends in good order.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, temporary(spark, name)

    def folder(self, name: str) -> str:
        """A path for files that go with the workspace."""
        return f"{self.root}/{name}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write df as a table and read it back."""
        path = self.folder(name)
        with settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column is called so (upper and lower case are one)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def id_filter(ids: F.Column, table: DataFrame) -> DataFrame:
    """The filter of a column of ids: rows of ROW_BITS bits, 2 ** (FILTER_BITS - ROW_BITS) at most, JVM-side."""
    h = F.pmod(F.xxhash64(ids.cast("bigint")), F.lit(1 << FILTER_BITS))
    return table.select(F.shiftright(h, ROW_BITS).alias("row"), h.bitwiseAND((1 << ROW_BITS) - 1).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))


def marked(docs: DataFrame, key: str, bits: DataFrame, mark: str) -> DataFrame:
    """docs with a boolean column: whether the key may be among the filter's ids. Null keys aren't, and no id of the filter is missed.

    The filter has a fixed size. Ids beyond some ten millions fill it, and then it lets ever more other keys pass: what is
    asked of it afterwards gets dearer, but its answers don't change.
    """
    row, own = fresh([*docs.columns, mark], "row", "bits")
    h = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(1 << FILTER_BITS))
    at = h.bitwiseAND((1 << ROW_BITS) - 1)
    byte = F.conv(F.hex(F.substring(F.col(own), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    joined = docs.join(F.broadcast(bits.toDF(row, own)), F.shiftright(h, ROW_BITS) == F.col(row), "left")
    return joined.select(*(column(c) for c in docs.columns), (F.col(key).isNotNull() & hit).alias(mark))


def column(name: str) -> F.Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def look_up(rows: DataFrame, key: str, table: DataFrame, total: int) -> DataFrame:
    """rows left-joined with a table of one row for each key, whose column ``n`` says how many rows ask for it (``total`` in all).

    Keys that ask for more than a HEAVY_KEYS-th of the rows, of which there are fewer than HEAVY_KEYS, are broadcast. Rows with
    such a key, or with none, are spread in the join of the others, so no key makes a task of its own.
    """
    values = [c for c in table.columns if c not in (key, "n")]
    k, *names = fresh(rows.columns, key, *(f"{c}_" for c in values))
    heavy = table.filter(F.col("n") > total / HEAVY_KEYS).select(F.col(key).alias(f"{k}h"), *(F.col(c).alias(f"{x}h") for c, x in zip(values, names, strict=True)))
    common = table.select(F.col(key).alias(f"{k}c"), *(F.col(c).alias(f"{x}c") for c, x in zip(values, names, strict=True)))
    found = rows.join(F.broadcast(heavy), F.col(key) == F.col(f"{k}h"), "left")
    done = F.col(f"{k}h").isNotNull() | F.col(key).isNull()
    spread = F.when(done, F.xxhash64(*(column(c) for c in rows.columns)).cast(table.schema[key].dataType)).otherwise(F.col(key))
    found = found.withColumn(f"{k}s", spread).join(common, F.col(f"{k}s") == F.col(f"{k}c"), "left")
    return found.select(*(column(c) for c in rows.columns), *(F.when(done, F.col(f"{x}h")).otherwise(F.col(f"{x}c")).alias(c) for c, x in zip(values, names, strict=True)))


def running(store: Workspace, name: str, df: DataFrame, order: list[F.Column], sums: dict[str, F.Column]) -> DataFrame:
    """df with exclusive prefix sums in a global order, under the names of ``sums``; no task orders more than a range.

    Ranges of the order are sorted apart; their totals, a row for each partition, are summed up before them.
    """
    part, at = fresh([*df.columns, *sums], "part", "at")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = store.put(name, ranged.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    first = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(part).agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    before = store.put(f"{name}-before", totals.select(F.col(part).alias(f"{part}_"), *(F.coalesce(F.sum(k).over(first(W.orderBy(part))), F.lit(0)).alias(f"{k}_") for k in sums)))
    own = ranged.select("*", *(F.coalesce(F.sum(v).over(first(W.partitionBy(part).orderBy(at))), F.lit(0)).alias(k) for k, v in sums.items()))
    joined = own.join(F.broadcast(before), F.col(part) == F.col(f"{part}_"))
    return joined.select(*(column(c) for c in df.columns), *((F.col(k) + F.col(f"{k}_")).alias(k) for k in sums))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_bucket(column: str, n: int) -> F.Column:
    """crc32 of the column as decimal text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is the empty string."""
    return [x or "" for x in column.to_pylist()]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column as one array, and the n + 1 offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


# The white space that parts words, and the odd factor and mixers of the hashes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FACTOR, MIXER, FACTOR_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
INVERSE = {f: np.uint64(pow(int(f), -1, 1 << 64)) for f in (FACTOR, FACTOR_2)}
_powers: dict[str, np.ndarray] = {}
#: Powers kept between calls; longer tables are made anew.
KEPT_POWERS = 1 << 22


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes with all bits stirred."""
    h = (h ^ (h >> np.uint64(32))) * MIXER
    h = (h ^ (h >> np.uint64(32))) * MIXER
    return h ^ (h >> np.uint64(32))


def powers(factor: np.uint64, n: int) -> np.ndarray:
    """factor ** 0 to factor ** (n - 1), modulo 2 ** 64; at least so many."""
    have = _powers.get(str(factor))
    if have is None or len(have) < n:
        row = np.full(max(n, 1 << 16), factor, np.uint64)
        row[0] = 1
        have = np.cumprod(row)
        if len(have) <= KEPT_POWERS:
            _powers[str(factor)] = have
    return have[:n]


def row_pieces(at: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """First and last + 1 of consecutive rows that hold about ``most`` bytes together, one row at least."""
    first = 0
    while first < len(at) - 1:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end
        first = end


def prefix_hash(data: np.ndarray, factor: np.uint64 = FACTOR) -> np.ndarray:
    """For span_hash: sums of (byte + 1) * factor ** position up to each position, modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(factor, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, factor: np.uint64 = FACTOR) -> np.ndarray:
    """Hashes of spans; equal bytes have equal hashes wherever they stand."""
    return mixed((prefix[ends] - prefix[starts]) * powers(INVERSE[factor], len(prefix))[starts] ^ (ends - starts).astype(np.uint64) * factor)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words, which are the maximal runs of other bytes than SPACE within a row."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(at, starts, "right") - 1


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n consecutive words of a row, and the positions of their first words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * FACTOR + hashes[k : k + m]
    first = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mixed(out[first]), first


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags each row has."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def crc32_sql(hexed: str, size: str) -> str:
    """DuckDB SQL for the CRC-32 of ``size`` bytes given as hex digits."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    byte = f"list_transform(range({size}), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::UBIGINT)"
    step = f"lambda crc, b: xor(({table}::UBIGINT[])[((xor(crc, b) & 255) + 1)::INT], crc >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {byte}), {step}), 4294967295::UBIGINT)::BIGINT"
