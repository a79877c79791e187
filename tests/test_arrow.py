"""Batches are bounded, and settings of the session are changed only as long as they must be."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessella import arrow

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sizes(df):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    return sorted(r["n"] for r in arrow.arrow_map(df, run, "n bigint").collect())


def test_batches_have_few_rows_and_bytes(spark):
    df = spark.range(0, 1200, 1, 1)
    assert sizes(df) == [200, 500, 500]
    wide = sizes(df.select(F.expr("repeat('x', 100000)").alias("x")))
    assert sum(wide) == 1200 and max(wide) <= 30


def test_limits_that_the_user_has_set_stay(spark):
    arrow.limit_batches(spark)
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "7")
    try:
        assert max(sizes(spark.range(0, 30, 1, 1))) == 7 and spark.conf.get(ROWS) == "7"
    finally:
        spark.conf.set(ROWS, before)


def test_settings_are_restored(spark):
    key, other = "spark.sql.shuffle.partitions", "spark.tessella.test"
    before = spark.conf.get(key)
    with arrow.settings(spark, {key: "3", other: "x"}):
        assert spark.conf.get(key) == "3" and spark.conf.get(other) == "x"
    assert spark.conf.get(key) == before and spark.conf.get(other, None) is None
