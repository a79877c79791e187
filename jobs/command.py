"""What the command lines share: arguments, configuration, logging, and a session of their own."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("jobs")


def written(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Write df as Parquet in place of what is there, in folders of the columns ``by``; log its rows without a pass of their own."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    LOG.info("wrote %s rows to %s", seen.get["rows"], path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def main(about: str, inputs: Sequence[str], settings_of: Callable[..., object], run: Callable[..., object]) -> None:
    """Parse the command line, read the configuration, and run the job in a session that ends with it."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", required=True, help="JSON file with the job's settings")
    for name in (*inputs, "output"):
        parser.add_argument(f"--{name}", required=True, help=f"path of {name}, in any file system that Spark reads")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.pop("config")) as file:
        settings = settings_of(**json.load(file))
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, settings=settings, **args)
    finally:
        spark.stop()
