import os
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

SETTINGS = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}


@pytest.fixture(scope="session")
def spark():
    # Python workers import the package, too.
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(Path(__file__).parents[1]), os.environ.get("PYTHONPATH")]))
    session = SparkSession.builder.master("local[4]").config(map=SETTINGS).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
