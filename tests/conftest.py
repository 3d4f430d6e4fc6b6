import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("evenkeel-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    from evenkeel.scratch import new_folder

    return lambda label="test": new_folder(spark, label)


@pytest.fixture
def keyed(spark):
    """Rows numbered by ``seq`` from a list of keys."""

    def make(keys):
        kind = "string" if keys and isinstance(keys[0], str) else "bigint"
        return spark.createDataFrame(list(enumerate(keys)), f"seq bigint, key {kind}")

    return make
