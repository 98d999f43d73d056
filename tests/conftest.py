import json

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def records(spark):
    """(ordinal, raw) from Python objects; texts stay as they are."""

    def make(items):
        rows = [(i, x if isinstance(x, str) or x is None else json.dumps(x, ensure_ascii=False)) for i, x in enumerate(items)]
        return spark.createDataFrame(rows, "ordinal long, raw string")

    return make


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
