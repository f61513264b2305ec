import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("mendcast-tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('scratch')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def clean_registry():
    from mendcast.plans import registry

    yield
    registry.reset_plugins()


@pytest.fixture
def make(spark):
    """Points from {series: [values]}; x defaults to the position."""
    def build(series, xs=None):
        rows = [
            (k, i, float(xs[i]) if xs else float(i), v)
            for k, values in series.items() for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, "series_id string, pos bigint, x double, value double")

    return build


@pytest.fixture
def values():
    """Values per series in position order."""
    def get(df, column="value"):
        out = {}
        for r in df.select("series_id", "pos", column).orderBy("series_id", "pos").collect():
            out.setdefault(r[0], []).append(r[2])
        return out

    return get
