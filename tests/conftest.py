import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .config("spark.driver.memory", "6g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set Spark options for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def make_chains(spark, rows):
    """Chains from (seq, id, split, field, citations, result) tuples."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(
        rows, "seq bigint, id string, split string, field string, citations bigint, result string")
    for stage in ("title", "hypothesis", "method", "experiment", "conclusion"):
        df = df.withColumn(stage, F.concat(F.lit(stage + " words of "), "id"))
    return df.withColumn("year", F.lit(2020))
