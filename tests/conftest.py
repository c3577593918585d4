import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of one column expression over a single text."""
    from pyspark.sql import functions as F

    def value(expression, text):
        df = spark.createDataFrame([(text,)], "text string")
        return df.select(expression(F.col("text")).alias("v")).first()["v"]

    return value


@pytest.fixture
def each(spark):
    """Values of one column expression over several texts, in order."""
    from pyspark.sql import functions as F

    def values(expression, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        return [row["v"] for row in df.select("i", expression(F.col("text")).alias("v")).orderBy("i").collect()]

    return values
