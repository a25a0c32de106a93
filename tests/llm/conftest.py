import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def docs_of(spark):
    """(rows) -> a documents table in a few partitions."""

    def make(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id long, text string" + extra).repartition(3)

    return make
