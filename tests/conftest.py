import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("jobgrain-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def opened(df):
    """How many files the scans of a plan opened."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
