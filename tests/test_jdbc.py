"""Tables of a database, here the one in memory whose driver comes with Spark."""

import pytest
from pyspark.sql import functions as F

from jobgrain.sources import tables

URL = "jdbc:derby:memory:jobgrain;create=true"
DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    """Rows (job_id, title, status, priority) as written."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "log"))
    spark._jvm.java.lang.Class.forName(DRIVER["driver"])
    to = spark._jvm.java.sql.DriverManager.getConnection(URL)
    rows = [(i if i < 100 else None, f"t{i}", "open", i % 7) for i in range(101)]
    statement = to.createStatement()
    for name in ("jobs", "idle"):
        statement.executeUpdate(f'CREATE TABLE {name} ("job_id" BIGINT, "title" VARCHAR(40), "status" VARCHAR(20), "priority" INT)')
    for i, title, status, priority in rows:
        statement.executeUpdate(f"INSERT INTO jobs VALUES ({'NULL' if i is None else i}, '{title}', '{status}', {priority})")
    yield rows
    to.close()


def test_ranges_of_a_key_are_read_at_once(spark, database):
    got = tables.read_table(spark, URL, "jobs", "jdbc", partitions=5, **DRIVER)
    assert got.columns == [c for c, _, _ in tables.columns_of("jobs")]
    per = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(per) == 5 and sum(per) == 101 and max(per) <= 22
    assert {(r.job_id, r.title, r.status, r.priority, r.source) for r in got.collect()} == {(*r, "linkedin") for r in database}
    other = tables.read_table(spark, URL, "jobs", "jdbc", split="priority", partitions=3, **DRIVER)
    assert other.count() == 101 and len(other.groupBy(F.spark_partition_id().alias("p")).count().collect()) == 3


def test_conditions_and_columns_go_to_the_database(spark, database):
    got = tables.read_table(spark, URL, "jobs", "jdbc", partitions=4, where="priority = 3 AND title <> 't3'", **DRIVER).select("job_id", "title")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "priority" in plan.split("PushedFilters")[1].split("]")[0] and "numPartitions=4" in plan
    assert "status" not in plan.split("ReadSchema")[1]
    assert sorted(r.job_id for r in got.collect()) == [i for i in range(100) if i % 7 == 3 and i != 3]


def test_an_empty_table(spark, database):
    assert not tables.read_table(spark, URL, "jobs", "jdbc", dbtable="idle", **DRIVER).count()
