"""Small dealings with folders through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def numbers(spark: SparkSession, path: str, name: str, complete: bool = True) -> list[int]:
    """The numbers n of the folders name=n under path, in order; complete: only those that a finished job has written."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return []
    found = [f.getPath() for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().partition("=")[2]) for p in found if not complete or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def by_partition(df: DataFrame, column: str) -> DataFrame:
    """df dealt for partitionBy(column): the rows of a partition lie together, small ones beside others, and one that is too large for a
    task is split, so that it becomes several files."""
    return df.hint("rebalance", F.col(column))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table under path; one without rows if nothing is there yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
