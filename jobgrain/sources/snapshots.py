"""A store as a partitioned table, of which an update rewrites the touched partitions and a read opens those that it asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobgrain.functions import folders
from jobgrain.functions.folders import by_partition
from jobgrain.functions.scratch import discard, materialize
from jobgrain.operators import store

#: The partition column of stores that are dealt by a hash of their key.
BUCKET = "store_bucket"


class StoredTable:
    """A table under path, partitioned by a date column of its own (by="first_seen_date") or by a hash of a key (by="job_id_hash",
    buckets=64).

    Dates suit readers that ask for a range of days and retention, which drops whole partitions; hashes suit updates by
    key, which then know their partitions from the keys alone. Elsewhere an update finds its partitions by reading the
    columns that it asks for, and no others. A row stays in its partition as long as the column that it is dealt by
    stays. An update is written to the shared folder first and moved from there, so it reads nothing that it replaces,
    and one that breaks while it is moved can be run again: all of the store's updates give the same twice.
    One writer at a time is assumed for a partition; different partitions may have different writers.
    """

    def __init__(self, spark: SparkSession, path: str, by: str, buckets: int | None = None):
        self.spark, self.path, self.by, self.buckets = spark, path, by, buckets
        self.column = by if buckets is None else BUCKET

    def _dealt(self, rows: DataFrame) -> DataFrame:
        if self.buckets is None:
            return rows
        if BUCKET in rows.columns:
            raise ValueError(f"{BUCKET} is the table's own column")
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(self.by)), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = by_partition(rows, self.column).write.mode(mode).partitionBy(self.column)
        (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """The table anew. Rows with many days or buckets are dealt so that each partition is one file, or a few where it is large."""
        by_partition(self._dealt(rows), self.column).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(self.column).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """More rows, in files of their own."""
        self._write(self._dealt(rows), "append")

    def _all(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        """All rows. A filter on a date that the table is partitioned by opens its partitions alone."""
        rows = self._all()
        return rows.drop(BUCKET) if self.buckets is not None else rows

    def read_keys(self, keys: list) -> DataFrame:
        """Rows of a few keys of a hashed table, from their buckets alone."""
        if self.buckets is None:
            raise ValueError("the table is not dealt by a key")
        kind = self._all().schema[self.by].dataType
        mine = self.spark.createDataFrame([(k,) for k in keys], f"k {kind.simpleString()}").select(F.pmod(F.xxhash64("k"), F.lit(self.buckets)).alias("b"))
        return self._all().where(F.col(BUCKET).isin([r.b for r in mine.distinct().collect()])).where(F.col(self.by).isin(keys)).drop(BUCKET)

    def _partitions(self, keys: DataFrame, key: str) -> list:
        """The values of the partition column that rows of some keys lie under."""
        if self.buckets is not None and key == self.by:
            found = self._dealt(keys.select(key))
        else:
            found = self._all().select(key, self.column).join(keys.select(key).distinct(), key, "left_semi")
        return [r[0] for r in found.select(self.column).distinct().collect()]

    def _under(self, values: list) -> Column:
        some = [v for v in values if v is not None]
        return (F.col(self.column).isin(some) if some else F.lit(False)) | (F.col(self.column).isNull() if None in values else F.lit(False))

    def update(self, keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame]) -> list:
        """Applies a change to the partitions that hold some keys, and returns their values; all others stay as they are.

        change takes and gives the rows of these partitions with the same columns; it may drop rows, and must leave alone
        those of other keys.
        """
        values = self._partitions(keys, key)
        if not values:
            return values
        mine = self._all().where(self._under(values))
        columns = [c for c in mine.columns if c != BUCKET or self.buckets is None]
        changed = materialize(self._dealt(change(mine.select(*columns))).select(*mine.columns), "changed")
        left = [r[0] for r in changed.select(self.column).distinct().collect()]
        self._write(changed, "overwrite")
        for v in set(values) - set(left):
            folders.delete(self.spark, f"{self.path}/{self.column}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}")
        discard(changed)
        return values

    # -- the store's operations (see operators.store), each on the partitions that it touches

    def insert_new(self, batch: DataFrame, as_of) -> None:
        """rows of new hashes are appended, no file is rewritten."""
        here = self.read()
        self.append(materialize(store.new_rows(here, batch, as_of), "fresh"))

    def touch(self, hashes: DataFrame, as_of) -> list:
        return self.update(hashes, "job_id_hash", lambda rows: store.touch_last_seen(rows, hashes, as_of))

    def mark_inactive(self, seen: DataFrame, searches: DataFrame, require_nonempty: bool = False) -> list:
        """Finds the rows that go by three columns of the store, then rewrites their partitions."""
        slim = self._all().select("source_search_id", "job_id_hash", "is_active")
        gone = store.mark_inactive(slim.where("is_active"), seen, searches, require_nonempty).where("NOT is_active")
        gone = materialize(gone.select("source_search_id", "job_id_hash").distinct(), "gone")
        return self.update(gone, "job_id_hash", lambda rows: store.mark_inactive(rows, seen, searches, require_nonempty))

    def apply_updates(self, updates: DataFrame) -> list:
        return self.update(updates, "job_id", lambda rows: store.apply_updates(rows, updates))

    def retain(self, as_of, days: int) -> list:
        """F4 on a table partitioned by first_seen_date: partitions before the last `days` go as folders, as do rows without a day."""
        if self.column != "first_seen_date":
            raise ValueError("retention drops whole days: partition the table by first_seen_date")
        day = F.coalesce(F.col(self.column) < F.date_sub(F.lit(as_of).cast("date"), days), F.lit(True))
        old = [r[0] for r in self._all().select(self.column).distinct().where(day).collect()]
        for v in old:
            folders.delete(self.spark, f"{self.path}/{self.column}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}")
        return old
