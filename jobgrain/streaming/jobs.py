"""Incremental forms of ingest, de-duplication, run metrics and status folding.

Every sink writes under the batch's own folder and overwrites it, so that a batch that runs again after a failure leaves the
same state: exactly one accepted row a hash over all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobgrain.functions.names import spare
from jobgrain.functions.text import job_hash
from jobgrain.operators.filters import Keywords
from jobgrain.operators.index import StoreIndex
from jobgrain.operators.ingest import classify_indexed
from jobgrain.operators.tracking import add_status, status_events, with_status


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of streams that start from now on lies in RocksDB, on the executors' disks, with its changes in the checkpoint: large states
    need no room on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def files_stream(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 64, fmt: str = "parquet") -> DataFrame:
    """A stream over the files of a path, with the columns of like."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def stream_ingest(source: DataFrame, store: DataFrame, path: str, kw: Keywords, as_of, checkpoint: str, window_days: int | None = 90, basis_points: int = 8500, **index) -> StreamingQuery:
    """Classifies every micro-batch against the store and what earlier batches took, and writes under path, each a folder a batch:
    accepted rows, touched hashes (of the stored rows that were seen again, not of those that repeat them) and outcome counts.

    What is known lies in an index under path/index (see StoreIndex, which takes the further options). It is built of store when
    the first stream starts and kept by the batches, later streams on other days among them: accepted rows are added and
    touched ones seen on as_of, so a posting that is seen again and again stays in the window.
    """
    known = StoreIndex(source.sparkSession, f"{path}/index", basis_points, **index)
    known.build(store)

    def batch(df: DataFrame, number: int) -> None:
        rows = classify_indexed(df, known, number, kw, window_days, as_of)
        day = F.lit(as_of).cast("date")
        accepted = rows.where("outcome = 'new'").withColumn("last_seen_date", day)
        touched = rows.where("outcome IN ('dup_hash', 'dup_store')").select(F.col("matched_hash").alias("job_id_hash")).distinct()
        accepted.write.mode("overwrite").parquet(f"{path}/accepted/batch={number}")
        accepted = df.sparkSession.read.schema(accepted.schema).parquet(f"{path}/accepted/batch={number}")
        touched.withColumn("seen", day).write.mode("overwrite").parquet(f"{path}/touched/batch={number}")
        rows.groupBy("outcome").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")
        known.add(number, accepted, touched, as_of)
        known.release()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested_store(store: DataFrame, path: str) -> DataFrame:
    """store as the batches of stream_ingest() under path have left it: their accepted rows added, last_seen_date the last day on which
    a row was seen, and rows that were seen again active."""
    spark = store.sparkSession
    taken = spark.read.parquet(f"{path}/accepted").withColumn("first_seen_date", F.col("last_seen_date"))
    fresh = {"is_active": True, "applied": False, "rejected": False, "status": "new"}
    value = lambda c: F.lit(fresh[c]) if c in fresh else F.col(c) if c in taken.columns else F.lit(None)
    rows = store.unionByName(taken.select(*(value(c).cast(store.schema[c].dataType).alias(c) for c in store.columns)))
    days = StoreIndex(spark, f"{path}/index").states(2**31 - 1).groupBy(F.col("job_id_hash").alias("h")).agg(F.max("day").alias("day"))
    h, day = spare(rows, "h", "day")
    seen = rows.withColumn(h, job_hash(F.col("title"), F.col("company"), F.col("url"))).join(days.toDF(h, day), h, "left")
    now = {"last_seen_date": F.greatest("last_seen_date", day)}
    if "is_active" in store.columns:
        now["is_active"] = F.col("is_active") | F.coalesce(F.col(day) > F.col("last_seen_date"), F.lit(False))
    return seen.withColumns(now).select(*store.columns)


def stream_dedup(source: DataFrame, event_time: str = "created_at", window: str = "90 days") -> DataFrame:
    """The stream with one row a posting hash inside the window; rows later than the window are dropped. The state holds a
    hash and a time a posting, on disk."""
    keep_state_on_disk(source.sparkSession)
    keyed = source.withColumn("job_id_hash", job_hash(F.col("title"), F.col("company"), F.col("url")))
    keyed = keyed.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return keyed.withWatermark(event_time, window).dropDuplicatesWithinWatermark(["job_id_hash"])


def stream_daily_runs(source: DataFrame, late: str = "1 day") -> DataFrame:
    """Run metrics a day and platform as an aggregate that updates."""
    day = F.window("run_timestamp", "1 day")
    timed = source.withColumn("run_timestamp", F.col("run_timestamp").cast("timestamp"))
    sums = timed.withWatermark("run_timestamp", late).groupBy(day.alias("w"), "platform").agg(
        F.count("*").alias("runs"), F.sum("total_cards_seen").alias("cards"), F.sum("tier1_filtered").alias("tier1"), F.sum("tier2_skipped").alias("tier2"))
    return sums.select(F.col("w.start").cast("date").alias("day"), "platform", "runs", "cards", "tier1", "tier2")


def stream_status(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Folds status events into one state a job: the last event and the days of some, by the events' own time, so events that come late
    or out of order, within a batch or across batches, change nothing. The states are kept by the stateful operator; each
    batch writes those of the jobs that its events name, a folder a batch. streamed_status() reads them."""
    keep_state_on_disk(source.sparkSession)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return status_events(source).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_status(jobs: DataFrame, path: str) -> DataFrame:
    """jobs after all events that stream_status() has folded under path."""
    return with_status(jobs, add_status(jobs.sparkSession.read.parquet(path)))
