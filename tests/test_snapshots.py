"""Stored tables rewrite and read the partitions that an operation touches, logs keep one copy a run, streams keep a state a job."""

import random
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from conftest import opened
from pyspark.sql import functions as F

from jobgrain.operators import store, tracking, views
from jobgrain.sources import tables
from jobgrain.sources.snapshots import BUCKET, StoredTable
from jobgrain.streaming import jobs as streams

AS_OF = "2026-02-28"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def partitions(before, after):
    """Partitions of which files came or went."""
    return {Path(f).parent.name.partition("=")[2] for f, _ in set(before.items()) ^ set(after.items())}


@pytest.fixture
def jobs(spark):
    """40 days, ten rows a day, and two without a day."""
    rows = [(i, f"h{i}", f"s{i % 4}", f"2026-01-{1 + i % 31:02d}" if i < 398 else None, True, "new") for i in range(400)]
    df = spark.createDataFrame(rows, "job_id long, job_id_hash string, source_search_id string, day string, is_active boolean, status string")
    return df.select("job_id", "job_id_hash", "source_search_id", F.to_date("day").alias("first_seen_date"), F.to_date("day").alias("last_seen_date"), "is_active", "status", F.lit(False).alias("applied"), F.lit(False).alias("rejected"), F.lit("x").alias("hit"), F.lit(1).alias("row"))


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_one_update_rewrites_one_bucket(spark, jobs, tmp_path):
    at = StoredTable(spark, str(tmp_path / "t"), "job_id", buckets=16)
    at.create(jobs)
    before = files(at.path)
    assert len(before) == 16
    updates = spark.createDataFrame([(7, 1, "2026-02-01", "applied"), (7, 2, "2026-02-02", None), (10**9, 3, "2026-02-03", "on_hold")], "job_id long, update_id long, updated_at string, status string")
    touched = at.apply_updates(updates)
    assert len(touched) == 2 and partitions(before, files(at.path)) == {str(b) for b in touched}
    want = store.apply_updates(jobs, updates)
    assert same(at.read(), want) and at.read().columns == jobs.columns
    before = files(at.path)
    at.apply_updates(updates)  # once more: the same rows
    assert same(at.read(), want)
    assert [r.status for r in at.read_keys([7]).collect()] == ["applied"] and opened(at.read_keys([7])) == 1
    assert at.apply_updates(updates.limit(0)) == []


def test_rows_seen_again_rewrite_their_days(spark, jobs, tmp_path):
    at = StoredTable(spark, str(tmp_path / "t"), "first_seen_date")
    at.create(jobs)
    before = files(at.path)
    hashes = spark.createDataFrame([("h3",), ("h34",), ("h399",), ("nobody",)], "job_id_hash string")
    touched = at.touch(hashes, AS_OF)
    assert {str(v) for v in touched} == {"2026-01-04", "None"}
    assert partitions(before, files(at.path)) == {"2026-01-04", "__HIVE_DEFAULT_PARTITION__"}
    assert same(at.read(), store.touch_last_seen(jobs, hashes, AS_OF))


def test_rows_that_are_gone_rewrite_their_days(spark, jobs, tmp_path):
    at = StoredTable(spark, str(tmp_path / "t"), "first_seen_date")
    at.create(jobs)
    seen = jobs.where("job_id NOT IN (1, 32, 5)").select("source_search_id", "job_id_hash")
    searches = spark.createDataFrame([("s0", True), ("s1", True), ("s2", False)], "id string, enabled boolean")
    before = files(at.path)
    assert {str(v) for v in at.mark_inactive(seen, searches)} == {"2026-01-02", "2026-01-06"}
    assert partitions(before, files(at.path)) == {"2026-01-02", "2026-01-06"}
    assert same(at.read(), store.mark_inactive(jobs, seen, searches))


def test_new_rows_are_appended_and_old_days_dropped(spark, jobs, tmp_path):
    at = StoredTable(spark, str(tmp_path / "t"), "first_seen_date")
    at.create(jobs)
    batch = spark.createDataFrame([(1, 1000, "h3"), (3, 1002, "new"), (2, 1001, "new")], "seq long, job_id long, job_id_hash string")
    before = files(at.path)
    at.insert_new(batch, AS_OF)
    after = files(at.path)
    assert partitions(before, after) == {AS_OF} and set(before.items()) <= set(after.items())
    assert same(at.read(), store.insert_new(jobs, batch, AS_OF)) and at.read().where("job_id = 1001").count() == 1
    before = files(at.path)
    gone = at.retain(AS_OF, 45)
    assert {str(v) for v in gone} == {"None", *(f"2026-01-{d:02d}" for d in range(1, 14))}
    assert set(files(at.path).items()) < set(before.items())
    assert same(at.read(), store.apply_retention(store.insert_new(jobs, batch, AS_OF), {}, AS_OF, 45)[0])


def test_a_range_of_days_opens_its_partitions(spark, jobs, tmp_path):
    at = StoredTable(spark, str(tmp_path / "t"), "first_seen_date")
    at.create(jobs)
    scores = jobs.select("job_id", F.lit(50).alias("score"))
    asked = lambda rows: views.jobs_in_range(rows, scores, AS_OF, 35, 60)
    assert same(asked(at.read()), asked(jobs)) and asked(jobs).count()
    assert opened(at.read()) == 32
    days = {r.first_seen_date for r in asked(jobs).collect()}
    assert opened(at.read().where(F.col("first_seen_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 35))) == len(days) == 8
    assert opened(asked(at.read())) == 8


def test_partitions_that_become_empty_go(spark, jobs, tmp_path):
    at = StoredTable(spark, str(tmp_path / "t"), "first_seen_date")
    at.create(jobs)
    day = jobs.where("first_seen_date = DATE '2026-01-05' OR first_seen_date IS NULL")
    at.update(day, "job_id", lambda rows: rows.where("first_seen_date <> DATE '2026-01-05'"))
    assert same(at.read(), jobs.where("first_seen_date <> DATE '2026-01-05'")) and len(files(at.path)) == 30
    with pytest.raises(ValueError):
        at.read_keys([1])
    with pytest.raises(ValueError):
        StoredTable(spark, str(tmp_path / "u"), "job_id", 4).create(jobs.withColumn(BUCKET, F.lit(1)))


def test_a_log_has_one_copy_a_run(spark, tmp_path):
    path = str(tmp_path / "log")
    kinds = {c: k for c, k, _ in tables.columns_of("scraping_runs")}
    runs = tables.with_schema(spark.range(6).select(F.col("id").alias("run_id"), F.lit("seek").alias("platform"), (F.col("id") * 1.25).alias("duration_seconds"), F.lit("2026-01-01 00:00:00").alias("run_timestamp")), "scraping_runs")
    assert set(kinds) == set(runs.columns)
    first, second = runs.where("run_id < 2"), runs.where("run_id IN (2, 3)")
    with ThreadPoolExecutor(2) as pool:  # at the same time
        keys = list(pool.map(lambda r: tables.run_log_append(r, path), (first, second)))
    assert len(set(keys)) == 2
    assert tables.run_log_append(second, path) == keys[1]
    told = lambda: sorted(int(r.run_id) for r in tables.read_run_log(spark, path).collect())
    assert told() == [0, 1, 2, 3]
    tables.run_log_append(runs.where("run_id = 4"), path, run="nightly 2026/01/02")
    tables.run_log_append(runs.where("run_id IN (4, 5)"), path, run="nightly 2026/01/02")
    assert told() == [0, 1, 2, 3, 4, 5]
    assert {r.duration_seconds for r in tables.read_run_log(spark, path).where("run_id = 5").collect()} == {"6.3"}


def test_a_run_of_many_rows_has_a_key(spark):
    rows = spark.range(20_000_000)
    n, mark = tables.run_key(rows).split("-")
    assert int(n) == 20_000_000 and int(mark, 16) > 2**63
    few = tables.run_key(rows.limit(100))
    assert few == f"100-{sum(r.h & 0xFFFFFFFFFF for r in rows.limit(100).select(F.xxhash64('id').alias('h')).collect()):x}"


def test_late_events_count_by_their_own_time(spark, tmp_path):
    """Events dealt to files in any order, one file a batch, give what one fold gives."""
    rng = random.Random(1)
    kinds = ("interested", "applied", "interview_scheduled", "offer_received", "accepted", "declined_offer", "rejected")
    events = [(i, rng.randrange(40), rng.choice(kinds), f"2026-01-{rng.randint(1, 28):02d} {rng.randrange(24):02d}:00:00") for i in range(400)]
    jobs = spark.createDataFrame([(i, "new", i % 7 == 0, "2025-12-01" if i % 7 == 0 else None, False, None, "2025-12-02" if i % 5 == 0 else None) for i in range(50)], "job_id long, status string, applied boolean, applied_date string, rejected boolean, rejected_date string, offer_date string")
    jobs = jobs.withColumns({c: F.col(c).cast("date") for c in jobs.columns if c.endswith("_date")}).withColumns({"told": F.lit(1), "row": F.lit(2)})
    schema = "id long, job_id long, new_status string, at string"
    like = spark.createDataFrame(events, schema).withColumn("changed_at", F.to_timestamp("at")).drop("at")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = {tuple(r) for r in tracking.fold_status(jobs, like).collect()}
    for k in range(5):
        like.where(f"id % 5 = {(3 * k) % 5}").coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # the second start has nothing left to do
            streams.stream_status(streams.files_stream(spark, source, like, 1), out, str(tmp_path / "state")).awaitTermination()
    assert {tuple(r) for r in streams.streamed_status(jobs, out).collect()} == want
    batches = {r.batch: r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect()}
    assert len(batches) == 5 and all(n <= len({j for i, j, _, _ in events if i % 5 == (3 * k) % 5}) for k, n in batches.items())
    assert list((tmp_path / "state").rglob("*.changelog")) or list((tmp_path / "state").rglob("*.zip"))
