"""The kept index of the store: a stream over many days gives what single batches over the whole store give."""

import random

import pytest
from conftest import opened
from pyspark.sql import functions as F

from jobgrain.functions import text
from jobgrain.operators import ingest, store
from jobgrain.operators.filters import Keywords
from jobgrain.operators.index import FIRST, StoreIndex
from jobgrain.streaming import jobs as streams

SCHEMA = "seq long, job_id long, title string, company string, url string, source string, description string"
KW = Keywords(description=("python", "sql"))
BODY = "python and sql " * 20


def posting(n, title, company="Acme", url=None, body=BODY):
    return (n, n, title, company, url, "seek", body)


def ingest_days(spark, tmp_path, first, days, **options):
    """Runs one stream a day over one path and checkpoint; the path."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    like = spark.createDataFrame([], SCHEMA)
    for day, rows in days:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        streams.stream_ingest(streams.files_stream(spark, source, like), first, out, KW, day, str(tmp_path / "state"), **options).awaitTermination()
    return out


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA + ", last_seen_date date")


def test_a_posting_that_is_seen_again_stays_one_row(spark, tmp_path, nothing):
    """Day 120 is out of the window of day 0, not of day 60; each time the url is another."""
    days = [("2026-01-01", [posting(1, "Data Engineer", url="u1")]), ("2026-03-02", [posting(2, "DATA engineer", "Acme Ltd", "u2")]), ("2026-05-01", [posting(3, "data engineer", url="u3")])]
    out = ingest_days(spark, tmp_path, nothing, days, buckets=4)
    assert {(r.batch, r.outcome, r.n) for r in spark.read.parquet(f"{out}/outcomes").collect()} == {(0, "new", 1), (1, "dup_store", 1), (2, "dup_store", 1)}
    (row,) = streams.ingested_store(nothing, out).collect()
    assert (row.job_id, str(row.last_seen_date)) == (1, "2026-05-01")


def test_a_posting_that_was_not_seen_is_new_again(spark, tmp_path, nothing):
    days = [("2026-01-01", [posting(1, "Data Engineer", url="u1")]), ("2026-05-01", [posting(3, "data engineer", url="u3")]), ("2026-05-02", [posting(4, "data engineer", url="u1")])]
    out = ingest_days(spark, tmp_path, nothing, days)
    assert {(r.batch, r.outcome) for r in spark.read.parquet(f"{out}/outcomes").collect()} == {(0, "new"), (1, "new"), (2, "dup_store")}
    touched = {(r.batch, r.job_id_hash) for r in spark.read.parquet(f"{out}/touched").collect()}
    assert touched == {(2, spark.range(1).select(text.job_hash(F.lit("data engineer"), F.lit("Acme"), F.lit("u3"))).first()[0])}


@pytest.mark.parametrize("fold_every,small", [(2, True), (20, False)])
def test_a_stream_over_days_is_one_batch_after_the_other(spark, tmp_path, monkeypatch, fold_every, small):
    if not small:
        from jobgrain.operators import similar

        monkeypatch.setattr(similar, "ASKING_ROWS", 0)
        monkeypatch.setattr(similar, "CELL", 4)
        monkeypatch.setattr(similar, "PART", 2)
    rng = random.Random(fold_every)
    words = "data engineer ml ops lead junior remote platform cloud".split()
    number = iter(range(1, 10**6))

    def rows(n):
        return [posting(next(number), " ".join(rng.choices(words, k=rng.randrange(0, 4))), rng.choice(["Acme Ltd", "acme", "Unknown", "Data Cloud Works", None]), rng.choice([None, f"u{rng.randrange(30)}"]), rng.choice([BODY, BODY, "short"])) for _ in range(n)]

    first = spark.createDataFrame([(*r, "2025-12-20") for r in rows(25)], SCHEMA + ", day string").withColumn("last_seen_date", F.to_date("day")).drop("day")
    days = [(d, rows(30)) for d in ("2026-01-01", "2026-02-10", "2026-05-20")]
    out = ingest_days(spark, tmp_path, first, days, buckets=3, fold_every=fold_every)
    kept = first.withColumn("job_id_hash", text.job_hash(F.col("title"), F.col("company"), F.col("url")))
    got = {(r.batch, r.outcome): r.n for r in spark.read.parquet(f"{out}/outcomes").collect()}
    for k, (day, new) in enumerate(days):
        c = ingest.classify_ingest(spark.createDataFrame(new, SCHEMA), kept.drop("job_id_hash"), KW, as_of=day)
        told = c.select("job_id", "job_id_hash", "outcome", "matched_hash").collect()
        assert {o: n for (b, o), n in got.items() if b == k} == {o: sum(r.outcome == o for r in told) for o in {r.outcome for r in told}}
        taken = {r.job_id for r in told if r.outcome == "new"}
        touched = {r.matched_hash for r in told if r.outcome in ("dup_store", "dup_hash")}
        assert {r.job_id for r in spark.read.parquet(f"{out}/accepted/batch={k}").collect()} == taken
        hashes = spark.createDataFrame([(h,) for h in touched], "job_id_hash string")
        schema = kept.schema
        kept = kept.unionByName(c.where("outcome = 'new'").select(*SCHEMA.replace(" long", "").replace(" string", "").split(", "), F.to_date(F.lit(day)).alias("last_seen_date"), "job_id_hash"))
        kept = store.touch_last_seen(kept.withColumn("is_active", F.lit(True)), hashes, day).drop("is_active")
        kept = spark.createDataFrame(kept.collect(), schema)
    state = streams.ingested_store(first, out)
    assert sorted((r.job_id, str(r.last_seen_date)) for r in state.collect()) == sorted((r.job_id, str(r.last_seen_date)) for r in kept.collect())


def test_a_batch_reads_its_own_buckets_and_runs_again(spark, tmp_path, nothing):
    first = spark.createDataFrame([(*posting(i, f"engineer of {i}", f"firm {i}", f"u{i}"), "2026-01-01") for i in range(400)], SCHEMA + ", day string").withColumn("last_seen_date", F.to_date("day"))
    index = StoreIndex(spark, str(tmp_path / "index"), buckets=32)
    index.build(first)
    index.build(nothing)  # there is one already
    for name in ("words", "urls", "stored"):
        assert opened(index._read(name, FIRST, 0)) >= 30 and opened(index._read(name, FIRST, 0, [3, 5])) == 2
    batch = spark.createDataFrame([posting(1000, "engineer of 7", "Firm 7 Ltd", "x")], SCHEMA)
    read = []
    plain = index._read
    index._read = lambda name, base, before, buckets=None: read.append((name, buckets)) or plain(name, base, before, buckets)
    got = ingest.classify_indexed(batch, index, 0, KW, as_of="2026-02-01").first()
    want = first.where("job_id = 7").select(text.job_hash(F.col("title"), F.col("company"), F.col("url"))).first()[0]
    assert (got.outcome, got.matched_hash) == ("dup_store", want)
    assert {n for n, _ in read} == {"words", "urls", "stored", "seen"} and all(b is not None and len(b) <= 4 for _, b in read)
    index._read = plain
    day = lambda b: {r.day.isoformat() for r in index.states(b).where(f"job_id_hash = '{want}'").collect()}
    touched = spark.createDataFrame([(want,)], "job_id_hash string")
    none = batch.where("false").withColumn("job_id_hash", F.lit(""))
    for _ in range(2):  # a batch that runs again
        index.add(0, none, touched, "2026-02-01")
    assert day(0) == {"2026-01-01"} and day(1) == {"2026-02-01"}
    index.fold(0)
    index.add(1, none, touched, "2026-03-01")
    assert day(0) == {"2026-01-01"} and day(1) == {"2026-02-01"} and day(2) == {"2026-03-01"}
    assert index.states(2).count() == 400


def test_a_store_and_a_batch_are_read_once(spark, tmp_path):
    """However often their columns are used: each row counts itself when it is made."""
    made = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            made.add(batch.num_rows)
            yield batch

    store = spark.createDataFrame([(*posting(i, f"engineer of {i}", f"firm {i}", f"u{i}"), "2026-01-01") for i in range(30)], SCHEMA + ", last_seen_date string")
    index = StoreIndex(spark, str(tmp_path / "index"), buckets=2)
    index.build(store.mapInArrow(count, store.schema))
    assert made.value == 30
    given = [posting(100 + i, f"engineer of {i}", f"firm {i}", f"v{i}", "short" if i % 3 else BODY) for i in range(20, 45)]
    batch = spark.createDataFrame(given, SCHEMA).withColumn("row", F.lit(5))
    got = ingest.classify_indexed(batch.mapInArrow(count, batch.schema), index, 0, KW, as_of="2026-02-01")
    rows = got.collect()
    assert made.value == 55 and got.columns[: len(batch.columns)] == batch.columns
    want = ingest.classify_ingest(batch, store, KW, as_of="2026-02-01").select(got.columns)
    assert sorted(map(str, rows)) == sorted(map(str, want.collect()))
    index.release()
