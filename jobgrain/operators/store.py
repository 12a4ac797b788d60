"""The posting store: a snapshot goes in, a snapshot comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.functions.names import spare


def new_rows(store: DataFrame, batch: DataFrame, as_of) -> DataFrame:
    """The rows of batch whose job_id_hash the store lacks, one a hash (the first by seq), with the store's columns, seen first and last
    on as_of. The first row of a hash is a minimum, so equal ones meet early."""
    rows = batch.select(F.struct("*").alias("row"), "seq", "job_id_hash")
    first = rows.groupBy("job_id_hash").agg(F.min_by("row", F.col("seq")).alias("row"))
    fresh = first.join(store.select("job_id_hash"), "job_id_hash", "left_anti").select("row.*")
    day = F.lit(as_of).cast("date")
    fresh = fresh.withColumns({"first_seen_date": day, "last_seen_date": day, "is_active": F.lit(True), "applied": F.lit(False), "rejected": F.lit(False), "status": F.lit("new")})
    return fresh.select(*(F.col(c) if c in fresh.columns else F.lit(None).cast(store.schema[c].dataType).alias(c) for c in store.columns))


def insert_new(store: DataFrame, batch: DataFrame, as_of) -> DataFrame:
    """store with the rows of batch that are new to it, see new_rows."""
    return store.unionByName(new_rows(store, batch, as_of))


def touch_last_seen(store: DataFrame, hashes: DataFrame, as_of) -> DataFrame:
    """Rows whose hash is in hashes were seen on as_of and are active."""
    (met,) = spare(store, "met")
    rows = store.join(hashes.select(F.col("job_id_hash").alias(met)).distinct(), F.col("job_id_hash") == F.col(met), "left")
    hit = F.col(met).isNotNull()
    return rows.withColumns({"last_seen_date": F.when(hit, F.lit(as_of).cast("date")).otherwise(F.col("last_seen_date")), "is_active": hit | F.col("is_active")}).select(*store.columns)


def mark_inactive(store: DataFrame, seen: DataFrame, searches: DataFrame, require_nonempty: bool = False) -> DataFrame:
    """Rows of every enabled search whose hash was not seen under that same search become inactive.

    A search in which nothing was seen loses all its rows, as a failed crawl would; require_nonempty spares such searches.
    """
    under, met, crawled = spare(store, "under", "met", "crawled")
    found = seen.select(F.col("source_search_id").alias(under), F.col("job_id_hash").alias(met)).distinct()
    on = searches.where("enabled").select(F.col("id").alias(crawled)).distinct()
    if require_nonempty:
        on = on.join(found, F.col(crawled) == F.col(under), "left_semi")
    rows = store.join(on, F.col("source_search_id") == F.col(crawled), "left")
    rows = rows.join(found, (F.col("source_search_id") == F.col(under)) & (F.col("job_id_hash") == F.col(met)), "left")
    gone = F.col(crawled).isNotNull() & F.col(met).isNull()
    return rows.withColumn("is_active", F.when(gone, F.lit(False)).otherwise(F.col("is_active"))).select(*store.columns)


def apply_retention(jobs: DataFrame, children: dict[str, DataFrame], as_of, days: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Jobs first seen within the last `days`, and the children of these jobs alone."""
    kept = jobs.where(F.col("first_seen_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return kept, {name: t.join(kept.select("job_id"), "job_id", "left_semi") for name, t in children.items()}


#: Columns that an update may set.
SETTABLE = ("applied", "applied_date", "rejected", "rejected_date", "status", "remarks", "priority", "interview_date", "interview_type")


def apply_updates(store: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates applied one after the other (by updated_at, then update_id): each column of a job takes the last value that
    any of its updates gives; nulls leave a column as it is. See rejection_rows for what a reject adds beside it."""
    columns = [c for c in SETTABLE if c in updates.columns and c in store.columns]
    if not columns:
        return store
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("updated_at", "update_id")))
    updated, to = spare(store, "updated", "to")
    latest = updates.groupBy(F.col("job_id").alias(updated)).agg(F.struct(*(last(c).alias(c) for c in columns)).alias(to))
    rows = store.join(latest, F.col("job_id") == F.col(updated), "left")
    return rows.withColumns({c: F.coalesce(F.col(f"{to}.{c}"), F.col(c)) for c in columns}).select(*store.columns)


def rejection_rows(updates: DataFrame, store: DataFrame) -> DataFrame:
    """job_id, rejection_category, rejection_notes, rejected_at: one row for each update that rejects a stored job."""
    given = lambda c, default: F.coalesce(c, F.lit(default)) if c in updates.columns else F.lit(default)
    said = updates.where("rejected").select("job_id", given("rejection_category", "other").alias("rejection_category"), given("rejection_notes", "").alias("rejection_notes"), F.col("updated_at").alias("rejected_at"))
    return said.join(store.select("job_id"), "job_id", "left_semi")


def fold_notes(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """job_id, notes: existing notes, then each logged note as '[date] text' on a line of its own, in time order."""
    line = F.struct("ts", "note_id", F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd"), F.lit("] "), F.coalesce("note", F.lit(""))).alias("line"))
    added = log.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("added"))
    return jobs.select("job_id", "notes").join(added, "job_id", "left").select("job_id", F.concat_ws("\n", F.expr("nullif(notes, '')"), "added").alias("notes"))
