"""Duplicates within a batch and against the store, and the classification of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.functions.names import spare
from jobgrain.functions.scratch import materialize
from jobgrain.functions.text import job_hash, normalize_company, strip
from jobgrain.operators import similar
from jobgrain.operators.filters import Keywords, quality_filter
from jobgrain.operators.index import StoreIndex


def _look_back(existing: DataFrame, window_days: int | None, as_of) -> DataFrame:
    """Existing rows seen within the last window_days; all of them without a window."""
    return existing if window_days is None else existing.where(F.col("last_seen_date") >= F.date_sub(F.lit(as_of).cast("date"), window_days))


def dedup_in_batch(df: DataFrame, passes: str = "passes") -> DataFrame:
    """Adds dup_cross: an earlier row (by seq) of the batch with the same title and company was accepted, that is, passes.

    One partial minimum a key and a join, rather than a window, so a key that very many rows share still combines early.
    """
    t, c, first = spare(df, "t", "c", "first")
    rows = df.withColumns({t: F.lower(strip(F.coalesce("title", F.lit("")))), c: normalize_company(F.col("company"))})
    firsts = rows.where(F.col(passes)).groupBy(t, c).agg(F.min("seq").alias(first))
    rows = rows.join(firsts, [t, c], "left").select(*df.columns, first)
    return rows.withColumn("dup_cross", F.coalesce(F.col("seq") > F.col(first), F.lit(False))).drop(first)


def match_existing_url(new: DataFrame, existing: DataFrame, window_days: int | None = None, as_of=None) -> DataFrame:
    """Rows of new whose url is stored already (and seen within the window)."""
    return new.join(_look_back(existing, window_days, as_of).select("url").where("url IS NOT NULL"), "url", "left_semi")


def match_existing_hash(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of new whose job_id_hash is stored already."""
    return new.join(existing.select("job_id_hash"), "job_id_hash", "left_semi")


def match_existing_fuzzy(new: DataFrame, existing: DataFrame, basis_points: int = 8500, window_days: int | None = 90, as_of=None) -> DataFrame:
    """Pairs of new and existing rows whose lower-cased titles and normalised companies both match (see fuzzy_match): new_key,
    existing_key, existing_source, similarity (of titles, as a fraction; 1.0 for equal cleaned titles). Both sides need job_id, title, company, source.

    New rows with equal keys are one class. Where the classes are few, as in a daily batch, they go to every task, so the
    store is read and never shuffled; more of them meet the store's classes by their keys (see similar.matches).
    """

    def prepared(df: DataFrame) -> DataFrame:
        return df.select(F.col("job_id").alias("key"), "source", *similar.clean_texts(F.col("title"), F.col("company")))

    fresh, stored = prepared(new), prepared(_look_back(existing, window_days, as_of))
    asking = materialize(fresh.select("t", "c").distinct(), "classes")
    small = similar.is_small(asking)
    order = similar.WordOrder.of(asking)
    probes = similar.probes(similar.entries(asking, order, basis_points), basis_points)
    theirs = [F.col("key").alias("existing_key"), F.col("source").alias("existing_source")]
    if small:
        pairs = similar.matches(probes, similar.entries(stored, order, basis_points), basis_points, True)
        found = pairs.select("q_t", "q_c", *theirs, "similarity")
    else:
        classes = materialize(similar.entries(stored.select("t", "c").distinct(), order, basis_points), "entries")
        pairs = similar.matches(materialize(probes, "probes"), classes, basis_points, False).select("q_t", "q_c", "t", "c", "similarity")
        found = pairs.join(stored, ["t", "c"]).select("q_t", "q_c", *theirs, "similarity")
    return fresh.select(F.col("key").alias("new_key"), F.col("t").alias("q_t"), F.col("c").alias("q_c")).join(found, ["q_t", "q_c"]).drop("q_t", "q_c")


def best_match(pairs: DataFrame) -> DataFrame:
    """One row a new row: the most similar existing one, the smallest key among equals."""
    best = F.max_by(F.struct("existing_key", "existing_source", "similarity"), F.struct("similarity", (-F.col("existing_key")).alias("k")))
    return pairs.groupBy("new_key").agg(best.alias("m")).select("new_key", "m.*")


def classify_ingest(batch: DataFrame, existing: DataFrame, kw: Keywords, basis_points: int = 8500, window_days: int | None = 90, as_of=None) -> DataFrame:
    """Adds to each row of a batch (seq, job_id, title, company, url, description, source) its outcome, what happens to it
    first, and matched_hash, the job_id_hash of the stored row that it repeats, if any.

    dup_cross: an earlier row of the batch with its title and company was taken; dup_store: the store has its url or a
    fuzzy match; low_quality: its description is not good enough; dup_hash: the store has its hash; new: none of these.
    Whether a row passes all but the first test depends on no other row of the batch, so these flags come first and one
    minimum a key settles the rest.
    """
    rows = _judged(batch, kw)
    stored = existing.withColumn("job_id_hash", job_hash(F.col("title"), F.col("company"), F.col("url")))
    seen = _look_back(stored, window_days, as_of)
    by_url = seen.where("url IS NOT NULL").groupBy("url").agg(F.min("job_id_hash").alias("by_url"))
    fuzzy = best_match(match_existing_fuzzy(batch, existing, basis_points, window_days, as_of)).select(F.col("new_key").alias("job_id"), "existing_key")
    by_fuzzy = fuzzy.join(stored.groupBy(F.col("job_id").alias("existing_key")).agg(F.min("job_id_hash").alias("by_fuzzy")), "existing_key").drop("existing_key")
    return settle(rows, by_url, by_fuzzy, stored.select("job_id_hash").distinct())


def classify_indexed(batch: DataFrame, index: StoreIndex, number: int, kw: Keywords, window_days: int | None = 90, as_of=None) -> DataFrame:
    """classify_ingest() against a kept index of the store, as the batches before `number` have left it. Work follows the batch: of
    the store, the buckets of the batch's keys are read.

    The batch is read and judged once, and settled without its descriptions, which join the outcomes in one step. The result
    can be read until index.release().
    """
    judged = _judged(batch, kw)
    (row,) = spare(judged, "row")
    rows = index.keep(judged.withColumn(row, F.monotonically_increasing_id()), "judged")
    slim = rows.select(row, "seq", "job_id", "title", "company", "url", "job_id_hash", "tier3_pass")
    settled = settle(slim, *index.look_up(slim, number, window_days, as_of))
    settled = index.keep(settled.select(row, *(c for c in settled.columns if c not in slim.columns)), "settled")
    return rows.join(settled, row).drop(row)


def _judged(batch: DataFrame, kw: Keywords) -> DataFrame:
    return quality_filter(batch.withColumn("job_id_hash", job_hash(F.col("title"), F.col("company"), F.col("url"))), kw)


def settle(rows: DataFrame, by_url: DataFrame, by_fuzzy: DataFrame, hashes: DataFrame) -> DataFrame:
    """Outcomes of a batch's rows (with job_id_hash and tier3_pass), from what the store has: by_url (url, by_url), by_fuzzy (job_id,
    by_fuzzy), each with the job_id_hash that matches, one row a url or job at most, and hashes (job_id_hash)."""
    by = spare(rows, "by_url", "by_fuzzy", "by_hash", "passes")
    named = [df.withColumnRenamed(old, new) for df, old, new in zip((by_url, by_fuzzy, hashes.withColumn("by_hash", F.col("job_id_hash"))), ("by_url", "by_fuzzy", "by_hash"), by, strict=False)]
    columns = rows.columns
    rows = rows.join(named[0], "url", "left").join(named[1], "job_id", "left").join(named[2], "job_id_hash", "left")
    met = F.coalesce(*by[:2])
    rows = rows.select(*columns, met.isNotNull().alias("dup_store"), F.col(by[2]).isNotNull().alias("dup_hash"), F.coalesce(met, by[2]).alias("matched_hash"))
    rows = dedup_in_batch(rows.withColumn(by[3], ~F.col("dup_store") & F.col("tier3_pass") & ~F.col("dup_hash")), by[3]).drop(by[3])
    outcome = F.when(F.col("dup_cross"), "dup_cross").when(F.col("dup_store"), "dup_store").when(~F.col("tier3_pass"), "low_quality").when(F.col("dup_hash"), "dup_hash").otherwise("new")
    return rows.withColumn("outcome", outcome)


def ingest_accounting(classified: DataFrame) -> DataFrame:
    """One row: rows in total, by outcome, whether they add up, and the percentage that needed no scoring."""
    names = ("new", "dup_cross", "dup_store", "low_quality", "dup_hash")
    sums = classified.agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == n).alias(f"n_{n}") for n in names))
    saved = F.col("n_dup_cross") + F.col("n_dup_store") + F.col("n_low_quality")
    return sums.withColumns({"adds_up": sum((F.col(f"n_{n}") for n in names), F.lit(0)) == F.col("total"), "savings_percent": F.round(F.coalesce(F.try_divide(saved * 100.0, F.col("total")), F.lit(0.0)), 1)})
