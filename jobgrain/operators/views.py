"""Views of jobs and scores: joins, semi and anti joins, date ranges and top rows.

None of them sorts a whole table unless it is asked for the top rows; sort with by_score() at the sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobgrain.operators.scoring import parse_score_json

#: Cities that count as Australian places.
CITIES = ("perth", "melbourne", "sydney", "brisbane", "adelaide", "canberra")


def by_score(df: DataFrame) -> DataFrame:
    """Best scores first, then the newest, then by job_id."""
    return df.orderBy(F.col("score").desc_nulls_last(), F.col("first_seen_date").desc_nulls_last(), "job_id")


def newest_first(df: DataFrame, *columns: str) -> DataFrame:
    """Ordered by dates, the latest first, then by job_id: ('applied_date', 'first_seen_date') for applied jobs,
    ('rejected_date', 'first_seen_date') for rejected ones, ('first_seen_date',) for unscored ones."""
    return df.orderBy(*(F.col(c).desc_nulls_last() for c in columns), "job_id")


def soonest_first(interviews: DataFrame) -> DataFrame:
    """Upcoming interviews in the order in which they come."""
    return interviews.orderBy(F.col("interview_date").asc_nulls_last(), "job_id")


def latest_scores(scores: DataFrame) -> DataFrame:
    """One score a job, the last one scored."""
    rest = [c for c in scores.columns if c != "job_id"]
    return scores.groupBy("job_id").agg(F.max_by(F.struct(*rest), F.struct("scored_at", "score_id")).alias("s")).select("job_id", "s.*")


def unscored(jobs: DataFrame, scores: DataFrame) -> DataFrame:
    return jobs.join(scores.select("job_id"), "job_id", "left_anti")


def rescore_candidates(jobs: DataFrame, scores: DataFrame, low: int, high: int, age_days: int, profile_hash: str, as_of) -> DataFrame:
    """Recent jobs whose score lies in [low, high] and was made for another profile; a null hash is no other profile."""
    near = scores.where(F.col("score").between(low, high) & (F.col("profile_hash") != profile_hash)).select("job_id", F.col("score").alias("old_score"))
    return jobs.where(F.col("first_seen_date") >= F.date_sub(F.lit(as_of).cast("date"), age_days)).join(near, "job_id")


def unnotified_matches(jobs: DataFrame, scores: DataFrame, notifications: DataFrame, threshold: int) -> DataFrame:
    return jobs.join(scores.where(F.col("score") >= threshold).select("job_id", "score"), "job_id").join(notifications.select("job_id"), "job_id", "left_anti")


def jobs_in_range(jobs: DataFrame, scores: DataFrame, as_of, days: int, hide_old_days: int) -> DataFrame:
    """Scored jobs first seen within both spans."""
    return jobs.where(F.col("first_seen_date") >= F.date_sub(F.lit(as_of).cast("date"), min(days, hide_old_days))).join(scores, "job_id")


def all_jobs(jobs: DataFrame, scores: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Scored jobs, the active ones by default."""
    return (jobs if include_inactive else jobs.where("is_active")).join(scores, "job_id")


def applied_jobs(jobs: DataFrame, scores: DataFrame, latest_only: bool = False) -> DataFrame:
    """Applied jobs that were not rejected with each of their scores, or with latest_only their last one."""
    return jobs.where("applied AND NOT rejected").join(latest_scores(scores) if latest_only else scores, "job_id", "left")


def rejected_jobs(jobs: DataFrame, scores: DataFrame, rejections: DataFrame, latest_only: bool = False) -> DataFrame:
    """Rejected jobs, one row for each of their scores (with latest_only: their last one) and rejections."""
    return jobs.where("rejected").join(latest_scores(scores) if latest_only else scores, "job_id", "left").join(rejections, "job_id", "left")


def jobs_by_status(jobs: DataFrame, scores: DataFrame, status: str, latest_only: bool = False) -> DataFrame:
    return jobs.where("is_active").where(F.col("status") == status).join(latest_scores(scores) if latest_only else scores, "job_id", "left")


def matches_above(jobs: DataFrame, scores: DataFrame, threshold: int, limit: int | None = None) -> DataFrame:
    """title, company, score of jobs at or above threshold; with a limit, the best ones."""
    found = jobs.select("job_id", "title", "company", "first_seen_date").join(scores.where(F.col("score") >= threshold).select("job_id", "score"), "job_id")
    return (found if limit is None else by_score(found).limit(limit)).select("job_id", "title", "company", "score")


def upcoming_interviews(interviews: DataFrame, jobs: DataFrame, as_of, days: int = 30) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return interviews.where(F.col("interview_date").between(day, F.date_add(day, days))).join(jobs.where("is_active").select("job_id", "title", "company"), "job_id")


def job_timeline(job_ids: DataFrame, status_history: DataFrame, interviews: DataFrame) -> DataFrame:
    """job_id, kind, happened, detail, nth: what happened to the given jobs, each kind from the newest to the oldest."""
    asked = job_ids.select("job_id").distinct()
    of = lambda df, kind, at, detail: df.join(asked, "job_id", "left_semi").select("job_id", F.lit(kind).alias("kind"), F.col(at).cast("timestamp").alias("happened"), F.col(detail).alias("detail"), "id")
    rows = of(status_history, "status", "changed_at", "new_status").unionByName(of(interviews, "interview", "interview_date", "interview_type"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("job_id", "kind").orderBy(F.desc("happened"), F.desc("id")))).drop("id")


def job_detail(job_ids: DataFrame, jobs: DataFrame, scores: DataFrame) -> DataFrame:
    """The given jobs with their latest score."""
    asked = job_ids.select("job_id").distinct()
    return jobs.join(asked, "job_id", "left_semi").join(latest_scores(scores.join(asked, "job_id", "left_semi")), "job_id", "left")


def job_components(job_ids: DataFrame, scores: DataFrame) -> DataFrame:
    """job_id and what the latest score of each given job is made of: components, hireability_factors, risk_profile and
    score_breakdown, read from their JSON. Jobs without a score have no row."""
    asked = job_ids.select("job_id").distinct()
    return parse_score_json(latest_scores(scores.join(asked, "job_id", "left_semi"))).select("job_id", "components", "hireability_factors", "risk_profile", "score_breakdown")


def location_matches(location: Column, mode: str) -> Column:
    """Whether a place belongs to a view; a null place belongs to none."""
    low = F.lower(location)
    has = lambda *words: F.coalesce(*(F.when(low.contains(w), F.lit(True)) for w in words), F.lit(False))
    tests = {"perth": has("perth"), "australia": has("australia", *CITIES) & has("remote", "hybrid"), "world": has("remote")}
    return tests[mode]


def region_matches(region: Column, wanted: str) -> Column:
    return F.coalesce(region, F.lit("australia")) == wanted


def open_matches(df: DataFrame, threshold: int) -> DataFrame:
    return df.where((F.col("score") >= threshold) & ~F.col("applied") & ~F.col("rejected"))


def sample_unscored(jobs: DataFrame, scores: DataFrame, n: int, seed: int) -> DataFrame:
    """n unscored jobs, drawn by a hash of their id, so that reruns draw the same."""
    return unscored(jobs, scores).orderBy(F.xxhash64(F.lit(seed), "job_id"), "job_id").limit(n)
