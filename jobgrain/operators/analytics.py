"""Counts, bands, buckets and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses in the order of the board, with labels.
BOARD = (
    ("new", "New"), ("interested", "Interested"), ("applied", "Applied"), ("phone_screen", "Phone Screen"), ("interview_scheduled", "Interview Scheduled"), ("interviewed", "Interviewed"), ("offer_received", "Offer Received"),
    ("accepted", "Accepted"), ("declined_offer", "Declined Offer"), ("rejected", "Rejected"), ("withdrawn", "Withdrawn"), ("on_hold", "On Hold"), ("archived", "Archived"))
#: Bands of scores as (label, least, most).
BANDS = (("90+", 90, None), ("80-89", 80, 89), ("75-79", 75, 79), ("below 75", None, 74))
FIFTHS = (("0-30", 0, 30), ("31-50", 31, 50), ("51-70", 51, 70), ("71-85", 71, 85), ("86-100", 86, 100))


def one_decimal(value: Column) -> Column:
    return F.round(F.coalesce(value, F.lit(0.0)), 1)


def headline_counts(jobs: DataFrame, scores: DataFrame, threshold: int) -> DataFrame:
    """One row: jobs, score rows at or above threshold, newest created_at (or 'Never'), mean score."""
    newest = F.coalesce(F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss"), F.lit("Never"))
    return jobs.agg(F.count("*").alias("n_jobs"), newest.alias("last_created")).crossJoin(  # one row each
        scores.agg(F.count_if(F.col("score") >= threshold).alias("n_matches"), one_decimal(F.avg("score")).alias("avg_score")))


def top_companies(jobs: DataFrame, n: int = 10) -> DataFrame:
    return jobs.where("company IS NOT NULL").groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(n)


def band_of(score: Column, bands=BANDS) -> Column:
    out = F.lit(None).cast("string")
    for label, low, high in reversed(bands):
        inside = (F.lit(True) if low is None else score >= low) & (F.lit(True) if high is None else score < high + 1)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def score_distribution(scores: DataFrame, bands=BANDS, by: str | None = None) -> DataFrame:
    """[by,] band, n, percent of the total (of by). Scores outside all bands are left out."""
    keys = [by] if by else []
    counts = scores.withColumn("band", band_of(F.col("score"), bands)).where("band IS NOT NULL").groupBy(*keys, "band").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*keys)), 1))


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows by a column, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def rejection_stats(rejections: DataFrame) -> DataFrame:
    return count_by(rejections, "rejection_category")


def status_stats(jobs: DataFrame) -> DataFrame:
    return count_by(jobs.where("is_active"), "status")


def status_board(df: DataFrame) -> DataFrame:
    """position, status, label, n of each section of the board; a null status is new, an unknown one is on no board."""
    board = df.sparkSession.createDataFrame([(i, s, label) for i, (s, label) in enumerate(BOARD)], "position int, status string, label string")
    return df.groupBy(F.coalesce("status", F.lit("new")).alias("status")).agg(F.count("*").alias("n")).join(F.broadcast(board), "status").select("position", "status", "label", "n")  # 13 rows


def date_bucket(day: Column, as_of) -> Column:
    """Age of a day as a label."""
    age = F.datediff(F.lit(as_of).cast("date"), day)
    return (F.when(age == 0, "Today").when(age == 1, "Yesterday").when(age <= 7, F.concat(age.cast("string"), F.lit(" days ago"))).when(age <= 30, F.date_format(day, "MMM dd, yyyy")).otherwise(F.date_format(day, "MMM yyyy")))


def score_class(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0))
    return F.when(s >= 90, "excellent").when(s >= 80, "good").when(s >= 75, "fair").otherwise("low")


def date_buckets(df: DataFrame, as_of, day: str = "first_seen_date") -> DataFrame:
    """bucket, score_class, n. A null score counts as 0."""
    return df.groupBy(date_bucket(F.col(day), as_of).alias("bucket"), score_class(F.col("score")).alias("score_class")).agg(F.count("*").alias("n"))


def view_stats(df: DataFrame) -> DataFrame:
    """One row: total, apply_count, mean score with nulls as 0."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("recommendation") == "APPLY").alias("apply_count"), one_decimal(F.avg(F.coalesce("score", F.lit(0)))).alias("avg_score"))


def score_badge(score: Column) -> Column:
    return F.when(score >= 90, "top").when(score >= 80, "strong").when(score >= 70, "good").otherwise("other")


def counts_by(df: DataFrame, dimension: str, as_of=None, days: int | None = None) -> DataFrame:
    """Jobs by a dimension, if asked only those seen in the last days."""
    rows = df if days is None else df.where(F.col("last_seen_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return rows.groupBy(dimension).agg(F.count("*").alias("n"))


def distinct_counts(jobs: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: distinct companies and distinct models used."""
    return jobs.agg(F.count_distinct("company").alias("n_companies")).crossJoin(scores.agg(F.count_distinct("model_used").alias("n_models")))  # one row each


def description_stats(jobs: DataFrame, by: str = "source") -> DataFrame:
    n = F.length(F.coalesce("description", F.lit("")))
    return jobs.groupBy(by).agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.floor(F.avg(n)).alias("mean"))


def recent_runs(runs: DataFrame, as_of, platform: str | None = None, days: int = 7, limit: int = 100) -> DataFrame:
    """The newest runs of the last days."""
    at = F.lit(as_of).cast("timestamp")
    rows = runs.where(F.col("run_timestamp") >= at - F.make_interval(days=F.lit(days)))
    return (rows if platform is None else rows.where(F.col("platform") == platform)).orderBy(F.desc("run_timestamp"), "run_id").limit(limit)


def run_row(stats: DataFrame) -> DataFrame:
    """Adds jobs_collected and efficiency_percent where they are not given: cards cut in percent of cards seen, 0 without cards."""
    cut = F.col("tier1_filtered") + F.col("tier2_skipped") + F.col("tier3_filtered")
    given = lambda c: F.col(c) if c in stats.columns else F.lit(None)
    return stats.withColumns({"jobs_collected": F.coalesce(given("jobs_collected"), F.col("total_cards_seen") - cut), "efficiency_percent": F.coalesce(given("efficiency_percent"), F.try_divide(cut * 100.0, F.col("total_cards_seen")), F.lit(0.0))})


_SUMS = {"pages": "pages_scraped", "cards": "total_cards_seen", "tier1": "tier1_filtered", "tier2": "tier2_skipped", "tier3": "tier3_filtered", "jobs": "jobs_collected"}


def _run_sums() -> list[Column]:
    return [F.count("*").alias("runs"), *(F.sum(c).alias(n) for n, c in _SUMS.items()), F.round(F.avg("efficiency_percent"), 6).alias("avg_efficiency"), F.round(F.sum("duration_seconds"), 4).alias("duration")]


def daily_summary(runs: DataFrame, date) -> DataFrame:
    """One row a platform for one day."""
    return runs.where(F.to_date("run_timestamp") == F.lit(date).cast("date")).groupBy("platform").agg(*_run_sums())


def daily_rollup(runs: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Per day the platforms' rows, and one of platform 'ALL' for all together."""
    rows = runs.where(F.to_date("run_timestamp") >= F.date_sub(F.lit(as_of).cast("date"), days)).withColumn("day", F.to_date("run_timestamp"))
    sums = rows.rollup("day", "platform").agg(F.grouping_id().alias("level"), *_run_sums()).where("level < 2")
    return sums.withColumn("platform", F.when(F.col("level") == 1, "ALL").otherwise(F.col("platform"))).drop("level")


def page_efficiency(runs: DataFrame) -> DataFrame:
    """Per page of page_details (JSON [{page, cards, jobs}]): page, cards, jobs, percent cut, the percentage over all pages, and
    its rank by percent cut. Malformed details count as none."""
    pages = runs.select(F.explode(F.from_json("page_details", "array<struct<page:int,cards:int,jobs:int>>")).alias("p")).groupBy("p.page").agg(F.sum("p.cards").alias("cards"), F.sum("p.jobs").alias("jobs"))
    cut = F.round(F.coalesce(F.try_divide((F.col("cards") - F.col("jobs")) * 100.0, F.col("cards")), F.lit(0.0)), 1)
    whole = Window.partitionBy()  # one row a page number
    overall = F.round(F.coalesce(F.try_divide((F.sum("cards").over(whole) - F.sum("jobs").over(whole)) * 100.0, F.sum("cards").over(whole)), F.lit(0.0)), 1)
    return pages.withColumns({"percent": cut, "overall_percent": overall}).withColumn("place", F.rank().over(Window.orderBy(F.desc("percent"))))


def component_stats(scored: DataFrame, session: str | None = None) -> DataFrame:
    """Per category of components: count, mean weight, score and contribution, and shares of match statuses."""
    rows = scored if session is None else scored.where(F.col("session_id") == session)
    c = rows.select(F.explode("components").alias("c")).select("c.*")
    worth = F.when(F.col("match_status") == "yes", 1.0).when(F.col("match_status") == "partial", 0.5).otherwise(0.0)
    share = lambda s: F.round(F.avg((F.col("match_status") == s).cast("double")), 6).alias(f"rate_{s}")
    return c.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("avg_weight"), F.round(F.avg(worth * 100), 6).alias("avg_score"), F.round(F.avg(F.col("weight") * worth), 6).alias("avg_contribution"), share("yes"), share("partial"), share("no"))


def session_stats(scored: DataFrame) -> DataFrame:
    """Per session: rows, failed (no score), gate failures, mean score over the rest, mean latency, recommendations."""
    gated, ok = F.col("hard_gate_failed").isNotNull(), F.col("score").isNotNull()
    total = F.sum(F.when(ok & ~gated, F.col("score")))
    return scored.groupBy("session_id").agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("failed"), F.count_if(gated).alias("gate_failures"), F.round(F.coalesce(total, F.lit(0)) / F.greatest(F.lit(1), F.count_if(ok & ~gated)), 6).alias("avg_score"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
        *(F.count_if(F.col("recommendation") == r).alias(f"n_{r.lower()}") for r in ("APPLY", "CLARIFY", "SKIP")))


def compare_scorings(a: DataFrame, b: DataFrame) -> DataFrame:
    """job_id, score_a, score_b, delta for all jobs that either has."""
    x, y = (df.select("job_id", F.col("score").alias(f"score_{n}"), F.col("recommendation").alias(f"rec_{n}")) for df, n in ((a, "a"), (b, "b")))
    return x.join(y, "job_id", "full_outer").withColumn("delta", F.col("score_b") - F.col("score_a"))


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row: mean scores and shares of APPLY and SKIP in percent, for both."""
    rate = lambda n, r: F.round(F.coalesce(F.try_divide(F.count_if(F.col(f"rec_{n}") == r) * 100.0, F.count(f"rec_{n}")), F.lit(0.0)), 1).alias(f"{r.lower()}_{n}")
    return compared.agg(F.count("*").alias("n"), *(F.round(F.avg(f"score_{n}"), 6).alias(f"avg_{n}") for n in "ab"), *(rate(n, r) for n in "ab" for r in ("APPLY", "SKIP")))
