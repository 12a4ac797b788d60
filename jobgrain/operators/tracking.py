"""Event logs folded into current state, change detection and funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobgrain.functions.names import spare

#: Stages of an application, in order.
STAGES = ("applied", "interview_scheduled", "offer_received", "accepted")
#: Stages between which time is measured, and the statuses that reach each.
TIMED = {"applied": ("applied",), "responded": ("responded",), "interview_scheduled": ("interview_scheduled",), "offer_received": ("offer_received",), "decision": ("accepted", "declined_offer", "rejected")}


def status_log(events: DataFrame) -> DataFrame:
    """Adds old_status: the job's status before, 'new' at first."""
    return events.withColumn("old_status", F.lag("new_status", 1, "new").over(Window.partitionBy("job_id").orderBy("changed_at", "id")))


def status_events(events: DataFrame) -> DataFrame:
    """One row a job of an event log: last (changed_at, id, new_status of its last event) and the days of its first application and last
    offer, decision and rejection. Minima and maxima, so parts of a log, in any order, add up to the whole: see add_status."""
    day = lambda *names: F.when(F.col("new_status").isin(*names), F.to_date("changed_at"))
    return events.groupBy("job_id").agg(
        F.max(F.struct("changed_at", "id", "new_status")).alias("last"), F.min(day("applied")).alias("first_applied"), F.max(day("offer_received")).alias("last_offer"),
        F.max(day("accepted", "declined_offer", "rejected")).alias("last_decision"), F.max(day("rejected")).alias("last_rejected"))


def add_status(parts: DataFrame) -> DataFrame:
    """status_events() of a log from those of its parts."""
    latest = ("last", "last_offer", "last_decision", "last_rejected")
    return parts.groupBy("job_id").agg(F.min("first_applied").alias("first_applied"), *(F.max(c).alias(c) for c in latest))


def with_status(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """Jobs with what their events say (status_events): status is the last one; the first 'applied' applies a job that was not; an
    offer's, decision's and rejection's dates are those of their last event, else those that the job has."""
    of, told = spare(jobs, "of", "told")
    state = state.select(F.col("job_id").alias(of), F.struct("last.new_status", "first_applied", "last_offer", "last_decision", "last_rejected").alias(told))
    rows = jobs.join(state, F.col("job_id") == F.col(of), "left")
    stored = lambda c: F.col(c) if c in jobs.columns else F.lit(None).cast("date")
    applies = F.col(f"{told}.first_applied").isNotNull()
    return rows.withColumns({
        "status": F.coalesce(f"{told}.new_status", "status"), "applied_date": F.when(applies & ~F.col("applied"), F.col(f"{told}.first_applied")).otherwise(F.col("applied_date")), "applied": F.col("applied") | applies,
        "rejected_date": F.coalesce(f"{told}.last_rejected", "rejected_date"), "rejected": F.col("rejected") | F.col(f"{told}.last_rejected").isNotNull(),
        "offer_date": F.coalesce(f"{told}.last_offer", stored("offer_date")), "decision_date": F.coalesce(f"{told}.last_decision", stored("decision_date"))}).drop(of, told)


def fold_status(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs after their events, see with_status. Aggregates rather than windows, so that each map side combines."""
    return with_status(jobs, status_events(events))


def latest_interview(jobs: DataFrame, interviews: DataFrame) -> DataFrame:
    """Jobs with interview_date and interview_type of the interview that was added last; a job without one keeps its own."""
    last = interviews.groupBy("job_id").agg(F.max_by(F.struct("interview_date", "interview_type"), F.struct("created_at", "id")).alias("i"))
    of = lambda c: F.coalesce(F.col(f"i.{c}"), F.col(c)) if c in jobs.columns else F.col(f"i.{c}")
    return jobs.join(last, "job_id", "left").withColumns({c: of(c) for c in ("interview_date", "interview_type")}).drop("i")


def latest_profile_hash(log: DataFrame) -> DataFrame:
    """One row, profile_hash: the newest logged one."""
    return log.agg(F.max_by("profile_hash", F.struct("changed_at", "profile_hash")).alias("profile_hash"))


def profile_changed(log: DataFrame, profile_hash: str | None) -> DataFrame:
    """One row: changed, first_run, record. A missing hash is no change; the first run is one, and is recorded as a change is."""
    now = F.lit(profile_hash).cast("string")
    first = F.col("profile_hash").isNull()
    changed = now.isNotNull() & (first | (F.col("profile_hash") != now))
    return latest_profile_hash(log).select(F.coalesce(changed, F.lit(False)).alias("changed"), (first & now.isNotNull()).alias("first_run"), F.coalesce(changed, F.lit(False)).alias("record"))


def apply_rescore(scores: DataFrame, new_scores: DataFrame) -> DataFrame:
    """Scores in which a rescored job has its new score alone."""
    return scores.join(new_scores.select("job_id"), "job_id", "left_anti").unionByName(new_scores)


def rescore_summary(scores: DataFrame, new_scores: DataFrame, threshold: int) -> DataFrame:
    """One row: jobs rescored, and those that rose from below threshold to it."""
    both = new_scores.select("job_id", F.col("score").alias("now")).join(scores.groupBy("job_id").agg(F.max("score").alias("old")), "job_id", "left")
    return both.agg(F.count("*").alias("rescored"), F.count_if((F.col("old") < threshold) & (F.col("now") >= threshold)).alias("upgraded"))


def record_notifications(matches: DataFrame, kind: str, status: str, sent_at) -> DataFrame:
    """One notification row a matched job."""
    return matches.select("job_id", F.lit(kind).alias("notification_type"), F.lit(sent_at).cast("timestamp").alias("sent_at"), F.lit(status).alias("status"))


def top_components(df: DataFrame, n: int = 3) -> DataFrame:
    """job_id and its n components of the largest contribution (weight times what the match is worth), names breaking ties."""
    worth = lambda c: c["weight"] * F.when(c["match_status"] == "yes", 1.0).when(c["match_status"] == "partial", 0.5).otherwise(0.0)
    ranked = F.sort_array(F.transform("components", lambda c: F.struct((-worth(c)).alias("less"), c["name"].alias("name"))))
    return df.select("job_id", F.transform(F.slice(ranked, 1, n), lambda x: F.struct(x["name"].alias("name"), (-x["less"]).alias("contribution"))).alias("top"))


def stage_durations(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: mean days from discovery to applied and from each stage to the next, over jobs that reached both, and from
    discovery to the decision."""
    firsts = events.groupBy("job_id").agg(*(F.min(F.when(F.col("new_status").isin(*names), F.to_date("changed_at"))).alias(s) for s, names in TIMED.items()))
    t = jobs.select("job_id", "first_seen_date").join(firsts, "job_id")
    steps = list(zip(("first_seen_date", *TIMED), TIMED, strict=False))
    mean = lambda a, b: F.round(F.avg(F.datediff(b, a)), 6)
    return t.agg(*(mean(a, b).alias(f"days_to_{b}") for a, b in steps), mean("first_seen_date", "decision").alias("days_in_all"))


def application_funnel(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """stage, position, jobs that ever reached it, step and overall conversion in percent; 'discovered' are all jobs."""
    reached = events.where(F.col("new_status").isin(*STAGES)).groupBy(F.col("new_status").alias("stage")).agg(F.count_distinct("job_id").alias("reached"))
    order = jobs.sparkSession.createDataFrame([("discovered", 0), *((s, i) for i, s in enumerate(STAGES, 1))], "stage string, position int")
    counts = order.join(reached.unionByName(jobs.agg(F.count("*").alias("reached")).withColumn("stage", F.lit("discovered"))), "stage", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    w = Window.orderBy("position")  # five rows
    rate = lambda of: F.round(F.coalesce(F.try_divide(F.col("reached") * 100.0, of), F.lit(0.0)), 2)
    return counts.withColumns({"step_percent": F.when(F.col("position") == 0, 100.0).otherwise(rate(F.lag("reached").over(w))), "overall_percent": rate(F.first("reached").over(w))})


def success_rate(events: DataFrame) -> DataFrame:
    """One row: accepted jobs in percent of applied ones."""
    of = lambda s: F.count_distinct(F.when(F.col("new_status") == s, F.col("job_id")))
    return events.agg(of("accepted").alias("accepted"), of("applied").alias("applied")).withColumn("success_percent", F.round(F.coalesce(F.try_divide(F.col("accepted") * 100.0, F.col("applied")), F.lit(0.0)), 2))
