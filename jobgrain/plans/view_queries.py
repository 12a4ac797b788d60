"""Queries of the views, tracking and analytics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrain.operators import analytics, tracking, views
from jobgrain.plans.fixtures import AS_OF, all_rejections, ctes, shape
from jobgrain.plans.registry import register

_DAY = f"DATE '{AS_OF}'"


def jobs(s, d):
    return shape(s, d, "postings")


def scores(s, d):
    return shape(s, d, "scores").select("score_id", "job_id", "score", "recommendation", "profile_hash", "model_used", "scored_at", "session_id", "latency_ms", "hard_gate_failed")


def events(s, d):
    return shape(s, d, "status_history").select("id", "job_id", "new_status", "changed_at")


def interviews(s, d):
    return shape(s, d, "interviews")


_JS = ctes("postings", "scores") + "\n"
_JSN = ctes("postings", "scores", "notifications") + "\n"
_JSR = ctes("postings", "scores", "rejections", "rejections_again") + "\n"
_JE = ctes("postings", "status_history") + "\n"
_JI = ctes("postings", "interviews") + "\n"
_RUNS = ctes("runs") + "\n"

register("unscored", lambda s, d: views.unscored(jobs(s, d), scores(s, d)).select("job_id", "title"), _JS + "SELECT job_id, title FROM postings WHERE job_id NOT IN (SELECT job_id FROM scores)")
register("rescore_candidates", lambda s, d: views.rescore_candidates(jobs(s, d), scores(s, d), 60, 79, 30, "p1", AS_OF).select("job_id", "old_score"),
         _JS + f"SELECT p.job_id, s.score AS old_score FROM postings p JOIN scores s ON p.job_id = s.job_id WHERE s.score BETWEEN 60 AND 79 AND s.profile_hash <> 'p1' AND first_seen_date >= {_DAY} - 30")
register("unnotified_matches", lambda s, d: views.unnotified_matches(jobs(s, d), scores(s, d), shape(s, d, "notifications"), 70).select("job_id", "score"),
         _JSN + "SELECT p.job_id, s.score FROM postings p JOIN scores s ON p.job_id = s.job_id WHERE s.score >= 70 AND p.job_id NOT IN (SELECT job_id FROM notifications)")
register("jobs_in_range", lambda s, d: views.jobs_in_range(jobs(s, d), scores(s, d), AS_OF, 14, 10).select("job_id", "score"), _JS + f"SELECT p.job_id, s.score FROM postings p JOIN scores s ON p.job_id = s.job_id WHERE first_seen_date >= {_DAY} - 14 AND first_seen_date >= {_DAY} - 10")
register("all_jobs", lambda s, d: views.all_jobs(jobs(s, d), scores(s, d)).select("job_id", "score"), _JS + "SELECT p.job_id, s.score FROM postings p JOIN scores s ON p.job_id = s.job_id WHERE is_active")
register("applied_jobs", lambda s, d: views.applied_jobs(jobs(s, d), scores(s, d)).select("job_id", "score", "applied_date"), _JS + "SELECT p.job_id, s.score, CAST(applied_date AS VARCHAR) AS applied_date FROM postings p LEFT JOIN scores s ON p.job_id = s.job_id WHERE applied AND NOT rejected")
register("rejected_jobs", lambda s, d: views.rejected_jobs(jobs(s, d), scores(s, d), all_rejections(s, d)).select("job_id", "score", "rejection_category"),
         _JSR + "SELECT p.job_id, s.score, r.rejection_category FROM postings p LEFT JOIN scores s ON p.job_id = s.job_id LEFT JOIN all_rejections r ON p.job_id = r.job_id WHERE rejected")
register("jobs_by_status", lambda s, d: views.jobs_by_status(jobs(s, d), scores(s, d), "interviewed").select("job_id", "score"), _JS + "SELECT p.job_id, s.score FROM postings p LEFT JOIN scores s ON p.job_id = s.job_id WHERE status = 'interviewed' AND is_active")
register("matches_above", lambda s, d: views.matches_above(jobs(s, d), scores(s, d), 70), _JS + "SELECT p.job_id, title, company, score FROM postings p JOIN scores s ON p.job_id = s.job_id WHERE score >= 70")
register("top_matches", lambda s, d: views.matches_above(jobs(s, d), scores(s, d), 70, 25), _JS + "SELECT p.job_id, title, company, score FROM postings p JOIN scores s ON p.job_id = s.job_id WHERE score >= 70 ORDER BY score DESC, first_seen_date DESC, p.job_id LIMIT 25")
register("upcoming_interviews", lambda s, d: views.upcoming_interviews(interviews(s, d), jobs(s, d), AS_OF).select("id", "job_id", "interview_date", "title"),
         _JI + f"SELECT i.id, i.job_id, CAST(CAST(i.interview_date AS DATE) AS VARCHAR) AS interview_date, p.title FROM interviews i JOIN postings p ON i.job_id = p.job_id WHERE is_active AND interview_date BETWEEN {_DAY} AND {_DAY} + 30")


def _asked(s, d):
    return jobs(s, d).select("job_id")


register("job_timeline", lambda s, d: views.job_timeline(_asked(s, d), events(s, d), interviews(s, d)).withColumn("happened", F.date_format("happened", "yyyy-MM-dd HH:mm:ss")), ctes("postings", "status_history", "interviews") + """,
a AS (SELECT job_id FROM postings),
r AS (SELECT job_id, 'status' AS kind, CAST(changed_at AS TIMESTAMP) AS happened, new_status AS detail, id FROM status_history WHERE job_id IN (SELECT job_id FROM a) UNION ALL SELECT job_id, 'interview', CAST(interview_date AS TIMESTAMP), interview_type, id FROM interviews WHERE job_id IN (SELECT job_id FROM a))
SELECT job_id, kind, strftime(happened, '%Y-%m-%d %H:%M:%S') AS happened, detail, row_number() OVER (PARTITION BY job_id, kind ORDER BY happened DESC, id DESC) AS nth FROM r""")
register("job_detail", lambda s, d: views.job_detail(_asked(s, d), jobs(s, d), scores(s, d)).select("job_id", "title", "score", "recommendation"), _JS + "SELECT p.job_id, title, score, recommendation FROM postings p LEFT JOIN scores s ON p.job_id = s.job_id")


def _made_of(s, d):
    """Scores of two rounds, the later one with other parts."""
    one = shape(s, d, "scores").select("job_id", "score_id", "scored_at", "matched", "m0", "m1")
    said = lambda c: F.concat(F.lit('{"level":"'), c, F.lit('"}'))
    parts = {"components": F.concat(F.lit('[{"name":"skills","match_status":"'), "m0", F.lit('","weight":50}]')), "hireability_factors": said("m0"), "risk_profile": said("m1"), "score_breakdown": F.coalesce("matched", F.lit(""))}
    later = one.withColumns({"scored_at": F.col("scored_at") + F.expr("INTERVAL 1 DAY"), "score_id": F.col("score_id") + 1, "m0": F.upper("m0")}).where("job_id % 2 = 0")
    return one.unionByName(later).withColumns(parts).drop("matched", "m0", "m1")


register("job_components", lambda s, d: views.job_components(_asked(s, d), _made_of(s, d)).select("job_id", F.col("components")[0]["match_status"].alias("part"), F.col("components")[0]["weight"].alias("weight"), F.col("hireability_factors")["level"].alias("hire"), F.col("risk_profile")["level"].alias("risk"), F.size("score_breakdown").alias("broken")), _JS + """
SELECT p.job_id, CASE WHEN p.job_id % 2 = 0 THEN upper(m0) ELSE m0 END AS part, 50.0 AS weight, CASE WHEN p.job_id % 2 = 0 THEN upper(m0) ELSE m0 END AS hire, m1 AS risk, CASE WHEN matched IS NOT NULL THEN 0 END AS broken FROM postings p JOIN scores s ON p.job_id = s.job_id""")
_AU = "(contains(lower(location), 'australia') OR " + " OR ".join(f"contains(lower(location), '{c}')" for c in views.CITIES) + ")"
register("location_filter", lambda s, d: jobs(s, d).select("job_id", *(views.location_matches(F.col("location"), m).alias(m) for m in ("perth", "australia", "world")), views.region_matches(F.col("region"), "australia").alias("home")),
         ctes("postings") + f"\nSELECT job_id, coalesce(contains(lower(location), 'perth'), false) AS perth, coalesce({_AU} AND (contains(lower(location), 'remote') OR contains(lower(location), 'hybrid')), false) AS australia, coalesce(contains(lower(location), 'remote'), false) AS world, coalesce(region, 'australia') = 'australia' AS home FROM postings")
register("open_matches", lambda s, d: views.open_matches(views.all_jobs(jobs(s, d), scores(s, d), True), 70).select("job_id", "score"), _JS + "SELECT p.job_id, score FROM postings p JOIN scores s ON p.job_id = s.job_id WHERE score >= 70 AND NOT applied AND NOT rejected")
register("sample_unscored", lambda s, d: views.sample_unscored(jobs(s, d), scores(s, d), 20, 7).select("job_id"))

register("status_log", lambda s, d: tracking.status_log(events(s, d)).select("id", "job_id", "old_status", "new_status"), _JE + "SELECT id, job_id, coalesce(lag(new_status) OVER (PARTITION BY job_id ORDER BY changed_at, id), 'new') AS old_status, new_status FROM status_history")
_STATE = ("job_id", "status", "applied", "applied_date", "offer_date", "decision_date", "rejected", "rejected_date")


def _dated(s, d):
    """Jobs of which some have an offer and a decision already."""
    of = lambda m, days: F.when(F.col("job_id") % m == 0, F.date_add("first_seen_date", days))
    return jobs(s, d).withColumns({"offer_date": of(4, 3), "decision_date": of(6, 9)})


register("fold_status", lambda s, d: tracking.fold_status(_dated(s, d), events(s, d)).select(*_STATE), _JE + """, e AS (SELECT job_id, arg_max(new_status, changed_at * 1) FROM (SELECT 1 AS job_id, 'x' AS new_status, 1 AS changed_at) GROUP BY job_id),
l AS (SELECT job_id, new_status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY changed_at DESC, id DESC) AS r FROM status_history) WHERE r = 1),
f AS (SELECT job_id, min(CASE WHEN new_status = 'applied' THEN CAST(changed_at AS DATE) END) AS a, max(CASE WHEN new_status = 'offer_received' THEN CAST(changed_at AS DATE) END) AS o,
  max(CASE WHEN new_status IN ('accepted', 'declined_offer', 'rejected') THEN CAST(changed_at AS DATE) END) AS c, max(CASE WHEN new_status = 'rejected' THEN CAST(changed_at AS DATE) END) AS r FROM status_history GROUP BY job_id)
SELECT p.job_id, coalesce(l.new_status, p.status) AS status, p.applied OR f.a IS NOT NULL AS applied, CAST(CASE WHEN f.a IS NOT NULL AND NOT p.applied THEN f.a ELSE CAST(p.applied_date AS DATE) END AS VARCHAR) AS applied_date, CAST(coalesce(f.o, CASE WHEN p.job_id % 4 = 0 THEN CAST(p.first_seen_date AS DATE) + 3 END) AS VARCHAR) AS offer_date, CAST(coalesce(f.c, CASE WHEN p.job_id % 6 = 0 THEN CAST(p.first_seen_date AS DATE) + 9 END) AS VARCHAR) AS decision_date,
  p.rejected OR f.r IS NOT NULL AS rejected, CAST(coalesce(f.r, CAST(p.rejected_date AS DATE)) AS VARCHAR) AS rejected_date FROM postings p LEFT JOIN l ON p.job_id = l.job_id LEFT JOIN f ON p.job_id = f.job_id""".replace(""", e AS (SELECT job_id, arg_max(new_status, changed_at * 1) FROM (SELECT 1 AS job_id, 'x' AS new_status, 1 AS changed_at) GROUP BY job_id),
l AS""", ",\nl AS"))
register("latest_interview", lambda s, d: tracking.latest_interview(jobs(s, d).select("job_id", F.col("first_seen_date").alias("interview_date"), F.lit("call").alias("interview_type")), interviews(s, d)), _JI + """,
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS r FROM interviews) WHERE r = 1)
SELECT p.job_id, CAST(CAST(coalesce(l.interview_date, p.first_seen_date) AS DATE) AS VARCHAR) AS interview_date, coalesce(l.interview_type, 'call') AS interview_type FROM postings p LEFT JOIN l ON p.job_id = l.job_id""")


def _profiles(s, d):
    return scores(s, d).where("profile_hash IS NOT NULL").select("profile_hash", F.col("scored_at").alias("changed_at"))


register("latest_profile_hash", lambda s, d: tracking.latest_profile_hash(_profiles(s, d)), _JS + "SELECT profile_hash FROM scores WHERE profile_hash IS NOT NULL ORDER BY scored_at DESC, profile_hash DESC LIMIT 1")
register("profile_changed", lambda s, d: tracking.profile_changed(_profiles(s, d), "p9"), _JS + "SELECT count(*) > 0 AS changed, count(*) = 0 AS first_run, true AS record FROM scores WHERE profile_hash IS NOT NULL")


def _rescored(s, d):
    return scores(s, d).where("job_id % 5 = 0").withColumn("score", ((F.col("score") * 3 + 20) % 101).cast("int"))


register("apply_rescore", lambda s, d: tracking.apply_rescore(scores(s, d), _rescored(s, d)).select("job_id", "score"), _JS + "SELECT job_id, CASE WHEN job_id % 5 = 0 THEN CAST((score * 3 + 20) % 101 AS INT) ELSE score END AS score FROM scores")
register("rescore_summary", lambda s, d: tracking.rescore_summary(scores(s, d), _rescored(s, d), 70), _JS + "SELECT count(*) AS rescored, count(*) FILTER (score < 70 AND (score * 3 + 20) % 101 >= 70) AS upgraded FROM scores WHERE job_id % 5 = 0")
register("record_notifications", lambda s, d: tracking.record_notifications(views.unnotified_matches(jobs(s, d), scores(s, d), shape(s, d, "notifications"), 70), "email", "sent", "2026-02-28 08:00:00").withColumn("sent_at", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss")),
         _JSN + "SELECT p.job_id, 'email' AS notification_type, '2026-02-28 08:00:00' AS sent_at, 'sent' AS status FROM postings p JOIN scores s ON p.job_id = s.job_id WHERE s.score >= 70 AND p.job_id NOT IN (SELECT job_id FROM notifications)")


def components(s, d):
    one = lambda i, name, cat, w: F.struct(F.lit(name).alias("name"), F.lit(cat).alias("category"), F.col(f"m{i}").alias("match_status"), F.lit("high").alias("criticality"), F.lit(float(w)).alias("weight"), F.lit("").alias("reasoning"))
    return shape(s, d, "scores").withColumn("components", F.array(one(0, "skills", "technical", 50), one(1, "experience", "background", 30), one(2, "domain", "technical", 20)))


_COMP = _JS + """, c AS (SELECT job_id, session_id, 'skills' AS name, 'technical' AS category, 50.0 AS w, m0 AS m FROM scores UNION ALL SELECT job_id, session_id, 'experience', 'background', 30.0, m1 FROM scores UNION ALL SELECT job_id, session_id, 'domain', 'technical', 20.0, m2 FROM scores),
cw AS (SELECT *, CASE m WHEN 'yes' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END AS x FROM c)
"""
register("top_components", lambda s, d: tracking.top_components(components(s, d), 2).select("job_id", F.posexplode("top").alias("pos", "t")).select("job_id", "pos", "t.name", "t.contribution"),
         _COMP + "SELECT job_id, CAST(r - 1 AS INT) AS pos, name, contribution FROM (SELECT job_id, name, CAST(w * x AS DOUBLE) AS contribution, row_number() OVER (PARTITION BY job_id ORDER BY w * x DESC, name) AS r FROM cw) WHERE r <= 2")
_FIRSTS = """, f AS (SELECT job_id, min(CASE WHEN new_status = 'applied' THEN CAST(changed_at AS DATE) END) AS a, min(CASE WHEN new_status = 'interview_scheduled' THEN CAST(changed_at AS DATE) END) AS i, min(CASE WHEN new_status = 'offer_received' THEN CAST(changed_at AS DATE) END) AS o, min(CASE WHEN new_status = 'interested' THEN CAST(changed_at AS DATE) END) AS s, min(CASE WHEN new_status = 'rejected' THEN CAST(changed_at AS DATE) END) AS e FROM status_history GROUP BY job_id)
"""
register("stage_durations", lambda s, d: tracking.stage_durations(events(s, d).replace("interested", "responded", "new_status"), jobs(s, d)), _JE + _FIRSTS + "SELECT round(avg(date_diff('day', CAST(first_seen_date AS DATE), a)), 6) AS days_to_applied, round(avg(date_diff('day', a, s)), 6) AS days_to_responded, round(avg(date_diff('day', s, i)), 6) AS days_to_interview_scheduled, round(avg(date_diff('day', i, o)), 6) AS days_to_offer_received, round(avg(date_diff('day', o, e)), 6) AS days_to_decision, round(avg(date_diff('day', CAST(first_seen_date AS DATE), e)), 6) AS days_in_all FROM postings p JOIN f ON p.job_id = f.job_id")
register("application_funnel", lambda s, d: tracking.application_funnel(jobs(s, d), events(s, d)), _JE + """,
n AS (SELECT 'discovered' AS stage, 0 AS position, count(*) AS reached FROM postings UNION ALL SELECT x.stage, x.position, (SELECT count(DISTINCT job_id) FROM status_history h WHERE h.new_status = x.stage) FROM (VALUES ('applied', 1), ('interview_scheduled', 2), ('offer_received', 3), ('accepted', 4)) AS x(stage, position))
SELECT stage, position, reached, CASE WHEN position = 0 THEN 100.0 ELSE round(coalesce(reached * 100.0 / nullif(lag(reached) OVER (ORDER BY position), 0), 0), 2) END AS step_percent, round(coalesce(reached * 100.0 / nullif(first(reached) OVER (ORDER BY position), 0), 0), 2) AS overall_percent FROM n""")
register("success_rate", lambda s, d: tracking.success_rate(events(s, d)), _JE + "SELECT count(DISTINCT CASE WHEN new_status = 'accepted' THEN job_id END) AS accepted, count(DISTINCT CASE WHEN new_status = 'applied' THEN job_id END) AS applied, round(count(DISTINCT CASE WHEN new_status = 'accepted' THEN job_id END) * 100.0 / count(DISTINCT CASE WHEN new_status = 'applied' THEN job_id END), 2) AS success_percent FROM status_history")

register("headline_counts", lambda s, d: analytics.headline_counts(jobs(s, d), scores(s, d), 70), _JS + "SELECT (SELECT count(*) FROM postings) AS n_jobs, (SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') FROM postings) AS last_created, count(*) FILTER (score >= 70) AS n_matches, round(avg(score), 1) AS avg_score FROM scores")
register("top_companies", lambda s, d: analytics.top_companies(jobs(s, d), 5), ctes("postings") + "\nSELECT company, count(*) AS n FROM postings WHERE company IS NOT NULL GROUP BY company ORDER BY n DESC, company LIMIT 5")


def _band_sql(bands) -> str:
    return "CASE " + " ".join(f"WHEN {'true' if lo is None else f'score >= {lo}'} AND {'true' if hi is None else f'score < {hi + 1}'} THEN '{b}'" for b, lo, hi in bands) + " END"


register("score_distribution", lambda s, d: analytics.score_distribution(scores(s, d)), _JS + f", b AS (SELECT {_band_sql(analytics.BANDS)} AS band, count(*) AS n FROM scores GROUP BY 1) SELECT band, n, round(n * 100.0 / sum(n) OVER (), 1) AS percent FROM b")
register("score_distribution_by_source", lambda s, d: analytics.score_distribution(scores(s, d).join(jobs(s, d).select("job_id", "source"), "job_id"), analytics.FIFTHS, "source"),
         _JS + f", b AS (SELECT source, {_band_sql(analytics.FIFTHS)} AS band, count(*) AS n FROM scores s JOIN postings p ON s.job_id = p.job_id GROUP BY 1, 2) SELECT source, band, n, round(n * 100.0 / sum(n) OVER (PARTITION BY source), 1) AS percent FROM b")
register("rejection_stats", lambda s, d: analytics.rejection_stats(all_rejections(s, d)), _JSR + "SELECT rejection_category, count(*) AS n FROM all_rejections GROUP BY 1")
register("status_stats", lambda s, d: analytics.status_stats(jobs(s, d)), ctes("postings") + "\nSELECT status, count(*) AS n FROM postings WHERE is_active GROUP BY 1")
register("status_board", lambda s, d: analytics.status_board(jobs(s, d)), ctes("postings") + ", b(position, status, label) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(analytics.BOARD)) + ")\nSELECT position, b.status, label, count(*) AS n FROM postings p JOIN b ON coalesce(p.status, 'new') = b.status GROUP BY 1, 2, 3")
_AGE = f"date_diff('day', CAST(first_seen_date AS DATE), {_DAY})"
register("date_buckets", lambda s, d: analytics.date_buckets(jobs(s, d).join(scores(s, d), "job_id", "left"), AS_OF), _JS + f"""
SELECT CASE WHEN {_AGE} = 0 THEN 'Today' WHEN {_AGE} = 1 THEN 'Yesterday' WHEN {_AGE} <= 7 THEN {_AGE} || ' days ago' WHEN {_AGE} <= 30 THEN strftime(CAST(first_seen_date AS DATE), '%b %d, %Y') ELSE strftime(CAST(first_seen_date AS DATE), '%b %Y') END AS bucket,
  CASE WHEN coalesce(score, 0) >= 90 THEN 'excellent' WHEN coalesce(score, 0) >= 80 THEN 'good' WHEN coalesce(score, 0) >= 75 THEN 'fair' ELSE 'low' END AS score_class, count(*) AS n FROM postings p LEFT JOIN scores s ON p.job_id = s.job_id GROUP BY 1, 2""")
register("view_stats", lambda s, d: analytics.view_stats(jobs(s, d).join(scores(s, d), "job_id", "left")), _JS + "SELECT count(*) AS total, count(*) FILTER (recommendation = 'APPLY') AS apply_count, round(avg(coalesce(score, 0)), 1) AS avg_score FROM postings p LEFT JOIN scores s ON p.job_id = s.job_id")
register("score_badge", lambda s, d: scores(s, d).select("job_id", analytics.score_badge(F.col("score")).alias("badge")), _JS + "SELECT job_id, CASE WHEN score >= 90 THEN 'top' WHEN score >= 80 THEN 'strong' WHEN score >= 70 THEN 'good' ELSE 'other' END AS badge FROM scores")
register("counts_by_source", lambda s, d: analytics.counts_by(jobs(s, d), "source", AS_OF, 10), ctes("postings") + f"\nSELECT source, count(*) AS n FROM postings WHERE last_seen_date >= {_DAY} - 10 GROUP BY 1")
register("counts_by_region", lambda s, d: analytics.counts_by(jobs(s, d), "region"), ctes("postings") + "\nSELECT region, count(*) AS n FROM postings GROUP BY 1")
register("distinct_counts", lambda s, d: analytics.distinct_counts(jobs(s, d), scores(s, d)), _JS + "SELECT (SELECT count(DISTINCT company) FROM postings) AS n_companies, count(DISTINCT model_used) AS n_models FROM scores")
register("description_stats", lambda s, d: analytics.description_stats(jobs(s, d)), ctes("postings") + "\nSELECT source, min(length(description)) AS shortest, max(length(description)) AS longest, CAST(floor(avg(length(description))) AS BIGINT) AS mean FROM postings GROUP BY 1")


def runs(s, d):
    return analytics.run_row(shape(s, d, "runs"))


_R = _RUNS[:-1] + """,
rr AS (SELECT *, total_cards_seen - tier1_filtered - tier2_skipped - tier3_filtered AS jobs_collected, CASE WHEN total_cards_seen = 0 THEN 0.0 ELSE (tier1_filtered + tier2_skipped + tier3_filtered) * 100.0 / total_cards_seen END AS efficiency_percent FROM runs)
"""
_SUMS = "count(*) AS runs, CAST(sum(pages_scraped) AS BIGINT) AS pages, CAST(sum(total_cards_seen) AS BIGINT) AS cards, CAST(sum(tier1_filtered) AS BIGINT) AS tier1, CAST(sum(tier2_skipped) AS BIGINT) AS tier2, CAST(sum(tier3_filtered) AS BIGINT) AS tier3, CAST(sum(jobs_collected) AS BIGINT) AS jobs, round(avg(efficiency_percent), 6) AS avg_efficiency, round(sum(duration_seconds), 4) AS duration"
_RUN_DAY = "1998-06-01"
register("run_row", lambda s, d: runs(s, d).select("run_id", "jobs_collected", F.round("efficiency_percent", 6).alias("efficiency_percent")), _R + "SELECT run_id, jobs_collected, round(efficiency_percent, 6) AS efficiency_percent FROM rr")
register("recent_runs", lambda s, d: analytics.recent_runs(runs(s, d), _RUN_DAY, "seek", 30, 50).select("run_id", "platform", "jobs_collected"), _R + f"SELECT run_id, platform, jobs_collected FROM rr WHERE run_timestamp >= TIMESTAMP '{_RUN_DAY}' - INTERVAL 30 DAY AND platform = 'seek' ORDER BY run_timestamp DESC, run_id LIMIT 50")
register("daily_summary", lambda s, d: analytics.daily_summary(runs(s, d), "1995-03-15"), _R + f"SELECT platform, {_SUMS} FROM rr WHERE CAST(run_timestamp AS DATE) = DATE '1995-03-15' GROUP BY platform")
register("daily_rollup", lambda s, d: analytics.daily_rollup(runs(s, d), _RUN_DAY, 7), _R + f"SELECT CAST(CAST(run_timestamp AS DATE) AS VARCHAR) AS day, platform, {_SUMS} FROM rr WHERE CAST(run_timestamp AS DATE) >= DATE '{_RUN_DAY}' - 7 GROUP BY 1, 2 UNION ALL SELECT CAST(CAST(run_timestamp AS DATE) AS VARCHAR), 'ALL', {_SUMS} FROM rr WHERE CAST(run_timestamp AS DATE) >= DATE '{_RUN_DAY}' - 7 GROUP BY 1")
register("page_efficiency", lambda s, d: analytics.page_efficiency(runs(s, d).withColumn("page_details", F.format_string('[{"page": %d, "cards": %d, "jobs": %d}]', "pages_scraped", "total_cards_seen", "jobs_collected"))), _R + """,
p AS (SELECT CAST(pages_scraped AS INT) AS page, CAST(sum(total_cards_seen) AS BIGINT) AS cards, CAST(sum(jobs_collected) AS BIGINT) AS jobs FROM rr GROUP BY 1),
q AS (SELECT *, round((cards - jobs) * 100.0 / cards, 1) AS percent, round((sum(cards) OVER () - sum(jobs) OVER ()) * 100.0 / sum(cards) OVER (), 1) AS overall_percent FROM p)
SELECT *, CAST(rank() OVER (ORDER BY percent DESC) AS INT) AS place FROM q""")
register("component_stats", lambda s, d: analytics.component_stats(components(s, d), "run1"), _COMP + """SELECT category, count(*) AS n, CAST(round(avg(w), 6) AS DOUBLE) AS avg_weight, CAST(round(avg(x * 100), 6) AS DOUBLE) AS avg_score, CAST(round(avg(w * x), 6) AS DOUBLE) AS avg_contribution,
  round(avg(CASE WHEN m = 'yes' THEN 1 ELSE 0 END), 6) AS rate_yes, round(avg(CASE WHEN m = 'partial' THEN 1 ELSE 0 END), 6) AS rate_partial, round(avg(CASE WHEN m = 'no' THEN 1 ELSE 0 END), 6) AS rate_no FROM cw WHERE session_id = 'run1' GROUP BY category""")
register("session_stats", lambda s, d: analytics.session_stats(scores(s, d).withColumn("score", F.when(F.col("job_id") % 29 != 0, F.col("score")))), _JS + """, t AS (SELECT *, CASE WHEN job_id % 29 <> 0 THEN score END AS sc FROM scores)
SELECT session_id, count(*) AS n, count(*) FILTER (sc IS NULL) AS failed, count(*) FILTER (hard_gate_failed IS NOT NULL) AS gate_failures, round(coalesce(sum(sc) FILTER (hard_gate_failed IS NULL), 0) / greatest(1, count(*) FILTER (sc IS NOT NULL AND hard_gate_failed IS NULL)), 6) AS avg_score, round(avg(latency_ms), 6) AS avg_latency,
  count(*) FILTER (recommendation = 'APPLY') AS n_apply, count(*) FILTER (recommendation = 'CLARIFY') AS n_clarify, count(*) FILTER (recommendation = 'SKIP') AS n_skip FROM t GROUP BY session_id""")


def _compared(s, d):
    b = _rescored(s, d).withColumn("recommendation", F.when(F.col("score") >= 70, "APPLY").when(F.col("score") >= 50, "CLARIFY").otherwise("SKIP"))
    return analytics.compare_scorings(scores(s, d).where("job_id % 2 = 0"), b)


_CMP = _JS + """, b AS (SELECT job_id, CAST((score * 3 + 20) % 101 AS INT) AS score FROM scores WHERE job_id % 5 = 0),
c AS (SELECT coalesce(a.job_id, b.job_id) AS job_id, a.score AS score_a, a.recommendation AS rec_a, b.score AS score_b, CASE WHEN b.score >= 70 THEN 'APPLY' WHEN b.score >= 50 THEN 'CLARIFY' WHEN b.score IS NOT NULL THEN 'SKIP' END AS rec_b, b.score - a.score AS delta FROM (SELECT * FROM scores WHERE job_id % 2 = 0) a FULL JOIN b ON a.job_id = b.job_id)
"""
register("compare_scorings", _compared, _CMP + "SELECT * FROM c")
register("comparison_summary", lambda s, d: analytics.comparison_summary(_compared(s, d)), _CMP + """SELECT count(*) AS n, round(avg(score_a), 6) AS avg_a, round(avg(score_b), 6) AS avg_b, round(count(*) FILTER (rec_a = 'APPLY') * 100.0 / count(rec_a), 1) AS apply_a, round(count(*) FILTER (rec_a = 'SKIP') * 100.0 / count(rec_a), 1) AS skip_a,
  round(count(*) FILTER (rec_b = 'APPLY') * 100.0 / count(rec_b), 1) AS apply_b, round(count(*) FILTER (rec_b = 'SKIP') * 100.0 / count(rec_b), 1) AS skip_b FROM c""")
