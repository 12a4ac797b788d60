"""Registered queries read whole tables and whole texts: small fixtures whose signals stand far from the start."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobgrain.functions import text
from jobgrain.operators import ingest, parse, scoring, store, tracking, views
from jobgrain.plans import catalogue, registry  # noqa: F401
from jobgrain.plans.fixtures import AS_OF, KEYWORDS
from jobgrain.streaming import jobs as streams

FAR = "lorem ipsum dolor sit amet " * 40 + "\n"
ADVERT = FAR + "Must have Python. Asks 5 years of experience. PhD required. Hold nv1. For a recent graduate. Deep learning. Work in Melbourne, office-based. Coaching at a startup."
#: Documents whose canned sentences give no signal of these.
IDS = (134, 179)


@pytest.fixture(scope="module")
def adverts(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, ADVERT, "en", "web", len(ADVERT)) for i in IDS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name, want", [
    ("dealbreakers", {"reasons": "Requires 5+ years of experience,PhD required"}),
    ("graduate_signals", {"explicit_graduate": True}),
    ("domains", {"domains_present": "Deep Learning", "domain_keywords": "deep learning"}),
    ("tech_stack", {"required": "python", "strong_present": "python"}),
    ("location_visa", {"primary_city": "Melbourne", "remote_type": "Onsite"}),
    ("company_signals", {"mentorship": True, "stage": "Startup"}),
    ("parse_postings", {"suitable": False, "description_length": len(ADVERT) + len(" | Series D, on your way.\nNothing else.")}),
    ("hard_gates", {"gate": "Security clearance required"}),
])
def test_adverts_are_parsed_whole(spark, adverts, name, want):
    rows = registry.queries()[name](spark, adverts).collect()
    assert sorted(r.job_id for r in rows) == list(IDS)
    assert [{k: r[k] for k in want} for r in rows] == [want] * len(IDS)


def test_adverts_are_scored_whole(spark, adverts):
    n = len(ADVERT) + len(" | Series D, on your way.\nNothing else.")
    assert {r.job_id: r.score for r in registry.queries()["score_batch"](spark, adverts).collect()} == {134: n % 100, 179: len("Associate Engineer")}
    assert registry.queries()["score_summary"](spark, adverts).first().avg_score == (n % 100 + len("Associate Engineer")) / 2


def test_contexts_of_a_skill_are_those_of_the_whole_text(spark):
    rng = random.Random(5)
    gaps = ["", " ", "\n", "x", "sql", " plus ", " required ", *(" " + "y" * n + " " for n in (48, 49, 50, 51, 99, 160, 207, 210, 400, 3000)), " z\n" * 90]
    texts = ["".join(rng.choice(gaps) + rng.choice(["sql", "sql", "", "sq"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    pattern = r"(?d).{0,50}(?<![\p{L}\p{N}_])sql(?![\p{L}\p{N}_]).{0,50}"
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all(parse.around(F.col("t"), "sql"), F.lit(pattern), F.lit(0)).alias("near")).collect()
    assert [r.near for r in got] == [re.findall(r"[^\n]{0,50}(?<!\w)sql(?!\w)[^\n]{0,50}", r.t) for r in got]


def test_every_job_is_asked_for(spark, sf):
    """Against rows counted by hand from the given tables, without the queries' SQL."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    ids = {r.doc_id for r in read("documents").select("doc_id").collect()}
    assert sorted(r.job_id for r in registry.queries()["job_detail"](spark, sf).collect()) == sorted(ids)
    happened = sorted([("status", r.user_id) for r in read("events").select("user_id").collect() if r.user_id in ids] + [("interview", r.k) for r in read("orders").selectExpr("o_orderkey % 1000 AS k").collect() if r.k in ids])
    assert sorted((r.kind, r.job_id) for r in registry.queries()["job_timeline"](spark, sf).collect()) == happened


def test_sources_are_read_whole(spark, tmp_path):
    """Bodies whose markers, labels and skills stand behind 500 characters of nothing."""
    body = " " * 500 + "python sql\nFull-time\n" + "z" * 500
    marked = body + "\nRequired Qualifications far\nJob function:\nFarming\n"
    spark.createDataFrame([(3, marked, "en", "web", 1), (13, marked, "en", "web", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: {r.doc_id: r for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    first = run("split_requirements")[3]
    assert first.description == body.strip() and first.requirement_text == "Required Qualifications\nfar\nJob function:\nFarming"
    labels = run("infer_labels")
    assert labels[13].job_function == "Farming" and labels[13].employment_type == "Full-time"
    assert run("join_skills")[3].skills.startswith("python, sql\nFull-time")


def test_searches_are_packed_in_small_objects(spark, tmp_path, monkeypatch):
    from jobgrain.plans import source_queries

    spark.range(1000).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang", "'web' AS source", "1 AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    sent, through = [], source_queries.through_file
    monkeypatch.setattr(source_queries, "through_file", lambda df, *a, **k: sent.append(df) or through(df, *a, **k))
    assert registry.queries()["read_searches"](spark, str(tmp_path)).count() == 750
    assert sent[0].count() == 10 and sent[0].selectExpr("max(size(seek) + size(jora) + size(linkedin)) AS n").first().n == 50


def test_titles_match_whatever_their_case(spark):
    rows = [(1, "DATA Engineer ", "Acme Ltd", "u1", "a"), (2, "Data engineer", "ACME", "u2", "b"), (3, "\tdata ENGINEER\n", "acme", "u3", "a")]
    df = spark.createDataFrame(rows, "job_id long, title string, company string, url string, source string")
    got = {(r.new_key, r.existing_key, r.similarity) for r in ingest.match_existing_fuzzy(df.where("job_id <> 2"), df.where("job_id = 2"), window_days=None).collect()}
    assert got == {(1, 2, 1.0), (3, 2, 1.0)}
    dup = ingest.dedup_in_batch(df.selectExpr("job_id AS seq", "title", "'Acme' AS company", "true AS passes")).collect()
    assert sorted((r.seq, r.dup_cross) for r in dup) == [(1, False), (2, True), (3, True)]


def test_updates_of_different_columns_add_up(spark):
    jobs = spark.createDataFrame([(1, "new", 0, False), (2, "new", 0, False)], "job_id long, status string, priority int, rejected boolean")
    updates = spark.createDataFrame([(1, 1, "2026-01-01", None, 9, None, None), (1, 2, "2026-01-02", "applied", None, None, None), (1, 3, "2026-01-03", "rejected", None, True, "visa"), (7, 4, "2026-01-03", "rejected", None, True, "visa")],
                                    "job_id long, update_id long, updated_at string, status string, priority int, rejected boolean, rejection_category string")
    assert sorted(map(tuple, store.apply_updates(jobs, updates).collect())) == [(1, "rejected", 9, True), (2, "new", 0, False)]
    assert [tuple(r) for r in store.rejection_rows(updates, jobs).collect()] == [(1, "visa", "", "2026-01-03")]
    assert store.apply_updates(jobs, updates.select("job_id", "update_id", "updated_at")).count() == 2


def test_dates_of_offers_outlive_later_batches(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "new", False, None, False, None, None, None), (2, "new", False, None, False, None, "2025-12-01", None)], "job_id long, status string, applied boolean, applied_date string, rejected boolean, rejected_date string, offer_date string, decision_date string")
    jobs = jobs.withColumns({c: F.col(c).cast("date") for c in jobs.columns if c.endswith("_date")})
    source = str(tmp_path / "in")
    for i, (job, status, at) in enumerate([(1, "offer_received", "2026-01-02 00:00:00"), (1, "accepted", "2026-01-05 00:00:00"), (2, "applied", "2026-01-06 00:00:00")]):
        spark.createDataFrame([(i, job, status, at)], "id long, job_id long, new_status string, at string").withColumn("changed_at", F.to_timestamp("at")).drop("at").coalesce(1).write.mode("append").parquet(source)
    like = spark.read.parquet(source)
    streams.stream_status(streams.files_stream(spark, source, like, 1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    last = streams.streamed_status(jobs, str(tmp_path / "out"))
    assert {(r.job_id, r.status, str(r.offer_date), str(r.decision_date)) for r in last.collect()} == {(1, "accepted", "2026-01-02", "2026-01-05"), (2, "applied", "2025-12-01", "None")}
    assert tracking.latest_interview(jobs.selectExpr("job_id", "CAST(NULL AS DATE) AS interview_date"), spark.createDataFrame([(1, "2026-02-01", "phone", "x", 1)], "job_id long, interview_date string, interview_type string, created_at string, id long").withColumn("interview_date", F.to_date("interview_date"))).columns == ["job_id", "interview_date", "interview_type"]


def test_touched_rows_are_those_of_the_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "Data Engineer", "Acme", "u1", "seek", "2026-02-27")], "job_id long, title string, company string, url string, source string, last_seen_date string")
    new = spark.createDataFrame([(1, 5, "DATA ENGINEER", "Acme Ltd", "u9", "jora", "text")], "seq long, job_id long, title string, company string, url string, source string, description string")
    source = str(tmp_path / "in")
    new.write.parquet(source)
    streams.stream_ingest(streams.files_stream(spark, source, new), old, str(tmp_path / "out"), KEYWORDS, AS_OF, str(tmp_path / "state")).awaitTermination()
    want = old.select(text.job_hash(F.col("title"), F.col("company"), F.col("url"))).first()[0]
    assert [r.job_id_hash for r in spark.read.parquet(str(tmp_path / "out" / "touched")).collect()] == [want]


def test_parser_without_any_terms(spark):
    cfg = parse.ParserConfig(exclude_visa=(), exclude_seniority=(), exclude_education=(), cities=())
    r = parse.parse_postings(spark.createDataFrame([("security clearance and phd required", "Senior Cook", "Perth")], "description string, title string, location string"), cfg).first()
    assert r.reasons == [] and not r.place.requires_pr and r.place.cities == []


def test_score_json_of_every_kind(spark):
    df = spark.createDataFrame([(1, '["a"]', '[{"name": "x", "weight": 2}]', '{"final_score": 7}'), (2, "[", "[", "{"), (3, "", "", ""), (4, None, None, None)], "job_id long, matched string, components string, score_breakdown string")
    got = {r.job_id: r for r in scoring.parse_score_json(df).collect()}
    assert got[1].matched == ["a"] and (got[1].components[0].name, got[1].components[0].weight) == ("x", 2.0) and got[1].score_breakdown == {"final_score": "7"}
    assert (got[2].matched, got[2].components, got[2].score_breakdown) == ([], [], {})
    assert all(x is None for i in (3, 4) for x in (got[i].matched, got[i].components, got[i].score_breakdown))


def test_orders_of_views(spark):
    jobs = spark.createDataFrame([(1, "2026-01-01", None), (2, "2026-01-03", "2026-01-02"), (3, "2026-01-02", "2026-01-02")], "job_id long, first_seen_date string, applied_date string")
    assert [r.job_id for r in views.newest_first(jobs, "applied_date", "first_seen_date").collect()] == [2, 3, 1]
    assert [r.job_id for r in views.newest_first(jobs, "first_seen_date").collect()] == [2, 3, 1]
    assert [r.job_id for r in views.soonest_first(jobs.withColumnRenamed("first_seen_date", "interview_date")).collect()] == [1, 3, 2]


def test_scorers_get_some_rows_at_a_time(spark):
    jobs = spark.range(4_000).select(F.col("id").alias("job_id"), F.when(F.col("id") == 7, F.repeat(F.lit("y"), 3 << 20)).otherwise(F.repeat(F.lit("x"), 2_000)).alias("description")).coalesce(1)
    size = lambda rows: rows["description"].str.len().groupby(lambda _: 0).transform("sum").astype("float64")
    got = scoring.score_batch(jobs, [("size", size)]).collect()
    assert [r.job_id for r in got] == list(range(4_000)) and {r.model_used for r in got} == {"size"}
    assert got[7].score == 3 << 20 and all(r.score <= scoring.AT_A_TIME for r in got if r.job_id != 7)
    assert not scoring.score_batch(jobs.limit(0), [("size", size)]).count()


def test_frames_of_scorers_stay_small_where_characters_are_wide(spark):
    """One sign beyond 16 bits makes Python hold a text with 4 bytes a character; a frame still has a few MB, however many rows follow."""
    wide = F.concat(F.repeat(F.lit("x"), 50_000), F.lit("\U0001F642"))
    jobs = spark.range(1_500).select(F.col("id").alias("job_id"), wide.alias("description")).coalesce(1)
    held = lambda rows: [float(rows.memory_usage(deep=True).sum())] * len(rows)
    got = scoring.score_batch(jobs, [("held", held)]).collect()
    assert len(got) == 1_500 and 200_000 < max(r.score for r in got) <= 5 << 20


def test_a_chain_scores_each_frame_by_itself(spark):
    """A scorer that raises or gives too few scores for one frame fails for the rows of that frame alone."""
    jobs = spark.range(900).select(F.col("id").alias("job_id"), F.repeat(F.lit("x"), 5_000).alias("description")).coalesce(1)

    def first(rows):
        if 0 in set(rows["job_id"]):
            raise ValueError("a long reason, " * 9)
        return rows["job_id"].where(rows["job_id"] % 3 == 0)

    def second(rows):
        return rows["job_id"][1:] if 899 in set(rows["job_id"]) else rows["job_id"].where(rows["job_id"] % 2 == 0)

    got = {r.job_id: r for r in scoring.score_batch(jobs, [("first", first), ("second", second)]).collect()}
    assert got[1].error == "second: no score" and (got[0].model_used, got[0].score, got[0].error) == ("second", 0.0, None)
    assert got[898].error.startswith("second: ") and got[898].error != "second: no score" and got[898].score is None
    assert (got[897].model_used, got[897].score) == ("first", 897.0) and len(got) == 900
    alone = {r.job_id: r.error for r in scoring.score_batch(jobs, [("first", first)]).collect()}
    assert alone[0] == "first: " + "a long reason, " * 9 and alone[899] == "first: no score"
