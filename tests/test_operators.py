"""Known rows, invariants and brute force."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobgrain.functions import text
from jobgrain.operators import analytics, filters, ingest, parse, scoring, store, tracking, views
from jobgrain.plans import search_plan
from jobgrain.plans.fixtures import AS_OF, KEYWORDS, shape
from jobgrain.sources import pages, tables
from jobgrain.streaming import jobs as streams

KW = filters.Keywords.from_config({
    "title_domain_keywords": ["machine learning", "data"], "title_role_keywords": ["engineer", "developer"], "title_standalone_keywords": ["graduate"], "title_required_phrases": ["machine learning engineer"], "title_exclude_keywords": ["hr"],
    "false_positive_patterns": [r"\bai\b.*\bsales\b"], "acronym_mappings": {"ml": "machine learning engineer", "ai": "artificial intelligence data"}, "dealbreakers": {"exclude_seniority": "Senior, Lead"}, "description_required_keywords": ["python", "sql"], "strong_keywords": ["pytorch"]})


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("name,want", [("Company Pty Ltd", "company"), ("Company Inc.", "company"), ("Company    Name", "company name"), ("Abyss Solutions Ltd", "abyss solutions"), ("Acme Pty Limited", "acme pty"), (None, ""), ("  X  GmbH ", "x")])
def test_company_names(spark, name, want):
    assert one(spark, text.normalize_company(F.col("c")), c=name) == want


def test_company_names_strict_off(spark):
    assert one(spark, text.normalize_company(F.col("c"), strict=False), c="Acme Pty Limited") == "acme"


@pytest.mark.parametrize("title,ok,rule", [
    ("ML Engineer", True, "phrase"), ("Graduate Software Engineer", True, "standalone"), ("Infrastructure Engineer", False, "role_only"), ("AI Sales Engineer", False, "false_positive"), ("Maintenance Engineer", True, "domain_role"),
    ("Senior Data Engineer", False, "seniority"), ("Seniority Data Engineer", True, "domain_role"), ("Chrome Data Engineer", False, "title_exclude"), ("Data", False, "domain_only"), ("Cook", False, "none"), (None, False, "none")])
def test_title_rules(spark, title, ok, rule):
    r = filters.title_filter(spark.createDataFrame([(title,)], "title string"), KW).first()
    assert (r.tier1_pass, r.tier1_rule) == (ok, rule)


def test_title_rules_by_word_and_legacy(spark):
    df = spark.createDataFrame([("Chrome Data Engineer",)], "title string")
    assert filters.title_filter(df, KW, match="word").first().tier1_pass
    legacy = filters.Keywords(domain=("data",))
    assert filters.title_filter(df, legacy).first().tier1_rule == "legacy"
    assert filters.title_filter(df, KW, enabled=False).first().tier1_pass


def test_quality(spark):
    long = "x" * 100
    rows = ["short python sql", f"{long} Python and SQL", f"{long} PyTorch", f"{long} python", None]
    got = filters.quality_filter(spark.createDataFrame([(r,) for r in rows], "description string"), KW).collect()
    assert [r.tier3_pass for r in got] == [False, True, True, False, False]


def test_page_rates(spark):
    board = [(15, 1), (15, 0), (15, 2), (15, 2), (15, 0), (1, 0)]
    flags = spark.createDataFrame([(p, i < cut, False, False) for p, (cards, cut) in enumerate(board) for i in range(cards)], "page int, tier1_cut boolean, tier2_cut boolean, tier3_cut boolean")
    total = filters.filter_metrics(flags).first()
    assert (total.seen, total.tier1, total.tier1_rate, total.efficiency) == (76, 5, "6.6", "6.6")
    assert {r.page: r.tier1_rate for r in filters.filter_metrics(flags, "page").collect()}[2] == "13.3"


def test_scores(spark):
    parts = [("yes", 20.0), ("yes", 15.0), ("partial", 25.0), ("no", 15.0), ("yes", 10.0)]
    df = spark.createDataFrame([([("n", "c", m, "high", w, "") for m, w in parts],)], f"c {scoring.COMPONENTS}")
    assert df.select(scoring.component_score(F.col("c"))).first()[0] == 57.5
    f = dict(zip(scoring.FACTOR_LIMITS, map(F.lit, (20.0, 25.0, 12.0, 15.0, 8.0)), strict=True))
    assert spark.range(1).select(scoring.hireability_score(**f)).first()[0] == 80
    final = lambda gate: spark.range(1).select(scoring.final_score(F.lit(75.0), F.lit(80.0), F.lit(gate).cast("string")).alias("s")).select("s", scoring.tier(F.col("s"))).first()
    assert tuple(final(None)) == (77.0, "APPLY") and tuple(final("gate")) == (0.0, "SKIP")


def test_parser(spark):
    ad = "Join our hybrid team, 3 days in office, in Melbourne. Junior developer with a masters degree; 0-2 years of professional experience.\nMachine learning, computer vision and object detection with PyTorch and Python required. LangChain and MLOps. Mentorship and career growth."
    cfg = parse.ParserConfig(skills=("python", "pytorch", "sql"), strong=("python", "pytorch"))
    r = parse.parse_postings(spark.createDataFrame([(ad, "Developer", "Melbourne")], "description string, title string, location string"), cfg).first()
    assert r.suitable and r.reasons == [] and r.graduate.seniority_level == "Junior/Entry-level" and r.graduate.years_required is None and r.graduate.masters_mentioned and r.graduate.keywords == ["junior"]
    assert r.domain.primary_domain == "Machine Learning" and r.domain.domains_present == ["Machine Learning", "Computer Vision", "Agentic AI", "MLOps"]
    assert r.domain.domain_keywords == ["langchain", "computer vision", "object detection", "machine learning", "mlops"]
    assert r.tech.required == ["python", "pytorch"] and r.tech.match_percentage == 100 and r.tech.strong_present == ["python", "pytorch"]
    assert (r.place.primary_city, r.place.remote_type, r.place.remote_days, r.place.preference) == ("Melbourne", "Hybrid", 3, 90)
    assert r.company_signals.mentorship and r.company_signals.growth and r.company_signals.team_size is None and r.confidence == 0.85


def test_parser_of_empty_text(spark):
    r = parse.parse_postings(spark.createDataFrame([(None, None, None)], "description string, title string, location string"), parse.ParserConfig()).first()
    assert r.reasons == ["No description provided"] and r.confidence == 0.0 and not r.suitable


def test_senior_titles(spark):
    cfg = parse.ParserConfig()
    rows = [("Senior Engineer", "code", 1), ("Senior or Junior Engineer", "code", 0), ("Junior to Senior Engineer", "code", 1), ("Senior Engineer", "with a junior", 0), ("Engineer", "a lead designer", 1), ("Engineer", "12 years experience", 1), ("Engineer", "2 years experience", 0)]
    df = spark.createDataFrame(rows, "t string, d string, n int")
    assert all(r.k == r.n for r in df.select("n", F.size(parse.dealbreakers(F.col("d"), F.lower("t"), cfg)).alias("k")).collect())


WORDS = st.text(alphabet="ab, .é", max_size=24)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS, WORDS), min_size=1, max_size=12))
def test_text_functions_restated(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, u string")
    got = df.select("*", text.fuzzy_match(F.col("a"), F.col("b"), 5000).alias("m"), text.job_hash(F.col("a"), F.col("b"), F.col("u")).alias("h"), text.normalize_company(F.col("b")).alias("n")).collect()
    for r in got:
        x, y = (re.sub(r"[^\w\s]", "", s).strip() for s in (r.a, r.b))
        p, q = set(x.split()), set(y.split())
        assert r.m == (x == y or bool(p and q and 2 * len(p & q) >= len(p | q)))
        assert r.n == re.sub(r"\s+", " ", r.b.lower()).strip()
        assert r.h == hashlib.sha256(f"{r.a}|{r.n}|{r.u}".lower().encode()).hexdigest()


@pytest.mark.parametrize("points", [8500, 6000])
def test_fuzzy_join_is_brute_force(spark, points):
    import random

    rng = random.Random(points)
    title = lambda: " ".join(rng.choices("data engineer ml ops lead junior remote platform cloud x y z".split(), k=rng.randrange(0, 9)))
    rows = [(i, title(), rng.choice(["Acme Ltd", "acme", "Data Cloud Works", "Unknown", None]), f"u{i}", rng.choice("ab")) for i in range(160)]
    df = spark.createDataFrame(rows, "job_id long, title string, company string, url string, source string")
    new, old = df.where("job_id % 2 = 1"), df.where("job_id % 2 = 0")
    got = {(r.new_key, r.existing_key) for r in ingest.match_existing_fuzzy(new, old, points, None).collect()}

    def alike(a, b):
        p, q = set(a.split()), set(b.split())
        return a.strip() == b.strip() or bool(p and q and 10000 * len(p & q) >= points * len(p | q))

    norm = lambda c: re.sub(r"\s+ltd$", "", (c or "").lower())
    assert got == {(a[0], b[0]) for a in rows if a[0] % 2 for b in rows if b[0] % 2 == 0 if alike(a[1], b[1]) and alike(norm(a[2]), norm(b[2]))}


def test_ingest_is_idempotent(spark, sf):
    p = shape(spark, sf, "postings").withColumn("job_id_hash", text.job_hash(F.col("title"), F.col("company"), F.col("url")))
    once = store.insert_new(p.where("job_id % 2 = 0"), p.where("job_id % 2 = 1"), AS_OF)
    assert store.insert_new(once, p.where("job_id % 2 = 1"), AS_OF).count() == once.count()
    assert once.where("job_id % 2 = 1").groupBy("job_id_hash").count().where("count > 1").count() == 0
    c = ingest.classify_ingest(p.where("job_id % 2 = 1").drop("job_id_hash"), p.where("job_id % 2 = 0").drop("job_id_hash"), KEYWORDS, as_of=AS_OF)
    assert c.where("outcome = 'new' AND NOT tier3_pass").count() == 0 and ingest.ingest_accounting(c).first().adds_up


def test_mark_inactive_guard(spark):
    jobs = spark.createDataFrame([("h1", "s1", True), ("h2", "s1", True), ("h3", "s2", True), ("h4", "s3", True)], "job_id_hash string, source_search_id string, is_active boolean")
    seen = jobs.where("job_id_hash = 'h1'")
    searches = spark.createDataFrame([("s1", True), ("s2", True), ("s3", False)], "id string, enabled boolean")
    state = lambda **k: {r.job_id_hash: r.is_active for r in store.mark_inactive(jobs, seen, searches, **k).collect()}
    assert state() == {"h1": True, "h2": False, "h3": False, "h4": True}
    assert state(require_nonempty=True) == {"h1": True, "h2": False, "h3": True, "h4": True}


def test_stream_over_batches_takes_each_hash_once(spark, sf, tmp_path):
    p = shape(spark, sf, "postings")
    new = p.where("job_id % 2 = 1")
    source = str(tmp_path / "in")
    for i in range(3):  # the second file repeats the first
        new.where(f"seq % 3 = {i if i != 1 else 0}").coalesce(1).write.mode("append").parquet(source)
    out = str(tmp_path / "out")
    for _ in range(2):  # a second start has nothing left to do
        streams.stream_ingest(streams.files_stream(spark, source, new, 1), p.where("job_id % 2 = 0"), out, KEYWORDS, AS_OF, str(tmp_path / "state")).awaitTermination()
    taken = spark.read.parquet(f"{out}/accepted")
    assert taken.count() and taken.groupBy("job_id_hash").count().where("count > 1").count() == 0
    assert spark.read.parquet(f"{out}/outcomes").agg(F.sum("n")).first()[0] == spark.read.parquet(source).count()


def test_profile_changes(spark):
    log = spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-01-02")], "profile_hash string, changed_at string")
    told = lambda df, h: tuple(tracking.profile_changed(df, h).first())
    assert told(log, "b") == (False, False, False) and told(log, "a") == (True, False, True) and told(log, None) == (False, False, False) and told(log.where("false"), "a") == (True, True, True)


def test_views_of_nulls(spark):
    df = spark.createDataFrame([(None, None), ("Remote - Perth WA", "us"), ("Sydney (Hybrid)", None)], "location string, region string")
    got = df.select(*(views.location_matches(F.col("location"), m) for m in ("perth", "australia", "world")), views.region_matches(F.col("region"), "australia")).collect()
    assert [tuple(r) for r in got] == [(False, False, False, True), (True, True, True, False), (False, True, False, True)]
    assert spark.range(1).select(analytics.date_bucket(F.to_date(F.lit("2026-03-01")), AS_OF)).first()[0] == "-1 days ago"


CARDS = """<html><body><article data-testid="job-card"><h3><a data-automation="jobTitle" href="/job/12?ref=x">Data <b>Engineer</b></a></h3><span data-automation="jobAdvertiser">Acme</span></article>
<article data-testid="job-card"><a data-automation="jobTitle" href="https://x.example/job/13">Dev</a><span data-automation="jobCompany"> </span><a data-automation="jobLocation">Perth</a></article>
<article data-testid="job-card"><p>no title</p></article></body></html>"""


def test_cards(spark):
    p = spark.createDataFrame([(1, "u", CARDS), (2, "u", None), (3, "u", "<article data-automation='normalJob'><h3><a href='/a'>T</a></h3>")], "page_id long, url string, html string")
    cards = pages.extract_cards(p, pages.SEEK)
    assert sorted((r.page_id, r.card_idx) for r in cards.collect()) == [(1, 0), (1, 1), (1, 2), (3, 0)]
    got = {(r.page_id, r.card_idx): r for r in pages.extract_fields(cards, pages.SEEK).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (3, 0)]
    assert (got[1, 0].title, got[1, 0].company, got[1, 0].location, got[1, 0].url) == ("Data Engineer", "Acme", "Australia", "https://www.seek.com.au/job/12")
    assert (got[1, 1].company, got[1, 1].location, got[1, 1].url) == ("Unknown", "Perth", "https://x.example/job/13")


def test_searches_in_three_shapes(spark, tmp_path):
    files = {"a": '{"linkedin": [{"id": "1", "name": "n", "url": "u", "enabled": true}],\n "seek": [{"id": "2", "url": "v", "enabled": false}]}', "b": '{"jora": [{"search_id": "j", "url": "w", "keyword": "k"}]}', "c": '{"searches": [{"id": "3", "url": "z", "enabled": true, "region": "us", "source": "seek"}]}'}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(body)
    got = sorted((r.id, r.region, r.source) for r in tables.read_searches(spark, [str(tmp_path / f"{n}.json") for n in files]).collect())
    assert got == [("1", "australia", "linkedin"), ("3", "us", "seek"), ("j", "australia", "jora")]


def test_paginate(spark):
    df = spark.createDataFrame([("linkedin", "https://l/?k=a&start=50"), ("linkedin", "https://l/x"), ("seek", "https://s/x")], "source string, url string")
    got = [r.page_url for r in search_plan.paginate(df, 2).collect()]
    assert got == ["https://l/?k=a&start=0", "https://l/?k=a&start=25", "https://l/x?start=0", "https://l/x?start=25", "https://s/x", "https://s/x?page=2"]


def test_scorer_chain_survives_errors(spark):
    def broken(rows):
        raise ValueError("no")

    got = scoring.score_batch(spark.createDataFrame([(1, "a"), (2, None)], "job_id long, t string"), [("broken", broken), ("length", lambda rows: rows["t"].str.len())]).collect()
    assert sorted((r.job_id, r.score if r.model_used else None, r.model_used, r.error) for r in got) == [(1, 1.0, "length", None), (2, None, None, "length: no score")]
