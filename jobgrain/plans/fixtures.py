"""The shapes of the library's tables over the given ones: each column is one expression that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobgrain.operators.filters import Keywords

AS_OF = "2026-02-28"
_DAY = f"DATE '{AS_OF}'"
_FIRST_SEEN = f"({_DAY} - CAST(doc_id % 45 AS INT))"
STATUSES = ("new", "interested", "applied", "phone_screen", "interview_scheduled", "interviewed", "offer_received", "accepted", "declined_offer", "rejected", "withdrawn", "on_hold", "archived")
_TITLE = "substr(split_part(text, chr(10), 1), 1, 80)"


def _case(key: str, values, otherwise: str | None = None) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + (f" ELSE {otherwise}" if otherwise else "") + " END"


#: name -> (given table, {column: expression}, condition)
SHAPES: dict[str, tuple[str, dict[str, str], str]] = {
    "postings": ("documents", {
        "seq": "doc_id", "job_id": "doc_id",
        "title": f"CASE WHEN doc_id % 4 = 1 THEN regexp_replace({_TITLE}, ' [^ ]*$', '') ELSE {_TITLE} END",
        "company": "'Firm ' || CAST(CAST(floor(doc_id / 2) AS BIGINT) % 3 AS STRING) || " + _case("doc_id % 5", (" Pty Ltd", " Pty. Ltd.", "  Inc.", "", " Pty Limited")),
        "url": "'https://board.example/jobs/view/' || substr(md5(text), 1, 12)", "description": "text",
        "source": _case("doc_id % 3", ("seek", "jora", "linkedin")), "region": "CASE WHEN doc_id % 5 = 0 THEN 'us' ELSE 'australia' END",
        "location": _case("doc_id % 6", ("Perth WA", "Melbourne VIC (Hybrid)", "Remote, Australia", "Sydney NSW", "Remote - United States")),
        "source_search_id": "'s' || CAST(doc_id % 8 AS STRING)",
        "first_seen_date": _FIRST_SEEN, "last_seen_date": f"least({_FIRST_SEEN} + CAST(doc_id % 5 AS INT), {_DAY})",
        "is_active": "doc_id % 11 <> 0", "applied": "doc_id % 13 = 0", "rejected": "doc_id % 17 = 0",
        "status": _case("doc_id % 13", STATUSES), "applied_date": f"CASE WHEN doc_id % 13 = 0 THEN {_FIRST_SEEN} + 1 END", "rejected_date": f"CASE WHEN doc_id % 17 = 0 THEN {_FIRST_SEEN} + 2 END",
        "created_at": f"CAST({_FIRST_SEEN} AS TIMESTAMP)", "priority": "CAST(doc_id % 3 AS INT)"}, "true"),
    "scores": ("documents", {
        "score_id": "doc_id", "job_id": "doc_id", "score": "CAST((doc_id * 37 + 11) % 101 AS INT)", "profile_hash": _case("doc_id % 3", ("p1", "p2")),
        "recommendation": "CASE WHEN (doc_id * 37 + 11) % 101 >= 70 THEN 'APPLY' WHEN (doc_id * 37 + 11) % 101 >= 50 THEN 'CLARIFY' ELSE 'SKIP' END",
        "scoring_method": _case("doc_id % 4", ("hybrid", "component_based", "hireability_based", "legacy")), "model_used": _case("doc_id % 2", ("model-a", "model-b")),
        "matched": """CASE WHEN doc_id % 19 = 0 THEN '{bad' WHEN doc_id % 23 = 0 THEN NULL ELSE '["python","' || source || '"]' END""",
        "key_points": """CASE WHEN doc_id % 19 = 0 THEN '{bad' ELSE '["k' || CAST(doc_id % 7 AS STRING) || '","x"]' END""",
        "hard_gate_failed": "CASE WHEN doc_id % 10 = 3 THEN 'clearance' END", "session_id": "'run' || CAST(doc_id % 4 AS STRING)", "latency_ms": "CAST(100 + doc_id % 900 AS DOUBLE)",
        "m0": _case("doc_id % 3", ("yes", "partial", "no")), "m1": _case("(doc_id + 1) % 3", ("yes", "partial", "no")), "m2": _case("(doc_id + 2) % 3", ("yes", "partial", "no")),
        "f0": "CAST(doc_id % 26 AS DOUBLE)", "f1": "CAST(doc_id % 28 AS DOUBLE)", "f2": "CAST(doc_id % 16 AS DOUBLE)", "f3": "CAST(doc_id % 17 - 1 AS DOUBLE)", "f4": "CAST(doc_id % 11 AS DOUBLE)",
        "scored_at": f"CAST({_FIRST_SEEN} + 1 AS TIMESTAMP)"}, "doc_id % 7 <> 0"),
    "adverts": ("documents", {
        "job_id": "doc_id", "title": _case("doc_id % 6", ("Senior ML Engineer", "Graduate Data Scientist", "Lead or Junior Analyst", "Software Engineer", "Manager", "Associate Engineer")),
        "location": _case("doc_id % 4", ("Perth WA", "Remote, Australia", "Melbourne")),
        "description": "CASE WHEN doc_id % 25 = 7 THEN '' ELSE text || ' | ' || " + _case("doc_id % 9", (
            "We want a Senior Developer with 5+ years of professional experience.", "Graduate program for new graduate hires, masters degree preferred.", "Entry-level role, 0-1 years of experience.", "Must hold security clearance. Visa sponsorship available.",
            "Machine learning and deep learning with PyTorch required. Nice to have: Docker.", "Hybrid, 3 days in office in Perth. An LLM and RAG with LangChain.", "Fully remote in Australia, an established enterprise.", "PhD required. A 12-person ML team at a startup.", "Series D, on your way."))
            + " || chr(10) || " + _case("doc_id % 5", ("Python is essential. Mentorship and career growth.", "Python preferred. SQL is a plus.", "Work with junior staff, 2 years experience.", "Computer vision with YOLO, then MLOps and model deployment.", "Nothing else.")) + " END"}, "true"),
    "notifications": ("documents", {"job_id": "doc_id", "notification_type": "'email'", "status": "'sent'"}, "doc_id % 9 = 0"),
    "rejections": ("documents", {"job_id": "doc_id", "rejection_category": _case("doc_id % 4", ("visa", "experience", "skills", "other")), "nth": "1"}, "doc_id % 17 = 0"),
    "rejections_again": ("documents", {"job_id": "doc_id", "rejection_category": "'second'", "nth": "2"}, "doc_id % 34 = 0"),
    "status_history": ("events", {
        "id": "event_id", "job_id": "user_id", "changed_at": "ts", "note": "props",
        "new_status": "CASE event_type WHEN 'view' THEN 'interested' WHEN 'click' THEN 'applied' WHEN 'signup' THEN 'interview_scheduled' WHEN 'purchase' THEN 'offer_received' ELSE 'rejected' END"}, "true"),
    "interviews": ("orders", {
        "id": "o_orderkey", "job_id": "o_orderkey % 1000", "interview_date": f"({_DAY} + CAST(o_orderkey % 60 AS INT) - 20)", "interview_type": "o_orderpriority", "created_at": "o_orderdate"}, "true"),
    "runs": ("lineitem", {
        "run_id": "l_orderkey * 10 + l_linenumber", "run_timestamp": "l_shipdate", "platform": "CASE l_returnflag WHEN 'A' THEN 'linkedin' WHEN 'N' THEN 'seek' ELSE 'jora' END", "search_name": "l_linestatus",
        "pages_scraped": "l_linenumber", "total_cards_seen": "CAST(floor(l_quantity) AS BIGINT)", "tier1_filtered": "CAST(floor(l_quantity * l_discount) AS BIGINT)", "tier2_skipped": "CAST(floor(l_quantity * l_tax) AS BIGINT)", "tier3_filtered": "CAST(0 AS BIGINT)",
        "duration_seconds": "l_extendedprice / 100"}, "true"),
}

KEYWORDS = Keywords(
    false_positive_patterns=("(the|of)[ ]+(and|in)",), exclude_seniority=("was", "les", "und"), title_exclude=("shwh", "spam"), exclude=("cookie", "laleen"),
    required_phrases=("it is", "de la"), standalone=("hea", "auf"), domain=("tion", "ment"), role=("er", "ing"), acronyms={"anea": "it is", "ndst": "hea"},
    description=("thanedble", "onon", "eaux", "ieren", "ción"), strong=("attion",), threshold=2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A library table over a given one; only the columns that are used are read."""
    given, columns, condition = SHAPES[name]
    return table(spark, sf_dir, given).where(condition).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def all_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "rejections").unionByName(shape(spark, sf_dir, "rejections_again"))


def searches(spark: SparkSession) -> DataFrame:
    return spark.range(8).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), (F.col("id") < 7).alias("enabled"))


def ctes(*names: str) -> str:
    """'WITH a AS (...), b AS (...)' with the same tables as shape()."""
    parts = []
    for name in names:
        if name == "searches":
            parts.append("searches AS (SELECT 's' || CAST(i AS VARCHAR) AS id, i < 7 AS enabled FROM generate_series(0, 7) AS t(i))")
            continue
        given, columns, condition = SHAPES[name]
        select = ", ".join(f"{e.replace('AS STRING)', 'AS VARCHAR)')} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {select} FROM {given} WHERE {condition})")
    if "rejections_again" in names:
        parts.append("all_rejections AS (SELECT * FROM rejections UNION ALL SELECT * FROM rejections_again)")
    return "WITH " + ",\n".join(parts)
