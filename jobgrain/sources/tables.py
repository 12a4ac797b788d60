"""Tables of the store with fixed schemas, and what goes out as files."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> columns as 'name type [= default]'. Columns that a file lacks are added; nulls become the default.
TABLES = {
    "jobs": """job_id long, job_id_hash string, title string, company string, location string, description string, requirement_text string, url string, posted_date string, employment_type string, source_search_id string,
        source string = linkedin, region string = australia, first_seen_date date, last_seen_date date, is_active boolean = true, applied boolean = false, rejected boolean = false, status string = new, applied_date date, rejected_date date,
        remarks string, created_at timestamp, interview_date date, interview_type string, offer_date date, offer_amount double, offer_currency string = AUD, decision_date date, follow_up_date date, priority int = 0, notes string,
        job_age string, seniority_level string, job_function string, industries string, skills string""",
    "scores": """score_id long, job_id long, score int, reasoning string, matched string, not_matched string, key_points string, model_used string, profile_hash string, scored_at timestamp, components string, score_breakdown string,
        recommendation string, hard_gate_failed string, risk_profile string, hireability_factors string, explanation string, scoring_method string = legacy""",
    "notifications": "id long, job_id long, notification_type string, sent_at timestamp, status string",
    "profile_changes": "id long, profile_hash string, changed_at timestamp, rescore_triggered boolean = false",
    "rejections": "id long, job_id long, rejection_category string, rejection_notes string, rejected_at timestamp",
    "status_history": "id long, job_id long, old_status string, new_status string, changed_at timestamp, notes string",
    "interview_notes": "id long, job_id long, interview_date date, interview_type string, interviewer_name string, topics_discussed string, questions_asked string, my_performance string, next_steps string, notes string, created_at timestamp",
    "scraping_runs": """run_id long, run_timestamp timestamp, platform string, search_name string, search_url string, pages_scraped int = 0, total_cards_seen long = 0, tier1_filtered long = 0, tier2_skipped long = 0, tier3_filtered long = 0,
        jobs_collected long = 0, efficiency_percent double, duration_seconds double, page_details string, error_message string, created_at timestamp""",
}


def columns_of(name: str) -> list[tuple[str, str, str | None]]:
    out = []
    for part in TABLES[name].split(","):
        field, _, default = part.partition("=")
        column, kind = field.split()
        out.append((column, kind, default.strip() or None))
    return out


def with_schema(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the table's columns and types: missing ones added, nulls replaced by defaults, others dropped."""
    out = []
    for column, kind, default in columns_of(name):
        value = F.col(column).try_cast(kind) if column in df.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(value, F.lit(default).cast(kind)) if default is not None else value).alias(column))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """A table from parquet, json, csv (with a header) or jdbc (see read_jdbc; path is the url). Files without a column read as if
    it were null."""
    if fmt == "jdbc":
        return read_jdbc(spark, path, name, **options)
    if fmt in ("json", "csv"):
        schema = ", ".join(f"{c} {k}" for c, k, _ in columns_of(name))
        reader = spark.read.options(**({"header": "true", "enforceSchema": "false"} if fmt == "csv" else {}), **options)
        return with_schema(reader.csv(path) if fmt == "csv" else reader.schema(schema).json(path), name)
    return with_schema(spark.read.format(fmt).options(**options).load(path), name)


def read_jdbc(spark: SparkSession, url: str, name: str, split: str | None = None, partitions: int = 8, where: str | None = None, **options) -> DataFrame:
    """A table of a database, read in so many ranges of a number, date or timestamp at once: the table's first column unless split
    names another. The ends of the ranges are asked of the database; rows below, above or without a value are in the
    first and last range. where is a condition on stored columns, which the database answers, as it does the choice of
    columns. options go to Spark's jdbc source (driver, user, fetchsize; dbtable where the table has another name)."""
    given = {"url": url, "dbtable": name, **options}
    split = split or columns_of(name)[0][0]
    stored = spark.read.format("jdbc").options(**given).load()
    low, high = stored.agg(F.min(split), F.max(split)).first()  # pushed down: one row comes back
    if low is not None and low != high:
        ends = {"partitionColumn": split, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
        stored = spark.read.format("jdbc").options(**given, **ends).load()
    return with_schema(stored if where is None else stored.where(where), name)


_SEARCH = "id string, search_id string, name string, url string, enabled boolean, region string, source string, keyword string, location string"


def read_searches(spark: SparkSession, paths: list[str], boards: tuple[str, ...] = ("linkedin", "seek", "jora"), multi_line: bool = True) -> DataFrame:
    """id, name, url, region, source, keyword, location of the enabled searches in JSON files of any of three shapes: one
    list a board, generated searches with a search_id, or one list of 'searches'. Regions default to
    australia. multi_line=False reads one such object a line."""
    item = f"array<struct<{_SEARCH.replace(' string', ':string').replace(' boolean', ':boolean')}>>"
    raw = spark.read.schema(", ".join(f"{n} {item}" for n in (*boards, "searches"))).json(paths, multiLine=multi_line)
    parts = [raw.select(F.explode(n).alias("s"), F.lit(n).alias("board")) for n in (*boards, "searches")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    s = rows.select(F.coalesce("s.id", "s.search_id").alias("id"), "s.name", "s.url", F.coalesce("s.enabled", F.lit(True)).alias("enabled"), F.coalesce("s.region", F.lit("australia")).alias("region"), F.coalesce("s.source", F.when(F.col("board") != "searches", F.col("board"))).alias("source"), "s.keyword", "s.location")
    return s.where("enabled").drop("enabled")


def run_log(runs: DataFrame) -> DataFrame:
    """Run rows as they are logged: percents and durations to one decimal, nested and internal columns left out."""
    one = lambda c: F.format_string("%.1f", F.round(F.coalesce(F.col(c), F.lit(0.0)), 1)).alias(c)
    rest = [c for c in runs.columns if c not in ("page_details", "created_at", "search_url", "efficiency_percent", "duration_seconds")]
    return runs.select(*rest, one("efficiency_percent"), one("duration_seconds"))


def run_key(rows: DataFrame) -> str:
    """The key of a run's rows: their number and a sum of their hashes, which a long holds for some 17 million rows alone."""
    mark = F.xxhash64(*rows.columns).bitwiseAND(F.lit(0xFFFFFFFFFF)).cast("decimal(13,0)")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(mark), F.lit(0))).first()
    return f"{n}-{int(total):x}"


def run_log_append(runs: DataFrame, path: str, run: str | None = None) -> str:
    """Logs run rows as CSV with a header in a folder of their run, path/run=KEY, which it replaces; the key.

    The same append twice leaves one copy, and runs with different keys may be logged at the same time. Without a key it is
    made of the rows (their number and a sum of their hashes), so equal rows are one run and others are another.
    """
    rows = run_log(runs)
    run = run_key(rows) if run is None else run
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/run={quote(run, safe='')}")
    return run


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """All logged run rows, as text, with the key of their run."""
    return spark.read.option("header", True).option("inferSchema", False).option("recursiveFileLookup", False).csv(path).withColumn("run", F.col("run").cast("string"))


def recent_log(runs: DataFrame, as_of, days: int = 30, limit: int = 10_000) -> DataFrame:
    """The log of the last days, newest first."""
    at = F.lit(as_of).cast("timestamp")
    return run_log(runs.where(F.col("run_timestamp") >= at - F.make_interval(days=F.lit(days))).orderBy(F.desc("run_timestamp"), "run_id").limit(limit))


def export_runs(runs: DataFrame, path: str, as_of, days: int = 30) -> None:
    recent_log(runs, as_of, days).write.mode("overwrite").option("header", True).csv(path)


def matches_to_export(jobs: DataFrame, scores: DataFrame, threshold: int = 70) -> DataFrame:
    """title, company, location, source, score, first_seen_date, url of jobs at or above threshold."""
    return jobs.join(scores.where(F.col("score") >= threshold).select("job_id", "score"), "job_id").select("title", "company", "location", "source", "score", "first_seen_date", "url")


def export_matches(jobs: DataFrame, scores: DataFrame, path: str, threshold: int = 70) -> None:
    matches_to_export(jobs, scores, threshold).orderBy(F.desc("score"), "title", "company", "url").write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
