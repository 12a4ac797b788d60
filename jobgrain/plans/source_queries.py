"""Queries of the sources, the search plan and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrain.functions.scratch import scratch
from jobgrain.operators import analytics
from jobgrain.plans import search_plan
from jobgrain.plans.fixtures import AS_OF, KEYWORDS, ctes, shape, table
from jobgrain.plans.ingest_queries import _CLASSIFY_SQL, _HASH, existing
from jobgrain.plans.registry import register
from jobgrain.plans.view_queries import _R, _RUN_DAY, scores
from jobgrain.sources import pages, tables
from jobgrain.streaming import jobs as streams


def through_file(df, spark, fmt="parquet", **options):
    """df written to the shared folder; the path."""
    path = scratch(spark, "table")
    writer = df.write.options(**options)
    (writer.csv if fmt == "csv" else writer.json if fmt == "json" else writer.parquet)(path)
    return path


def _read_back(fmt):
    def run(s, d):
        sent = shape(s, d, "postings").select("job_id", "title", "location", F.when(F.col("job_id") % 3 == 0, F.col("status")).alias("status"), "is_active", "first_seen_date")
        path = through_file(sent.withColumn("title", F.regexp_replace("title", '["\\\\]', "")), s, fmt, **({"header": "true"} if fmt == "csv" else {}))
        return tables.read_table(s, path, "jobs", fmt).select("job_id", F.coalesce("location", F.lit("-")).alias("location"), "source", "region", "status", "is_active", "applied", "priority", "offer_currency", "first_seen_date")
    return run


for _fmt in ("parquet", "json", "csv"):
    register(f"read_table_{_fmt}", _read_back(_fmt), ctes("postings") + "\nSELECT job_id, coalesce(location, '-') AS location, 'linkedin' AS source, 'australia' AS region, CASE WHEN job_id % 3 = 0 THEN status ELSE 'new' END AS status, is_active, false AS applied, 0 AS priority, 'AUD' AS offer_currency, CAST(CAST(first_seen_date AS DATE) AS VARCHAR) AS first_seen_date FROM postings")


def _searches(s, d):
    p = shape(s, d, "postings")
    item = F.struct(F.concat(F.lit("x"), F.col("job_id").cast("string")).alias("id"), "title", (F.col("job_id") % 4 != 0).alias("enabled"), "url")
    by_board = p.where("job_id % 2 = 0").groupBy(F.floor(F.col("job_id") / 100).alias("k")).agg(*(F.collect_list(F.when(F.col("source") == b, item)).alias(b) for b in ("linkedin", "seek", "jora"))).drop("k")
    made = p.where("job_id % 2 = 1").select(F.array(F.struct(F.concat(F.lit("g"), F.col("job_id").cast("string")).alias("search_id"), F.col("title").alias("keyword"), "url", "source")).alias("searches"))
    return tables.read_searches(s, [through_file(by_board, s, "json"), through_file(made, s, "json")], multi_line=False).select("id", "region", "source", "url")


register("read_searches", _searches, ctes("postings") + "\nSELECT CASE WHEN job_id % 2 = 0 THEN 'x' ELSE 'g' END || job_id AS id, 'australia' AS region, source, url FROM postings WHERE job_id % 2 = 1 OR job_id % 4 <> 0")
_LOG = ("run_id", "platform", "jobs_collected", "efficiency_percent", "duration_seconds")


def _logged(s, d):
    r = analytics.run_row(shape(s, d, "runs")).withColumns({"page_details": F.lit("[]"), "created_at": F.col("run_timestamp"), "search_url": F.lit("u")})
    path = scratch(s, "log")
    tables.run_log_append(r.where("run_id % 2 = 0"), path)
    tables.run_log_append(r.where("run_id % 2 = 1"), path)
    tables.run_log_append(r.where("run_id % 2 = 1"), path)  # a rerun
    return tables.read_run_log(s, path).select(F.col("run_id").cast("long").alias("run_id"), "platform", F.col("jobs_collected").cast("long").alias("jobs_collected"), "efficiency_percent", "duration_seconds")


_ONE = "printf('%.1f', round({}, 1))"
register("run_log_append", _logged, _R + f"SELECT run_id, platform, jobs_collected, {_ONE.format('efficiency_percent')} AS efficiency_percent, {_ONE.format('duration_seconds')} AS duration_seconds FROM rr")


def _exported(s, d):
    r = analytics.run_row(shape(s, d, "runs"))
    path = scratch(s, "export")
    tables.export_runs(r, path, _RUN_DAY, 30)
    return s.read.option("header", True).csv(path).select(F.col("run_id").cast("long").alias("run_id"), "platform", "efficiency_percent")


register("export_runs", _exported, _R + f"SELECT run_id, platform, {_ONE.format('efficiency_percent')} AS efficiency_percent FROM (SELECT * FROM rr WHERE run_timestamp >= TIMESTAMP '{_RUN_DAY}' - INTERVAL 30 DAY ORDER BY run_timestamp DESC, run_id LIMIT 10000)")


def _matches(s, d):
    path = scratch(s, "matches")
    tables.export_matches(shape(s, d, "postings"), scores(s, d), path, 70)
    return s.read.option("header", True).csv(path).select("company", "source", F.col("score").cast("int").alias("score"), "url")


register("export_matches", _matches, ctes("postings", "scores") + "\nSELECT company, source, score, url FROM postings p JOIN scores s ON p.job_id = s.job_id WHERE score >= 70")


def _json(s, d):
    path = scratch(s, "json")
    tables.write_json(scores(s, d).select("job_id", "score", F.struct("model_used", "recommendation").alias("by")), path)
    return s.read.schema("job_id long, score int, by struct<model_used:string,recommendation:string>").json(path).select("job_id", "score", "by.model_used", "by.recommendation")


register("write_json", _json, ctes("scores") + "\nSELECT job_id, score, model_used, recommendation FROM scores")

_ARTICLE = r"regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"
#: The article's text: blocks part words, other tags do not.
_UNESCAPED = r"regexp_replace(regexp_replace(regexp_replace(" + _ARTICLE + r", '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)<(/?(p|div|h[1-6]|li|ul|ol|section|article|header|footer|form|aside|nav|table|tr|td|th|blockquote|pre|figure|figcaption)|br|hr)([^a-z0-9>][^>]*)?>', chr(10), 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g')"
for _entity, _character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', '{_character}')"
#: What the SQL's trim() cuts: Unicode's space separators.
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_ENTRIES = pages.BoardSpec(cards=("section.none", "nav li", "li"))
register("extract_cards_many", lambda s, d: pages.extract_cards(table(s, d, "pages"), _ENTRIES).groupBy("page_id").agg(F.count("*").alias("cards"), F.max("card_idx").alias("last"), F.sum(F.length("html")).alias("size")), r"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>.*?</li>')) AS html FROM pages)
SELECT page_id, count(*) AS cards, CAST(count(*) - 1 AS INT) AS last, CAST(sum(length(html)) AS BIGINT) AS size FROM p GROUP BY 1""")
register("extract_cards", lambda s, d: pages.extract_cards(table(s, d, "pages"), pages.ARTICLE).select("page_id", "card_idx", F.length("html").alias("size")), f"SELECT page_id, CAST(0 AS INT) AS card_idx, length({_ARTICLE}) + 19 AS size FROM pages")
register("extract_fields", lambda s, d: pages.extract_records(table(s, d, "pages"), pages.ARTICLE).select("page_id", "url", "company", "location", F.md5(F.regexp_replace("title", " +", " ")).alias("title")),
         r"SELECT page_id, split_part(url, '?', 1) AS url, 'Unknown' AS company, 'Unknown' AS location, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS title FROM pages WHERE regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) <> ''".replace('\\"', '"'))
register("drop_recommended", lambda s, d: pages.drop_recommended(table(s, d, "pages").select("page_id", "html"), ("thanedble", "onon", "ieren")).select("page_id"), "SELECT page_id FROM pages WHERE NOT (contains(lower(html), 'thanedble') OR contains(lower(html), 'onon') OR contains(lower(html), 'ieren'))")
register("page_description", lambda s, d: pages.page_description(table(s, d, "pages"), ("div.none", "article"), 200).select("page_id", F.md5(F.btrim(F.replace("description", F.lit("\n"), F.lit(" ")), F.lit(_SPACES))).alias("description")), f"SELECT page_id, md5(trim(regexp_replace({_UNESCAPED}, '\\s+', ' ', 'g'))) AS description FROM pages")
register("canonical_url", lambda s, d: table(s, d, "pages").select("page_id", pages.canonical_url(F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://[^/]+", "")).when(F.col("page_id") % 7 == 1, F.lit(None)).otherwise(F.col("url")), "https://board.example", F.col("page_id")).alias("url")),
         r"""WITH u AS (SELECT page_id, split_part(CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://[^/]+', '') WHEN page_id % 7 = 1 THEN NULL ELSE url END, '?', 1) AS p FROM pages)
SELECT page_id, CASE WHEN p LIKE '/%' THEN 'https://board.example' || p WHEN p IS NULL OR p = '' THEN 'https://board.example/jobs/view/' || page_id ELSE p END AS url FROM u""")
_MARKED = "CASE doc_id % 6 WHEN 0 THEN text || ' Must Have ' || text WHEN 1 THEN text || 'Requirements: x' || chr(10) || ' Basic Qualifications y ' || text WHEN 2 THEN 'a Minimum Qualifications b ' || text || ' Requirements: c' ELSE text END"
register("split_requirements", lambda s, d: pages.split_requirements(table(s, d, "documents").selectExpr("doc_id", f"{_MARKED} AS text")).select("doc_id", "description", "requirement_text"), "WITH m AS (SELECT doc_id, " + _MARKED + " AS t FROM documents),\nh AS (SELECT *, CASE " + " ".join(f"WHEN contains(t, '{h}') THEN '{h}'" for h in pages.REQUIREMENTS) + r""" END AS h FROM m)
SELECT doc_id, CASE WHEN h IS NULL THEN t ELSE trim(substr(t, 1, instr(t, h) - 1), ' ' || chr(10) || chr(9)) END AS description, CASE WHEN h IS NOT NULL THEN h || chr(10) || trim(substr(t, instr(t, h) + length(h)), ' ' || chr(10) || chr(9)) END AS requirement_text FROM h""")
_CRITERIA = ("Seniority level Associate", "Employment type Full-time", "Job function Engineering", "Industries Software", "Contract", "Entry level")
register("classify_criteria", lambda s, d: pages.classify_criteria(shape(s, d, "postings").select("job_id", F.concat(F.filter(F.array(*(F.when((F.col("job_id") + i) % 3 != 0, F.lit(c)) for i, c in enumerate(_CRITERIA))), lambda x: x.isNotNull()), F.split("description", "\n")).alias("criteria"))).drop("criteria"),
         ctes("postings") + "\nSELECT job_id, CASE WHEN (job_id + 5) % 3 <> 0 THEN 'Entry level' WHEN job_id % 3 <> 0 THEN 'Associate' END AS seniority_level, CASE WHEN (job_id + 4) % 3 <> 0 THEN 'Contract' WHEN (job_id + 1) % 3 <> 0 THEN 'Full-time' END AS employment_type, CASE WHEN (job_id + 2) % 3 <> 0 THEN 'Engineering' END AS job_function, CASE WHEN job_id % 3 <> 0 THEN 'Software' END AS industries FROM postings")
_PANEL = "CASE doc_id % 7 WHEN 0 THEN 'Seniority level:' || chr(10) || ' Director ' WHEN 1 THEN 'Seniority level:' || chr(10) || 'salary 5' WHEN 2 THEN 'an internship program, part time' WHEN 3 THEN 'Employment type:' || chr(10) || 'Casual' || chr(10) || 'Job function:' || chr(10) || 'Design' WHEN 4 THEN 'associate, full-time' WHEN 5 THEN 'Industries:' || chr(10) || 'Mining' || chr(10) || 'contract' ELSE 'associate degree' END"
register("infer_labels", lambda s, d: pages.infer_labels(table(s, d, "documents").selectExpr("doc_id", f"text || chr(10) || {_PANEL} || chr(10) || text AS text")).drop("text"), """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Director' WHEN 2 THEN 'Entry level' WHEN 4 THEN 'Associate' END AS seniority_level, CASE doc_id % 7 WHEN 2 THEN 'Part-time' WHEN 3 THEN 'Casual' WHEN 4 THEN 'Full-time' WHEN 5 THEN 'Contract' END AS employment_type,
  CASE doc_id % 7 WHEN 3 THEN 'Design' END AS job_function, CASE doc_id % 7 WHEN 5 THEN 'Mining' END AS industries FROM documents""")
_CARD = "text || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Engineer' || chr(10) || ' Posted ' || doc_id || ' days ago ' || chr(10) || 'x' WHEN 1 THEN 'long ago' WHEN 2 THEN 'Ago' || chr(10) || '1 Week' ELSE 'none' END || chr(10) || text"
_SPEAKS = "contains({0}, 'hour') OR contains({0}, 'day') OR contains({0}, 'week') OR contains({0}, 'month')"
register("posted_age", lambda s, d: table(s, d, "documents").selectExpr("doc_id", f"{_CARD} AS card").select("doc_id", pages.posted_age(F.col("card")).alias("age")), f"SELECT doc_id, CASE WHEN {_SPEAKS.format('low')} THEN trim(list_filter(string_split(low, chr(10)), lambda x: {_SPEAKS.format('x')} OR contains(x, 'ago'))[1], ' ' || chr(9) || chr(10) || chr(13)) END AS age FROM (SELECT doc_id, lower({_CARD}) AS low FROM documents)")
register("join_skills", lambda s, d: table(s, d, "documents").select("doc_id", pages.join_skills(F.split("text", " ")).alias("skills")), "SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(text, ' '), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> ''), 1, 10), ', ') AS skills FROM documents")

_PLAN_SQL = r"""
t AS (SELECT DISTINCT title FROM postings), r AS (SELECT title, lower(title) AS low, replace(lower(title), ' ', '_') AS slug FROM t),
plan AS (SELECT 'https://www.linkedin.com/jobs/search/?keywords=' || trim(title) || '&f_TPR=r172800&geoId=101452733' AS url, 'linkedin' AS source, title AS keyword, 'Australia' AS location, 'linkedin_' || slug || '_australia' AS search_id FROM r
UNION ALL SELECT 'https://www.linkedin.com/jobs/search/?keywords=' || trim(title) || '&f_TPR=r172800&geoId=103644278&f_WT=2', 'linkedin', title, 'US', 'linkedin_' || slug || '_us' FROM r
UNION ALL SELECT 'https://www.seek.com.au/' || replace(replace(trim(low), ' ', '-'), '/', '-') || '-jobs/in-All-Australia?daterange=2', 'seek', title, 'Australia', 'seek_' || slug || '_australia' FROM r
UNION ALL SELECT 'https://au.jora.com/j?sp=search&trigger_source=serp&a=7d&q=' || replace(replace(replace(url_encode(low), '%20', '+'), '*', '%2A'), '%2A', '*') || '&l=Australia', 'jora', title, 'Australia', 'jora_' || slug || '_australia' FROM r)"""


def _plan(s, d):
    return search_plan.search_urls(shape(s, d, "postings").select("title").distinct(), max_age_hours=48)


register("search_urls", _plan, ctes("postings") + "," + _PLAN_SQL + "\nSELECT * FROM plan")
register("paginate", lambda s, d: search_plan.paginate(_plan(s, d), 3).select("search_id", "source", "page", "page_url"), ctes("postings") + "," + _PLAN_SQL + "\nSELECT search_id, source, CAST(i AS INT) AS page, CASE WHEN source = 'linkedin' THEN url || '&start=' || (25 * (i - 1)) WHEN i = 1 THEN url ELSE url || '&page=' || i END AS page_url FROM plan, generate_series(1, 3) AS g(i)")
register("board_location", lambda s, d: shape(s, d, "postings").where("location IS NOT NULL").select("job_id", *(search_plan.board_location(F.split_part("location", F.lit(" "), F.lit(1)), b).alias(b) for b in ("linkedin", "seek", "jora")), search_plan.board_location(F.col("location"), "seek", True).alias("partial")), ctes("postings") + """
SELECT job_id, CASE job_id % 6 WHEN 0 THEN 'Perth, Western Australia, Australia' WHEN 1 THEN 'Melbourne, Victoria, Australia' WHEN 2 THEN 'Remote,' WHEN 3 THEN 'Sydney, New South Wales, Australia' ELSE 'Australia' END AS linkedin,
  CASE job_id % 6 WHEN 0 THEN 'All-Perth-WA' WHEN 1 THEN 'All-Melbourne-VIC' WHEN 3 THEN 'All-Sydney-NSW' ELSE 'All-Australia' END AS seek, CASE job_id % 6 WHEN 0 THEN 'Perth WA' WHEN 1 THEN 'Melbourne VIC' WHEN 3 THEN 'Sydney NSW' ELSE 'Australia' END AS jora,
  CASE job_id % 6 WHEN 0 THEN 'All-Perth-WA' WHEN 1 THEN 'All-Melbourne-VIC' WHEN 3 THEN 'All-Sydney-NSW' ELSE 'All-Australia' END AS partial FROM postings WHERE location IS NOT NULL""")


def _stream(s, d, name, condition="true"):
    """A library table, or its rows of a condition, as a stream: as files in the shared folder."""
    rows = shape(s, d, name).where(condition)
    path = through_file(rows, s)
    return streams.files_stream(s, path, rows)


def _finish(query):
    query.awaitTermination()


def _stream_ingest(s, d):
    path = scratch(s, "stream")
    _finish(streams.stream_ingest(_stream(s, d, "postings", "job_id % 2 = 1"), existing(s, d), path, KEYWORDS, AS_OF, scratch(s, "state")))
    return s.read.parquet(f"{path}/outcomes").groupBy("outcome").agg(F.sum("n").alias("n"))


register("stream_ingest", _stream_ingest, ctes("postings") + "," + _CLASSIFY_SQL + "\nSELECT outcome, count(*) AS n FROM classified GROUP BY 1")


def _sink(s, df, mode):
    path = scratch(s, "stream")
    _finish(df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else n}")).option("checkpointLocation", scratch(s, "state")).trigger(availableNow=True).start())
    return s.read.parquet(path).drop("batch")


register("stream_dedup", lambda s, d: _sink(s, streams.stream_dedup(_stream(s, d, "postings").select("title", "company", "url", "created_at")).select("job_id_hash"), "append").select("job_id_hash"), ctes("postings") + f"\nSELECT DISTINCT {_HASH} AS job_id_hash FROM postings")
register("stream_daily_runs", lambda s, d: _sink(s, streams.stream_daily_runs(_stream(s, d, "runs")), "complete"), ctes("runs") + "\nSELECT CAST(CAST(run_timestamp AS DATE) AS VARCHAR) AS day, platform, count(*) AS runs, CAST(sum(total_cards_seen) AS BIGINT) AS cards, CAST(sum(tier1_filtered) AS BIGINT) AS tier1, CAST(sum(tier2_skipped) AS BIGINT) AS tier2 FROM runs GROUP BY 1, 2")


def _stream_status(s, d):
    path = scratch(s, "stream")
    keep = ["job_id", "status", "applied", "applied_date", "rejected", "rejected_date", "first_seen_date"]
    jobs = shape(s, d, "postings").select(*keep).withColumn("offer_date", F.when(F.col("job_id") % 4 == 0, F.date_add("first_seen_date", 3)))
    _finish(streams.stream_status(_stream(s, d, "status_history"), path, scratch(s, "state")))
    return streams.streamed_status(jobs, path).select("job_id", "status", "applied", "rejected", "offer_date", "decision_date")


register("stream_status", _stream_status, ctes("postings", "status_history") + """,
l AS (SELECT job_id, new_status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY changed_at DESC, id DESC) AS r FROM status_history) WHERE r = 1),
f AS (SELECT job_id, bool_or(new_status = 'applied') AS a, bool_or(new_status = 'rejected') AS r, max(changed_at) FILTER (new_status = 'offer_received') AS o, max(changed_at) FILTER (new_status IN ('accepted', 'declined_offer', 'rejected')) AS e FROM status_history GROUP BY job_id)
SELECT p.job_id, coalesce(l.new_status, p.status) AS status, p.applied OR coalesce(f.a, false) AS applied, p.rejected OR coalesce(f.r, false) AS rejected, CAST(coalesce(CAST(f.o AS DATE), CASE WHEN p.job_id % 4 = 0 THEN CAST(p.first_seen_date AS DATE) + 3 END) AS VARCHAR) AS offer_date, CAST(CAST(f.e AS DATE) AS VARCHAR) AS decision_date FROM postings p LEFT JOIN l ON p.job_id = l.job_id LEFT JOIN f ON p.job_id = f.job_id""")
