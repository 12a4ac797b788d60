"""Queries of the filter, ingest and store operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrain.functions import text
from jobgrain.operators import filters, ingest, store
from jobgrain.plans.fixtures import AS_OF, KEYWORDS, all_rejections, ctes, searches, shape
from jobgrain.plans.registry import register

_DAY = f"DATE '{AS_OF}'"
_KW = KEYWORDS


def postings(spark, sf):
    return shape(spark, sf, "postings")


def existing(spark, sf):
    return postings(spark, sf).where("job_id % 2 = 0")


def incoming(spark, sf):
    return postings(spark, sf).where("job_id % 2 = 1")


def _norm(c: str) -> str:
    """SQL of a normalised company name."""
    ws = r"[ \t\n\r\x0B\f]"
    out = f"regexp_replace(lower(coalesce({c}, '')), '^{ws}+|{ws}+$', '', 'g')"
    for e in (rf"{ws}+pty\.?{ws}+ltd\.?$", f"{ws}+pty$", rf"{ws}+ltd\.?$", f"{ws}+limited$", rf"{ws}+inc\.?$", f"{ws}+incorporated$", rf"{ws}+corp\.?$", f"{ws}+corporation$", f"{ws}+llc$", f"{ws}+llp$", f"{ws}+plc$", f"{ws}+gmbh$", f"{ws}+pty{ws}+limited$"):
        out = f"regexp_replace({out}, '{e}', '')"
    return f"trim(regexp_replace({out}, '{ws}+', ' ', 'g'))"


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}_ \t\n\r]', '', 'g'), '[ \t\n\r]+', ' ', 'g'))"


_TRIMMED = r"regexp_replace(title, '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g')"


def _first(text_: str, words, word=False) -> str:
    tests = [f"WHEN contains({text_}, '{w}') THEN '{w}'" if not word else rf"WHEN regexp_matches({text_}, '(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])') THEN '{w}'" for w in words]
    return "CASE " + " ".join(tests) + " END"


_FULL = "lower(title) || CASE WHEN contains(lower(title), 'anea') THEN ' it is' ELSE '' END || CASE WHEN contains(lower(title), 'ndst') THEN ' hea' ELSE '' END"
_TITLE_SQL = f"""
titled AS (SELECT *, CASE WHEN regexp_matches(title, '(?i){_KW.false_positive_patterns[0]}') THEN '{_KW.false_positive_patterns[0]}' END AS fp, {_first('lower(title)', _KW.exclude_seniority, True)} AS sen,
  {_first('lower(title)', _KW.title_exclude)} AS tex, {_first('lower(title)', _KW.exclude)} AS exc, {_first(_FULL, _KW.required_phrases)} AS phr, {_first(_FULL, _KW.standalone)} AS sta, {_first(_FULL, _KW.domain)} AS dom, {_first(_FULL, _KW.role)} AS rol FROM postings),
ruled AS (SELECT *, CASE WHEN fp IS NOT NULL THEN 'false_positive' WHEN sen IS NOT NULL THEN 'seniority' WHEN tex IS NOT NULL THEN 'title_exclude' WHEN exc IS NOT NULL THEN 'exclude' WHEN phr IS NOT NULL THEN 'phrase'
  WHEN sta IS NOT NULL THEN 'standalone' WHEN dom IS NOT NULL AND rol IS NOT NULL THEN 'domain_role' WHEN dom IS NOT NULL THEN 'domain_only' WHEN rol IS NOT NULL THEN 'role_only' ELSE 'none' END AS tier1_rule FROM titled),
flagged AS (SELECT *, tier1_rule IN ('phrase', 'standalone', 'domain_role') AS tier1_pass, CASE tier1_rule WHEN 'false_positive' THEN 'False positive pattern: ' || fp WHEN 'seniority' THEN 'Excluded seniority: ' || sen
  WHEN 'title_exclude' THEN 'Excluded role type: ' || tex WHEN 'exclude' THEN 'Non-technical role: ' || exc WHEN 'phrase' THEN 'Matched required phrase: ' || phr WHEN 'standalone' THEN 'Matched standalone keyword: ' || sta
  WHEN 'domain_role' THEN 'Matched domain+role: ' || dom || ' + ' || rol WHEN 'domain_only' THEN 'Has domain ''' || dom || ''' but no role keyword' WHEN 'role_only' THEN 'Has role ''' || rol || ''' but no domain keyword (generic job)'
  ELSE 'No domain or role keywords found' END AS tier1_reason FROM ruled)"""

_HITS = " + ".join(f"CASE WHEN contains(lower(description), '{w}') THEN 1 ELSE 0 END" for w in _KW.description)
_QUALITY_SQL = f"""
counted AS (SELECT *, {_HITS} AS keyword_hits, CASE WHEN contains(lower(description), 'attion') THEN 1 ELSE 0 END AS strong_hits FROM postings),
judged AS (SELECT *, length(description) >= 100 AND (keyword_hits >= 2 OR strong_hits >= 1) AS tier3_pass,
  CASE WHEN length(description) < 100 THEN 'Description too short: ' || length(description) || ' chars < 100' WHEN keyword_hits >= 2 THEN 'Quality: ' || keyword_hits || ' keyword matches (threshold: 2)'
  WHEN strong_hits >= 1 THEN 'Quality: ' || strong_hits || ' strong keywords' ELSE 'Insufficient keywords: ' || keyword_hits || ' < 2' END AS tier3_reason FROM counted)"""

_HASH = f"sha256(lower(title || '|' || {_norm('company')} || '|' || url))"
_FUZZY_SQL = f"""
f AS (SELECT job_id, source, url, last_seen_date, {_clean('lower(title)')} AS t, {_clean(_norm('company'))} AS c FROM postings),
g AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS tw, list_distinct(list_filter(string_split(c, ' '), lambda x: x <> '')) AS cw FROM f),
pairs AS (SELECT a.job_id AS new_key, b.job_id AS existing_key, b.source AS existing_source, a.t = b.t AS same_title, len(list_intersect(a.tw, b.tw)) AS ti, len(a.tw) + len(b.tw) - len(list_intersect(a.tw, b.tw)) AS tu,
    len(a.tw) * len(b.tw) > 0 AS tn, a.c = b.c AS same_company, len(list_intersect(a.cw, b.cw)) AS ci, len(a.cw) + len(b.cw) - len(list_intersect(a.cw, b.cw)) AS cu, len(a.cw) * len(b.cw) > 0 AS cn
  FROM g a JOIN g b ON a.job_id % 2 = 1 AND b.job_id % 2 = 0 AND b.last_seen_date >= {_DAY} - 90 AND (a.c = b.c OR len(list_intersect(a.cw, b.cw)) * 10000 >= 8500 * (len(a.cw) + len(b.cw) - len(list_intersect(a.cw, b.cw))))),
fuzzy AS (SELECT new_key, existing_key, existing_source, CASE WHEN same_title THEN 1.0 ELSE CAST(ti AS DOUBLE) / tu END AS similarity FROM pairs
  WHERE (same_title OR (tn AND ti * 10000 >= 8500 * tu)) AND (same_company OR (cn AND ci * 10000 >= 8500 * cu)))"""
_CLASSIFY_SQL = _QUALITY_SQL + "," + _FUZZY_SQL + f""",
h AS (SELECT *, {_HASH} AS job_id_hash, lower({_TRIMMED}) AS dt, {_norm('company')} AS dc FROM judged),
old AS (SELECT * FROM h WHERE job_id % 2 = 0),
urls AS (SELECT url, min(job_id_hash) AS by_url FROM old WHERE last_seen_date >= {_DAY} - 90 GROUP BY url),
best AS (SELECT new_key, job_id_hash AS by_fuzzy FROM (SELECT *, row_number() OVER (PARTITION BY new_key ORDER BY similarity DESC, existing_key) AS r FROM fuzzy) JOIN old ON existing_key = job_id WHERE r = 1),
tests AS (SELECT h.*, coalesce(urls.by_url, best.by_fuzzy, CASE WHEN h.job_id_hash IN (SELECT job_id_hash FROM old) THEN h.job_id_hash END) AS matched_hash, (h.url IN (SELECT url FROM old WHERE last_seen_date >= {_DAY} - 90) OR h.job_id IN (SELECT new_key FROM fuzzy)) AS dup_store, h.job_id_hash IN (SELECT job_id_hash FROM old) AS dup_hash FROM h LEFT JOIN urls ON h.url = urls.url LEFT JOIN best ON h.job_id = best.new_key WHERE job_id % 2 = 1),
firsts AS (SELECT dt, dc, min(seq) AS first_pass FROM tests WHERE NOT dup_store AND tier3_pass AND NOT dup_hash GROUP BY dt, dc),
classified AS (SELECT t.*, CASE WHEN coalesce(t.seq > f.first_pass, false) THEN 'dup_cross' WHEN dup_store THEN 'dup_store' WHEN NOT tier3_pass THEN 'low_quality' WHEN dup_hash THEN 'dup_hash' ELSE 'new' END AS outcome
  FROM tests t LEFT JOIN firsts f ON t.dt = f.dt AND t.dc = f.dc)"""


def classified(spark, sf):
    return ingest.classify_ingest(incoming(spark, sf), existing(spark, sf), _KW, as_of=AS_OF)


register("ingest_accounting", lambda s, d: ingest.ingest_accounting(classified(s, d)), ctes("postings") + "," + _CLASSIFY_SQL + """
SELECT count(*) AS total, count(*) FILTER (outcome = 'new') AS n_new, count(*) FILTER (outcome = 'dup_cross') AS n_dup_cross, count(*) FILTER (outcome = 'dup_store') AS n_dup_store, count(*) FILTER (outcome = 'low_quality') AS n_low_quality,
  count(*) FILTER (outcome = 'dup_hash') AS n_dup_hash, true AS adds_up, round(count(*) FILTER (outcome IN ('dup_cross', 'dup_store', 'low_quality')) * 100.0 / count(*), 1) AS savings_percent FROM classified""")
register("classify_ingest", lambda s, d: classified(s, d).select("job_id", "outcome", "matched_hash"), ctes("postings") + "," + _CLASSIFY_SQL + "\nSELECT job_id, outcome, matched_hash FROM classified")
register("title_filter", lambda s, d: filters.title_filter(postings(s, d), _KW).select("job_id", "tier1_pass", "tier1_rule", "tier1_reason"), ctes("postings") + "," + _TITLE_SQL + "\nSELECT job_id, tier1_pass, tier1_rule, tier1_reason FROM flagged")
register("expand_acronyms", lambda s, d: postings(s, d).select("job_id", filters.expand_acronyms(F.col("title"), _KW.acronyms).alias("expanded")), ctes("postings") + f"\nSELECT job_id, {_FULL} AS expanded FROM postings")
register("quality_filter", lambda s, d: filters.quality_filter(postings(s, d), _KW).select("job_id", "tier3_pass", "tier3_reason", "keyword_hits"), ctes("postings") + "," + _QUALITY_SQL + "\nSELECT job_id, tier3_pass, tier3_reason, keyword_hits FROM judged")


def _flags(s, d):
    return filters.quality_filter(filters.title_filter(postings(s, d), _KW), _KW).select("source", (~F.col("tier1_pass")).alias("tier1_cut"), (F.col("tier1_pass") & (F.col("job_id") % 5 == 0)).alias("tier2_cut"), (F.col("tier1_pass") & (F.col("job_id") % 5 != 0) & ~F.col("tier3_pass")).alias("tier3_cut"))


def _pct(part: str, whole: str) -> str:
    return f"printf('%.1f', round(coalesce({part} * 100.0 / nullif({whole}, 0), 0), 1))"


register("filter_metrics", lambda s, d: filters.filter_metrics(_flags(s, d), "source"), ctes("postings") + "," + _TITLE_SQL + "," + _QUALITY_SQL + f""",
fl AS (SELECT a.source, NOT a.tier1_pass AS c1, a.tier1_pass AND a.job_id % 5 = 0 AS c2, a.tier1_pass AND a.job_id % 5 <> 0 AND NOT b.tier3_pass AS c3 FROM flagged a JOIN judged b USING (job_id)),
m AS (SELECT source, count(*) AS seen, count(*) FILTER (c1) AS tier1, count(*) FILTER (c2) AS tier2, count(*) FILTER (c3) AS tier3 FROM fl GROUP BY source)
SELECT *, seen - tier1 - tier2 - tier3 AS collected, {_pct('tier1', 'seen')} AS tier1_rate, {_pct('CASE WHEN seen - tier1 > 1 THEN tier2 END', '(seen - tier1)')} AS tier2_rate, {_pct('tier3', '(seen - tier1 - tier2)')} AS tier3_rate, {_pct('(tier1 + tier2 + tier3)', 'seen')} AS efficiency FROM m""")
_WORDS = ("the", "of", "la", "de", "die")
register("filter_reason_breakdown", lambda s, d: filters.filter_reason_breakdown(filters.title_filter(postings(s, d), _KW), words=_WORDS), ctes("postings") + "," + _TITLE_SQL + f"\nSELECT coalesce({_first('lower(title)', _WORDS)}, 'other') AS bucket, count(*) AS n FROM flagged WHERE NOT tier1_pass GROUP BY 1")
register("normalize_company", lambda s, d: postings(s, d).select("job_id", text.normalize_company(F.col("company")).alias("name")), ctes("postings") + f"\nSELECT job_id, {_norm('company')} AS name FROM postings")
register("job_hash", lambda s, d: postings(s, d).select("job_id", text.job_hash(F.col("title"), F.col("company"), F.col("url")).alias("hash"), text.job_hash(F.col("title"), F.col("company")).alias("cross_hash")),
         ctes("postings") + f"\nSELECT job_id, {_HASH} AS hash, sha256(lower(title || '|' || {_norm('company')})) AS cross_hash FROM postings")
register("legacy_hash", lambda s, d: postings(s, d).select("job_id", text.legacy_hash(F.col("title"), F.col("company"), F.col("url")).alias("legacy"), text.content_hash(F.col("description")).alias("sha"), text.content_hash(F.col("description"), "md5").alias("md5_")),
         ctes("postings") + "\nSELECT job_id, md5(title || company || url) AS legacy, sha256(description) AS sha, md5(description) AS md5_ FROM postings")


def _neighbours(s, d):
    p = postings(s, d).select("job_id", "title")
    q = p.select((F.col("job_id") - 1).alias("job_id"), F.col("title").alias("other"))
    return p.join(q, "job_id").select("job_id", F.round(text.word_jaccard(F.col("title"), F.col("other")), 9).alias("jaccard"), text.fuzzy_match(F.col("title"), F.col("other"), 2000).alias("alike"))


register("word_jaccard", _neighbours, ctes("postings") + f""",
w AS (SELECT job_id, {_clean('title')} AS t FROM postings), x AS (SELECT job_id, t, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS s FROM w),
y AS (SELECT a.job_id, a.t AS t1, b.t AS t2, len(a.s) * len(b.s) > 0 AS full_, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS u FROM x a JOIN x b ON b.job_id = a.job_id + 1)
SELECT job_id, CASE WHEN full_ THEN round(CAST(i AS DOUBLE) / u, 9) ELSE 0.0 END AS jaccard, t1 = t2 OR (full_ AND i * 10000 >= u * 2000) AS alike FROM y""")
register("dedup_in_batch", lambda s, d: ingest.dedup_in_batch(postings(s, d).withColumn("passes", F.col("job_id") % 6 != 0)).select("job_id", "dup_cross"), ctes("postings") + f""",
k AS (SELECT job_id, seq, lower({_TRIMMED}) AS t, {_norm('company')} AS c FROM postings), m AS (SELECT t, c, min(seq) AS first_pass FROM k WHERE job_id % 6 <> 0 GROUP BY t, c)
SELECT job_id, coalesce(seq > first_pass, false) AS dup_cross FROM k LEFT JOIN m ON k.t = m.t AND k.c = m.c""")
register("match_existing_url", lambda s, d: ingest.match_existing_url(incoming(s, d), existing(s, d), 30, AS_OF).select("job_id", "url"), ctes("postings") + f"\nSELECT job_id, url FROM postings WHERE job_id % 2 = 1 AND url IN (SELECT url FROM postings WHERE job_id % 2 = 0 AND last_seen_date >= {_DAY} - 30)")
register("match_existing_fuzzy", lambda s, d: ingest.match_existing_fuzzy(incoming(s, d), existing(s, d), as_of=AS_OF), ctes("postings") + "," + _FUZZY_SQL + "\nSELECT new_key, existing_key, existing_source, similarity FROM fuzzy")
register("best_match", lambda s, d: ingest.best_match(ingest.match_existing_fuzzy(incoming(s, d), existing(s, d), as_of=AS_OF)), ctes("postings") + "," + _FUZZY_SQL + "\nSELECT new_key, existing_key, existing_source, similarity FROM (SELECT *, row_number() OVER (PARTITION BY new_key ORDER BY similarity DESC, existing_key) AS r FROM fuzzy) WHERE r = 1")


def _hashed(df):
    return df.withColumn("job_id_hash", text.job_hash(F.col("title"), F.col("company"), F.col("url")))


_H = f", hashed AS (SELECT *, {_HASH} AS job_id_hash FROM postings)"
_STORE = ("job_id", "job_id_hash", "is_active", "first_seen_date", "last_seen_date", "status", "applied")
register("match_existing_hash", lambda s, d: ingest.match_existing_hash(_hashed(incoming(s, d)), _hashed(existing(s, d))).select("job_id"), ctes("postings") + _H + "\nSELECT job_id FROM hashed WHERE job_id % 2 = 1 AND job_id_hash IN (SELECT job_id_hash FROM hashed WHERE job_id % 2 = 0)")
register("insert_new", lambda s, d: store.insert_new(_hashed(existing(s, d)), _hashed(incoming(s, d)), AS_OF).select(*_STORE), ctes("postings") + _H + f""",
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id_hash ORDER BY seq) AS nth FROM hashed WHERE job_id % 2 = 1) WHERE nth = 1 AND job_id_hash NOT IN (SELECT job_id_hash FROM hashed WHERE job_id % 2 = 0))
SELECT job_id, job_id_hash, is_active, CAST(first_seen_date AS VARCHAR) AS first_seen_date, CAST(last_seen_date AS VARCHAR) AS last_seen_date, status, applied FROM hashed WHERE job_id % 2 = 0 UNION ALL SELECT job_id, job_id_hash, true, '{AS_OF}', '{AS_OF}', 'new', false FROM fresh""")
register("touch_last_seen", lambda s, d: store.touch_last_seen(_hashed(postings(s, d)), _hashed(postings(s, d)).where("job_id % 3 = 0"), AS_OF).select("job_id", "is_active", "last_seen_date"), ctes("postings") + _H + f""",
t AS (SELECT *, job_id_hash IN (SELECT job_id_hash FROM hashed WHERE job_id % 3 = 0) AS hit FROM hashed)
SELECT job_id, is_active OR hit AS is_active, CAST(CASE WHEN hit THEN {_DAY} ELSE last_seen_date END AS VARCHAR) AS last_seen_date FROM t""")
register("mark_inactive", lambda s, d: store.mark_inactive(_hashed(postings(s, d)), _hashed(postings(s, d)).where("job_id % 3 = 0 AND source_search_id <> 's2'"), searches(s)).select("job_id", "is_active"), ctes("postings", "searches") + _H + """,
seen AS (SELECT DISTINCT source_search_id, job_id_hash FROM hashed WHERE job_id % 3 = 0 AND source_search_id <> 's2')
SELECT h.job_id, CASE WHEN h.source_search_id IN (SELECT id FROM searches WHERE enabled) AND s.job_id_hash IS NULL THEN false ELSE h.is_active END AS is_active
FROM hashed h LEFT JOIN seen s ON h.source_search_id = s.source_search_id AND h.job_id_hash = s.job_id_hash""")


def _retained(s, d):
    jobs, children = store.apply_retention(postings(s, d), {"scores": shape(s, d, "scores"), "rejections": all_rejections(s, d)}, AS_OF, 20)
    count = lambda name, df: df.agg(F.count("*").alias("n"), F.sum("job_id").alias("ids")).withColumn("table_name", F.lit(name))
    return count("jobs", jobs).unionByName(count("scores", children["scores"])).unionByName(count("rejections", children["rejections"]))


register("apply_retention", _retained, ctes("postings", "scores", "rejections", "rejections_again") + f""",
j AS (SELECT job_id FROM postings WHERE first_seen_date >= {_DAY} - 20)
SELECT 'jobs' AS table_name, count(*) AS n, CAST(sum(job_id) AS BIGINT) AS ids FROM j UNION ALL SELECT 'scores', count(*), CAST(sum(job_id) AS BIGINT) FROM scores WHERE job_id IN (SELECT job_id FROM j)
UNION ALL SELECT 'rejections', count(*), CAST(sum(job_id) AS BIGINT) FROM all_rejections WHERE job_id IN (SELECT job_id FROM j)""")


def _updates(s, d):
    h = shape(s, d, "status_history")
    return h.select("job_id", F.col("changed_at").alias("updated_at"), F.col("id").alias("update_id"), F.col("new_status").alias("status"), F.when(F.col("new_status") == "applied", F.lit(True)).alias("applied"), F.when(F.col("new_status") == "applied", F.to_date("changed_at")).alias("applied_date"), F.when(F.col("id") % 2 == 0, F.lit(9)).alias("priority"))


register("apply_updates", lambda s, d: store.apply_updates(postings(s, d), _updates(s, d)).select("job_id", "status", "applied", "applied_date", "priority"), ctes("postings", "status_history") + """,
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY changed_at DESC, id DESC) AS r FROM status_history) WHERE r = 1),
a AS (SELECT job_id, max(changed_at) FILTER (new_status = 'applied') AS applied_at, bool_or(id % 2 = 0) AS urgent FROM status_history GROUP BY job_id)
SELECT p.job_id, coalesce(u.new_status, p.status) AS status, p.applied OR a.applied_at IS NOT NULL AS applied, CAST(coalesce(CAST(a.applied_at AS DATE), CAST(p.applied_date AS DATE)) AS VARCHAR) AS applied_date,
  CASE WHEN a.urgent THEN 9 ELSE p.priority END AS priority FROM postings p LEFT JOIN u ON p.job_id = u.job_id LEFT JOIN a ON p.job_id = a.job_id""")


def _rejects(s, d):
    h = shape(s, d, "status_history")
    return h.select("job_id", F.col("changed_at").alias("updated_at"), F.col("id").alias("update_id"), (F.col("new_status") == "rejected").alias("rejected"), F.col("note").alias("rejection_notes"))


register("rejection_rows", lambda s, d: store.rejection_rows(_rejects(s, d), postings(s, d)).select("job_id", "rejection_category", "rejection_notes", F.to_date("rejected_at").alias("rejected_on")), ctes("postings", "status_history") + "\nSELECT job_id, 'other' AS rejection_category, coalesce(note, '') AS rejection_notes, CAST(CAST(changed_at AS DATE) AS VARCHAR) AS rejected_on FROM status_history WHERE new_status = 'rejected' AND job_id IN (SELECT job_id FROM postings)")
register("fold_notes", lambda s, d: store.fold_notes(postings(s, d).select("job_id", F.when(F.col("job_id") % 2 == 0, F.lit("old")).otherwise(F.lit("")).alias("notes")), shape(s, d, "status_history").select("job_id", F.col("changed_at").alias("ts"), F.col("id").alias("note_id"), "note")),
         ctes("postings", "status_history") + """,
n AS (SELECT job_id, string_agg('[' || strftime(changed_at, '%Y-%m-%d') || '] ' || coalesce(note, ''), chr(10) ORDER BY changed_at, id) AS added FROM status_history GROUP BY job_id)
SELECT p.job_id, concat_ws(chr(10), CASE WHEN p.job_id % 2 = 0 THEN 'old' END, n.added) AS notes FROM postings p LEFT JOIN n ON p.job_id = n.job_id""")
