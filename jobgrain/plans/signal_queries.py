"""Queries of the posting parser and the scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobgrain.operators import parse, scoring
from jobgrain.plans.fixtures import ctes, shape
from jobgrain.plans.registry import register
from jobgrain.plans.view_queries import components

CONFIG = parse.ParserConfig(skills=("python", "sql", "pytorch", "docker"), strong=("python", "pytorch"))


def parsed(s, d):
    return parse.parse_postings(shape(s, d, "adverts"), CONFIG)


_N = r"[^\p{L}\p{N}_]"


def _re(phrases) -> str:
    body = "|".join(p.replace("[ -]", "\0").replace(" ", r"\s+").replace("\0", r"[\s-]") for p in phrases)
    return f"(^|{_N})({body})($|{_N})"


def _has(phrases, text="low") -> str:
    return f"regexp_matches({text}, '{_re(phrases)}')"


def _get(phrases, text="low") -> str:
    return f"CASE WHEN {_has(phrases, text)} THEN regexp_extract({text}, '{_re(phrases)}', 2) END"


def _list(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


_YEARS = rf"(^|{_N})([0-2]|1-2|0-1)\s*years?\s*(of)?\s*experience($|{_N})"
_MANY = rf"(^|{_N})([3-9]|1[0-9])\+?\s*years?\s*(of)?\s*(professional\s+)?experience($|{_N})"
_ROLE = rf"(^|{_N})(senior|lead|principal|staff|head of)\s+(developer|engineer|analyst|architect|programmer|consultant|designer)"
_OFFICE = r"([0-9]+)\s*days?\s*(in[\s-]office|onsite|office)"
_DOM = {n: _has(p) for n, p in parse.DOMAINS.items()}
_ALL = " || ".join(f"regexp_extract_all(low, '{_re(parse.DOMAINS[n])}', 2)" for n in parse.KEYWORD_ORDER)
_SKILLS = {k: f"regexp_matches(low, '(^|{_N}){k}($|{_N})')" for k in CONFIG.skills}


def _context(skill: str, cues: str) -> str:
    return rf"len(list_filter(regexp_extract_all(low, '.{{0,50}}{skill}.{{0,50}}'), lambda x: regexp_matches(x, '{cues}'))) > 0"


_NEED = {k: f"({_SKILLS[k]} AND ({_context(k, parse.REQUIRED_CUES)} OR NOT {_context(k, parse.PREFERRED_CUES)}))" for k in CONFIG.skills}
_WANT = {k: f"({_SKILLS[k]} AND NOT {_NEED[k]})" for k in CONFIG.skills}
_JOIN = lambda xs: f"coalesce(array_to_string({xs}, ','), '')"
_BASE = ctes("adverts") + rf""",
b AS (SELECT *, lower(description) AS low, lower(title) AS head, lower(description) || ' ' || lower(coalesce(location, '')) AS place FROM adverts),
t1 AS (SELECT *, regexp_matches(regexp_replace(head, '^.*(^|{_N})(junior|graduate)($|{_N})', ''), '(^|{_N})(senior|lead|principal|staff|manager|director)($|{_N})') AS senior_title, regexp_matches(low, '(^|{_N})(junior|graduate|entry)') AS young FROM b),
g AS (SELECT *, {_has(parse.GRADUATE)} OR {_has(parse.GRADUATE, 'head')} AS grad, {_has(parse.ENTRY)} OR {_has(parse.ENTRY, 'head')} AS entry, CASE WHEN regexp_matches(low, '{_YEARS}') THEN regexp_extract(low, '{_YEARS}', 2) END AS asked FROM t1),
p AS (SELECT *, CASE WHEN asked IS NOT NULL THEN CAST(string_split(asked, '-')[-1] AS INT) END AS years, {_has(CONFIG.exclude_visa)} AS pr, {_has(parse.SPONSOR)} AS sponsor, {_has(parse.REMOTE)} AS remote,
  regexp_matches(low, '(^|{_N})(hybrid|{_OFFICE})($|{_N})') AS hybrid, {_has(parse.MENTOR)} AS mentor, {_has(parse.GROWTH)} AS growth,
  {_list(*(f"CASE WHEN regexp_matches(place, '(^|{_N}){c.lower()}($|{_N})') THEN '{c}' END" for c in CONFIG.cities))} AS cities,
  CASE WHEN description = '' THEN ['No description provided'] ELSE {_list(f"CASE WHEN {_has(CONFIG.exclude_visa)} THEN 'Requires Australian PR/Citizenship/Security Clearance' END",
    f"CASE WHEN (senior_title OR regexp_matches(low, '{_ROLE}')) AND NOT young THEN CASE WHEN senior_title THEN 'Senior/Lead level position (in title)' ELSE 'Senior/Lead level position (in description)' END END",
    f"CASE WHEN regexp_matches(low, '{_MANY}') THEN 'Requires ' || regexp_extract(low, '{_MANY}', 2) || '+ years of experience' END", f"CASE WHEN {_has(CONFIG.exclude_education)} THEN 'PhD required' END")} END AS reasons,
  {_list(*(f"CASE WHEN {x} THEN '{n}' END" for n, x in _DOM.items()))} AS present, {_list(*(f"CASE WHEN {_NEED[k]} THEN '{k}' END" for k in sorted(CONFIG.skills)))} AS needs, {_list(*(f"CASE WHEN {_WANT[k]} THEN '{k}' END" for k in sorted(CONFIG.skills)))} AS wants FROM g)
"""
join = lambda c: F.array_join(c, ",")
register("dealbreakers", lambda s, d: parsed(s, d).select("job_id", join("reasons").alias("reasons")), _BASE + f"SELECT job_id, {_JOIN('reasons')} AS reasons FROM p")
register("graduate_signals", lambda s, d: parsed(s, d).select("job_id", "graduate.explicit_graduate", "graduate.entry_level", "graduate.years_required", "graduate.masters_mentioned", "graduate.seniority_level", "graduate.accepts_fresh_grads", join("graduate.keywords").alias("keywords")), _BASE + rf"""
SELECT job_id, grad AS explicit_graduate, entry AS entry_level, years AS years_required, {_has(parse.MASTERS)} AS masters_mentioned, CASE WHEN grad THEN 'Graduate' WHEN entry THEN 'Junior/Entry-level' WHEN years <= 1 THEN 'Entry-level' ELSE 'Unknown' END AS seniority_level,
  grad OR entry OR coalesce(years <= 1, false) AS accepts_fresh_grads, {_JOIN(_list(f'CASE WHEN grad THEN {_get(parse.GRADUATE)} END', f'CASE WHEN entry THEN {_get(parse.ENTRY)} END', f"CASE WHEN asked IS NOT NULL THEN regexp_replace(regexp_extract(low, '{_YEARS}'), '^{_N}|{_N}$', '', 'g') END"))} AS keywords FROM p""")
register("domains", lambda s, d: parsed(s, d).select("job_id", "domain.primary_domain", "domain.is_ai_ml_role", join("domain.domains_present").alias("domains_present"), join(F.sort_array("domain.domain_keywords")).alias("domain_keywords")), _BASE + f"""
SELECT job_id, coalesce(present[1], 'Unknown') AS primary_domain, len(present) > 0 AS is_ai_ml_role, {_JOIN('present')} AS domains_present, {_JOIN(f'list_sort(list_distinct({_ALL}))')} AS domain_keywords FROM p""")
register("tech_stack", lambda s, d: parsed(s, d).select("job_id", join("tech.required").alias("required"), join("tech.preferred").alias("preferred"), "tech.match_percentage", join("tech.strong_present").alias("strong_present")), _BASE + f"""
SELECT job_id, {_JOIN('needs')} AS required, {_JOIN('wants')} AS preferred, 100 AS match_percentage, {_JOIN(_list(*(f"CASE WHEN {_SKILLS[k]} THEN '{k}' END" for k in sorted(CONFIG.strong))))} AS strong_present FROM p""")
register("location_visa", lambda s, d: parsed(s, d).select("job_id", join("place.cities").alias("cities"), "place.primary_city", "place.remote_type", "place.remote_days", "place.preference", "place.requires_pr", "place.sponsorship", "place.acceptable", "place.blocker"), _BASE + rf"""
SELECT job_id, {_JOIN('cities')} AS cities, cities[1] AS primary_city, CASE WHEN remote THEN 'Fully Remote' WHEN hybrid THEN 'Hybrid' WHEN {_has(parse.ONSITE)} THEN 'Onsite' ELSE 'Unknown' END AS remote_type, CASE WHEN NOT remote AND hybrid AND regexp_matches(low, '{_OFFICE}') THEN CAST(regexp_extract(low, '{_OFFICE}', 1) AS INT) END AS remote_days,
  CASE cities[1] WHEN 'Perth' THEN 100 WHEN 'Melbourne' THEN 90 WHEN 'Remote' THEN 80 ELSE CASE WHEN remote AND contains(place, 'australia') THEN 80 WHEN remote THEN 60 ELSE 0 END END AS preference, pr AS requires_pr, sponsor AS sponsorship, NOT pr OR sponsor AS acceptable, pr AND NOT sponsor AS blocker FROM p""")
_TEAM = r"([0-9]+)[\s-]?(person|member|engineer)s?\s+(team|ml|ai|data)"
register("company_signals", lambda s, d: parsed(s, d).select("job_id", "company_signals.*"), _BASE + rf"""
SELECT job_id, mentor AS mentorship, growth, mentor OR growth AS learning, CASE WHEN regexp_matches(low, '{_TEAM}') THEN regexp_extract(low, '{_TEAM}', 1) || '-person ' || regexp_extract(low, '{_TEAM}', 3) || ' team' END AS team_size,
  CASE WHEN {_has(parse.STARTUP)} THEN 'Startup' WHEN {_has(parse.SCALEUP)} THEN 'Scale-up' WHEN {_has(parse.ENTERPRISE)} THEN 'Enterprise' ELSE 'Unknown' END AS stage FROM p""")
register("parse_postings", lambda s, d: parsed(s, d).select("job_id", "suitable", "confidence", "description_length", "has_description"), _BASE + """
SELECT job_id, description <> '' AND len(reasons) = 0 AND (grad OR entry OR coalesce(years <= 2, false)) AS suitable, CASE WHEN description = '' THEN CAST(0 AS DOUBLE) ELSE CAST(round(least(1.0, 0.5 + CASE WHEN len(reasons) > 0 THEN 0.2 ELSE 0 END + CASE WHEN years IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN grad THEN 0.2 ELSE 0 END
  + CASE WHEN len(present) > 0 THEN 0.1 ELSE 0 END + CASE WHEN len(needs) > 0 THEN 0.15 ELSE 0 END + CASE WHEN len(cities) > 0 THEN 0.1 ELSE 0 END), 4) AS DOUBLE) END AS confidence, length(description) AS description_length, length(trim(description)) > 100 AS has_description FROM p""")

_GATES = "coalesce(" + ", ".join(f"CASE WHEN {_has(p)} THEN '{n}' END" for n, p in scoring.GATES.items()) + rf", CASE WHEN regexp_matches(low, '(^|{_N})([3-9]|[1-9][0-9])\+\s*years') OR {_has(scoring.SENIOR_TITLES, 'head')} THEN 'Minimum experience not met' END)"
register("hard_gates", lambda s, d: shape(s, d, "adverts").select("job_id", scoring.hard_gates(F.col("description"), F.col("title")).alias("gate")), _BASE + f"SELECT job_id, {_GATES} AS gate FROM p")
_SC = ctes("scores")
_WORTH = lambda c: f"CASE {c} WHEN 'yes' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END"
_COMPONENT = f"CAST(50 * {_WORTH('m0')} + 30 * {_WORTH('m1')} + 20 * {_WORTH('m2')} AS DOUBLE)"
_HIRE = "least(25.0, greatest(0.0, f0)) + least(25.0, greatest(0.0, f1)) + least(15.0, greatest(0.0, f2)) + least(15.0, greatest(0.0, f3)) + least(10.0, greatest(0.0, f4))"


def rated(s, d):
    factors = dict(zip(scoring.FACTOR_LIMITS, (F.col(f"f{i}") for i in range(5)), strict=True))
    t = components(s, d).withColumns({"component": scoring.component_score(F.col("components")), "hire": scoring.hireability_score(**factors), "complete": scoring.weights_add_up(F.col("components"))})
    return t.withColumn("final", scoring.final_score(F.col("component"), F.col("hire"), F.col("hard_gate_failed")))


register("component_score", lambda s, d: rated(s, d).select("job_id", "component", "complete"), _SC + f"\nSELECT job_id, {_COMPONENT} AS component, true AS complete FROM scores")
register("hireability_score", lambda s, d: rated(s, d).select("job_id", "hire"), _SC + f"\nSELECT job_id, {_HIRE} AS hire FROM scores")
register("final_score", lambda s, d: rated(s, d).select("job_id", "final", scoring.tier(F.col("final")).alias("tier")), _SC + f""",
f AS (SELECT job_id, CASE WHEN hard_gate_failed IS NOT NULL THEN 0.0 ELSE round({_COMPONENT} * 0.6 + ({_HIRE}) * 0.4, 6) END AS final FROM scores)
SELECT job_id, final, CASE WHEN final >= 70 THEN 'APPLY' WHEN final >= 50 THEN 'CLARIFY' ELSE 'SKIP' END AS tier FROM f""")


def raw_responses(s, d):
    t = shape(s, d, "scores")
    given = F.format_string('{"hard_gate_failed":null,"score_breakdown":{"component_score":1.0,"hireability_score":2.0,"final_score":%d,"total_possible":100,"earned":3,"lost_to_dealbreakers":4,"lost_to_gaps":5},"recommendation":"%s","explanation":"fits","key_points":["a","b"]}', "score", "recommendation")
    raw = F.when(F.col("job_id") % 19 == 0, "{bad").when(F.col("job_id") % 6 == 0, F.format_string('{"final_score":%d}', "score")).when(F.col("job_id") % 6 == 1, F.format_string('{"score":%d,"hard_gate_failed":"clearance"}', "score")).when(F.col("job_id") % 6 == 2, "{}").otherwise(given)
    return t.select("job_id", raw.alias("raw"))


register("normalize_response", lambda s, d: scoring.normalize_response(raw_responses(s, d)).select("job_id", "is_valid", "hard_gate_failed", "recommendation", "reasoning", "score", F.col("breakdown.final_score").alias("final"), F.col("breakdown.lost_to_gaps").alias("gaps"), F.array_join("key_points", ",").alias("points")), _SC + """,
k AS (SELECT job_id, CAST(score AS DOUBLE) AS sc, recommendation AS rec, CASE WHEN job_id % 19 = 0 THEN 'bad' WHEN job_id % 6 = 0 THEN 'final' WHEN job_id % 6 = 1 THEN 'score' WHEN job_id % 6 = 2 THEN 'none' ELSE 'full' END AS kind FROM scores)
SELECT job_id, kind <> 'bad' AS is_valid, CASE WHEN kind = 'score' THEN 'clearance' END AS hard_gate_failed, CASE kind WHEN 'bad' THEN NULL WHEN 'full' THEN rec ELSE 'CLARIFY' END AS recommendation, CASE kind WHEN 'bad' THEN NULL WHEN 'full' THEN 'fits' ELSE 'No explanation provided' END AS reasoning,
  CASE kind WHEN 'bad' THEN NULL WHEN 'full' THEN sc WHEN 'score' THEN sc ELSE 0.0 END AS score, CASE kind WHEN 'bad' THEN NULL WHEN 'none' THEN 0.0 ELSE sc END AS final, CASE kind WHEN 'bad' THEN NULL WHEN 'full' THEN 5.0 WHEN 'none' THEN 100.0 ELSE 100 - sc END AS gaps, CASE kind WHEN 'bad' THEN NULL WHEN 'full' THEN 'a,b' ELSE '' END AS points FROM k""")


def _rows(s, d):
    t = rated(s, d).withColumns({"reasoning": F.when(F.col("job_id") % 2 == 0, "because").otherwise(""), "key_points": F.array(F.lit("k"), F.col("recommendation")), "breakdown": F.struct(F.col("final").alias("final_score")), "hireability": F.struct(F.col("f0").alias("legal_visa"))})
    return scoring.score_rows(t, "p7")


register("score_rows", lambda s, d: _rows(s, d).select("job_id", "reasoning", "key_points", "profile_hash", F.col("components").isNotNull().alias("c"), F.col("breakdown").isNotNull().alias("b"), F.col("hireability").isNotNull().alias("h")), _SC + """
SELECT job_id, CASE WHEN job_id % 2 = 0 THEN 'because' ELSE 'k; ' || recommendation END AS reasoning, '["k","' || recommendation || '"]' AS key_points, 'p7' AS profile_hash, scoring_method IN ('hybrid', 'component_based') AS c, scoring_method IN ('hybrid', 'component_based') AS b, scoring_method IN ('hybrid', 'hireability_based') AS h FROM scores""")
register("parse_score_json", lambda s, d: shape(s, d, "scores").select("job_id", *(F.concat_ws(",", F.lit("n="), F.size(x).cast("string"), F.array_join(x, ",")).alias(c) for c in ("matched", "key_points") for x in [scoring.parse_json_list(F.col(c))])), _SC + r""",
j AS (SELECT job_id, CASE WHEN matched IS NULL THEN NULL WHEN json_valid(matched) THEN CAST(CAST(matched AS JSON) AS VARCHAR[]) ELSE [] END AS m, CASE WHEN json_valid(key_points) THEN CAST(CAST(key_points AS JSON) AS VARCHAR[]) ELSE [] END AS k FROM scores)
SELECT job_id, concat_ws(',', 'n=', CAST(len(m) AS VARCHAR), array_to_string(m, ',')) AS matched, concat_ws(',', 'n=', CAST(len(k) AS VARCHAR), array_to_string(k, ',')) AS key_points FROM j""")


def _hybrid(s, d):
    quoted = F.regexp_replace(F.substring_index("title", " ", 1), r'["\\\\]', "")
    t = shape(s, d, "postings").select("job_id", F.when(F.col("job_id") % 5 == 0, "{bad").when(F.col("job_id") % 7 == 0, "").otherwise(F.concat(F.lit('{"level":"'), quoted, F.lit('","n":'), "job_id", F.lit("}"))).alias("risk_profile"),
                                       F.when(F.col("job_id") % 5 == 1, "[1").otherwise(F.concat(F.lit('[{"name":"'), quoted, F.lit('","weight":'), "job_id", F.lit("}]"))).alias("components"))
    return scoring.parse_score_json(t).select("job_id", F.size("risk_profile").alias("risks"), F.col("risk_profile")["level"].alias("level"), F.col("risk_profile")["n"].alias("n"), F.size("components").alias("parts"), F.get("components", F.lit(0))["name"].alias("name"), F.get("components", F.lit(0))["weight"].alias("weight"))


register("parse_score_json_nested", _hybrid, ctes("postings") + r"""
SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 0 WHEN job_id % 7 = 0 THEN NULL ELSE 2 END AS risks, CASE WHEN job_id % 5 <> 0 AND job_id % 7 <> 0 THEN q END AS level, CASE WHEN job_id % 5 <> 0 AND job_id % 7 <> 0 THEN CAST(job_id AS VARCHAR) END AS n,
  CASE WHEN job_id % 5 = 1 THEN 0 ELSE 1 END AS parts, CASE WHEN job_id % 5 <> 1 THEN q END AS name, CASE WHEN job_id % 5 <> 1 THEN CAST(job_id AS DOUBLE) END AS weight FROM (SELECT job_id, regexp_replace(split_part(title, ' ', 1), '["\\]', '', 'g') AS q FROM postings)""")


def chain(s, d):
    """Two scorers: one that only knows titles with 'Engineer', then one for the rest that fails on empty texts."""
    def by_title(rows):
        return rows["title"].where(rows["title"].str.contains("Engineer")).str.len().astype("float64")

    def by_text(rows):
        n = rows["description"].str.len()
        return (n % 100).where(n > 0)

    return scoring.score_batch(shape(s, d, "adverts"), [("title", by_title), ("text", by_text)])


_CHAIN = ctes("adverts") + """,
r AS (SELECT job_id, CASE WHEN contains(title, 'Engineer') THEN CAST(length(title) AS DOUBLE) WHEN length(description) > 0 THEN CAST(length(description) % 100 AS DOUBLE) END AS score, CASE WHEN contains(title, 'Engineer') THEN 'title' WHEN length(description) > 0 THEN 'text' END AS model_used FROM adverts)
"""
register("score_batch", lambda s, d: chain(s, d), _CHAIN + "SELECT *, CASE WHEN score IS NULL THEN 'text: no score' END AS error FROM r")
register("score_summary", lambda s, d: scoring.score_summary(chain(s, d)), _CHAIN + "SELECT count(*) AS processed, count(*) FILTER (score IS NULL) AS failed, round(coalesce(avg(score), 0), 1) AS avg_score FROM r")


_WELCOME = "(grad OR entry OR coalesce(years <= 1, false))"
_RULES = _BASE + f""",
f AS (SELECT *, {_GATES} AS gate, CASE cities[1] WHEN 'Perth' THEN 100 WHEN 'Melbourne' THEN 90 WHEN 'Remote' THEN 80 ELSE CASE WHEN remote AND contains(place, 'australia') THEN 80 WHEN remote THEN 60 ELSE 0 END END AS liked FROM p WHERE description <> ''),
m AS (SELECT *, CAST(CASE WHEN len(needs) = 0 THEN 25 ELSE 50 END + CASE WHEN len(reasons) > 0 THEN 0 WHEN {_WELCOME} THEN 20 ELSE 10 END + CASE WHEN len(present) > 0 THEN 15 ELSE 0 END + CASE WHEN liked >= 80 THEN 15 WHEN liked > 0 THEN 7.5 ELSE 0 END AS DOUBLE) AS component,
  CAST(CASE WHEN pr AND NOT sponsor THEN 0 WHEN pr THEN 12 ELSE 25 END + CASE WHEN {_WELCOME} THEN 25 WHEN len(reasons) = 0 THEN 15 ELSE 5 END + CASE WHEN {_WELCOME} THEN 15 ELSE 8 END + CASE WHEN len(needs) = 0 THEN 7 ELSE 15 END + CASE WHEN len(present) > 0 THEN 10 ELSE 4 END AS DOUBLE) AS hire FROM f),
z AS (SELECT job_id, gate, component, hire, CASE WHEN gate IS NOT NULL THEN CAST(0 AS DOUBLE) ELSE round(component * 0.6 + hire * 0.4, 6) END AS score FROM m)"""
register("rule_scores", lambda s, d: scoring.rule_scores(shape(s, d, "adverts"), CONFIG).where("score IS NOT NULL").select("job_id", F.col("hard_gate_failed").alias("gate"), F.col("component_score").alias("component"), F.col("hireability_score").alias("hire"), "score", "recommendation"),
         _RULES + "\nSELECT job_id, gate, component, hire, score, CASE WHEN score >= 70 THEN 'APPLY' WHEN score >= 50 THEN 'CLARIFY' ELSE 'SKIP' END AS recommendation FROM z")
register("score_batch_rules", lambda s, d: scoring.score_batch(shape(s, d, "adverts"), [("title", lambda rows: rows["title"].str.len().astype("float64"))], rules=CONFIG).select("job_id", "score", "model_used"),
         _RULES + "\nSELECT job_id, score, 'rules' AS model_used FROM z UNION ALL SELECT job_id, CAST(length(title) AS DOUBLE), 'title' FROM p WHERE description = '' AND title IS NOT NULL UNION ALL SELECT job_id, NULL, NULL FROM p WHERE description = '' AND title IS NULL")


def _external(s, d):
    t = shape(s, d, "scores").withColumn("job_id_hash", F.md5(F.col("job_id").cast("string")))
    js = t.select("score_id", "job_id_hash", F.col("score").alias("total_score"), "model_used", "recommendation")
    comp = components(s, d).select("score_id", F.explode("components").alias("c")).select("score_id", F.col("c.name").alias("component_name"), F.col("c.category").alias("component_category"), F.col("c.weight").alias("component_weight"), "c.match_status")
    ins = t.select("score_id", F.explode(F.array(*(F.struct(F.lit(i).alias("insight_order"), F.concat(F.lit(f"i{i}-"), "recommendation").alias("insight_text")) for i in (2, 1)))).alias("x")).select("score_id", "x.*")
    jobs = shape(s, d, "postings").where("job_id % 3 = 0").select("job_id", F.md5(F.col("job_id").cast("string")).alias("job_id_hash"))
    out = scoring.merge_external_scores(js, comp, ins, jobs)
    return out.select("job_id", "score", "model_used", F.array_join(F.transform("components", lambda c: F.concat_ws(":", c["component_name"], c["match_status"])), ",").alias("parts"), F.array_join("key_points", ",").alias("points"))


register("merge_external_scores", _external, _SC + "\nSELECT job_id, score, model_used, 'domain:' || m2 || ',experience:' || m1 || ',skills:' || m0 AS parts, 'i1-' || recommendation || ',i2-' || recommendation AS points FROM scores WHERE job_id % 3 = 0")
