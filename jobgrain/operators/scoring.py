"""Rule-based scores, normalised responses of scorers, and the host for pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.functions.names import spare
from jobgrain.operators.parse import SPACE, ParserConfig, begins, names, parse_postings

# Phrases that fail a gate, in the order of the gates.
GATES = {
    "Citizenship/PR required": ("australian citizen", "pr required", "must hold citizenship", "citizenship required"),
    "Security clearance required": ("nv1", "nv2", "baseline clearance", "security clearance"),
    "Licensed profession required": ("registered nurse", "medical practitioner", "admitted solicitor", "registered teacher", "chartered civil engineer", "chartered mining engineer"),
}
SENIOR_TITLES = ("senior", "lead", "principal")
#: The most that each hireability factor counts for.
FACTOR_LIMITS = {"legal_visa": 25.0, "experience_credibility": 25.0, "recruiter_comprehension": 15.0, "skill_monetization": 15.0, "narrative_coherence": 10.0}

COMPONENTS = "array<struct<name:string,category:string,match_status:string,criticality:string,weight:double,reasoning:string>>"
BREAKDOWN = "struct<component_score:double,hireability_score:double,final_score:double,total_possible:double,earned:double,lost_to_dealbreakers:double,lost_to_gaps:double>"
RESPONSE = f"struct<hard_gate_failed:string,components:{COMPONENTS},score_breakdown:{BREAKDOWN},recommendation:string,explanation:string,final_score:double,score:double,key_points:array<string>>"


def hard_gates(description: Column, title: Column, gates: dict[str, tuple[str, ...]] = GATES, visa_expires_soon: bool | None = None, overseas_only: Column | None = None) -> Column:
    """The first gate that fails, null if all pass. Gates that need facts of a profile apply only when those are given."""
    low, head = F.lower(F.coalesce(description, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    tests = [F.when(names(low, p), F.lit(name)) for name, p in gates.items()]
    years = rf"{begins('123456789')}([3-9]|[1-9][0-9])\+{SPACE}*years"
    tests.append(F.when(low.contains("years") & low.rlike(years) | names(head, SENIOR_TITLES), F.lit("Minimum experience not met")))
    if visa_expires_soon:
        tests.append(F.when(low.contains("no visa sponsorship"), F.lit("No visa sponsorship")))
    if overseas_only is not None:
        tests.append(F.when(overseas_only, F.lit("Geographic impossibility")))
    return F.coalesce(*tests)


def component_score(components: Column) -> Column:
    """Sum of weights, whole for yes and half for partial."""
    worth = lambda c: F.when(c["match_status"] == "yes", 1.0).when(c["match_status"] == "partial", 0.5).otherwise(0.0)
    return F.aggregate(components, F.lit(0.0), lambda acc, c: acc + c["weight"] * worth(c))


def weights_add_up(components: Column) -> Column:
    return F.aggregate(components, F.lit(0.0), lambda acc, c: acc + c["weight"]) == 100.0


def hireability_score(**factors: Column) -> Column:
    """Sum of the factors, each cut to its limits; 90 at most."""
    return sum((F.least(F.lit(top), F.greatest(F.lit(0.0), F.coalesce(factors[n], F.lit(0.0)))) for n, top in FACTOR_LIMITS.items()), F.lit(0.0))


def final_score(component: Column, hireability: Column, gate: Column) -> Column:
    """Both blended, 0 behind a failed gate; 96 at most."""
    return F.when(gate.isNotNull(), 0.0).otherwise(F.round(component * 0.6 + hireability * 0.4, 6))


def tier(score: Column) -> Column:
    return F.when(score >= 70, "APPLY").when(score >= 50, "CLARIFY").otherwise("SKIP")


def normalize_response(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds is_valid, hard_gate_failed, recommendation, explanation, reasoning, components, breakdown, score, key_points from raw
    JSON. What is missing gets its default; a missing breakdown is rebuilt from the final score, else the score, else 0. Text that
    is not a JSON object is invalid and has nulls."""
    t = df.withColumn("r", F.from_json(raw, RESPONSE, {"mode": "PERMISSIVE"}))
    valid = F.coalesce(F.try_parse_json(raw).isNotNull() & strip_left(F.col(raw)).startswith("{"), F.lit(False))
    final = F.coalesce("r.final_score", "r.score", F.lit(0.0))
    rebuilt = F.struct(F.lit(0.0).alias("component_score"), F.lit(0.0).alias("hireability_score"), final.alias("final_score"), F.lit(100.0).alias("total_possible"), final.alias("earned"), F.lit(0.0).alias("lost_to_dealbreakers"), (100 - final).alias("lost_to_gaps")).cast(BREAKDOWN)
    only = lambda c: F.when(valid, c)
    explanation = F.coalesce("r.explanation", F.lit("No explanation provided"))
    return t.select(
        *df.columns, valid.alias("is_valid"), only(F.col("r.hard_gate_failed")).alias("hard_gate_failed"), only(F.coalesce("r.recommendation", F.lit("CLARIFY"))).alias("recommendation"), only(explanation).alias("explanation"), only(explanation).alias("reasoning"),
        only(F.coalesce("r.components", F.array().cast(COMPONENTS))).alias("components"), only(F.coalesce("r.score_breakdown", rebuilt)).alias("breakdown"), only(F.coalesce("r.score_breakdown.final_score", "r.score", F.lit(0.0))).alias("score"), only(F.coalesce("r.key_points", F.array().cast("array<string>"))).alias("key_points"))


def strip_left(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+", "")


def score_rows(df: DataFrame, profile_hash: str) -> DataFrame:
    """Rows of the scores table: reasoning falls back to the key points, and each method fills its own JSON columns."""
    method = F.col("scoring_method")
    text = lambda c, *methods: F.when(method.isin(*methods), F.to_json(c)).alias(c)
    return df.select(
        "job_id", "score", F.coalesce(F.expr("nullif(reasoning, '')"), F.array_join("key_points", "; ")).alias("reasoning"), F.to_json("key_points").alias("key_points"), "scoring_method", F.lit(profile_hash).alias("profile_hash"),
        text("components", "hybrid", "component_based"), text("breakdown", "hybrid", "component_based"), text("hireability", "hybrid", "hireability_based"))


def parse_json_list(text: Column) -> Column:
    """A JSON array of strings; malformed text gives an empty one, null and '' stay null."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None)).otherwise(F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>")))


def parse_score_json(df: DataFrame) -> DataFrame:
    """Every JSON column of a score that df has, read: matched, not_matched and key_points as arrays of strings, components
    as an array of components, score_breakdown, risk_profile and hireability_factors as maps of strings. Malformed text gives
    an empty array or map, null and '' a null."""
    kinds = {c: "array<string>" for c in ("matched", "not_matched", "key_points")} | {"components": COMPONENTS} | {c: "map<string,string>" for c in ("score_breakdown", "risk_profile", "hireability_factors")}
    empty = lambda kind: (F.array() if kind.startswith("array") else F.create_map()).cast(kind)
    read = lambda c, kind: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.coalesce(F.from_json(c, kind), empty(kind)))
    return df.withColumns({c: read(c, kind) for c, kind in kinds.items() if c in df.columns})


#: Weights of the rule scorer's components; they add up to 100.
RULE_WEIGHTS = {"skills": 50.0, "experience": 20.0, "domain": 15.0, "location": 15.0}


def rule_scores(jobs: DataFrame, cfg: ParserConfig, gates: dict[str, tuple[str, ...]] = GATES) -> DataFrame:
    """Adds hard_gate_failed, components, hireability, component_score, hireability_score, score and recommendation, by rules alone,
    from what the parser finds in title, description and location (see parse_postings).

    Components: required skills that the candidate has (yes from 70 %, partial from 40 % or where none are asked), experience
    (no behind a dealbreaker, yes where graduates are welcome), a known domain, and how far the place is preferred. Factors:
    the right to work, credible experience, a level that is told, the share of skills, and a domain to tell of. Both are
    blended as final_score() says. A job without a description cannot be judged: its score and parts are null.
    """
    signals = ("reasons", "graduate", "domain", "tech", "place", "company_signals", "suitable", "confidence", "description_length", "has_description")
    own = dict(zip(jobs.columns, spare(jobs.select(*(F.lit(0).alias(c) for c in signals)), *jobs.columns), strict=True))  # their names meanwhile
    t = jobs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    t = parse_postings(t, cfg, own["description"], own["title"], own["location"])
    of = {c: F.col(c) for c in signals}
    fresh, asked, share = of["graduate"]["accepts_fresh_grads"], F.size(of["tech"]["required"]), of["tech"]["match_percentage"]
    clear, liked = F.size(of["reasons"]) == 0, of["place"]["preference"]
    met = {
        "skills": F.when(asked == 0, "partial").when(share >= 70, "yes").when(share >= 40, "partial").otherwise("no"),
        "experience": F.when(~clear, "no").when(fresh, "yes").otherwise("partial"),
        "domain": F.when(of["domain"]["is_ai_ml_role"], "yes").otherwise("no"),
        "location": F.when(liked >= 80, "yes").when(liked > 0, "partial").otherwise("no")}
    components = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), met[n].alias("match_status")) for n, w in RULE_WEIGHTS.items()))
    factors = {
        "legal_visa": F.when(of["place"]["blocker"], 0.0).when(of["place"]["requires_pr"], 12.0).otherwise(25.0),
        "experience_credibility": F.when(fresh, 25.0).when(clear, 15.0).otherwise(5.0),
        "recruiter_comprehension": F.when(of["graduate"]["seniority_level"] == "Unknown", 8.0).otherwise(15.0),
        "skill_monetization": F.when(asked == 0, 7.0).otherwise(share * 0.15),
        "narrative_coherence": F.when(of["domain"]["is_ai_ml_role"], 10.0).otherwise(4.0)}
    judged = F.coalesce(own["description"], F.lit("")) != ""
    only = lambda c: F.when(judged, c)
    gate, parts = hard_gates(F.col(own["description"]), F.col(own["title"]), gates), F.struct(*(c.alias(n) for n, c in factors.items()))
    steps = spare(t, "hard_gate_failed", "components", "hireability", "component_score", "hireability_score", "score")
    t = t.withColumns(dict(zip(steps, (only(gate), only(components), only(parts)), strict=False)))
    t = t.withColumns({steps[3]: component_score(F.col(steps[1])), steps[4]: only(hireability_score(**{n: F.col(f"{steps[2]}.{n}") for n in factors}))})
    t = t.withColumn(steps[5], only(final_score(F.col(steps[3]), F.col(steps[4]), F.col(steps[0]))))
    names_ = ("hard_gate_failed", "components", "hireability", "component_score", "hireability_score", "score")
    told = F.struct(*(F.col(n).alias(c) for n, c in zip(steps, names_, strict=True)), only(tier(F.col(steps[5]))).alias("recommendation"))
    # a generated row keeps filters on a score from being rewritten as filters on all that it is made of
    return t.select(*(F.col(n).alias(c) for c, n in own.items()), F.inline(F.array(told)))


Scorer = tuple[str, Callable[[pd.DataFrame], pd.Series]]
#: Bytes of rows that go to the scorers at once, about.
AT_A_TIME = 1 << 20
#: Integers go to scorers as pandas' own nullable ones, so that a null beside them changes none.
_WHOLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some MB at a time, or one that has more by itself."""
    if batch.nbytes <= AT_A_TIME or len(batch) < 2:
        yield batch
    else:
        half = len(batch) // 2
        yield from _parts(batch.slice(0, half))
        yield from _parts(batch.slice(half))


def score_batch(jobs: DataFrame, scorers: Sequence[Scorer], key: str = "job_id", rules: ParserConfig | None = None) -> DataFrame:
    """key, score, model_used, error: each row's score from the first scorer of the chain that gives one.

    With rules, the rule scorer stands first, as columns ("rules" in model_used); only rows that it cannot judge, those
    without a description, go on to Python. A scorer maps a frame of rows to a series of scores, null where it fails; one
    that raises fails for all rows it was given. Only rows without a score go on to the next. Rows that no scorer
    manages keep the last error. Keys go around the scorers as they are, whatever their type. A frame holds some MB of
    rows, so a worker's memory does not follow how many rows a partition has.
    """

    def run(batches):
        for batch in (part for whole in batches for part in _parts(whole)):
            rows = batch.to_pandas(types_mapper=_WHOLE.get)
            score, model, error = np.full(len(rows), np.nan), np.full(len(rows), None), np.full(len(rows), None if rules is None else "rules: no description", dtype=object)
            for name, scorer in scorers:
                left = np.isnan(score)
                if not left.any():
                    break
                try:
                    got = pd.Series(scorer(rows[left]), dtype="float64").to_numpy()
                    if len(got) != left.sum():
                        raise ValueError(f"{len(got)} scores for {left.sum()} rows")
                except Exception as e:  # noqa: BLE001  (a plug-in may raise anything)
                    error[left] = f"{name}: {e}"
                    continue
                none = np.isnan(got)
                score[left], model[left], error[left] = got, np.where(none, None, name), np.where(none, f"{name}: no score", None)
            told = [pa.array(score, pa.float64(), from_pandas=True), pa.array(model, pa.string()), pa.array(error, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(key)), *told], [key, "score", "model_used", "error"])

    schema = f"{key} {jobs.schema[key].dataType.simpleString()}, score double, model_used string, error string"
    if rules is None:
        return jobs.mapInArrow(run, schema)
    told = F.coalesce(F.col("description"), F.lit("")) != ""
    native = rule_scores(jobs.where(told), rules).select(key, "score", F.lit("rules").alias("model_used"), F.lit(None).cast("string").alias("error"))
    return native.unionByName(jobs.where(~told).mapInArrow(run, schema))


def score_summary(scored: DataFrame) -> DataFrame:
    """One row: processed, failed, mean score."""
    return scored.agg(F.count("*").alias("processed"), F.count_if(F.col("score").isNull()).alias("failed"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 1).alias("avg_score"))


def merge_external_scores(job_scores: DataFrame, components: DataFrame, insights: DataFrame, jobs: DataFrame) -> DataFrame:
    """Scores of another store as rows for known jobs (by hash): components sorted by name, insights in their order."""
    c = components.groupBy("score_id").agg(F.sort_array(F.collect_list(F.struct("component_name", "component_category", "component_weight", "match_status"))).alias("components"))
    i = insights.groupBy("score_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("insight_order", "insight_text"))), lambda x: x["insight_text"]).alias("key_points"))
    known = job_scores.join(jobs.select("job_id", "job_id_hash"), "job_id_hash")
    return known.join(c, "score_id", "left").join(i, "score_id", "left").select("job_id", F.col("total_score").alias("score"), "model_used", "recommendation", "components", "key_points")
