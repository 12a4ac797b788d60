"""The rule scorer stands first in the chain, and keys pass around the scorers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobgrain.operators import scoring
from jobgrain.operators.parse import ParserConfig

CFG = ParserConfig(skills=("python", "sql"), strong=("python",))
BIG = 2**53 + 1


def test_scores_from_rules(spark):
    good = "Graduate program in machine learning. Python required, SQL required. Based in Perth. " + "x" * 100
    rows = [(1, "Graduate ML Engineer", good, "Perth"), (2, "Senior ML Engineer", good, "Perth"), (3, "Cook", "Kitchen work in Sydney. Kotlin is required.", "Sydney"), (4, "Nurse", "registered nurse, security clearance", None), (5, "Empty", "", "Perth"), (6, "Null", None, None)]
    df = spark.createDataFrame(rows, "job_id long, title string, description string, location string").withColumns({"reasons": F.lit(1), "Tech": F.lit(2), "reasons_": F.lit(3)})
    got = {r.job_id: r for r in scoring.rule_scores(df, CFG).collect()}
    assert got[1].component_score == 100.0 and got[1].hireability_score == 90.0 and got[1].score == 96.0 and got[1].recommendation == "APPLY" and (got[1].reasons, got[1].Tech, got[1].reasons_) == (1, 2, 3)
    assert got[2].hard_gate_failed == "Minimum experience not met" and got[2].score == 0.0 and got[2].recommendation == "SKIP"
    assert {c.name: c.match_status for c in got[3].components} == {"skills": "partial", "experience": "partial", "domain": "no", "location": "no"}
    assert got[4].hard_gate_failed == "Security clearance required" and got[4].score == 0
    assert all(got[i][c] is None for i in (5, 6) for c in ("score", "components", "hireability", "hard_gate_failed", "recommendation", "component_score"))
    assert sum(scoring.RULE_WEIGHTS.values()) == 100


def test_only_what_rules_cannot_judge_reaches_python(spark):
    asked = spark.sparkContext.accumulator(0)

    def by_title(rows):
        asked.add(len(rows))
        return pd.Series([7.0 if t else None for t in rows["title"]])

    rows = [(None, "a", "", None), (BIG, "b", None, None), (BIG + 1, None, "", None), (BIG + 2, "d", "python", None), (None, "e", "sql", None)]
    df = spark.createDataFrame(rows, "job_id long, title string, description string, location string").coalesce(1)
    got = sorted(scoring.score_batch(df, [("title", by_title)], rules=CFG).select("job_id", "model_used", "error", F.col("score").isNull()).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(None, "title", None, False), (BIG, "title", None, False), (BIG + 1, None, "title: no score", True), (BIG + 2, "rules", None, False), (None, "rules", None, False)], key=str)
    assert asked.value == 3
    none = scoring.score_batch(df, [], rules=CFG).where("score IS NULL").collect()
    assert {r.error for r in none} == {"rules: no description"} and len(none) == 3


@pytest.mark.parametrize("kind", ["long", "string", "decimal(20,0)", "struct<a:long>"])
def test_keys_of_any_type_pass_around_the_scorers(spark, kind):
    df = spark.createDataFrame([(None, "x"), (BIG, "y"), (BIG - 1, None)], "n long, t string").coalesce(1)
    key = F.struct(F.col("n").alias("a")) if kind.startswith("struct") else F.col("n").cast(kind)
    df = df.withColumn("job_id", key)
    seen = []

    def length(rows):
        assert rows["n"].tolist()[1] == BIG  # integers beside a null are whole
        return rows["t"].str.len()

    got = scoring.score_batch(df, [("length", length)]).collect()
    want = [r.job_id for r in df.select("job_id").collect()]
    assert [r.job_id for r in got] == want and [r.score for r in got] == [1.0, 1.0, None] and not seen
