"""The join of similar postings: both plans give the rows of a plain comparison, and a hot cell is cut."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobgrain.operators import ingest, similar

SCHEMA = "job_id long, title string, company string, url string, source string"


def alike(a, b, points):
    p, q = set(a.split()), set(b.split())
    return a.strip() == b.strip() or bool(p and q and 10000 * len(p & q) >= points * len(p | q))


def brute(rows, points):
    norm = lambda c: re.sub(r"\s+ltd$", "", (c or "").lower())
    return sorted((a[0], b[0]) for a in rows if a[0] % 2 for b in rows if b[0] % 2 == 0 if alike(a[1], b[1], points) and alike(norm(a[2]), norm(b[2]), points))


@pytest.fixture
def large(monkeypatch):
    monkeypatch.setattr(similar, "ASKING_ROWS", 0)
    monkeypatch.setattr(similar, "CELL", 6)
    monkeypatch.setattr(similar, "PART", 2)


@pytest.mark.parametrize("points,frequent", [(8500, 200), (6000, 3), (10000, 0)])
@pytest.mark.parametrize("small", [True, False])
def test_both_plans_are_brute_force(spark, monkeypatch, request, points, frequent, small):
    if not small:
        request.getfixturevalue("large")
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    rng = random.Random(points)
    words = "data engineer ml ops lead junior remote platform cloud x y z".split()
    title = lambda: " ".join(rng.choices(words, weights=[9, 9, 5, 3, 2, 2, 1, 1, 1, 1, 1, 1], k=rng.randrange(0, 12)))
    rows = [(i, title(), rng.choice(["Acme Ltd", "acme", "Data Cloud Works", "data works cloud ltd", "Unknown", "", None]), f"u{i}", rng.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ingest.match_existing_fuzzy(df.where("job_id % 2 = 1"), df.where("job_id % 2 = 0"), points, None).collect()
    assert sorted((r.new_key, r.existing_key) for r in got) == brute(rows, points)


def test_repeated_rows_and_empty_sides(spark, large):
    df = spark.createDataFrame([(1, "a b", "x", "u", "s"), (1, "a b", "x", "u", "s"), (2, "b a", "x", "u", "s"), (2, "b a", "x", "u", "s"), (4, None, None, None, None), (3, " ", "", None, None)], SCHEMA)
    new, old = df.where("job_id % 2 = 1"), df.where("job_id % 2 = 0")
    got = sorted((r.new_key, r.existing_key, r.similarity) for r in ingest.match_existing_fuzzy(new, old, window_days=None).collect())
    assert got == [(1, 2, 1.0)] * 4 + [(3, 4, 1.0)]
    assert not ingest.match_existing_fuzzy(new.limit(0), old, window_days=None).count() and not ingest.match_existing_fuzzy(new, old.limit(0), window_days=None).count()


def test_fifty_thousand_titles_of_one_company(spark, monkeypatch):
    """All titles share their words, so a handful of cells hold all rows: they are cut in even parts."""
    monkeypatch.setattr(similar, "ASKING_ROWS", 0)
    rng = random.Random(2)
    words = [f"w{i:02d}" for i in range(24)]
    titles = sorted({" ".join(sorted(rng.sample(words, 7))) for _ in range(70_000)})[:50_000]
    assert len(titles) == 50_000
    stored = spark.createDataFrame([(2 * i, t, "Unknown", None, "s") for i, t in enumerate(titles)], SCHEMA).repartition(8)
    new = spark.createDataFrame([(2 * i + 1, " ".join(rng.sample(titles[i].split(), 7)), "unknown", None, "s") for i in range(0, 50_000, 10)], SCHEMA)
    got = ingest.match_existing_fuzzy(new, stored, window_days=None)
    assert sorted((r.new_key, r.existing_key) for r in got.select("new_key", "existing_key").collect()) == [(2 * i + 1, 2 * i) for i in range(0, 50_000, 10)]


def test_a_hot_cell_meets_in_even_parts(spark, monkeypatch):
    monkeypatch.setattr(similar, "CELL", 1 << 16)
    monkeypatch.setattr(similar, "PART", 256)
    texts = spark.range(4000).select(F.concat(F.lit("a b c d e f g "), F.col("id").cast("string")).alias("t"), F.lit("unknown").alias("c"))
    order = similar.WordOrder(tuple(str(i) for i in range(0)), ())
    rows = similar.entries(texts, order, 8500).where("kt = 'a'").withColumns({"kt": F.lit("a"), "pt": F.lit(0)})
    asking = similar.probes(rows, 8500)
    cells = []
    monkeypatch.setattr(similar, "_alike", lambda points, side: (F.lit(True), F.lit(True)))
    met = similar.matches(asking, rows, 8500, False)
    part = [F.pmod(F.xxhash64(t, c), F.lit(16)) for t, c in (("q_t", "q_c"), ("t", "c"))]
    cells = [r.n for r in met.groupBy(*(p.alias(f"p{i}") for i, p in enumerate(part))).agg(F.count("*").alias("n")).collect()]
    n = rows.count()
    assert sum(cells) == n * n and len(cells) == 256 and max(cells) < 3 * sorted(cells)[128]


def test_a_small_batch_leaves_the_store_where_it_is(spark, sf):
    from jobgrain.plans.fixtures import shape

    p = shape(spark, sf, "postings")
    found = ingest.match_existing_fuzzy(p.where("job_id % 2 = 1"), p.where("job_id % 2 = 0"), as_of="2026-02-28")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    deepest = plan.split("\n")
    hint = next(i for i, line in enumerate(deepest) if "strategy=broadcast" in line)
    assert not any("Aggregate" in line or "Repartition" in line for line in deepest[hint:])
