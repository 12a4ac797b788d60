import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobgrain.llm import lm

STRENGTH = 100.0


def brute(rows, order=2, strength=STRENGTH):
    docs = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    grams = Counter()
    for i, w in docs:
        if not out(i):
            grams["<s>",] += 1
            for k in range(len(w)):
                for j in range(max(-1, k - order + 1), k + 1):
                    grams[tuple((["<s>", *w])[j + 1 : k + 2])] += 1
    uni = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(uni.values()), len(uni)

    def p(x, h):
        if not h:
            return (uni.get(x, 0) or v or 1) / max(1, n + v)
        return (grams[(*h, x)] + strength * p(x, h[1:])) / (grams[h] + strength) if grams[h] else p(x, h[1:])

    result = []
    for i, w in docs:
        base = sum(math.log10((uni.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10(p(x, tuple((["<s>", *w])[max(0, k + 2 - order) : k + 1]))) for k, x in enumerate(w))
        result.append((str(i), out(i), len(w), sum(uni.get(x, 0) > 0 for x in w), n, base, score))
    return sorted(result, key=lambda r: (r[0], r[6]))


def got(df):
    return sorted(((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=lambda r: (r[0], r[6]))


def same(a, b):
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert all(x[5:] == pytest.approx(y[5:], rel=1e-9, abs=1e-9) for x, y in zip(a, b, strict=True))


def test_matches_brute_force_and_beats_the_base(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "BATCH_BYTES", 60_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = got(lm.score_texts(docs))
    same(found, brute([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in found if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_walk_of_any_order(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BATCH_BYTES", 500)
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choices("a b c d e".split(), k=rng.randrange(0, 40)))) for i in range(80)] + [(100, "a z b"), (101, "z"), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(got(lm.score_texts(docs, order=order, strength=2.0)), brute(rows, order, 2.0))


def test_null_ids_beside_large_ones(spark):
    rows = [(9007199254740993 + i, f"a b {i}") for i in range(60)] + [(None, "a b"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(got(lm.score_texts(docs)), brute(rows))
    assert lm.score_texts(docs).schema["id"].dataType.simpleString() == "bigint"
    named = [(f"n{i}", "a b") for i in range(20)]
    same(got(lm.score_texts(spark.createDataFrame(named, "doc_id string, text string"))), brute(named))


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    same(got(lm.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string"))), brute([(held, "a b")]))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b a B"), (3, "a b a B"), (4, "é É \x1f q"), (None, "a"), (10, "w " * 9000), (5, " \n\t ")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, batch int")
    same(got(lm.score_texts(docs)), brute(rows))
    assert lm.score_texts(docs.where("doc_id < 0")).count() == 0
    same(got(lm.score_texts(docs, order=3)), brute(rows, 3))


def test_equal_rows_are_spread(spark, tmp_path, monkeypatch):
    """A third of all rows are failed crawls, of no id and no text: no batch has many more of them than another."""
    from jobgrain.llm import suffixes

    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "CASE WHEN id % 3 > 0 THEN repeat(concat('w', id, ' '), 20) ELSE 'not found' END AS text")
    rows.coalesce(2).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 12_000)
    for docs in (spark.read.parquet(f"{tmp_path}/t"), rows.where("true").repartition(3)):
        dealt, _ = suffixes._deal(docs, "doc_id", "text")
        hot = [r["count"] for r in dealt.where(F.col("id") == suffixes.NOBODY).groupBy("batch").count().collect()]
        assert sum(hot) == 1000 and len(hot) > 10 and max(hot) < 3 * sum(hot) / len(hot)
    monkeypatch.setattr(lm, "BATCH_BYTES", 12_000)
    scored = lm.score_texts(spark.read.parquet(f"{tmp_path}/t"))
    assert scored.count() == 3000 and scored.where("id IS NULL").select("score", "base_score").distinct().count() == 1
