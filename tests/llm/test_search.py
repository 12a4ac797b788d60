import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobgrain.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def shape(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_terms():
    for t in ("Don't STOP_me now: ÄÖ café ab1\x7f2 x\x00y [z] ~É` 漢字、かな", "", " -- "):
        assert [w.decode() for w in search.terms_of(t.encode())] == terms(t)


@pytest.fixture
def odd():
    rng = random.Random(4)
    words = ["the", "of", "Alpha", "beta", "gamma", "É", "zeta9", "漢字"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([3, 8, 60])]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(300)]
    docs += [(i, "alpha beta gamma the the") for i in range(1000, 1100)]  # ties by id
    docs += [(None, "alpha beta gamma the the"), (None, None), (1, None), (2, ""), (2, "--- !"), (5, "solo " * 30_000), (7, "w1 w2"), (7, "w1 w2"), (-3, "alpha beta gamma the the")]
    rng.shuffle(docs)
    items = [(i, text(rng.randint(1, 30))) for i in range(25)] + [(100, None), (101, ""), (102, "nowhere"), (103, "the the the"), (None, "w1 beta"), (104, "Alpha solo"), (104, "w3")]
    return docs, items


@pytest.mark.parametrize("limit,cells,meet,at_a_time", [(5_000, 1 << 21, 1_000, 10_000), (4, 300, 2, 7)])
def test_matches_brute_force(spark, odd, monkeypatch, limit, cells, meet, at_a_time):
    docs, items = odd
    monkeypatch.setattr(search, "INDEX_ITEMS", limit)
    monkeypatch.setattr(search, "MEET", meet)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_a_time)
    try:
        d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "n": F.lit(2), "item_id": F.lit(3)}).repartition(6)
        q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
        got = search.search(d, q)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert shape(got.collect()) == shape(brute(docs, items))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables_and_other_ids(spark, odd):
    docs, items = odd
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert not search.search(d.limit(0), q).count()
    assert not search.search(d, q.limit(0)).count()
    named = search.search(d.withColumn("doc_id", F.format_string("%05d", F.abs("doc_id"))), q, top=3)
    assert named.schema["doc_id"].dataType.simpleString() == "string"
    best = [r.doc_id for r in named.where("item_id = 103").orderBy("rank").collect()]
    assert len(best) == 3 and all(best)
