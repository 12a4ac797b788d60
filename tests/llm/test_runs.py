import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobgrain.llm import queries, runs


def brute(words, least=6, times=4):
    """All runs (start, length, period) by trying every period at every place, in order."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                if j + q - i >= max(least, times * q):
                    found.setdefault((i, j + q - i), q)  # the smallest period comes first
                i = j
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def circled(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def odd_texts(seed):
    rng = random.Random(seed)
    out = [[], ["a"], ["a"] * 6, ["a"] * 5, list("ab" * 4), list("ab" * 3 + "a"), list("aab" * 30), list("abcabcabcabcx" * 5), list("aaaaaabaaaaaabaaaaaabaaaaaab")]
    for _ in range(250):
        w = []
        while len(w) < rng.randint(0, 120):
            part = [rng.choice("abc") for _ in range(rng.randint(1, 5))]
            w += part * rng.choice([1, 1, 2, 4, 7, 20]) + part[: rng.randint(0, len(part))]
        out.append(w)
    return out


@pytest.mark.parametrize("seed,least,times", [(1, 6, 4), (2, 2, 2), (3, 1, 3)])
def test_runs_of_odd_texts(seed, least, times, monkeypatch):
    monkeypatch.setattr(runs, "CELLS", 64)  # many blocks
    texts = odd_texts(seed)
    codes = np.array([ord(c) for w in texts for c in w], np.int64)
    doc, start, length, period = runs.find_runs(codes, np.array([len(w) for w in texts], np.int64), least, times)
    got = {}
    for d, *r in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got.setdefault(d, []).append(tuple(r))
    assert [got.get(d, []) for d in range(len(texts))] == [brute(w, least, times) for w in texts]


def test_levels_tell_how_far_texts_agree():
    rng = np.random.default_rng(5)
    lengths = np.array([0, 40, 1, 90, 0, 60], np.int64)
    codes = rng.integers(0, 3, lengths.sum())
    order = runs.SuffixArray(codes, lengths)
    ends = np.cumsum(lengths)
    suffix = lambda i: (order.doc[i], codes[i : ends[order.doc[i]]].tolist())
    assert order.suffix.tolist() == sorted(range(len(codes)), key=suffix)
    lcp = order.common_prefixes()
    for t in range(1, len(codes)):
        (a, x), (b, y) = suffix(order.suffix[t - 1]), suffix(order.suffix[t])
        assert lcp[t] == (next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y))) if a == b else 0)  # noqa: B905


def check(found, rows):
    got = sorted(((r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in found), key=repr)
    want = []
    for i, t in rows:
        words = circled([w.decode() for w in (t or "").encode().split()], i)
        mine = brute(words)
        best = min(mine, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if mine else None
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(words), len(mine), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in mine)), sha(collapsed(words, mine))))
    assert got == sorted(want, key=repr)


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(w)) for i, w in enumerate(odd_texts(8))]
    rows += [(None, "x y x y x y x y x y"), (None, None), (7, None), (3, ""), (3, " \n\t "), (4, "é  é\xa0 é é\x0bé é é é"), (4, "é  é\xa0 é é\x0bé é é é"), (2**60, "一 二 " * 40)]
    rows += [(i, " ".join(rng.choice("abcdefgh") for _ in range(300))) for i in range(1000, 1060)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "id": F.lit("x"), "n_words": F.lit(2)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    check(queries.op12_periodic_runs(spark, str(tmp_path)).collect(), rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert not runs.collapse_runs(df.limit(0)).count()
    words = runs.collapse_runs(df.withColumn("doc_id", F.lit("key"))).where("n_words > 0").first()
    assert words.id == "key"


def test_a_very_long_text(spark):
    text = "alpha beta gamma " * 60_000 + " ".join(str(i) for i in range(150_000)) + " z" * 300_000
    (row,) = runs.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 180_000, 3), (330_000, 300_000, 1)]
    assert row.n_words == 630_000 and row.collapsed == "alpha beta gamma " + " ".join(str(i) for i in range(150_000)) + " z"


def test_small_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if len(t or "") < 6000]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("coalesce(length(text), 0) < 6000")
    got = {r.id: [tuple(x) for x in r.runs] for r in runs.collapse_runs(docs).collect()}
    assert got == {i: brute((t or "").encode().split()) for i, t in rows}
