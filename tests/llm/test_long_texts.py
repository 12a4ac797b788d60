"""One text of 20 MB among short ones: whole results, in a session of the size that the other tests have."""

import pytest

from brute import simhash
from jobgrain.llm import lm, quality, simhash as near, suffixes

PERIOD, TIMES = 10_007, 345


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """A text whose words go round in a circle, so that what is in it can be counted without reading it."""
    once = [f"w{i}" for i in range(PERIOD)]
    text = " ".join(once * TIMES + once[:3])
    assert len(text) > 19_000_000
    path = str(tmp_path_factory.mktemp("long") / "docs")
    rows = [(1, text), (2, "a few words only"), (3, None), (5, text + " tail"), (6, " ".join(once + once[:3]))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_rules(long_docs):
    got = {r.doc_id: r for r in quality.rule_ledger(long_docs).collect()}
    n = PERIOD * TIMES + 3
    assert (got[1].n_words, got[1].n_repeat_words, got[5].n_words, got[5].n_repeat_words) == (n, n, n + 1, n)
    assert got[1].word_chars == TIMES * sum(len(f"w{i}") for i in range(PERIOD)) + 6 and got[3].n_words == 0


def test_language_model(long_docs):
    got = {r.id: r for r in lm.score_texts(long_docs).collect()}
    assert {i: got[i].n_tokens for i in got} == {1: PERIOD * TIMES + 4, 2: 5, 3: 1, 5: PERIOD * TIMES + 5, 6: PERIOD + 4}
    assert got[1].train_tokens == sum(r.n_tokens for r in got.values() if not r.held_out)
    assert got[1].score > got[1].base_score


def test_repeated_passages(long_docs):
    got = sorted((r.id, r.start_word, r.end_word, r.first_id) for r in suffixes.repeated_passages(long_docs).collect())
    n = PERIOD * TIMES + 3
    assert got == [(1, 0, n, 1), (5, 0, n, 1), (6, 0, PERIOD + 3, 1)]


def test_fingerprints(long_docs):
    got = {r.doc_id: r for r in near.near_duplicates(long_docs).collect()}
    circle = simhash(" ".join(f"w{i % PERIOD}" for i in range(PERIOD + 3)))
    assert got[1].fp % 2**64 == circle == got[6].fp % 2**64
    assert got[1].component_id == got[6].component_id == 1
