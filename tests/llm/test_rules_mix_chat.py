import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from jobgrain.llm import chat, mixing, quality
from jobgrain.llm.common import count_words
from jobgrain.llm.queries import ORACLE_SQL, QUERIES


def test_ledger_and_policies(spark):
    text = "one two three four five. " * 11
    rows = [(1, None), (2, ""), (3, " \n\x0b"), (4, text), (5, " ".join(f"w{i}" for i in range(60))), (5, "a\u00a0b # \n\nx\nx\n"), (None, "w " * 70)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n_words string")
    got = quality.apply_policy(quality.rule_ledger(docs)).collect()
    assert [r.n_words for r in got] == [0, 0, 0, 55, 60, 4, 70]
    assert [r.n_repeat_words for r in got] == [0, 0, 0, 55, 0, 0, 70]
    assert [r.kept for r in got] == [False, False, False, False, True, False, False]
    assert (got[5].word_chars, got[5].n_symbols, got[5].n_dup_lines) == (6, 1, 1)
    assert [r.doc_id for r in quality.keep_good(docs, "v2").collect()] == [5] == [r.doc_id for r in quality.keep_good(docs).collect()]
    short = spark.createDataFrame([(1, "Four words are here"), (2, "# # # #"), (3, ""), (4, None)], "doc_id long, text string")
    assert [r.doc_id for r in quality.keep_good(short).collect()] == [1] and quality.keep_good(short, "v2").count() == 0
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.rule_ledger(docs.where("doc_id < 0")).count() == 0
    ablation = {r.rule: r for r in quality.ablate(quality.rule_ledger(docs)).collect()}
    assert ablation["few_words"].n_failed == 4 and ablation["repeated_words"].n_only == 1


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 700, None: 300, "e": 0}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = [*sorted(x for x in sizes if x), None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * weight[s]) for s in sizes) < sum(sizes.values()) else (low, mid)
    assert got == pytest.approx({s: min(3 * sizes[s], low * weight[s]) for s in sizes})


@pytest.mark.parametrize("together", [50_000, 5])
def test_mix(spark, sf, monkeypatch, together):
    monkeypatch.setattr(mixing, "RANKED_TOGETHER", together)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix_sources(docs).collect()
    assert sorted(got) == sorted(mixing.mix_sources(docs).collect())
    words = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    assert {r.id: r.size for r in got} == words
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= max(0.01 * mine[0].target, min(r.size for r in mine if r.size))
        assert all(0 <= r.copies <= 3 for r in mine)


def test_rates_solve_the_dual(spark):
    rng = np.random.default_rng(1)
    groups = [("a", int(z), int(n)) for z, n in enumerate(rng.integers(1, 9, 40), 1)] + [("b", 5, 3), ("c", 0, 4)]
    size = {s: sum(z * n for x, z, n in groups if x == s) for s in "abc"}
    target = {"a": 2.2 * size["a"], "b": 0.4 * size["b"], "c": 0.0}
    got = mixing.balance(spark.createDataFrame(groups, "source string, size long, n long"), spark.createDataFrame([(s, size[s], target[s]) for s in "abc"], "source string, source_size long, target double")).collect()
    for s in "ab":
        assert sum(r.rate * r.size * r.n for r in got if r.source == s) == pytest.approx(target[s], rel=1e-6)
    free = [(r.size, np.log(r.rate)) for r in got if r.source == "a" and r.rate < 3 - 1e-9]
    assert np.ptp([y / x for x, y in free]) < 1e-6  # one tilt


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b", None), (1, "a b", None), (2, None, "s"), (3, "", "s"), (None, "x y z", "t"), (4, "q " * 500, "u")] + [(9, "same words here", "hot")] * 30
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    docs = docs.withColumnsRenamed({"size": "mix_rows"}).withColumn("h", docs["doc_id"]).withColumn("copies", docs["doc_id"]).withColumn("nth", docs["doc_id"])
    again = mixing.repeat_documents(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(docs.where("doc_id < 0")).count() == 0
    assert mixing.repeat_documents(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("together", [10_000, 7])
def test_copies_restated(spark, monkeypatch, together):
    """Copies of each document by the rule: sizes from large to small make up for what is left over, ranks go by hash."""
    monkeypatch.setattr(mixing, "RANKED_TOGETHER", together)
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 12))), ["a", "b", "c", None][int(rng.integers(0, 4))]) for i in range(300)] + [(7, "same text here", "a")] * 200
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for held in by.values():
        target, size = held[0].target, held[0].source_size
        assert size == sum(r.size for r in held)
        sizes, n = np.unique([r.size for r in held], return_counts=True)
        low, high = -50.0, 50.0
        for _ in range(200):
            tilt = (low + high) / 2
            low, high = (tilt, high) if (np.minimum(3, np.exp(tilt * sizes)) * sizes * n).sum() < target else (low, tilt)
        due, total = 0.0, {}
        for z, m, rate in sorted(zip(sizes.tolist(), n.tolist(), np.minimum(3, np.exp(low * sizes)).tolist(), strict=True), reverse=True):
            due += rate * m * z
            total[z] = int(np.clip(np.floor(due / z + 0.5), 0, 3 * m)) if z else 0
            due -= total[z] * z
        for z, k in total.items():
            mine = sorted(r.copies for r in held if r.size == z)
            assert sum(mine) == k and mine[-1] - mine[0] <= 1
    assert sorted(got, key=str) == sorted(mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect(), key=str)


def test_words_are_counted_in_linear_time(spark):
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", " a  b\nc ", "\x1ca\x85b", "a" + " " * 1_000_000 + "b", " " * 1_000_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", count_words(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [len((t or "").encode().split()) for t in texts]


def test_preference_pairs(spark):
    turns = [("p", "chosen", 0, "user", "hi"), ("p", "chosen", 1, "assistant", "yo"), ("p", "rejected", 0, "user", "hi"), ("p", "rejected", 1, "assistant", "no"), ("p", "rejected", 2, "user", None),
             ("q", "chosen", 0, "user", "a"), ("q", "rejected", 0, "user", "a"), ("r", "chosen", 0, None, "x"), (None, "chosen", 1, "assistant", "z"), (None, "rejected", None, "assistant", "z"), ("p", "other", 0, "user", "?")]
    got = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame([(*t, "x") for t in turns], "pair_id string, side string, turn int, role string, text string, prompt string")).collect()}
    p = got["p"]
    assert (p.prompt, p.n_prompt_turns) == ("<|user|>\nhi<|end|>\n", 1)
    assert p.chosen == "<|assistant|>\nyo<|end|>\n" and [p.chosen[s.start : s.end] for s in p.chosen_mask] == ["yo<|end|>\n"]
    assert p.rejected == "<|assistant|>\nno<|end|>\n<|user|>\n<|end|>\n" and [p.rejected[s.start : s.end] for s in p.rejected_mask] == ["no<|end|>\n"]
    assert (got["q"].chosen, got["q"].rejected, got["q"].n_prompt_turns) == ("", "", 1)
    assert (got["r"].prompt, got["r"].chosen, got["r"].rejected) == ("", "<|unknown|>\nx<|end|>\n", "")
    assert got[None].n_prompt_turns == 1
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.preference_pairs(chat.repeat_negatives(empty)).count() == 0


def test_no_python_in_chat_plans(spark, sf, capsys):
    QUERIES["op5_preference_chat"](spark, sf).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_names():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
