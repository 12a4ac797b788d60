import random
from collections import Counter

from jobgrain.llm import suffixes


def brute(rows, passage=50):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    windows = Counter(tuple(w[k : k + passage]) for _, w in docs for k in range(len(w) - passage + 1))
    holder = {}
    for i, w in docs:
        for k in range(len(w) - passage + 1):
            x = tuple(w[k : k + passage])
            holder[x] = min(holder.get(x, i), i)
    out = []
    for i, w in docs:
        hit = [k for k in range(len(w) - passage + 1) if windows[tuple(w[k : k + passage])] > 1]
        runs = []
        for k in hit:
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        out += [(i, r[0], r[-1] + passage, min(holder[tuple(w[k : k + passage])] for k in r)) for r in runs]
    return sorted(out)


def got(df):
    return sorted((r.id, r.start_word, r.end_word, r.first_id) for r in df.collect())


def test_matches_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 60_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert want and got(suffixes.repeated_passages(docs)) == want


def planted(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 90, 400)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 120))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(0, len(p) // 2) if rng.random() < 0.4 else 0
            at = rng.choice((0, len(w)))
            w[at:at] = p[cut:]
        rows.append((i, " ".join(w)))
    return rows + [(7, rows[3][1]), (60, "x " * 120), (61, None), (62, ""), (63, " \n")]


def test_planted_passages(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 9_000)
    rows = planted()
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, id int, batch int, n_chars long")
    assert got(suffixes.repeated_passages(docs)) == brute(rows)
    assert got(suffixes.repeated_passages(docs.where("doc_id < 0"))) == []
    kept = suffixes.drop_repeats(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.where("doc_id <> 7 AND doc_id <> 60").collect()]
    assert [x for x in brute(left)] == []
    texts, repeats = dict(rows[:60]), {i for i, *_ in brute(rows)}
    assert all(t == texts[i] for i, t in left if i < 60 and i not in repeats)
    whole = {tuple((t or "").split()[k : k + 50]) for _, t in rows for k in range(len((t or "").split()) - 49)}
    after = {tuple((r.text or "").split()[k : k + 50]) for r in kept.collect() for k in range(len((r.text or "").split()) - 49)}
    assert len(whole - after) < len(whole)


def test_cut_keeps_the_rest():
    import numpy as np

    assert suffixes._cut(b"  a b\n c d  e ", np.array([0, 1, 1, 0, 0], bool)) == b"a d  e"
    assert suffixes._cut(b"a b ", np.array([0, 0], bool)) == b"a b "


def test_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 300)
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(9007199254740993, words + " x"), (None, words), (None, words + " y"), (9007199254740995, "z " + words)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, no_text int, n_chars long").repartition(3)
    found = sorted(((r.id or 0, r.start_word, r.end_word, r.first_id) for r in suffixes.repeated_passages(docs).collect()))
    first = 9007199254740993
    assert found == [(0, 0, 60, first), (0, 0, 60, first), (first, 0, 60, first), (9007199254740995, 1, 61, first)]
    kept = suffixes.drop_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted([words + " x", "y", "z"])
    alone = docs.where("doc_id IS NULL")
    assert sorted(len(r.text.split()) for r in suffixes.drop_repeats(alone).collect()) in ([1, 60], [61])
    assert {r.first_id for r in suffixes.repeated_passages(alone).collect()} == {None}
    twice = spark.createDataFrame([(5, words, 1), (5, words + " q", 1), (5, words, 1)], "doc_id long, text string, n_chars long")
    assert sum(r.text.split().count("w3") for r in suffixes.drop_repeats(twice).collect()) == 1
