import random

from brute import components, simhash_components
from jobgrain.llm import simhash


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fp, comp = simhash_components(texts)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fp[i], comp[i]) for i in texts}
    assert len(set(comp.values())) < len(comp)


def test_links_of_dense_and_hot_cells(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(60)})
    rows = [(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)]
    want = components(range(len(prints)), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    for cell, segments in ((4096, 3), (7, 3), (4096, 2), (9, 5)):
        monkeypatch.setattr(simhash, "CELL", cell)
        links = simhash.hamming_links(spark.createDataFrame(rows, "fp long, node long"), segments=segments).collect()
        assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 64 for r in links)
        assert components(range(len(prints)), [(r.a, r.b) for r in links]) == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "y"), (4, "a b", "y"), (5, "A  B", "z"), (5, "A  B", "z"), (None, "q r s t u", "z"), (6, "w " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or 99, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6), (99, None)]  # the null id stands alone
    assert simhash.near_duplicates(docs.where("doc_id < 0")).count() == 0
    assert sorted(r.doc_id or 99 for r in simhash.drop_near_duplicates(docs).collect()) == [1, 4, 6, 99]


def test_ids_that_are_null_or_repeated_or_text(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(None, a, 1), (None, a, 2), (7, b, 3), (7, a, 4), (8, b, 5), (9007199254740993, "other words altogether here", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_rows int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(7, a), (7, b), (9007199254740993, "other words altogether here")])
    named = spark.createDataFrame([("x", a), ("b", a), (None, b)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.component_id) for r in simhash.near_duplicates(named).collect()) == [("", None), ("b", "b"), ("x", "b")]
    nulls = spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")
    assert sorted(r.text for r in simhash.drop_near_duplicates(nulls).collect()) == sorted([a, b])
