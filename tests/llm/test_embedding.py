import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import vector_links
from jobgrain.llm import embedding


def got(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_matches_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    found = embedding.near_vectors(table)
    want = vector_links(rows)
    assert got(found) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.collect())


@pytest.mark.parametrize("axes,cell", [(2, 8192), (2, 30), (1, 9), (3, 60)])
def test_dense_groups_near_the_threshold(spark, monkeypatch, axes, cell):
    monkeypatch.setattr(embedding, "CELL", cell)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((4, 24))
    v = centre[rng.integers(0, 4, 160)] + rng.standard_normal((160, 24)) * 0.27
    v[40:60] = v[40]
    rows = [(i, int(i % 2), [float(np.float32(x)) for x in v[i]]) for i in range(160)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert got(embedding.near_vectors(table, axes=axes)) == vector_links(rows)


def test_odd_rows(spark):
    rows = [(1, 1, None), (2, 1, []), (3, 1, [0.0, 0.0]), (4, 1, [1.0, None]), (5, 1, [math.nan, 1.0]), (6, 1, [math.inf, 1.0]), (7, None, [1.0, 0.0]), (8, 1, [1.0, 0.0]), (9, 1, [2.0, 0.0]), (10, 1, [-0.0, 1.0]), (11, 1, [0.0, 1.0]), (12, 2, [0.0, 1.0]), (13, 1, [0.0, 1.0, 0.0])]
    rows += [(14, 3, [1e300, 2e300]), (15, 3, [1e-300, 2e-300]), (16, 3, [1.7e308, -1.7e308])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, n string")
    want = vector_links(rows[:-3]) | {14: (1, 14), 15: (1, 14), 16: (0, 16)}
    assert got(embedding.near_vectors(table)) == want
    assert embedding.near_vectors(table.where("vec_id < 0")).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [0.0, 1.0]), (None, 1, [1.0, 0.0]), (3, 1, [1.0, 0.01])]
    found = embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in found), key=str) == [(0, 0, None, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_cells_are_parted_by_medians(spark, monkeypatch):
    monkeypatch.setattr(embedding, "CELL", 25)
    v = np.random.default_rng(7).standard_normal((800, 16))
    rows = spark.createDataFrame([(i, 1, 16, 1, x.tolist()) for i, x in enumerate(v)], "node long, label int, width int, n long, embedding array<double>")
    turned = rows.mapInPandas(embedding._turned(4, None, 0.14), "node long, label int, width int, n long, embedding array<double>, block int, x array<double>, limit double").cache()
    levels = embedding._median_cuts(turned)
    assert len(levels) >= 5
    cells = turned.withColumns({"cell": F.lit(""), "off": F.transform("x", lambda x: F.lit(0.0)), "far": F.lit(0.0), "home": F.lit(True)})
    for level, cuts in enumerate(levels):
        cells = embedding._descend(cells, cuts, level)
    held = {}
    for r in cells.select("block", "cell", "node", "home").collect():
        held.setdefault((r.block, r.cell), ([], []))[0 if r.home else 1].append(r.node)
    assert max(len(home) for home, _ in held.values()) <= 25
    for block in range(4):
        mine = [x for (b, _), x in held.items() if b == block]
        assert sorted(i for home, _ in mine for i in home) == list(range(800))
        beside = [(min(i, j), max(i, j)) for home, visits in mine for i in home for j in [*(k for k in home if k > i), *visits]]
        assert len(beside) == len(set(beside)) < 0.6 * 800 * 799 / 2
        x = embedding._units(list(v)) @ embedding.rotation(16)[:, 4 * block : 4 * block + 4]
        near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.14 * 4 / 16
        assert {(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)} <= set(beside)
    alike = spark.createDataFrame([(1, 16, 0, [0.5, 0.5])] * 60, "label int, width int, block int, x array<double>")
    assert sum(cuts.count() for cuts in embedding._median_cuts(alike)) == 0
    some = spark.createDataFrame([(1, 16, 0, [0.5, 0.0 if i else -1.0]) for i in range(60)], "label int, width int, block int, x array<double>")
    assert sum(cuts.count() for cuts in embedding._median_cuts(some)) == 1
