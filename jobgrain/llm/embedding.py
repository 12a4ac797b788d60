"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import connected_components, materialize
from jobgrain.llm.linking import roots

#: A label or cell with more vectors than this is cut further.
CELL = 8192
#: What names a cell: its cell is the path of its sides, level by level.
AT = ["label", "width", "block", "cell"]
#: Vectors that one task compares at a time with as many others, and pairs that it verifies at a time.
BLOCK, PAIRS = 1024, 1 << 17
#: By how much a squared distance in single precision may be off.
ROUGH = 1e-5


def rotation(width: int, seed: int = 11) -> np.ndarray:
    """A fixed random rotation: it spreads the distance of a pair evenly over the coordinates, whatever the data."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def block_bounds(width: int, blocks: int) -> list[tuple[int, int]]:
    cuts = [width * i // blocks for i in range(blocks + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _units(vectors) -> np.ndarray:
    """Vectors of one length scaled to length one, safely for very large and very small components."""
    v = np.stack(vectors).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _turned(blocks: int, axes: int | None, budget: float):
    """One row a vector and block: x, the coordinates of the block that cuts use, and limit, the block's share of the budget."""

    def turn(it):
        for rows in it:
            for width, same in rows.groupby("width"):
                turned = _units(same["embedding"].to_numpy()) @ rotation(int(width))
                for k, (low, high) in enumerate(block_bounds(int(width), blocks)):
                    x = turned[:, low : high if axes is None else min(high, low + axes)]
                    yield same.assign(block=k, x=list(x), limit=budget * (high - low) / width * (1 + 1e-9))[["node", "label", "width", "n", "embedding", "block", "x", "limit"]]

    return turn


def _median_cuts(turned: DataFrame) -> list[DataFrame]:
    """Cuts of cells that hold more than CELL vectors, level by level: label, width, block, cell -> cut. A level cuts at the
    median of one axis, and the next level of the next axis. Cells that no axis can part any more stay as they are."""
    homes, levels, quiet = turned.select("label", "width", "block", F.lit("").alias("cell"), "x"), [], 0
    axes = turned.agg(F.max(F.size("x"))).first()[0] or 0
    while quiet < axes:
        x = F.get("x", F.lit(len(levels)) % F.size("x"))
        seen = homes.groupBy(*AT).agg(F.count("*").alias("m"), F.percentile_approx(x, 0.5, 1000).alias("mid"), F.min(x).alias("low"), F.max(x).alias("high")).where(f"m > {CELL}")
        between = F.when(F.col("mid") > F.col("low"), F.col("mid")).otherwise(F.col("high"))
        full = materialize(seen.select(*AT, F.when(F.col("low") < F.col("high"), between).alias("cut")), "cuts")
        crowded, cut = full.agg(F.count("*"), F.count("cut")).first()
        if not crowded:
            break
        quiet = 0 if cut else quiet + 1
        side = F.when(F.col("cut").isNull(), "").when(x < F.col("cut"), "0").otherwise("1")
        homes = materialize(homes.join(full, AT).select("label", "width", "block", F.concat("cell", side).alias("cell"), "x"), "homes")
        levels.append(full.where("cut IS NOT NULL"))
    return levels


def _descend(rows: DataFrame, cuts: DataFrame, level: int) -> DataFrame:
    """Rows of one level of cells -> rows of the next. Each goes to its own side of the cut. A visitor goes to the other side
    as well, and a vector at home on the right begins a visit to the left, where the squared distance to that cell, added
    up over all axes cut so far, is within the limit. So a pair meets in the home cell of one of the two."""
    axis = F.lit(level) % F.size("x")
    x, off, cut = F.get("x", axis), F.get("off", axis), F.col("cut")
    over = F.greatest(off, F.abs(x - cut))
    far = F.col("far") - off * off + over * over
    step = lambda cell, off, far, home: F.struct(cell.alias("cell"), off.alias("off"), far.alias("far"), home.alias("home"))
    beside = F.concat("cell", F.when(x < cut, "0").otherwise("1"))
    across = F.concat("cell", F.when(x < cut, "1").otherwise("0"))
    stays = step(F.when(cut.isNull(), F.col("cell")).otherwise(beside), F.col("off"), F.col("far"), F.col("home"))
    goes = step(across, F.transform("off", lambda o, i: F.when(i == axis, over).otherwise(o)), far, F.lit(False))
    both = F.coalesce((far <= F.col("limit")) & (~F.col("home") | (x >= cut)), F.lit(False))
    fixed = [c for c in rows.columns if c not in ("cell", "off", "far", "home")]
    met = rows.join(cuts, AT, "left").withColumn("next", F.explode(F.when(both, F.array(stays, goes)).otherwise(F.array(stays))))
    return met.select(*fixed, "next.*")


def _compare(blocks: int, budget: float, threshold: float):
    """Links of the home vectors of one cell among themselves and with its visitors, each pair in one block only: the
    first whose share of the distance is within its budget. A cell of no block is a whole label, and all its blocks are
    joined at once. Gives counts of linked rows a node, and a forest of links."""

    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        width, block = int(key[1]), int(key[2])
        bounds = block_bounds(width, blocks)
        limits = [budget * (b - a) / width * (1 + 1e-9) for a, b in bounds]
        rows = rows.drop_duplicates(["node", "home"])
        home = rows["home"].to_numpy()
        node, n = rows["node"].to_numpy(), rows["n"].to_numpy()
        unit = _units(rows["embedding"].to_numpy())
        parts = unit @ rotation(width)
        links = np.zeros(len(rows), np.int64)
        label = np.arange(len(rows))
        mine, diagonal = np.flatnonzero(home), bool(rows["diagonal"].iloc[0])

        def verify(k: int, a: np.ndarray, b: np.ndarray) -> None:
            nonlocal label
            low, high = bounds[k]
            sure = ((parts[a, low:high] - parts[b, low:high]) ** 2).sum(axis=1) <= limits[k]
            for m, (low, high) in enumerate(bounds[:k]):
                sure[sure] = ((parts[a[sure], low:high] - parts[b[sure], low:high]) ** 2).sum(axis=1) > limits[m]
            sure[sure] = np.einsum("ij,ij->i", unit[a[sure]], unit[b[sure]]) >= threshold
            a, b = a[sure], b[sure]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            label = roots(len(rows), a, b, label)

        for k in range(len(bounds)) if block < 0 else (block,):
            x, y = _sides(parts[:, slice(*bounds[k])].astype(np.float32))
            for i in range(0, len(mine), BLOCK):
                some = mine[i : i + BLOCK]
                others = np.r_[mine[i:], np.flatnonzero(~home)] if diagonal else np.flatnonzero(~home)
                for j in range(0, len(others), BLOCK):
                    more = others[j : j + BLOCK]
                    at = np.flatnonzero(x[some] @ y[more].T <= limits[k] + ROUGH)
                    a, b = some[at // len(more)], more[at % len(more)]
                    fresh = ~home[b] | (b > a)
                    a, b = a[fresh], b[fresh]
                    for c in range(0, len(a), PAIRS):
                        verify(k, a[c : c + PAIRS], b[c : c + PAIRS])
        out = pd.DataFrame({"node": node, "links": links, "other": node[label]})
        return out[(out["links"] > 0) | (out["node"] != out["other"])]

    return compare


def _sides(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x, y such that x @ y.T has the squared distances between all rows of v."""
    square, one = (v * v).sum(axis=1, keepdims=True), np.ones((len(v), 1), v.dtype)
    return np.hstack([-2 * v, square, one]), np.hstack([v, one, square])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, blocks: int = 4, axes: int | None = None) -> DataFrame:
    """One row a vector: id_col, n_links (other rows of its label with a cosine of `threshold` or more), component_id
    (the smallest id that links reach), kept (it is that id).

    Vectors of length one with a cosine of t are at a squared distance of 2 - 2t. After a rotation each is cut into
    blocks, and each block gets a share of that budget in proportion to its width; a pair within the whole budget is
    within the share of some block. So each block is range-joined on its own, and the union of candidates is verified
    exactly in double precision. A pair that several blocks find is taken from the first of them.

    A label of at most CELL classes is one task, to which each vector goes once, and which joins block after block. A
    larger one is parted block by block by recursive median cuts over all axes of the block (or its first `axes`) until no cell
    holds more, and a vector visits the cells that its block's share of the distance reaches, summed over the axes; a cell that
    cuts cannot part, or that very many visit, is cut into chunks and every pair of chunks compared apart.

    Equal vectors of one label are one class with a count, so copies cost one row. Tasks return counts and a forest of
    links, never all pairs.

    A vector that is null, empty, zero or has null or non-finite components, and one with a null label or null id, links with
    nothing. Vectors of different lengths never link. Rows that repeat an id are vectors of their own in counts and
    share the id's component. Other columns are ignored; an empty table gives no rows.
    """
    of = lambda c: F.col(f"`{c}`")
    rows = vectors.select(of(id_col).alias("id"), of(label_col).alias("label"), F.transform(of(vector_col), lambda x: x.cast("double")).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    keyed = rows.withColumn("usable", F.coalesce(finite & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    classes = keyed.where("usable").groupBy("label", F.transform("embedding", lambda x: x + 0.0).alias("embedding")).agg(F.min("id").alias("node"), F.count("*").alias("n"))
    # ids may repeat in other classes, so a class is named by a number of its own: a hash of what it holds
    classes = materialize(classes.withColumn("class", F.xxhash64("label", "embedding")), "classes")
    budget = 2 - 2 * threshold
    rows = classes.select(F.col("class").alias("node"), "label", F.size("embedding").alias("width"), "n", "embedding")
    place = lambda block, cell, home: {"block": F.lit(block), "cell": F.lit(cell), "home": F.lit(home), "i": F.lit(0), "j": F.lit(0)}
    crowded = materialize(rows.groupBy("label", "width").agg(F.count("*").alias("m")).where(f"m > {CELL}").drop("m"), "crowded")
    if crowded.isEmpty():
        dealt = rows.withColumns(place(-1, "", True))
    else:
        large = rows.join(crowded, ["label", "width"], "left_semi").select(*rows.columns)
        kinds = f"node long, label {rows.schema['label'].dataType.simpleString()}, width int, n long, embedding array<double>"
        turned = materialize(large.mapInPandas(_turned(blocks, axes, budget), f"{kinds}, block int, x array<double>, limit double"), "turned")
        cells = turned.withColumns({"cell": F.lit(""), "off": F.transform("x", lambda x: F.lit(0.0)), "far": F.lit(0.0), "home": F.lit(True)})
        for level, cuts in enumerate(_median_cuts(turned)):
            cells = _descend(cells, cuts, level)
        cells = cells.select(*rows.columns, "block", "cell", "home")
        hot = materialize(cells.groupBy(*AT).agg(F.count("*").alias("m")).where(f"m > {CELL}").select(*AT, F.ceil(F.col("m") / CELL).cast("int").alias("chunks")), "hot")
        many = cells.join(hot, AT, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        chunk, every = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), F.sequence(F.lit(0), F.col("chunks") - 1)
        stands = F.when(F.col("home"), F.transform(every, lambda j: F.struct(chunk.alias("i"), j.alias("j"), F.lit(True).alias("home"))))
        visits = F.filter(F.transform(every, lambda i: F.struct(i.alias("i"), chunk.alias("j"), F.lit(False).alias("home"))), lambda x: ~F.col("home") | (x["i"] < chunk))
        placed = many.withColumn("p", F.explode(F.concat(F.coalesce(stands, F.array().cast("array<struct<i:int,j:int,home:boolean>>")), visits)))
        dealt = rows.join(crowded, ["label", "width"], "left_anti").select(*rows.columns).withColumns(place(-1, "", True)).unionByName(placed.select(*rows.columns, "block", "cell", "p.home", "p.i", "p.j"))
    found = dealt.withColumn("diagonal", F.col("i") == F.col("j")).groupBy("label", "width", "block", "cell", "i", "j").applyInPandas(_compare(blocks, budget, threshold), "node long, links long, other long")
    found = materialize(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("class", "node")
    a, b = named.select(F.col("class").alias("node"), F.col("node").alias("a")), named.select(F.col("class").alias("other"), F.col("node").alias("b"))
    edges = found.where("node <> other").select("node", "other").distinct().join(a, "node").join(b, "other").select("a", "b")
    copies = keyed.where("usable").select(F.col("id").alias("a"), F.xxhash64("label", F.transform("embedding", lambda x: x + 0.0)).alias("other"))
    same = copies.join(b, "other").where("a <> b").select("a", "b")  # each row belongs to its class
    joined = connected_components(edges.unionByName(same))
    answer = keyed.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", F.transform("embedding", lambda x: x + 0.0))))
    answer = answer.join(classes.select(F.col("class").alias("node"), "n").join(links, "node", "left"), "node", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return answer.select(F.col("id").alias(id_col), (F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
