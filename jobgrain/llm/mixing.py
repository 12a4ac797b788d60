"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobgrain.llm.common import count_words, materialize, numbered

#: No document is taken more often than this, and no source's target exceeds this many times its size.
MOST = 3
#: Rows that one window partition ranks at most, about.
RANKED_TOGETHER = 10_000


def source_targets(sizes: DataFrame, weight_cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size -> also target, by water-filling: min(most * source_size, level * weight), where the level is
    such that the targets sum to all sizes. Weights repeat over the sources in code-point order, a null source last.

    The level starts where no source is full; sources below it are filled, what they leave raises it, until no more fill
    up. A round is one aggregation, and the driver sees its sums alone, so sources may be as many as web sites are.
    """
    last = F.col("source").isNull()
    ordered = sizes.withColumn("last", last).repartitionByRange("last", "source").sortWithinPartitions("last", "source").withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered.select("source", "source_size", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("nth")), "sources")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a written part
    ahead = ordered.groupBy("part").agg(F.count("*").alias("m")).select("part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("ahead"))
    place = (F.col("nth") + F.col("ahead")) % len(weight_cycle)
    weighed = ordered.join(ahead, "part").select("source", "source_size", F.element_at(F.array(*map(F.lit, weight_cycle)), (place + 1).cast("int")).alias("weight"))
    whole = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    level, open_weight = whole["size"] / max(1, whole["weight"]), whole["weight"]
    while open_weight:
        full = F.expr(f"{most} * source_size") <= F.lit(level) * F.col("weight")
        now = weighed.agg(F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)).alias("filled"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if now["weight"] == open_weight:
            break
        open_weight = now["weight"]
        level = (whole["size"] - now["filled"]) / open_weight if open_weight else math.inf
    return weighed.select("source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), F.lit(level) * F.col("weight")).cast("double").alias("target"))


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("source", "named")
    return left.join(right, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")


def rates(size: np.ndarray, n: np.ndarray, target: float, most: int = MOST, rounds: int = 100, tolerance: float = 1e-12) -> np.ndarray:
    """For one source's histogram: how often each document of a size is taken, min(most, exp(tilt * size / mean size)), with the
    tilt such that rates times sizes sum to target.

    These are the weights nearest in relative entropy to one copy of each document under the token constraint and the
    bound. The dual in the tilt is convex: Newton steps, kept inside a bracket where the bound flattens the slope. A
    source at its limit takes every document `most` times, and one without words has nothing to tilt.
    """
    words = float((size * n).sum())
    if not words or target >= most * words * (1 - 1e-12):
        return np.full(len(size), float(most) if words else 1.0)
    z = size / (words / n.sum())
    tilt, low, high = 0.0, -math.inf, math.inf
    for _ in range(rounds):
        rate = np.minimum(most, np.exp(np.minimum(tilt * z, 50.0)))
        miss = float((rate * size * n).sum()) - target
        if abs(miss) <= tolerance * target:
            break
        low, high = (tilt, high) if miss < 0 else (low, tilt)
        slope = float((rate * size * z * n)[rate < most].sum())
        step = tilt - miss / slope if slope > 0 else tilt - math.copysign(4, miss)
        step = max(tilt - 4, min(tilt + 4, step))
        if not low < step < high:
            step = (low + high) / 2
        if step == tilt:
            break
        tilt = step
    return np.minimum(most, np.exp(np.minimum(tilt * z, 50.0)))


def balance(groups: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n) histogram and the targets -> source, size, n, rate (see rates).

    The dual separates by source, so each source's Newton rounds run where its histogram is, all sources beside each
    other; a histogram has one row a size, however many documents there are.
    """

    def solve(h: pd.DataFrame) -> pd.DataFrame:
        return h[["source", "size", "n"]].assign(rate=rates(h["size"].to_numpy(np.float64), h["n"].to_numpy(np.float64), float(h["target"].iloc[0]), most))

    return _by_source(groups, targets.select("source", "target")).groupBy("source").applyInPandas(solve, "source string, size long, n long, rate double")


def _deal(most: int):
    """For one source's histogram: how many copies the n documents of each size take together. Sizes go from large to
    small and each makes up for what the larger ones left over, so a source ends within a small document of its target."""

    def deal(h: pd.DataFrame) -> pd.DataFrame:
        h = h.sort_values("size", ascending=False)
        due, total = 0.0, []
        for size, n, rate in zip(h["size"].to_numpy(), h["n"].to_numpy(), h["rate"].to_numpy(), strict=True):
            due += rate * n * size
            k = int(np.clip(np.floor(due / size + 0.5), 0, most * n)) if size else 0
            due -= k * size
            total.append(k)
        return pd.DataFrame({"source": h["source"], "size": h["size"], "n": h["n"], "total": total})

    return deal


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: int = 7) -> DataFrame:
    """One row a document: id, h (a hash of id and text), source, size (words; null text: 0), source_size, target, copies.

    Rates become whole copies: the n documents of one (source, size) take floor or ceil of their mean copies each, and
    which take one more is decided by a hash of id and text, so reruns agree and identical rows tie harmlessly.
    Documents without words take no copies. Repeated rows, null ids and null sources are handled like others; an empty
    table gives no rows; other columns of docs are ignored.

    The histogram of (source, size) is all that the rounds and the rounding read. Rows that agree in id and text are one
    class with a count; classes are ranked within one (source, size) in hash buckets of bounded size after the counts of
    the buckets before, and where a class gets a copy more for some of its rows alone, these are numbered part by part,
    so copies of one document that are a third of all rows still spread.
    """
    of = lambda c: F.col(f"`{c}`")
    keyed = docs.select(of(id_col).alias("id"), of(source_col).cast("string").alias("source"), count_words(of(text_col)).alias("size"), F.xxhash64(F.lit(seed), of(id_col), of(text_col)).alias("h"))
    slim = materialize(keyed.withColumn("row", F.monotonically_increasing_id()), "mix")
    classes = slim.groupBy("source", "size", "h").agg(F.count("*").alias("rows"))
    groups = materialize(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "mix")
    targets = materialize(source_targets(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weight_cycle, most), "mix")
    plan = balance(groups, targets, most).groupBy("source").applyInPandas(_deal(most), "source string, size long, n long, total long")
    plan = materialize(_by_source(plan, targets), "mix")
    same = classes["source"].eqNullSafe(plan["source"]) & (classes["size"] == plan["size"])
    bucket = F.when(F.col("n") > RANKED_TOGETHER, F.pmod("h", F.ceil(F.col("n") / RANKED_TOGETHER))).otherwise(0)
    sized = classes.join(plan, same).select(classes["source"], classes["size"], "h", "rows", "n", F.expr("total div n").alias("each"), F.expr("total % n").alias("more"), "source_size", "target", bucket.alias("bucket"))
    before = Window.partitionBy("source", "size", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("s", "z").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = sized.where(f"more > 0 AND n > {RANKED_TOGETHER}").groupBy(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b")).agg(F.sum("rows").alias("m"))
    offsets = counts.select("s", "z", "b", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead"))
    ranked = sized.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")), "left")
    left = F.col("more") - F.col("before") - F.coalesce("ahead", F.lit(0))  # for this class and those after it
    dealt = materialize(ranked.select(F.col("h").alias("k"), F.col("source").alias("s"), F.col("size").alias("z"), "rows", "source_size", "target", "each", F.greatest(F.lit(0), F.least("rows", left)).alias("extra")), "mix")
    met = slim.join(dealt, (F.col("h") == F.col("k")) & (F.col("size") == F.col("z")) & F.col("source").eqNullSafe(F.col("s")))
    out = ["id", "h", "source", "size", "source_size", "target"]
    clear = met.where("extra = 0 OR extra = rows").select(*out, (F.col("each") + (F.col("extra") > 0).cast("long")).alias("copies"))
    split = numbered(met.where("extra > 0 AND extra < rows"), ["h", "source", "size"], "row").select(*out, (F.col("each") + (F.col("nth") < F.col("extra")).cast("long")).alias("copies"))
    return clear.unionByName(split)


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, columns unchanged, whatever their names.

    Rows that agree in id and text share their copies evenly, the first of them taking what remains; null texts, empty ones
    and those without words go, null ids and null sources are handled like others, an empty table gives no rows.
    """
    of = lambda c: F.col(f"`{c}`")
    pooled = mix_sources(docs, id_col, text_col, source_col, seed=seed, **options).groupBy("h").agg(F.sum("copies").alias("pool"), F.count("*").alias("rows")).where("pool > 0")
    held = docs.select(F.struct(*map(of, docs.columns)).alias("doc"), F.xxhash64(F.lit(seed), of(id_col), of(text_col)).alias("h"), F.monotonically_increasing_id().alias("row"))
    met = held.join(pooled, "h")
    clear = met.where("pool % rows = 0").select("doc", F.expr("pool div rows").alias("copies"))
    split = numbered(met.where("pool % rows > 0"), ["h"], "row").select("doc", (F.expr("pool div rows") + (F.col("nth") < F.expr("pool % rows")).cast("long")).alias("copies"))
    every = clear.unionByName(split).where("copies > 0")
    return every.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*(F.col(f"doc.`{c}`") for c in docs.columns))
