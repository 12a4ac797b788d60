"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import connected_components, materialize
from jobgrain.llm.linking import ragged, roots

#: A table cell with more fingerprints than this is dealt out in chunks of about this many.
CELL = 4096
#: Pairs that a task compares at a time, and rows that it holds, about.
BLOCK, TASK_ROWS = 1 << 21, 150_000


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text: XXH64 of each shingle of `width` words, a bit is set if it is in over half of them."""
    words = text.lower().split()  # bytes.lower() lowers A-Z only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate(([0], end[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i:j], seed) for i, j in zip(begin[: 1 - width].tolist(), end[width - 1 :].tolist(), strict=True)], np.uint64)
    votes = sum(np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), 8192))
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id, h (a hash of id and text), fp (the 64 bits as a signed long) for every whole text; a null text counts as empty."""

    def batches(it):
        for b in it:
            fp = np.array([fingerprint(x or b"", width) for x in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["id", "h", "fp"])

    of = lambda c: F.col(f"`{c}`")
    slim = docs.select(of(id_col).alias("id"), F.xxhash64(of(id_col), of(text_col)).alias("h"), of(text_col).cast("binary").alias("text_bytes"))
    return slim.mapInArrow(batches, f"id {docs.schema[id_col].dataType.simpleString()}, h long, fp long")


def segment_bounds(radius: int, segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment; within `radius` bits over all, some segment differs by at most radius // segments."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _links(radius: int):
    """For the rows of one task: a spanning forest of the links between home fingerprints of each cell and the others."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cell", "home"], ascending=[True, False], kind="stable")
        cell, home, fp = rows["cell"].to_numpy(), rows["home"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        nodes, at = np.unique(rows["node"].to_numpy(), return_inverse=True)
        label = np.arange(len(nodes))
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(cell)])
        homes = np.add.reduceat(home.astype(np.int64), first) if len(cell) else size
        # each row after the first is compared with the home rows before it, so a cell without homes costs nothing
        place = np.arange(len(cell)) - np.repeat(first, size)
        against = np.minimum(place, np.repeat(homes, size))
        done = 0
        ends = np.cumsum(against)
        while done < len(cell):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BLOCK, "right")))
            who, nth = ragged(against[done:stop])
            x = who + done
            y = np.repeat(first, size)[x] + nth
            apart = label[at[x]] != label[at[y]]  # what is joined already needs no look
            x, y = x[apart], y[apart]
            near = np.bitwise_count(fp[x] ^ fp[y]) <= radius
            label = roots(len(nodes), at[x[near]], at[y[near]], label)
            done = stop
        tied = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[tied], "b": nodes[label[tied]]})

    return link


def _ball(segment: int, value: Column, flips: list[int]) -> Column:
    """The cells to look up around a segment's value: flips whose lowest bit goes from 0 to 1."""
    upward = F.filter(F.array(*(F.lit(m).cast("long") for m in flips)), lambda m: value.bitwiseAND(m).bitwiseAND(-m) == 0)
    return F.transform(upward, lambda m: F.struct(F.lit(segment).alias("seg"), value.bitwiseXOR(m).alias("value"), F.lit(False).alias("home")))


def hamming_links(prints: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """prints (fp, node: one row a distinct fingerprint) -> links a, b between nodes whose components are those of all
    pairs within `radius` bits. Exact; a forest of each bucket's links stands for all of them.

    Each fingerprint is stored in one table cell a segment, and looks up the cells of the small Hamming ball around its
    segment: with 3 segments and 4 bits some segment differs by at most one bit, so the ball has one flip of each bit; with
    2 segments, whose cells hold 2 ** 11 times fewer of a large corpus, it has two. Two neighbours would find each other
    twice, so only flips whose lowest bit goes from 0 to 1 are looked up. Cells are dealt to tasks by hash; a
    cell that very many share is cut into chunks, and each pair of chunks is a cell of its own.
    """
    homes, looks, width = [], [], segments
    for s, (low, bits) in enumerate(segment_bounds(radius, segments)):
        value = F.shiftrightunsigned("fp", low).bitwiseAND((1 << bits) - 1)
        homes.append(F.struct(F.lit(s).alias("seg"), value.alias("value"), F.lit(True).alias("home")))
        flips = [sum(1 << i for i in chosen) for k in range(1, radius // segments + 1) for chosen in combinations(range(bits), k)]
        if flips:
            width += len(flips) // 2
            looks.append(_ball(s, value, flips))
    prints = prints.select("fp", "node")
    hot = prints.select(F.explode(F.array(*homes)).alias("c")).groupBy("c.seg", "c.value").agg(F.count("*").alias("n")).where(f"n > {CELL}")
    hot = materialize(hot.select("seg", "value", F.ceil(F.col("n") / CELL).cast("int").alias("chunks")), "cells")
    placed = prints.select("fp", "node", F.explode(F.concat(F.array(*homes), *looks)).alias("c")).select("fp", "node", "c.*")
    n = max(1, prints.count() * width // TASK_ROWS)
    if hot.isEmpty():
        tasks = placed.select("fp", "node", "home", F.xxhash64("seg", "value").alias("cell"))
    else:
        many = placed.join(hot, ["seg", "value"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        every = F.sequence(F.lit(0), F.col("chunks") - 1)
        # a home row stands in row `chunk` of the square of chunk pairs, and as a guest in its column above the diagonal; a look stands in its column
        stands = F.when(F.col("home"), F.transform(every, lambda j: F.struct(chunk.alias("i"), j.alias("j"), F.lit(True).alias("home")))).otherwise(F.array().cast("array<struct<i:int,j:int,home:boolean>>"))
        visits = F.filter(F.transform(every, lambda i: F.struct(i.alias("i"), chunk.alias("j"), F.lit(False).alias("home"))), lambda x: ~F.col("home") | (x["i"] < chunk))
        tasks = many.select("fp", "node", "seg", "value", F.explode(F.concat(stands, visits)).alias("p")).select("fp", "node", "p.home", F.xxhash64("seg", "value", "p.i", "p.j").alias("cell"))
    return tasks.groupBy(F.pmod("cell", F.lit(n)).alias("task")).applyInPandas(_links(radius), "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, radius: int, segments: int, width: int) -> tuple[DataFrame, DataFrame]:
    """prints: id, h, fp of each document; classes: fp, group of each fingerprint, where group is the smallest that links reach."""
    prints = materialize(fingerprints(docs, id_col, text_col, width), "prints")
    classes = materialize(prints.select("fp").distinct(), "classes")
    joined = connected_components(hamming_links(classes.withColumn("node", F.col("fp")), radius, segments))
    return prints, materialize(classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("group")), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, segments: int = 3, width: int = 4) -> DataFrame:
    """One row a document: id_col, fp, component_id (the smallest id that links of `radius` bits or fewer reach).

    Documents with one fingerprint are one class, so groups of copies of any size cost one row; links are sought between
    classes, and each document takes the smallest id of the classes that its own reaches. Texts without words have
    fingerprint zero and link like any other. Null ids take part as the largest; where there are no others, component_id
    is null. Ids may be of any type that has an order. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    prints, classes = _classes(docs, id_col, text_col, radius, segments, width)
    least = prints.groupBy("fp").agg(F.min("id").alias("least")).join(classes, "fp")
    named = classes.join(least.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, segments: int = 3, width: int = 4) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest id, a null id being the largest; among
    texts that share the id the one with the smallest hash; of identical rows one. All columns stay, whatever their
    names; a null text is empty; an empty table gives no rows."""
    of = lambda c: F.col(f"`{c}`")
    prints, classes = _classes(docs, id_col, text_col, radius, segments, width)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    first = prints.groupBy("fp").agg(F.min(order).alias("first")).join(classes, "fp")
    stay = first.groupBy("group").agg(F.min("first").alias("first")).select("first.id", "first.h")
    held = docs.select(F.struct(*map(of, docs.columns)).alias("doc"), of(id_col).alias("own"), F.xxhash64(of(id_col), of(text_col)).alias("own_h"))
    many = prints.groupBy("id", "h").agg(F.count("*").alias("n"))
    stay = stay.join(many, stay["h"].eqNullSafe(many["h"]) & stay["id"].eqNullSafe(many["id"])).select(stay["id"], stay["h"], "n")
    met = held.join(stay, held["own_h"].eqNullSafe(stay["h"]) & held["own"].eqNullSafe(stay["id"]))
    once, again = met.where("n = 1"), met.where("n > 1").dropDuplicates(["own", "own_h"])
    return once.select("doc.*").unionByName(again.select("doc.*"))
