"""Ranked lexical search the other way round: the items wait in an inverted index, the documents stream past."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobgrain.llm.common import discard, materialize
from jobgrain.llm.linking import ragged

#: Bytes of text and items that one index holds at most (more items take more indexes, one after the other), but for one longer item.
INDEX_BYTES, INDEX_ITEMS = 8 << 20, 5_000
#: Scores of documents and items that a worker holds at a time.
CELLS = 1 << 21
#: Groups into which tasks are dealt when their heaps meet, before the groups meet.
MEET = 1_000

#: What parts terms in ASCII becomes a space, capitals become small; all other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The maximal matches of [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+, A-Z lower-cased."""
    return text.translate(_FOLD).split()


class ItemIndex:
    """Terms of some items, and by term the items that hold it, with how often."""

    def __init__(self, texts: list[bytes]):
        self.items = len(texts)
        self.terms: dict[bytes, int] = {}
        codes, item = [], []
        for i, t in enumerate(texts):
            got = [self.terms.setdefault(w, len(self.terms)) for w in terms_of(t)]
            codes += got
            item += [i] * len(got)
        key, times = np.unique(np.array(codes, np.int64) * max(1, self.items) + np.array(item, np.int64), return_counts=True)
        term, self.item = np.divmod(key, max(1, self.items))
        self.times = times.astype(np.int64)
        self.begin = np.searchsorted(term, np.arange(len(self.terms) + 1))


def _count(index):
    """Of each document with a term: how many it has, and how often each of the index's terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = index.value.terms
        width = max(1, len(terms))
        for batch in batches:
            n = np.zeros(len(batch), np.int64)
            codes: list[int] = []
            held = np.zeros(len(batch), np.int64)
            for d, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                n[d] = len(words)
                found = [terms[w] for w in words if w in terms]
                codes += found
                held[d] = len(found)
            key, tf = np.unique(np.repeat(np.arange(len(batch)), held) * width + np.array(codes, np.int64), return_counts=True)
            doc, term = np.divmod(key, width)
            offsets = pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((term, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    return count


class Heaps:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.best: pa.Table | None = None
        self.least = np.ones(items, np.int64)  # a document with less is none of the best

    def offer(self, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: one row a document, one column an item."""
        bar = self.least
        if len(scores) > self.top:
            bar = np.maximum(bar, np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top])
        doc, item = np.nonzero(scores >= bar)
        if not len(doc):
            return
        new = pa.table({"item": pa.array(item, pa.int64()), "score": scores[doc, item], "id": ids.take(pa.array(doc))})
        all_ = (pa.concat_tables([self.best, new]) if self.best is not None else new).combine_chunks()
        all_ = all_.sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending")])  # nulls go last
        item = all_["item"].to_numpy()
        head = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        nth = np.arange(len(item)) - np.repeat(head, np.diff(np.r_[head, len(item)]))
        self.best = all_.filter(pa.array(nth < self.top))
        full = nth == self.top - 1
        self.least[item[full]] = all_["score"].to_numpy()[full]


def _rank(index, weights, n_docs: int, n_terms: int, top: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, w = index.value, weights.value
        postings = np.diff(ix.begin)
        heaps = Heaps(ix.items, top)
        together = max(1, CELLS // max(1, ix.items))
        for batch in batches:
            for start in range(0, len(batch), together):
                some = batch.slice(start, together)
                m = np.array([75 + 25 * n * n_docs // n_terms for n in some.column(1).to_pylist()], np.int64)  # of any size until here
                counts = some.column(2).value_lengths().to_numpy()
                doc, term, tf = np.repeat(np.arange(len(some)), counts), some.column(2).flatten().to_numpy(), some.column(3).flatten().to_numpy()
                part = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                scores = np.zeros(len(some) * ix.items, np.int64)
                cut = np.searchsorted(np.cumsum(postings[term]), np.arange(CELLS, int(postings[term].sum()) + CELLS, CELLS), "right")
                done = 0
                for k in np.unique(np.r_[cut, len(term)]).tolist():
                    row, place = ragged(postings[term[done:k]])
                    row += done
                    at = ix.begin[term[row]] + place
                    np.add.at(scores, doc[row] * ix.items + ix.item[at], part[row] * ix.times[at])
                    done = k
                heaps.offer(scores.reshape(len(some), ix.items), some.column(0))
        if heaps.best is not None:
            task = pa.array(np.full(len(heaps.best), TaskContext.get().partitionId(), np.int64))
            yield from heaps.best.append_column("task", task).combine_chunks().to_batches()

    return rank


def _best(df: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The first `top` rows of each group by score, then id, with their rank. Spark keeps as few in each task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _blocks(items: DataFrame) -> int:
    """Into how many indexes items are dealt, so that each is small enough unless it holds one item alone."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // INDEX_ITEMS), -(-size // INDEX_BYTES))
    while blocks > 1:
        held = items.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
        if not held.where((F.col("n") > 1) & ((F.col("size") > 2 * INDEX_BYTES) | (F.col("n") > 2 * INDEX_ITEMS))).count():
            break
        blocks *= 2
    return blocks


def search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The `top` documents of each item: item_id, rank (from 1), doc_id, score, for scores above 0, equal ones by id.

    A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))); a document of n terms has m = 75 + (25 n N) div L; its score sums
    weight * ((10 ** 9 tf) div (1000 tf + 12 m)) over the item's terms with repeats. N counts documents with a term, L all
    their terms, df those that hold the term. Terms are runs of letters and digits in ASCII and of all characters beyond.

    The items' terms make an inverted index, which goes to every worker: of bounded size, as many items take several
    indexes one after the other, each with a pass over the documents. A pass reads the texts once and writes how
    often each document holds the index's terms; counts of documents come from that, then scores in 64-bit integers. A
    task keeps a heap of `top` documents an item, heaps meet in groups of tasks, groups meet by item: no group
    grows with the documents, and a word that every document holds is a number a document.

    Null texts have no terms; items without terms have no rows; items are answered row by row, so a repeated item_id is answered
    twice; repeated documents each count and rank, null ids last among equals; other columns are ignored; an empty
    table on either side gives no rows.
    """
    spark = docs.sparkSession
    of = lambda c: F.col(f"`{c}`")
    binary = lambda c: F.coalesce(of(c), F.lit("")).cast("binary").alias("text")
    asked = materialize(items.select(F.monotonically_increasing_id().alias("item"), of(item_col).alias("item_id"), binary(item_text_col)), "items")
    slim = docs.select(of(id_col).alias("id"), binary(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = _blocks(asked)
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").collect()  # bounded, see _blocks
        index = spark.sparkContext.broadcast(ItemIndex([bytes(r.text) for r in block]))
        counts = materialize(slim.mapInArrow(_count(index), f"id {kind}, n long, terms array<int>, tf array<long>"), "term_counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(index.value.terms), np.int64)
        for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of the index
            df[term] = n
        weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64))
        heaps = materialize(counts.mapInArrow(_rank(index, weights, n_docs, n_terms, top), f"item long, score long, id {kind}, task long"), "heaps")
        discard(counts)
        groups = _best(heaps.withColumn("meet", F.pmod("task", F.lit(MEET))), ["item", "meet"], top).drop("rank")
        best = _best(groups, ["item"], top)
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(block)], "item long, number long")
        best = best.join(names, "item").select(F.col("number").alias("item"), "rank", "id", "score")
        found = best if found is None else found.unionByName(best)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
