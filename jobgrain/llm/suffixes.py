"""Passages that repeat across documents, by sparse suffixes at content-selected positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jobgrain.llm.common import materialize, placed
from jobgrain.llm.exchange import bucket_of, merge, receive, receive_values, send, send_values

#: Bytes of text that one batch holds, about.
BATCH_BYTES = 6 << 20
#: Words of a suffix's key. With at least 50 words to a passage, every passage then holds a selected suffix.
KEY_WORDS = 16
#: Fixed odd number whose powers weigh the words of a window.
BASE = 0x9E3779B97F4A7C15
#: Stands for a null id, so that ids stay integers in a task; it is the largest.
NOBODY = np.iinfo(np.int64).max
#: Who holds a window first: the id, then a hash of the row's place, which parts rows that share an id.
OWNER = np.dtype([("id", "<i8"), ("row", "<i8")])


def _scan(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i:i+n] for each i, cut short at the end."""
    out, have = x.copy(), 1
    while have < n:
        step = min(have, n - have)
        out[:-step] = pick(out[:-step], out[step:]) if step < len(out) else out[:-step]
        have += step
    return out


class Batch:
    """The words of some documents one after the other, with hashes of their windows."""

    def __init__(self, texts: list[bytes], passage: int):
        known: dict[bytes, int] = {}
        codes: list[int] = []
        lengths = []
        for text in texts:
            words = text.split()
            codes += [known.setdefault(w, len(known)) for w in words]
            lengths.append(len(words))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
        self.words = hashes[np.array(codes, np.int64)] if codes else np.zeros(0, np.uint64)
        self.lengths = np.array(lengths, np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        up = np.full(n + 1, BASE, np.uint64)
        up[0] = 1
        up = np.cumprod(up, dtype=np.uint64)
        down = np.full(n + 1, pow(BASE, -1, 2**64), np.uint64)
        down[0] = 1
        down = np.cumprod(down, dtype=np.uint64)
        self.up, self.sums = up, np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * down[:n], dtype=np.uint64)])
        whole = np.maximum(0, self.lengths - passage + 1)
        self.window = np.zeros(n, bool)  # a passage begins here and ends within the document
        row = np.repeat(np.arange(len(whole)), whole)
        self.window[self.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)] = True

    def hashed(self, size: int) -> np.ndarray:
        """Hash of the `size` words at each position that has so many after it in the batch."""
        n = max(0, len(self.words) - size + 1)
        x = (self.sums[size : size + n] - self.sums[:n]) * self.up[:n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def suffixes(self, passage: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the retained suffixes, and for each window's position the key of the suffix that it selects.

        A window selects the least of its keys, which depends on its words alone, so equal windows select equal suffixes.
        """
        keys, span = self.hashed(KEY_WORDS), passage - KEY_WORDS + 1
        at = np.flatnonzero(self.window)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        least = _scan(keys, span, np.minimum)
        shown = np.zeros(len(keys), np.uint64)
        shown[at] = least[at]
        most = _scan(shown[::-1], span, np.maximum)[::-1]
        return keys[(most == keys) & (keys > 0)], least[at]


def _ask_suffixes(passage: int, buckets: int):
    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.unique(Batch(rows["text"], passage).suffixes(passage)[0], return_counts=True)
        return _parcels(rows["batch"].iloc[0], buckets, keys, counts)

    return ask


def _parcels(batch, buckets: int, keys: np.ndarray, counts: np.ndarray, owners: np.ndarray | None = None) -> pd.DataFrame:
    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    parts = [(p, i, j) for p, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
    return pd.DataFrame({"batch": [batch] * len(parts), "bucket": [p for p, _, _ in parts], "data": [send(keys[i:j], np.minimum(counts[i:j], 2)) for _, i, j in parts], "owners": [owners[i:j].tobytes() if owners is not None else None for _, i, j in parts]})


def _neighbours(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of sorted suffixes: for each batch, which of its keys have an equal neighbour."""
    sent = [receive(d) for d in rows["data"]]
    keys, total = merge(sent)
    return pd.DataFrame({"batch": rows["batch"], "bucket": rows["bucket"], "stage": 1, "data": [send_values((total[np.searchsorted(keys, k)] > 1).astype(np.int64)) for k, _ in sent], "owners": None})


def _order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["id", "h", "text"], kind="stable")


def _owners(rows: pd.DataFrame, doc: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), OWNER)
    out["id"], out["row"] = rows["id"].to_numpy(np.int64)[doc], rows["h"].to_numpy(np.int64)[doc]
    return out


def _candidates(rows: pd.DataFrame, replies: pd.DataFrame, passage: int):
    """Positions of the windows around shared suffixes, their hashes, and the batch."""
    b = Batch(rows["text"], passage)
    keys, selected = b.suffixes(passage)
    keys = np.unique(keys)
    replies = replies.sort_values("bucket")
    shared = np.concatenate([receive_values(d) for d in replies["data"]]).astype(bool) if len(replies) else np.zeros(0, bool)
    if len(shared) != len(keys):
        raise RuntimeError("the documents were dealt differently the second time: write them to a table first")
    at = np.flatnonzero(b.window)
    at = at[shared[np.searchsorted(keys, selected)]] if len(at) else at
    return b, at, b.hashed(passage)[at]


def _extend(passage: int, buckets: int):
    """Around each shared suffix, all windows to its left and right that select it are compared whole."""

    def extend(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"batch": [], "bucket": [], "data": [], "owners": []})
        rows = _order(rows)
        b, at, windows = _candidates(rows, replies, passage)
        owner = _owners(rows, b.doc[at])
        keys, first, counts = np.unique(windows, return_index=True, return_counts=True)  # rows go by id, so the first is the least
        return _parcels(rows["batch"].iloc[0], buckets, keys, counts, owner[first])

    return extend


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of windows: for each batch, which of its windows occur twice or more, and the least id that holds them."""
    sent = [receive(d) for d in rows["data"]]
    keys, total = merge(sent)
    owner = np.full(len(keys), NOBODY, OWNER)
    places = [np.searchsorted(keys, k) for k, _ in sent]
    for at, own in zip(places, rows["owners"], strict=True):
        new, old = np.frombuffer(own, OWNER), owner[at]
        less = (new["id"] < old["id"]) | (new["id"] == old["id"]) & (new["row"] < old["row"])
        owner[at[less]] = new[less]
    twice = [total[at] > 1 for at in places]
    return pd.DataFrame({"batch": rows["batch"], "bucket": rows["bucket"], "stage": 2, "data": [send_values(t.astype(np.int64)) for t in twice], "owners": [owner[at][t].tobytes() for at, t in zip(places, twice, strict=True)]})


def _found(passage: int, finish, columns: list[str]):
    def find(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({c: [] for c in columns})
        rows = _order(rows)
        b, at, windows = _candidates(rows, replies[replies["stage"] == 1], passage)
        keys, where = np.unique(windows, return_inverse=True)
        second = replies[replies["stage"] == 2].sort_values("bucket")
        twice = np.concatenate([receive_values(d) for d in second["data"]]).astype(bool) if len(second) else np.zeros(0, bool)
        owner = np.full(len(keys), NOBODY, OWNER)
        owner[twice] = np.concatenate([np.frombuffer(d, OWNER) for d in second["owners"]]) if len(second) else owner[twice]
        hit = twice[where] if len(where) else np.zeros(0, bool)
        return finish(rows, b, at[hit], windows[hit], owner[where[hit]] if len(where) else np.zeros(0, OWNER))

    return find


def _spans(passage: int):
    def spans(rows, b: Batch, at, windows, owner) -> pd.DataFrame:
        begins = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(b.doc[at]) > 0)]) if len(at) else np.zeros(0, np.int64)
        ends = np.r_[begins[1:], len(at)][: len(begins)] - 1
        doc = b.doc[at[begins]]
        least = np.minimum.reduceat(owner["id"], begins) if len(at) else owner["id"]
        return pd.DataFrame({"id": rows["id"].to_numpy()[doc], "start_word": at[begins] - b.first[doc], "end_word": at[ends] + passage - b.first[doc], "first_id": least})

    return spans


def _without(passage: int):
    def without(rows, b: Batch, at, windows, owner) -> pd.DataFrame:
        mine = _owners(rows, b.doc[at])
        seen = pd.DataFrame({"id": mine["id"], "row": mine["row"], "w": windows}).duplicated().to_numpy()
        extra = at[(owner != mine) | seen]
        gone = np.zeros(len(b.words) + 1, np.int64)
        np.add.at(gone, extra, 1)
        np.add.at(gone, extra + passage, -1)
        gone = np.cumsum(gone)[:-1] > 0
        texts = list(rows["text"])
        for d in np.unique(b.doc[gone]):
            texts[d] = _cut(texts[d], gone[b.first[d] : b.first[d] + b.lengths[d]])
        return pd.DataFrame({"row": rows["row"], "text": texts, "n_words": b.lengths, "n_gone": np.bincount(b.doc[gone], minlength=len(rows))})

    return without


def _cut(text: bytes, gone: np.ndarray) -> bytes:
    """text without the words marked as gone; what stands between the other words stays."""
    edges = np.isin(np.frombuffer(text, np.uint8), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    edges = np.diff(np.r_[True, edges, True].astype(np.int8))
    begin = np.flatnonzero(edges == -1)
    drop = np.diff(np.r_[0, gone.astype(np.int8), 0])
    keep, done = [], 0
    for i, j in zip(np.flatnonzero(drop == 1).tolist(), np.flatnonzero(drop == -1).tolist(), strict=True):
        keep.append(text[done : begin[i]])
        done = int(begin[j]) if j < len(begin) else len(text)
    keep.append(text[done:])
    return b"".join(keep).strip() if len(keep) > 1 else text


def _both_stages(dealt: DataFrame, passage: int, buckets: int) -> DataFrame:
    """What the buckets reply to each batch: shared suffixes, then repeated windows."""
    parcel, reply = "batch int, bucket int, data binary, owners binary", "batch int, bucket int, stage int, data binary, owners binary"
    slim = dealt.select("id", "h", "text", "batch")
    asked = slim.groupBy("batch").applyInPandas(_ask_suffixes(passage, buckets), parcel)
    suffixes = materialize(asked.groupBy("bucket").applyInPandas(_neighbours, reply), "suffixes")
    extended = slim.groupBy("batch").cogroup(suffixes.select("batch", "bucket", "data").groupBy("batch")).applyInPandas(_extend(passage, buckets), parcel)
    windows = materialize(extended.groupBy("bucket").applyInPandas(_settle, reply), "windows")
    return suffixes.unionByName(windows)


def _deal(docs: DataFrame, id_col: str, text_col: str, *others) -> tuple[DataFrame, int]:
    """id, h, text and others of each document with its batch, and how many buckets there are. h is a hash of the place where a row is
    stored, so equal rows are spread as others are."""
    of = lambda c: F.col(f"`{c}`")
    docs, place = placed(docs)
    slim = docs.select(F.coalesce(of(id_col).cast("long"), F.lit(NOBODY)).alias("id"), F.coalesce(of(text_col), F.lit("")).cast("binary").alias("text"), F.xxhash64(place).alias("h"), *others)
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // BATCH_BYTES))
    return slim.withColumn("batch", F.pmod("h", F.lit(batches)).cast("int")), max(1, -(-batches // 4))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = 50) -> DataFrame:
    """id, start_word, end_word (exclusive), first_id: the maximal runs of a document's words in which every window of
    `passage` words occurs twice or more in the corpus, in other documents or the same; first_id is the least id that holds a
    window of the run. Exact but for collisions of 64-bit hashes.

    A suffix is retained where its first words hash lowest in some window of `passage` words, a choice that depends on the
    words alone, so two copies of a passage retain the same suffixes. Retained suffixes meet sorted in buckets, where
    equal neighbours are shared. Shared ones are extended left and right: the windows that select them are compared
    whole, and runs of repeated windows join up to spans. Every key travels once a batch with a count, so a passage that
    very many documents hold is no larger for a bucket than any other.

    Words are [^\\x20\\x09-\\x0D]+, compared exactly. Ids must be integers; null ids count as the largest, and first_id is null
    where they alone hold the run. A null text is empty; texts shorter than a passage have none; repeated rows repeat
    each other; other columns are ignored; an empty table gives no rows.
    """
    dealt, buckets = _deal(docs, id_col, text_col)
    replies = _both_stages(dealt, passage, buckets)
    columns = ["id", "start_word", "end_word", "first_id"]
    found = dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(_found(passage, _spans(passage), columns), "id long, start_word long, end_word long, first_id long")
    return found.withColumns({c: F.nullif(c, F.lit(NOBODY)) for c in ("id", "first_id")})


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", passage: int = 50, least_left: int = 1) -> DataFrame:
    """docs with repeated passages cut out of all texts but one: the least id that holds a window keeps it, at its first
    place; a null id is the largest, and of several rows of one id one row keeps it. Documents left with fewer than
    least_left words by a cut are dropped; others keep all columns, whatever their names, with chars_col recounted. A null
    text stays null, texts without repeats stay as they are, an empty table gives no rows.
    """
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.struct(*(F.col(f"`{c}`") for c in others)).alias("doc"), F.col(f"`{text_col}`").isNull().alias("no_text")).alias("row")
    dealt, buckets = _deal(docs, id_col, text_col, row)
    replies = _both_stages(dealt, passage, buckets)
    cut = dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(_found(passage, _without(passage), ["row", "text", "n_words", "n_gone"]), StructType([dealt.schema["row"], dealt.schema["text"], StructField("n_words", LongType()), StructField("n_gone", LongType())]))
    kept = cut.where(f"n_gone = 0 OR n_words - n_gone >= {least_left}")
    text = F.when(F.col("row.no_text"), F.lit(None)).otherwise(F.col("text").cast("string"))
    kept = kept.withColumn("text_now", text)
    columns = [F.col("text_now").alias(c) if c == text_col else F.when(F.col("n_gone") > 0, F.length("text_now")).otherwise(F.col(f"row.doc.`{c}`")).cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(f"row.doc.`{c}`").alias(c) for c in docs.columns]
    return kept.select(*columns)
