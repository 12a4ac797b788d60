"""Language-model scoring with a weighted backoff automaton over the corpus's own n-grams."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import materialize, placed
from jobgrain.llm.exchange import bucket_of, merge, receive, receive_values, send, send_values

#: Bytes of text that one batch holds, about.
BATCH_BYTES = 6 << 20
#: Bits of the hashes that stand for n-grams. Distinct keys are nearly all that is exchanged, so a byte less is a sixth less. Of n
#: n-grams n * n / 2 ** 57 pairs share a key: of 10 ** 10 fewer than one in ten million.
BITS = 56
#: Key of the end of a document, and of the place before its first word, fixed numbers unlike any hash of a word's bytes.
END, START = np.uint64(0x9E3779B97F4A7C), np.uint64(0xC2B2AE3D27D4EB)


def held_out(doc_id: str | None) -> bool:
    """doc_id: the id as text; a null one counts as the text 'None'."""
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


class Batch:
    """The n-grams of some documents, by position: keys[k] has the hash of the (k+1)-gram that ends at each token."""

    def __init__(self, ids, texts: list[bytes], order: int):
        known: dict[bytes, int] = {}
        codes: list[int] = []
        lengths = []
        for text in texts:
            words = text.lower().split()  # bytes.lower() lowers A-Z only
            codes += [known.setdefault(w, len(known)) for w in words]
            codes.append(-1)
            lengths.append(len(words) + 1)
        hashes = np.array([*(xxhash.xxh64_intdigest(w) >> 64 - BITS for w in known), int(END)], np.uint64)
        self.lengths = np.array(lengths, np.int64)
        self.train = np.repeat(np.array([not held_out(i) for i in ids], bool), self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(codes)) - np.repeat(self.first, self.lengths)
        word = hashes[np.array(codes, np.int64)]
        self.keys = [word]
        for k in range(1, order):
            before = np.roll(self.keys[-1], 1)
            before[self.first] = START if k == 1 else 0
            self.keys.append(np.where(self.place >= k - 1, mixed(before, word), np.uint64(0)))

    def requests(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """All distinct keys in order with the counts of their training tokens, and by order where each position's key is."""
        every = np.concatenate(self.keys)
        keys, at = np.unique(every, return_inverse=True)
        counts = np.bincount(at, np.tile(self.train, len(self.keys)), len(keys)).astype(np.int64)
        return keys, counts, np.split(at, len(self.keys))


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context's hash and the word that follows (a multiply and shift mix of both)."""
    x = (context * np.uint64(0xFF51AFD7ED558CCD)) ^ (word >> np.uint64(29)) ^ (word * np.uint64(0xC4CEB9FE1A85EC53))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - BITS)


def _request(order: int, buckets: int):
    def request(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "text"], kind="stable", na_position="first")
        b = Batch(rows["id"], rows["text"], order)
        keys, counts, at = b.requests()
        words = np.zeros(len(keys), bool)
        words[at[0]] = True  # one-grams, whose totals give N and V
        cut = np.searchsorted(bucket_of(keys, buckets, BITS), np.arange(buckets + 1))
        batch = rows["batch"].iloc[0]
        out = [(batch, p, send(keys[i:j], counts[i:j] * 2 + words[i:j])) for p, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
        return pd.DataFrame(out, columns=["batch", "bucket", "data"])

    return request


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: totals of its keys, sent back to each batch in the batch's order; tokens and types of its words."""
    sent = [receive(d) for d in rows["data"]]
    keys, total = merge([(k, v >> 1) for k, v in sent])
    words = np.zeros(len(keys), bool)
    out = []
    for batch, (k, v) in zip(rows["batch"], sent, strict=True):
        at = np.searchsorted(keys, k)
        words[at] |= (v & 1).astype(bool)
        out.append((batch, send_values(total[at])))
    tokens, types = int(total[words].sum()), int((total[words] > 0).sum())
    return pd.DataFrame({"batch": [b for b, _ in out], "bucket": rows["bucket"], "data": [d for _, d in out], "tokens": [tokens] + [0] * (len(out) - 1), "types": [types] + [0] * (len(out) - 1)})


class Automaton:
    """The model as far as the texts of one batch can reach it: numbered states joined by arcs and failure arcs.

    Every n-gram of the batch has a number. As a context h it is a state, if training has seen it; two more states are the
    root (no context) and the start of a document. In state h the arc of word w is the n-gram hw, if training has seen it;
    its weight is the smoothed estimate (c(hw) + strength * p(w | shorter h)) / (c(h) + strength), and it leads to the
    longest state that ends in hw. Where h has no arc for w, the failure arc of weight strength / (c(h) + strength) leads to
    the state of h without its first word. The root's arcs are c(w) / (tokens + types), and types / (tokens + types) for
    any unknown word, which lead to the word's state and back to the root. Weights are log10; one above zero says no arc.
    """

    def __init__(self, counts: np.ndarray, at: list[np.ndarray], place: np.ndarray, starts: float, tokens: int, types: int, strength: float):
        """counts: of each n-gram in training; at[k]: the (k+1)-gram that ends at each place; place: within its document."""
        n, order, total = len(counts), len(at), max(1, tokens + types)
        self.root, self.begin = n, n + 1
        self.at, self.order = at, order
        self.first = self.begin if starts and order > 1 else self.root
        seen = counts > 0
        p = np.where(seen, counts / total, max(1, types) / total)
        fail, length = np.full(n + 2, n, np.int32), np.zeros(n + 2, np.int8)
        length[self.begin] = 1
        fallback = np.zeros(n + 2)
        fallback[self.begin] = np.log10(strength / (starts + strength))
        length[at[0][seen[at[0]]]] = min(1, order - 1)
        for k in range(1, order):
            there = np.flatnonzero(place >= k - 1)  # with a context of k words, or of the start and k - 1
            grams = at[k][there]
            context = np.full(len(there), float(starts))
            inner = place[there] > 0
            context[inner] = counts[at[k - 1][there[inner] - 1]]
            fail[grams] = at[k - 1][there]
            p[grams] = np.where(context > 0, (counts[grams] + strength * p[fail[grams]]) / (context + strength), p[fail[grams]])
            length[grams] = np.where(seen[grams], min(k + 1, order - 1), 0)
        fallback[:n] = np.log10(strength / (counts + strength))
        target = np.arange(n, dtype=np.int32)
        if order > 1:  # n-grams of full length are no contexts: their arcs lead to what follows their first word
            target[at[-1]] = fail[at[-1]]
        else:
            target[:] = self.root
        target[~seen] = self.root
        weight = np.log10(p)
        for k in range(1, order):
            weight[at[k][~seen[at[k]]]] = 1.0
        self.weight, self.fail, self.fallback, self.target, self.length = map(memoryview, (weight, fail, fallback, target, length))

    def score(self, begin: int, end: int) -> float:
        """log10 probability of the tokens at some places, which are one document: one walk from left to right."""
        weight, fail, fallback, target, length = self.weight, self.fail, self.fallback, self.target, self.length
        arcs = [a[begin:end].tolist() for a in self.at]
        state, total = self.first, 0.0
        for i in range(end - begin):
            k = length[state]
            arc = arcs[k][i]
            while weight[arc] > 0:
                total += fallback[state]
                state = fail[state]
                k = length[state]
                arc = arcs[k][i]
            total += weight[arc]
            state = target[arc]
        return total


def _score(order: int, buckets: int, tokens: int, types: int, strength: float):
    def score(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"id": [], "held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []})
        rows = rows.sort_values(["id", "text"], kind="stable", na_position="first")
        b = Batch(rows["id"], rows["text"], order)
        keys, _, at = b.requests()
        total = np.concatenate([receive_values(d) for d in replies.sort_values("bucket")["data"]])
        if len(total) != len(keys):
            raise RuntimeError("the documents were dealt differently the second time: write them to a table first")
        unigrams = total[at[0]]
        sums = lambda x: np.add.reduceat(x, b.first)
        starts = float(unigrams[b.first[0] + b.lengths[0] - 1])  # as many documents start as end
        base = np.log10((unigrams + 0.1) / (tokens + 0.1 * (types + 1)))
        model = Automaton(total, at, b.place, starts, tokens, types, strength)
        logs = [model.score(i, i + n) for i, n in zip(b.first.tolist(), b.lengths.tolist(), strict=True)]
        return pd.DataFrame({"id": rows["id"], "held_out": [held_out(i) for i in rows["id"]], "n_tokens": b.lengths, "n_known": sums((unigrams > 0).astype(np.int64)), "train_tokens": tokens, "base_score": sums(base), "score": logs})

    return score


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, strength: float = 100.0) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (see Automaton).

    Learns n-grams up to `order` from the documents that are not held out (crc32 of the id as text is not divisible by
    10) and scores every whole text. The state after each token is the longest seen context, so order 2 keeps the last word.
    strength is the weight of the shorter context's estimate in seen tokens; held-out text of the small tables is flat
    around 100 to 300. Tokens are words in lower-case A-Z and one end. Null texts are empty; a null id counts as the text 'None' in the
    choice of held-out rows; repeated rows count each; an empty table gives no rows; other columns are ignored.

    Documents are dealt to batches of bounded size by a hash of the place where each is stored (see placed), twice, so equal
    rows are spread as others are and docs must lie where they are; n-gram counts meet in buckets by key (see
    exchange), so both work and memory follow the input and no table of the model goes to any one place.
    """
    docs, place = placed(docs)
    slim = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), place.alias("place"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // BATCH_BYTES))
    buckets = max(1, -(-batches // 2))
    dealt = slim.withColumn("batch", F.pmod(F.xxhash64("place"), F.lit(batches)).cast("int")).drop("place")
    requests = dealt.groupBy("batch").applyInPandas(_request(order, buckets), "batch int, bucket int, data binary")
    replies = materialize(requests.groupBy("bucket").applyInPandas(_answer, "batch int, bucket int, data binary, tokens long, types long"), "ngrams")
    tokens, types = replies.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    kind = docs.schema[id_col].dataType.simpleString()
    scored = dealt.groupBy("batch").cogroup(replies.select("batch", "bucket", "data").groupBy("batch")).applyInPandas(_score(order, buckets, tokens, types, strength), "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("id", F.col("id").cast(kind))
