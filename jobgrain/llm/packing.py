"""Packing documents into sequences: a configuration program over the histogram of lengths, then a distributed deal."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobgrain.llm.common import materialize
from jobgrain.llm.tokens import REMEMBERED, tokenizer

#: Rows that one window partition ranks at most, about.
RANKED_TOGETHER = 10_000


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece of at most `capacity` ids; a document is its ids and end_id."""

    def cut(it):
        for b in it:
            ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in tokenizer(tokenizer_path, remembered).encode([x or b"" for x in b.column(1).to_pylist()])]
            counts = np.array([-(-len(x) // capacity) for x in ids], np.int64)
            row = np.repeat(np.arange(len(ids)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            length = np.minimum(capacity, np.array([len(x) for x in ids], np.int64)[row] - piece * capacity)
            crc = [zlib.crc32(ids[r][p * capacity : (p + 1) * capacity].tobytes()) for r, p in zip(row.tolist(), piece.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text_bytes"))
    return slim.mapInArrow(cut, f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def price_fillings(price: np.ndarray, capacity: int, lengths: np.ndarray) -> list[int]:
    """For each room up to capacity, the first length of the filling of the largest total price (0: none fits); the next one is
    that of the room then left. An unbounded knapsack by dynamic programming over `lengths`, in ascending order."""
    value, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth = price[lengths]
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(int(lengths[0]), capacity + 1):
        n = fits[c]
        options = value[c - lengths[:n]] + worth[:n]
        best = int(options.argmax())
        value[c], pick[c] = options[best], lengths[best]
    return pick.tolist()


def _configuration(first: int, pick: list[int], left: list[int], capacity: int) -> dict[int, int] | None:
    """The length `first` and the best filling of the room beside it, unless more of a length is in it than is left."""
    out, room = {first: 1}, capacity - first
    while pick[room]:
        n = pick[room]
        k = out.get(n, 0) + 1
        if k > left[n]:
            return None
        out[n] = k
        room -= n
    return out


def best_fit(left: dict[int, int], capacity: int, begun: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram, after sequences that are begun already: each length in turn goes where the
    least room is left for it. Sequences of one content are moved together, so the work depends on the lengths alone."""
    room_of = lambda config: capacity - sum(n * k for n, k in config.items())
    groups = sorted(((room_of(c), c, m) for c, m in begun if m > 0), key=lambda g: g[0])
    for n in sorted((n for n, k in left.items() if k > 0), reverse=True):
        k, now = left[n], []
        i = bisect_left(groups, n, key=lambda g: g[0])
        stop = i
        while k and stop < len(groups):
            room, config, m = groups[stop]
            each = room // n
            whole, part = min(m, k // each), 0
            k -= whole * each
            if whole < m:
                part, k = k, 0
            for more, times in ((each, whole), (part, 1 if part else 0), (0, m - whole - (1 if part else 0))):
                if times:
                    now.append((room - more * n, config | {n: config.get(n, 0) + more} if more else config, times))
            stop += 1
        if k:
            each = capacity // n
            now += [(capacity - x * n, {n: x}, times) for x, times in ((each, k // each), (k % each, 1 if k % each else 0)) if times]
        groups[i:stop] = []
        for g in now:
            insort(groups, g, key=lambda g: g[0])
    return [(config, m) for _, config, m in groups]


def configuration_program(histogram: dict[int, int], capacity: int, rounds: int = 100, step: float = 1.0, rate: float = 0.02, enough: float = 0.99) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """(configuration, times) pairs and what they leave of the histogram; no length is held more often than it occurs.

    Prices start at each length's share of a sequence. In each round one knapsack table prices the fillings of all rooms, so
    it names the best configuration for every length; each is taken a whole number of times, for up to `step` (a share) of what was
    left of its length, as far as its lengths last. Then the price of a length falls exponentially in how much of its count the
    round covered, less the mean of that, and rises where it was covered less; so lengths that are short are spared by the next
    round's fillings. It ends when `enough` of all tokens are held, or after `rounds`.
    """
    lengths = np.array(sorted(histogram), np.int64)
    count = np.zeros(capacity + 1)
    count[lengths] = [histogram[n] for n in lengths.tolist()]
    price = np.arange(capacity + 1) / capacity
    left = [0] * (capacity + 1)
    for n, k in histogram.items():
        left[n] = k
    open_tokens = total = sum(n * k for n, k in histogram.items())
    taken: dict[tuple, int] = {}
    for _ in range(rounds):
        live = [n for n in lengths.tolist() if left[n]]
        if not live or open_tokens <= (1 - enough) * total:
            break
        at = np.array(live, np.int64)
        pick, before = price_fillings(price, capacity, at), list(left)
        for n in reversed(live):
            config = _configuration(n, pick, left, capacity) if left[n] else None
            if config is None:
                continue
            times = min(int(np.ceil(step * before[n])), *(left[m] // k for m, k in config.items()))
            key = tuple(sorted(config.items(), reverse=True))
            taken[key] = taken.get(key, 0) + times
            for m, k in config.items():
                left[m] -= k * times
                open_tokens -= m * k * times
        covered = np.array([before[n] - left[n] for n in live]) / count[at]
        price[at] *= np.exp(-rate * (covered - covered.mean()))
    return [(dict(key), times) for key, times in taken.items()], {n: left[n] for n in histogram if left[n]}


def plan_packing(histogram: dict[int, int], capacity: int, rounds: int = 100) -> list[tuple[dict[int, int], int]]:
    """(configuration, times) pairs that hold every length as often as it occurs, in few sequences.

    The program takes configurations that cover each length's count at the least total, by multiplicative weights with
    knapsack pricing (see configuration_program), in whole numbers. The little that it leaves goes by best fit, largest
    first, into the room of these and into new sequences.

    A program of bounded rounds is not always the best plan, so best fit alone is planned as well, and holds where it
    needs fewer sequences. A plan's size is at least the sum of lengths over the capacity; one that meets this bound
    needs no other. The work depends on the capacity alone, never on the number of documents.
    """
    plan = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    rest = {n: k for n, k in histogram.items() if 0 < n < capacity and k > 0}
    if not rest:
        return plan
    sequences = lambda p: sum(m for _, m in p)
    whole, left = configuration_program(rest, capacity, rounds)
    plans = [best_fit(left, capacity, whole)]
    if sequences(plans[0]) > -(-sum(n * k for n, k in rest.items()) // capacity):
        plans.append(best_fit(rest, capacity))
    return plan + min(plans, key=sequences)


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, its runs of slots: first rank, slots in one sequence, first sequence, offset of the first slot."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for config, times in plan:
        offset = 0
        for n, k in config.items():
            runs.setdefault(n, []).append((used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty, so it is one piece of its end id; repeated rows and null ids are documents of their own; other
    columns are ignored; an empty table gives no rows. The driver sees the histogram of lengths, at most `capacity`
    numbers, and returns the plan; pieces find their place by their rank among those of their length. Ranks are dealt in
    hash buckets of bounded size after the counts of the buckets before, so that one common length still spreads; the
    hash takes in the row's number in the written table, so that equal rows spread as well.
    """
    cut = cut_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, remembered)
    pieces = materialize(cut.withColumn("h", F.xxhash64("id", "piece", F.monotonically_increasing_id())), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = _slots(plan_packing(histogram, capacity))
    crowded = [F.lit(n) for n, k in histogram.items() if k > RANKED_TOGETHER]
    chunks = F.create_map(*(F.lit(x) for n, k in histogram.items() if k > RANKED_TOGETHER for x in (n, -(-k // RANKED_TOGETHER)))) if crowded else None
    bucket = F.pmod("h", F.coalesce(F.try_element_at(chunks, "length"), F.lit(1)).cast("long")) if crowded else F.lit(0).cast("long")
    dealt = pieces.withColumn("bucket", bucket)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("h", "id", "piece")) - 1)
    if crowded:
        ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sizes = dealt.where(F.col("length").isin(*crowded)).groupBy("length", "bucket").agg(F.count("*").alias("m"))
        ranked = ranked.join(sizes.select("length", "bucket", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead")), ["length", "bucket"], "left").withColumn("rank", F.col("rank") + F.coalesce("ahead", F.lit(0)))

    def place(it):
        for b in it:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                first, k, seq, off = (c for c in slots[int(n)])
                run = np.searchsorted(first, rank[mine], "right") - 1
                nth = rank[mine] - first[run]
                sequence[mine], offset[mine] = seq[run] + nth // k[run], off[run] + nth % k[run] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return ranked.select("id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(place, f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
