"""Counting keys of up to 64 bits over a whole corpus, and telling each batch of documents the counts of its own keys.

A batch sends each bucket (a range of keys) its distinct keys, sorted, with its own counts, as one compressed row; a bucket adds
up the counts of equal neighbours in the merged order and answers every batch in the batch's order. Each key travels
once a batch however often it occurs, so a frequent key weighs on no bucket, and buckets are as even as the hashes.
"""

from __future__ import annotations

import numpy as np
import zstandard


def bucket_of(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Buckets split the range of unsigned keys of so many bits evenly, so sorted keys are sorted by bucket."""
    return ((keys >> np.uint64(bits - 24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def send(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted distinct keys and a small number for each. Keys go as differences, byte by byte, which compresses well."""
    step = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    small = np.minimum(values, 255).astype(np.uint8)
    large = values[values >= 255].astype("<u4")
    return len(keys).to_bytes(4, "little") + zstandard.compress(np.ascontiguousarray(step).tobytes() + small.tobytes() + large.tobytes(), 1)


def receive(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    raw = zstandard.decompress(data[4:])
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel()
    values = np.frombuffer(raw, np.uint8, n, 8 * n).astype(np.int64)
    values[values == 255] = np.frombuffer(raw, "<u4", -1, 9 * n)
    return np.cumsum(step, dtype=np.uint64), values


def send_values(values: np.ndarray) -> bytes:
    small = np.minimum(values, 255).astype(np.uint8)
    return len(values).to_bytes(4, "little") + zstandard.compress(small.tobytes() + values[values >= 255].astype("<u4").tobytes(), 1)


def receive_values(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = zstandard.decompress(data[4:])
    values = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(raw, "<u4", -1, n)
    return values


def merge(sent: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All batches' keys of one bucket in sorted order without repeats, and each key's total."""
    keys = np.concatenate([k for k, _ in sent]) if sent else np.zeros(0, np.uint64)
    values = np.concatenate([v for _, v in sent]) if sent else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")  # the batches are sorted runs
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values
