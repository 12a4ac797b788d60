"""Small numpy helpers for tasks that find links among the rows of one bucket."""

from __future__ import annotations

import numpy as np


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0..n-1 and links (a, b): the smallest node of each node's component. label: what is joined already."""
    label = np.arange(n) if label is None else label
    while a.size:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place within the row of every cell of a ragged table with so many cells a row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
