"""Directly addressable codes: ids cut into chunks by level, with continuation bitmaps and rank directories."""

from __future__ import annotations

import struct

import numpy as np

#: Layout, little-endian: magic, version, bits of a chunk, levels, then the entries of each level; then for each level
#: its chunks (one byte each), its bitmap (bit i set: entry i goes on at the next level) and its rank directory (set bits
#: before each run of RUN entries, 32 bits each).
MAGIC, VERSION, BITS = b"DACS", 1, 8
RUN = 512


def pack(ids: np.ndarray) -> bytes:
    """The code of unsigned 32-bit ids."""
    rest = np.asarray(ids, np.uint32)
    sizes, parts = [], []
    while True:
        more = rest >> BITS > 0
        bitmap = np.packbits(more, bitorder="little")
        before = np.concatenate(([0], np.cumsum(more, dtype=np.uint32)))[: len(more) : RUN] if len(more) else np.zeros(0)
        sizes.append(len(rest))
        parts += [(rest & (1 << BITS) - 1).astype(np.uint8).tobytes(), bitmap.tobytes(), before.astype("<u4").tobytes()]
        if not more.any():
            break
        rest = rest[more] >> BITS
    return struct.pack(f"<4sBBH{len(sizes)}I", MAGIC, VERSION, BITS, len(sizes), *sizes) + b"".join(parts)


class Codes:
    """Reads one code: code[i] reaches an id without decoding others, slice(a, b) decodes a run of them."""

    def __init__(self, data: bytes):
        magic, version, bits, levels = struct.unpack_from("<4sBBH", data)
        if magic != MAGIC or version != VERSION or bits != BITS:
            raise ValueError("not a code of this version")
        self.sizes = struct.unpack_from(f"<{levels}I", data, 8)
        at, self.levels = 8 + 4 * levels, []
        for n in self.sizes:
            ends = np.cumsum([at, n, -(-n // 8), 4 * -(-n // RUN)]).tolist()
            self.levels.append(tuple(np.frombuffer(data[a:b], kind) for a, b, kind in zip(ends, ends[1:], (np.uint8, np.uint8, "<u4"), strict=False)))
            at = ends[-1]

    def __len__(self) -> int:
        return self.sizes[0]

    def _rank(self, level: int, i: int) -> int:
        """Set bits before entry i of a level."""
        _, bitmap, before = self.levels[level]
        if i >= self.sizes[level]:
            return self.sizes[level + 1] if level + 1 < len(self.sizes) else 0
        run = i // RUN
        whole, rest = bitmap[run * RUN // 8 : i // 8], i % 8
        part = int(bitmap[i // 8]) & (1 << rest) - 1
        return int(before[run]) + int(np.bitwise_count(whole).sum()) + part.bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << BITS * level
            if not int(bitmap[i // 8]) >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        out = self._slice(0, a, b)
        return out

    def _slice(self, level: int, a: int, b: int) -> np.ndarray:
        chunks, bitmap, _ = self.levels[level]
        out = chunks[a:b].astype(np.uint32)
        more = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
        if more.any():
            first = self._rank(level, a)
            out[more] |= self._slice(level + 1, first, first + int(more.sum())) << np.uint32(BITS)
        return out
