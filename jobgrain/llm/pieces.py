"""Encoding into pieces that remember where in the text they come from, and decoding.

A SentencePiece model normalises a text through a compiled character map (the longest matching prefix is replaced), marks
spaces, and cuts the result into pieces. Here the map is read from the model and followed with a record of the source
of every byte, so each piece is projected to the bytes of the original text that it stands for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.linking import ragged

#: Source bytes of segments that a worker remembers at most before it starts over, and bytes of text encoded at a time.
REMEMBERED, AT_A_TIME = 12 << 20, 2 << 20
#: The mark of a space, and the character that stands for malformed bytes.
SPACE, BAD = "▁".encode(), "�".encode()
#: Kinds of pieces in a model file.
UNKNOWN, CONTROL, OWN, BYTE = 2, 3, 4, 6

_SEGMENT = re.compile(rb" *[^ ]+| +")
_LOADED: dict[bytes, Pieces] = {}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """Number, value and whole encoding of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        start = at
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value, data[start:at]


class CharacterMap:
    """The compiled map: a double-array trie of prefixes, whose values are places in a row of replacements that end in 0."""

    def __init__(self, data: bytes):
        size = int.from_bytes(data[:4], "little")
        self.units = np.frombuffer(data, "<u4", size // 4, 4).tolist() if data else []
        self.texts = data[4 + size :]
        self.known: dict[int, bytes] = {}

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """How many bytes the longest known prefix of text[at:] has, and what replaces it."""
        units = self.units
        if not units:
            return None
        found = None
        node = self._child(0, units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        return found and (found[0], self._text(found[1]))

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 512) >> 6))

    def _text(self, at: int) -> bytes:
        if at not in self.known:
            self.known[at] = self.texts[at : self.texts.index(b"\0", at)]
        return self.known[at]


def _character(text: bytes, at: int) -> int:
    """Bytes of the well-formed character at a place; 0 if there is none."""
    b = text[at]
    n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
    try:
        text[at : at + n].decode()
    except UnicodeDecodeError:
        return 0
    return n


class Pieces:
    """A model file, read for encoding with spans and for decoding."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        parts = list(fields(model))
        table = [{n: v for n, v, _ in fields(v)} for n, v, _ in parts if n == 1]
        trainer, rules = ({n: v for k, part, _ in parts if k == number for n, v, _ in fields(part)} for number in (2, 3))
        self.texts = [p.get(1, b"") for p in table]
        self.kinds = np.array([p.get(3, 1) for p in table], np.uint8)
        if OWN in self.kinds or any(k == 5 and v for k, v, _ in parts) or trainer.get(24):
            raise ValueError("models with pieces of a user, a map for decoding or spaces after words are not supported")
        self.map = CharacterMap(rules.get(2, b""))
        self.prefix, self.trim, self.mark = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        # what cuts a normalised text into pieces: the same model without rules of its own
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
        self.cutter = SentencePieceProcessor(model_proto=b"".join(whole for n, _, whole in parts if n != 3) + b"\x1a" + bytes([len(plain)]) + plain)
        byte = lambda t: bytes([int(t[3:5], 16)])  # noqa: E731  (<0xAB>)
        self.sizes = np.array([1 if k == BYTE else len(t) for t, k in zip(self.texts, self.kinds, strict=True)], np.int64)
        said = [byte(t) if k == BYTE else b"" if k == CONTROL else trainer.get(44, " ⁇ ".encode()) if k == UNKNOWN else t.replace(SPACE, b" ") for t, k in zip(self.texts, self.kinds, strict=True)]
        self.said = pa.array(said, pa.large_binary())
        self.opens = np.array([k not in (CONTROL, UNKNOWN, BYTE) and t.startswith(SPACE) for t, k in zip(self.texts, self.kinds, strict=True)])
        # a text may be cut before a space after another character if nothing reaches across: no piece, no rule
        across = any(SPACE in t.lstrip(b"\xe2\x96\x81") for t in self.texts if t.startswith(SPACE) or SPACE in t)
        self.by_segment = self.mark and not self.trim and not self.map.units and not across
        self._forget()

    def _forget(self) -> None:
        #: Segments that do not begin a text, and those that do, with their numbers.
        self.places: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        self.held = 0
        self.ids, self.spans, self.begin = np.zeros(0, np.int32), np.zeros((2, 0), np.int64), np.zeros(1, np.int64)

    def normalize(self, text: bytes, first: bool = True) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the place in the source that it comes from."""
        if not text:
            return b"", np.zeros(1, np.int64)
        space = SPACE if self.mark else b" "
        out, source = bytearray(), []
        at, blank = 0, self.trim
        started = not (self.prefix and first)
        while at < len(text):
            step, piece = self.map.longest(text, at) or ((n := _character(text, at)) or 1, text[at : at + n] if n else BAD)
            if not started and not (self.trim and piece == b" "):
                out += space
                source += [at] * len(space)
                started = True
            if blank:
                piece = piece.lstrip(b" ")
            if piece:
                blank = self.trim and piece.endswith(b" ")
                piece = piece.replace(b" ", space)
                out += piece
                source += [at] * len(piece)
            at += step
        while self.trim and out.endswith(space):
            at = source[-len(space)]
            del out[-len(space) :], source[-len(space) :]
        return bytes(out), np.array([*source, at], np.int64)

    def _normals(self, texts: list[bytes], first: list[bool]) -> tuple[list[bytes], np.ndarray]:
        """Normalised texts, and one after the other for each of their bytes the place in its own text that it comes from, with
        one place more at the end of each."""
        try:
            plain = self.by_segment and (b"".join(texts).decode(), True)[1]
        except UnicodeDecodeError:
            plain = False
        if not plain:
            done = [self.normalize(t, f) for t, f in zip(texts, first, strict=True)]
            return [n for n, _ in done], np.concatenate([s for _, s in done])
        ahead = [b" " if self.prefix and f else b"" for f in first]
        marked = [a + t for a, t in zip(ahead, texts, strict=True)]
        raw = np.frombuffer(b"\n".join([*marked, b""]), np.uint8)  # a byte more at the end of each
        sizes = np.array([len(t) + 1 for t in marked], np.int64)
        begin = np.cumsum(sizes) - sizes + np.array([len(a) for a in ahead], np.int64)
        source = np.maximum(0, np.arange(len(raw)) - np.repeat(begin, sizes))
        return [t.replace(b" ", SPACE) for t in marked], np.repeat(source, np.where(raw == 32, len(SPACE), 1))

    def cut(self, texts: list[bytes], first: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts that begin a document or not, their sources (begin and end, from the start of each text), how many each has.
        Of a character in bytes the last one has the source."""
        normals, source = self._normals(texts, first)
        got = self.cutter.encode([n.decode() for n in normals], num_threads=1)
        counts = np.array([len(g) for g in got], np.int64)
        ids = np.fromiter(chain.from_iterable(got), np.int32, int(counts.sum()))
        sizes = self.sizes[ids]
        text_of = np.repeat(np.arange(len(texts)), counts)
        for k in np.unique(text_of[self.kinds[ids] == UNKNOWN]).tolist():  # one piece for several characters: the library tells
            sizes[text_of == k] = [len(p.surface.encode()) for p in self.cutter.encode(normals[k].decode(), return_type="proto").pieces]
        ends = np.cumsum(sizes) + text_of  # each text's end takes a place of its own
        begins = ends - sizes
        within = np.flatnonzero(self.kinds[ids] == BYTE)
        if len(within):
            raw = np.frombuffer(b"\n".join([*normals, b""]), np.uint8)
            lead = np.flatnonzero((raw & 0xC0) != 0x80)
            at = np.searchsorted(lead, begins[within], "right") - 1
            last = ends[within] == lead[at + 1]
            begins[within] = lead[at]
            ends[within] = np.where(last, ends[within], lead[at])
        return ids, np.stack([source[begins], source[ends]]), counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sources (two rows: begin, end) of all texts one after the other, and how many ids each has."""
        if self.held > REMEMBERED:
            self._forget()
        places: list[int] = []
        sizes: list[int] = []
        new: list[bytes] = []
        opening: list[bool] = []
        counts = np.zeros(len(texts), np.int64)
        n = len(self.begin) - 1
        for k, text in enumerate(texts):
            parts = _SEGMENT.findall(text) if self.by_segment and SPACE not in text else [text] if text else []
            counts[k] = len(parts)
            sizes += map(len, parts)
            known = self.places[1]
            for p in parts:
                at = known.get(p)
                if at is None:
                    at = known[p] = n + len(new)
                    new.append(p)
                    opening.append(known is self.places[1])
                places.append(at)
                known = self.places[0]
        if new:
            ids, spans, length = self.cut(new, opening)
            self.ids, self.spans = np.concatenate([self.ids, ids]), np.concatenate([self.spans, spans], axis=1)
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(length)])
            self.held += sum(map(len, new)) + 60 * len(new)
        at, size = np.array(places, np.int64), np.array(sizes, np.int64)
        row, place = ragged(np.diff(self.begin)[at])
        cell = self.begin[at][row] + place
        text_of = np.repeat(np.arange(len(texts)), counts)
        ahead = np.r_[np.int64(0), np.cumsum(size)]  # bytes before each segment
        start = ahead[:-1] - ahead[(np.cumsum(counts) - counts)[text_of]]
        return self.ids[cell], self.spans[:, cell] + start[row], np.bincount(text_of[row], minlength=len(texts))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each list of ids, which lie one after the other. Bytes that make no character become U+FFFD each."""
        said = self.said.take(pa.array(ids))
        ends = np.frombuffer(said.buffers()[1], np.int64, len(ids) + 1, said.offset * 8) if len(ids) else np.zeros(1, np.int64)
        data = said.buffers()[2]
        raw = memoryview(data) if data is not None else memoryview(b"")
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            mine = bytes(raw[ends[a] : ends[b]])
            if self.prefix or self.trim:
                k = a
                while k < b and self.kinds[ids[k]] == CONTROL:
                    k += 1
                while k < b and self.opens[ids[k]]:  # the space before the first word
                    mine = mine[1:]
                    if not self.trim or self.texts[ids[k]] != SPACE:
                        break
                    k += 1
            try:
                out.append(mine.decode())
            except UnicodeDecodeError:
                out.append(re.sub("[\udc80-\udcff]", "�", mine.decode(errors="surrogateescape")))
        return out


def _pieces(model: bytes) -> Pieces:
    """A worker reads a model once."""
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def _parts(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some MB at a time."""
    total = np.cumsum(sizes)
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + AT_A_TIME, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _encode(model, decode: bool):
    names = ["id", "ids", "begins", "ends", *(["decoded"] if decode else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value)
        for batch in batches:
            for some in _parts(batch, pc.binary_length(batch.column(1)).to_numpy()):
                ids, spans, counts = pieces.encode(some.column(1).to_pylist())
                offsets = np.r_[0, np.cumsum(counts)]
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (ids, *spans)]
                texts = [pa.array(pieces.decode(ids, offsets), pa.string())] if decode else []
                yield pa.RecordBatch.from_arrays([some.column(0), *lists, *texts], names)

    return encode


def _decode(model):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model.value)
        for batch in batches:
            for some in _parts(batch, batch.column(1).value_lengths().fill_null(0).to_numpy() * 4):
                lists = some.column(1)
                counts = lists.value_lengths().fill_null(0).to_numpy()
                texts = pieces.decode(lists.flatten().to_numpy(), np.r_[0, np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([*some.columns[2:], pa.array(texts, pa.string())], [*some.schema.names[2:], "decoded"])

    return decode


def _read(spark, path: str):
    """The model file, which goes to the workers: a vocabulary, not data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row a document: id, ids, begins, ends, and with decode their text, decoded, as decode_pieces() gives it. ids are those of the SentencePiece model file, without begin or end; piece k
    stands for the bytes begins[k] to ends[k] of the text in UTF-8. A character that is spelled in bytes belongs to the
    last of its pieces, the others are empty there.

    A narrow operator over whole texts, some MB at a time. A model whose rules leave texts as they are (but for the mark of spaces)
    and whose pieces never reach across the start of a word gives a text the pieces of its words, so each distinct word
    is normalised, cut and projected once in a while; other models take each text whole.

    Null texts are empty and have no pieces; ids may be of any type, null or repeated; other columns are ignored; an empty
    table gives no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, ids array<int>, begins array<int>, ends array<int>" + (", decoded string" if decode else "")
    return slim.mapInArrow(_encode(_read(docs.sparkSession, model), decode), columns)


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded: the text of each row's ids. No ids, or null, give an empty text."""
    if "decoded" in encoded.columns:
        raise ValueError("there is a column decoded already")
    rows = encoded.select(F.lit(0).alias("_0"), F.col(f"`{ids_col}`").alias("_1"), "*")
    schema = encoded.schema.simpleString()
    return rows.mapInArrow(_decode(_read(encoded.sparkSession, model)), f"{schema[:-1]},decoded:string>")
