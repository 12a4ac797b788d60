"""Token ids of whole texts with a public tokenizer, at the cost of its distinct words."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker remembers at most before it starts over, about 0.2 kB each; memory stays bounded by this.
REMEMBERED = 1_000_000
#: Bytes of text that are cut into words at a time, about, and new words that go through the library in one call.
AT_A_TIME, TOGETHER = 8 << 20, 20_000
#: Stands between new words that are encoded as one string: a control character, which ordinary words do not hold.
MARK = "\x01"

_LOADED: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Encodes texts with a tokenizer file, each distinct word once.

    A tokenizer that drops white space before it splits words never looks across it, so it gives a text the ids of its
    words, one after the other. Natural text repeats its words: a batch is cut into words and numbered by Arrow, and
    only words not yet remembered go through the library, many in one string with a mark between them. Words that hold
    the mark go through it one by one. A word in ASCII is looked up in lower case if the tokenizer lower-cases; one with '<|' could
    hold a special token, whose case matters, and is left as it is. A tokenizer that keeps white space encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = REMEMBERED
        self.by_word = self._drops_space()
        self.lowers = self._ids("A") == self._ids("a")
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _drops_space(self) -> bool:
        """Whether words are cut at white space and nothing of it is left: so they are in a probe, and so is its encoding."""
        probe = "ab  Cd\n,e9 \t'x"
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(probe) if self.tokenizer.pre_tokenizer else []
        clean = bool(cut) and not any(set(probe[a:b]) & set(" \n\t") for _, (a, b) in cut)
        return clean and self._ids(probe) == [t for w in probe.split() for t in self._ids(w)]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of new words, which have the next places."""
        odd = [i for i, w in enumerate(words) if MARK in w] if self.mark is not None else range(len(words))
        plain = words if not odd else [w for w in words if MARK not in w] if self.mark is not None else []
        parts = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        found, counts = [], []
        for got in self.tokenizer.encode_batch_fast([f" {MARK} ".join([*p, ""]) for p in parts], add_special_tokens=False) if parts else ():
            ids = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            counts.append(np.diff(ends, prepend=-1) - 1)
            found.append(ids[ids != self.mark])
        n, ids = np.concatenate([*counts, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.uint32)])
        if odd:
            alone = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)]
            cut = np.cumsum(n)
            at = np.array(list(odd)) - np.arange(len(odd))  # plain words before each
            where = np.repeat(np.concatenate(([0], cut))[at], [len(x) for x in alone])
            ids = np.insert(ids, where, [t for x in alone for t in x])
            n = np.insert(n, at, [len(x) for x in alone])
        while self.begin[-1] + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.begin[-1] : self.begin[-1] + len(ids)] = ids
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(n, dtype=np.int64)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        out: list[np.ndarray] = []
        start = 0
        while start < len(texts):  # some MB of text at a time
            stop, size = start, 0
            while stop < len(texts) and (size < AT_A_TIME or stop == start):
                size += len(texts[stop])
                stop += 1
            out += self._some(texts[start:stop])
            start = stop
        return out

    def _some(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        if len(self.place) > self.remembered:
            self._forget()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = pc.dictionary_encode(split.flatten())
        places = np.fromiter(map(self._place_of, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        self._learn(list(self.place)[len(self.begin) - 1 :])
        at = places[words.indices.to_numpy()]
        n = np.diff(self.begin)[at]
        ends = np.cumsum(n)
        step = np.repeat(self.begin[at] - (ends - n), n)
        step += np.arange(len(step))
        ids = self.ids[step]
        cut = np.concatenate(([0], ends))[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _place_of(self, word: str) -> int:
        """Numbers words in the order in which they are first asked for."""
        if self.lowers and word.isascii() and "<|" not in word:
            word = word.lower()
        return self.place.setdefault(word, len(self.place))


def tokenizer(path: str, remembered: int = REMEMBERED) -> WordTokenizer:
    """The tokenizer of a file, loaded once in a worker, which remembers so many words from now on."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    _LOADED[path].remembered = remembered
    return _LOADED[path]
