"""Ids of a word-level byte-pair vocabulary, for all words of a slice of texts at once.

The tokenizer drops white space, lower-cases, and cuts a text into runs: letters,
single digits, other signs. Nothing looks beyond a run, so a text's ids are those of
its words one after the other. The distinct words of a slice are found by hash; the
plain ones (ASCII signs without the apostrophe, which has rules of its own, and the
letters from U+00C0 to U+00FF) are merged together in NumPy: all runs lie in one
array, and each round joins in every run its pair of lowest rank. Any other word goes
through the whole tokenizer. No state outlives a slice but the vocabulary itself.
"""

from __future__ import annotations

import json
import os

import numpy as np

from strandloom.llm import kernels as K

_BAD, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.full(256, _BAD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[39] = _BAD
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:192] = _KIND[0xC3] = _LETTER
_NONE = np.int32(1 << 30)
_SLOTS = 20
_HASH = np.uint64(0x9E3779B97F4A7C15)


def _spelling() -> list[str]:
    """The sign that spells each byte: itself if it prints, else the next free one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


class BytePairs:
    """The vocabulary file ``path`` of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        spelt = _spelling()
        self.inner = np.array([vocab[c] for c in spelt], np.int32)
        self.final = np.array([vocab[c + end] for c in spelt], np.int32)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64).reshape(-1, 3)
        self.made = pairs[:, 2].astype(np.int32)
        keys = self._key(pairs[:, 0], pairs[:, 1])
        # open addressing: each key at the first free place from its own on
        self.rank, self.keys = np.full((1 << _SLOTS) + 64, _NONE, np.int32), np.full((1 << _SLOTS) + 64, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.reach = 1
        for r, (at, key) in enumerate(zip(self._slot(keys).tolist(), keys.tolist(), strict=True)):
            step = 0
            while self.rank[at + step] != _NONE:
                step += 1
            self.rank[at + step], self.keys[at + step] = r, key
            self.reach = max(self.reach, step + 1)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * _HASH) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or _NONE."""
        keys = self._key(a, b)
        at = self._slot(keys)
        rank = np.where(self.keys[at] == keys, self.rank[at], _NONE)
        if self.reach > 1:
            left = np.flatnonzero((rank == _NONE) & (self.rank[at] != _NONE))
            for step in range(1, self.reach):
                hit = self.keys[at[left] + step] == keys[left]
                rank[left[hit]] = self.rank[at[left[hit]] + step]
                left = left[~hit]
        return rank

    def merge(self, ids: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Join in place what lies in ``run`` (non-decreasing); True where an id is left."""
        left = np.ones(len(ids), bool)
        at = np.flatnonzero(np.bincount(run)[run] > 1) if len(run) else np.zeros(0, np.int64)
        tok, own = ids[at], run[at]
        while len(tok):
            rank = np.full(len(tok), _NONE, np.int32)
            rank[:-1] = np.where(own[1:] == own[:-1], self._ranks(tok[:-1], tok[1:]), _NONE)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(tok)))
            take = rank == np.repeat(np.where(low == _NONE, -1, low), size)
            if len(both := np.flatnonzero(take[1:] & take[:-1])):  # as in "aaa": every other one of a streak
                streak = np.cumsum(np.concatenate([[True], np.diff(both) > 1]))
                odd = (np.arange(len(both)) - np.searchsorted(streak, streak)) % 2 == 0
                take[both[odd] + 1] = False
            joined = np.flatnonzero(take)
            tok[joined] = self.made[rank[joined]]
            ids[at[joined]] = tok[joined]
            left[at[joined + 1]] = False
            stay = np.repeat((low != _NONE) & (size > 2), size)
            stay[joined + 1] = False
            at, tok, own = at[stay], tok[stay], own[stay]
        return left

    def _plain(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words one after the other, and how many each word has."""
        size = end - start
        word = np.repeat(np.arange(len(size)), size)
        src = np.arange(len(word)) + np.repeat(start - (np.cumsum(size) - size), size)
        raw = data[src]
        high = np.zeros(len(raw), bool)  # second bytes of U+00C0 to U+00DE: their small letters are 32 on
        high[1:] = (raw[:-1] == 0xC3) & (raw[1:] <= 0x9E)
        raw = K.ASCII_LOWER[raw] + (high * np.uint8(32))
        kind = _KIND[raw]
        new = np.ones(len(raw), bool)
        new[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        last = np.ones(len(raw), bool)
        last[:-1] = new[1:]
        ids = np.where(last, self.final[raw], self.inner[raw])
        left = self.merge(ids, np.cumsum(new) - 1)
        return ids[left], np.bincount(word[left], minlength=len(size))

    def of_slice(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned, 32 bits) of all texts one after the other, and how many each text has."""
        rows = len(off) - 1
        spans = K.words(data, off)
        if not len(spans.hash):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        _, one, which = np.unique(spans.hash, return_index=True, return_inverse=True)
        start, end = spans.start[one], spans.end[one]
        odd = _KIND[data] == _BAD
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the two signs among the letters
        odd[1:] |= (data[:-1] == 60) & (data[1:] == 124)  # special tokens begin so
        bad = np.concatenate([[0], np.cumsum(odd)])
        plain = bad[end] == bad[start]
        ids, n = self._plain(data, start[plain], end[plain])
        size = np.zeros(len(one), np.int64)
        size[plain] = n
        if not plain.all():
            texts = [data[a:b].tobytes().decode() for a, b in zip(start[~plain].tolist(), end[~plain].tolist(), strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            size[~plain] = [len(x) for x in found]
            ids = np.concatenate([ids, np.array([i for x in found for i in x], ids.dtype)])
        begin = np.zeros(len(one), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        begin[order] = np.cumsum(size[order]) - size[order]
        many = size[which]
        at = np.repeat(begin[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return ids[at].astype(np.uint32), np.bincount(spans.row, many, rows).astype(np.int64)


_loaded: dict[str, BytePairs] = {}


def load(path: str) -> BytePairs:
    """The worker's own instance: reading the file takes longer than a small task."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = BytePairs(path)
    return _loaded[path]
