"""Token ids of texts by a tokenizer of the tokenizers library, word by word through a cache.

The vocabulary drops white space and never joins characters across it, so the ids of a text are those
of its white-space separated pieces in order (probed when the file is loaded; if a vocabulary does
otherwise, whole texts are encoded). Pieces met before come from a cache of bounded size, found by their
64-bit hash; new ones are encoded in one call, set apart by a separator with ids of its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidebars.llm.arrow_text import chunks, word_bounds, word_hashes

#: Entries of the cache before it starts anew.
CACHE = 500_000
_tokenizers: dict = {}


class WordTokenizer:
    """Ids of texts; equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = None
        for mark in ("‡", "◊", "⌂"):
            ids = self._plain(mark)
            if ids and self._plain(f"a {mark} b") == [*self._plain("a"), *ids, *self._plain("b")]:
                self.separator, self.mark = mark, np.array(ids, np.uint32)
                break
        self.by_word = self._joins_nothing()
        self._clear()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _joins_nothing(self) -> bool:
        """Whether white space only separates, on probes; else whole texts are encoded."""
        probes = ("ab cd", "a\n\tb", "don't it's", "x , y", "1 2 34 é", "üß \x0b\x0c.", "<|endoftext|> a", "A Big WORD")
        return all(self._plain(t) == [x for w in t.encode().lower().split() for x in self._plain(w.decode())] for t in probes)

    def _clear(self) -> None:
        self.keys = np.zeros(1 << 21, np.uint64)
        self.entry = np.zeros(1 << 21, np.int32)
        self.known = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 15, np.int64)
        self.used = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of word hashes in the open table, -1 where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(hashes), -1, np.int64)
        left, at = np.arange(len(hashes)), hashes & mask
        while len(left):
            keys = self.keys[at]
            hit = keys == hashes[left]
            out[left[hit]] = self.entry[at[hit]]
            go = ~hit & (keys != 0)
            left, at = left[go], (at[go] + np.uint64(1)) & mask
        return out

    def _put(self, hashes: np.ndarray) -> None:
        """Enter new distinct hashes with the entries that _add has made for them, in order."""
        mask = np.uint64(len(self.keys) - 1)
        entries = np.arange(self.known, self.known + len(hashes), dtype=np.int32)
        self.known += len(hashes)
        at = hashes & mask
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            mine = self.keys[at] == hashes
            self.entry[at[mine]] = entries[mine]
            hashes, entries, at = hashes[~mine], entries[~mine], (at[~mine] + np.uint64(1)) & mask

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, first = self.used, self.known
        while n + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(lengths) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[n : n + len(ids)] = ids
        self.ends[first + 1 : first + 1 + len(lengths)] = n + np.cumsum(lengths)
        self.used = n + len(ids)

    def _ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words, and how many each has."""
        mark = self.separator.encode() if self.separator else b""
        alone = {i for i, w in enumerate(words) if not mark or mark in w or b"<|" in w}
        got: list = [None] * len(words)
        joined = [i for i in range(len(words)) if i not in alone]
        if joined:
            text = f" {self.separator} ".join(words[i].decode("utf-8", "replace") for i in joined)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            k = len(self.mark)
            hit = np.ones(max(0, len(ids) - k + 1), bool)
            for j in range(k):
                hit &= ids[j : j + len(hit)] == self.mark[j]
            at = np.flatnonzero(hit)
            if len(at) == len(joined) - 1:
                if not alone:
                    keep = np.ones(len(ids), bool)
                    for j in range(k):
                        keep[at + j] = False
                    return ids[keep], np.diff(np.concatenate([[-k], at, [len(ids)]])) - k
                for i, a, b in zip(joined, [0, *(at + k)], [*at, len(ids)], strict=True):
                    got[i] = ids[a:b]
            else:
                alone.update(joined)
        for i in alone:
            got[i] = np.array(self._plain(words[i].decode("utf-8", "replace")), np.uint32)
        return np.concatenate(got), np.array([len(g) for g in got], np.int64)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        self._add(*self._ids_of(words))
        self._put(hashes)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.ends[at]
        lengths = self.ends[at + 1] - starts
        total = np.cumsum(lengths)
        return self.ids[np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)], lengths

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts data[at[i]:at[i + 1]] one after the other, and their bounds (n + 1)."""
        if not self.by_word:
            raw = data.tobytes()
            got = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], add_special_tokens=False)
            return np.array([x for e in got for x in e.ids], np.uint32), np.concatenate([[0], np.cumsum([len(e.ids) for e in got])]).astype(np.int64)
        starts, ends, before = word_bounds(data, at)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        hashes = word_hashes(data, starts, ends, lower=True)
        entries = self._find(hashes)
        if (entries < 0).any():
            if self.known > CACHE:
                self._clear()
                entries[:] = -1
            new, first = np.unique(np.where(entries < 0, hashes, np.uint64(0)), return_index=True)
            if entries[first[0]] >= 0:
                new, first = new[1:], first[1:]
            raw = data.tobytes().lower()
            self._learn(new, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            missing = np.flatnonzero(entries < 0)
            entries[missing] = self._find(hashes[missing])
        ids, lengths = self._gather(entries)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[before]


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encoded(column: pa.Array, path: str, end_id: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and ids of each text, with end_id last."""
    t = tokenizer(path)
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    for lo, hi, data, at in chunks(column):
        ids, bounds = t.encode(data, at)
        for i in range(hi - lo):
            yield lo + i, np.concatenate([ids[bounds[i] : bounds[i + 1]], tail])
