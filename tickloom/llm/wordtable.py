"""Encoding by distinct words: each word is given to the tokenizer once, texts are put together from its ids."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start:start+length] of every row, one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class WordTable:
    """Ids of words by way of ``encode`` (list of words -> list of id lists), kept for reuse.

    Right for tokenizers whose pieces never cross a word border. ``limit`` bounds the words that are
    kept; beyond it the table starts anew, which costs time but changes no result.
    """

    def __init__(self, encode: Callable[[list], list[list[int]]], limit: int = 200_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.slot: dict = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def slots(self, words: list) -> np.ndarray:
        """Number of each word; equal words have equal numbers until the next call that clears the table."""
        if len(self.slot) > self.limit:
            self._clear()
        out = np.fromiter(map(self.slot.get, words, [-1] * len(words)), np.int64, len(words))
        gaps = np.flatnonzero(out < 0)
        if len(gaps):
            missing = [words[i] for i in gaps.tolist()]
            self._add(list(dict.fromkeys(missing)))
            out[gaps] = np.fromiter(map(self.slot.get, missing), np.int64, len(missing))
        return out

    def _add(self, words: list) -> None:
        ids = self.encode(words)
        n, first = len(words), len(self.slot)
        lengths = np.fromiter(map(len, ids), np.int64, n)
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.start):
            self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.start[first:first + n] = self.used + np.cumsum(lengths) - lengths
        self.length[first:first + n] = lengths
        self.used += total
        self.slot.update(zip(words, range(first, first + n)))

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each word has."""
        lengths = self.length[slots]
        return ragged_take(self.flat, self.start[slots], lengths), lengths


def by_size(texts: Iterable, most: int = 1 << 20) -> Iterator[list]:
    """Runs of texts of about ``most`` characters; a longer text comes alone. None stands for an empty text."""
    run, size = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``lengths`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]
