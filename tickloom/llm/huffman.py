"""Canonical length-limited Huffman codes over integer ids, with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for a count of 0.

    The limit rises to what the number of symbols needs. A lone symbol gets one bit.
    """
    symbols = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n < 2:
        lengths[symbols] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(n))))
    if limit > 25:
        raise ValueError("more symbols than the decoding table can hold")
    leaves = symbols[np.argsort(counts[symbols], kind="stable")]
    weight = counts[leaves].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < n)  # which items are leaves
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        m = int(is_leaf[:take].sum())
        lengths[leaves[:m]] += 1
        take = 2 * (take - m)
    return lengths


@dataclass
class Codebook:
    """Canonical codes: shorter first, then by id. The lengths alone define them."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.width = int(self.lengths.max(initial=1))
        symbols = np.flatnonzero(self.lengths)
        symbols = symbols[np.argsort(self.lengths[symbols], kind="stable")]
        bits = self.lengths[symbols].astype(np.int64)
        room = np.left_shift(1, self.width - bits)
        first = np.cumsum(room) - room
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[symbols] = first >> (self.width - bits)
        table = np.repeat(symbols, room)
        self.table = np.zeros(1 << self.width, np.int32)
        self.table[: len(table)] = table
        self.table_bits = self.lengths[self.table].astype(np.int64)

    def encode(self, ids: np.ndarray, every: int = 64) -> tuple[bytes, np.ndarray]:
        """Bits of the ids, the first in the highest bit, and the bit offset of each ``every``-th id."""
        bits = self.lengths[ids].astype(np.int64)
        if len(ids) and not bits.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(bits)
        at = ends - bits
        n_bytes = (self.width + 14) // 8
        window = self.codes[ids] << (8 * n_bytes - (at & 7) - bits).astype(np.uint64)
        out = np.zeros((int(ends[-1]) + 7) // 8 + n_bytes if len(ids) else 0, np.uint8)
        for k in range(n_bytes):
            np.add.at(out, (at >> 3) + k, (window >> np.uint64(8 * (n_bytes - 1 - k))).astype(np.uint8))
        size = (int(ends[-1]) + 7) // 8 if len(ids) else 0
        return out[:size].tobytes(), at[::every].astype(np.int64)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, every: int = 64) -> np.ndarray:
        """The n ids; all checkpoints advance together, one table lookup per id."""
        if not n:
            return np.zeros(0, np.int32)
        data = np.zeros(len(payload) + 8, np.uint32)
        data[: len(payload)] = np.frombuffer(payload, np.uint8)
        words = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
        at, last = checkpoints.copy(), 8 * (len(payload) + 4)
        out = np.empty((every, len(at)), np.int32)
        down = np.uint32(32 - self.width)
        for step in range(min(every, n)):
            entry = (words[at >> 3] << (at & 7).astype(np.uint32)) >> down
            out[step] = self.table[entry]
            at += self.table_bits[entry]
            np.minimum(at, last, out=at)  # the last lane may be shorter than the others
        return out.T.reshape(-1)[:n]
