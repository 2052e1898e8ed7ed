"""Exact number-theoretic transforms of many rows at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Primes c * 2^k + 1 below 2^31 with a primitive root and k.
PRIMES = ((2013265921, 31, 27), (469762049, 3, 26), (167772161, 3, 25))
LARGEST = 1 << 25


@lru_cache(maxsize=256)
def _roots(size: int, prime: int, root: int, inverse: bool) -> np.ndarray:
    """Powers 0 to size / 2 - 1 of a root of unity of that order."""
    w = pow(root, (prime - 1) // size, prime)
    w = pow(w, prime - 2, prime) if inverse else w
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:  # doubling: powers k to 2k - 1 are powers 0 to k - 1 times w^k
        out = np.concatenate([out, out * np.uint64(pow(w, len(out), prime)) % np.uint64(prime)])
    return out


def _product(a: np.ndarray, b: np.ndarray, p: np.uint64) -> np.ndarray:
    x = a * b
    x -= (x // p) * p
    return x


def _wrapped(x: np.ndarray, p: np.uint64) -> np.ndarray:
    """x mod p for x below 2 p: the difference wraps around to a huge number where x is below p."""
    return np.minimum(x, x - p)


def forward(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Transform of each row, in bit-reversed order; the row length is a power of two."""
    p, (m, size) = np.uint64(prime), rows.shape
    a = rows
    while size > 1:
        pair = a.reshape(m, -1, 2, size // 2)
        u, v = pair[:, :, 0], pair[:, :, 1]
        out = np.empty_like(pair)
        out[:, :, 0] = _wrapped(u + v, p)
        out[:, :, 1] = _product(_wrapped(u + (p - v), p), _roots(size, prime, root, False), p)
        a, size = out, size // 2
    return a.reshape(rows.shape)


def backward(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Rows whose ``forward`` is given."""
    p, (m, n) = np.uint64(prime), rows.shape
    a, size = rows, 2
    while size <= n:
        pair = a.reshape(m, -1, 2, size // 2)
        u, v = pair[:, :, 0], _product(pair[:, :, 1], _roots(size, prime, root, True), p)
        out = np.empty_like(pair)
        out[:, :, 0] = _wrapped(u + v, p)
        out[:, :, 1] = _wrapped(u + (p - v), p)
        a, size = out, size * 2
    return _product(a.reshape(rows.shape), np.uint64(pow(n, prime - 2, prime)), p)


def squared_differences(short: np.ndarray, long: np.ndarray, prime: int, root: int) -> np.ndarray:
    """sum((short[r, i] - long[r, i + lag])^2 over i) mod prime, for each row and lag at which short lies inside long.

    Values are not negative. The sum is the squares of both minus twice their correlation, which
    is one product of transforms.
    """
    p, (m, b), w = np.uint64(prime), short.shape, long.shape[1]
    size = 1 << max(1, (w - 1).bit_length())  # wrapped products fall on lags below zero only
    x, y = np.zeros((m, size), np.uint64), np.zeros((m, size), np.uint64)
    x[:, :b], y[:, :w] = short[:, ::-1].astype(np.uint64) % p, long.astype(np.uint64) % p
    own = np.zeros((m, w + 1), np.uint64)
    np.cumsum(_product(y[:, :w], y[:, :w], p), axis=1, out=own[:, 1:])  # below 2^31 each, 2^25 of them at most
    squares = _product(x, x, p).sum(1, dtype=np.uint64) % p
    both = backward(_product(forward(x, prime, root), forward(y, prime, root), p), prime, root)[:, b - 1:w]
    sums = squares[:, None] + (own[:, b:] - own[:, :w - b + 1]) % p
    return (sums + np.uint64(2) * (p - both)) % p
