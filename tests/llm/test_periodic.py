import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import ntt, periodic


def brute(words):
    """All runs: per period the maximal stretches of equal words at that distance, if no divisor is a period."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if j > i and length >= max(6, 4 * q):
                run = words[start:start + length]
                if all(any(run[k] != run[k + d] for k in range(length - d)) for d in range(1, q)):
                    found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


PIECES = st.one_of(st.lists(st.sampled_from("abc"), max_size=9), st.builds(lambda p, n, cut: (p * n)[:len(p) * n - cut], st.lists(st.sampled_from("abcd"), min_size=1, max_size=14), st.integers(2, 9), st.integers(0, 5)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=5).map(lambda x: sum(x, [])), min_size=1, max_size=4))
def test_runs_equal_brute_force(texts):
    sizes = np.array([len(t) for t in texts], np.int64)
    origin = np.cumsum(sizes) - sizes
    ids = np.concatenate([periodic.word_ids([w.encode() for w in t]) + o for t, o in zip(texts, origin)])
    got = list(zip(*(x.tolist() for x in periodic.find_runs(ids, sizes))))
    assert got == [(s + int(o), n, q) for t, o in zip(texts, origin) for s, n, q in brute(t)]


def test_long_runs_with_hot_and_rare_words():
    rng = np.random.default_rng(2)
    for p in (1, 2, 63, 64, 65, 127, 300, 1000):
        base = [str(x) for x in rng.integers(0, 1 << 30, p)]
        text = [str(x) for x in rng.integers(0, 40, 500)] + (base * 11)[:4 * p + 7] + ["end"] * 7
        ids = periodic.word_ids([w.encode() for w in text])
        got = list(zip(*(x.tolist() for x in periodic.find_runs(ids, np.array([len(ids)])))))
        assert (500, 4 * p + 7, p) in got and (len(text) - 7, 7, 1) in got
        assert len(text) > 3000 or got == brute(text)
    assert [x.tolist() for x in periodic.find_runs(np.zeros(30_000, np.int64), np.array([30_000]))] == [[0], [30_000], [1]]


@pytest.mark.parametrize("size", [2, 4, 32])
def test_squared_differences_are_exact(size):
    rng = np.random.default_rng(size)
    short, long = rng.integers(0, 1 << 20, (7, size)), rng.integers(0, 1 << 20, (7, 2 * size - 1))
    long[0, size // 2:size // 2 + size] = short[0]
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(s, w[k:])) for k in range(size)] for s, w in zip(short, long)]
    for prime, root, _ in ntt.PRIMES:
        assert ntt.squared_differences(short, long, prime, root).tolist() == [[x % prime for x in row] for row in want]


def planted(doc_id, text):
    words = [] if text is None else text.encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())


def test_query_parts_equal_brute_force(make_docs, odd_docs, odd_rows, no_docs):
    texts = ["a b c " * 9, "x y\tx\ny x\x0by x y x y", "é é " * 4 + "é ", "one two three four five six seven", " \n", "0 0 0 0 0", "0 0 0 0 0 0", "q " * 50 + "r q q q q q q q"]
    rows = [(i, texts[i % len(texts)] + f" tail {i} tail {i} " * (i % 7)) for i in range(160)] + [(i, t) for i, t in enumerate(texts)]
    for docs, want in ((make_docs(rows, ("words", "n", "g", "runs", "collapsed")), rows), (odd_docs, [r[:2] for r in odd_rows if len(r[1] or "") < 9000]), (no_docs, [])):
        got = periodic.summary(periodic.collapse(periodic.with_planted_repeats(docs))).collect()
        short = [tuple(r) for r in got if r.doc_id not in (7, 8) or docs is not odd_docs]
        want = [expected(*r) for r in want if r[0] not in (7, 8) or docs is not odd_docs]
        assert sorted(short, key=str) == sorted(want, key=str)
        if docs is odd_docs:
            assert len(got) == len(odd_rows) and next(r for r in got if r.doc_id == 7).length >= 6


def test_collapsed_text_and_runs_of_the_operator(make_docs):
    row = periodic.collapse(make_docs([(1, "in " + "ha ho " * 5 + "out")])).first()
    assert row.collapsed == "in ha ho out" and [tuple(r) for r in row.runs] == [(1, 10, 2)] and row.n_words == 12
