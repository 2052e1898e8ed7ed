import hashlib
import math
import re
from collections import defaultdict

import pytest

from tickloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, excess over the limit dealt again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, open_, total = {}, set(names), sum(sizes.values())
    while open_:
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}
        open_ -= over
    return fixed


def expected(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, s in rows]
    by = defaultdict(int)
    for r, n in zip(rows, size):
        by[r[3]] += n
    want = targets(by)
    out = []
    for s in by:
        mine = sorted(((hashlib.md5(f"0:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, n) for r, n in zip(rows, size) if r[3] == s))
        left = math.floor(want[s] + 1e-9)
        taken = [0] * len(mine)
        while left > 0 and by[s]:
            for i, (_, _, _, n) in enumerate(mine):
                part = min(n, left)
                taken[i] += part
                left -= part
        out += [(m[2] if m[1] else None, m[3], by[s], t) for m, t in zip(mine, taken)]
    return sorted(out, key=str), want


SOURCES = [(i, "w " * (3 * (i % 7)), "en", s) for i, s in enumerate(["b", "a", None, "b", "é", "b", "a", "Z", "b", "b", "b", "b", "b", "b"])]


@pytest.mark.parametrize("rows", [SOURCES, [(1, "a b c", None, "x")], [(1, None, None, None), (None, "a b", None, None), (2, "", None, "q")],
                                  [(i % 5, "u v w", None, "big" if i % 3 else "small") for i in range(60)]])
def test_mix_equals_brute_force(make_docs, rows):
    got = mixing.mix(make_docs(rows)).collect()
    want, target = expected(rows)
    assert sorted(((r.doc_id, r["size"], r.source_size, r.taken) for r in got), key=str) == want
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r["size"]
    for s in target:
        assert sum(r.taken for r in got if r.source == s) == math.floor(target[s] + 1e-9)


def test_mixed_documents_come_as_often_as_taken(make_docs):
    docs = make_docs(SOURCES)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = defaultdict(int)
    for r in out.collect():
        copies[r.doc_id] += 1
    for r in mixing.mix(docs).collect():
        assert copies[r.doc_id] == r.epochs + (r.tail_words > 0)


def test_odd_and_empty(odd_docs, no_docs, odd_rows):
    assert mixing.mix(odd_docs).count() == len(odd_rows)
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []
