import random
from collections import defaultdict

import numpy as np

from tickloom.llm import setjoin
from tickloom.llm.common import Scratch
from tickloom.llm.components import components


def brute(rows, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed):
    """Families around common texts: light and heavy edits, tails cut off, a passage that all share, exact copies."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for family in range(9):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 12, 40, 90, 160]))]
        for k in range(14):
            words = edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3]))
            if rng.random() < 0.5:
                words = words[: max(5, int(len(words) * rng.choice([0.75, 0.85, 0.95])))]
            if rng.random() < 0.3:
                words = words + passage
            if family % 3 == 0 and k % 2:  # a second group of the same stock
                words = words[len(words) // 6:]
            rows.append(" ".join(words))
    rows += ["One two three", "one TWO  three", "", None, "\t\n"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(100 + i, rows[j]) for i, j in enumerate(order)]


def check(make_docs, rows):
    got = setjoin.jaccard_join(make_docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_groups_equal_brute_force(make_docs):
    check(make_docs, corpus(1))


def test_members_are_searched_where_leaders_do_not_link(make_docs):
    # a short text lies whole inside a long one; a third text links with the short one only
    base = [f"w{i}" for i in range(104)]
    rows = [(i, " ".join(x)) for i, x in enumerate([base, base[:86], base[:85], base[:70], base[:69] + ["q"], base[16:], base[17:]])]
    check(make_docs, rows)


def test_odd_rows(odd_docs, no_docs, odd_rows):
    got = setjoin.jaccard_join(odd_docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(d, t) for d, t in odd_rows])
    assert setjoin.jaccard_join(no_docs).collect() == []


def test_shingles_and_bounds():
    assert len(setjoin.shingles("a b c d e f")) == 2
    assert (setjoin.shingles("A b\tC") == setjoin.shingles("a  B c\n")).all()
    a, b = np.meshgrid(np.arange(1, 60), np.arange(1, 60))
    need = setjoin.least_overlap(a, b, 80)
    assert (100 * need >= 80 * (a + b - need)).all() and (100 * (need - 1) < 80 * (a + b - need + 1)).all()


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test-components")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50))


def test_word_hashes_do_not_depend_on_the_place():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**7)}" for _ in range(28_000)]
    for size in (200_000, 300_000, 600_000):  # shorter and longer than a piece
        base = " ".join([*words, "g" * size, *words[::-1]])
        front = " ".join(f"x{i}" for i in range(4_000))
        a, b, c = (set(setjoin.shingles(t).tolist()) for t in (base, f"{front} {base}", front))
        assert a <= b and len(b - a) == len(c) + 4
    one = setjoin._word_hashes(b"v" * 300_000)[0]
    assert all((setjoin._word_hashes(b"v " * k + b"v" * 300_000)[-1] == one) for k in (1, 50_000, 131_000))
