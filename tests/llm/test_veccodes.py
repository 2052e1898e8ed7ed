import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tickloom.llm import common, veccodes

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def expected(rows, parts, n_entries, rounds):
    """Codes, errors and codebooks by plain loops over Python integers."""
    ok = [r for r in rows if r[1] is not None and len(r[1]) >= parts and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    ints = [[math.floor(256 * x) for x in r[1]] for r in ok]
    size = len(ints[0])
    edges = [size * i // parts for i in range(parts + 1)]
    books = [[v[a:b] for v in ints[:n_entries]] for a, b in zip(edges, edges[1:])]

    def assign():
        out = []
        for v in ints:
            out.append([min((sum((x - c) ** 2 for x, c in zip(v[edges[p]:edges[p + 1]], e)), i) for i, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[edges[p]:edges[p + 1]] for v, a in zip(ints, got) if a[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    got = assign()
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in a), sum(d for d, _ in a), r[2]) for r, a in zip(ok, got)), key=str), digest


ODD = [(1, None, 1), (2, [], 1), (3, [0.5, None, 0.1, 0.2], 2), (4, [float("nan")] * 4, 2), (5, [float("inf"), 0.0, 0.0, 0.0], None), (6, [0.1, 0.2], 1),
       (7, [0.1, 0.2, 0.3, 0.4], None), (7, [0.1, 0.2, 0.3, 0.4], None), (8, [-0.1, -0.001, 0.3, 0.4], 1), (None, [0.1, 0.2, 0.3, 0.5], 1), (9, [0.0, 0.0, 0.0, 0.0], 2), (10, [0.1] * 6, 2)]


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    many = [(int(i), (np.round(rng.normal(0, 0.05, 12) * 64) / 256).astype(np.float32).tolist(), int(i) % 3) for i in rng.permutation(300)]
    for rows, parts, n_entries in ((many, 4, 9), (many, 5, 200), (ODD, 2, 2), (ODD, 2, 64), (many[:1], 3, 4)):
        df = spark.createDataFrame(rows, VEC).repartition(3).selectExpr("*", "'x' AS code", "1 AS error", "2 AS _key", "'y' AS vec", "3 AS id")
        coded, entries = veccodes.compress(df, parts, n_entries)
        want, digest = expected([tuple(r) for r in spark.createDataFrame(rows, VEC).collect()], parts, n_entries, 2)
        assert sorted(map(tuple, coded.collect()), key=str) == want
        assert veccodes.codebook_digest(entries, veccodes.part_edges(entries.shape[1], parts)) == digest


def test_empty_table_and_group_totals(spark):
    coded, entries = veccodes.compress(spark.createDataFrame([], VEC))
    assert coded.collect() == [] and entries.size == 0
    assert len(veccodes.codebook_digest(entries, veccodes.part_edges(0, 16))) == 64
    coded, _ = veccodes.compress(spark.createDataFrame(ODD, VEC), 2, 2)
    rows = coded.collect()
    for few in (0, 10):
        common.FEW_GROUPS, old = few, common.FEW_GROUPS
        got = veccodes.with_group_total(veccodes.cut_lineage(coded), "label", "error", "label_error").collect()
        common.FEW_GROUPS = old
        assert len(got) == len(rows) and all(g.label_error == sum(r.error for r in rows if r.label == g.label) for g in got)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(0, 60), st.integers(1, 6), st.integers(1, 40), st.randoms(use_true_random=False))
def test_trie_walk_equals_full_search(width, n, n_entries, subtree, random):
    part = np.array([[random.randint(-3, 3) for _ in range(width)] for _ in range(n)], np.int64).reshape(n, width)
    entries = np.array([[random.randint(-3, 3) for _ in range(width)] for _ in range(n_entries)], np.int64)
    if not n:
        assert all(len(x) == 0 for x in veccodes.nearest_entries(part, entries))
        return
    veccodes.SUBTREE, old = subtree, veccodes.SUBTREE
    leaves, weight, place = veccodes.distinct_parts(part)
    code, best = veccodes.nearest_entries(leaves, entries)
    veccodes.SUBTREE = old
    full = ((part[:, None] - entries[None]) ** 2).sum(2)
    assert (code[place] == full.argmin(1)).all() and (best[place] == full.min(1)).all()
    assert weight.sum() == n and (leaves[place] == part).all()
