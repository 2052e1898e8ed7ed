import numpy as np
from pyspark.sql import types as T

from tickloom.llm import hnsw, neardup

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
DIM = 24


def brute(rows, least=0.93):
    """Links of all rows with all rows, and the smallest id of each group by following them."""
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: [] for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    near[i].append(j)
    out = []
    for i in range(len(rows)):
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


def family(rng, centre, n, noise, first, label):
    return [(first + i, (centre + rng.normal(0, noise, DIM)).astype(np.float32).tolist(), label) for i in range(n)]


def sample(seed, n=260):
    rng = np.random.default_rng(seed)
    rows = family(rng, np.zeros(DIM), n, 1, 0, 1)
    rows += family(rng, rng.normal(0, 1, DIM), 90, 0.12, 1000, 1) + family(rng, rng.normal(0, 1, DIM), 40, 0.25, 2000, 2) + family(rng, rng.normal(0, 1, DIM), 30, 0.05, 3000, 1)
    rows += [(5000 + i, rows[3][1], 1) for i in range(25)]  # exact copies
    rows += [(6000, (np.array(rows[5][1]) * 8).tolist(), 1), (7000, rows[5][1], 2), (7000, rows[6][1], 1), (None, rows[7][1], 1)]
    return rows


ODD = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 1.0], None), (8, [1.0, 1.0], None),
       (9, [1.0, 1.0], 3), (9, [1.0, 1.0], 3), (10, [2.0, 2.0], 3), (11, [-0.0, 1.0], 3), (12, [0.0, 1.0], 3), (13, [1.0, 1.0, 0.0], 3), (14, [1e30, 1e30], 3), (None, None, None), (None, [1e-30, 1e-30], 3)]


def test_links_and_groups_equal_brute_force(spark):
    many = sample(1)
    for rows, shard_rows in ((many, 8192), (many, 100), (ODD, 8192), (ODD[:9], 1)):
        df = spark.createDataFrame(rows, VEC).repartition(3).selectExpr("*", "'x' AS node", "1 AS shard", "2 AS links", "3 AS vec", "4 AS n_links")
        got, audits = neardup.near_copies(df, shard_rows=shard_rows)
        assert sorted(map(tuple, got.collect()), key=str) == brute([tuple(r) for r in spark.createDataFrame(rows, VEC).collect()])
        for r in audits.collect():
            assert r.found_links >= neardup.RECALL * r.true_links


def test_empty_table(spark):
    got, audits = neardup.near_copies(spark.createDataFrame([], VEC))
    assert got.collect() == [] and audits.collect() == []


def unit(rng, n):
    x = np.concatenate([rng.normal(0, 1, (n, DIM)), rng.normal(0, 1, DIM) + rng.normal(0, 0.1, (n // 3, DIM))]).astype(np.float32)
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_graph_search_recall_and_reach():
    rng = np.random.default_rng(4)
    x = unit(rng, 1500)
    g = hnsw.build(x, hnsw.levels(rng.integers(0, 1 << 63, len(x)).astype(np.uint64)))
    for layer, links in enumerate(g.layers):
        seen = np.zeros(len(x), bool)
        hnsw._reached(links, g.entry, seen)
        assert (seen == (g.level >= layer)).all()
        assert all(g.level[links[r][links[r] >= 0]].min(initial=99) >= layer for r in np.flatnonzero(seen))
    rows, nodes = hnsw.within(g, x, 0.9, 16)
    r, c = np.nonzero(x @ x.T >= 0.9)
    found = set(zip(rows.tolist(), nodes.tolist()))
    true = set(zip(r.tolist(), c.tolist()))
    assert len(found) == len(rows) and found <= true | {(a, b) for a, b in found if x[a] @ x[b] > 0.899} and len(found & true) >= 0.98 * len(true)


def test_audit_widens_beams_until_links_are_found():
    """A graph without links finds nothing but its entry; the audits widen the beams up to a full comparison."""
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, DIM) + rng.normal(0, 0.1, (300, DIM))
    x = neardup.unit_rows(v)
    g = hnsw.Graph(x, np.zeros(300, np.int64), [np.full((300, 4), -1, np.int32)], 0)
    rows, nodes, (true, found, beam) = neardup.audited_links(g, v, v, True, 0.93)
    assert beam >= 300 and true == found > 0
    e = v / np.linalg.norm(v, axis=1)[:, None]
    assert len(rows) == int((e @ e.T >= 0.93).sum()) - 300


def test_stars_join_what_pairs_join():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n_rows, n_nodes, m = rng.integers(1, 12, 3)
        rows, nodes = rng.integers(0, n_rows, m), rng.integers(0, n_nodes, m)
        a, b = neardup.star_roots(rows, nodes, n_rows, n_nodes)
        parts = [({("r", r), ("n", n)}) for r, n in zip(rows.tolist(), nodes.tolist())]
        stars = [({("r", r), ("n", int(n))}) for r, n in enumerate(a) if n >= 0] + [({("n", r), ("n", int(n))}) for r, n in enumerate(b) if n >= 0]
        assert union(parts) == union(stars)


def union(sets):
    out = []
    for s in sets:
        for o in [o for o in out if o & s]:
            out.remove(o)
            s = s | o
        out.append(s)
    return {frozenset(s) for s in out}
