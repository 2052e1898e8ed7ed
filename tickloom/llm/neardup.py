"""Near copies among embeddings: small-world graphs per shard, audited beams, verified cosines, united groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import hnsw
from tickloom.llm.common import Scratch, table, usable, with_group_total
from tickloom.llm.components import components
from tickloom.llm.registry import query
from tickloom.session import cut_lineage

#: Vectors of a shard, about; a label with more has more shards.
SHARD_ROWS = 8192
#: Width of the first beam, share of true links that an audit must find, and one in how many vectors is audited (AUDIT_LEAST at least).
BEAM, RECALL, AUDIT_EVERY, AUDIT_LEAST = 32, 0.98, 8, 64
#: Cosines of the search are single precision; pairs this much below the threshold are verified, too.
SLACK = 1e-4
CHUNK = 1 << 16


def exact_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as doubles, divided by a power of two each, so that no square overflows or vanishes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None]) if len(v) else v


def unit_rows(v: np.ndarray) -> np.ndarray:
    return (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)


def verified(a: np.ndarray, b: np.ndarray, rows: np.ndarray, nodes: np.ndarray, least: float) -> np.ndarray:
    """Which (row, node) pairs have a cosine of ``least`` or more in double precision."""
    na, nb, out = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)), np.zeros(len(rows), bool)
    for lo in range(0, len(rows), CHUNK):
        r, c = rows[lo:lo + CHUNK], nodes[lo:lo + CHUNK]
        out[lo:lo + CHUNK] = np.einsum("ij,ij->i", a[r], b[c]) / (na[r] * nb[c]) >= least
    return out


def audited_links(g: hnsw.Graph, exact: np.ndarray, asked: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Verified (query, node) pairs of one block of queries in one shard, and the audit: true links, found links, last beam.

    Some queries are compared with the whole shard. While the beams find less than RECALL of their links,
    all beams double; a beam as wide as the shard compares everything. ``same``: queries are the shard's own vectors.
    """
    q, width = unit_rows(asked), BEAM
    step = max(1, min(AUDIT_EVERY, len(q) // AUDIT_LEAST))
    sample = np.arange(0, len(q), step)
    true = set()
    for lo in range(0, len(sample), 512):
        some = sample[lo:lo + 512]
        r, c = np.nonzero(unit_rows(asked[some]) @ g.x.T >= least - SLACK)
        ok = verified(asked, exact, some[r], c, least) & ~(same & (some[r] == c))
        true.update((some[r[ok]] * len(exact) + c[ok]).tolist())
    while True:
        rows, nodes = hnsw.within(g, q, least - SLACK, width)
        ok = verified(asked, exact, rows, nodes, least) & ~(same & (rows == nodes))
        rows, nodes = rows[ok], nodes[ok]
        mine = rows % step == 0
        found = len(true.intersection((rows[mine] * len(exact) + nodes[mine]).tolist()))
        if found >= RECALL * len(true) or width >= len(exact):
            return rows, nodes, (len(true), found, width)
        width *= 2


def star_roots(rows: np.ndarray, nodes: np.ndarray, n_rows: int, n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """For queries and nodes that have a pair: a node of their group, so that one edge each says what all pairs say; -1 for the others."""
    root = np.arange(n_nodes)
    linked, of_row = np.zeros(n_nodes, bool), np.full(n_rows, -1)
    order = np.argsort(rows, kind="stable")
    starts = np.searchsorted(rows[order], np.arange(n_rows + 1))
    for r in np.flatnonzero(np.diff(starts)).tolist():
        hit = nodes[order[starts[r]:starts[r + 1]]]
        groups = root[hit]
        first = groups.min()
        if (groups != first).any():
            root[np.isin(root, groups)] = first
        linked[hit] = True
        of_row[r] = first
    return np.where(of_row >= 0, root[of_row], -1), np.where(linked, root, -1)


GRAPH_DDL = "label {label}, shard int, shards int, node long, n long, vec {vec}, level int, links array<array<int>>"
FOUND_DDL = "node long, root long, n long, true_links long, found_links long, beam int"


def build_graphs(classes: DataFrame) -> DataFrame:
    """A graph per (label, shard): every vector with its layers' links, as places in the shard by ascending node."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        x = unit_rows(exact_rows(t["vec"]))
        g = hnsw.build(x, hnsw.levels(np.asarray(t["random"]).view(np.uint64)))
        lists = [[[int(i) for i in links[r] if i >= 0] for links in g.layers[:top + 1]] for r, top in enumerate(g.level.tolist())]
        return t.select(["label", "shard", "shards", "node", "n", "vec"]).append_column("level", pa.array(g.level.astype(np.int32))).append_column("links", pa.array(lists, pa.list_(pa.list_(pa.int32()))))

    kinds = dict(classes.dtypes)
    rows = classes.select("label", "shard", "shards", "node", "n", "vec", F.xxhash64("vec", F.lit(7)).alias("random"))
    return rows.groupBy("label", "shard").applyInArrow(run, GRAPH_DDL.format(label=kinds["label"], vec=kinds["vec"]))


def _graph(t: pa.Table, x: np.ndarray) -> hnsw.Graph:
    level = np.asarray(t["level"]).astype(np.int64)
    layers = [np.full((len(x), (1 if layer else 2) * hnsw.LINKS + 1), -1, np.int32) for layer in range(int(level.max()) + 1)]
    for r, lists in enumerate(t["links"].to_pylist()):
        for layer, found in zip(layers, lists):
            layer[r, :len(found)] = found
    return hnsw.Graph(x, level, layers, int(np.argmax(level)))


def query_graphs(graphs: DataFrame, least: float) -> DataFrame:
    """Every vector against every shard of its label: sums of links, edges to a node of the group, and the audit of each pair of shards.

    A group is one block of queries and one shard, both of bounded size.
    """

    def run(asks: pa.Table, has: pa.Table) -> pa.Table:
        asks, has = asks.sort_by("node"), has.sort_by("node")
        exact, asked = exact_rows(has["vec"]), exact_rows(asks["vec"])
        names, here, copies = np.asarray(asks["node"]), np.asarray(has["node"]), np.asarray(has["n"])
        same = len(names) == len(here) and bool((names == here).all())
        rows, nodes, audit = audited_links(_graph(has, unit_rows(exact)), exact, asked, same, least)
        of_row, of_node = star_roots(rows, nodes, len(names), len(here))
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, rows, copies[nodes])
        a, b = np.flatnonzero(of_row >= 0), np.flatnonzero(of_node >= 0)
        node = np.concatenate([names[a], here[b], [-1]])
        root = np.concatenate([here[of_row[a]], here[of_node[b]], [-1]])
        tail = [pa.array(np.concatenate([np.zeros(len(node) - 1, np.int64), [v]])) for v in audit[:2]]
        beam = pa.array(np.concatenate([np.zeros(len(node) - 1, np.int32), [audit[2]]]).astype(np.int32))
        return pa.table([pa.array(node), pa.array(root), pa.array(np.concatenate([sums[a], np.zeros(len(b) + 1, np.int64)])), *tail, beam], names=["node", "root", "n", "true_links", "found_links", "beam"])

    other = F.expr("explode(sequence(0, shards - 1))")
    asks = graphs.select("label", F.col("shard").alias("q"), other.alias("t"), "node", "vec").groupBy("label", "q", "t")
    has = graphs.select("label", F.col("shard").alias("t"), other.alias("q"), "node", "n", "vec", "level", "links").groupBy("label", "q", "t")
    return asks.cogroup(has).applyInArrow(run, FOUND_DDL)


def near_copies(vectors: DataFrame, least: float = 0.93, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links, component_id, kept) of every vector, and the audits (true_links, found_links, beam) of the search.

    Vectors of one label are linked when their cosine in double precision is ``least`` or more. Equal vectors
    of a label are searched once and counted as often as they occur. A label is dealt over shards of about
    ``shard_rows`` distinct vectors; each shard gets a graph, and every vector searches every shard of its
    label, with beams that widen until a sample compared with the whole shard shows RECALL of its links.
    Every pair found is verified, so no link is false. Pairs are counted and united where they are found, never listed.

    n_links counts other rows; component_id is the smallest id reached, null if all are; kept says whether that is the row's own id.
    Null labels and vectors that are null, zero, empty or hold null, NaN or infinite components link with nothing, nor do
    vectors of different lengths. Repeated ids are rows of their own. Empty table: no rows. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "near-copies")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    links = usable("vec") & F.col("label").isNotNull() & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("links", F.coalesce(links, F.lit(False)))
    usual = rows.filter("links").drop("links")
    try:
        kind = F.struct("label", F.size("vec").alias("width"))  # vectors of different lengths never meet
        classes = usual.groupBy(kind.alias("label"), "vec").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
        classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()))
        sized = with_group_total(classes.withColumn("one", F.lit(1).cast("long")), "label", "one", "size")
        sized = sized.withColumn("shards", F.expr(f"cast((size + {int(shard_rows) - 1}) div {int(shard_rows)} as int)"))
        graphs = scratch.table(build_graphs(sized.withColumn("shard", F.expr("cast(pmod(xxhash64(node), shards) as int)"))))
        found = scratch.table(query_graphs(graphs, least))
        audits = cut_lineage(found.filter("node < 0").select("true_links", "found_links", "beam"))
        pairs = found.filter("node >= 0 and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        groups = components(pairs, scratch).select("node", F.col("label").alias("group"))
        sums = found.filter("node >= 0").groupBy("node").agg(F.sum("n").alias("links"))
        named = scratch.table(classes.join(groups, "node", "left").join(sums, "node", "left").withColumn("group", F.coalesce("group", "node")))
        smallest = named.groupBy("group").agg(F.min("id").alias("component_id"))
        n_links = F.coalesce("links", F.lit(0)) + F.col("n") - 1
        known = cut_lineage(named.join(smallest, "group").select(F.col("label.label").alias("label"), "vec", n_links.alias("n_links"), "component_id"))
    finally:
        scratch.clear()
    met = usual.join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not links").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), audits


@query("op12_near_copies")
def op12_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))[0]
