"""Vector codes: parts of integer vectors named by their nearest codebook entry, found along a trie of distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table, usable, with_group_total
from tickloom.llm.registry import query
from tickloom.session import cut_lineage

SCALE = 256
#: Scaled components beyond this are held at it, so that squared distances of a part fit 64 bits.
LIMIT = 1 << 28
#: Subtrees of at most this many distinct parts are walked as arrays; above, node by node.
SUBTREE = 4096


def part_edges(size: int, parts: int) -> list[int]:
    """Borders of ``parts`` consecutive parts, equal where ``size`` allows."""
    return [size * i // parts for i in range(parts + 1)]


def distinct_parts(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, their counts, and the place of every row among them."""
    order = np.lexsort(part.T[::-1])
    rows = part[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
    place = np.empty(len(part), np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return rows[starts], np.diff(np.concatenate([starts, [len(part)]])), place


def nearest_entries(leaves: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry with the least squared distance, the lower index on ties, and that distance, for sorted distinct parts.

    The parts are the leaves of a trie with one level per component. The walk is depth first: a node
    holds the vector of distances to all entries over the components of its prefix, and every child
    adds the square of one component to it, so parts with a common prefix share its sums. A subtree
    of up to SUBTREE leaves is finished level by level as one array, which bounds memory by
    SUBTREE x entries and the depth.
    """
    n, width = leaves.shape
    code, best = np.empty(n, np.int64), np.empty(n, np.int64)
    if not n:
        return code, best
    # changes[j, i]: leaf i begins a new prefix of j + 1 components
    changes = np.ones((width, n), bool)
    changes[:, 1:] = np.logical_or.accumulate((leaves[1:] != leaves[:-1]).T, 0)
    stack = [(0, n, 0, np.zeros(len(entries), np.int64))]
    while stack:
        lo, hi, depth, held = stack.pop()
        if hi - lo > SUBTREE and depth < width:
            starts = lo + np.flatnonzero(changes[depth, lo:hi])
            starts[0] = lo
            ends = np.append(starts[1:], hi)
            for a, b in zip(starts[::-1].tolist(), ends[::-1].tolist()):
                stack.append((a, b, depth + 1, held + (leaves[a, depth] - entries[:, depth]) ** 2))
            continue
        sums, group = held[None], np.zeros(hi - lo, np.int64)
        for j in range(depth, width):
            new = changes[j, lo:hi].copy()
            new[0] = True
            starts = np.flatnonzero(new)
            sums = sums[group[starts]] + (leaves[lo + starts, j][:, None] - entries[:, j]) ** 2
            group = np.cumsum(new) - 1
        code[lo:hi] = sums.argmin(1)[group]
        best[lo:hi] = sums.min(1)[group]
    return code, best


def integer_rows(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one batch as floor(SCALE * x), one row each."""
    flat = np.asarray(column.flatten(), np.float64).reshape(-1, size)
    return np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64)


def first_entries(rows: DataFrame, n_entries: int) -> np.ndarray:
    """Integer vectors of the smallest ids; all of the length that the first of them has. At most ``n_entries`` rows reach the driver."""
    order = [F.col("id").asc_nulls_last(), "vec", F.col("label").asc_nulls_last()]
    taken = rows.orderBy(*order).limit(n_entries).collect()
    if len({len(r["vec"]) for r in taken}) > 1:
        taken = rows.filter(F.size("vec") == len(taken[0]["vec"])).orderBy(*order).limit(n_entries).collect()
    if not taken:
        return np.zeros((0, 0), np.int64)
    return np.clip(np.floor(np.array([r["vec"] for r in taken], np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def moved_entries(vectors: DataFrame, entries: np.ndarray, edges: list[int]) -> np.ndarray:
    """One round: every part to its nearest entry, every used entry to the floored mean of its parts.

    A task walks the trie of each batch and adds up counts and sums per entry, weighted by how often
    a distinct part occurs; parts x entries x components sums leave it, and as many reach the driver.
    """
    size, n_entries = entries.shape[1], len(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((n_entries, size), np.int64), np.zeros((n_entries, len(edges) - 1), np.int64)
        for b in batches:
            ints = integer_rows(b.column(0), size)
            for p, (lo, hi) in enumerate(zip(edges, edges[1:])):
                leaves, weight, _ = distinct_parts(ints[:, lo:hi]) if len(ints) else (ints[:, lo:hi], np.zeros(0, np.int64), None)
                code, _ = nearest_entries(leaves, entries[:, lo:hi])
                np.add.at(counts[:, p], code, weight)
                np.add.at(sums[:, lo:hi], code, leaves * weight[:, None])
        part = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        entry, at = np.nonzero(counts[:, part] > 0)
        yield pa.record_batch([pa.array(entry, pa.int32()), pa.array(at, pa.int32()), pa.array(sums[entry, at]), pa.array(counts[entry, part[at]])], names=["entry", "at", "total", "n"])

    partial = vectors.mapInArrow(run, "entry int, at int, total long, n long")
    out = entries.copy()
    for r in partial.groupBy("entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["entry"], r["at"]] = r["total"] // r["n"]
    return out


def codebook_digest(entries: np.ndarray, edges: list[int]) -> str:
    """Checksum of all entries by part, entry and component, as decimal numbers with commas between."""
    numbers = (str(x) for lo, hi in zip(edges, edges[1:]) for row in entries[:, lo:hi].tolist() for x in row)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, n_entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vec_col: str = "embedding",
             label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Code and error of every vector, and the codebooks (entries x components).

    Components become floor(256 x); a vector is cut into ``parts`` consecutive parts. The codebook of a
    part begins as that part of the ``n_entries`` vectors with the smallest ids (null ids last, equal
    ids by vector, then label) and moves ``rounds`` times to the floored means of the parts nearest to
    its entries; unused entries stay. Each round reads the vectors once and shuffles sums only.

    Returns rows of vec_id, code (two hex digits per part), error (squared distances summed over the
    parts) and label. Dropped are vectors that are null, hold null, NaN or infinite components, have
    fewer components than parts, or another length than the kept vector that comes first. Components
    beyond +-2^20 are held there. Repeated rows and ids give repeated rows; ties go to the
    lower entry. Fewer vectors than ``n_entries``: fewer entries. Empty table: no rows, no entries.
    Other columns are not read.
    """
    if not 0 < n_entries <= 256:
        raise ValueError("a code has two hex digits per part: 1 to 256 entries")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    rows = rows.filter(usable("vec") & (F.size("vec") >= parts))
    entries = first_entries(rows, n_entries)
    size = entries.shape[1]
    edges = part_edges(size, parts)
    rows = rows.filter(F.size("vec") == size)
    for _ in range(rounds if size else 0):
        entries = moved_entries(rows.select("vec"), entries, edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ints = integer_rows(b.column(1), size)
            codes, error = np.empty((len(ints), parts), np.uint8), np.zeros(len(ints), np.int64)
            for p, (lo, hi) in enumerate(zip(edges, edges[1:])):
                leaves, _, place = distinct_parts(ints[:, lo:hi])
                code, best = nearest_entries(leaves, entries[:, lo:hi])
                codes[:, p] = code[place]
                error += best[place]
            digits = codes.tobytes().hex()
            text = [digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.record_batch([b.column(0), pa.array(text, pa.string()), pa.array(error), b.column(2)], names=["vec_id", "code", "error", "label"])

    kinds = dict(rows.dtypes)
    coded = rows.select("id", "vec", "label").mapInArrow(run, f"vec_id {kinds['id']}, code string, error long, label {kinds['label']}")
    return coded, entries


def _sql(parts: int, n_entries: int, rounds: int) -> str:
    """The codes in SQL: components as rows, every part against every entry of its codebook."""
    steps = [
        "kept AS (SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"""x AS (SELECT vec_id, j, (j * {parts}) // n AS part, CAST(floor({SCALE} * CAST(embedding[j + 1] AS DOUBLE)) AS BIGINT) AS v
            FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(len(embedding))) AS j FROM kept))""",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {n_entries})",
        "c0 AS (SELECT part, entry, j, v FROM x JOIN first USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, part, min(d * 256 + entry) AS m FROM (
            SELECT vec_id, x.part, entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c USING (j) GROUP BY vec_id, x.part, entry) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (SELECT c.part, c.entry, c.j, COALESCE(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
                SELECT a.m % 256 AS entry, x.j, CAST(floor(sum(x.v)::DOUBLE / count(*)) AS BIGINT) AS v FROM x JOIN a{r} a USING (vec_id, part) GROUP BY 1, 2) m
                ON m.entry = c.entry AND m.j = c.j)""")
    return "WITH " + ",\n".join(steps) + f""",
        coded AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), book"""


@query("op11_vector_codes", _sql(16, 64, 2))
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, entries = compress(table(spark, sf_dir, "embeddings"))
    rows = with_group_total(cut_lineage(coded), "label", "error", "label_error")
    digest = codebook_digest(entries, part_edges(entries.shape[1], 16))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
