"""Exact Jaccard join of documents on word n-grams with set-relation skipping."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, Scratch, merged_arrays, shuffle_width, table
from tickloom.llm.components import components
from tickloom.llm.registry import query
from tickloom.session import cut_lineage

COUNTER_BITS, FILTER_BITS, SLICES = 20, 26, 64
N_MINS, HOT = 4, 50_000
TURNS, TRIES, PARTS = 1, 6, 4
PIECE, BLANK = 1 << 18, re.compile(rb"[ \t-\r]")
IS_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
#: Odd multipliers that make independent orders of the hashes.
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

PASS_ONE = "kind int, doc_id long, text_hash long, node long, n long, mins array<long>, slice int, data binary"
ONE_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("mins", pa.list_(pa.int64())), ("slice", pa.int32()), ("data", pa.binary())])
POSTING = np.dtype([("hash", "<i8"), ("node", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(PIECE * 2, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every word of a piece of lower-cased text; it depends on the bytes of the word alone.

    Words of up to ``PIECE`` bytes come from running sums, longer ones from xxh3. In a piece of over twice
    that only the last word reaches beyond ``PIECE``, so sums over the front are enough.
    """
    b = np.frombuffer(data, np.uint8)
    blank = np.ones(len(b) + 2, bool)
    np.take(IS_BLANK, b, out=blank[1:-1])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edges[::2], edges[1::2]
    up, down = _powers()
    front = b[: 2 * PIECE]
    sums = np.zeros(len(front) + 1, np.uint64)
    np.cumsum(front * up[: len(front)], out=sums[1:])
    short = last - first <= PIECE
    out = np.zeros(len(first), np.uint64)
    at, to = first[short], last[short]
    out[short] = _mix((sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64))
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[first[i]:last[i]])
    return out


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text.

    A-Z are lower-cased, words are parted by ASCII white space. Fewer words make one shingle; none make
    an empty set. Long texts are hashed in pieces that end between words.
    """
    data = (text or "").encode("utf-8", "replace").lower()
    hashes, at = [], 0
    while at < len(data):
        end = at + PIECE
        gap = BLANK.search(data, end) if end < len(data) else None
        end = gap.start() if gap else len(data)
        hashes.append(_word_hashes(data[at:end]))
        at = end
    word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    if not len(word):
        return word
    n = max(len(word) - words + 1, 1)
    out = np.full(n, min(words, len(word)), np.uint64)
    for k in range(min(words, len(word))):
        out = (out ^ word[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out = _mix(out)
    out.sort()
    fresh = np.ones(n, bool)
    np.not_equal(out[1:], out[:-1], out=fresh[1:])
    return out[fresh]


def node_of(shingle_set: np.ndarray) -> int:
    """64-bit name of a set; equal sets share it."""
    return int(np.array([xxhash.xxh3_64_intdigest(shingle_set.tobytes())], np.uint64).view(np.int64)[0])


def least_overlap(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection with percent * union <= 100 * intersection."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """Bit per hash of the nodes, of fixed size: a filter that never misses a node; false hits only cost bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            np.bitwise_or.at(packed, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        packed = packed.reshape(SLICES, -1)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array([packed[k].tobytes() for k in some], pa.binary())], names=["slice", "data"])

    rows = nodes.coalesce(shuffle_width(nodes.sparkSession)).mapInArrow(run, "slice int, data binary")
    full = np.zeros((SLICES, (1 << FILTER_BITS) // 8 // SLICES), np.uint8)
    for k, part in merged_arrays(rows, np.bitwise_or, np.uint8, SLICES).items():
        full[k] = part
    return full.reshape(-1)


def _describe(words: int):
    """Per document its node, size and least hashes in several orders; at the end the task's shingle counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, any_row = np.zeros(1 << COUNTER_BITS, np.int32), False
        for b in batches:
            out, pending = [], []
            for text in b.column(2):
                s = shingles(text.as_py(), words)
                mins = [(s * m).min() for m in MIXERS] if len(s) else [np.uint64(0)] * N_MINS
                out.append((node_of(s), len(s), np.array(mins, np.uint64).view(np.int64)))
                pending.append(s)
                if len(pending) >= 500:
                    counters += np.bincount(np.concatenate(pending) >> np.uint64(64 - COUNTER_BITS), minlength=1 << COUNTER_BITS).astype(np.int32)
                    pending = []
            if pending:
                counters += np.bincount(np.concatenate(pending) >> np.uint64(64 - COUNTER_BITS), minlength=1 << COUNTER_BITS).astype(np.int32)
            if out:
                any_row, k = True, len(out)
                node, n, mins = zip(*out)
                yield pa.record_batch([pa.array([0] * k, pa.int32()), b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()),
                                       pa.array([m.tolist() for m in mins], pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=ONE_SCHEMA)
        if any_row:
            for k, part in enumerate(counters.reshape(SLICES, -1)):
                yield pa.record_batch([[1], [None], [None], [None], [None], [None], [k], [part.astype(np.int64).tobytes()]], schema=ONE_SCHEMA)

    return run


def _sets(docs: DataFrame, nodes: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(node, shingles) of the wanted nodes, made anew from the texts that pass the node filter; equal sets once per task."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter_of(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sent = bits.value, set()
        for b in batches:
            for text in b.column(0):
                s = shingles(text.as_py(), words)
                node = node_of(s)
                at = (node % (1 << 64)) >> (64 - FILTER_BITS)
                if len(s) and node not in sent and known[at >> 3] >> (at & 7) & 1:
                    sent.add(node)
                    yield pa.record_batch([pa.array([node], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["node", "shingles"])

    made = docs.select("text").mapInArrow(run, "node long, shingles binary")
    return scratch.table(made.join(nodes.distinct(), "node", "left_semi").dropDuplicates(["node"]))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))


def _overlaps(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of node pairs (a, b), from the whole sets (node, shingles)."""

    @F.pandas_udf("n_a long, n_b long, overlap long")
    def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                out.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            yield pd.DataFrame(out, columns=["n_a", "n_b", "overlap"])

    rows = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return scratch.table(rows.select("a", "b", compare("x", "y").alias("c")).select("a", "b", "c.*"))


def _linked(percent: int):
    return F.expr(f"100 * overlap >= {percent} * (n_a + n_b - overlap)")


def _postings(docs: DataFrame, counters: np.ndarray, total: int, words: int, percent: int) -> DataFrame:
    """(hash, node, n, pos): prefix entries of all lists that hold two or more different sets.

    Shingles are ordered by how often their counter was hit and then by hash, one order for all sets, so
    that common passages come last; two sets that link share one of the first n - ceil(n * percent / 100)
    + 1. Entries travel packed by hash bucket; a bucket is a bounded share of all entries. Lists of very
    frequent shingles, which only sets made of them still reach, are not gathered: they pass through as
    they are, dealt by node.
    """
    spark = docs.sparkSession
    buckets = max(shuffle_width(spark), total * (100 - percent) // 100 // 1_000_000 + 1)
    weights = spark.sparkContext.broadcast(counters)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            hot = weights.value[rows["hash"].view(np.uint64) >> np.uint64(64 - COUNTER_BITS)] >= HOT + 4 * total // len(weights.value)
            place = np.where(hot, rows["node"], rows["hash"]).view(np.uint64) % np.uint64(buckets)
            order = np.lexsort((place, hot))
            rows, place, hot = rows[order], place[order].astype(np.int64), hot[order]
            cuts = np.flatnonzero(np.diff(place) | (np.diff(hot.astype(np.int8)) != 0)) + 1
            parts = np.split(rows, cuts)
            first = np.concatenate([[0], cuts])
            yield pa.record_batch([pa.array(place[first], pa.int64()), pa.array(hot[first], pa.bool_()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["bucket", "hot", "data"])

        for b in batches:
            for text in b.column(0):
                s = shingles(text.as_py(), words)
                node = node_of(s)
                if not len(s) or node in sent:
                    continue
                sent.add(node)
                take = len(s) - (percent * len(s) + 99) // 100 + 1
                first = np.lexsort((s, weights.value[s >> np.uint64(64 - COUNTER_BITS)]))[:take]
                rows = np.empty(take, POSTING)
                rows["hash"], rows["node"], rows["n"], rows["pos"] = s[first].view(np.int64), node, len(s), np.arange(take)
                held.append(rows)
                size += take
                if size > 250_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 100_000):
                x = rows[i:i + 100_000]
                yield pa.record_batch([pa.array(x["hash"]), pa.array(x["node"]), pa.array(x["n"].astype(np.int64)), pa.array(x["pos"].astype(np.int64))], names=["hash", "node", "n", "pos"])

        held = []
        for b in batches:
            for hot, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if hot:
                    yield from out(np.frombuffer(data, POSTING))
                else:
                    held.append(np.frombuffer(data, POSTING))
        if held:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["node"], rows["hash"]))]
            fresh = np.concatenate([[True], (rows["hash"][1:] != rows["hash"][:-1]) | (rows["node"][1:] != rows["node"][:-1])])
            rows = rows[fresh]
            same = rows["hash"][1:] == rows["hash"][:-1]
            yield from out(rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])])

    packed = docs.select("text").mapInArrow(emit, "bucket long, hot boolean, data binary").repartition(buckets, "bucket")
    return packed.mapInArrow(shared, "hash long, node long, n long, pos long")


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected groups of documents whose n-gram sets have a Jaccard likeness of ``percent`` or more.

    1. Equal sets become one node. 2. Sets that share a least hash are compared with one leader each, at
    most one comparison per set; a set that links with its leader joins the leader's cluster and keeps
    its overlap. 3. Each set tries a few neighbours from its prefix lists. Then prefix lists are cut in blocks per cluster with sizes and positions; blocks of two
    clusters in different components meet only if their size range and the places left behind the
    shared position allow a link, otherwise the block is skipped whole. 4. Leaders of such clusters are
    compared. If they link, all is said. If not, the answers for their members follow from the leaders'
    overlap: it plus what either member has beyond its leader bounds theirs, and only pairs that the
    bound lets through are compared. No link between different sets is lost, and no group is paired out.

    Returns doc_id, text_hash, n_shingles, set_id (equal sets share it), group_id (linked sets share it) and
    component_id, the smallest document id that links reach. Null, empty and wordless texts: no shingles,
    set_id and group_id null, component_id the own id.
    Null ids: their links count, they name no component unless nothing else does (then null). Repeated
    rows are equal sets. Empty table: no rows. Other columns are not read. Hashes have 64 bits.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scratch = Scratch(spark, "jaccard-join")
    seen = scratch.table(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_describe(words), PASS_ONE))
    described = seen.filter("kind = 0").select("doc_id", "text_hash", F.when(F.col("n") > 0, F.col("node")).alias("node"), "n", "mins")
    nodes = scratch.table(described.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").alias("least"), F.first("mins").alias("mins")))
    result = scratch.table(described.select("doc_id", "text_hash", "node", "n"))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts = merged_arrays(seen.filter("kind = 1"), np.add, np.int64, SLICES) if total else {}
    counters = np.concatenate([parts[k] for k in range(SLICES)]) if parts else np.zeros(0, np.int64)

    placed = _groups(docs, nodes, counters, total, words, percent, scratch).select("node", F.col("component").alias("label"))
    named = scratch.table(nodes.select("node", "least").join(placed, "node"))
    groups = named.join(named.groupBy("label").agg(F.min("least").alias("component")), "label").select("node", "label", "component")
    out = result.join(groups, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = cut_lineage(out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("node").alias("set_id"), F.col("label").alias("group_id"), own.alias("component_id")))
    scratch.clear()
    return out


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the document with the smallest id stays, once.

    Null ids come after all others. Documents without words are in no group and all stay. All columns
    are returned.
    """
    found = jaccard_join(docs, **options).filter("group_id IS NOT NULL")
    first = found.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("k"))
    first = first.select(F.col("k.doc_id").alias("_keep_id"), F.col("k.text_hash").alias("_keep_hash"))
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    has_word = F.coalesce(F.regexp_like(F.col(text_col), F.lit(WORD)), F.lit(False))
    mark = "_hash_of_text"
    rows = docs.filter(has_word).withColumn(mark, F.xxhash64(text_col))
    rows = rows.join(first, rows[id_col].eqNullSafe(F.col("_keep_id")) & (rows[mark] == F.col("_keep_hash")), "left_semi")
    return rows.dropDuplicates([id_col, mark]).drop(mark).unionByName(docs.filter(~has_word))


def _joined(placed: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``placed`` with the components of linked nodes made one; only component pairs are walked."""
    at = placed.select(F.col("node").alias("_n"), "component")
    ends = links.select("a", "b").join(at.withColumnsRenamed({"component": "u"}), F.col("a") == F.col("_n")).drop("_n")
    ends = ends.join(at.withColumnsRenamed({"component": "v"}), F.col("b") == F.col("_n")).select(F.col("u").alias("a"), F.col("v").alias("b"))
    known = components(ends, scratch).select(F.col("node").alias("component"), "label")
    return scratch.table(placed.join(known, "component", "left").withColumn("component", F.coalesce("label", "component")).drop("label"))


def _groups(docs: DataFrame, nodes: DataFrame, counters: np.ndarray, total: int, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component): nodes that links connect share a component."""
    placed = nodes.select("node", "n", F.col("node").alias("cluster"), F.lit(0).cast("long").alias("beyond"), F.col("node").alias("component"))
    if not total:
        return placed
    # leaders: for each of the least hashes the smallest node; the leader most of them name is tried
    keys = nodes.select("node", "n", F.posexplode("mins").alias("k", "least_hash"))
    leaders = keys.groupBy("k", "least_hash").agg(F.min("node").alias("leader"), F.max("node").alias("other")).filter("leader <> other").drop("other")
    named = keys.join(leaders, ["k", "least_hash"]).filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("votes")).filter("votes >= 2")
    tried = named.groupBy("node").agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader"))
    tried = scratch.table(tried.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    if not tried.isEmpty():
        stars = scratch.table(_overlaps(tried, _sets(docs, _ends(tried), words, scratch), scratch).filter(_linked(percent)))
        placed = nodes.select("node", "n", F.col("node").alias("component")).join(stars.select(F.col("a").alias("node"), F.col("b").alias("leader"), "overlap"), "node", "left")
        placed = placed.select("node", "n", F.coalesce("leader", "node").alias("cluster"), (F.col("n") - F.coalesce("overlap", "n")).alias("beyond"), "component")
        placed = _joined(scratch.table(placed), stars, scratch)

    lists = _postings(docs, counters, total, words, percent).join(placed.select("node", "cluster", "component"), "node")
    mixed = lambda df: df.join(df.groupBy("hash").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("hash"), "hash", "left_semi")
    lists = scratch.table(mixed(lists))
    if lists.isEmpty():
        return placed
    sets = _sets(docs, lists.select("node").unionAll(lists.select(F.col("cluster").alias("node"))).distinct(), words, scratch)

    # a wide family of near copies soon is one component when each of its sets tries a few others: what is
    # in one component by then needs no comparison any more
    need = F.expr(f"{percent} * (n + m)")
    for turn in range(TURNS):
        near = Window.partitionBy("hash", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PARTS))).orderBy(F.xxhash64("node", F.lit(turn)), "node")
        ahead = F.array(*[F.struct(*[F.lead(c, k).over(near).alias(a) for c, a in (("node", "other"), ("n", "m"), ("pos", "there"), ("component", "theirs"))]) for k in range(1, TRIES + 1)])
        step = lists.select("node", "n", "pos", "component", ahead.alias("ahead")).select("node", "n", "pos", "component", F.explode("ahead").alias("x")).select("node", "n", "pos", "component", "x.*")
        step = step.filter((F.col("component") != F.col("theirs")) & (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("there")) * (100 + percent) >= need))
        step = step.groupBy("node", "other").agg(F.count("*").alias("shared")).groupBy("node").agg(F.collect_list(F.struct("shared", "other")).alias("x"))
        step = step.select(F.col("node").alias("a"), F.explode(F.slice(F.sort_array("x", asc=False), 1, TRIES)).alias("x")).select("a", F.col("x.other").alias("b"))
        links = scratch.table(_overlaps(step, sets, scratch).filter(_linked(percent)).select("a", "b"))
        if not links.isEmpty():
            placed = _joined(placed, links, scratch)
            lists = scratch.table(mixed(lists.drop("component").join(placed.select("node", "component"), "node")))

    blocks = lists.groupBy("hash", "cluster").agg(F.max("component").alias("component"), F.min("n").alias("small"), F.max("n").alias("large"), F.max(F.col("n") - F.col("pos")).alias("left"),
                                              F.max(F.col("node") != F.col("cluster")).alias("others"))
    x, y = (blocks.select("hash", *[F.col(c).alias(f"{s}_{c}") for c in ("cluster", "component", "small", "large", "left", "others")]) for s in "xy")
    fits = F.expr(f"x_component < y_component AND 100 * x_large >= {percent} * y_small AND 100 * y_large >= {percent} * x_small"
                  f" AND least(x_left, y_left) * {100 + percent} >= {percent} * (x_small + y_small)")
    met = x.join(y, "hash").filter(fits).groupBy("x_cluster", "y_cluster").agg(F.max(F.col("x_others") | F.col("y_others")).alias("others"))
    met = scratch.table(met.select(F.col("x_cluster").alias("a"), F.col("y_cluster").alias("b"), "others"))
    if met.isEmpty():
        return placed
    told = _overlaps(met, sets, scratch)
    placed = _joined(placed, told.filter(_linked(percent)), scratch)
    # members can link where leaders do not: the leaders' overlap bounds theirs
    score = F.col("beyond") * (100 + percent) - F.col("n") * percent
    known = placed.select("node", "n", "cluster", score.alias("score"), F.col("component").alias("now"))
    clusters = known.groupBy("cluster").agg(F.max("score").alias("most"), F.max("now").alias("now"))
    ca, cb = (clusters.select(F.col("cluster").alias(c), F.col("most").alias(f"{c}_most"), F.col("now").alias(f"{c}_now")) for c in "ab")
    rest = told.filter(~_linked(percent)).join(met, ["a", "b"]).filter("others").select("a", "b", (F.col("overlap") * (100 + percent)).alias("shared"))
    rest = scratch.table(rest.join(ca, "a").join(cb, "b").filter("a_now <> b_now AND shared + a_most + b_most >= 0"))
    if not rest.isEmpty():
        p, q = (known.select(*[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "cluster", "score")]) for s in "pq")
        pairs = rest.join(p, (F.col("a") == F.col("p_cluster")) & (F.col("shared") + F.col("p_score") + F.col("b_most") >= 0))
        could = F.expr(f"shared + p_score + q_score >= 0 AND 100 * p_n >= {percent} * q_n AND 100 * q_n >= {percent} * p_n")
        pairs = pairs.join(q, (F.col("b") == F.col("q_cluster")) & could)
        pairs = scratch.table(pairs.select(F.col("p_node").alias("a"), F.col("q_node").alias("b")).filter("a <> b").distinct())
        if not pairs.isEmpty():
            placed = _joined(placed, _overlaps(pairs, _sets(docs, _ends(pairs), words, scratch), scratch).filter(_linked(percent)), scratch)
    return placed


@query("op10_ngram_jaccard_groups")
def op10_ngram_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
