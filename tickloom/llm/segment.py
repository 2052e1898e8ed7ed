"""SentencePiece encoding by sampled segmentations without replacement, and decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table
from tickloom.llm.lattice import Lattices, Vocabulary, log_inclusion, top_k, units_of
from tickloom.llm.registry import query
from tickloom.llm.wordtable import by_size, ragged_take

VOCABULARY = "piece_bpe_32k.model"
SAMPLES = pa.schema([("doc_id", pa.int64()), ("text_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("logp", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())])
SAMPLES_DDL = "doc_id long, text_crc32 long, decoded_crc32 long, sample int, ids array<int>, logp double, perturbed double, log_inclusion double"


@lru_cache(maxsize=2)
def _model(path: str, alpha: float) -> tuple[Lattices, np.ndarray, np.ndarray, np.ndarray]:
    vocabulary, data = Vocabulary.load(path, alpha)
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    return Lattices(vocabulary), np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, sizes


def encode_run(texts: list[str], keys: np.ndarray, k: int, path: str, alpha: float) -> tuple[np.ndarray, ...]:
    """Row, sample number, log probability, perturbed value and log inclusion of each sample, and their ids with lengths."""
    lattices = _model(path, alpha)[0]
    found = top_k(lattices, [units_of(t) for t in texts], keys, k)
    rows = [(r, m, s.logp, s.value, log_inclusion(s.logp, rest)) for r, (samples, rest) in enumerate(found) for m, s in enumerate(samples)]
    edges = [s.edges for samples, _ in found for s in samples]
    per_sample = np.fromiter(map(len, edges), np.int64, len(edges))
    ids, per_edge = lattices.ids(np.concatenate(edges) if edges else np.zeros(0, np.int64))
    total = np.concatenate([[0], np.cumsum(per_edge)])
    ends = np.cumsum(per_sample)
    row, sample, logp, value, inclusion = (np.array(x) for x in zip(*rows))
    return row, sample, logp, value, inclusion, ids, total[ends] - total[ends - per_sample]


def encode(docs: DataFrame, k: int = 2, alpha: float = 1.0, seed: int = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k distinct segmentations of every whole text, best perturbed value first.

    Returns doc_id, text_crc32, decoded_crc32 (of what the ids decode to), sample (from 0), ids, logp (log probability of the segmentation given the
    text), perturbed and log_inclusion (log probability of being among the k). Random numbers come from
    (seed, id) and the place in the text, so a row is the same in any partitioning. ``alpha`` sharpens or
    flattens the distribution. Texts with fewer than k segmentations give all of them; null and empty
    texts have the empty one. Equal ids share random numbers, repeated rows give repeated samples.
    Empty table: no rows. Other columns are not read.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids_of, crc, keys = b.column(0), b.column(1), b.column(2).to_numpy().view(np.uint64)
            done = 0
            for texts in by_size(b.column(3).to_pylist(), 1 << 18):
                row, sample, logp, value, inclusion, ids, sizes = encode_run(texts, keys[done:done + len(texts)], k, path, alpha)
                take = pa.array(row + done)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                back = pa.array([zlib.crc32(t.encode()) for t in decode_ids(ids, sizes, path)], pa.int64())
                yield pa.record_batch([ids_of.take(take), crc.take(take), back, pa.array(sample.astype(np.int32)), lists, pa.array(logp), pa.array(value), pa.array(inclusion)], schema=SAMPLES)
                done += len(texts)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"), text.alias("text"))
    return rows.mapInArrow(run, SAMPLES_DDL)


def decode_ids(ids: np.ndarray, sizes: np.ndarray, vocabulary: str) -> list[str]:
    """Texts of id sequences that lie one after the other; bytes that are no UTF-8 become the replacement character."""
    _, flat, start, length = _model(vocabulary, 1.0)
    data = ragged_take(flat, start[ids], length[ids]).tobytes()
    total = np.concatenate([[0], np.cumsum(length[ids])])
    ends = np.cumsum(sizes)
    return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(total[ends - sizes].tolist(), total[ends].tolist())]


def decode(rows: DataFrame, ids_col: str = "ids", vocabulary: str | None = None, out: str = "decoded") -> DataFrame:
    """Add the text of an id array; null ids give an empty text."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        sizes = np.asarray(ids.value_lengths().fill_null(0), np.int64)
        return pa.array(decode_ids(np.asarray(ids.flatten(), np.int64), sizes, path), pa.string())

    return rows.withColumn(out, run(F.col(ids_col)))


@query("op2_sampled_segmentations")
def op2_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents"))
    exact = F.col("decoded_crc32") == F.col("text_crc32")
    return rows.select("doc_id", "sample", "ids", F.size("ids").alias("n_pieces"), "logp", "perturbed", "log_inclusion", exact.alias("round_trip"))
