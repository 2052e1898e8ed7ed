"""Contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import running_totals, table
from tickloom.llm.registry import query


def shard(docs: DataFrame, n_shards: int, order: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text",
          overhead: int = 8) -> DataFrame:
    """Shard and slot of every document; shards are contiguous in ``order`` and near equal in bytes.

    Size is the UTF-8 length of the text plus ``overhead``. The byte offset of each row comes from
    per-partition totals; the row goes to the shard that holds the middle of its byte range, so a
    shard misses its equal share by half a document at either end at most.

    Returns the order columns, doc_id, size, text_crc32, shard and slot (from 0, without gaps). Null
    text: no bytes, checksum 0. Null order values come first; equal ones are ordered by checksum and
    size, and rows equal in all of these are alike. A document larger than a shard leaves shards
    empty. Empty table: no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)], F.col(id_col).alias("doc_id"),
                       (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(1).alias("_one"))
    by = [f"_by{i}" for i in range(len(order))]
    rows = running_totals(rows, [*by, "text_crc32", "size"], {"_start": "size", "_row": "_one"})
    middle = F.expr(f"((2 * _start + size) * {int(n_shards)}) div (2 * _start_total)")
    rows = rows.withColumn("shard", F.coalesce(middle, F.lit(0)).cast("int"))
    first = rows.groupBy("shard").agg(F.min("_row").alias("_first"))
    rows = rows.join(F.broadcast(first), "shard")  # one row per shard
    return rows.select(*[F.col(b).alias(c) for b, c in zip(by, order) if c != id_col], "doc_id", "size", "text_crc32", "shard",
                       (F.col("_row") - F.col("_first")).cast("long").alias("slot"))


@query("op4_byte_shards")
def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
