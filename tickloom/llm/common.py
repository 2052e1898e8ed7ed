"""Small helpers shared by the text operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.session import cut_lineage, shared_dir

#: A word is a run of anything but space and the five ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most this many groups is broadcast.
FEW_GROUPS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _cuts_below(value: Column, cuts: list[int]) -> Column:
    """Number of cuts below the value, looked up in two steps of about sqrt(n) comparisons."""
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    if not groups:
        return F.lit(0)
    long = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    head = F.size(F.filter(long([g[0] for g in groups[1:]]), lambda c: c < value)) if len(groups) > 1 else F.lit(0)
    inner = F.element_at(F.array(*[long(g) for g in groups]), (head + 1).cast("int"))
    return head * step + F.size(F.filter(inner, lambda c: c < value))


def id_ranges(df: DataFrame, id_col: str, n: int) -> Callable[[Column], Column]:
    """Function from an id to the number of its range, 0 to n - 1, of ascending ids.

    Cuts come from approximate quantiles (n - 1 numbers on the driver); they balance the work and have
    no part in any result.
    """
    cuts = df.select(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("c")).first()["c"] or []
    return lambda value: _cuts_below(value, sorted(set(cuts)))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a table of this run by the file system that holds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one run in the shared folder: written once, read with their true size, removed together.

    Unlike checkpoints, whose size estimate is carried on from join to join, files tell the planner
    what they hold, so small tables are broadcast and chains of joins stay cheap to plan.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch_path(spark, name), 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove_path(self.spark, self.root)


def merged_arrays(rows: DataFrame, how: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype, slices: int) -> dict[int, np.ndarray]:
    """Rows (slice, data) of equally long arrays put together by ``how``, slice by slice, in a streaming fold.

    The arrays have a fixed length and ``slices`` is fixed, so what a task and the driver hold is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(data, dtype)
                held[k] = how(held[k], x) if k in held else x
        for k, x in held.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["slice", "data"])

    rows = rows.select("slice", "data").repartition(min(slices, shuffle_width(rows.sparkSession)), "slice")
    return {r["slice"]: np.frombuffer(r["data"], dtype) for r in rows.mapInArrow(run, "slice int, data binary").collect()}


def running_totals(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums over the whole table in ``order``, without gathering it anywhere.

    Rows are range-partitioned by ``order`` and written once, so that a lost executor cannot move
    the range borders. Each partition hands up one row of totals (as many rows as partitions); their
    running sum is the offset of the partition, and a window inside it does the rest.
    ``sums``: name of the new column -> column to add up; ``<name>_total`` is its sum over all rows.
    """
    n = shuffle_width(df.sparkSession)
    placed = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{s}") for s, c in sums.items()])
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_all_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
                           *[F.sum(f"_all_{s}").over(every).alias(f"{s}_total") for s in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{s}") for s, c in sums.items()])
    return rows.join(totals, "_part").select(*df.columns, *[(F.col(f"_off_{s}") + F.col(f"_in_{s}")).alias(s) for s in sums], *[f"{s}_total" for s in sums])


def usable(embedding: str | Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    v = F.col(embedding) if isinstance(embedding, str) else embedding
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def with_group_total(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over rows with an equal key, nulls together.

    ``rows`` must be cut from its lineage. Sums merge in every task first; they are broadcast where
    their number has been counted as small, and otherwise joined by a shuffle that splits hot keys.
    """
    sums = cut_lineage(rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(out)))
    small = F.broadcast(sums) if sums.count() <= FEW_GROUPS else sums
    return rows.join(small, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
