"""Deduplication, source fallback, enrichment and unions without ordered group windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], last: bool = False) -> DataFrame:
    """First (or last) row per key in a total order.

    A min/max by struct combines on the map side, so a key with a third of all rows costs one
    row per task in the shuffle.
    """
    pick = F.max_by if last else F.min_by
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = [(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names)]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(*keyed, row.alias("_row"), rank.alias("_rank")).groupBy(*names).agg(
        pick("_row", "_rank").alias("_row")).select("_row.*")


def union_aligned(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_source(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Whole-source fallback: per key only rows of the first source that has any."""
    tagged = union_aligned(*[f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)])
    best = tagged.groupBy(*keys).agg(F.min("_src").alias("_src"))
    return tagged.join(best, [*keys, "_src"], "left_semi").drop("_src")


def fill_from(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A later source fills only nulls. ``secondary`` is unique per key."""
    s = secondary.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    j = primary.join(s, list(keys), "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in cols else F.col(c) for c in primary.columns])


def first_existing(df: DataFrame, *names: str) -> Column:
    """The first of several column names the frame has, even where it is null."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(None).cast("double")


def replace_rows(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace base rows with the same key."""
    return base.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """Top n per group; Spark limits each group inside every task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n)
    return out.withColumnRenamed("_rk", rank) if rank else out.drop("_rk")
