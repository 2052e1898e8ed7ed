"""Point-in-time joins in linear time: tag, union, sort, carry. No range or cartesian join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _day(c: str) -> Column:
    return F.unix_date(F.to_date(F.col(c)))


def _sides(left: DataFrame, right: DataFrame, keys, on, right_on, cols):
    l = left.select("*", F.lit(1).alias("_side"))
    payload = F.struct(F.col(right_on).alias("_at"), *[F.col(c).alias(c) for c in cols])
    r = right.where(F.col(right_on).isNotNull()).select(
        *[F.col(k) for k in keys], F.col(right_on).cast(left.schema[on].dataType).alias(on),
        F.lit(0).alias("_side"), payload.alias("_hit"))
    return l, r


def _carry(l: DataFrame, r: DataFrame, keys, on, forward: bool, bucket_days: int | None) -> DataFrame:
    """Union of both sides with ``_hit`` carried onto left rows.

    With ``bucket_days`` a series is cut into time buckets; the value entering a bucket comes
    from a per-bucket summary, so no task holds a whole series.
    """
    both = l.unionByName(r, allowMissingColumns=True)
    by = list(keys)
    pick = F.min_by if forward else F.max_by
    if bucket_days:
        both = both.withColumn("_b", F.floor(_day(on) / bucket_days))
        edge = both.groupBy(*keys, "_b").agg(pick("_hit", F.when(F.col("_hit").isNotNull(), F.col(on))).alias("_hit"))
        order = F.col("_b").desc() if forward else F.col("_b")
        prior = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        seeds = edge.select(*keys, "_b", F.lit(-1).alias("_side"),
                            F.last("_hit", ignorenulls=True).over(prior).alias("_hit"))
        seeds = seeds.where(F.col("_hit").isNotNull())
        both = both.unionByName(seeds, allowMissingColumns=True)
        by.append("_b")
    when = F.col(on).desc() if forward else F.col(on)
    first = F.when(F.col("_side") < 0, 0).otherwise(1)
    w = Window.partitionBy(*by).orderBy(first, when, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).where(F.col("_side") == 1)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, right_on: str,
              cols: Sequence[str], direction: str = "backward", matched: str | None = None,
              bucket_days: int | None = None) -> DataFrame:
    """Each left row gets ``cols`` of the closest right row at or before (or after) ``on``.

    ``right`` has one row per key and time. ``matched`` names a column for the time found.
    """
    l, r = _sides(left, right, keys, on, right_on, cols)
    out = _carry(l, r, keys, on, direction == "forward", bucket_days)
    extra = [F.col("_hit")["_at"].alias(matched)] if matched else []
    return out.select(*left.columns, *[F.col("_hit")[c].alias(c) for c in cols], *extra)


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, right_on: str,
                 cols: Sequence[str], tolerance_days: int, bucket_days: int = 64) -> DataFrame:
    """Closest right row on either side within a tolerance; equal gaps take the earlier row.

    Right rows are copied to the one or two time buckets they can reach, so both look-ups run
    inside (keys, bucket).
    """
    bucket_days = max(bucket_days, tolerance_days)
    l, r = _sides(left, right, keys, on, right_on, cols)
    l = l.withColumn("_b", F.floor(_day(on) / bucket_days))
    r = r.withColumn("_b", F.explode(F.array_distinct(F.array(
        F.floor((_day(on) - tolerance_days) / bucket_days),
        F.floor((_day(on) + tolerance_days) / bucket_days)))))
    both = l.unionByName(r, allowMissingColumns=True)
    by = [*keys, "_b"]
    back = Window.partitionBy(*by).orderBy(F.col(on), "_side").rowsBetween(Window.unboundedPreceding, 0)
    fwd = Window.partitionBy(*by).orderBy(F.col(on).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({
        "_bk": F.last("_hit", ignorenulls=True).over(back),
        "_fw": F.last("_hit", ignorenulls=True).over(fwd),
    }).where(F.col("_side") == 1)
    gap_b = F.datediff(F.col(on), F.col("_bk")["_at"])
    gap_f = F.datediff(F.col("_fw")["_at"], F.col(on))
    big = F.lit(1 << 30)
    hit = F.when(F.coalesce(gap_b, big) <= F.coalesce(gap_f, big), F.col("_bk")).otherwise(F.col("_fw"))
    near = F.when(F.least(F.coalesce(gap_b, big), F.coalesce(gap_f, big)) <= tolerance_days, hit)
    return both.withColumn("_near", near).select(
        *left.columns, *[F.col("_near")[c].alias(c) for c in cols])


def align_to_spine(spine: DataFrame, values: DataFrame, keys: Sequence[str], on: str,
                   cols: Sequence[str], limit: int = 5) -> DataFrame:
    """Reindex values to the spine; a value is carried over at most ``limit`` union rows."""
    s = spine.select("*", F.lit(1).alias("_spine"))
    joined = s.join(values.select(*keys, on, *cols), [*keys, on], "full")
    w = Window.partitionBy(*keys).orderBy(on).rowsBetween(-limit, 0)
    filled = joined.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    return filled.where(F.col("_spine") == 1).select(*spine.columns, *cols)


def event_distance(spine: DataFrame, events: DataFrame, keys: Sequence[str], on: str,
                   event_on: str, none: int = 9999) -> DataFrame:
    """Days to the next event (0 on the day), days since the last, and a within-5-days flag."""
    days = events.select(*keys, F.col(event_on).alias("_ev")).where("_ev is not null").distinct()
    a = asof_join(spine, days, keys, on, "_ev", [], "forward", matched="_next")
    b = asof_join(a, days, keys, on, "_ev", [], "backward", matched="_last")
    to_next = F.coalesce(F.datediff("_next", on), F.lit(none))
    since = F.coalesce(F.datediff(on, "_last"), F.lit(none))
    return b.select(*spine.columns, to_next.alias("earn_days_to_next"),
                    since.alias("earn_days_since_last"),
                    F.when((to_next <= 5) | (since <= 5), 1).otherwise(0).alias("earn_is_week"))
