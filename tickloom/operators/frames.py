"""Ordered-series helpers: gated rolling statistics, exponential means, split series.

A daily bar table holds at most one row per symbol and calendar day, so a symbol's window
partition is bounded by the calendar. Series without that bound (ticks, articles) go through
``number_rows`` and ``with_halo``, which cut one long series into many window partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.numeric import adjusted_kurtosis, adjusted_skew, col, finite, safe_div


@dataclass(frozen=True)
class Series:
    """How rows are grouped into series and ordered inside each."""

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("date",)

    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def back(self, n: int) -> WindowSpec:
        """The current row and the n-1 rows before it."""
        return self.spec().rowsBetween(-(n - 1), 0)

    def rows(self, first: int, last: int) -> WindowSpec:
        return self.spec().rowsBetween(first, last)

    def so_far(self) -> WindowSpec:
        return self.spec().rowsBetween(Window.unboundedPreceding, 0)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def newest_first(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order])

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.spec())

    def lead(self, x, n: int = 1) -> Column:
        return F.lead(col(x), n).over(self.spec())

    # rolling statistics over n rows; null until mp non-null values are in the frame
    def _gate(self, stat: Column, x: Column, n: int, mp: int | None) -> Column:
        need = n if mp is None else mp
        return F.when(F.count(x).over(self.back(n)) >= need, stat)

    def mean(self, x, n: int, mp: int | None = None) -> Column:
        x = col(x)
        return self._gate(F.avg(x).over(self.back(n)), x, n, mp)

    def std(self, x, n: int, mp: int | None = None) -> Column:
        x = col(x)
        return self._gate(finite(F.stddev_samp(x).over(self.back(n))), x, n, mp)

    def var(self, x, n: int, mp: int | None = None) -> Column:
        x = col(x)
        return self._gate(finite(F.var_samp(x).over(self.back(n))), x, n, mp)

    def high(self, x, n: int, mp: int | None = None) -> Column:
        x = col(x)
        return self._gate(F.max(x).over(self.back(n)), x, n, mp)

    def low(self, x, n: int, mp: int | None = None) -> Column:
        x = col(x)
        return self._gate(F.min(x).over(self.back(n)), x, n, mp)

    def total(self, x, n: int, mp: int | None = None) -> Column:
        x = col(x)
        return self._gate(F.sum(x).over(self.back(n)), x, n, mp)

    def skew(self, x, n: int, mp: int | None = None) -> Column:
        x = col(x)
        w = self.back(n)
        return self._gate(adjusted_skew(F.skewness(x).over(w), F.count(x).over(w)), x, n, mp)

    def kurt(self, x, n: int, mp: int | None = None) -> Column:
        x = col(x)
        w = self.back(n)
        return self._gate(adjusted_kurtosis(F.kurtosis(x).over(w), F.count(x).over(w)), x, n, mp)

    def cov(self, x, y, n: int, mp: int | None = None) -> Column:
        x, y = col(x), col(y)
        pair = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
        return self._gate(finite(F.covar_samp(x, y).over(self.back(n))), pair, n, mp)

    def corr(self, x, y, n: int, mp: int | None = None) -> Column:
        x, y = col(x), col(y)
        both, w = x.isNotNull() & y.isNotNull(), self.back(n)
        xs, ys = F.when(both, x), F.when(both, y)
        scale = F.stddev_samp(xs).over(w) * F.stddev_samp(ys).over(w)
        return self._gate(finite(safe_div(F.covar_samp(x, y).over(w), scale)), xs, n, mp)

    def ffill(self, x, limit: int) -> Column:
        """Last non-null value at most ``limit`` rows back."""
        return F.last(col(x), ignorenulls=True).over(self.rows(-limit, 0))

    def bfill(self, x, limit: int) -> Column:
        return F.first(col(x), ignorenulls=True).over(self.rows(0, limit))


@dataclass(frozen=True)
class Ewm:
    """One exponential mean: y = alpha * x + (1 - alpha) * y_prev, seeded by the first value."""

    out: str
    x: str
    alpha: float
    min_rows: int = 1

    @staticmethod
    def span(out: str, x: str, n: int) -> Ewm:
        return Ewm(out, x, 2.0 / (n + 1.0))


def add_ewm(df: DataFrame, specs: Sequence[Ewm], series: Series, block: int = 128) -> DataFrame:
    """Exponential means in linear time, all of them in one pass over the sorted series.

    Inside blocks of ``block`` rows the mean is a running sum of x * beta**-offset scaled back
    by beta**offset. A trailing sum of exactly ``block`` rows follows from the running sum and
    its lag, and the mean is the beta**block-weighted sum of such trailing sums; terms below
    1e-18 are left out. Nulls may only lead a series (a first difference); a later null counts
    as no observation and yields null on its row.
    """
    base = df.withColumn("_pos", F.row_number().over(series.spec()) - 1)
    lead_cols = sorted({s.x for s in specs})
    seen = {x: f"_n_{i}" for i, x in enumerate(lead_cols)}
    base = base.withColumns({seen[x]: F.count(F.col(x)).over(series.so_far()) for x in lead_cols})
    base = base.withColumns({
        "_blk": F.floor(F.col("_pos") / block),
        "_off": (F.col("_pos") % block).cast("double"),
    })
    in_block = (
        Window.partitionBy(*series.keys, "_blk").orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    run, trail, out = {}, {}, {}
    for i, s in enumerate(specs):
        beta = F.lit(1.0 - s.alpha)
        weight = F.when(F.col(seen[s.x]) == 1, F.lit(1.0)).otherwise(F.lit(s.alpha))
        scaled = F.coalesce(weight * F.col(s.x), F.lit(0.0)) * F.pow(beta, -F.col("_off"))
        run[f"_run_{i}"] = F.sum(scaled).over(in_block) * F.pow(beta, F.col("_off"))
    base = base.withColumns(run)
    before = series.rows(Window.unboundedPreceding, -1)
    for i, s in enumerate(specs):
        beta = 1.0 - s.alpha
        close = F.last(F.when(F.col("_off") == block - 1, F.col(f"_run_{i}")),
                       ignorenulls=True).over(before)
        past = F.coalesce(series.lag(f"_run_{i}", block), F.lit(0.0))
        trail[f"_tr_{i}"] = (
            F.col(f"_run_{i}")
            + F.coalesce(close, F.lit(0.0)) * F.pow(F.lit(beta), F.col("_off") + 1)
            - past * F.lit(beta ** block)
        )
    base = base.withColumns(trail)
    for i, s in enumerate(specs):
        beta = 1.0 - s.alpha
        terms = math.ceil(math.log(1e-18) / (block * math.log(beta)))
        y = F.col(f"_tr_{i}")
        for q in range(1, terms + 1):
            y = y + F.coalesce(series.lag(f"_tr_{i}", q * block), F.lit(0.0)) * F.lit(beta ** (block * q))
        out[s.out] = F.when(F.col(s.x).isNotNull() & (F.col(seen[s.x]) >= s.min_rows), y)
    base = base.withColumns(out)
    return base.drop("_pos", "_blk", "_off", *seen.values(), *run, *trail)


def fence(df: DataFrame) -> DataFrame:
    """Keep later filters above this point.

    Catalyst rewrites a filter on a computed column into a filter on the whole expression. For
    long pricing formulas that grows the plan far more than it saves; the always-true test of a
    non-deterministic id stops the rewrite.
    """
    return df.where(F.monotonically_increasing_id() >= 0)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                out: str = "_pos") -> DataFrame:
    """0-based row number per series without holding a series in one task.

    ``bucket`` must not decrease along ``order`` (a day or hour of the order column). Rows are
    counted per bucket, the small counts are summed up to offsets, and rows are numbered inside
    buckets only.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_base") + F.col("_rn"))
        .drop("_bucket", "_rn", "_base")
    )


def with_halo(df: DataFrame, pos: str, back: int, ahead: int = 0, chunk: int = 4096) -> DataFrame:
    """Cut numbered series into chunks that carry the neighbouring rows their windows need.

    Adds ``_chunk`` and ``_home``. Windows over (keys, _chunk) with frames inside
    [-back, +ahead] give exact values on rows where ``_home``; drop the other rows afterwards.
    """
    chunk = max(chunk, back + 1, ahead + 1)
    home = F.floor(F.col(pos) / chunk)
    first = F.greatest(F.floor((F.col(pos) - ahead) / chunk), F.lit(0))
    last = F.floor((F.col(pos) + back) / chunk)
    return (
        df.withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_home", F.col("_chunk") == home)
    )


def average_rank(x, within: Sequence[str | Column]) -> Column:
    """Rank with ties averaged, among non-null x; null stays null."""
    x = col(x)
    w = Window.partitionBy(*within, x.isNull()).orderBy(x)
    ties = Window.partitionBy(*within, x)
    return F.when(x.isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def percent_rank_avg(x, within: Sequence[str | Column]) -> Column:
    """Average-tie rank divided by the number of non-null values."""
    x = col(x)
    return average_rank(x, within) / F.count(x).over(Window.partitionBy(*within))
