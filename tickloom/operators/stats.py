"""Labels, column statistics, autocorrelation and small regressions by sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.numeric import adjusted_kurtosis, adjusted_skew, finite, safe_div
from tickloom.operators.frames import Series, percent_rank_avg

FLAT = 0.005


def add_targets(df: DataFrame, s: Series = Series(), keep_null: bool = False) -> DataFrame:
    """Forward targets from log returns and 20-day volatility.

    A missing next return compares false, so direction and large-move are 0 on the last row;
    ``keep_null`` leaves them null there.
    """
    r = F.col("log_return")
    ahead = s.rows(1, 5)
    full = F.count(r).over(ahead) == 5
    df = df.withColumns({
        "target_1d": s.lead(r, 1), "target_5d": F.when(full, F.sum(r).over(ahead)),
        "target_vol_5d": F.when(full, F.stddev_samp(r).over(ahead)), "_std20": s.std(r, 20)})
    df = df.withColumns({"_next20": s.lead("_std20", 1), "_rank": percent_rank_avg("realized_vol_20d", s.keys)})
    nxt = F.col("target_1d")
    large = F.coalesce(F.abs(nxt) > 2 * F.col("_next20"), F.lit(False)).cast("int")
    out = {
        "target_dir_1d": F.when(nxt > FLAT, 1).when(nxt < -FLAT, -1).otherwise(0),
        "target_large_move": large,
        "target_regime": F.when(F.col("_rank") <= 1 / 3, 0.0).when(F.col("_rank") <= 2 / 3, 1.0).when(F.col("_rank").isNotNull(), 2.0),
    }
    if keep_null:
        out = {k: v if k == "target_regime" else F.when(nxt.isNotNull(), v) for k, v in out.items()}
    return df.withColumns(out).drop("_std20", "_next20", "_rank")


def long_form(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keys), list(cols), name, value)


def describe(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Count, mean, std, min, max, sample skew and kurtosis, null percent per column."""
    x = F.col("value")
    n = F.count(x)
    return long_form(df, keys, cols).groupBy(*keys, "feature").agg(
        n.alias("n"), F.avg(x).alias("mean"), finite(F.stddev_samp(x)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        adjusted_skew(F.skewness(x), n).alias("skew"), adjusted_kurtosis(F.kurtosis(x), n).alias("kurt"),
        F.bround((1 - n / F.count(F.lit(1))) * 100, 2).alias("null_pct"))


def pair_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs, null for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return finite(safe_div(F.covar_samp(x, y), F.stddev_samp(a) * F.stddev_samp(b)))


def target_correlations(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Correlation of every column with a target, ranked from both ends."""
    lf = long_form(df, [*keys, target], cols)
    g = lf.groupBy(*keys, "feature").agg(pair_corr(F.col("value"), F.col(target).cast("double")).alias("corr"))
    w = Window.partitionBy(*keys)
    return g.where("corr is not null").withColumns({
        "top_rank": F.row_number().over(w.orderBy(F.desc("corr"), "feature")), "bottom_rank": F.row_number().over(w.orderBy("corr", "feature"))})


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlation of a fixed list of columns, upper triangle as rows, one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[pair_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(items).alias("x")).select("x.*")


def histogram(df: DataFrame, x: str, bins: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Equal-width counts between minimum and maximum; the last bin is closed."""
    lim = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    j = df.where(F.col(x).isNotNull()).join(lim, list(keys))
    pos = F.floor(safe_div(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    return j.withColumn("bin", F.least(F.coalesce(pos, F.lit(0)), F.lit(bins - 1)).cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    g = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def train_stats(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean, population deviation and linear-interpolation 5th and 95th percentile per column."""
    g = long_form(df, keys, cols).groupBy(*keys, "feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("_p"))
    return g.withColumns({"p05": F.col("_p")[0], "p95": F.col("_p")[1]}).drop("_p")


def standardise(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Median-impute, then scale to zero mean and unit population deviation (constant: divide by 1)."""
    med = df.groupBy(*keys).agg(*[F.median(c).alias(f"_m_{c}") for c in cols])
    x = df.join(med, list(keys)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols})
    mom = x.groupBy(*keys).agg(*[F.avg(c).alias(f"_a_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    y = x.join(mom, list(keys))
    scaled = {c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in cols}
    return y.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


# ---- autocorrelation ------------------------------------------------------------------------

def acf(df: DataFrame, x: str, lags: int = 40, s: Series = Series(), extra: Sequence[str] = ()) -> DataFrame:
    """Autocorrelation with full-sample mean and variance, one row per lag."""
    keys = [*s.keys, *extra]
    base = df.where(F.col(x).isNotNull())
    m = base.groupBy(*keys).agg(F.avg(x).alias("_mean"))
    c = base.join(m, keys).withColumn("_c", F.col(x) - F.col("_mean"))
    w = Window.partitionBy(*keys).orderBy(*s.order)
    c = c.select(*keys, "_c", *[F.lag("_c", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    g = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_v"),
                             *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_p{k}") for k in range(1, lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), safe_div(F.col(f"_p{k}"), F.col("_v")).alias("acf")) for k in range(1, lags + 1)])
    return g.select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "n", "r.*")


def pacf(acf_rows: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Partial autocorrelation from the (at most 40) autocorrelations of each key."""
    kinds = dict(acf_rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "lag int", "pacf double"])

    def levinson(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = pdf.sort_values("lag")["acf"].to_numpy()
        phi, out = np.zeros(0), []
        for k in range(1, len(rho) + 1):
            prev = rho[:k - 1]
            new = (rho[k - 1] - phi @ prev[::-1]) / (1 - phi @ prev)
            phi = np.append(phi - new * phi[::-1], new)
            out.append(new)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "lag": np.arange(1, len(rho) + 1, dtype="int32"), "pacf": out})

    return acf_rows.groupBy(*keys).applyInPandas(levinson, schema)


# ---- least squares by sums ------------------------------------------------------------------

_FIT = T.StructType([
    T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("se", T.ArrayType(T.DoubleType())), T.StructField("rss", T.DoubleType()),
    T.StructField("tss", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("r2", T.DoubleType())])


@F.pandas_udf(_FIT)
def _solve(g: pd.Series, d: pd.Series) -> pd.DataFrame:
    out = []
    for flat, k in zip(g, d):
        k = int(k)
        m = np.zeros((k + 1, k + 1))
        m[np.triu_indices(k + 1)] = flat
        m = m + np.triu(m, 1).T
        a, b, yy, n = m[:k, :k], m[:k, k], m[k, k], m[0, 0]
        inv = np.linalg.pinv(a)
        beta = inv @ b
        rss = max(float(yy - beta @ b), 0.0)
        tss = float(yy - b[0] ** 2 / n) if n else 0.0
        s2 = rss / (n - k) if n > k else np.nan
        out.append((beta, np.sqrt(np.maximum(np.diag(inv) * s2, 0.0)), rss, tss, int(n), 1 - rss / tss if tss > 0 else np.nan))
    return pd.DataFrame(out, columns=["beta", "se", "rss", "tss", "n", "r2"])


def ols(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares with intercept per key: cross-product sums in one aggregate, then a small solve.

    Rows with a null are left out. ``fit`` holds coefficients (intercept first), errors, RSS, n, R2.
    """
    cols = ["_one", *xs, y]
    d = df.where(" and ".join(f"`{c}` is not null" for c in [*xs, y])).withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"_g{i}_{j}")
            for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    names = [f"_g{i}_{j}" for i in range(len(cols)) for j in range(i, len(cols))]
    g = d.groupBy(*keys).agg(*sums)
    return g.select(*keys, _solve(F.array(*names), F.lit(len(xs) + 1)).alias("fit"))
