"""The daily feature matrix: assembly, catalogue, cleaning, increments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.asof import asof_join, asof_nearest
from tickloom.operators.frames import Series
from tickloom.operators.sets import keep_one, union_aligned

META = ("symbol", "date", "fund_quarter_end", "opt_as_of")
TARGETS = ("target_1d", "target_5d", "target_vol_5d", "target_dir_1d", "target_large_move", "target_regime")

# Column order of the matrix by group.
GROUPS = (
    ("symbol", "date"),
    ("open", "high", "low", "close", "volume"),
    ("sma_20", "sma_50", "sma_200", "ema_20", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_mid",
     "bb_lower", "atr_14", "obv", "daily_return", "log_return"),
    ("price_to_sma20", "price_to_sma50", "price_to_sma200", "bb_pct", "volume_zscore", "high_low_range", "overnight_gap"),
    ("realized_vol_20d", "realized_vol_60d", "vol_of_vol", "skewness_20d", "kurtosis_20d", "downside_deviation", "max_drawdown_20d"),
    ("amihud_illiquidity", "bid_ask_spread_proxy", "volume_participation", "trade_imbalance"),
    ("reversal_1w", "momentum_1m", "momentum_3m", "momentum_6m", "momentum_12m", "high_52w_pct", "low_52w_pct", "price_accel"),
    ("index_return", "beta_60d", "corr_20d", "rel_strength"),
)
PREFIXES = ("fund_", "news_", "insdr_", "opt_", "earn_")


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def ordered(df: DataFrame) -> DataFrame:
    """Columns by group, each once, unknown ones last."""
    names = [c for g in GROUPS for c in g if c in df.columns]
    for p in PREFIXES:
        names += sorted(with_prefix(df, p)) if p == "fund_" else with_prefix(df, p)
    names += df.columns
    return df.select(*dict.fromkeys(names))


def numeric_columns(df: DataFrame, skip: Sequence[str] = META + TARGETS) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def merge_news(spine: DataFrame, daily: DataFrame, scores: Sequence[str], causal: bool = False,
               s: Series = Series()) -> DataFrame:
    """Attach daily scores to bars: nearest day within 4, carried 20 rows, back-filled 5, 7-row mean.

    The nearest join and the back-fill can look ahead by 4 days and 5 rows; ``causal`` uses the
    latest earlier day and no back-fill.
    """
    cols = [*scores, "news_articles"]
    if causal:
        j = asof_join(spine, daily, list(s.keys), s.order[0], "date", cols, matched="_at")
        fresh = F.datediff(s.order[0], "_at") <= 4
        j = j.withColumns({c: F.when(fresh, F.col(c)) for c in cols}).drop("_at")
    else:
        j = asof_nearest(spine, daily, list(s.keys), s.order[0], "date", cols, 4)
    j = j.withColumn("news_count", F.coalesce("news_articles", F.lit(0))).drop("news_articles")
    j = j.withColumns({c: s.ffill(c, 20) for c in scores})
    if not causal:
        j = j.withColumns({c: s.bfill(c, 5) for c in scores})
    name = lambda c: "news_sent_7d" if c == "news_sent_score" else f"{c}_7d"
    return j.withColumns({name(c): s.mean(c, 7, 1) for c in scores})


def trim_warmup(df: DataFrame, start: Column, on: str = "date") -> DataFrame:
    """Drop warm-up rows after the windows have used them."""
    return df.where(F.col(on) >= start)


# ---- catalogue and cleaning -----------------------------------------------------------------

def catalogue(df: DataFrame, about: dict[str, str] | None = None) -> DataFrame:
    """One row per column: type, null percent, description; all counted in one pass."""
    about = about or {}
    agg = df.agg(*[F.bround(F.avg(F.col(c).isNull().cast("double")) * 100, 1).alias(c) for c in df.columns])
    kinds = dict(df.dtypes)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(c).alias("null_pct"),
                              F.lit(about.get(c, "-")).alias("description")) for c in df.columns])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def mostly_null(df: DataFrame, limit: float = 0.5) -> list[str]:
    """Columns whose null share is strictly above the limit."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] is not None and row[c] > limit]


def constant_columns(df: DataFrame) -> list[str]:
    """Numeric columns with zero sample deviation; one row alone has none and is kept."""
    nums = numeric_columns(df, ())
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in nums]).first()
    return [c for c in nums if row[c] is not None and row[c] == 0]


def fill_medians(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Fill nulls with the exact median per group. Medians come back as one small row per group."""
    cols = list(cols)
    med = df.groupBy(*by).agg(*[F.median(c).alias(f"_m_{c}") for c in cols])
    j = df.join(med, list(by))
    return j.select(*[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def clean(df: DataFrame, carry: Sequence[str], s: Series = Series(), causal: bool = False) -> DataFrame:
    """Drop mostly-null columns, carry slow columns, fill medians, drop constants."""
    df = df.drop(*[c for c in mostly_null(df) if c not in META])
    have = [c for c in carry if c in df.columns]
    df = df.withColumns({c: s.ffill(c, 20) for c in have})
    if not causal:
        df = df.withColumns({c: s.bfill(c, 5) for c in have})
    df = fill_medians(df, numeric_columns(df, META), s.keys)
    return df.drop(*constant_columns(df))


# ---- increments -----------------------------------------------------------------------------

def merge_increment(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append with aligned columns; the newer row wins per key."""
    both = union_aligned(stored.withColumn("_gen", F.lit(0)), new.withColumn("_gen", F.lit(1)))
    return keep_one(both, list(keys), ["_gen"], last=True).drop("_gen")


def last_dates(stored: DataFrame) -> DataFrame:
    return stored.groupBy("symbol").agg(F.max("date").alias("last_date"))


def newer_rows(df: DataFrame, last: DataFrame) -> DataFrame:
    """Rows after the stored last date of their symbol; unknown symbols come whole."""
    j = df.join(last, "symbol", "left")
    return j.where(F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))).drop("last_date")


def is_up_to_date(source: DataFrame, stored: DataFrame) -> bool:
    return newer_rows(source.select("symbol", "date"), last_dates(stored)).limit(1).count() == 0


def source_report(sources: dict[str | None, DataFrame], known: Sequence[str] = ()) -> DataFrame:
    """Row count, latest date and status per source. A None key splits a frame by provider."""
    parts = []
    for name, df in sources.items():
        label = F.col("provider") if name is None else F.lit(name)
        parts.append(df.groupBy(label.alias("provider")).agg(F.count(F.lit(1)).alias("row_count"), F.max("date").alias("latest")))
    got = union_aligned(*parts)
    if known:
        spark = got.sparkSession
        names = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in known])).alias("provider"))
        missing = names.join(got.select("provider"), "provider", "left_anti").select(
            "provider", F.lit(0).cast("long").alias("row_count"), F.lit(None).cast("date").alias("latest"))
        got = got.unionByName(missing)
    return got.withColumn("status", F.when(F.col("row_count") > 0, "OK").otherwise("EMPTY"))
