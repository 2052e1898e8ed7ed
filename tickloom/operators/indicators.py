"""Technical and risk features over daily bars, every symbol at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import clip, none_if_zero, safe_div
from tickloom.operators.frames import Ewm, Series, add_ewm

ANNUAL = math.sqrt(252.0)
DAILY = Series()


def add_returns(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Simple and log return, first difference and true range."""
    df = df.withColumn("prev_close", s.lag("close"))
    ratio = safe_div("close", "prev_close")
    return df.withColumns({
        "delta": F.col("close") - F.col("prev_close"),
        "daily_return": ratio - 1,
        "log_return": F.when(ratio > 0, F.ln(ratio)),
        "true_range": F.greatest(
            F.col("high") - F.col("low"),
            F.abs(F.col("high") - F.col("prev_close")),
            F.abs(F.col("low") - F.col("prev_close"))),
    })


def add_averages(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Simple means, Bollinger bands (sample deviation) and on-balance volume."""
    df = df.withColumns({
        "sma_20": s.mean("close", 20),
        "sma_50": s.mean("close", 50),
        "sma_200": s.mean("close", 200),
        "_sd20": s.std("close", 20),
        "obv": F.sum(F.coalesce(F.signum("delta"), F.lit(0.0)) * F.col("volume")).over(s.so_far()),
    })
    return df.withColumns({
        "bb_mid": F.col("sma_20"),
        "bb_upper": F.col("sma_20") + 2 * F.col("_sd20"),
        "bb_lower": F.col("sma_20") - 2 * F.col("_sd20"),
    }).drop("_sd20")


def add_smoothed(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """EMA, Wilder RSI and ATR, MACD line, signal and histogram."""
    df = df.withColumns({
        "_gain": clip("delta", low=0.0),
        "_loss": clip(-F.col("delta"), low=0.0),
    })
    df = add_ewm(df, [
        Ewm.span("ema_20", "close", 20), Ewm.span("_e12", "close", 12), Ewm.span("_e26", "close", 26),
        Ewm("_ag", "_gain", 1 / 14, 14), Ewm("_al", "_loss", 1 / 14, 14),
        Ewm("atr_14", "true_range", 1 / 14, 14),
    ], s)
    df = df.withColumns({
        "rsi_14": 100 - safe_div(F.lit(100.0), 1 + safe_div("_ag", "_al")),
        "macd": F.col("_e12") - F.col("_e26"),
    })
    df = add_ewm(df, [Ewm.span("macd_signal", "macd", 9)], s)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop(
        "_gain", "_loss", "_e12", "_e26", "_ag", "_al")


def technicals(bars: DataFrame, s: Series = DAILY) -> DataFrame:
    return add_smoothed(add_averages(add_returns(bars, s), s), s)


def add_derived(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Price ratios, band position, volume z-score, range and overnight gap."""
    return df.withColumns({
        "price_to_sma20": safe_div("close", "sma_20"),
        "price_to_sma50": safe_div("close", "sma_50"),
        "price_to_sma200": safe_div("close", "sma_200"),
        "bb_pct": safe_div(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")),
        "volume_zscore": safe_div(F.col("volume") - s.mean("volume", 20, 5), s.std("volume", 20, 5)),
        "high_low_range": safe_div(F.col("high") - F.col("low"), "close"),
        "overnight_gap": safe_div("open", "prev_close") - 1,
    })


def add_risk(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Realised volatility, its own volatility, moments, downside deviation, drawdown."""
    r = F.col("log_return")
    neg = F.when(r < 0, r)
    w = s.back(20)
    peak = s.high("close", 20, 1)
    df = df.withColumns({
        "realized_vol_20d": s.std(r, 20, 5) * ANNUAL,
        "realized_vol_60d": s.std(r, 60, 20) * ANNUAL,
        "skewness_20d": s.skew(r, 20, 10),
        "kurtosis_20d": s.kurt(r, 20, 10),
        "downside_deviation": F.when(
            (F.count(r).over(w) >= 10) & (F.count(neg).over(w) >= 3),
            F.stddev_samp(neg).over(w) * ANNUAL),
        "max_drawdown_20d": safe_div(F.col("close") - peak, peak),
    })
    return df.withColumn("vol_of_vol", s.std("realized_vol_20d", 20, 5))


def add_microstructure(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Illiquidity, spread proxy, volume participation, intraday imbalance."""
    v = none_if_zero("volume")
    spread = F.col("high") - F.col("low")
    return df.withColumns({
        "amihud_illiquidity": s.mean(F.abs("log_return") / v * 1e6, 20, 5),
        "bid_ask_spread_proxy": safe_div(spread, (F.col("high") + F.col("low")) / 2),
        "volume_participation": safe_div(v, s.mean(v, 20, 5)),
        "trade_imbalance": clip(safe_div(F.col("close") - F.col("open"), spread), -1, 1),
    })


def add_momentum(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Momentum that skips the last five rows, reversal and 52-week distances."""
    skip = s.lag("close", 5)
    df = df.withColumns({
        "reversal_1w": safe_div("close", skip) - 1,
        "momentum_1m": safe_div(skip, s.lag("close", 26)) - 1,
        "momentum_3m": safe_div(skip, s.lag("close", 68)) - 1,
        "momentum_6m": safe_div(skip, s.lag("close", 131)) - 1,
        "momentum_12m": safe_div(skip, s.lag("close", 257)) - 1,
        "high_52w_pct": clip(safe_div("close", s.high("close", 252, 63)) - 1, -1, 0),
        "low_52w_pct": clip(safe_div("close", s.low("close", 252, 63)) - 1, 0, None),
    })
    return df.withColumn("price_accel", F.col("momentum_1m") - F.col("momentum_3m"))


def add_cross_asset(df: DataFrame, index_return: str, s: Series = DAILY) -> DataFrame:
    """Rolling beta and correlation to an index return already aligned to the rows."""
    own, idx = F.col("log_return"), F.col(index_return)
    return df.withColumns({
        "beta_60d": safe_div(s.cov(own, idx, 60, 20), s.var(idx, 60, 20)),
        "corr_20d": s.corr(own, idx, 20, 10),
        "rel_strength": own - idx,
    })


def chart_overlays(bars: DataFrame, s: Series = DAILY) -> DataFrame:
    """Chart variants: EMA 20/50/200, simple-mean RSI and ATR, stochastic, CCI."""
    df = add_returns(bars, s)
    up = F.when(F.col("delta") > 0, F.col("delta")).otherwise(0.0)
    down = F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0.0)
    df = df.withColumns({
        "_tp": (F.col("high") + F.col("low") + F.col("close")) / 3,
        "_up": s.mean(up, 14), "_down": s.mean(down, 14),
        "_low14": s.low("low", 14), "_high14": s.high("high", 14),
        "atr": s.mean("true_range", 14),
    })
    df = df.withColumn("stoch_k", 100 * safe_div(F.col("close") - F.col("_low14"),
                                                 F.col("_high14") - F.col("_low14")))
    df = df.withColumns({
        "rsi": 100 - safe_div(F.lit(100.0), 1 + safe_div("_up", "_down")),
        "stoch_d": s.mean("stoch_k", 3),
        "cci": safe_div(F.col("_tp") - s.mean("_tp", 20), 0.015 * s.std("_tp", 20)),
    })
    df = add_ewm(df, [Ewm.span(f"ema{n}", "close", n) for n in (20, 50, 200)], s)
    return df.drop("_tp", "_up", "_down", "_low14", "_high14")


def rebased(bars: DataFrame, s: Series = DAILY) -> DataFrame:
    """Percent change from the first close, with start, end and total change."""
    first = F.first("close").over(s.so_far())
    last = F.last("close").over(s.rows(Window.unboundedPreceding, Window.unboundedFollowing))
    df = bars.withColumns({"start_price": first, "end_price": last})
    return df.withColumns({
        "value": safe_div(F.col("close") - F.col("start_price"), "start_price") * 100,
        "change_percent": safe_div(F.col("end_price") - F.col("start_price"), "start_price") * 100,
    })


def day_change(bars: DataFrame, s: Series = DAILY) -> DataFrame:
    """Quote line: previous close, change and percent change."""
    prev = s.lag("close")
    return bars.withColumns({
        "previous_close": prev,
        "change": F.col("close") - prev,
        "change_pct": safe_div(F.col("close") - prev, prev) * 100,
    })


def macd_crossovers(bars: DataFrame, capital: float = 100000.0, risk: float = 0.02,
                    atr_mult: float = 2.0, warmup: int = 40, s: Series = DAILY) -> DataFrame:
    """Alternating crossover trades: an opposite cross closes and opens, repeats are ignored."""
    df = add_returns(bars, s)
    df = add_ewm(df, [Ewm.span("_e12", "close", 12), Ewm.span("_e26", "close", 26),
                      Ewm.span("atr", "true_range", 14)], s)
    df = df.withColumn("macd", F.col("_e12") - F.col("_e26"))
    df = add_ewm(df, [Ewm.span("signal", "macd", 9)], s)
    df = df.withColumn("histogram", F.col("macd") - F.col("signal"))
    df = df.withColumns({"_prev": s.lag("histogram"), "_row": F.row_number().over(s.spec()) - 1})
    cross = (
        F.when((F.col("_prev") <= 0) & (F.col("histogram") > 0), F.lit("long"))
        .when((F.col("_prev") >= 0) & (F.col("histogram") < 0), F.lit("short"))
    )
    df = df.withColumn("_dir", F.when(F.col("_row") >= warmup, cross))
    held = F.last("_dir", ignorenulls=True).over(s.rows(Window.unboundedPreceding, -1))
    df = df.withColumn("_held", held).where(
        F.col("_dir").isNotNull() & (F.col("_held").isNull() | (F.col("_held") != F.col("_dir"))))
    gap = atr_mult * F.col("atr")
    opened = F.struct(
        F.lit(1).alias("leg"), F.col("_dir").alias("direction"),
        F.when(F.col("_dir") == "long", F.col("close") - gap).otherwise(F.col("close") + gap).alias("stop_loss"),
        (F.lit(capital * risk) / F.greatest(gap, F.lit(0.01))).alias("position_size"))
    closed = F.struct(F.lit(0).alias("leg"), F.lit("close").alias("direction"),
                      F.lit(0.0).alias("stop_loss"), F.lit(0.0).alias("position_size"))
    legs = F.when(F.col("_held").isNotNull(), F.array(closed, opened)).otherwise(F.array(opened))
    return df.withColumn("_t", F.explode(legs)).select(
        *s.keys, *s.order, F.col("_t.leg"), F.col("_t.direction"), F.col("close").alias("price"),
        F.col("_t.stop_loss"), F.col("_t.position_size"), "macd", "signal", "histogram")


def band_state(df: DataFrame, z: str, entry: float = 1.5, exit_: float = 0.5,
               s: Series = DAILY) -> DataFrame:
    """Spread position from z-score bands: enter beyond ``entry``, leave inside ``exit_``."""
    mark = (
        F.when(F.col(z) >= entry, F.lit(-1)).when(F.col(z) <= -entry, F.lit(1))
        .when(F.abs(F.col(z)) <= exit_, F.lit(0))
    )
    return df.withColumn("_mark", mark).withColumn(
        "position", F.coalesce(F.last("_mark", ignorenulls=True).over(s.so_far()), F.lit(0))).drop("_mark")
