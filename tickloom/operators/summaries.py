"""Per-symbol summaries: scenarios, grades, recommendations, peers, parameter diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import safe_div
from tickloom.operators.frames import Series

# Horizon in rows per timeframe, and in days for growth scenarios.
HORIZONS = {"1W": 5, "1M": 21, "3M": 63, "6M": 126, "1Y": 252}
GROWTH_DAYS = {"1W": 7, "1M": 30, "3M": 90, "6M": 180, "1Y": 365}
ANNUAL = math.sqrt(252.0)


def price_scenarios(returns: DataFrame, overlay: DataFrame | None = None, s: Series = Series()) -> DataFrame:
    """Bull, base and bear targets with probabilities from the symbol's own return history.

    Drift is halved. ``overlay(symbol, daily_drift, daily_vol)`` replaces both for the first five rows.
    """
    r = returns.where("log_return is not null")
    g = returns.groupBy("symbol").agg(F.max_by("close", "date").alias("last"), (F.avg("log_return") * 0.5).alias("drift"),
                                      F.stddev_samp("log_return").alias("vol"), F.count("log_return").alias("n"))
    hs = F.array(*[F.struct(F.lit(k).alias("timeframe"), F.lit(h).alias("h")) for k, h in HORIZONS.items()])
    g = g.withColumn("_h", F.explode(hs)).select("symbol", "last", "drift", "vol", "n", "_h.*")
    total, var = F.col("drift") * F.col("h"), F.col("vol") * F.col("vol") * F.col("h")
    if overlay is not None:
        g = g.join(overlay, "symbol", "left")
        m = F.least(F.col("h"), F.lit(5))
        has = F.col("daily_drift").isNotNull()
        total = F.when(has, F.col("daily_drift") * m + F.col("drift") * (F.col("h") - m)).otherwise(total)
        var = F.when(has, F.pow("daily_vol", 2) * m + F.col("vol") * F.col("vol") * (F.col("h") - m)).otherwise(var)
    g = g.withColumns({"total_drift": total, "band": F.sqrt(var)})
    row, rows = F.row_number().over(s.spec()) - 1, F.count(F.lit(1)).over(s.whole())
    sums = F.array(*[F.when(row < rows - h, F.struct(F.lit(k).alias("timeframe"), F.sum("log_return").over(s.rows(0, h - 1)).alias("hr"))) for k, h in HORIZONS.items()])
    parts = r.select("symbol", sums.alias("_sums")).select("symbol", F.explode(F.array_compact("_sums")).alias("w")).select("symbol", "w.*")
    parts = parts.withColumn("_mean", F.avg("hr").over(Window.partitionBy("symbol", "timeframe")))
    j = parts.join(g.select("symbol", "timeframe", "total_drift", "band"), ["symbol", "timeframe"])
    c = F.col("hr") - F.col("_mean") + F.col("total_drift")
    f = lambda cond: F.avg(cond.cast("double"))
    p = j.groupBy("symbol", "timeframe").agg(f(c >= F.col("band")).alias("_bull"), f(c <= -F.col("band")).alias("_bear"), f(c > 0).alias("_up"))
    g = g.join(p, ["symbol", "timeframe"], "left")
    thin = F.col("n") <= F.col("h") + 20
    up0 = 0.5 + F.coalesce(safe_div("total_drift", F.col("band") * 2.5), F.lit(0.0))
    g = g.withColumns({"p_bull": F.when(thin, 0.16).otherwise(F.col("_bull")), "p_bear": F.when(thin, 0.16).otherwise(F.col("_bear")),
                       "p_up": F.when(thin, up0).otherwise(F.col("_up"))})
    g = g.withColumn("p_base", F.greatest(F.lit(0.0), 1 - F.col("p_bull") - F.col("p_bear")))
    px = lambda x: F.bround(F.col("last") * F.exp(x), 2)
    g = g.withColumns({"bull": px(F.col("total_drift") + F.col("band")), "base": px(F.col("total_drift")), "bear": px(F.col("total_drift") - F.col("band"))})
    return g.select("symbol", "timeframe", "h", "last", (F.col("vol") * ANNUAL).alias("annualized_vol"), "p_up", "p_bull", "p_base", "p_bear", "bull", "base", "bear",
                    *[F.bround((F.col(c) - F.col("last")) / F.col("last") * 100, 2).alias(f"{c}_return") for c in ("bull", "base", "bear")])


def action_of(p_up: Column, base_return: Column) -> Column:
    return (F.when((p_up >= 0.62) & (base_return > 2), "Strong Buy").when((p_up >= 0.55) & (base_return > 0), "Buy")
            .when((p_up <= 0.38) | (base_return < -5), F.when(p_up <= 0.33, "Strong Sell").otherwise("Sell")).otherwise("Hold"))


def recommendations(scenarios: DataFrame) -> DataFrame:
    p = F.bround("p_up", 3)
    return scenarios.select("symbol", "timeframe", action_of(p, F.col("base_return")).alias("action"), F.bround(0.5 + F.abs(p - 0.5), 2).alias("confidence"), p.alias("p_up"), "base_return")


def growth_scenarios(df: DataFrame) -> DataFrame:
    """Targets from EPS growth and a 0-100 sentiment score per timeframe. Needs price, eps_growth, sentiment."""
    ts = F.array(*[F.struct(F.lit(k).alias("timeframe"), F.lit(float(v)).alias("days")) for k, v in GROWTH_DAYS.items()])
    g = df.withColumn("_t", F.explode(ts)).select(*df.columns, "_t.*")
    growth = F.coalesce(F.when(F.col("eps_growth") != 0, F.col("eps_growth")), F.lit(10.0)) / 100 * F.col("days") / 365
    sent = (F.col("sentiment") - 50) / 100
    px = F.col("price")
    return g.withColumns({"bull": px * (1 + growth * 1.5 + sent * 0.2), "base": px * (1 + growth + sent * 0.1), "bear": px * (1 + growth * 0.3 - F.abs(sent) * 0.2)})


def _band(x: Column, cuts: Sequence[float], above: bool) -> Column:
    scores = (95, 85, 75, 60)
    out = F.lit(40)
    for c, sc in reversed(list(zip(cuts, scores))):
        out = F.when(x > c if above else x < c, sc).otherwise(out)
    return out


def letter(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def grades(df: DataFrame) -> DataFrame:
    """Valuation, profitability, growth and health scores; missing and zero inputs take defaults."""
    d = {"pe_ratio": 20.0, "roe": 15.0, "profit_margin": 10.0, "eps_growth": 10.0, "revenue_growth": 10.0, "debt_to_equity": 0.5}
    x = {k: F.coalesce(F.when(F.col(k) != 0, F.col(k)), F.lit(v)) for k, v in d.items()}
    df = df.withColumns({
        "valuation": _band(x["pe_ratio"], (15, 20, 25, 35), False), "profitability": _band((x["roe"] + x["profit_margin"]) / 2, (20, 15, 10, 5), True),
        "growth": _band((x["eps_growth"] + x["revenue_growth"]) / 2, (20, 15, 10, 5), True), "financial_health": _band(x["debt_to_equity"], (0.3, 0.5, 1.0, 2.0), False)})
    df = df.withColumn("average_score", (F.col("valuation") + F.col("profitability") + F.col("growth") + F.col("financial_health")) / 4.0)
    return df.withColumn("overall_grade", letter(F.col("average_score")))


def peer_comparison(metrics: DataFrame, peers: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sorted peers above and below a subject per metric; equal or missing in neither. A peer list is short by nature."""
    lf = metrics.select("symbol", *names).unpivot("symbol", list(names), "metric", "value").where("value is not null")
    own = lf.select("symbol", "metric", F.col("value").alias("own"))
    other = lf.select(F.col("symbol").alias("peer"), "metric", F.col("value").alias("theirs"))
    j = own.join(peers, "symbol").join(other, ["peer", "metric"], "left")
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("peer"))))
    return j.groupBy("symbol", "metric", "own").agg(pick(F.col("theirs") > F.col("own")).alias("higher"), pick(F.col("theirs") < F.col("own")).alias("lower"))


def market_snapshot(bars: DataFrame, s: Series = Series()) -> DataFrame:
    """Latest changes, 52-week position, price against averages, volatility and its one-year rank."""
    df = bars.withColumn("_r", F.ln(F.col("close") / s.lag("close")))
    chg = lambda n: (F.col("close") / F.coalesce(s.lag("close", n), F.first("close").over(s.so_far())) - 1) * 100
    up, down = F.greatest(F.col("_d"), F.lit(0.0)), F.greatest(-F.col("_d"), F.lit(0.0))
    df = df.withColumns({"_d": F.col("close") - s.lag("close"), "_vol": s.std("_r", 20)})
    df = df.withColumns({
        "chg_1w_pct": chg(5), "chg_1m_pct": chg(21), "chg_3m_pct": chg(63),
        "_lo": s.low("close", 252, 1), "_hi": s.high("close", 252, 1), "_s50": s.mean("close", 50, 1), "_s200": s.mean("close", 200),
        "_g": s.mean(up, 14), "_l": s.mean(down, 14), "_now": F.col("_vol"), "_back": F.row_number().over(s.newest_first())})
    last = df.where("_back = 1")
    ref = df.where("_back <= 253 and _vol is not null").select("symbol", "_vol")
    rank = ref.join(last.select("symbol", F.col("_vol").alias("_cur")), "symbol").groupBy("symbol").agg(F.avg((F.col("_vol") <= F.col("_cur")).cast("double")).alias("_rk"))
    out = last.join(rank, "symbol", "left")
    return out.select(
        "symbol", "date", F.col("close").alias("last"), "chg_1w_pct", "chg_1m_pct", "chg_3m_pct",
        (safe_div(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 100).alias("pos_in_52w_range_pct"),
        F.when(F.col("_l") > 0, 100 - 100 / (1 + safe_div("_g", "_l"))).otherwise(100.0).alias("rsi14"),
        ((F.col("close") / F.col("_s50") - 1) * 100).alias("price_vs_sma50_pct"), ((F.col("close") / F.col("_s200") - 1) * 100).alias("price_vs_sma200_pct"),
        (F.col("_vol") * ANNUAL).alias("realized_vol_20d_ann"), (F.col("_rk") * 100).alias("vol_1y_percentile"))


# ---- parameter history ------------------------------------------------------------------------

def parameter_stats(history: DataFrame, names: Sequence[str], s: Series = Series(), jump: float = 3.0) -> DataFrame:
    """Mean, population deviation, range, change volatility, largest jump and jump count per parameter."""
    lf = history.select(*s.keys, *s.order, *names).unpivot([*s.keys, *s.order], list(names), "parameter", "value")
    w = Window.partitionBy(*s.keys, "parameter").orderBy(*s.order)
    d = lf.withColumn("_d", F.col("value") - F.lag("value").over(w))
    d = d.withColumn("_cv", F.stddev_pop("_d").over(Window.partitionBy(*s.keys, "parameter")))
    return d.groupBy(*s.keys, "parameter").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.max("_cv").alias("change_vol"),
        F.max(F.abs("_d")).alias("max_jump"), F.count(F.when((F.col("_cv") > 0) & (F.abs("_d") / F.col("_cv") > jump), 1)).alias("jumps"))


def stress_periods(history: DataFrame, s: Series = Series(), nu_z: float = 2.0, rho_flip: float = 0.3) -> DataFrame:
    """Flags on nu (population z), rho change and alpha (sample z), and their share."""
    w = s.whole()
    nu = safe_div(F.col("nu") - F.avg("nu").over(w), F.stddev_pop("nu").over(w))
    al = safe_div(F.col("alpha") - F.avg("alpha").over(w), F.stddev_samp("alpha").over(w))
    no = F.lit(False)
    df = history.withColumns({"nu_spike": F.coalesce(F.abs(nu) > nu_z, no), "rho_flip": F.coalesce(F.abs(F.col("rho") - s.lag("rho")) > rho_flip, no), "alpha_surge": F.coalesce(al > 2.0, no)})
    return df.withColumn("stress_score", (F.col("nu_spike").cast("int") + F.col("rho_flip").cast("int") + F.col("alpha_surge").cast("int")) / 3.0)


def transitions(df: DataFrame, label: str, s: Series = Series()) -> DataFrame:
    prev = s.lag(label)
    return df.withColumn("_prev", prev).where(F.col("_prev").isNotNull() & (F.col("_prev") != F.col(label))).select(
        *s.keys, *s.order, F.col("_prev").alias("from_label"), F.col(label).alias("to_label"))


def validation_summary(windows: DataFrame, keys: Sequence[str], params: Sequence[str]) -> DataFrame:
    """Mean errors, parameter deviation across windows, best and worst window."""
    rank = F.when(F.col("price_rmse").isNotNull(), F.struct("price_rmse", "window"))
    return windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("price_rmse").alias("avg_price_rmse"), F.avg("vol_rmse").alias("avg_vol_rmse"),
        *[F.stddev_pop(p).alias(f"{p}_std") for p in params],
        F.min_by("window", rank).alias("best_window"), F.max_by("window", rank).alias("worst_window"))
