"""Backtest tables: market path, daily P&L, attribution, equity curve, stress scenarios."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import safe_div
from tickloom.operators.frames import Series
from tickloom.operators.options import with_bs_price
from tickloom.operators.portfolio import hedge_shares

ANNUAL = math.sqrt(252.0)


def market_path(bars: DataFrame, s: Series = Series()) -> DataFrame:
    """Spot moves, change of five-row realised volatility in points, derived shocks, regime."""
    df = bars.withColumns({
        "ret": F.coalesce(safe_div("close", s.lag("close")) - 1, F.lit(0.0)),
        "dspot": F.coalesce(F.col("close") - s.lag("close"), F.lit(0.0)),
    })
    df = df.withColumn("rv5", F.coalesce(s.std("ret", 5, 2), F.lit(0.0)) * 100)
    df = df.withColumn("iv_change_points", F.coalesce(F.col("rv5") - s.lag("rv5"), F.lit(0.0)))
    size = F.abs("ret")
    move = F.col("iv_change_points")
    return df.select(
        *s.keys, *s.order, F.bround("close", 2).alias("spot"), F.bround("dspot", 4).alias("dspot"), "ret",
        F.bround(move, 4).alias("iv_change_points"), F.bround(move * 0.5, 4).alias("skew_shift_points"),
        F.bround(move * 0.3, 4).alias("term_twist_points"), F.bround(move * 0.8, 4).alias("vol_of_vol_shock_points"),
        F.when(size > 0.03, "crisis").when(size > 0.015, "stress").otherwise("normal").alias("regime"))


@dataclass(frozen=True)
class Config:
    """Backtest settings; defaults are fixed values of the strategy rules."""

    initial_capital_usd: float = 250000.0
    max_holding_days: int = 20
    edge_close_vol_points: float = 0.50
    exit_on_regime_flip: bool = False
    hedge_mode: str = "threshold"
    delta_hedge_threshold: float = 25.0
    hedge_slippage_bps: float = 5.0
    hedge_commission_per_share: float = 0.005
    option_commission_per_contract: float = 0.65
    spread_cross_fraction: float = 0.50
    running_hedge: bool = False


PARTS = ("delta_pnl", "gamma_pnl", "vega_pnl", "theta_pnl")
MONEY = (*PARTS, "mtm_pnl", "realized_pnl", "hedge_pnl", "hedge_costs", "transaction_costs", "turnover_usd",
         "capital_used_usd", "net_delta", "net_gamma", "net_vega", "net_theta")


def cohort_totals(targets: DataFrame, fills: DataFrame, cands: DataFrame, cfg: Config, keys: Sequence[str]) -> DataFrame:
    """Sums over the filled positions that share an entry row.

    A day's P&L is linear in the positions, so they are added up before any day is attached and
    positions never meet days row by row. With ``running_hedge`` the hedge follows the net delta
    as it builds up position by position.
    """
    f = fills.where("accepted and filled_contracts > 0").select("intent_id", "filled_contracts", "fill_price")
    c = cands.select("intent_id", *[F.col(x).alias(f"_{x}") for x in ("bid", "ask", "mid")])
    j = targets.drop("bid", "ask", "mid").join(f, "intent_id").join(c, "intent_id")
    j = j.withColumnsRenamed({"_bid": "bid", "_ask": "ask", "_mid": "mid"})
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    scale = sign * F.col("filled_contracts") / F.greatest(F.abs("contracts"), F.lit(1))
    n = F.col("filled_contracts")
    j = j.withColumns({g: scale * F.col(g) for g in ("delta", "gamma", "vega", "theta")})
    entry, exit_ = F.col("fill_price") * 100.0 * n, F.col("mid") * 100.0 * n
    sums = {
        **{f"net_{g}": F.sum(g) for g in ("delta", "gamma", "vega", "theta")},
        "capital_used_usd": F.sum(F.abs(entry)),
        "_realized": F.sum(F.when(F.col("side") == "buy", exit_ - entry).otherwise(entry - exit_)),
        "_tc": F.sum(n * F.greatest(F.col("ask") - F.col("bid"), F.lit(0.0)) * 100.0 * cfg.spread_cross_fraction
                     + n * cfg.option_commission_per_contract * 2.0),
        "_turnover": F.sum(entry + exit_),
    }
    if cfg.running_hedge:
        w = Window.partitionBy(*keys).orderBy("intent_id").rowsBetween(Window.unboundedPreceding, 0)
        j = j.withColumn("_sh", hedge_shares(F.sum("delta").over(w), cfg.hedge_mode, cfg.delta_hedge_threshold))
        return j.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()], F.sum("_sh").alias("_shares"), F.sum(F.abs("_sh")).alias("_abs_shares"))
    g = j.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
    g = g.withColumn("_shares", hedge_shares(F.col("net_delta"), cfg.hedge_mode, cfg.delta_hedge_threshold))
    return g.withColumn("_abs_shares", F.abs("_shares"))


def daily_pnl(targets: DataFrame, fills: DataFrame, cands: DataFrame, path: DataFrame, cfg: Config = Config(),
              run: Sequence[str] = ("symbol",)) -> DataFrame:
    """Daily P&L table of positions opened on the first path row of their run.

    Exits depend on the day only (horizon, closed edge, regime), so each run has one exit row.
    """
    keys = list(run)
    w = Window.partitionBy(*keys).orderBy("date")
    p = path.withColumn("day", F.row_number().over(w))
    early = max(3, int(cfg.max_holding_days * 0.30))
    leave = (F.col("day") >= cfg.max_holding_days) | (
        (F.abs("iv_change_points") < cfg.edge_close_vol_points) & (F.col("day") >= early))
    if cfg.exit_on_regime_flip:
        leave = leave | F.lower("regime").isin("stress", "crisis", "jump")
    exits = p.where(leave).groupBy(*keys).agg(F.min("day").alias("exit_day"))
    book = cohort_totals(targets, fills, cands, cfg, keys)
    j = p.join(book, keys, "left").join(exits, keys, "left")
    live = F.col("net_delta").isNotNull() & (F.col("exit_day").isNull() | (F.col("day") <= F.col("exit_day")))
    closing = F.col("net_delta").isNotNull() & (F.col("day") == F.col("exit_day"))
    ds = F.col("dspot")
    calc = {
        "delta_pnl": F.col("net_delta") * ds * 100.0, "gamma_pnl": 0.5 * F.col("net_gamma") * ds * ds * 100.0,
        "vega_pnl": F.col("net_vega") * F.col("iv_change_points"), "theta_pnl": F.col("net_theta"),
        "hedge_pnl": F.col("_shares") * ds,
        "hedge_costs": F.col("_abs_shares") * F.abs(ds) * (cfg.hedge_slippage_bps / 10000.0) + F.col("_abs_shares") * cfg.hedge_commission_per_share,
        **{c: F.col(c) for c in ("capital_used_usd", "net_delta", "net_gamma", "net_vega", "net_theta")},
    }
    out = {k: F.when(live, v).otherwise(0.0).alias(k) for k, v in calc.items()}
    out["realized_pnl"] = F.when(closing, F.col("_realized")).otherwise(0.0).alias("realized_pnl")
    out["transaction_costs"] = F.when(closing, F.col("_tc")).otherwise(0.0).alias("transaction_costs")
    out["turnover_usd"] = F.when(closing, F.col("_turnover")).otherwise(0.0).alias("turnover_usd")
    d = j.select(*keys, "date", "regime", *out.values())
    d = d.withColumn("mtm_pnl", F.col("delta_pnl") + F.col("gamma_pnl") + F.col("vega_pnl") + F.col("theta_pnl"))
    d = d.withColumn("total_pnl", F.col("mtm_pnl") + F.col("realized_pnl") + F.col("hedge_pnl") - F.col("hedge_costs") - F.col("transaction_costs"))
    return equity_curve(d, cfg.initial_capital_usd, keys)


def equity_curve(daily: DataFrame, capital: float, keys: Sequence[str]) -> DataFrame:
    """Running equity, its peak from the initial capital, and relative drawdown."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("equity", F.lit(capital) + F.sum("total_pnl").over(w))
    d = d.withColumn("_peak", F.greatest(F.max("equity").over(w), F.lit(capital)))
    return d.withColumns({
        "drawdown_pct": F.when(F.col("_peak") <= 0, 0.0).otherwise((F.col("_peak") - F.col("equity")) / F.col("_peak")),
        "capital_used_pct": F.col("capital_used_usd") / F.lit(capital),
    }).drop("_peak")


def attribution(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P&L split into model, hedge, greek and cost parts, with P&L by regime as a map.

    Marking equals the greek sum here, so the model part reduces to minus the hedge P&L.
    """
    explained = F.col("delta_pnl") + F.col("gamma_pnl") + F.col("vega_pnl") + F.col("theta_pnl") + F.col("hedge_pnl")
    g = daily.groupBy(*keys).agg(
        F.sum(F.col("mtm_pnl") - explained).alias("model_edge_capture"),
        F.sum(F.col("hedge_pnl") - F.col("hedge_costs")).alias("delta_hedge_contribution"),
        F.sum("vega_pnl").alias("vega_exposure"), F.sum("theta_pnl").alias("theta_carry"),
        F.sum(F.col("transaction_costs") + F.col("hedge_costs")).alias("execution_cost"),
        F.sum(F.col("transaction_costs") * 0.5).alias("spread_crossing"))
    by = daily.groupBy(*keys, "regime").agg(F.sum("total_pnl").alias("pnl"))
    m = by.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("regime", "pnl")))).alias("regime_performance"))
    return g.join(m, list(keys))


def summary(daily: DataFrame, capital: float, keys: Sequence[str]) -> DataFrame:
    """Totals, costs, worst drawdown, mean capital use, turnover, Sharpe ratio and return."""
    n, sd = F.count("total_pnl"), F.stddev_samp("total_pnl")
    return daily.groupBy(*keys).agg(
        F.sum("total_pnl").alias("total_pnl"),
        F.sum(F.col("mtm_pnl") + F.col("realized_pnl") + F.col("hedge_pnl")).alias("gross_before_costs"),
        F.sum(F.col("transaction_costs") + F.col("hedge_costs")).alias("total_costs"),
        F.max("drawdown_pct").alias("max_drawdown_pct"), F.avg("capital_used_pct").alias("average_capital_used_pct"),
        F.sum("turnover_usd").alias("turnover_usd"), F.count(F.lit(1)).alias("days"),
        F.when((n >= 2) & (sd > 0), F.avg("total_pnl") / sd * ANNUAL).otherwise(0.0).alias("sharpe"),
        (F.sum("total_pnl") / capital * 100).alias("total_return_pct"))


# Default stress scenarios.
SCENARIOS = (
    # name, spot, skew, term, vol-of-vol, spread x, liquidity x, hedge lag, wrong way, unstable calibration
    ("spot_down_5pct_skew_widen", -0.05, 2.5, 0.5, 1.5, 1.0, 1.0, 1.0, False, False),
    ("spot_up_4pct_term_twist", 0.04, -1.0, 2.0, 1.0, 1.0, 1.0, 1.0, False, False),
    ("liquidity_collapse_spread_widen", -0.01, 1.0, 0.0, 1.0, 3.0, 0.25, 1.5, False, False),
    ("overnight_gap_wrong_way_jump", -0.08, 3.0, 1.0, 2.5, 2.0, 1.0, 2.0, True, False),
    ("calibration_instability_event", -0.03, 2.0, 2.0, 3.0, 2.5, 0.40, 1.0, False, True),
)
_SHOCK = ("scenario", "spot_shock", "skew", "term", "vov", "spread_x", "liquidity_x", "lag_x", "wrong_way", "unstable")


def stress(positions: DataFrame, keys: Sequence[str], scenarios=SCENARIOS) -> DataFrame:
    """P&L per scenario in eight parts. Needs position greeks, contracts, bid, ask and spot.

    The fixed scenario list is exploded next to each position and summed on the map side.
    """
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(_SHOCK, s)]) for s in scenarios])
    p = positions.withColumn("s", F.explode(rows)).select(*positions.columns, "s.*")
    ds = F.col("spot") * F.col("spot_shock")
    shift = F.col("vov") + F.when(F.col("option_type") == "put", 1.2).otherwise(0.8) * F.col("skew") + F.greatest(
        F.col("maturity_days") / 30.0, F.lit(0.5)) * F.col("term")
    spread = F.coalesce(F.greatest(F.col("ask") - F.col("bid"), F.lit(0.0)), F.lit(0.0))
    g = p.groupBy(*keys, "scenario").agg(
        F.sum(F.col("delta") * ds).alias("delta_pnl"), F.sum(0.5 * F.col("gamma") * ds * ds).alias("gamma_pnl"),
        F.sum(F.col("vega") * shift).alias("vega_pnl"), F.sum(F.col("theta") / 252.0).alias("theta_pnl"),
        (-F.sum(F.abs("contracts") * spread * 100.0 * F.col("spread_x") / F.greatest(F.col("liquidity_x"), F.lit(1e-6)))).alias("execution_drag"),
        (-F.sum(F.abs(F.col("delta") * ds) * F.greatest(F.col("lag_x") - 1.0, F.lit(0.0)))).alias("hedge_lag"),
        (-F.sum(F.when(F.col("wrong_way"), 0.20 * (F.abs("vega") + F.abs("gamma") * F.greatest(F.abs(ds), F.lit(1.0)))).otherwise(0.0))).alias("wrong_way_jump"),
        (-F.sum(F.when(F.col("unstable"), 0.10 * (F.abs("vega") + F.abs("theta") + F.abs("gamma") * 100.0)).otherwise(0.0))).alias("calibration_instability"))
    parts = ("delta_pnl", "gamma_pnl", "vega_pnl", "theta_pnl", "execution_drag", "hedge_lag", "wrong_way_jump", "calibration_instability")
    total = F.col(parts[0])
    for c in parts[1:]:
        total = total + F.col(c)
    return g.withColumn("pnl", total)


# ---- templates with rolling re-entry --------------------------------------------------------

# Hedge mode, holding rows, hedge threshold, sizing (capital share, margin) and legs
# (type, buy?, strike ratio, days, volatility, delta, gamma, vega, theta) per strategy.
STRATEGIES = {
    "Volatility Mean Reversion": dict(hedge="threshold", hold=20, threshold=25.0, share=0.30, margin=0.13, legs=(
        ("call", False, 1.05, 30, 0.20, 0.30, 0.012, 10.5, -6.5), ("put", False, 0.95, 30, 0.20, -0.30, 0.012, 10.0, -6.0))),
    "Delta-Neutral Short Vol": dict(hedge="continuous", hold=15, threshold=10.0, share=0.30, margin=0.20, legs=(
        ("call", False, 1.0, 30, 0.20, 0.50, 0.020, 14.0, -8.0), ("put", False, 1.0, 30, 0.20, -0.50, 0.020, 13.5, -7.5))),
    "Long Gamma Momentum": dict(hedge="discrete_daily", hold=10, threshold=15.0, share=0.10, margin=None, legs=(
        ("call", True, 1.0, 30, 0.20, 0.52, 0.022, 13.0, -7.5), ("call", False, 1.05, 30, 0.22, 0.28, 0.014, 9.5, -5.0))),
}
PRICE_DAYS_PER_YEAR = 252.0


def entry_legs(path: DataFrame, strategy: str) -> DataFrame:
    """Leg quotes of a template at the first row of every holding window, per unit of contracts."""
    spec = STRATEGIES[strategy]
    w = Window.partitionBy("symbol").orderBy("date")
    p = path.withColumn("_rn", F.row_number().over(w) - 1)
    p = p.withColumns({"window_id": F.floor(F.col("_rn") / spec["hold"]), "day": F.col("_rn") % spec["hold"] + 1})
    first = Window.partitionBy("symbol", "window_id").orderBy("day")
    p = p.withColumn("_s0", F.first("spot").over(first))
    legs = []
    for kind, buy, ratio, days, vol, *greeks in spec["legs"]:
        k = F.bround(F.col("_s0") * ratio, 0)
        t = days / PRICE_DAYS_PER_YEAR
        name = f"_px{len(legs)}"
        p = with_bs_price(p, name, F.col("_s0"), k, F.lit(t), F.lit(0.0), F.lit(vol), F.lit(kind == "call"))
        mid = F.greatest(F.coalesce(F.col(name), F.lit(0.01)), F.lit(0.01))
        legs.append(F.struct(F.lit(1.0 if buy else -1.0).alias("sign"), F.bround(mid, 2).alias("mid"), mid.alias("raw"),
                             F.bround(mid * 1.01, 2).alias("fill"), (F.bround(mid * 1.03, 2) - F.bround(mid * 0.97, 2)).alias("spread"),
                             *[F.lit(g).alias(n) for n, g in zip(("delta", "gamma", "vega", "theta"), greeks)]))
    return p.withColumn("legs", F.when(F.col("day") == 1, F.array(*legs))).drop("_rn", "_s0", "_px0", "_px1")


def rolling_reentry(path: DataFrame, strategy: str, capital: float = 250000.0, cfg: Config = Config()) -> DataFrame:
    """Re-enter the template every holding window with the equity reached so far.

    The contract count of a window depends on the equity after the window before it, so one
    (strategy, symbol) series of daily rows is walked window by window; series run in parallel.
    Leg prices are columns computed beforehand.
    """
    spec = STRATEGIES[strategy]
    share, margin, mode, limit = spec["share"], spec["margin"], spec["hedge"], spec["threshold"]
    slip, per_share, fee, cross = cfg.hedge_slippage_bps / 1e4, cfg.hedge_commission_per_share, cfg.option_commission_per_contract, cfg.spread_cross_fraction
    hold = spec["hold"]
    cols = ("symbol", "date", "regime", "contracts", *PARTS, "mtm_pnl", "realized_pnl", "hedge_pnl", "hedge_costs", "transaction_costs",
            "turnover_usd", "capital_used_usd", "net_delta", "total_pnl", "capital_used_pct")
    schema = ", ".join(f"{c} {'string' if c in ('symbol', 'regime') else 'date' if c == 'date' else 'double'}" for c in cols)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        equity, frames = capital, []
        for _, win in pdf.sort_values("date").groupby("window_id", sort=True):
            legs, spot = win["legs"].iloc[0], win["spot"].iloc[0]
            if margin is None:
                debit = max(legs[0]["raw"] - legs[1]["raw"], 0.50)
                n = max(1.0, float(np.floor(equity * share / (debit * 100))))
            else:
                n = max(1.0, float(np.floor(equity * share / (spot * margin * 100))))
            net = {g: sum(x["sign"] * x[g] * n for x in legs) for g in ("delta", "gamma", "vega", "theta")}
            shares, gross, run = 0.0, 0.0, 0.0
            for x in legs:
                run += x["sign"] * x["delta"] * n
                q = float(np.rint(-run)) if mode != "threshold" or abs(run) >= limit else 0.0
                shares, gross = shares + q, gross + abs(q)
            ds = win["dspot"].to_numpy(dtype=float).copy()
            ds[0] = 0.0
            iv = win["iv_change_points"].to_numpy(dtype=float)
            last = np.arange(1, len(win) + 1) >= hold
            d = pd.DataFrame({"symbol": win["symbol"].to_numpy(), "date": win["date"].to_numpy(), "regime": win["regime"].to_numpy(), "contracts": float(n)})
            d["delta_pnl"], d["gamma_pnl"] = net["delta"] * ds * 100.0, 0.5 * net["gamma"] * ds ** 2 * 100.0
            d["vega_pnl"], d["theta_pnl"] = net["vega"] * iv, net["theta"]
            d["mtm_pnl"] = d[list(PARTS)].sum(axis=1)
            d["realized_pnl"] = np.where(last, sum(x["sign"] * (x["mid"] - x["fill"]) * 100.0 * n for x in legs), 0.0)
            d["hedge_pnl"], d["hedge_costs"] = shares * ds, gross * np.abs(ds) * slip + gross * per_share
            d["transaction_costs"] = np.where(last, sum(n * max(x["spread"], 0.0) * 100.0 * cross + n * fee * 2.0 for x in legs), 0.0)
            d["turnover_usd"] = np.where(last, sum((x["fill"] + x["mid"]) * 100.0 * n for x in legs), 0.0)
            d["capital_used_usd"] = sum(abs(x["fill"]) * 100.0 * n for x in legs)
            d["net_delta"] = net["delta"]
            d["total_pnl"] = d["mtm_pnl"] + d["realized_pnl"] + d["hedge_pnl"] - d["hedge_costs"] - d["transaction_costs"]
            d["capital_used_pct"] = d["capital_used_usd"] / equity if equity > 0 else 0.0
            equity += float(d["total_pnl"].sum())
            frames.append(d)
        return pd.concat(frames)[list(cols)]

    daily = entry_legs(path, strategy).groupBy("symbol").applyInPandas(walk, schema)
    daily = daily.withColumnRenamed("capital_used_pct", "_pct").withColumn("strategy", F.lit(strategy))
    return equity_curve(daily, capital, ["strategy", "symbol"]).withColumn("capital_used_pct", F.col("_pct")).drop("_pct")
