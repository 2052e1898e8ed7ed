"""Volatility signals from model and market volatilities, trade intents, multi-leg strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import safe_div
from tickloom.operators.frames import fence

COMMISSION_BPS = 130.0
DEFAULT_SPREAD_BPS = 500.0
MIN_INTEREST, MIN_VOLUME, MAX_SPREAD = 100, 20, 0.10


def reality_flags(df: DataFrame) -> DataFrame:
    """Liquidity, spread and strike flags; missing market data fails all of them."""
    mid = (F.col("bid") + F.col("ask")) / 2
    live = (F.col("bid") > 0) & (F.col("ask") > 0)
    no = F.lit(False)
    return df.withColumns({
        "liquidity_ok": F.coalesce((F.col("open_interest") >= MIN_INTEREST) & (F.col("volume") >= MIN_VOLUME), no),
        "spread_ok": F.coalesce(live & (safe_div(F.col("ask") - F.col("bid"), mid) <= MAX_SPREAD), no),
        "strike_ok": F.coalesce(F.col("strike").isNotNull() & F.col("bid").isNotNull(), no),
    })


def spread_cost_bps(bid: Column, ask: Column) -> Column:
    """Half the relative spread in basis points, a fixed cost where there is no two-sided quote."""
    half = safe_div(ask - bid, (bid + ask) / 2) / 2 * 10000
    return F.coalesce(F.when((bid > 0) & (ask > 0), half), F.lit(DEFAULT_SPREAD_BPS))


def single_leg_signals(df: DataFrame, edge: str = "absolute") -> DataFrame:
    """Signal type, confidence, costs and net edge per quote with model_iv and market_iv.

    ``edge="signed"`` subtracts costs from the signed difference, so short signals can never
    pass the net-edge filter; the default compares the size of the difference with the costs.
    """
    diff = F.col("model_iv") - F.col("market_iv")
    money = F.col("strike") / F.col("spot")
    long = diff > 0.02
    kind = (
        F.when(F.abs(diff) < 0.02, "no_trade")
        .when(money.between(0.95, 1.05), F.when(long, "long_straddle").otherwise("short_straddle"))
        .when(money > 1.05, F.when(long, "long_call").otherwise("short_call"))
        .otherwise(F.when(long, "long_put").otherwise("short_put")))
    df = reality_flags(df).withColumns({
        "edge_bps": diff * 10000,
        "signal_type": kind,
        "confidence": F.when(F.abs(diff) < 0.02, 0.0).otherwise(F.least(F.abs(diff) / 0.10, F.lit(1.0))),
        "spread_cost_bps": spread_cost_bps(F.col("bid"), F.col("ask")),
        "commission_bps": F.lit(COMMISSION_BPS),
    })
    df = df.withColumn("total_cost_bps", F.col("spread_cost_bps") + F.col("commission_bps"))
    base = F.col("edge_bps") if edge == "signed" else F.abs("edge_bps")
    df = df.withColumn("net_edge_bps", base - F.col("total_cost_bps"))
    warn = F.concat_ws(", ", F.when(~F.col("liquidity_ok"), "LOW LIQUIDITY"), F.when(~F.col("spread_ok"), "WIDE SPREAD"),
                       F.when(~F.col("strike_ok"), "STRIKE UNAVAILABLE"))
    return df.withColumn("rationale", F.when(
        F.col("signal_type") == "no_trade", "NO_TRADE: model and market volatility agree").otherwise(F.concat(
            F.upper("signal_type"), F.format_string(": model %.3f against market %.3f, net edge %.0f bps", F.col("model_iv"), F.col("market_iv"), F.col("net_edge_bps")),
            F.when(warn != "", F.concat(F.lit("; "), warn)).otherwise(F.lit("")))))


def tradeable(signals: DataFrame, min_edge: float = 50.0) -> DataFrame:
    return fence(signals).where((F.col("net_edge_bps") >= min_edge) & F.col("liquidity_ok") & F.col("spread_ok")
                         & F.col("strike_ok") & (F.col("signal_type") != "no_trade"))


def cost_stress(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Net edge per cost scenario and liquidity verdicts with half the interest or volume."""
    e, s, c = F.col("edge_bps"), F.col("spread_cost_bps"), F.col("commission_bps")
    half_oi, half_v = F.col("open_interest") * 0.5 >= MIN_INTEREST, F.col("volume") * 0.5 >= MIN_VOLUME
    no = F.lit(False)

    def row(name, edge, ok):
        return F.struct(F.lit(name).alias("scenario"), edge.cast("double").alias("net_edge_bps"), F.coalesce(ok, no).alias("tradeable"))

    gone = F.lit(None).cast("double")
    rows = F.array(
        row("base_case", F.col("net_edge_bps"), F.col("liquidity_ok")), row("spread_2x", e - 2 * s - c, F.col("liquidity_ok")),
        row("spread_3x", e - 3 * s - c, F.col("liquidity_ok")), row("commission_2x", e - s - 2 * c, F.col("liquidity_ok")),
        row("all_costs_2x", e - 2 * (s + c), F.col("liquidity_ok")), row("oi_50pct_drop", gone, half_oi),
        row("volume_50pct_drop", gone, half_v), row("both_50pct_drop", gone, half_oi & half_v))
    return signals.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


# Direction, structure, action pattern and hedge policy per signal type.
STRUCTURES = {
    "long_call": ("Long volatility, bullish convexity", "Single-leg long call", "BUY 1 call @ K=%.2f", "delta_threshold"),
    "short_call": ("Short volatility, bearish/upside-capped", "Single-leg short call", "SELL 1 call @ K=%.2f", "delta_threshold"),
    "long_put": ("Long volatility, bearish convexity", "Single-leg long put", "BUY 1 put @ K=%.2f", "delta_threshold"),
    "short_put": ("Short volatility, bullish/downside-risk", "Single-leg short put", "SELL 1 put @ K=%.2f", "delta_threshold"),
    "long_straddle": ("Long volatility wings/ATM expansion", "Delta-hedged long straddle", "BUY 1 call + BUY 1 put @ K=%.2f", "delta_daily"),
    "short_straddle": ("Short volatility mean-reversion", "Delta-hedged short straddle", "SELL 1 call + SELL 1 put @ K=%.2f", "delta_daily"),
}


def trade_intents(signals: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Intent per signal: id SYM-type-nnn, structure text, holding horizon, hedge policy.

    The ordinal numbers a symbol's signals, which are at most the contracts of one chain.
    """
    df = signals.where("signal_type <> 'no_trade'")
    df = df.withColumn("ordinal", F.row_number().over(Window.partitionBy("symbol").orderBy(*order)))

    def pick(i):
        out = F.lit(None).cast("string")
        for k, v in STRUCTURES.items():
            text = F.format_string(v[i], F.col("strike")) if i == 2 else F.lit(v[i])
            out = F.when(F.col("signal_type") == k, text).otherwise(out)
        return out

    days = F.greatest(F.col("time_to_maturity") * 365.0, F.lit(1.0))
    return df.withColumns({
        "intent_id": F.concat(F.upper("symbol"), F.lit("-"), F.col("signal_type"), F.lit("-"), F.when(
            F.col("ordinal") < 1000, F.lpad(F.col("ordinal").cast("string"), 3, "0")).otherwise(F.col("ordinal").cast("string"))),
        "trade_direction": pick(0), "structure": pick(1), "action_summary": pick(2), "hedge_policy": pick(3),
        "maturity_days": days,
        "holding_horizon_days": F.greatest(F.lit(3.0), F.least(F.lit(30.0), days * 0.35)).cast("int"),
    })


# ---- multi-leg strategies -------------------------------------------------------------------

def _leg_delta(kind: Column, money: Column) -> Column:
    near = money.between(0.95, 1.05)
    call = F.when(near, 0.5).when(money > 1.05, 0.2).otherwise(0.8)
    put = F.when(near, -0.5).when(money < 0.95, -0.2).otherwise(-0.8)
    return F.when(kind == "call", call).otherwise(put)


def strategy_summary(legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edge, cost, proxy greeks, flags and confidence of strategies from their leg rows.

    Legs carry ``side`` +1/-1, option_type, strike, spot, time_to_maturity, model_iv, market_iv and quotes.
    """
    legs = reality_flags(legs)
    side, money = F.col("side"), F.col("strike") / F.col("spot")
    g = legs.groupBy(*keys).agg(
        F.sum(side * (F.col("model_iv") - F.col("market_iv")) * 10000).alias("edge_bps"),
        F.sum(spread_cost_bps(F.col("bid"), F.col("ask")) + COMMISSION_BPS).alias("cost_bps"),
        F.sum(side * _leg_delta(F.col("option_type"), money)).alias("delta"),
        F.sum(side * F.when(money.between(0.95, 1.05), 0.05).otherwise(0.01)).alias("gamma"),
        F.sum(side * F.col("time_to_maturity") * 20).alias("vega"),
        F.sum(side).alias("_net"), F.avg("time_to_maturity").alias("_t"),
        F.sum(F.when(side > 0, F.col("ask")).otherwise(-F.col("bid"))).alias("net_debit"),
        F.bool_and("strike_ok").alias("strikes_ok"), F.bool_and("liquidity_ok").alias("liquidity_ok"),
        F.bool_and("spread_ok").alias("spreads_ok"))
    g = g.withColumn("net_edge_bps", F.col("edge_bps") - F.col("cost_bps"))
    lack = (F.when(F.col("strikes_ok"), 0.0).otherwise(0.4) + F.when(F.col("liquidity_ok"), 0.0).otherwise(0.3)
            + F.when(F.col("spreads_ok"), 0.0).otherwise(0.3))
    conf = F.greatest(F.least(F.col("net_edge_bps") / 200, F.lit(1.0)) - lack, F.lit(0.0))
    return g.withColumns({
        "theta": F.col("_net") * (-5 / F.sqrt("_t")),
        "confidence": F.when(F.col("net_edge_bps") < 0, 0.0).otherwise(conf),
    }).drop("_net", "_t")


def payoff_bounds(df: DataFrame) -> DataFrame:
    """Maximum profit, loss and breakevens by strategy; an unlimited side is null with a flag.

    Needs strategy, low_strike, high_strike and net_debit.
    """
    st, lo, hi, d = (F.col(c) for c in ("strategy", "low_strike", "high_strike", "net_debit"))
    return df.withColumns({
        "max_profit": F.when(st == "bull_call_spread", hi - lo - d).when(st == "calendar_spread", lo * 0.05).when(st == "short_strangle", -d),
        "max_loss": F.when(st == "risk_reversal", lo + d).when(st != "short_strangle", d),
        "unlimited_profit": st.isin("long_strangle", "risk_reversal"),
        "unlimited_loss": st == "short_strangle",
        "breakeven_low": F.when(st == "bull_call_spread", lo + d).when(st == "calendar_spread", lo).when(
            st == "risk_reversal", hi + d).otherwise(lo - F.abs(d)),
        "breakeven_high": F.when(st.isin("long_strangle", "short_strangle"), hi + F.abs(d)),
    })


def nearest_leg(quotes: DataFrame, kind: str, ratio: float, alias: str) -> DataFrame:
    """Per expiry, the quote of one type whose strike is nearest to ratio x spot."""
    row = F.struct("strike", "spot", "time_to_maturity", "model_iv", "market_iv", "bid", "ask", "volume", "open_interest", "option_type")
    gap = F.struct(F.abs(F.col("strike") - F.col("spot") * ratio), F.col("strike"))
    return quotes.where(F.col("option_type") == kind).groupBy("symbol", "snapshot_date", "expiry").agg(F.min_by(row, gap).alias(alias))


def build_strategies(quotes: DataFrame) -> DataFrame:
    """Bull call spread, long and short strangle, risk reversal per expiry, and a calendar spread
    over each pair of neighbouring expiries. Legs are picked by aggregation, never by pairing quotes."""
    keys = ["symbol", "snapshot_date", "expiry"]
    atm = nearest_leg(quotes, "call", 1.0, "atm")
    up = nearest_leg(quotes, "call", 1.03, "up")
    down = nearest_leg(quotes, "put", 0.97, "down")
    legs = atm.join(up, keys).join(down, keys)

    def pack(name, lo, hi, *parts):
        return F.struct(F.lit(name).alias("strategy"), lo["strike"].alias("low_strike"), hi["strike"].alias("high_strike"),
                        F.array(*[F.struct(F.lit(s).alias("side"), leg.alias("leg")) for s, leg in parts]).alias("legs"))

    a, u, d = F.col("atm"), F.col("up"), F.col("down")
    one = legs.where("atm.strike < up.strike").select(*keys, F.explode(F.array(
        pack("bull_call_spread", a, u, (1, a), (-1, u)), pack("long_strangle", d, u, (1, d), (1, u)),
        pack("short_strangle", d, u, (-1, d), (-1, u)), pack("risk_reversal", d, u, (1, u), (-1, d)))).alias("s"))
    # same strike in the next expiry: neighbour by window over one contract line
    line = quotes.where("option_type = 'call'")
    w = Window.partitionBy("symbol", "snapshot_date", "strike").orderBy("expiry")
    row = F.struct("strike", "spot", "time_to_maturity", "model_iv", "market_iv", "bid", "ask", "volume", "open_interest", "option_type")
    cal = line.withColumns({"near": row, "far": F.lead(row).over(w)}).where("far is not null")
    n, f = F.col("near"), F.col("far")
    two = cal.select(*keys, pack("calendar_spread", n, f, (-1, n), (1, f)).alias("s"))
    both = one.unionByName(two).select(*keys, "s.*")
    exploded = both.select(*keys, "strategy", "low_strike", "high_strike", F.explode("legs").alias("l")).select(
        *keys, "strategy", "low_strike", "high_strike", "l.side", "l.leg.*")
    return payoff_bounds(strategy_summary(exploded, [*keys, "strategy", "low_strike", "high_strike"]))
