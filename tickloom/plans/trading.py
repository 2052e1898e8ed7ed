"""Signals, portfolio, fills, backtests, stress and risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import backtest as bt, options as op, portfolio as pf, signals as sg
from tickloom.plans import views_sql as v
from tickloom.plans.chain import CK, QUOTES_SQL, R, SABR_SQL, cleaned, sabr_fixed
from tickloom.plans.features import PATH_CTE
from tickloom.plans.registry import query, rounded, sql_rounded
from tickloom.sources import tables as t

# ---- signals --------------------------------------------------------------------------------

SIGNAL_SQL = f"""{QUOTES_SQL}, {SABR_SQL.format(src='clean')},
s0 AS (SELECT *, true_vol AS market_iv, model_iv - true_vol AS diff, coalesce(open_interest >= 100 AND volume >= 20, false) AS liquidity_ok,
  coalesce(bid > 0 AND ask > 0 AND spread_pct <= 0.10, false) AS spread_ok, bid IS NOT NULL AS strike_ok,
  CASE WHEN bid > 0 AND ask > 0 THEN spread_pct / 2 * 10000 ELSE 500 END AS spread_cost_bps FROM sb),
sig AS (SELECT *, diff * 10000 AS edge_bps, CASE WHEN abs(diff) < 0.02 THEN 'no_trade'
    WHEN moneyness BETWEEN 0.95 AND 1.05 THEN CASE WHEN diff > 0.02 THEN 'long_straddle' ELSE 'short_straddle' END
    WHEN moneyness > 1.05 THEN CASE WHEN diff > 0.02 THEN 'long_call' ELSE 'short_call' END
    ELSE CASE WHEN diff > 0.02 THEN 'long_put' ELSE 'short_put' END END AS signal_type,
  CASE WHEN abs(diff) < 0.02 THEN 0 ELSE least(abs(diff) / 0.10, 1) END AS confidence, abs(diff * 10000) - (spread_cost_bps + 130) AS net_edge_bps FROM s0)"""


def signals(spark, d, edge="absolute"):
    q = sabr_fixed(cleaned(spark, d)).withColumn("market_iv", F.col("true_vol"))
    return sg.single_leg_signals(q, edge)


_SIG = ["edge_bps", "confidence", "spread_cost_bps", "net_edge_bps"]
_SIGK = CK + ["signal_type", "liquidity_ok", "spread_ok", "strike_ok"]


@query("volatility_signals", "Q8 P12", f"WITH {SIGNAL_SQL} SELECT {sql_rounded(_SIGK, _SIG, 4)} FROM sig")
def volatility_signals(spark, d):
    return rounded(signals(spark, d), _SIGK, _SIG, 4)


@query("tradeable_signals", "P11 O4", f"""WITH {SIGNAL_SQL} SELECT {sql_rounded(CK + ['signal_type'], ['net_edge_bps'], 4)} FROM sig
WHERE net_edge_bps >= 50 AND liquidity_ok AND spread_ok AND strike_ok AND signal_type <> 'no_trade'
ORDER BY net_edge_bps DESC, symbol, days_to_expiry, strike, option_type""")
def tradeable_signals(spark, d):
    s = sg.tradeable(signals(spark, d)).orderBy(F.desc("net_edge_bps"), *CK)
    return rounded(s, CK + ["signal_type"], ["net_edge_bps"], 4)


@query("signals_signed_edge", "Q8 P11", f"""WITH {SIGNAL_SQL} SELECT signal_type, count(*) AS signals FROM sig
WHERE edge_bps - spread_cost_bps - 130 >= 50 AND liquidity_ok AND spread_ok AND strike_ok AND signal_type <> 'no_trade' GROUP BY 1""")
def signals_signed_edge(spark, d):
    return sg.tradeable(signals(spark, d, "signed")).groupBy("signal_type").agg(F.count(F.lit(1)).alias("signals"))


@query("signal_cost_stress", "Q9", f"""WITH {SIGNAL_SQL}, st AS (
  SELECT *, 'base_case' AS scenario, net_edge_bps AS e, liquidity_ok AS ok FROM sig
  UNION ALL SELECT *, 'spread_2x', edge_bps - 2 * spread_cost_bps - 130, liquidity_ok FROM sig
  UNION ALL SELECT *, 'spread_3x', edge_bps - 3 * spread_cost_bps - 130, liquidity_ok FROM sig
  UNION ALL SELECT *, 'commission_2x', edge_bps - spread_cost_bps - 260, liquidity_ok FROM sig
  UNION ALL SELECT *, 'all_costs_2x', edge_bps - 2 * (spread_cost_bps + 130), liquidity_ok FROM sig
  UNION ALL SELECT *, 'oi_50pct_drop', NULL, coalesce(open_interest * 0.5 >= 100, false) FROM sig
  UNION ALL SELECT *, 'volume_50pct_drop', NULL, volume * 0.5 >= 20 FROM sig
  UNION ALL SELECT *, 'both_50pct_drop', NULL, coalesce(open_interest * 0.5 >= 100, false) AND volume * 0.5 >= 20 FROM sig)
SELECT symbol, days_to_expiry, strike, option_type, scenario, round(e, 4) + 0.0 AS net_edge_bps, ok AS tradeable FROM st""")
def signal_cost_stress(spark, d):
    return sg.cost_stress(signals(spark, d), CK).withColumn("net_edge_bps", F.round("net_edge_bps", 4))


INTENT_SQL = f"""{SIGNAL_SQL}, ti AS (SELECT *, greatest(time_to_maturity * 365.0e0, 1) AS maturity_days,
  row_number() OVER (PARTITION BY symbol ORDER BY net_edge_bps DESC, days_to_expiry, strike, option_type) AS ordinal FROM sig
  WHERE net_edge_bps >= 50 AND liquidity_ok AND spread_ok AND strike_ok AND signal_type <> 'no_trade'),
intents AS (SELECT *, upper(symbol) || '-' || signal_type || '-' || CASE WHEN ordinal < 1000 THEN lpad(CAST(ordinal AS VARCHAR), 3, '0') ELSE CAST(ordinal AS VARCHAR) END AS intent_id,
  CAST(trunc(greatest(3, least(30, maturity_days * 0.35e0))) AS INTEGER) AS holding_horizon_days,
  CASE WHEN signal_type LIKE 'long%' THEN 'buy' ELSE 'sell' END AS side, CASE WHEN signal_type LIKE '%put' THEN 'put' ELSE 'call' END AS kind FROM ti)"""


def intents(spark, d):
    return sg.trade_intents(sg.tradeable(signals(spark, d)), [F.desc("net_edge_bps"), "days_to_expiry", "strike", "option_type"])


@query("trade_intents", "Q11", f"""WITH {INTENT_SQL} SELECT intent_id, symbol, strike, holding_horizon_days, round(net_edge_bps, 4) AS net_edge_bps,
  CASE signal_type WHEN 'long_call' THEN printf('BUY 1 call @ K=%.2f', strike) WHEN 'short_call' THEN printf('SELL 1 call @ K=%.2f', strike)
    WHEN 'long_put' THEN printf('BUY 1 put @ K=%.2f', strike) WHEN 'short_put' THEN printf('SELL 1 put @ K=%.2f', strike)
    WHEN 'long_straddle' THEN printf('BUY 1 call + BUY 1 put @ K=%.2f', strike) ELSE printf('SELL 1 call + SELL 1 put @ K=%.2f', strike) END AS action_summary FROM intents""")
def trade_intents(spark, d):
    return intents(spark, d).select("intent_id", "symbol", "strike", "holding_horizon_days", F.round("net_edge_bps", 4).alias("net_edge_bps"), "action_summary")


CAND_SQL = f"""{INTENT_SQL}, cands AS (SELECT intent_id, symbol, kind AS option_type, side, strike, spot, maturity_days, confidence, net_edge_bps AS expected_net_edge_bps,
  bid, ask, mid_price AS mid, coalesce(volume, 0) AS volume, coalesce(open_interest, 0) AS open_interest, CASE WHEN kind = 'call' THEN 0.5e0 ELSE -0.5e0 END AS delta,
  greatest(0.05e0, 2.0e0 / greatest(spot, 1) / greatest(sqrt(greatest(maturity_days / 365, 1 / 365.0e0)), 0.08e0)) AS gamma,
  greatest(5.0e0, 20.0e0 * sqrt(greatest(maturity_days / 365, 1 / 365.0e0)) * (1 - least(abs(strike / spot - 1), 0.3e0))) AS vega,
  greatest(1.0e0, 0.10e0 * greatest(mid_price * 100, 1) / greatest(holding_horizon_days, 1)) AS theta,
  greatest(mid_price * 100 + greatest(ask - bid, 0) * 100, 1.0e0) AS stress_loss_per_contract FROM intents)"""
_CAND = ["maturity_days", "confidence", "expected_net_edge_bps", "mid", "delta", "gamma", "vega", "theta", "stress_loss_per_contract"]


def cands(spark, d):
    return pf.candidates(intents(spark, d))


@query("position_candidates", "Q12 J18", f"""WITH {CAND_SQL} SELECT {sql_rounded(['intent_id', 'symbol', 'option_type', 'side', 'strike', 'volume', 'open_interest'], _CAND, 4)} FROM cands""")
def position_candidates(spark, d):
    return rounded(cands(spark, d), ["intent_id", "symbol", "option_type", "side", "strike", "volume", "open_interest"], _CAND, 4)


@query("candidate_priority", "O7", f"""WITH {CAND_SQL} SELECT symbol, intent_id, row_number() OVER (PARTITION BY symbol ORDER BY
  greatest(expected_net_edge_bps, 0) * greatest(confidence, 0.01e0) / greatest(abs(vega), 1e-9) DESC, intent_id) AS priority FROM cands""")
def candidate_priority(spark, d):
    return pf.prioritise(cands(spark, d)).select("symbol", "intent_id", F.col("priority").cast("long").alias("priority"))


SIZED_SQL = f"""WITH RECURSIVE {CAND_SQL}, ord AS (SELECT *, greatest(mid, 0.01e0) * 100 AS cash, CAST(round_even(maturity_days, 0) AS BIGINT) AS days, CAST(round_even(strike, 0) AS BIGINT) AS unit,
  CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sg, row_number() OVER (PARTITION BY symbol ORDER BY
  greatest(expected_net_edge_bps, 0) * greatest(confidence, 0.01e0) / greatest(abs(vega), 1e-9) DESC, intent_id) AS priority FROM cands),
walk AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS priority, CAST(0 AS BIGINT) AS contracts, 0.0e0 AS used, 0.0e0 AS total, CAST([] AS STRUCT(d BIGINT, u BIGINT, s DOUBLE)[]) AS held FROM ord
  UNION ALL SELECT symbol, priority, contracts, used + contracts * cash, total + sg * vega * contracts,
    CASE WHEN contracts > 0 THEN list_append(held, {{'d': days, 'u': unit, 's': contracts * cash}}) ELSE held END
  FROM (SELECT o.symbol, o.priority, o.cash, o.sg, o.vega, o.days, o.unit, w.used, w.total, w.held,
    CAST(greatest(0, least(floor(greatest(8000 - abs(w.total), 0) / greatest(abs(o.vega), 1e-9)), floor((250000 * 0.35e0 - w.used) / o.cash), 50,
      floor(greatest(least(250000 * 0.20e0 - w.used, 250000 * 0.15e0 - coalesce(list_sum(list_transform(list_filter(w.held, lambda x: x.d = o.days), lambda x: x.s)), 0),
        250000 * 0.10e0 - coalesce(list_sum(list_transform(list_filter(w.held, lambda x: x.u = o.unit), lambda x: x.s)), 0)), 0) / o.cash))) AS BIGINT) AS contracts
    FROM walk w JOIN ord o ON o.symbol = w.symbol AND o.priority = w.priority + 1) step),
sized AS (SELECT o.intent_id, o.symbol, o.option_type, o.side, o.strike, CAST(w.contracts AS INTEGER) AS contracts, w.contracts * o.cash AS premium_notional, o.sg * o.delta * w.contracts AS delta,
  o.sg * o.gamma * w.contracts AS gamma, o.sg * o.vega * w.contracts AS vega, o.sg * o.theta * w.contracts AS theta, o.stress_loss_per_contract * w.contracts AS stress_loss
  FROM walk w JOIN ord o USING (symbol, priority) WHERE w.contracts > 0)"""
_SIZED = ["premium_notional", "delta", "gamma", "vega", "theta", "stress_loss"]


@query("sized_positions", "Q13", f"{SIZED_SQL} SELECT {sql_rounded(['intent_id', 'symbol', 'option_type', 'side', 'strike', 'contracts'], _SIZED, 4)} FROM sized")
def sized_positions(spark, d):
    s = pf.size_positions(cands(spark, d))
    return rounded(s, ["intent_id", "symbol", "option_type", "side", "strike", "contracts"], _SIZED, 4)


@query("intent_market_join", "J18", f"""WITH {INTENT_SQL} SELECT i.intent_id, i.symbol, c.bid, coalesce(c.ask, 0.01) AS ask, coalesce(c.volume, 0) AS volume
FROM intents i LEFT JOIN (SELECT * FROM chain WHERE open_interest >= 150) c ON i.symbol = c.symbol AND i.expiry = c.expiry AND i.strike = c.strike AND i.option_type = c.option_type""")
def intent_market_join(spark, d):
    """Quotes are keyed by the full contract, with defaults where one is missing."""
    i = intents(spark, d).select("intent_id", *CK)
    q = t.chain(spark, d).where("open_interest >= 150").select(*CK, "bid", "ask", "volume")
    return i.join(q, CK, "left").select("intent_id", "symbol", "bid", F.coalesce("ask", F.lit(0.01)).alias("ask"), F.coalesce("volume", F.lit(0)).alias("volume"))


# positions by rule: every cleaned quote is held, so that later steps have a plain SQL form
RULE_SQL = f"""{QUOTES_SQL}, pos AS (SELECT *, symbol || '-' || CAST(days_to_expiry AS VARCHAR) || '-' || CAST(grid AS VARCHAR) || '-' || option_type AS intent_id,
    CASE WHEN grid % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, CAST(1 + grid % 9 AS INTEGER) AS contracts, days_to_expiry * 1.0e0 AS maturity_days, mid_price AS mid,
    CASE WHEN grid % 3 = 0 THEN -1 ELSE 1 END * (1 + grid % 9) AS sg FROM (SELECT *, CAST(floor(strike * 10 + 0.5e0) AS BIGINT) AS grid FROM clean) x),
tg AS (SELECT *, contracts * mid * 100 AS premium_notional, sg * CASE WHEN option_type = 'call' THEN 0.5e0 ELSE -0.5e0 END AS delta, sg * 0.012e0 AS gamma,
  sg * 10.5e0 AS vega, sg * -6.5e0 AS theta, contracts * (mid * 100 + (ask - bid) * 100) AS stress_loss FROM pos)"""


def rule_targets(spark, d):
    q = cleaned(spark, d)
    grid = F.floor(F.col("strike") * 10 + 0.5).cast("long")
    q = q.withColumns({"grid": grid})
    sell = F.col("grid") % 3 == 0
    q = q.withColumns({
        "intent_id": F.concat_ws("-", "symbol", "days_to_expiry", "grid", "option_type"), "side": F.when(sell, "sell").otherwise("buy"),
        "contracts": (1 + F.col("grid") % 9).cast("int"), "maturity_days": F.col("days_to_expiry").cast("double"), "mid": F.col("mid_price")})
    sgn = F.when(sell, -1.0).otherwise(1.0) * F.col("contracts")
    return q.withColumns({
        "premium_notional": F.col("contracts") * F.col("mid") * 100, "delta": sgn * F.when(F.col("option_type") == "call", 0.5).otherwise(-0.5),
        "gamma": sgn * 0.012, "vega": sgn * 10.5, "theta": sgn * -6.5,
        "stress_loss": F.col("contracts") * (F.col("mid") * 100 + (F.col("ask") - F.col("bid")) * 100)})


_NET = ["premium_notional", "delta", "gamma", "vega", "theta", "stress_loss"]


@query("netted_positions", "Q14", f"""WITH {RULE_SQL}, m AS (SELECT * FROM tg UNION ALL SELECT * REPLACE (CASE WHEN side = 'buy' THEN 'sell' ELSE 'buy' END AS side, CAST(1 + contracts % 4 AS INTEGER) AS contracts,
    -delta * (1 + contracts % 4) / contracts AS delta, -gamma * (1 + contracts % 4) / contracts AS gamma, -vega * (1 + contracts % 4) / contracts AS vega, -theta * (1 + contracts % 4) / contracts AS theta,
    premium_notional * (1 + contracts % 4) / contracts AS premium_notional, stress_loss * (1 + contracts % 4) / contracts AS stress_loss) FROM tg),
n AS (SELECT symbol, option_type, round(strike, 4) AS strike, round(maturity_days, 2) AS maturity_days, CAST(sum(CASE WHEN side = 'buy' THEN contracts ELSE -contracts END) AS BIGINT) AS net,
  sum(contracts) AS gross, sum(delta) AS delta, sum(gamma) AS gamma, sum(vega) AS vega, sum(theta) AS theta, sum(premium_notional) AS p, sum(stress_loss) AS s FROM m GROUP BY ALL),
o AS (SELECT *, CASE WHEN net > 0 THEN 'buy' ELSE 'sell' END AS side, abs(net) AS contracts, p * abs(net) / gross AS premium_notional, s * abs(net) / gross AS stress_loss FROM n WHERE net <> 0)
SELECT {sql_rounded(['symbol', 'option_type', 'strike', 'maturity_days', 'side', 'contracts'], _NET, 4)} FROM o""")
def netted_positions(spark, d):
    """Targets netted against a smaller opposite position in the same contract."""
    a = rule_targets(spark, d)
    k = 1 + F.col("contracts") % 4
    b = a.withColumns({
        **{g: -F.col(g) * k / F.col("contracts") for g in ("delta", "gamma", "vega", "theta")},
        **{g: F.col(g) * k / F.col("contracts") for g in ("premium_notional", "stress_loss")},
        "side": F.when(F.col("side") == "buy", "sell").otherwise("buy"), "contracts": k.cast("int")})
    n = pf.net_positions(a.unionByName(b))
    return rounded(n, ["symbol", "option_type", "strike", "maturity_days", "side", "contracts"], _NET, 4)


_BOOK = ["net_delta", "net_gamma", "net_vega", "net_theta", "gross_premium", "total_stress_loss"]


@query("book_totals", "A20 Q15", f"""WITH {RULE_SQL}, g AS (SELECT symbol, sum(delta) AS net_delta, sum(gamma) AS net_gamma, sum(vega) AS net_vega, sum(theta) AS net_theta,
  sum(abs(premium_notional)) AS gross_premium, sum(stress_loss) AS total_stress_loss FROM tg GROUP BY 1)
SELECT {sql_rounded(['symbol'], _BOOK, 3)}, CASE WHEN abs(net_delta) >= 25 THEN round_even(-net_delta, 0) + 0.0e0 ELSE 0.0e0 END AS delta_hedge_shares FROM g""")
def book_totals(spark, d):
    b = pf.book_totals(rule_targets(spark, d), ["symbol"])
    return rounded(b, ["symbol", "delta_hedge_shares"], _BOOK, 3)


FILL_SQL = f"""{RULE_SQL}, f0 AS (SELECT *, CASE WHEN coalesce(open_interest, 0) < 100 THEN 'min_open_interest_fail' WHEN volume < 20 THEN 'min_volume_fail'
    WHEN contracts > floor(greatest(volume, 1) * 0.10e0) THEN 'max_participation_fail' WHEN ask <= 0 OR bid < 0 OR ask < bid THEN 'bad_quote' ELSE 'filled' END AS reason,
  CASE WHEN side = 'buy' THEN (mid + 0.25e0 * greatest(ask - bid, 0)) * 1.001e0 ELSE greatest((mid - 0.25e0 * greatest(ask - bid, 0)) * 0.999e0, 0) END AS px FROM tg),
fl AS (SELECT *, reason = 'filled' AS accepted, CASE WHEN reason = 'filled' THEN contracts ELSE 0 END AS filled_contracts, CASE WHEN reason = 'filled' THEN px ELSE 0 END AS fill_price,
  CASE WHEN reason = 'filled' THEN contracts * 0.65e0 ELSE 0 END AS estimated_fees,
  CASE WHEN reason = 'filled' THEN CASE WHEN side = 'buy' THEN px * 100 * contracts + contracts * 0.65e0 ELSE -px * 100 * contracts + contracts * 0.65e0 END ELSE 0 END AS total_cash_impact FROM f0)"""


def rule_fills(spark, d):
    tg = rule_targets(spark, d)
    return tg, pf.simulate_fills(tg, tg)


@query("simulated_fills", "P13 Q16 J20", f"WITH {FILL_SQL} SELECT {sql_rounded(['intent_id', 'accepted', 'reason', 'filled_contracts'], ['fill_price', 'estimated_fees', 'total_cash_impact'], 8)} FROM fl")
def simulated_fills(spark, d):
    _, f = rule_fills(spark, d)
    return rounded(f, ["intent_id", "accepted", "reason", "filled_contracts"], ["fill_price", "estimated_fees", "total_cash_impact"], 8)


# the positions of every brand are run on the path of one bar symbol each
_RUN_SYMBOL = "CASE CAST(regexp_extract(symbol, '(\\d+)$', 1) AS INTEGER) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END"


def _on_path(df):
    k = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int") % 3
    return df.withColumn("symbol", F.when(k == 0, "A").when(k == 1, "N").otherwise("R"))


def backtest(spark, d, cfg=bt.Config()):
    tg, f = rule_fills(spark, d)
    tg = _on_path(tg)
    return bt.daily_pnl(tg, f.drop("symbol"), tg, bt.market_path(t.bars_daily(spark, d)), cfg)


def _day_sql(hedge: str, running: bool = False) -> str:
    return f"""{FILL_SQL}, {v.BARS}, {PATH_CTE},
h0 AS (SELECT {_RUN_SYMBOL} AS sym, *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS sgn FROM fl WHERE accepted AND filled_contracts > 0),
h1 AS (SELECT *, sgn * delta AS xd, sgn * gamma AS xg, sgn * vega AS xv, sgn * theta AS xt, sum(sgn * delta) OVER (PARTITION BY sym ORDER BY intent_id) AS run FROM h0),
h2 AS (SELECT *, {"CASE WHEN abs(run) >= 25 THEN round_even(-run, 0) ELSE 0 END"} AS sh FROM h1),
bk0 AS (SELECT sym AS symbol, sum(xd) AS net_delta, sum(xg) AS net_gamma, sum(xv) AS net_vega, sum(xt) AS net_theta, sum(abs(fill_price * 100 * contracts)) AS cap,
  sum(sgn * (mid - fill_price) * 100 * contracts) AS rl, sum(contracts * greatest(ask - bid, 0) * 100 * 0.5e0 + contracts * 1.3e0) AS tc,
  sum((mid + fill_price) * 100 * contracts) AS tn, sum(sh) AS rsh, sum(abs(sh)) AS rab FROM h2 GROUP BY 1),
bk AS (SELECT *, {hedge} FROM bk0),
p1 AS (SELECT *, row_number() OVER {v.LINE} AS day FROM path),
ex AS (SELECT symbol, min(day) AS exit_day FROM p1 WHERE day >= 20 OR (abs(iv_change_points) < 0.5e0 AND day >= 6) GROUP BY 1),
dd0 AS (SELECT p1.*, bk.* EXCLUDE (symbol), coalesce(day <= exit_day, false) AS live, coalesce(day = exit_day, false) AS closing FROM p1 LEFT JOIN bk USING (symbol) LEFT JOIN ex USING (symbol)),
dd1 AS (SELECT symbol, date, regime, CASE WHEN live THEN net_delta * dspot * 100 ELSE 0 END AS delta_pnl, CASE WHEN live THEN 0.5e0 * net_gamma * dspot * dspot * 100 ELSE 0 END AS gamma_pnl,
  CASE WHEN live THEN net_vega * iv_change_points ELSE 0 END AS vega_pnl, CASE WHEN live THEN net_theta ELSE 0 END AS theta_pnl,
  CASE WHEN live THEN shares * dspot ELSE 0 END AS hedge_pnl, CASE WHEN live THEN ab * abs(dspot) * 0.0005e0 + ab * 0.005e0 ELSE 0 END AS hedge_costs,
  CASE WHEN closing THEN rl ELSE 0 END AS realized_pnl, CASE WHEN closing THEN tc ELSE 0 END AS transaction_costs, CASE WHEN closing THEN tn ELSE 0 END AS turnover_usd,
  CASE WHEN live THEN cap ELSE 0 END AS capital_used_usd FROM dd0),
dd2 AS (SELECT *, delta_pnl + gamma_pnl + vega_pnl + theta_pnl AS mtm_pnl FROM dd1),
dd3 AS (SELECT *, mtm_pnl + realized_pnl + hedge_pnl - hedge_costs - transaction_costs AS total_pnl FROM dd2),
dd4 AS (SELECT *, 250000 + sum(total_pnl) OVER {v.SOFAR} AS equity FROM dd3),
dd5 AS (SELECT *, greatest(max(equity) OVER {v.SOFAR}, 250000) AS peak FROM dd4),
daily AS (SELECT *, CASE WHEN peak <= 0 THEN 0 ELSE (peak - equity) / peak END AS drawdown_pct, capital_used_usd / 250000 AS capital_used_pct FROM dd5)"""


DAY_SQL = _day_sql("CASE WHEN abs(net_delta) >= 25 THEN round_even(-net_delta, 0) ELSE 0 END AS shares, abs(CASE WHEN abs(net_delta) >= 25 THEN round_even(-net_delta, 0) ELSE 0 END) AS ab")
_PNL = ["mtm_pnl", "realized_pnl", "hedge_pnl", "hedge_costs", "transaction_costs", "total_pnl", "equity"]


@query("backtest_daily", "Q17 J12 J20 W35", f"WITH {DAY_SQL} SELECT symbol, date, regime, {', '.join(f'round({c} / 1e6, 4) + 0.0 AS {c}' for c in _PNL)}, round(drawdown_pct, 6) + 0.0 AS drawdown_pct FROM daily")
def backtest_daily(spark, d):
    b = backtest(spark, d)
    return b.select("symbol", "date", "regime", *[F.round(F.col(c) / 1e6, 4).alias(c) for c in _PNL], F.round("drawdown_pct", 6).alias("drawdown_pct"))


@query("backtest_running_hedge", "Q17 Q15", f"WITH {_day_sql('rsh AS shares, rab AS ab')} SELECT symbol, date, {', '.join(f'round({c} / 1e6, 4) + 0.0 AS {c}' for c in ('hedge_pnl', 'hedge_costs', 'total_pnl'))} FROM daily")
def backtest_running_hedge(spark, d):
    b = backtest(spark, d, bt.Config(running_hedge=True))
    return b.select("symbol", "date", *[F.round(F.col(c) / 1e6, 4).alias(c) for c in ("hedge_pnl", "hedge_costs", "total_pnl")])


@query("pnl_attribution", "A18", f"""WITH {DAY_SQL} SELECT symbol, round((sum(mtm_pnl - (delta_pnl + gamma_pnl + vega_pnl + theta_pnl + hedge_pnl))) / 1e6, 4) + 0.0 AS model_edge_capture,
  round((sum(hedge_pnl - hedge_costs)) / 1e6, 4) + 0.0 AS delta_hedge_contribution, round((sum(vega_pnl)) / 1e6, 4) + 0.0 AS vega_exposure, round((sum(theta_pnl)) / 1e6, 4) + 0.0 AS theta_carry,
  round((sum(transaction_costs + hedge_costs)) / 1e6, 4) + 0.0 AS execution_cost, round((sum(transaction_costs * 0.5e0)) / 1e6, 4) + 0.0 AS spread_crossing,
  round((coalesce(sum(total_pnl) FILTER (WHERE regime = 'crisis'), 0)) / 1e6, 4) + 0.0 AS crisis_pnl, round((coalesce(sum(total_pnl) FILTER (WHERE regime = 'normal'), 0)) / 1e6, 4) + 0.0 AS normal_pnl FROM daily GROUP BY 1""")
def pnl_attribution(spark, d):
    a = bt.attribution(backtest(spark, d), ["symbol"])
    names = ["model_edge_capture", "delta_hedge_contribution", "vega_exposure", "theta_carry", "execution_cost", "spread_crossing"]
    by = lambda k: F.round(F.coalesce(F.element_at("regime_performance", F.lit(k)), F.lit(0.0)) / 1e6, 4).alias(f"{k}_pnl")
    return a.select("symbol", *[F.round(F.col(c) / 1e6, 4).alias(c) for c in names], by("crisis"), by("normal"))


_SUM = ["total_pnl", "gross_before_costs", "total_costs", "turnover_usd"]
_SUM2 = ["max_drawdown_pct", "average_capital_used_pct", "sharpe", "total_return_pct"]


@query("backtest_summary", "A19", f"""WITH {DAY_SQL}, s AS (SELECT symbol, sum(total_pnl) AS total_pnl, sum(mtm_pnl + realized_pnl + hedge_pnl) AS gross_before_costs, sum(transaction_costs + hedge_costs) AS total_costs,
  sum(turnover_usd) AS turnover_usd, max(drawdown_pct) AS max_drawdown_pct, avg(capital_used_pct) AS average_capital_used_pct,
  CASE WHEN count(*) >= 2 AND stddev_samp(total_pnl) > 0 THEN avg(total_pnl) / stddev_samp(total_pnl) * sqrt(252) ELSE 0 END AS sharpe, sum(total_pnl) / 250000 * 100 / 1e6 AS total_return_pct FROM daily GROUP BY 1)
SELECT symbol, {', '.join(f'round({c} / 1e6, 4) + 0.0 AS {c}' for c in _SUM)}, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in _SUM2)} FROM s""")
def backtest_summary(spark, d):
    s = bt.summary(backtest(spark, d), 250000.0, ["symbol"]).withColumn("total_return_pct", F.col("total_return_pct") / 1e6)
    return s.select("symbol", *[F.round(F.col(c) / 1e6, 4).alias(c) for c in _SUM], *[F.round(c, 4).alias(c) for c in _SUM2])


@query("rolling_reentry", "Q18 W35")
def rolling_reentry(spark, d):
    """All three templates on every symbol, re-entered each holding window."""
    path = bt.market_path(t.bars_daily(spark, d))
    out = None
    for s in bt.STRATEGIES:
        x = bt.rolling_reentry(path, s)
        out = x if out is None else out.unionByName(x)
    return rounded(out, ["strategy", "symbol", "date", "regime"], ["contracts", "total_pnl", "equity", "drawdown_pct"], 4)


_STRESS = ["pnl", "delta_pnl", "gamma_pnl", "vega_pnl", "theta_pnl", "execution_drag", "hedge_lag", "wrong_way_jump", "calibration_instability"]
_SC = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}e0" for x in s) + ")" for s in bt.SCENARIOS)


@query("stress_scenarios", "Q19 J13", f"""WITH {RULE_SQL}, sc AS (SELECT * FROM (VALUES {_SC}) s(scenario, spot_shock, skew, term, vov, spread_x, liquidity_x, lag_x, wrong_way, unstable)),
x AS (SELECT *, spot * spot_shock AS ds, vov + CASE WHEN option_type = 'put' THEN 1.2e0 ELSE 0.8e0 END * skew + greatest(maturity_days / 30, 0.5e0) * term AS shift FROM tg CROSS JOIN sc),
g AS (SELECT symbol, scenario, sum(delta * ds) AS delta_pnl, sum(0.5e0 * gamma * ds * ds) AS gamma_pnl, sum(vega * shift) AS vega_pnl, sum(theta / 252) AS theta_pnl,
  -sum(contracts * (ask - bid) * 100 * spread_x / greatest(liquidity_x, 1e-6)) AS execution_drag, -sum(abs(delta * ds) * greatest(lag_x - 1, 0)) AS hedge_lag,
  -sum(CASE WHEN wrong_way THEN 0.20e0 * (abs(vega) + abs(gamma) * greatest(abs(ds), 1)) ELSE 0 END) AS wrong_way_jump,
  -sum(CASE WHEN unstable THEN 0.10e0 * (abs(vega) + abs(theta) + abs(gamma) * 100) ELSE 0 END) AS calibration_instability FROM x GROUP BY ALL),
h AS (SELECT *, delta_pnl + gamma_pnl + vega_pnl + theta_pnl + execution_drag + hedge_lag + wrong_way_jump + calibration_instability AS pnl FROM g)
SELECT {sql_rounded(['symbol', 'scenario'], _STRESS, 5)} FROM h""")
def stress_scenarios(spark, d):
    return rounded(bt.stress(rule_targets(spark, d), ["symbol"]), ["symbol", "scenario"], _STRESS, 5)


# ---- multi-leg ------------------------------------------------------------------------------

_LEGS = f"""{SIGNAL_SQL}, lq AS (SELECT * FROM s0),
atm AS (SELECT symbol, expiry, arg_min(struct_pack(strike := strike, spot := spot, tt := time_to_maturity, m := model_iv, k := market_iv, bid := bid, ask := ask, l := liquidity_ok, s := spread_ok, ot := option_type), (abs(strike - spot), strike)) AS a FROM lq WHERE option_type = 'call' GROUP BY ALL),
up AS (SELECT symbol, expiry, arg_min(struct_pack(strike := strike, spot := spot, tt := time_to_maturity, m := model_iv, k := market_iv, bid := bid, ask := ask, l := liquidity_ok, s := spread_ok, ot := option_type), (abs(strike - spot * 1.03e0), strike)) AS u FROM lq WHERE option_type = 'call' GROUP BY ALL),
dn AS (SELECT symbol, expiry, arg_min(struct_pack(strike := strike, spot := spot, tt := time_to_maturity, m := model_iv, k := market_iv, bid := bid, ask := ask, l := liquidity_ok, s := spread_ok, ot := option_type), (abs(strike - spot * 0.97e0), strike)) AS d FROM lq WHERE option_type = 'put' GROUP BY ALL),
tri AS (SELECT * FROM atm JOIN up USING (symbol, expiry) JOIN dn USING (symbol, expiry) WHERE a.strike < u.strike),
cal AS (SELECT symbol, expiry, struct_pack(strike := strike, spot := spot, tt := time_to_maturity, m := model_iv, k := market_iv, bid := bid, ask := ask, l := liquidity_ok, s := spread_ok, ot := option_type) AS n FROM lq WHERE option_type = 'call'),
cal2 AS (SELECT symbol, expiry, n, lead(n) OVER (PARTITION BY symbol, n.strike ORDER BY expiry) AS f FROM cal),
legs AS (SELECT symbol, expiry, 'bull_call_spread' AS strategy, a.strike AS lo, u.strike AS hi, 1 AS sd, a AS g FROM tri UNION ALL SELECT symbol, expiry, 'bull_call_spread', a.strike, u.strike, -1, u FROM tri
  UNION ALL SELECT symbol, expiry, 'long_strangle', d.strike, u.strike, 1, d FROM tri UNION ALL SELECT symbol, expiry, 'long_strangle', d.strike, u.strike, 1, u FROM tri
  UNION ALL SELECT symbol, expiry, 'short_strangle', d.strike, u.strike, -1, d FROM tri UNION ALL SELECT symbol, expiry, 'short_strangle', d.strike, u.strike, -1, u FROM tri
  UNION ALL SELECT symbol, expiry, 'risk_reversal', d.strike, u.strike, 1, u FROM tri UNION ALL SELECT symbol, expiry, 'risk_reversal', d.strike, u.strike, -1, d FROM tri
  UNION ALL SELECT symbol, expiry, 'calendar_spread', n.strike, f.strike, -1, n FROM cal2 WHERE f IS NOT NULL UNION ALL SELECT symbol, expiry, 'calendar_spread', n.strike, f.strike, 1, f FROM cal2 WHERE f IS NOT NULL),
le AS (SELECT *, g.strike / g.spot AS mny FROM legs),
su AS (SELECT symbol, expiry, strategy, lo AS low_strike, hi AS high_strike, sum(sd * (g.m - g.k) * 10000) AS edge_bps,
  sum(CASE WHEN g.bid > 0 AND g.ask > 0 THEN (g.ask - g.bid) / ((g.bid + g.ask) / 2) / 2 * 10000 ELSE 500 END + 130) AS cost_bps,
  sum(sd * CASE WHEN g.ot = 'call' THEN CASE WHEN mny BETWEEN 0.95 AND 1.05 THEN 0.5e0 WHEN mny > 1.05 THEN 0.2e0 ELSE 0.8e0 END
    ELSE CASE WHEN mny BETWEEN 0.95 AND 1.05 THEN -0.5e0 WHEN mny < 0.95 THEN -0.2e0 ELSE -0.8e0 END END) AS delta,
  sum(sd * g.tt * 20) AS vega, sum(CASE WHEN sd > 0 THEN g.ask ELSE -g.bid END) AS net_debit, bool_and(g.l) AS lok, bool_and(g.s) AS sok FROM le GROUP BY ALL),
sv AS (SELECT *, edge_bps - cost_bps AS net_edge_bps FROM su),
strat AS (SELECT *, CASE WHEN net_edge_bps < 0 THEN 0 ELSE greatest(least(net_edge_bps / 200, 1) - CASE WHEN lok THEN 0 ELSE 0.3e0 END - CASE WHEN sok THEN 0 ELSE 0.3e0 END, 0) END AS confidence,
  CASE strategy WHEN 'bull_call_spread' THEN high_strike - low_strike - net_debit WHEN 'calendar_spread' THEN low_strike * 0.05e0 WHEN 'short_strangle' THEN -net_debit END AS max_profit,
  CASE strategy WHEN 'risk_reversal' THEN low_strike + net_debit WHEN 'short_strangle' THEN NULL ELSE net_debit END AS max_loss,
  CASE strategy WHEN 'bull_call_spread' THEN low_strike + net_debit WHEN 'calendar_spread' THEN low_strike WHEN 'risk_reversal' THEN high_strike + net_debit ELSE low_strike - abs(net_debit) END AS breakeven_low FROM sv)"""
_STRAT = ["edge_bps", "cost_bps", "net_edge_bps", "delta", "vega", "net_debit", "confidence", "max_profit", "max_loss", "breakeven_low"]


@query("multi_leg_strategies", "Q10", f"WITH {_LEGS} SELECT {sql_rounded(['symbol', 'expiry', 'strategy', 'low_strike', 'high_strike'], _STRAT, 4)} FROM strat")
def multi_leg_strategies(spark, d):
    q = sabr_fixed(cleaned(spark, d)).withColumn("market_iv", F.col("true_vol"))
    return rounded(sg.build_strategies(q), ["symbol", "expiry", "strategy", "low_strike", "high_strike"], _STRAT, 4)


# ---- positions and limits -------------------------------------------------------------------

FILLS_SQL = """fills AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS sgn,
  CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS val FROM lineitem),
vw AS (SELECT symbol, sum(sgn * q) AS quantity, CAST(sum(val) AS DOUBLE) / CAST(sum(q) AS DOUBLE) AS avg_price, count(*) AS fills FROM fills GROUP BY 1 HAVING sum(sgn * q) <> 0)"""


@query("position_vwap", "A27 R4", f"WITH {FILLS_SQL} SELECT symbol, CAST(quantity AS DOUBLE) AS quantity, round(avg_price, 4) AS avg_price, fills FROM vw")
def position_vwap(spark, d):
    p = pf.position_vwap(t.fills(spark, d))
    return p.select("symbol", F.col("quantity").cast("double").alias("quantity"), F.round(F.col("avg_price").cast("double"), 4).alias("avg_price"), "fills")


@query("exposure_limits", "A28 R6", f"""WITH {FILLS_SQL}, g AS (SELECT CAST(substr(symbol, 2) AS BIGINT) % 7 AS book, sum(abs(CAST(quantity AS DOUBLE) * avg_price)) AS total_exposure, count(*) AS positions,
  count(CASE WHEN abs(CAST(quantity AS DOUBLE) * avg_price) > 500000 THEN 1 END) AS position_breaches FROM vw GROUP BY 1)
SELECT book, round(total_exposure, 2) AS total_exposure, positions, position_breaches, list_filter([CASE WHEN total_exposure > 5000000 THEN 'total exposure limit' END,
  CASE WHEN position_breaches > 0 THEN 'position limit x' || CAST(position_breaches AS VARCHAR) END], lambda x: x IS NOT NULL) AS breaches FROM g""")
def exposure_limits(spark, d):
    p = pf.position_vwap(t.fills(spark, d)).withColumn("book", F.substring("symbol", 2, 20).cast("long") % 7)
    p = p.withColumns({"quantity": F.col("quantity").cast("double"), "avg_price": F.col("avg_price").cast("double")})
    return pf.exposure_report(p, 500000.0, 5000000.0).withColumn("total_exposure", F.round("total_exposure", 2))


@query("order_limit_checks", "R5", f"""WITH {FILLS_SQL}, o AS (SELECT 'S' || CAST(o_custkey % 50 AS VARCHAR) AS symbol, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
  1.0e0 + o_orderkey % 40 AS quantity, o_totalprice / 20 AS price FROM orders),
ex AS (SELECT CAST(substr(symbol, 2) AS BIGINT) % 7 AS book, sum(abs(CAST(quantity AS DOUBLE) * avg_price)) AS exposure FROM vw GROUP BY 1),
j AS (SELECT o.*, coalesce((SELECT exposure FROM ex WHERE ex.book = CAST(substr(o.symbol, 2) AS BIGINT) % 7), 0) AS exposure, quantity * price AS order_value, abs((coalesce((SELECT CAST(vw.quantity AS DOUBLE) FROM vw WHERE vw.symbol = o.symbol), 0) + CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) * price) AS aft FROM o)
SELECT o_orderkey, round(order_value, 4) AS order_value, CASE WHEN order_value > 400000 THEN 'order value limit' WHEN aft > 3000000 THEN 'position limit' WHEN exposure + order_value > 5000000 THEN 'exposure limit' ELSE 'approved' END AS reason FROM j""")
def order_limit_checks(spark, d):
    o = t.table(spark, d, "orders").select(
        F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string")).alias("symbol"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        (F.lit(1.0) + F.col("o_orderkey") % 40).alias("quantity"), (F.col("o_totalprice") / 20).alias("price"))
    """Each order against its value, the position after it and the exposure of its book's positions."""
    p = pf.position_vwap(t.fills(spark, d)).withColumns({"quantity": F.col("quantity").cast("double"), "avg_price": F.col("avg_price").cast("double")})
    book = F.substring("symbol", 2, 20).cast("long") % 7
    held = p.groupBy(book.alias("book")).agg(F.sum(F.abs(F.col("quantity") * F.col("avg_price"))).alias("exposure"))
    o = o.withColumn("book", book).join(held, "book", "left")
    c = pf.check_orders(o, p, F.coalesce("exposure", F.lit(0.0)), 400000.0, 3000000.0, 5000000.0)
    return c.select("o_orderkey", F.round("order_value", 4).alias("order_value"), "reason")
