"""Bars and daily indicator queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.functions.numeric import safe_div
from tickloom.operators import backtest as bt
from tickloom.operators import indicators as ind
from tickloom.operators.asof import align_to_spine
from tickloom.operators.frames import Ewm, Series, add_ewm, number_rows, with_halo
from tickloom.plans import views_sql as v
from tickloom.plans.registry import query, rounded, sql_rounded
from tickloom.sources import tables as t

KEY = ["symbol", "date"]
S = Series()
A = math.sqrt(252.0)


@query("bars_daily", "S1 view", f"WITH {v.BARS} SELECT * FROM bars")
def bars_daily(spark, d):
    return t.bars_daily(spark, d)


@query("bars_range_scan", "S1 S2 P15",
       f"""WITH {v.BARS} SELECT symbol, date, close, volume FROM bars
       WHERE symbol = 'A' AND date > DATE '2001-06-30' - 365 AND date <= DATE '2001-06-30'""")
def bars_range_scan(spark, d):
    from tickloom.functions.dates import period_start
    b = t.bars_daily(spark, d)
    as_of = F.lit("2001-06-30").cast("date")
    return b.where((F.col("symbol") == "A") & (F.col("date") > period_start("1y", as_of)) & (F.col("date") <= as_of)).select(
        "symbol", "date", "close", "volume")


@query("bars_universe", "S1 view", f"WITH {v.UNIVERSE} SELECT * FROM bars")
def bars_universe(spark, d):
    return t.bars_universe(spark, d)


@query("bars_intraday", "R9 view", f"WITH {v.intraday(3_600_000_000)} SELECT * FROM ibars")
def bars_intraday(spark, d):
    return t.bars_intraday(spark, d)


@query("returns", "W6 W8 F1", f"""WITH {v.BARS}, {v.RET}
SELECT {sql_rounded(KEY, ['daily_return', 'log_return', 'true_range'], 5)} FROM ret""")
def returns(spark, d):
    return rounded(ind.add_returns(t.bars_daily(spark, d)), KEY, ["daily_return", "log_return", "true_range"], 5)


_AVG_COLS = ["sma_20", "sma_50", "sma_200", "bb_upper", "bb_lower", "obv"]
_AVG_SQL = f"""WITH {v.BARS}, {v.RET}, f AS (SELECT symbol, date,
  {v.gate('avg(close)', 'close', 20)} AS sma_20, {v.gate('avg(close)', 'close', 50)} AS sma_50,
  {v.gate('avg(close)', 'close', 200)} AS sma_200, {v.gate('stddev_samp(close)', 'close', 20)} AS sd,
  sum(coalesce(sign(delta), 0) * volume) OVER {v.SOFAR} AS obv FROM ret),
g AS (SELECT *, sma_20 + 2 * sd AS bb_upper, sma_20 - 2 * sd AS bb_lower FROM f)
SELECT {sql_rounded(KEY, _AVG_COLS, 5)} FROM g"""


@query("moving_averages", "W1 W5 W7", _AVG_SQL)
def moving_averages(spark, d):
    return rounded(ind.add_averages(ind.add_returns(t.bars_daily(spark, d))), KEY, _AVG_COLS, 5)


_SMOOTH = ["ema_20", "atr_14", "rsi_14", "macd", "macd_signal", "macd_hist"]
SMOOTH_CTE = f"""sm0 AS (SELECT *, {v.ewm('close', 2 / 21)} AS ema_20, {v.ewm('close', 2 / 13)} AS e12,
  {v.ewm('close', 2 / 27)} AS e26, {v.ewm('g', 1 / 14)} AS ag, {v.ewm('l', 1 / 14)} AS al,
  {v.ewm('true_range', 1 / 14)} AS atr, count(g) OVER {v.SOFAR} AS n, count(*) OVER {v.SOFAR} AS rn
  FROM (SELECT *, CASE WHEN delta > 0 THEN delta WHEN delta <= 0 THEN 0 END AS g,
    CASE WHEN delta < 0 THEN -delta WHEN delta >= 0 THEN 0 END AS l FROM ret) t),
sm1 AS (SELECT *, e12 - e26 AS macd, CASE WHEN rn >= 14 THEN atr END AS atr_14,
  CASE WHEN n >= 14 AND al <> 0 THEN 100 - 100 / (1 + ag / al) END AS rsi_14 FROM sm0),
sm2 AS (SELECT *, {v.ewm('macd', 2 / 10)} AS macd_signal FROM sm1),
smooth AS (SELECT *, macd - macd_signal AS macd_hist FROM sm2)"""


@query("smoothed_indicators", "W2 W3 W4", f"""WITH {v.BARS}, {v.RET}, {SMOOTH_CTE}
SELECT {sql_rounded(KEY, _SMOOTH, 4)} FROM smooth""")
def smoothed_indicators(spark, d):
    return rounded(ind.add_smoothed(ind.add_returns(t.bars_daily(spark, d))), KEY, _SMOOTH, 4)


@query("latest_snapshot", "W1 W2 W3 O8", f"""WITH {v.BARS}, {v.RET}, {SMOOTH_CTE},
x AS (SELECT *, {v.gate('avg(close)', 'close', 20)} AS sma_20,
  row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rk FROM smooth WHERE close IS NOT NULL)
SELECT {sql_rounded(KEY, ['close', 'sma_20', 'rsi_14'])} FROM x WHERE rk = 1""")
def latest_snapshot(spark, d):
    full = ind.technicals(t.bars_daily(spark, d)).where("close is not null")
    top = full.groupBy("symbol").agg(
        F.max_by(F.struct("date", "close", "sma_20", "rsi_14"), "date").alias("r")).select("symbol", "r.*")
    return rounded(top, KEY, ["close", "sma_20", "rsi_14"])


@query("universe_technicals", "W1 W2 W3 W5", f"""WITH {v.UNIVERSE}, {v.RET}, {SMOOTH_CTE},
x AS (SELECT *, {v.gate('avg(close)', 'close', 20)} AS sma_20 FROM smooth)
SELECT {sql_rounded(KEY, ['sma_20', 'ema_20', 'rsi_14', 'macd_hist'], 4)} FROM x""")
def universe_technicals(spark, d):
    return rounded(ind.technicals(t.series_universe(spark, d)), KEY, ["sma_20", "ema_20", "rsi_14", "macd_hist"], 4)


_DER = ["price_to_sma20", "price_to_sma50", "price_to_sma200", "bb_pct", "volume_zscore", "high_low_range", "overnight_gap"]


@query("derived_ratios", "W9 F1", f"""WITH {v.BARS}, {v.RET}, f AS (SELECT *,
  {v.gate('avg(close)', 'close', 20)} AS s20, {v.gate('avg(close)', 'close', 50)} AS s50,
  {v.gate('avg(close)', 'close', 200)} AS s200, {v.gate('stddev_samp(close)', 'close', 20)} AS sd,
  {v.gate('avg(volume)', 'volume', 20, 5)} AS vm, {v.gate('stddev_samp(volume)', 'volume', 20, 5)} AS vs FROM ret),
g AS (SELECT symbol, date, {v.sd('close', 's20')} AS price_to_sma20, {v.sd('close', 's50')} AS price_to_sma50,
  {v.sd('close', 's200')} AS price_to_sma200, {v.sd('close - (s20 - 2 * sd)', '4 * sd')} AS bb_pct,
  {v.sd('volume - vm', 'vs')} AS volume_zscore, {v.sd('high - low', 'close')} AS high_low_range,
  {v.sd('open', 'prev_close')} - 1 AS overnight_gap FROM f)
SELECT {sql_rounded(KEY, _DER)} FROM g""")
def derived_ratios(spark, d):
    return rounded(ind.add_derived(ind.add_averages(ind.add_returns(t.bars_daily(spark, d)))), KEY, _DER)


_RISK = ["realized_vol_20d", "realized_vol_60d", "vol_of_vol", "skewness_20d", "kurtosis_20d", "downside_deviation",
         "max_drawdown_20d"]


@query("risk_features", "W10 W11 W12 W13 W14 F8", f"""WITH {v.BARS}, {v.RET}, f AS (SELECT *,
  CASE WHEN log_return < 0 THEN log_return END AS neg,
  {v.gate('stddev_samp(log_return)', 'log_return', 20, 5)} * {A!r} AS realized_vol_20d,
  {v.gate('stddev_samp(log_return)', 'log_return', 60, 20)} * {A!r} AS realized_vol_60d,
  {v.gate('skewness(log_return)', 'log_return', 20, 10)} AS skewness_20d,
  {v.gate('kurtosis(log_return)', 'log_return', 20, 10)} AS kurtosis_20d,
  close / max(close) OVER {v.w(20)} - 1 AS max_drawdown_20d FROM ret),
g AS (SELECT *, CASE WHEN count(log_return) OVER {v.w(20)} >= 10 AND count(neg) OVER {v.w(20)} >= 3
    THEN stddev_samp(neg) OVER {v.w(20)} * {A!r} END AS downside_deviation,
  {v.gate('stddev_samp(realized_vol_20d)', 'realized_vol_20d', 20, 5)} AS vol_of_vol FROM f)
SELECT {sql_rounded(KEY, _RISK)} FROM g""")
def risk_features(spark, d):
    return rounded(ind.add_risk(ind.add_returns(t.bars_daily(spark, d))), KEY, _RISK)


_MICRO = ["amihud_illiquidity", "bid_ask_spread_proxy", "volume_participation", "trade_imbalance"]


@query("microstructure_features", "W15 W16 F2", f"""WITH {v.BARS}, {v.RET},
e AS (SELECT *, CASE WHEN volume <> 0 THEN volume END AS vv, high - low AS hl FROM ret),
f AS (SELECT *, abs(log_return) / vv * 1e6 AS am FROM e),
g AS (SELECT symbol, date, {v.gate('avg(am)', 'am', 20, 5)} AS amihud_illiquidity,
  {v.sd('hl', '(high + low) / 2')} AS bid_ask_spread_proxy,
  vv / ({v.gate('avg(vv)', 'vv', 20, 5)}) AS volume_participation,
  CASE WHEN hl <> 0 THEN greatest(least((close - open) / hl, 1), -1) END AS trade_imbalance FROM f)
SELECT {sql_rounded(KEY, _MICRO, 4)} FROM g""")
def microstructure_features(spark, d):
    return rounded(ind.add_microstructure(ind.add_returns(t.bars_daily(spark, d))), KEY, _MICRO, 4)


_MOM = ["reversal_1w", "momentum_1m", "momentum_3m", "momentum_6m", "momentum_12m", "high_52w_pct", "low_52w_pct",
        "price_accel"]


@query("momentum_features", "W17 W18 W19 F2", f"""WITH {v.BARS}, f AS (SELECT symbol, date, close,
  lag(close, 5) OVER {v.LINE} AS l5, lag(close, 26) OVER {v.LINE} AS l26, lag(close, 68) OVER {v.LINE} AS l68,
  lag(close, 131) OVER {v.LINE} AS l131, lag(close, 257) OVER {v.LINE} AS l257,
  {v.gate('max(close)', 'close', 252, 63)} AS hi, {v.gate('min(close)', 'close', 252, 63)} AS lo FROM bars),
g AS (SELECT symbol, date, {v.sd('close', 'l5')} - 1 AS reversal_1w, {v.sd('l5', 'l26')} - 1 AS momentum_1m,
  {v.sd('l5', 'l68')} - 1 AS momentum_3m, {v.sd('l5', 'l131')} - 1 AS momentum_6m,
  {v.sd('l5', 'l257')} - 1 AS momentum_12m,
  CASE WHEN hi IS NOT NULL THEN greatest(least(close / hi - 1, 0), -1) END AS high_52w_pct,
  CASE WHEN lo IS NOT NULL THEN greatest(close / lo - 1, 0) END AS low_52w_pct FROM f),
h AS (SELECT *, momentum_1m - momentum_3m AS price_accel FROM g)
SELECT {sql_rounded(KEY, _MOM)} FROM h""")
def momentum_features(spark, d):
    return rounded(ind.add_momentum(t.bars_daily(spark, d)), KEY, _MOM)


BENCH_RET = f"""bret AS (SELECT date, ln(close / lag(close) OVER (ORDER BY date)) AS idx FROM bench),
aligned AS (
  SELECT symbol, date, idx FROM (
    SELECT symbol, date, spine, last_value(idx IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS idx
    FROM (SELECT coalesce(b.symbol, s.symbol) AS symbol, coalesce(b.date, s.date) AS date, s.idx, b.symbol AS spine
      FROM bars b FULL JOIN (SELECT symbol, date, idx FROM bret CROSS JOIN (SELECT DISTINCT symbol FROM bars)) s
      ON b.symbol = s.symbol AND b.date = s.date) u) z WHERE spine IS NOT NULL)"""


def index_returns(spark, d, bars):
    """Index log return for the months a symbol trades in and the month before each."""
    b = t.bars_benchmark(spark, d).withColumn("symbol", F.lit("*"))
    r = ind.add_returns(b.withColumns({c: F.col("close") for c in ("open", "high", "low")}))
    month = F.trunc("date", "month")
    seen = bars.select("symbol", F.explode(F.array(month, F.add_months(month, -1))).alias("_m")).distinct()
    r = r.select("date", F.col("log_return").alias("idx"), month.alias("_m"))
    return seen.join(r, "_m").drop("_m")


@query("cross_asset_features", "J4 W20 W21 W22", f"""WITH {v.BARS}, {v.RET}, {v.BENCH}, {BENCH_RET},
j AS (SELECT r.*, a.idx, CASE WHEN r.log_return IS NOT NULL AND a.idx IS NOT NULL THEN r.log_return END AS rp,
  CASE WHEN r.log_return IS NOT NULL AND a.idx IS NOT NULL THEN a.idx END AS ip
  FROM ret r JOIN aligned a USING (symbol, date)),
f AS (SELECT symbol, date, log_return - idx AS rel_strength, idx,
  {v.gate('covar_samp(rp, ip)', 'rp', 60, 20)} AS cv, {v.gate('var_samp(idx)', 'idx', 60, 20)} AS vr,
  {v.gate('corr(rp, ip)', 'rp', 20, 10)} AS corr_20d FROM j),
g AS (SELECT *, {v.sd('cv', 'vr')} AS beta_60d FROM f)
SELECT {sql_rounded(KEY, ['idx', 'beta_60d', 'corr_20d', 'rel_strength'])} FROM g""")
def cross_asset_features(spark, d):
    bars = t.bars_daily(spark, d)
    own = ind.add_returns(bars)
    al = align_to_spine(own, index_returns(spark, d, bars), ["symbol"], "date", ["idx"], 5)
    return rounded(ind.add_cross_asset(al, "idx"), KEY, ["idx", "beta_60d", "corr_20d", "rel_strength"])


@query("fill_limits", "W23 W24", f"""WITH {v.BARS}, x AS (SELECT symbol, date,
  CASE WHEN CAST(volume AS BIGINT) % 40 = 0 THEN close END AS v FROM bars),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
  ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS ff FROM x),
g AS (SELECT *, first_value(ff IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
  ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS fb FROM f),
h AS (SELECT *, avg(fb) OVER {v.w(7)} AS mean_7d FROM g)
SELECT {sql_rounded(KEY, ['v', 'ff', 'fb', 'mean_7d'])} FROM h""")
def fill_limits(spark, d):
    x = t.bars_daily(spark, d).select(*KEY, F.when(F.col("volume").cast("bigint") % 40 == 0, F.col("close")).alias("v"))
    x = x.withColumn("ff", S.ffill("v", 20))
    x = x.withColumn("fb", S.bfill("ff", 5))
    return rounded(x.withColumn("mean_7d", S.mean("fb", 7, 1)), KEY, ["v", "ff", "fb", "mean_7d"])


_CH = ["rsi", "atr", "stoch_k", "stoch_d", "cci", "ema20", "ema50", "ema200"]


@query("chart_overlays", "W2 W28 W29 W30 W31", f"""WITH {v.BARS}, {v.RET}, e AS (SELECT *,
  CASE WHEN delta > 0 THEN delta ELSE 0 END AS up, CASE WHEN delta < 0 THEN -delta ELSE 0 END AS dn,
  (high + low + close) / 3 AS tp FROM ret),
f AS (SELECT *, {v.gate('avg(up)', 'up', 14)} AS u, {v.gate('avg(dn)', 'dn', 14)} AS dd,
  {v.gate('avg(true_range)', 'true_range', 14)} AS atr, {v.gate('min(low)', 'low', 14)} AS l14,
  {v.gate('max(high)', 'high', 14)} AS h14, {v.gate('avg(tp)', 'tp', 20)} AS tpm,
  {v.gate('stddev_samp(tp)', 'tp', 20)} AS tps, {v.ewm('close', 2 / 21)} AS ema20, {v.ewm('close', 2 / 51)} AS ema50,
  {v.ewm('close', 2 / 201)} AS ema200 FROM e),
g AS (SELECT *, CASE WHEN dd <> 0 THEN 100 - 100 / (1 + u / dd) END AS rsi,
  100 * ({v.sd('close - l14', 'h14 - l14')}) AS stoch_k, {v.sd('tp - tpm', '0.015 * tps')} AS cci FROM f),
h AS (SELECT *, {v.gate('avg(stoch_k)', 'stoch_k', 3)} AS stoch_d FROM g)
SELECT {sql_rounded(KEY, _CH, 4)} FROM h""")
def chart_overlays(spark, d):
    return rounded(ind.chart_overlays(t.bars_daily(spark, d)), KEY, _CH, 4)


@query("rebased_comparison", "W32", f"""WITH {v.BARS}, f AS (SELECT symbol, date, close,
  first_value(close) OVER {v.LINE} AS start_price,
  last_value(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS end_price
  FROM bars), g AS (SELECT *, (close - start_price) / start_price * 100 AS value,
  (end_price - start_price) / start_price * 100 AS change_percent FROM f)
SELECT {sql_rounded(KEY, ['value', 'start_price', 'end_price', 'change_percent'])} FROM g""")
def rebased_comparison(spark, d):
    return rounded(ind.rebased(t.bars_daily(spark, d)), KEY, ["value", "start_price", "end_price", "change_percent"])


@query("daily_change", "W46", f"""WITH {v.BARS}, f AS (SELECT symbol, date, close,
  lag(close) OVER {v.LINE} AS previous_close FROM bars),
g AS (SELECT *, close - previous_close AS change, (close - previous_close) / previous_close * 100 AS change_pct FROM f)
SELECT {sql_rounded(KEY, ['close', 'previous_close', 'change', 'change_pct'])} FROM g""")
def daily_change(spark, d):
    return rounded(ind.day_change(t.bars_daily(spark, d)), KEY, ["close", "previous_close", "change", "change_pct"])


@query("macd_crossovers", "W36 W37", f"""WITH {v.BARS}, {v.RET}, {SMOOTH_CTE},
a AS (SELECT symbol, date, close, macd, macd_signal AS signal, macd_hist AS histogram,
  {v.ewm('true_range', 2 / 15)} AS atr, row_number() OVER {v.LINE} - 1 AS rn,
  lag(macd_hist) OVER {v.LINE} AS ph FROM smooth),
b AS (SELECT *, CASE WHEN rn >= 40 AND ph <= 0 AND histogram > 0 THEN 'long'
  WHEN rn >= 40 AND ph >= 0 AND histogram < 0 THEN 'short' END AS dir FROM a),
c AS (SELECT *, last_value(dir IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM b),
x AS (SELECT * FROM c WHERE dir IS NOT NULL AND (held IS NULL OR held <> dir)),
legs AS (SELECT symbol, date, 1 AS leg, dir AS direction, close AS price,
    CASE WHEN dir = 'long' THEN close - 2 * atr ELSE close + 2 * atr END AS stop_loss,
    2000.0 / greatest(2 * atr, 0.01) AS position_size, macd, signal, histogram FROM x
  UNION ALL SELECT symbol, date, 0, 'close', close, 0, 0, macd, signal, histogram FROM x WHERE held IS NOT NULL)
SELECT {sql_rounded(['symbol', 'date', 'leg', 'direction'], ['price', 'stop_loss', 'position_size', 'macd', 'signal', 'histogram'], 4)}
FROM legs""")
def macd_crossovers(spark, d):
    return rounded(ind.macd_crossovers(t.bars_daily(spark, d)), ["symbol", "date", "leg", "direction"],
                   ["price", "stop_loss", "position_size", "macd", "signal", "histogram"], 4)


_PATH = ["spot", "dspot", "ret", "iv_change_points", "skew_shift_points"]
PATH_CTE = f"""path0 AS (SELECT symbol, date, close, coalesce(close / lag(close) OVER {v.LINE} - 1, 0) AS ret,
  coalesce(close - lag(close) OVER {v.LINE}, 0) AS dspot FROM bars),
path1 AS (SELECT *, coalesce(list_stddev_samp(list(ret) OVER {v.w(5)}), 0) * 100 AS rv5 FROM path0),
path2 AS (SELECT *, coalesce(rv5 - lag(rv5) OVER {v.LINE}, 0) AS mv FROM path1),
path AS (SELECT symbol, date, close AS spot, round(dspot, 4) + 0.0 AS dspot, ret, round(mv, 4) + 0.0 AS iv_change_points,
  round(mv * 0.5, 4) + 0.0 AS skew_shift_points,
  CASE WHEN abs(ret) > 0.03 THEN 'crisis' WHEN abs(ret) > 0.015 THEN 'stress' ELSE 'normal' END AS regime FROM path2)"""


@query("market_path", "W34", f"""WITH {v.BARS}, {PATH_CTE}
SELECT {sql_rounded(['symbol', 'date', 'regime'], _PATH, 4)} FROM path""")
def market_path(spark, d):
    return rounded(bt.market_path(t.bars_daily(spark, d)), ["symbol", "date", "regime"], _PATH, 4)


@query("tick_rolling_mean", "W1 S3 R9", """WITH f AS (SELECT event_type AS symbol, event_id,
  row_number() OVER q - 1 AS pos, count(*) OVER (q ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n,
  avg(value) OVER (q ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m
  FROM events WINDOW q AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT symbol, event_id, pos, round(CASE WHEN n >= 20 THEN m END, 6) + 0.0 AS mean_20 FROM f""")
def tick_rolling_mean(spark, d):
    """Rolling mean over raw ticks; a hot symbol is cut into chunks with a 19-row halo."""
    x = number_rows(t.ticks(spark, d), ["symbol"], ["ts", "event_id"], F.to_date("ts"))
    x = with_halo(x, "_pos", back=19)
    s = Series(("symbol", "_chunk"), ("_pos",))
    x = x.withColumn("mean_20", s.mean("price", 20)).where("_home")
    return x.select("symbol", "event_id", F.col("_pos").cast("long").alias("pos"), F.round("mean_20", 6).alias("mean_20"))
