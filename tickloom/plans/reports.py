"""Summary queries: scenarios, grades, recommendations, peers, snapshots, parameter history, matrix."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from tickloom.operators import indicators as ind, matrix as mx, options as op, summaries as su
from tickloom.operators.asof import align_to_spine, asof_join, event_distance
from tickloom.operators.frames import Series
from tickloom.operators.news import insider_monthly, month_start
from tickloom.plans import views_sql as v
from tickloom.plans.features import index_returns
from tickloom.plans.inputs import _daily, _fund
from tickloom.plans.registry import query, rounded, sql_rounded
from tickloom.session import cut_lineage, shared_dir
from tickloom.sources import history as hs, tables as t

A = math.sqrt(252.0)


def _scen(spark, d):
    return su.price_scenarios(ind.add_returns(t.bars_daily(spark, d)))


SCEN_SQL = f"""{v.BARS}, {v.RET}, g AS (SELECT symbol, arg_max(close, date) AS last, avg(log_return) * 0.5 AS drift, stddev_samp(log_return) AS vol, count(log_return) AS n FROM ret GROUP BY 1),
h AS (SELECT g.*, tf AS timeframe, hh AS h, drift * hh AS td, sqrt(vol * vol * hh) AS band FROM g CROSS JOIN (VALUES ('1W', 5), ('1M', 21), ('3M', 63), ('6M', 126), ('1Y', 252)) x(tf, hh)),
rr AS (SELECT symbol, date, log_return, row_number() OVER {v.LINE} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS m FROM ret WHERE log_return IS NOT NULL),
w AS ({' UNION ALL '.join(f"SELECT symbol, '{k}' AS timeframe, s AS hr FROM (SELECT *, sum(log_return) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS s FROM rr) q WHERE rn < m - {n}" for k, n in su.HORIZONS.items())}),
c AS (SELECT symbol, timeframe, hr - avg(hr) OVER (PARTITION BY symbol, timeframe) + td AS c, band FROM w JOIN h USING (symbol, timeframe)),
p AS (SELECT symbol, timeframe, avg(CASE WHEN c >= band THEN 1.0e0 ELSE 0 END) AS p_bull, avg(CASE WHEN c <= -band THEN 1.0e0 ELSE 0 END) AS p_bear, avg(CASE WHEN c > 0 THEN 1.0e0 ELSE 0 END) AS p_up FROM c GROUP BY ALL),
scen AS (SELECT h.symbol, h.timeframe, CAST(h AS INTEGER) AS h, last, vol * {A!r} AS annualized_vol, p_up, p_bull, p_bear, greatest(0, 1 - p_bull - p_bear) AS p_base, round(last * exp(td + band), 2) AS bull, round(last * exp(td), 2) AS base, round(last * exp(td - band), 2) AS bear
  FROM h JOIN p USING (symbol, timeframe))"""


@query("price_scenarios", "Q20 W41", f"WITH {SCEN_SQL} SELECT {sql_rounded(['symbol', 'timeframe', 'h'], ['last', 'annualized_vol', 'p_up', 'p_bull', 'p_base', 'p_bear', 'base', 'bear'], 5)} FROM scen")
def price_scenarios(spark, d):
    return rounded(_scen(spark, d), ["symbol", "timeframe", "h"], ["last", "annualized_vol", "p_up", "p_bull", "p_base", "p_bear", "base", "bear"], 5)


@query("recommendations", "Q22 F13", f"""WITH {SCEN_SQL}, r AS (SELECT symbol, timeframe, round(p_up, 3) AS p, round((base - last) / last * 100, 2) + 0.0 AS br FROM scen)
SELECT symbol, timeframe, CASE WHEN p >= 0.62 AND br > 2 THEN 'Strong Buy' WHEN p >= 0.55 AND br > 0 THEN 'Buy' WHEN p <= 0.38 OR br < -5 THEN CASE WHEN p <= 0.33 THEN 'Strong Sell' ELSE 'Sell' END ELSE 'Hold' END AS action, p AS p_up, br AS base_return FROM r""")
def recommendations(spark, d):
    return su.recommendations(_scen(spark, d)).drop("confidence")


@query("growth_scenarios", "Q21", """WITH s AS (SELECT s_suppkey, s_acctbal + 1000 AS price, s_nationkey * 1.0e0 AS eg, (s_suppkey * 7) % 100 AS se FROM supplier),
g AS (SELECT *, CASE WHEN eg <> 0 THEN eg ELSE 10 END / 100 * days / 365 AS gr, (se - 50) / 100.0e0 AS f FROM s CROSS JOIN (VALUES ('1W', 7), ('1M', 30), ('3M', 90), ('6M', 180), ('1Y', 365)) t(timeframe, days))
SELECT s_suppkey, timeframe, round(price * (1 + gr * 1.5 + f * 0.2), 7) AS bull, round(price * (1 + gr + f * 0.1), 7) AS base, round(price * (1 + gr * 0.3 - abs(f) * 0.2), 7) AS bear FROM g""")
def growth_scenarios(spark, d):
    s = t.table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") + 1000).alias("price"), F.col("s_nationkey").cast("double").alias("eps_growth"), ((F.col("s_suppkey") * 7) % 100).alias("sentiment"))
    return rounded(su.growth_scenarios(s), ["s_suppkey", "timeframe"], ["bull", "base", "bear"], 7)


@query("company_grades", "F12", """WITH s AS (SELECT s_suppkey, s_suppkey % 45 * 1.0e0 AS pe, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey * 1.5e0 END AS roe, s_nationkey * 1.0e0 AS pm, s_suppkey % 30 * 1.0e0 AS eg, s_suppkey % 25 * 1.0e0 AS rg, (s_suppkey % 28) / 10.0e0 AS de FROM supplier),
x AS (SELECT s_suppkey, coalesce(nullif(pe, 0), 20) AS pe, (coalesce(nullif(roe, 0), 15) + coalesce(nullif(pm, 0), 10)) / 2 AS pr, (coalesce(nullif(eg, 0), 10) + coalesce(nullif(rg, 0), 10)) / 2 AS gr, coalesce(nullif(de, 0), 0.5) AS de FROM s),
y AS (SELECT s_suppkey, CASE WHEN pe < 15 THEN 95 WHEN pe < 20 THEN 85 WHEN pe < 25 THEN 75 WHEN pe < 35 THEN 60 ELSE 40 END AS valuation, CASE WHEN pr > 20 THEN 95 WHEN pr > 15 THEN 85 WHEN pr > 10 THEN 75 WHEN pr > 5 THEN 60 ELSE 40 END AS profitability,
  CASE WHEN gr > 20 THEN 95 WHEN gr > 15 THEN 85 WHEN gr > 10 THEN 75 WHEN gr > 5 THEN 60 ELSE 40 END AS growth, CASE WHEN de < 0.3 THEN 95 WHEN de < 0.5 THEN 85 WHEN de < 1.0 THEN 75 WHEN de < 2.0 THEN 60 ELSE 40 END AS financial_health FROM x),
z AS (SELECT *, (valuation + profitability + growth + financial_health) / 4.0e0 AS average_score FROM y) SELECT *, CASE WHEN average_score >= 90 THEN 'A' WHEN average_score >= 80 THEN 'B' WHEN average_score >= 70 THEN 'C' WHEN average_score >= 60 THEN 'D' ELSE 'F' END AS overall_grade FROM z""")
def company_grades(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = t.table(spark, d, "supplier").select(
        "s_suppkey", (k % 45).cast("double").alias("pe_ratio"), F.when(k % 7 != 0, n * 1.5).alias("roe"), n.cast("double").alias("profit_margin"),
        (k % 30).cast("double").alias("eps_growth"), (k % 25).cast("double").alias("revenue_growth"), ((k % 28) / 10.0).alias("debt_to_equity"))
    return su.grades(s).select("s_suppkey", "valuation", "profitability", "growth", "financial_health", "average_score", "overall_grade")


@query("peer_comparison", "J16", f"""WITH {v.BARS}, m AS (SELECT symbol, round(avg(close), 4) AS c, CAST(max(volume) AS DOUBLE) AS v FROM bars GROUP BY 1), l AS (SELECT symbol, 'c' AS metric, c AS value FROM m UNION ALL SELECT symbol, 'v', v FROM m)
SELECT a.symbol, a.metric, a.value AS own, list_sort(coalesce(list(b.symbol) FILTER (WHERE b.value > a.value), [])) AS higher, list_sort(coalesce(list(b.symbol) FILTER (WHERE b.value < a.value), [])) AS lower
FROM l a JOIN l b ON a.metric = b.metric AND a.symbol <> b.symbol GROUP BY ALL""")
def peer_comparison(spark, d):
    m = t.bars_daily(spark, d).groupBy("symbol").agg(F.round(F.avg("close"), 4).alias("c"), F.max("volume").alias("v"))
    peers = m.select("symbol", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("peer")).where("symbol <> peer")
    return su.peer_comparison(m, peers, ["c", "v"])


_SNAP = ["last", "chg_1w_pct", "chg_1m_pct", "chg_3m_pct", "pos_in_52w_range_pct", "rsi14", "price_vs_sma50_pct", "price_vs_sma200_pct", "realized_vol_20d_ann", "vol_1y_percentile"]


@query("market_snapshot", "W42 W43", f"""WITH {v.BARS}, {v.RET}, f AS (SELECT *, greatest(coalesce(delta, 0), 0) AS u, greatest(coalesce(-delta, 0), 0) AS dn, {v.gate('stddev_samp(log_return)', 'log_return', 20)} AS vol FROM ret),
g AS (SELECT *, (close / lag(close, 5) OVER {v.LINE} - 1) * 100 AS chg_1w_pct, (close / lag(close, 21) OVER {v.LINE} - 1) * 100 AS chg_1m_pct, (close / lag(close, 63) OVER {v.LINE} - 1) * 100 AS chg_3m_pct,
  min(close) OVER {v.w(252)} AS lo, max(close) OVER {v.w(252)} AS hi, avg(close) OVER {v.w(50)} AS s50, avg(close) OVER {v.w(200)} AS s200, avg(u) OVER {v.w(14)} AS ag, avg(dn) OVER {v.w(14)} AS al,
  row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS bk FROM f),
k AS (SELECT a.symbol, avg(CASE WHEN b.vol <= a.vol THEN 1.0e0 ELSE 0 END) * 100 AS vol_1y_percentile FROM g a JOIN g b ON a.symbol = b.symbol AND b.bk <= 253 AND b.vol IS NOT NULL WHERE a.bk = 1 GROUP BY 1),
o AS (SELECT g.symbol, date, close AS last, chg_1w_pct, chg_1m_pct, chg_3m_pct, (close - lo) / (hi - lo) * 100 AS pos_in_52w_range_pct, CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) ELSE 100 END AS rsi14,
  (close / s50 - 1) * 100 AS price_vs_sma50_pct, (close / s200 - 1) * 100 AS price_vs_sma200_pct, vol * {A!r} AS realized_vol_20d_ann, vol_1y_percentile FROM g JOIN k USING (symbol) WHERE bk = 1)
SELECT {sql_rounded(['symbol', 'date'], _SNAP, 4)} FROM o""")
def market_snapshot(spark, d):
    return rounded(su.market_snapshot(t.bars_daily(spark, d)), ["symbol", "date"], _SNAP, 4)


HIST_SQL = """hist AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) / 1e6 AS alpha, avg(CASE WHEN o_orderkey % 2 = 0 THEN 1.0e0 ELSE -1.0e0 END) AS rho, stddev_samp(o_totalprice) / 1e5 AS nu FROM orders GROUP BY ALL)"""


def history(spark, d):
    o = t.table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date(F.trunc("o_orderdate", "month")).alias("date")).agg(
        (F.avg("o_totalprice") / 1e6).alias("alpha"), F.avg(F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(-1.0)).alias("rho"), (F.stddev_samp("o_totalprice") / 1e5).alias("nu"))


@query("parameter_stats", "A25 W39", f"""WITH {HIST_SQL}, l AS (SELECT symbol, date, 'alpha' AS parameter, alpha AS value FROM hist UNION ALL SELECT symbol, date, 'rho', rho FROM hist UNION ALL SELECT symbol, date, 'nu', nu FROM hist),
d AS (SELECT *, value - lag(value) OVER (PARTITION BY symbol, parameter ORDER BY date) AS dd FROM l), e AS (SELECT *, stddev_pop(dd) OVER (PARTITION BY symbol, parameter) AS cv FROM d)
SELECT symbol, parameter, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) + 0.0 AS min, round(max(value), 6) AS max, round(max(cv), 6) AS change_vol, round(max(abs(dd)), 6) AS max_jump, count(CASE WHEN cv > 0 AND abs(dd) / cv > 3 THEN 1 END) AS jumps FROM e GROUP BY ALL""")
def parameter_stats(spark, d):
    return rounded(su.parameter_stats(history(spark, d), ["alpha", "rho", "nu"]), ["symbol", "parameter", "jumps"], ["mean", "std", "min", "max", "change_vol", "max_jump"])


@query("parameter_stress", "W40", f"""WITH {HIST_SQL}, z AS (SELECT *, coalesce(abs((nu - avg(nu) OVER p) / stddev_pop(nu) OVER p) > 2, false) AS a, coalesce(abs(rho - lag(rho) OVER {v.LINE}) > 0.3, false) AS b, (alpha - avg(alpha) OVER p) / stddev_samp(alpha) OVER p > 2 AS c FROM hist WINDOW p AS (PARTITION BY symbol))
SELECT symbol, date, a AS nu_spike, b AS rho_flip, c AS alpha_surge, round((a::INT + b::INT + c::INT) / 3.0e0, 6) AS stress_score FROM z""")
def parameter_stress(spark, d):
    return su.stress_periods(history(spark, d)).select("symbol", "date", "nu_spike", "rho_flip", "alpha_surge", F.round("stress_score", 6).alias("stress_score"))


@query("regime_transitions", "W38", f"""WITH {HIST_SQL}, x AS (SELECT symbol, date, CASE WHEN alpha > 0.25 THEN 1 ELSE 0 END AS lb FROM hist), y AS (SELECT *, lag(lb) OVER {v.LINE} AS pv FROM x)
SELECT symbol, date, pv AS from_label, lb AS to_label FROM y WHERE pv IS NOT NULL AND pv <> lb""")
def regime_transitions(spark, d):
    return su.transitions(history(spark, d).withColumn("lb", F.when(F.col("alpha") > 0.25, 1).otherwise(0)), "lb")


@query("validation_summary", "A26", f"""WITH {HIST_SQL}, w AS (SELECT symbol, date AS "window", nu AS price_rmse, alpha AS vol_rmse, rho FROM hist)
SELECT symbol, count(*) AS n_windows, round(avg(price_rmse), 6) AS avg_price_rmse, round(avg(vol_rmse), 6) AS avg_vol_rmse, round(stddev_pop(rho), 6) AS rho_std, arg_min("window", (price_rmse, "window")) FILTER (WHERE price_rmse IS NOT NULL) AS best_window, arg_max("window", (price_rmse, "window")) FILTER (WHERE price_rmse IS NOT NULL) AS worst_window FROM w GROUP BY 1""")
def validation_summary(spark, d):
    w = history(spark, d).select("symbol", F.col("date").alias("window"), F.col("nu").alias("price_rmse"), F.col("alpha").alias("vol_rmse"), "rho")
    return rounded(su.validation_summary(w, ["symbol"], ["rho"]), ["symbol", "n_windows", "best_window", "worst_window"], ["avg_price_rmse", "avg_vol_rmse", "rho_std"])


def feature_matrix_frame(spark, d, start="1996-06-01"):
    """All feature groups on the bar spine, trimmed after the warm-up rows have been used."""
    bars = t.bars_daily(spark, d)
    x = ind.technicals(bars)
    x = ind.add_momentum(ind.add_microstructure(ind.add_risk(ind.add_derived(x))))
    x = align_to_spine(x, index_returns(spark, d, bars), ["symbol"], "date", ["idx"], 5)
    x = ind.add_cross_asset(x, "idx").withColumnRenamed("idx", "index_return")
    f = _fund(spark, d)
    x = asof_join(x, f, ["symbol"], "date", "period_end", [c for c in f.columns if c.startswith("fund_")])
    x = mx.merge_news(x, _daily(spark, d), ["news_sent_score"])
    m = insider_monthly(t.insider_transactions(spark, d)).select("symbol", month_start().alias("at"), F.col("change").alias("insdr_change"), F.col("mspr").alias("insdr_mspr"))
    x = asof_join(x, m, ["symbol"], "date", "at", ["insdr_change", "insdr_mspr"])
    x = event_distance(x, t.report_dates(spark, d), ["symbol"], "date", "event_date")
    x = x.drop("prev_close", "delta", "true_range")
    return mx.ordered(mx.trim_warmup(x, F.lit(start).cast("date")))


@query("feature_matrix", "S3 P1 P2 S15")
def feature_matrix(spark, d):
    x = feature_matrix_frame(spark, d)
    return x.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in x.dtypes])


@query("clean_matrix", "P3 P4 A14 W23")
def clean_matrix(spark, d):
    """The matrix with dead and constant columns dropped, slow columns carried and medians filled."""
    x = cut_lineage(feature_matrix_frame(spark, d))
    return mx.clean(x, [c for c in x.columns if c.startswith(("fund_", "news_", "insdr_")) and c != "fund_quarter_end"])


@query("stage_store", "S15 S19 S3", f"""WITH {v.BARS}, b AS (SELECT symbol, date, CASE WHEN symbol = 'A' AND date_trunc('month', date) = DATE '1998-03-01' THEN close + 1 ELSE close END AS close FROM bars),
l AS (SELECT symbol, max(date) AS last FROM b GROUP BY 1) SELECT symbol, date, round(close, 4) AS close FROM b JOIN l USING (symbol) WHERE date BETWEEN last - 30 - 400 AND last""")
def stage_store(spark, d):
    """A stage in partitions per symbol and month; one month of one symbol is replaced; the last 30 days are read with their warm-up."""
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    bars = t.bars_daily(spark, d).select("symbol", "date", "close")
    hs.export(bars, path)
    fixed = bars.where("symbol = 'A' and trunc(date, 'month') = date'1998-03-01'").withColumn("close", F.col("close") + 1)
    hs.export(fixed, path)
    stored = hs.read_export(spark, path, "symbol string, date date, close double, month date")
    wanted = cut_lineage(bars.groupBy("symbol").agg(F.date_sub(F.max("date"), 30).alias("first"), F.max("date").alias("last")))
    return hs.warm_rows(stored, wanted).select("symbol", "date", F.round("close", 4).alias("close"))
