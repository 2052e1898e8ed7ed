"""Label, statistics and econometrics queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import econometrics as ec, indicators as ind, learning as ml, matrix as mx, stats as st
from tickloom.operators.frames import Series
from tickloom.plans import views_sql as v
from tickloom.plans.features import A
from tickloom.plans.registry import query, rounded, sql_rounded
from tickloom.session import cut_lineage
from tickloom.sources import tables as t

KEY = ["symbol", "date"]
RV_SQL = f"""rv AS (SELECT *, {v.gate('stddev_samp(log_return)', 'log_return', 20, 5)} * {A!r} AS realized_vol_20d,
  {v.gate('stddev_samp(log_return)', 'log_return', 20)} AS std20 FROM ret)"""
_AH = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
TARGET_SQL = f"""{v.BARS}, {v.RET}, {RV_SQL}, tg0 AS (SELECT *, lead(log_return) OVER {v.LINE} AS target_1d,
  CASE WHEN count(log_return) {_AH} = 5 THEN sum(log_return) {_AH} END AS target_5d,
  CASE WHEN count(log_return) {_AH} = 5 THEN stddev_samp(log_return) {_AH} END AS target_vol_5d, lead(std20) OVER {v.LINE} AS n20,
  CASE WHEN realized_vol_20d IS NOT NULL THEN (rank() OVER (PARTITION BY symbol ORDER BY realized_vol_20d NULLS LAST)
    + (count(*) OVER (PARTITION BY symbol, realized_vol_20d) - 1) / 2.0e0) / count(realized_vol_20d) OVER (PARTITION BY symbol) END AS rk FROM rv),
targets AS (SELECT *, CASE WHEN target_1d > 0.005 THEN 1 WHEN target_1d < -0.005 THEN -1 ELSE 0 END AS target_dir_1d,
  CAST(coalesce(abs(target_1d) > 2 * n20, false) AS INTEGER) AS target_large_move,
  CASE WHEN rk <= 1 / 3.0e0 THEN 0.0e0 WHEN rk <= 2 / 3.0e0 THEN 1.0e0 WHEN rk IS NOT NULL THEN 2.0e0 END AS target_regime FROM tg0)"""


def base(spark, d):
    return ind.add_risk(ind.add_returns(t.bars_daily(spark, d)))


def labelled(spark, d):
    return st.add_targets(base(spark, d))


@query("forward_targets", "W25 W26 W27", f"""WITH {TARGET_SQL}
SELECT {sql_rounded(KEY + ['target_dir_1d', 'target_large_move', 'target_regime'], ['target_1d', 'target_5d', 'target_vol_5d'])} FROM targets""")
def forward_targets(spark, d):
    return rounded(labelled(spark, d), KEY + ["target_dir_1d", "target_large_move", "target_regime"], ["target_1d", "target_5d", "target_vol_5d"])


@query("column_describe", "A10 F8", f"""WITH {TARGET_SQL}, l AS (SELECT symbol, 'log_return' AS feature, log_return AS value FROM targets UNION ALL
  SELECT symbol, 'realized_vol_20d', realized_vol_20d FROM targets UNION ALL SELECT symbol, 'target_5d', target_5d FROM targets),
g AS (SELECT symbol, feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
  skewness(value) AS skew, kurtosis(value) AS kurt, round((1 - count(value) * 1.0e0 / count(*)) * 100, 2) AS null_pct FROM l GROUP BY ALL)
SELECT {sql_rounded(['symbol', 'feature', 'n', 'null_pct'], ['mean', 'std', 'min', 'max', 'skew', 'kurt'], 5)} FROM g""")
def column_describe(spark, d):
    x = st.describe(labelled(spark, d), ["log_return", "realized_vol_20d", "target_5d"])
    return rounded(x, ["symbol", "feature", "n", "null_pct"], ["mean", "std", "min", "max", "skew", "kurt"], 5)


_FE = ["log_return", "realized_vol_20d", "volume", "close"]


@query("target_correlations", "A11 O5", f"""WITH {TARGET_SQL}, l AS ({' UNION ALL '.join(f"SELECT symbol, '{c}' AS feature, {c} AS value, target_1d FROM targets" for c in _FE)}),
g AS (SELECT symbol, feature, corr(value, target_1d) AS c FROM l GROUP BY ALL)
SELECT symbol, feature, round(c, 6) + 0.0 AS corr, CAST(row_number() OVER (PARTITION BY symbol ORDER BY c DESC, feature) AS INTEGER) AS top_rank,
  CAST(row_number() OVER (PARTITION BY symbol ORDER BY c, feature) AS INTEGER) AS bottom_rank FROM g""")
def target_correlations(spark, d):
    x = st.target_correlations(labelled(spark, d), _FE, "target_1d")
    return x.withColumn("corr", F.round("corr", 6))


@query("correlation_matrix", "A11 M2", f"""WITH {TARGET_SQL} {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM targets" for i, a in enumerate(_FE) for b in _FE[i + 1:])}""")
def correlation_matrix(spark, d):
    return st.correlation_matrix(labelled(spark, d), _FE).withColumn("corr", F.round("corr", 6))


@query("return_histogram", "A12", f"""WITH {v.BARS}, {v.RET}, l AS (SELECT symbol, min(log_return) AS lo, max(log_return) AS hi FROM ret GROUP BY 1)
SELECT symbol, CAST(least(floor((log_return - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM ret JOIN l USING (symbol) WHERE log_return IS NOT NULL GROUP BY ALL""")
def return_histogram(spark, d):
    return st.histogram(ind.add_returns(t.bars_daily(spark, d)), "log_return", 50)


@query("class_balance", "A13", f"""WITH {TARGET_SQL}, g AS (SELECT symbol, target_dir_1d, count(*) AS n FROM targets GROUP BY ALL)
SELECT symbol, target_dir_1d, n, round(n * 1.0e0 / sum(n) OVER (PARTITION BY symbol), 6) AS share FROM g""")
def class_balance(spark, d):
    return st.class_balance(labelled(spark, d), "target_dir_1d").withColumn("share", F.round("share", 6))


@query("train_stats", "A15", f"""WITH {TARGET_SQL}, l AS ({' UNION ALL '.join(f"SELECT symbol, '{c}' AS feature, {c} AS value FROM targets" for c in _FE[:3])})
SELECT symbol, feature, round(avg(value), 4) + 0.0 AS mean, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.05), 4) + 0.0 AS p05, round(quantile_cont(value, 0.95), 4) + 0.0 AS p95 FROM l GROUP BY ALL""")
def train_stats(spark, d):
    return rounded(st.train_stats(labelled(spark, d), _FE[:3]), ["symbol", "feature"], ["mean", "std", "p05", "p95"], 4)


@query("median_scaling", "A14 M1", f"""WITH {TARGET_SQL}, m AS (SELECT symbol, median(log_return) AS m1, median(realized_vol_20d) AS m2 FROM targets GROUP BY 1),
x AS (SELECT symbol, date, coalesce(log_return, m1) AS a, coalesce(realized_vol_20d, m2) AS b FROM targets JOIN m USING (symbol)),
s AS (SELECT symbol, avg(a) AS aa, stddev_pop(a) AS sa, avg(b) AS ab, stddev_pop(b) AS sb FROM x GROUP BY 1)
SELECT symbol, date, round((a - aa) / sa, 6) + 0.0 AS log_return, round((b - ab) / sb, 6) + 0.0 AS realized_vol_20d FROM x JOIN s USING (symbol)""")
def median_scaling(spark, d):
    x = base(spark, d).select(*KEY, "log_return", "realized_vol_20d")
    return rounded(st.standardise(x, ["log_return", "realized_vol_20d"]), KEY, ["log_return", "realized_vol_20d"])


LAGS = 40
KINDS_SQL = """kinds AS (SELECT symbol, date, 'r' AS kind, log_return AS x FROM ret WHERE log_return IS NOT NULL UNION ALL SELECT symbol, date, 'abs_r', abs(log_return) FROM ret WHERE log_return IS NOT NULL
  UNION ALL SELECT symbol, date, 'r2', log_return * log_return FROM ret WHERE log_return IS NOT NULL)"""


def acf_sql(source: str, keys: str, lags: int) -> str:
    """CTEs ending in acf(keys, n, lag, acf) of the column x of ``source``."""
    return f"""ac AS (SELECT {keys}, date, x - avg(x) OVER (PARTITION BY {keys}) AS c FROM {source}),
ag AS (SELECT {keys}, count(*) AS n, [{', '.join(f'coalesce(sum(c * l{k}) / nullif(sum(c * c), 0), NULL)' for k in range(1, lags + 1))}] AS rho
  FROM (SELECT *, {', '.join(f'lag(c, {k}) OVER (PARTITION BY {keys} ORDER BY date) AS l{k}' for k in range(1, lags + 1))} FROM ac) q GROUP BY ALL),
acf AS (SELECT {keys}, n, CAST(unnest(range(1, {lags + 1})) AS INTEGER) AS lag, unnest(rho) AS acf FROM ag)"""


@query("autocorrelation", "W44", f"""WITH {v.BARS}, {v.RET}, {KINDS_SQL}, {acf_sql('kinds', 'symbol, kind', LAGS)} SELECT symbol, kind, lag, round(acf, 6) + 0.0 AS acf FROM acf""")
def autocorrelation(spark, d):
    """Forty lags of returns, absolute and squared returns."""
    a = st.acf(ec.volatility_series(ind.add_returns(t.bars_daily(spark, d))), "x", LAGS, extra=("kind",))
    return a.select("symbol", "kind", "lag", F.round("acf", 6).alias("acf"))


@query("autocorrelation_by_regime", "W44 W45", f"""WITH RECURSIVE {TARGET_SQL}, md AS (SELECT symbol, median(realized_vol_20d) AS m FROM targets WHERE realized_vol_20d IS NOT NULL GROUP BY 1),
hv AS (SELECT symbol, date, CASE WHEN realized_vol_20d <= m THEN 'calm' ELSE 'stress' END AS half, abs(log_return) AS x FROM targets JOIN md USING (symbol) WHERE realized_vol_20d IS NOT NULL AND log_return IS NOT NULL),
{acf_sql('hv', 'symbol, half', LAGS)},
lev AS (SELECT symbol, half, rho, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(NULL AS DOUBLE) AS pac FROM ag
  UNION ALL SELECT symbol, half, rho, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - new * phi[k + 1 - i]), new), new
  FROM (SELECT *, (rho[k + 1] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * rho[k + 1 - i])), 0)) / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * rho[i])), 0)) AS new FROM lev) s WHERE k < {LAGS})
SELECT symbol, half, lag, n, round(acf, 6) + 0.0 AS acf, round(pac, 5) + 0.0 AS pacf FROM acf JOIN (SELECT symbol, half, CAST(k AS INTEGER) AS lag, pac FROM lev WHERE k > 0) p USING (symbol, half, lag)""")
def autocorrelation_by_regime(spark, d):
    """Autocorrelation of absolute returns in calm and stressed halves, with partial autocorrelation."""
    x = base(spark, d).where("realized_vol_20d is not null")
    m = x.groupBy("symbol").agg(F.median("realized_vol_20d").alias("_m"))
    x = x.join(m, "symbol").withColumns({"half": F.when(F.col("realized_vol_20d") <= F.col("_m"), "calm").otherwise("stress"), "ar": F.abs("log_return")})
    a = st.acf(x, "ar", LAGS, extra=("half",))
    return a.join(st.pacf(a, ["symbol", "half"]), ["symbol", "half", "lag"]).withColumns({"acf": F.round("acf", 6), "pacf": F.round("pacf", 5)})


@query("column_catalogue", "S18 A14", f"""WITH {v.BARS}, {v.RET} SELECT 'symbol' AS "column", 'string' AS dtype, 0.0e0 AS null_pct, '-' AS description
UNION ALL SELECT 'close', 'double', 0.0e0, 'closing price' UNION ALL SELECT 'log_return', 'double', round(avg(CASE WHEN log_return IS NULL THEN 1.0e0 ELSE 0 END) * 100, 1), '-' FROM ret""")
def column_catalogue(spark, d):
    x = ind.add_returns(t.bars_daily(spark, d)).select("symbol", "close", "log_return")
    return mx.catalogue(x, {"close": "closing price"})


@query("null_and_constant_columns", "P3 P4 P5", """SELECT 'dead' AS "column", 'mostly_null' AS reason UNION ALL SELECT 'one', 'constant'""")
def null_and_constant_columns(spark, d):
    b = t.bars_daily(spark, d).select(*KEY, "close", F.when(F.dayofmonth("date") == 1, F.col("close")).alias("dead"), F.lit(1.0).alias("one"))
    drop = F.array(*[F.struct(F.lit(c).alias("column"), F.lit("mostly_null").alias("reason")) for c in mx.mostly_null(b)],
                   *[F.struct(F.lit(c).alias("column"), F.lit("constant").alias("reason")) for c in mx.constant_columns(b)])
    return b.agg(F.max("date")).select(F.explode(drop).alias("r")).select("r.*")


# ---- econometrics -----------------------------------------------------------------------------

def rets(spark, d):
    return ind.add_returns(t.bars_daily(spark, d))


def _even_tail(m: int) -> str:
    """Chi-square tail of q for an even number of degrees of freedom."""
    return "exp(-q / 2) * (" + " + ".join(f"pow(q / 2, {i}) / {math.factorial(i)}.0e0" for i in range(m // 2)) + ")"


@query("ljung_box", "E1", f"""WITH {v.BARS}, {v.RET}, {KINDS_SQL}, {acf_sql('kinds', 'symbol, kind', 20)},
qs AS (SELECT symbol, kind, m AS lag, n * (n + 2.0e0) * sum(CASE WHEN acf.lag <= m THEN acf * acf / (n - acf.lag) END) AS q FROM acf CROSS JOIN (VALUES (5), (10), (20)) t(m) GROUP BY symbol, kind, n, m),
qr AS (SELECT *, sqrt(q) AS rt FROM qs)
SELECT symbol, kind, lag, round(q, 5) + 0.0 AS q, round(CASE lag WHEN 10 THEN {_even_tail(10)} WHEN 20 THEN {_even_tail(20)}
  ELSE 2 * (1 - {v.ncdf('rt')}) + sqrt(2 * q / pi()) * exp(-q / 2) * (1 + q / 3) END, 5) + 0.0 AS p_value FROM qr""")
def ljung_box(spark, d):
    return rounded(ec.ljung_box(rets(spark, d)), ["symbol", "kind", "lag"], ["q", "p_value"], 5)


@query("arch_lm_test", "E2")
def arch_lm_test(spark, d):
    return rounded(ec.arch_lm(rets(spark, d)), ["symbol", "n"], ["lm", "p_value"], 5)


def pairs(spark, d):
    """Each symbol as base against the others: the list of symbols is small by nature of a pair study."""
    b = t.bars_daily(spark, d)
    p = b.select(F.col("symbol").alias("base")).distinct().withColumn("peer", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R")))).where("base <> peer")
    return ec.pair_prices(b, p)


PAIR_SQL = f"""{v.BARS}, pp AS (SELECT a.symbol AS base, b.symbol AS peer, a.date, a.close AS y, b.close AS x FROM bars a JOIN bars b ON a.date = b.date AND a.symbol <> b.symbol),
fit AS (SELECT base, peer, regr_slope(y, x) AS hr, regr_intercept(y, x) AS ic FROM pp GROUP BY ALL),
sp AS (SELECT pp.*, hr, ic, y - ic - hr * x AS spread FROM pp JOIN fit USING (base, peer))"""
_PW = "PARTITION BY base, peer ORDER BY date"


@query("engle_granger_spread", "E3 J15 W33 E8", f"""WITH {PAIR_SQL}, z AS (SELECT *, CASE WHEN count(*) OVER q >= 60 THEN (spread - avg(spread) OVER q) / stddev_samp(spread) OVER q END AS zscore FROM sp
  WINDOW q AS ({_PW} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, CASE WHEN zscore >= 1.5 THEN -1 WHEN zscore <= -1.5 THEN 1 WHEN abs(zscore) <= 0.5 THEN 0 END AS mark FROM z)
SELECT base, peer, date, round(hr, 6) + 0.0 AS hedge_ratio, round(spread, 4) + 0.0 AS spread, round(zscore, 5) + 0.0 AS zscore,
  coalesce(last_value(mark IGNORE NULLS) OVER ({_PW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM m""")
def engle_granger_spread(spark, d):
    x = ind.band_state(ec.spread_zscore(ec.engle_granger(pairs(spark, d))), "zscore", s=ec.PAIR)
    return x.select("base", "peer", "date", F.round("hedge_ratio", 6).alias("hedge_ratio"), F.round("spread", 4).alias("spread"), F.round("zscore", 5).alias("zscore"), "position")


@query("spread_half_life", "E5", f"""WITH {PAIR_SQL}, l AS (SELECT *, lag(spread) OVER ({_PW}) AS lev FROM sp), g AS (SELECT base, peer, regr_slope(spread - lev, lev) AS phi FROM l GROUP BY ALL)
SELECT base, peer, round(phi, 6) + 0.0 AS phi, CASE WHEN phi < 0 THEN round(-ln(2) / phi, 1) END AS half_life FROM g""")
def spread_half_life(spark, d):
    h = ec.half_life(ec.engle_granger(pairs(spark, d)), "spread", ec.PAIR)
    return h.withColumn("phi", F.round("phi", 6))


@query("hurst_exponent", "E6", f"""WITH {v.BARS}, d AS (SELECT symbol, close, row_number() OVER {v.LINE} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
e AS (SELECT symbol, close, rn, n, unnest(range(2, 20)) AS lag FROM d), f AS (SELECT *, rn // lag AS c FROM e WHERE lag < n // 4 AND (rn // lag) * lag < n - lag),
g AS (SELECT *, close - avg(close) OVER (PARTITION BY symbol, lag, c) AS dev FROM f),
h AS (SELECT *, sum(dev) OVER (PARTITION BY symbol, lag, c ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM g),
i AS (SELECT symbol, lag, c, max(cum) - min(cum) AS r, stddev_samp(close) AS s FROM h GROUP BY ALL), j AS (SELECT symbol, lag, avg(r / s) AS rs FROM i WHERE s > 0 GROUP BY ALL)
SELECT symbol, round(regr_slope(ln(rs), ln(lag)), 4) AS hurst FROM j GROUP BY 1""")
def hurst_exponent(spark, d):
    return ec.hurst(t.bars_daily(spark, d), "close")


@query("pair_report", "E4 E7")
def pair_report(spark, d):
    return rounded(ec.pair_report(pairs(spark, d)), ["base", "peer", "reject", "tradeable"], ["adf_t", "phi", "half_life", "hurst"], 5)


@query("johansen_rank", "E9")
def johansen_rank(spark, d):
    return rounded(ec.johansen(pairs(spark, d)), ["base", "peer", "rank"], ["trace0", "trace1"], 4)


@query("aligned_prices", "J8", f"""WITH {v.BARS}, p AS (SELECT date, max(close) FILTER (WHERE symbol = 'A') AS "A", max(close) FILTER (WHERE symbol = 'N') AS "N", max(close) FILTER (WHERE symbol = 'R') AS "R" FROM bars GROUP BY 1)
SELECT * FROM p WHERE "A" IS NOT NULL AND "N" IS NOT NULL AND "R" IS NOT NULL""")
def aligned_prices(spark, d):
    return ec.aligned_prices(t.bars_daily(spark, d), ["A", "N", "R"])


@query("garch_models", "E10 E11")
def garch_models(spark, d):
    """ARCH(1, 2, 5, 10) with free alphas and GARCH(1,1) for every symbol."""
    f = ec.fit_volatility(rets(spark, d).select("symbol", "date", "log_return"), ec.SPECS)
    return rounded(f.drop("alphas"), ["symbol", "spec"], [c for c in f.columns if c not in ("symbol", "spec", "alphas")], 6)


@query("ar_order_selection", "E14")
def ar_order_selection(spark, d):
    return rounded(ec.ar_orders(rets(spark, d), "log_return"), ["symbol", "p"], ["aic", "bic", "rss"], 4)


@query("expanding_ar_forecast", "E13")
def expanding_ar_forecast(spark, d):
    """Walk-forward one-step forecasts per symbol: past mean, AR, AR + index change, AR + index change + benchmark return.

    The order, 1 to 3, is the one with the least AIC on the first 120 rows of the symbol.
    """
    s = Series()
    b = t.bars_benchmark(spark, d)
    w = Window.orderBy("date")  # one row per calendar day
    b = b.select("date", (F.col("close") / 1000 - F.lag("close").over(w) / 1000).alias("d_index"), F.log(F.col("close") / F.lag("close").over(w)).alias("bench"))
    x = rets(spark, d).where("log_return is not null").join(b, "date").where("d_index is not null").select("symbol", "date", "log_return", "d_index", "bench")
    x = cut_lineage(ml.number(x))
    first = ec.ar_orders(x.where(F.col("rn") < ml.INIT_TRAIN), "log_return").groupBy("symbol").agg(F.min_by("p", "aic").alias("order"))
    x, names = ec.lagged(x, "log_return", 3)
    x = x.join(first, "symbol").withColumns({n: F.when(F.col("order") >= k, F.col(n)).otherwise(0.0) for k, n in enumerate(names, 1)})
    models = {"ar": names, "ar_index": [*names, "d_index"], "ar_index_bench": [*names, "d_index", "bench"]}
    for m, xs in models.items():
        x = ec.expanding_forecast(x, "log_return", xs, out=m)
    x = x.withColumn("naive", F.avg("log_return").over(s.rows(-(1 << 30), -1))).where("ar is not null and ar_index is not null and ar_index_bench is not null")
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("naive", *models)]))
    long = x.select("symbol", "order", "log_return", one.alias("m")).select("symbol", "order", F.col("m.model").alias("model"), "log_return", F.col("m.p").alias("p"))
    g = ml.regression_metrics(long, "log_return", "p", ["symbol", "order", "model"])
    return rounded(g, ["symbol", "order", "model", "n"], ["rmse", "mae", "dir_acc", "ic"], 5)


def wide_returns(spark, d, most: int = 12):
    """Percent returns with a column per symbol of the table, days with all of them; a joint model takes ``most`` symbols at most."""
    r = rets(spark, d).where("log_return is not null").withColumn("log_return", F.col("log_return") * 100)
    names = sorted(x["symbol"] for x in r.select("symbol").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} symbols for one joint model")
    return r.groupBy("date").pivot("symbol", names).agg(F.first("log_return")).dropna()


@query("var_lag_table", "E15")
def var_lag_table(spark, d):
    return rounded(ec.var_orders(w := wide_returns(spark, d), [c for c in w.columns if c != "date"], 10), ["p", "n"], ["aic", "bic", "hqic", "fpe"], 5)


@query("granger_causality", "E15 E16")
def granger_causality(spark, d):
    """F tests of every ordered pair of symbols at the lag count with the least BIC."""
    w = wide_returns(spark, d)
    return rounded(ec.var_granger(w, [c for c in w.columns if c != "date"]), ["effect", "cause", "p", "n", "causes"], ["f_stat", "p_value"], 5)
