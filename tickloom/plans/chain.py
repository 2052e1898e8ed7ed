"""Option chain queries: cleaning, surface, greeks, implied volatility, SABR, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import options as op
from tickloom.operators.frames import fence
from tickloom.operators.sets import keep_one
from tickloom.plans import views_sql as v
from tickloom.plans.registry import query, rounded, sql_rounded
from tickloom.session import cut_lineage
from tickloom.sources import tables as t

R = t.RATE
CK = ["symbol", "days_to_expiry", "strike", "option_type"]

QUOTES_SQL = f"""{v.CHAIN},
q0 AS (SELECT *, (bid + ask) / 2 AS mid_price, strike / spot AS moneyness, exp(-0.04e0 * time_to_maturity) AS discount_factor FROM chain),
q1 AS (SELECT *, CASE WHEN mid_price <> 0 THEN (ask - bid) / mid_price END AS spread_pct, ln(moneyness) AS log_moneyness, strike * discount_factor AS pv_strike FROM q0),
quotes AS (SELECT *, CASE WHEN option_type = 'call' THEN greatest(spot - pv_strike, 0) ELSE greatest(pv_strike - spot, 0) END AS intrinsic_value FROM q1),
flags AS (SELECT *, coalesce(days_to_expiry > 0, false) AS f1, coalesce(volume, 0) >= 5 AS f2, coalesce(open_interest, 0) >= 1 AS f3,
  coalesce(spread_pct <= 0.5, false) AS f4, moneyness BETWEEN 0.70 AND 1.30 AS f5, mid_price > 0 AS f6, mid_price >= intrinsic_value * 0.95e0 AS f7 FROM quotes),
clean AS (SELECT * EXCLUDE (f1, f2, f3, f4, f5, f6, f7) FROM flags WHERE f1 AND f2 AND f3 AND f4 AND f5 AND f6 AND f7)"""


def quotes(spark, d):
    return op.quote_fields(t.chain(spark, d), R)


def cleaned(spark, d):
    return op.clean_quotes(quotes(spark, d))


@query("option_chain", "Q2 view", f"WITH {v.CHAIN} SELECT * FROM chain")
def option_chain(spark, d):
    return t.chain(spark, d)


_QF = ["mid_price", "spread_pct", "moneyness", "log_moneyness", "discount_factor", "pv_strike", "intrinsic_value"]


@query("quote_fields", "F11", f"WITH {QUOTES_SQL} SELECT {sql_rounded(CK, _QF)} FROM quotes")
def quote_fields(spark, d):
    return rounded(quotes(spark, d), CK, _QF)


@query("quotes_cleaned", "P6", f"WITH {QUOTES_SQL} SELECT symbol, days_to_expiry, strike, option_type, bid, ask FROM clean")
def quotes_cleaned(spark, d):
    return cleaned(spark, d).select(*CK, "bid", "ask")


@query("cleaning_funnel", "P7", f"""WITH {QUOTES_SQL} SELECT symbol, count(*) AS initial, count(*) FILTER (WHERE f1) AS after_unexpired,
  count(*) FILTER (WHERE f1 AND f2) AS after_volume, count(*) FILTER (WHERE f1 AND f2 AND f3) AS after_open_interest,
  count(*) FILTER (WHERE f1 AND f2 AND f3 AND f4) AS after_spread, count(*) FILTER (WHERE f1 AND f2 AND f3 AND f4 AND f5) AS after_moneyness,
  count(*) FILTER (WHERE f1 AND f2 AND f3 AND f4 AND f5 AND f6) AS after_positive_price,
  count(*) FILTER (WHERE f1 AND f2 AND f3 AND f4 AND f5 AND f6 AND f7) AS after_arbitrage FROM flags GROUP BY 1""")
def cleaning_funnel(spark, d):
    return op.cleaning_funnel(quotes(spark, d))


@query("density_gate", "P17", f"""WITH {QUOTES_SQL}, n AS (SELECT symbol, snapshot_date, expiry, count(*) AS n FROM clean GROUP BY ALL),
g AS (SELECT symbol, snapshot_date, min(n) AS min_per_expiry, CAST(sum(n) AS BIGINT) AS total, count(*) AS expiries, avg(n) AS avg_per_expiry FROM n GROUP BY ALL)
SELECT symbol, snapshot_date, min_per_expiry, total, expiries, round(avg_per_expiry, 6) AS avg_per_expiry,
  min_per_expiry >= 12 OR total >= 20 OR (expiries >= 3 AND avg_per_expiry >= 7) AS passes FROM g""")
def density_gate(spark, d):
    return op.density_gate(cleaned(spark, d)).withColumn("avg_per_expiry", F.round("avg_per_expiry", 6))


FRONT_SQL = """fe0 AS (SELECT symbol, expiry, sum(coalesce(open_interest, 0)) AS oi FROM chain GROUP BY ALL),
fe AS (SELECT symbol, coalesce(min(CASE WHEN oi > 0 THEN expiry END), min(expiry)) AS expiry FROM fe0 GROUP BY 1),
front AS (SELECT c.* FROM chain c JOIN fe USING (symbol, expiry)),
pp AS (SELECT symbol, strike, CAST(sum(CASE WHEN option_type = 'call' THEN coalesce(open_interest, 0) ELSE 0 END) AS DOUBLE) AS c,
  CAST(sum(CASE WHEN option_type = 'put' THEN coalesce(open_interest, 0) ELSE 0 END) AS DOUBLE) AS p FROM front GROUP BY ALL),
pain AS (SELECT a.symbol, a.strike, round(sum(greatest(a.strike - b.strike, 0) * b.c + greatest(b.strike - a.strike, 0) * b.p), 2) AS pain
  FROM pp a JOIN pp b USING (symbol) GROUP BY ALL),
mp AS (SELECT symbol, arg_min(strike, (pain, strike)) AS opt_max_pain FROM pain GROUP BY 1),
atm AS (SELECT symbol, arg_min(quoted_vol, (abs(strike - spot), strike)) AS iv FROM front WHERE option_type = 'call' AND quoted_vol >= 0.15 GROUP BY 1),
oi AS (SELECT symbol, expiry, CAST(sum(CASE WHEN option_type = 'call' THEN coalesce(open_interest, 0) ELSE 0 END) AS BIGINT) AS c,
  CAST(sum(CASE WHEN option_type = 'put' THEN coalesce(open_interest, 0) ELSE 0 END) AS BIGINT) AS p FROM front GROUP BY ALL)"""


@query("surface_metrics", "A6 A7 A8 A9 J11 P9", f"""WITH {v.CHAIN}, {FRONT_SQL}
SELECT oi.symbol, oi.expiry, CASE WHEN c + p > 0 THEN iv END AS opt_atm_iv, CASE WHEN c <> 0 THEN round(p * 1.0e0 / c, 4) END AS opt_put_call_oi,
  CASE WHEN c + p > 0 THEN c + p END AS opt_total_oi, CASE WHEN c + p > 0 THEN opt_max_pain END AS opt_max_pain
FROM oi LEFT JOIN atm USING (symbol) JOIN mp USING (symbol)""")
def surface_metrics(spark, d):
    return op.surface_metrics(t.chain(spark, d))


FORWARD_SQL = """fw0 AS (SELECT symbol, snapshot_date, expiry, strike, any_value(spot) AS spot, any_value(time_to_maturity) AS tt,
    max(CASE WHEN option_type = 'call' THEN mid_price END) AS call, max(CASE WHEN option_type = 'put' THEN mid_price END) AS put FROM clean GROUP BY ALL),
fw1 AS (SELECT symbol, snapshot_date, expiry, arg_min({'k': strike, 't': tt, 'c': call, 'p': put}, (abs(strike - spot), strike)) AS a FROM fw0 GROUP BY ALL),
fwd AS (SELECT symbol, snapshot_date, expiry, a.k AS strike, a.c AS call, a.p AS put, a.k + exp(0.04e0 * a.t) * (a.c - a.p) AS forward FROM fw1 WHERE a.c IS NOT NULL AND a.p IS NOT NULL)"""


@query("parity_forwards", "Q1 A8 J19", f"""WITH {QUOTES_SQL}, {FORWARD_SQL}
SELECT {sql_rounded(['symbol', 'snapshot_date', 'expiry', 'strike'], ['call', 'put', 'forward'], 5)} FROM fwd""")
def parity_forwards(spark, d):
    f = op.forwards(cleaned(spark, d), R)
    return rounded(f, ["symbol", "snapshot_date", "expiry", "strike"], ["call", "put", "forward"], 5)


GREEK_COLS = ["price", "delta", "gamma", "theta_per_day", "vega_per_pct", "rho_per_pct", "charm_per_day", "vanna", "volga_per_pct"]


def greeks_sql(src: str, vol: str, q: str = "0.01e0") -> str:
    r, s, k, tt, g = "0.04e0", "spot", "strike", "time_to_maturity", vol
    return f"""gk0 AS (SELECT *, {v.d12(vol, q=q)} FROM {src}),
gk1 AS (SELECT *, {v.ncdf('d1')} AS cn1, {v.ncdf('d2')} AS cn2, {v.ncdf('n1')} AS cm1, {v.ncdf('n2')} AS cm2, exp(-d1 * d1 / 2) / 2.5066282746310002 AS phi,
  exp(-{q} * {tt}) AS eq, exp(-{r} * {tt}) AS er, sqrt({tt}) AS root FROM gk0),
gk2 AS (SELECT *, {s} * eq * phi * root AS vega, -({s} * eq * phi * {g}) / (2 * root) AS decay,
  eq * phi * (2 * ({r} - {q}) * {tt} - d2 * {g} * root) / (2 * {tt} * {g} * root) AS drift FROM gk1),
greeks AS (SELECT *, CASE WHEN option_type = 'call' THEN {s} * eq * cn1 - {k} * er * cn2 ELSE {k} * er * cm2 - {s} * eq * cm1 END AS price,
  CASE WHEN option_type = 'call' THEN eq * cn1 ELSE eq * (cn1 - 1) END AS delta, eq * phi / ({s} * {g} * root) AS gamma,
  CASE WHEN option_type = 'call' THEN decay + {q} * {s} * eq * cn1 - {r} * {k} * er * cn2 ELSE decay - {q} * {s} * eq * cm1 + {r} * {k} * er * cm2 END / 365 AS theta_per_day,
  vega / 100 AS vega_per_pct, CASE WHEN option_type = 'call' THEN {k} * {tt} * er * cn2 ELSE -{k} * {tt} * er * cm2 END / 100 AS rho_per_pct,
  CASE WHEN option_type = 'call' THEN -{q} * eq * cn1 + drift ELSE {q} * eq * cm1 + drift END / 365 AS charm_per_day,
  vega * (1 - d1 / ({g} * root)) / {s} AS vanna, vega * d1 * d2 / {g} / 100 AS volga_per_pct FROM gk2)"""


@query("black_scholes_greeks", "Q2", f"WITH {v.CHAIN}, {greeks_sql('chain', 'true_vol')} SELECT {sql_rounded(CK, GREEK_COLS)} FROM greeks")
def black_scholes_greeks(spark, d):
    return rounded(op.add_greeks(t.chain(spark, d), "true_vol", R, 0.01), CK, GREEK_COLS)


@query("portfolio_greeks", "A21", f"""WITH {v.CHAIN}, {greeks_sql('chain', 'true_vol')} SELECT symbol, {', '.join(f'round(sum({c} * qty), 3) + 0.0 AS {c}' for c in GREEK_COLS[:6])}
FROM (SELECT *, (CAST(floor(strike * 10 + 0.5e0) AS BIGINT) % 5) - 2 AS qty FROM greeks) t GROUP BY 1""")
def portfolio_greeks(spark, d):
    from tickloom.operators.portfolio import portfolio_greeks as total
    g = op.add_greeks(t.chain(spark, d), "true_vol", R, 0.01).withColumn("qty", F.pmod(F.floor(F.col("strike") * 10 + 0.5).cast("long"), F.lit(5)) - 2)
    return rounded(total(g, "qty", ["symbol"]), ["symbol"], GREEK_COLS[:6], 3)


@query("delta_parity", "J19 Q7", f"""WITH {v.CHAIN}, {greeks_sql('chain', 'true_vol', '0.0e0')}, p AS (SELECT symbol, snapshot_date, expiry, strike,
  max(CASE WHEN option_type = 'call' THEN delta END) AS call, max(CASE WHEN option_type = 'put' THEN delta END) AS put FROM greeks GROUP BY ALL)
SELECT symbol, snapshot_date, expiry, strike, round(call, 6) + 0.0 AS call, round(put, 6) + 0.0 AS put, round(abs(call - put - 1), 6) + 0.0 AS parity_error FROM p""")
def delta_parity(spark, d):
    g = op.add_greeks(t.chain(spark, d), "true_vol", R)
    return rounded(op.parity_error(g), ["symbol", "snapshot_date", "expiry", "strike"], ["call", "put", "parity_error"])


IV_SQL = f"""it AS (
  SELECT symbol, days_to_expiry, strike, option_type, spot, time_to_maturity, mid_price, 1e-4 AS lo, 4.0e0 AS hi, 0 AS i FROM clean
  UNION ALL
  SELECT symbol, days_to_expiry, strike, option_type, spot, time_to_maturity, mid_price, CASE WHEN val < mid_price THEN m ELSE lo END, CASE WHEN val < mid_price THEN hi ELSE m END, i + 1
  FROM (SELECT *, {v.bs()} AS val FROM (SELECT *, {v.d12('m')} FROM (SELECT *, (lo + hi) / 2 AS m FROM it WHERE i < 50) a) b) c),
bd AS (SELECT symbol, days_to_expiry, strike, option_type, min(val) AS floor_val FROM (SELECT *, {v.bs()} AS val FROM (SELECT *, {v.d12('1e-4')} FROM clean) a) b GROUP BY ALL),
ivs AS (SELECT c.*, CASE WHEN bd.floor_val <= c.mid_price THEN (it.lo + it.hi) / 2 END AS implied_volatility
  FROM clean c JOIN it USING (symbol, days_to_expiry, strike, option_type) JOIN bd USING (symbol, days_to_expiry, strike, option_type) WHERE it.i = 50)"""


@query("implied_volatility", "Q3 P8", f"""WITH RECURSIVE {QUOTES_SQL}, {IV_SQL}
SELECT symbol, days_to_expiry, strike, option_type, round(implied_volatility, 5) AS implied_volatility FROM ivs WHERE implied_volatility > 0 AND implied_volatility < 3""")
def implied_volatility(spark, d):
    return rounded(op.valid_vol(op.add_implied_vol(cleaned(spark, d), R)), CK, ["implied_volatility"], 5)


# beta 1: the surface depends on log(F/K) only
SABR_SQL = """sb0 AS (SELECT *, ln(spot * exp(0.04e0 * time_to_maturity) / strike) AS lfk FROM {src}),
sb1 AS (SELECT *, (0.8e0 / 0.25e0) * lfk AS z FROM sb0),
sb2 AS (SELECT *, CASE WHEN abs(z) < 1e-10 THEN 1.0e0 ELSE ln((sqrt(1 + 0.6e0 * z + z * z) + z + 0.3e0) / 1.3e0) / z END AS xz FROM sb1),
sb AS (SELECT *, 0.25e0 * xz * (1 + ((-0.3e0 * 0.8e0 * 0.25e0) / 4 + ((2 - 3 * 0.09e0) / 24) * 0.64e0) * time_to_maturity) AS model_iv FROM sb2)"""


def sabr_fixed(df):
    f = F.col("spot") * F.exp(F.lit(R) * F.col("time_to_maturity"))
    return fence(op.with_sabr_vol(df, "model_iv", f, F.col("strike"), F.col("time_to_maturity"), *[F.lit(x) for x in (0.25, 1.0, -0.3, 0.8)]))


@query("sabr_surface", "Q4", f"""WITH {v.CHAIN}, {SABR_SQL.format(src='chain')}, sp AS (SELECT * EXCLUDE (d1, d2, n1, n2), {v.bs()} AS model_price FROM (SELECT *, {v.d12('model_iv')} FROM sb) q)
SELECT {sql_rounded(CK, ['model_iv', 'model_price'])} FROM sp""")
def sabr_surface(spark, d):
    c = op.with_sabr_price(sabr_fixed(t.chain(spark, d)), "model_price", F.col("spot"), F.col("strike"), F.col("time_to_maturity"), F.lit(R), "model_iv",
                           F.col("option_type") == "call")
    return rounded(c, CK, ["model_iv", "model_price"])


@query("quote_weights", "Q5", f"""WITH {QUOTES_SQL}, x AS (SELECT *, exp(-0.5e0 * log_moneyness * log_moneyness / (true_vol * true_vol * time_to_maturity + 1e-6)) AS w FROM clean)
SELECT symbol, days_to_expiry, strike, option_type, round(w / avg(w) OVER (PARTITION BY symbol, snapshot_date), 6) AS weight FROM x""")
def quote_weights(spark, d):
    q = cleaned(spark, d).withColumn("implied_volatility", F.col("true_vol"))
    return rounded(op.add_quote_weights(q), CK, ["weight"])


def _ready(spark, d):
    """Quotes of surfaces dense enough to calibrate, with volatility and weights.

    The solved volatilities are written once; the grid rounds read them several times.
    """
    q = cut_lineage(op.valid_vol(op.add_implied_vol(cleaned(spark, d), R)))
    ok = op.density_gate(q).where("passes").select(*op.GROUP)
    return op.add_quote_weights(q.join(ok, list(op.GROUP), "left_semi"))


@query("sabr_calibration", "Q5 Q6")
def sabr_calibration(spark, d):
    c = op.calibrate_sabr(_ready(spark, d), R)
    return rounded(c, ["symbol", "snapshot_date", "alpha_ok", "nu_ok", "rho_ok"], ["alpha", "rho", "nu", "vol_rmse", "price_rmse", "objective"], 5)


@query("sabr_penalties", "Q6", """WITH p AS (SELECT p_partkey, p_size / 40.0e0 - 0.2e0 AS alpha, (p_retailprice - 950) / 40 AS rho, p_size / 25.0e0 - 0.5e0 AS nu FROM part),
x AS (SELECT *, CASE WHEN alpha < 0.001 THEN exp(0.001e0 - alpha) - 1 ELSE 0 END + CASE WHEN nu < 0.001 THEN exp(0.001e0 - nu) - 1 ELSE 0 END +
  CASE WHEN rho < -0.99 THEN exp(-0.99e0 - rho) - 1 WHEN rho > 0.99 THEN exp(rho - 0.99e0) - 1 ELSE 0 END AS pen FROM p)
SELECT p_partkey, round(pen * 1000, 5) AS penalty, alpha > 0 AND nu > 0 AND abs(rho) < 1 AS valid FROM x""")
def sabr_penalties(spark, d):
    p = t.table(spark, d, "part").select("p_partkey", (F.col("p_size") / 40.0 - 0.2).alias("alpha"), ((F.col("p_retailprice") - 950) / 40).alias("rho"), (F.col("p_size") / 25.0 - 0.5).alias("nu"))
    a, r, n = F.col("alpha"), F.col("rho"), F.col("nu")
    return p.select("p_partkey", F.round(op.sabr_penalty(a, r, n), 5).alias("penalty"), ((a > 0) & (n > 0) & (F.abs(r) < 1)).alias("valid"))


@query("sabr_greeks", "Q7 J14")
def sabr_greeks(spark, d):
    g = op.sabr_greeks(t.chain(spark, d), R, F.lit(0.25), F.lit(-0.3), F.lit(0.8))
    return rounded(g, CK, ["sabr_vol", "sabr_delta", "sabr_gamma", "sabr_vega", "sabr_theta", "sabr_vanna", "delta_error", "gamma_error", "vega_error"])


@query("greeks_grid", "J14", f"""WITH {v.CHAIN}, k AS (SELECT symbol, strike, any_value(spot) AS spot FROM chain GROUP BY ALL),
g AS (SELECT *, months / 12.0e0 AS time_to_maturity FROM k CROSS JOIN (VALUES (1), (3), (6), (12)) m(months) CROSS JOIN (VALUES ('call'), ('put')) o(option_type)),
g2 AS (SELECT *, 0.2e0 AS vol FROM g), {greeks_sql('g2', 'vol', '0.0e0')}
SELECT {sql_rounded(['symbol', 'strike', 'months', 'option_type'], ['delta', 'gamma', 'vega_per_pct'])} FROM greeks""")
def greeks_grid(spark, d):
    k = t.chain(spark, d).groupBy("symbol", "strike").agg(F.first("spot").alias("spot"))
    k = k.withColumn("months", F.explode(F.array(*[F.lit(m) for m in (1, 3, 6, 12)]))).withColumn("option_type", F.explode(F.array(F.lit("call"), F.lit("put"))))
    k = k.withColumns({"time_to_maturity": F.col("months") / 12.0, "vol": F.lit(0.2)})
    return rounded(op.add_greeks(k, "vol", R), ["symbol", "strike", "months", "option_type"], ["delta", "gamma", "vega_per_pct"])


@query("greeks_lookup_join", "J7", f"""WITH {v.CHAIN}, {greeks_sql('chain', 'true_vol', '0.0e0')},
src AS (SELECT symbol, days_to_expiry, strike, option_type, delta FROM greeks WHERE CAST(floor(strike * 10 + 0.5e0) AS BIGINT) % 3 = 0)
SELECT c.symbol, c.days_to_expiry, c.strike, c.option_type, round(src.delta, 6) + 0.0 AS delta FROM chain c LEFT JOIN src USING (symbol, days_to_expiry, strike, option_type)""")
def greeks_lookup_join(spark, d):
    """A provider's greeks arrive twice for some contracts; one row per contract is kept."""
    c = t.chain(spark, d)
    g = op.add_greeks(c.where(F.floor(F.col("strike") * 10 + 0.5).cast("long") % 3 == 0), "true_vol", R).select(*CK, "delta", F.lit(0).alias("rev"))
    doubled = g.unionByName(g.withColumns({"delta": F.lit(0.0), "rev": F.lit(1)}))
    one = keep_one(doubled, CK, ["rev"]).select(*CK, "delta")
    return c.select(*CK).join(one, CK, "left").withColumn("delta", F.round("delta", 6))
