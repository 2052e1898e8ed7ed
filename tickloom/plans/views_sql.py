"""Plain-SQL forms of the views, shared by the check queries."""

from __future__ import annotations


def _bars(name: str, symbol: str) -> str:
    key = "(l_orderkey, l_linenumber, px)"
    return f"""{name} AS (
  SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS date,
    arg_min(px, {key}) AS open, max(px) AS high, min(px) AS low, arg_max(px, {key}) AS close,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume
  FROM (SELECT *, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100.0 AS px FROM lineitem WHERE l_quantity > 0) t
  GROUP BY 1, 2)"""


BARS = _bars("bars", "l_returnflag")
UNIVERSE = _bars("bars", "'S' || CAST(l_suppkey AS VARCHAR)")

RET = """ret AS (
  SELECT *, close - prev_close AS delta, close / prev_close - 1 AS daily_return,
    CASE WHEN close / prev_close > 0 THEN ln(close / prev_close) END AS log_return,
    greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS true_range
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM bars) t)"""

BENCH = """bench AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS close
  FROM orders GROUP BY 1)"""

NEWS = """news AS (
  SELECT d.doc_id AS article_id, d.source AS provider, d.lang, d.text AS headline, d.text,
    CAST(DATE '1995-01-02' + CAST(d.doc_id % 2499 AS INTEGER) AS DATE) AS date,
    CASE d.doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS symbol,
    CAST(l.quality - l.toxic AS DOUBLE) AS score, CAST(d.n_chars AS DOUBLE) AS weight
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _stat(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT symbol, period_end, revenue AS total_revenue, revenue - cost AS gross_profit,
    revenue - 2 * cost AS operating_income, revenue - 2.5 * cost AS net_income,
    CASE WHEN orders > 0 THEN (revenue - 2.5 * cost) / (orders * 100) END AS diluted_eps,
    revenue - 1.5 * cost AS operating_cash_flow, -0.25 * cost AS capital_expenditure,
    revenue - debt AS stockholders_equity, revenue * 2 AS total_assets, debt AS total_debt,
    debt * 0.5 AS cash, revenue * 0.75 AS current_assets, debt * 1.25 AS current_liabilities
  FROM {source})"""


STATUS_SYMBOL = "CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END"

FUND_RAW = f"""fraw AS (
  SELECT {STATUS_SYMBOL} AS symbol,
    CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS period_end,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(count(*) AS DOUBLE) AS orders,
    CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS cost,
    CAST(sum(CASE WHEN o_orderpriority LIKE '2%' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS debt
  FROM orders GROUP BY 1, 2),
annual_raw AS (
  SELECT symbol, make_date(year(period_end), 12, 31) AS period_end,
    CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue, sum(orders) AS orders,
    CAST(sum(CAST(cost AS DECIMAL(18,2))) AS DOUBLE) AS cost, CAST(sum(CAST(debt AS DECIMAL(18,2))) AS DOUBLE) AS debt
  FROM fraw GROUP BY 1, 2)"""
STATEMENT = FUND_RAW + ",\n" + _stat("stq", "fraw") + ",\n" + _stat("sta", "annual_raw")


REPORTS = f"""reports AS (
  SELECT symbol, event_date FROM (
    SELECT {STATUS_SYMBOL} AS symbol, date_trunc('quarter', o_orderdate) AS q,
      CAST(min(o_orderdate) AS DATE) AS event_date
    FROM orders GROUP BY 1, 2) t)"""

INSIDER = f"""insider AS (
  SELECT {STATUS_SYMBOL} AS symbol, o_orderkey AS txn_id, CAST(o_orderdate AS DATE) AS date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Purchase at price' WHEN '2-HIGH' THEN 'Sale at price'
      WHEN '3-MEDIUM' THEN 'Stock Award(Grant)' WHEN '5-LOW' THEN 'Sell to cover' ELSE 'Gift' END AS text,
    o_totalprice AS shares
  FROM orders)"""


def intraday(micros: int, name: str = "ibars") -> str:
    start = f"make_timestamp(epoch_us(ts) - epoch_us(ts) % {micros})"
    return f"""{name} AS (
  SELECT event_type AS symbol, {start} AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""


def ewm(x: str, alpha: float, by: str = "symbol", order: str = "date") -> str:
    """Exponential mean as a fold over all earlier values, nulls left out."""
    return (f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY {by} ORDER BY {order} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, v: {alpha!r} * v + {1 - alpha!r} * a)")


def w(n: int, by: str = "symbol", order: str = "date") -> str:
    return f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gate(stat: str, x: str, n: int, mp: int | None = None, by: str = "symbol", order: str = "date") -> str:
    return (f"CASE WHEN count({x}) OVER {w(n, by, order)} >= {n if mp is None else mp} "
            f"THEN {stat} OVER {w(n, by, order)} END")


def sd(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END"


LINE = "(PARTITION BY symbol ORDER BY date)"
SOFAR = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


# The normal-tail approximation the price columns use.
_N = "0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376"
_D = "0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752"


def _horner(z: str, coefs: str) -> str:
    acc = ""
    for c in coefs.split(", "):
        c = f"CAST({c} AS DOUBLE)"
        acc = f"({acc} * {z} + {c})" if acc else c
    return acc


def ncdf(c: str) -> str:
    """Normal CDF of a plain column name."""
    z = f"abs({c})"
    tail = (f"CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < 7.07106781186547 "
            f"THEN exp(-{z} * {z} / 2) * {_horner(z, _N)} / {_horner(z, _D)} "
            f"ELSE exp(-{z} * {z} / 2) / (({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) * 2.5066282746310002) END")
    return f"(CASE WHEN {c} > 0 THEN 1 - ({tail}) ELSE ({tail}) END)"


def bs(call: str = "option_type = 'call'", s: str = "spot", k: str = "strike", t: str = "time_to_maturity",
       r: str = "0.04e0", d1: str = "d1", d2: str = "d2", q: str = "0.0e0") -> str:
    """Black-Scholes price from columns that already hold d1, d2 and their negatives n1, n2."""
    return (f"CASE WHEN {call} THEN {s} * exp(-{q} * {t}) * {ncdf(d1)} - {k} * exp(-{r} * {t}) * {ncdf(d2)} "
            f"ELSE {k} * exp(-{r} * {t}) * {ncdf('n2')} - {s} * exp(-{q} * {t}) * {ncdf('n1')} END")


def d12(vol: str, s: str = "spot", k: str = "strike", t: str = "time_to_maturity", r: str = "0.04e0", q: str = "0.0e0") -> str:
    d1 = f"((ln({s} / {k}) + ({r} - {q} + {vol} * {vol} / 2) * {t}) / ({vol} * sqrt({t})))"
    d2 = f"({d1} - {vol} * sqrt({t}))"
    return f"{d1} AS d1, {d2} AS d2, -{d1} AS n1, -{d2} AS n2"


CHAIN = f"""ch0 AS (SELECT p_brand AS symbol, CAST(ceil(p_size / 10.0) * 10 AS INTEGER) AS days_to_expiry,
    p_retailprice AS strike, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l ON p_partkey = l_partkey GROUP BY 1, 2, 3),
ch1 AS (SELECT *, 935.0e0 + CAST(regexp_extract(symbol, '(\\d+)$', 1) AS DOUBLE) AS spot, days_to_expiry / 365.0e0 AS time_to_maturity,
    CAST(floor(strike * 10 + 0.5e0) AS BIGINT) AS grid FROM ch0 CROSS JOIN (VALUES ('call'), ('put')) o(option_type)),
ch2 AS (SELECT *, floor((0.2e0 + 0.5e0 * abs(ln(strike / spot)) + 0.05e0 * sqrt(time_to_maturity) + (grid % 7) / 200.0e0) * 10000 + 0.5e0) / 10000.0e0 AS true_vol,
    CASE WHEN grid % 29 = 0 THEN 0.4e0 WHEN grid % 5 = 0 THEN 0.08e0 ELSE 0.02e0 END AS half FROM ch1),
ch3 AS (SELECT *, true_vol * true_vol * time_to_maturity AS width, CASE WHEN option_type = 'call' THEN 1.0e0 ELSE -1.0e0 END AS sgn FROM ch2),
ch4 AS (SELECT *, greatest(sgn * (spot - strike * exp(-0.04e0 * time_to_maturity)), 0) + 0.4e0 * spot * sqrt(width) * exp(-pow(ln(strike / spot), 2) / (2 * width)) AS fair FROM ch3),
chain AS (SELECT symbol, DATE '2024-01-31' AS snapshot_date, days_to_expiry, CAST(DATE '2024-01-31' + days_to_expiry AS DATE) AS expiry,
    strike, option_type, spot, time_to_maturity, floor(fair * (1 - half) * 100 + 0.5e0) / 100.0e0 AS bid,
    floor(fair * (1 + half) * 100 + 0.5e0) / 100.0e0 AS ask, n * 3 AS volume,
    CASE WHEN grid % 31 <> 0 THEN n * CASE WHEN option_type = 'call' THEN 10 ELSE 7 END END AS open_interest,
    CASE WHEN grid % 11 = 0 THEN 0.125e0 ELSE true_vol END AS quoted_vol, true_vol FROM ch4)"""
