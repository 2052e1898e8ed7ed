"""Option chains: pricing and greeks as columns, cleaning, forwards, implied volatility, SABR."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import HART_DEN, HART_NUM, finite, norm_cdf, norm_pdf, safe_div
from tickloom.operators.frames import fence

GROUP = ("symbol", "snapshot_date")


def d1_d2(s, k, t, r, vol, q=None) -> tuple[Column, Column]:
    q = F.lit(0.0) if q is None else q
    d1 = (F.ln(s / k) + (r - q + vol * vol / 2) * t) / (vol * F.sqrt(t))
    return d1, d1 - vol * F.sqrt(t)


def with_bs_price(df: DataFrame, out: str, s, k, t, r, vol, is_call, q=None) -> DataFrame:
    """Black-Scholes price in three projections, so that each formula refers to short columns."""
    q0 = F.lit(0.0) if q is None else q
    d1, d2 = d1_d2(s, k, t, r, vol, q)
    sign = F.when(is_call, 1.0).otherwise(-1.0)
    df = df.withColumns({"_x1": sign * d1, "_x2": sign * d2, "_sg": sign, "_fw": s * F.exp(-q0 * t), "_pv": k * F.exp(-r * t)})
    df = df.withColumns({"_c1": norm_cdf("_x1"), "_c2": norm_cdf("_x2")})
    price = F.col("_sg") * (F.col("_fw") * F.col("_c1") - F.col("_pv") * F.col("_c2"))
    return df.withColumn(out, price).drop("_x1", "_x2", "_sg", "_fw", "_pv", "_c1", "_c2")


def add_greeks(df: DataFrame, vol: str, rate: float, div: float = 0.0) -> DataFrame:
    """Price and greeks. Units are in the names: theta and charm per calendar day, vega, rho
    and volga per 1% move, and the raw per-unit vega."""
    s, k, t, sg = F.col("spot"), F.col("strike"), F.col("time_to_maturity"), F.col(vol)
    r, q = F.lit(float(rate)), F.lit(float(div))
    call = F.col("option_type") == "call"
    d1, d2 = d1_d2(s, k, t, r, sg, q)
    df = df.withColumns({"_d1": d1, "_d2": d2, "_root": F.sqrt(t)})
    d1, d2, root = F.col("_d1"), F.col("_d2"), F.col("_root")
    df = df.withColumns({
        "_n1": norm_cdf(d1), "_n2": norm_cdf(d2), "_m1": norm_cdf(-d1), "_m2": norm_cdf(-d2),
        "_phi": norm_pdf(d1), "_eq": F.exp(-q * t), "_er": F.exp(-r * t),
    })
    n1, n2, m1, m2 = (F.col(c) for c in ("_n1", "_n2", "_m1", "_m2"))
    phi, eq, er = F.col("_phi"), F.col("_eq"), F.col("_er")
    vega = s * eq * phi * root
    decay = -(s * eq * phi * sg) / (2 * root)
    drift = eq * phi * (2 * (r - q) * t - d2 * sg * root) / (2 * t * sg * root)
    return df.withColumns({
        "price": F.when(call, s * eq * n1 - k * er * n2).otherwise(k * er * m2 - s * eq * m1),
        "delta": F.when(call, eq * n1).otherwise(eq * (n1 - 1)),
        "gamma": eq * phi / (s * sg * root),
        "theta_per_day": F.when(call, decay + q * s * eq * n1 - r * k * er * n2).otherwise(
            decay - q * s * eq * m1 + r * k * er * m2) / 365.0,
        "vega_per_unit": vega,
        "vega_per_pct": vega / 100.0,
        "rho_per_pct": F.when(call, k * t * er * n2).otherwise(-k * t * er * m2) / 100.0,
        "charm_per_day": F.when(call, -q * eq * n1 + drift).otherwise(q * eq * m1 + drift) / 365.0,
        "vanna": vega * (1 - d1 / (sg * root)) / s,
        "volga_per_pct": vega * d1 * d2 / sg / 100.0,
    }).drop("_d1", "_d2", "_root", "_n1", "_n2", "_m1", "_m2", "_phi", "_eq", "_er")


# ---- cleaning ---------------------------------------------------------------------------

def quote_fields(chain: DataFrame, rate: float) -> DataFrame:
    """Mid, spread, moneyness, discounting and intrinsic value of each quote."""
    mid = (F.col("bid") + F.col("ask")) / 2
    df = chain.withColumns({
        "mid_price": mid,
        "spread_pct": safe_div(F.col("ask") - F.col("bid"), mid),
        "moneyness": F.col("strike") / F.col("spot"),
        "discount_factor": F.exp(-F.lit(float(rate)) * F.col("time_to_maturity")),
    })
    pv = F.col("strike") * F.col("discount_factor")
    return df.withColumns({
        "log_moneyness": F.ln("moneyness"),
        "pv_strike": pv,
        "intrinsic_value": F.when(F.col("option_type") == "call", F.greatest(F.col("spot") - pv, F.lit(0.0))).otherwise(
            F.greatest(pv - F.col("spot"), F.lit(0.0))),
    })


def quote_filters(min_volume: int = 5, min_interest: int = 1, max_spread: float = 0.5,
                  low: float = 0.70, high: float = 1.30) -> dict[str, Column]:
    """The cleaning steps in order. A null never passes."""
    steps = {
        "unexpired": F.col("days_to_expiry") > 0,
        "volume": F.coalesce("volume", F.lit(0)) >= min_volume,
        "open_interest": F.coalesce("open_interest", F.lit(0)) >= min_interest,
        "spread": F.col("spread_pct") <= max_spread,
        "moneyness": F.col("moneyness").between(low, high),
        "positive_price": F.col("mid_price") > 0,
        "arbitrage": F.col("mid_price") >= F.col("intrinsic_value") * 0.95,
    }
    return {k: F.coalesce(c, F.lit(False)) for k, c in steps.items()}


def clean_quotes(quotes: DataFrame, **limits) -> DataFrame:
    keep = F.lit(True)
    for c in quote_filters(**limits).values():
        keep = keep & c
    return fence(quotes).where(keep)


def cleaning_funnel(quotes: DataFrame, keys: Sequence[str] = ("symbol",), **limits) -> DataFrame:
    """Rows left after each step, counted in one pass."""
    keep, out = F.lit(True), [F.count(F.lit(1)).alias("initial")]
    for name, c in quote_filters(**limits).items():
        keep = keep & c
        out.append(F.sum(F.when(keep, 1).otherwise(0)).alias(f"after_{name}"))
    return quotes.groupBy(*keys).agg(*out)


def density_gate(quotes: DataFrame) -> DataFrame:
    """Enough quotes to calibrate: 12 per expiry, or 20 in all, or three expiries of 7 on average."""
    per = quotes.groupBy(*GROUP, "expiry").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy(*GROUP).agg(F.min("n").alias("min_per_expiry"), F.sum("n").alias("total"),
                                F.count(F.lit(1)).alias("expiries"), F.avg("n").alias("avg_per_expiry"))
    return g.withColumn("passes", (F.col("min_per_expiry") >= 12) | (F.col("total") >= 20) | (
        (F.col("expiries") >= 3) & (F.col("avg_per_expiry") >= 7)))


# ---- surface summary --------------------------------------------------------------------

def front_expiry(chain: DataFrame) -> DataFrame:
    """First expiry with open interest, else the earliest."""
    per = chain.groupBy("symbol", "expiry").agg(F.sum(F.coalesce("open_interest", F.lit(0))).alias("oi"))
    return per.groupBy("symbol").agg(
        F.coalesce(F.min(F.when(F.col("oi") > 0, F.col("expiry"))), F.min("expiry")).alias("expiry"))


def max_pain(front: DataFrame) -> DataFrame:
    """Strike with the least open-interest-weighted payout, by running sums over strikes.

    Payout at s is s*sum(OI of lower calls) - sum(k*OI) plus the mirrored put sum, so no strike
    pairs are formed. Ties take the lowest strike.
    """
    def oi(kind):
        return F.sum(F.when(F.col("option_type") == kind, F.coalesce("open_interest", F.lit(0))).otherwise(0)).cast("double")

    per = front.groupBy("symbol", "strike").agg(oi("call").alias("c"), oi("put").alias("p"))
    up = Window.partitionBy("symbol").orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("symbol").orderBy(F.desc("strike")).rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("strike")
    pain = (k * F.sum("c").over(up) - F.sum(k * F.col("c")).over(up)
            + F.sum(k * F.col("p")).over(down) - k * F.sum("p").over(down))
    per = per.withColumn("_pain", F.round(pain, 2))
    return per.groupBy("symbol").agg(F.min_by("strike", F.struct("_pain", "strike")).alias("opt_max_pain"),
                                     F.min("_pain").alias("payout"))


def surface_metrics(chain: DataFrame, iv: str = "quoted_vol", min_iv: float = 0.15) -> DataFrame:
    """At-the-money volatility, put/call interest, total interest and max pain of the front expiry."""
    front = chain.join(front_expiry(chain), ["symbol", "expiry"])
    call = F.col("option_type") == "call"
    usable = call & (F.col(iv) >= min_iv)
    near = F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))
    oi = F.coalesce("open_interest", F.lit(0))
    g = front.groupBy("symbol", "expiry").agg(
        F.min_by(F.when(usable, F.col(iv)), F.when(usable, near)).alias("_iv"),
        F.sum(F.when(call, oi).otherwise(0)).alias("_c"), F.sum(F.when(~call, oi).otherwise(0)).alias("_p"))
    total = F.col("_c") + F.col("_p")
    g = g.select(
        "symbol", "expiry", F.when(total > 0, F.col("_iv")).alias("opt_atm_iv"),
        F.bround(safe_div(F.col("_p").cast("double"), F.col("_c").cast("double")), 4).alias("opt_put_call_oi"),
        F.when(total > 0, total).alias("opt_total_oi"))
    pain = max_pain(front).select("symbol", "opt_max_pain")
    return g.join(pain, "symbol").withColumn(
        "opt_max_pain", F.when(F.col("opt_total_oi").isNotNull(), F.col("opt_max_pain")))


def forwards(quotes: DataFrame, rate: float) -> DataFrame:
    """Forward per expiry from put-call parity at the strike nearest to spot."""
    keys = [*GROUP, "expiry"]
    both = quotes.groupBy(*keys, "strike", "spot", "time_to_maturity").pivot("option_type", ["call", "put"]).agg(F.first("mid_price"))
    near = F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))
    atm = both.groupBy(*keys).agg(F.min_by(F.struct("strike", "time_to_maturity", "call", "put"), near).alias("a")).select(*keys, "a.*")
    return atm.where("call is not null and put is not null").withColumn(
        "forward", F.col("strike") + F.exp(F.lit(float(rate)) * F.col("time_to_maturity")) * (F.col("call") - F.col("put")))


def parity_error(quotes: DataFrame, value: str = "delta", target: float = 1.0) -> DataFrame:
    """abs(call - put - target) per strike and expiry where both sides exist."""
    g = quotes.groupBy(*GROUP, "expiry", "strike").pivot("option_type", ["call", "put"]).agg(F.first(value))
    return g.where("call is not null and put is not null").withColumn(
        "parity_error", F.abs(F.col("call") - F.col("put") - target))


# ---- implied volatility -----------------------------------------------------------------

def _cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x)
    num = np.polyval(HART_NUM, z)
    den = np.polyval(HART_DEN, z)
    bell = np.exp(-z * z / 2)
    far = bell / ((z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) * np.sqrt(2 * np.pi))
    tail = np.where(z > 37, 0.0, np.where(z < 7.07106781186547, bell * num / den, far))
    return np.where(x > 0, 1 - tail, tail)


def implied_vol_udf(rate: float, low: float = 1e-4, high: float = 4.0, steps: int = 50):
    """Vectorised bisection over a batch of quotes; prices outside the bounds give null."""

    @F.pandas_udf("double")
    def solve(price: pd.Series, spot: pd.Series, strike: pd.Series, t: pd.Series, is_call: pd.Series) -> pd.Series:
        p, s, k, tt = (x.to_numpy(dtype=float) for x in (price, spot, strike, t))
        call = is_call.to_numpy(dtype=bool)
        root, pv = np.sqrt(tt), k * np.exp(-rate * tt)

        def value(vol):
            d1 = (np.log(s / k) + (rate + vol * vol / 2) * tt) / (vol * root)
            d2 = d1 - vol * root
            return np.where(call, s * _cdf(d1) - pv * _cdf(d2), pv * _cdf(-d2) - s * _cdf(-d1))

        lo, hi = np.full(len(p), low), np.full(len(p), high)
        ok = (value(lo) <= p) & (p <= value(hi))
        for _ in range(steps):
            mid = (lo + hi) / 2
            below = value(mid) < p
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return pd.Series(np.where(ok, (lo + hi) / 2, np.nan))

    return solve.asNondeterministic()  # a later filter must not run the solver twice


def add_implied_vol(quotes: DataFrame, rate: float, price: str = "mid_price") -> DataFrame:
    solve = implied_vol_udf(rate)
    iv = solve(price, "spot", "strike", "time_to_maturity", F.col("option_type") == "call")
    return quotes.withColumn("implied_volatility", finite(iv))


def valid_vol(quotes: DataFrame) -> DataFrame:
    return quotes.where((F.col("implied_volatility") > 0) & (F.col("implied_volatility") < 3.0))


# ---- SABR -------------------------------------------------------------------------------

def with_sabr_vol(df: DataFrame, out: str, f, k, t, alpha, beta, rho, nu) -> DataFrame:
    """Hagan expansion in the form this engine's surfaces use (x(z)/z multiplies); 0 if unusable."""
    one_b = 1 - beta
    df = df.withColumns({"_f": f, "_k": k})
    f, k = F.col("_f"), F.col("_k")
    at = F.abs(f - k) < 1e-10
    df = df.withColumns({
        "_lf": F.ln(f / k), "_mid": F.when(at, F.pow(f, one_b)).otherwise(F.pow(f * k, one_b / 2)), "_at": at})
    log_fk, mid = F.col("_lf"), F.col("_mid")
    df = df.withColumn("_z", (nu / alpha) * mid * log_fk)
    z = F.col("_z")
    df = df.withColumn("_arg", F.sqrt(1 - 2 * rho * z + z * z) + z - rho)
    arg, den = F.col("_arg"), 1 - rho
    wing = 1 + (F.pow(one_b, 2) / 24) * F.pow(log_fk, 2) + (F.pow(one_b, 4) / 1920) * F.pow(log_fk, 4)
    time = 1 + (
        (F.pow(one_b, 2) / 24) * (alpha * alpha / (mid * mid)) + (rho * beta * nu * alpha) / (4 * mid)
        + ((2 - 3 * rho * rho) / 24) * (nu * nu)) * t
    df = df.withColumns({
        "_x": F.when((F.abs(z) < 1e-10) | (F.abs(den) < 1e-10) | (arg <= 0), F.lit(1.0)).otherwise(F.ln(arg / den) / z),
        "_wing": F.when(F.col("_at"), F.lit(1.0)).otherwise(wing), "_time": time})
    vol = alpha / (mid * F.col("_wing")) * F.when(F.col("_at"), F.lit(1.0)).otherwise(F.col("_x")) * F.col("_time")
    df = df.withColumn("_raw", vol)
    good = F.when((mid >= 1e-10) & (F.col("_raw") > 0) & (F.col("_raw") < float("inf")) & ~F.isnan("_raw"), F.col("_raw"))
    return df.withColumn(out, F.coalesce(good, F.lit(0.0))).drop("_f", "_k", "_lf", "_mid", "_at", "_z", "_arg", "_x", "_wing", "_time", "_raw")


def with_sabr_price(df: DataFrame, out: str, s, k, t, r, vol: str, is_call) -> DataFrame:
    """Black price at the SABR volatility in column ``vol``; intrinsic value where it is 0."""
    pv = k * F.exp(-r * t)
    floor = F.when(is_call, F.greatest(s - pv, F.lit(0.0))).otherwise(F.greatest(pv - s, F.lit(0.0)))
    df = with_bs_price(df, "_bs", s, k, t, r, F.greatest(F.col(vol), F.lit(1e-12)), is_call)
    return df.withColumn(out, F.when(F.col(vol) <= 0, floor).otherwise(F.col("_bs"))).drop("_bs")


def sabr_penalty(alpha, rho, nu, weight: float = 1000.0, buffer: float = 0.01) -> Column:
    """Soft constraint penalty: exponential outside alpha, nu >= 0.001 and the rho band."""
    def below(x, low):
        return F.when(x < low, F.exp(low - x) - 1).otherwise(0.0)

    return (below(alpha, F.lit(0.001)) + below(nu, F.lit(0.001)) + below(rho, F.lit(-1.0 + buffer))
            + below(-rho, F.lit(-1.0 + buffer))) * weight


def add_quote_weights(quotes: DataFrame) -> DataFrame:
    """Vega-like weights, Gaussian in log-moneyness, scaled to mean 1 per surface."""
    m, v, t = F.col("log_moneyness"), F.col("implied_volatility"), F.col("time_to_maturity")
    df = quotes.withColumn("_w", F.exp(-0.5 * m * m / (v * v * t + 1e-6)))
    tot = df.groupBy(*GROUP).agg(F.avg("_w").alias("_mean"))
    return df.join(tot, list(GROUP)).withColumn("weight", safe_div("_w", "_mean")).drop("_w", "_mean")


def _errors(points: DataFrame, rate: float, beta: float, huber: float | None,
            vol_weight: float, price_weight: float) -> DataFrame:
    """Weighted volatility and price error of every (surface, parameter set in p_alpha, p_rho, p_nu)."""
    s, k, t, r = F.col("spot"), F.col("strike"), F.col("time_to_maturity"), F.lit(float(rate))
    p = with_sabr_vol(points, "_vol", s * F.exp(r * t), k, t, F.col("p_alpha"), F.lit(float(beta)), F.col("p_rho"), F.col("p_nu"))
    p = with_sabr_price(p, "_px", s, k, t, r, "_vol", F.col("option_type") == "call")
    p = p.withColumns({"_ev": F.col("_vol") - F.col("implied_volatility"), "_ep": (F.col("_px") - F.col("mid_price")) / F.col("spot")})
    ev, ep = F.col("_ev"), F.col("_ep")

    def loss(e):
        if huber is None:
            return e * e
        a = F.abs(e)
        return F.when(a <= huber, e * e).otherwise(2 * huber * (a - 0.5 * huber))

    g = p.groupBy(*GROUP, "p_alpha", "p_rho", "p_nu").agg(
        F.sqrt(F.sum(F.col("weight") * loss(ev)) / F.sum("weight")).alias("vol_rmse"),
        F.sqrt(F.sum(F.col("weight") * loss(ep)) / F.sum("weight")).alias("price_rmse"))
    pen = sabr_penalty(F.col("p_alpha"), F.col("p_rho"), F.col("p_nu"))
    return g.withColumn("objective", vol_weight * F.col("vol_rmse") + price_weight * F.col("price_rmse") + pen)


def _best(errors: DataFrame) -> DataFrame:
    row = F.struct("objective", "p_alpha", "p_rho", "p_nu", "vol_rmse", "price_rmse")
    return errors.groupBy(*GROUP).agg(F.min(row).alias("b")).select(
        *GROUP, F.col("b.p_alpha").alias("alpha"), F.col("b.p_rho").alias("rho"), F.col("b.p_nu").alias("nu"),
        F.col("b.vol_rmse").alias("vol_rmse"), F.col("b.price_rmse").alias("price_rmse"), F.col("b.objective").alias("objective"))


def _spread(df: DataFrame, name: str, values: Column) -> DataFrame:
    return df.withColumn(name, F.explode(values))


def calibrate_sabr(quotes: DataFrame, rate: float, beta: float = 1.0, huber: float | None = None,
                   alphas: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.6), rhos: Sequence[float] = (-0.6, -0.3, 0.0, 0.3, 0.6),
                   nus: Sequence[float] = (0.3, 0.8, 1.5), rounds: int = 2, vol_weight: float = 0.7,
                   price_weight: float = 0.3) -> DataFrame:
    """Grid calibration of every surface in one job, refined around the best point.

    The grid is three short fixed lists, exploded next to each quote and summed on the
    map side, so the shuffle carries (surfaces x parameter sets) rows, not quotes.
    """
    lits = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    need = [*GROUP, "spot", "strike", "time_to_maturity", "option_type", "implied_volatility", "mid_price", "weight"]
    quotes = quotes.select(*need)
    grid = _spread(_spread(_spread(quotes, "p_alpha", lits(alphas)), "p_rho", lits(rhos)), "p_nu", lits(nus))
    best = _best(_errors(grid, rate, beta, huber, vol_weight, price_weight))
    da, dr, dn = (float(max(np.diff(g))) for g in (alphas, rhos, nus))
    for i in range(1, rounds):
        h = 2.0 * 2.0 ** i
        near = best.select(*GROUP, "alpha", "rho", "nu")
        for name, steps in (("_a", (-2, -1, 0, 1, 2)), ("_r", (-2, -1, 0, 1, 2)), ("_n", (-1, 0, 1))):
            near = _spread(near, name, lits(steps))
        near = near.select(
            *GROUP, F.round(F.greatest(F.col("alpha") + F.col("_a") * (da / h), F.lit(0.001)), 6).alias("p_alpha"),
            F.round(F.greatest(F.least(F.col("rho") + F.col("_r") * (dr / h), F.lit(0.99)), F.lit(-0.99)), 6).alias("p_rho"),
            F.round(F.greatest(F.col("nu") + F.col("_n") * (dn / h), F.lit(0.001)), 6).alias("p_nu")).distinct()
        best = _best(_errors(quotes.join(near, list(GROUP)), rate, beta, huber, vol_weight, price_weight))
    return best.withColumns({
        "alpha_ok": F.col("alpha") > 0, "nu_ok": F.col("nu") > 0, "rho_ok": F.abs("rho") < 1})


def sabr_greeks(chain: DataFrame, rate: float, alpha, rho, nu, beta: float = 1.0) -> DataFrame:
    """Finite-difference SABR greeks next to Black-Scholes ones, with absolute differences.

    Each quote is repeated for seven fixed bumps of spot, alpha and time; the bumped prices meet
    again in the partial aggregation of the same task.
    """
    s, k, t, r = F.col("spot"), F.col("strike"), F.col("time_to_maturity"), F.lit(float(rate))
    b, call, day = F.lit(float(beta)), F.col("option_type") == "call", 1.0 / 365.0
    moves = {"p0": (0, 0, 0), "up": (1, 0, 0), "dn": (-1, 0, 0), "pa": (0, 1, 0), "ua": (1, 1, 0), "da": (-1, 1, 0), "pt": (0, 0, 1)}
    rows = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(float(x)).alias(c) for c, x in zip(("ds", "da", "dt"), m)]) for n, m in moves.items()])
    x = chain.withColumn("_m", F.explode(rows)).withColumns({
        "_s": s * (1 + 0.01 * F.col("_m.ds")), "_al": alpha * (1 + 0.01 * F.col("_m.da")), "_t": F.greatest(t - day * F.col("_m.dt"), F.lit(1e-9))})
    x = with_sabr_vol(x, "_v", F.col("_s") * F.exp(r * F.col("_t")), k, F.col("_t"), F.col("_al"), b, rho, nu)
    x = with_sabr_price(x, "_price", F.col("_s"), k, F.col("_t"), r, "_v", call)
    df = x.groupBy(*chain.columns).agg(*[F.max(F.when(F.col("_m.n") == n, F.col("_price"))).alias(f"_{n}") for n in moves])
    df = df.withColumn("_pt", F.when(t > day, F.col("_pt")))
    df = with_sabr_vol(df, "sabr_vol", s, k, t, alpha, b, rho, nu)
    h, ha, ht = 0.01 * s, 0.01 * alpha, day
    df = df.withColumns({
        "sabr_delta": (F.col("_up") - F.col("_dn")) / (2 * h),
        "sabr_gamma": (F.col("_up") - 2 * F.col("_p0") + F.col("_dn")) / (h * h),
        "sabr_vega": (F.col("_pa") - F.col("_p0")) / ha,
        "sabr_theta": F.coalesce(-(F.col("_p0") - F.col("_pt")) / ht, F.lit(0.0)),
        "sabr_vanna": ((F.col("_ua") - F.col("_da")) - (F.col("_up") - F.col("_dn"))) / (2 * h * ha),
    })
    df = add_greeks(df, "sabr_vol", rate)
    return df.withColumns({
        "delta_error": F.abs(F.col("sabr_delta") - F.col("delta")),
        "gamma_error": F.abs(F.col("sabr_gamma") - F.col("gamma")),
        "vega_error": F.abs(F.col("sabr_vega") - F.col("vega_per_unit")),
    }).drop("_p0", "_up", "_dn", "_pa", "_ua", "_da", "_pt")
