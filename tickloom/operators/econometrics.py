"""Volatility clustering, cointegration, GARCH, autoregressions - per symbol or pair."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.numeric import norm_cdf, safe_div
from tickloom.operators.frames import Series
from tickloom.operators.stats import acf, ols

# 5% critical values (ADF with constant; cointegration residual; Johansen trace for two series).
ADF_CRIT, COINT_CRIT = -2.86, -3.34
TRACE_CRIT = (15.4943, 3.8415)


def chi2_sf(x: Column, df: int) -> Column:
    """Chi-square survival function for a whole number of degrees of freedom, as a finite sum."""
    h = x / 2
    if df % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, df // 2):
            term = term * h / i
            total = total + term
        return F.exp(-h) * total
    total = 2 * (1 - norm_cdf(F.sqrt(x)))
    term = F.sqrt(2 * x / math.pi) * F.exp(-h)
    for i in range(1, (df - 1) // 2 + 1):
        total = total + term
        term = term * x / (2 * i + 1)
    return total


def volatility_series(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Returns, absolute and squared returns as one long series per kind."""
    r = F.col("log_return")
    kinds = F.array(F.struct(F.lit("r").alias("kind"), r.alias("x")), F.struct(F.lit("abs_r").alias("kind"), F.abs(r).alias("x")),
                    F.struct(F.lit("r2").alias("kind"), (r * r).alias("x")))
    return df.where("log_return is not null").select(*s.keys, *s.order, F.explode(kinds).alias("k")).select(*s.keys, *s.order, "k.*")


def ljung_box(df: DataFrame, lags: Sequence[int] = (5, 10, 20), s: Series = Series()) -> DataFrame:
    """Q statistic and p-value of r, abs r and r squared at each lag."""
    a = acf(volatility_series(df, s), "x", max(lags), s, ("kind",))
    n = F.col("n")
    part = F.col("acf") * F.col("acf") / (n - F.col("lag"))
    g = a.groupBy(*s.keys, "kind", "n").agg(*[(n * (n + 2) * F.sum(F.when(F.col("lag") <= m, part))).alias(f"_q{m}") for m in lags])
    rows = F.array(*[F.struct(F.lit(m).alias("lag"), F.col(f"_q{m}").alias("q"), chi2_sf(F.col(f"_q{m}"), m).alias("p_value")) for m in lags])
    return g.select(*s.keys, "kind", F.explode(rows).alias("r")).select(*s.keys, "kind", "r.*")


def lagged(df: DataFrame, x: str, lags: int, s: Series = Series()) -> tuple[DataFrame, list[str]]:
    names = [f"{x}_l{k}" for k in range(1, lags + 1)]
    return df.withColumns({n: s.lag(x, k) for k, n in enumerate(names, 1)}), names


def arch_lm(df: DataFrame, lags: int = 12, s: Series = Series()) -> DataFrame:
    """n x R2 of squared returns on their own lags, with its chi-square p-value."""
    x, names = lagged(df.where("log_return is not null").withColumn("r2", F.col("log_return") * F.col("log_return")), "r2", lags, s)
    f = ols(x, s.keys, "r2", names)
    lm = F.col("fit.n") * F.col("fit.r2")
    return f.select(*s.keys, F.col("fit.n").alias("n"), lm.alias("lm"), chi2_sf(lm, lags).alias("p_value"))


# ---- pairs ----------------------------------------------------------------------------------

def pair_prices(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Base and peer closes on common dates for a small list of (base, peer)."""
    y = bars.select(F.col("symbol").alias("base"), "date", F.col("close").alias("y"))
    x = bars.select(F.col("symbol").alias("peer"), "date", F.col("close").alias("x"))
    return pairs.join(y, "base").join(x, ["peer", "date"])


def aligned_prices(bars: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """One column per symbol, only dates all of them have."""
    return bars.groupBy("date").pivot("symbol", list(symbols)).agg(F.first("close")).dropna()


PAIR = Series(("base", "peer"), ("date",))


def engle_granger(prices: DataFrame, s: Series = PAIR) -> DataFrame:
    """Hedge ratio, intercept and spread per row."""
    fit = prices.groupBy(*s.keys).agg(F.regr_slope("y", "x").alias("hedge_ratio"), F.regr_intercept("y", "x").alias("intercept"))
    return prices.join(fit, list(s.keys)).withColumn("spread", F.col("y") - F.col("intercept") - F.col("hedge_ratio") * F.col("x"))


def adf(df: DataFrame, x: str, lags: int = 1, s: Series = Series(), crit: float = ADF_CRIT) -> DataFrame:
    """Augmented Dickey-Fuller t statistic at a stated lag, with constant."""
    d = df.withColumn("_lev", s.lag(x)).withColumn("_d", F.col(x) - F.col("_lev"))
    d, names = lagged(d, "_d", lags, s) if lags else (d, [])
    f = ols(d, s.keys, "_d", ["_lev", *names])
    t = F.col("fit.beta")[1] / F.col("fit.se")[1]
    return f.select(*s.keys, t.alias("adf_t"), F.col("fit.n").alias("n"), (t < crit).alias("reject"))


def half_life(df: DataFrame, x: str, s: Series = Series()) -> DataFrame:
    """-ln 2 over the AR(1) slope of changes; null (never reverts) when the slope is not negative."""
    d = df.withColumn("_lev", s.lag(x)).withColumn("_d", F.col(x) - F.col("_lev"))
    g = d.groupBy(*s.keys).agg(F.regr_slope("_d", "_lev").alias("phi"))
    return g.withColumn("half_life", F.when(F.col("phi") < 0, F.bround(-math.log(2) / F.col("phi"), 1)))


def hurst(df: DataFrame, x: str, max_lag: int = 20, s: Series = Series()) -> DataFrame:
    """Rescaled-range exponent over chunk lengths 2 .. min(max_lag, n/4)-1; the last start is left out."""
    keys = list(s.keys)
    d = df.where(F.col(x).isNotNull()).withColumn("_rn", F.row_number().over(s.spec()) - 1)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, keys).select(*keys, x, "_rn", "_n", F.explode(F.sequence(F.lit(2), F.lit(max_lag - 1))).alias("lag"))
    d = d.where(F.col("lag") < F.floor(F.col("_n") / 4)).withColumn("_c", F.floor(F.col("_rn") / F.col("lag")))
    d = d.where(F.col("_c") * F.col("lag") < F.col("_n") - F.col("lag"))
    ck = [*keys, "lag", "_c"]
    d = d.withColumn("_dev", F.col(x) - F.avg(x).over(Window.partitionBy(*ck)))
    d = d.withColumn("_cum", F.sum("_dev").over(Window.partitionBy(*ck).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(*ck).agg((F.max("_cum") - F.min("_cum")).alias("_r"), F.stddev_samp(x).alias("_s"))
    rs = g.where("_s > 0").groupBy(*keys, "lag").agg(F.avg(F.col("_r") / F.col("_s")).alias("rs"))
    return rs.groupBy(*keys).agg(F.bround(F.regr_slope(F.ln("rs"), F.ln("lag")), 4).alias("hurst"))


def pair_report(prices: DataFrame) -> DataFrame:
    """Cointegration verdict per pair: spread rejects a unit root, half-life below 60, Hurst below 0.5."""
    sp = engle_granger(prices)
    a = adf(sp, "spread", 1, PAIR, COINT_CRIT)
    h, u = half_life(sp, "spread", PAIR), hurst(sp, "spread", 20, PAIR)
    j = a.join(h, list(PAIR.keys)).join(u, list(PAIR.keys))
    ok = F.col("reject") & (F.col("half_life") < 60) & (F.col("hurst") < 0.5)
    return j.withColumn("tradeable", F.coalesce(ok, F.lit(False)))


def johansen(prices: DataFrame, s: Series = PAIR) -> DataFrame:
    """Trace statistics and rank for two series and one lagged difference.

    Moment sums by aggregate; the 2x2 eigenproblem is solved by its quadratic.
    """
    d = prices.withColumns({"dy": F.col("y") - s.lag("y"), "dx": F.col("x") - s.lag("x"), "ly": s.lag("y"), "lx": s.lag("x")})
    d = d.withColumns({"py": s.lag("dy"), "px": s.lag("dx")}).where("py is not null and px is not null")
    cols = ["dy", "dx", "ly", "lx", "py", "px"]
    g = d.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(f"{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]])

    @F.pandas_udf("trace0 double, trace1 double")
    def trace(n: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for size, flat in zip(n, m):
            c = np.zeros((6, 6))
            c[np.triu_indices(6)] = flat
            c = c + np.triu(c, 1).T
            z = np.linalg.pinv(c[4:, 4:])
            part = lambda a, b: c[np.ix_(a, b)] - c[np.ix_(a, [4, 5])] @ z @ c[np.ix_([4, 5], b)]
            s00, s01, s11 = part([0, 1], [0, 1]), part([0, 1], [2, 3]), part([2, 3], [2, 3])
            mat = np.linalg.pinv(s11) @ s01.T @ np.linalg.pinv(s00) @ s01
            tr, det = np.trace(mat), np.linalg.det(mat)
            root = np.sqrt(max(tr * tr / 4 - det, 0.0))
            l1, l2 = (min(max(v, 0.0), 1 - 1e-12) for v in (tr / 2 + root, tr / 2 - root))
            out.append((-size * (np.log1p(-l1) + np.log1p(-l2)), -size * np.log1p(-l2)))
        return pd.DataFrame(out, columns=["trace0", "trace1"])

    names = [f"{a}_{b}" for i, a in enumerate(cols) for b in cols[i:]]
    t = g.select(*s.keys, trace("n", F.array(*names)).alias("t")).select(*s.keys, "t.*")
    return t.withColumn("rank", (F.col("trace0") > TRACE_CRIT[0]).cast("int") + (F.col("trace1") > TRACE_CRIT[1]).cast("int"))


def spread_zscore(sp: DataFrame, window: int = 60, s: Series = PAIR) -> DataFrame:
    return sp.withColumn("zscore", safe_div(F.col("spread") - s.mean("spread", window), s.std("spread", window)))


# ---- conditional volatility -----------------------------------------------------------------

def linear_recurrence(x: np.ndarray, keep: float, start: float, block: int = 64) -> np.ndarray:
    """v[0] = start, v[t] = keep * v[t - 1] + x[t], a block of rows at a time.

    Inside a block v is a product with a triangle of powers of ``keep``; only one value per block is carried on.
    """
    n = len(x)
    rows = np.zeros(-(-n // block) * block)
    rows[:n] = x
    rows[0] = start
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    inside = rows.reshape(-1, block) @ np.where(lag >= 0, float(keep) ** np.maximum(lag, 0), 0.0).T
    carried, powers = 0.0, float(keep) ** np.arange(1, block + 1)
    for b in inside:
        b += powers * carried
        carried = b[-1]
    return inside.ravel()[:n]


def _gauss(e2: np.ndarray, h: np.ndarray) -> float:
    return -0.5 * float(np.sum(np.log(2 * np.pi * h) + e2 / h))


def _nonnegative(a: np.ndarray, b: np.ndarray, x: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """Minimum of x'ax / 2 - b'x over x >= 0 by coordinate descent from ``x``."""
    x = x.copy()
    for _ in range(sweeps):
        before = x.copy()
        for k in range(len(x)):
            x[k] = max(0.0, x[k] + (b[k] - a[k] @ x) / a[k, k]) if a[k, k] > 0 else 0.0
        if np.abs(x - before).max() <= 1e-12 * max(np.abs(x).max(), 1e-300):
            break
    return x


def fit_arch(e2: np.ndarray, q: int, rounds: int = 100, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, float]:
    """omega and q free alphas of ARCH(q), the variances and the log-likelihood, by Fisher scoring.

    The scoring step is a least-squares fit of squared shocks on their lags with weights 1 / variance^2,
    kept at alphas >= 0; it is shortened until the likelihood rises. The start is the best of some equal
    alphas, so the fit is never below them. Shocks before the first row are the mean square.
    """
    v0 = float(e2.mean())
    past = np.concatenate([np.full(q, v0), e2])
    z = np.stack([np.ones(len(e2)), *[past[q - k:q - k + len(e2)] for k in range(1, q + 1)]], 1)
    z[:, 1:] /= v0  # one scale for omega and alphas
    y, least = e2 / v0, 1e-8

    def at(theta):
        h = np.maximum(z @ theta, least)
        return -0.5 * float(np.sum(np.log(h) + y / h)), h

    starts = [np.concatenate([[1 - a], np.full(q, a / q)]) for a in (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)]
    theta = max(starts, key=lambda t: at(t)[0])
    best, h = at(theta)
    for _ in range(rounds):
        w = z / (h * h)[:, None]
        goal = _nonnegative(z.T @ w, w.T @ y, theta)
        goal[0] = max(goal[0], least)
        if goal[1:].sum() > 0.9999:
            goal[1:] *= 0.9999 / goal[1:].sum()
        step, gained = 1.0, 0.0
        while step > 1e-6:
            new = theta + step * (goal - theta)
            value, hv = at(new)
            if value > best:
                gained, theta, best, h = value - best, new, value, hv
                break
            step /= 2
        if gained < tol:
            break
    theta = np.concatenate([[theta[0] * v0], theta[1:]])
    return theta, h * v0, _gauss(e2, h * v0)


def fit_garch(e2: np.ndarray, refine: int = 3) -> tuple[float, float, float, np.ndarray, float]:
    """omega, alpha, beta, variances and log-likelihood of GARCH(1,1) with variance targeting, on a grid that narrows ``refine`` times.

    The first grid spans alpha up to 0.38 and beta up to 0.95 in steps of 0.09 and 0.175; each next one is a third as wide.
    """
    v0 = float(e2.mean())
    ga, gb, wa, wb, best = 0.2, 0.6, 0.18, 0.35, None
    for _ in range(refine):
        for a in np.linspace(max(ga - wa, 1e-4), min(ga + wa, 0.95), 5):
            for b in np.linspace(max(gb - wb, 0.0), min(gb + wb, 0.9999), 5):
                if a + b < 0.9999:
                    om = (1 - a - b) * v0
                    shock = np.concatenate([[v0], om + a * e2[:-1]])
                    h = np.maximum(linear_recurrence(shock, b, v0), 1e-300)
                    ll = _gauss(e2, h)
                    if best is None or ll > best[0]:
                        best = (ll, a, b, h)
        _, ga, gb, _ = best
        wa, wb = wa / 3, wb / 3
    ll, a, b, h = best
    return (1 - a - b) * v0, a, b, h, ll


def fit_volatility(returns: DataFrame, specs: Sequence[tuple[str, int, bool]], s: Series = Series(), refine: int = 3) -> DataFrame:
    """ARCH(q) with free alphas and GARCH(1,1), one row per series and spec; ``alpha`` is the sum of the alphas.

    Information criteria count the mean, omega and every alpha and beta. A series is the daily rows of
    one symbol; series run in parallel. A series without variation gives nothing.
    """
    kinds = dict(returns.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in s.keys], "spec string, omega double, alpha double, beta double, loglik double, aic double, bic double, "
                        "persistence double, half_life double, long_run_vol double, next_sigma double, var_95 double, cvar_95 double, alphas array<double>"])
    order = list(s.order)
    names = ["spec", "omega", "alpha", "beta", "loglik", "aic", "bic", "persistence", "half_life", "long_run_vol", "next_sigma", "var_95", "cvar_95", "alphas"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(order)["log_return"].dropna().to_numpy()
        r = r if len(r) else np.zeros(1)
        e2, v0, n = (r - r.mean()) ** 2, float(np.var(r)), len(r)
        rows = []
        for name, q, garch in specs if v0 > 1e-18 * float(np.mean(r * r)) else ():
            if garch:
                om, a, b, h, ll = fit_garch(e2, refine)
                alphas, k = np.array([a]), 4
            else:
                theta, h, ll = fit_arch(e2, q)
                om, alphas, b, k = float(theta[0]), theta[1:], 0.0, q + 2
            tail = np.concatenate([e2[::-1][:q], np.full(max(0, q - n), v0)])
            p, sig = float(alphas.sum() + b), math.sqrt(om + float(alphas @ tail) + b * h[-1])
            rows.append((name, om, float(alphas.sum()), b, ll, 2 * k - 2 * ll, k * math.log(n) - 2 * ll, p, math.log(0.5) / math.log(p) if 0 < p < 1 else None,
                         math.sqrt(v0 * 252), sig, 1.6448536269514722 * sig * 100, 0.10313564037537139 / 0.05 * sig * 100, alphas.tolist()))
        out = pd.DataFrame(rows, columns=names)
        for i, k in enumerate(s.keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return returns.groupBy(*s.keys).applyInPandas(fit, schema)


SPECS = (("arch_1", 1, False), ("arch_2", 2, False), ("arch_5", 5, False), ("arch_10", 10, False), ("garch_1_1", 1, True))


def garch_path(returns: DataFrame, params: DataFrame, s: Series = Series(), block: int = 64) -> DataFrame:
    """Conditional variance of fitted GARCH(1,1), exact over the whole series.

    v_t = omega + alpha e_{t-1}^2 + beta v_{t-1} is linear in v, so a block of rows is one pair
    (beta ** rows, sum of its shocks): blocks fold into the value that enters each block, and a row
    folds the at most ``block`` shocks before it. No row holds more than a block of the series.
    """
    j = returns.where("log_return is not null").join(params.where("spec = 'garch_1_1'").select(*s.keys, "omega", "alpha", "beta"), list(s.keys))
    m = j.groupBy(*s.keys).agg(F.avg("log_return").alias("_mu"), F.var_pop("log_return").alias("_v0"))
    j = j.join(m, list(s.keys)).withColumn("_rn", F.row_number().over(s.spec()) - 1)
    j = j.withColumns({"_x": F.col("omega") + F.col("alpha") * F.pow(F.col("log_return") - F.col("_mu"), 2), "_blk": F.floor(F.col("_rn") / block)})
    step = lambda acc, x: F.col("beta") * acc + x
    whole = j.groupBy(*s.keys, "_blk").agg(F.max("beta").alias("beta"), F.max("_v0").alias("_v0"), F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_x"))), lambda r: r["_x"]).alias("_xs"))
    whole = whole.select(*s.keys, "_blk", "beta", "_v0", F.struct(F.pow("beta", F.size("_xs")).alias("keep"), F.aggregate("_xs", F.lit(0.0), step).alias("add")).alias("_pair"))
    before = Window.partitionBy(*s.keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    enter = F.aggregate(F.collect_list("_pair").over(before), F.col("_v0"), lambda acc, p: acc * p["keep"] + p["add"])
    whole = whole.select(*s.keys, "_blk", enter.alias("_enter"))
    inside = Window.partitionBy(*s.keys, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    j = j.join(whole, [*s.keys, "_blk"]).withColumn("_past", F.collect_list("_x").over(inside))
    return j.withColumn("sigma2", F.aggregate("_past", F.col("_enter"), step)).drop("_mu", "_v0", "_rn", "_x", "_blk", "_enter", "_past")


# ---- autoregressions ------------------------------------------------------------------------

def ar_orders(df: DataFrame, x: str, max_p: int = 3, s: Series = Series()) -> DataFrame:
    """AIC and BIC of AR(1..p) on the same rows."""
    d, names = lagged(df.where(F.col(x).isNotNull()), x, max_p, s)
    d = d.where(F.col(names[-1]).isNotNull())
    out = None
    for p in range(1, max_p + 1):
        f = ols(d, s.keys, x, names[:p])
        n, ll = F.col("fit.n"), None
        aic = n * F.ln(F.col("fit.rss") / n) + 2 * (p + 1)
        bic = n * F.ln(F.col("fit.rss") / n) + (p + 1) * F.ln(n)
        o = f.select(*s.keys, F.lit(p).alias("p"), aic.alias("aic"), bic.alias("bic"), F.col("fit.rss").alias("rss"))
        out = o if out is None else out.unionByName(o)
    return out


@F.pandas_udf(T.DoubleType())
def _predict(g: pd.Series, x: pd.Series, d: pd.Series) -> pd.Series:
    """Least-squares forecasts of a whole batch: all cross-product matrices are solved together."""
    out = np.full(len(g), np.nan)
    able = np.array([a is not None and b is not None and not any(v is None for v in b) for a, b in zip(g, x)], bool)
    if able.any():
        k = int(d.iloc[0])
        m = np.zeros((int(able.sum()), k + 1, k + 1))
        rows, cols = np.triu_indices(k + 1)
        m[:, rows, cols] = np.stack(g[able].to_list())
        a = m[:, :k, :k] + np.triu(m[:, :k, :k], 1).transpose(0, 2, 1)
        now = np.concatenate([np.ones((len(m), 1)), np.array(x[able].to_list(), float).reshape(len(m), k - 1)], 1)
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))  # unit diagonal, so columns of any size weigh alike
        inverse = np.linalg.pinv(a / scale[:, :, None] / scale[:, None, :], rcond=1e-12, hermitian=True)
        out[able] = np.einsum("ni,nij,nj->n", now / scale, inverse, m[:, :k, k] / scale)
    return pd.Series(out)


def expanding_forecast(df: DataFrame, y: str, xs: Sequence[str], init: int = 120, s: Series = Series(), out: str = "pred") -> DataFrame:
    """One-step forecast of y from an OLS on all earlier rows, via running cross-product sums."""
    ok = F.lit(True)
    for c in [*xs, y]:
        ok = ok & F.col(c).isNotNull()
    d = df.withColumn("_one", F.lit(1.0)).withColumn("_ok", ok)
    every = s.rows(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({f"_x_{c}": F.col(c) - F.first(c, ignorenulls=True).over(every) for c in xs})  # a shift changes no forecast and keeps digits
    cols = ["_one", *[f"_x_{c}" for c in xs], y]
    before = s.rows(Window.unboundedPreceding, -1)
    sums = {f"_g{i}_{j}": F.sum(F.when(F.col("_ok"), F.col(a) * F.col(b))).over(before) for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i}
    d = d.withColumns({**sums, "_seen": F.coalesce(F.sum(F.col("_ok").cast("int")).over(before), F.lit(0))})
    ready = F.when(F.col("_seen") >= init, F.array(*sums))
    d = d.withColumn("_p", _predict(ready, F.array(*[F.col(f"_x_{c}").cast("double") for c in xs]) if xs else F.array().cast("array<double>"), F.lit(len(xs) + 1)))
    return d.withColumn(out, F.when(F.col("_ok"), F.when(~F.isnan("_p"), F.col("_p")))).drop("_one", "_ok", "_seen", "_p", *sums, *[f"_x_{c}" for c in xs])


def var_orders(wide: DataFrame, cols: Sequence[str], max_p: int = 3, s: Series = Series((), ("date",))) -> DataFrame:
    """AIC, BIC, HQIC and FPE of a vector autoregression per lag count, on the same rows.

    The residual covariances of all orders come from one matrix of cross-products, summed in one pass.
    """
    k = len(cols)
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one aligned series, one row per calendar day
    lags = [F.lag(c, p).over(w).alias(f"{c}_l{p}") for p in range(1, max_p + 1) for c in cols]
    full = ["_one", *cols, *[f"{c}_l{p}" for p in range(1, max_p + 1) for c in cols]]
    d = wide.select(F.lit(1.0).alias("_one"), *cols, *lags).dropna().select(F.array(*full).alias("v"))
    # upper triangle, row by row; lower orders are leading blocks of the same matrix
    triangle = F.flatten(F.transform("v", lambda x, a: F.transform(F.slice(F.col("v"), a + 1, F.lit(len(full)) - a), lambda y: x * y)))
    sums = d.select(F.posexplode(triangle).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    gram = sums.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda r: r["x"]).alias("g"))

    @F.pandas_udf("array<struct<p:int,n:double,logdet:double>>")
    def orders(flat: pd.Series) -> pd.Series:
        out = []
        for f in flat:
            g = np.zeros((len(full), len(full)))
            if f is None or len(f) == 0:
                out.append([])
                continue
            g[np.triu_indices(len(full))] = f
            g = g + np.triu(g, 1).T
            y, rows = list(range(1, k + 1)), []
            for p in range(1, max_p + 1):
                x = [0, *range(k + 1, k + 1 + k * p)]
                e = g[np.ix_(y, y)] - g[np.ix_(y, x)] @ np.linalg.pinv(g[np.ix_(x, x)]) @ g[np.ix_(x, y)]
                rows.append({"p": p, "n": g[0, 0], "logdet": np.linalg.slogdet(e / g[0, 0])[1]})
            out.append(rows)
        return pd.Series(out)

    n, m = F.col("n"), 1 + k * F.col("p")
    par = k * m
    return gram.select(F.explode(orders("g")).alias("r")).select("r.*").select(
        "p", n.cast("long").alias("n"), (F.col("logdet") + 2.0 * par / n).alias("aic"), (F.col("logdet") + F.ln(n) * par / n).alias("bic"),
        (F.col("logdet") + 2 * F.ln(F.ln(n)) * par / n).alias("hqic"), (F.exp("logdet") * F.pow((n + m) / (n - m), F.lit(k))).alias("fpe"))


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def f_survival(x: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution by the incomplete beta function."""
    if not x > 0:
        return 1.0
    a, b, z = d2 / 2, d1 / 2, d2 / (d2 + d1 * x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log1p(-z))
    return front * _beta_cf(a, b, z) / a if z < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - z) / b


@F.pandas_udf(T.DoubleType())
def f_sf(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_survival(a, b, c) for a, b, c in zip(x, d1, d2)])


def swept(m: np.ndarray, at: Sequence[int]) -> np.ndarray:
    """The sweep operator on the given rows, one after the other; sweeping a row again undoes it up to sign."""
    m = m.copy()
    for k in at:
        d = m[k, k]
        row, col = m[k] / d, m[:, k].copy()
        m -= np.outer(col, row)
        m[k], m[:, k] = row, -col / d
        m[k, k] = 1 / d
    return m


def var_granger(wide: DataFrame, cols: Sequence[str], max_p: int = 10, order: str = "date") -> DataFrame:
    """F tests of every ordered pair in the vector autoregression whose lag count has the least BIC.

    One pass sums cross-products of all series and lags, by how many lags a row has; the BIC compares lag
    counts on the rows that have all, the chosen model uses every row that has its lags. Models with and
    without a cause's lags come from the same matrix by sweeping. The second degree of freedom is
    series x residual rows. One aligned series: one row per day.
    """
    cols, k = list(cols), len(cols)
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    lags = [F.coalesce(F.lag(c, p).over(w), F.lit(0.0)).alias(f"_l{p}_{i}") for p in range(1, max_p + 1) for i, c in enumerate(cols)]
    d = wide.dropna(subset=cols).select(F.least(F.row_number().over(w) - 1, F.lit(max_p)).alias("has"), F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(f"_y{i}") for i, c in enumerate(cols)], *lags)
    size = 1 + k + k * max_p
    v = F.array("_one", *[f"_y{i}" for i in range(k)], *[f"_l{p}_{i}" for p in range(1, max_p + 1) for i in range(k)])
    d = d.select("has", v.alias("v"))
    triangle = F.flatten(F.transform("v", lambda x, a: F.transform(F.slice(F.col("v"), a + 1, F.lit(size) - a), lambda y: x * y)))
    sums = d.select("has", F.posexplode(triangle).alias("at", "x")).groupBy("has", "at").agg(F.sum("x").alias("x"))

    def tests(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = np.zeros((max_p + 1, size * (size + 1) // 2))
        grams[pdf["has"], pdf["at"]] = pdf["x"]

        def square(flat):
            g = np.zeros((size, size))
            g[np.triu_indices(size)] = flat
            return g + np.triu(g, 1).T

        full, y, bic = square(grams[max_p]), list(range(1, k + 1)), []
        n = full[0, 0]
        for p in range(1, max_p + 1):
            e = swept(full, [0, *range(k + 1, k + 1 + k * p)])[np.ix_(y, y)] / n
            bic.append(np.linalg.slogdet(e)[1] + math.log(n) * k * (1 + k * p) / n)
        p = int(np.argmin(bic)) + 1
        g = square(grams[p:].sum(0))
        n, xs = int(g[0, 0]), [0, *range(k + 1, k + 1 + k * p)]
        every, free, rows = swept(g, xs), n - 1 - k * p, []
        for j, cause in enumerate(cols):
            less = swept(every, [k + 1 + k * (lag - 1) + j for lag in range(1, p + 1)])  # takes the cause's lags out again
            for i, effect in enumerate(cols):
                if i != j:
                    f = (less[i + 1, i + 1] - every[i + 1, i + 1]) / p / (every[i + 1, i + 1] / free)
                    prob = f_survival(f, p, k * free)
                    rows.append((effect, cause, p, n, f, prob, prob < 0.05))
        return pd.DataFrame(rows, columns=["effect", "cause", "p", "n", "f_stat", "p_value", "causes"])

    return sums.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(tests, "effect string, cause string, p int, n long, f_stat double, p_value double, causes boolean")
