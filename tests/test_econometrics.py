"""Volatility models, expanding forecasts and Granger tests against plain numpy."""

import datetime as dt
import math

import numpy as np
import pytest

from tickloom.operators import econometrics as ec

DAY = lambda i: dt.date(2015, 1, 1) + dt.timedelta(days=int(i))


def arch_shocks(alphas, n, seed):
    rng = np.random.default_rng(seed)
    e = np.zeros(n)
    for t in range(n):
        past = [e[t - k] ** 2 for k in range(1, len(alphas) + 1) if t >= k]
        e[t] = math.sqrt(1e-4 + sum(a * p for a, p in zip(alphas, past))) * rng.normal()
    return e


def loglik(e2, omega, alphas):
    h = np.full(len(e2), omega)
    for k, a in enumerate(alphas, 1):
        h += a * np.concatenate([np.full(min(k, len(e2)), e2.mean()), e2[:-k]])[:len(e2)]
    return -0.5 * np.sum(np.log(2 * np.pi * h) + e2 / h)


@pytest.mark.parametrize("true,q", [((0.5,), 1), ((0.1, 0.5), 2), ((0.0, 0.0, 0.3, 0.0, 0.3), 5), ((0.2,), 10), ((0.0,), 2)])
def test_arch_fit_is_a_maximum_and_not_below_equal_alphas(true, q):
    e2 = arch_shocks(true, 3000, 7) ** 2
    theta, h, ll = ec.fit_arch(e2, q)
    assert len(theta) == q + 1 and (theta >= 0).all() and theta[1:].sum() < 1 and ll == pytest.approx(loglik(e2, theta[0], theta[1:]))
    v0 = e2.mean()
    for a in np.linspace(0, 0.95, 39):  # equal alphas, as a grid
        assert ll >= loglik(e2, (1 - a) * v0, np.full(q, a / q)) - 1e-9
    for k in range(q + 1):  # no small step along a coordinate is better
        for s in (1 + 1e-3, 1 - 1e-3):
            t = theta.copy()
            t[k] = t[k] * s if t[k] > 0 else 1e-4
            assert loglik(e2, t[0], t[1:]) <= ll + 1e-6
    if q == len(true) and sum(true):
        assert np.allclose(theta[1:], true, atol=0.09)


def test_linear_recurrence_equals_loop():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 1000):
        for keep in (0.0, 0.3, 0.9999):
            x, v = rng.random(n), [2.5]
            for t in range(1, n):
                v.append(keep * v[-1] + x[t])
            assert np.allclose(ec.linear_recurrence(x, keep, 2.5), v, rtol=1e-12)


def test_volatility_table(spark):
    rows = [(s, DAY(i), float(x)) for s, seed in (("A", 1), ("B", 2)) for i, x in enumerate(arch_shocks((0.2, 0.2), 700, seed))] + [("C", DAY(i), 0.01) for i in range(30)] + [("A", DAY(999), None)]
    got = ec.fit_volatility(spark.createDataFrame(rows, "symbol string, date date, log_return double"), ec.SPECS).collect()
    assert {(r["symbol"], r["spec"]) for r in got} == {(s, x[0]) for s in "AB" for x in ec.SPECS}
    for r in got:
        garch = r["spec"] == "garch_1_1"
        k = 4 if garch else int(r["spec"].split("_")[1]) + 2
        assert r["aic"] == pytest.approx(2 * k - 2 * r["loglik"]) and r["bic"] == pytest.approx(k * math.log(700) - 2 * r["loglik"]) and r["persistence"] < 1
        assert r["alpha"] == pytest.approx(sum(r["alphas"])) and len(r["alphas"]) == (1 if garch else k - 2)


def test_expanding_forecast_equals_least_squares_on_earlier_rows(spark):
    rng = np.random.default_rng(5)
    n, big = 160, 1e6
    x = np.stack([rng.normal(0, 1, n), big + rng.normal(0, 1, n), np.zeros(n)], 1)  # sizes far apart, and a column without variation
    y = 0.5 * x[:, 0] - 0.2 * (x[:, 1] - big) + rng.normal(0, 0.1, n)
    rows = [("X", DAY(i), *map(float, x[i]), None if i in (5, 140) else float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, date date, a double, b double, c double, y double")
    got = {r["date"]: r["pred"] for r in ec.expanding_forecast(df, "y", ["a", "b", "c"], init=120).collect()}
    seen = [i for i in range(n) if i not in (5, 140)]
    for t in range(n):
        past = [i for i in seen if i < t]
        if len(past) < 120 or t not in seen:
            assert got[DAY(t)] is None
            continue
        m = np.stack([np.ones(len(past)), x[past, 0], x[past, 1] - big], 1)
        want = np.linalg.lstsq(m, y[past], rcond=None)[0] @ [1, x[t, 0], x[t, 1] - big]
        assert got[DAY(t)] == pytest.approx(want, abs=1e-4)


def test_sweep_solves_and_undoes():
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (50, 4)), rng.normal(0, 1, (50, 1))
    u = np.concatenate([x, y], 1)
    m = ec.swept(u.T @ u, [0, 1, 2, 3])
    assert m[4, 4] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[1][0]) and np.allclose(m[:4, :4], np.linalg.inv(x.T @ x))
    assert np.allclose(ec.swept(m, [3, 2, 1, 0]), u.T @ u)


def test_granger_of_all_pairs_equals_least_squares(spark):
    rng = np.random.default_rng(11)
    n = 400
    z = rng.normal(0, 1, (n, 3))
    for t in range(2, n):
        z[t, 0] += 0.4 * z[t - 2, 1] + 0.2 * z[t - 1, 0]
        z[t, 2] += 0.3 * z[t - 1, 0]
    wide = spark.createDataFrame([(DAY(i), *map(float, r)) for i, r in enumerate(z)] + [(DAY(n + 5), 1.0, None, 2.0)], "date date, a double, b double, c double")
    got = {(r["effect"], r["cause"]): r for r in ec.var_granger(wide, ["a", "b", "c"], 4).collect()}

    def design(p, lo):
        return np.stack([np.ones(n - lo), *[z[lo - k:n - k, i] for k in range(1, p + 1) for i in range(3)]], 1)

    bic = []
    for p in range(1, 5):
        m, y = design(p, 4), z[4:]
        e = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
        bic.append(np.linalg.slogdet(e.T @ e / len(y))[1] + math.log(len(y)) * 3 * (1 + 3 * p) / len(y))
    p = int(np.argmin(bic)) + 1
    m, free = design(p, p), n - p - 1 - 3 * p
    assert set(got) == {(a, b) for a in "abc" for b in "abc" if a != b} and p == 2
    rss = lambda d, y: float(np.sum((y - d @ np.linalg.lstsq(d, y, rcond=None)[0]) ** 2))
    for (effect, cause), r in got.items():
        y = z[p:, "abc".index(effect)]
        keep = [0, *[1 + 3 * (k - 1) + i for k in range(1, p + 1) for i in range(3) if i != "abc".index(cause)]]
        f = (rss(m[:, keep], y) - rss(m, y)) / p / (rss(m, y) / free)
        assert r["p"] == p and r["n"] == n - p and r["f_stat"] == pytest.approx(f) and r["p_value"] == pytest.approx(ec.f_survival(f, p, 3 * free))
    assert got["a", "b"]["causes"] and got["c", "a"]["causes"] and not got["b", "a"]["causes"]
