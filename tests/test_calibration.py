"""Sigmoids and calibrated probabilities against plain numpy."""

import datetime as dt

import numpy as np
import pytest

from tickloom.operators import calibration as cb


def newton(s, y):
    """Sigmoid fit by numpy's own Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    v = np.array([0.0, np.log((n0 + 1) / (n1 + 1))])
    m = np.stack([s, np.ones(len(s))], 1)
    loss = lambda v: np.sum(np.logaddexp(0, m @ v) - (1 - t) * (m @ v))
    for _ in range(200):
        p = 1 / (1 + np.exp(m @ v))
        step = -np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + 1e-12 * np.eye(2), m.T @ (t - p))
        while loss(v + step) > loss(v) + 1e-12 and np.abs(step).max() > 1e-14:
            step = step / 2
        v = v + step
    return v


def test_sigmoids_equal_numpy(spark):
    rng = np.random.default_rng(2)
    data = {0: (2.0, 0.5), 1: (0.2, -3.0), 2: (8.0, 0.0)}
    rows, want = [], {}
    for g, (k, b) in data.items():
        s = rng.normal(0, 1.5, 400)
        y = (rng.random(400) < 1 / (1 + np.exp(-k * s - b))).astype(int)
        rows += [(g, float(a), int(c)) for a, c in zip(s, y)]
        want[g] = newton(s, y)
    rows += [(3, 1.0, 1), (3, 1.0, 1), (3, 1.0, 0)]  # one margin only
    got = cb.fit_sigmoids(spark.createDataFrame(rows, "g int, s double, y int"))
    for g in data:
        assert got[g] == pytest.approx(tuple(want[g]), rel=1e-6, abs=1e-7)
    a, b = got[3]
    assert 1 / (1 + np.exp(a + b)) == pytest.approx((2 * 3 / 4 + 1 / 3) / 3, abs=1e-6)


def test_margins_are_the_minimum_of_their_loss(spark):
    """The gradient of the balanced squared hinge loss vanishes for every model."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (500, 3))
    lab = np.where(x[:, 0] + 0.3 * rng.normal(0, 1, 500) > 0.9, 1.0, np.where(x[:, 1] > 1, -1.0, 0.0))
    fold = rng.integers(0, 3, 500)
    rows = spark.createDataFrame([(*map(float, a), float(b), int(f)) for a, b, f in zip(x, lab, fold)], "a double, b double, c double, _label double, _fold int").repartition(4)
    got = cb.fit_margins(rows, ["a", "b", "c"], [-1.0, 1.0], 3)
    for g, w in got.items():
        use = fold != g % 3
        m, y = np.concatenate([x[use], np.ones((use.sum(), 1))], 1), np.where(lab[use] == (-1.0, 1.0)[g // 3], 1.0, -1.0)
        cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
        gap = np.maximum(1 - y * (m @ w), 0)
        assert np.abs(w - 2 * (m * (cost * gap * y)[:, None]).sum(0)).max() < 1e-6 and len(got) == 6


def test_probabilities_add_up_and_rank(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        x = rng.normal(0, 1, 2)
        y = 1 if x[0] > 1.2 else -1 if x[0] < -1.2 else 0
        rows.append(("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), None if i % 50 == 3 else float(x[0]), float(x[1]), 5.0, y, int(y == 1)))
    df = spark.createDataFrame(rows, "symbol string, date date, a double, b double, c double, y int, up int")
    train, late = df.where("date < '2022-01-01'"), df.where("date >= '2022-01-01'")
    three = cb.calibrated_svc(train, late, ["a", "b", "c"], "y", (-1, 0, 1)).collect()
    assert len(three) == late.count() and all(abs(r["p_0"] + r["p_1"] + r["p_2"] - 1) < 1e-12 and min(r["p_0"], r["p_1"], r["p_2"]) >= 0 for r in three)
    up = {r["date"]: r["p_2"] for r in three}
    two = cb.calibrated_svc(train, late, ["a", "b", "c"], "up", (0, 1)).collect()
    assert all(abs(r["p_0"] + r["p_1"] - 1) < 1e-12 for r in two)
    for p, hits in ((up, {r["date"] for r in three if r["y"] == 1}), ({r["date"]: r["p_1"] for r in two}, {r["date"] for r in two if r["up"] == 1})):
        pos, neg = [v for k, v in p.items() if k in hits], [v for k, v in p.items() if k not in hits]
        assert np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) > 0.95
    mean = np.mean([r["p_1"] for r in two])
    assert abs(mean - np.mean([r["up"] for r in two])) < 0.05  # calibrated: a rare class keeps its share in spite of the weights
