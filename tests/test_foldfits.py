"""Walk-forward fits from prefix sums against direct fits, and areas under ranking curves by loops."""

import datetime as dt

import numpy as np
import pytest

from tickloom.operators import foldfits as ff
from tickloom.operators.learning import embargo_of


def direct(x, y, stop, a, b):
    """One fold by the plain rule: medians, scales, lasso by proximal steps, ridge and elastic net on what it selects."""
    tr, med = x[:stop].copy(), np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        known = tr[~np.isnan(tr[:, j]), j]
        med[j] = np.median(known) if len(known) else 0.0
        tr[np.isnan(tr[:, j]), j] = med[j]
    va = np.where(np.isnan(x[a:b]), med, x[a:b])
    mu, sd = tr.mean(0), tr.std(0)
    sd[sd < 1e-9] = 1.0
    tr, va, yt = (tr - mu) / sd, (va - mu) / sd, y[:stop]

    def prox(m, l1, l2):
        w, step = np.zeros(m.shape[1]), 1 / (np.linalg.norm(m, 2) ** 2 / len(m) + l2 + 1e-12)
        for _ in range(20_000):
            g = m.T @ (m @ w - (yt - yt.mean())) / len(m) + l2 * w
            new = w - step * g
            w = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        return w

    w = prox(tr, ff.LASSO_ALPHA, 0)
    keep = np.abs(w) > 1e-9
    if keep.sum() < 3:
        keep = np.zeros(len(w), bool)
        keep[np.argsort(np.abs(w), kind="stable")[-10:]] = True
    m = tr[:, keep]
    ridge = np.linalg.solve(m.T @ m + 10 * np.eye(m.shape[1]), m.T @ (yt - yt.mean()))
    net = prox(m, 0.005, 0.005)
    return keep, w, va[:, keep] @ ridge + yt.mean(), va[:, keep] @ net + yt.mean()


def sample(seed=0, n=330, d=13):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)) * np.logspace(-3, 3, d) + 1000
    x[:25, 2], x[rng.random(n) < 0.1, 5], x[:, 7] = np.nan, np.nan, 3.0
    return x, np.nan_to_num(x[:, 1] - 1000) * 0.3 + (x[:, 9] - 1000) / 800 + rng.normal(0, 0.5, n)


@pytest.mark.parametrize("quiet", [False, True])
def test_fits_equal_direct_fits(quiet):
    x, y = sample()
    y = y * 1e-4 if quiet else y  # quiet: the lasso selects nothing and the ten largest stay
    folds = ff.fold_edges(len(x), 5)
    lasso, keep, preds = ff.fit_series(x, y, folds)
    assert folds[0] == (0, 115, 120, 141) and folds[-1] == (-1, 274, 279, 330) and folds[-2][3] == 279
    for k in (0, 3, len(folds) - 1):
        _, stop, a, b = folds[k]
        want, w, ridge, net = direct(x, y, stop, a, b)
        assert (keep[k] == want).all() and np.allclose(lasso[k], w, atol=1e-7)
        assert np.allclose(preds["ridge"][k], ridge, atol=1e-8) and np.allclose(preds["elasticnet"][k], net, atol=1e-6)


def test_walk_forward_table_and_frequency(spark):
    x, y = sample(1, 260, 11)
    names = [f"f{i}" for i in range(11)]
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i]), None if i % 7 == 0 else float(y[i] > 0)) for i in range(260)]
    rows += [("B", r[1], *r[2:]) for r in rows[:100]]  # too short for a fold
    df = spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"{n} double" for n in names) + ", target_5d double, target_dir_1d double").repartition(3)
    out = ff.linear_walk_forward(df, names, ["target_5d", "target_dir_1d"]).collect()
    for target in ("target_5d", "target_dir_1d"):
        col = y if target == "target_5d" else np.array([np.nan if r[-1] is None else r[-1] for r in rows[:260]])
        at = np.flatnonzero(~np.isnan(col))
        folds = ff.fold_edges(len(at), embargo_of(target))
        lasso, keep, preds = ff.fit_series(x[at], col[at], folds)
        got = {(r["fold"], r["name"], r["date"]): r["value"] for r in out if r["target"] == target and r["kind"] == "forecast"}
        want = {(f, m, rows[at[i]][1]): v for m, p in preds.items() for (f, _, a, b), vs in zip(folds, p) for i, v in zip(range(a, b), vs)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    freq = ff.selection_frequency(spark.createDataFrame(out, ff_schema(spark, df))).where("target = 'target_5d'").collect()
    cv = [k for k, f in enumerate(ff.fold_edges(260, 5)) if f[0] >= 0]
    keep = ff.fit_series(x, y, ff.fold_edges(260, 5))[1][cv]
    assert {r["feature"]: (r["selected"], r["folds"]) for r in freq} == {n: (int(keep[:, i].sum()), len(cv)) for i, n in enumerate(names) if keep[:, i].any()}
    assert {r["symbol"] for r in out} == {"A"}


def test_latest_forecasts_equal_direct_fits(spark):
    x, y = sample(5, 150, 11)
    names = [f"f{i}" for i in range(11)]
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), *[None if np.isnan(v) else float(v) for v in x[i]], None if i > 144 else float(y[i])) for i in range(150)]
    rows += [("B", r[1], *r[2:]) for r in rows[:5]]
    df = spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"{n} double" for n in names) + ", target_5d double").repartition(2)
    got = {r["model"]: r for r in ff.latest_forecasts(df, names, ["target_5d"]).collect()}
    both = np.concatenate([x[:145], x[149:]])
    _, _, ridge, net = direct(both, y[:145], 145, 145, 146)
    assert set(got) == {"ridge", "elasticnet"} and got["ridge"]["symbol"] == "A" and got["ridge"]["date"] == rows[149][1] and got["ridge"]["n_train"] == 145
    assert got["ridge"]["value"] == pytest.approx(ridge[0], abs=1e-8) and got["elasticnet"]["value"] == pytest.approx(net[0], abs=1e-6)


def ff_schema(spark, df):
    return f"symbol string, {ff.ROWS}"


def test_areas_equal_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{rng.integers(0, 3)}", int(rng.random() < 0.3), float(rng.integers(0, 12)) / 4) for _ in range(600)] + [("only", 1, 0.5), ("none", 0, 0.5), ("k0", None, 1.0), ("k0", 1, None)]
    got = {r["k"]: r for r in ff.ranking_areas(spark.createDataFrame(rows, "k string, y int, s double"), "y", "s", ["k"]).collect()}
    for k in ("k0", "k1", "k2"):
        part = [(y, s) for kk, y, s in rows if kk == k and y is not None and s is not None]
        pos, neg = [s for y, s in part if y], [s for y, s in part if not y]
        auc = np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])
        ap, seen = 0.0, 0.0
        for cut in sorted({s for _, s in part}, reverse=True):
            above = [y for y, s in part if s >= cut]
            ap += (sum(above) / len(pos) - seen) * sum(above) / len(above)
            seen = sum(above) / len(pos)
        assert got[k]["roc_auc"] == pytest.approx(auc) and got[k]["pr_auc"] == pytest.approx(ap) and got[k]["n"] == len(part)
    assert got["only"]["roc_auc"] is None and got["only"]["pr_auc"] == 1 and got["none"]["pr_auc"] is None
