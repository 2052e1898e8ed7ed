"""Walk-forward linear fits from prefix sums: every expanding fold is one row of a table of cross-products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.learning import HOLDOUT, INIT_TRAIN, STEP, embargo_of
from tickloom.session import cut_lineage

# Penalties of the screening lasso, the ridge and the elastic net, and how many features a thin selection keeps.
LASSO_ALPHA, RIDGE_ALPHA, NET_ALPHA, NET_L1 = 5e-3, 10.0, 0.01, 0.5
FEWEST, FALLBACK = 3, 10


def fold_edges(n: int, gap: int, init: int = INIT_TRAIN, step: int = STEP, holdout: int = HOLDOUT) -> list[tuple[int, int, int, int]]:
    """(fold, train_stop, val_start, val_end) of a series of n rows; the holdout is fold -1."""
    cut = n - holdout
    folds = [(f, max(start - gap, 0), start, min(start + step, cut)) for f, start in enumerate(range(init, cut, step))]
    return folds + ([(-1, max(cut - gap, 0), cut, n)] if folds else [])


def prefix_moments(x: np.ndarray, y: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Means, cross-products and correlations with y of the rows before each stop, nulls filled by the medians of those rows.

    A filled column is value + missing x median, so its cross-products follow from those of values and
    missing marks, whatever the median: blocks between stops are summed once and added up.
    """
    gaps = np.flatnonzero(np.isnan(x).any(0))
    medians = np.zeros((len(stops), x.shape[1]))
    for f, stop in enumerate(stops):
        for j in gaps:
            known = x[:stop, j][~np.isnan(x[:stop, j])]
            medians[f, j] = np.median(known) if len(known) else 0.0
    shift = np.nan_to_num(np.nanmean(np.where(np.isnan(x), np.nan, x), 0) if len(x) else np.zeros(x.shape[1]))  # any constant will do; it keeps digits
    missing = np.isnan(x[:, gaps]).astype(float)
    u = np.concatenate([np.ones((len(x), 1)), np.nan_to_num(x - shift), missing, y[:, None]], 1)
    order = np.argsort(stops, kind="stable")
    edges = np.concatenate([[0], stops[order]])
    grams = np.cumsum([u[a:b].T @ u[a:b] for a, b in zip(edges, edges[1:])], 0)
    out = np.empty_like(grams)
    out[order] = grams
    d = x.shape[1]
    spread = np.zeros((len(stops), u.shape[1], d + 2))
    spread[:, 0, 0], spread[:, -1, -1] = 1, 1
    spread[:, np.arange(1, d + 1), np.arange(1, d + 1)] = 1
    spread[:, d + 1 + np.arange(len(gaps)), 1 + gaps] = medians[:, gaps] - shift[gaps]
    g = spread.transpose(0, 2, 1) @ out @ spread
    n = np.maximum(g[:, 0, 0], 1)[:, None]
    mean, mean_y = g[:, 0, 1:-1] / n, g[:, 0, -1] / n[:, 0]
    cov = g[:, 1:-1, 1:-1] / n[:, :, None] - mean[:, :, None] * mean[:, None, :]
    cov_y = g[:, 1:-1, -1] / n - mean * mean_y[:, None]
    return medians, mean + shift, cov, cov_y, mean_y, n[:, 0]


def standardised(cov: np.ndarray, cov_y: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correlations and scales; a constant column has scale 1 and correlates with nothing."""
    var = np.einsum("fii->fi", cov)
    flat = var <= 1e-18 * mean * mean + 1e-300
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))
    live = ~flat
    corr = cov / scale[:, :, None] / scale[:, None, :] * live[:, :, None] * live[:, None, :]
    return corr, cov_y / scale * live, scale


def descent(c: np.ndarray, r: np.ndarray, l1: float, l2: float = 0.0, free: np.ndarray | None = None, rounds: int = 500, tol: float = 1e-7) -> np.ndarray:
    """Minimum of b'cb / 2 - r'b + l1 |b| + l2 b'b / 2 for all folds together; only ``free`` columns move.

    A sweep of coordinate descent finds which columns enter. On the columns in use the penalty is linear
    as long as no sign changes, so the minimum there is one linear solve: coefficients go
    towards it until the first of them reaches zero and leaves. A fold is done when a sweep moves none
    of its coefficients by more than ``tol``.
    """
    d = r.shape[1]
    b, scale = np.zeros_like(r), np.einsum("fii->fi", c) + l2
    can = (scale > l2) & (True if free is None else free)
    live, eye = np.flatnonzero(can.any(1)), np.eye(d)
    for _ in range(rounds):
        if not len(live):
            break
        cl, bl, sl, ok = c[live], b[live], scale[live], can[live]
        rest, moved = r[live] - np.einsum("fij,fj->fi", cl, bl), np.zeros(len(live))
        for j in range(d):
            z = rest[:, j] + (sl[:, j] - l2) * bl[:, j]
            new = np.where(ok[:, j], np.sign(z) * np.maximum(np.abs(z) - l1, 0) / np.where(ok[:, j], sl[:, j], 1), 0)
            move = new - bl[:, j]
            if move.any():
                rest -= cl[:, j] * move[:, None]
                bl[:, j] = new
                moved = np.maximum(moved, np.abs(move))
        for _ in range(d):
            sign = np.sign(bl)
            used = sign != 0
            m = np.where(used[:, :, None] & used[:, None, :], cl, 0) + eye * np.where(used, l2 + 1e-10, 1.0)[:, None, :]
            goal = np.linalg.solve(m, np.where(used, r[live] - l1 * sign, 0)[:, :, None])[:, :, 0]
            cross = used & (goal * sign < 0)
            part = np.where(cross, np.abs(bl) / np.where(cross, np.abs(goal - bl), 1), 1.0)
            far = part.min(1)
            bl = np.where(cross & (part <= far[:, None]), 0.0, bl + far[:, None] * (goal - bl))
            if (far == 1).all():
                break
        b[live] = bl
        live = live[moved >= tol]
    return b


def screened(b: np.ndarray) -> np.ndarray:
    """Columns with a coefficient; where fewer than three have one, the ten largest, later columns first on ties."""
    keep = np.abs(b) > 0
    for f in np.flatnonzero(keep.sum(1) < FEWEST):
        keep[f] = False
        keep[f, np.argsort(np.abs(b[f]), kind="stable")[-FALLBACK:]] = True
    return keep


def fit_series(x: np.ndarray, y: np.ndarray, folds: Sequence[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, dict[str, list[np.ndarray]]]:
    """Lasso coefficients and selection per fold, and validation forecasts of ridge and elastic net on the selected columns."""
    stops = np.array([f[1] for f in folds])
    medians, mean, cov, cov_y, mean_y, n = prefix_moments(x, y, stops)
    c, r, scale = standardised(cov, cov_y, mean)
    lasso = descent(c, r, LASSO_ALPHA)
    keep = screened(lasso)
    both = keep[:, :, None] & keep[:, None, :]
    eye = np.eye(x.shape[1])
    ridge = np.linalg.solve(np.where(both, c * n[:, None, None], 0) + eye * np.where(keep, RIDGE_ALPHA, 1.0)[:, None, :], (np.where(keep, r, 0) * n[:, None])[:, :, None])[:, :, 0]
    net = descent(c, r, NET_ALPHA * NET_L1, NET_ALPHA * (1 - NET_L1), keep)
    out: dict[str, list[np.ndarray]] = {"ridge": [], "elasticnet": []}
    for k, (_, _, a, b) in enumerate(folds):
        v = (np.where(np.isnan(x[a:b]), medians[k], x[a:b]) - mean[k]) / scale[k]
        out["ridge"].append(v @ ridge[k] + mean_y[k])
        out["elasticnet"].append(v @ net[k] + mean_y[k])
    return lasso, keep, out


ROWS = "target string, fold int, kind string, name string, date date, y double, value double"


def linear_walk_forward(df: DataFrame, features: Sequence[str], targets: Sequence[str], init: int = INIT_TRAIN, step: int = STEP, holdout: int = HOLDOUT, key: str = "symbol") -> DataFrame:
    """Rows of kind ``selected`` (feature, lasso coefficient) and ``forecast`` (model, date, y, value) for every fold and target of every series.

    Folds expand by ``step`` rows and purge the label horizon before validation; the last ``holdout``
    rows are fold -1. Nothing of a fold's validation rows reaches its medians, scales, selection or fits. Rows without the target
    are left out, series too short for one fold give nothing. A series has one row per day, so its
    group is bounded by the calendar; series run in parallel.
    """
    kind = dict(df.dtypes)[key]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("date")
        x_all = np.stack([np.asarray(t[c].cast(pa.float64()).fill_null(float("nan"))) for c in features], 1)
        x_all = np.where(np.isfinite(x_all), x_all, np.nan)
        dates, parts = t["date"].combine_chunks(), []
        for target in targets:
            y_all = np.asarray(t[target].cast(pa.float64()).fill_null(float("nan")))
            at = np.flatnonzero(~np.isnan(y_all))
            folds = fold_edges(len(at), embargo_of(target), init, step, holdout)
            if not folds:
                continue
            x, y = x_all[at], y_all[at]
            lasso, keep, preds = fit_series(x, y, folds)
            f, j = np.nonzero(keep)
            ids = np.array([k for k, *_ in folds])
            parts.append((target, ids[f], "selected", [features[i] for i in j], None, None, lasso[f, j]))
            for model, values in preds.items():
                rows = np.concatenate([np.arange(a, b) for _, _, a, b in folds])
                fold = np.repeat(ids, [b - a for _, _, a, b in folds])
                parts.append((target, fold, "forecast", [model] * len(rows), dates.take(pa.array(at[rows])), y[rows], np.concatenate(values)))
        tables = []
        if not parts:
            empty = {n: pa.array([], k) for n, k in (("target", pa.string()), ("fold", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("date", pa.date32()), ("y", pa.float64()), ("value", pa.float64()))}
            return pa.table({key: pa.array([], t.schema.field(key).type), **empty})
        for target, fold, what, names, day, y, value in parts:
            n = len(value)
            tables.append(pa.table({
                key: pa.array([t[key][0].as_py()] * n, t.schema.field(key).type), "target": pa.array([target] * n), "fold": pa.array(fold, pa.int32()), "kind": pa.array([what] * n), "name": pa.array(names),
                "date": pa.nulls(n, pa.date32()) if day is None else day.cast(pa.date32()), "y": pa.nulls(n, pa.float64()) if y is None else pa.array(y), "value": pa.array(value)}))
        return pa.concat_tables(tables)

    return df.select(key, "date", *features, *targets).groupBy(key).applyInArrow(run, f"{key} {kind}, {ROWS}")


def latest_forecasts(df: DataFrame, features: Sequence[str], targets: Sequence[str], key: str = "symbol") -> DataFrame:
    """(key, date, target, model, n_train, value) of every series' newest row, from all its rows that have the target.

    Screening and fits are those of the walk-forward, on one fold that ends with the last labelled row. A series with fewer labelled rows
    than FALLBACK has no forecast for that target.
    """
    kind = dict(df.dtypes)[key]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("date")
        x = np.stack([np.asarray(t[c].cast(pa.float64()).fill_null(float("nan"))) for c in features], 1)
        x, out = np.where(np.isfinite(x), x, np.nan), []
        for target in targets:
            y = np.asarray(t[target].cast(pa.float64()).fill_null(float("nan")))
            at = np.flatnonzero(~np.isnan(y))
            if len(at) < FALLBACK:
                continue
            both = np.concatenate([x[at], x[-1:]])  # the newest row is the one validation row
            _, _, preds = fit_series(both, np.append(y[at], 0.0), [(0, len(at), len(at), len(at) + 1)])
            out += [(target, m, len(at), float(v[0][0])) for m, v in preds.items()]
        names, models, n, values = zip(*out) if out else ((), (), (), ())
        size = len(out)
        return pa.table({key: pa.array([t[key][0].as_py()] * size, t.schema.field(key).type), "date": pa.array([t["date"][-1].as_py()] * size, pa.date32()), "target": pa.array(names, pa.string()),
                         "model": pa.array(models, pa.string()), "n_train": pa.array(n, pa.int64()), "value": pa.array(values, pa.float64())})

    return df.select(key, "date", *features, *targets).groupBy(key).applyInArrow(run, f"{key} {kind}, date date, target string, model string, n_train long, value double")


def selection_frequency(rows: DataFrame, keys: Sequence[str] = ("symbol", "target")) -> DataFrame:
    """In how many folds (holdout not counted) each feature was selected, and its share of the folds."""
    cv = rows.where("fold >= 0")
    folds = cv.where("kind = 'forecast'").groupBy(*keys).agg(F.count_distinct("fold").alias("folds"))
    hits = cv.where("kind = 'selected'").groupBy(*keys, F.col("name").alias("feature")).agg(F.count(F.lit(1)).alias("selected"), F.avg(F.abs("value")).alias("mean_abs"))
    return hits.join(folds, list(keys)).withColumn("share", F.col("selected") / F.col("folds"))


# ---- areas under ranking curves -------------------------------------------------------------

def running_counts(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], buckets: int = 64) -> DataFrame:
    """Inclusive running sums per key in ascending ``order``, one row per (key, order value).

    Each key is cut into ranges at approximate quantiles; ranges get their offsets from their totals, so
    a key with a third of all rows is spread over as many tasks.
    """
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts"))
    d = df.join(cuts, list(keys)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = d.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    off = off.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    d = d.join(off, [*keys, "_b"])
    return d.select(*df.columns, *[(F.col(f"_o_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums])


def ranking_areas(pred: DataFrame, y: str, score: str, keys: Sequence[str]) -> DataFrame:
    """n, positives, ROC-AUC and average precision of a score for label 1, per key; equal scores are one step.

    Counts per distinct score are merged before they are ordered. Undefined areas (one class only) are null.
    """
    d = pred.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    hit = (F.col(y) == 1).cast("long")
    steps = cut_lineage(d.groupBy(*keys, (-F.col(score)).alias("_s")).agg(F.sum(hit).alias("_pos"), F.count(F.lit(1)).alias("_n")))  # read three times
    run = running_counts(steps, keys, "_s", ["_pos", "_n"])
    neg = F.col("_n") - F.col("_pos")
    below = neg * (F.col("cum__pos") - F.col("_pos") / 2)  # positives above each negative, ties half
    g = run.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_pos").alias("positives"), F.sum(below).alias("_roc"), F.sum(F.col("_pos") * F.col("cum__pos") / F.col("cum__n")).alias("_ap"))
    p, q = F.col("positives"), F.col("n") - F.col("positives")
    return g.select(*keys, "n", "positives", F.when((p > 0) & (q > 0), F.col("_roc") / (p * q)).alias("roc_auc"), F.when(p > 0, F.col("_ap") / p).alias("pr_auc"))


def one_vs_rest_auc(pred: DataFrame, y: str, scores: dict[int, str], keys: Sequence[str]) -> DataFrame:
    """ROC-AUC of each class against the others, averaged with the classes' counts; ``scores`` names a score column per class."""
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(s).alias("s")) for c, s in scores.items()]))
    d = pred.where(F.col(y).isNotNull()).select(*keys, F.col(y).cast("int").alias("_y"), one.alias("_o"))
    d = d.select(*keys, F.col("_o.c").alias("class"), (F.col("_y") == F.col("_o.c")).cast("int").alias("_hit"), F.col("_o.s").alias("_score"))
    a = ranking_areas(d, "_hit", "_score", [*keys, "class"]).where("roc_auc is not null")
    return a.groupBy(*keys).agg((F.sum(F.col("roc_auc") * F.col("positives")) / F.sum("positives")).alias("roc_auc_ovr"), F.count(F.lit(1)).alias("classes"))
