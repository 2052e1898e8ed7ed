"""Feature screening and linear paths from cross-product sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.stats import correlation_matrix, long_form


def prune_correlated(df: DataFrame, cols: Sequence[str], limit: float = 0.95) -> list[str]:
    """Columns to drop: any with abs correlation above the limit to an earlier column."""
    rows = correlation_matrix(df, cols).where(F.abs("corr") > limit).select("b").distinct().collect()
    hit = {r["b"] for r in rows}
    return [c for c in cols if c in hit]


def low_variance(df: DataFrame, cols: Sequence[str], limit: float = 0.01) -> list[str]:
    row = df.agg(*[F.var_samp(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] < limit]


def mutual_information(df: DataFrame, cols: Sequence[str], target: str, bins: int = 8, discrete: bool = False) -> DataFrame:
    """Mutual information of each column with a target from quantile bins, in nats."""
    edges = [i / bins for i in range(1, bins)]
    d = df.where(F.col(target).isNotNull())
    if discrete:
        d = d.withColumn("_y", F.col(target).cast("int"))
    else:
        cut = d.agg(F.percentile_approx(target, edges, 10000)).first()[0]
        d = d.withColumn("_y", sum(((F.col(target) > F.lit(float(e))).cast("int") for e in cut), F.lit(0)))
    lf = long_form(d, ["_y"], cols).where("value is not null")
    cuts = lf.groupBy("feature").agg(F.percentile_approx("value", edges, 10000).alias("_cx"))
    b = lf.join(cuts, "feature").withColumn("_x", F.size(F.filter("_cx", lambda e: e < F.col("value"))))
    cell = b.groupBy("feature", "_x", "_y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    f = Window.partitionBy("feature")
    j = cell.withColumns({"_t": F.sum("n").over(f), "_nx": F.sum("n").over(Window.partitionBy("feature", "_x")),
                          "_ny": F.sum("n").over(Window.partitionBy("feature", "_y"))})
    return j.groupBy("feature").agg(F.sum(F.col("n") / F.col("_t") * F.ln(F.col("n") * F.col("_t") / (F.col("_nx") * F.col("_ny")))).alias("mi"))


def gram(df: DataFrame, cols: Sequence[str], y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Upper triangle of the cross-products of (1, cols, y) per key, as one array; additive over rows."""
    names = ["_one", *cols, y]
    d = df.where(F.col(y).isNotNull()).withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    arr = F.array(*[f"g{i}_{j}" for i in range(len(names)) for j in range(i, len(names))])
    return d.groupBy(*keys).agg(*sums).select(*keys, arr.alias("gram"))


def unpack(flat, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = np.asarray(flat, dtype=float)
    return m + np.triu(m, 1).T


def centred(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, np.ndarray, float]:
    """Centred XX, Xy, yy, n and means from a gram matrix with a leading 1."""
    n = g[0, 0]
    mx, my = g[0, 1:-1] / n, g[0, -1] / n
    return g[1:-1, 1:-1] - n * np.outer(mx, mx), g[1:-1, -1] - n * mx * my, g[-1, -1] - n * my * my, n, mx, my


def lasso_solve(xx, xy, n, alpha: float, rounds: int = 200, start=None) -> np.ndarray:
    """Coordinate descent for RSS/(2n) + alpha * L1."""
    b = np.zeros(len(xy)) if start is None else start.copy()
    for _ in range(rounds):
        move = 0.0
        for j in range(len(b)):
            if xx[j, j] <= 0:
                continue
            r = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            new = np.sign(r) * max(abs(r) - n * alpha, 0.0) / xx[j, j]
            move, b[j] = max(move, abs(new - b[j])), new
        if move < 1e-10:
            break
    return b


def linear_paths(df: DataFrame, cols: Sequence[str], targets: Sequence[str], folds: str, n_folds: int = 5, n_alphas: int = 50) -> DataFrame:
    """Cross-validated lasso and ridge coefficients per target.

    One aggregate per target gives a gram matrix per contiguous fold; every alpha and fold is then
    solved from those small matrices, so the data is read once and never refitted.
    """
    size = len(cols) + 2
    names = list(cols)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gs = {int(k): unpack(v, size) for k, v in zip(pdf["fold"], pdf["gram"])}
        whole = sum(gs.values())
        xx, xy, _, n, _, _ = centred(whole)
        top = float(np.max(np.abs(xy))) / n
        grids = {"lasso": np.geomspace(top, top * 1e-3, n_alphas), "ridge": np.logspace(-3, 4, n_alphas)}

        def fit(kind, g, alpha, start=None):
            a, b, _, m, mx, my = centred(g)
            w = lasso_solve(a, b, m, alpha, start=start) if kind == "lasso" else np.linalg.solve(a + alpha * np.eye(len(b)), b)
            return w, my - mx @ w

        out = []
        for kind, alphas in grids.items():
            err = np.zeros(len(alphas))
            for g in gs.values():
                w = None
                for i, al in enumerate(alphas):
                    w, c = fit(kind, whole - g, al, w if kind == "lasso" else None)
                    v = np.concatenate(([c], w, [-1.0]))
                    err[i] += v @ g @ v
            best = alphas[int(np.argmin(err))]
            w, _ = fit(kind, whole, best)
            out += [(pdf["target"].iloc[0], kind, f, float(best), abs(float(x))) for f, x in zip(names, w)]
        return pd.DataFrame(out, columns=["target", "kind", "feature", "alpha", "score"])

    parts = None
    for t in targets:
        g = gram(df, cols, t, [folds]).select(F.lit(t).alias("target"), F.col(folds).cast("int").alias("fold"), "gram")
        parts = g if parts is None else parts.unionByName(g)
    return parts.groupBy("target").applyInPandas(solve, "target string, kind string, feature string, alpha double, score double")


def combine_paths(scores: DataFrame) -> DataFrame:
    """Min-max normalised mean of lasso and ridge scores per target."""
    w = Window.partitionBy("target", "kind")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    n = scores.withColumn("_n", (F.col("score") - lo) / (hi - lo + 1e-12))
    return n.groupBy("target", "feature").agg(
        F.max(F.when(F.col("kind") == "lasso", F.col("score"))).alias("lasso"), F.max(F.when(F.col("kind") == "ridge", F.col("score"))).alias("ridge"),
        F.avg("_n").alias("combined"))


def recommend(combined: DataFrame, mi: DataFrame, top_mi: int = 30, strong: float = 0.2) -> DataFrame:
    """Two-of-three vote: any lasso coefficient, top mutual information, strong combined score."""
    ranked = mi.withColumn("_rk", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("mi"), "feature")))
    j = combined.join(ranked, ["target", "feature"], "left")
    v = j.groupBy("feature").agg(F.max((F.coalesce("lasso", F.lit(0.0)) > 0).cast("int")).alias("v1"),
                                 F.max(F.coalesce(F.col("_rk") <= top_mi, F.lit(False)).cast("int")).alias("v2"),
                                 F.max((F.coalesce("combined", F.lit(0.0)) > strong).cast("int")).alias("v3"))
    return v.withColumn("votes", F.col("v1") + F.col("v2") + F.col("v3")).where("votes >= 2").select("feature", "votes")
