"""Margin classifiers with balanced class weights whose margins become probabilities by cross-fitted sigmoids."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage


def sigmoid(a: float, b: float, margin: Column) -> Column:
    return 1 / (1 + F.exp(F.lit(a) * margin + F.lit(b)))


def fit_sigmoids(scores: DataFrame, rounds: int = 60, tol: float = 1e-9) -> dict[int, tuple[float, float]]:
    """(a, b) of 1 / (1 + exp(a s + b)) per group, from rows (g, s, y) with y 0 or 1.

    Targets are drawn in from 0 and 1 by the class counts, (n1 + 1) / (n1 + 2) and 1 / (n0 + 2). Each Newton step
    of all groups is one aggregate; a step that does not lower the loss is halved.
    """
    counts = {r["g"]: (r["n1"], r["n"] - r["n1"]) for r in scores.groupBy("g").agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("n")).collect()}
    at = {g: np.array([0.0, math.log((n0 + 1) / (n1 + 1))]) for g, (n1, n0) in counts.items()}
    step, loss, done = {g: np.zeros(2) for g in at}, {g: math.inf for g in at}, set()
    pick = lambda values: F.element_at(F.create_map(*[x for g, v in values.items() for x in (F.lit(g), F.lit(float(v)))]), F.col("g"))
    t = F.when(F.col("y") == 1, pick({g: (n1 + 1) / (n1 + 2) for g, (n1, _) in counts.items()})).otherwise(pick({g: 1 / (n0 + 2) for g, (_, n0) in counts.items()}))
    for _ in range(rounds):
        if len(done) == len(at):
            break
        z = pick({g: v[0] for g, v in at.items()}) * F.col("s") + pick({g: v[1] for g, v in at.items()})
        d = scores.select("g", "s", t.alias("t"), z.alias("z")).withColumn("p", 1 / (1 + F.exp("z")))
        e, w, s = F.col("t") - F.col("p"), F.col("p") * (1 - F.col("p")), F.col("s")
        soft = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))  # log(1 + exp(z))
        sums = d.groupBy("g").agg(F.sum(s * e).alias("ga"), F.sum(e).alias("gb"), F.sum(s * s * w).alias("haa"), F.sum(s * w).alias("hab"), F.sum(w).alias("hbb"), F.sum(soft - (1 - F.col("t")) * F.col("z")).alias("loss"))
        for r in sums.collect():
            g = r["g"]
            if g in done:
                continue
            if r["loss"] > loss[g] + 1e-12 * abs(loss[g]):
                step[g] = step[g] / 2
                at[g] = at[g] - step[g]
            else:
                loss[g] = r["loss"]
                h = np.array([[r["haa"] + 1e-12, r["hab"]], [r["hab"], r["hbb"] + 1e-12]])
                step[g] = -np.linalg.solve(h, [r["ga"], r["gb"]])
                at[g] = at[g] + step[g]
            if np.abs(step[g]).max() < tol * max(1.0, np.abs(at[g]).max()):
                done.add(g)
    return {g: (float(v[0]), float(v[1])) for g, v in at.items()}


def standard_columns(train: DataFrame, frames: Sequence[DataFrame], features: Sequence[str]) -> list[DataFrame]:
    """Nulls filled by the training medians and columns scaled by the training moments; constant columns are zero."""
    med = train.agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in features]).first()
    fill = {c: float(med[c]) if med[c] is not None else 0.0 for c in features}
    m = train.fillna(fill, list(features)).agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    scaled = {c: (F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) - m[f"m_{c}"]) / (m[f"s_{c}"] or 1.0) for c in features}
    return [f.withColumns(scaled) for f in frames]


def fit_margins(rows: DataFrame, features: Sequence[str], codes: Sequence[float], folds: int, c: float = 1.0, rounds: int = 40, tol: float = 1e-8) -> dict[int, np.ndarray]:
    """Coefficients (constant last) of linear classifiers with squared hinge loss and balanced class weights.

    ``rows`` holds the features, ``_label`` and ``_fold``. Model i * folds + k tells code i from the others and learns on all
    folds but k. A Newton step needs the weighted cross-products of the rows inside the margin only; one pass
    over the rows adds them up for all models, in every task first. A step that does not lower
    the loss is halved.
    """
    d, n_models = len(features) + 1, len(codes) * folds
    counts = {(r["_label"], r["_fold"]): r["n"] for r in rows.groupBy("_label", "_fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.ones((n_models, 2))
    for g in range(n_models):
        n = [sum(v for (lab, f), v in counts.items() if f != g % folds and (lab == codes[g // folds]) == bool(one)) for one in (0, 1)]
        weight[g] = [sum(n) / (2 * x) if x else 1.0 for x in n]
    upper = np.triu_indices(d)
    size = len(upper[0]) + d + 1

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((n_models, size))
            for b in batches:
                x = np.stack([*[np.asarray(b.column(j), float) for j in range(d - 1)], np.ones(b.num_rows)], 1)
                label, fold = np.asarray(b.column(d - 1), float), np.asarray(b.column(d))
                for g in range(n_models):
                    y = np.where(label == codes[g // folds], 1.0, -1.0)
                    gap = 1 - y * (x @ w[g])
                    act = (gap > 0) & (fold != g % folds)
                    cost = np.where(y[act] > 0, weight[g, 1], weight[g, 0])
                    xa = x[act] * cost[:, None]
                    held[g] += np.concatenate([(xa.T @ x[act])[upper], xa.T @ y[act], [cost @ gap[act] ** 2]])
            yield pa.record_batch([pa.array(np.arange(n_models * size), pa.int32()), pa.array(held.ravel())], names=["at", "v"])

        total = np.zeros(n_models * size)
        for r in rows.select(*features, "_label", "_fold").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            total[r["at"]] = r["v"]
        return total.reshape(n_models, size)

    w, step = np.zeros((n_models, d)), np.zeros((n_models, d))
    loss, done = np.full(n_models, np.inf), np.zeros(n_models, bool)
    for _ in range(rounds):
        for g, flat in enumerate(sums(w)):
            if done[g]:
                continue
            now = 0.5 * w[g] @ w[g] + c * flat[-1]
            if now > loss[g] * (1 + 1e-12):
                step[g] /= 2
                w[g] -= step[g]
            else:
                loss[g], h = now, np.zeros((d, d))
                h[upper] = flat[:len(upper[0])]
                h = np.eye(d) + 2 * c * (h + np.triu(h, 1).T)
                step[g] = np.linalg.solve(h, 2 * c * flat[len(upper[0]):-1]) - w[g]
                w[g] += step[g]
            done[g] = np.abs(step[g]).max() < tol * max(1.0, np.abs(w[g]).max())
        if done.all():
            break
    return dict(enumerate(w))


def calibrated_svc(train: DataFrame, apply: DataFrame, features: Sequence[str], label: str, classes: Sequence[int], keys: Sequence[str] = ("symbol", "date"), folds: int = 3) -> DataFrame:
    """``apply`` with a probability column ``p_<i>`` for the i-th class; they add up to 1.

    For each class against the others and each fold (by hash of the keys), a linear support vector
    machine with balanced class weights learns on the other folds; its margins on the fold give
    a sigmoid. A row's probabilities are normalised per fold and averaged over the folds.
    """
    tr, ap = standard_columns(train, [train.where(F.col(label).isNotNull()), apply], features)
    tr = cut_lineage(tr.select(*features, F.col(label).cast("double").alias("_label"), F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int").alias("_fold")))
    targets = list(classes) if len(classes) > 2 else [classes[1]]
    margins = {}
    for g, w in fit_margins(tr, features, [float(t) for t in targets], folds).items():
        margins[g] = sum((F.lit(float(b)) * F.col(f) for b, f in zip(w, features)), F.lit(float(w[-1])))
    held = F.explode(F.array(*[F.when(F.col("_fold") == g % folds, F.struct(F.lit(g).alias("g"), m.alias("s"), (F.col("_label") == targets[g // folds]).cast("int").alias("y"))) for g, m in margins.items()]))
    ab = fit_sigmoids(cut_lineage(tr.select(held.alias("h")).where("h is not null").select("h.*")))
    known = [k for k in range(folds) if all(i * folds + k in ab for i in range(len(targets)))]  # an empty fold says nothing
    ap = ap.withColumns({f"_p{g}": sigmoid(*ab[g], margins[g]) for g in ab})
    if len(targets) == 1:
        one = sum((F.col(f"_p{k}") for k in known), F.lit(0.0)) / len(known)
        out = {"p_0": 1 - one, "p_1": one}
    else:
        total = {k: sum((F.col(f"_p{i * folds + k}") for i in range(len(targets))), F.lit(0.0)) for k in known}
        share = lambda i, k: F.when(total[k] > 0, F.col(f"_p{i * folds + k}") / total[k]).otherwise(1 / len(targets))
        out = {f"p_{i}": sum((share(i, k) for k in known), F.lit(0.0)) / len(known) for i in range(len(targets))}
    return ap.withColumns(out).select(*keys, label, *out)
