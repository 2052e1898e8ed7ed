"""Walk-forward learning, metrics, ensembles, regimes, gate, registry and drift as tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml import classification as cl, clustering as ck, regression as rg
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.numeric import finite, safe_div
from tickloom.operators.frames import Series, average_rank, number_rows
from tickloom.operators.sets import top_per_group
from tickloom.session import cut_lineage

# Walk-forward layout, label horizons, gate thresholds, ensemble weights.
INIT_TRAIN, STEP, HOLDOUT = 120, 21, 51
HORIZON = {"target_1d": 1, "target_dir_1d": 1, "target_large_move": 1, "target_5d": 5, "target_vol_5d": 5, "target_regime": 5}
FLOOR = {"regression": 0.02, "classification": 0.30}
MIN_GAIN, BEAT = 0.005, 1.05


def embargo_of(target: str) -> int:
    return HORIZON.get(target, 5)


# ---- splits ---------------------------------------------------------------------------------

def number(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Row number and series length, the base of every split."""
    return df.withColumns({"rn": F.row_number().over(s.spec()) - 1, "n_rows": F.count(F.lit(1)).over(s.whole())})


def split_role(df: DataFrame, init: int = INIT_TRAIN, step: int = STEP, holdout: int = HOLDOUT) -> DataFrame:
    """Validation fold of each row (null before the first fold) and a holdout flag."""
    cut = F.col("n_rows") - holdout
    fold = F.when((F.col("rn") >= init) & (F.col("rn") < cut), F.floor((F.col("rn") - init) / step))
    return df.withColumns({"fold": fold.cast("int"), "is_holdout": F.col("rn") >= cut})


def fold_table(df: DataFrame, embargo: int, init: int = INIT_TRAIN, step: int = STEP, holdout: int = HOLDOUT, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(fold, train_stop, val_start, val_end) per series from its length; training purges ``embargo`` rows."""
    n = df.groupBy(*keys).agg((F.count(F.lit(1)) - holdout).alias("_a")).where(F.col("_a") > init)
    last = F.floor((F.col("_a") - init - 1) / step)
    f = n.select(*keys, "_a", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("fold"))
    start = init + F.col("fold") * step
    return f.select(*keys, F.col("fold").cast("int").alias("fold"), F.greatest(start - embargo, F.lit(0)).alias("train_stop"),
                    start.alias("val_start"), F.least(start + step, F.col("_a")).alias("val_end"))


# ---- metrics --------------------------------------------------------------------------------

def regression_metrics(pred: DataFrame, y: str, p: str, keys: Sequence[str]) -> DataFrame:
    """MAE, RMSE, R2, directional accuracy and rank correlation (0 when undefined)."""
    d = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    d = d.withColumns({"_ry": average_rank(y, keys), "_rp": average_rank(p, keys), "_my": F.avg(y).over(Window.partitionBy(*keys))})
    e = F.col(y) - F.col(p)
    ic = safe_div(F.covar_pop("_ry", "_rp"), F.stddev_pop("_ry") * F.stddev_pop("_rp"))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - safe_div(F.sum(e * e), F.sum(F.pow(F.col(y) - F.col("_my"), 2)))).alias("r2"),
        F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("dir_acc"), F.coalesce(finite(ic), F.lit(0.0)).alias("ic"))


def classification_metrics(pred: DataFrame, y: str, p: str, keys: Sequence[str]) -> DataFrame:
    """Accuracy, balanced accuracy, weighted and macro F1, precision and recall of class 1, from counts."""
    cell = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(
        *keys, F.col(y).cast("int").alias("_y"), F.col(p).cast("int").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    both = F.array(F.struct(F.col("_y").alias("c"), F.col("_n").alias("t"), F.lit(0).cast("bigint").alias("q"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("h")),
                   F.struct(F.col("_p").alias("c"), F.lit(0).cast("bigint").alias("t"), F.col("_n").alias("q"), F.lit(0).cast("bigint").alias("h")))
    per = cell.select(*keys, F.explode(both).alias("x")).groupBy(*keys, "x.c").agg(F.sum("x.t").alias("t"), F.sum("x.q").alias("q"), F.sum("x.h").alias("h"))
    z = lambda a, b: F.coalesce(safe_div(a, b), F.lit(0.0))
    f1 = z(2 * F.col("h"), F.col("t") + F.col("q"))
    return per.groupBy(*keys).agg(
        F.sum("t").alias("n"), (F.sum("h") / F.sum("t")).alias("acc"), F.avg(F.when(F.col("t") > 0, F.col("h") / F.col("t"))).alias("bal_acc"),
        (F.sum(f1 * F.col("t")) / F.sum("t")).alias("f1_w"), F.avg(f1).alias("f1_macro"),
        F.max(F.when(F.col("c") == 1, z(F.col("h"), F.col("q")))).alias("precision"), F.max(F.when(F.col("c") == 1, z(F.col("h"), F.col("t")))).alias("recall"))


def roc_auc(pred: DataFrame, y: str, score: str, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve from average ranks of the score."""
    d = pred.where(F.col(y).isNotNull() & F.col(score).isNotNull()).withColumn("_r", average_rank(score, keys))
    pos = F.sum(F.when(F.col(y) == 1, 1).otherwise(0))
    g = d.groupBy(*keys).agg(pos.alias("_p"), F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col(y) == 1, F.col("_r"))).alias("_s"))
    return g.select(*keys, safe_div(F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * (F.col("_n") - F.col("_p"))).alias("roc_auc"))


def baselines(train: DataFrame, target: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Naive forecast per series: zero, last-20 mean, last-5 median, majority, never, last class."""
    t = train.where(F.col(target).isNotNull())
    if target in ("target_1d", "target_large_move"):
        return t.groupBy(*keys).agg(F.lit(0.0).alias("baseline"))
    if target == "target_dir_1d":
        g = t.groupBy(*keys, target).agg(F.count(F.lit(1)).alias("n"))
        return g.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(target)).alias("c"))).alias("m")).select(*keys, (-F.col("m.c")).cast("double").alias("baseline"))
    if target == "target_regime":
        return t.groupBy(*keys).agg(F.max_by(F.col(target).cast("double"), "date").alias("baseline"))
    k = 20 if target == "target_5d" else 5
    last = top_per_group(t, list(keys), [F.desc("date")], k)
    return last.groupBy(*keys).agg((F.avg(target) if k == 20 else F.median(target)).alias("baseline"))


def class_weights(train: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """n / (classes x count) per class."""
    g = train.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    if keys:
        tot = g.groupBy(*keys).agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
        j = g.join(tot, list(keys))
    else:
        t = g.agg(F.sum("n"), F.count(F.lit(1))).first()
        j = g.withColumns({"_t": F.lit(t[0]), "_k": F.lit(t[1])})
    return j.select(*keys, label, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))


def oversample(df: DataFrame, label: str, features: Sequence[str], k: int = 5, seed: int = 42, bucket: int = 512) -> DataFrame:
    """Minority rows interpolated towards one of their k nearest minority rows until classes balance.

    Neighbours are looked for among rows next to each other along one projection: rows are numbered in
    its order and cut into runs of ``bucket`` to 2 x ``bucket`` rows (all rows if there are fewer), so
    every run has the same bound at any size, ties included. The number of new rows is exact: row i of
    n makes floor((i + 1) need / n) - floor(i need / n) of them. A lone minority row is repeated.
    Expects a binary 0/1 label.
    """
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r[label]): r["n"] for r in n.collect() if r[label] is not None}
    minor = min(counts, key=counts.get)
    rows, need = counts[minor], max(counts.values()) - counts[minor]
    proj = sum((F.coalesce(F.col(f), F.lit(0.0)) * (1.0 if i % 2 else -1.0) for i, f in enumerate(features)), F.lit(0.0))
    x = df.where(F.col(label) == minor).select(*features, proj.alias("_p"), F.lit(0).alias("_all"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64)).alias("_tied"))
    parts = max(1, rows // bucket)
    cuts = x.agg(F.percentile_approx("_p", [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0] or []
    # a range of equal projections may be large, so each is counted in 64 parts
    where = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("_p"))) * 64 + F.col("_tied")
    x = number_rows(x, ["_all"], ["_p", *features], where)
    share = lambda i: F.floor(i * F.lit(need) / F.lit(rows))
    x = x.withColumns({"_b": F.least(F.floor(F.col("_pos") / max(bucket, 1)), F.lit(parts - 1)), "_new": (share(F.col("_pos") + 1) - share(F.col("_pos"))).cast("int")})
    schema = ", ".join(f"{f} double" for f in features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        m = pdf[list(features)].fillna(0.0).to_numpy(float)
        rng = np.random.default_rng([seed, int(pdf["_b"].iloc[0])])
        pick = np.repeat(np.arange(len(m)), pdf["_new"])
        out = np.empty((len(pick), m.shape[1]))
        near = min(k, len(m) - 1)
        for i in range(0, len(pick), 1024):
            rows = pick[i:i + 1024]
            mate = rows
            if near:
                d = ((m[rows, None, :] - m[None, :, :]) ** 2).sum(axis=2)
                d[np.arange(len(rows)), rows] = np.inf
                mate = np.argpartition(d, near - 1, axis=1)[np.arange(len(rows)), rng.integers(0, near, len(rows))]
            out[i:i + 1024] = m[rows] + rng.random((len(rows), 1)) * (m[mate] - m[rows])
        return pd.DataFrame(out, columns=list(features))

    made = x.groupBy("_b").applyInPandas(grow, schema).withColumn(label, F.lit(minor))
    return df.select(*features, label).unionByName(made)


# ---- models ---------------------------------------------------------------------------------

def regressors(seed: int = 42) -> dict:
    base = dict(featuresCol="x", labelCol="y", predictionCol="prediction")
    return {
        "ridge": rg.LinearRegression(regParam=1.0, elasticNetParam=0.0, **base),
        "elasticnet": rg.LinearRegression(regParam=0.001, elasticNetParam=0.5, **base),
        "huber": rg.LinearRegression(loss="huber", epsilon=1.35, regParam=0.0001, maxIter=50, **base),
        "rf": rg.RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed, **base),
        "gbt": rg.GBTRegressor(maxIter=10, maxDepth=3, seed=seed, **base),
        "gbt_slow": rg.GBTRegressor(maxIter=20, maxDepth=2, stepSize=0.05, seed=seed, **base),
    }


def classifiers(classes: int, seed: int = 42, weighted: bool = False) -> dict:
    base = dict(featuresCol="x", labelCol="y", predictionCol="prediction")
    w = {"weightCol": "w"} if weighted else {}
    out = {"logistic": cl.LogisticRegression(regParam=0.01, **base, **w),
           "rf": cl.RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **base, **w)}
    svc, gbt = cl.LinearSVC(regParam=0.01, maxIter=30), cl.GBTClassifier(maxIter=10, maxDepth=3, seed=seed)
    if classes == 2:
        out["svc"], out["gbt"] = svc.copy(), gbt.copy()
        for m in (out["svc"], out["gbt"]):
            m.setParams(**base)
    else:
        out["svc"] = cl.OneVsRest(classifier=svc, **base)
        out["gbt"] = cl.OneVsRest(classifier=gbt, **base)
    return out


def prepare(train: DataFrame, others: Sequence[DataFrame], features: Sequence[str], target: str):
    """Impute by train medians, scale by train moments, assemble. Statistics never see other rows.

    Medians are approximate to 1 in 10,000 ranks, so that no task meets every value of a feature.
    """
    stats = train.agg(*[F.percentile_approx(c, 0.5, 10000).alias(f"m_{c}") for c in features]).first()
    fill = {c: stats[f"m_{c}"] if stats[f"m_{c}"] is not None else 0.0 for c in features}
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_v"), StandardScaler(inputCol="_v", outputCol="x", withMean=True)])
    ready = [d.fillna(fill, list(features)).withColumn("y", F.col(target).cast("double")) for d in [train, *others]]
    model = pipe.fit(ready[0])
    return [model.transform(d).drop("_v") for d in ready], model, fill


def number_dates(df: DataFrame) -> DataFrame:
    """rn and n_rows by calendar: all rows of a day share a number, so a split never looks past a day of any symbol."""
    w = Window.orderBy("date")  # one row per calendar day
    days = df.select("date").distinct()
    days = days.select("date", (F.row_number().over(w) - 1).alias("rn"), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"))
    return df.join(days, "date")


def walk_forward(df: DataFrame, features: Sequence[str], target: str, models: dict, init: int = INIT_TRAIN, step: int = STEP,
                 holdout: int = HOLDOUT, version: str = "A", task: str = "regression", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Metric rows (version, target, keys, model, fold) for every fold and the holdout (fold -1).

    ``df`` holds raw features: each fold imputes and scales by its own training rows. Folds are cut by
    date for all symbols together; metrics are per key. The driver only submits fits; training rows of
    a fold are a filtered view of one table.
    """
    d = cut_lineage(split_role(number_dates(df.where(F.col(target).isNotNull())), init, step, holdout))
    gap = embargo_of(target)
    folds = [r["fold"] for r in d.select("fold").distinct().orderBy("fold").collect() if r["fold"] is not None]
    out = None
    for f in [*folds, -1]:
        if f >= 0:
            train, val = d.where(F.col("rn") < init + f * step - gap), d.where(F.col("fold") == f)
        else:
            train, val = d.where(F.col("rn") < F.col("n_rows") - holdout - gap), d.where("is_holdout")
        (tr, va), _, _ = prepare(train, [val], features, target)
        base = baselines(train, target, keys)
        preds = va.select(*keys, "date", "y").join(base, list(keys)).select(*keys, "y", F.lit("baseline").alias("model"), F.col("baseline").alias("p"))
        for name, est in models.items():
            p = est.fit(tr).transform(va).select(*keys, "y", F.lit(name).alias("model"), F.col("prediction").alias("p"))
            preds = preds.unionByName(p)
        m = regression_metrics(preds, "y", "p", [*keys, "model"]) if task == "regression" else classification_metrics(preds, "y", "p", [*keys, "model"])
        m = m.select(F.lit(version).alias("version"), F.lit(target).alias("target"), F.lit(f).alias("fold"), *m.columns)
        out = m if out is None else out.unionByName(m)
    return out


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Importances or absolute coefficients, normalised to sum 1."""
    raw = model.featureImportances.toArray() if hasattr(model, "featureImportances") else np.abs(model.coefficients.toArray())
    total = float(raw.sum()) or 1.0
    return [(f, float(v) / total) for f, v in zip(features, raw)]


def random_grid(space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    rng = np.random.default_rng(seed)
    return [{k: v[int(rng.integers(len(v)))] for k, v in space.items()} for _ in range(n)]


def random_search(df: DataFrame, features: Sequence[str], target: str, estimator, space: dict[str, Sequence], n: int = 25, splits: int = 3, holdout: int = HOLDOUT, seed: int = 42):
    """Best of n sampled parameter sets over time-ordered inner splits by date; returns params and RMSE.

    ``df`` holds raw features. The holdout days take no part, and every split imputes and scales by the
    rows before it, prepared once for all parameter sets.
    """
    d = number_dates(df.where(F.col(target).isNotNull())).where(F.col("rn") < F.col("n_rows") - holdout)
    hi = d.agg(F.max("rn")).first()[0] + 1
    parts = []
    for i in range(1, splits + 1):
        lo, up = hi * i // (splits + 1), hi * (i + 1) // (splits + 1)
        (tr, va), _, _ = prepare(d.where(F.col("rn") < lo - embargo_of(target)), [d.where((F.col("rn") >= lo) & (F.col("rn") < up))], features, target)
        parts.append((cut_lineage(tr.select("x", "y")), cut_lineage(va.select("x", "y"))))
    best = None
    for params in random_grid(space, n, seed):
        model = estimator.copy({estimator.getParam(k): v for k, v in params.items()}).setFeaturesCol("x")
        err = [model.fit(tr).transform(va).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0] for tr, va in parts]
        score = float(np.mean(err))
        if best is None or score < best[1]:
            best = (params, score)
    return best


# ---- ensembles ------------------------------------------------------------------------------

def weighted_mix(preds: dict[str, str], weights: dict[str, float]) -> Column:
    """Weighted mean over the models present in a row; missing ones give up their weight."""
    num, den = F.lit(0.0), F.lit(0.0)
    for m, w in weights.items():
        if m in preds:
            c = F.col(preds[m])
            num, den = num + F.coalesce(c * w, F.lit(0.0)), den + F.when(c.isNotNull(), w).otherwise(0.0)
    return safe_div(num, den)


def ensembles(wide: DataFrame, preds: dict[str, str], static: dict[str, float], calm: dict[str, float], stress: dict[str, float], regime: str) -> DataFrame:
    """Simple, static-weight and regime-aware means; null with fewer than two models."""
    cols = [F.col(c) for c in preds.values()]
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    mean = safe_div(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)), n)
    ok = n >= 2
    return wide.withColumns({
        "ensemble_mean": F.when(ok, mean), "ensemble_weighted": F.when(ok, weighted_mix(preds, static)),
        "ensemble_regime": F.when(ok, F.when(F.col(regime) == 0, weighted_mix(preds, calm)).otherwise(weighted_mix(preds, stress)))})


# ---- regimes and anomalies ------------------------------------------------------------------

def reduce_features(df: DataFrame, features: Sequence[str], k: int, train: Column):
    """Centred PCA fitted on the training rows; returns the frame with ``z`` and the variance shares."""
    asm = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df)
    sc = StandardScaler(inputCol="_v", outputCol="_c", withMean=True).fit(asm.where(train))
    c = sc.transform(asm)
    model = PCA(k=k, inputCol="_c", outputCol="z").fit(c.where(train))
    return model.transform(c).drop("_v", "_c"), model.explainedVariance.toArray()


def choose_k(train: DataFrame, ks: Sequence[int] = (2, 3, 4, 5, 6), seed: int = 42):
    """Silhouette of KMeans and BIC of a full-covariance mixture per k."""
    n, d = train.count(), len(train.select("z").first()["z"])
    rows = []
    for k in ks:
        km = ck.KMeans(k=k, seed=seed, featuresCol="z").fit(train)
        sil = ClusteringEvaluator(featuresCol="z").evaluate(km.transform(train))
        gm = ck.GaussianMixture(k=k, seed=seed, featuresCol="z", maxIter=30).fit(train)
        par = k * d + k * d * (d + 1) / 2 + k - 1
        rows.append((k, float(sil), float(-2 * gm.summary.logLikelihood + par * np.log(n))))
    return rows


def relabel(df: DataFrame, cluster: str, by: str) -> DataFrame:
    """Cluster numbers in ascending order of a mean (calm first)."""
    m = df.groupBy(cluster).agg(F.avg(by).alias("_m"))
    rank = m.select(cluster, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_m", cluster)) - 1).alias("_new"))  # k rows
    return df.join(F.broadcast(rank), cluster).drop(cluster).withColumnRenamed("_new", cluster)


def regimes(df: DataFrame, features: Sequence[str], k: int, vol: str, train: Column, dims: int = 3, seed: int = 42) -> DataFrame:
    """KMeans cluster (relabelled by volatility), mixture cluster and posteriors per row."""
    z, _ = reduce_features(df, features, dims, train)
    km = ck.KMeans(k=k, seed=seed, featuresCol="z", predictionCol="cluster_kmeans").fit(z.where(train))
    gm = ck.GaussianMixture(k=k, seed=seed, featuresCol="z", predictionCol="cluster_gmm", probabilityCol="_pr", maxIter=30).fit(z.where(train))
    out = gm.transform(km.transform(z)).withColumn("_pr", vector_to_array("_pr"))
    out = out.withColumns({f"gmm_prob_regime_{i}": F.col("_pr")[i] for i in range(k)}).drop("z", "_pr")
    return relabel(out, "cluster_kmeans", vol)


# ---- gate, registry, drift ------------------------------------------------------------------

def promotion_gate(df: DataFrame, new: str, existing: str, baseline: str, task: str) -> DataFrame:
    """First failing reason: floor, baseline x 1.05 (positive baselines), existing + 0.005."""
    v, e, b = F.col(new), F.col(existing), F.col(baseline)
    floor = F.when(F.col(task) == "regression", FLOOR["regression"]).otherwise(FLOOR["classification"])
    reason = (F.when(v < floor, "floor").when((b > 0) & (v < b * BEAT), "baseline").when(e.isNotNull() & (v < e + MIN_GAIN), "improvement"))
    return df.withColumns({"reason": F.coalesce(reason, F.lit("passes")), "promoted": reason.isNull()})


def best_model(metrics: DataFrame, metric: str, keys: Sequence[str] = ("target",)) -> DataFrame:
    m = metrics.where((F.col("model") != "baseline") & F.col(metric).isNotNull())
    return m.groupBy(*keys).agg(F.max(F.struct(metric, "model")).alias("b")).select(*keys, F.col("b.model").alias("model"), F.col(f"b.{metric}").alias("metric_value"))


def registry_state(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Active and previous row per key from promoted versions; rollback makes the previous one active."""
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    r = versions.where("promoted").withColumn("_rk", F.row_number().over(w)).where("_rk <= 2")
    return r.withColumn("state", F.when(F.col("_rk") == 1, "active").otherwise("previous")).drop("_rk")


def rollback(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Swap in the previous row where there is one; a single active row stays."""
    has = F.count(F.when(F.col("state") == "previous", 1)).over(Window.partitionBy(*keys)) > 0
    return state.withColumn("_has", has).withColumn("state", F.when(~F.col("_has"), F.col("state")).when(
        F.col("state") == "previous", "active").otherwise("rolled_back")).drop("_has")


def feature_drift(latest: DataFrame, stats: DataFrame, keys: Sequence[str] = ("symbol",), z_limit: float = 3.0, cap: int | None = None) -> DataFrame:
    """Latest (feature, value) against training mean, std, p05, p95: one row per flagged feature, by name.

    Each row also tells how many features were checked and flagged for its key; keys without a flag give
    one row with null feature and status ok. ``cap`` shortens the list of a report, not the counts.
    """
    j = latest.where("value is not null").join(stats, [*keys, "feature"])
    z = (F.col("value") - F.col("mean")) / F.greatest(F.col("std"), F.lit(1e-9))
    out = (F.col("value") < F.col("p05")) | (F.col("value") > F.col("p95"))
    j = j.withColumns({"z_score": F.bround(z, 2), "in_p5_p95": ~out, "_flag": (F.abs(z) > z_limit) | out})
    total = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features_checked"), F.count_if("_flag").alias("n_drift_flags"))
    total = total.withColumn("overall_status", F.when(F.col("n_drift_flags") == 0, "ok").otherwise("warning"))
    flags = j.where("_flag").drop("_flag")
    return total.join(flags if cap is None else top_per_group(flags, list(keys), [F.col("feature")], cap), list(keys), "left")


def model_drift(log: DataFrame, registered: DataFrame, window: int = 20, need: int = 10, drop: float = 0.10) -> DataFrame:
    """Rolling rank correlation of the last realised predictions against the registered one, with status."""
    def ic(pred, act, name):
        d = top_per_group(log.where(F.col(pred).isNotNull() & F.col(act).isNotNull()), ["symbol"], [F.desc("date")], window)
        d = d.withColumns({"_a": average_rank(pred, ["symbol"]), "_b": average_rank(act, ["symbol"])})
        g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), safe_div(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")).alias("_c"))
        return g.select("symbol", F.when(F.col("_n") >= need, F.bround("_c", 4)).alias(name))

    n = log.groupBy("symbol").agg(F.count(F.when(F.col("pred_1d").isNotNull() & F.col("actual_1d").isNotNull(), 1)).alias("n_with_actuals"), F.count(F.lit(1)).alias("n_observations"))
    j = n.join(ic("pred_1d", "actual_1d", "rolling_ic_1d"), "symbol", "left").join(ic("pred_5d", "actual_5d", "rolling_ic_5d"), "symbol", "left").join(registered, "symbol", "left")
    worse = lambda h: F.coalesce(F.col(f"rolling_ic_{h}") < F.col(f"registered_ic_{h}") - drop, F.lit(False))
    return j.withColumn("drift_status", F.when(F.col("n_with_actuals") < need, "insufficient_data").when(worse("1d") | worse("5d"), "degraded").when(
        F.col("rolling_ic_1d") < 0, "warning").otherwise("ok"))


def signal_of(r5, vol) -> tuple[Column, Column]:
    """Signal from the 5-day forecast at +-1% and confidence from the volatility forecast at 2% / 4%."""
    return (F.when(r5 > 0.01, "long").when(r5 < -0.01, "short").otherwise("neutral"),
            F.when(vol < 0.02, "high").when(vol > 0.04, "low").otherwise("medium"))


def backfill_actuals(preds: DataFrame, bars: DataFrame) -> DataFrame:
    """First and first-five log returns strictly after each prediction date; five days only when complete."""
    from tickloom.operators.asof import asof_join
    s = Series()
    ahead = s.rows(0, 4)
    f = bars.withColumns({"_r1": F.col("log_return"), "_r5": F.when(F.count("log_return").over(ahead) == 5, F.sum("log_return").over(ahead))})
    f = f.select("symbol", F.date_sub("date", 1).alias("_eve"), "_r1", "_r5")  # the first bar after d has eve >= d
    j = asof_join(preds, f, ["symbol"], "date", "_eve", ["_r1", "_r5"], "forward")
    return j.withColumnsRenamed({"_r1": "actual_1d", "_r5": "actual_5d"})
