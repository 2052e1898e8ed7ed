"""Walk-forward learning over all daily features: selection per fold, linear forecasts, ranking areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import calibration as cb, factors as fa, foldfits as ff, indicators as ind, learning as ml, matrix as mx, stats as st
from tickloom.plans.registry import query, rounded
from tickloom.plans.statistics import TARGET_SQL, labelled
from tickloom.session import cut_lineage
from tickloom.sources import tables as t


def daily_features(spark, d):
    """Every numeric feature that the bars alone give, with all six targets."""
    x = ind.add_momentum(ind.add_microstructure(ind.add_risk(ind.add_derived(ind.technicals(t.bars_daily(spark, d))))))
    x = st.add_targets(x.drop("prev_close", "delta", "true_range"))
    features = mx.numeric_columns(x)
    return cut_lineage(x.select("symbol", "date", *features, *mx.TARGETS)), features


def walk(spark, d):
    x, features = daily_features(spark, d)
    return cut_lineage(ff.linear_walk_forward(x, features, mx.TARGETS))


@query("lasso_selection", "A31 M11")
def lasso_selection(spark, d):
    """In how many expanding folds (step 21) the lasso of the fold selects each feature, for all six targets."""
    return rounded(ff.selection_frequency(walk(spark, d)), ["symbol", "target", "feature", "selected", "folds"], ["mean_abs", "share"])


def fold_metrics(spark, d):
    """Metrics of the linear models per symbol, target, model and fold; fold -1 is the holdout."""
    f = walk(spark, d).where("kind = 'forecast'")
    return ml.regression_metrics(f, "y", "value", ["symbol", "target", "name", "fold"]).withColumnRenamed("name", "model")


@query("linear_walk_forward", "M11 M14 M18")
def linear_walk_forward(spark, d):
    return rounded(fold_metrics(spark, d), ["symbol", "target", "model", "fold", "n"], ["mae", "rmse", "r2", "dir_acc", "ic"])


@query("linear_cv_summary", "A17 M24")
def linear_cv_summary(spark, d):
    """Mean and deviation of every metric over the folds, and which model has the best mean rank correlation."""
    names = ("mae", "rmse", "r2", "dir_acc", "ic")
    g = fold_metrics(spark, d).where("fold >= 0").groupBy("symbol", "target", "model").agg(
        F.count(F.lit(1)).alias("folds"), *[F.avg(c).alias(f"{c}_mean") for c in names], *[F.stddev_samp(c).alias(f"{c}_std") for c in names])
    best = g.groupBy("symbol", "target").agg(F.max_by("model", F.struct("ic_mean", "model")).alias("best_model"))
    return rounded(g.join(best, ["symbol", "target"]), ["symbol", "target", "model", "folds", "best_model"], [f"{c}_{k}" for c in names for k in ("mean", "std")])


@query("latest_linear_scores", "M26 F14")
def latest_linear_scores(spark, d):
    """Forecasts of all six targets on the newest row of every symbol, with the signal of the five-day forecast."""
    x, features = daily_features(spark, d)
    f = ff.latest_forecasts(x, features, mx.TARGETS).where("model = 'ridge'")
    g = f.groupBy("symbol", "date").agg(*[F.max(F.when(F.col("target") == tg, F.col("value"))).alias(f"pred_{tg[7:]}") for tg in mx.TARGETS])
    sig, conf = ml.signal_of(F.col("pred_5d"), F.col("pred_vol_5d"))
    return rounded(g.withColumns({"signal": sig, "confidence": conf}), ["symbol", "date", "signal", "confidence"], [f"pred_{tg[7:]}" for tg in mx.TARGETS])


@query("pca_table", "M7")
def pca_table(spark, d):
    """Variance shares, the numbers of components for 90 and 95 %, and all loadings, from the days before the holdout."""
    x, features = daily_features(spark, d)
    train = ml.number_dates(x).where(F.col("rn") < F.col("n_rows") - ml.HOLDOUT)
    return rounded(fa.pca_report(x, features, cut_lineage(train)), ["component", "n_90", "n_95", "feature"], ["variance_share", "cumulative", "loading"], 5)


@query("ranking_areas", "M9", f"""WITH {TARGET_SQL}, p AS (SELECT symbol, target_large_move AS y, round(abs(log_return), 2) AS s FROM targets WHERE log_return IS NOT NULL),
g AS (SELECT symbol, s, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY symbol ORDER BY s DESC))
SELECT symbol, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, round(sum((n - pos) * (cp - pos / 2.0e0)) / (sum(pos) * 1.0e0 * (sum(n) - sum(pos))), 6) AS roc_auc, round(sum(pos * 1.0e0 * cp / cn) / sum(pos), 6) AS pr_auc FROM c GROUP BY 1""")
def ranking_areas(spark, d):
    """ROC-AUC and average precision of a score with many ties."""
    x = labelled(spark, d).where("log_return is not null").withColumn("s", F.round(F.abs("log_return"), 2))
    return rounded(ff.ranking_areas(x, "target_large_move", "s", ["symbol"]), ["symbol", "n", "positives"], ["roc_auc", "pr_auc"])


@query("one_vs_rest_auc", "M9", f"""WITH {TARGET_SQL}, p AS (SELECT symbol, target_dir_1d AS y, unnest([-1, 0, 1]) AS c, round(log_return, 3) AS r FROM targets WHERE log_return IS NOT NULL),
s AS (SELECT symbol, c, CASE WHEN y = c THEN 1 ELSE 0 END AS y, CASE c WHEN 1 THEN r WHEN -1 THEN -r ELSE -abs(r) END AS s FROM p),
k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY symbol, c, s) - 1) / 2.0e0 AS rk FROM s WINDOW w AS (PARTITION BY symbol, c ORDER BY s)),
a AS (SELECT symbol, c, sum(y) AS pos, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * (count(*) - sum(y))) AS auc FROM k GROUP BY ALL)
SELECT symbol, round(sum(auc * pos) / sum(pos), 6) AS roc_auc_ovr, count(*) AS classes FROM a GROUP BY 1""")
def one_vs_rest_auc(spark, d):
    """ROC-AUC of up, flat and down against the others, weighted by their counts."""
    x = labelled(spark, d).where("log_return is not null").withColumn("r", F.round("log_return", 3))
    x = x.withColumns({"up": F.col("r"), "down": -F.col("r"), "flat": -F.abs("r")})
    return rounded(ff.one_vs_rest_auc(x, "target_dir_1d", {1: "up", 0: "flat", -1: "down"}, ["symbol"]), ["symbol", "classes"], ["roc_auc_ovr"])


@query("calibrated_classifiers", "M15 M13 M9")
def calibrated_classifiers(spark, d):
    """Class probabilities of balanced, calibrated margin classifiers on the holdout days: Brier score, log loss and areas per symbol and target."""
    x, features = daily_features(spark, d)
    x = cut_lineage(ml.number_dates(x))
    cut = F.col("n_rows") - ml.HOLDOUT
    out = None
    for target, classes in (("target_large_move", (0, 1)), ("target_dir_1d", (-1, 0, 1))):
        p = cut_lineage(cb.calibrated_svc(x.where(F.col("rn") < cut - ml.embargo_of(target)), x.where(F.col("rn") >= cut), features, target, classes))
        p = p.where(F.col(target).isNotNull())
        brier = sum((F.pow(F.col(f"p_{i}") - (F.col(target) == c).cast("double"), 2) for i, c in enumerate(classes)), F.lit(0.0))
        true = sum((F.when(F.col(target) == c, F.col(f"p_{i}")).otherwise(0.0) for i, c in enumerate(classes)), F.lit(0.0))
        g = p.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(brier).alias("brier"), F.avg(-F.log(F.greatest(true, F.lit(1e-15)))).alias("log_loss"))
        auc = ff.one_vs_rest_auc(p, target, {c: f"p_{i}" for i, c in enumerate(classes)}, ["symbol"]).select("symbol", "roc_auc_ovr")
        ap = ff.ranking_areas(p, target, f"p_{len(classes) - 1}", ["symbol"]).select("symbol", "pr_auc")
        g = g.join(auc, "symbol", "left").join(ap, "symbol", "left").withColumn("target", F.lit(target))
        out = g if out is None else out.unionByName(g)
    return rounded(out, ["symbol", "target", "n"], ["brier", "log_loss", "roc_auc_ovr", "pr_auc"])
