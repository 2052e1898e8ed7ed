"""Selection, learning, regimes, gate, registry and drift queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import indicators as ind, learning as ml, selection as se, stats as st
from tickloom.operators.frames import Series
from tickloom.plans import views_sql as v
from tickloom.plans.registry import query, rounded, sql_rounded
from tickloom.plans.statistics import TARGET_SQL, base, labelled
from tickloom.session import cut_lineage, shared_dir
from tickloom.sources import tables as t
from tickloom.streaming import jobs
from tickloom.streaming.store import TableStore

S = Series()
FEATS = ["realized_vol_20d", "realized_vol_60d", "skewness_20d", "max_drawdown_20d", "reversal_1w", "momentum_1m", "amihud_illiquidity", "trade_imbalance"]


def learn_table(spark, d):
    """Raw features and targets, written once: every fit below reads the files, not the lineage."""
    x = ind.add_momentum(ind.add_microstructure(ind.add_risk(ind.add_returns(t.bars_daily(spark, d)))))
    x = st.add_targets(x)
    return cut_lineage(x.select("symbol", "date", "log_return", *FEATS, "target_1d", "target_5d", "target_vol_5d", "target_dir_1d", "target_large_move", "target_regime"))


def scaled_table(spark, d):
    """The table imputed and standardised over all rows, for views of the whole sample that predict nothing."""
    return st.standardise(learn_table(spark, d), FEATS)


@query("walk_forward_folds", "M8 P18", f"""WITH {v.BARS}, n AS (SELECT symbol, count(*) - 51 AS a FROM bars GROUP BY 1),
f AS (SELECT symbol, a, CAST(unnest(range(0, (a - 121) // 21 + 1)) AS INTEGER) AS fold FROM n WHERE a > 120)
SELECT symbol, fold, greatest(120 + fold * 21 - 5, 0) AS train_stop, CAST(120 + fold * 21 AS BIGINT) AS val_start, least(120 + fold * 21 + 21, a) AS val_end FROM f""")
def walk_forward_folds(spark, d):
    f = ml.fold_table(t.bars_daily(spark, d), 5)
    return f.select("symbol", "fold", *[F.col(c).cast("long").alias(c) for c in ("train_stop", "val_start", "val_end")])


@query("split_roles", "P18 M8", f"""WITH {v.BARS}, r AS (SELECT symbol, date, row_number() OVER {v.LINE} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, date, CAST(CASE WHEN rn >= 120 AND rn < n - 51 THEN (rn - 120) // 21 END AS INTEGER) AS fold, rn >= n - 51 AS is_holdout FROM r""")
def split_roles(spark, d):
    return ml.split_role(ml.number(t.bars_daily(spark, d))).select("symbol", "date", "fold", "is_holdout")


@query("regression_metrics", "M9", f"""WITH {TARGET_SQL}, p AS (SELECT symbol, target_1d AS y, log_return AS p FROM targets WHERE target_1d IS NOT NULL AND log_return IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0e0 AS ry,
  rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0e0 AS rp, avg(y) OVER (PARTITION BY symbol) AS my FROM p)
SELECT symbol, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 6) AS r2,
  round(avg(CASE WHEN sign(y) = sign(p) THEN 1.0e0 ELSE 0 END), 6) AS dir_acc, round(corr(ry, rp), 6) AS ic FROM r GROUP BY 1""")
def regression_metrics(spark, d):
    return rounded(ml.regression_metrics(labelled(spark, d), "target_1d", "log_return", ["symbol"]), ["symbol", "n"], ["mae", "rmse", "r2", "dir_acc", "ic"])


@query("classification_metrics", "M9 M10", f"""WITH {TARGET_SQL}, p AS (SELECT symbol, target_dir_1d AS y, CASE WHEN log_return > 0 THEN 1 ELSE -1 END AS p FROM targets WHERE log_return IS NOT NULL),
c AS (SELECT symbol, unnest([-1, 0, 1]) AS c FROM (SELECT DISTINCT symbol FROM p)),
k AS (SELECT c.symbol, c.c, count(CASE WHEN y = c THEN 1 END) AS t, count(CASE WHEN p = c THEN 1 END) AS q, count(CASE WHEN y = c AND p = c THEN 1 END) AS h FROM c JOIN p USING (symbol) GROUP BY ALL),
f AS (SELECT *, CASE WHEN t + q > 0 THEN 2.0e0 * h / (t + q) ELSE 0 END AS f1 FROM k WHERE t + q > 0)
SELECT symbol, CAST(sum(t) AS BIGINT) AS n, round(sum(h) / sum(t), 6) AS acc, round(avg(CASE WHEN t > 0 THEN h * 1.0e0 / t END), 6) AS bal_acc, round(sum(f1 * t) / sum(t), 6) AS f1_w, round(avg(f1), 6) AS f1_macro FROM f GROUP BY 1""")
def classification_metrics(spark, d):
    x = labelled(spark, d).where("log_return is not null").withColumn("p", F.when(F.col("log_return") > 0, 1).otherwise(-1))
    return rounded(ml.classification_metrics(x, "target_dir_1d", "p", ["symbol"]), ["symbol", "n"], ["acc", "bal_acc", "f1_w", "f1_macro"])


@query("roc_auc", "M9", f"""WITH {TARGET_SQL}, p AS (SELECT symbol, target_large_move AS y, abs(log_return) AS s FROM targets WHERE log_return IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY s) + (count(*) OVER (PARTITION BY symbol, s) - 1) / 2.0e0 AS rk FROM p),
g AS (SELECT symbol, sum(y) AS p, count(*) AS n, sum(CASE WHEN y = 1 THEN rk END) AS s FROM r GROUP BY 1)
SELECT symbol, round((s - p * (p + 1) / 2.0e0) / (p * (n - p)), 6) AS roc_auc FROM g""")
def roc_auc(spark, d):
    x = labelled(spark, d).where("log_return is not null").withColumn("s", F.abs("log_return"))
    return ml.roc_auc(x, "target_large_move", "s", ["symbol"]).withColumn("roc_auc", F.round("roc_auc", 6))


@query("naive_baselines", "M10", f"""WITH {TARGET_SQL}, a AS (SELECT symbol, target_5d, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rk FROM targets WHERE target_5d IS NOT NULL),
b AS (SELECT symbol, target_vol_5d, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rk FROM targets WHERE target_vol_5d IS NOT NULL),
c AS (SELECT symbol, target_dir_1d, count(*) AS n FROM targets GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, target_dir_1d) AS rk FROM c),
e AS (SELECT symbol, arg_max(target_regime, date) AS r FROM targets WHERE target_regime IS NOT NULL GROUP BY 1)
SELECT symbol, 'target_5d' AS target, round(avg(target_5d), 6) + 0.0 AS baseline FROM a WHERE rk <= 20 GROUP BY 1 UNION ALL SELECT symbol, 'target_vol_5d', round(median(target_vol_5d), 6) FROM b WHERE rk <= 5 GROUP BY 1
UNION ALL SELECT symbol, 'target_dir_1d', target_dir_1d * 1.0e0 FROM d WHERE rk = 1 UNION ALL SELECT symbol, 'target_regime', r FROM e""")
def naive_baselines(spark, d):
    x = labelled(spark, d)
    out = None
    for tg in ("target_5d", "target_vol_5d", "target_dir_1d", "target_regime"):
        b = ml.baselines(x, tg).select("symbol", F.lit(tg).alias("target"), F.round("baseline", 6).alias("baseline"))
        out = b if out is None else out.unionByName(b)
    return out


@query("class_weights", "M13", f"""WITH {TARGET_SQL}, g AS (SELECT symbol, target_dir_1d, count(*) AS n FROM targets GROUP BY ALL)
SELECT symbol, target_dir_1d, n, round(sum(n) OVER (PARTITION BY symbol) * 1.0e0 / (count(*) OVER (PARTITION BY symbol) * n), 6) AS weight FROM g""")
def class_weights(spark, d):
    return ml.class_weights(labelled(spark, d), "target_dir_1d", ["symbol"]).withColumn("weight", F.round("weight", 6))


@query("feature_pruning", "M2 M3", """SELECT 'realized_copy' AS feature, 'correlated' AS reason""")
def feature_pruning(spark, d):
    x = scaled_table(spark, d).withColumn("realized_copy", F.col("reversal_1w") * 2 + 1)
    cols = ["reversal_1w", "momentum_1m", "trade_imbalance", "realized_copy"]
    bad = [("correlated", c) for c in se.prune_correlated(x, cols)] + [("low_variance", c) for c in se.low_variance(x, cols)]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(r).alias("reason")) for r, c in bad])
    return x.agg(F.count(F.lit(1))).select(F.explode(rows).alias("r")).select("r.*")


@query("mutual_information", "M4 O6")
def mutual_information(spark, d):
    x = scaled_table(spark, d)
    a = se.mutual_information(x, FEATS, "target_5d").withColumn("target", F.lit("target_5d"))
    b = se.mutual_information(x, FEATS, "target_regime", discrete=True).withColumn("target", F.lit("target_regime"))
    return rounded(a.unionByName(b), ["target", "feature"], ["mi"])


@query("linear_feature_paths", "M5 M6")
def linear_feature_paths(spark, d):
    x = ml.number(scaled_table(spark, d)).withColumn("cv", F.floor(F.col("rn") * 5 / F.col("n_rows")).cast("int"))
    c = se.combine_paths(se.linear_paths(x, FEATS, ["target_1d", "target_5d"], "cv"))
    return rounded(c, ["target", "feature"], ["lasso", "ridge", "combined"])


@query("recommended_features", "M6 O6")
def recommended_features(spark, d):
    x = ml.number(scaled_table(spark, d)).withColumn("cv", F.floor(F.col("rn") * 5 / F.col("n_rows")).cast("int"))
    c = se.combine_paths(se.linear_paths(x, FEATS, ["target_5d"], "cv"))
    mi = se.mutual_information(x, FEATS, "target_5d").withColumn("target", F.lit("target_5d"))
    return se.recommend(c, mi, top_mi=30)


@query("oversampled_classes", "M12", f"""WITH {TARGET_SQL}, c AS (SELECT target_large_move, count(*) AS n FROM targets GROUP BY 1)
SELECT target_large_move, CASE WHEN target_large_move IS NULL THEN n ELSE (SELECT max(n) FROM c WHERE target_large_move IS NOT NULL) END AS n FROM c""")
def oversampled_classes(spark, d):
    x = scaled_table(spark, d)
    return ml.oversample(x, "target_large_move", FEATS).groupBy("target_large_move").agg(F.count(F.lit(1)).alias("n"))


def ladder(spark, d):
    x = learn_table(spark, d)
    n = x.select("date").distinct().count()
    reg = ml.regressors()
    return ml.walk_forward(x, FEATS, "target_vol_5d", {k: reg[k] for k in ("ridge", "rf")}, init=n // 2, step=n // 4)


@query("model_ladder", "M11 M14 M18")
def model_ladder(spark, d):
    """Large walk-forward folds by date and the holdout, for two regressors and the baseline, per symbol."""
    return rounded(ladder(spark, d), ["version", "target", "symbol", "model", "fold", "n"], ["mae", "rmse", "r2", "dir_acc", "ic"])


@query("cv_summary", "A17")
def cv_summary(spark, d):
    m = model_ladder(spark, d).where("fold >= 0")
    return m.groupBy("target", "version", "symbol", "model").agg(F.round(F.avg("ic"), 6).alias("ic_mean"), F.round(F.stddev_samp("ic"), 6).alias("ic_std"), F.count(F.lit(1)).alias("folds"))


@query("best_models", "M24")
def best_models(spark, d):
    """Model with the best mean rank correlation over the folds, per symbol and target."""
    m = ladder(spark, d).where("fold >= 0").groupBy("symbol", "target", "model").agg(F.avg("ic").alias("ic"))
    return rounded(ml.best_model(m, "ic", ("symbol", "target")), ["symbol", "target", "model"], ["metric_value"])


@query("model_importances", "M16")
def model_importances(spark, d):
    """Shares of the features in the forest and in the ridge coefficients, fitted on the days before the holdout."""
    x = ml.number_dates(learn_table(spark, d).where("target_vol_5d is not null")).where(F.col("rn") < F.col("n_rows") - ml.HOLDOUT)
    (tr,), _, _ = ml.prepare(x, [], FEATS, "target_vol_5d")
    reg = ml.regressors()
    rows = [(m, f, v) for m in ("ridge", "rf") for f, v in ml.importances(reg[m].fit(tr), FEATS)]
    shares = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("feature"), F.lit(v).alias("importance")) for m, f, v in rows])
    return rounded(tr.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(shares).alias("r")).select("n_rows", "r.*"), ["n_rows", "model", "feature"], ["importance"])


@query("regime_counts", "M7 M20 M21")
def regime_counts(spark, d):
    """Silhouette and BIC for 2 to 6 regimes on the reduced features, with the variance share of each kept dimension."""
    x = ml.number(scaled_table(spark, d))
    z, share = ml.reduce_features(x, FEATS, len(FEATS), F.col("rn") < F.col("n_rows") * 0.8)
    z = cut_lineage(z.select("z"))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("silhouette"), F.lit(b).alias("bic")) for k, s, b in ml.choose_k(z)])
    out = z.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(rows).alias("r"), F.array(*[F.round(F.lit(float(v)), 6) for v in share]).alias("variance_shares"))
    return rounded(out.select("n_rows", "r.*", "variance_shares"), ["n_rows", "k", "variance_shares"], ["silhouette", "bic"], 4)


@query("market_regimes", "M7 M20 M21 A16")
def market_regimes(spark, d):
    """Regimes fitted on the first 80% of each symbol's rows, profiled over all rows."""
    x = ml.number(scaled_table(spark, d))
    r = ml.regimes(x, FEATS, 3, "realized_vol_20d", F.col("rn") < F.col("n_rows") * 0.8)
    return r.groupBy("cluster_kmeans").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in FEATS[:4]], F.round(F.avg("gmm_prob_regime_0"), 4).alias("gmm_p0")).orderBy("cluster_kmeans")


_MIX = {"ridge": 0.2, "gbt_a": 0.4, "gbt_b": 0.4}
_STRESS = {"ridge": 0.4, "gbt_a": 0.3, "gbt_b": 0.3}


@query("ensemble_predictions", "M19", f"""WITH {TARGET_SQL}, p AS (SELECT symbol, date, log_return AS a, lag(log_return) OVER {v.LINE} AS b, CASE WHEN day(date) % 3 <> 0 THEN lag(log_return, 2) OVER {v.LINE} END AS c, coalesce(target_regime, 0) AS rg FROM targets),
q AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS s,
  coalesce(a * 0.2e0, 0) + coalesce(b * 0.4e0, 0) + coalesce(c * 0.4e0, 0) AS w1, CASE WHEN a IS NULL THEN 0 ELSE 0.2e0 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4e0 END + CASE WHEN c IS NULL THEN 0 ELSE 0.4e0 END AS d1,
  coalesce(a * 0.4e0, 0) + coalesce(b * 0.3e0, 0) + coalesce(c * 0.3e0, 0) AS w2, CASE WHEN a IS NULL THEN 0 ELSE 0.4e0 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3e0 END + CASE WHEN c IS NULL THEN 0 ELSE 0.3e0 END AS d2 FROM p)
SELECT symbol, date, CASE WHEN n >= 2 THEN round(s / n, 6) + 0.0 END AS ensemble_mean, CASE WHEN n >= 2 THEN round(w1 / d1, 6) + 0.0 END AS ensemble_weighted,
  CASE WHEN n >= 2 THEN round(CASE WHEN rg = 0 THEN w1 / d1 ELSE w2 / d2 END, 6) + 0.0 END AS ensemble_regime FROM q""")
def ensemble_predictions(spark, d):
    x = labelled(spark, d)
    x = x.select("symbol", "date", F.col("log_return").alias("a"), S.lag("log_return").alias("b"), F.when(F.dayofmonth("date") % 3 != 0, S.lag("log_return", 2)).alias("c"), F.coalesce("target_regime", F.lit(0.0)).alias("rg"))
    e = ml.ensembles(x, {"ridge": "a", "gbt_a": "b", "gbt_b": "c"}, _MIX, _MIX, _STRESS, "rg")
    return rounded(e, ["symbol", "date"], ["ensemble_mean", "ensemble_weighted", "ensemble_regime"])


_GATE = f"""g0 AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'regression' ELSE 'classification' END AS task, s_acctbal / 10000 AS nv,
  CASE WHEN s_suppkey % 3 <> 0 THEN (s_acctbal - 500 + s_suppkey * 6) / 10000 END AS ev, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 10500 + (s_suppkey % 4) / 100.0e0 - 0.01e0 END AS bv FROM supplier)"""


@query("promotion_gate", "M23", f"""WITH {_GATE} SELECT k, task, CASE WHEN nv < CASE WHEN task = 'regression' THEN 0.02 ELSE 0.30 END THEN 'floor' WHEN bv > 0 AND nv < bv * 1.05e0 THEN 'baseline'
  WHEN ev IS NOT NULL AND nv < ev + 0.005e0 THEN 'improvement' ELSE 'passes' END AS reason FROM g0""")
def promotion_gate(spark, d):
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    g = t.table(spark, d, "supplier").select(
        k.alias("k"), F.when(k % 2 == 0, "regression").otherwise("classification").alias("task"), (b / 10000).alias("nv"),
        F.when(k % 3 != 0, (b - 500 + k * 6) / 10000).alias("ev"), F.when(k % 5 != 0, b / 10500 + (k % 4) / 100.0 - 0.01).alias("bv"))
    return ml.promotion_gate(g, "nv", "ev", "bv", "task").select("k", "task", "reason")


@query("registry_state", "M25", """WITH x AS (SELECT o_orderpriority AS target, CAST(date_trunc('month', o_orderdate) AS DATE) AS version, avg(o_totalprice) AS mv FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY version DESC) AS rk FROM x WHERE month(version) % 2 = 0)
SELECT target, version, CASE rk WHEN 1 THEN 'rolled_back' ELSE 'active' END AS state FROM r WHERE rk <= 2""")
def registry_state(spark, d):
    """Promoted monthly versions per key; a rollback makes the previous one active."""
    x = t.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("target"), F.to_date(F.trunc("o_orderdate", "month")).alias("version")).agg(F.avg("o_totalprice").alias("mv"))
    s = ml.registry_state(x.withColumn("promoted", F.month("version") % 2 == 0), ["target"])
    return ml.rollback(s, ["target"]).select("target", "version", "state")


_DRIFT = ["log_return", "realized_vol_20d", "volume", "close", "high"]


@query("feature_drift", "M27", f"""WITH {TARGET_SQL}, l AS ({' UNION ALL '.join(f"SELECT symbol, date, '{c}' AS feature, {c} AS value FROM targets" for c in _DRIFT)}),
e AS (SELECT symbol, max(date) AS newest FROM targets GROUP BY 1),
s AS (SELECT symbol, feature, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95 FROM l WHERE date < DATE '2000-01-01' GROUP BY ALL),
n AS (SELECT l.symbol, l.feature, l.value FROM l JOIN e ON l.symbol = e.symbol AND l.date = e.newest WHERE l.value IS NOT NULL),
f AS (SELECT symbol, feature, round((value - mean) / greatest(std, 1e-9), 2) + 0.0 AS z_score, NOT (value < p05 OR value > p95) AS in_p5_p95,
  abs((value - mean) / greatest(std, 1e-9)) > 3 OR value < p05 OR value > p95 AS flag FROM n JOIN s USING (symbol, feature)),
c AS (SELECT symbol, count(*) AS n_features_checked, count(CASE WHEN flag THEN 1 END) AS n_drift_flags FROM f GROUP BY 1)
SELECT c.symbol, n_features_checked, n_drift_flags, CASE WHEN n_drift_flags = 0 THEN 'ok' ELSE 'warning' END AS overall_status, feature, z_score, in_p5_p95
FROM c LEFT JOIN (SELECT * FROM f WHERE flag) g USING (symbol)""")
def feature_drift(spark, d):
    """Newest row of each symbol against its rows before 2000."""
    x = labelled(spark, d)
    stats = st.train_stats(x.where("date < date'2000-01-01'"), _DRIFT)
    newest = x.groupBy("symbol").agg(F.max("date").alias("date"))
    latest = st.long_form(x.join(newest, ["symbol", "date"], "left_semi"), ["symbol"], _DRIFT)
    return ml.feature_drift(latest, stats).select("symbol", "n_features_checked", "n_drift_flags", "overall_status", "feature", "z_score", "in_p5_p95")


def prediction_log(spark, d):
    """Predictions on every fourth calendar day of a year, trading day or not."""
    b = ind.add_returns(t.bars_daily(spark, d))
    days = b.select("symbol", F.date_add("date", (F.dayofmonth("date") % 3).cast("int")).alias("date"), F.col("log_return").alias("pred_1d"), (-F.col("log_return") * 2).alias("pred_5d")).where(F.dayofmonth("date") % 4 == 0)
    p = days.groupBy("symbol", "date").agg(F.max("pred_1d").alias("pred_1d"), F.min("pred_5d").alias("pred_5d"))
    return ml.backfill_actuals(p, b)


LOG_SQL = f"""{v.BARS}, {v.RET}, d0 AS (SELECT symbol, CAST(date + CAST(day(date) % 3 AS INTEGER) AS DATE) AS date, log_return AS p1, -log_return * 2 AS p5 FROM ret),
d1 AS (SELECT symbol, date, max(p1) AS pred_1d, min(p5) AS pred_5d FROM d0 WHERE day(date) % 4 = 0 GROUP BY ALL),
f AS (SELECT symbol, date, log_return AS r1, CASE WHEN count(log_return) OVER q = 5 THEN sum(log_return) OVER q END AS r5 FROM ret WINDOW q AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
plog AS (SELECT d1.*, f.r1 AS actual_1d, f.r5 AS actual_5d FROM d1 ASOF LEFT JOIN f ON d1.symbol = f.symbol AND d1.date < f.date)"""


@query("prediction_actuals", "J10 R8", f"WITH {LOG_SQL} SELECT {sql_rounded(['symbol', 'date'], ['pred_1d', 'pred_5d', 'actual_1d', 'actual_5d'])} FROM plog")
def prediction_actuals(spark, d):
    return rounded(prediction_log(spark, d), ["symbol", "date"], ["pred_1d", "pred_5d", "actual_1d", "actual_5d"])


_IC = "SELECT symbol, count(*) AS n, round(corr(ra, rb), 4) + 0.0 AS c FROM (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY a) + (count(*) OVER (PARTITION BY symbol, a) - 1) / 2.0e0 AS ra, rank() OVER (PARTITION BY symbol ORDER BY b) + (count(*) OVER (PARTITION BY symbol, b) - 1) / 2.0e0 AS rb FROM (SELECT symbol, {p} AS a, {q} AS b, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rk FROM plog WHERE {p} IS NOT NULL AND {q} IS NOT NULL) x WHERE rk <= 20) y GROUP BY 1"


@query("model_drift", "M28 W47", f"""WITH {LOG_SQL}, i1 AS ({_IC.format(p='pred_1d', q='actual_1d')}), i5 AS ({_IC.format(p='pred_5d', q='actual_5d')}), n AS (SELECT symbol, count(CASE WHEN pred_1d IS NOT NULL AND actual_1d IS NOT NULL THEN 1 END) AS n_with_actuals FROM plog GROUP BY 1)
SELECT symbol, n_with_actuals, i1.c AS rolling_ic_1d, i5.c AS rolling_ic_5d, CASE WHEN n_with_actuals < 10 THEN 'insufficient_data' WHEN i1.c < 0.05 - 0.10 OR i5.c < 0.30 - 0.10 THEN 'degraded' WHEN i1.c < 0 THEN 'warning' ELSE 'ok' END AS drift_status
FROM n LEFT JOIN i1 USING (symbol) LEFT JOIN i5 USING (symbol)""")
def model_drift(spark, d):
    log = prediction_log(spark, d)
    reg = log.select("symbol").distinct().select("symbol", F.lit(0.05).alias("registered_ic_1d"), F.lit(0.30).alias("registered_ic_5d"))
    return ml.model_drift(log, reg).select("symbol", "n_with_actuals", "rolling_ic_1d", "rolling_ic_5d", "drift_status")


@query("prediction_upsert", "J17 U2", f"""WITH {LOG_SQL}, n AS (SELECT symbol, date, pred_1d + 1 AS pred_1d FROM plog WHERE year(date) = 2001)
SELECT symbol, date, round(pred_1d, 6) + 0.0 AS pred_1d FROM plog WHERE (symbol, date) NOT IN (SELECT (symbol, date) FROM n) UNION ALL SELECT symbol, date, round(pred_1d, 6) + 0.0 FROM n""")
def prediction_upsert(spark, d):
    from tickloom.operators.sets import replace_rows
    log = prediction_log(spark, d).select("symbol", "date", "pred_1d")
    new = log.where("year(date) = 2001").withColumn("pred_1d", F.col("pred_1d") + 1)
    return replace_rows(log, new, ["symbol", "date"]).withColumn("pred_1d", F.round("pred_1d", 6))


@query("stream_prediction_log", "R8 J17 J10", f"""WITH {v.BARS}, {v.RET}, f AS (SELECT symbol, date, log_return AS r1, CASE WHEN count(log_return) OVER q = 5 THEN sum(log_return) OVER q END AS r5 FROM ret WINDOW q AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
p AS (SELECT {v.STATUS_SYMBOL} AS symbol, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) / 1e5 AS pred_1d, arg_max(o_totalprice, o_orderkey) / -1e5 AS pred_5d FROM orders GROUP BY 1, 2)
SELECT p.symbol, p.date, round(pred_1d, 7) + 0.0 AS pred_1d, round(pred_5d, 7) + 0.0 AS pred_5d, round(f.r1, 6) + 0.0 AS actual_1d, round(f.r5, 6) + 0.0 AS actual_5d FROM p ASOF LEFT JOIN f ON p.symbol = f.symbol AND p.date < f.date""")
def stream_prediction_log(spark, d):
    """A stream of forecasts: the newest per symbol and day stays, realised returns are filled in, each batch is taken once."""
    made = jobs.file_stream(spark, d, "orders.parquet").select(
        t.status_symbol().alias("symbol"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 1e5).alias("pred_1d"), (F.col("o_totalprice") / -1e5).alias("pred_5d"), F.col("o_orderkey").alias("made_at"))
    where = f"{shared_dir(spark)}/predictions-{uuid.uuid4().hex}"
    store = TableStore(spark, f"{where}/store")
    jobs.run_batches(made, f"{where}/state", lambda batch, epoch: jobs.upsert_predictions(batch, store, epoch, ind.add_returns(t.bars_daily(spark, d))))
    log = store.read("log").withColumns({c: F.round(c, 7) for c in ("pred_1d", "pred_5d")})
    return rounded(log, ["symbol", "date", "pred_1d", "pred_5d"], ["actual_1d", "actual_5d"])


@query("latest_scores", "M26 F14 O8")
def latest_scores(spark, d):
    """Ridge forecasts of the 5-day return and volatility on the newest row per symbol, with signal."""
    x = learn_table(spark, d)
    last = x.groupBy("symbol").agg(F.max("date").alias("date")).join(x, ["symbol", "date"])
    out = None
    for tg in ("target_5d", "target_vol_5d"):
        (tr, la), _, _ = ml.prepare(x.where(F.col(tg).isNotNull()), [last], FEATS, tg)
        p = ml.regressors()["ridge"].fit(tr).transform(la).select("symbol", "date", F.col("prediction").alias(f"pred_{tg[7:]}"))
        out = p if out is None else out.join(p, ["symbol", "date"])
    sig, conf = ml.signal_of(F.col("pred_5d"), F.col("pred_vol_5d"))
    return rounded(out.withColumns({"signal": sig, "confidence": conf}), ["symbol", "date", "signal", "confidence"], ["pred_5d", "pred_vol_5d"])
