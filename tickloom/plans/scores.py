"""Text scores, classifiers, tuning and volatility comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import econometrics as ec, learning as ml
from tickloom.operators.scoring import NEGATIVE_WORDS, POSITIVE_WORDS, daily_probabilities
from tickloom.operators.stats import pair_corr
from tickloom.plans import views_sql as v
from tickloom.plans.models import FEATS, learn_table
from tickloom.plans.registry import query, rounded
from tickloom.plans.statistics import base
from tickloom.sources import tables as t

_P = ", ".join(f"'{w}'" for w in POSITIVE_WORDS)
_N = ", ".join(f"'{w}'" for w in NEGATIVE_WORDS)


@query("text_sentiment_daily", "A2 U-3", f"""WITH {v.NEWS}, w AS (SELECT symbol, date, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM news),
c AS (SELECT symbol, date, len(list_filter(ws, lambda x: x IN ({_P}))) AS p, len(list_filter(ws, lambda x: x IN ({_N}))) AS n FROM w)
SELECT symbol, date, round(avg(p * 1.0e0 / (p + n + 1)), 6) AS positive, round(avg(n * 1.0e0 / (p + n + 1)), 6) AS negative, round(avg(1.0e0 / (p + n + 1)), 6) AS neutral,
  round(avg((p - n) * 1.0e0 / (p + n + 1)), 6) + 0.0 AS score, count(*) AS articles FROM c GROUP BY ALL""")
def text_sentiment_daily(spark, d):
    return rounded(daily_probabilities(t.news(spark, d)), ["symbol", "date", "articles"], ["positive", "negative", "neutral", "score"])


@query("classifier_ladder", "M15 M13 M9")
def classifier_ladder(spark, d):
    x = learn_table(spark, d)
    n = x.select("date").distinct().count()
    m = ml.walk_forward(x, FEATS, "target_large_move", {k: e for k, e in ml.classifiers(2).items() if k in ("logistic", "svc")}, init=n // 2, step=n // 2, task="classification")
    return rounded(m, ["version", "target", "symbol", "model", "fold", "n"], ["acc", "bal_acc", "f1_w", "f1_macro"])


@query("tuned_ridge", "M17")
def tuned_ridge(spark, d):
    """Random search over regularisation with time-ordered inner splits; one row with the winner."""
    x = learn_table(spark, d).where("target_vol_5d is not null")
    params, rmse = ml.random_search(x, FEATS, "target_vol_5d", ml.regressors()["ridge"], {"regParam": [0.001, 0.01, 0.1, 1.0, 10.0], "elasticNetParam": [0.0, 0.25, 0.5, 0.75, 1.0]}, n=6)
    return x.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(float(params["regParam"])).alias("reg_param"), F.lit(float(params["elasticNetParam"])).alias("elastic_net"), F.round(F.lit(rmse), 6).alias("rmse"))


@query("garch_vs_realized", "E12")
def garch_vs_realized(spark, d):
    r = base(spark, d).select("symbol", "date", "log_return", "realized_vol_20d")
    par = ec.fit_volatility(r.select("symbol", "date", "log_return"), (("garch_1_1", 1, True),))
    p = ec.garch_path(r, par).withColumn("garch_vol", F.sqrt(F.col("sigma2") * 252))
    return p.groupBy("symbol").agg(F.round(pair_corr(F.col("garch_vol"), F.col("realized_vol_20d")), 5).alias("corr"), F.count(F.lit(1)).alias("n"))
