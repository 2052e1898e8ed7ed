"""Operator semantics on small fixtures."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest as bt, econometrics as ec, learning as ml, matrix as mx, options as op, portfolio as pf, selection as se, sets, signals as sg, stats as st
from tickloom.operators.news import dedupe_headlines, dedupe_prefix
from tickloom.sources import tables as t
from tickloom.streaming import jobs
from tickloom.streaming.store import TableStore

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]


def test_null_share_limit_is_strict(spark):
    df = spark.createDataFrame([(None, None, 1.0), (None, None, 1.0), (1.0, None, 1.0), (2.0, 1.0, 1.0)], "half double, dead double, one double")
    assert mx.mostly_null(df) == ["dead"] and "one" in mx.constant_columns(df)
    assert mx.constant_columns(df.where("half = 1")) == []


def test_targets(spark):
    df = spark.createDataFrame([("X", D[i], r, 0.1 + i) for i, r in enumerate([.01, .02, .03, .04, .05, .0, .005, .0])], "symbol string, date date, log_return double, realized_vol_20d double")
    rows = st.add_targets(df).orderBy("date").collect()
    assert rows[0]["target_1d"] == .02 and rows[-1]["target_1d"] is None and rows[-1]["target_dir_1d"] == 0
    assert rows[5]["target_dir_1d"] == 0 and abs(rows[0]["target_5d"] - .14) < 1e-12 and rows[-1]["target_5d"] is None
    assert st.add_targets(df, keep_null=True).orderBy(F.desc("date")).first()["target_dir_1d"] is None


def test_gate(spark):
    rows = [(.101, None, .10, "regression"), (.356, .35, .30, "classification"), (.01, None, None, "regression"), (.352, .35, None, "classification")]
    got = ml.promotion_gate(spark.createDataFrame(rows, "n double, e double, b double, t string"), "n", "e", "b", "t").collect()
    assert [r["reason"] for r in got] == ["baseline", "passes", "floor", "improvement"]


def test_dedupe_and_fallback(spark):
    a = spark.createDataFrame([(1, D[0], "Same"), (2, D[0], "Same"), (3, D[0], "same"), (4, D[1], "Same")], "article_id int, date date, headline string")
    assert sorted(r["article_id"] for r in dedupe_headlines(a).collect()) == [1, 3, 4]
    assert sorted(r["article_id"] for r in dedupe_prefix(a).collect()) == [1, 4]
    p = spark.createDataFrame([("A", 1)], "k string, v int")
    q = spark.createDataFrame([("A", 2), ("B", 3)], "k string, v int")
    assert sorted((r["k"], r["v"]) for r in sets.first_source([p, q], ["k"]).collect()) == [("A", 1), ("B", 3)]


def test_increment_equals_full_build(spark, tmp_path):
    b = spark.createDataFrame([("X", d, float(i)) for i, d in enumerate(D)], "symbol string, date date, close double")
    feat = lambda x: x.withColumn("m", F.avg("close").over(__import__("tickloom.operators.frames", fromlist=["Series"]).Series().back(5)))
    store = TableStore(spark, str(tmp_path / "s"))
    upto = lambda hi: b.where(F.col("date") < F.lit(D[0] + dt.timedelta(days=hi)))
    calls = []

    def breaks(x):
        calls.append(1)
        raise OSError("lost in the middle")

    for epoch, hi in enumerate((20, 20, 45, 60)):
        if epoch == 2:  # a batch that fails half-way leaves nothing behind and is replayed
            with pytest.raises(OSError):
                jobs.build_increment(upto(hi), store, breaks, warmup=30, epoch=epoch)
            assert store.epochs() == [0, 1]
        assert jobs.build_increment(upto(hi), store, feat, warmup=30, epoch=epoch)
        assert not jobs.build_increment(upto(hi), store, feat, warmup=30, epoch=epoch)  # a replay changes nothing
    got = store.read("features")
    assert calls and got.count() == 60 and got.exceptAll(feat(b)).count() == 0
    assert mx.is_up_to_date(b, got)


def test_csv_history_dates_from_file_names(spark, tmp_path):
    from tickloom.sources.history import load_history
    for day, a in (("20240102", 0.2), ("20240105", 0.3)):
        pd.DataFrame({"alpha": [a], "rho": [-.1], "nu": [.5]}).to_csv(tmp_path / f"SPY_sabr_{day}_101500.csv", index=False)
    got = load_history(spark, str(tmp_path / "*_sabr_*.csv"), "alpha double, rho double, nu double", "2024-01-03").collect()
    assert len(got) == 1 and got[0]["symbol"] == "SPY" and got[0]["alpha"] == 0.3


def test_implied_vol_round_trip(spark):
    rows = [(100.0, 90.0 + k, 0.25, c, 0.1 + 0.01 * k) for k in range(20) for c in ("call", "put")]
    df = spark.createDataFrame(rows, "spot double, strike double, time_to_maturity double, option_type string, vol double")
    df = op.with_bs_price(df, "mid_price", F.col("spot"), F.col("strike"), F.col("time_to_maturity"), F.lit(0.03), F.col("vol"), F.col("option_type") == "call")
    for r in op.add_implied_vol(df, 0.03).collect():
        assert abs(r["implied_volatility"] - r["vol"]) < 1e-6


def test_max_pain_by_brute_force(spark, sf):
    front = t.chain(spark, sf).join(op.front_expiry(t.chain(spark, sf)), ["symbol", "expiry"])
    got = {r["symbol"]: r["opt_max_pain"] for r in op.max_pain(front).collect()}
    for sym, g in front.toPandas().groupby("symbol"):
        ks, oi = np.sort(g["strike"].unique()), g["open_interest"].fillna(0)
        call = g["option_type"] == "call"
        pain = [round(float((np.maximum(s - g["strike"], 0) * oi * call + np.maximum(g["strike"] - s, 0) * oi * ~call).sum()), 2) for s in ks]
        assert got[sym] == ks[int(np.argmin(pain))]


def test_calibration_finds_known_surface(spark, sf):
    q = op.quote_fields(t.chain(spark, sf), t.RATE).where("symbol = 'Brand#1'")
    f = F.col("spot") * F.exp(F.lit(t.RATE) * F.col("time_to_maturity"))
    q = op.with_sabr_vol(q, "implied_volatility", f, F.col("strike"), F.col("time_to_maturity"), *[F.lit(x) for x in (0.3, 1.0, -0.3, 0.8)])
    q = op.with_sabr_price(q.drop("mid_price"), "mid_price", F.col("spot"), F.col("strike"), F.col("time_to_maturity"), F.lit(t.RATE), "implied_volatility", F.col("option_type") == "call")
    best = op.calibrate_sabr(op.add_quote_weights(q), t.RATE, rounds=1).first()
    assert (best["alpha"], best["rho"], best["nu"]) == (0.3, -0.3, 0.8) and best["objective"] < 1e-9


def test_sizing_respects_limits(spark):
    c = [(f"i{k:03d}", "X", "call", "buy", 90.0 + k, 100.0, 30.0, 0.5, 100.0 + k, 1.0, 1.1, 1.05 + 0.01 * k, 500, 500, .5, .05, 10.0, 1.0, 120.0) for k in range(60)]
    df = spark.createDataFrame(c, "intent_id string, symbol string, option_type string, side string, strike double, spot double, maturity_days double, confidence double, expected_net_edge_bps double, bid double, ask double, mid double, volume int, open_interest int, delta double, gamma double, vega double, theta double, stress_loss_per_contract double")
    lim = pf.Limits()
    p = pf.size_positions(df, lim).toPandas()
    assert 0 < len(p) and p["contracts"].max() <= 50 and p["vega"].sum() <= lim.max_abs_vega
    assert p["premium_notional"].sum() <= lim.capital_usd * lim.max_maturity_alloc_pct + 1e-6


def test_backtest_parts_add_up(spark, sf):
    path = bt.market_path(t.bars_daily(spark, sf).where("date < date'1995-04-01'"))
    d = bt.rolling_reentry(path, "Delta-Neutral Short Vol").toPandas()
    total = d["mtm_pnl"] + d["realized_pnl"] + d["hedge_pnl"] - d["hedge_costs"] - d["transaction_costs"]
    assert np.allclose(total, d["total_pnl"])
    for _, g in d.sort_values("date").groupby("symbol"):
        assert np.allclose(250000 + g["total_pnl"].cumsum(), g["equity"])


def test_running_hedge_by_loop(spark):
    sgn = {"buy": 1, "sell": -1}
    rows = [(f"p{i}", "X", "buy" if i % 3 else "sell", 2, 20.0 * (i + 1) * (1 if i % 2 else -1), .1, 1.0, -1.0, 5.0, 4.9, 5.1) for i in range(6)]
    tg = spark.createDataFrame(rows, "intent_id string, symbol string, side string, contracts int, delta double, gamma double, vega double, theta double, mid double, bid double, ask double")
    fills = tg.select("intent_id", F.lit(True).alias("accepted"), F.col("contracts").alias("filled_contracts"), F.lit(5.05).alias("fill_price"))
    path = spark.createDataFrame([("X", D[i], ds, 1.0, "normal") for i, ds in enumerate([0.0, 1.5, -2.0])], "symbol string, date date, dspot double, iv_change_points double, regime string")
    got = bt.daily_pnl(tg, fills, tg, path, bt.Config(running_hedge=True)).orderBy("date").collect()
    run, shares = 0.0, 0.0
    for r in rows:
        run += sgn[r[2]] * r[4]
        shares += round(-run) if abs(run) >= 25 else 0
    assert [round(g["hedge_pnl"], 9) for g in got] == [0.0, shares * 1.5, shares * -2.0]


def test_ols_adf_and_f_tail(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 1.5 + x @ [2.0, -1.0] + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"k": "s", "a": x[:, 0], "b": x[:, 1], "y": y}))
    fit = st.ols(df, ["k"], "y", ["a", "b"]).first()["fit"]
    z = np.column_stack([np.ones(200), x])
    want, rss, *_ = np.linalg.lstsq(z, y, rcond=None)
    assert np.allclose(fit["beta"], want) and math.isclose(fit["rss"], float(rss[0]), rel_tol=1e-9)
    assert abs(ec.f_survival(4.0, 2, 10) - (1 + 4.0 * 2 / 10) ** -5) < 1e-12
    p = spark.createDataFrame([(7.0,)], "x double").select(ec.chi2_sf(F.col("x"), 1), ec.chi2_sf(F.col("x"), 5), ec.chi2_sf(F.col("x"), 4)).first()
    assert abs(p[0] - math.erfc(math.sqrt(3.5))) < 1e-12 and abs(p[2] - math.exp(-3.5) * 4.5) < 1e-12 and 0.22 < p[1] < 0.2207


def test_garch_path_follows_recursion(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0, 0.01, 1500)
    day = lambda i: dt.date(2015, 1, 1) + dt.timedelta(days=i)
    df = spark.createDataFrame([("X", day(i), float(v)) for i, v in enumerate(r)], "symbol string, date date, log_return double")
    par = spark.createDataFrame([("X", "garch_1_1", 1e-6, 0.002, 0.997)], "symbol string, spec string, omega double, alpha double, beta double")
    got = [x["sigma2"] for x in ec.garch_path(df, par).orderBy("date").collect()]
    e2, v = (r - r.mean()) ** 2, np.var(r)
    for i in range(1500):
        assert math.isclose(got[i], v, rel_tol=1e-9)
        v = 1e-6 + 0.002 * e2[i] + 0.997 * v


def test_folds_do_not_leak(spark):
    df = spark.createDataFrame([("X", d) for d in [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(260)]], "symbol string, date date")
    f = ml.fold_table(df, 5).orderBy("fold").collect()
    assert all(r["train_stop"] + 5 == r["val_start"] and r["val_end"] <= 260 - 51 for r in f) and f[-1]["val_end"] == 209


def test_lasso_against_its_conditions():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5))
    y = x @ [1.0, 0, 0, -0.5, 0] + rng.normal(size=300) * .1
    x, y = x - x.mean(0), y - y.mean()
    w = se.lasso_solve(x.T @ x, x.T @ y, 300, 0.05)
    g = x.T @ (y - x @ w) / 300
    assert np.all(np.abs(g) <= 0.05 + 1e-6) and np.allclose(g[w != 0], 0.05 * np.sign(w[w != 0]), atol=1e-6)


def test_oversampling_balances(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(float(a), float(b), int(i < 12)) for i, (a, b) in enumerate(rng.normal(size=(100, 2)))], "a double, b double, y int")
    got = {r["y"]: r["n"] for r in ml.oversample(df, "y", ["a", "b"]).groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got[0] == got[1] == 88


def test_oversampling_is_one_method_at_any_size(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2100, 2))
    x[:700] = 1.0  # a third of the minority is one point
    df = spark.createDataFrame(pd.DataFrame({"a": np.r_[x[:, 0], rng.normal(size=9000)], "b": np.r_[x[:, 1], rng.normal(size=9000)], "y": [1] * 2100 + [0] * 9000}))
    made = ml.oversample(df, "y", ["a", "b"], bucket=256).where("y = 1").toPandas()
    assert len(made) == 9000 and made["a"].between(x[:, 0].min(), x[:, 0].max()).all()
    lone = spark.createDataFrame([(1.0, 2.0, 1)] + [(0.0, 0.0, 0)] * 4, "a double, b double, y int")
    assert [tuple(r) for r in ml.oversample(lone, "y", ["a", "b"]).where("y = 1").collect()] == [(1.0, 2.0, 1)] * 4


def test_prediction_upsert_versions(spark, tmp_path):
    sch = "symbol string, date date, pred_1d double, made_at int"
    store = TableStore(spark, str(tmp_path))
    jobs.upsert_predictions(spark.createDataFrame([("X", D[0], .1, 1), ("X", D[1], .2, 1)], sch), store, 0)
    jobs.upsert_predictions(spark.createDataFrame([("X", D[1], .3, 1), ("X", D[1], .4, 2)], sch), store, 1)
    assert sorted(r["pred_1d"] for r in store.read("log").collect()) == [.1, .4]


def test_legs_and_fill_reasons(spark):
    c = spark.createDataFrame([("a", 1.0, 1.2, 1.1, 500, 500), ("b", 1.0, 1.2, 1.1, 500, 5), ("c", 1.0, 1.2, 1.1, 30, 500), ("d", 1.3, 1.2, 1.1, 500, 500)], "intent_id string, bid double, ask double, mid double, volume int, open_interest int")
    tg = spark.createDataFrame([(i, "X", "buy", 5) for i in "abcdz"], "intent_id string, symbol string, side string, contracts int")
    got = {r["intent_id"]: r["reason"] for r in pf.simulate_fills(tg, c).collect()}
    assert got == {"a": "filled", "b": "min_open_interest_fail", "c": "max_participation_fail", "d": "bad_quote", "z": "missing_candidate"}


def test_var_orders_equal_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    d = pd.DataFrame(x, columns=["a", "b"]).assign(date=[dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(200)])
    got = ec.var_orders(spark.createDataFrame(d), ["a", "b"], 3).orderBy("p").collect()
    for p, r in enumerate(got, 1):
        z = np.column_stack([np.ones(197)] + [x[3 - k:200 - k] for k in range(1, p + 1)])
        e = x[3:] - z @ np.linalg.lstsq(z, x[3:], rcond=None)[0]
        assert r["p"] == p and r["n"] == 197 and math.isclose(r["aic"], np.linalg.slogdet(e.T @ e / 197)[1] + 2 * 2 * (1 + 2 * p) / 197, rel_tol=1e-9)


def test_word_shares(spark):
    from tickloom.operators.scoring import text_probabilities, word_probabilities
    d = spark.createDataFrame([("Strong GAIN, weak debt; again",), (None,), ("",)], "text string")
    got = [tuple(r["p"]) for r in d.select(word_probabilities("text").alias("p")).collect()]
    assert got == [(0.4, 0.4, 0.2), (0.0, 0.0, 1.0), (0.0, 0.0, 1.0)]
    own = d.select(text_probabilities(F.col("text"), lambda: lambda texts: [(1.0, 0.0, 0.0)] * len(texts)).alias("p")).collect()
    assert all(tuple(r["p"]) == (1.0, 0.0, 0.0) for r in own)
