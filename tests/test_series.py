"""Series helpers against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.numeric import clip, norm_cdf, safe_div
from tickloom.operators import indicators as ind
from tickloom.operators.asof import align_to_spine, asof_join, asof_nearest, event_distance
from tickloom.operators.frames import Ewm, Series, add_ewm, average_rank, number_rows, with_halo
from tickloom.plans import features
from tickloom.sources import tables

S = Series()


def walk(n=400, seed=1, symbol="X"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    d = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    return pd.DataFrame({"symbol": symbol, "date": d, "open": close * 0.99, "high": close * 1.02, "low": close * 0.97, "close": close,
                         "volume": rng.integers(1, 1000, n).astype(float)})


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(pd.concat([walk(400, 1, "X"), walk(333, 2, "Y")]))


def pull(df, *cols):
    return df.orderBy("symbol", "date").toPandas()[list(cols)]


@pytest.mark.parametrize("span,block", [(9, 16), (20, 128), (200, 32)])
def test_ewm_equals_pandas(spark, bars, span, block):
    got = pull(add_ewm(bars, [Ewm.span("e", "close", span)], S, block=block), "symbol", "close", "e")
    for _, g in got.groupby("symbol"):
        want = g["close"].ewm(span=span, adjust=False).mean()
        assert np.allclose(g["e"], want, rtol=1e-11)


def test_wilder_rsi_and_atr(spark, bars):
    got = pull(ind.technicals(bars), "symbol", "high", "low", "close", "rsi_14", "atr_14", "macd_hist")
    for _, g in got.groupby("symbol"):
        d = g["close"].diff()
        up = d.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
        dn = (-d).clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
        assert np.allclose(g["rsi_14"], 100 - 100 / (1 + up / dn), equal_nan=True)
        tr = pd.concat([g["high"] - g["low"], (g["high"] - g["close"].shift()).abs(), (g["low"] - g["close"].shift()).abs()], axis=1).max(axis=1)
        assert np.allclose(g["atr_14"], tr.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean(), equal_nan=True)
        m = g["close"].ewm(span=12, adjust=False).mean() - g["close"].ewm(span=26, adjust=False).mean()
        assert np.allclose(g["macd_hist"], m - m.ewm(span=9, adjust=False).mean())


def test_rolling_moments(spark, bars):
    got = pull(ind.add_risk(ind.add_returns(bars)), "symbol", "log_return", "skewness_20d", "kurtosis_20d", "vol_of_vol")
    for _, g in got.groupby("symbol"):
        r = g["log_return"]
        assert np.allclose(g["skewness_20d"], r.rolling(20, min_periods=10).skew(), equal_nan=True)
        assert np.allclose(g["kurtosis_20d"], r.rolling(20, min_periods=10).kurt(), equal_nan=True)
        v = r.rolling(20, min_periods=5).std() * np.sqrt(252)
        assert np.allclose(g["vol_of_vol"], v.rolling(20, min_periods=5).std(), equal_nan=True)


def test_future_rows_do_not_change_the_past(spark, bars):
    cut = dt.date(2020, 9, 1)
    full = ind.add_momentum(ind.add_risk(ind.technicals(bars))).where(F.col("date") < F.lit(cut))
    part = ind.add_momentum(ind.add_risk(ind.technicals(bars.where(F.col("date") < F.lit(cut)))))
    assert full.exceptAll(part).count() == 0 and part.exceptAll(full).count() == 0


def test_fill_limits(spark):
    d = [dt.date(2024, 1, i + 1) for i in range(5)]
    df = spark.createDataFrame([("X", d[0], 1.0)] + [("X", x, None) for x in d[1:]], "symbol string, date date, v double")
    got = [r[0] for r in df.withColumn("f", S.ffill("v", 3)).orderBy("date").select("f").collect()]
    assert got == [1, 1, 1, 1, None]


def test_chunked_windows_equal_plain(spark, bars):
    x = number_rows(bars, ["symbol"], ["date"], F.trunc("date", "month"))
    x = with_halo(x, "_pos", back=9, chunk=13)
    s = Series(("symbol", "_chunk"), ("_pos",))
    got = pull(x.withColumn("m", s.mean("close", 10)).where("_home"), "symbol", "close", "m")
    assert len(got) == 733
    for _, g in got.groupby("symbol"):
        assert np.allclose(g["m"], g["close"].rolling(10).mean(), equal_nan=True)


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(5)
    day = lambda k: [dt.date(2020, 1, 1) + dt.timedelta(days=int(i)) for i in sorted(rng.choice(300, k, replace=False))]
    left = pd.concat([pd.DataFrame({"symbol": s, "date": day(120)}) for s in "AB"])
    right = pd.concat([pd.DataFrame({"symbol": s, "at": day(25)}) for s in "AB"])
    right["v"] = rng.normal(size=len(right))
    return left, right


@pytest.mark.parametrize("bucket", [None, 7, 60])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_equals_merge_asof(spark, sides, direction, bucket):
    left, right = sides
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["symbol"], "date", "at", ["v"], direction, bucket_days=bucket)
    got = got.orderBy("date", "symbol").toPandas()
    l, r = left.assign(date=pd.to_datetime(left["date"])), right.assign(at=pd.to_datetime(right["at"]))
    want = pd.merge_asof(l.sort_values(["date", "symbol"]), r.sort_values("at"), left_on="date", right_on="at", by="symbol", direction=direction)
    assert np.allclose(got["v"], want["v"], equal_nan=True)


def test_asof_nearest(spark, sides):
    left, right = sides
    out = asof_nearest(spark.createDataFrame(left), spark.createDataFrame(right), ["symbol"], "date", "at", ["v"], 4, bucket_days=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = out.orderBy("date", "symbol").toPandas()
    l, r = left.assign(date=pd.to_datetime(left["date"])), right.assign(at=pd.to_datetime(right["at"]))
    want = pd.merge_asof(l.sort_values(["date", "symbol"]), r.sort_values("at"), left_on="date", right_on="at", by="symbol", direction="nearest", tolerance=pd.Timedelta("4d"))
    assert np.allclose(got["v"], want["v"], equal_nan=True)


def test_event_distance_and_alignment(spark, sides):
    left, right = sides
    l, r = spark.createDataFrame(left), spark.createDataFrame(right)
    row = event_distance(l, r, ["symbol"], "date", "at").where("earn_days_to_next = 0").first()
    assert row["earn_days_since_last"] == 0 and row["earn_is_week"] == 1
    a = align_to_spine(l, r.withColumnRenamed("at", "date"), ["symbol"], "date", ["v"], 5)
    assert a.count() == len(left)


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (-9.0, 2.0)], "a double, b double")
    rows = df.select(safe_div("a", "b").alias("q"), clip("a", -1, 1).alias("c")).collect()
    assert [r["q"] for r in rows] == [None, None, -4.5] and [r["c"] for r in rows] == [1.0, None, -1.0]
    import math
    xs = [-8.0, -3.0, -0.5, 0.0, 1.7, 6.0, 7.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(norm_cdf("x")).collect()
    for x, g in zip(xs, got):
        assert abs(g[0] - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-14
    r = spark.createDataFrame([("s", v) for v in (3.0, 1.0, 3.0, None)], "k string, v double").withColumn("r", average_rank("v", ["k"])).orderBy("v").collect()
    assert [x["r"] for x in r] == [None, 1.0, 2.5, 2.5]


def test_universe_is_dealt_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PART_ROWS", 100)
    items = spark.range(4000).selectExpr(
        "id AS l_orderkey", "cast(1 AS int) AS l_linenumber", "id % 200 AS l_suppkey", "double(1 + id % 7) AS l_quantity",
        "double(100 + id % 13) AS l_extendedprice", "cast(date_add(date'2024-01-01', cast(id div 200 AS int)) AS timestamp) AS l_shipdate")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    dealt = tables.series_universe(spark, str(tmp_path))
    parts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(parts) > 20 and max(r["n"] for r in parts) <= 250 and sum(r["n"] for r in parts) == 4000
    assert dealt.select("symbol", F.spark_partition_id()).distinct().count() == 200
    got = sorted(map(tuple, features.universe_technicals(spark, str(tmp_path)).collect()), key=str)
    monkeypatch.setattr(tables, "PART_ROWS", 250_000)
    assert got == sorted(map(tuple, features.universe_technicals(spark, str(tmp_path)).collect()), key=str) and len(got) == 4000
