"""The partitioned stage store: one month of one symbol is replaced, the rest stays, and a warm-up read opens its months only."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from tickloom.sources import history as hs

SCHEMA = "symbol string, date date, close double, month date"


def rows(spark, bump=0.0):
    data = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), i + bump) for s in "AB" for i in range(366)]
    return spark.createDataFrame(data, "symbol string, date date, close double").repartition(3)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/part-*", recursive=True)}


def test_one_month_is_replaced_and_other_files_stay(spark, tmp_path):
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        hs.export(rows(spark), path, fmt)
        before = files(path)
        assert len(before) == 24  # one file per symbol and month
        hs.export(rows(spark, 1000.0).where("symbol = 'B' and month(date) = 5"), path, fmt)
        after = files(path)
        gone = set(before) - set(after)
        assert len(gone) == 1 and "symbol=B/month=2020-05-01" in gone.pop() and all(before[f] == after[f] for f in set(before) & set(after))
        got = hs.read_export(spark, path, SCHEMA, fmt)
        want = rows(spark).where("not (symbol = 'B' and month(date) = 5)").union(rows(spark, 1000.0).where("symbol = 'B' and month(date) = 5"))
        assert got.count() == 732 and got.drop("month").exceptAll(want).count() == 0


def test_warm_up_read_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "s")
    hs.export(rows(spark), path)
    names = tmp_path / "wanted"
    spark.createDataFrame([("A", dt.date(2020, 6, 20), dt.date(2020, 7, 3)), ("B", dt.date(2020, 3, 5), dt.date(2020, 3, 6)), ("C", dt.date(2020, 1, 1), dt.date(2020, 2, 1))], "symbol string, first date, last date").write.parquet(str(names))
    wanted = spark.read.parquet(str(names)).where("symbol <> 'C'")
    got = hs.warm_rows(hs.read_export(spark, path, SCHEMA), wanted, warmup=30)
    want = {("A", dt.date(2020, 5, 21) + dt.timedelta(days=i)) for i in range(44)} | {("B", dt.date(2020, 2, 4) + dt.timedelta(days=i)) for i in range(32)}
    assert {(r["symbol"], r["date"]) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert hs.warm_rows(hs.read_export(spark, path, SCHEMA), wanted.where("symbol = 'none'")).count() == 0
    assert got.agg(F.count_distinct("month")).first()[0] == 5
