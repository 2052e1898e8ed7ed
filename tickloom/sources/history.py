"""Calibration history from landed CSV files, and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_history(spark: SparkSession, pattern: str, schema: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of all matching files with symbol and time read from names like SYM_model_YYYYMMDD_HHMMSS.csv."""
    df = spark.read.schema(schema).option("header", True).csv(pattern).withColumn("_f", F.col("_metadata.file_name"))
    stamp = F.regexp_extract("_f", r"(\d{8}_\d{6})", 1)
    df = df.withColumns({"symbol": F.regexp_extract("_f", r"^([^_]+)_", 1), "calibrated_at": F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))}).drop("_f")
    df = df.withColumn("date", F.to_date("calibrated_at")).where("date is not null")
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df.where(F.col("date") <= F.lit(end).cast("date")) if end else df


def export(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ("symbol", "month"), day: str = "date") -> None:
    """Write a stage or signal table in partitions as parquet or CSV; only partitions that ``df`` has rows for are replaced.

    ``month`` is the first day of the month of ``day``. Rows of a partition come together before the
    write, so it is one file.
    """
    if "month" in by and "month" not in df.columns:
        df = df.withColumn("month", F.trunc(day, "month"))
    w = df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.partitionBy(*by).save(path)


def read_export(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Stored rows; ``schema`` names the partition columns, too, so nothing is guessed from folder names."""
    r = spark.read.schema(schema).format(fmt)
    return (r.option("header", True) if fmt == "csv" else r).load(path).select(*T.StructType.fromDDL(schema).names)


def warm_rows(stored: DataFrame, wanted: DataFrame, warmup: int = 400, day: str = "date") -> DataFrame:
    """Stored rows from ``warmup`` days before what is wanted: ``wanted`` (symbol, first, last) has a row per symbol.

    The months of each symbol are joined to the partition columns, so the scan opens the partitions of the
    range only; the months are few beside the rows.
    """
    r = wanted.select("symbol", F.date_sub("first", warmup).alias("_first"), F.col("last").alias("_last")).where("_first <= _last")
    months = r.select("symbol", "_first", "_last", F.explode(F.sequence(F.trunc("_first", "month"), F.trunc("_last", "month"), F.expr("interval 1 month"))).alias("month"))
    return stored.join(months, ["symbol", "month"]).where(F.col(day).between(F.col("_first"), F.col("_last"))).select(*stored.columns)
