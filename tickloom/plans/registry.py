"""Named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under ``name``; ``covers`` lists the inventory rows it shows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, keep: list[str], nums: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in nums])


def sql_rounded(keep: list[str], nums: list[str], digits: int = 6) -> str:
    return ", ".join([*keep, *[f"round({c}, {digits}) + 0.0 AS {c}" for c in nums]])
