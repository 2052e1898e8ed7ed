"""Principal components of many features from one pass of cross-products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.calibration import standard_columns


def cross_products(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, int]:
    """x'x of the feature columns (no nulls) and the number of rows; every task adds up its rows first."""
    d = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((d, d)), 0
        for b in batches:
            x = np.stack([np.asarray(c, float) for c in b.columns], 1)
            held, n = held + x.T @ x, n + len(x)
        yield pa.record_batch([pa.array(np.arange(d * d + 1), pa.int32()), pa.array(np.append(held.ravel(), n))], names=["at", "v"])

    total = np.zeros(d * d + 1)
    for r in df.select(*features).mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r["v"]
    return total[:-1].reshape(d, d), int(total[-1])


def pca_report(df: DataFrame, features: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """(component, variance_share, cumulative, n_90, n_95, feature, loading) of the standardised training rows.

    n_90 and n_95 are the numbers of components that reach 90 and 95 % of the variance. The largest loading of a
    component is positive, the first one on ties. Nulls take the training median; an empty table has no rows.
    """
    train = df if train is None else train
    xx, n = cross_products(standard_columns(train, [train], features)[0], features)
    value, vector = np.linalg.eigh(xx / max(n, 1))
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    share = value / value.sum() if value.sum() > 0 else value
    total = np.cumsum(share)
    reach = [int(np.searchsorted(total, level - 1e-12)) + 1 for level in (0.90, 0.95)]
    lead = np.abs(vector).argmax(0)
    vector = vector * np.sign(vector[lead, np.arange(len(features))])
    rows = [(i + 1, float(share[i]), float(total[i]), *reach, f, float(vector[j, i])) for i in range(len(features)) for j, f in enumerate(features)] if n else []
    return df.sparkSession.createDataFrame(rows, "component int, variance_share double, cumulative double, n_90 int, n_95 int, feature string, loading double")
