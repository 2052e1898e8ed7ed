"""A spread of registered queries against their SQL on the smallest tables."""

import os

import pytest
from check import compare, duck

import __spark_entry__ as entry

NAMES = ["bars_daily", "smoothed_indicators", "cross_asset_features", "fundamentals_asof", "news_nearest_join", "insight_news_flat",
         "earnings_distance", "surface_metrics", "forward_targets", "regression_metrics", "position_vwap", "book_depth"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    res = duck(sf).execute(entry.oracle_sql()[name])
    assert compare(df.columns, got, [c[0] for c in res.description], res.fetchall()) == ""


def test_entry_and_catalogue(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "COVERAGE.md"))
