"""Headline timings: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom import plans
from tickloom.session import build_session

HEADLINES = ("latest_snapshot", "universe_technicals", "risk_features", "fundamentals_asof", "news_daily_scores", "tick_rolling_mean",
             "black_scholes_greeks", "volatility_signals", "stress_scenarios", "position_vwap", "order_limit_checks", "book_depth")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    plans.load_all()
    spark = build_session("bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINES:
        t0 = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": os.environ.get("BENCH_CPUS", "8")}))


if __name__ == "__main__":
    main()
