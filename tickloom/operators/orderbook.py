"""Order-book state from an event table: live orders, levels, depth, order flow. No matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import safe_div
from tickloom.operators.sets import top_per_group


def tick_price(price: Column, tick: float) -> Column:
    return F.round(price / tick) * tick


def latest_orders(events: DataFrame) -> DataFrame:
    """The last event of every order by sequence; combines on the map side and works on streams."""
    row = F.struct("action", "side", "price", "qty", "seq")
    return events.groupBy("symbol", "order_id").agg(F.max_by(row, "seq").alias("e")).select("symbol", "order_id", "e.*")


def levels(orders: DataFrame, tick: float = 0.01) -> DataFrame:
    """Quantity and order count per price level of the live orders."""
    live = orders.where("action <> 'cancel' and qty > 0")
    return live.groupBy("symbol", "side", tick_price(F.col("price"), tick).alias("price")).agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("orders"))


def top_levels(lv: DataFrame, n: int) -> DataFrame:
    """Best n levels per side: bids from above, asks from below."""
    key = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    return top_per_group(lv, ["symbol", "side"], [key], n, rank="level")


def depth(lv: DataFrame, n: int = 10) -> DataFrame:
    """Depth totals, best prices, mid, spread and VWAP over the top n levels of both sides."""
    d = top_levels(lv, n)
    bid = F.col("side") == "bid"
    g = d.groupBy("symbol").agg(
        F.sum(F.when(bid, F.col("qty"))).alias("bid_depth"), F.sum(F.when(~bid, F.col("qty"))).alias("ask_depth"),
        F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(~bid, F.col("price"))).alias("best_ask"),
        safe_div(F.sum(F.col("price") * F.col("qty")), F.sum("qty")).alias("vwap"))
    return g.withColumns({"mid": (F.col("best_bid") + F.col("best_ask")) / 2, "spread": F.col("best_ask") - F.col("best_bid")})


def flow_summary(events: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Orders, adds, modifications and cancellations, and how many orders are still open."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1))
    g = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), n("add").alias("adds"), n("modify").alias("modifies"), n("cancel").alias("cancels"))
    o = latest_orders(events).groupBy(*keys).agg(F.count(F.lit(1)).alias("orders"), F.count(F.when(F.col("action") != "cancel", 1)).alias("open_orders"))
    return g.join(o, list(keys))
