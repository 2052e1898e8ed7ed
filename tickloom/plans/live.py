"""Streaming queries run to completion on the given tables, and order-book tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import orderbook as ob
from tickloom.operators import portfolio as pf
from tickloom.operators.frames import Series
from tickloom.plans import views_sql as v
from tickloom.plans.registry import query
from tickloom.plans.trading import FILLS_SQL
from tickloom.sources import tables as t
from tickloom.session import shared_dir
from tickloom.streaming import jobs, state
from tickloom.streaming.store import TableStore

BOOK_SQL = """oe AS (SELECT 'B' || CAST(user_id % 4 AS VARCHAR) AS symbol, event_id AS seq, event_id // 3 AS order_id,
  CASE event_type WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'modify' ELSE 'add' END AS action, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, round(value, 0) AS price, event_id % 97 + 1 AS qty FROM events),
lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, order_id ORDER BY seq DESC) AS rk FROM oe) q WHERE rk = 1),
lv AS (SELECT symbol, side, round(price / 0.5) * 0.5 AS price, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS orders FROM lo WHERE action <> 'cancel' GROUP BY ALL),
tl AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM lv)"""


@query("book_levels", "R7", f"WITH {BOOK_SQL} SELECT * FROM lv")
def book_levels(spark, d):
    return ob.levels(ob.latest_orders(t.order_events(spark, d)), 0.5)


@query("book_top_levels", "O9", f"WITH {BOOK_SQL} SELECT symbol, side, price, qty, orders, CAST(level AS INTEGER) AS level FROM tl WHERE level <= 5")
def book_top_levels(spark, d):
    return ob.top_levels(ob.levels(ob.latest_orders(t.order_events(spark, d)), 0.5), 5)


@query("book_depth", "A29", f"""WITH {BOOK_SQL}, g AS (SELECT symbol, CAST(sum(qty) FILTER (WHERE side = 'bid') AS BIGINT) AS bid_depth, CAST(sum(qty) FILTER (WHERE side = 'ask') AS BIGINT) AS ask_depth,
  max(price) FILTER (WHERE side = 'bid') AS best_bid, min(price) FILTER (WHERE side = 'ask') AS best_ask, round(sum(price * qty) / sum(qty), 6) AS vwap FROM tl WHERE level <= 10 GROUP BY 1)
SELECT *, (best_bid + best_ask) / 2 AS mid, best_ask - best_bid AS spread FROM g""")
def book_depth(spark, d):
    return ob.depth(ob.levels(ob.latest_orders(t.order_events(spark, d)), 0.5)).withColumn("vwap", F.round("vwap", 6))


@query("order_flow_summary", "A30", f"""WITH {BOOK_SQL}, a AS (SELECT symbol, count(*) AS events, count(*) FILTER (WHERE action = 'add') AS adds, count(*) FILTER (WHERE action = 'modify') AS modifies, count(*) FILTER (WHERE action = 'cancel') AS cancels FROM oe GROUP BY 1),
b AS (SELECT symbol, count(*) AS orders, count(*) FILTER (WHERE action <> 'cancel') AS open_orders FROM lo GROUP BY 1) SELECT * FROM a JOIN b USING (symbol)""")
def order_flow_summary(spark, d):
    return ob.flow_summary(t.order_events(spark, d))


@query("stream_intraday_bars", "R9", f"WITH {v.intraday(300_000_000)} SELECT * FROM ibars")
def stream_intraday_bars(spark, d):
    s = jobs.file_stream(spark, d, "events.parquet").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))
    out = jobs.drain(jobs.tick_bars(s), "update", keep=("symbol", "ts"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_positions", "R4", f"WITH {FILLS_SQL} SELECT symbol, CAST(quantity AS DOUBLE) AS quantity, round(avg_price, 4) AS avg_price, fills FROM vw")
def stream_positions(spark, d):
    s = jobs.file_stream(spark, d, "lineitem.parquet").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").cast(t.MONEY).alias("quantity"), F.col("l_extendedprice").cast(t.MONEY).alias("value"))
    p = jobs.positions_now(jobs.drain(jobs.position_totals(s), "update", keep=("symbol",)))
    return p.select("symbol", F.col("quantity").cast("double").alias("quantity"), F.round(F.col("avg_price").cast("double"), 4).alias("avg_price"), "fills")


STATE_SQL = """f AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS sgn,
  CAST(round(l_quantity * 100) AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS val FROM lineitem),
r AS (SELECT *, sum(sgn * q) OVER w AS quantity FROM f WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
g AS (SELECT *, count(CASE WHEN quantity = 0 THEN 1 END) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS span FROM r),
pos AS (SELECT symbol, seq, CAST(quantity AS BIGINT) AS quantity, CASE WHEN quantity = 0 THEN 0 ELSE CAST(sum(sgn * val) OVER s AS BIGINT) END AS val, count(*) OVER s AS fills FROM g WINDOW s AS (PARTITION BY symbol, span ORDER BY seq)),
last AS (SELECT symbol, quantity, val, fills FROM pos QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1)"""


def stream_fills(spark, d):
    """Fills in landed order; seq is order and line."""
    return jobs.file_stream(spark, d, "lineitem.parquet").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("value"))


@query("stream_position_states", "R4 U-5", f"WITH {STATE_SQL} SELECT symbol, quantity / 100.0e0 AS quantity, round(val / CAST(quantity AS DOUBLE), 4) + 0.0 AS avg_price, fills FROM last WHERE quantity <> 0")
def stream_position_states(spark, d):
    """Positions in keyed state: the average counts from where the position was last flat, and flat ones are gone."""
    last = jobs.drain(state.position_states(stream_fills(spark, d)), "update", keep=("symbol",))
    return state.open_positions(last).select("symbol", "quantity", F.round("avg_price", 4).alias("avg_price"), "fills")


@query("stream_limit_alerts", "R6", f"""WITH {STATE_SQL}, b AS (SELECT *, abs(val) > 50000000 AS over, coalesce(lag(abs(val) > 50000000) OVER (PARTITION BY symbol ORDER BY seq), false) AS was FROM pos)
SELECT symbol, seq, abs(val) / 100.0e0 AS exposure, 'breach' AS kind FROM b WHERE over AND NOT was""")
def stream_limit_alerts(spark, d):
    """One alert per breach, and the next after a recovery."""
    return jobs.drain(state.limit_alerts(stream_fills(spark, d), 500000.0), "update")


@query("stream_order_checks", "R5", f"""WITH RECURSIVE {FILLS_SQL}, ex AS (SELECT CAST(substr(symbol, 2) AS BIGINT) % 7 AS book, sum(abs(CAST(quantity AS DOUBLE) * avg_price)) AS exposure FROM vw GROUP BY 1),
o AS (SELECT o_custkey % 50 % 7 AS book, o_orderkey AS seq, CAST(round(o_totalprice * 100) AS BIGINT) AS val, row_number() OVER (PARTITION BY o_custkey % 50 % 7 ORDER BY o_orderkey) AS rk FROM orders),
s AS (SELECT book, coalesce(max(ex.exposure), 0) AS e FROM (SELECT DISTINCT book FROM o) b LEFT JOIN ex USING (book) GROUP BY book),
w AS (SELECT book, CAST(0 AS BIGINT) AS rk, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS val, CAST(round(round(e, 2) * 100) AS BIGINT) AS spent, CAST(0 AS BIGINT) AS before, CAST('' AS VARCHAR) AS reason FROM s
  UNION ALL SELECT o.book, o.rk, o.seq, o.val, w.spent + CASE WHEN o.val <= 35000000 AND w.spent + o.val <= 4000000000 THEN o.val ELSE 0 END, w.spent,
    CASE WHEN o.val > 35000000 THEN 'order value limit' WHEN w.spent + o.val > 4000000000 THEN 'exposure limit' ELSE 'approved' END FROM w JOIN o ON o.book = w.book AND o.rk = w.rk + 1)
SELECT book, seq, val / 100.0e0 AS order_value, before / 100.0e0 AS exposure_before, reason FROM w WHERE rk > 0""")
def stream_order_checks(spark, d):
    """Orders of a stream against order value and the book's exposure, which runs on with every approved order."""
    o = jobs.file_stream(spark, d, "orders.parquet").select((F.col("o_custkey") % 50 % 7).alias("book"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))

    def held():
        p = pf.position_vwap(t.fills(spark, d)).withColumns({"quantity": F.col("quantity").cast("double"), "avg_price": F.col("avg_price").cast("double")})
        return p.groupBy((F.substring("symbol", 2, 20).cast("long") % 7).alias("book")).agg(F.round(F.sum(F.abs(F.col("quantity") * F.col("avg_price"))), 2).alias("exposure"))

    where = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    store = TableStore(spark, f"{where}/store")
    jobs.run_batches(o, f"{where}/state", jobs.order_decisions(store, held, 350000.0, 40000000.0))
    return store.read("decisions").select("book", "seq", (F.col("value_cents") / 100).alias("order_value"), (F.col("before_cents") / 100).alias("exposure_before"), "reason")


@query("stream_daily_build", "R3", f"WITH {v.UNIVERSE} SELECT symbol, date, round(close, 4) AS close, round(avg(close) OVER w, 6) + 0.0 AS sma_20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def stream_daily_build(spark, d):
    """The daily build as a stream: landed line items to bars and features, each batch taken once."""
    def build(batch, epoch):
        parts = t.parts_of(batch)
        feat = lambda b: b.repartition(parts, "symbol").select("symbol", "date", "close", F.avg("close").over(Series().back(20)).alias("sma_20"))
        return jobs.build_increment(t.line_bars(batch, t.supplier_symbol(), parts), store, feat, epoch=epoch)

    where = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"
    store = TableStore(spark, f"{where}/store")
    landed = jobs.file_stream(spark, d, "lineitem.parquet")
    jobs.run_batches(landed, f"{where}/state", build)
    return store.read("features").select("symbol", "date", F.round("close", 4).alias("close"), F.round("sma_20", 6).alias("sma_20"))


@query("stream_order_book", "R7", f"WITH {BOOK_SQL} SELECT * FROM lv")
def stream_order_book(spark, d):
    s = jobs.file_stream(spark, d, "events.parquet")
    s = t.book_events(s)
    return ob.levels(jobs.drain(jobs.book_orders(s), "update", keep=("symbol", "order_id")), 0.5)


@query("stream_news_feed", "R1 R2 S8", """SELECT DISTINCT doc_id AS article_id, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS symbol FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 < 2""")
def stream_news_feed(spark, d):
    """Messages arrive twice; each is kept once and only for subscribed symbols."""
    s = jobs.file_stream(spark, d, "documents.parquet")
    sym = F.when(F.col("doc_id") % 3 == 0, "A").when(F.col("doc_id") % 3 == 1, "N").otherwise("R")
    at = F.date_format(F.expr("date_add(date'2024-01-01', cast(doc_id % 20 as int))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("doc_id") % 5 == 0, "subscription").otherwise("n")
    body = F.to_json(F.struct(kind.alias("T"), F.col("doc_id").alias("id"), F.col("text").alias("headline"), at.alias("created_at"), F.array(sym, F.lit("Z")).alias("symbols")))
    twice = s.select(F.explode(F.array(body, body)).alias("body"))
    watch = t.table(spark, d, "region").select(F.element_at(F.array(F.lit("A"), F.lit("N")), (F.col("r_regionkey") % 2 + 1).cast("int")).alias("symbol")).distinct()
    return jobs.drain(jobs.news_feed(twice, watch), "append").select("article_id", "symbol")
