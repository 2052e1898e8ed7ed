"""Readers for the base tables and the market views derived from them.

Every view is a deterministic expression over a base table and grows with it. Money sums go
through DECIMAL so that the result does not depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.frames import fence

MONEY = "decimal(18,2)"
#: Rows of one part of a table with many symbols: what a task sorts stays the same when the table grows.
PART_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def exact_sum(c: str | Column, kind: str = MONEY) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(kind)).cast("double")


def cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100.0


def _bars(trades: DataFrame, *keys: str) -> DataFrame:
    """OHLCV by keys from (px, qty, tick). ``tick`` is one DECIMAL holding order and price, so
    open and close stay inside hash aggregation and combine on the map side."""
    return trades.groupBy(*keys).agg(
        F.min_by("px", "tick").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "tick").alias("close"), exact_sum("qty").alias("volume"))


def parts_of(rows: DataFrame) -> int:
    """Parts of at most about ``PART_ROWS`` rows, and no fewer than a shuffle has."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))


def line_bars(items: DataFrame, symbol: Column, parts: int | None = None) -> DataFrame:
    """Daily bars of line items, which may be a batch of a stream.

    With few symbols the bars combine before the shuffle. With many there is little to combine, and
    ``parts`` deals the items by symbol and day so that the groups of a task stay bounded.
    """
    px = cents(F.col("l_extendedprice") / F.col("l_quantity"))
    seq = F.col("l_orderkey").cast("decimal(20,0)") * 10 + F.col("l_linenumber").cast("decimal(20,0)")
    tick = seq.cast("decimal(26,0)") * F.lit(10**12).cast("decimal(14,0)") + F.round(px * 100).cast("decimal(14,0)")
    trades = items.where("l_quantity > 0").select(
        symbol.alias("symbol"), F.to_date("l_shipdate").alias("date"), px.alias("px"),
        F.col("l_quantity").alias("qty"), tick.cast("decimal(38,0)").alias("tick"))
    return _bars(trades.repartition(parts, "symbol", "date") if parts else trades, "symbol", "date")


def supplier_symbol() -> Column:
    return F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: one symbol per return flag, ordered trades inside a ship date."""
    return line_bars(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"))


def bars_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with one symbol per supplier: a wide universe that grows with the data."""
    items = table(spark, sf_dir, "lineitem")
    return line_bars(items, supplier_symbol(), parts_of(items))


def series_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe dealt by symbol, for windows over whole series; a part holds a bounded number of rows."""
    items = table(spark, sf_dir, "lineitem")
    parts = parts_of(items)
    return line_bars(items, supplier_symbol(), parts).repartition(parts, "symbol")


def bars_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index series: mean order price per day."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (exact_sum("o_totalprice") / F.count("o_totalprice")).alias("close"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), "user_id", "props")


def bars_intraday(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """Bars of any width from ticks, ordered by (ts, event_id)."""
    tick = (F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)") * F.lit(10**14).cast("decimal(16,0)")
            + F.col("event_id").cast("decimal(20,0)")).cast("decimal(38,0)")
    t = ticks(spark, sf_dir).select("symbol", "ts", F.col("price").alias("px"), F.lit(1).alias("qty"),
                                    tick.alias("tick"))
    t = t.withColumn("ts", F.window("ts", width)["start"])
    return _bars(t, "symbol", "ts")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: provider, headline, day and weight from documents; score from labels."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("score"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("article_id"), F.col("source").alias("provider"), "lang",
        F.col("text").alias("headline"), "text",
        F.expr("date_add(date'1995-01-02', cast(pmod(doc_id, 2499) as int))").alias("date"),
        F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.expr("cast(pmod(doc_id, 3) as int) + 1")).alias("symbol"),
        "score", F.col("n_chars").cast("double").alias("weight"))


def status_symbol() -> Column:
    """Bar symbol of an order status."""
    return F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")


def fundamentals_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statement figures per symbol (order status)."""
    o = table(spark, sf_dir, "orders")
    q = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    return o.groupBy(status_symbol().alias("symbol"), q.alias("period_end")).agg(
        exact_sum("o_totalprice").alias("revenue"),
        F.count(F.lit(1)).cast("double").alias("orders"),
        exact_sum(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice"))).alias("cost"),
        exact_sum(F.when(F.col("o_orderpriority").startswith("2"), F.col("o_totalprice"))).alias("debt"))


def statement(spark: SparkSession, sf_dir: str, tier: str = "quarter") -> DataFrame:
    """Statement lines in the form the ratio suite expects; annual sums the quarters."""
    f = fundamentals_raw(spark, sf_dir)
    if tier == "annual":
        f = f.groupBy("symbol", F.make_date(F.year("period_end"), F.lit(12), F.lit(31)).alias("period_end")).agg(
            *[exact_sum(c).alias(c) for c in ("revenue", "orders", "cost", "debt")])
    rev, cost, debt = F.col("revenue"), F.col("cost"), F.col("debt")
    return f.select(
        "symbol", "period_end", rev.alias("total_revenue"), (rev - cost).alias("gross_profit"),
        (rev - 2 * cost).alias("operating_income"), (rev - 2.5 * cost).alias("net_income"),
        F.when(F.col("orders") > 0, (rev - 2.5 * cost) / (F.col("orders") * 100)).alias("diluted_eps"),
        (rev - 1.5 * cost).alias("operating_cash_flow"), (-0.25 * cost).alias("capital_expenditure"),
        (rev - debt).alias("stockholders_equity"), (rev * 2).alias("total_assets"), debt.alias("total_debt"),
        (debt * 0.5).alias("cash"), (rev * 0.75).alias("current_assets"), (debt * 1.25).alias("current_liabilities"))


def report_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First order date of each quarter per status, mapped onto bar symbols."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(status_symbol().alias("symbol"), F.trunc("o_orderdate", "quarter").alias("_q")).agg(
        F.min(F.to_date("o_orderdate")).alias("event_date")).drop("_q")


def insider_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider trades: free text by priority, shares by order value."""
    text = F.element_at(F.create_map(
        F.lit("1-URGENT"), F.lit("Purchase at price"), F.lit("2-HIGH"), F.lit("Sale at price"),
        F.lit("3-MEDIUM"), F.lit("Stock Award(Grant)"), F.lit("5-LOW"), F.lit("Sell to cover")),
        F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        status_symbol().alias("symbol"), F.col("o_orderkey").alias("txn_id"), F.to_date("o_orderdate").alias("date"),
        F.coalesce(text, F.lit("Gift")).alias("text"), F.col("o_totalprice").alias("shares"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed trades in DECIMAL: buys on open lines, sells on finished ones."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.to_date("l_shipdate").alias("date"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").cast(MONEY).alias("quantity"), F.col("l_extendedprice").cast(MONEY).alias("value"))


def book_events(e: DataFrame) -> DataFrame:
    """Order-book events: three consecutive events belong to one order."""
    action = F.when(F.col("event_type") == "error", "cancel").when(
        F.col("event_type") == "purchase", "modify").otherwise("add")
    return e.select(
        F.concat(F.lit("B"), F.pmod("user_id", F.lit(4)).cast("string")).alias("symbol"), "ts",
        F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 3).alias("order_id"), action.alias("action"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "bid").otherwise("ask").alias("side"),
        F.round("value", 0).alias("price"), (F.pmod("event_id", F.lit(97)) + 1).cast("long").alias("qty"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_events(table(spark, sf_dir, "events"))


RATE = 0.04


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option chain: parts give strike and expiry per brand, line items give interest.

    Parts with the same contract are added up, so there is one row per
    (symbol, days, strike, option_type). Quotes surround intrinsic value plus a bell-shaped time
    value, equal for call and put, so put-call parity holds.
    """
    lots = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    parts = table(spark, sf_dir, "part").join(lots, "p_partkey", "left").select(
        F.col("p_brand").alias("symbol"), (F.ceil(F.col("p_size") / 10) * 10).cast("int").alias("days_to_expiry"),
        F.col("p_retailprice").alias("strike"), F.coalesce("n", F.lit(0)).alias("n"))
    c = parts.groupBy("symbol", "days_to_expiry", "strike").agg(F.sum("n").alias("n"))
    c = c.withColumn("option_type", F.explode(F.array(F.lit("call"), F.lit("put"))))
    grid = F.floor(F.col("strike") * 10 + 0.5).cast("long")
    c = c.withColumns({
        "spot": F.lit(935.0) + F.regexp_extract("symbol", r"(\d+)$", 1).cast("double"),
        "time_to_maturity": F.col("days_to_expiry") / 365.0,
        "grid": grid,
    })
    c = c.withColumn("true_vol", F.floor((
        0.2 + 0.5 * F.abs(F.ln(F.col("strike") / F.col("spot"))) + 0.05 * F.sqrt("time_to_maturity")
        + F.pmod("grid", F.lit(7)) / 200.0) * 10000 + 0.5) / 10000.0)
    pv = F.col("strike") * F.exp(-F.lit(RATE) * F.col("time_to_maturity"))
    side = F.when(F.col("option_type") == "call", 1.0).otherwise(-1.0)
    width = F.col("true_vol") * F.col("true_vol") * F.col("time_to_maturity")
    fair = F.greatest(side * (F.col("spot") - pv), F.lit(0.0)) + 0.4 * F.col("spot") * F.sqrt(width) * F.exp(
        -F.pow(F.ln(F.col("strike") / F.col("spot")), 2) / (2 * width))
    half = F.when(F.pmod("grid", F.lit(29)) == 0, 0.4).when(F.pmod("grid", F.lit(5)) == 0, 0.08).otherwise(0.02)
    c = c.withColumns({"_fair": fair, "_half": half})
    return fence(c).select(
        "symbol", F.lit("2024-01-31").cast("date").alias("snapshot_date"), "days_to_expiry",
        F.date_add(F.lit("2024-01-31").cast("date"), F.col("days_to_expiry")).alias("expiry"),
        "strike", "option_type", "spot", "time_to_maturity",
        cents(F.col("_fair") * (1 - F.col("_half"))).alias("bid"), cents(F.col("_fair") * (1 + F.col("_half"))).alias("ask"),
        (F.col("n") * 3).cast("long").alias("volume"),
        F.when(F.pmod("grid", F.lit(31)) != 0, F.col("n") * F.when(F.col("option_type") == "call", 10).otherwise(7)).cast("long").alias("open_interest"),
        F.when(F.pmod("grid", F.lit(11)) == 0, 0.125).otherwise(F.col("true_vol")).alias("quoted_vol"), "true_vol")
