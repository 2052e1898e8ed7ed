"""Structured Streaming jobs: news, bars, positions, limits, book, increments.

State is bounded by watermarks or by the number of keys. What a batch writes goes through a
``TableStore``, which takes every batch exactly once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import orderbook
from tickloom.operators.learning import backfill_actuals
from tickloom.operators.matrix import last_dates, merge_increment, newer_rows
from tickloom.operators.sets import keep_one, replace_rows
from tickloom.session import shared_dir
from tickloom.sources.feeds import stream_news
from tickloom.streaming.state import decide_orders
from tickloom.streaming.store import TableStore


def file_stream(spark: SparkSession, folder: str, name: str, schema=None, fmt: str = "parquet", per_batch: int | None = None) -> DataFrame:
    """Stream over landed files matching ``name``, or over all files of the table folder ``name``; the schema comes from the files when not given."""
    at = f"{folder.rstrip('/')}/{name}"
    schema = schema or spark.read.format(fmt).load(at).schema
    r = spark.readStream.schema(schema).format(fmt)
    r = r.option("maxFilesPerTrigger", per_batch) if per_batch else r
    return r.load(at) if _is_folder(spark, at) else r.option("pathGlobFilter", name).load(folder)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


@contextmanager
def data_batches_only(spark: SparkSession):
    """Queries started inside end when their data do; else processing-time timers keep a bounded run going for ever."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_batches(stream: DataFrame, state: str, body: Callable[[DataFrame, int], object], mode: str = "append") -> None:
    """Run ``body`` on everything available, batch by batch; the place in the stream is kept under ``state``."""
    with data_batches_only(stream.sparkSession):
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, epoch: body(batch, epoch) and None)
        q = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def drain(stream: DataFrame, mode: str, out: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    In update mode the last written row per ``keep`` key is the current state. A stream without any file gives no rows.
    """
    spark = stream.sparkSession
    out = out or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")

    run_batches(stream, f"{out}/state", write, mode)
    if not _is_folder(spark, f"{out}/data"):
        return spark.createDataFrame([], stream.schema)
    got = spark.read.schema(f"{_ddl(stream)}, epoch bigint").parquet(f"{out}/data")
    return keep_one(got, list(keep), ["epoch"], last=True).drop("epoch") if keep else got.drop("epoch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


# ---- news -----------------------------------------------------------------------------------

def news_feed(bodies: DataFrame, watch: DataFrame | None = None, late: str = "1 day", keys: Sequence[str] = ("article_id",)) -> DataFrame:
    """Normalised messages, once per key within the watermark, optionally only watched symbols.

    ``watch(symbol)`` is a subscription list; its size is checked by Spark's broadcast threshold.
    """
    n = stream_news(bodies).withWatermark("created_at", late).dropDuplicatesWithinWatermark(list(keys))
    if watch is None:
        return n
    return n.withColumn("symbol", F.explode("symbols")).join(watch, "symbol", "left_semi")


# ---- bars -----------------------------------------------------------------------------------

def tick_bars(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars from (symbol, ts, event_id, price); later ticks than the watermark are dropped."""
    order = F.struct("ts", "event_id")
    t = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return t.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def build_increment(batch_bars: DataFrame, store: TableStore, features: Callable[[DataFrame], DataFrame], warmup: int = 400, epoch: int = 0) -> bool:
    """foreachBatch body of the daily build: recompute from warm-up rows, keep only newer rows.

    ``store`` takes ``bars`` and ``features`` of an epoch together, once: a batch that failed half-way is
    invisible, and a batch that had been published before changes nothing (False). A read error ends the
    batch. Symbols with nothing newer are left alone.
    """
    if store.is_published(epoch):
        return False
    old, feats = (store.read(t, before=epoch) for t in ("bars", "features"))
    if old is not None:
        last = last_dates(feats)
        new = newer_rows(batch_bars, last)
        touched = new.groupBy("symbol").agg(F.min("date").alias("_from"))
        back = old.join(touched, "symbol").where(F.col("date") >= F.date_sub("_from", warmup)).drop("_from")
        fresh = newer_rows(features(merge_increment(back, new, ["symbol", "date"])), last)
    else:
        new, fresh = batch_bars, features(batch_bars)
    return store.commit(epoch, {"bars": new, "features": fresh})


# ---- positions and limits -------------------------------------------------------------------

def position_totals(fills: DataFrame) -> DataFrame:
    """Running signed quantity and value per symbol; sums do not depend on arrival order."""
    sign = F.when(F.col("side") == "BUY", F.lit(1)).otherwise(F.lit(-1))
    return fills.groupBy("symbol").agg(F.sum(sign * F.col("quantity")).alias("quantity"), F.sum("quantity").alias("traded"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("fills"))


def positions_now(totals: DataFrame) -> DataFrame:
    """Open positions with their volume-weighted price; flat ones are gone."""
    return totals.where("quantity <> 0").withColumn("avg_price", (F.col("value") / F.col("traded")).cast("decimal(38,10)"))


def breach_alerts(positions: DataFrame, max_value: float) -> DataFrame:
    """Positions above a value limit; ``state.limit_alerts`` is the form that tells each breach once."""
    return positions.withColumn("exposure", F.abs(F.col("quantity") * F.col("avg_price")).cast("double")).where(F.col("exposure") > max_value)


def order_decisions(store: TableStore, held: Callable[[], DataFrame], max_order: float, max_exposure: float) -> Callable[[DataFrame, int], bool]:
    """foreachBatch body of the pre-trade check: one decision per order, each batch decided once.

    A batch starts from ``held()`` (book, exposure), which is read anew for it, plus what earlier batches have
    approved; inside the batch the exposure runs on in ``seq`` order.
    """

    def body(orders: DataFrame, epoch: int) -> bool:
        if store.is_published(epoch):
            return False
        start, past = held().select("book", "exposure"), store.read("decisions", before=epoch)
        if past is not None:
            start = start.unionByName(past.where("reason = 'approved'").select("book", (F.col("value_cents") / 100).alias("exposure")))
        start = start.groupBy("book").agg(F.sum("exposure").alias("exposure"))
        return store.commit(epoch, {"decisions": decide_orders(orders, start, max_order, max_exposure)})

    return body


def book_orders(events: DataFrame) -> DataFrame:
    return orderbook.latest_orders(events)


# ---- predictions ----------------------------------------------------------------------------

def upsert_predictions(batch: DataFrame, store: TableStore, epoch: int, bars: DataFrame | None = None) -> bool:
    """foreachBatch body of the prediction log: newest row per (symbol, date) wins, realised returns are filled in.

    The log of an epoch is a whole table that replaces the one before; an epoch is taken once.
    """
    if store.is_published(epoch):
        return False
    one = keep_one(batch, ["symbol", "date"], ["made_at"], last=True).drop("made_at")
    old = store.read("log", before=epoch)
    if old is not None:
        one = replace_rows(old.select(*one.columns), one, ["symbol", "date"])
    return store.commit(epoch, {"log": one if bars is None else backfill_actuals(one, bars)}, replaces=True)
