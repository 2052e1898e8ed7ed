"""Keyed state functions: positions per symbol, limit alerts with suppression, orders against running exposure.

State lives in the state store of the stream (RocksDB), one small row per symbol. Rows of a symbol
are taken in ``seq`` order inside a batch; between batches the order of the batches holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Quantities and values are whole hundredths, so sums are exact.
CENTS = 100


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state functions need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def running_position(dq: np.ndarray, dv: np.ndarray, q: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantity and value after each fill, and the fills since the position was last flat.

    A fill adds its signed quantity and signed value; at quantity zero the position is closed and the
    next fill opens a new one, so the value counts from there on.
    """
    quantity, value = q + np.cumsum(dq), v + np.cumsum(dv)
    flat = quantity == 0
    at = np.where(flat, np.arange(len(dq)), -1)
    last = np.maximum.accumulate(np.concatenate([[-1], at[:-1]])) if len(dq) else at  # flat before this fill
    value = value - np.where(last >= 0, value[last], 0)
    since = np.arange(len(dq)) - last
    return quantity, np.where(flat, 0, value), np.where(flat, 0, since)


def _fills(rows: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows of one symbol in this batch by seq, with signed quantity and value in hundredths."""
    part = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable", ignore_index=True)
    sign = np.where(part["side"] == "BUY", 1, -1)
    return part, sign * part["quantity_cents"].to_numpy(np.int64), sign * part["value_cents"].to_numpy(np.int64)


class Positions(StatefulProcessor):
    """One row per symbol and batch: the position after the batch; a flat position leaves no state."""

    SCHEMA = "symbol string, seq bigint, quantity_cents bigint, value_cents bigint, fills bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("position", "quantity bigint, value bigint, fills bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        q, v, n = self.held.get() if self.held.exists() else (0, 0, 0)
        part, dq, dv = _fills(rows)
        quantity, value, since = running_position(dq, dv, q, v)
        never_flat = since[-1] == len(part)
        q, v, n = int(quantity[-1]), int(value[-1]), int(since[-1]) + (n if never_flat else 0)
        if q:
            self.held.update((q, v, n))
        else:
            self.held.clear()
        yield pd.DataFrame({"symbol": [key[0]], "seq": [int(part["seq"].iloc[-1])], "quantity_cents": [q], "value_cents": [v], "fills": [n]})

    def close(self) -> None:
        pass


class LimitAlerts(StatefulProcessor):
    """One alert when the exposure of a symbol rises above its limit, and none until it has recovered.

    ``told`` keeps that the alert was given and has a time to live of ``remind_ms``; a timer set for then
    repeats the alert if the breach is still open, even when no fill arrives.
    """

    SCHEMA = "symbol string, seq bigint, exposure_cents bigint, kind string"

    def __init__(self, limit: float, remind_ms: int):
        self.limit, self.remind_ms = round(limit * CENTS), remind_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("position", "quantity bigint, value bigint, seq bigint")
        self.told = handle.getValueState("told", "at bigint", self.remind_ms)

    def _drop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def _tell(self, now: int) -> None:
        self.told.update((now,))
        self._drop_timers()
        self.handle.registerTimer(now + self.remind_ms)

    def _alerts(self, key, seq, exposure, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [key[0]] * len(seq), "seq": seq, "exposure_cents": exposure, "kind": [kind] * len(seq)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        q, v, seq = self.held.get() if self.held.exists() else (0, 0, -1)
        was_over = bool(q) and abs(v) > self.limit
        part, dq, dv = _fills(rows)
        quantity, value, _ = running_position(dq, dv, q, v)
        exposure = np.abs(value)
        over = exposure > self.limit
        rises = over & ~np.concatenate([[was_over], over[:-1]])
        now = timerValues.getCurrentProcessingTimeInMs()
        q, v = int(quantity[-1]), int(value[-1])
        if q:
            self.held.update((q, v, int(part["seq"].iloc[-1])))
        else:
            self.held.clear()
        if not over[-1]:  # recovered
            self.told.clear()
            self._drop_timers()
        elif rises.any():
            self._tell(now)
        if rises.any():
            yield self._alerts(key, part["seq"].to_numpy(np.int64)[rises], exposure[rises], "breach")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        q, v, seq = self.held.get() if self.held.exists() else (0, 0, -1)
        still = bool(q) and abs(v) > self.limit
        if still:
            self._tell(timerValues.getCurrentProcessingTimeInMs())
            yield self._alerts(key, [seq], [abs(v)], "still open")

    def close(self) -> None:
        pass


def with_cents(fills: DataFrame) -> DataFrame:
    """symbol, seq, side and whole hundredths of quantity and value."""
    cents = lambda c: F.round(F.col(c) * CENTS).cast("long").alias(f"{c}_cents")
    return fills.select("symbol", "seq", "side", cents("quantity"), cents("value"))


def position_states(fills: DataFrame) -> DataFrame:
    """Stream of (symbol, seq, quantity_cents, value_cents, fills): the last row per symbol is its position, zero when closed."""
    use_rocksdb(fills.sparkSession)
    return with_cents(fills).groupBy("symbol").transformWithStateInPandas(Positions(), Positions.SCHEMA, "Update", "None")


def open_positions(states: DataFrame) -> DataFrame:
    """Open positions with their volume-weighted price, from the last state row of each symbol."""
    rows = states.where("quantity_cents <> 0")
    return rows.select("symbol", (F.col("quantity_cents") / CENTS).alias("quantity"), (F.col("value_cents") / F.col("quantity_cents")).alias("avg_price"), "fills")


def limit_alerts(fills: DataFrame, limit: float, remind_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Stream of alerts (symbol, seq, exposure, kind): one per rise above the limit, and reminders while it lasts."""
    use_rocksdb(fills.sparkSession)
    out = with_cents(fills).groupBy("symbol").transformWithStateInPandas(LimitAlerts(limit, remind_ms), LimitAlerts.SCHEMA, "Update", "ProcessingTime")
    return out.select("symbol", "seq", (F.col("exposure_cents") / CENTS).alias("exposure"), "kind")


# ---- orders against running exposure --------------------------------------------------------

#: Reasons of a decision.
REASONS = ("approved", "order value limit", "exposure limit")


def admit(value: np.ndarray, exposure: int, max_order: int, max_exposure: int) -> np.ndarray:
    """Place in REASONS for each order in turn; an approved order adds its value to the exposure of the next.

    Between two refusals the exposure is a running sum, so each step finds the next refusal by binary
    search; an order that does not fit is passed over.
    """
    out = np.where(value > max_order, 1, 0)
    able = np.flatnonzero(out == 0)
    total = np.cumsum(value[able])
    lo, spent = 0, exposure
    while lo < len(able):
        before = total[lo - 1] if lo else 0
        stop = int(np.searchsorted(total, max_exposure - spent + before, "right"))
        stop = max(stop, lo)
        if stop >= len(able):
            break
        spent += int(total[stop - 1] - before) if stop > lo else 0
        out[able[stop]] = 2
        room = max_exposure - spent
        later = np.flatnonzero(value[able[stop + 1:]] <= room)
        nxt = stop + 1 + int(later[0]) if len(later) else len(able)
        out[able[stop + 1:nxt]] = 2
        lo = nxt
    return out


def decide_orders(orders: DataFrame, exposure: DataFrame, max_order: float, max_exposure: float) -> DataFrame:
    """A decision per order (book, seq, value): order_value, exposure before it, reason.

    Orders of a book are taken by seq; the book starts at its row of ``exposure`` (book, exposure), 0
    without one. Amounts are whole hundredths.
    """
    limits = round(max_order * CENTS), round(max_exposure * CENTS)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq", kind="stable", ignore_index=True)
        value, start = part["value_cents"].to_numpy(np.int64), int(part["start_cents"].iloc[0])
        reason = admit(value, start, *limits)
        taken = np.cumsum(np.where(reason == 0, value, 0))
        return pd.DataFrame({"book": part["book"], "seq": part["seq"], "value_cents": value, "before_cents": start + np.concatenate([[0], taken[:-1]]), "reason": np.array(REASONS, object)[reason]})

    cents = lambda c: F.round(F.col(c) * CENTS).cast("long")
    start = exposure.select("book", cents("exposure").alias("start_cents"))
    rows = orders.select("book", "seq", cents("value").alias("value_cents")).join(start, "book", "left").fillna({"start_cents": 0})
    kinds = dict(rows.dtypes)
    return rows.groupBy("book").applyInPandas(run, f"book {kinds['book']}, seq {kinds['seq']}, value_cents long, before_cents long, reason string")
