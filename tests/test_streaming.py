"""Keyed state, suppressed alerts, orders against running exposure, and batches that are killed and replayed."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.plans.live import stream_news_feed
from tickloom.streaming import jobs, state
from tickloom.streaming.store import TableStore, exactly_once

FILL = "symbol string, seq bigint, side string, quantity double, value double"


def loop_positions(fills):
    """Positions by the plain rule, fill by fill."""
    held, path = {}, []
    for sym, seq, side, q, v in sorted(fills, key=lambda r: r[1]):
        s = 1 if side == "BUY" else -1
        quantity, value, n = held.get(sym, (0, 0, 0))
        quantity, value, n = quantity + s * q, value + s * v, n + 1
        if quantity == 0:
            held.pop(sym, None)
            path.append((sym, seq, 0.0))
        else:
            held[sym] = (quantity, value, n)
            path.append((sym, seq, abs(value)))
    return held, path


def some_fills(n=400, seed=3):
    rng = np.random.default_rng(seed)
    return [(f"S{rng.integers(0, 6)}", i, "BUY" if rng.random() < 0.5 else "SELL", float(rng.integers(1, 4)), float(rng.integers(100, 400)) / 4) for i in range(n)]


def landed(spark, rows, schema, folder, parts, key="seq"):
    """Rows in files that are read one per batch, in order."""
    per = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * per:(i + 1) * per], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return jobs.file_stream(spark, folder, "*.parquet", schema=spark.createDataFrame([], schema).schema, per_batch=1)


def test_stream_of_a_table_that_is_a_folder_of_files(spark, tmp_path):
    for part in ((0, 25), (25, 50)):
        spark.range(*part).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.range(5).selectExpr("cast(id AS int) AS r_regionkey").coalesce(1).write.parquet(f"{tmp_path}/region.parquet")
    got = [tuple(r) for r in stream_news_feed(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(i, "AN"[i % 3]) for i in range(50) if i % 5 and i % 3 < 2]
    only_one = jobs.file_stream(spark, str(tmp_path), "region.parquet", per_batch=1)
    assert jobs.drain(only_one, "append").count() == 5


def test_stream_without_files_gives_no_rows(spark, tmp_path):
    got = jobs.drain(jobs.file_stream(spark, str(tmp_path), "*.parquet", schema="a int, b string"), "append")
    assert got.columns == ["a", "b"] and got.count() == 0


def test_running_position_equals_loop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        dq, dv, q, v = rng.integers(-2, 3, n), rng.integers(-9, 10, n), int(rng.integers(-2, 3)), int(rng.integers(-9, 9))
        v = v if q else 0
        want, since = [], 0
        a, b = q, v
        for x, y in zip(dq, dv):
            a, b, since = a + x, b + y, since + 1
            if a == 0:
                b, since = 0, 0
            want.append((a, b, since))
        assert [tuple(map(int, t)) for t in zip(*state.running_position(dq, dv, q, v))] == [tuple(map(int, w)) for w in want]


def test_positions_over_batches_and_after_a_killed_batch(spark, tmp_path):
    fills = some_fills()
    held, _ = loop_positions(fills)
    stream = landed(spark, fills, FILL, str(tmp_path / "in"), 5)
    store, killed = TableStore(spark, str(tmp_path / "store")), []

    def body(batch, epoch):
        if epoch == 2 and not killed:
            killed.append(epoch)
            raise RuntimeError("killed")
        return store.commit(epoch, {"positions": batch.withColumn("epoch", F.lit(epoch))})

    run = lambda: stream_states(stream, str(tmp_path / "state"), body)
    with pytest.raises(Exception, match="killed"):
        run()
    assert store.epochs() == [0, 1]
    run()
    last = jobs.keep_one(store.read("positions"), ["symbol"], ["epoch"], last=True)
    got = {r["symbol"]: (r["quantity"], r["avg_price"], r["fills"]) for r in state.open_positions(last).collect()}
    assert killed and set(got) == set(held)
    for sym, (q, v, n) in held.items():
        assert got[sym] == (q, pytest.approx(v / q), n)


def stream_states(stream, where, body):
    jobs.run_batches(state.position_states(stream), where, body, "update")


def alerts(stream, where, sink, limit, remind_ms):
    def body(batch, epoch):
        sink.extend((r["symbol"], r["seq"], r["exposure"], r["kind"]) for r in batch.collect())

    jobs.run_batches(state.limit_alerts(stream, limit, remind_ms), where, body, "update")


def test_alert_once_per_breach_and_again_after_recovery(spark, tmp_path):
    rows = [("A", 0, "BUY", 1.0, 50.0), ("A", 1, "BUY", 1.0, 60.0),  # breach at 110
            ("A", 2, "BUY", 1.0, 5.0), ("A", 3, "BUY", 1.0, 5.0),  # repeats are silent, also in the next batch
            ("A", 4, "SELL", 2.0, 80.0), ("A", 5, "BUY", 1.0, 200.0),  # recovery at 40, new breach
            ("A", 6, "SELL", 3.0, 240.0), ("B", 7, "BUY", 1.0, 90.0)]  # flat: position and breach are gone
    got = []
    alerts(landed(spark, rows, FILL, str(tmp_path / "in"), 4), str(tmp_path / "state"), got, 100.0, 10 ** 9)
    assert got == [("A", 1, 110.0, "breach"), ("A", 5, 240.0, "breach")]


def test_alerts_equal_loop(spark, tmp_path):
    fills = some_fills(300, 8)
    want, over = [], {}
    for sym, seq, exposure in loop_positions(fills)[1]:
        if exposure > 150 and not over.get(sym):
            want.append((sym, seq, exposure, "breach"))
        over[sym] = exposure > 150
    got = []
    alerts(landed(spark, fills, FILL, str(tmp_path / "in"), 3), str(tmp_path / "state"), got, 150.0, 10 ** 9)
    assert sorted(got) == sorted(want) and len(want) > 5


def test_open_breach_is_repeated_after_its_time(spark, tmp_path):
    folder, got = str(tmp_path / "in"), []
    stream = landed(spark, [("A", 0, "BUY", 1.0, 500.0), ("C", 0, "BUY", 1.0, 500.0)], FILL, folder, 1)
    alerts(stream, str(tmp_path / "state"), got, 100.0, 500)
    assert sorted(got) == [("A", 0, 500.0, "breach"), ("C", 0, 500.0, "breach")]
    time.sleep(0.7)
    landed(spark, [("C", 1, "SELL", 1.0, 500.0), ("B", 1, "BUY", 1.0, 1.0)], FILL, folder, 1)
    alerts(stream, str(tmp_path / "state"), got, 100.0, 500)
    assert got[2:] == [("A", 0, 500.0, "still open")]


def test_admission_equals_loop():
    rng = np.random.default_rng(9)
    for _ in range(300):
        value, start, most = rng.integers(0, 60, int(rng.integers(0, 15))), int(rng.integers(0, 80)), int(rng.integers(50, 200))
        spent, want = start, []
        for v in value:
            want.append(1 if v > 50 else 2 if spent + v > most else 0)
            spent += v if want[-1] == 0 else 0
        assert state.admit(value, start, 50, most).tolist() == want


def test_order_decisions_over_batches_equal_one_run(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 3)), i, float(rng.integers(1, 4000)) / 100) for i in range(200)]
    held = spark.createDataFrame([(0, 100.0), (1, 20.0)], "book int, exposure double")
    schema, want = "book int, seq bigint, value double", {}
    spent = {0: 100.0, 1: 20.0, 2: 0.0}
    for book, seq, v in rows:
        want[seq] = "order value limit" if v > 35 else "exposure limit" if round(spent[book] + v, 2) > 600 else "approved"
        spent[book] += v if want[seq] == "approved" else 0
    store, reads = TableStore(spark, str(tmp_path / "s")), []
    body = jobs.order_decisions(store, lambda: reads.append(1) or held, 35.0, 600.0)
    jobs.run_batches(landed(spark, rows, schema, str(tmp_path / "in"), 4), str(tmp_path / "state"), body)
    got = {r["seq"]: r["reason"] for r in store.read("decisions").collect()}
    assert got == want and len(reads) == 4 and set(want.values()) == set(state.REASONS)


# ---- killed at each write -------------------------------------------------------------------

ROW = "symbol string, date int, v double"


def broken(df):
    return df.withColumn("v", F.expr("if(v >= 0, raise_error('killed'), v)").cast("double"))


@pytest.mark.parametrize("at", ["first table", "second table", "manifest", "after publication"])
def test_batch_killed_at_each_write_is_taken_once(spark, tmp_path, at, monkeypatch):
    store, state_dir, hits = TableStore(spark, str(tmp_path / "store")), str(tmp_path / "state"), []
    rows = [("X", i, float(i)) for i in range(12)]
    stream = landed(spark, rows, ROW, str(tmp_path / "in"), 3, "date")

    def body(batch, epoch):
        die = epoch == 1 and not hits
        if die:
            hits.append(at)
        bars, features = batch, batch.withColumn("v", F.col("v") * 2)
        if die and at == "manifest":
            monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        done = exactly_once(store, lambda b, e: {"bars": broken(bars) if die and at == "first table" else bars, "features": broken(features) if die and at == "second table" else features})(batch, epoch)
        if die and at == "after publication":
            raise OSError("killed")
        return done

    with pytest.raises(Exception, match="killed"):
        jobs.run_batches(stream, state_dir, body)
    monkeypatch.undo()
    seen = 2 if at == "after publication" else 1
    assert store.epochs() == list(range(seen)) and store.read("bars").count() == store.read("features").count() == 4 * seen
    before = sorted(store.read("bars").inputFiles())
    jobs.run_batches(stream, state_dir, body)
    assert store.epochs() == [0, 1, 2] and set(before) <= set(store.read("bars").inputFiles())
    for table, k in (("bars", 1), ("features", 2)):
        assert sorted(tuple(r) for r in store.read(table).collect()) == [("X", i, float(i * k)) for i in range(12)]
    assert store.vacuum() == {"first table": 1, "second table": 2, "manifest": 2, "after publication": 0}[at]
    store.compact()
    assert store.epochs() == [2] and store.read("bars").count() == 12 and store.is_published(0)
    assert not store.commit(1, {"bars": store.read("bars"), "features": store.read("features")})
    assert store.vacuum() == 6 and store.read("features").count() == 12


def test_prediction_log_over_batches_equals_one_run(spark, tmp_path):
    """Rows of later batches win; actual returns come in when their bars do; a replay changes nothing."""
    sch = "symbol string, date date, pred_1d double, pred_5d double, made_at int"
    day = lambda n: __import__("datetime").date(2024, 1, 1) + __import__("datetime").timedelta(days=n)
    rows = [("X", day(i % 20), i / 100, -i / 100, i) for i in range(60)]
    bars = spark.createDataFrame([("X", day(i), (i * i % 7) / 100) for i in range(30)], "symbol string, date date, log_return double")
    store, one = TableStore(spark, str(tmp_path / "s")), TableStore(spark, str(tmp_path / "one"))
    jobs.run_batches(landed(spark, rows, sch, str(tmp_path / "in"), 4, "made_at"), str(tmp_path / "state"), lambda b, e: jobs.upsert_predictions(b, store, e, bars))
    jobs.upsert_predictions(spark.createDataFrame(rows, sch), one, 0, bars)
    got, want = (sorted(tuple(r) for r in s.read("log").select("symbol", "date", "pred_1d", "pred_5d", "actual_1d", "actual_5d").collect()) for s in (store, one))
    assert got == want and len(got) == 20 and store.epochs() == [3]
    assert not jobs.upsert_predictions(spark.createDataFrame(rows[:5], sch), store, 3, bars)
