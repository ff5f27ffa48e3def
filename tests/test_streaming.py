"""Streams give what the batch operators give."""

import datetime as dt
import json
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.dc import dc_events
from tickloom.operators.windows import momentum, rolling_regime, trend_bias
from tickloom.operators.timeline import Timeline
from tickloom.streaming import io
from tickloom.streaming.detector import dc_stream
from tickloom.streaming.rolling import RollingProcessor, rolling_stream

T0 = dt.datetime(2024, 1, 1)


def messages(n=400, seed=1):
    rng = np.random.default_rng(seed)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return [
        {"symbol": "AB"[i % 2], "price": round(float(p), 6), "timestamp": (T0 + dt.timedelta(seconds=i)).isoformat() + "Z"}
        for i, p in enumerate(px)
    ]


def write_files(folder, rows, per_file=100):
    folder.mkdir()
    for k in range(0, len(rows), per_file):
        (folder / f"m{k:05d}.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows[k : k + per_file]))


def run(stream, name, mode="update"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


EVENT = ["symbol", "start_time", "end_time", "start_price", "end_price", "event_type", "threshold_down", "max_osv"]


def batch_events(spark, rows, thetas):
    df = spark.createDataFrame(
        [(r["symbol"], dt.datetime.fromisoformat(r["timestamp"][:-1]), r["price"]) for r in rows],
        "symbol string, ts timestamp_ntz, price double",
    )
    return sorted(tuple(r) for r in dc_events(df, thetas).select(*EVENT).collect())


def test_stream_equals_batch_with_dead_letters(spark, tmp_path):
    rows = messages()
    write_files(tmp_path / "in", [*rows[:150], "{broken", '{"symbol": "A", "price": "x"}', *rows[150:]])
    raw = io.read_tick_stream(spark, path=str(tmp_path / "in"), max_files=1)
    listener = io.MetricsListener()
    spark.streams.addListener(listener)
    parsed = io.counted_ticks(raw)
    out = run(dc_stream(parsed.where("error is null"), [0.02, 0.05]), "live_events")
    got = sorted(tuple(r) for r in out.where("kind = 'event'").select(*EVENT).collect())
    assert got == batch_events(spark, rows, [0.02, 0.05]) and len(got) > 20
    sink = io.write_events(io.counted_ticks(raw), str(tmp_path / "ok"), str(tmp_path / "cp"), str(tmp_path / "dead"))
    sink.awaitTermination()
    spark.streams.removeListener(listener)
    assert spark.read.text(str(tmp_path / "dead") + "/*").count() == 2
    assert spark.read.text(str(tmp_path / "ok") + "/*").count() == len(rows)


def test_watermark_puts_ticks_in_order_and_reports_late_ones(spark, tmp_path):
    rows = messages(300, seed=4)
    shuffled = [rows[i ^ 1] for i in range(300)]  # neighbours swapped
    far = [{"symbol": s, "price": 1.0, "timestamp": "2024-02-01T00:00:00Z"} for s in "AB"]
    late = [{"symbol": "A", "price": 55.0, "timestamp": "2024-01-01T00:00:01Z"}]
    write_files(tmp_path / "in", [*shuffled, *far], 100)
    (tmp_path / "in" / "z1.json").write_text("\n".join(json.dumps(r) for r in far))
    (tmp_path / "in" / "z2.json").write_text("\n".join(json.dumps(r) for r in late))
    raw = io.read_tick_stream(spark, path=str(tmp_path / "in"), max_files=1)
    ticks = io.counted_ticks(raw).where("error is null")
    out = run(dc_stream(ticks, [0.02], watermark="10 seconds"), "ordered_events")
    got = sorted(tuple(r) for r in out.where("kind = 'event'").select(*EVENT).collect())
    assert got == batch_events(spark, rows, [0.02]) and len(got) > 20
    assert [r.end_price for r in out.where("kind = 'late'").collect()] == [55.0]


def test_other_symbols_move_the_clock_and_idle_symbols_are_forgotten(spark, tmp_path):
    """The last ticks of a silent symbol come out; after a silence longer than ``idle`` it starts anew."""
    at = lambda s: (T0 + dt.timedelta(seconds=s)).isoformat() + "Z"
    first = [{"symbol": "A", "price": p, "timestamp": at(i)} for i, p in enumerate([100, 101, 99, 97, 96])]
    clock = lambda *seconds: [{"symbol": "~", "price": 1.0, "timestamp": at(s)} for s in seconds]
    again = [{"symbol": "A", "price": p, "timestamp": at(5000 + i)} for i, p in enumerate([100, 101, 90])]
    write_files(tmp_path / "in", [*first, *clock(100), *clock(101), *clock(4000), *clock(4001), *clock(4002), *again, *clock(9000), *clock(9001)], 1)
    ticks = io.counted_ticks(io.read_tick_stream(spark, path=str(tmp_path / "in"), max_files=1)).where("error is null")
    for name, idle, ups in (("remembered", None, 1), ("forgotten", "1000 seconds", 0)):
        out = run(dc_stream(ticks, [0.02], watermark="10 seconds", idle=idle), name).where("kind = 'event'").collect()
        downs = [r.end_price for r in out if r.event_type == "PDCC_Down"]
        assert downs == [97.0, 90.0]
        assert sum(r.event_type == "PDCC2_UP" for r in out) == ups


def test_sources_exclude_each_other(spark):
    with pytest.raises(ValueError):
        io.read_tick_stream(spark, topic="a", subscription="b")


def test_telemetry_ingest_is_exactly_once(spark, tmp_path):
    lines = [
        {"event_type": "tick", "timestamp": 1704067200.0, "session_id": "s", "symbol": "A", "payload": {"price": i}}
        for i in range(5)
    ] + [{"event_type": "trade_exit", "timestamp": 1.0, "session_id": "s", "symbol": "A", "payload": {"trade_id": "t", "exit_price": 2.5, "extra": 1}}]
    write_files(tmp_path / "in", lines + ["{bad"], 3)
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    for _ in range(2):
        io.ingest_telemetry(*args).awaitTermination()
    count = lambda t: spark.read.parquet(str(tmp_path / "out" / t) + "/*").count()
    assert (count("ticks"), count("trades"), count("misc")) == (5, 1, 1)
    assert spark.read.parquet(str(tmp_path / "out" / "trades") + "/*").first().exit_price == 2.5


def test_rolling_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [
        ("S", T0 + dt.timedelta(seconds=int(20 * i)), 100.0, 100.0 + float(rng.normal()), ["PDCC_Down", "PDCC2_UP"][int(rng.integers(2))])
        for i in range(120)
    ]
    kind = "symbol string, end_time timestamp_ntz, start_price double, end_price double, event_type string"
    df = spark.createDataFrame(rows, kind)
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).json(str(tmp_path / "in"))
    live = run(rolling_stream(stream), "rolling_states").orderBy("us").collect()
    base = df.select(
        "symbol", F.col("end_time").alias("ts"),
        F.when(F.col("event_type") == "PDCC2_UP", 1).otherwise(-1).alias("direction"),
        (F.abs(F.col("end_price") - 100) / 100).alias("tmv"),
    )
    tl = Timeline.of("symbol", "ts", (), "15 minutes")
    regime = [r.regime for r in rolling_regime(base, tl).orderBy("ts").collect()]
    score = [r.momentum for r in momentum(base, tl).orderBy("ts").collect()]
    trend = trend_bias(base, tl).orderBy("ts").collect()
    assert [r.regime for r in live] == regime and len(set(regime)) > 1
    assert [r.momentum for r in live] == pytest.approx(score, abs=1e-9)
    assert [r.trend for r in live] == [r.trend for r in trend]
    assert [r.bias for r in live] == pytest.approx([r.bias for r in trend])


def test_rolling_states_of_a_key_in_several_arrow_batches_with_events_at_one_time():
    """Batches of a key are in no order among themselves; an event sees the others of its time."""
    def states(*batches):
        proc = RollingProcessor(600, 900, 0.3, 0.6, 4.0, 0.6, 2)
        proc.recent = proc.score = types.SimpleNamespace(exists=lambda: False, update=lambda v: None)
        return pd.concat(list(proc.handleInputRows(("A",), iter(batches), None))).reset_index(drop=True)

    rng = np.random.default_rng(3)
    us = (np.arange(200) // 2) * 30_000_000
    rows = pd.DataFrame({"us": us, "seq": np.arange(200), "direction": rng.choice([-1, 1], 200), "tmv": rng.random(200)})
    mixed = rows.sample(frac=1, random_state=1)
    whole = states(rows)
    pd.testing.assert_frame_equal(states(mixed[:70], mixed[70:71], mixed[71:]), whole)
    at = 120
    inside = rows[(rows.us >= us[at] - 900_000_000) & (rows.us <= us[at])]
    assert whole.bias[at] == pytest.approx((inside.direction * inside.tmv).sum() / inside.tmv.sum(), abs=1e-12)
