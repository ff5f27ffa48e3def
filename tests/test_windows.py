"""Rolling states on the sensor and funding series, splits and windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import trades as T
from tickloom.operators import windows as W
from tickloom.operators.joins import asof_backward
from tickloom.operators.timeline import Timeline

T0 = dt.datetime(2024, 1, 1)
TL = Timeline.of("symbol", "ts", "id", "10 minutes")


def sensors(spark, directions, step=30.0, tmv=0.01):
    rows = [("S", T0 + dt.timedelta(seconds=step * i), i, d, tmv * (1 + i % 3)) for i, d in enumerate(directions)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, direction int, tmv double")


def regimes(spark, directions, step=30.0, **kw):
    return [r.regime for r in W.rolling_regime(sensors(spark, directions, step), TL, **kw).orderBy("id").collect()]


def test_regimes(spark):
    assert regimes(spark, [1, -1]) == ["quiet", "quiet"]
    assert regimes(spark, [1, -1, 1, -1, 1], step=10) == ["quiet"] * 5
    assert regimes(spark, [1, -1] * 30, step=5)[-1] == "choppy"
    assert regimes(spark, [1] * 12)[-1] == "trending"
    assert regimes(spark, [1, -1] * 6)[-1] == "neutral"
    assert regimes(spark, [1, -1] * 60, step=5, inclusive=False, consistency=0.4)[-1] == "choppy"


def test_trend_gate(spark):
    up = W.trend_bias(sensors(spark, [1] * 6), TL).orderBy("id").collect()
    assert up[3].trend is None and up[5].trend == "up" and up[5].bias == 1
    assert up[5].short_size_factor == 0 and up[5].long_size_factor == 1
    simple = W.trend_bias(sensors(spark, [1, 1, 1, 1, -1]), TL, mode="simple", action="reduce").orderBy("id").collect()
    assert simple[4].bias == pytest.approx(0.6) and simple[4].trend == "up" and simple[4].short_size_factor == 1


def test_momentum_is_the_recursive_average(spark):
    dirs = [1, 1, -1, 1, -1, -1, 1] * 30
    rows = W.momentum(sensors(spark, dirs, step=7), TL, history=50).orderBy("id").collect()
    score = 0.0
    for r, d in zip(rows, dirs):
        score = 0.3 * d + 0.7 * score
        assert r.momentum == pytest.approx(score, abs=1e-9)
    assert rows[-1].momentum_rate == pytest.approx(43 / 5)


def test_adaptive_tp(spark):
    rows = [("S", T0 + dt.timedelta(seconds=i), i, float(v)) for i, v in enumerate([0.01, 0.02, -1, 0.03, 0.04, 0.05, 0.001])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, overshoot double")
    out = [r.adaptive_tp for r in W.adaptive_tp(df, TL).orderBy("id").collect()]
    assert out == pytest.approx([0.005, 0.005, 0.005, 0.005, 0.03 * 0.4, 0.025 * 0.4])


def test_loss_streak(spark):
    rows = [("S", T0 + dt.timedelta(hours=i), i, float(v)) for i, v in enumerate([-1.0, -1, -1, -1, 2, -1])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, net_pnl_usd double")
    out = W.loss_streak(df, TL).orderBy("id").collect()
    assert [r.consecutive_losses for r in out] == [1, 2, 3, 4, 0, 1]
    assert out[3].cooldown_until == T0 + dt.timedelta(hours=3, seconds=1200) and out[1].cooldown_until is None


def funding(spark, rates):
    rows = [("S", T0 + dt.timedelta(hours=i), i, float(r), 100.0, 100.0) for i, r in enumerate(rates)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, rate double, mark_price double, oracle_price double")


def test_funding_streaks(spark):
    last = lambda rates: W.funding_streaks(funding(spark, rates), TL, 0.0001, -0.0001, notional=50).orderBy(F.desc("id")).first()
    assert last([0.0002] * 3).consecutive_above == 3
    assert last([0.0002, 0.0003, 0.00005, 0.0002]).consecutive_above == 1
    row = last([-0.0001] * 4)
    assert row.consecutive_below == 4 and row.cumulative_payment == pytest.approx(-0.02)
    assert last([0.0002]).cumulative_payment == pytest.approx(0.01)
    assert last([0.0002]).apr_pct == pytest.approx(0.0002 * 24 * 365 * 100)


def test_basis_trade(spark):
    rates = [0.0002] * 3 + [0.0003] * 2 + [-0.0002] * 4 + [0.0002] * 2
    out = T.basis_pnl(funding(spark, rates), notional_usd=1000.0).collect()
    assert len(out) == 1 and out[0].reason == "funding_negative" and out[0].hold_hours == 6
    assert out[0].funding_payments == 6 and out[0].funding_pnl == pytest.approx(0.6 - 0.8)
    assert out[0].net_pnl == pytest.approx(-0.2 - 1.1)


def test_split_needs_enough_rows(spark):
    df = sensors(spark, [1] * 99)
    with pytest.raises(Exception, match="fewer than 100 rows"):
        W.chrono_split(df, "ts", "symbol", ["id"]).collect()
    parts = W.chrono_split(sensors(spark, [1] * 200), "ts", None, ["id"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"train": 140, "val": 40, "test": 20}


def test_windows_are_full_and_consecutive(spark):
    df = sensors(spark, list(range(40)))
    rows = W.windows(df, TL, ["direction", "tmv"], "direction", L=5, S=3, H=2, stride=4, block_rows=1).orderBy("window_id").collect()
    assert [r.window_id for r in rows] == list(range(0, 31, 4))
    assert [x[0] for x in rows[1].x] == [4, 5, 6, 7, 8] and rows[1].y == [12, 13]
    tf = W.tf_windows(df, TL, ["direction"], "direction", L=5, shift=4, H=1, sparse=True).orderBy("window_id").first()
    assert tf.y == [8] and not hasattr(tf, "x")


def test_asof_ties_take_the_last_right_row(spark):
    left = sensors(spark, [1, 1, 1], step=60)
    right = spark.createDataFrame(
        [("S", T0 + dt.timedelta(seconds=60), 1, "a"), ("S", T0 + dt.timedelta(seconds=60), 2, "b"), ("Q", T0, 1, "z")],
        "symbol string, at timestamp_ntz, seq int, v string",
    )
    out = asof_backward(left, right, "symbol", "ts", "at", ["v"], "id", ["seq"]).orderBy("id").collect()
    assert [r.v for r in out] == [None, "b", "b"]


def test_a_hot_key_is_spread_over_tasks(spark):
    """All rows belong to one symbol; no task may see more than its share of chunks."""
    df = spark.range(20_000).select(
        F.lit("S").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), "id",
        (F.col("id") % 10).cast("double").alias("price"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = W.price_change(df, Timeline.of("symbol", "ts", "id", "6 hours"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 20_000 / 3
