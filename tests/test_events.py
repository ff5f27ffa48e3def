"""Events, their invariance to cutting, and the features on them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import dc

T0 = dt.datetime(2024, 1, 1)


def ticks(spark, prices, step=60, symbol="A"):
    rows = [(symbol, T0 + dt.timedelta(seconds=step * i), i, float(p)) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, price double")


@pytest.mark.parametrize("span", [None, "1 minute", "1 day"])
def test_five_prices(spark, span):
    rows = dc.dc_events(ticks(spark, [100, 102, 95, 94, 100]), [0.05], order="id", span=span).collect()
    minute = lambda i: T0 + dt.timedelta(minutes=i)
    got = {r.event_type: (r.start_time, r.end_time, r.start_price, r.end_price) for r in rows}
    assert got == {
        "PDCC_Down": (minute(1), minute(2), 102.0, 95.0),
        "OSV_Down": (minute(2), minute(3), 95.0, 94.0),
        "PDCC2_UP": (minute(3), minute(4), 94.0, 100.0),
    }
    best = dc.max_overshoot(spark.createDataFrame(rows)).first()
    assert best.max_osv_down == pytest.approx(0.21052631578947367) and best.max_osv_up == 0.0


def test_result_does_not_depend_on_cutting_or_partitions(spark):
    rng = np.random.default_rng(5)
    walk = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 3000)))
    base = ticks(spark, walk).unionByName(ticks(spark, walk[:300][::-1], symbol="B"))
    pairs = [0.02, (0.05, 0.03)]
    want = None
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for span, parts in ((None, 1), ("1 hour", 4), ("7 minutes", 16), ("1 day", 8)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = sorted(tuple(r) for r in dc.dc_events(base, pairs, order="id", span=span).collect())
            want = want or got
            assert got == want and len(got) > 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)


def test_small_buffers_and_batches_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = ticks(spark, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 2000))))
    want = sorted(tuple(r) for r in dc.dc_events(base, [0.02], order="id").collect())
    monkeypatch.setattr(dc, "BUFFER_ROWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = sorted(tuple(r) for r in dc.dc_events(base, [0.02], order="id").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_features_follow_the_regime(spark):
    base = ticks(spark, [100, 102, 95, 94, 100, 101, 99])
    events = dc.dc_events(base, [0.05], order="id")
    rows = dc.dc_features(base, events, 0.05, order="id").orderBy("id").collect()
    assert [r.regime for r in rows] == ["none", "none", "down", "down", "up", "up", "up"]
    assert [r.PDCC_Down for r in rows] == [0, 0, 1, 0, 0, 0, 0]
    assert [r.PDCC2_UP for r in rows] == [0, 0, 0, 0, 1, 0, 0]
    assert rows[3].OSV_Down == pytest.approx((95 - 94) / 95 * 100)
    assert rows[6].OSV_Up == pytest.approx(-1.0) and rows[6].OSV_Up_clamped == 0.0
    quality = dc.feature_quality(base, events, dc.dc_features(base, events, 0.05)).first()
    assert quality.tick_count_match == 1 and quality.none_regime_count == 2


def test_wide_features_equal_long_ones(spark):
    rng = np.random.default_rng(7)
    base = ticks(spark, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 400))))
    events = dc.dc_events(base, [0.02, 0.05], order="id").cache()
    wide = dc.dc_features_wide(base, events, {"a": 0.02, "b": 0.05}, ["OSV_Up", "regime_up"], order="id")
    for name, theta in (("a", 0.02), ("b", 0.05)):
        long = dc.dc_features(base, events, theta, order="id").select(
            "id", F.col("OSV_Up").alias(f"{name}_OSV_Up"), F.col("regime_up").alias(f"{name}_regime_up")
        )
        assert sorted(long.collect()) == sorted(wide.select(*long.columns).collect())


def test_annotation_prefers_confirmations(spark):
    base = ticks(spark, [100, 102, 95, 94, 100])
    rows = dc.dc_annotate(base, dc.dc_events(base, [0.05], order="id")).orderBy("id").collect()
    assert [r.event for r in rows] == [None, None, "PDCC_Down", "OSV_Down", "PDCC2_UP"]
