"""Values that must not stop a job or change a result, and limits that must not drop rows."""

import datetime as dt
import math
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom import session
from tickloom.functions.reversal import Series
from tickloom.operators import dc, fills, ml, stats
from tickloom.operators import windows as W
from tickloom.operators.joins import scalar_cross, single_row
from tickloom.operators.timeline import Timeline
from tickloom.streaming.detector import TrendProcessor

T0 = dt.datetime(2024, 1, 1)


def ticks(spark, prices, step=60):
    rows = [("A", T0 + dt.timedelta(seconds=step * i), i, None if p is None else float(p)) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, price double")


@pytest.mark.parametrize("span", [None, "10 minutes", "37 minutes", "1 day"])
def test_broken_prices_change_no_event(spark, span):
    rng = np.random.default_rng(8)
    walk = (100 * np.exp(np.cumsum(rng.normal(0, 0.01, 400)))).tolist()
    mixed, sound = [], []
    for i, p in enumerate(walk):
        mixed += [p, [math.nan, 0.0, -3.0, math.inf, None][i % 5]]
        sound += [p, None]
    got, want = (sorted(tuple(r) for r in dc.dc_events(ticks(spark, x), [0.02], order="id", span=span).collect()) for x in (mixed, sound))
    assert got == want and len(got) > 20
    errors = dc.bad_ticks(ticks(spark, mixed)).groupBy("error").count().collect()
    assert dict(map(tuple, errors)) == {"bad price": 320, "no price": 80}


def test_nan_far_and_near(spark):
    far = [10] * 40 + [math.nan] + [10] * 20 + [8]
    near = [10] * 40 + [10] * 20 + [math.nan, 8]
    for prices in (far, near):
        for span in (None, "10 minutes"):
            rows = dc.dc_events(ticks(spark, prices), [0.1], order="id", span=span).collect()
            assert [r.event_type for r in rows] == ["PDCC_Down"]
    with pytest.raises(ValueError):
        Series(np.array([1.0, math.nan]), np.array([0, 1]))


def test_the_stream_gives_broken_prices_back():
    state = {}
    value = types.SimpleNamespace(exists=lambda: "v" in state, get=lambda: state["v"], update=lambda v: state.update(v=v))
    proc = TrendProcessor([(0.1, 0.1)], None)
    proc.trend = value
    rows = pd.DataFrame({"us": [1, 2, 3, 4], "seq": [0] * 4, "price": [10.0, math.nan, 0.0, 8.0]})
    out = pd.concat(list(proc.handleInputRows(("A",), iter([rows]), None)))
    assert out["kind"].tolist() == ["bad", "bad", "event"]


def test_two_rows_where_one_is_meant_fail(spark):
    one, two, none = (spark.range(n).select(F.col("id").cast("double").alias("x_mean"), F.lit(1.0).alias("x_scale")) for n in (1, 2, 0))
    base = spark.range(3).select(F.col("id").cast("double").alias("x"))
    assert single_row(one).count() == 1 and single_row(none).count() == 0
    assert scalar_cross(base, one).count() == 3
    for run in (lambda: scalar_cross(base, two), lambda: ml.apply_scaler(base, two, ["x"]), lambda: ml.inverse_scaler(base, two, "x", "x")):
        with pytest.raises(Exception, match="more than one row"):
            run().collect()


@pytest.mark.parametrize("alpha", [1.0, 0.9, 0.3, 0.001])
def test_momentum_of_any_alpha_and_length(spark, alpha, monkeypatch):
    rng = np.random.default_rng(9)
    directions = rng.choice([-1, 1], 3000).tolist()
    rows = [("A", T0 + dt.timedelta(seconds=i), i, d) for i, d in enumerate(directions)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, direction int")
    got = [r.momentum for r in W.momentum(df, Timeline.of("symbol", "ts", "id"), alpha=alpha).orderBy("id").collect()]
    value, want = 0.0, []
    for d in directions:
        value = alpha * d + (1 - alpha) * value
        want.append(max(-1.0, min(1.0, value)))
    assert got == pytest.approx(want, abs=1e-9)


def test_momentum_rate_counts_all_unless_told(spark):
    rows = [("A", T0 + dt.timedelta(seconds=i), i, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, direction int")
    line = Timeline.of("symbol", "ts", "id")
    last = lambda **kw: W.momentum(df, line, rate_lookback_s=300, **kw).orderBy(F.desc("id")).first().momentum_rate
    assert last() == 200 / 5 and last(history=50) == 50 / 5


def test_regime_counts_more_than_a_hundred(spark):
    rows = [("A", T0 + dt.timedelta(seconds=i), i, 1) for i in range(250)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, direction int")
    out = W.rolling_regime(df, Timeline.of("symbol", "ts", "id"), inclusive=False)
    assert out.agg(F.max("regime_events")).first()[0] == 250


@pytest.mark.parametrize("n", [50, 51])
def test_exact_signed_rank_up_to_the_border(spark, n):
    rows = [("p", 0.0, float(i + 1), (1 if i % 3 else -1) * (i + 1.5)) for i in range(n)]
    df = spark.createDataFrame(rows, "pair string, y_true double, a double, b double")
    exact, normal = (stats.paired_tests(df, exact_upto=k).first().wilcoxon_p for k in (10**6, 0))
    assert stats.paired_tests(df).first().wilcoxon_p == (exact if n <= 50 else normal)
    assert exact == pytest.approx(normal, abs=0.02)


def test_a_cluster_session_needs_a_shared_folder():
    sc = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda k, d: None))
    with pytest.raises(ValueError, match="shared folder"):
        session.shared_folder(fake)


def one_by_one(rows):
    """Round trips of fills taken one after another, by the rules alone."""
    q = mean = 0.0
    out = []
    for kind, px, sz, start in rows:
        sign = {"Open Long": 1, "Open Short": -1, "Long > Short": -1, "Short > Long": 1}.get(kind, 0)
        want = sz if kind.startswith("Close") else (abs(start) or sz) if ">" in kind else 0.0
        off = min(want, abs(q)) if q else want
        if q and want:
            out.append((round(mean, 9), px, round(off, 9)))
            q -= math.copysign(off, q)
            q = 0.0 if abs(q) < 1e-12 else q
        rest = sz - off
        if sign and rest > 1e-12 and q * sign >= 0:
            mean, q = (mean * abs(q) + px * rest) / (abs(q) + rest), q + sign * rest
    return out


@pytest.mark.parametrize("passes", [1, 50])
def test_fills_that_contradict_their_positions(spark, monkeypatch, passes):
    monkeypatch.setattr(fills, "PASSES", passes)
    rng = np.random.default_rng(11)
    rows, held = [], 0.0
    for _ in range(300):
        px, sz = float(rng.integers(90, 110)), float(rng.integers(1, 5))
        kinds = ["Open Long", "Open Short"] if held == 0 else ["Open Long", "Close Long", "Long > Short", "Short > Long"]
        kind = kinds[rng.integers(len(kinds))]
        start = 0.0 if rng.random() < 0.2 else held  # a wrong report now and then
        rows.append((kind, px, sz, start))
        held = max(0.0, held + (sz if kind.startswith("Open") else -sz))
    df = spark.createDataFrame(
        [("w", "c", k, str(p), str(s), str(st), 1_700_000_000_000 + 5000 * i, i) for i, (k, p, s, st) in enumerate(rows)],
        "wallet string, coin string, dir string, px string, sz string, startPosition string, time long, oid long",
    )
    done, _ = fills.pair_fills(df)
    got = [(round(r.entry_price, 9), r.exit_price, round(r["size"], 9)) for r in done.orderBy("exit_time").collect()]
    assert got == one_by_one(rows)
    assert done.select("stretch").distinct().count() > (3 if passes == 50 else 0)
