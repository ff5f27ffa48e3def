"""Metrics, tests and distributions against hand-made or brute-force results."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import pvalues as P
from tickloom.operators import ml, stats
from tickloom.operators.joins import reconcile_positions, zip_thresholds

T0 = dt.datetime(2024, 1, 1)


def preds(spark, y, p, model="m"):
    rows = [(model, i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "model string, sample_index long, y_true double, y_pred double")


def test_forecast_metrics_known_values(spark):
    same = stats.forecast_metrics(preds(spark, [1, 2, 3], [1, 2, 3])).first()
    assert same.rmse == 0 and same.r_squared == 1
    off = stats.forecast_metrics(preds(spark, [1, 2, 3], [2, 3, 4])).first()
    assert off.rmse == pytest.approx(1) and off.mae == pytest.approx(1)
    flat = stats.forecast_metrics(preds(spark, [5, 5], [4, 6])).first()
    assert flat.r_squared == 0
    zeros = stats.forecast_metrics(preds(spark, [0, 0], [0, 0])).first()
    assert zeros.mape == 0 and zeros.smape == 0


def test_directional_accuracy_edges(spark):
    one = stats.directional_accuracy(preds(spark, [1], [2])).first()
    assert one.directional_accuracy == 0
    ups = stats.directional_accuracy(preds(spark, [1, 2, 1, 3], [1, 3, 2, 1]), span=2).first()
    assert ups.directional_accuracy == pytest.approx(2 / 3)
    still = preds(spark, [1, 1], [2, 0]).withColumn("ref", F.lit(1.0))
    assert stats.directional_accuracy(still, reference="ref").first().directional_accuracy == 0.5


def test_p_values():
    assert P.student_sf2(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert P.student_sf2(0.0, 5) == pytest.approx(1.0)
    assert P.student_sf2(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert P.normal_sf2(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    for n in (5, 8):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
        for w in (0, 3, n):
            want = min(1.0, 2 * sum(x <= w for x in sums) / 2**n)
            assert P.wilcoxon_exact_sf2(w, n) == pytest.approx(want)


def brute_ranks(d):
    d = d[d != 0]
    a = np.abs(d)
    rank = np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])
    return min(rank[d > 0].sum(), rank[d < 0].sum()), len(d)


def test_paired_tests_against_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(0, 1, 30)
    a, b = y + rng.normal(0, 0.5, 30), y + rng.normal(0, 0.9, 30)
    df = spark.createDataFrame(
        [("p", float(i), float(j), float(k)) for i, j, k in zip(y, a, b)],
        "pair string, y_true double, a double, b double",
    )
    row = stats.paired_tests(df).first()
    stat, n = brute_ranks((y - a) ** 2 - (y - b) ** 2)
    assert row.wilcoxon_p == pytest.approx(P.wilcoxon_exact_sf2(stat, n))
    d = np.abs(y - a) - np.abs(y - b)
    t = d.mean() / (d.std(ddof=1) / math.sqrt(30))
    assert row.paired_ttest_p == pytest.approx(P.student_sf2(t, 29))
    rmse = lambda p: math.sqrt(((y - p) ** 2).mean())
    assert row.rmse_relative_improvement_pct == pytest.approx((rmse(b) - rmse(a)) / rmse(b) * 100)


def test_few_or_equal_samples_have_no_signed_rank_p(spark):
    few = spark.createDataFrame([("p", 1.0, 2.0, 3.0)] * 3, "pair string, y_true double, a double, b double")
    same = spark.createDataFrame([("p", 1.0, 2.0, 2.0)] * 9, "pair string, y_true double, a double, b double")
    assert stats.paired_tests(few).first().wilcoxon_p is None
    row = stats.paired_tests(same).first()
    assert row.wilcoxon_p is None and row.rmse_relative_improvement_pct == 0


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_percentiles_interpolate_linearly(spark, n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 40, n).astype(float)  # many copies
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    row = stats.percentiles(df, "v", ["g"]).first()
    for p in (25, 50, 75, 90):
        assert row[f"p{p}"] == pytest.approx(np.percentile(values, p))
    assert row["count"] == n and row["max"] == values.max()


def test_ranked_values_are_exact_whatever_the_cuts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = np.r_[np.full(300, 7.0), rng.normal(0, 5, 400)]  # one value holds a large share
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for splits in (4, 256):
        monkeypatch.setattr(stats, "SPLITS", splits)
        for r in stats.ranked_values(df, [], "v").collect():
            assert r.below == (values < r.value).sum() and r.n == (values == r.value).sum()


def test_scaler_keeps_constants_and_inverts(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1), (3.0, 5.0, 0)], "a double, b double, flag int")
    params = stats.scaler_fit(df, ["a", "b"])
    row = params.first()
    assert (row.a_mean, row.a_scale, row.b_scale) == (2.0, 1.0, 1.0)
    out = ml.apply_scaler(df, params, ["a", "b"], ["flag"], scale_indicators=True)
    assert [r.a_std for r in out.collect()] == [-1.0, 1.0] and [r.flag_std for r in out.collect()] == [1.0, -1.0]
    assert [r.a_std for r in ml.inverse_scaler(out, params, "a", "a_std").collect()] == [1.0, 3.0]


def test_latents_and_labels(spark):
    rows = [(1, "0.02", [3.0], [30.0], [9.0], [20.0]), (1, "0.01", [1.0, 2.0], [10.0], [8.0], [10.0])]
    df = spark.createDataFrame(rows, "window_id int, threshold string, z array<double>, z_mean array<double>, z_log_var array<double>, y array<double>")
    first = ml.latent_concat(df, expected=2).first()
    assert first.z == [1.0, 2.0, 3.0] and first.y == [10.0]
    stacked = ml.latent_concat(df, label="stack", expected=2)
    assert ml.pick_label(stacked, ["0.01", "0.02"], "0.02").first().y == [20.0]
    assert ml.pick_label(stacked, ["0.01", "0.02"], 99).first().y == [20.0]
    with pytest.raises(Exception, match="missing a threshold"):
        ml.latent_concat(df, expected=3).collect()


def test_zip_guards(spark):
    kind = "window_id int, x array<array<double>>, y array<double>"
    a = spark.createDataFrame([(1, [[1.0]], [5.0]), (2, [[2.0]], [6.0])], kind)
    b = spark.createDataFrame([(1, [[3.0]], [5.0]), (2, [[4.0]], [6.0])], kind)
    rows = zip_thresholds([a, b], "window_id").orderBy("window_id").collect()
    assert rows[0].x == [[1.0, 3.0]] and rows[0].y == [5.0]
    assert zip_thresholds([a, b], "window_id", y="stack").orderBy("window_id").first().y == [[5.0], [5.0]]
    with pytest.raises(Exception, match="differ in length"):
        zip_thresholds([a, b.where("window_id = 1")], "window_id").collect()
    with pytest.raises(Exception, match="labels differ"):
        zip_thresholds([a, b.withColumn("y", F.array(F.lit(0.0)))], "window_id").collect()


def test_equity_curve(spark):
    curve = [100, 110, 99, 0, 50, 60]
    rows = [("a", T0 + dt.timedelta(minutes=30 * i), float(v)) for i, v in enumerate(curve)]
    rows += [("short", T0, 1.0), ("short", T0 + dt.timedelta(hours=1), 2.0)]
    df = spark.createDataFrame(rows, "address string, ts timestamp_ntz, equity double")
    got = {r.address: r for r in stats.equity_metrics(df, span="1 hour").collect()}
    steps = [0.1, -0.1, -1.0, 0.2]  # the step from zero is left out
    a = got["a"]
    assert a.pos_pct == pytest.approx(0.5) and a.max_dd == pytest.approx(1.0)
    assert a.vol == pytest.approx(np.std(steps, ddof=1))
    assert a.ret_1h == 0.0 and a.ret_24h == pytest.approx(-0.4)
    assert got["short"].ret_24h == 0.0 and got["short"].vol == 0.0


def test_position_drift_rules(spark):
    pos = lambda rows: spark.createDataFrame(rows, "coin string, szi double")
    leader = pos([("same", 10.0), ("flip", 5.0), ("drift", 10.0), ("busy", 5.0), ("flat", 0.0)])
    follower = pos([("same", 9.5), ("flip", -5.0), ("drift", 5.0), ("busy", -5.0), ("orphan", 1.0), ("flat", 0.0)])
    seen = spark.createDataFrame([("busy", 95.0), ("same", 10.0)], "coin string, ts double")
    out = {r.coin: (r.drift_pct, r.kind) for r in reconcile_positions(leader, follower, seen, F.lit(100.0)).collect()}
    assert out == {"flip": (100.0, "direction"), "drift": (50.0, "size"), "orphan": (100.0, "orphan")}


def test_experiments_and_best_run(spark, tmp_path):
    for name, rmse in (("001-a", 0.5), ("002-b", 0.4)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.json").write_text('{"per_model": {"baseline": {"rmse": %s, "r_squared": 0.1}}, "comparisons": {}}' % rmse)
    out = stats.experiment_rollup(spark, str(tmp_path / "*" / "results.json"), ["rmse", "r_squared"])
    assert {r.experiment: r.rmse for r in out.collect()} == {"001-a": 0.5, "002-b": 0.4}
    runs = out.withColumn("run_id", F.col("experiment"))
    assert stats.best_run(runs, "rmse").first().run_id == "002-b"
    assert stats.best_run(runs, "rmse", lower_is_better=False).first().run_id == "001-a"


def test_encoders_and_regression(spark):
    rows = [(float(i % 7), "abc"[i % 3], "xy"[i % 2], float(3 * (i % 7) + (i % 3))) for i in range(300)]
    df = spark.createDataFrame(rows, "n double, c string, o string, label double")
    enc = ml.encode_features(df, ["n"], ["c"], ["o"])
    odd = enc.transform(spark.createDataFrame([(1.0, "new", "new", 0.0)], df.schema)).first().features.toArray()
    assert odd[1:4].tolist() == [0, 0, 0] and odd[4] == 2
    ready = enc.transform(df)
    _, metrics = ml.tabular_regression(ready, ready, ready, "label", maxIter=5)
    row = metrics.first()
    assert row.r_squared > 0.9 and row.rmsle < 1
