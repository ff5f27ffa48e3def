"""Chunked operators against plain windows, whatever the chunk length."""

import datetime as dt
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import timeline as TL
from tickloom.operators import windows as W

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows; values have nulls; times have ties."""
    data = []
    for i in range(600):
        key = "hot" if i % 10 else f"k{i % 3}"
        value = None if i % 7 == 0 else float((i * 37) % 101 - 50)
        data.append((key, T0 + dt.timedelta(minutes=(i // 2) * 7 % 4000), i, value))
    return spark.createDataFrame(data, "k string, ts timestamp_ntz, id int, v double").cache()


@pytest.mark.parametrize("span", ["10 minutes", "3 hours", "30 days"])
def test_running_equals_window(rows, span):
    tl = TL.Timeline.of("k", "ts", "id", span)
    w = Window.partitionBy("k").orderBy("ts", "id")
    up, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    on = w.rowsBetween(0, Window.unboundedFollowing)
    v = F.col("v")
    pairs = {
        "s": (TL.total_so_far(v), F.sum(v).over(up)),
        "n": (TL.count_so_far(), F.count(F.lit(1)).over(up)),
        "hi": (TL.max_so_far(v), F.max(v).over(up)),
        "hi0": (TL.max_so_far(v, current=False), F.max(v).over(before)),
        "lo": (TL.min_so_far(v), F.min(v).over(up)),
        "last": (TL.last_known(v), F.last(v, True).over(up)),
        "nxt": (TL.next_known(v), F.first(v, True).over(on)),
        "lag": (TL.previous(v), F.lag(v).over(w)),
        "lead": (TL.following(v), F.lead(v).over(w)),
        "top": (TL.max_of_key(v), F.max(v).over(Window.partitionBy("k"))),
    }
    mine = TL.running(rows, tl, **{n: a for n, (a, _) in pairs.items()})
    plain = rows.select("*", *[b.alias(n) for n, (_, b) in pairs.items()])
    assert sorted(mine.collect(), key=lambda r: r.id) == sorted(plain.collect(), key=lambda r: r.id)


@pytest.mark.parametrize("block", [1, 50, 10_000])
def test_rows_frame_equals_window(rows, block):
    tl = TL.Timeline.of("k", "ts", "id", "3 hours")
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-4, 2)
    mine = TL.rows_frame(rows, tl, 4, 2, lambda f: {"m": F.sum("v").over(f)}, block)
    plain = rows.withColumn("m", F.sum("v").over(w))
    assert sorted(mine.collect(), key=lambda r: r.id) == sorted(plain.collect(), key=lambda r: r.id)


@pytest.mark.parametrize("span", ["1 minute", "2 hours", "10 days"])
def test_range_frame_equals_window(rows, span):
    tl = TL.Timeline.of("k", "ts", "id", span)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("k").orderBy(us).rangeBetween(-1_800_000_000, 0)
    mine = TL.range_frame(rows, tl, "30 minutes", lambda f: {"m": F.sum("v").over(f)})
    plain = rows.withColumn("m", F.sum("v").over(w))
    assert sorted(mine.collect(), key=lambda r: r.id) == sorted(plain.collect(), key=lambda r: r.id)


def test_both_branches_share_one_exchange(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    tl = TL.Timeline.of("k", "ts", "id", "3 hours")
    out = TL.running(stored, tl, s=TL.total_so_far(F.col("v")))
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_suggested_span_follows_the_busiest_key(rows):
    tl = TL.Timeline.of("k", "ts", "id")
    wide, narrow = TL.suggest_span(rows, tl, 10_000), TL.suggest_span(rows, tl, 50)
    assert narrow < wide


def test_no_frame_shrinks_towards_the_end(spark, capsys):
    """Spark evaluates frames from a row to the end of its partition anew for every row."""
    rows = [("A", i, i, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts long, id int, v double")
    line = TL.Timeline.of("symbol", "ts", "id", 100)
    ahead = TL.running(df, line, a=TL.next_known(F.col("v")), b=TL.next_known(F.when(F.col("id") % 7 == 0, F.col("v")), current=False))
    for out in (ahead, W.numeric_fill(df, ["v"], line), W.chrono_split(df, "ts", "symbol", ["id"], span=100)):
        out.explain()
        assert "unboundedfollowing" not in capsys.readouterr().out.lower()
    got = {r.id: (r.a, r.b) for r in ahead.collect()}
    assert got == {i: (i, next((k for k in range(i + 1, 300) if k % 7 == 0), None)) for i in range(300)}


@pytest.mark.parametrize("open_left", [False, True])
def test_range_sums_equal_window(rows, open_left):
    reach = 45 * 60_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("k").orderBy(us).rangeBetween(-reach + open_left, 0)
    want = rows.select("id", F.count("*").over(w).alias("n"), F.min(us).over(w).alias("at"), F.sum("v").over(w).alias("s"), F.sum("id").over(w).alias("i"))
    mine = TL.range_sums(rows, TL.Timeline.of("k", "ts", "id"), reach, {"s": F.col("v"), "i": F.col("id")}, open_left)
    mine = mine.select("id", F.col("__n").alias("n"), F.col("__first").alias("at"), "s", "i")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect()))


def test_a_frame_costs_the_same_whatever_its_length(spark):
    """200,000 rows that all see each other; adding each frame up anew would be 20 billion steps."""
    rows = spark.range(200_000).select(F.lit("A").alias("k"), "id", F.when(F.col("id") != 5, F.col("id") * 1.0).otherwise(float("nan")).alias("v"))
    started = time.monotonic()
    out = TL.range_sums(rows, TL.Timeline.of("k", "id"), 250_000, {"s": F.col("v")})
    got = out.agg(F.max("__n"), F.count_if(F.isnan("s")), F.max(F.when(~F.isnan("s"), F.col("s")))).first()
    assert tuple(got) == (200_000, 199_995, 10.0) and time.monotonic() - started < 60
