"""Readers, writers and parsing of files."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars, thresholds
from tickloom.operators import cleaning
from tickloom.sources import tables as S

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def rows(spark):
    data = [(i, f"s{i % 3}", T0 + dt.timedelta(hours=5 * i), float(i)) for i in range(40)]
    return spark.createDataFrame(data, "id int, symbol string, ts timestamp_ntz, v double")


def test_read_dataset_prefers_csv_then_parquet(spark, rows, tmp_path):
    a, b, c = tmp_path / "a", tmp_path / "b", tmp_path / "c"
    rows.write.parquet(str(a))
    assert S.read_dataset(spark, str(a)).count() == 40
    b.mkdir()
    (b / "x.csv").write_text("id,px\n1,2.5\n2,3.5\n")
    out = S.read_dataset(spark, str(b), {"px": "price"})
    assert out.columns == ["id", "price"] and out.agg(F.sum("price")).first()[0] == 6.0
    c.mkdir()
    (c / "part-0000").write_text("id,px\n1,2.5\n")
    assert S.read_dataset(spark, str(c)).count() == 1


def test_read_dataset_rejects_an_empty_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_dataset(spark, str(tmp_path))


def test_load_dataset_dispositions(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS loads")
    f = tmp_path / "d.json"
    f.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    schema = json.dumps([{"name": "a", "type": "INT64"}, {"name": "b", "type": "STRING"}])
    name = f"loads.t{abs(hash(str(tmp_path)))}"
    assert S.load_dataset(spark, str(f), name, schema_json=schema).count() == 2
    assert S.load_dataset(spark, str(f), name, schema_json=schema, mode="append").count() == 4
    assert S.load_dataset(spark, str(f), name, schema_json=schema, mode="truncate").count() == 2
    with pytest.raises(Exception):
        S.load_dataset(spark, str(f), name, schema_json=schema, mode="empty")
    out = S.query_to_table(spark, f"SELECT sum(a) AS s FROM {name}", name + "_sum")
    assert out.first().s == 3
    spark.sql("DROP DATABASE loads CASCADE")


def test_extract_is_skipped_when_present(spark, rows, tmp_path):
    uri = str(tmp_path / "out")
    S.extract_table(rows, uri)
    S.extract_table(rows.limit(1), uri)
    assert spark.read.parquet(uri).count() == 40
    S.extract_table(rows.limit(1), uri, skip_if_exists=False)
    assert spark.read.parquet(uri).count() == 1


def test_table_is_day_partitioned_and_prunes(spark, rows, tmp_path):
    uri = str(tmp_path / "t")
    S.write_table(rows, uri, "ts", ["symbol"], salt=2)
    day = spark.read.parquet(uri).where(F.col("dt") == dt.date(2024, 1, 2))
    assert day.count() == 5
    assert "PartitionFilters: [isnotnull(dt" in day._jdf.queryExecution().executedPlan().toString()


def test_shards_keep_time_order(spark, rows, tmp_path):
    uri = str(tmp_path / "s")
    body = S.write_shards(rows, uri, 4, "ts", {"mean": 1.5})
    assert body["rows"] == {"all": 40} and body["mean"] == 1.5
    saved = json.loads(spark.read.text(uri + "_manifest").first()[0])
    assert saved == body
    spans = (
        spark.read.parquet(uri)
        .groupBy(F.input_file_name().alias("f"))
        .agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    assert len(spans) > 1 and all(r.b - r.a + 1 == r.n for r in spans)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_predictions(spark, rows, tmp_path, fmt):
    assert S.write_predictions(rows, str(tmp_path / "p"), fmt)["rows"] == 40


def test_candles_keep_the_first_of_each(spark, tmp_path):
    one = {"t": 1000, "T": 1999, "s": "A", "i": "1m", "o": "1", "c": "2", "h": "3", "l": "0.5", "v": "9", "n": 4}
    (tmp_path / "a.json").write_text(json.dumps([one, {**one, "t": 0, "c": "5"}]))
    (tmp_path / "b.json").write_text(json.dumps([{**one, "c": "7"}]))
    out = S.read_candles(spark, str(tmp_path)).collect()
    assert [r.close for r in out] == [5.0, 2.0] and out[1].trades == 4


def test_session_reports(spark, tmp_path):
    good = {"symbol": "S", "threshold": 0.01, "sl_pct": 0.1, "tp_pct": 0.2,
            "signals": [{"timestamp": 1.0, "type": "BUY", "price": 5.0}]}
    (tmp_path / "report_a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "report_b.json").write_text("{not json")
    (tmp_path / "report_c.json").write_text(json.dumps({"symbol": "S"}))
    (tmp_path / "report_d.json").write_text(json.dumps({k: v for k, v in good.items() if k != "signals"}))
    out = S.read_session_reports(spark, str(tmp_path), ["a", "b", "c", "d", "missing"]).orderBy("session_id")
    rows = out.collect()
    assert [r.session_id for r in rows] == ["a", "d"]
    assert rows[0].trail_pct == 0.5 and rows[0].leverage == 10 and rows[0].signals[0].type == "BUY"
    assert rows[1].signals == []


def test_leaderboard_document(spark, tmp_path):
    perf = [["day", {"pnl": "1", "roi": "0.1", "vlm": "5"}], ["month", {"pnl": "2", "roi": "0.2", "vlm": "6"}],
            ["allTime", {"pnl": "3", "roi": "0.3", "vlm": "7"}]]
    doc = {"leaderboardRows": [
        {"ethAddress": "0x1", "displayName": None, "accountValue": "10", "windowPerformances": perf},
        {"ethAddress": "0x2", "displayName": "x", "accountValue": "bad", "windowPerformances": perf},
    ]}
    f = tmp_path / "board.json"
    f.write_text(json.dumps(doc))
    rows = S.read_leaderboard(spark, str(f)).collect()
    assert [r.address for r in rows] == ["0x1"]
    assert rows[0].roi_allTime == 0.3 and rows[0].vlm_month == 6.0 and rows[0].roi_week is None


def test_fills_and_cutoffs(spark, rows, tmp_path):
    fills = [{"coin": c, "dir": "Open Long", "px": "1", "sz": "1", "time": t} for c, t in (("A", 3), ("A", 1), ("B", 2))]
    (tmp_path / "f.json").write_text(json.dumps(fills))
    assert [r.time for r in S.read_fills(spark, str(tmp_path), "A", 0).collect()] == [1, 3]
    split = S.split_by_cutoffs(rows, "ts", "2024-01-03", "2024-01-05", "2024-01-06")
    assert {r.split for r in split.collect()} == {"train", "val", "test"}


def test_rendered_query(spark, rows):
    rows.createOrReplaceTempView("rendered_rows")
    out = S.render_query(spark, "SELECT count(*) AS n FROM IDENTIFIER(:t) WHERE v >= :low", t="rendered_rows", low=30.0)
    assert out.first().n == 10


def test_timestamps(spark):
    texts = ["1704067200", "1704067200.5", "2024-01-01T00:00:00Z", "2024-01-01 00:00:00 UTC",
             "2024-01-01T02:00:00+02:00", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.orderBy("i").select(scalars.coerce_ts(F.col("t")).cast("timestamp_ntz").alias("x")).collect()]
    assert got == [T0, T0 + dt.timedelta(seconds=0.5), T0, T0, T0, None, None]
    with pytest.raises(Exception, match="not a timestamp"):
        df.select(scalars.coerce_ts(F.col("t"), strict=True)).collect()


def test_client_ids_over_63_bits(spark):
    raw = "0x" + cleaning.CLIENT_ID_MAGIC + "ffffffffffffffff"
    df = spark.createDataFrame([(raw,), (raw[:-1],), ("0x" + "00" * 16,)], "c string")
    out = [r[0] for r in df.select(scalars.decode_client_id(F.col("c"), cleaning.CLIENT_ID_MAGIC)).collect()]
    assert out == [2**64 - 1, None, None]


def test_thresholds():
    assert thresholds.parse_threshold("0.01") == (0.01, 0.01)
    assert thresholds.parse_threshold("0.02:0.01") == (0.02, 0.01)
    assert thresholds.parse_threshold("SOL:0.010/0.015") == (0.01, 0.015)
    assert thresholds.parse_threshold([0.02, 0.01], ordered=True) == (0.01, 0.02)
    assert thresholds.symbol_of("SOL:0.01") == "SOL" and thresholds.symbol_of("0.1:0.2") is None
    assert thresholds.table_suffix((0.01, 0.01)) == "0p010" and thresholds.canonical((0.01, 0.01)) == "0.010000"
    with pytest.raises(ValueError):
        thresholds.parse_threshold("0.1/0.2/0.3")


def test_prices_rounded_to_the_venue(spark):
    orders = [("A", 1.23456, 12345.678, True), ("A", 1.23456, 1.23456789, True), ("A", 1.23456, 1.23456789, False),
              ("A", 0.001, 123456.7, False), ("B", 5.0, 0.00012345678, True), ("C", 1.0, 1.0, True)]
    df = spark.createDataFrame(orders, "coin string, size double, price double, is_buy boolean")
    meta = spark.createDataFrame([("A", 2, False), ("B", 0, True)], "coin string, sz_decimals int, is_spot boolean")
    got = cleaning.round_to_venue(df.coalesce(1), meta)
    rows = {(r.coin, r.size, r.price, r.is_buy): r for r in got.collect()}
    price = [rows[o].order_price for o in orders[:5]]
    assert price == [12345.0, 1.2345, 1.2346, 123457.0, 0.00012345]
    assert rows[orders[0]].order_size == 1.23
    assert rows[orders[3]].error == "size rounds to zero" and rows[orders[5]].error == "unknown market"


def test_unknown_telemetry_goes_to_misc(spark):
    line = json.dumps({"event_type": "strange", "payload": {}})
    tick = json.dumps({"event_type": "tick", "timestamp": 1704067200.0, "session_id": "s", "symbol": "A", "payload": {"price": 3}})
    out = cleaning.flatten_telemetry(spark.createDataFrame([(line,), (tick,), ("{bad",)], "value string"))
    assert out["misc"].count() == 2
    row = out["ticks"].first()
    assert row.price == 3.0 and row.symbol == "A"


def test_files_of_a_busy_day_are_bounded(spark, tmp_path):
    """Parts of a large group don't meet in a file, however few tasks there are."""
    rows = spark.range(6000).select(F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_interval(0, 0, 0, id % 3)").alias("ts"), F.lit("A").alias("symbol"), "id")
    S.write_table(rows, str(tmp_path / "t"), "ts", ["symbol"], file_bytes=1000)
    files = spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name().alias("f")).count().agg(F.sum("count"), F.max("count")).first()
    assert files[0] == 6000 and files[1] * 17 < 2000


def test_small_shards_need_no_range_each(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("ts"), "id")
    body = S.write_shards(rows, str(tmp_path / "s"), ts="ts", file_bytes=800)
    files = spark.read.parquet(str(tmp_path / "s")).groupBy(F.input_file_name().alias("f")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    found = sorted(files.collect(), key=lambda r: r.a)
    assert all(r.b - r.a + 1 == r.n <= 50 for r in found) and sum(r.n for r in found) == 20_000 and body["shards"] == 400
    tasks = {re.search(r"part-(\d+)-", r.f)[1] for r in found}
    assert len(tasks) <= 64 < len(found)
