"""What is written is read back, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.stats import experiment_rollup
from tickloom.session import scratch
from tickloom.sources import tables as S
from tickloom.streaming import io
from tickloom.streaming.detector import dc_stream
from tickloom.streaming.rolling import rolling_stream
from tickloom.workload import market
from tickloom.workload.inputs import FILLS, THRESHOLDS, TICKS, dc_sql, fills, preds, sensors
from tickloom.workload.registry import Tables, query


@query("S2_read_dataset_csv", f"WITH {TICKS} SELECT * FROM ticks", "price")
def _(t: Tables):
    path = scratch(t.spark, "csv")
    t.ticks.withColumn("ts", F.col("ts").cast("string")).write.option("header", "true").csv(path)
    kind = "sym string, ts timestamp, price double, event_id bigint"
    out = S.read_dataset(t.spark, path, {"sym": "symbol"}, T.StructType.fromDDL(kind))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("S2_read_dataset_parquet", f"WITH {TICKS} SELECT * FROM ticks", "price")
def _(t: Tables):
    """Parquet in nested folders, beside files of another kind."""
    path = scratch(t.spark, "mixed")
    t.ticks.withColumnRenamed("symbol", "sym").write.partitionBy("sym").parquet(f"{path}/data")
    t.spark.range(1).select(F.lit("notes").alias("value")).write.text(f"{path}/notes")
    out = S.read_dataset(t.spark, path)
    symbol = F.regexp_extract(F.input_file_name(), "sym=([^/]+)/", 1)
    return out.withColumn("symbol", symbol).select("symbol", "ts", "price", "event_id")


@query(
    "S3_S16_query_to_table",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1",
)
def _(t: Tables):
    t.orders.createOrReplaceTempView("tickloom_orders")
    database = _database(t)
    sql = "SELECT * FROM IDENTIFIER(:source) WHERE o_totalprice > :low"
    rendered = S.render_query(t.spark, sql, source="tickloom_orders", low=200000.0)
    rendered.createOrReplaceTempView("tickloom_rendered")
    return S.query_to_table(
        t.spark,
        "SELECT o_orderpriority, count(*) AS n FROM tickloom_rendered GROUP BY o_orderpriority",
        f"{database}.by_priority",
    )


def _database(t: Tables) -> str:
    path = scratch(t.spark, "db")
    name = "tl_" + path[-12:]
    t.spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    return name


@query("S4_S5_extract_and_load", f"WITH {TICKS} SELECT symbol, event_id, price FROM ticks", "price")
def _(t: Tables):
    path = scratch(t.spark, "export")
    rows = t.ticks.select("symbol", "event_id", "price")
    S.extract_table(rows, path, "json")
    S.extract_table(rows.limit(1), path, "json")  # there already, so nothing happens
    schema = (
        '[{"name": "symbol", "type": "STRING"}, {"name": "event_id", "type": "INT64"}, '
        '{"name": "price", "type": "FLOAT64"}]'
    )
    return S.load_dataset(t.spark, path, f"{_database(t)}.ticks", "json", schema)


@query(
    "S6_ingest_telemetry",
    """SELECT 'dc_events' AS kind, event_id::VARCHAR AS session_id, value AS price FROM events WHERE event_id % 3 = 1
UNION ALL SELECT 'ticks', event_id::VARCHAR, value FROM events WHERE event_id % 3 = 0
UNION ALL SELECT 'misc', event_id::VARCHAR, NULL FROM events WHERE event_id % 3 = 2""",
    "price",
)
def _(t: Tables):
    source, out = scratch(t.spark, "ndjson"), scratch(t.spark, "tables")
    market._telemetry(t).write.text(source)
    io.ingest_telemetry(t.spark, source, out, scratch(t.spark, "cp")).awaitTermination()
    table = lambda n, c: t.spark.read.parquet(f"{out}/{n}/*").select(
        F.lit(n).alias("kind"), "session_id", F.col(c).alias("price")
    )
    misc = t.spark.read.parquet(f"{out}/misc/*").select(
        F.lit("misc").alias("kind"), F.get_json_object("line", "$.session_id").alias("session_id"),
        F.lit(None).cast("double").alias("price"),
    )
    return table("dc_events", "start_price").unionByName(table("ticks", "price")).unionByName(misc)


@query(
    "S7_S8_stream_with_dead_letters",
    """SELECT 'tick' AS kind, count(*) AS n FROM events WHERE event_id % 50 NOT IN (7, 8, 9)
UNION ALL SELECT 'dead', count(*) FROM events WHERE event_id % 50 IN (7, 8, 9)""",
)
def _(t: Tables):
    source, good, dead = (scratch(t.spark, n) for n in ("messages", "good", "dead"))
    market._messages(t).select("value").write.text(source)
    parsed = io.counted_ticks(io.read_tick_stream(t.spark, path=source))
    io.write_events(parsed, good, scratch(t.spark, "cp"), dead).awaitTermination()
    count = lambda path, kind: t.spark.read.text(f"{path}/*").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.lit(kind).alias("kind"), "n")
    return count(good, "tick").unionByName(count(dead, "dead"))


@query(
    "S8_written_rows",
    """SELECT 'tick' AS kind, event_type AS symbol, ts, value AS price, NULL AS payload FROM events WHERE event_id % 50 NOT IN (7, 8, 9)
UNION ALL SELECT 'dead', NULL, NULL, NULL, '{broken' FROM events WHERE event_id % 50 = 7
UNION ALL SELECT 'dead', NULL, NULL, NULL, '{"symbol": "a", "price": 1, "timestamp": "soon"}' FROM events WHERE event_id % 50 = 9""",
    "price",
)
def _(t: Tables):
    """The rows that the stream wrote, and the messages of two kinds that it put aside."""
    source, good, dead = (scratch(t.spark, n) for n in ("messages", "good", "dead"))
    market._messages(t).select("value").write.text(source)
    parsed = io.counted_ticks(io.read_tick_stream(t.spark, path=source))
    io.write_events(parsed, good, scratch(t.spark, "cp"), dead).awaitTermination()
    tick = F.from_json("value", "symbol string, price double, ts timestamp_ntz").alias("r")
    rows = t.spark.read.text(f"{good}/*").select(tick).select(F.lit("tick").alias("kind"), "r.symbol", "r.ts", (F.col("r.price") - market.LIFT).alias("price"), F.lit(None).cast("string").alias("payload"))
    aside = t.spark.read.text(f"{dead}/*").select(F.get_json_object("value", "$.payload").alias("payload")).where("payload not like '%much%'")
    return rows.unionByName(aside.withColumn("kind", F.lit("dead")), allowMissingColumns=True)


@query(
    "S12_read_candles",
    """WITH c AS (SELECT event_type AS symbol, '1h' AS interval, date_trunc('hour', ts) AS ts, value, event_id FROM events)
SELECT symbol, interval, ts, ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS close_ts, arg_min(value, event_id) AS open,
  arg_min(value + 1, event_id) AS close, arg_min(value - 1, event_id) AS low, arg_min(value + 2, event_id) AS high,
  arg_min(value * 3, event_id) AS volume, min(event_id) AS trades FROM c GROUP BY symbol, interval, ts""",
    "open close low high volume",
)
def _(t: Tables):
    """Candle arrays in a file per symbol and day, an hour several times over."""
    path = scratch(t.spark, "candles")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    v, text = F.col("value"), lambda c: c.cast("string")
    fields = {
        "t": text(F.unix_millis(hour)), "T": text(F.unix_millis(hour) + 3_599_999), "s": F.col("event_type"), "i": F.lit("1h"), "o": text(v), "c": text(v + 1),
        "h": text(v + 2), "l": text(v - 1), "v": text(v * 3), "n": text(F.col("event_id")),
    }
    candle = F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), c)])
    ordered = F.array_sort(F.collect_list(F.struct("event_id", F.to_json(candle).alias("candle"))))
    chunks = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(ordered.alias("rows"))
    body = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda x: x["candle"]), ","), F.lit("]"))
    chunks.select("event_type", "day", body.alias("value")).write.partitionBy("event_type", "day").text(path)
    return S.read_candles(t.spark, path)


@query(
    "S13_fills_from_files",
    f"""WITH {FILLS} SELECT coin, oid, time, dir, px, sz FROM fills WHERE coin = 'click' AND time >= 1704300000000 AND time <= 1705500000000""",
    "px sz",
)
def _(t: Tables):
    path = scratch(t.spark, "fills")
    rows = fills(t).withColumn("day", F.to_date(F.timestamp_millis("time")))
    chunks = rows.groupBy("coin", "day").agg(F.to_json(F.collect_list(F.struct("coin", "oid", "time", "dir", "px", "sz"))).alias("value"))
    chunks.write.partitionBy("coin", "day").text(path)
    return S.read_fills(t.spark, path, "click", 1704300000000, 1705500000000).select("coin", "oid", "time", "dir", "px", "sz")


@query(
    "S14_read_session_reports",
    """SELECT s_suppkey::VARCHAR AS session_id, s_name AS symbol, s_acctbal / 1e6 AS threshold, 0.01 AS sl_pct, 0.02 AS tp_pct,
  CASE WHEN s_suppkey % 3 = 0 THEN 0.7 ELSE 0.5 END AS trail_pct, s_suppkey AS tick_count, CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 0 END AS signals,
  CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 END AS last_price FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0""",
    "threshold sl_pct tp_pct trail_pct last_price",
)
def _(t: Tables):
    """A report per session, some with defaults, some broken off, some without what is needed."""
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    signal = lambda kind, price: F.struct(F.lit(1.0).alias("timestamp"), F.lit(kind).alias("type"), price.alias("price"), F.lit(2.0).alias("size"), F.lit("x").alias("reason"))
    report = F.to_json(F.struct(
        F.col("s_name").alias("symbol"), (bal / 1e6).alias("threshold"), F.lit(0.01).alias("sl_pct"), F.when(k % 11 != 0, 0.02).alias("tp_pct"),
        F.when(k % 3 == 0, 0.7).alias("trail_pct"), k.alias("tick_count"), F.when(k % 5 == 0, F.array(signal("BUY", bal), signal("CLOSE", bal + 1))).alias("signals"),
    ))
    body = F.when(k % 7 == 0, F.substring(report, 1, 30)).otherwise(report)
    path = scratch(t.spark, "reports")
    reports = t.supplier.select(F.concat(F.lit("report_"), k.cast("string")).alias("session"), body.alias("value"))
    # A folder per session: tasks make and commit them side by side, as neither one task nor the driver can in time.
    side_by_side = reports.repartition(48, "session").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    side_by_side.partitionBy("session").text(path)
    out = S.read_session_reports(t.spark, path)
    return out.select(
        "session_id", "symbol", "threshold", "sl_pct", "tp_pct", "trail_pct", "tick_count", F.size("signals").alias("signals"),
        F.get(F.filter("signals", lambda x: x["type"] == "CLOSE"), 0)["price"].alias("last_price"),
    )


@query(
    "S5_mixed_folder",
    f"WITH {TICKS} SELECT symbol, event_id, price FROM ticks",
    "price",
)
def _(t: Tables):
    """A folder with more Parquet than other files: those are loaded, the others left alone."""
    path = scratch(t.spark, "folder")
    t.ticks.select("symbol", "event_id", "price").repartition(3, "event_id").write.parquet(f"{path}/data")
    t.spark.range(1).write.json(f"{path}/notes")
    return S.load_dataset(t.spark, path, f"{_database(t)}.mixed")


@query(
    "S9_write_table",
    "SELECT (ts::DATE)::VARCHAR AS dt, event_type AS symbol, count(*) AS n, max(value) AS top FROM events GROUP BY ALL",
    "top",
)
def _(t: Tables):
    path = scratch(t.spark, "daily")
    rows = t.events.select(F.col("event_type").alias("symbol"), "ts", "value")
    S.write_table(rows, path, "ts", ["symbol"], file_bytes=4096)
    stored = t.spark.read.parquet(path)
    return stored.groupBy(F.col("dt").cast("string").alias("dt"), "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top")
    )


@query("S9_one_busy_day", f"WITH {TICKS} SELECT symbol, event_id, price, '2024-01-01' AS dt FROM ticks", "price")
def _(t: Tables):
    """Nearly all rows on one day: a few files of bounded size, or the query fails."""
    path, most = scratch(t.spark, "busy"), 65536
    us = F.pmod(F.col("event_id"), F.lit(86_400_000_000)) + F.lit(1_704_067_200_000_000)
    rows = t.ticks.withColumn("ts", F.timestamp_micros(us).cast("timestamp_ntz"))
    S.write_table(rows, path, "ts", ["symbol"], file_bytes=most)
    stored = t.spark.read.parquet(path)
    per_file = stored.groupBy(F.input_file_name().alias("f"), "symbol").agg(F.sum(F.octet_length("symbol") + 24).alias("bytes"))
    large = per_file.agg(F.max("bytes").alias("bytes")).select(F.when(F.col("bytes") > 2 * most, F.raise_error(F.lit("a file is too large"))).alias("ok"))
    return stored.crossJoin(F.broadcast(large)).where("ok is null").select("symbol", "event_id", "price", F.col("dt").cast("string").alias("dt"))


@query("S10_write_shards", f"WITH {TICKS} SELECT * FROM ticks", "price")
def _(t: Tables):
    path = scratch(t.spark, "shards")
    S.write_shards(t.ticks, path, ts="ts", manifest={"features": ["price"]}, tie=["event_id"], file_bytes=16384)
    return t.spark.read.parquet(path)


@query(
    "S11_write_predictions",
    "SELECT event_type AS model, event_id AS sample_index, value AS y_true FROM events",
    "y_true",
)
def _(t: Tables):
    path = scratch(t.spark, "predictions")
    S.write_predictions(preds(t).select("model", "sample_index", "y_true"), path)
    return t.spark.read.parquet(path)


FILE_ROWS, FILES = 1_000_000, 12  # at most so many rows a file (if time is even), at least so many files


def _write_in_time(rows: DataFrame, path: str, jitter_us: int = 0) -> None:
    """``rows(ts, event_id, ...)`` as one file per stretch of time, each written after the one before, in no order within a file.

    A row lands up to ``jitter_us`` after its time, so files overlap in time.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last, n = rows.agg(F.min(us), F.max(us), F.count(F.lit(1))).first()
    if not n:
        return
    files = max(FILES, -(-n // FILE_ROWS))
    length = (last + jitter_us - first) // files + 1
    late = F.pmod(F.xxhash64("event_id"), F.lit(jitter_us + 1))
    numbered = rows.withColumn("file", F.floor((us - first + late) / length).cast("int"))
    # All rows are dealt to their stretches once, so that a file costs what it holds; then the files are written one by one.
    dealt = scratch(rows.sparkSession, "stretches")
    numbered.repartition(files, "file").sortWithinPartitions("file", F.hash("event_id")).write.partitionBy("file").parquet(dealt)
    for k in range(files):
        some = rows.sparkSession.read.schema(numbered.schema).parquet(dealt).where(F.col("file") == k).drop("file")
        some.coalesce(1).sortWithinPartitions(F.hash("event_id")).write.parquet(f"{path}/file={k}")


def _tick_files(t: Tables, jitter_us: int = 0) -> str:
    """The ticks as files, and two files more with a tick of a symbol of its own, long after the others: the clock that ends the day."""
    path = scratch(t.spark, "tick-files")
    _write_in_time(t.ticks.select("symbol", "ts", "price", "event_id"), path, jitter_us)
    for k in (1, 2):
        end = t.ticks.agg((F.max("ts") + F.expr(f"interval {400 + k} days")).alias("ts"))
        end.select(F.lit("~").alias("symbol"), "ts", F.lit(1.0).alias("price"), F.lit(-1).cast("long").alias("event_id")).write.parquet(f"{path}/file={1000000 + k}")
    return path


def _files_as_stream(t: Tables, path: str) -> DataFrame:
    """One file a batch, in order of time."""
    schema = t.spark.read.parquet(path).schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).drop("file")


def _drained(stream: DataFrame, name: str) -> tuple[DataFrame, list]:
    """What a stream gives until it has read everything, as written by batch, and the progress of its batches."""
    out = scratch(stream.sparkSession, name)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = stream.writeStream.foreachBatch(sink).outputMode("update")
    run = run.option("checkpointLocation", scratch(stream.sparkSession, "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.parquet(out).drop("batch"), run.recentProgress


JITTER, WAIT = 2 * 86_400_000_000, "3 days"


@query(
    "D3_dc_stream_ordered",
    f"WITH RECURSIVE {dc_sql()} SELECT * FROM dc",
    "start_price end_price threshold_down threshold_up max_osv",
)
def _(t: Tables):
    """The detector over many files in which ticks overtake each other, with the batch detector's check."""
    ticks = _files_as_stream(t, _tick_files(t, JITTER))
    found, _progress = _drained(dc_stream(ticks, THRESHOLDS, order="event_id", watermark=WAIT), "events")
    return found.where("kind = 'event'").drop("kind", "event_timestamp", "ingested_at")


@query(
    "D3_dc_stream",
    f"WITH RECURSIVE {dc_sql()} SELECT * FROM dc",
    "start_price end_price threshold_down threshold_up max_osv",
)
def _(t: Tables):
    """The detector over files that are each in any order but follow each other in time."""
    ticks = _files_as_stream(t, _tick_files(t))
    found, _progress = _drained(dc_stream(ticks, THRESHOLDS, order="event_id", watermark=WAIT), "events")
    return found.where("kind = 'event'").drop("kind", "event_timestamp", "ingested_at")


@query(
    "X2_late_ticks",
    "SELECT 'late' AS kind, event_type AS symbol, ts, value + 50 AS price FROM events WHERE event_id % 97 = 0 UNION ALL SELECT 'bad', event_type, ts, -1.0::DOUBLE FROM events WHERE event_id % 89 = 0",
    "price",
)
def _(t: Tables):
    """Ticks that come again when the clock is long past them are reported, as are those without a sound price."""
    path = _tick_files(t)
    late = t.ticks.where("event_id % 97 = 0").unionByName(t.ticks.where("event_id % 89 = 0").withColumn("price", F.lit(-1.0)))
    late.select("symbol", "ts", "price", "event_id").write.parquet(f"{path}/file=1000003")
    found, _progress = _drained(dc_stream(_files_as_stream(t, path), THRESHOLDS[:1], order="event_id", watermark=WAIT), "late")
    return found.where("kind <> 'event'").select("kind", "symbol", F.col("event_timestamp").alias("ts"), F.col("end_price").alias("price"))


@query(
    "X4_counters",
    f"""WITH RECURSIVE {dc_sql()} SELECT 'parse_errors' AS counter, count(*) AS n FROM events WHERE event_id % 50 IN (7, 8, 9)
UNION ALL SELECT 'parsed', count(*) FROM events WHERE event_id % 50 NOT IN (7, 8, 9) UNION ALL SELECT 'events_emitted', count(*) FROM dc""",
)
def _(t: Tables):
    """Counters that the streams observe, from the progress of their batches."""
    source = scratch(t.spark, "messages")
    market._messages(t).select("value").write.text(source)
    _rows, read = _drained(io.counted_ticks(io.read_tick_stream(t.spark, path=source)).select("error"), "parsed")
    ticks = _files_as_stream(t, _tick_files(t))
    _rows, found = _drained(dc_stream(ticks, THRESHOLDS, order="event_id", watermark=WAIT), "emitted")
    totals = io.observed_totals([*read, *found])
    names = ("ticks.parse_errors", "ticks.parsed", "events.events_emitted")
    return t.spark.createDataFrame([(k.split(".")[1], totals.get(k, 0)) for k in names], "counter string, n long")


@query(
    "X5_rolling_stream",
    f"""WITH RECURSIVE {market.MOMENTUM}, {market.REGIME.replace(market.SENSORS + ",", "")}, {market.TREND.replace(market.SENSORS + ",", "")}
SELECT m.symbol, m.ts, m.direction::INT AS direction, r.regime, m.momentum, t.bias, t.trend FROM moments m JOIN regimes r USING (event_id) JOIN trends t USING (event_id)""",
    "momentum bias",
)
def _(t: Tables):
    """Regime, momentum and trend of sensor events on a stream of files, with the checks of the batch operators."""
    events = sensors(t).select(
        "symbol", "ts", F.col("ts").alias("end_time"), F.lit(1.0).alias("start_price"), (F.lit(1.0) + F.col("tmv")).alias("end_price"), "event_id",
        F.when(F.col("direction") == 1, "PDCC2_UP").otherwise("PDCC_Down").alias("event_type"),
    )
    path = scratch(t.spark, "sensor-files")
    _write_in_time(events, path)
    live = rolling_stream(_files_as_stream(t, path), 6 * 3600, 9 * 3600, choppy_rate=0.05, order="event_id")
    found, _progress = _drained(live, "rolling")
    return found.select("symbol", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "direction", "regime", "momentum", "bias", "trend")


@query(
    "A23_experiment_rollup",
    """SELECT 'run=' || o_orderpriority AS experiment, o_orderstatus AS model, avg(o_totalprice) AS mae, count(*)::DOUBLE AS n FROM orders GROUP BY ALL""",
    "mae n",
    2,
)
def _(t: Tables):
    """Result files of runs in a folder each, as their trainers leave them."""
    per = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("mae"), F.count(F.lit(1)).cast("double").alias("n"))
    metrics = F.struct(F.col("o_orderstatus"), F.create_map(F.lit("mae"), "mae", F.lit("n"), "n"))
    runs = per.groupBy(F.col("o_orderpriority").alias("run")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(metrics)).alias("per_model"))).alias("value"))
    path = scratch(t.spark, "experiments")
    runs.repartition("run").write.partitionBy("run").text(path)
    return experiment_rollup(t.spark, path, ["mae", "n"])
