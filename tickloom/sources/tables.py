"""Readers and writers."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schemas
from tickloom.functions.scalars import epoch_parts_to_ts
from tickloom.operators.timeline import Timeline, row_index
from tickloom.session import cut_lineage

FORMATS = {
    "csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet",
    "avro": "avro", "orc": "orc",
}
DISPOSITIONS = {
    "truncate": "overwrite", "append": "append", "empty": "errorifexists",
}


def scan_trades(
    source: DataFrame | SparkSession, path: str | None = None, instrument: str | None = None,
    start: str = "1970-01-01", end: str = "9999-12-31",
) -> DataFrame:
    """Raw snapshots of one instrument with load time *and* event time in the range.

    The load-time condition prunes partitions and row groups; the event-time one is the real one.
    """
    raw = source if isinstance(source, DataFrame) else source.read.schema(schemas.RAW_TRADE).parquet(path)
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    rows = raw if instrument is None else raw.where(F.col("INSTRUMENT") == instrument)
    rows = rows.where(F.col("LOAD_TIME").between(lo, hi))
    ts = epoch_parts_to_ts(F.col("LAST_PROCESSED_TRADE_TS"), F.col("LAST_PROCESSED_TRADE_TS_NS"))
    return rows.select(
        F.col("MARKET").alias("market"),
        F.col("INSTRUMENT").alias("instrument"),
        F.col("LAST_PROCESSED_TRADE_CCSEQ").cast("string").alias("trade_id"),
        ts.cast("timestamp_ntz").alias("ts"),
        F.col("LAST_PROCESSED_TRADE_PRICE").alias("price"),
        F.col("LAST_PROCESSED_TRADE_QUANTITY").alias("vol_base"),
        F.col("LAST_PROCESSED_TRADE_QUOTE_QUANTITY").alias("vol_quote"),
        F.col("LAST_PROCESSED_TRADE_SIDE").alias("side"),
        F.col("LOAD_TIME").alias("load_time"),
    ).where(F.col("ts").between(lo, hi))


def _listing(spark: SparkSession, path: str) -> list[str]:
    """Extensions of the files under a path, the most frequent first, without reading any contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)(?:\.gz)?$", 1)).alias("e")
    found = files.select(ext).groupBy("e").count().orderBy(F.desc("count"), "e")
    return [r.e for r in found.collect()]


def read_dataset(
    spark: SparkSession, path: str, columns: Mapping[str, str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A folder of CSV, else Parquet, else Avro, else extension-less CSV; an empty one fails, as does one of other files only."""
    found = _listing(spark, path)
    if not found:
        raise FileNotFoundError(f"no files under {path}")
    kind = next((k for k in ("csv", "parquet", "avro") if k in found), "csv")
    if kind not in found and "" not in found:
        raise ValueError(f"no CSV, Parquet or Avro under {path}, but {', '.join(found)}")
    reader = spark.read.option("recursiveFileLookup", "true")
    if kind in found:
        reader = reader.option("pathGlobFilter", f"*.{kind}*")
    if kind == "csv":
        reader = reader.option("header", "true").option("inferSchema", str(schema is None).lower())
    df = (reader.schema(schema) if schema else reader).format(kind).load(path)
    return df.withColumnsRenamed(dict(columns)) if columns else df


def query_to_table(spark: SparkSession, sql: str, table: str, mode: str = "overwrite") -> DataFrame:
    """S3: run a query into a table."""
    spark.sql(sql).write.mode(mode).saveAsTable(table)
    return spark.table(table)


def extract_table(df: DataFrame, uri: str, fmt: str = "parquet", skip_if_exists: bool = True) -> None:
    """Export a table; by default nothing happens when the target is there."""
    df.write.format(fmt).mode("ignore" if skip_if_exists else "overwrite").save(uri)


def load_dataset(
    spark: SparkSession, path: str, table: str, format: str | None = None,
    schema_json: str | None = None, mode: str = "truncate",
    csv_options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Load files into a table.

    The format comes from the extension unless given; in a folder from that of most files (of equal
    numbers the first by name), and only files with it are read. ``schema_json`` is a list of
    ``{name, type}`` or Spark's own JSON; ``mode`` is truncate, append or empty.
    """
    only = None
    if format is None:
        tail = path.rstrip("*").rstrip("/").removesuffix(".gz").rsplit(".", 1)
        ext = tail[-1].lower() if len(tail) == 2 and "/" not in tail[-1] else None
        format = FORMATS.get(ext or "")
        if format is None:
            only = next((e for e in _listing(spark, path) if e in FORMATS), None)
            format = FORMATS[only] if only else "csv"
    reader = spark.read.format(format)
    if only:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{only}*")
    if schema_json:
        reader = reader.schema(_schema_of(schema_json))
    elif format == "csv":
        reader = reader.option("inferSchema", "true")
    if format == "csv":
        reader = reader.options(**{"header": "true", **(csv_options or {})})
    reader.load(path).write.mode(DISPOSITIONS.get(mode.lower(), mode)).saveAsTable(table)
    return spark.table(table)


# Warehouse type names and their Spark types.
WAREHOUSE_TYPES = {
    "STRING": "string", "INT64": "bigint", "INTEGER": "bigint", "FLOAT64": "double",
    "FLOAT": "double", "BOOL": "boolean", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp",
    "DATETIME": "timestamp_ntz", "DATE": "date", "NUMERIC": "decimal(38,9)", "JSON": "string",
    "BYTES": "binary",
}


def _schema_of(text: str) -> T.StructType:
    spec = json.loads(text)
    if isinstance(spec, dict):
        return T.StructType.fromJson(spec)
    return T.StructType.fromDDL(
        ", ".join(
            f"`{f['name']}` {WAREHOUSE_TYPES.get(f['type'].upper(), f['type'])}" for f in spec
        )
    )


FILE_BYTES = 256 << 20  # bytes of rows, before compression, that go into one file
RANGES = 64  # ranges that are sampled whatever the size of the table


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: its texts as they are, eight for anything else."""
    sizes = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8)
        for f in df.schema.fields
    ]
    return sum(sizes[1:], sizes[0]).cast("long")


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def write_table(
    df: DataFrame, path: str, partition_ts: str, cluster: Sequence[str] = (),
    mode: str = "overwrite", salt: int | None = None, file_bytes: int = FILE_BYTES,
) -> None:
    """Day partitions, rows clustered inside their files.

    Bytes are measured per (day, cluster) first, in one map-side combined pass; only those with more than ``file_bytes``
    are spread over as many files as that asks for, by a hash of the row, and no two of a day meet in a task. There are at
    most as many of them as the table has multiples of ``file_bytes``, and Spark broadcasts them only where they are known
    to be few. ``salt`` spreads every one by that number instead.
    """
    out = df.withColumn("dt", F.to_date(F.col(partition_ts)))
    names = ["dt", *cluster]
    keys: list[Column] = [F.col(c) for c in names]
    dealt = None
    if salt is None:
        part = F.ceil(F.sum(_bytes(df)) / F.lit(file_bytes)).cast("int").alias("__parts")
        heavy = out.groupBy(*names).agg(part).where("__parts > 1")
        # A row per file that is larger than the rest: their numbers, one after another.
        first = F.sum("__parts").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1))
        heavy = cut_lineage(heavy.withColumn("__first", F.coalesce(first, F.lit(0)).cast("int")))
        same = reduce(lambda x, y: x & y, [F.col(f"o.{c}").eqNullSafe(F.col(f"h.{c}")) for c in names])
        # A task writes one file a day, so as many tasks as the fullest day has files take them all in turns.
        full = heavy.groupBy("dt").agg(F.sum("__parts").alias("n")).agg(F.max("n")).first()[0]
        if full:
            rest = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            joined = out.alias("o").join(heavy.alias("h"), same, "left").select("o.*", "h.__parts", "h.__first")
            spread = F.pmod(F.col("__first") + F.pmod(_row_hash(df), F.col("__parts")), F.lit(full))
            place = F.coalesce(spread, F.lit(full) + F.pmod(F.hash(*names), F.lit(rest))).cast("int")
            dealt = joined.withColumn("__place", place).repartitionById(full + rest, "__place")
    elif salt > 1:
        keys.append(F.pmod(_row_hash(df), F.lit(salt)))
    ordered = (out.repartition(*keys) if dealt is None else dealt).sortWithinPartitions(*names, partition_ts)
    ordered.select(*df.columns, "dt").write.mode(mode).partitionBy("dt").parquet(path)


def write_shards(
    df: DataFrame, path: str, n: int | None = None, ts: str = "ts", manifest: Mapping | None = None,
    split: str | None = None, tie: Sequence[str] = (), file_bytes: int = FILE_BYTES,
) -> dict:
    """Time-ordered compressed shards (per split) and a manifest next to them.

    Rows and bytes are measured in one pass over the table; without ``n`` there are as many shards as give each
    about ``file_bytes``, 16 at least. Spark's sampled ranges make them about equal as long as they are few; of smaller files a range of about
    ``FILE_BYTES`` holds many, one after another, as samples and tasks must not grow with the number of files. ``tie`` orders rows of the same time.
    """
    name = F.col(split).cast("string") if split else F.lit("all")
    sizes = df.groupBy(name.alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.sum(_bytes(df)).alias("bytes")).collect()
    n = n or max(16, -(-sum(r.bytes for r in sizes) // file_bytes))
    ranges = min(n, max(RANGES, -(-sum(r.bytes for r in sizes) // FILE_BYTES)))
    order = [c for c in (split, ts, *tie) if c]
    writer = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "gzip")
    if ranges < n:
        writer = writer.option("maxRecordsPerFile", -(-sum(r.rows for r in sizes) // n))
    (writer.partitionBy(split) if split else writer).parquet(path)
    counts = {str(r.split): r.rows for r in sizes} or {"all": 0}
    body = {"rows": counts, "columns": df.columns, "shards": n, **(manifest or {})}
    _write_text(df.sparkSession, f"{path.rstrip('/')}_manifest", json.dumps(body))
    return body


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> dict:
    """Predictions with a row-count file; ``_SUCCESS`` marks a finished write.

    Rows are counted while they are written.
    """
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt).mode("overwrite")
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)
    body = {"rows": seen.get["rows"], "columns": df.columns}
    _write_text(df.sparkSession, f"{path.rstrip('/')}_metadata", json.dumps(body))
    return body


def dedup_candles(raw: DataFrame) -> DataFrame:
    """One candle per (symbol, interval, open time), the first delivered, in time order.

    ``raw`` has the candle as ``map<string, string>`` in ``candle`` (its keys differ only by case)
    and the order of delivery in ``seq``.
    """
    field = lambda k: F.col("candle")[k]
    # Short names in the files.
    names = {"o": "open", "c": "close", "l": "low", "h": "high", "v": "volume"}
    flat = raw.select(
        field("s").alias("symbol"), field("i").alias("interval"),
        field("t").try_cast("long").alias("t"), field("T").try_cast("long").alias("close_ms"),
        *[field(k).try_cast("double").alias(n) for k, n in names.items()],
        field("n").try_cast("long").alias("trades"), "seq",
    )
    rest = ["close_ms", *names.values(), "trades"]
    first = flat.groupBy("symbol", "interval", "t").agg(F.min(F.struct("seq", *rest)).alias("r"))
    at = lambda c: F.timestamp_millis(F.col(c)).cast("timestamp_ntz")
    return first.select(
        "symbol", "interval", at("t").alias("ts"), at("r.close_ms").alias("close_ts"),
        *[f"r.{c}" for c in rest[1:]],
    ).orderBy("symbol", "interval", "ts")


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Candle chunks, a JSON array of candles per file."""
    files = spark.read.option("wholetext", "true").text(path)
    candles = F.from_json("value", "array<map<string, string>>")
    raw = files.select(
        F.col("_metadata.file_path").alias("f"), F.posexplode(candles).alias("pos", "candle")
    )
    return dedup_candles(raw.select("candle", F.struct("f", "pos").alias("seq")))


def fills_between(
    raw: DataFrame, coin: str, start_ms: int, end_ms: int | None = None
) -> DataFrame:
    rows = raw.where((F.col("coin") == coin) & (F.col("time") >= start_ms))
    if end_ms is not None:
        rows = rows.where(F.col("time") <= end_ms)
    return rows.orderBy("time")


def read_fills(
    spark: SparkSession, path: str, coin: str, start_ms: int, end_ms: int | None = None
) -> DataFrame:
    """Fills of one coin in a time range, in time order."""
    return fills_between(
        spark.read.schema(schemas.FILL).json(path, multiLine=True), coin, start_ms, end_ms
    )


def read_session_reports(spark: SparkSession, path: str, ids: Sequence[str] | None = None) -> DataFrame:
    """One JSON report per session, in a file or folder ``report_<session>``; corrupt files are skipped, defaults filled in."""
    bad = "_corrupt"
    schema = T.StructType([*schemas.SESSION_REPORT.fields, T.StructField(bad, T.StringType())])
    raw = spark.read.schema(schema).json(
        path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=bad
    )
    sid = F.regexp_extract(F.col("_metadata.file_path"), r"report_([^/]+?)(?:\.json)?(?:/[^/]*)?$", 1)
    rows = raw.withColumn("session_id", sid)
    if ids is not None:
        wanted = spark.createDataFrame([(i,) for i in ids], "session_id string")
        rows = rows.join(F.broadcast(wanted), "session_id", "left_semi")
    good = rows.where(F.col(bad).isNull()).dropna(subset=["symbol", "threshold", "sl_pct", "tp_pct"])
    # Defaults of optional fields.
    return good.fillna(
        {"trail_pct": 0.5, "position_size_usd": 100.0, "leverage": 10.0, "duration_seconds": 0.0,
         "tick_count": 0, "signal_count": 0, "dc_event_count": 0}
    ).withColumn("signals", F.coalesce("signals", F.array().cast(schema["signals"].dataType))).drop(bad)


def flatten_leaderboard(rows: DataFrame) -> DataFrame:
    """Leaderboard rows with ``windowPerformances: [[window, {pnl, roi, vlm}]]`` made flat.

    Numbers that do not parse become null, and rows with a null in a needed column are dropped.
    """
    perf = "struct<pnl: string, roi: string, vlm: string>"
    by_window = F.map_from_entries(
        F.transform(
            "windowPerformances", lambda p: F.struct(p[0], F.from_json(p[1], perf))
        )
    )
    out = rows.withColumn("w", by_window)
    number = lambda w, m: F.col("w")[w][m].try_cast("double").alias(f"{m}_{w}")
    flat = out.select(
        F.col("ethAddress").alias("address"), F.col("displayName").alias("display_name"),
        F.col("accountValue").try_cast("double").alias("account_value"),
        *[number(w, m) for m in ("roi", "pnl", "vlm") for w in ("day", "week", "month", "allTime")],
    )
    return flat.dropna(
        subset=["address", "account_value", "roi_month", "roi_allTime", "vlm_month",
                "pnl_allTime", "pnl_month"]
    )


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """A document ``{leaderboardRows: [...]}`` or one row per line."""
    row = schemas.LEADER_ROW
    doc = T.StructType([T.StructField("leaderboardRows", T.ArrayType(row)), *row.fields])
    raw = spark.read.schema(doc).json(path, multiLine=path.endswith(".json"))
    nested = raw.where("leaderboardRows is not null").select(
        F.explode("leaderboardRows").alias("r")
    ).select("r.*")
    flat = raw.where("leaderboardRows is null").select(*row.names)
    return flatten_leaderboard(nested.unionByName(flat))


def render_query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """SQL text with named markers (``:name``, ``IDENTIFIER(:table)``)."""
    return spark.sql(sql, args=params)


def render_file(spark: SparkSession, path: str, **params) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return render_query(spark, f.read(), **params)


def split_by_cutoffs(
    df: DataFrame, ts: str, train_end: str, val_end: str, test_start: str,
    val_start: str | None = None,
) -> DataFrame:
    """The split of each row by cutoff times (ends inclusive); other rows are left out.

    A row that more than one split would take goes to the earliest of them.
    Write the result with ``partitionBy("split")``.
    """
    t = F.col(ts)
    at = lambda x: F.lit(x).cast(df.schema[ts].dataType)
    split = (
        F.when(t <= at(train_end), "train")
        .when((t >= at(val_start or train_end)) & (t <= at(val_end)), "val")
        .when(t >= at(test_start), "test")
    )
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def sample_index(df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    return row_index(df, Timeline.of(by, ts, tie), "sample_index")
