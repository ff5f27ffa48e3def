"""Parsing, cleaning and reshaping of raw rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schemas
from tickloom.functions.scalars import (
    coerce_ts,
    decode_client_id,
    haversine_m,
    is_supported_market,
    market_type,
    usable_price,
)

CLIENT_ID_MAGIC = b"COPYBOT1".hex()  # fixed value: first 8 bytes of a mirror order's id


def require(df: DataFrame, cols: Sequence[str], drop_nulls: bool = True) -> DataFrame:
    """P5: fail when columns are missing; drop rows with nulls in them."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.dropna(subset=list(cols)) if drop_nulls else df


def rename(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Physical to logical names; names that are not there are an error."""
    require(df, list(columns), drop_nulls=False)
    return df.withColumnsRenamed(dict(columns))


def clean_events(events: DataFrame) -> DataFrame:
    """P20: only events with both ends."""
    return events.where(F.col("start_time").isNotNull() & F.col("end_time").isNotNull())


def parsed_ticks(
    raw: DataFrame, payload: str = "value", symbol_field: str = "symbol",
    price_field: str = "price", timestamp_field: str = "timestamp",
) -> DataFrame:
    """JSON payloads with symbol, price, ts and, where something is wrong, ``error``."""
    fields = (symbol_field, price_field, timestamp_field)
    kind = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    text = F.col(payload).cast("string")
    doc = F.from_json(text, kind, {"mode": "PERMISSIVE"})
    rows = raw.withColumn("payload", text).withColumn("__d", doc)
    symbol = F.col("__d")[symbol_field]
    price = F.col("__d")[price_field].try_cast("double")
    ts = coerce_ts(F.col("__d")[timestamp_field]).cast("timestamp_ntz")
    error = (
        F.when(symbol.isNull(), f"missing {symbol_field}")
        .when(~usable_price(price), f"bad {price_field}")
        .when(ts.isNull(), f"bad {timestamp_field}")
    )
    return (
        rows.withColumn("symbol", symbol)
        .withColumn("price", price)
        .withColumn("ts", ts)
        .withColumn("error", error)
        .drop("__d")
    )


def parse_ticks(raw: DataFrame, payload: str = "value", **fields: str):
    """(ticks, errors): good rows, and ``{error, payload}`` for the rest."""
    rows = parsed_ticks(raw, payload, **fields)
    ticks = rows.where(F.col("error").isNull()).drop("error", "payload")
    return ticks, rows.where(F.col("error").isNotNull()).select("error", "payload")


def recency_window(
    df: DataFrame, ts: str, now: str | None = None, months: tuple[int, int] = (3, 2)
) -> DataFrame:
    """P10: rows dated between 3 and 2 months before ``now`` (the current time when empty)."""
    at = F.coalesce(F.nullif(F.lit(now or ""), F.lit("")).cast("timestamp"), F.current_timestamp())
    day = at.cast("date")
    return df.where(
        F.col(ts)
        .cast("date")
        .between(F.add_months(day, -months[0]), F.add_months(day, -months[1]))
    )


def trip_features(df: DataFrame, target: str | None = "total_fare") -> DataFrame:
    """Model inputs per trip; missing or zero durations become the mean of the input."""
    mean = df.agg(F.round(F.avg("trip_seconds")).cast("long").alias("__mean"))
    t = df.crossJoin(F.broadcast(mean))
    seconds = F.col("trip_seconds")
    fixed = F.when(seconds.isNull() | (seconds <= 0), F.col("__mean")).otherwise(seconds)
    needed = (
        "fare", "trip_start_timestamp", "pickup_longitude", "pickup_latitude",
        "dropoff_longitude", "dropoff_latitude", "payment_type", "company",
    )
    rows = t.dropna(subset=list(needed)).where(
        (F.col("trip_miles") > 0) & (F.col("fare") > 0) & (F.col("fare") < 1500)
    )
    start = F.col("trip_start_timestamp")
    out = [
        F.dayofweek(start).cast("double").alias("dayofweek"),
        F.hour(start).cast("double").alias("hourofday"),
        haversine_m(
            F.col("pickup_longitude"), F.col("pickup_latitude"),
            F.col("dropoff_longitude"), F.col("dropoff_latitude"),
        ).alias("trip_distance"),
        F.col("trip_miles"),
        fixed.cast("double").alias("trip_seconds"),
        F.col("payment_type"),
        F.col("company"),
    ]
    if target:
        out.append(
            (F.col("fare") + F.col("tips") + F.col("tolls") + F.col("extras")).alias(target)
        )
    return rows.select(*out)


# --- telemetry -------------------------------------------------------------------------------


def _typed(doc: Column, field: T.StructField) -> Column:
    """A payload field if there, else the envelope's; payload wins a name clash."""
    path = f"$.{field.name}"
    value = F.coalesce(
        F.get_json_object(F.get_json_object(doc, "$.payload"), path), F.get_json_object(doc, path)
    )
    if isinstance(field.dataType, T.TimestampType):
        return coerce_ts(value).alias(field.name)
    return value.try_cast(field.dataType).alias(field.name)


def flatten_telemetry(df: DataFrame, line: str = "value") -> dict[str, DataFrame]:
    """NDJSON event lines to one typed table per kind, ``misc`` for unknown kinds.

    Routing uses the envelope's event type; the stored ``event_type`` may be the payload's own.
    """
    routes = F.create_map(
        *[F.lit(x) for pair in schemas.TELEMETRY_ROUTES.items() for x in pair]
    )
    doc = F.col(line)
    kind = F.get_json_object(doc, "$.event_type")
    routed = df.withColumn("__table", F.coalesce(routes[kind], F.lit("misc")))
    out = {
        name: routed.where(F.col("__table") == name).select(*[_typed(doc, f) for f in schema])
        for name, schema in schemas.TELEMETRY.items()
    }
    out["misc"] = routed.where(F.col("__table") == "misc").select(
        kind.alias("event_type"), doc.alias("line")
    )
    return out


# --- order and fill messages -----------------------------------------------------------------

ORDER_UPDATES = (
    "channel string, data array<struct<order: struct<coin: string, side: string, "
    "limitPx: string, sz: string, oid: bigint, cloid: string>, status: string>>"
)
USER_EVENTS = (
    "channel string, data struct<fills: array<struct<coin: string, side: string, px: string, "
    "sz: string, oid: bigint, cloid: string>>, twapHistory: array<struct<state: struct<"
    "coin: string, side: string, sz: string, executedSz: string, executedNtl: string, "
    "minutes: int, reduceOnly: boolean, randomize: boolean, timestamp: bigint>, "
    "status: struct<status: string>>>>"
)


def orders_to_actions(
    messages: DataFrame, mappings: DataFrame, line: str = "value", seq: str = "seq",
    magic: str = CLIENT_ID_MAGIC,
) -> DataFrame:
    """PLACE, CANCEL and FILL rows from order and user channels.

    ``mappings(leader_oid, follower_oid)`` are the orders mirrored already. Own mirror orders are
    left out; PLACE and CANCEL only for orders not mirrored yet, FILL only for mirrored ones.
    """
    channel = F.get_json_object(F.col(line), "$.channel")
    known = mappings.select(F.col("leader_oid")).distinct()
    mine = mappings.select(F.col("follower_oid").alias("leader_oid")).distinct()

    orders = (
        messages.where(channel == "orderUpdates")
        .select(seq, F.posexplode(F.from_json(F.col(line), ORDER_UPDATES)["data"]).alias("pos", "u"))
        .select(seq, "pos", "u.order.*", "u.status")
        .withColumnRenamed("oid", "leader_oid")
    )
    usable = is_supported_market(F.col("coin")) & F.col("leader_oid").isNotNull() & decode_client_id(
        F.coalesce("cloid", F.lit("")), magic
    ).isNull()
    fresh = orders.where(usable).join(known, "leader_oid", "left_anti")
    price = F.col("limitPx").try_cast("double")
    blank = F.lit(None).cast("double")
    actions = fresh.where(
        ((F.col("status") == "open") & price.isNotNull()) | (F.col("status") == "canceled")
    ).select(
        seq, "pos",
        F.when(F.col("status") == "open", "PLACE").otherwise("CANCEL").alias("action"),
        "leader_oid", "coin",
        F.when(F.col("status") == "open", F.col("side")).alias("side"),
        F.when(F.col("status") == "open", price).alias("limit_px"),
        blank.alias("fill_sz"), blank.alias("fill_px"),
    )
    fills = (
        messages.where(channel.isin("user", "userEvents"))
        .select(
            seq,
            F.posexplode(F.from_json(F.col(line), USER_EVENTS)["data"]["fills"]).alias("pos", "f"),
        )
        .select(seq, "pos", "f.*")
        .withColumnRenamed("oid", "leader_oid")
        .where(usable)
        .join(mine, "leader_oid", "left_anti")
        .join(known, "leader_oid", "left_semi")
    )
    sz, px = F.col("sz").try_cast("double"), F.col("px").try_cast("double")
    filled = fills.where(sz.isNotNull() & px.isNotNull()).select(
        seq, "pos", F.lit("FILL").alias("action"), "leader_oid", "coin", "side",
        blank.alias("limit_px"), sz.alias("fill_sz"), px.alias("fill_px"),
    )
    return actions.unionByName(filled)


def twap_events(messages: DataFrame, line: str = "value", seq: str = "seq") -> DataFrame:
    """One row per TWAP status; repeated activations of one order appear once.

    The first activation is a map-side combined minimum per composite id.
    """
    rows = (
        messages.where(F.get_json_object(F.col(line), "$.channel").isin("user", "userEvents"))
        .select(
            seq,
            F.posexplode(
                F.from_json(F.col(line), USER_EVENTS)["data"]["twapHistory"]
            ).alias("pos", "t"),
        )
        .select(seq, "pos", "t.state.*", F.col("t.status.status").alias("status"))
        .where(is_supported_market(F.col("coin")))
    )
    text = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d))
    out = rows.select(
        F.concat_ws(
            "_", "coin", "side", text("minutes", "1"), text("randomize", "false"), text("sz", "0")
        ).alias("twap_id"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        "coin",
        market_type(F.col("coin")).alias("market_type"),
        F.when(F.col("side") == "B", "BUY").otherwise("SELL").alias("side"),
        F.col("sz").try_cast("double").alias("size"),
        F.coalesce(F.col("executedSz").try_cast("double"), F.lit(0.0)).alias("executed_size"),
        F.coalesce(F.col("executedNtl").try_cast("double"), F.lit(0.0)).alias("executed_notional"),
        "minutes",
        F.coalesce("reduceOnly", F.lit(False)).alias("reduce_only"),
        F.coalesce("randomize", F.lit(False)).alias("randomize"),
        seq,
        "pos",
    )
    rest = [c for c in out.columns if c not in ("twap_id", seq, "pos")]
    first = (
        out.where("status = 'activated'")
        .groupBy("twap_id")
        .agg(F.min(F.struct(seq, "pos", *rest)).alias("r"))
        .select("twap_id", "r.*")
    )
    return out.where("status <> 'activated'").unionByName(first)


def round_to_venue(orders: DataFrame, meta: DataFrame) -> DataFrame:
    """Sizes and prices as the venue accepts them.

    ``orders(coin, size, price, is_buy)``, ``meta(coin, sz_decimals, is_spot)``. Sizes are cut to
    ``sz_decimals``. Prices take the most decimals (at most 8 spot / 6 perpetual minus
    ``sz_decimals``) that leave five significant digits, rounding down for buys and up for sells;
    whole numbers are always allowed. A size or price that is not positive gets ``error``.
    """
    o = orders.join(meta, "coin", "left")
    size, price = F.col("size").cast("decimal(28,10)"), F.col("price").cast("decimal(28,10)")
    cap = F.greatest(
        F.when(F.col("is_spot"), 8).otherwise(6) - F.col("sz_decimals"), F.lit(0)
    )
    tens = [F.lit(str(10**d)).cast("decimal(10,0)") for d in range(9)]
    candidates = []
    for d in range(9):
        down = F.floor(price * tens[d])
        up = F.ceil(price * tens[d])
        digits = F.when(F.col("is_buy"), down).otherwise(up).cast("decimal(28,0)")
        value = (digits / tens[d]).cast("decimal(28,10)")
        significant = F.length(
            F.regexp_replace(digits.cast("string"), "0+$", "")
        )
        whole = digits % tens[d] == 0
        candidates.append(
            F.when((F.lit(d) <= cap) & (whole | (significant <= 5)), value)
        )
    rounded = F.coalesce(*reversed(candidates))
    cut = F.coalesce(
        *[F.when(F.col("sz_decimals") == d, F.floor(size * tens[d]) / tens[d]) for d in range(9)]
    ).cast("decimal(28,10)")
    out = o.withColumn("order_size", cut.cast("double")).withColumn(
        "order_price", rounded.cast("double")
    )
    error = (
        F.when(F.col("sz_decimals").isNull(), "unknown market")
        .when(F.col("size") <= 0, "size not positive")
        .when(F.col("order_size") <= 0, "size rounds to zero")
        .when(F.col("price") <= 0, "price not positive")
    )
    return out.withColumn("error", error)
