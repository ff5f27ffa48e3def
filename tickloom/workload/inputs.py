"""Domain tables derived from the given tables, in Spark and, for the checks, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.timeline import Timeline, running, total_so_far
from tickloom.operators.trades import leg_pnl
from tickloom.workload.registry import Tables

THRESHOLDS = [(0.1, 0.1), (0.3, 0.3), (0.5, 0.5)]
SPAN = "7 days"

TICKS = "ticks AS (SELECT event_type AS symbol, ts, value + 50 AS price, event_id FROM events)"

# A walk between 100 and 140 in steps of at most 0.12, so that thresholds of some thousandths mean something. Whole numbers up
# to the last division, so two engines agree.
WALK = """ticks AS (SELECT symbol, ts, event_id, 100 + abs((c % 4000 + 4000) % 4000 - 2000) / 50.0::DOUBLE AS price FROM (
  SELECT event_type AS symbol, ts, event_id, sum((event_id * 7919) % 13 - 6) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS c FROM events))"""


def walk(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("symbol"), "ts", "event_id")
    tl = Timeline.of("symbol", "ts", "event_id", SPAN)
    steps = running(rows, tl, c=total_so_far(F.col("event_id") * 7919 % 13 - 6))
    return steps.select("symbol", "ts", (F.abs(F.pmod("c", F.lit(4000)) - 2000) / F.lit(50.0) + 100).alias("price"), "event_id")


SENSORS = """sensors AS (SELECT event_type AS symbol, ts, event_id,
  CASE WHEN value > 20 THEN 1 ELSE -1 END AS direction, value / 100 AS tmv FROM events)"""


def sensors(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("symbol"), "ts", "event_id",
        F.when(F.col("value") > 20, 1).otherwise(-1).alias("direction"),
        (F.col("value") / 100).alias("tmv"),
    )


RAW = """raw AS (
  SELECT event_type AS market, 'I' || (user_id % 10) AS instrument, event_id::VARCHAR AS trade_id,
    ts, value + 50 AS price, (1 + event_id % 5)::DOUBLE AS vol_base,
    (1 + event_id % 5) * (value + 50) AS vol_quote,
    CASE event_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'sell' ELSE 'other' END AS side,
    ts + INTERVAL 1 MINUTE + copy * INTERVAL 1 SECOND AS load_time
  FROM events, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR event_id % 7 = 0)"""


def raw_trades(t: Tables) -> DataFrame:
    """Raw snapshots with every seventh trade delivered twice."""
    e = t.events
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    copies = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    rows = e.withColumn("copy", F.explode(copies))
    price, qty = F.col("value") + 50, (F.lit(1) + F.col("event_id") % 5).cast("double")
    side = (
        F.when(F.col("event_id") % 3 == 0, "BUY")
        .when(F.col("event_id") % 3 == 1, "sell")
        .otherwise("other")
    )
    load = F.timestamp_micros(us + 60_000_000 + F.col("copy") * 1_000_000).cast("timestamp_ntz")
    return rows.select(
        F.col("event_type").alias("MARKET"),
        F.concat(F.lit("I"), (F.col("user_id") % 10).cast("string")).alias("INSTRUMENT"),
        F.col("event_id").alias("LAST_PROCESSED_TRADE_CCSEQ"),
        F.floor(us / 1_000_000).cast("long").alias("LAST_PROCESSED_TRADE_TS"),
        ((us % 1_000_000) * 1000 + 7).alias("LAST_PROCESSED_TRADE_TS_NS"),
        price.alias("LAST_PROCESSED_TRADE_PRICE"),
        qty.alias("LAST_PROCESSED_TRADE_QUANTITY"),
        (qty * price).alias("LAST_PROCESSED_TRADE_QUOTE_QUANTITY"),
        side.alias("LAST_PROCESSED_TRADE_SIDE"),
        load.alias("LOAD_TIME"),
    )


TRADES = """trade_base AS (
  SELECT o_orderpriority AS symbol, o_orderkey AS id, o_orderdate AS entry_time,
    o_orderdate + (o_orderkey % 48) * INTERVAL 1 HOUR AS exit_time,
    CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
    (100 + o_custkey % 50)::DOUBLE AS entry_price,
    (100 + o_custkey % 50) * (1 + ((o_orderkey * 7919) % 41 - 20) / 1000.0::DOUBLE) AS exit_price,
    (1 + o_orderkey % 4)::DOUBLE AS size,
    CASE o_orderkey % 3 WHEN 0 THEN 'trailing_stop_loss' WHEN 1 THEN 'take_profit'
      ELSE 'reversal_close' END AS reason,
    (o_orderkey % 11) / 1000.0::DOUBLE AS mfe_pct, (o_orderkey % 13) / 1000.0::DOUBLE AS mae_pct
  FROM orders),
trade_pnl AS (
  SELECT *, (CASE side WHEN 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END)
      / entry_price AS pnl_pct,
    entry_price * size * 0.00035::DOUBLE AS entry_fee, exit_price * size * 0.00035::DOUBLE AS exit_fee
  FROM trade_base),
trades AS (
  SELECT *, pnl_pct * (entry_price * size) AS pnl_usd, entry_fee + exit_fee AS total_fees,
    pnl_pct * (entry_price * size) - (entry_fee + exit_fee) AS net_pnl_usd FROM trade_pnl)"""


def trades(t: Tables) -> DataFrame:
    """A closed-trade ledger: one trade per order."""
    k = F.col("o_orderkey")
    entry = (F.lit(100) + F.col("o_custkey") % 50).cast("double")
    hours = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (k % 48) * 3_600_000_000
    base = t.orders.select(
        F.col("o_orderpriority").alias("symbol"),
        k.alias("id"),
        F.col("o_orderdate").alias("entry_time"),
        F.timestamp_micros(hours).cast("timestamp_ntz").alias("exit_time"),
        F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
        entry.alias("entry_price"),
        (entry * (F.lit(1) + ((k * 7919) % 41 - 20) / F.lit(1000.0))).alias("exit_price"),
        (F.lit(1) + k % 4).cast("double").alias("size"),
        F.when(k % 3 == 0, "trailing_stop_loss")
        .when(k % 3 == 1, "take_profit")
        .otherwise("reversal_close")
        .alias("reason"),
        ((k % 11) / F.lit(1000.0)).alias("mfe_pct"),
        ((k % 13) / F.lit(1000.0)).alias("mae_pct"),
    )
    return leg_pnl(base)


FILLS = """fills AS (
  SELECT user_id AS wallet, event_type AS coin, event_id AS oid, epoch_us(ts) // 1000 AS time,
    (['Open Long', 'Open Long', 'Close Long', 'Open Short', 'Close Short', 'Long > Short',
      'Short > Long'])[1 + (event_id % 7)::INT] AS dir,
    value + 50 AS px, (1 + event_id % 3)::DOUBLE AS sz,
    CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE (1 + event_id % 2)::DOUBLE END AS start_pos
  FROM events)"""


def fills(t: Tables) -> DataFrame:
    """Fills per wallet and coin; deliberately not consistent, so every rule is exercised."""
    k = F.col("event_id")
    kinds = [
        "Open Long", "Open Long", "Close Long", "Open Short", "Close Short", "Long > Short",
        "Short > Long",
    ]
    start = F.when(k % 5 == 0, 0.0).otherwise((F.lit(1) + k % 2).cast("double"))
    return t.events.select(
        F.col("user_id").alias("wallet"), F.col("event_type").alias("coin"), k.alias("oid"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
        F.get(F.array(*[F.lit(x) for x in kinds]), (k % 7).cast("int")).alias("dir"),
        (F.col("value") + 50).cast("string").alias("px"),
        (F.lit(1) + k % 3).cast("string").alias("sz"),
        start.cast("string").alias("startPosition"),
    )


PREDS = """preds AS (
  SELECT event_type AS model, event_id AS sample_index, value AS y_true,
    value * (1 + ((user_id % 21) - 10) / 100.0::DOUBLE) AS y_pred, user_id * 0.2::DOUBLE AS reference_price
  FROM events)"""


def preds(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("model"), F.col("event_id").alias("sample_index"),
        F.col("value").alias("y_true"),
        (F.col("value") * (F.lit(1) + ((F.col("user_id") % 21) - 10) / F.lit(100.0))).alias("y_pred"),
        (F.col("user_id") * F.lit(0.2)).alias("reference_price"),
    )


ARMS = """arms AS (
  SELECT l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS sample_index, 0 AS arm,
    l_extendedprice AS y_true, l_partkey, l_suppkey FROM lineitem)"""

FUNDING = """funding AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS ts,
    ((max(o_orderkey) % 100) - 40) / 1e6 AS rate, (100 + max(o_orderkey) % 50)::DOUBLE AS mark_price,
    (100 + min(o_orderkey) % 50)::DOUBLE AS oracle_price
  FROM orders GROUP BY ALL)"""


def funding(t: Tables) -> DataFrame:
    hi, lo = F.max("o_orderkey"), F.min("o_orderkey")
    return t.orders.groupBy(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts")
    ).agg(
        ((hi % 100 - 40) / F.lit(1e6)).alias("rate"),
        (F.lit(100) + hi % 50).cast("double").alias("mark_price"),
        (F.lit(100) + lo % 50).cast("double").alias("oracle_price"),
    )


# Multiplier, modulus and offset of the made-up ROI of each window.
ROI = {"day": (37, 41, 10), "week": (53, 61, 15), "month": (71, 81, 20), "allTime": (97, 301, 50)}


def _leader_sql() -> str:
    roi = ", ".join(
        f"((c_custkey * {a}) % {m} - {o}) / 100.0::DOUBLE AS roi_{w}" for w, (a, m, o) in ROI.items()
    )
    pnl = ", ".join(f"roi_{w} * account_value AS pnl_{w}" for w in ROI)
    vlm = ", ".join(f"account_value * (20 + c_custkey % 300) AS vlm_{w}" for w in ROI)
    return f"""leader_base AS (
  SELECT c_custkey, c_name AS address, 100000 + c_acctbal * 100 AS account_value, {roi} FROM customer),
leaders AS (SELECT address, account_value, roi_day, roi_week, roi_month, roi_allTime, {pnl}, {vlm}
  FROM leader_base)"""


LEADERS = _leader_sql()


def leaders(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    base = t.customer.select(
        k, F.col("c_name").alias("address"),
        (F.lit(100000) + F.col("c_acctbal") * 100).alias("account_value"),
        *[((k * a % m - o) / F.lit(100.0)).alias(f"roi_{w}") for w, (a, m, o) in ROI.items()],
    )
    return base.select(
        "address", "account_value", *[f"roi_{w}" for w in ROI],
        *[(F.col(f"roi_{w}") * F.col("account_value")).alias(f"pnl_{w}") for w in ROI],
        *[(F.col("account_value") * (F.lit(20) + k % 300)).alias(f"vlm_{w}") for w in ROI],
    )


def dc_sql(thresholds=THRESHOLDS, name: str = "dc", ticks: str = TICKS) -> str:
    """The detector as a recursive query, one tick per step, independent of the library's code."""
    pairs = ", ".join(f"({d}::DOUBLE, {u}::DOUBLE)" for d, u in thresholds)
    return f"""{ticks},
seq AS (SELECT symbol, ts, price AS px,
    row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS rn FROM ticks),
thr(td, tu) AS (VALUES {pairs}),
walk AS (
  SELECT symbol, td, tu, 0::BIGINT AS rn, 'none' AS mode,
    NULL::DOUBLE AS hi, NULL::TIMESTAMP AS hi_ts, NULL::DOUBLE AS lo, NULL::TIMESTAMP AS lo_ts,
    NULL::DOUBLE AS an, NULL::TIMESTAMP AS an_ts, NULL::DOUBLE AS ex, NULL::TIMESTAMP AS ex_ts,
    NULL::DOUBLE AS px, NULL::TIMESTAMP AS ts, false AS fall, false AS rise, 'none' AS was,
    NULL::DOUBLE AS p_hi, NULL::TIMESTAMP AS p_hi_ts, NULL::DOUBLE AS p_lo,
    NULL::TIMESTAMP AS p_lo_ts, NULL::DOUBLE AS p_an, NULL::TIMESTAMP AS p_an_ts,
    NULL::DOUBLE AS p_ex, NULL::TIMESTAMP AS p_ex_ts
  FROM (SELECT DISTINCT symbol FROM ticks), thr
  UNION ALL
  SELECT w.symbol, w.td, w.tu, s.rn,
    CASE WHEN f THEN 'down' WHEN r THEN 'up' ELSE w.mode END,
    CASE WHEN f OR r OR w.mode = 'down' THEN NULL WHEN w.hi IS NULL OR s.px > w.hi THEN s.px ELSE w.hi END,
    CASE WHEN f OR r OR w.mode = 'down' THEN NULL WHEN w.hi IS NULL OR s.px > w.hi THEN s.ts ELSE w.hi_ts END,
    CASE WHEN f THEN s.px WHEN r OR w.mode = 'up' THEN NULL WHEN w.lo IS NULL OR s.px < w.lo THEN s.px ELSE w.lo END,
    CASE WHEN f THEN s.ts WHEN r OR w.mode = 'up' THEN NULL WHEN w.lo IS NULL OR s.px < w.lo THEN s.ts ELSE w.lo_ts END,
    CASE WHEN f OR r THEN s.px ELSE w.an END, CASE WHEN f OR r THEN s.ts ELSE w.an_ts END,
    CASE WHEN f OR r OR (w.mode = 'up' AND s.px >= w.ex) OR (w.mode = 'down' AND s.px <= w.ex) THEN s.px ELSE w.ex END,
    CASE WHEN f OR r OR (w.mode = 'up' AND s.px >= w.ex) OR (w.mode = 'down' AND s.px <= w.ex) THEN s.ts ELSE w.ex_ts END,
    s.px, s.ts, f, r, w.mode, w.hi, w.hi_ts, w.lo, w.lo_ts, w.an, w.an_ts, w.ex, w.ex_ts
  FROM (
    SELECT w0.*, s0.rn AS s_rn, s0.px AS s_px,
      coalesce(w0.mode <> 'down' AND w0.hi > s0.px AND w0.hi - s0.px >= w0.hi * w0.td, false) AS f,
      NOT coalesce(w0.mode <> 'down' AND w0.hi > s0.px AND w0.hi - s0.px >= w0.hi * w0.td, false)
        AND coalesce(w0.mode <> 'up' AND w0.lo < s0.px AND s0.px - w0.lo >= w0.lo * w0.tu, false) AS r
    FROM walk w0 JOIN seq s0 ON s0.symbol = w0.symbol AND s0.rn = w0.rn + 1) w
  JOIN seq s ON s.symbol = w.symbol AND s.rn = w.s_rn),
{name} AS (
  SELECT symbol, CASE WHEN fall THEN p_hi_ts ELSE p_lo_ts END AS start_time, ts AS end_time,
    CASE WHEN fall THEN p_hi ELSE p_lo END AS start_price, px AS end_price,
    CASE WHEN fall THEN 'PDCC_Down' ELSE 'PDCC2_UP' END AS event_type,
    td AS threshold_down, tu AS threshold_up, 0.0::DOUBLE AS max_osv
  FROM walk WHERE fall OR rise
  UNION ALL
  SELECT symbol, p_an_ts, p_ex_ts, p_an, p_ex,
    CASE WHEN fall THEN 'OSV_Up' ELSE 'OSV_Down' END, td, tu,
    greatest(CASE WHEN fall THEN (p_ex - p_an) / (p_an * tu) ELSE (p_an - p_ex) / (p_an * td) END, 0)
  FROM walk WHERE (fall AND was = 'up') OR (rise AND was = 'down'))"""
