"""Explicit schemas of every external table. Field names and types."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(),
    "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(text: str) -> T.StructType:
    """Flat ``name type, ...`` text; usable before a session exists."""
    pairs = [f.split() for f in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TICK = _schema(
    "market string, instrument string, trade_id string, ts timestamp_ntz, price double, "
    "vol_base double, vol_quote double, side string, load_time timestamp_ntz"
)
DC_EVENT = _schema(
    "symbol string, start_time timestamp_ntz, end_time timestamp_ntz, start_price double, "
    "end_price double, event_type string, threshold_down double, threshold_up double, "
    "max_osv double"
)
TRADE = _schema(
    "symbol string, side string, entry_price double, exit_price double, size double, "
    "entry_time timestamp_ntz, exit_time timestamp_ntz, pnl_pct double, pnl_usd double, "
    "entry_fee double, exit_fee double, total_fees double, net_pnl_usd double, reason string, "
    "mfe_pct double, mae_pct double"
)
PREDICTION = _schema(
    "model string, sample_index bigint, horizon int, y_true double, y_pred double, "
    "reference_price double"
)
FUNDING = _schema(
    "symbol string, ts timestamp_ntz, rate double, mark_price double, oracle_price double"
)
RAW_TRADE = _schema(
    "MARKET string, INSTRUMENT string, LAST_PROCESSED_TRADE_CCSEQ bigint, "
    "LAST_PROCESSED_TRADE_TS bigint, LAST_PROCESSED_TRADE_TS_NS bigint, "
    "LAST_PROCESSED_TRADE_PRICE double, LAST_PROCESSED_TRADE_QUANTITY double, "
    "LAST_PROCESSED_TRADE_QUOTE_QUANTITY double, LAST_PROCESSED_TRADE_SIDE string, "
    "LOAD_TIME timestamp_ntz"
)
FILL = _schema(
    "coin string, side string, dir string, px string, sz string, time bigint, oid bigint, "
    "closedPnl string, startPosition string, crossed boolean, hash string"
)
SESSION_REPORT = _schema(
    "symbol string, threshold double, sl_pct double, tp_pct double, trail_pct double, "
    "position_size_usd double, leverage double, duration_seconds double, tick_count bigint, "
    "signal_count bigint, dc_event_count bigint"
).add(
    "signals",
    T.ArrayType(
        _schema("timestamp double, type string, price double, size double, reason string")
    ),
)
LEADER_ROW = _schema("ethAddress string, displayName string, accountValue string").add(
    "windowPerformances", T.ArrayType(T.ArrayType(T.StringType()))
)
TICK_MESSAGE = _schema("symbol string, price string, timestamp string")

_ENVELOPE = (
    "timestamp timestamp, session_id string, symbol string, event_type string, bridge_type string"
)

# The seven telemetry tables.
TELEMETRY = {
    "ticks": _schema("timestamp timestamp, session_id string, symbol string, price double"),
    "dc_events": _schema(
        _ENVELOPE + ", start_price double, end_price double, start_time double, "
        "threshold_down double, threshold_up double, is_sensor boolean, score double, "
        "regime string, threshold_key string"
    ),
    "signals": _schema(
        _ENVELOPE + ", signal_type string, price double, size double, reason string, "
        "is_reversal boolean, momentum_score double, regime string"
    ),
    "trades": _schema(
        _ENVELOPE + ", trade_id string, side string, entry_price double, size double, "
        "is_reversal boolean, backstop_sl_pct double, backstop_tp_pct double, "
        "dc_event_type string, dc_start_price double, dc_end_price double, "
        "dc_duration_s double, dc_threshold double, exit_price double, exit_reason string, "
        "sl_at_exit double, tp_at_exit double, max_favorable_excursion_pct double, "
        "max_adverse_excursion_pct double, trade_duration_s double, momentum_score double, "
        "regime string"
    ),
    "fills": _schema(
        _ENVELOPE + ", signal_type string, price double, size double, reason string"
    ),
    "sessions": _schema(
        _ENVELOPE + ", config string, network string, observe_only boolean, leverage bigint, "
        "backstop_sl_pct double, backstop_tp_pct double, duration_seconds double, "
        "tick_count bigint, signal_count bigint, trade_count bigint, dc_event_count bigint, "
        "reconnect_count bigint, sensor_event_count bigint, trade_event_count bigint, "
        "filtered_count bigint, final_momentum_score double, final_regime string, "
        "reconnect_number bigint"
    ),
    "account_snapshots": _schema(
        _ENVELOPE + ", account_value double, margin_used double, withdrawable double"
    ),
}

# Which table each event type goes to.
TELEMETRY_ROUTES = {
    "tick": "ticks",
    "tick_snapshot": "ticks",
    "dc_event": "dc_events",
    "momentum_update": "dc_events",
    "signal": "signals",
    "trade_entry": "trades",
    "trade_exit": "trades",
    "fill": "fills",
    "session_start": "sessions",
    "session_end": "sessions",
    "reconnect": "sessions",
    "account_snapshot": "account_snapshots",
}
