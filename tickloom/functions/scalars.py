"""Column expressions used across operators; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEARS = (-62_135_596_800.0, 253_402_300_799.0)  # epoch seconds of the years 1 to 9999
EARTH_RADIUS_M = 6_371_010.0  # fixed value: mean radius used for great-circle distance


def coerce_ts(col: Column, strict: bool = False) -> Column:
    """Text to ``timestamp``: a number is epoch seconds, anything else ISO text.

    ``Z`` and a trailing `` UTC`` are accepted. Bad input, and a number that is no moment of the years 1
    to 9999, gives null, or an error when strict.
    """
    text = F.trim(col.cast("string"))
    seconds = text.try_cast("double")
    iso = F.regexp_replace(F.regexp_replace(text, r"\s*UTC$", ""), r"Z$", "+00:00")
    parsed = F.coalesce(
        F.timestamp_micros(F.round(F.when(seconds.between(*YEARS), seconds) * 1_000_000).cast("long")),
        iso.try_cast("timestamp"),
    )
    if not strict:
        return parsed
    message = F.concat(F.lit("not a timestamp: "), F.coalesce(text, F.lit("null")))
    return F.when(parsed.isNull(), F.raise_error(message).cast("timestamp")).otherwise(parsed)


def epoch_parts_to_ts(seconds: Column, nanos: Column) -> Column:
    """Epoch seconds plus nanoseconds, cut to microseconds."""
    return F.timestamp_micros(
        seconds.cast("long") * F.lit(1_000_000) + F.floor(nanos / F.lit(1000)).cast("long")
    )


def to_local(ts: Column, tz: str) -> Column:
    """UTC instant to wall-clock time in ``tz``."""
    return F.from_utc_timestamp(ts.cast("timestamp"), tz).cast("timestamp_ntz")


def sign_of_side(side: Column) -> Column:
    upper = F.upper(side)
    return F.when(upper == "BUY", 1).when(upper == "SELL", -1).otherwise(0)


def market_type(coin: Column) -> Column:
    return (
        F.when(coin.isNull() | (coin == ""), F.lit("UNKNOWN"))
        .when(coin.startswith("@") | coin.contains("/"), F.lit("SPOT"))
        .otherwise(F.lit("PERP"))
    )


def is_supported_market(coin: Column) -> Column:
    """A valid spot (``@12`` or ``A/B``) or perpetual symbol."""
    usable = coin.isNotNull() & (coin != "") & (coin != "N/A")
    return usable & F.when(coin.startswith("@"), coin.rlike(r"^@\s*\+?\d+\s*$")).otherwise(
        F.lit(True)
    )


def decode_client_id(raw: Column, magic: str) -> Column:
    """Leader order id inside a 16-byte hex client id whose first 8 bytes are ``magic`` (hex).

    Ids above the signed 64-bit range do not fit a bigint, so the result is ``decimal(20,0)``.
    """
    well_formed = raw.rlike(r"^0x[0-9A-Fa-f]{32}$") & (
        F.lower(F.substring(raw, 3, 16)) == magic.lower()
    )
    return F.when(well_formed, F.conv(F.substring(raw, 19, 16), 16, 10).cast("decimal(20,0)"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -60.0, 60.0)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def pnl_pct(side: Column, entry: Column, exit_: Column) -> Column:
    signed = F.when(side == "LONG", exit_ - entry).otherwise(entry - exit_)
    return signed / entry


def safe_div(a: Column, b: Column, fallback: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(fallback)).otherwise(F.try_divide(a, b))


def usable_price(x: Column) -> Column:
    """Whether a price is a finite number above zero; never null."""
    x = x.cast("double")
    return F.coalesce((x > 0) & (x < F.lit(float("inf"))), F.lit(False))


def zero_if_bad(x: Column) -> Column:
    """Null, NaN and infinities become zero."""
    inf = float("inf")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(inf))
    return F.when(bad, F.lit(0.0)).otherwise(x)
