"""Window operators W1-W18, on the chunked timeline primitives."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import sign_of_side
from tickloom.operators.timeline import (
    MICROS,
    Running,
    Timeline,
    count_so_far,
    following,
    last_known,
    max_so_far,
    micros,
    next_known,
    previous,
    range_sums,
    row_index,
    rows_frame,
    running,
    total_so_far,
)


def seconds_between(df: DataFrame, later: str, earlier: Column) -> Column:
    return (micros(df, later) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def dedup_trades(
    df: DataFrame,
    keys: Sequence[str] = ("market", "instrument", "trade_id"),
    order: Sequence[str] = ("ts", "load_time"),
) -> DataFrame:
    """One row per trade, the earliest by (ts, load time).

    A minimum over row structs: copies are dropped on the map side, so a trade repeated any number
    of times is never gathered.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in df.columns])


def tick_flow(
    df: DataFrame, tl: Timeline, price: str = "price", side: str = "side",
    base: str = "vol_base", quote: str = "vol_quote",
) -> DataFrame:
    """W2 and W3 together: returns, durations and cumulative signed volume in one shuffle."""
    signed = df.withColumn("__sgn", sign_of_side(F.col(side)))
    out = running(
        signed, tl,
        __prev=previous(F.struct(F.col(price).alias("p"), F.col(tl.ts).alias("t"))),
        cvd_base=total_so_far(F.col("__sgn") * F.col(base)),
        cvd_quote=total_so_far(F.col("__sgn") * F.col(quote)),
    )
    return _with_deltas(out, tl, price, F.col("__prev.p"), F.col("__prev.t")).drop(
        "__sgn", "__prev"
    )


def _with_deltas(out: DataFrame, tl: Timeline, price: str, prev_p: Column, prev_t: Column):
    ratio = F.try_divide(F.col(price), prev_p)
    return out.withColumn(
        "log_return", F.when(ratio > 0, F.ln(F.when(ratio > 0, ratio)))
    ).withColumn("inter_trade_duration_seconds", seconds_between(out, tl.ts, prev_t))


def tick_deltas(df: DataFrame, tl: Timeline, price: str = "price") -> DataFrame:
    """Log return and seconds since the previous tick of the key."""
    out = running(
        df, tl, __prev=previous(F.struct(F.col(price).alias("p"), F.col(tl.ts).alias("t")))
    )
    return _with_deltas(out, tl, price, F.col("__prev.p"), F.col("__prev.t")).drop("__prev")


def cvd(
    df: DataFrame, tl: Timeline, side: str = "side", base: str = "vol_base", quote: str = "vol_quote"
) -> DataFrame:
    """Cumulative signed volume in base and quote units."""
    sgn = sign_of_side(F.col(side))
    return running(
        df, tl,
        cvd_base=total_so_far(sgn * F.col(base)),
        cvd_quote=total_so_far(sgn * F.col(quote)),
    )


def equity_path(trades: DataFrame, tl: Timeline) -> DataFrame:
    """Running net result and its peak, up to and before each trade (peaks start at zero)."""
    zero = F.lit(0.0)
    cum = running(trades, tl, cum=total_so_far(F.col("net_pnl_usd")))
    out = running(
        cum, tl,
        peak=max_so_far(F.col("cum")),
        peak_before=max_so_far(F.col("cum"), current=False),
        cum_before=previous(F.col("cum")),
    )
    return (
        out.withColumn("peak", F.greatest(zero, F.col("peak")))
        .withColumn("peak_before", F.greatest(zero, F.col("peak_before")))
        .withColumn("cum_before", F.coalesce(F.col("cum_before"), zero))
    )


def drawdown_of() -> Column:
    """Largest fall of the realised curve from its peak (aggregate over ``equity_path``)."""
    return F.max(F.col("peak") - F.col("cum"))


def equity_drawdown_of() -> Column:
    """As above, also testing each trade's worst open moment against the peak before it."""
    worst = -(F.col("mae_pct") * F.col("size") * F.col("entry_price")) - F.col("entry_fee")
    dip = F.col("peak_before") - (F.col("cum_before") + worst)
    after = F.col("peak_before") - F.col("cum")
    return F.max(F.greatest(F.lit(0.0), dip, after))


def max_drawdown(trades: DataFrame, tl: Timeline) -> DataFrame:
    """W4."""
    return equity_path(trades, tl).groupBy(*tl.by).agg(drawdown_of().alias("max_drawdown_usd"))


def equity_drawdown(trades: DataFrame, tl: Timeline) -> DataFrame:
    """W5."""
    return (
        equity_path(trades, tl)
        .groupBy(*tl.by)
        .agg(equity_drawdown_of().alias("max_equity_drawdown_usd"))
    )


def rolling_regime(
    events: DataFrame,
    tl: Timeline,
    direction: str = "direction",
    lookback_s: float = 600,
    choppy_rate: float = 4.0,
    consistency: float = 0.6,
    min_events: int = 3,
    min_span_s: float = 60,
    inclusive: bool = True,
) -> DataFrame:
    """W6 (``inclusive=True``) and W6b (``inclusive=False``): market regime at each event.

    W6 wants a minimum span and tests direction first. W6b leaves out events exactly at the cutoff
    and tests the rate first.
    """
    d = F.col(direction)
    out = range_sums(events, tl, int(lookback_s * 1_000_000), {"__sum": d}, open_left=not inclusive).withColumnRenamed("__n", "regime_events")
    n, span = F.col("regime_events"), (micros(out, tl.ts) - F.col("__first")) / F.lit(1e6)
    steady = F.abs(F.col("__sum")) / n
    if inclusive:
        rate = F.try_divide(n, span / 60.0)
        regime = (
            F.when((n < min_events) | (span < min_span_s), "quiet")
            .when(steady >= consistency, "trending")
            .when(rate > choppy_rate, "choppy")
            .otherwise("neutral")
        )
    else:
        rate = n / F.greatest(span / 60.0, F.lit(0.01))
        regime = (
            F.when(n < min_events, "quiet")
            .when((rate > choppy_rate) & (steady < consistency), "choppy")
            .when(rate > choppy_rate, "trending")
            .otherwise("neutral")
        )
    return (
        out.withColumn("event_rate", rate)
        .withColumn("consistency", steady)
        .withColumn("regime", regime)
        .drop("__first", "__sum")
    )


def trend_bias(
    events: DataFrame,
    tl: Timeline,
    direction: str = "direction",
    tmv: str = "tmv",
    lookback_s: float = 900,
    min_events: int = 5,
    min_consistency: float = 0.6,
    strict: float = 0.8,
    mode: str = "tmv_weighted",
    action: str = "block",
    reduced_size: float = 0.5,
) -> DataFrame:
    """Signed bias, dominant trend, and the size factor each side may trade with."""
    d, m = F.col(direction), F.col(tmv)
    sums = {
        "__d": d, "__dm": d * m, "__m": m,
        "__up": F.when(d > 0, m), "__ups": F.when((d > 0) & m.isNotNull(), 1),
        "__down": F.when(d < 0, m), "__downs": F.when((d < 0) & m.isNotNull(), 1),
    }
    out = range_sums(events, tl, int(lookback_s * 1_000_000), sums).withColumnRenamed("__n", "trend_events")
    out = out.withColumns({f"avg_tmv_{k}": F.coalesce(F.col(f"__{k}") / F.col(f"__{k}s"), F.lit(0.0)) for k in ("up", "down")})
    n = F.col("trend_events")
    weighted = F.when(F.col("__m") == 0, 0.0).otherwise(F.try_divide(F.col("__dm"), F.col("__m")))
    bias = weighted if mode == "tmv_weighted" else F.col("__d") / n
    trend = F.when(n < min_events, None).when(bias >= min_consistency, "up").when(
        bias <= -min_consistency, "down"
    )
    against = {
        "allow": F.lit(1.0),
        "block": F.lit(0.0),
        "reduce": F.when(F.abs(F.col("bias")) >= strict, reduced_size).otherwise(1.0),
    }[action]
    factor = lambda opposing: F.when(F.col("trend") == opposing, against).otherwise(1.0)
    return (
        out.withColumn("bias", bias)
        .withColumn("trend", trend)
        .withColumn("long_size_factor", factor("down"))
        .withColumn("short_size_factor", factor("up"))
        .drop("__first", *sums)
    )


def average_direction(numbered: DataFrame, tl: Timeline, name: str, direction: str = "direction", alpha: float = 0.3) -> DataFrame:
    """Column ``name``: the exponential average of directions from zero, as in ``momentum``; rows have their place in the key in ``__i``."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    x = F.col(direction).cast("double")
    if alpha == 1:
        return numbered.withColumn(name, x)
    fade = -math.log1p(-alpha)
    block = max(1, int(120 * math.log(10) / fade))
    power = lambda n: F.exp(n * F.lit(fade))
    cut = numbered.withColumn("__block", F.floor(F.col("__i") / block)).withColumn("__n", F.col("__i") % block)
    inside = Window.partitionBy(*tl.by, "__block").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("__own", F.sum(x * F.lit(alpha) * power(F.col("__n"))).over(inside) / power(F.col("__n")))
    last = cut.groupBy(*tl.by, "__block").agg(
        (F.sum(x * F.lit(alpha) * power(F.col("__n"))) / power(F.max("__n"))).alias("__before")
    ).withColumn("__block", F.col("__block") + 1)
    carried = F.coalesce(F.col("__before"), F.lit(0.0)) / power(F.col("__n") + 1)
    joined = local.join(last, [*tl.by, "__block"], "left")
    return joined.withColumn(name, F.col("__own") + carried).drop("__block", "__n", "__own", "__before")


def momentum(
    events: DataFrame,
    tl: Timeline,
    direction: str = "direction",
    alpha: float = 0.3,
    rate_lookback_s: float = 300,
    history: int | None = None,
) -> DataFrame:
    """Exponential average of directions from zero, its regime, and recent events per minute.

    Rows are numbered and cut into blocks so long that a row's weight at the end of the next block is
    below ``1e-120``. Inside a block the average is a sum of directions times growing powers, scaled
    back; the block before gives the rest through its last value. The rate counts events
    after ``now - lookback``, of the last ``history`` where it is given.
    """
    scored = average_direction(row_index(events, tl, "__i"), tl, "momentum", direction, alpha)
    out = range_sums(scored, tl, int(rate_lookback_s * 1_000_000), {}, open_left=True)
    recent = F.col("__n")
    if history is not None:
        recent = F.least(recent, F.lit(history))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("momentum")))
    s = F.col("momentum")
    return (
        out.withColumn("momentum", score)
        .withColumn("momentum_rate", recent / F.lit(rate_lookback_s / 60.0))
        .withColumn(
            "momentum_regime",
            F.when(s > 0.5, "trending_up").when(s < -0.5, "trending_down").otherwise("choppy"),
        )
        .drop("__i", "__n", "__first")
    )


def median_of(values: Column) -> Column:
    """Median of a sorted array, interpolated."""
    n = F.size(values)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.ceil((n - 1) / 2).cast("int")
    return (F.get(values, lo) + F.get(values, hi)) / 2.0


def adaptive_tp(
    overshoots: DataFrame,
    tl: Timeline,
    value: str = "overshoot",
    n: int = 20,
    min_samples: int = 5,
    fraction: float = 0.4,
    floor: float = 0.003,
    default: float = 0.005,
) -> DataFrame:
    """Take-profit from the median of the last ``n`` positive overshoots."""
    out = rows_frame(
        overshoots.where(F.col(value) > 0), tl, n - 1, 0,
        lambda w: {"__last": F.collect_list(value).over(w)},
    )
    median = median_of(F.array_sort("__last"))
    return out.withColumn(
        "adaptive_tp",
        F.when(F.size("__last") < min_samples, F.lit(default)).otherwise(
            F.greatest(median * fraction, F.lit(floor))
        ),
    ).drop("__last")


def _streaks(df: DataFrame, tl: Timeline, **conditions: Column) -> DataFrame:
    """Rows since each condition last failed: its current run length (zero when it fails)."""
    counted = running(df, tl, __n=count_so_far())
    last_fail = {
        f"__f_{name}": last_known(F.when(~F.coalesce(cond, F.lit(False)), F.col("__n")))
        for name, cond in conditions.items()
    }
    out = running(counted, tl, **last_fail)
    for name in conditions:
        out = out.withColumn(name, F.col("__n") - F.coalesce(F.col(f"__f_{name}"), F.lit(0)))
    return out.drop("__n", *last_fail)


def loss_streak(
    trades: DataFrame, tl: Timeline, net: str = "net_pnl_usd",
    max_losses: int = 3, base_cooldown_s: float = 300,
) -> DataFrame:
    """Consecutive losses and until when they stop trading (null when they do not)."""
    out = _streaks(trades, tl, consecutive_losses=F.col(net) <= 0)
    streak = F.col("consecutive_losses")
    until = micros(out, tl.ts) + (streak * F.lit(int(base_cooldown_s * 1_000_000)))
    kind = trades.schema[tl.ts].dataType
    return out.withColumn(
        "cooldown_until", F.when(streak >= max_losses, F.timestamp_micros(until).cast(kind))
    )


def funding_streaks(
    obs: DataFrame, tl: Timeline, enter: float, exit_: float, rate: str = "rate",
    window_h: float = 24, notional: float = 1.0,
) -> DataFrame:
    """Runs above entry / below exit, mean rate of the window, APR, cumulative payment."""
    r = F.col(rate)
    runs = _streaks(obs, tl, consecutive_above=r >= enter, consecutive_below=r <= exit_)
    paid = running(runs, tl, cumulative_payment=total_so_far(r * F.lit(notional)))
    out = range_sums(paid, tl, int(window_h * 3600 * 1_000_000), {"__sum": r, "__known": F.when(r.isNotNull(), 1)})
    out = out.withColumn("mean_rate", F.col("__sum") / F.col("__known")).drop("__n", "__first", "__sum", "__known")
    return out.withColumn("apr_pct", r * 24 * 365 * 100)


def alternation_overshoot(events: DataFrame, tl: Timeline) -> DataFrame:
    """Relative move between consecutive opposite confirmations, null otherwise."""
    return _alternation(events, tl).drop("__at")


def _alternation(events: DataFrame, tl: Timeline) -> DataFrame:
    out = running(
        events, tl,
        __prev=previous(F.struct("end_price", "event_type")),
        __at=count_so_far(current=False),
    ).withColumn("__at", F.coalesce("__at", F.lit(0).cast("long")))
    move = F.abs(F.col("end_price") - F.col("__prev.end_price")) / F.col("__prev.end_price")
    flipped = F.col("event_type") != F.col("__prev.event_type")
    return out.withColumn("overshoot", F.when(flipped, move)).drop("__prev")


def tick_context(ticks: DataFrame, tl: Timeline, price: str = "price", n: int = 60) -> DataFrame:
    """Tick part of W13: range, mean, trend and the latest prices of the last ``n`` ticks."""
    p = F.col(price)
    out = rows_frame(
        ticks, tl, n - 1, 0,
        lambda w: {
            "price_high": F.max(p).over(w),
            "price_low": F.min(p).over(w),
            "price_mean": F.avg(p).over(w),
            "__first": F.first(p).over(w),
            "tick_count": F.count(p).over(w),
            "recent_prices": F.collect_list(p).over(w.rowsBetween(-19, 0)),
        },
    )
    width = F.col("price_high") - F.col("price_low")
    return (
        out.withColumn("price_trend_pct", (p - F.col("__first")) / F.col("__first") * 100)
        .withColumn("range_pct", width / F.col("price_low") * 100)
        .withColumn(
            "range_position", F.when(width > 0, (p - F.col("price_low")) / width).otherwise(0.5)
        )
        .withColumn("current_price", p)
        .drop("__first")
    )


def event_context(events: DataFrame, tl: Timeline, n: int = 20) -> DataFrame:
    """Event part of W13: confirmations up and down and mean overshoot among the last ``n``."""
    return rows_frame(
        _alternation(events, tl), tl, n - 1, 0,
        lambda w: {
            "dc_up_count": F.count(F.when(F.col("event_type") == "PDCC2_UP", 1)).over(w),
            "dc_down_count": F.count(F.when(F.col("event_type") == "PDCC_Down", 1)).over(w),
            "avg_overshoot_pct": F.coalesce(
                F.avg("overshoot").over(w.rowsBetween(-(n - 2), 0)) * 100, F.lit(0.0)
            ),
        },
        index="__at",
    ).drop("__at")


def trade_context(trades: DataFrame, tl: Timeline, n: int = 20) -> DataFrame:
    """Trade part of W13: totals so far, current loss run and the net of the last ``n``."""
    won = F.col("pnl_pct") > 0
    counted = running(
        trades, tl, total_trades=count_so_far(), win_count=total_so_far(won.cast("long"))
    )
    last_win = F.when(won, F.col("total_trades"))
    runs = running(counted, tl, __win=last_known(last_win)).withColumn(
        "consecutive_losses", F.col("total_trades") - F.coalesce("__win", F.lit(0))
    )
    return rows_frame(
        runs.withColumn("__at", F.col("total_trades") - 1).drop("__win"), tl, n - 1, 0,
        lambda w: {"net_pnl_pct": F.sum("pnl_pct").over(w) * 100}, index="__at",
    ).drop("__at")


def windows(
    df: DataFrame,
    tl: Timeline,
    features: Sequence[str],
    label: str,
    L: int = 50,
    S: int = 50,
    H: int = 1,
    stride: int = 1,
    sparse: bool = False,
    block_rows: int = 16_384,
) -> DataFrame:
    """Supervised windows: L input rows, a gap of S rows, H labels; full windows only.

    ``window_id`` is the index of the first row. With ``sparse`` only the id and the labels are
    produced, and inputs are read from the row table when needed.
    """
    row = F.array(*[F.col(f).cast("double") for f in features])

    def frames(w):
        out = {"y": F.collect_list(label).over(w.rowsBetween(L + S, L + S + H - 1))}
        if not sparse:
            out["x"] = F.collect_list(row).over(w.rowsBetween(0, L - 1))
        return out

    out = rows_frame(df, tl, 0, L + S + H - 1, frames, block_rows, index="window_id")
    full = out.where((F.size("y") == H) & (F.col("window_id") % stride == 0))
    return full.select(*tl.by, "window_id", *([] if sparse else ["x"]), "y")


def tf_windows(
    df: DataFrame, tl: Timeline, features: Sequence[str], label: str,
    L: int, shift: int, H: int, **more,
) -> DataFrame:
    """Total width ``L + shift``, labels are its last ``H`` rows."""
    return windows(df, tl, features, label, L, shift - H, H, **more)


def chrono_split(
    df: DataFrame,
    ts: str,
    by: str | Sequence[str] | None = None,
    tie: Sequence[str] = (),
    fractions: Sequence[float] = (0.7, 0.2, 0.1),
    min_rows: int = 100,
    span: str | int = "1 day",
) -> DataFrame:
    """Split time-ordered rows at ``int(n * 0.7)`` and ``int(n * 0.9)``.

    Without ``by`` the split is global, still without a one-partition window: positions come from
    counts per time chunk.
    """
    keyed, keys = (df.withColumn("__all", F.lit(0)), ["__all"]) if by is None else (df, by)
    tl = Timeline.of(keys, ts, tie, span)
    out = running(keyed, tl, __index=count_so_far(current=False), __left=_rows_left())
    out = out.withColumn("__index", F.coalesce("__index", F.lit(0).cast("long")))
    n = F.col("__left") + F.lit(1) + F.col("__index")
    out = out.withColumn("__n", n)
    short = F.col("__n") < min_rows
    first = F.floor(F.col("__n") * F.lit(fractions[0])).cast("long")
    second = F.floor(F.col("__n") * F.lit(round(fractions[0] + fractions[1], 12))).cast("long")
    split = (
        F.when(short, F.raise_error(F.lit(f"fewer than {min_rows} rows to split")).cast("string"))
        .when(F.col("__index") < first, "train")
        .when(F.col("__index") < second, "val")
        .otherwise("test")
    )
    return out.withColumn("split", split).drop("__index", "__left", "__n", "__all")


def _rows_left():
    """Rows of the key after this one."""
    one = F.lit(1).cast("long")
    after_row = (Window.unboundedPreceding, -1)
    return Running(
        lambda w, back: F.coalesce(F.sum(one).over(back.rowsBetween(*after_row)), F.lit(0).cast("long")),
        lambda key: F.count(F.lit(1)),
        lambda t, before, after: F.sum(t).over(after),
        lambda a, b: a + F.coalesce(b, F.lit(0).cast("long")),
    )


def fingerprint(cols: Sequence[Column]) -> Column:
    """60-bit non-negative row fingerprint; the same in any engine with md5."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_split(df: DataFrame, lots: int = 10, cols: Sequence[str] | None = None) -> DataFrame:
    """Lot of each row's fingerprint; lots 0-7 train, 8 valid, 9 test (out of ten)."""
    lot = F.pmod(fingerprint([F.col(c) for c in (cols or df.columns)]), F.lit(lots)).cast("int")
    share = F.col("lot") / F.lit(lots)
    return df.withColumn("lot", lot).withColumn(
        "split", F.when(share < 0.8, "train").when(share < 0.9, "valid").otherwise("test")
    )


def last_n_features(df: DataFrame, tl: Timeline, features: Sequence[str], n: int) -> DataFrame:
    """Matrix of the last ``n`` feature rows, only where it is full."""
    row = F.array(*[F.col(f).cast("double") for f in features])
    out = rows_frame(df, tl, n - 1, 0, lambda w: {"x": F.collect_list(row).over(w)})
    return out.where(F.size("x") == n)


def price_change(df: DataFrame, tl: Timeline, price: str = "price") -> DataFrame:
    """Change and percentage change against the previous price."""
    out = running(df, tl, __prev=previous(F.col(price)))
    change = F.col(price) - F.col("__prev")
    return (
        out.withColumn("change", change)
        .withColumn("change_pct", F.try_divide(change, F.col("__prev")) * 100)
        .drop("__prev")
    )


def reversal_lookahead(fills: DataFrame, tl: Timeline, window_ms: int = 2000) -> DataFrame:
    """Closes whose next fill opens the other side within ``window_ms`` (``time`` in ms)."""
    out = running(fills, tl, __next=following(F.struct("dir", "time")))
    close = F.col("dir").startswith("Close")
    opens = F.col("__next.dir").startswith("Open")
    flips = F.col("dir").contains("Long") != F.col("__next.dir").contains("Long")
    near = F.col("__next.time") - F.col("time") <= window_ms
    hit = F.coalesce(close & opens & flips & near, F.lit(False))
    return out.withColumn("is_reversal", hit).drop("__next")


def numeric_fill(df: DataFrame, cols: Sequence[str], tl: Timeline) -> DataFrame:
    """To numbers, then forward fill and backward fill within the key."""
    cast = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})
    specs = {}
    for c in cols:
        specs[f"__b_{c}"] = last_known(F.col(c))
        specs[f"__a_{c}"] = next_known(F.col(c))
    out = running(cast, tl, **specs)
    filled = {c: F.coalesce(F.col(f"__b_{c}"), F.col(f"__a_{c}")) for c in cols}
    return out.withColumns(filled).drop(*specs)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
