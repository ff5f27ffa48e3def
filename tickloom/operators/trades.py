"""Labels, ledgers, sweeps and reviews of trades."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import pnl_pct, safe_div
from tickloom.operators.dc import dc_events, same_threshold
from tickloom.operators.joins import asof_backward, carry_states, single_row
from tickloom.operators.timeline import (
    CHUNK,
    Timeline,
    following,
    islands,
    max_so_far,
    micros,
    min_so_far,
    ordered_fold,
    previous,
    rows_frame,
    running,
)
from tickloom.operators.windows import (
    drawdown_of,
    equity_drawdown_of,
    equity_path,
    seconds_between,
)
from tickloom.session import cut_lineage

TAKER_FEE = 0.00035  # fixed value: fee per side

# The two parameter grids.
SINGLE_GRID = {
    "threshold": [0.002, 0.004, 0.006, 0.008, 0.01, 0.015],
    "sl": [0.003, 0.005, 0.008, 0.01, 0.015, 0.02],
    "tp": [0.005, 0.01, 0.02, 0.03, 0.05, 0.10],
    "trail": [0.3, 0.5, 0.7],
    "min_profit": [0.001, 0.002],
}
MULTI_GRID = {
    "threshold": [0.008, 0.01, 0.015, 0.02],
    "alpha": [0.2, 0.3, 0.5],
    "min_score": [0.1, 0.2, 0.3, 0.5],
    "sl": [0.005, 0.01, 0.015, 0.02],
    "tp": [0.005, 0.01, 0.02, 0.05],
    "trail": [0.3, 0.5, 0.7],
    "min_profit": [0.001, 0.002],
}


def grid_table(spark: SparkSession, grid: dict[str, Sequence[float]]) -> DataFrame:
    """Every combination of the grid's values, numbered in order of the values.

    Its size is the product of the caller's lists, so it is safe to broadcast.
    """
    out = spark.range(1).select(F.lit(0).cast("long").alias("config_id"))
    for name, values in grid.items():
        n = len(values)
        out = out.select(
            "*", F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias("__i", name)
        ).withColumn("config_id", F.col("config_id") * n + F.col("__i")).drop("__i")
    return out


# --- pricing ---------------------------------------------------------------------------------


def leg_pnl(df: DataFrame, fee: float = TAKER_FEE) -> DataFrame:
    """Result and fees of round trips with side, entry_price, exit_price and size."""
    entry, exit_, size = F.col("entry_price"), F.col("exit_price"), F.col("size")
    out = (
        df.withColumn("pnl_pct", pnl_pct(F.col("side"), entry, exit_))
        .withColumn("pnl_usd", F.col("pnl_pct") * (entry * size))
        .withColumn("entry_fee", entry * size * F.lit(fee))
        .withColumn("exit_fee", exit_ * size * F.lit(fee))
    )
    total = F.col("entry_fee") + F.col("exit_fee")
    return out.withColumn("total_fees", total).withColumn(
        "net_pnl_usd", F.col("pnl_usd") - F.col("total_fees")
    )


def exit_reason(df: DataFrame, reversal: str = "is_reversal") -> DataFrame:
    """Why a close happened."""
    return df.withColumn(
        "reason",
        F.when(F.col(reversal), "reversal_close")
        .when(F.col("pnl_pct") > 0, "take_profit")
        .otherwise("stop_loss"),
    )


# --- barrier and trailing labels ---------------------------------------------------------------


def trade_paths(
    entries: DataFrame, ticks: DataFrame, by: Sequence[str], ts: str = "ts",
    price: str = "price", order: Sequence[str] = (), span: str | int = "1 day",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Ticks after each entry, up to the next entry of the key, with what was reached before.

    ``entries(by..., entry_time, side, entry_price, ...)``; one position at a time, so each tick
    has one entry and no pair is ever multiplied. Prices are turned so that up is favourable:
    ``q`` is the price (long) or minus the price (short); ``fav_prev`` is the best ``q`` before
    the tick, at least the entry; ``fav`` and ``adv`` include the tick.
    """
    carry = ["side", "entry_price", *extra]
    joined = asof_backward(
        ticks, entries, by, ts, "entry_time", carry, order, keep_right_ts=True, span=span
    )
    live = joined.where(F.col("entry_time").isNotNull() & (F.col(ts) > F.col("entry_time")))
    return with_marks(live, by, ts, price, order, span)


def with_marks(
    live: DataFrame, by: Sequence[str], ts: str, price: str, order: Sequence[str],
    span: str | int,
) -> DataFrame:
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    rows = (
        live.withColumn("s", sign)
        .withColumn("q", F.col("s") * F.col(price))
        .withColumn("e", F.col("s") * F.col("entry_price"))
    )
    tl = Timeline.of([*by, "entry_time"], ts, order, span)
    out = running(
        rows, tl,
        fav_prev=max_so_far(F.col("q"), current=False),
        fav=max_so_far(F.col("q")),
        adv=min_so_far(F.col("q")),
    )
    return (
        out.withColumn("fav_prev", F.greatest("e", "fav_prev"))
        .withColumn("fav", F.greatest("e", "fav"))
        .withColumn("adv", F.least("e", "adv"))
    )


def touches(trailing: bool = True) -> tuple[Column, Column]:
    """(stop hit, target hit) for a path row with columns sl, tp and, if trailing, trail, min_profit.

    The stop that counts is the one left by earlier ticks. It depends on the best price so far
    alone, so each row can be tested on its own, for any number of parameter sets.
    """
    entry, s, q, e = (F.col(c) for c in ("entry_price", "s", "q", "e"))
    stop = s * (entry * (F.lit(1.0) - s * F.col("sl")))
    if trailing:
        profit = (F.col("fav_prev") - e) / entry
        lifted = e + (F.col("fav_prev") - e) * F.col("trail")
        stop = F.greatest(stop, F.when(profit >= F.col("min_profit"), lifted))
    target = s * (entry * (F.lit(1.0) + s * F.col("tp")))
    return q <= stop, q >= target


def first_exits(
    paths: DataFrame, keys: Sequence[str], ts: str, price: str, order: Sequence[str],
    trailing: bool, prefix: str = "",
) -> DataFrame:
    """First touching row per trade; a minimum over structs, combined on the map side."""
    stop, target = touches(trailing)
    reason = F.when(stop, f"{prefix}stop_loss").when(target, f"{prefix}take_profit")
    hits = paths.withColumn("__reason", reason).where(F.col("__reason").isNotNull())
    row = F.struct(
        F.col(ts).alias("exit_time"), *[F.col(c).alias(f"__o_{c}") for c in order],
        F.col(price).alias("exit_price"), F.col("__reason").alias("reason"), "fav", "adv",
    )
    best = hits.groupBy(*keys).agg(F.min(row).alias("x"))
    return best.select(*keys, "x.exit_time", "x.exit_price", "x.reason", "x.fav", "x.adv")


def part_hits(
    rows: DataFrame, keys: Sequence[str], grid: dict[str, Sequence[float]], ts: str, price: str, order: Sequence[str]
) -> DataFrame:
    """First rows of each trade that touch each stop, each target and each trailing stop of a grid.

    A row touches the greatest of two stops if it touches either, so the exit of a parameter set is
    the earliest of three rows, and a trade needs one of each value, not one of each combination: 18
    rows for 216 sets of the single-scale grid. They come in arrays, in order of the grid's values.
    """
    entry, s, q, e, best = (F.col(c) for c in ("entry_price", "s", "q", "e", "fav_prev"))
    row = F.struct(
        F.col(ts).alias("exit_time"), *[F.col(c) for c in order], F.col(price).alias("exit_price"), "fav", "adv"
    )
    first = lambda touched: F.min(F.when(touched, row))
    stops = [first(q <= s * (entry * (F.lit(1.0) - s * F.lit(float(v))))) for v in grid["sl"]]
    targets = [first(q >= s * (entry * (F.lit(1.0) + s * F.lit(float(v))))) for v in grid["tp"]]
    trails = [
        first(((best - e) / entry >= F.lit(float(m))) & (q <= e + (best - e) * F.lit(float(t))))
        for t in grid["trail"]
        for m in grid["min_profit"]
    ]
    found = rows.groupBy(*keys).agg(
        *[c.alias(f"__{k}{i}") for k, cs in (("sl", stops), ("tp", targets), ("tr", trails)) for i, c in enumerate(cs)]
    )
    arrays = [
        F.array(*[f"__{k}{i}" for i in range(len(cs))]).alias(f"{k}_hits")
        for k, cs in (("sl", stops), ("tp", targets), ("tr", trails))
    ]
    return found.select(*keys, *arrays)


def grid_places(grid: dict[str, Sequence[float]]) -> dict[str, Column]:
    """Where a parameter set of ``grid_table`` finds its rows in the arrays of ``part_hits``."""
    place = lambda name: F.array_position(F.array(*[F.lit(float(v)) for v in grid[name]]), F.col(name)) - 1
    return {"sl_at": place("sl"), "tp_at": place("tp"), "tr_at": place("trail") * len(grid["min_profit"]) + place("min_profit")}


def with_exits(cases: DataFrame, prefix: str = "trailing_", also: Sequence[str] = ()) -> DataFrame:
    """The exit of each case from its arrays of hits and its places in them; a stop goes before a target on one row."""
    hit = lambda kind: F.get(F.col(f"{kind}_hits"), F.col(f"{kind}_at").cast("int"))
    stop, target = F.least(hit("sl"), hit("tr")), hit("tp")
    rows = cases.withColumn("__x", F.least(stop, target)).withColumn(
        "reason", F.when(F.coalesce(stop <= target, stop.isNotNull()), f"{prefix}stop_loss").when(target.isNotNull(), f"{prefix}take_profit")
    )
    fields = ("exit_time", "exit_price", "fav", "adv")
    gone = ("sl_hits", "tp_hits", "tr_hits", "sl_at", "tp_at", "tr_at", "__x")
    return rows.select(*[c for c in rows.columns if c not in gone], *[F.col(f"__x.{c}").alias(c) for c in fields], *[F.col(f"__x.{c}").alias(f"exit_{c}") for c in also])


def _label(
    entries, ticks, by, ts, price, order, span, horizon, params: dict, trailing: bool
) -> DataFrame:
    keys = [*by, "entry_time"]
    paths = trade_paths(entries, ticks, by, ts, price, order, span)
    if horizon is not None:
        age = seconds_between(paths, ts, F.col("entry_time"))
        paths = paths.where(age <= F.lit(float(horizon)))
    paths = paths.withColumns({k: F.lit(float(v)) for k, v in params.items()})
    exits = first_exits(paths, keys, ts, price, order, trailing)
    s = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    e = s * F.col("entry_price")
    out = entries.join(exits, keys, "left")
    mfe = F.greatest((F.col("fav") - e) / F.col("entry_price"), F.lit(0.0))
    mae = F.greatest((e - F.col("adv")) / F.col("entry_price"), F.lit(0.0))
    return out.withColumn("mfe_pct", mfe).withColumn("mae_pct", mae).drop("fav", "adv")


def barrier_labels(
    entries: DataFrame, ticks: DataFrame, sl: float, tp: float, horizon: float | None = None,
    by: Sequence[str] = ("symbol",), ts: str = "ts", price: str = "price",
    order: Sequence[str] = (), span: str | int = "1 day",
) -> DataFrame:
    """First tick after each entry that touches the stop (tested first) or the target.

    Entries untouched until the next entry, or within ``horizon`` seconds, have null exits.
    """
    return _label(
        entries, ticks, by, ts, price, order, span, horizon, {"sl": sl, "tp": tp}, False
    )


def trailing_labels(
    entries: DataFrame, ticks: DataFrame, sl: float, tp: float, trail: float, min_profit: float,
    horizon: float | None = None, by: Sequence[str] = ("symbol",), ts: str = "ts",
    price: str = "price", order: Sequence[str] = (), span: str | int = "1 day",
) -> DataFrame:
    """As T2 with a stop that follows the best price and never loosens; MFE and MAE."""
    params = {"sl": sl, "tp": tp, "trail": trail, "min_profit": min_profit}
    return _label(entries, ticks, by, ts, price, order, span, horizon, params, True)


# --- ledgers -----------------------------------------------------------------------------------


def _entry_events(
    events: DataFrame, thresholds: Sequence | None, by: Sequence[str], cooldown_s: float, span
) -> DataFrame:
    """Confirmations with their successor and an id for runs the cooldown can link.

    One small row per confirmation, written out because paths, cases and exits all read it.
    """
    theta = F.lit(0)
    if thresholds is not None:
        theta = F.coalesce(
            *[F.when(same_threshold(events, t), i) for i, t in enumerate(thresholds)]
        )
    pdcc = events.where(F.col("event_type").isin("PDCC_Down", "PDCC2_UP")).select(
        *by,
        theta.alias("theta"),
        F.col("end_time").alias("entry_time"),
        F.col("end_price").alias("entry_price"),
        F.when(F.col("event_type") == "PDCC2_UP", "LONG").otherwise("SHORT").alias("side"),
    )
    pdcc = pdcc.where(F.col("theta").isNotNull())
    tl = Timeline.of([*by, "theta"], "entry_time", (), span)
    out = running(
        pdcc, tl,
        __next=following(F.struct(F.col("entry_time").alias("t"), F.col("entry_price").alias("p"))),
        __prev=previous(F.col("entry_time")),
    )
    gap = seconds_between(out, "entry_time", F.col("__prev"))
    out = (
        out.withColumn("next_time", F.col("__next.t"))
        .withColumn("next_price", F.col("__next.p"))
        .withColumn("gap_s", gap)
        .drop("__next", "__prev")
    )
    starts = F.col("gap_s").isNull() | (F.col("gap_s") >= cooldown_s)
    return cut_lineage(islands(out, tl, starts, "run"))


def _enter(candidates: DataFrame, keys: Sequence[str], cooldown_s: float) -> DataFrame:
    """Which confirmations become trades.

    A reversal of an open position always enters; otherwise the last entry must be a cooldown
    ago. An event at least a cooldown after the event before it always enters, so runs between
    such events are independent and each is folded alone.
    """
    cool = int(cooldown_s * 1_000_000)

    def fold(batches):
        key, last, is_open = None, None, False
        for pdf in batches:
            cols = [pdf[k].to_numpy() for k in keys]
            at, closed = pdf["__at"].to_numpy(), pdf["__closed"].to_numpy()
            keep = np.zeros(len(pdf), bool)
            for i in range(len(pdf)):
                now = tuple(c[i] for c in cols)
                if now != key:
                    key, last, is_open = now, None, False
                enter = is_open or last is None or at[i] - last >= cool
                keep[i] = enter
                if enter:
                    last = at[i]
                is_open = bool(enter and not closed[i])
            yield pdf[keep]

    rows = candidates.withColumn("__at", micros(candidates, "entry_time")).withColumn(
        "__closed", F.col("reason").isNotNull()
    )
    return ordered_fold(rows, keys, ["__at"], fold, rows.schema).drop("__at", "__closed")


def _taken_sets(
    found: DataFrame, by: Sequence[str], thresholds: Sequence[float], grid: dict[str, Sequence[float]], cooldown_s: float
) -> DataFrame:
    """``__id, __sets``: the numbers of the parameter sets that take each confirmation of ``found``, by the rule of ``_enter``.

    Whether a set closes a trade follows from which of its single values are touched, so a confirmation is one small row
    for all sets of its threshold, and these are folded side by side: neither shuffle nor loop is multiplied by the grid.
    """
    cool = int(cooldown_s * 1_000_000)
    names, kinds = list(grid), ("sl", "tp", "trail", "min_profit")
    ends = np.cumsum([0, len(grid["sl"]), len(grid["tp"])])
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    for number, values in enumerate(product(*grid.values())):
        one = dict(zip(names, values, strict=True))
        sl, tp, trail, profit = (list(grid[k]).index(one[k]) for k in kinds)
        row = (number, ends[0] + sl, ends[1] + tp, ends[2] + trail * len(grid["min_profit"]) + profit)
        places.setdefault(thresholds.index(float(one["threshold"])), []).append(row)
    sets = {theta: np.array(rows, np.int64).T for theta, rows in places.items()}
    keys = [*by, "theta", "run"]

    def fold(batches):
        key, last, is_open = None, None, None
        for pdf in batches:
            cols = [pdf[k].to_numpy() for k in keys]
            at, theta, touched = pdf["__at"].to_numpy(), pdf["theta"].to_numpy(), pdf["__touched"].to_numpy()
            out = []
            for i in range(len(pdf)):
                number, sl, tp, trail = sets[theta[i]]
                now = tuple(c[i] for c in cols)
                if now != key:
                    key, last, is_open = now, np.full(len(number), at[i] - cool), np.zeros(len(number), bool)
                enter = is_open | (at[i] - last >= cool)
                hit = np.asarray(touched[i], bool)
                is_open = enter & ~(hit[sl] | hit[tp] | hit[trail])
                last = np.where(enter, at[i], last)
                out.append(number[enter])
            some = [len(o) > 0 for o in out]
            yield pd.DataFrame({"__id": pdf["__id"].to_numpy()[some], "__sets": [o for o, any_ in zip(out, some, strict=True) if any_]})

    flags = F.concat(*[F.transform(f"{k}_hits", lambda h: h.isNotNull()) for k in ("sl", "tp", "tr")])
    width = int(ends[2]) + len(grid["trail"]) * len(grid["min_profit"])
    rows = found.select(*keys, "__id", micros(found, "entry_time").alias("__at"), F.coalesce(flags, F.array_repeat(F.lit(False), width)).alias("__touched"))
    return ordered_fold(rows, keys, ["__at"], fold, "__id long, __sets array<long>")


def _ledger(
    events: DataFrame, ticks: DataFrame, thresholds: Sequence | None, params: DataFrame | dict,
    by: Sequence[str], ts, price, order, span, cooldown_s, usd, fee, config: Sequence[str],
    grid: dict[str, Sequence[float]] | None = None,
) -> DataFrame:
    entries = _entry_events(events, thresholds, by, cooldown_s, span)
    keys = [*by, "theta", "entry_time"]
    count = 1 if thresholds is None else len(thresholds)
    paths = _paths_with_end(entries, ticks, count, by, ts, price, order, span)
    ties = [f"__o{i}" for i in range(len(order))]
    if isinstance(params, dict):
        tested = paths.withColumns({k: F.lit(float(v)) for k, v in params.items()})
        priced = entries.join(first_exits(tested, keys, ts, price, ties, True, "trailing_"), keys, "left")
        entered = _enter(priced, [*by, "theta", *config, "run"], cooldown_s)
    else:
        hits = part_hits(_only_extremes(paths, keys, ts), keys, grid, ts, price, ties)
        found = cut_lineage(entries.withColumn("__id", F.monotonically_increasing_id()).join(hits, keys, "left"))
        taken = _taken_sets(found, by, thresholds, grid, cooldown_s)
        cases = found.join(taken, "__id").withColumn("config_id", F.explode("__sets")).drop("__id", "__sets")
        entered = with_exits(cases.join(F.broadcast(params), ["theta", "config_id"]))
    s = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    e = s * F.col("entry_price")
    stopped = F.col("reason").isNotNull()
    excursion = lambda x: F.when(
        stopped, F.greatest(x / F.col("entry_price"), F.lit(0.0))
    ).otherwise(0.0)
    closed = (
        entered.where(stopped | F.col("next_time").isNotNull())
        .withColumn("mfe_pct", excursion(F.col("fav") - e))
        .withColumn("mae_pct", excursion(e - F.col("adv")))
        .withColumn("exit_time", F.when(stopped, F.col("exit_time")).otherwise(F.col("next_time")))
        .withColumn(
            "exit_price", F.when(stopped, F.col("exit_price")).otherwise(F.col("next_price"))
        )
        .withColumn("reason", F.coalesce("reason", F.lit("reversal_close")))
        .withColumn("size", F.lit(float(usd)) / F.col("entry_price"))
    )
    out = leg_pnl(closed, fee)
    return out.select(
        *by, *config, "side", "entry_price", "exit_price", "size", "entry_time", "exit_time",
        "pnl_pct", "pnl_usd", "entry_fee", "exit_fee", "total_fees", "net_pnl_usd", "reason",
        "mfe_pct", "mae_pct",
    )


def _paths_with_end(
    entries: DataFrame, ticks: DataFrame, count: int, by, ts, price, order, span
) -> DataFrame:
    """Ticks of every trade of every threshold, with the tick of the next confirmation as the last.

    The live trade of each threshold is carried along the ticks together, so ticks are shuffled
    once before they fan out to thresholds.
    """
    cols = ["entry_time", "side", "entry_price"]
    states = [
        (entries.where(F.col("theta") == i).select(*by, *cols), cols) for i in range(count)
    ]
    carried = carry_states(
        ticks.select(*by, ts, price, *order), states, by, ts, "entry_time", order, span
    )
    trades = F.array(
        *[F.struct(F.lit(i).alias("theta"), F.col(f"__s{i}").alias("e")) for i in range(count)]
    )
    ties = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    live = carried.select(*by, ts, price, *ties, F.explode(trades).alias("t")).select(
        *by, "t.theta", *[f"t.e.{c}" for c in cols], ts, price,
        F.lit(0).alias("__last"), *[f"__o{i}" for i in range(len(order))],
    )
    live = live.where(F.col("entry_time").isNotNull() & (F.col(ts) > F.col("entry_time")))
    last = entries.where(F.col("next_time").isNotNull()).select(
        *by, "theta", *cols,
        F.col("next_time").alias(ts), F.col("next_price").alias(price), F.lit(1).alias("__last"),
    )
    both = live.unionByName(last, allowMissingColumns=True)
    ends = ["__last", *[f"__o{i}" for i in range(len(order))]]
    return with_marks(both, [*by, "theta"], ts, price, ends, span)


def _only_extremes(paths: DataFrame, keys, ts: str) -> DataFrame:
    """Rows that can be a first touch for some parameters: a new best, or a new low since one.

    Between two new bests the stop does not move, so only the first row that reaches a new low can
    hit it. Lows restart at every chunk, which keeps more rows than needed but never fewer.
    """
    ties = [c for c in paths.columns if c.startswith("__o")]
    tl = Timeline.of(keys, ts, ["__last", *ties])
    best = (F.col("q") > F.col("fav_prev")).cast("int")
    rows = paths.withColumn("__best", best).withColumn(CHUNK, tl.chunk(paths))
    w = Window.partitionBy(*keys, CHUNK).orderBy(*tl.order)
    rows = rows.withColumn("__leg", F.sum("__best").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = Window.partitionBy(*keys, CHUNK, "__leg").orderBy(*tl.order)
    before = F.min("q").over(low.rowsBetween(Window.unboundedPreceding, -1))
    keep = (F.col("__best") == 1) | before.isNull() | (F.col("q") < before)
    return rows.withColumn("__keep", keep).where("__keep").drop("__best", "__leg", "__keep", CHUNK)


def dc_trades(
    ticks: DataFrame,
    events: DataFrame,
    sl: float,
    tp: float,
    trail: float,
    min_profit: float,
    cooldown_s: float = 10.0,
    position_usd: float = 100.0,
    fee: float = TAKER_FEE,
    by: Sequence[str] = ("symbol",),
    ts: str = "ts",
    price: str = "price",
    order: Sequence[str] = (),
    span: str | int = "1 day",
) -> DataFrame:
    """T4: ledger of the overshoot rule for events of *one* symmetric threshold.

    Confirmations of one threshold alternate, so trade i lives from confirmation i to the next.
    All exits are priced in parallel; only the cooldown is sequential, and it runs over events.
    A trade still open at the end is not reported.
    """
    params = {"sl": sl, "tp": tp, "trail": trail, "min_profit": min_profit}
    return _ledger(
        events, ticks, None, params, list(by), ts, price, list(order), span, cooldown_s,
        position_usd, fee, [],
    )


def dc_trades_sweep(
    ticks: DataFrame,
    grid: dict[str, Sequence[float]] | None = None,
    events: DataFrame | None = None,
    cooldown_s: float = 10.0,
    position_usd: float = 100.0,
    fee: float = TAKER_FEE,
    by: Sequence[str] = ("symbol",),
    ts: str = "ts",
    price: str = "price",
    order: Sequence[str] = (),
    span: str | int = "1 day",
) -> DataFrame:
    """T5: ledgers of every parameter set of a grid (threshold, sl, tp, trail, min_profit).

    Events depend on the threshold alone and path extremes on the trade alone, so both are computed
    once. Each trade is searched for the touch of every single value (``part_hits``); the
    broadcast grid then meets trades, not ticks, so nothing but the ledger itself grows with it.
    A grid with other parameters is refused; ``gated.multi_scale_sweep`` takes momentum.
    """
    grid = grid or SINGLE_GRID
    if set(grid) != set(SINGLE_GRID):
        raise ValueError(f"the grid must have {sorted(SINGLE_GRID)}, not {sorted(grid)}")
    thresholds = [float(t) for t in grid["threshold"]]
    number = F.coalesce(
        *[F.when(F.col("threshold") == F.lit(t), i) for i, t in enumerate(thresholds)]
    )
    params = grid_table(ticks.sparkSession, grid).withColumn("theta", number)
    params = params.withColumns(grid_places(grid)).select("theta", "config_id", "sl_at", "tp_at", "tr_at")
    if events is None:
        events = cut_lineage(dc_events(ticks, thresholds, by, ts, price, order, span))
    return _ledger(
        events, ticks, thresholds, params, list(by), ts, price, list(order), span, cooldown_s,
        position_usd, fee, ["config_id"], grid,
    )


def gate_trades(
    candidates: DataFrame,
    min_momentum: float | None = None,
    block_choppy: bool = True,
    direction_filter: str | None = None,
    use_trend: bool = False,
    use_loss_streak: bool = True,
) -> DataFrame:
    """What the guards decide about each candidate event.

    Candidates come from ``attach_rolling_state`` and may carry ``momentum``, ``regime``,
    ``long_size_factor`` / ``short_size_factor``, ``trend`` and ``cooldown_until``. Guards apply in
    the order direction, momentum, regime, loss streak, trend; ``decision`` names the first one
    that blocks.
    """
    cols = set(candidates.columns)
    up = F.col("event_type") == "PDCC2_UP"
    rules: list[tuple[str, Column]] = []
    if direction_filter:
        rules.append(("direction", ~up if direction_filter == "long" else up))
    if min_momentum is not None and "momentum" in cols:
        m = F.coalesce(F.col("momentum"), F.lit(0.0))
        confirms = F.when(up, m > min_momentum).otherwise(m < -min_momentum)
        rules.append(("momentum", ~confirms))
    if block_choppy and "regime" in cols:
        rules.append(("choppy", F.col("regime") == "choppy"))
    if use_loss_streak and "cooldown_until" in cols:
        rules.append(("loss_streak", F.col("ts") < F.col("cooldown_until")))
    factor = F.lit(1.0)
    if use_trend and "long_size_factor" in cols:
        factor = F.coalesce(
            F.when(up, F.col("long_size_factor")).otherwise(F.col("short_size_factor")),
            F.lit(1.0),
        )
        rules.append(("counter_trend", factor == 0))
    decision = F.lit("enter")
    for name, blocks in reversed(rules):
        decision = F.when(F.coalesce(blocks, F.lit(False)), name).otherwise(decision)
    out = candidates.withColumn("decision", decision)
    flip = (
        F.coalesce(
            ((F.col("trend") == "up") & ~up) | ((F.col("trend") == "down") & up), F.lit(False)
        )
        if "trend" in cols
        else F.lit(False)
    )
    return out.withColumn(
        "size_factor", F.when(F.col("decision") == "enter", factor).otherwise(0.0)
    ).withColumn("against_trend", flip)


def score_events(context: DataFrame, direction_filter: str | None = None) -> DataFrame:
    """Rule-based action, confidence, target and stop for each trigger event.

    Needs the context columns of W13, ``event_type``, ``regime``, ``consecutive_losses`` and
    optionally ``position_side``.
    """
    up, down = F.col("event_type") == "PDCC2_UP", F.col("event_type") == "PDCC_Down"
    side = F.col("position_side") if "position_side" in context.columns else F.lit(None)
    losses = F.coalesce("consecutive_losses", F.lit(0))
    wide = F.col("price_high") > F.col("price_low")
    range_pct = safe_div((F.col("price_high") - F.col("price_low")), F.col("price_low")) * 100
    where = safe_div(
        F.col("current_price") - F.col("price_low"), F.col("price_high") - F.col("price_low")
    )
    ups, downs = F.coalesce("dc_up_count", F.lit(0)), F.coalesce("dc_down_count", F.lit(0))
    trend = F.col("price_trend_pct")
    won = F.try_divide(F.coalesce("win_count", F.lit(0)), F.coalesce("total_trades", F.lit(0)))
    pick = lambda *cases: _first_case(cases)
    # Base confidence and the weight of each factor.
    score = (
        F.lit(0.58)
        + pick((wide & (F.col("tick_count") >= 10) & (range_pct < 0.3), -0.10))
        + pick(
            (up & (trend > 0.5), 0.10), (up & (trend < -1.0), -0.10),
            (down & (trend < -0.5), 0.10), (down & (trend > 1.0), -0.10),
        )
        + pick((wide & up & (where < 0.4), 0.05), (wide & up & (where > 0.8), -0.05))
        + pick(
            (up & (F.try_divide(ups, ups + downs) > 0.6), 0.05),
            (down & (F.try_divide(downs, ups + downs) > 0.6), 0.05),
        )
        + pick(
            ((F.coalesce("total_trades", F.lit(0)) >= 3) & (won > 0.6), 0.05),
            ((F.coalesce("total_trades", F.lit(0)) >= 3) & (won < 0.3), -0.05),
        )
    )
    opposing = ((side == "LONG") & down) | ((side == "SHORT") & up)
    wrong_side = (
        F.lit(False) if direction_filter is None else (down if direction_filter == "long" else up)
    )
    action = (
        F.when(F.col("regime") == "choppy", "skip_choppy")
        .when(losses >= F.when(losses < 3, 3).otherwise(4), "skip_losses")
        .when(side.isNotNull() & opposing, "close")
        .when(side.isNotNull(), "skip_position")
        .when(wrong_side, "skip_direction")
        .when(up, "enter_long")
        .when(down, "enter_short")
        .otherwise("skip_unknown")
    )
    base = {"skip_choppy": 0.3, "skip_losses": 0.2, "close": 0.7, "skip_position": 0.5,
            "skip_direction": 0.4, "skip_unknown": 0.3}
    out = context.withColumn("action", action)
    confidence = F.col("__score")
    for name, value in base.items():
        confidence = F.when(F.col("action") == name, value).otherwise(confidence)
    enters = F.col("action").startswith("enter")
    overshoot = F.coalesce("avg_overshoot_pct", F.lit(0.0))
    tp = F.when(overshoot > 0, F.greatest(F.lit(0.003), overshoot / 100 * 0.4)).otherwise(0.008)
    c = F.round(F.col("__score"), 9)
    sl = F.when(c >= 0.7, 0.012).when(c < 0.55, 0.018).otherwise(0.015)
    return (
        out.withColumn("__score", score)
        .withColumn("confidence", confidence)
        .withColumn("tp_pct", F.when(enters, tp))
        .withColumn("sl_pct", F.when(enters, sl))
        .drop("__score")
    )


def _first_case(cases) -> Column:
    out = F.lit(0.0)
    for cond, value in reversed(cases):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(value)).otherwise(out)
    return out


# --- reviews -----------------------------------------------------------------------------------


def trade_metrics(
    trades: DataFrame, by: Sequence[str] = ("symbol",), days: float = 7.0,
    total_signals: int = 0, order: Sequence[str] = (), span: str | int = "1 day",
) -> DataFrame:
    """A5: the 22 summary figures per key; keys without trades do not appear."""
    tl = Timeline.of(list(by), "exit_time", ["entry_time", *order], span)
    rows = equity_path(trades, tl).withColumn(
        "__hold", seconds_between(trades, "exit_time", F.col("entry_time"))
    )
    net, gross, n = F.col("net_pnl_usd"), F.col("pnl_usd"), F.count(F.lit(1))
    won, lost = F.when(net > 0, net), F.when(net <= 0, net)
    agg = rows.groupBy(*by).agg(
        n.alias("total_trades"),
        F.lit(total_signals).alias("total_signals"),
        F.count(won).alias("wins"),
        F.count(lost).alias("losses"),
        (F.count(won) / n * 100).alias("win_rate_net"),
        (F.count_if(gross > 0) / n * 100).alias("win_rate_gross"),
        F.sum(gross).alias("gross_pnl_usd"),
        F.sum("total_fees").alias("total_fees_usd"),
        F.sum(net).alias("net_pnl_usd"),
        F.coalesce(F.avg(won), F.lit(0.0)).alias("avg_win_net_usd"),
        F.coalesce(F.avg(lost), F.lit(0.0)).alias("avg_loss_net_usd"),
        F.avg("__hold").alias("avg_hold_seconds"),
        drawdown_of().alias("max_drawdown_usd"),
        equity_drawdown_of().alias("max_equity_drawdown_usd"),
        F.coalesce(F.sum(won), F.lit(0.0)).alias("__won"),
        F.abs(F.coalesce(F.sum(lost), F.lit(0.0))).alias("__lost"),
        F.count_if((gross > 0) & (net <= 0)).alias("trades_eaten_by_fees"),
        F.count_if(F.col("reason").contains("stop_loss")).alias("sl_exits"),
        F.count_if(F.col("reason").contains("take_profit")).alias("tp_exits"),
        F.count_if(F.col("reason").contains("reversal")).alias("reversal_exits"),
    )
    fees, total = F.col("total_fees_usd"), F.col("gross_pnl_usd")
    return (
        agg.withColumn("fee_pct_of_gross", safe_div(fees, F.abs(total)) * 100)
        .withColumn(
            "profit_factor",
            F.when(F.col("__lost") > 0, F.try_divide(F.col("__won"), F.col("__lost"))).otherwise(
                F.lit(float("inf"))
            ),
        )
        .withColumn("per_trade_avg_fee", fees / F.col("total_trades"))
        .withColumn(
            "net_pnl_per_day", F.col("net_pnl_usd") / F.lit(days) if days > 0 else F.lit(0.0)
        )
        .drop("__won", "__lost")
    )


def side_breakdown(trades: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Trades, wins, losses and net per side; a side without trades gets a zero row."""
    net = F.col("net_pnl_usd")
    found = trades.groupBy(*by, "side").agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(net > 0).alias("wins"),
        F.count_if(net <= 0).alias("losses"),
        F.sum(net).alias("net_pnl_usd"),
    )
    sides = trades.select(*by).distinct().select(
        *by, F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))).alias("side")
    )
    return sides.join(found, [*by, "side"], "left").fillna(
        0, ["trades", "wins", "losses"]
    ).fillna(0.0, ["net_pnl_usd"])


def sweep_summary(
    trades: DataFrame, grid: DataFrame, min_trades: int = 5, days: float = 7.0,
    by: Sequence[str] = ("config_id",), span: str | int = "1 day",
) -> DataFrame:
    """Figures per configuration with at least ``min_trades`` trades, best net first."""
    keep = [
        "total_trades", "wins", "losses", "win_rate_net", "gross_pnl_usd", "total_fees_usd",
        "net_pnl_usd", "profit_factor", "max_drawdown_usd", "net_pnl_per_day",
        "trades_eaten_by_fees",
    ]
    rest = [c for c in ("symbol",) if c in trades.columns and c not in by]
    figures = trade_metrics(trades, by, days, order=rest, span=span).select(*by, *keep)
    out = figures.where(F.col("total_trades") >= min_trades).join(
        F.broadcast(grid), "config_id"
    )
    return out.orderBy(F.desc("net_pnl_usd"))


def sweep_patterns(
    summary: DataFrame,
    params: Sequence[str] = ("threshold", "sl", "tp", "trail", "min_profit"),
) -> DataFrame:
    """Mean parameters and counts of profitable and unprofitable configurations."""
    return summary.groupBy((F.col("net_pnl_usd") > 0).alias("profitable")).agg(
        F.count(F.lit(1)).alias("configs"), *[F.avg(p).alias(f"avg_{p}") for p in params]
    )


def risk_breaches(
    positions: DataFrame, account: DataFrame, limits: DataFrame, legacy_abs: bool = False
) -> DataFrame:
    """One row per fired rule.

    ``positions(account_id, asset, size, entry_price, current_value, unrealized_pnl)``,
    ``account(account_id, total_value, drawdown_pct)`` and one row of ``limits`` (more are an error). Only a loss fires
    the stop rule; ``legacy_abs`` fires it on a gain of that size too.
    """
    lim = F.broadcast(single_row(limits, "limits"))
    p = positions.join(account, "account_id").crossJoin(lim)
    result = F.try_divide(
        F.col("unrealized_pnl"), F.col("entry_price") * F.abs("size")
    ) * 100
    loss = F.abs(result) if legacy_abs else -result
    share = F.try_divide(F.col("current_value"), F.col("total_value")) * 100
    priced = F.col("entry_price") > 0

    def rule(name, action, severity, value, bound, cond):
        return F.when(
            cond & (value >= F.col(bound)),
            F.struct(
                F.lit(name).alias("rule"), F.lit(action).alias("action"),
                F.lit(severity).alias("severity"), value.alias("value"),
                F.col(bound).cast("double").alias("bound"),
            ),
        )

    per_position = F.array_compact(
        F.array(
            rule("stop_loss", "close_position", "HIGH", loss, "loss_pct", priced),
            rule(
                "take_profit", "close_position", "MEDIUM", result, "profit_pct",
                priced & (F.col("unrealized_pnl") > 0),
            ),
            rule(
                "max_position_size", "reduce_position", "MEDIUM", share, "max_position_size_pct",
                F.col("total_value") > 0,
            ),
        )
    )
    fired = p.select("account_id", "asset", F.explode(per_position).alias("r")).select(
        "account_id", "asset", "r.*"
    )
    dd = F.col("drawdown_pct").cast("double")
    whole = (
        account.crossJoin(lim)
        .select(
            "account_id", F.lit("ACCOUNT").alias("asset"),
            rule(
                "max_drawdown", "emergency_exit", "CRITICAL", dd, "max_drawdown_pct", F.lit(True)
            ).alias("r"),
        )
        .where("r is not null")
        .select("account_id", "asset", "r.*")
    )
    return fired.unionByName(whole)


def exposure_breaches(
    positions: DataFrame, equity: DataFrame, max_total: float, max_single: float,
    max_drawdown_pct: float,
) -> DataFrame:
    """A16, exposure form: total and single exposure limits and drawdown from the equity peak.

    ``positions(account_id, coin, exposure)``, ``equity(account_id, ts, equity)``.
    """
    size = F.abs("exposure")
    per_coin = positions.groupBy("account_id", "coin").agg(F.sum(size).alias("value"))
    single = per_coin.where(F.col("value") > max_single).select(
        "account_id", F.lit("single_exposure").alias("rule"), "coin", "value"
    )
    total = per_coin.groupBy("account_id").agg(F.sum("value").alias("value")).where(
        F.col("value") > max_total
    ).select("account_id", F.lit("total_exposure").alias("rule"), F.lit(None).cast("string").alias("coin"), "value")
    peak = equity.groupBy("account_id").agg(
        F.max("equity").alias("peak"), F.max_by("equity", "ts").alias("now")
    )
    fall = F.when(F.col("peak") > 0, (F.col("peak") - F.col("now")) / F.col("peak") * 100).otherwise(0.0)
    drop = peak.withColumn("value", fall).where(F.col("value") > max_drawdown_pct).select(
        "account_id", F.lit("drawdown").alias("rule"), F.lit(None).cast("string").alias("coin"), "value"
    )
    return single.unionByName(total).unionByName(drop)


def session_signals(reports: DataFrame) -> DataFrame:
    """One row per signal of each session report, in the report's order."""
    return reports.select(
        "session_id", "symbol", "threshold", "position_size_usd",
        F.posexplode_outer("signals").alias("pos", "sig"),
    ).select("session_id", "symbol", "threshold", "position_size_usd", "pos", "sig.*")


def session_summary(reports: DataFrame) -> DataFrame:
    """Signals per minute and counts by type, read off the report's own array."""
    of = lambda t: F.size(F.filter("signals", lambda s: s["type"] == t))
    return reports.select(
        "session_id", "symbol", "threshold", "tick_count", "dc_event_count",
        F.when(
            F.col("duration_seconds") > 0,
            F.col("signal_count") / F.when(F.col("duration_seconds") > 0, F.col("duration_seconds")) * 60.0,
        ).otherwise(0.0).alias("signals_per_min"),
        of("BUY").alias("buy_signals"), of("SELL").alias("sell_signals"),
        of("CLOSE").alias("close_signals"),
    )


def signal_trades(
    signals: DataFrame, tl: Timeline, fee: float = TAKER_FEE, usd: str = "position_size_usd"
) -> DataFrame:
    """Trades of an observed signal stream: each entry ends at the very next signal.

    ``signals(by..., type, price, size)``; an opposite or repeated entry closes and reopens.
    """
    kinds = signals.where(F.col("type").isin("BUY", "SELL", "CLOSE"))
    out = running(kinds, tl, exit_price=following(F.col("price")))
    trades = (
        out.where(F.col("type").isin("BUY", "SELL") & F.col("exit_price").isNotNull())
        .withColumn("side", F.when(F.col("type") == "BUY", "LONG").otherwise("SHORT"))
        .withColumn("entry_price", F.col("price"))
        .withColumn("size", F.coalesce(F.col("size"), F.col(usd) / F.col("price")))
    )
    return leg_pnl(trades, fee)


def signal_pnl(signals: DataFrame, tl: Timeline, fee: float = TAKER_FEE) -> DataFrame:
    """Simulated result per session."""
    net = F.col("net_pnl_usd")
    zero = F.lit(0.0)
    found = signal_trades(signals, tl, fee).groupBy(*tl.by).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.sum("pnl_usd").alias("gross_pnl_usd"),
        F.sum("total_fees").alias("total_fees_usd"),
        F.sum(net).alias("net_pnl_usd"),
        F.count_if(net > 0).alias("wins"),
        F.count_if(net <= 0).alias("losses"),
    )
    every = signals.select(*tl.by).distinct().join(found, list(tl.by), "left")
    filled = every.fillna(0, ["total_trades", "wins", "losses"]).fillna(
        0.0, ["gross_pnl_usd", "total_fees_usd", "net_pnl_usd"]
    )
    return filled.withColumn(
        "win_rate", F.coalesce(F.try_divide(F.col("wins"), F.col("total_trades")), zero)
    )


def decision_summary(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Decisions by the beginning of their action."""
    a = F.col("action")
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(a.startswith("enter")).alias("enters"),
        F.count_if(a.startswith("close")).alias("closes"),
        F.count_if(a.startswith("skip")).alias("skips"),
    )


def rank_thresholds(sessions: DataFrame) -> DataFrame:
    """Best session by net result plus a win-rate bonus, and how sure the choice is."""
    bonus = F.when(F.col("total_trades") > 0, F.col("win_rate") * 0.1).otherwise(-1.0)
    top = (
        sessions.withColumn("score", F.col("net_pnl_usd") + bonus)
        .orderBy(F.desc("score"), "session_id")
        .limit(2)
    )
    w = Window.orderBy(F.desc("score"), "session_id")
    gap = F.col("score") - F.lead("score").over(w)
    sure = F.when(gap.isNull(), 0.5).otherwise(F.least(F.lit(0.95), 0.5 + gap * 0.2))
    return (
        top.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)))
        .withColumn("__rn", F.row_number().over(w))
        .where("__rn = 1")
        .drop("__rn")
    )


# --- carry trades --------------------------------------------------------------------------------

BASIS_SCHEMA = (
    "entry_time long, exit_time long, spot_entry double, perp_entry double, spot_exit double, "
    "perp_exit double, funding_pnl double, funding_payments long, reason string"
)


def basis_pnl(
    funding: DataFrame,
    by: Sequence[str] = ("symbol",),
    ts: str = "ts",
    enter_rate: float = 0.0001,
    enter_hours: int = 3,
    exit_rate: float = -0.0001,
    exit_hours: int = 4,
    max_hold_hours: float = 0.0,
    target_usd: float = 0.0,
    max_loss_usd: float = 0.0,
    notional_usd: float = 100.0,
    fee: float = 0.0011,
    tie: Sequence[str] = (),
    span: str | int = "30 days",
) -> DataFrame:
    """Spot-plus-short-perpetual trades on hourly funding (rate, mark_price, oracle_price).

    Both streaks restart when a position closes, so observations depend on the ones before. But
    ``exit_hours`` low rates in a row leave no position open and no entry under way, whatever was
    before them: the first higher rate after such a run starts afresh. Stretches between these
    points are folded independently.
    """
    if exit_rate >= enter_rate:
        raise ValueError("the exit rate must be below the entry rate")
    hour = 3_600_000_000

    def fold(batches):
        key, above, below, pos = None, 0, 0, None
        for pdf in batches:
            cols = [pdf[k].to_numpy() for k in by]
            at, rate = pdf["__at"].to_numpy(), pdf["rate"].to_numpy()
            spot, perp = pdf["oracle_price"].to_numpy(), pdf["mark_price"].to_numpy()
            stretch = pdf["__stretch"].to_numpy()
            out = []
            for i in range(len(pdf)):
                now = tuple(c[i] for c in cols)
                if (now, stretch[i]) != key:
                    key, above, below, pos = (now, stretch[i]), 0, 0, None
                above = above + 1 if rate[i] >= enter_rate else 0
                below = below + 1 if rate[i] <= exit_rate else 0
                if pos is None:
                    if above >= enter_hours:
                        pos = [at[i], spot[i], perp[i], 0.0, 0]
                    continue
                pos[3] += rate[i] * notional_usd
                pos[4] += 1
                held = (at[i] - pos[0]) / hour
                if below >= exit_hours:
                    reason = "funding_negative"
                elif 0 < max_hold_hours <= held:
                    reason = "max_hold_time"
                elif target_usd > 0 and pos[3] >= target_usd:
                    reason = "target_profit"
                elif max_loss_usd > 0 and pos[3] <= -max_loss_usd:
                    reason = "max_loss"
                else:
                    continue
                out.append((*now, pos[0], at[i], pos[1], pos[2], spot[i], perp[i], pos[3], pos[4], reason))
                above, below, pos = 0, 0, None
            names = [*by, *[c.split()[0] for c in BASIS_SCHEMA.split(", ")]]
            yield pd.DataFrame(out, columns=names)

    keys = ", ".join(f"`{c}` {funding.schema[c].dataType.simpleString()}" for c in by)
    rows = funding.where(F.col("rate").isNotNull()).withColumn("__at", micros(funding, ts))
    tl = Timeline.of(by, ts, tie, span)
    low = (F.col("rate") <= exit_rate).cast("int")

    def run_before(w):
        w = w.rowsBetween(-exit_hours, -1)
        return {"__low_run": (F.count(low).over(w) == exit_hours) & (F.min(low).over(w) == 1)}

    marked = rows_frame(rows, tl, exit_hours, 0, run_before)
    cut = islands(marked, tl, F.col("__low_run") & (low == 0), "__stretch")
    trades = ordered_fold(
        cut, [*by, "__stretch"], ["__at", *tie], fold, f"{keys}, {BASIS_SCHEMA}"
    )
    spot = (F.col("spot_exit") - F.col("spot_entry")) / F.col("spot_entry") * F.lit(notional_usd)
    perp = (F.col("perp_entry") - F.col("perp_exit")) / F.col("perp_entry") * F.lit(notional_usd)
    kind = funding.schema[ts].dataType
    fees = F.lit(notional_usd * fee)
    return (
        trades.withColumn("hold_hours", (F.col("exit_time") - F.col("entry_time")) / F.lit(hour))
        .withColumn("entry_time", F.timestamp_micros("entry_time").cast(kind))
        .withColumn("exit_time", F.timestamp_micros("exit_time").cast(kind))
        .withColumn("spot_pnl", spot)
        .withColumn("perp_pnl", perp)
        .withColumn("total_fees", fees)
        .withColumn(
            "net_pnl",
            F.col("spot_pnl") + F.col("perp_pnl") + F.col("funding_pnl") - F.col("total_fees"),
        )
    )
