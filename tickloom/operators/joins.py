"""As-of, positional and reconciliation joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.timeline import Timeline, last_known, running


def single_row(df: DataFrame, name: str = "table") -> DataFrame:
    """A table that must not have more than one row; with more the query fails. No row stays no row.

    One map-side combined aggregation, so the result is safe to broadcast.
    """
    one = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("r")).agg(
        F.count(F.lit(1)).alias("n"), F.first("r").alias("r")
    )
    many = F.raise_error(F.lit(f"{name}: more than one row")).cast("boolean")
    return one.where(F.when(F.col("n") > 1, many).otherwise(F.col("n") == 1)).select("r.*")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: str | Sequence[str],
    left_ts: str,
    right_ts: str,
    cols: Sequence[str],
    order: str | Sequence[str] = (),
    right_order: Sequence[str] = (),
    keep_right_ts: bool = False,
    span: str | int = "1 day",
) -> DataFrame:
    """Every left row gets the latest right row with ``right_ts <= left_ts`` of the same key.

    Left rows before the first right row get nulls; of equal right times the last row in
    ``right_order`` wins. The two sides are merged and carried forward chunk by chunk, so a hot
    key is spread over its chunks and no pair of rows is ever built.
    """
    tl = Timeline.of(by, left_ts)
    ties = list(Timeline.of(by, left_ts, order).tie)
    payload = [*cols, *([right_ts] if keep_right_ts else [])]
    l_rows = left.select(
        *left.columns,
        F.lit(1).alias("__side"),
        *[F.col(c).alias(f"__o{i}") for i, c in enumerate(ties)],
    )
    ranked = F.struct(*[F.col(c) for c in right_order]) if right_order else F.lit(0)
    box = F.struct(*[F.col(c).alias(f"r_{c}") for c in payload])
    # Of several right rows at one time only one can win, so they are reduced before the merge.
    r_rows = (
        right.where(F.col(right_ts).isNotNull())
        .groupBy(*tl.by, F.col(right_ts).alias(left_ts))
        .agg(F.max_by(box, ranked).alias("__right"))
        .withColumn("__side", F.lit(0))
    )
    merged = l_rows.unionByName(r_rows, allowMissingColumns=True)
    line = Timeline(
        tl.by, left_ts, ("__side", *[f"__o{i}" for i in range(len(ties))]), span
    )
    carried = running(merged, line, __right=last_known(F.col("__right")))
    return carried.where(F.col("__side") == 1).select(
        *left.columns, *[F.col("__right")[f"r_{c}"].alias(c) for c in payload]
    )


def asof_in_interval(
    left: DataFrame,
    events: DataFrame,
    by: str | Sequence[str],
    ts: str,
    start: str,
    end: str,
    closed: str = "left",
    cols: Sequence[str] | None = None,
    order: str | Sequence[str] = (),
    right_order: Sequence[str] = (),
    span: str | int = "1 day",
) -> DataFrame:
    """As-of on the event's start, then only rows inside the event.

    ``closed`` is ``"left"`` for ``[start, end)`` or ``"neither"`` for ``(start, end)``.
    """
    keys = Timeline.of(by, ts).by
    payload = list(cols or [c for c in events.columns if c not in (*keys, start)])
    if end not in payload:
        payload.append(end)
    joined = asof_backward(
        left, events, by, ts, start, payload, order, right_order or (end,), True, span
    )
    after = F.col(ts) >= F.col(start) if closed == "left" else F.col(ts) > F.col(start)
    return joined.where(after & (F.col(ts) < F.col(end)))


def zip_thresholds(
    dfs: Sequence[DataFrame],
    key: str | Sequence[str],
    y: str = "first",
    rtol: float = 1e-6,
    atol: float = 1e-6,
    x_col: str = "x",
    y_col: str = "y",
) -> DataFrame:
    """Join per-threshold window sets on their id; concatenate x row by row.

    Guards: a key missing on one side, or labels that differ beyond the tolerance (with
    ``y="first"``), stop the job.
    """
    keys = [key] if isinstance(key, str) else list(key)
    parts = [
        d.select(*keys, F.col(x_col).alias(f"__x{i}"), F.col(y_col).alias(f"__y{i}"))
        for i, d in enumerate(dfs)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys, "full_outer")
    n = len(parts)
    present = F.lit(True)
    for i in range(n):
        present = present & F.col(f"__x{i}").isNotNull()
    equal = F.lit(True)
    for i in range(1, n if y == "first" else 1):
        close = F.forall(
            F.arrays_zip(F.col("__y0").alias("a"), F.col(f"__y{i}").alias("b")),
            lambda p: F.abs(p["a"] - p["b"]) <= F.lit(atol) + F.lit(rtol) * F.abs(p["b"]),
        )
        equal = equal & close & (F.size("__y0") == F.size(f"__y{i}"))
    x = F.col("__x0")
    for i in range(1, n):
        x = F.zip_with(x, F.col(f"__x{i}"), lambda a, b: F.concat(a, b))
    labels = F.col("__y0") if y == "first" else F.array(*[F.col(f"__y{i}") for i in range(n)])
    checked = (
        F.when(~present, F.raise_error(F.lit("window sets differ in length")).cast("boolean"))
        .when(~equal, F.raise_error(F.lit("labels differ between thresholds")).cast("boolean"))
        .otherwise(F.lit(True))
    )
    return out.where(checked).select(*keys, x.alias(x_col), labels.alias(y_col))


def scalar_cross(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row table (an aggregate or parameters) to every row; more rows are an error."""
    return df.crossJoin(F.broadcast(single_row(one_row)))


def join_by_index(
    universe: DataFrame, contexts: DataFrame, by: Sequence[str] = (),
    left_array: str = "universe", right_array: str = "contexts",
) -> DataFrame:
    """Two arrays matched by position; universe entries without a context keep nulls."""
    left = universe.select(*by, F.posexplode(left_array).alias("pos", "item"))
    right = contexts.select(*by, F.posexplode(right_array).alias("pos", "context"))
    return left.join(right, [*by, "pos"], "left")


def spot_perp_pairs(
    tokens: DataFrame, spot: DataFrame, perps: DataFrame, min_rate: float = 0.0
) -> DataFrame:
    """Bases tradable both spot and perpetual, their spot pairs, funding and eligibility.

    ``tokens(index, name)``, ``spot(market_id, base_index)``, ``perps(name, funding, mark_price)``.
    """
    named = spot.join(
        tokens.select(F.col("index").alias("base_index"), F.col("name").alias("asset")),
        "base_index",
    )
    pairs = named.groupBy("asset").agg(
        F.sort_array(F.collect_set("market_id")).alias("spot_pairs")
    )
    rate = F.col("funding")
    return (
        perps.withColumnRenamed("name", "asset")
        .join(pairs, "asset")
        .select(
            "asset",
            "spot_pairs",
            rate.alias("funding_rate"),
            (rate * 100).alias("funding_rate_pct"),
            F.col("mark_price").alias("perp_mark_price"),
            (rate > F.lit(min_rate)).alias("eligible_for_arbitrage"),
        )
    )


def reconcile_orders(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """Actions that make the follower's open orders mirror the leader's.

    ``leader(oid, coin, side, limit_px)``, ``follower(oid, leader_oid, coin)``. The follower order
    with the lowest id is the mirror (the minimum is map-side combined, so any number of copies
    of one order is fine); the others are duplicates.
    """
    mine = follower.where(F.col("leader_oid").isNotNull())
    first = mine.groupBy("leader_oid").agg(F.min("oid").alias("first_oid"))
    mirrors = mine.join(first, "leader_oid")
    is_first = F.col("oid") == F.col("first_oid")
    extra = mirrors.where(~is_first).select(
        F.lit("CANCEL_DUPLICATE").alias("action"), "leader_oid",
        F.col("oid").alias("follower_oid"), "coin",
    )
    kept = mirrors.where(is_first)
    open_ids = leader.select(F.col("oid").alias("leader_oid"))
    orphans = kept.join(open_ids, "leader_oid", "left_anti").select(
        F.lit("CANCEL_ORPHAN").alias("action"), "leader_oid",
        F.col("oid").alias("follower_oid"), "coin",
    )
    led = leader.withColumnRenamed("oid", "leader_oid").join(first, "leader_oid", "left")
    kept_or_new = led.select(
        F.when(F.col("first_oid").isNull(), "PLACE").otherwise("KEEP").alias("action"),
        "leader_oid",
        F.col("first_oid").alias("follower_oid"),
        "coin",
    )
    return kept_or_new.unionByName(orphans).unionByName(extra)


def reconcile_positions(
    leader: DataFrame,
    follower: DataFrame,
    activity: DataFrame,
    now: Column,
    grace_s: float = 30.0,
    threshold: float = 10.0,
) -> DataFrame:
    """Drift per coin. Inputs are ``(coin, szi)``; ``activity(coin, ts)`` in epoch seconds."""
    both = leader.select("coin", F.col("szi").alias("l")).join(
        follower.select("coin", F.col("szi").alias("f")), "coin", "full_outer"
    )
    recent = activity.where(now - F.col("ts") < F.lit(grace_s)).select("coin").distinct()
    lead, follow = F.coalesce("l", F.lit(0.0)), F.coalesce("f", F.lit(0.0))
    drift = (
        F.when((F.signum(lead) != F.signum(follow)) & (lead != 0), 100.0)
        .when((lead == 0) & (follow != 0), 100.0)
        .otherwise(F.abs(1 - F.try_divide(F.abs(follow), F.abs(lead))) * 100)
    )
    kind = (
        F.when((F.signum(lead) != F.signum(follow)) & (lead != 0), "direction")
        .when((lead == 0) & (follow != 0), "orphan")
        .otherwise("size")
    )
    return (
        both.where((lead != 0) | (follow != 0))
        .join(recent, "coin", "left_anti")
        .select(
            "coin", lead.alias("leader_szi"), follow.alias("follower_szi"),
            drift.alias("drift_pct"), kind.alias("kind"),
        )
        .where(F.col("drift_pct") > F.lit(threshold))
    )


def link_trades(trades: DataFrame) -> DataFrame:
    """Entry and exit telemetry rows to one row per trade; open trades have null exits.

    One aggregation with map-side combine instead of a self join.
    """
    entry, exit_ = F.col("event_type") == "trade_entry", F.col("event_type") == "trade_exit"
    pick = lambda cond, c: F.max_by(F.when(cond, F.col(c)), F.when(cond, F.col("timestamp")))
    return trades.groupBy("trade_id").agg(
        *[pick(entry, c).alias(c) for c in ("symbol", "side", "entry_price", "size")],
        pick(entry, "timestamp").alias("entry_time"),
        *[pick(exit_, c).alias(c) for c in ("exit_price", "exit_reason")],
        pick(exit_, "timestamp").alias("exit_time"),
        (F.count_if(exit_) == 0).alias("is_open"),
    )


def fill_progress(orders: DataFrame, fills: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Filled share of leader and follower per leader order, and how far they differ.

    ``orders(leader_oid, owner, total_qty)``, ``fills(leader_oid, owner, qty)``.
    """
    filled = fills.groupBy("leader_oid", "owner").agg(F.sum("qty").alias("filled"))
    both = orders.join(filled, ["leader_oid", "owner"], "left")
    total, done = F.col("total_qty"), F.coalesce("filled", F.lit(0.0))
    pct = F.when(total <= 0, 0.0).otherwise(F.try_divide(done, total) * 100)
    side = lambda who: F.coalesce(
        F.max(F.when(F.col("owner") == who, F.col("pct"))), F.lit(0.0)
    )
    out = (
        both.withColumn("pct", pct)
        .groupBy("leader_oid")
        .agg(side("leader").alias("leader_pct"), side("follower").alias("follower_pct"))
        .withColumn("drift_pct", F.abs(F.col("leader_pct") - F.col("follower_pct")))
    )
    return out.withColumn("warn", F.col("drift_pct") > F.lit(threshold))


def carry_states(
    events: DataFrame,
    states: Sequence[tuple[DataFrame, Sequence[str]]],
    by: str | Sequence[str],
    ts: str,
    state_ts: str = "ts",
    order: str | Sequence[str] = (),
    span: str | int = "1 day",
) -> DataFrame:
    """Each event row with the latest row of every state in structs ``__s0``, ``__s1``, ...

    All states are merged into one timeline, so the events are shuffled once however many states
    there are. Of several state rows at one time the one greatest in ``cols`` order is kept.
    """
    tl = Timeline.of(by, ts)
    ties = list(Timeline.of(by, ts, order).tie)
    merged = events.select(
        *events.columns,
        F.lit(1).alias("__side"),
        *[F.col(c).alias(f"__o{i}") for i, c in enumerate(ties)],
    )
    specs = {}
    for i, (state, cols) in enumerate(states):
        box = F.struct(*[F.col(c).alias(c) for c in cols])
        last = state.groupBy(*tl.by, F.col(state_ts).alias(ts)).agg(F.max(box).alias(f"__s{i}"))
        merged = merged.unionByName(
            last.withColumn("__side", F.lit(0)), allowMissingColumns=True
        )
        specs[f"__s{i}"] = last_known(F.col(f"__s{i}"))
    line = Timeline(tl.by, ts, ("__side", *[f"__o{i}" for i in range(len(ties))]), span)
    carried = running(merged, line, **specs)
    return carried.where(F.col("__side") == 1).select(*events.columns, *specs)


def attach_rolling_state(
    events: DataFrame,
    *states: tuple[DataFrame, Sequence[str]],
    by: str | Sequence[str],
    ts: str,
    state_ts: str = "ts",
    order: str | Sequence[str] = (),
    span: str | int = "1 day",
) -> DataFrame:
    """Rolling states "as of" each event; a state at the event's own time counts."""
    carried = carry_states(events, states, by, ts, state_ts, order, span)
    outs = [
        F.col(f"__s{i}")[c].alias(c) for i, (_, cols) in enumerate(states) for c in cols
    ]
    return carried.select(*events.columns, *outs)


def last_n_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Top ``n`` rows per key; Spark's group limit cuts each map partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
