"""Directional-change events and the features built on them.

The detector is sequential per (symbol, threshold), so a symbol's timeline is cut into chunks of
event time and processed in three steps, each parallel over chunks or symbols:

1. ``_summaries``: per chunk, what its ticks do to *any* incoming state.
2. ``_starts``: per symbol, chain the summaries (one small row per chunk) into the exact state each
   chunk starts from.
3. ``_emit``: per chunk, run the ticks from that state and emit events.

No step holds more than a bounded buffer, thresholds never multiply the shuffled ticks, and the
result does not depend on how chunks are cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.reversal import (
    Series,
    State,
    advance_from,
    apply,
    summarise_series,
)
from tickloom.functions.scalars import usable_price, zero_if_bad
from tickloom.functions.thresholds import parse_threshold
from tickloom.operators.joins import asof_backward, asof_in_interval, carry_states
from tickloom.operators.timeline import (
    CHUNK,
    Timeline,
    micros,
    ordered_fold,
    running,
    total_so_far,
)

BUFFER_ROWS = 250_000
PDCC = ("PDCC_Down", "PDCC2_UP")


def _slices(pdf: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, slice]]:
    """Contiguous runs of equal keys in a sorted batch."""
    n = len(pdf)
    if n == 0:
        return
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        col = pdf[k].to_numpy()
        change[1:] |= col[1:] != col[:-1]
    starts = np.flatnonzero(change)
    cols = [pdf[k].to_numpy() for k in keys]
    for a, b in zip(starts, [*starts[1:], n]):
        yield tuple(c[a] for c in cols), slice(a, b)


def _summaries(ticks: DataFrame, by: tuple[str, ...], pairs, schema_by: str) -> DataFrame:
    keys = [*by, CHUNK]

    def fold(batches):
        key, px, ts, held, part = None, [], [], 0, 0

        def flush():
            p, t = np.concatenate(px), np.concatenate(ts)
            x = Series(p, t)
            body = json.dumps([summarise_series(x, d, u) for d, u in pairs])
            row = dict(zip(keys, key), __part=part, summary=body)
            return pd.DataFrame([row])

        for pdf in batches:
            price, when = pdf["__px"].to_numpy(), pdf["__us"].to_numpy()
            for k, s in _slices(pdf, keys):
                if key is not None and (k != key or held >= BUFFER_ROWS):
                    yield flush()
                    part = part + 1 if k == key else 0
                    px, ts, held = [], [], 0
                key = k
                px.append(price[s])
                ts.append(when[s])
                held += s.stop - s.start
        if key is not None:
            yield flush()

    order = ["__us", *[c for c in ticks.columns if c.startswith("__tie")], "__px"]
    return ordered_fold(
        ticks, keys, order, fold, f"{schema_by}, {CHUNK} bigint, __part int, summary string"
    )


def _starts(summaries: DataFrame, by: tuple[str, ...], count: int, schema_by: str) -> DataFrame:
    def fold(batches):
        key, states = None, []
        for pdf in batches:
            rows = []
            chunks, parts = pdf[CHUNK].to_numpy(), pdf["__part"].to_numpy()
            bodies = pdf["summary"].to_numpy()
            for k, s in _slices(pdf, by):
                if k != key:
                    key, states = k, [State()] * count
                for i in range(s.start, s.stop):
                    if parts[i] == 0:
                        state = json.dumps([asdict(x) for x in states])
                        rows.append((*k, chunks[i], state))
                    states = [apply(b, x) for b, x in zip(json.loads(bodies[i]), states)]
            yield pd.DataFrame(rows, columns=[*by, CHUNK, "__state"])

    return ordered_fold(
        summaries, by, [CHUNK, "__part"], fold, f"{schema_by}, {CHUNK} bigint, __state string"
    )


EVENT_COLUMNS = (
    "threshold_down double, threshold_up double, event_type string, __start bigint, __end bigint, "
    "start_price double, end_price double, max_osv double"
)


def _emit(rows: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], pairs, schema_by: str):
    width = len(EVENT_COLUMNS.split(","))

    def fold(batches):
        key, states = None, []
        for pdf in batches:
            out = []
            price, when = pdf["__px"].to_numpy(), pdf["__us"].to_numpy()
            state = pdf["__state"].to_numpy()
            for k, s in _slices(pdf, keys):
                a = s.start
                if k != key:
                    key, states = k, [State()] * len(pairs)
                    if isinstance(state[a], str):
                        states = [State(**x) for x in json.loads(state[a])]
                        a += 1
                if a == s.stop:
                    continue
                x = Series(price[a : s.stop], when[a : s.stop])
                for i, (down, up) in enumerate(pairs):
                    events: list[tuple] = []
                    states[i] = advance_from(states[i], x, 0, down, up, events)
                    out.extend((*k[: len(by)], down, up, *e) for e in events)
            names = [*by, *[f"c{i}" for i in range(width)]]
            frame = pd.DataFrame(out, columns=names)
            frame.columns = [*by, *[c.split()[0] for c in EVENT_COLUMNS.split(", ")]]
            yield frame

    order = ["__us", *[c for c in rows.columns if c.startswith("__tie")], "__px"]
    return ordered_fold(rows, keys, ["__head", *order], fold, f"{schema_by}, {EVENT_COLUMNS}")


def dc_events(
    ticks: DataFrame,
    thresholds: Sequence,
    by: str | Sequence[str] = "symbol",
    ts: str = "ts",
    price: str = "price",
    order: str | Sequence[str] = (),
    span: str | int | None = "1 day",
) -> DataFrame:
    """Confirmations (``PDCC_Down``, ``PDCC2_UP``) and overshoots per key and threshold.

    ``span`` is the chunk length; None runs each key as one stream (cheapest when no key is hot).
    Ticks that ``ts`` and ``order`` leave tied are taken by price, so a rerun gives the same events.
    Prices that aren't finite and above zero take no part; ``bad_ticks`` has them.
    """
    tl = Timeline.of(by, ts, order, span or "1 day")
    pairs = [parse_threshold(t) for t in thresholds]
    kind = ticks.schema[ts].dataType
    ties = {f"__tie{i}": F.col(c) for i, c in enumerate(tl.tie)}
    rows = ticks.where(usable_price(F.col(price)) & F.col(ts).isNotNull()).select(
        *tl.by,
        micros(ticks, ts).alias("__us"),
        F.col(price).cast("double").alias("__px"),
        tl.chunk(ticks).alias(CHUNK),
        *[c.alias(n) for n, c in ties.items()],
    )
    schema_by = ", ".join(f"`{c}` {ticks.schema[c].dataType.simpleString()}" for c in tl.by)
    plain = rows.withColumn("__head", F.lit(1)).withColumn("__state", F.lit(None).cast("string"))
    if span is None:
        found = _emit(plain, tl.by, tl.by, pairs, schema_by)
    else:
        starts = _starts(_summaries(rows, tl.by, pairs, schema_by), tl.by, len(pairs), schema_by)
        heads = starts.withColumn("__head", F.lit(0))
        both = plain.unionByName(heads, allowMissingColumns=True)
        found = _emit(both, (*tl.by, CHUNK), tl.by, pairs, schema_by)
    return found.select(
        *tl.by,
        _time(F.col("__start"), kind).alias("start_time"),
        _time(F.col("__end"), kind).alias("end_time"),
        "start_price",
        "end_price",
        "event_type",
        "threshold_down",
        "threshold_up",
        "max_osv",
    )


def bad_ticks(ticks: DataFrame, ts: str = "ts", price: str = "price") -> DataFrame:
    """The ticks that ``dc_events`` leaves out, with the reason in ``error``."""
    error = F.when(F.col(ts).isNull(), f"no {ts}").when(F.col(price).isNull(), f"no {price}")
    error = error.when(~usable_price(F.col(price)), f"bad {price}")
    return ticks.withColumn("error", error).where(F.col("error").isNotNull())


def _time(us: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return us.cast(kind)
    return F.timestamp_micros(us).cast(kind)


def same_threshold(events: DataFrame, threshold) -> Column:
    down, up = parse_threshold(threshold)
    return (F.abs(events["threshold_down"] - F.lit(down)) <= 1e-12) & (
        F.abs(events["threshold_up"] - F.lit(up)) <= 1e-12
    )


def confirmations(events: DataFrame, threshold=None) -> DataFrame:
    """The PDCC rows, of one threshold if given."""
    rows = events.where(F.col("event_type").isin(*PDCC))
    return rows if threshold is None else rows.where(same_threshold(rows, threshold))


def dc_annotate(
    ticks: DataFrame, events: DataFrame, by: str | Sequence[str] = "symbol", ts: str = "ts"
) -> DataFrame:
    """Mark the ticks where a trend is confirmed and where its overshoot ends.

    A tick that both confirms one trend and ends another's overshoot keeps the confirmation.
    """
    tl = Timeline.of(by, ts)
    # Label per event type.
    label = F.create_map(
        F.lit("PDCC_Down"), F.lit("Downward Start"),
        F.lit("OSV_Down"), F.lit("Downward Update"),
        F.lit("PDCC2_UP"), F.lit("Upward Start"),
        F.lit("OSV_Up"), F.lit("Upward Update"),
    )
    rank = F.when(F.col("event_type").isin(*PDCC), 1).otherwise(0)
    marks = events.groupBy(*tl.by, F.col("end_time").alias(ts)).agg(
        F.max(F.struct(rank.alias("r"), "event_type"))["event_type"].alias("event")
    )
    return ticks.join(marks, [*tl.by, ts], "left").withColumn("event_label", label[F.col("event")])


def dc_features(
    ticks: DataFrame,
    events: DataFrame,
    threshold,
    by: str | Sequence[str] = "symbol",
    ts: str = "ts",
    price: str = "price",
    order: str | Sequence[str] = (),
    span: str | int = "1 day",
) -> DataFrame:
    """Regime, confirmation flags and signed / clamped overshoot for every tick."""
    anchors = confirmations(events, threshold).select(
        *Timeline.of(by, ts).by,
        F.col("end_time").alias("anchor_time"),
        F.col("end_price").alias("anchor_price"),
        "event_type",
    )
    joined = asof_backward(
        ticks, anchors, by, ts, "anchor_time", ["anchor_price", "event_type"], order,
        keep_right_ts=True, span=span,
    )
    regime, cols = _feature_columns(
        F.col("event_type"), F.col("anchor_time"), F.col("anchor_price"), F.col(ts), F.col(price)
    )
    out = joined.withColumn("regime", regime)
    for name, value in cols.items():
        out = out.withColumn(name, value)
    return out.drop("event_type")


def _feature_columns(kind: Column, at: Column, anchor: Column, ts: Column, px: Column):
    """Regime and feature columns from the latest confirmation's type, time and price."""
    up, down, here = kind == "PDCC2_UP", kind == "PDCC_Down", ts == at
    base = F.when(anchor == 0, None).otherwise(anchor)
    rise = F.try_divide(px - base, base) * 100.0
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    floor0 = lambda c: F.greatest(zero_if_bad(c), F.lit(0.0))
    regime = F.when(up, "up").when(down, "down").otherwise(F.lit("none"))
    return regime, {
        "PDCC2_UP": flag(up & here),
        "PDCC_Down": flag(down & here),
        "regime_up": flag(up),
        "regime_down": flag(down),
        "OSV_Up": zero_if_bad(F.when(up, rise)),
        "OSV_Down": zero_if_bad(F.when(down, -rise)),
        "OSV_Up_clamped": floor0(F.when(up, rise)),
        "OSV_Down_clamped": floor0(F.when(down, -rise)),
    }


def dc_features_wide(
    ticks: DataFrame,
    events: DataFrame,
    thresholds: dict[str, object],
    columns: Sequence[str],
    by: str | Sequence[str] = "symbol",
    ts: str = "ts",
    price: str = "price",
    order: str | Sequence[str] = (),
    span: str | int = "1 day",
) -> DataFrame:
    """D4 and D7 in one pass: ``<name>_<column>`` for every named threshold.

    The latest confirmation of each threshold is carried along together, so ticks are shuffled
    once instead of once per threshold and once more to bring the thresholds together.
    """
    keys = Timeline.of(by, ts).by
    cols = ["end_time", "end_price", "event_type"]
    states = [
        (confirmations(events, t).select(*keys, *cols), cols) for t in thresholds.values()
    ]
    out = carry_states(ticks, states, by, ts, "end_time", order, span)
    made = []
    for i, name in enumerate(thresholds):
        box = F.col(f"__s{i}")
        _, feats = _feature_columns(
            box["event_type"], box["end_time"], box["end_price"], F.col(ts), F.col(price)
        )
        made += [feats[c].alias(f"{name}_{c}") for c in columns]
    return out.select(*ticks.columns, *made)


def dc_event_features(events: DataFrame, threshold, version: int = 2) -> DataFrame:
    """Flags and magnitudes per event. Version 1 folds overshoots into the PDCC flags."""
    rows = events.where(same_threshold(events, threshold))
    kind = F.col("event_type")
    size = F.abs((F.col("start_price") - F.col("end_price")) / F.col("start_price") * 100.0)
    is_ = lambda *names: kind.isin(*names).cast("int")
    up = is_("PDCC2_UP", "OSV_Up") if version == 1 else is_("PDCC2_UP")
    down = is_("PDCC_Down", "OSV_Down") if version == 1 else is_("PDCC_Down")
    out = (
        rows.withColumn("PDCC2_UP", up)
        .withColumn("PDCC_Down", down)
        .withColumn("OSV_Up", F.when(kind == "OSV_Up", size).otherwise(0.0))
        .withColumn("OSV_Down", F.when(kind == "OSV_Down", size).otherwise(0.0))
    )
    if version == 1:
        return out
    return out.withColumn("OSV_Up_flag", is_("OSV_Up")).withColumn("OSV_Down_flag", is_("OSV_Down"))


def dc_tick_features(
    ticks: DataFrame,
    events: DataFrame,
    threshold,
    version: int = 2,
    by: str | Sequence[str] = "symbol",
    ts: str = "ts",
    price: str = "price",
    order: str | Sequence[str] = (),
    span: str | int = "1 day",
) -> DataFrame:
    """Each tick inside an event, with its move from the event's start price.

    Version 1 keeps ticks in the open interval; version 2 in ``[start, end)``.
    """
    keys = list(Timeline.of(by, ts).by)
    feats = dc_event_features(events, threshold, version)
    flags = ["PDCC2_UP", "PDCC_Down"] + (["OSV_Up_flag", "OSV_Down_flag"] if version == 2 else [])
    base = ["OSV_Up", "OSV_Down"]
    right = feats.select(*keys, "start_time", "end_time", "start_price", *flags, *base)
    inside = asof_in_interval(
        ticks, right, by, ts, "start_time", "end_time",
        closed="left" if version == 2 else "neither", order=order,
        right_order=("end_time", "OSV_Up", "OSV_Down", *flags), span=span,
    )
    move = F.abs((F.col(price) - F.col("start_price")) / F.col("start_price") * 100.0)
    if version == 1:
        return inside.withColumn(
            "OSV_Up", F.when(F.col("PDCC2_UP") == 1, move).otherwise(F.col("OSV_Up"))
        ).withColumn(
            "OSV_Down", F.when(F.col("PDCC_Down") == 1, move).otherwise(F.col("OSV_Down"))
        )
    # One event is kept per start time, so its flag is already the same on all of its ticks.
    return inside.withColumn(
        "OSV_Up", F.when(F.col("OSV_Up_flag") == 1, move).otherwise(0.0)
    ).withColumn("OSV_Down", F.when(F.col("OSV_Down_flag") == 1, move).otherwise(0.0))


def cross_threshold_features(
    feats: DataFrame,
    common: Sequence[str],
    per_threshold: Sequence[str],
    thresholds: Sequence[str],
    by: str | Sequence[str] = "symbol",
    ts: str = "ts",
    threshold_col: str = "threshold",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Long per-threshold tick rows to one row per tick, shared columns once.

    Per-threshold columns come out as ``<threshold>_<column>`` in the order of ``thresholds``.
    """
    keys = [*Timeline.of(by, ts).by, ts, *tie]
    here = lambda t: F.col(threshold_col) == F.lit(t)
    return feats.groupBy(*keys).agg(
        *[F.max(F.when(here(thresholds[0]), F.col(c))).alias(c) for c in common],
        *[
            F.max(F.when(here(t), F.col(c))).alias(f"{t}_{c}")
            for t in thresholds
            for c in per_threshold
        ],
    )


def regime_stats(
    feats: DataFrame,
    by: str | Sequence[str] = "symbol",
    ts: str = "ts",
    order: str | Sequence[str] = (),
    span: str | int = "1 day",
) -> DataFrame:
    """Length in ticks of the runs between confirmations: mean, sample std, count per side.

    Run numbers come from chunked running sums and lengths from a map-side combined count, so a
    long run is never gathered in one task.
    """
    tl = Timeline.of(by, ts, order, span)
    is_start = (F.col("PDCC2_UP") == 1) | (F.col("PDCC_Down") == 1)
    numbered = running(feats, tl, run=total_so_far(is_start.cast("long")))
    runs = (
        numbered.where(F.col("run") > 0)
        .groupBy(*tl.by, "run")
        .agg(F.count(F.lit(1)).alias("length"), F.max(F.when(is_start, F.col("PDCC2_UP"))).alias("up"))
    )
    stats = []
    for side, flag in (("up", 1), ("down", 0)):
        length = F.when(F.col("up") == flag, F.col("length"))
        stats += [
            F.coalesce(F.avg(length), F.lit(0.0)).alias(f"avg_ticks_{side}_regime"),
            F.when(F.count(length) == 0, 0.0)
            .otherwise(F.stddev_samp(length))
            .alias(f"std_ticks_{side}_regime"),
            F.count(length).alias(f"num_{side}_regimes"),
        ]
    keys = feats.select(*tl.by).distinct()
    return keys.join(runs.groupBy(*tl.by).agg(*stats), list(tl.by), "left").fillna(
        0, [f"num_{s}_regimes" for s in ("up", "down")]
    ).fillna(0.0, [f"avg_ticks_{s}_regime" for s in ("up", "down")])


def feature_quality(
    ticks: DataFrame, events: DataFrame, feats: DataFrame, by: str | Sequence[str] = "symbol"
) -> DataFrame:
    """A10: row counts in and out, anchors, ticks per regime and null counts per key."""
    keys = list(Timeline.of(by, "ts").by)
    checked = (
        "PDCC2_UP", "PDCC_Down", "OSV_Up", "OSV_Down", "OSV_Up_clamped", "OSV_Down_clamped",
    )
    n_in = ticks.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_ticks_input"))
    n_ev = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_dc_events_input"),
        F.count_if(F.col("event_type").isin(*PDCC)).alias("num_pdcc_anchors"),
    )
    n_out = feats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_ticks_output"),
        F.sum("regime_up").alias("regime_up_ticks"),
        F.sum("regime_down").alias("regime_down_ticks"),
        F.count_if(F.col("regime") == "none").alias("none_regime_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_count_{c}") for c in checked],
    )
    return (
        n_in.join(n_ev, keys, "left")
        .join(n_out, keys, "left")
        .fillna(0)
        .withColumn(
            "tick_count_match", (F.col("num_ticks_input") == F.col("num_ticks_output")).cast("int")
        )
    )


def max_overshoot(events: DataFrame, by: str | Sequence[str] = "symbol") -> DataFrame:
    """Largest overshoot, in threshold units, per key, threshold and side."""
    keys = [*Timeline.of(by, "ts").by, "threshold_down", "threshold_up"]
    side = lambda n: F.coalesce(
        F.max(F.when(F.col("event_type") == n, F.col("max_osv"))), F.lit(0.0)
    )
    return events.groupBy(*keys).agg(
        side("OSV_Down").alias("max_osv_down"), side("OSV_Up").alias("max_osv_up")
    )
