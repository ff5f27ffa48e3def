"""The batch path from raw trades to supervised windows, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import to_local
from tickloom.functions.thresholds import canonical, parse_threshold
from tickloom.operators.dc import dc_events, dc_features_wide
from tickloom.operators.ml import apply_scaler
from tickloom.operators.stats import scaler_fit
from tickloom.operators.timeline import Timeline
from tickloom.operators.windows import chrono_split, dedup_trades, tick_flow, windows
from tickloom.session import cut_lineage

DC_COLUMNS = ("PDCC_Down", "OSV_Down", "PDCC2_UP", "OSV_Up", "regime_up", "regime_down")


def tick_extract(trades: DataFrame, tz: str = "America/Toronto", span: str | int = "1 day") -> DataFrame:
    """S1's rows deduplicated, with returns, durations and cumulative signed volume."""
    unique = dedup_trades(trades)
    tl = Timeline.of(("market", "instrument"), "ts", ("trade_id", "load_time"), span)
    out = tick_flow(unique, tl)
    return out.select(
        "market", "instrument", "trade_id", "ts", to_local(F.col("ts"), tz).alias("local_ts"),
        "price", "vol_base", "vol_quote", "cvd_base", "cvd_quote", "log_return",
        "inter_trade_duration_seconds",
    )


@dataclass(frozen=True)
class WindowPlan:
    """Parameters of ``supervised_windows``."""

    thresholds: Sequence = (0.001, 0.005, 0.01)
    continuous: Sequence[str] = ("price",)
    label: str = "price"
    length: int = 50
    gap: int = 50
    horizon: int = 1
    stride: int = 1
    span: str | int = "1 day"
    order: Sequence[str] = field(default_factory=tuple)


def engineered_ticks(ticks: DataFrame, plan: WindowPlan) -> DataFrame:
    """Ticks with the features of every threshold side by side.

    Events are cut off by a checkpoint: they are small next to the ticks, and every threshold's
    join would otherwise detect them again.
    """
    events = cut_lineage(
        dc_events(ticks, plan.thresholds, order=plan.order, span=plan.span)
    )
    names = {
        "t" + canonical(parse_threshold(t)).replace(".", "p"): t for t in plan.thresholds
    }
    return dc_features_wide(ticks, events, names, DC_COLUMNS, order=plan.order, span=plan.span)


def supervised_windows(ticks: DataFrame, plan: WindowPlan) -> DataFrame:
    """Windows per symbol and split, scaled by the training split's mean and deviation."""
    feats = engineered_ticks(ticks, plan)
    rows = chrono_split(feats, "ts", "symbol", plan.order, span=plan.span)
    osv = [c for c in rows.columns if c.endswith(("OSV_Up", "OSV_Down"))]
    scaled = [*plan.continuous, *osv]
    params = scaler_fit(rows.where("split = 'train'"), scaled)
    flags = [c for c in rows.columns if c.endswith(("PDCC_Down", "PDCC2_UP", "regime_up", "regime_down"))]
    ready = apply_scaler(rows, params, scaled)
    tl = Timeline.of(("symbol", "split"), "ts", plan.order, plan.span)
    inputs = [f"{c}_std" for c in scaled] + flags
    return windows(
        ready, tl, inputs, f"{plan.label}_std", plan.length, plan.gap, plan.horizon, plan.stride
    )
