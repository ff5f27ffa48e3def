"""Thresholds as text, pairs and small tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

Pair = tuple[float, float]


def parse_threshold(text: str | float | Sequence[float], ordered: bool = False) -> Pair:
    """``"0.01"``, ``"0.01:0.02"``, ``"SOL:0.01/0.02"``, a number or a ``(down, up)`` pair.

    With ``ordered`` the smaller value becomes the down threshold.
    """
    down, up = _values(text)
    return (min(down, up), max(down, up)) if ordered else (down, up)


def _values(text: str | float | Sequence[float]) -> Pair:
    if isinstance(text, (int, float)):
        return float(text), float(text)
    if not isinstance(text, str):
        down, up = (float(x) for x in text)
        return down, up
    body = text.strip()
    head, sep, tail = body.partition(":")
    if sep:
        try:
            values = [float(head), float(tail)]
        except ValueError:
            values = [float(x) for x in tail.split("/")]
    else:
        values = [float(x) for x in body.split("/")]
    if len(values) > 2:
        raise ValueError(f"not a threshold: {text!r}")
    return values[0], values[-1]


def symbol_of(text: str) -> str | None:
    """The symbol in ``SYM:a/b``, if there is one."""
    head, sep, _ = text.strip().partition(":")
    try:
        float(head)
    except ValueError:
        return head.strip() if sep else None
    return None


def canonical(pair: Pair, precision: int = 6) -> str:
    down, up = (f"{x:.{precision}f}" for x in pair)
    return down if down == up else f"{down}_{up}"


def table_suffix(pair: Pair, precision: int = 3) -> str:
    return canonical(pair, precision).replace(".", "p")


def threshold_table(spark: SparkSession, thresholds: Iterable) -> DataFrame:
    """One row per threshold; meant for a broadcast join (its size is the caller's list)."""
    rows = []
    for i, item in enumerate(thresholds):
        pair = parse_threshold(item, ordered=True)
        rows.append(
            (
                i,
                *pair,
                canonical(pair),
                f"dc_events_threshold_{table_suffix(pair)}",
                f"X_{table_suffix(pair)}",
                f"dc_detection_threshold_{canonical(pair, 3)}",
            )
        )
    return spark.createDataFrame(
        rows,
        "threshold_id int, threshold_down double, threshold_up double, threshold_text string, "
        "event_table string, feature_table string, experiment string",
    )
