"""Regime, momentum and trend per event on a stream of confirmations."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.session import use_rocksdb


OUT_SCHEMA = (
    "symbol string, us long, direction int, regime string, momentum double, bias double, "
    "trend string"
)


class RollingProcessor(StatefulProcessor):
    """Per symbol: the events of the longest lookback, in typed state, and the momentum score.

    A batch is put behind the events that are still in reach. Every window is then a difference of two running
    totals, found by binary search, so an event costs the same whatever the length of the lookback; running totals
    start anew with each batch, so nothing drifts. Directions are counted in whole numbers.
    """

    def __init__(self, regime_s, trend_s, alpha, steady, choppy_rate, strong, least):
        self.regime_us, self.trend_us = int(regime_s * 1e6), int(trend_s * 1e6)
        self.alpha, self.steady, self.choppy_rate, self.strong, self.least = alpha, steady, choppy_rate, strong, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "us array<long>, direction array<int>, tmv array<double>")
        self.score = handle.getValueState("score", "score double")

    def handleInputRows(self, key, rows, timerValues):
        us, d, tmv = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if self.recent.exists():
            us, d, tmv = (np.asarray(x, t) for x, t in zip(self.recent.get(), (np.int64, np.int64, float), strict=True))
        score = self.score.get()[0] if self.score.exists() else 0.0
        # Spark hands a key's rows over in several Arrow batches, each in any order, so they are put together before they are sorted.
        pdf = pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")
        old = len(us)
        us = np.concatenate([us, pdf["us"].to_numpy(np.int64)])
        d = np.concatenate([d, pdf["direction"].to_numpy(np.int64)])
        tmv = np.concatenate([tmv, pdf["tmv"].to_numpy(float)])
        fade = lambda s, x: max(-1.0, min(1.0, self.alpha * x + (1.0 - self.alpha) * s))
        scores = list(accumulate(d[old:].tolist(), fade, initial=score))[1:]
        score = scores[-1] if scores else score
        regime, (bias, trend) = self._regime(us, d, old), self._trend(us, d, tmv, old)
        yield pd.DataFrame({
            "symbol": [key[0]] * (len(us) - old), "us": us[old:], "direction": d[old:].astype(np.int32), "regime": regime,
            "momentum": scores, "bias": bias, "trend": trend,
        })
        kept = us >= us[-1] - max(self.regime_us, self.trend_us) if len(us) else slice(None)
        us, d, tmv = us[kept], d[kept], tmv[kept]
        self.recent.update((us.tolist(), d.tolist(), tmv.tolist()))
        self.score.update((score,))

    @staticmethod
    def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        totals = np.concatenate([[0], np.cumsum(values if values.dtype == np.int64 else values.astype(np.longdouble))])
        return (totals[last] - totals[first]).astype(values.dtype)

    def _windows(self, us: np.ndarray, old: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """First event and end of the window of each new event; events of its own time are inside."""
        return np.searchsorted(us, us[old:] - reach, "left"), np.searchsorted(us, us[old:], "right")

    def _regime(self, us, d, old) -> np.ndarray:
        first, last = self._windows(us, old, self.regime_us)
        n, minutes = last - first, (us[old:] - us[np.minimum(first, max(len(us) - 1, 0))]) / 6e7
        steady = np.abs(self._sums(d, first, last)) / np.maximum(n, 1) >= self.steady
        rate = n / np.where(minutes > 0, minutes, np.inf)
        return np.select([(n < 3) | (minutes < 1), steady, rate > self.choppy_rate], ["quiet", "trending", "choppy"], "neutral")

    def _trend(self, us, d, tmv, old) -> tuple[np.ndarray, np.ndarray]:
        first, last = self._windows(us, old, self.trend_us)
        total = self._sums(tmv, first, last)
        bias = np.divide(self._sums(d * tmv, first, last), total, out=np.zeros(len(total)), where=total != 0)
        known = (last - first >= self.least) & (np.abs(bias) >= self.strong)
        return bias, np.where(known, np.where(bias > 0, "up", "down"), None)

    def close(self) -> None:
        pass


def rolling_stream(
    events: DataFrame, regime_s: float = 600, trend_s: float = 900, alpha: float = 0.3, steady: float = 0.6,
    choppy_rate: float = 4.0, strong: float = 0.6, least: int = 5, order: str | None = None,
) -> DataFrame:
    """``events(symbol, end_time, start_price, end_price, event_type)`` to per-event states.

    Events of a symbol must come in order of time from batch to batch, as ``dc_stream`` gives them; within a batch they are
    sorted. Windows include both ends. ``steady`` is the consistency of a trending regime, ``choppy_rate`` the events
    a minute of a choppy one, ``strong`` the bias of a trend of at least ``least`` events.
    """
    use_rocksdb(events.sparkSession)
    rows = events.where(F.col("event_type").isin("PDCC_Down", "PDCC2_UP")).select(
        "symbol",
        F.unix_micros(F.col("end_time").cast("timestamp")).alias("us"),
        (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("seq"),
        F.when(F.col("event_type") == "PDCC2_UP", 1).otherwise(-1).alias("direction"),
        (F.abs(F.col("end_price") - F.col("start_price")) / F.col("start_price")).alias("tmv"),
    )
    return rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=RollingProcessor(regime_s, trend_s, alpha, steady, choppy_rate, strong, least),
        outputStructType=OUT_SCHEMA,
        outputMode="update",
        timeMode="None",
    )
