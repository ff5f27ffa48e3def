"""D3: directional-change detection on a tick stream, with the step function of the batch job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.reversal import State, advance
from tickloom.functions.thresholds import parse_threshold
from tickloom.operators.timeline import micros, span_micros
from tickloom.session import use_rocksdb

OUT_SCHEMA = (
    "symbol string, kind string, event_type string, threshold_down double, threshold_up double, "
    "start_us long, end_us long, start_price double, end_price double, max_osv double, "
    "event_us long"
)
OUT_NAMES = [c.split()[0] for c in OUT_SCHEMA.split(", ")]


STATE = "mode string, high double, high_ts long, low double, low_ts long, anchor double, anchor_ts long, extreme double, extreme_ts long"
_FIELDS = [c.split()[0] for c in STATE.split(", ")]


def _output(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=OUT_NAMES)


def _told(key: str, kind: str, pdf: pd.DataFrame) -> list[tuple]:
    """Ticks that take no part, as rows of the output."""
    return [(key, kind, None, None, None, None, None, None, p, None, u) for u, p in zip(pdf["us"].tolist(), pdf["price"].tolist(), strict=True)]


class TrendProcessor(StatefulProcessor):
    """Per symbol: one trend state per threshold; ticks count in arrival order, those of one Arrow batch by time."""

    def __init__(self, pairs, bucket: int | None = None, idle: int | None = None):
        self.pairs, self.bucket, self.idle = pairs, bucket, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        one = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in STATE.split(", "))
        self.trend = handle.getValueState("trend", f"states array<struct<{one}>>, applied long")

    def _held(self) -> tuple[list[State], int]:
        if not self.trend.exists():
            return [State()] * len(self.pairs), -1
        states, applied = self.trend.get()
        return [State(*s) for s in states], applied

    def _keep(self, states: list[State], applied: int) -> None:
        self.trend.update(([tuple(getattr(s, f) for f in _FIELDS) for s in states], applied))

    def _advance(self, key: str, states: list[State], us: np.ndarray, px: np.ndarray) -> list[tuple]:
        out = []
        for i, (down, up) in enumerate(self.pairs):
            events: list[tuple] = []
            states[i] = advance(states[i], px, us, down, up, events)
            out += [(key, "event", e[0], down, up, *e[1:], e[2]) for e in events]
        return out

    @staticmethod
    def _sound(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        price = pdf["price"].to_numpy(float)
        good = np.isfinite(price) & (price > 0)
        return pdf[good], pdf[~good]

    def handleInputRows(self, key, rows, timerValues):
        states, applied = self._held()
        for pdf in rows:
            pdf, bad = self._sound(pdf.sort_values(["us", "seq"], kind="stable"))
            us = pdf["us"].to_numpy(np.int64)
            yield _output(_told(key[0], "bad", bad) + self._advance(key[0], states, us, pdf["price"].to_numpy(float)))
            applied = max(applied, int(us[-1])) if len(us) else applied
        self._keep(states, applied)

    def close(self) -> None:
        pass


class OrderedTrendProcessor(TrendProcessor):
    """As above in event-time order: ticks wait in time buckets until the watermark has passed their bucket.

    Every Arrow batch is filed by bucket as it comes, under a part number of its own, so a batch costs what it
    holds, not what waits. A bucket's timer is its end; when the watermark gets there, nothing on time can belong
    to the bucket any more and its ticks are sorted and applied. The watermark is that of the whole
    stream, so ticks of a symbol that has fallen silent don't wait for its next one. A tick of a bucket that
    was applied comes out as ``late``. With ``idle`` a symbol without ticks for so long is forgotten.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.parts = handle.getMapState("parts", "bucket long", "n int")
        self.waiting = handle.getMapState("waiting", "bucket long, part int", "us array<long>, seq array<long>, price array<double>")

    def handleInputRows(self, key, rows, timerValues):
        states, applied = self._held()
        for pdf in rows:
            pdf, bad = self._sound(pdf)
            number = pdf["us"].to_numpy(np.int64) // self.bucket
            late = number <= applied
            yield _output(_told(key[0], "bad", bad) + _told(key[0], "late", pdf[late]))
            for bucket, ticks in pdf[~late].groupby(number[~late], sort=False):
                slot = (int(bucket),)
                n = self.parts.getValue(slot)[0] if self.parts.containsKey(slot) else 0
                if not n:
                    self.handle.registerTimer(-(-(int(bucket) + 1) * self.bucket // 1000))
                self.waiting.updateValue((*slot, n), tuple(ticks[c].tolist() for c in ("us", "seq", "price")))
                self.parts.updateValue(slot, (n + 1,))
        self._keep(states, applied)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        states, applied = self._held()
        due = sorted(k[0] for k in self.parts.keys() if (k[0] + 1) * self.bucket <= now)
        for bucket in due:
            ticks = []
            for n in range(self.parts.getValue((bucket,))[0]):
                ticks.append(self.waiting.getValue((bucket, n)))
                self.waiting.removeKey((bucket, n))
            self.parts.removeKey((bucket,))
            us, seq = (np.concatenate([np.asarray(t[i], np.int64) for t in ticks]) for i in (0, 1))
            order = np.lexsort((seq, us))
            yield _output(self._advance(key[0], states, us[order], np.concatenate([np.asarray(t[2], float) for t in ticks])[order]))
            applied = bucket
        if due:
            self._keep(states, applied)
            if self.idle is not None:
                self.handle.registerTimer(-(-((applied + 1) * self.bucket + self.idle) // 1000))
        elif self.idle is not None and (applied + 1) * self.bucket + self.idle <= now and not list(self.parts.keys()):
            self.trend.clear()


def dc_stream(
    ticks: DataFrame, thresholds: Sequence, by: str = "symbol", ts: str = "ts",
    price: str = "price", order: str | None = None, watermark: str | None = None,
    bucket: str | None = None, idle: str | None = None,
) -> DataFrame:
    """Events of a streaming tick frame; ``kind`` is ``event``, ``late`` for ticks too old to use, or
    ``bad`` for prices that aren't finite and above zero.

    State is one small row per symbol for all thresholds. ``watermark`` (such as ``"10 seconds"``)
    turns on event-time order: ticks may come in any order within that time, over any number of files and batches. They are applied
    by ``bucket`` (a sixteenth of the watermark, a second at least) once the watermark is past it. ``idle`` forgets symbols without ticks for so long.
    The counter ``events_emitted`` is observed per batch (X4).
    """
    use_rocksdb(ticks.sparkSession)
    pairs = [parse_threshold(t) for t in thresholds]
    usable = ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull())
    columns = [
        F.col(by).cast("string").alias("symbol"),
        micros(ticks, ts).alias("us"),
        (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("seq"),
        F.col(price).cast("double").alias("price"),
    ]
    if watermark is None:
        rows, processor, mode = usable.select(*columns), TrendProcessor(pairs), "None"
    else:
        wait = span_micros(watermark)
        length = span_micros(bucket) if bucket else max(wait // 16, 1_000_000)
        timed = usable.select(*columns, F.timestamp_micros(micros(ticks, ts)).alias("event_time"))
        # Only the clock of the stream is wanted: the column it comes from goes, so that late ticks get to the processor, which reports them.
        rows = timed.withWatermark("event_time", f"{wait} microseconds").select("symbol", "us", "seq", "price")
        processor, mode = OrderedTrendProcessor(pairs, length, span_micros(idle) if idle else None), "EventTime"
    found = rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUT_SCHEMA, outputMode="update", timeMode=mode,
    )
    found = found.observe("events", F.count_if(F.col("kind") == "event").alias("events_emitted"))
    at = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    return found.select(
        "symbol", "kind", at("start_us").alias("start_time"), at("end_us").alias("end_time"),
        "start_price", "end_price", "event_type", "threshold_down", "threshold_up", "max_osv",
        at("event_us").alias("event_timestamp"), F.current_timestamp().alias("ingested_at"),
    )
