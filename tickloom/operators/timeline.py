"""Ordered operators that never put a whole key into one task.

A plain ``Window.partitionBy(symbol).orderBy(ts)`` sends every row of a symbol to one task. One
symbol can hold a third of the data, so everything here cuts a key's timeline into pieces:

* ``running`` works inside ``(key, chunk)``, where a chunk is a fixed span of event time, and adds
  what the earlier chunks of the key amount to. That carry comes from a one-row-per-chunk summary
  (map-side combined), so the only window over a whole key sees as many rows as it has chunks.
* ``range_frame`` and ``rows_frame`` copy the few rows a frame can reach across a border into the
  next piece, evaluate the frame there, and keep each row once.

Chunks are a function of the row's own timestamp, so a recomputed task gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec


UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
CHUNK, PIECE, INDEX, MICROS = "__chunk", "__piece", "__index", "__micros"
_UP, _UF = Window.unboundedPreceding, Window.unboundedFollowing


def span_micros(span: str | int) -> int:
    """``"1 day"``, ``"6 hours"`` or a number of microseconds."""
    if isinstance(span, int):
        return span
    amount, unit = span.split()
    return int(float(amount) * UNITS[unit.rstrip("s")] * 1_000_000)


def micros(df: DataFrame, ts: str) -> Column:
    """Event time as whole microseconds; integral columns are taken as they are."""
    kind = df.schema[ts].dataType
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return F.col(ts).cast("long")
    return F.unix_micros(F.col(ts).cast("timestamp"))


@dataclass(frozen=True)
class Timeline:
    """How rows are keyed and ordered. ``by`` must not be null; ``ts`` + ``tie`` is a total order."""

    by: tuple[str, ...]
    ts: str
    tie: tuple[str, ...] = ()
    span: str | int = "1 day"

    @classmethod
    def of(
        cls,
        by: str | Sequence[str],
        ts: str,
        tie: str | Sequence[str] = (),
        span: str | int = "1 day",
    ) -> Timeline:
        as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
        return cls(as_tuple(by), ts, as_tuple(tie), span)

    @property
    def order(self) -> list[Column]:
        return [F.col(c) for c in (self.ts, *self.tie)]

    @property
    def key(self) -> Column:
        return F.struct(*self.order)

    def chunk(self, df: DataFrame) -> Column:
        return F.floor(micros(df, self.ts) / F.lit(span_micros(self.span))).cast("long")

    def with_by(self, *more: str) -> Timeline:
        return replace(self, by=(*self.by, *more))


@dataclass(frozen=True)
class Running:
    """One value carried along a timeline; see the constructors below.

    Windows come in the order of time and against it, and frames only grow: Spark evaluates one that shrinks
    towards the end anew for every row, which is quadratic in the rows of a piece.
    """

    local: Callable[[WindowSpec, WindowSpec], Column]
    total: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def _add(a: Column, b: Column) -> Column:
    zero = F.lit(0)
    return F.when(a.isNull() & b.isNull(), None).otherwise(
        F.coalesce(a, zero) + F.coalesce(b, zero)
    )


def _frame(w: WindowSpec, current: bool) -> WindowSpec:
    return w.rowsBetween(_UP, 0 if current else -1)


def total_so_far(expr: Column, current: bool = True) -> Running:
    return Running(
        lambda w, back: F.sum(expr).over(_frame(w, current)),
        lambda key: F.sum(expr),
        lambda t, before, after: F.sum(t).over(before),
        _add,
    )


def count_so_far(current: bool = True) -> Running:
    return total_so_far(F.lit(1).cast("long"), current)


def max_so_far(expr: Column, current: bool = True) -> Running:
    return Running(
        lambda w, back: F.max(expr).over(_frame(w, current)),
        lambda key: F.max(expr),
        lambda t, before, after: F.max(t).over(before),
        lambda a, b: F.greatest(a, b),
    )


def min_so_far(expr: Column, current: bool = True) -> Running:
    return Running(
        lambda w, back: F.min(expr).over(_frame(w, current)),
        lambda key: F.min(expr),
        lambda t, before, after: F.min(t).over(before),
        lambda a, b: F.least(a, b),
    )


def last_known(expr: Column, current: bool = True) -> Running:
    """Latest non-null value up to this row (forward fill)."""
    return Running(
        lambda w, back: F.last(expr, True).over(_frame(w, current)),
        lambda key: F.max_by(expr, F.when(expr.isNotNull(), key)),
        lambda t, before, after: F.last(t, True).over(before),
        lambda a, b: F.coalesce(a, b),
    )


def next_known(expr: Column, current: bool = True) -> Running:
    """Earliest non-null value from this row on (backward fill)."""
    return Running(
        lambda w, back: F.last(expr, True).over(_frame(back, current)),
        lambda key: F.min_by(expr, F.when(expr.isNotNull(), key)),
        lambda t, before, after: F.last(t, True).over(after),
        lambda a, b: F.coalesce(a, b),
    )


def previous(expr: Column) -> Running:
    """The value on the row before, null or not (``lag``)."""
    boxed = F.struct(expr.alias("v"))
    return Running(
        lambda w, back: F.lag(boxed).over(w),
        lambda key: F.max_by(boxed, key),
        lambda t, before, after: F.last(t, True).over(before),
        lambda a, b: F.coalesce(a, b)["v"],
    )


def following(expr: Column) -> Running:
    """The value on the row after, null or not (``lead``)."""
    boxed = F.struct(expr.alias("v"))
    return Running(
        lambda w, back: F.lead(boxed).over(w),
        lambda key: F.min_by(boxed, key),
        lambda t, before, after: F.last(t, True).over(after),
        lambda a, b: F.coalesce(a, b)["v"],
    )


def max_of_key(expr: Column) -> Running:
    """Maximum over the whole key, on every row."""
    return Running(
        lambda w, back: F.max(expr).over(w.rowsBetween(_UP, _UF)),
        lambda key: F.max(expr),
        lambda t, before, after: F.greatest(F.max(t).over(before), F.max(t).over(after)),
        lambda a, b: F.greatest(a, b),
    )


def running(df: DataFrame, tl: Timeline, **specs: Running) -> DataFrame:
    """Add one column per spec, as a window over the whole key would, without such a window."""
    # The key is one never-null struct, and the summary touches every column, so that both
    # branches below need exactly the same exchange: rows are computed and shuffled once.
    base = df.withColumn(PIECE, F.struct(*tl.by, tl.chunk(df).alias(CHUNK))).repartition(PIECE)
    touched = F.max(F.xxhash64(*base.columns)).alias("__touched")
    inside, back = (Window.partitionBy(PIECE).orderBy(*order) for order in (tl.order, [c.desc() for c in tl.order]))
    across = Window.partitionBy(*[f"{PIECE}.{c}" for c in tl.by])
    before, after = (across.orderBy(o).rowsBetween(_UP, -1) for o in (f"{PIECE}.{CHUNK}", F.col(f"{PIECE}.{CHUNK}").desc()))

    totals = base.groupBy(PIECE).agg(
        *[s.total(tl.key).alias(f"__t_{n}") for n, s in specs.items()], touched
    )
    carries = totals.where(F.col("__touched").isNotNull()).select(
        PIECE,
        *[s.carry(F.col(f"__t_{n}"), before, after).alias(f"__c_{n}") for n, s in specs.items()],
    )
    local = base.select("*", *[s.local(inside, back).alias(f"__l_{n}") for n, s in specs.items()])
    joined = local.join(carries, PIECE, "left")
    kept = [c for c in df.columns if c not in specs]
    return joined.select(
        *kept,
        *[
            s.merge(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n)
            for n, s in specs.items()
        ],
    )


def row_index(df: DataFrame, tl: Timeline, name: str = INDEX) -> DataFrame:
    """Zero-based position of each row inside its key."""
    return running(df, tl, **{name: count_so_far(current=False)}).withColumn(
        name, F.coalesce(F.col(name), F.lit(0).cast("long"))
    )


def range_frame(
    df: DataFrame,
    tl: Timeline,
    lookback: str | int,
    exprs: Callable[[WindowSpec], dict[str, Column]],
    keep: Column | None = None,
    open_left: bool = False,
) -> DataFrame:
    """Frame ``[ts - lookback, ts]`` (or ``(ts - lookback, ts]``) by event time.

    Every row is copied into the later pieces its time can be seen from: at most two copies, as a
    piece is at least as long as the lookback. ``keep`` limits the rows that are returned.
    """
    reach = span_micros(lookback)
    piece = max(reach, span_micros(tl.span))
    base = df.withColumn(MICROS, micros(df, tl.ts))
    first = F.floor(F.col(MICROS) / F.lit(piece)).cast("long")
    last = F.floor((F.col(MICROS) + F.lit(reach)) / F.lit(piece)).cast("long")
    home = first if keep is None else F.when(keep, first)
    copies = base.withColumn("__home", home).withColumn(
        CHUNK, F.explode(F.sequence(first, last))
    )
    w = (
        Window.partitionBy(*tl.by, CHUNK)
        .orderBy(MICROS)
        .rangeBetween(-reach + (1 if open_left else 0), 0)
    )
    out = exprs(w)
    return (
        copies.select("*", *[c.alias(n) for n, c in out.items()])
        .where(F.col("__home") == F.col(CHUNK))
        .drop(CHUNK, MICROS, "__home")
    )


CELLS = 4  # frame lengths in a piece of ``range_sums``


def range_sums(
    df: DataFrame, tl: Timeline, lookback: str | int, sums: dict[str, Column], open_left: bool = False
) -> DataFrame:
    """Per row ``__n`` (rows), ``__first`` (earliest time, microseconds) and sums of its frame ``[ts - lookback, ts]`` by event time.

    As ``range_frame``, whose frames Spark adds up anew for every row, in time that doesn't follow the length of the frame:
    time is cut into cells as long as the frame, so a frame is the end of one cell and the beginning of the next, and both
    are running sums. Nothing is subtracted: rounding stays that of a sum, and NaN stays in the frames that hold it. A
    task holds ``CELLS`` cells of a key and the one before. Sums of whole numbers are longs; a frame of nulls gives null.
    """
    reach = span_micros(lookback)
    asked = df.withColumn(MICROS, micros(df, tl.ts)).withColumns(sums)
    given_names = df.columns
    whole = {n: isinstance(asked.schema[n].dataType, (T.LongType, T.IntegerType)) for n in sums}
    base = asked.withColumns({n: F.col(n).cast("long" if w else "double") for n, w in whole.items()})
    piece = lambda us: F.floor(us / F.lit(reach * CELLS)).cast("long")
    copies = base.withColumn(CHUNK, F.explode(F.sequence(piece(F.col(MICROS)), piece(F.col(MICROS) + F.lit(reach)))))

    def add(table: pa.Table) -> pa.Table:
        us = table[MICROS].to_numpy()
        order = np.argsort(us, kind="stable")
        us = us[order]
        cell = us // reach
        starts = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
        bounds = list(zip(starts, [*starts[1:], len(us)], strict=True))
        own = np.searchsorted(us, cell * reach, "left")
        first = np.searchsorted(us, us - reach, "right" if open_left else "left")
        last = np.searchsorted(us, us, "right") - 1

        def framed(values: np.ndarray) -> np.ndarray:
            ahead, behind = np.empty_like(values), np.empty_like(values)
            for a, b in bounds:
                ahead[a:b] = np.cumsum(values[a:b])
                behind[a:b] = np.cumsum(values[a:b][::-1])[::-1]
            return ahead[last] + np.where(first < own, behind[first], 0)

        home = np.flatnonzero(cell // CELLS == table[CHUNK][0].as_py())
        out = table.select(given_names).take(pa.array(order[home]))
        out = out.append_column("__n", pa.array((last + 1 - first)[home])).append_column("__first", pa.array(us[first][home]))
        for name, is_whole in whole.items():
            given = table[name].combine_chunks()
            known = given.is_valid().to_numpy(zero_copy_only=False)[order]
            numbers = given.fill_null(0).to_numpy(zero_copy_only=False)[order].astype(np.int64 if is_whole else np.longdouble)
            total = framed(numbers).astype(np.int64 if is_whole else float)
            out = out.append_column(name, pa.array(total[home], mask=framed(known.astype(np.int64))[home] == 0))
        return out

    fields = [T.StructField("__n", T.LongType()), T.StructField("__first", T.LongType()), *[T.StructField(n, T.LongType() if w else T.DoubleType()) for n, w in whole.items()]]
    return copies.groupBy(*tl.by, CHUNK).applyInArrow(add, T.StructType([*df.schema.fields, *fields]))


def rows_frame(
    df: DataFrame,
    tl: Timeline,
    before: int,
    after: int,
    exprs: Callable[[WindowSpec], dict[str, Column]],
    block_rows: int = 16_384,
    index: str | None = None,
) -> DataFrame:
    """Frame of ``before`` rows back and ``after`` rows on, in blocks of equal row counts.

    Blocks come from the row's position in its key, so a hot key gives many equal blocks whatever
    its timestamps look like. A block is at least four frames long, so copies stay under 25%.
    """
    block = max(block_rows, 4 * (before + after + 1))
    name = index or INDEX
    indexed = df if index in df.columns else row_index(df, tl, name)
    pos = F.col(name)
    home = F.floor(pos / F.lit(block)).cast("long")
    lo = F.floor(F.greatest(pos - F.lit(after), F.lit(0)) / F.lit(block)).cast("long")
    hi = F.floor((pos + F.lit(before)) / F.lit(block)).cast("long")
    copies = indexed.withColumn("__home", home).withColumn(
        CHUNK, F.explode(F.sequence(lo, hi))
    )
    w = Window.partitionBy(*tl.by, CHUNK).orderBy(name).rowsBetween(-before, after)
    out = exprs(w)
    done = copies.select("*", *[c.alias(n) for n, c in out.items()]).where(
        F.col("__home") == F.col(CHUNK)
    )
    return done.drop(CHUNK, "__home", *([] if index else [name]))


def islands(df: DataFrame, tl: Timeline, starts: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: a new run begins wherever ``starts`` is true."""
    flag = F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return running(df, tl, **{name: total_so_far(flag)})


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str | T.StructType,
) -> DataFrame:
    """Stream each key's rows in order through ``fold``, Arrow batch by Arrow batch.

    All rows of a key meet in one partition but are never held together; callers pass keys that
    are already cut small (chunks, islands, summaries).
    """
    return (
        df.repartition(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys, *order)
        .mapInPandas(fold, schema)
    )


def suggest_span(df: DataFrame, tl: Timeline, target_rows: int = 2_000_000) -> int:
    """Chunk span in microseconds that gives the busiest key about ``target_rows`` per chunk.

    One map-side combined pass over the key and time columns; one row comes back.
    """
    us = micros(df, tl.ts)
    per_key = df.groupBy(*tl.by).agg(
        F.count(F.lit(1)).alias("n"), (F.max(us) - F.min(us)).alias("length")
    )
    row = per_key.agg(F.max_by(F.struct("n", "length"), "n").alias("top")).first()
    if row is None or row.top is None:
        return span_micros(tl.span)
    pieces = max(1, math.ceil(row.top.n / target_rows))
    return max(1_000_000, math.ceil((row.top.length + 1) / pieces))
