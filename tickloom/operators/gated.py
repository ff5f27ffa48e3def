"""Ledgers whose entries depend on how earlier trades ended (T6, multi-scale T5).

A candidate trade is a node. Where it would end (stop, target, trend flip, reversal) doesn't depend on the
trades before it, so all candidates are priced at once; what does depend on them is which candidates
are taken, and that is a chain of links from trade to trade. No task walks through a key. Without a loss streak a link
depends on its own trade alone: all sets of a candidate lie side by side in one row, and stretches of candidates are described,
chained and walked (``_taken``). With one, links are followed by pointer doubling, so a key with very many trades takes as many
rounds as its number of trades has bits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.dc import confirmations, dc_events, same_threshold
from tickloom.operators.joins import asof_backward
from tickloom.operators.timeline import (
    Timeline,
    count_so_far,
    micros,
    next_known,
    ordered_fold,
    row_index,
    running,
)
from tickloom.operators.trades import MULTI_GRID, TAKER_FEE, grid_places, grid_table, leg_pnl, with_exits
from tickloom.operators.windows import average_direction
from tickloom.session import cut_lineage

BLOCK = 8192  # ticks of a key that are searched at once
GROWTH, LARGEST = 8, 64  # times the block of the round before; at most so many times the first
STEP = 512  # ticks of a block that are looked at before an entry is asked whether it needs more
STRETCH = 1024  # candidates of a key whose chains are followed at once
FAR = np.iinfo(np.int64).max // 2  # a place and a time that no tick has
SENSORS = (0.002, 0.004, 0.008)  # fixed values: thresholds whose confirmations feed the momentum


def reached(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``node`` of every node that chains of links lead to from ``roots(node)``, the roots included.

    ``links(node, to)`` has at most one row per node. Round k holds the jumps over ``2**k`` links and the nodes that
    fewer than ``2**k`` links reach; both double by joins on equal nodes.
    """
    found = cut_lineage(roots.select("node").distinct())
    jumps = cut_lineage(links.where(F.col("to").isNotNull()).select("node", "to"))
    while True:
        new = jumps.join(found, "node", "left_semi").select(F.col("to").alias("node")).distinct()
        new = cut_lineage(new.join(found, "node", "left_anti"))
        if new.isEmpty():
            return found
        found = cut_lineage(found.union(new))
        jumps = cut_lineage(jumps.select("node", F.col("to").alias("via")).join(jumps.select(F.col("node").alias("via"), "to"), "via").select("node", "to"))


def numbered_ticks(
    ticks: DataFrame, by: Sequence[str], ts: str = "ts", price: str = "price", order: Sequence[str] = (), span: str | int = "1 day",
) -> DataFrame:
    """``by..., pos, us, ts, px``: ticks with their place in their key, written out."""
    rows = ticks.select(*by, F.col(ts).alias("ts"), F.col(price).cast("double").alias("px"), micros(ticks, ts).alias("us"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    tl = Timeline.of(list(by), "us", [f"__o{i}" for i in range(len(order))], span)
    return cut_lineage(row_index(rows, tl, "pos").select(*by, "pos", "us", "ts", "px"))


def _after(rows: DataFrame, events: DataFrame, by: Sequence[str], at: Sequence[str], payload: Sequence[str], name: str, span) -> DataFrame:
    """Each row with the first of ``events(by..., us, pos, ...)`` that isn't before ``(at)`` in struct ``name``; one shuffle, no pairs."""
    box = F.struct(*payload)
    asks = rows.select("*", F.col(at[0]).alias("__us"), F.col(at[1]).alias("__pos"), F.lit(0).alias("__kind"))
    facts = events.select(*by, F.col("us").alias("__us"), F.col("pos").alias("__pos"), F.lit(1).alias("__kind"), box.alias("__event"))
    both = asks.unionByName(facts, allowMissingColumns=True)
    tl = Timeline.of(list(by), "__us", ["__pos", "__kind"], span)
    out = running(both, tl, **{name: next_known(F.col("__event"))})
    return out.where("__kind = 0").select(*rows.columns, name)


def first_touches(
    entries: DataFrame, ticks: DataFrame, by: Sequence[str], grid: dict[str, Sequence[float]], block: int = BLOCK
) -> DataFrame:
    """``entry`` and the first tick that touches each stop, target and trailing stop after it, as ``with_exits`` takes them.

    ``entries(by..., entry, pos, last, s, entry_price)`` may be dense and overlap: ``pos`` is the entry's own tick,
    ``last`` the last tick that counts, ``s`` 1 (long) or -1. ``ticks`` come from ``numbered_ticks``.

    Ticks are packed into blocks of equal row counts, and entries meet their block, not each other's ticks. Every entry is
    searched in its own block first, all at once; only those that can still end and have ticks to go
    move on to the next block, with the best and worst price so far. Blocks grow from round to round, so a long way takes few rounds. A set has one stop, one target and one trailing stop, so
    once all values of one of these kinds are touched every set has ended, and later touches (left out) decide nothing.
    So an entry goes as far as its own trade takes, not to the last touch of the widest value.
    """
    own = F.array_sort(F.collect_list(F.struct("pos", "px")))
    packed = cut_lineage(
        ticks.groupBy(*by, F.floor(F.col("pos") / block).alias("block")).agg(F.transform(own, lambda x: x["px"]).alias("px"))
    )
    parts = [("sl", float(v), 0.0) for v in grid["sl"]] + [("tp", float(v), 0.0) for v in grid["tp"]]
    parts += [("tr", float(t), float(m)) for t in grid["trail"] for m in grid["min_profit"]]
    kind_of = np.array([("sl", "tp", "tr").index(p[0]) for p in parts])
    sizes = np.bincount(kind_of, minlength=3)
    fields = ("entry", "pos", "last", "s", "entry_price", "fav", "adv", "hits")
    hit_type = "array<struct<part: int, pos: long, fav: double, adv: double>>"
    names = ", ".join(f"`{c}` {ticks.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{names}, block long, entry long, pos long, last long, s double, entry_price double, fav double, adv double, ended boolean, hits {hit_type}"

    def touched(kind: str, a: float, b: float, r, q: np.ndarray, best: np.ndarray) -> np.ndarray:
        e, p = r["s"] * r["entry_price"], r["entry_price"]
        if kind == "sl":
            return q <= r["s"] * (p * (1.0 - r["s"] * a))
        if kind == "tp":
            return q >= r["s"] * (p * (1.0 + r["s"] * a))
        return ((best - e) / p >= b) & (q <= e + (best - e) * a)

    def ended_by(known: set[int]) -> bool:
        return bool((np.bincount(kind_of[list(known)], minlength=3) == sizes).any()) if known else False

    def search(batches, size):
        for pdf in batches:
            out = []
            for key, number, px, entries_of in zip(pdf[list(by)].itertuples(index=False), pdf["block"], pdf["px"], pdf["entries"], strict=True):
                first = number * size
                for r in entries_of:
                    lo, hi = max(r["pos"] + 1 - first, 0), min(r["last"] + 1 - first, len(px))
                    best, worst, hits = r["fav"], r["adv"], list(r["hits"])
                    known = {h["part"] for h in hits}
                    for lo in range(lo, hi, STEP):
                        q = px[lo : min(lo + STEP, hi)] * r["s"]
                        fav = np.maximum.accumulate(np.concatenate([[best], q]))
                        adv = np.minimum.accumulate(np.concatenate([[worst], q]))
                        best, worst = float(fav[-1]), float(adv[-1])
                        for i, part in enumerate(parts):
                            if i not in known:
                                rows = touched(*part, r, q, fav[:-1])
                                at = int(rows.argmax())
                                if rows[at]:
                                    known.add(i)
                                    hits.append({"part": i, "pos": int(first + lo + at), "fav": float(fav[at + 1]), "adv": float(adv[at + 1])})
                        if ended_by(known):
                            break
                    out.append((*key, number, r["entry"], r["pos"], r["last"], r["s"], r["entry_price"], best, worst, ended_by(known), hits))
            yield pd.DataFrame(out, columns=[*by, "block", *fields[:-1], "ended", fields[-1]])

    start = F.col("s") * F.col("entry_price")
    live = entries.where("last > pos").select(
        *by, F.floor((F.col("pos") + 1) / block).alias("block"), "entry", "pos", "last", F.col("s").cast("double").alias("s"), "entry_price",
        start.alias("fav"), start.alias("adv"), F.expr(f"cast(array() as {hit_type})").alias("hits"),
    )
    done, size = None, block
    while True:
        waiting = live.groupBy(*by, "block").agg(F.collect_list(F.struct(*fields)).alias("entries"))
        searched = cut_lineage(packed.join(waiting, [*by, "block"]).mapInPandas(lambda batches, size=size: search(batches, size), schema))
        over = F.col("ended") | (F.col("last") < (F.col("block") + 1) * size)
        ended = searched.where(over).select(*by, "entry", "hits")
        done = ended if done is None else done.union(ended)
        live = searched.where(~over).withColumn("pos", (F.col("block") + 1) * size - 1)  # the last tick that was searched
        if live.isEmpty():
            break
        if size < block * LARGEST:
            size *= GROWTH
            parts_of = F.array_sort(F.collect_list(F.struct("block", "px")))
            packed = cut_lineage(packed.groupBy(*by, F.floor(F.col("block") / GROWTH).alias("block")).agg(F.flatten(F.transform(parts_of, lambda x: x["px"])).alias("px")))
        live = live.withColumn("block", F.floor((F.col("pos") + 1) / size))
    found = done.select(*by, "entry", F.explode("hits").alias("h")).select(*by, "entry", "h.part", "h.pos", "h.fav", "h.adv")
    priced = found.join(ticks.select(*by, "pos", F.col("ts").alias("exit_time"), F.col("px").alias("exit_price")), [*by, "pos"])
    row = F.struct("pos", "exit_time", "exit_price", "fav", "adv")
    cells = priced.groupBy("entry").agg(*[F.min(F.when(F.col("part") == i, row)).alias(f"__p{i}") for i in range(len(parts))])
    kinds = {k: [f"__p{i}" for i, p in enumerate(parts) if p[0] == k] for k in ("sl", "tp", "tr")}
    return cells.select("entry", *[F.array(*cols).alias(f"{k}_hits") for k, cols in kinds.items()])


class _Stretch:
    """Consecutive candidates of a key: where a trade of each, under each set of exits, lets the next one begin.

    What may come next is a bound, the least time and the least place: the first candidate that is before neither is taken,
    in whichever stretch it is. ``next`` has its number here, or that of all if it is in a later one.
    """

    def __init__(self, rows: pa.Table, exits: np.ndarray, cool: int):
        column = {c: rows.column(c).to_numpy() for c in ("__at", "pos", "us", "__r", "__r_us", "__f", "__f_us")}
        hits = {c: rows.column(c).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) for c in ("__x", "__x_us")}
        self.order = np.argsort(column["__at"])
        self.us, self.pos = column["us"][self.order], column["pos"][self.order]
        r, r_us, f, f_us = (column[c][self.order][:, None] for c in ("__r", "__r_us", "__f", "__f_us"))
        x, x_us = (hits[c][self.order][:, exits].min(2) for c in ("__x", "__x_us"))
        flipped = (f < FAR) & (f <= np.minimum(x, r))
        left = flipped | (x < FAR) & (x <= r)
        end, begin = np.where(flipped, f_us, x_us), np.where(flipped, f + 1, x)
        least = np.maximum(end, self.us[:, None] + cool)
        self.b_us = np.where(left, least, r_us)
        self.b_pos = np.where(left, np.where(least == end, begin, -1), r)
        self.next = np.maximum(self.first(self.b_us, self.b_pos), np.arange(1, len(self.us) + 1)[:, None])

    def first(self, us: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.us, us), np.searchsorted(self.pos, pos))

    def described(self) -> tuple:
        """Which bound the chain leaves with, by where it comes in. Chains soon meet, so this is told by a set's changes alone:
        number of the set, time and place of the candidate before the change, time and place of the bound."""
        us, pos, n = self.b_us.copy(), self.b_pos.copy(), len(self.us)
        for i in range(n - 2, -1, -1):
            sets = np.flatnonzero(self.next[i] < n)
            to = self.next[i, sets]
            us[i, sets], pos[i, sets] = us[to, sets], pos[to, sets]
        new = np.ones(us.shape, bool)
        new[1:] = (us[1:] != us[:-1]) | (pos[1:] != pos[:-1])
        number, at = np.nonzero(new.T)
        before = [np.r_[-FAR, v[:-1]][at] for v in (self.us, self.pos)]
        return int(self.us[-1]), int(self.pos[-1]), number, *before, us[at, number], pos[at, number]

    def walked(self, us: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Row per candidate, column per set: whether it is taken, if the chain comes in with the bounds given."""
        taken = np.zeros(self.next.shape, bool)
        at = self.first(us, pos)
        for i in range(len(self.us)):
            taken[i] = at == i
            at = np.where(taken[i], self.next[i], at)
        return taken


def _taken(rows: DataFrame, configs: DataFrame, grid: dict[str, Sequence[float]], keys: Sequence[str], group: Sequence[str], cool: int, ts_type: str) -> DataFrame:
    """``rows``, those that are taken under some set, with ``config_ids`` of these sets.

    ``rows`` have ``r``, ``f`` and the touches, and in ``__at`` their place among the candidates of the key. Stretches of equal
    row counts are described for every place at which a chain may come in, the descriptions of a key are chained (one row for each
    stretch, streamed), and each stretch is walked from the bounds it really starts with. Nothing of the size of candidates times sets is stored.
    """
    sizes = [len(grid["sl"]), len(grid["tp"]), len(grid["trail"]) * len(grid["min_profit"])]
    sets: dict[tuple, tuple[list, list]] = {}  # of the caller's size, as the grid
    for row in configs.orderBy("config_id").collect():
        ids, exits = sets.setdefault(tuple(row[c] for c in group), ([], []))
        ids.append(row["config_id"])
        exits.append((row["sl_at"], sizes[0] + row["tp_at"], sizes[0] + sizes[1] + row["tr_at"]))
    sets = {k: (np.array(ids), np.array(exits)) for k, (ids, exits) in sets.items()}
    time = lambda c: c.cast("long") if ts_type in ("bigint", "int") else F.unix_micros(c.cast("timestamp"))
    known = lambda c: F.coalesce(c, F.lit(FAR))
    hits = [F.get(F.col(f"{kind}_hits"), i) for kind, n in zip(("sl", "tp", "tr"), sizes, strict=True) for i in range(n)]
    places = rows.withColumns(
        {
            "__stretch": F.floor(F.col("__at") / STRETCH), "__r": known(F.col("r.pos")), "__r_us": known(F.col("r.us")), "__f": known(F.col("f.pos")), "__f_us": known(F.col("f.us")),
            "__x": F.array(*[known(h["pos"]) for h in hits]), "__x_us": F.array(*[known(time(h["exit_time"])) for h in hits]),
        }
    )
    stretch, width, columns = [*keys, "__stretch"], len(keys), rows.columns
    names = ", ".join(f"`{c}` {places.schema[c].dataType.simpleString()}" for c in stretch)
    own = places.select(*stretch, "__at", "pos", "us", "__r", "__r_us", "__f", "__f_us", "__x", "__x_us")
    told = {"last_us": pa.int64(), "last_pos": pa.int64(), "number": pa.list_(pa.int32()), **dict.fromkeys(("before_us", "before_pos", "to_us", "to_pos"), pa.list_(pa.int64()))}
    of = lambda key: sets.get(tuple(v.as_py() for v in key[width - len(group) : width]))

    def describe(key, table):
        chosen = of(key)
        values = _Stretch(table, chosen[1], cool).described() if chosen else [None] * len(told)
        out = table.select(stretch).slice(0, 1 if chosen else 0)
        for (name, kind), value in zip(told.items(), values, strict=True):
            out = out.append_column(name, pa.array([value] if chosen else [], kind))
        return out

    arrays = "number array<int>, before_us array<bigint>, before_pos array<bigint>, to_us array<bigint>, to_pos array<bigint>"
    described = cut_lineage(own.groupBy(*stretch).applyInArrow(describe, f"{names}, last_us bigint, last_pos bigint, {arrays}"))

    def chain(batches):
        key, us, pos = None, None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                here, (last_us, last_pos, number, before_us, before_pos, to_us, to_pos) = row[: width + 1], row[width + 1 :]
                if here[:width] != key:
                    count = int(number[-1]) + 1
                    key, us, pos = here[:width], np.full(count, -FAR), np.full(count, -FAR)
                out.append((*here, us, pos))
                passed = (before_us < us[number]) | (before_pos < pos[number])
                passed[np.r_[True, number[1:] != number[:-1]]] = True
                at = np.r_[0, np.cumsum(np.bincount(number))[:-1]] + np.bincount(number[passed]) - 1
                by_it = (last_us < us) | (last_pos < pos)
                us, pos = np.where(by_it, us, to_us[at]), np.where(by_it, pos, to_pos[at])
            yield pd.DataFrame(out, columns=[*stretch, "from_us", "from_pos"])

    starts = cut_lineage(ordered_fold(described, list(keys), ["__stretch"], chain, f"{names}, from_us array<bigint>, from_pos array<bigint>"))

    def walk(key, table, start):
        chosen = of(key)
        if chosen is None or not start.num_rows or not table.num_rows:
            return table.slice(0, 0).select(columns).append_column("config_ids", pa.array([], pa.list_(pa.int64())))
        s = _Stretch(table, chosen[1], cool)
        taken = s.walked(*(start.column(c).combine_chunks().flatten().to_numpy() for c in ("from_us", "from_pos")))
        some = taken.any(1)
        at, number = np.nonzero(taken)
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(taken.sum(1)[some])], pa.int32()), pa.array(chosen[0][number], pa.int64()))
        return table.select(columns).take(pa.array(s.order[some])).append_column("config_ids", ids)

    both = places.groupBy(*stretch).cogroup(starts.groupBy(*stretch))
    return both.applyInArrow(walk, T.StructType([*rows.schema.fields, T.StructField("config_ids", T.ArrayType(T.LongType()))]))


def gated_ledger(
    candidates: DataFrame,
    ticks: DataFrame,
    configs: DataFrame,
    grid: dict[str, Sequence[float]],
    by: Sequence[str] = ("symbol",),
    group: Sequence[str] = (),
    flips: DataFrame | None = None,
    cooldown_s: float = 10.0,
    max_losses: int | None = None,
    loss_cooldown_s: float = 300.0,
    position_usd: float = 100.0,
    fee: float = TAKER_FEE,
    span: str | int = "1 day",
    block: int = BLOCK,
) -> DataFrame:
    """The ledger of candidates that passed the guards that need no memory, with the guards that do.

    ``candidates(by..., group..., pos, us, entry_time, entry_price, side[, size_factor])`` are the events that may trade, at a tick
    ``pos`` of ``ticks`` (``numbered_ticks``), one of a group at a tick; ``group`` separates candidate sets that never meet (threshold, momentum rule).
    ``configs(group..., config_id, sl_at, tp_at, tr_at)`` has the exits to try, as places in ``grid``.
    ``flips(by..., pos, us, against)`` are ticks at which the dominant trend stands against a side.

    A trade ends at the first of: a tick where the trend is against it (``trend_flip``; nothing enters at that tick), a touched
    stop or target, the next candidate of the other side (``reversal_close``, which then enters whatever the
    cooldown says). Otherwise the next trade is the first candidate from the end on that is
    ``cooldown_s`` after the last entry and not inside the pause of a loss streak: ``loss_cooldown_s`` times the number of
    losses in a row, once they are ``max_losses``. Reversals leave the streak as it is, a win ends it. A trade still open at the end isn't
    reported.

    Without ``max_losses`` the chains are followed stretch by stretch, for all sets of a candidate at once (``_taken``). With it, links
    lead from trade to trade. Along a run of reversals the streak is constant, so runs are one
    node each, and a node is (first trade, losses before it). Nodes with one more loss are made from those
    that lose, until none do; then the chain from the first candidate of each key is followed by ``reached``.
    """
    by, group = list(by), list(group)
    candidates = cut_lineage(candidates)  # read for the cases, the chain's heads and every level of its links
    if not group:
        candidates, configs, group = candidates.withColumn("__all", F.lit(0)), configs.withColumn("__all", F.lit(0)), ["__all"]
    keys = [*by, *group]
    tl = Timeline.of(keys, "us", ["pos", "side"], span)
    here = F.struct("pos", "us", F.col("entry_time").alias("ts"), F.col("entry_price").alias("px"))
    factor = F.col("size_factor").cast("double") if "size_factor" in candidates.columns else F.lit(1.0)
    rows = running(
        candidates.select(*keys, "pos", "us", "entry_time", "entry_price", "side", factor.alias("factor")), tl,
        __long=next_known(F.when(F.col("side") == "LONG", here), current=False),
        __short=next_known(F.when(F.col("side") == "SHORT", here), current=False),
        __at=count_so_far(current=False),
    )
    end = F.when(F.col("side") == "LONG", F.col("__short")).otherwise(F.col("__long"))
    rows = rows.withColumn("__at", F.coalesce("__at", F.lit(0).cast("long")))
    rows = rows.withColumn("r", end).drop("__long", "__short").withColumn("s", F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0))
    if flips is not None:
        state = F.struct("pos", "us", F.col("ts"), F.col("px"))
        facts = flips.join(ticks, [*by, "pos", "us"]).select(*by, "pos", "us", "against", state.alias("f"))
        asks = rows.withColumn("__next", F.col("pos") + 1)
        for side in ("LONG", "SHORT"):
            asks = _after(asks, facts.where(F.col("against") == side), by, ("us", "__next"), ["f"], f"__{side}", span)
        flip = F.when(F.col("side") == "LONG", F.col("__LONG.f")).otherwise(F.col("__SHORT.f"))
        rows = asks.withColumn("f", flip).drop("__LONG", "__SHORT", "__next")
    else:
        rows = rows.withColumn("f", F.lit(None).cast(f"struct<pos: long, us: long, ts: {ticks.schema['ts'].dataType.simpleString()}, px: double>"))
    rows = cut_lineage(rows.withColumn("entry", F.monotonically_increasing_id()))

    # One search per tick and side, however many groups have the candidate; it runs to the last tick that any of them needs.
    ends = ticks.groupBy(*by).agg(F.max("pos").alias("final"))
    limit = F.least(F.coalesce(F.col("r.pos"), F.col("final")), F.coalesce(F.col("f.pos"), F.col("final")))
    wanted = rows.join(ends, by).groupBy(*by, "pos", "side", "s", "entry_price").agg(F.max(limit).alias("last"), F.min("entry").alias("entry"))
    touches = first_touches(wanted, ticks, by, grid, block)
    found = wanted.select(*by, "pos", "side", "entry").join(touches, "entry", "left").drop("entry")
    rows = rows.join(found, [*by, "pos", "side"], "left")
    cool = int(cooldown_s * 1_000_000)
    if max_losses is None:
        rows = _taken(cut_lineage(rows), configs, grid, keys, group, cool, ticks.schema["ts"].dataType.simpleString())
        cases = rows.withColumn("config_id", F.explode("config_ids")).drop("config_ids").join(F.broadcast(configs), [*group, "config_id"])
    else:
        cases = rows.join(F.broadcast(configs), group)
    cases = with_exits(cases, also=["pos"])

    case = [*keys, "config_id"]
    inf = F.lit(np.iinfo(np.int64).max)
    at = {k: F.coalesce(F.col(f"{k}.pos"), inf) for k in ("f", "r")} | {"x": F.coalesce(F.col("exit_pos"), inf)}
    flipped = (at["f"] < inf) & (at["f"] <= F.least(at["x"], at["r"]))
    touched = ~flipped & (at["x"] < inf) & (at["x"] <= at["r"])
    reversed_ = ~flipped & ~touched & (at["r"] < inf)

    def of_end(flip, touch, reversal):
        return F.when(flipped, flip).when(touched, touch).when(reversed_, reversal)

    priced = cases.select(
        *case, "pos", "us", "side", "s", "factor", "entry_time", "entry_price",
        of_end(F.lit("trend_flip"), F.col("reason"), F.lit("reversal_close")).alias("reason"),
        of_end(F.col("f.ts"), F.col("exit_time"), F.col("r.ts")).alias("exit_time"),
        of_end(F.col("f.px"), F.col("exit_price"), F.col("r.px")).alias("exit_price"),
        of_end(at["f"] + 1, at["x"], at["r"]).alias("from_pos"),
        F.when(touched, F.col("fav")).alias("fav"), F.when(touched, F.col("adv")).alias("adv"),
        F.when(reversed_, F.col("r.pos")).alias("r_pos"),
    )
    out = priced if max_losses is None else _after_streaks(priced, candidates, configs, case, group, cool, max_losses, int(loss_cooldown_s * 1_000_000), span)
    e = F.col("s") * F.col("entry_price")
    excursion = lambda x: F.coalesce(F.greatest(x / F.col("entry_price"), F.lit(0.0)), F.lit(0.0))
    closed = out.where("reason is not null").withColumn("mfe_pct", F.when(F.col("fav").isNotNull(), excursion(F.col("fav") - e)).otherwise(0.0))
    closed = closed.withColumn("mae_pct", F.when(F.col("adv").isNotNull(), excursion(e - F.col("adv"))).otherwise(0.0))
    legs = leg_pnl(closed.withColumn("size", F.lit(float(position_usd)) * F.col("factor") / F.col("entry_price")), fee)
    return legs.drop("__all").select(
        *[c for c in case if c != "__all"], "side", "entry_price", "exit_price", "size", "entry_time", "exit_time", "pnl_pct", "pnl_usd", "entry_fee", "exit_fee",
        "total_fees", "net_pnl_usd", "reason", "mfe_pct", "mae_pct",
    )


def _after_streaks(
    priced: DataFrame, candidates: DataFrame, configs: DataFrame, case: Sequence[str], group: Sequence[str], cool: int, max_losses: int, pause: int, span
) -> DataFrame:
    """The rows of ``priced`` that are taken where a streak of losses pauses the entries."""
    keys = case[:-1]
    won = (F.col("exit_price") - F.col("entry_price")) * F.col("s") > 0
    priced = priced.withColumn("won", won).withColumn("x_us", micros(priced, "exit_time"))
    priced = cut_lineage(priced)

    # Runs of reversals: where each run that begins with a trade ends.
    link = priced.select(F.struct(*case, "pos").alias("node"), F.struct(*case, F.col("r_pos").alias("pos")).alias("to"), "r_pos")
    tails = _tails(link.select("node", F.when(F.col("r_pos").isNotNull(), F.col("to")).alias("to")))
    tail = priced.select(F.struct(*case, "pos").alias("tail"), "won", "reason", "x_us", "from_pos", F.col("us").alias("last_us"))
    runs = cut_lineage(tails.join(tail, "tail"))

    starts = candidates.select(*keys, "pos", "us")
    cases_of = configs.select(*group, "config_id")
    heads = starts.groupBy(*keys).agg(F.min("pos").alias("pos")).join(F.broadcast(cases_of), group)
    roots = heads.select(F.struct(F.struct(*case, "pos").alias("run"), F.lit(0).cast("long").alias("losses")).alias("node"))

    def following_runs(nodes: DataFrame) -> DataFrame:
        """``nodes(run, losses)`` with the run and the losses that come next."""
        closed = nodes.join(runs.withColumnRenamed("node", "run"), "run").where("reason is not null")
        after = F.when(F.col("won"), 0).otherwise(F.col("losses") + 1).cast("long")
        out = closed.select("run", "losses", "last_us", "x_us", "from_pos", after.alias("after"), *[F.col(f"run.{k}").alias(k) for k in case])
        until = F.when(F.col("after") >= max_losses, F.col("x_us") + F.col("after") * pause).otherwise(F.lit(0).cast("long"))
        bound = F.greatest(F.col("x_us"), F.col("last_us") + cool, until)
        out = out.withColumn("b_us", bound).withColumn("b_pos", F.when(F.col("b_us") == F.col("x_us"), F.col("from_pos")).otherwise(F.lit(-1).cast("long")))
        ahead = _after(out, starts, keys, ("b_us", "b_pos"), ["pos"], "next", span)
        to = F.struct(*case, F.col("next.pos").alias("pos"))
        return cut_lineage(ahead.where("next is not null").select("run", "losses", to.alias("to"), "after"))

    level = cut_lineage(priced.select(F.struct(*case, "pos").alias("run"), F.lit(0).cast("long").alias("losses")))
    links = None
    while not level.isEmpty():
        linked = following_runs(level)
        links = linked if links is None else links.union(linked)
        level = cut_lineage(linked.where("after > 0").select(F.col("to").alias("run"), F.col("after").alias("losses")).distinct())
    if links is None:
        links = following_runs(level)
    node = F.struct("run", "losses").alias("node")
    to = F.struct(F.col("to").alias("run"), F.col("after").alias("losses")).alias("to")
    taken_runs = reached(links.select(node, to), roots).select(F.col("node.run").alias("node")).distinct()
    taken = reached(link.where("r_pos is not null").select("node", "to"), taken_runs)

    return priced.join(taken.select(*[F.col(f"node.{k}").alias(k) for k in case], F.col("node.pos").alias("pos")), [*case, "pos"], "left_semi")


def _tails(links: DataFrame) -> DataFrame:
    """``node, tail``: the end of the chain from each node of ``links(node, to)`` (``to`` is null at an end), by pointer doubling."""
    jumps = cut_lineage(links.select("node", F.coalesce("to", "node").alias("tail")))
    while True:
        further = jumps.select(F.col("node").alias("tail"), F.col("tail").alias("__far"))
        new = cut_lineage(jumps.join(further, "tail").select("node", F.col("__far").alias("tail"), (F.col("__far") != F.col("tail")).alias("__moved")))
        jumps = new.select("node", "tail")
        if new.where("__moved").isEmpty():
            return jumps


def candidates_of(events: DataFrame, ticks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confirmations as candidates: their tick, side and price. ``ticks`` come from ``numbered_ticks``."""
    rows = confirmations(events)
    rows = rows.select(*by, "threshold_down", "threshold_up", F.col("end_time").alias("entry_time"), F.col("end_price").alias("entry_price"),
        F.when(F.col("event_type") == "PDCC2_UP", "LONG").otherwise("SHORT").alias("side"), micros(rows, "end_time").alias("us"))
    return asof_backward(rows, ticks.select(*by, F.col("us").alias("__at"), "pos"), list(by), "us", "__at", ["pos"], right_order=["pos"])


def multi_scale_sweep(
    ticks: DataFrame,
    grid: dict[str, Sequence[float]] | None = None,
    sensors: Sequence = SENSORS,
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
    """T5 on several scales: ledgers of every set of threshold, alpha, min_score, sl, tp, trail and min_profit.

    Confirmations of the ``sensors`` feed an exponential average of directions; a confirmation of the trade threshold is a
    candidate if the average of its tick is beyond ``min_score`` on its side. A threshold that is a sensor too only feeds the average.
    Events, momentum per alpha and the touches of single values are each computed once. At one tick, sensors come before trades, in order of their thresholds.
    """
    grid = grid or MULTI_GRID
    if set(grid) != set(MULTI_GRID):
        raise ValueError(f"the grid must have {sorted(MULTI_GRID)}, not {sorted(grid)}")
    by = list(by)
    trade = [float(t) for t in grid["threshold"]]
    numbered = numbered_ticks(ticks, by, ts, price, order, span)
    if events is None:
        events = dc_events(ticks, sorted({*map(float, sensors), *trade}), by, ts, price, order, span)
    rows = cut_lineage(candidates_of(events, numbered, by))
    is_sensor = F.greatest(*[same_threshold(rows, t) for t in sensors], F.lit(False))
    felt = rows.where(is_sensor).withColumn("direction", F.when(F.col("side") == "LONG", 1).otherwise(-1))
    tl = Timeline.of(by, "us", ["threshold_down"], span)
    score = cut_lineage(row_index(felt.select(*by, "us", "threshold_down", "direction"), tl, "__i"))
    names = [f"momentum_{a}" for a in range(len(grid["alpha"]))]
    for name, alpha in zip(names, grid["alpha"], strict=True):
        score = average_direction(score, tl, name, alpha=float(alpha))
    score = score.withColumns({name: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(name))) for name in names})
    felt_by = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha_at"), F.col(name).alias("momentum")) for a, name in enumerate(names)]))
    scored = _scored(rows.where(~is_sensor), score, names, by, span).withColumn("__felt", felt_by).select("*", "__felt.*").drop("__felt", *names)
    theta = F.coalesce(*[F.when(same_threshold(scored, t), i) for i, t in enumerate(trade)])
    sign = F.when(F.col("side") == "LONG", F.col("momentum")).otherwise(-F.col("momentum"))
    scores = F.array(*[F.struct(F.lit(i).alias("score_at"), F.lit(float(v)).alias("least")) for i, v in enumerate(grid["min_score"])])
    ready = scored.withColumn("theta", theta).where("theta is not null").withColumn("g", F.explode(scores)).where(F.coalesce(sign, F.lit(0.0)) > F.col("g.least"))
    ready = ready.select(*by, "theta", "alpha_at", F.col("g.score_at").alias("score_at"), "pos", "us", "entry_time", "entry_price", "side")
    place = lambda name: (F.array_position(F.array(*[F.lit(float(v)) for v in grid[name]]), F.col(name)) - 1).cast("int")
    configs = grid_table(ticks.sparkSession, grid)
    configs = configs.withColumns({**grid_places(grid), "theta": place("threshold"), "alpha_at": place("alpha"), "score_at": place("min_score")})
    group = ["theta", "alpha_at", "score_at"]
    configs = configs.select(*group, "config_id", "sl_at", "tp_at", "tr_at")
    out = gated_ledger(ready, numbered, configs, grid, by, group, None, cooldown_s, None, 0.0, position_usd, fee, span)
    return out.drop(*group)


def _scored(rows: DataFrame, score: DataFrame, names: Sequence[str], by: Sequence[str], span) -> DataFrame:
    """Each candidate with the averages ``names`` of the last sensor up to its tick."""
    state = score.select(*by, F.col("us").alias("__at"), *names, "threshold_down")
    return asof_backward(rows, state, by, "us", "__at", names, ["threshold_down"], ["threshold_down"], span=span)
