"""Ledgers with feedback against a plain walk through the ticks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import gated
from tickloom.operators.trades import MULTI_GRID, dc_trades_sweep, grid_places, grid_table

T0 = dt.datetime(2024, 1, 1)
RISK = {"sl": [0.01, 0.02], "tp": [0.01, 0.03], "trail": [0.5], "min_profit": [0.002, 0.01]}


def market(n, seed, symbols="AB"):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        px = 100 * np.exp(np.cumsum(rng.normal(0, 0.004, n)))
        rows += [(s, T0 + dt.timedelta(seconds=20 * i), round(float(p), 4), i) for i, p in enumerate(px)]
    return rows


def some_candidates(rows, seed, groups=2):
    rng = np.random.default_rng(seed)
    out = []
    for s, ts, px, i in rows:
        for g in range(groups):
            if rng.random() < 0.12:
                out.append((s, g, i, int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1e6), ts, px, "LONG" if rng.random() < 0.5 else "SHORT", float(rng.choice([0.5, 1.0]))))
    return out


def some_flips(rows, seed):
    rng = np.random.default_rng(seed)
    return {(s, i): ("LONG" if rng.random() < 0.5 else "SHORT") for s, _, _, i in rows if rng.random() < 0.04}


def plainly(rows, candidates, flips, configs, cooldown, most, pause):
    """One tick after another with an open position, as a strategy would."""
    out = []
    for s in sorted({r[0] for r in rows}):
        ticks = sorted((r for r in rows if r[0] == s), key=lambda r: r[3])
        for g in sorted({c[1] for c in candidates}):
            own = {c[2]: c for c in candidates if c[0] == s and c[1] == g}
            for config, (sl, tp, trail, profit) in configs:
                trade, last, streak, until = None, None, 0, None
                for _, ts, px, i in ticks:
                    blocked = False
                    if trade and i > trade["i"]:
                        q, e, p = trade["s"] * px, trade["s"] * trade["p"], trade["p"]
                        best = trade["fav"]
                        trade["fav"], trade["adv"] = max(best, q), min(trade["adv"], q)
                        why = None
                        if flips.get((s, i)) == trade["side"]:
                            why, blocked = "trend_flip", True
                        elif q <= trade["s"] * (p * (1 - trade["s"] * sl)) or ((best - e) / p >= profit and q <= e + (best - e) * trail):
                            why = "trailing_stop_loss"
                        elif q >= trade["s"] * (p * (1 + trade["s"] * tp)):
                            why = "trailing_take_profit"
                        if why:
                            out.append((s, g, config, trade["side"], trade["t"], ts, px, why, trade["f"]))
                            streak = 0 if (px - p) * trade["s"] > 0 else streak + 1
                            until = ts + dt.timedelta(seconds=pause * streak) if streak and most and streak >= most else None
                            trade = None
                    c = own.get(i)
                    if not c or blocked or (until and ts < until) or (trade and trade["side"] == c[6]):
                        continue
                    if trade:
                        out.append((s, g, config, trade["side"], trade["t"], ts, px, "reversal_close", trade["f"]))
                    elif last and (ts - last).total_seconds() < cooldown:
                        continue
                    sign = 1 if c[6] == "LONG" else -1
                    trade, last = {"i": i, "s": sign, "side": c[6], "p": px, "t": ts, "fav": sign * px, "adv": sign * px, "f": c[7]}, ts
    return sorted(out)


@pytest.mark.parametrize("seed, cooldown, most, pause, block", [(1, 0, None, 0, 64), (2, 100, 2, 120, 37), (3, 45, 1, 300, 8192), (4, 200, 3, 60, 100)])
def test_equals_a_walk_through_the_ticks(spark, seed, cooldown, most, pause, block):
    rows = market(500, seed)
    given, flips = some_candidates(rows, seed + 10), some_flips(rows, seed + 20)
    ticks = gated.numbered_ticks(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price double, n long").repartition(5), ["symbol"], order=["n"])
    kind = "symbol string, g int, pos long, us long, entry_time timestamp_ntz, entry_price double, side string, size_factor double"
    us = {(r[0], r[3]): int((r[1] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for r in rows}
    turned = spark.createDataFrame([(s, i, us[s, i], side) for (s, i), side in flips.items()], "symbol string, pos long, us long, against string")
    table = grid_table(spark, RISK)
    configs = table.withColumns(grid_places(RISK)).select("config_id", "sl_at", "tp_at", "tr_at").crossJoin(spark.createDataFrame([(0,), (1,)], "g int"))
    out = gated.gated_ledger(
        spark.createDataFrame(given, kind), ticks, configs, RISK, group=["g"], flips=turned, cooldown_s=cooldown, max_losses=most,
        loss_cooldown_s=pause, position_usd=100.0, span="30 minutes", block=block,
    )
    size = F.round(F.col("size") * F.col("entry_price") / 100, 6)
    got = sorted(tuple(r) for r in out.select("symbol", "g", "config_id", "side", "entry_time", "exit_time", "exit_price", "reason", size).collect())
    sets = [(r.config_id, (r.sl, r.tp, r.trail, r.min_profit)) for r in table.collect()]
    want = plainly(rows, given, flips, sets, cooldown, most, pause)
    assert got == want and {r[7] for r in want} == {"trend_flip", "trailing_stop_loss", "trailing_take_profit", "reversal_close"}


def test_chains_of_any_length(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1 if i + 1 < n and i % 100 != 99 else None) for i in range(n)], "node long, to long")
    got = lambda *roots: sorted(r.node for r in gated.reached(links, spark.createDataFrame([(r,) for r in roots], "node long")).collect())
    assert got(0) == list(range(100)) and got(250, 99) == [99, *range(250, 300)] and got(7000) == [7000]
    tails = {r.node: r.tail for r in gated._tails(links).collect()}
    assert tails == {i: i // 100 * 100 + 99 for i in range(n)}


def test_no_candidates(spark):
    ticks = gated.numbered_ticks(spark.createDataFrame(market(20, 1), "symbol string, ts timestamp_ntz, price double, n long"), ["symbol"], order=["n"])
    none = spark.createDataFrame([], "symbol string, pos long, us long, entry_time timestamp_ntz, entry_price double, side string")
    config = grid_table(spark, RISK).withColumns(grid_places(RISK)).select("config_id", "sl_at", "tp_at", "tr_at")
    assert gated.gated_ledger(none, ticks, config, RISK, max_losses=2).collect() == []


def test_other_grids_are_refused(spark):
    ticks = spark.createDataFrame(market(5, 1), "symbol string, ts timestamp_ntz, price double, n long")
    with pytest.raises(ValueError):
        dc_trades_sweep(ticks, MULTI_GRID)
    with pytest.raises(ValueError):
        gated.multi_scale_sweep(ticks, RISK)


def test_a_search_ends_with_the_trade(spark, monkeypatch):
    """All stops are touched at once and the target never: the search must not walk on through all blocks of the key."""
    prices = [100.0, 100.1, *[90.0 + i % 2 for i in range(400)]]
    rows = [("S", i, i, float(p)) for i, p in enumerate(prices)]
    ticks = spark.createDataFrame(rows, "symbol string, pos long, ts long, px double")
    entries = spark.createDataFrame([("S", 7, 0, 401, 1.0, 100.0)], "symbol string, entry long, pos long, last long, s double, entry_price double")
    grid = {"sl": [0.01, 0.02], "tp": [0.5], "trail": [0.5], "min_profit": [0.3]}
    real, rounds = gated.cut_lineage, []
    monkeypatch.setattr(gated, "cut_lineage", lambda df: rounds.append(1) or real(df))
    (row,) = gated.first_touches(entries, ticks, ["symbol"], grid, block=8).collect()
    assert [h.pos for h in row.sl_hits] == [2, 2] and row.tp_hits == [None] == row.tr_hits
    assert len(rounds) == 2  # the packed blocks and one search


def test_a_long_way_takes_few_rounds(spark, monkeypatch):
    """A target far away is found over growing blocks, and where the price is best and worst on the way stays known."""
    prices = [100.0 + i % 3 for i in range(5000)]
    prices[37], prices[1234], prices[4321] = 104.5, 99.5, 111.0
    ticks = spark.createDataFrame([("S", i, i, p) for i, p in enumerate(prices)], "symbol string, pos long, ts long, px double")
    entries = spark.createDataFrame([("S", 7, 3, 4999, 1.0, 100.0), ("S", 8, 4000, 4100, 1.0, 100.0), ("S", 9, 16, 4999, 1.0, 100.0)], "symbol string, entry long, pos long, last long, s double, entry_price double")
    grid = {"sl": [0.2], "tp": [0.1], "trail": [0.01], "min_profit": [0.2]}
    real, rounds = gated.cut_lineage, []
    monkeypatch.setattr(gated, "cut_lineage", lambda df: rounds.append(1) or real(df))
    found = {r.entry: [(h.pos, h.fav, h.adv) for h in r.tp_hits] for r in gated.first_touches(entries, ticks, ["symbol"], grid, block=8).collect()}
    assert found == {7: [(4321, 111.0, 99.5)], 9: [(4321, 111.0, 99.5)]}
    assert len(rounds) < 20  # 5000 ticks are 625 blocks of 8


def swept(spark, rows, given, flips, cooldown):
    """The ledger of every set of RISK without a loss streak, and what a walk through the ticks gives."""
    ticks = gated.numbered_ticks(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price double, n long").repartition(5), ["symbol"], order=["n"])
    kind = "symbol string, g int, pos long, us long, entry_time timestamp_ntz, entry_price double, side string, size_factor double"
    us = {(r[0], r[3]): int((r[1] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for r in rows}
    turned = spark.createDataFrame([(s, i, us[s, i], side) for (s, i), side in flips.items()], "symbol string, pos long, us long, against string")
    table = grid_table(spark, RISK)
    configs = table.withColumns(grid_places(RISK)).select("config_id", "sl_at", "tp_at", "tr_at").crossJoin(spark.createDataFrame([(0,), (1,)], "g int"))
    out = gated.gated_ledger(spark.createDataFrame(given, kind), ticks, configs, RISK, group=["g"], flips=turned, cooldown_s=cooldown, span="30 minutes", block=64)
    size = F.round(F.col("size") * F.col("entry_price") / 100, 6)
    got = sorted(tuple(r) for r in out.select("symbol", "g", "config_id", "side", "entry_time", "exit_time", "exit_price", "reason", size).collect())
    sets = [(r.config_id, (r.sl, r.tp, r.trail, r.min_profit)) for r in table.collect()]
    return got, plainly(rows, given, flips, sets, cooldown, None, 0)


@pytest.mark.parametrize("stretch, cooldown", [(1, 100), (3, 0), (16, 700), (17, 6000)])
def test_chains_cross_stretches(spark, monkeypatch, stretch, cooldown):
    monkeypatch.setattr(gated, "STRETCH", stretch)
    rows = market(400, stretch)
    given = [c for c in some_candidates(rows, 5) if not (c[1] == 1 and c[0] == "B")]  # a key without candidates
    got, want = swept(spark, rows, given, some_flips(rows, 6), cooldown)
    assert got == want and len(want) > 50


def test_no_table_of_candidates_times_sets_is_stored(spark, monkeypatch):
    """Rounds that each store all candidates under all sets fill the disk."""
    rows = market(400, 8)
    given, sizes, real = some_candidates(rows, 9), [], gated.cut_lineage

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(gated, "cut_lineage", counted)
    got, want = swept(spark, rows, given, {}, 100)
    assert got == want
    assert max(sizes) <= max(len(rows), len(given)) and len(sizes) < 16
