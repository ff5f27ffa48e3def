"""Fill pairing, labels, ledgers and metrics."""

import datetime as dt
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import trades as T
from tickloom.operators.dc import confirmations, dc_events
from tickloom.operators.fills import pair_fills
from tickloom.operators.timeline import Timeline
from tickloom.operators.windows import equity_path

T0 = dt.datetime(2024, 1, 1)
FILL = "wallet string, coin string, dir string, px string, sz string, time long, oid long, startPosition string"


def fills(spark, rows, wallet="w"):
    data = [(wallet, "X", d, str(px), str(sz), t, i, str(p)) for i, (d, px, sz, t, p) in enumerate(rows)]
    return spark.createDataFrame(data, FILL)


def paired(spark, rows, **kw):
    done, left = pair_fills(fills(spark, rows), **kw)
    return done.orderBy("exit_time", "fill_no").collect(), left.collect()


REPLAY = [
    ("Open Short", 26.621, 11.26, 1740725886000, 0.0),
    ("Close Short", 26.561, 11.26, 1740725934000, -11.26),
    ("Open Long", 26.89, 11.15, 1740726126000, 0.0),
    ("Long > Short", 26.505, 11.32, 1740726737000, 11.15),
    ("Close Short", 26.436, 0.17, 1740726913000, -0.17),
    ("Open Long", 26.541, 11.3, 1740727480000, 0.0),
    ("Close Long", 26.337, 11.3, 1740727819000, 11.3),
    ("Open Short", 26.172, 11.47, 1740728199000, 0.0),
    ("Close Short", 26.381, 11.47, 1740728512000, -11.47),
    ("Open Long", 26.51, 10.88, 1740728799000, 0.0),
    ("Close Long", 26.71, 10.88, 1740728964000, 10.88),
    ("Open Short", 27.279, 10.99, 1740746214000, 0.0),
    ("Close Short", 27.212, 10.99, 1740746252000, -10.99),
    ("Open Long", 27.551, 10.89, 1740752927000, 0.0),
    ("Close Long", 27.617, 10.89, 1740752978000, 10.89),
]  # fixed values: a recorded sequence


def test_replay_gives_eight_round_trips(spark):
    done, left = paired(spark, REPLAY)
    assert [r.side for r in done] == ["SHORT", "LONG", "SHORT", "LONG", "SHORT", "LONG", "SHORT", "LONG"]
    assert [r.pnl_usd > 0 for r in done] == [True, False, True, False, False, True, True, True]
    assert done[1].reason == "reversal_close" and done[1].entry_price == 26.89
    assert done[2].size == pytest.approx(0.17, abs=0.01)
    assert left == []


def test_scaling_in_partial_close_and_orphans(spark):
    done, left = paired(
        spark,
        [("Close Long", 9, 1, 500, 0), ("Open Long", 10, 1, 1000, 0), ("Open Long", 20, 1, 2000, 1),
         ("Open Short", 99, 5, 2500, 2), ("Close Long", 30, 1.5, 3000, 2)],
    )
    assert len(done) == 1 and done[0].entry_price == 15 and done[0].size == 1.5
    assert done[0].reason == "take_profit"
    assert done[0].total_fees == pytest.approx((15 + 30) * 1.5 * 0.00035)
    assert len(left) == 1 and left[0].side == "LONG" and left[0].size == 0.5


@pytest.mark.parametrize("gap,reason", [(1500, "reversal_close"), (2500, "take_profit")])
def test_reversal_window(spark, gap, reason):
    done, _ = paired(
        spark,
        [("Open Long", 10, 1, 0, 0), ("Close Long", 11, 1, 5000, 1), ("Open Short", 11, 1, 5000 + gap, 0)],
    )
    assert done[0].reason == reason


def test_cut_stretches_equal_one_stream(spark):
    """Reported flat positions are only believed when the stretch before really ended flat."""
    rng = np.random.default_rng(3)
    kinds = ["Open Long", "Close Long", "Open Short", "Close Short", "Long > Short", "Short > Long"]
    rows = [
        (kinds[rng.integers(6)], 10 + rng.integers(5), 1 + rng.integers(3), 1000 * i, rng.integers(2))
        for i in range(400)
    ]
    done, _ = paired(spark, rows)
    side, want = None, []
    for kind, px, sz, t, start in rows:
        if kind.startswith("Open"):
            new = kind.split()[1].upper()
            if side is None:
                side, entry, size, notional = new, px, sz, px * sz
            elif side == new:
                notional, size = notional + px * sz, size + sz
                entry = notional / size
            continue
        if kind.startswith("Close"):
            closing, opening = sz, 0
        else:
            closing = start or sz
            opening = sz - (min(closing, size) if side else closing)
        if side:
            part = min(closing, size)
            want.append((side, pytest.approx(entry), px, part))
            size -= part
            notional = entry * size
            side = side if size > 1e-12 else None
        if opening > 0:
            new = "SHORT" if kind == "Long > Short" else "LONG"
            if side is None:
                side, entry, size, notional = new, px, opening, px * opening
            elif side == new:
                notional, size = notional + px * opening, size + opening
                entry = notional / size
    assert [(r.side, r.entry_price, r.exit_price, r.size) for r in done] == want


def path(spark, prices):
    rows = [("A", T0 + dt.timedelta(minutes=i), i, float(p)) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int, price double")


def simulate(prices, theta, sl, tp, trail, min_profit, cooldown):
    """The rule run tick by tick on one symbol: exits first, then entries."""
    from tickloom.functions.reversal import State, advance

    state, pos, last, done = State(), None, None, []
    for i, p in enumerate(prices):
        events = []
        state = advance(state, np.array([p]), np.array([i]), theta, theta, events)
        if pos:
            s, e = pos["s"], pos["entry"]
            pos["fav"], pos["adv"] = max(pos["fav"], s * p), min(pos["adv"], s * p)
            stop, target = pos["stop"], s * (e * (1 + s * tp))
            if s * p <= stop or s * p >= target:
                why = "trailing_stop_loss" if s * p <= stop else "trailing_take_profit"
                done.append((pos["at"], i, p, why))
                pos = None
            elif s * (p - e) / e >= min_profit:
                pos["stop"] = max(stop, s * e + (pos["fav"] - s * e) * trail)
        for kind, *_ in [x for x in events if x[0].startswith("PDCC")]:
            s = 1 if kind == "PDCC2_UP" else -1
            if pos:
                done.append((pos["at"], i, p, "reversal_close"))
            elif last is not None and (i - last) * 60 < cooldown:
                continue
            pos = {"s": s, "entry": p, "at": i, "fav": s * p, "adv": s * p, "stop": s * (p * (1 - s * sl))}
            last = i
    return done


@pytest.mark.parametrize("cooldown", [0, 1200])
def test_ledger_equals_tick_by_tick_run(spark, cooldown):
    rng = np.random.default_rng(11)
    prices = (100 * np.exp(np.cumsum(rng.normal(0, 0.006, 1500)))).round(4)
    ticks = path(spark, prices)
    events = confirmations(dc_events(ticks, [0.01], order="id"))
    got = T.dc_trades(ticks, events, 0.008, 0.02, 0.5, 0.004, cooldown, order=["id"], span="3 hours")
    minute = lambda t: int((t - T0).total_seconds() // 60)
    rows = sorted((minute(r.entry_time), minute(r.exit_time), r.exit_price, r.reason) for r in got.collect())
    assert rows == sorted(simulate(prices, 0.01, 0.008, 0.02, 0.5, 0.004, cooldown))
    assert len(rows) > 50


def test_sweep_holds_every_single_run(spark):
    rng = np.random.default_rng(12)
    prices = (100 * np.exp(np.cumsum(rng.normal(0, 0.006, 800)))).round(4)
    ticks = path(spark, prices)
    grid = {"threshold": [0.01, 0.02], "sl": [0.005, 0.01], "tp": [0.02], "trail": [0.3, 0.7], "min_profit": [0.002]}
    table = {r.config_id: r for r in T.grid_table(spark, grid).collect()}
    assert len(table) == 8
    out = T.dc_trades_sweep(ticks, grid, cooldown_s=600, order=["id"], span="2 hours").collect()
    minute = lambda t: int((t - T0).total_seconds() // 60)
    for cid, p in table.items():
        mine = sorted((minute(r.entry_time), minute(r.exit_time), r.reason) for r in out if r.config_id == cid)
        want = simulate(prices, p.threshold, p.sl, p.tp, p.trail, p.min_profit, 600)
        assert mine == sorted((a, b, w) for a, b, _, w in want)


def test_default_grids_have_the_documented_sizes(spark):
    assert T.grid_table(spark, T.SINGLE_GRID).count() == 1296
    assert T.grid_table(spark, T.MULTI_GRID).count() == 4608


def ledger(spark, nets, maes=None):
    rows = [
        ("A", T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(minutes=i + 1), i, "LONG", 100.0, 100.0 + n,
         1.0, n / 100, float(n), 0.0, 0.0, 0.0, float(n), "take_profit", 0.0, (maes or [0] * len(nets))[i] / 100)
        for i, n in enumerate(nets)
    ]
    return spark.createDataFrame(
        rows,
        "symbol string, entry_time timestamp_ntz, exit_time timestamp_ntz, id int, side string, entry_price double, "
        "exit_price double, size double, pnl_pct double, pnl_usd double, entry_fee double, exit_fee double, "
        "total_fees double, net_pnl_usd double, reason string, mfe_pct double, mae_pct double",
    )


def test_metrics_edges(spark):
    all_wins = T.trade_metrics(ledger(spark, [1, 2, 3]), order=["id"]).first()
    assert all_wins.profit_factor == float("inf") and all_wins.max_drawdown_usd == 0
    mixed = T.trade_metrics(ledger(spark, [5, -3, -4, 10], [0, 6, 4, 1]), order=["id"], days=2).first()
    assert mixed.max_drawdown_usd == pytest.approx(7)
    assert mixed.max_equity_drawdown_usd >= mixed.max_drawdown_usd
    assert mixed.net_pnl_per_day == pytest.approx(4) and mixed.wins == 2


def test_drawdown_starts_from_zero(spark):
    tl = Timeline.of("symbol", "exit_time", "id", "2 minutes")
    rows = equity_path(ledger(spark, [-5, 2, -1]), tl).orderBy("id").collect()
    assert [r.peak - r.cum for r in rows] == [5, 3, 4]


def test_stop_rule_is_signed_unless_asked(spark):
    positions = spark.createDataFrame(
        [(1, "a", 1.0, 100.0, 106.0, 6.0), (1, "b", 1.0, 100.0, 94.0, -6.0)],
        "account_id int, asset string, size double, entry_price double, current_value double, unrealized_pnl double",
    )
    account = spark.createDataFrame([(1, 10_000.0, 0.0)], "account_id int, total_value double, drawdown_pct double")
    limits = spark.createDataFrame(
        [(5.0, 20.0, 15.0, 30.0)],
        "loss_pct double, profit_pct double, max_drawdown_pct double, max_position_size_pct double",
    )
    fired = lambda **k: sorted(r.asset for r in T.risk_breaches(positions, account, limits, **k).collect())
    assert fired() == ["b"] and fired(legacy_abs=True) == ["a", "b"]


def test_observed_signals(spark):
    rows = [("s", 0, "BUY", 100.0, 1.0), ("s", 1, "CLOSE", 110.0, None), ("s", 2, "SELL", 110.0, 1.0),
            ("s", 3, "NOTE", 1.0, None), ("s", 4, "BUY", 100.0, 1.0)]
    df = spark.createDataFrame(rows, "session_id string, pos int, type string, price double, size double")
    df = df.withColumn("position_size_usd", F.lit(100.0))
    out = T.signal_pnl(df, Timeline.of("session_id", "pos", (), 2)).first()
    assert out.total_trades == 2 and out.gross_pnl_usd == pytest.approx(20)


def test_sets_are_folded_side_by_side(spark):
    """One row per confirmation, whatever the grid: the sets that take it are those of a plain walk, set by set."""
    grid = {"threshold": [0.1, 0.2], "sl": [0.1, 0.2], "tp": [0.3], "trail": [0.5, 0.6], "min_profit": [0.1]}
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        hits = [[(1,) if rng.random() < 0.2 else None for _ in range(n)] for n in (2, 1, 2)]
        rows.append((i, "S", i % 2, 0, 10 * i + int(rng.integers(0, 9)), *hits))
    rows.append((200, "S", 0, 1, 5000, None, None, None))
    box = "array<struct<pos: int>>"
    found = spark.createDataFrame(rows, f"__id long, symbol string, theta int, run long, entry_time long, sl_hits {box}, tp_hits {box}, tr_hits {box}")
    got = {r["__id"]: list(r["__sets"]) for r in T._taken_sets(found, ["symbol"], [0.1, 0.2], grid, 0.00003).collect()}
    want = {}
    for number, (theta, sl, _, trail, _) in enumerate(product(*(range(len(v)) for v in grid.values()))):
        state = {}
        for i, _, th, run, at, *hits in sorted(rows, key=lambda r: (r[3], r[4], r[0])):
            if th == theta:
                last, is_open = state.get(run, (None, False))
                if is_open or last is None or at - last >= 30:
                    want.setdefault(i, []).append(number)
                    closed = hits[0] is not None and any((hits[0][sl], hits[1][0], hits[2][trail]))
                    state[run] = (at, not closed)
                else:
                    state[run] = (last, False)
    assert got == want
