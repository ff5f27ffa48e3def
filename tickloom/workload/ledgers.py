"""Trades, labels, sweeps and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import gated as G
from tickloom.operators import trades as T
from tickloom.operators.dc import confirmations, dc_events
from tickloom.operators.fills import pair_fills
from tickloom.operators.joins import attach_rolling_state
from tickloom.operators.timeline import Timeline
from tickloom.session import cut_lineage
from tickloom.workload import market
from tickloom.workload.events import events_of
from tickloom.workload.inputs import (
    FILLS,
    FUNDING,
    SPAN,
    TICKS,
    TRADES,
    WALK,
    dc_sql,
    fills,
    funding,
    trades,
    walk,
)
from tickloom.workload.registry import Tables, query

MONEY = "entry_price exit_price size pnl_pct pnl_usd entry_fee exit_fee total_fees net_pnl_usd"


@query(
    "P18_P19_leg_pnl",
    f"""WITH {TRADES} SELECT symbol, id, side, pnl_pct, pnl_usd, total_fees, net_pnl_usd,
  CASE WHEN id % 5 = 0 THEN 'reversal_close' WHEN pnl_pct > 0 THEN 'take_profit' ELSE 'stop_loss' END AS reason FROM trades""",
    "pnl_pct pnl_usd total_fees net_pnl_usd",
)
def _(t: Tables):
    rows = T.exit_reason(trades(t).withColumn("is_reversal", F.col("id") % 5 == 0))
    return rows.select(
        "symbol", "id", "side", "pnl_pct", "pnl_usd", "total_fees", "net_pnl_usd", "reason"
    )


# A fill at a time: the position before it decides what it does.
PAIRING = f"""{FILLS},
o AS (SELECT *, row_number() OVER w AS rn,
    CASE WHEN dir LIKE 'Open%' THEN 'O' WHEN dir LIKE 'Close%' THEN 'C' ELSE 'F' END AS k,
    CASE WHEN dir IN ('Open Long', 'Short > Long') THEN 'LONG' WHEN dir IN ('Open Short', 'Long > Short') THEN 'SHORT' END AS to_side,
    coalesce(lead(dir) OVER w LIKE 'Open%' AND contains(dir, 'Long') <> contains(lead(dir) OVER w, 'Long')
      AND lead(time) OVER w - time <= 2000, false) AS rev
  FROM fills WINDOW w AS (PARTITION BY wallet, coin ORDER BY time, oid)),
walk AS (
  SELECT DISTINCT wallet, coin, 0::BIGINT AS rn, NULL::VARCHAR AS side, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS size, 0.0::DOUBLE AS notional, NULL::BIGINT AS since,
    NULL::VARCHAR AS t_side, NULL::DOUBLE AS t_entry, NULL::DOUBLE AS t_px, NULL::DOUBLE AS t_size, NULL::BIGINT AS t_since, NULL::BIGINT AS t_time, false AS t_rev FROM fills
  UNION ALL
  SELECT wallet, coin, rn2, CASE WHEN opens THEN new_side ELSE left_side END,
    CASE WHEN opens AND left_side IS NULL THEN px WHEN opens AND left_side = new_side THEN (left_notional + px * open_sz) / (left_size + open_sz) ELSE entry END,
    CASE WHEN opens AND left_side IS NULL THEN open_sz WHEN opens AND left_side = new_side THEN left_size + open_sz ELSE left_size END,
    CASE WHEN opens AND left_side IS NULL THEN px * open_sz WHEN opens AND left_side = new_side THEN left_notional + px * open_sz ELSE left_notional END,
    CASE WHEN opens AND left_side IS NULL THEN time ELSE since END,
    CASE WHEN part IS NOT NULL THEN side END, CASE WHEN part IS NOT NULL THEN entry END, CASE WHEN part IS NOT NULL THEN px END, part,
    CASE WHEN part IS NOT NULL THEN since END, CASE WHEN part IS NOT NULL THEN time END, rev2
  FROM (SELECT *, CASE WHEN k = 'C' THEN false ELSE open_sz > 1e-12 END AS opens_raw,
      CASE WHEN left_side IS NOT NULL AND left_side <> to_side THEN false WHEN k = 'C' THEN false ELSE open_sz > 1e-12 END AS opens, to_side AS new_side
    FROM (SELECT *, CASE WHEN part IS NULL THEN side WHEN size - part <= 1e-12 THEN NULL ELSE side END AS left_side,
        CASE WHEN part IS NULL THEN size ELSE size - part END AS left_size,
        CASE WHEN part IS NULL THEN notional ELSE entry * (size - part) END AS left_notional,
        CASE WHEN k = 'O' THEN sz WHEN k = 'F' THEN sz - coalesce(part, CASE WHEN start_pos > 0 THEN start_pos ELSE sz END) ELSE 0 END AS open_sz
      FROM (SELECT w.wallet, w.coin, w.side, w.entry, w.size, w.notional, w.since, o.rn AS rn2, o.k, o.px, o.sz, o.start_pos, o.time, o.to_side,
          CASE WHEN w.side IS NULL OR o.k = 'O' THEN NULL WHEN o.k = 'C' THEN least(o.sz, w.size)
            ELSE least(CASE WHEN o.start_pos > 0 THEN o.start_pos ELSE o.sz END, w.size) END AS part, o.rev OR o.k = 'F' AS rev2
        FROM walk w JOIN o ON o.wallet = w.wallet AND o.coin = w.coin AND o.rn = w.rn + 1) a) b) c)"""


@query(
    "T1_pair_fills",
    f"""WITH RECURSIVE {PAIRING} SELECT wallet, coin, t_side AS side, t_entry AS entry_price, t_px AS exit_price, t_size AS size,
  make_timestamp(t_since * 1000) AS entry_time, make_timestamp(t_time * 1000) AS exit_time,
  (CASE t_side WHEN 'LONG' THEN t_px - t_entry ELSE t_entry - t_px END) / t_entry * (t_entry * t_size) - (t_entry + t_px) * t_size * 0.00035::DOUBLE AS net_pnl_usd,
  CASE WHEN t_rev THEN 'reversal_close' WHEN (CASE t_side WHEN 'LONG' THEN t_px - t_entry ELSE t_entry - t_px END) > 0 THEN 'take_profit' ELSE 'stop_loss' END AS reason
FROM walk WHERE t_side IS NOT NULL""",
    "entry_price exit_price size net_pnl_usd",
)
def _(t: Tables):
    done, _open = pair_fills(fills(t))
    return done.select(
        "wallet", "coin", "side", "entry_price", "exit_price", "size", "entry_time", "exit_time",
        "net_pnl_usd", "reason",
    )


@query(
    "T1_open_positions",
    f"""WITH RECURSIVE {PAIRING} SELECT wallet, coin, side, entry AS entry_price, size, make_timestamp(since * 1000) AS entry_time
FROM walk WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wallet, coin ORDER BY rn DESC) = 1
  AND rn = (SELECT max(rn) FROM o WHERE o.wallet = walk.wallet AND o.coin = walk.coin)""",
    "entry_price size",
)
def _(t: Tables):
    _done, left = pair_fills(fills(t))
    return left


# Every confirmation of a small threshold on the walk is an entry that lives until the next one of its symbol.
ENTRIES = """entries AS (SELECT symbol, end_time AS entry_time, CASE event_type WHEN 'PDCC2_UP' THEN 'LONG' ELSE 'SHORT' END AS side,
  end_price AS entry_price, lead(end_time) OVER (PARTITION BY symbol ORDER BY end_time) AS until FROM dc WHERE event_type LIKE 'PDCC%')"""


def _entries(ticks: DataFrame) -> DataFrame:
    found = confirmations(dc_events(ticks, [0.004], order="event_id", span=SPAN))
    return cut_lineage(found.select(
        "symbol", F.col("end_time").alias("entry_time"),
        F.when(F.col("event_type") == "PDCC2_UP", "LONG").otherwise("SHORT").alias("side"),
        F.col("end_price").alias("entry_price"),
    ))


def _life(trail: str) -> str:
    """Every tick of every entry, with the stop left by the ticks before it."""
    return f"""{dc_sql([(0.004, 0.004)], ticks=WALK)}, {ENTRIES},
live AS (SELECT e.*, t.ts, t.price, CASE e.side WHEN 'LONG' THEN 1 ELSE -1 END AS s FROM entries e JOIN ticks t
  ON t.symbol = e.symbol AND t.ts > e.entry_time AND (e.until IS NULL OR t.ts < e.until)),
best AS (SELECT *, greatest(s * entry_price, max(s * price) OVER w) AS fav, least(s * entry_price, min(s * price) OVER w) AS adv,
    greatest(s * entry_price, coalesce(max(s * price) OVER b, s * entry_price)) AS prev FROM live
  WINDOW w AS (PARTITION BY symbol, entry_time ORDER BY ts ROWS UNBOUNDED PRECEDING),
    b AS (PARTITION BY symbol, entry_time ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stops AS (SELECT *, {trail} AS stop, s * entry_price * (1 + s * 0.005::DOUBLE) AS target FROM best),
hits AS (SELECT * FROM stops WHERE s * price <= stop OR s * price >= target
  QUALIFY row_number() OVER (PARTITION BY symbol, entry_time ORDER BY ts) = 1)"""


LABEL = """SELECT e.symbol, e.entry_time, e.side, e.entry_price, h.ts AS exit_time, h.price AS exit_price,
  CASE WHEN h.s * h.price <= h.stop THEN 'stop_loss' WHEN h.ts IS NOT NULL THEN 'take_profit' END AS reason,
  greatest((h.fav - h.s * h.entry_price) / h.entry_price, 0) AS mfe_pct, greatest((h.s * h.entry_price - h.adv) / h.entry_price, 0) AS mae_pct
FROM entries e LEFT JOIN hits h USING (symbol, entry_time)"""
FIXED = "s * entry_price * (1 - s * 0.003::DOUBLE)"
TRAIL = f"""greatest({FIXED}, CASE WHEN (prev - s * entry_price) / entry_price >= 0.001::DOUBLE THEN s * entry_price + (prev - s * entry_price) * 0.5::DOUBLE END)"""


@query(
    "T2_barrier_labels",
    f"WITH RECURSIVE {_life(FIXED)} {LABEL}",
    "entry_price exit_price mfe_pct mae_pct",
)
def _(t: Tables):
    ticks = cut_lineage(walk(t))
    return T.barrier_labels(_entries(ticks), ticks, 0.003, 0.005, order=["event_id"], span=SPAN)


@query(
    "T3_trailing_labels", f"WITH RECURSIVE {_life(TRAIL)} {LABEL}", "entry_price exit_price mfe_pct mae_pct"
)
def _(t: Tables):
    ticks = cut_lineage(walk(t))
    return T.trailing_labels(
        _entries(ticks), ticks, 0.003, 0.005, 0.5, 0.001, order=["event_id"], span=SPAN
    )


def _ledger_sql(sl="c.sl", tp="c.tp", trail="c.trail", profit="c.min_profit", configs="", pick="") -> str:
    """Every tick of every trade, then entries one event after another for the cooldown."""
    return f"""pdcc AS (SELECT symbol, threshold_down AS theta, end_time AS born, end_price AS entry_price,
    CASE event_type WHEN 'PDCC2_UP' THEN 'LONG' ELSE 'SHORT' END AS side, CASE event_type WHEN 'PDCC2_UP' THEN 1 ELSE -1 END AS s
  FROM dc WHERE event_type LIKE 'PDCC%'),
e AS (SELECT *, lead(born) OVER w AS nxt, lead(entry_price) OVER w AS nxt_px, row_number() OVER w AS rn FROM pdcc
  WINDOW w AS (PARTITION BY symbol, theta ORDER BY born)),
live AS (SELECT e.*, t.ts, t.price FROM e JOIN ticks t ON t.symbol = e.symbol AND t.ts > e.born AND (e.nxt IS NULL OR t.ts <= e.nxt)),
best AS (SELECT *, greatest(s * entry_price, max(s * price) OVER w) AS fav, least(s * entry_price, min(s * price) OVER w) AS adv,
    greatest(s * entry_price, coalesce(max(s * price) OVER b, s * entry_price)) AS prev FROM live
  WINDOW w AS (PARTITION BY symbol, theta, born ORDER BY ts ROWS UNBOUNDED PRECEDING),
    b AS (PARTITION BY symbol, theta, born ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{configs}
stops AS (SELECT best.*, {pick} greatest(s * entry_price * (1 - s * {sl}), CASE WHEN (prev - s * entry_price) / entry_price >= {profit}
    THEN s * entry_price + (prev - s * entry_price) * {trail} END) AS stop, s * entry_price * (1 + s * {tp}) AS target FROM best {'JOIN cfg c ON c.threshold = best.theta' if pick else ''}),
hits AS (SELECT * FROM stops WHERE s * price <= stop OR s * price >= target
  QUALIFY row_number() OVER (PARTITION BY symbol, theta, {'config_id,' if pick else ''} born ORDER BY ts) = 1),
cases AS (SELECT e.*, {'c.config_id,' if pick else ''} h.ts AS x_ts, h.price AS x_px, CASE WHEN h.s * h.price <= h.stop THEN 'trailing_stop_loss' WHEN h.ts IS NOT NULL THEN 'trailing_take_profit' END AS why,
    h.fav, h.adv FROM e {'JOIN cfg c ON c.threshold = e.theta' if pick else ''} LEFT JOIN hits h ON h.symbol = e.symbol AND h.theta = e.theta AND h.born = e.born {'AND h.config_id = c.config_id' if pick else ''})"""


def _closed_sql(source: str, extra: str = "") -> str:
    return f"""closed AS (SELECT symbol, {extra} side, entry_price, coalesce(x_px, nxt_px) AS exit_price, 100 / entry_price AS size, born AS entry_time,
    coalesce(x_ts, nxt) AS exit_time, coalesce(why, 'reversal_close') AS reason,
    CASE WHEN why IS NULL THEN 0 ELSE greatest((fav - s * entry_price) / entry_price, 0) END AS mfe_pct,
    CASE WHEN why IS NULL THEN 0 ELSE greatest((s * entry_price - adv) / entry_price, 0) END AS mae_pct FROM {source} WHERE why IS NOT NULL OR nxt IS NOT NULL),
priced AS (SELECT *, (CASE side WHEN 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END) / entry_price AS pnl_pct,
    entry_price * size * 0.00035::DOUBLE AS entry_fee, exit_price * size * 0.00035::DOUBLE AS exit_fee FROM closed),
ledger AS (SELECT *, pnl_pct * (entry_price * size) AS pnl_usd, entry_fee + exit_fee AS total_fees,
    pnl_pct * (entry_price * size) - (entry_fee + exit_fee) AS net_pnl_usd FROM priced)"""


COOL = 7200


@query(
    "T4_dc_trades",
    f"""WITH RECURSIVE {dc_sql([(0.3, 0.3)])}, {_ledger_sql("0.3::DOUBLE", "0.5::DOUBLE", "0.5::DOUBLE", "0.1::DOUBLE")},
fold AS (
  SELECT symbol, rn, born AS last, why IS NULL AS open, true AS entered FROM cases WHERE rn = 1
  UNION ALL
  SELECT c.symbol, c.rn, CASE WHEN f.open OR c.born - f.last >= INTERVAL {COOL} SECOND THEN c.born ELSE f.last END,
    (f.open OR c.born - f.last >= INTERVAL {COOL} SECOND) AND c.why IS NULL, f.open OR c.born - f.last >= INTERVAL {COOL} SECOND
  FROM fold f JOIN cases c ON c.symbol = f.symbol AND c.rn = f.rn + 1),
taken AS (SELECT cases.* FROM cases JOIN fold USING (symbol, rn) WHERE entered), {_closed_sql("taken")}
SELECT * FROM ledger""",
    MONEY + " mfe_pct mae_pct",
)
def _(t: Tables):
    events = cut_lineage(confirmations(events_of(t, [0.3])))
    return T.dc_trades(
        t.ticks, events, 0.3, 0.5, 0.5, 0.1, COOL, order=["event_id"], span=SPAN
    )


FEW = {"threshold": [0.1, 0.3], "sl": [0.2, 0.3], "tp": [0.3, 0.6], "trail": [0.3, 0.7], "min_profit": [0.05, 0.1]}
GRID = T.SINGLE_GRID


def _values(grid: dict) -> str:
    """``cfg``: every set of a grid, numbered in order of its values."""
    names, number, lists = list(grid), "0", []
    for i, name in enumerate(names):
        number = f"({number} * {len(grid[name])} + g{i}.i)"
        lists.append("(VALUES " + ", ".join(f"({j}, {v}::DOUBLE)" for j, v in enumerate(grid[name])) + f") g{i}(i, v)")
    picks = ", ".join(f"g{i}.v AS {name}" for i, name in enumerate(names))
    return f"cfg AS (SELECT {number} AS config_id, {picks} FROM {', '.join(lists)}),"


def _sweep_sql(grid: dict, ticks: str) -> str:
    return f"""{dc_sql([(t, t) for t in grid["threshold"]], ticks=ticks)}, {_ledger_sql(configs=_values(grid), pick="c.config_id,")},
fold AS (
  SELECT symbol, theta, config_id, rn, born AS last, why IS NULL AS open, true AS entered FROM cases WHERE rn = 1
  UNION ALL
  SELECT c.symbol, c.theta, c.config_id, c.rn, CASE WHEN f.open OR c.born - f.last >= INTERVAL {COOL} SECOND THEN c.born ELSE f.last END,
    (f.open OR c.born - f.last >= INTERVAL {COOL} SECOND) AND c.why IS NULL, f.open OR c.born - f.last >= INTERVAL {COOL} SECOND
  FROM fold f JOIN cases c ON c.symbol = f.symbol AND c.theta = f.theta AND c.config_id = f.config_id AND c.rn = f.rn + 1),
taken AS (SELECT cases.* FROM cases JOIN fold USING (symbol, theta, config_id, rn) WHERE entered), {_closed_sql("taken", "config_id,")}"""


def _sweep(t: Tables) -> DataFrame:
    ticks = cut_lineage(walk(t))
    return T.dc_trades_sweep(ticks, GRID, None, COOL, order=["event_id"], span=SPAN)


SWEEP = _sweep_sql(GRID, WALK)
SHOWN = "symbol, config_id::BIGINT AS config_id, side, entry_time, exit_time, exit_price, reason, net_pnl_usd, mfe_pct, mae_pct"
LEDGER = ("symbol", "config_id", "side", "entry_time", "exit_time", "exit_price", "reason", "net_pnl_usd", "mfe_pct", "mae_pct")


@query("T5_sweep_1296", f"WITH RECURSIVE {SWEEP} SELECT {SHOWN} FROM ledger", "exit_price net_pnl_usd mfe_pct mae_pct")
def _(t: Tables):
    return _sweep(t).select(*LEDGER)


@query("T5_dc_trades_sweep", f"WITH RECURSIVE {_sweep_sql(FEW, TICKS)} SELECT {SHOWN} FROM ledger", "exit_price net_pnl_usd mfe_pct mae_pct")
def _(t: Tables):
    """A market so jumpy that most ticks are confirmations, and a coarse grid."""
    events = cut_lineage(confirmations(events_of(t, FEW["threshold"])))
    return T.dc_trades_sweep(t.ticks, FEW, events, COOL, order=["event_id"], span=SPAN).select(*LEDGER)


def _gated_sql(cooldown: int, losses: int | None, pause: int, group: str = "symbol", configs: str = "", usd: str = "100") -> str:
    """From ``cand`` (places in ``seqt``, optional ``flip``) to ``ledger``: every tick of every candidate up to its reversal, then one candidate after another."""
    pick = "c.config_id," if configs else ""
    key = f"{group}, config_id" if configs else group
    same = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in group.split(","))
    each = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in key.split(","))
    most = losses or 10**9
    return f"""e AS (SELECT *, CASE side WHEN 'LONG' THEN min(CASE side WHEN 'SHORT' THEN pos END) OVER w ELSE min(CASE side WHEN 'LONG' THEN pos END) OVER w END AS r_pos,
    row_number() OVER (PARTITION BY {group} ORDER BY pos) AS n FROM cand WINDOW w AS (PARTITION BY {group} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
live AS (SELECT e.*, t.ts, t.price, t.pos AS t_pos FROM e JOIN seqt t ON t.symbol = e.symbol AND t.pos > e.pos AND t.pos <= coalesce(e.r_pos, 1000000000)),
best AS (SELECT *, greatest(s * entry_price, max(s * price) OVER w) AS fav, least(s * entry_price, min(s * price) OVER w) AS adv,
    greatest(s * entry_price, coalesce(max(s * price) OVER b, s * entry_price)) AS prev FROM live
  WINDOW w AS (PARTITION BY {group}, pos ORDER BY t_pos ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY {group}, pos ORDER BY t_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{configs}
stops AS (SELECT best.*, {pick} greatest(s * entry_price * (1 - s * c.sl), CASE WHEN (prev - s * entry_price) / entry_price >= c.min_profit
    THEN s * entry_price + (prev - s * entry_price) * c.trail END) AS stop, s * entry_price * (1 + s * c.tp) AS target FROM best JOIN cfg c ON {same('c', 'best') if configs else 'true'}),
hits AS (SELECT * FROM stops WHERE s * price <= stop OR s * price >= target QUALIFY row_number() OVER (PARTITION BY {key}, pos ORDER BY t_pos) = 1),
ends AS (SELECT e.*, {pick} h.t_pos AS x_pos, h.ts AS x_ts, h.price AS x_px, h.fav, h.adv, CASE WHEN h.s * h.price <= h.stop THEN 'trailing_stop_loss' ELSE 'trailing_take_profit' END AS x_why,
    coalesce(e.f_pos <= least(coalesce(h.t_pos, 1000000000), coalesce(e.r_pos, 1000000000)), false) AS flips
  FROM e {f"JOIN cfg c ON {same('c', 'e')}" if configs else ''} LEFT JOIN hits h ON {same('h', 'e')} AND h.pos = e.pos {'AND h.config_id = c.config_id' if configs else ''}),
cases AS (SELECT x.*, CASE WHEN flips THEN 'trend_flip' WHEN x_pos IS NOT NULL THEN x_why WHEN r_pos IS NOT NULL THEN 'reversal_close' END AS why,
    CASE WHEN flips THEN f_pos WHEN x_pos IS NOT NULL THEN x_pos ELSE r_pos END AS end_pos FROM ends x),
done AS (SELECT c.*, t.ts AS end_ts, t.price AS end_px, s * (t.price - entry_price) > 0 AS won FROM cases c LEFT JOIN seqt t ON t.symbol = c.symbol AND t.pos = c.end_pos),
fold AS (
  SELECT {key}, n, pos, why, end_pos, end_ts, won, side, born AS last, true AS entered, true AS open, 0 AS streak, NULL::TIMESTAMP AS until FROM done WHERE n = 1
  UNION ALL
  SELECT {', '.join('d.' + k.strip() for k in key.split(','))}, d.n, d.pos, CASE WHEN go THEN d.why ELSE d.f_why END, CASE WHEN go THEN d.end_pos ELSE d.f_end END, CASE WHEN go THEN d.end_ts ELSE d.f_ts END,
    CASE WHEN go THEN d.won ELSE d.f_won END, CASE WHEN go THEN d.side ELSE d.f_side END, CASE WHEN go THEN d.born ELSE d.f_last END, go, go OR d.held, d.streak2, d.until2
  FROM (SELECT *, NOT blocked AND NOT (held AND side = f_side) AND (until2 IS NULL OR born >= until2) AND (held OR born - f_last >= INTERVAL {cooldown} SECOND) AS go FROM (
    SELECT *, f_open AND NOT shut AS held, shut AND f_why = 'trend_flip' AND f_end = pos AS blocked, CASE WHEN shut THEN CASE WHEN f_won THEN NULL WHEN streak2 >= {most} THEN f_ts + streak2 * INTERVAL {pause} SECOND ELSE f_until END ELSE f_until END AS until2 FROM (
      SELECT *, CASE WHEN NOT shut THEN f_streak WHEN f_won THEN 0 ELSE f_streak + 1 END AS streak2 FROM (
        SELECT d.*, f.why AS f_why, f.end_pos AS f_end, f.end_ts AS f_ts, f.won AS f_won, f.side AS f_side, f.last AS f_last, f.open AS f_open, f.streak AS f_streak, f.until AS f_until,
          f.open AND coalesce(f.why <> 'reversal_close' AND f.end_pos <= d.pos, false) AS shut
        FROM fold f JOIN done d ON {each('d', 'f')} AND d.n = f.n + 1)))) d),
taken AS (SELECT done.* FROM done JOIN fold USING ({key}, n) WHERE entered),
closed AS (SELECT {key}, side, entry_price, end_px AS exit_price, {usd} / entry_price AS size, born AS entry_time, end_ts AS exit_time, why AS reason,
    CASE WHEN why LIKE 'trailing%' THEN greatest((fav - s * entry_price) / entry_price, 0) ELSE 0 END AS mfe_pct, CASE WHEN why LIKE 'trailing%' THEN greatest((s * entry_price - adv) / entry_price, 0) ELSE 0 END AS mae_pct
  FROM taken WHERE why IS NOT NULL),
priced AS (SELECT *, (CASE side WHEN 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END) / entry_price AS pnl_pct,
    entry_price * size * 0.00035::DOUBLE AS entry_fee, exit_price * size * 0.00035::DOUBLE AS exit_fee FROM closed),
ledger AS (SELECT *, pnl_pct * (entry_price * size) - (entry_fee + exit_fee) AS net_pnl_usd FROM priced)"""


PLACED = """seqt AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS pos FROM ticks),
pdcc AS (SELECT d.symbol, d.threshold_down AS theta, t.pos, t.event_id, d.end_time AS born, d.end_price AS entry_price, CASE d.event_type WHEN 'PDCC2_UP' THEN 'LONG' ELSE 'SHORT' END AS side,
    CASE d.event_type WHEN 'PDCC2_UP' THEN 1 ELSE -1 END AS s FROM dc d JOIN seqt t ON t.symbol = d.symbol AND t.ts = d.end_time WHERE d.event_type LIKE 'PDCC%')"""
BARE = lambda sql: sql.replace(market.SENSORS + ",", "")
RISK = {"sl": [0.004], "tp": [0.01], "trail": [0.5], "min_profit": [0.001]}


@query(
    "T6_gated_ledger",
    f"""WITH RECURSIVE {dc_sql([(0.003, 0.003)], ticks=WALK)}, {PLACED}, {market.MOMENTUM}, {BARE(market.REGIME)}, {BARE(market.TREND)},
flipped AS (SELECT seqt.symbol, pos, CASE trend WHEN 'up' THEN 'SHORT' ELSE 'LONG' END AS against FROM trends JOIN seqt USING (event_id) WHERE trend IS NOT NULL),
gates AS (SELECT p.*, CASE side WHEN 'LONG' THEN long_size_factor ELSE short_size_factor END AS factor FROM pdcc p JOIN moments m USING (event_id) JOIN regimes r USING (event_id) JOIN trends t USING (event_id)
  WHERE (CASE side WHEN 'LONG' THEN m.momentum ELSE -m.momentum END) > 0.1 AND r.regime <> 'choppy'),
cand AS (SELECT g.*, f.pos AS f_pos FROM gates g ASOF LEFT JOIN flipped f ON f.symbol = g.symbol AND f.against = g.side AND g.pos < f.pos),
cfg AS (SELECT 0.004::DOUBLE AS sl, 0.01::DOUBLE AS tp, 0.5::DOUBLE AS trail, 0.001::DOUBLE AS min_profit),
{_gated_sql(1800, 2, 3600, usd="100 * factor")} SELECT symbol, side, entry_time, exit_time, entry_price, exit_price, size, reason, net_pnl_usd, mfe_pct, mae_pct FROM ledger""",
    "entry_price exit_price size net_pnl_usd mfe_pct mae_pct",
)
def _(t: Tables):
    ticks = cut_lineage(walk(t))
    numbered = G.numbered_ticks(ticks, ["symbol"], order=["event_id"], span=SPAN)
    events = G.candidates_of(dc_events(ticks, [0.003], order="event_id", span=SPAN), numbered, ["symbol"])
    events = events.withColumns({"event_type": F.when(F.col("side") == "LONG", "PDCC2_UP").otherwise("PDCC_Down"), "ts": F.col("entry_time")})
    trend = cut_lineage(market._trend(t))
    known = attach_rolling_state(
        events, (market._momentum(t), ["momentum"]), (market._regime(t), ["regime"]), (trend, ["trend", "long_size_factor", "short_size_factor"]),
        by="symbol", ts="ts", order="pos", span=SPAN,
    )
    ready = T.gate_trades(known, min_momentum=0.1, use_trend=True).where("decision = 'enter'")
    against = F.when(F.col("trend") == "up", "SHORT").otherwise("LONG").alias("against")
    flips = trend.where("trend is not null").select("symbol", "ts", against).distinct().join(numbered, ["symbol", "ts"]).select("symbol", "pos", "us", "against")
    config = T.grid_table(t.spark, RISK).withColumns(T.grid_places(RISK)).select("config_id", "sl_at", "tp_at", "tr_at")
    out = G.gated_ledger(ready, numbered, config, RISK, flips=flips, cooldown_s=1800, max_losses=2, loss_cooldown_s=3600, span=SPAN)
    return out.select("symbol", "side", "entry_time", "exit_time", "entry_price", "exit_price", "size", "reason", "net_pnl_usd", "mfe_pct", "mae_pct")


MANY = T.MULTI_GRID


def _multi_sql() -> str:
    levels = sorted({*G.SENSORS, *MANY["threshold"]})
    alphas = ", ".join(f"({v}::DOUBLE)" for v in MANY["alpha"])
    scores = ", ".join(f"({v}::DOUBLE)" for v in MANY["min_score"])
    feel = ", ".join(f"{v}::DOUBLE" for v in G.SENSORS)
    cfg = _values(MANY).removesuffix(",").replace("cfg AS", "all_sets AS") + ", cfg AS (SELECT all_sets.*, symbol, threshold AS theta FROM all_sets, (SELECT DISTINCT symbol FROM ticks)),"
    return f"""{dc_sql([(v, v) for v in levels], ticks=WALK)}, {PLACED},
felt AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos, theta) AS k FROM pdcc WHERE theta IN ({feel})),
score AS (SELECT symbol, alpha, k, pos, theta, alpha * s AS m FROM felt, (VALUES {alphas}) a(alpha) WHERE k = 1
  UNION ALL SELECT f.symbol, c.alpha, f.k, f.pos, f.theta, c.alpha * f.s + (1 - c.alpha) * c.m FROM score c JOIN felt f ON f.symbol = c.symbol AND f.k = c.k + 1),
last_score AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY symbol, alpha, pos ORDER BY theta DESC) = 1),
asked AS (SELECT p.*, alpha FROM pdcc p, (VALUES {alphas}) a(alpha) WHERE theta NOT IN ({feel})),
cand AS (SELECT a.*, min_score, NULL::BIGINT AS f_pos FROM (SELECT a.*, l.m FROM asked a ASOF JOIN last_score l ON l.symbol = a.symbol AND l.alpha = a.alpha AND a.pos >= l.pos) a, (VALUES {scores}) g(min_score) WHERE s * m > min_score),
{_gated_sql(3600, None, 0, "symbol, theta, alpha, min_score", cfg)}"""


@query("T5_multi_scale", f"WITH RECURSIVE {_multi_sql()} SELECT {SHOWN} FROM ledger", "exit_price net_pnl_usd mfe_pct mae_pct")
def _(t: Tables):
    return G.multi_scale_sweep(cut_lineage(walk(t)), MANY, cooldown_s=3600, order=["event_id"], span=SPAN).select(*LEDGER)


LEAST = 5  # trades from which on a configuration is reported
SUMMARY = f"""{SWEEP},
curve AS (SELECT *, sum(net_pnl_usd) OVER w AS cum FROM ledger WINDOW w AS (PARTITION BY config_id ORDER BY exit_time, entry_time, symbol ROWS UNBOUNDED PRECEDING)),
peaks AS (SELECT *, greatest(0, max(cum) OVER w) AS peak FROM curve WINDOW w AS (PARTITION BY config_id ORDER BY exit_time, entry_time, symbol ROWS UNBOUNDED PRECEDING)),
summary AS (SELECT config_id::BIGINT AS config_id, count(*) AS total_trades, count(*) FILTER (net_pnl_usd > 0) AS wins, sum(net_pnl_usd) AS net_pnl_usd,
  max(peak - cum) AS max_drawdown_usd, sum(net_pnl_usd) / 30 AS net_pnl_per_day FROM peaks GROUP BY 1 HAVING count(*) >= {LEAST})"""


@query(
    "A7_sweep_summary",
    f"WITH RECURSIVE {SUMMARY} SELECT summary.*, threshold, sl, tp, trail, min_profit FROM summary JOIN cfg USING (config_id)",
    "net_pnl_usd max_drawdown_usd net_pnl_per_day threshold sl tp trail min_profit",
    4,
)
def _(t: Tables):
    out = T.sweep_summary(_sweep(t), T.grid_table(t.spark, GRID), LEAST, 30, span=SPAN)
    return out.select(
        "config_id", "total_trades", "wins", "net_pnl_usd", "max_drawdown_usd",
        "net_pnl_per_day", *GRID,
    )


@query(
    "A8_sweep_patterns",
    f"""WITH RECURSIVE {SUMMARY} SELECT net_pnl_usd > 0 AS profitable, count(*) AS configs, avg(threshold) AS avg_threshold, avg(sl) AS avg_sl, avg(tp) AS avg_tp,
  avg(trail) AS avg_trail, avg(min_profit) AS avg_min_profit FROM summary JOIN cfg USING (config_id) GROUP BY 1""",
    "avg_threshold avg_sl avg_tp avg_trail avg_min_profit",
)
def _(t: Tables):
    return T.sweep_patterns(
        T.sweep_summary(_sweep(t), T.grid_table(t.spark, GRID), LEAST, 30, span=SPAN)
    )


@query(
    "A5_trade_metrics",
    f"""WITH {market.PATH} SELECT symbol, count(*) AS total_trades, 7::INT AS total_signals, count(*) FILTER (net_pnl_usd > 0) AS wins, count(*) FILTER (net_pnl_usd <= 0) AS losses,
  count(*) FILTER (net_pnl_usd > 0) / count(*) * 100 AS win_rate_net, count(*) FILTER (pnl_usd > 0) / count(*) * 100 AS win_rate_gross,
  sum(pnl_usd) AS gross_pnl_usd, sum(total_fees) AS total_fees_usd, sum(net_pnl_usd) AS net_pnl_usd, sum(total_fees) / abs(sum(pnl_usd)) * 100 AS fee_pct_of_gross,
  avg(net_pnl_usd) FILTER (net_pnl_usd > 0) AS avg_win_net_usd, avg(net_pnl_usd) FILTER (net_pnl_usd <= 0) AS avg_loss_net_usd,
  avg(epoch(exit_time) - epoch(entry_time)) AS avg_hold_seconds, max(peak - cum) AS max_drawdown_usd, {market.EQUITY_DD} AS max_equity_drawdown_usd,
  sum(net_pnl_usd) FILTER (net_pnl_usd > 0) / abs(sum(net_pnl_usd) FILTER (net_pnl_usd <= 0)) AS profit_factor,
  count(*) FILTER (pnl_usd > 0 AND net_pnl_usd <= 0) AS trades_eaten_by_fees, sum(total_fees) / count(*) AS per_trade_avg_fee, sum(net_pnl_usd) / 7 AS net_pnl_per_day,
  count(*) FILTER (contains(reason, 'stop_loss')) AS sl_exits, count(*) FILTER (contains(reason, 'take_profit')) AS tp_exits, count(*) FILTER (contains(reason, 'reversal')) AS reversal_exits
FROM path GROUP BY symbol""",
    "win_rate_net win_rate_gross gross_pnl_usd total_fees_usd net_pnl_usd fee_pct_of_gross avg_win_net_usd avg_loss_net_usd "
    "avg_hold_seconds max_drawdown_usd max_equity_drawdown_usd profit_factor per_trade_avg_fee net_pnl_per_day",
    4,
)
def _(t: Tables):
    return T.trade_metrics(trades(t), total_signals=7, order=["id"], span="180 days")


@query(
    "A6_side_breakdown",
    f"""WITH {TRADES}, x AS (SELECT * FROM trades WHERE NOT (symbol = '5-LOW' AND side = 'SHORT')),
k AS (SELECT DISTINCT symbol, side FROM (SELECT DISTINCT symbol FROM x), (VALUES ('LONG'), ('SHORT')) v(side))
SELECT symbol, side, count(id) AS trades, count(*) FILTER (net_pnl_usd > 0) AS wins, count(*) FILTER (net_pnl_usd <= 0) AS losses, coalesce(sum(net_pnl_usd), 0) AS net_pnl_usd
FROM k LEFT JOIN x USING (symbol, side) GROUP BY ALL""",
    "net_pnl_usd",
    4,
)
def _(t: Tables):
    rows = trades(t).where(~((F.col("symbol") == "5-LOW") & (F.col("side") == "SHORT")))
    return T.side_breakdown(rows)


@query(
    "T6_gate_trades",
    f"""WITH RECURSIVE {market.MOMENTUM}, {market.REGIME.replace(market.SENSORS + ',', '')},
{market.TREND.replace(market.SENSORS + ',', '')}, {market.QUOTES},
c AS (SELECT q.symbol, q.quote_ts AS ts, q.quote_id, CASE WHEN q.quote > 20 THEN 'PDCC2_UP' ELSE 'PDCC_Down' END AS event_type,
  s.momentum, s.regime, s.trend, s.long_size_factor, s.short_size_factor FROM quotes q ASOF LEFT JOIN
  (SELECT m.symbol, m.ts, m.momentum, r.regime, t.trend, t.long_size_factor, t.short_size_factor FROM moments m JOIN regimes r USING (event_id) JOIN trends t USING (event_id)) s
  ON q.symbol = s.symbol AND q.quote_ts >= s.ts),
d AS (SELECT *, CASE WHEN NOT (CASE event_type WHEN 'PDCC2_UP' THEN coalesce(momentum, 0) > 0.1 ELSE coalesce(momentum, 0) < -0.1 END) THEN 'momentum'
  WHEN coalesce(regime = 'choppy', false) THEN 'choppy' ELSE 'enter' END AS decision FROM c)
SELECT symbol, ts, quote_id, event_type, decision, CASE WHEN decision = 'enter' THEN coalesce(CASE event_type WHEN 'PDCC2_UP' THEN long_size_factor ELSE short_size_factor END, 1) ELSE 0 END AS size_factor,
  coalesce((trend = 'up' AND event_type = 'PDCC_Down') OR (trend = 'down' AND event_type = 'PDCC2_UP'), false) AS against_trend FROM d""",
    "size_factor",
)
def _(t: Tables):
    quotes = market._quotes(t).select(
        "symbol", F.col("quote_ts").alias("ts"), "quote_id",
        F.when(F.col("quote") > 20, "PDCC2_UP").otherwise("PDCC_Down").alias("event_type"),
    )
    candidates = attach_rolling_state(
        quotes,
        (market._momentum(t), ["momentum"]),
        (market._regime(t), ["regime"]),
        (market._trend(t), ["trend", "long_size_factor", "short_size_factor"]),
        by="symbol", ts="ts", order="quote_id", span=SPAN,
    )
    out = T.gate_trades(candidates, min_momentum=0.1, use_trend=True)
    return out.select(
        "symbol", "ts", "quote_id", "event_type", "decision", "size_factor", "against_trend"
    )


@query(
    "T7_score_events",
    f"""WITH {market.CONTEXT}, x AS (SELECT tc.*, event_type, dc_up_count AS u, dc_down_count AS d, avg_overshoot_pct AS o, event_type = 'PDCC2_UP' AS up,
  (price_high - price_low) / price_low * 100 AS rng, CASE WHEN price_high > price_low THEN (current_price - price_low) / (price_high - price_low) END AS pos,
  CASE WHEN event_id % 11 = 0 THEN 'choppy' ELSE 'neutral' END AS regime, (event_id % 5)::BIGINT AS losses, (event_id % 9)::BIGINT AS wins FROM tc JOIN ec USING (event_id)),
s AS (SELECT *, 0.58 + CASE WHEN price_high > price_low AND tick_count >= 10 AND rng < 0.3 THEN -0.1 ELSE 0 END
  + CASE WHEN up AND price_trend_pct > 0.5 THEN 0.1 WHEN up AND price_trend_pct < -1 THEN -0.1 WHEN NOT up AND price_trend_pct < -0.5 THEN 0.1 WHEN NOT up AND price_trend_pct > 1 THEN -0.1 ELSE 0 END
  + CASE WHEN up AND pos < 0.4 THEN 0.05 WHEN up AND pos > 0.8 THEN -0.05 ELSE 0 END
  + CASE WHEN up AND u / (u + d) > 0.6 THEN 0.05 WHEN NOT up AND d / (u + d) > 0.6 THEN 0.05 ELSE 0 END
  + CASE WHEN wins / 10 > 0.6 THEN 0.05 WHEN wins / 10 < 0.3 THEN -0.05 ELSE 0 END AS score FROM x),
a AS (SELECT *, CASE WHEN regime = 'choppy' THEN 'skip_choppy' WHEN losses >= CASE WHEN losses < 3 THEN 3 ELSE 4 END THEN 'skip_losses' WHEN up THEN 'enter_long' ELSE 'enter_short' END AS action FROM s)
SELECT symbol, ts, event_id, action, CASE action WHEN 'skip_choppy' THEN 0.3 WHEN 'skip_losses' THEN 0.2 ELSE score END AS confidence,
  CASE WHEN action LIKE 'enter%' THEN CASE WHEN o > 0 THEN greatest(0.003, o / 100 * 0.4) ELSE 0.008 END END AS tp_pct,
  CASE WHEN action LIKE 'enter%' THEN CASE WHEN round(score, 9) >= 0.7 THEN 0.012 WHEN round(score, 9) < 0.55 THEN 0.018 ELSE 0.015 END END AS sl_pct FROM a""",
    "confidence tp_pct sl_pct",
)
def _(t: Tables):
    return _decisions(t).select(
        "symbol", "ts", "event_id", "action", "confidence", "tp_pct", "sl_pct"
    )


def _decisions(t: Tables) -> DataFrame:
    k = F.col("event_id")
    context = (
        market.market_context(t)
        .withColumn("regime", F.when(k % 11 == 0, "choppy").otherwise("neutral"))
        .withColumn("consecutive_losses", k % 5)
        .withColumn("win_count", k % 9)
        .withColumn("total_trades", F.lit(10))
    )
    return T.score_events(context)


@query(
    "A19_decision_summary",
    """SELECT event_type AS symbol, count(*) AS total, count(*) FILTER (event_id % 11 <> 0 AND event_id % 5 <> 4) AS enters, 0::BIGINT AS closes,
  count(*) FILTER (event_id % 11 = 0 OR event_id % 5 = 4) AS skips FROM events GROUP BY 1""",
)
def _(t: Tables):
    return T.decision_summary(_decisions(t), ["symbol"])


BASIS = f"""{FUNDING}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM funding),
walk AS (
  SELECT DISTINCT symbol, 0::BIGINT AS rn, 0 AS above, 0 AS below, NULL::TIMESTAMP AS since, 0.0::DOUBLE AS spot, 0.0::DOUBLE AS perp, 0.0::DOUBLE AS fund, 0 AS pays,
    NULL::VARCHAR AS why, NULL::TIMESTAMP AS ts, NULL::TIMESTAMP AS e_ts, NULL::DOUBLE AS e_spot, NULL::DOUBLE AS e_perp, NULL::DOUBLE AS x_spot, NULL::DOUBLE AS x_perp, NULL::DOUBLE AS x_fund, NULL::INT AS x_pays FROM funding
  UNION ALL
  SELECT symbol, rn2, CASE WHEN w IS NULL THEN a ELSE 0 END, CASE WHEN w IS NULL THEN b ELSE 0 END,
    CASE WHEN w IS NOT NULL THEN NULL WHEN since IS NULL AND a >= 2 THEN ts2 ELSE since END,
    CASE WHEN since IS NULL THEN oracle_price ELSE spot END, CASE WHEN since IS NULL THEN mark_price ELSE perp END,
    CASE WHEN since IS NULL THEN 0 ELSE fund2 END, CASE WHEN since IS NULL THEN 0 ELSE pays + 1 END, w, ts2, since, spot, perp, oracle_price, mark_price, fund2, pays + 1
  FROM (SELECT *, CASE WHEN since IS NULL THEN NULL WHEN b >= 2 THEN 'funding_negative' WHEN ts2 - since >= INTERVAL 480 HOUR THEN 'max_hold_time' WHEN fund2 >= 0.4 THEN 'target_profit'
      WHEN fund2 <= -0.1 THEN 'max_loss' END AS w
    FROM (SELECT w0.symbol, w0.since, w0.spot, w0.perp, w0.pays, w0.fund + f.rate * 1000 AS fund2, f.rn AS rn2, f.ts AS ts2, f.oracle_price, f.mark_price,
        CASE WHEN f.rate >= 0.00001 THEN w0.above + 1 ELSE 0 END AS a, CASE WHEN f.rate <= -0.00001 THEN w0.below + 1 ELSE 0 END AS b
      FROM walk w0 JOIN f ON f.symbol = w0.symbol AND f.rn = w0.rn + 1) q) z)"""


@query(
    "T8_basis_pnl",
    f"""WITH RECURSIVE {BASIS} SELECT symbol, e_ts AS entry_time, ts AS exit_time, why AS reason, x_pays::BIGINT AS funding_payments, x_fund AS funding_pnl,
  (x_spot - e_spot) / e_spot * 1000 AS spot_pnl, (e_perp - x_perp) / e_perp * 1000 AS perp_pnl,
  (x_spot - e_spot) / e_spot * 1000 + (e_perp - x_perp) / e_perp * 1000 + x_fund - 1.1 AS net_pnl FROM walk WHERE why IS NOT NULL""",
    "funding_pnl spot_pnl perp_pnl net_pnl",
)
def _(t: Tables):
    out = T.basis_pnl(
        funding(t), enter_rate=0.00001, enter_hours=2, exit_rate=-0.00001, exit_hours=2,
        max_hold_hours=480, target_usd=0.4, max_loss_usd=0.1, notional_usd=1000.0,
    )
    return out.select(
        "symbol", "entry_time", "exit_time", "reason", "funding_payments", "funding_pnl",
        "spot_pnl", "perp_pnl", "net_pnl",
    )


@query(
    "A16_risk_breaches",
    """WITH p AS (SELECT o_custkey AS account_id, o_orderkey::VARCHAR AS asset, 1 + o_orderkey % 4 AS size, 100.0 + o_custkey % 50 AS e, o_totalprice AS v, (o_orderkey % 101 - 50.0) AS u FROM orders),
a AS (SELECT c_custkey AS account_id, c_acctbal * 100 AS total_value, (c_custkey % 97)::DOUBLE AS dd FROM customer),
j AS (SELECT p.*, total_value FROM p JOIN a USING (account_id))
SELECT account_id, asset, 'stop_loss' AS rule, 'close_position' AS action, 'HIGH' AS severity, -u / (e * size) * 100 AS value, 5.0 AS bound FROM j WHERE -u / (e * size) * 100 >= 5
UNION ALL SELECT account_id, asset, 'take_profit', 'close_position', 'MEDIUM', u / (e * size) * 100, 20.0 FROM j WHERE u > 0 AND u / (e * size) * 100 >= 20
UNION ALL SELECT account_id, asset, 'max_position_size', 'reduce_position', 'MEDIUM', v / total_value * 100, 30.0 FROM j WHERE total_value > 0 AND v / total_value * 100 >= 30
UNION ALL SELECT account_id, 'ACCOUNT', 'max_drawdown', 'emergency_exit', 'CRITICAL', dd, 90.0 FROM a WHERE dd >= 90""",
    "value bound",
)
def _(t: Tables):
    k = F.col("o_orderkey")
    positions = t.orders.select(
        F.col("o_custkey").alias("account_id"), k.cast("string").alias("asset"),
        (F.lit(1) + k % 4).alias("size"), (F.lit(100.0) + F.col("o_custkey") % 50).alias("entry_price"),
        F.col("o_totalprice").alias("current_value"), (k % 101 - F.lit(50.0)).alias("unrealized_pnl"),
    )
    account = t.customer.select(
        F.col("c_custkey").alias("account_id"), (F.col("c_acctbal") * 100).alias("total_value"),
        (F.col("c_custkey") % 97).cast("double").alias("drawdown_pct"),
    )
    limits = t.spark.range(1).select(
        F.lit(5.0).alias("loss_pct"), F.lit(20.0).alias("profit_pct"),
        F.lit(90.0).alias("max_drawdown_pct"), F.lit(30.0).alias("max_position_size_pct"),
    )
    return T.risk_breaches(positions, account, limits)


@query(
    "A16_exposure_breaches",
    """WITH x AS (SELECT o_custkey AS account_id, o_orderpriority AS coin, sum(abs(o_totalprice)) AS value FROM orders GROUP BY ALL),
q AS (SELECT o_custkey AS account_id, max(o_totalprice) AS peak, arg_max(o_totalprice, o_orderkey) AS now FROM orders GROUP BY 1)
SELECT account_id, 'single_exposure' AS rule, coin, value FROM x WHERE value > 1000000
UNION ALL SELECT account_id, 'total_exposure', NULL, sum(value) FROM x GROUP BY 1 HAVING sum(value) > 3000000
UNION ALL SELECT account_id, 'drawdown', NULL, (peak - now) / peak * 100 FROM q WHERE (peak - now) / peak * 100 > 80""",
    "value",
    4,
)
def _(t: Tables):
    positions = t.orders.select(
        F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("coin"),
        F.col("o_totalprice").alias("exposure"),
    )
    equity = t.orders.select(
        F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("ts"),
        F.col("o_totalprice").alias("equity"),
    )
    return T.exposure_breaches(positions, equity, 1_000_000 * 3, 1_000_000, 80)


def _reports(t: Tables) -> DataFrame:
    """Session reports: blocks of fifty events as signals in time order, so arrays stay small."""
    k = F.col("event_id")
    kind = F.get(
        F.array(*[F.lit(x) for x in ("BUY", "SELL", "CLOSE", "NOTE")]), (k % 4).cast("int")
    )
    signal = F.struct(
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"),
        kind.alias("type"), (F.col("value") + 50).alias("price"), F.lit(None).cast("double").alias("size"),
        F.lit("").alias("reason"),
    )
    block = F.floor(k / 50)
    return t.events.groupBy(block.cast("string").alias("session_id")).agg(
        F.lit("S").alias("symbol"), (F.max(block) / 1000.0).alias("threshold"),
        F.lit(100.0).alias("position_size_usd"), F.lit(3600.0).alias("duration_seconds"),
        F.count(F.lit(1)).alias("tick_count"), F.count(F.lit(1)).alias("signal_count"),
        F.count(F.lit(1)).alias("dc_event_count"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("ts", "event_id", signal.alias("s")))),
            lambda x: x["s"],
        ).alias("signals"),
    )


@query(
    "A17_session_summary",
    """SELECT (event_id // 50)::VARCHAR AS session_id, 'S' AS symbol, any_value(event_id // 50) / 1000 AS threshold, count(*) AS tick_count, count(*) AS dc_event_count, count(*) / 60 AS signals_per_min,
  (count(*) FILTER (event_id % 4 = 0))::INT AS buy_signals, (count(*) FILTER (event_id % 4 = 1))::INT AS sell_signals, (count(*) FILTER (event_id % 4 = 2))::INT AS close_signals FROM events GROUP BY event_id // 50""",
    "threshold signals_per_min",
)
def _(t: Tables):
    return T.session_summary(_reports(t))


SESSION = """sig AS (SELECT event_id // 50 AS user_id, event_id % 4 AS k, value + 50 AS px, lead(value + 50) OVER (PARTITION BY event_id // 50 ORDER BY ts, event_id) AS nxt FROM events WHERE event_id % 4 < 3),
st AS (SELECT user_id, px, nxt, 100 / px AS size, CASE k WHEN 0 THEN nxt - px ELSE px - nxt END / px * (px * (100 / px)) AS g, (px + nxt) * (100 / px) * 0.00035::DOUBLE AS fee
  FROM sig WHERE k < 2 AND nxt IS NOT NULL),
sp AS (SELECT user_id::VARCHAR AS session_id, count(st.px) AS total_trades, coalesce(sum(g), 0) AS gross_pnl_usd, coalesce(sum(fee), 0) AS total_fees_usd,
  coalesce(sum(g - fee), 0) AS net_pnl_usd, count(*) FILTER (g - fee > 0) AS wins, count(*) FILTER (g - fee <= 0) AS losses,
  coalesce(count(*) FILTER (g - fee > 0) / nullif(count(st.px), 0), 0) AS win_rate FROM (SELECT DISTINCT event_id // 50 AS user_id FROM events) u LEFT JOIN st USING (user_id) GROUP BY user_id)"""


def _session_pnl(t: Tables) -> DataFrame:
    signals = T.session_signals(_reports(t))
    return T.signal_pnl(signals, Timeline.of("session_id", "pos", (), 10_000))


@query(
    "A18_signal_pnl",
    f"WITH {SESSION} SELECT * FROM sp",
    "gross_pnl_usd total_fees_usd net_pnl_usd win_rate",
    5,
)
def _(t: Tables):
    return _session_pnl(t)


@query(
    "T9_rank_thresholds",
    f"""WITH {SESSION}, s AS (SELECT *, net_pnl_usd + CASE WHEN total_trades > 0 THEN win_rate * 0.1 ELSE -1 END AS score FROM sp),
r AS (SELECT *, score - lead(score) OVER (ORDER BY score DESC, session_id) AS gap, row_number() OVER (ORDER BY score DESC, session_id) AS rn FROM s)
SELECT session_id, score, greatest(0, least(1, least(0.95, 0.5 + gap * 0.2))) AS confidence FROM r WHERE rn = 1""",
    "score confidence",
)
def _(t: Tables):
    return T.rank_thresholds(_session_pnl(t)).select("session_id", "score", "confidence")
