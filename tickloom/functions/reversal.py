"""Directional-change step function on numpy arrays, shared by batch and streaming.

State of one (symbol, threshold) timeline. ``mode`` is ``"none"`` before the first confirmation,
then ``"up"`` or ``"down"``. Prices and times come in pairs:

* ``high``: running maximum a down move is measured from (modes none and up). After an up
  confirmation it starts on the *next* tick. First occurrence wins a tie.
* ``low``: running minimum an up move is measured from (modes none and down), confirmation tick
  included. First occurrence wins a tie.
* ``anchor``: the last confirmation. ``extreme``: the overshoot's end since then, confirmation tick
  included. Last occurrence wins a tie.

``advance`` applies ticks to a state. ``summarise`` describes what a stretch of ticks does to *any*
state, and ``apply`` evaluates that description, so stretches can be processed independently and
chained afterwards with exactly the sequential result.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import numpy as np

INF = float("inf")
NEAR, FIRST_BLOCK, LAST_BLOCK = 24, 64, 8192


@dataclass(frozen=True)
class State:
    mode: str = "none"
    high: float = -INF
    high_ts: int = -1
    low: float = INF
    low_ts: int = -1
    anchor: float | None = None
    anchor_ts: int = -1
    extreme: float | None = None
    extreme_ts: int = -1


def confirmed(mode: str, price: float, ts: int) -> State:
    """State right after a confirmation at this tick."""
    if mode == "down":
        return State("down", -INF, -1, price, ts, price, ts, price, ts)
    return State("up", -INF, -1, INF, -1, price, ts, price, ts)


class Series:
    """Ticks of one stretch as arrays (for long scans) and as lists (for short ones)."""

    __slots__ = ("n", "px", "ts", "q", "ql", "pl", "tl")

    def __init__(self, px, ts):
        if len(px) and not (np.isfinite(px).all() and px.min() > 0):
            raise ValueError("prices must be finite and above zero")
        self.n, self.px, self.ts = len(px), px, ts
        neg = -px
        self.q = {1: px, -1: neg}
        self.pl, self.tl = px.tolist(), ts.tolist()
        self.ql = {1: self.pl, -1: neg.tolist()}


def next_reversal(s: Series, i, best, best_ts, theta, sign, n=None):
    """First tick from ``i`` whose fall from the running maximum of ``q`` reaches the threshold.

    ``q`` is the price for a down move (``sign=1``) and minus the price for an up move
    (``sign=-1``); the test is then ``max - px >= max * theta`` or ``px - min >= min * theta``.
    Returns (position or ``n``, running maximum before it, its time). Close reversals are found
    tick by tick, far ones in growing array blocks; on finite prices both test the same condition
    with the same numbers.
    """
    n = s.n if n is None else n
    values, times = s.ql[sign], s.tl
    stop = min(n, i + NEAR)
    scale = sign * theta
    while i < stop:
        x = values[i]
        if best > x and best - x >= best * scale:
            return i, best, best_ts
        if x > best:
            best, best_ts = x, times[i]
        i += 1
    q, size = s.q[sign], FIRST_BLOCK
    while i < n:
        seg = q[i : min(i + size, n)]
        prev = np.empty(len(seg))
        prev[0] = best
        np.maximum(np.maximum.accumulate(seg)[:-1], best, out=prev[1:])
        hit = (prev > seg) & (prev - seg >= prev * scale)
        k = int(hit.argmax())
        found = bool(hit[k])
        seen = seg[:k] if found else seg
        if len(seen):
            a = int(seen.argmax())
            if seen[a] > best:
                best, best_ts = float(seen[a]), times[i + a]
        if found:
            return i + k, best, best_ts
        i += len(seg)
        size = min(2 * size, LAST_BLOCK)
    return n, best, best_ts


def overshoot(s: Series, i, j, best, best_ts, sign):
    """Running maximum of ``q`` over ``[i, j)`` with the last occurrence winning ties."""
    if j - i <= NEAR:
        values = s.ql[sign]
        for k in range(i, j):
            if best is None or values[k] >= best:
                best, best_ts = values[k], s.tl[k]
        return best, best_ts
    seg = s.q[sign][i:j]
    a = len(seg) - 1 - int(seg[::-1].argmax())
    if best is None or seg[a] >= best:
        return float(seg[a]), s.tl[i + a]
    return best, best_ts


def advance(state: State, px, ts, down: float, up: float, out: list | None = None) -> State:
    """Apply ticks in order; confirmation and overshoot rows are appended to ``out``.

    A row is (event_type, start_ts, end_ts, start_price, end_price, max_osv).
    """
    return advance_from(state, Series(px, ts), 0, down, up, out)


def advance_from(
    s: State, x: Series, i: int, down: float, up: float, out: list | None = None
) -> State:
    """``advance`` over the ticks of a prepared series from position ``i``."""
    n = x.n
    mode, high, high_ts, low, low_ts = s.mode, s.high, s.high_ts, s.low, s.low_ts
    anchor, anchor_ts, ext, ext_ts = s.anchor, s.anchor_ts, s.extreme, s.extreme_ts
    while i < n:
        if mode == "up":
            j, high, high_ts = next_reversal(x, i, high, high_ts, down, 1)
            ext, ext_ts = overshoot(x, i, j, ext, ext_ts, 1)
            fell = True
        elif mode == "down":
            j, low, low_ts = next_reversal(x, i, -low, low_ts, up, -1)
            ext, ext_ts = overshoot(x, i, j, -ext, ext_ts, -1)
            low, ext = -low, -ext
            fell = False
        else:
            jd, high, high_ts = next_reversal(x, i, high, high_ts, down, 1)
            ju, low, low_ts = next_reversal(x, i, -low, low_ts, up, -1)
            low = -low
            fell = jd < ju
            j = jd if fell else ju
        if j == n:
            break
        price, when = x.pl[j], x.tl[j]
        if out is not None:
            if fell:
                out.append(("PDCC_Down", high_ts, when, high, price, 0.0))
            else:
                out.append(("PDCC2_UP", low_ts, when, low, price, 0.0))
            if mode == "up":
                size = (ext - anchor) / (anchor * up)
                out.append(("OSV_Up", anchor_ts, ext_ts, anchor, ext, max(size, 0.0)))
            elif mode == "down":
                size = (anchor - ext) / (anchor * down)
                out.append(("OSV_Down", anchor_ts, ext_ts, anchor, ext, max(size, 0.0)))
        anchor = ext = price
        anchor_ts = ext_ts = when
        high, high_ts = -INF, -1
        if fell:
            mode, low, low_ts = "down", price, when
        else:
            mode, low, low_ts = "up", INF, -1
        i = j + 1
    return State(mode, high, high_ts, low, low_ts, anchor, anchor_ts, ext, ext_ts)


class _Chains:
    """Where each confirmation inside one stretch leads; shared tails are walked once."""

    def __init__(self, x: Series, down: float, up: float):
        self.x, self.down, self.up = x, down, up
        self.ends: dict[tuple[str, int], State] = {}

    def next_confirm(self, mode: str, pos: int) -> int:
        if mode == "down":
            return next_reversal(self.x, pos + 1, self.x.ql[-1][pos], 0, self.up, -1)[0]
        return next_reversal(self.x, pos + 1, -INF, -1, self.down, 1)[0]

    def tail(self, mode: str, pos: int) -> State:
        """State at the end of the stretch after a confirmation at ``pos``."""
        path, end, x = [], None, self.x
        while end is None:
            if (mode, pos) in self.ends:
                end = self.ends[(mode, pos)]
                break
            path.append((mode, pos))
            turn = self.next_confirm(mode, pos)
            if turn == x.n:
                start = confirmed(mode, x.pl[pos], x.tl[pos])
                end = advance_from(start, x, pos + 1, self.down, self.up)
            else:
                mode, pos = ("up" if mode == "down" else "down"), turn
        for key in path:
            self.ends[key] = end
        return end

    def fall_turns(self, records: list[int]) -> dict[int, int]:
        """Next confirmation after a fall at each record low: shared until it is passed."""
        turns, turn = {}, -1
        for pos in records:
            if pos > turn:
                turn = self.next_confirm("down", pos)
            turns[pos] = turn
        return turns

    def rise_turns(self, records: list[int]) -> dict[int, int]:
        """Next confirmation after a rise at each record high.

        The high restarts on the tick after a rise, so the rise at one record only meets the
        others from the next record on, unless the price reverses in between.
        """
        with_own, turn = {}, -1
        for pos in records:
            if pos > turn:
                turn = next_reversal(self.x, pos + 1, self.x.pl[pos], 0, self.down, 1)[0]
            with_own[pos] = turn
        turns = {}
        for pos, after in zip(records, records[1:] + [None]):
            if after is None:
                turns[pos] = self.next_confirm("up", pos)
                continue
            between = next_reversal(self.x, pos + 1, -INF, -1, self.down, 1, after)[0]
            turns[pos] = between if between < after else with_own[after]
        return turns

    def open_rises(self, records: list[int]) -> dict[int, State]:
        """End states of rises that nothing reverses."""
        px, n, times = self.x.px, self.x.n, self.x.tl
        peak = np.maximum.accumulate(px[::-1])[::-1]
        at_peak = np.flatnonzero(px == peak)
        last_of = {float(px[p]): int(p) for p in at_peak}
        ends = {}
        for pos in records:
            top = float(peak[pos])
            state = confirmed("up", float(px[pos]), times[pos])
            state = replace(state, extreme=top, extreme_ts=times[last_of[top]])
            if pos + 1 < n:
                first = int(at_peak[np.searchsorted(at_peak, pos + 1)])
                state = replace(state, high=float(px[first]), high_ts=times[first])
            ends[pos] = state
        return ends


def _entries(q, stop: int, mode: str, chains: _Chains) -> list[list]:
    """First confirmations a stretch can give, by how far the incoming extreme lies.

    Only a new record low of ``q`` can be the first tick that an incoming maximum turns into a
    reversal; ``stop`` is where the stretch reverses on its own. Entries that lead to the same
    later confirmation share their final state, so only the last of them is kept.
    Each entry is [price, ts, position, forced, final state]; a null state is the one before it
    with this entry as the anchor.
    """
    px, ts, n = chains.x.pl, chains.x.tl, len(q)
    head = q[:stop]
    records: list[int] = []
    if stop:
        low = np.minimum.accumulate(head)
        records = [int(p) for p in np.flatnonzero(np.r_[True, head[1:] < low[:-1]])]
    turns = chains.fall_turns(records) if mode == "down" else chains.rise_turns(records)
    still_open = [p for p in records if turns[p] == n]
    if mode == "down":
        ends = {p: chains.tail("down", still_open[0]) for p in still_open}
        ends = {
            p: replace(e, anchor=px[p], anchor_ts=ts[p]) for p, e in ends.items()
        }
    else:
        ends = chains.open_rises(still_open)
    positions = records
    if stop < n:
        positions = records + [stop]
        turns[stop] = chains.next_confirm(mode, stop)
        ends[stop] = chains.tail(mode, stop)
    other = "up" if mode == "down" else "down"
    rows: list[list] = []
    group, template = None, None
    for pos in positions:
        turn = turns[pos]
        entry = [px[pos], ts[pos], pos, pos == stop]
        if turn < n:
            if group == turn:
                rows[-1][:4] = entry
            else:
                rows.append([*entry, asdict(chains.tail(other, turn))])
            group, template = turn, None
        else:
            shared = replace(ends[pos], anchor=None, anchor_ts=-1)
            rows.append([*entry, None if shared == template else asdict(ends[pos])])
            group, template = None, shared
    return rows


def summarise(px, ts, down: float, up: float) -> dict:
    """What these ticks do to a state that is not known yet (JSON-safe)."""
    return summarise_series(Series(px, ts), down, up)


def summarise_series(x: Series, down: float, up: float) -> dict:
    """``summarise`` over a prepared series."""
    chains, n = _Chains(x, down, up), x.n
    jd, high, high_ts = next_reversal(x, 0, -INF, -1, down, 1)
    ju, low, low_ts = next_reversal(x, 0, -INF, -1, up, -1)
    top, top_ts = overshoot(x, 0, n, None, -1, 1) if jd == n else (None, -1)
    bottom, bottom_ts = overshoot(x, 0, n, None, -1, -1) if ju == n else (None, -1)
    return {
        "high": high, "high_ts": high_ts, "low": -low, "low_ts": low_ts,
        "top": top, "top_ts": top_ts,
        "bottom": None if bottom is None else -bottom, "bottom_ts": bottom_ts,
        "falls": _entries(x.q[1], jd, "down", chains),
        "rises": _entries(x.q[-1], ju, "up", chains),
        "down": down, "up": up,
    }


def _first_entry(rows: list, extreme: float, theta: float, sign: int):
    """Index of the first entry an incoming extreme (sign-adjusted) turns into a confirmation."""
    for k, (price, _, _, forced, _) in enumerate(rows):
        q = sign * price
        if forced or (extreme > q and extreme - q >= sign * extreme * theta):
            return k
    return None


def _end_of(rows: list, k: int) -> State:
    price, ts, _, _, end = rows[k]
    if end is not None:
        return State(**end)
    while rows[k][4] is None:
        k -= 1
    return replace(State(**rows[k][4]), anchor=price, anchor_ts=ts)


def apply(summary: dict, s: State) -> State:
    """State after the summarised ticks, given the state before them."""
    fall = rise = None
    if s.mode != "down":
        fall = _first_entry(summary["falls"], s.high, summary["down"], 1)
    if s.mode != "up":
        rise = _first_entry(summary["rises"], -s.low, summary["up"], -1)
    if fall is not None and rise is not None:
        if summary["falls"][fall][2] < summary["rises"][rise][2]:
            rise = None
        else:
            fall = None
    if fall is not None:
        return _end_of(summary["falls"], fall)
    if rise is not None:
        return _end_of(summary["rises"], rise)
    if s.mode != "down" and summary["high"] > s.high:
        s = replace(s, high=summary["high"], high_ts=summary["high_ts"])
    if s.mode != "up" and summary["low"] < s.low:
        s = replace(s, low=summary["low"], low_ts=summary["low_ts"])
    if s.mode == "up" and summary["top"] >= s.extreme:
        s = replace(s, extreme=summary["top"], extreme_ts=summary["top_ts"])
    if s.mode == "down" and summary["bottom"] <= s.extreme:
        s = replace(s, extreme=summary["bottom"], extreme_ts=summary["bottom_ts"])
    return s
