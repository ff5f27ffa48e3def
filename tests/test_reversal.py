"""The step function against a tick-by-tick restatement of the rule."""

import json

import numpy as np
import pytest

from tickloom.functions.reversal import State, advance, apply, summarise

INF = float("inf")


def one_by_one(px, ts, down, up):
    mode, events = None, []
    hi, hi_t, lo, lo_t = -INF, -1, INF, -1
    anchor = anchor_t = ext = ext_t = None
    for p, t in zip(px, ts):
        if mode != "down":
            if hi > p and hi - p >= hi * down:
                events.append(("PDCC_Down", hi_t, t, hi, p))
                if mode == "up":
                    events.append(("OSV_Up", anchor_t, ext_t, anchor, ext))
                mode, anchor, anchor_t, ext, ext_t, lo, lo_t = "down", p, t, p, t, p, t
                continue
            if p > hi:
                hi, hi_t = p, t
        if mode == "down" and p <= ext:
            ext, ext_t = p, t
        if mode != "up":
            if lo < p and p - lo >= lo * up:
                events.append(("PDCC2_UP", lo_t, t, lo, p))
                if mode == "down":
                    events.append(("OSV_Down", anchor_t, ext_t, anchor, ext))
                mode, anchor, anchor_t, ext, ext_t, hi, hi_t = "up", p, t, p, t, -INF, -1
                continue
            if p < lo:
                lo, lo_t = p, t
        if mode == "up" and p >= ext:
            ext, ext_t = p, t
    return events


def series(kind, n, rng):
    if kind == "walk":
        return 100 * np.exp(np.cumsum(rng.normal(0, 0.004, n)))
    if kind == "steps":
        return (100 + np.cumsum(rng.integers(-1, 2, n))).clip(5).astype(float)
    return 50 + rng.exponential(30, n)


@pytest.mark.parametrize("kind", ["walk", "steps", "spikes"])
@pytest.mark.parametrize("pair", [(0.01, 0.01), (0.03, 0.02), (0.005, 0.02), (0.5, 0.5)])
def test_any_cut_gives_the_sequential_result(kind, pair):
    rng = np.random.default_rng(abs(hash((kind, pair))) % 2**32)
    for trial in range(15):
        n = int(rng.integers(1, 900))
        px = series(kind, n, rng)
        ts = np.sort(rng.integers(0, n, n)) if trial % 2 else np.arange(n)
        cuts = [0, *sorted(set(rng.integers(0, n + 1, int(rng.integers(1, 40))).tolist())), n]
        ran, chained, out = State(), State(), []
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            ran = advance(ran, px[a:b], ts[a:b], *pair, out)
            body = json.loads(json.dumps(summarise(px[a:b], ts[a:b], *pair)))
            chained = apply(body, chained)
            assert chained == ran
        assert [e[:5] for e in out] == one_by_one(px.tolist(), ts.tolist(), *pair)


def test_five_prices():
    px, out = np.array([100.0, 102, 95, 94, 100]), []
    advance(State(), px, np.arange(5), 0.05, 0.05, out)
    assert [e[:5] for e in out] == [
        ("PDCC_Down", 1, 2, 102, 95), ("PDCC2_UP", 3, 4, 94, 100), ("OSV_Down", 2, 3, 95, 94),
    ]
    assert out[2][5] == pytest.approx(0.21052631578947367)


def test_quiet_series_give_nothing():
    for px in (np.full(100, 100.0), 100 + 0.1 * np.sin(np.arange(50))):
        out = []
        advance(State(), px, np.arange(len(px)), 0.01, 0.01, out)
        assert out == []


def test_finer_thresholds_give_more_events():
    px = 100 + 2 * np.sin(0.1 * np.arange(200))
    counts = []
    for theta in (0.005, 0.01, 0.03):
        out = []
        advance(State(), px, np.arange(200), theta, theta, out)
        counts.append(sum(e[0].startswith("PDCC") for e in out))
    assert counts[0] >= counts[1] > counts[2]
