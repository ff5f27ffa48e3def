"""P-values of the paired tests; small closed-form helpers used on one aggregated row per pair."""

from __future__ import annotations

import math


def normal_sf2(z: float) -> float:
    """Two-sided normal tail."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    scale = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return scale * _beta_fraction(a, b, x) / a
    return 1.0 - scale * _beta_fraction(b, a, 1.0 - x) / b


def student_sf2(t: float, df: float) -> float:
    """Two-sided Student tail."""
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def wilcoxon_exact_sf2(stat: float, n: int) -> float:
    """Two-sided exact signed-rank tail for at most 50 untied, nonzero differences."""
    ways = [1]
    for rank in range(1, n + 1):
        longer = ways + [0] * rank
        for s, w in enumerate(ways):
            longer[s + rank] += w
        ways = longer
    return min(1.0, 2.0 * sum(ways[: int(stat) + 1]) / 2.0**n)
