"""Ranking of assets, leaders and funding opportunities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import clip, sigmoid
from tickloom.operators.stats import equity_metrics, percentiles
from tickloom.session import cut_lineage

# Weights per performance window and the constants of the two scores.
WINDOW_WEIGHTS = {"day": 0.05, "week": 0.15, "month": 0.35, "allTime": 0.45}
MIN_MONTH_VOLUME = 10_000_000.0
MIN_ACCOUNT_VALUE = 100_000.0
DISPERSION_K = 3.0
TURNOVER_K = 1.2
LONG_TERM_K = 3.0
LONGEVITY_START, LONGEVITY_STEP, LONGEVITY_MAX, LONGEVITY_TRIES = 0.55, 0.08, 0.80, 4
LONGEVITY_TARGET = 0.25
# Percentile settings for anchors (all-time ROI, month ROI, dispersion, turnover).
ANCHOR_STEPS = [
    (60, 45, 60, 80),
    (55, 40, 65, 85),
    (50, 35, 70, 90),
    (45, 30, 75, 92),
    (40, 25, 80, 94),
    (35, 20, 85, 96),
]
CORE_SYMBOLS = ("HYPE", "SOL")
EXCLUDED_SYMBOLS = ("PURR", "JEFF")


def rank_assets(
    contexts: DataFrame,
    min_volume: float = 1_000_000,
    min_change: float = 1.5,
    n: int = 5,
    core: Sequence[str] = CORE_SYMBOLS,
    excluded: Sequence[str] = EXCLUDED_SYMBOLS,
) -> DataFrame:
    """Strongest movers. ``contexts(symbol, price, prev, volume, funding, open_interest)``.

    Core symbols need no volume or momentum and take the places of the weakest others.
    """
    change = (F.col("price") - F.col("prev")) / F.col("prev") * 100
    is_core = F.col("symbol").isin(*core)
    rows = contexts.where(
        ~F.col("symbol").isin(*excluded) & (F.col("price") > 0) & (F.col("prev") > 0)
    ).withColumn("change_pct", change)
    c, f = F.col("change_pct"), F.col("funding")
    direction = (
        F.when(c > min_change, "long").when(c < -min_change, "short").when(is_core, "neutral")
    )
    kept = rows.withColumn("direction", direction).where(
        F.col("direction").isNotNull() & ((F.col("volume") >= min_volume) | is_core)
    )
    d = F.col("direction")
    agrees = ((d == "short") & (f < 0)) | ((d == "long") & (f > 0))
    scored = kept.withColumn(
        "score",
        F.abs(c) * F.least(F.col("volume") / 1e7, F.lit(3.0)) * F.when(agrees, 1.2).otherwise(1.0),
    ).withColumn(
        "threshold",
        F.when(F.abs(c) > 6, 0.03).when(F.abs(c) > 4, 0.025).when(F.abs(c) > 2, 0.02).otherwise(0.015),
    )
    top = scored.orderBy(is_core.desc(), F.desc("score"), "symbol").limit(max(n, 1))
    return top.select(
        "symbol", "price", "change_pct", F.col("volume").alias("volume_24h_usd"),
        (f * 100).alias("funding_rate_pct"),
        (F.col("open_interest") * F.col("price")).alias("open_interest_usd"),
        "direction", "score", "threshold",
    )


def _dispersion() -> Column:
    """Population deviation of log1p of the (non-negative) ROI over the four windows."""
    logs = [F.log1p(F.greatest(F.col(f"roi_{w}"), F.lit(0.0))) for w in WINDOW_WEIGHTS]
    mean = reduce(lambda a, b: a + b, logs) / len(logs)
    squares = [(x - mean) * (x - mean) for x in logs]
    return F.sqrt(reduce(lambda a, b: a + b, squares) / len(logs))


def _weighted(make) -> Column:
    return reduce(lambda a, b: a + b, [make(w) * F.lit(v) for w, v in WINDOW_WEIGHTS.items()])


def _shape(d: DataFrame) -> DataFrame:
    best = F.greatest("roi_day", "roi_week")
    return (
        d.withColumn("turnover", F.try_divide(F.col("vlm_month"), F.col("account_value")))
        .withColumn("dispersion", _dispersion())
        .withColumn("pop", best - F.col("roi_month"))
        .withColumn("convex_score", best / (F.lit(1e-6) + F.col("dispersion")))
    )


def _core_score(norm: Column) -> Column:
    roi = _weighted(lambda w: F.tanh(F.col(f"roi_{w}") / norm))
    pnl = _weighted(lambda w: F.log1p(F.greatest(F.col(f"pnl_{w}"), F.lit(0.0))))
    return roi * 0.70 + pnl * 0.30


def score_leaders(
    df: DataFrame, longevity_weight: float = LONGEVITY_START, version: int = 2
) -> DataFrame:
    """T11 (version 2) and T11b (version 1): score of each trader that passes the hard filters.

    Input columns: address, account_value and ``{roi,pnl,vlm}_{day,week,month,allTime}``.
    """
    if version == 1:
        return _score_fixed(df)
    w = longevity_weight
    out = leader_terms(df)
    return out.withColumn(
        "score", F.col("core_term") * F.lit(1.0 - w) + F.col("longevity_term") * F.lit(w)
    )


def leader_terms(df: DataFrame) -> DataFrame:
    """Everything in score version 2 that does not depend on the longevity weight.

    The two scales are tuned to the data by exact quantiles, read from one-row tables.
    """
    d = _shape(
        df.where(
            (F.col("account_value") >= MIN_ACCOUNT_VALUE)
            & (F.col("vlm_month") >= MIN_MONTH_VOLUME)
            & (F.col("pnl_allTime") > 0)
            & F.col("roi_allTime").isNotNull()
            & F.col("roi_month").isNotNull()
            & F.col("pnl_month").isNotNull()
        )
    )
    named = {
        "turnover": F.col("turnover"),
        "week": F.col("roi_week"),
        "month": F.when(F.col("roi_month") > 0, F.col("roi_month")),
    }
    pairs = [F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in named.items()]
    long = d.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    q = percentiles(long, "value", ["metric"], (0.75,))
    of = lambda name, c: F.max(F.when(F.col("metric") == name, F.col(c)))
    norm = F.when(of("month", "count") >= 50, of("month", "p75")).otherwise(of("week", "p75"))
    scales = q.agg(
        clip(norm, 0.05, 0.60).alias("roi_normalizer"),
        clip(of("turnover", "p75"), 20.0, 250.0).alias("turnover_target"),
    )
    d = d.crossJoin(F.broadcast(scales))
    roi = {w: F.col(f"roi_{w}") for w in WINDOW_WEIGHTS}
    smooth = F.lit(1.0) / (F.lit(1.0) + F.lit(DISPERSION_K) * F.col("dispersion"))
    gap = clip(roi["allTime"] - roi["day"], -60.0, 60.0)
    long_term = F.lit(1.0) / (F.lit(1.0) + F.exp(-LONG_TERM_K * gap))
    ratio = F.greatest(F.col("turnover") / F.col("turnover_target"), F.lit(0.0))
    churn = F.lit(1.0) / (F.lit(1.0) + F.lit(TURNOVER_K) * F.log1p(ratio))
    penalty = F.when(roi["week"] < 0, 0.70).otherwise(1.0) * F.when(
        roi["day"] < 0, 0.85
    ).otherwise(1.0)
    positive = reduce(lambda a, b: a + b, [(r > 0).cast("double") for r in roi.values()]) / 4.0
    worst = F.least(*roi.values())
    consistency = positive * 0.55 + smooth * 0.30 + sigmoid((worst + 0.05) * 3.0) * 0.15
    pos = (
        sigmoid(clip(roi["allTime"], -5.0, 5.0) * 2.5) * 0.50
        + sigmoid(clip(roi["month"], -2.0, 2.0) * 2.0) * 0.30
        + sigmoid(clip(roi["week"], -2.0, 2.0) * 1.5) * 0.20
    )
    return (
        d.withColumn("positive_share", positive)
        .withColumn("consistency_term", consistency)
        .withColumn("longevity_term", pos * F.col("consistency_term") * churn * long_term)
        .withColumn("core_term", _core_score(F.col("roi_normalizer")) * penalty)
    )


def _score_fixed(df: DataFrame) -> DataFrame:
    d = _shape(
        df.where(
            (F.col("account_value") >= MIN_ACCOUNT_VALUE)
            & (F.col("roi_month") > 0)
            & (F.col("roi_allTime") > 0)
            & (F.col("pnl_allTime") > 0)
            & (F.col("vlm_month") >= MIN_MONTH_VOLUME)
        )
    )
    smooth = F.lit(1.0) / (F.lit(1.0) + F.lit(DISPERSION_K) * F.col("dispersion"))
    long_term = sigmoid((F.col("roi_allTime") - F.col("roi_day")) * LONG_TERM_K)
    churn = F.lit(1.0) / (F.lit(1.0) + F.lit(TURNOVER_K) * F.log1p(F.col("turnover") / 100.0))
    penalty = F.when(F.col("roi_week") < 0, 0.60).otherwise(1.0)
    return d.withColumn("score", _core_score(F.lit(0.25)) * smooth * long_term * churn * penalty)


def longevity_weights() -> list[float]:
    """The weights tried in turn, then the one used if none of them is enough."""
    out, w = [], LONGEVITY_START
    for _ in range(LONGEVITY_TRIES + 1):
        out.append(w)
        w = min(LONGEVITY_MAX, w + LONGEVITY_STEP)
    return out


def tune_longevity(df: DataFrame) -> DataFrame:
    """The first longevity weight whose ten best have a median longevity term on target.

    Every weight's top ten is a bounded top-k over the same terms, which are written out once;
    the choice is one row.
    """
    terms = cut_lineage(leader_terms(df))
    tries = longevity_weights()
    medians = []
    for i, w in enumerate(tries):
        score = F.col("core_term") * F.lit(1.0 - w) + F.col("longevity_term") * F.lit(w)
        top = terms.select(score.alias("s"), "longevity_term", "address").orderBy(
            F.desc("s"), "address"
        ).limit(10)
        medians.append(
            top.agg(F.median("longevity_term").alias("m")).select(
                F.lit(i).alias("step"), F.lit(w).alias("weight"), "m"
            )
        )
    steps = reduce(DataFrame.unionByName, medians)
    good = (F.col("m") >= LONGEVITY_TARGET) | (F.col("step") == len(tries) - 1)
    chosen = steps.where(good).agg(F.min_by("weight", "step").alias("longevity_weight"))
    w = F.col("longevity_weight")
    return terms.crossJoin(F.broadcast(chosen)).withColumn(
        "score", F.col("core_term") * (F.lit(1.0) - w) + F.col("longevity_term") * w
    )


def tune_anchors(
    scored: DataFrame, n: int = 3, k: int = 3000, min_account_value: float = MIN_ACCOUNT_VALUE,
    positive_week: bool = False,
) -> DataFrame:
    """The ``n`` best traders under the first percentile setting that enough of them pass.

    If no setting gives ``n``, the one with the most eligible traders is used. Everything happens
    on the top ``k``, a bounded table.
    """
    pool = scored.orderBy(F.desc("score"), "address").limit(k)
    bars = []
    for i, (a, m, disp, turn) in enumerate(ANCHOR_STEPS):
        q = lambda c, p: F.percentile(c, F.lit(p / 100.0))
        bars.append(
            F.struct(
                F.lit(i).alias("step"), q("roi_allTime", a).alias("all"),
                q("roi_month", m).alias("month"), q("dispersion", disp).alias("disp"),
                q("turnover", turn).alias("turn"), F.median("longevity_term").alias("med"),
            )
        )
    table = pool.agg(F.array(*bars).alias("bars")).select(F.explode("bars").alias("bar"))
    b = lambda f: F.col("bar")[f]
    ok = (
        (F.col("roi_allTime") >= b("all"))
        & (F.col("roi_month") >= b("month"))
        & (F.col("dispersion") <= b("disp"))
        & (F.col("turnover") <= b("turn"))
        & (F.col("account_value") >= min_account_value)
        & (F.col("pnl_allTime") > 0)
        & (F.col("roi_month") > 0)
        & (F.col("pnl_month") > 0)
        & (F.col("positive_share") >= 0.75)
        & (F.col("longevity_term") >= b("med"))
    )
    if positive_week:
        ok = ok & (F.col("roi_week") > 0) & (F.col("pnl_week") > 0)
    eligible = pool.crossJoin(F.broadcast(table)).where(ok).withColumn("step", b("step"))
    sizes = eligible.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(
        F.when(F.col("n") >= n, 1).otherwise(0).alias("enough"),
        F.when(F.col("n") >= n, 0).otherwise(F.col("n")).alias("most"),
        (-F.col("step")).alias("early"),
    )
    chosen = sizes.agg(F.max_by("step", rank).alias("chosen"))
    return (
        eligible.crossJoin(F.broadcast(chosen))
        .where(F.col("step") == F.col("chosen"))
        .drop("bar", "chosen")
        .orderBy(F.desc("score"), "address")
        .limit(n)
    )


def pick_convexity(
    scored: DataFrame, anchors: DataFrame, k: int = 3000,
    dispersion: tuple[float, float] = (0.18, 0.45), turnover_max: float = 300.0,
    min_month_roi: float = 0.01, min_week_roi: float = 0.0,
) -> DataFrame:
    """The trader with the best short-term pop that is neither an anchor nor erratic."""
    pool = scored.orderBy(F.desc("score"), "address").limit(k)
    pool = pool.join(anchors.select("address"), "address", "left_anti").where(
        F.col("dispersion").between(*dispersion)
        & (F.col("turnover") <= turnover_max)
        & (F.col("roi_month") >= min_month_roi)
        & (F.col("roi_week") >= min_week_roi)
        & (F.col("roi_allTime") > 0)
        & (F.col("pop") > 0)
    )
    mid = pool.agg(F.greatest(F.median("longevity_term"), F.lit(1e-6)).alias("__mid"))
    rank = (
        F.tanh(F.col("pop") / 0.25) * 0.60
        + F.tanh(F.col("convex_score") / 5.0) * 0.20
        + F.tanh(F.col("longevity_term") / F.col("__mid")) * 0.20
    )
    return (
        pool.crossJoin(F.broadcast(mid))
        .withColumn("satellite_rank", rank)
        .drop("__mid")
        .orderBy(F.desc("satellite_rank"), "address")
        .limit(1)
    )


def pick_convexity_fixed(scored: DataFrame, anchors: DataFrame, k: int = 500) -> DataFrame:
    """T13, the older rule: fixed weights, all of week, month and all-time positive."""
    pool = scored.orderBy(F.desc("score"), "address").limit(k)
    pool = pool.join(anchors.select("address"), "address", "left_anti").where(
        F.col("dispersion").between(0.18, 0.40)
        & (F.col("roi_week") > 0)
        & (F.col("roi_month") > 0)
        & (F.col("roi_allTime") > 0)
        & (F.col("turnover") <= 300)
        & (F.col("pop") > 0)
    )
    rank = F.tanh(F.col("pop") / 0.25) * 0.7 + F.tanh(F.col("convex_score") / 5.0) * 0.3
    return pool.withColumn("satellite_rank", rank).orderBy(
        F.desc("satellite_rank"), "address"
    ).limit(1)


def rank_leaders_by_equity(
    curves: DataFrame, by: str = "address", k: int | None = None, **kw
) -> DataFrame:
    """Leaders by return, consistency, drawdown and volatility of their equity curve."""
    m = equity_metrics(curves, by, **kw)
    score = (
        F.col("ret_24h") + F.col("pos_pct") * 0.1 - F.col("max_dd") * 0.8 - F.col("vol") * 0.2
    )
    out = m.withColumn("score", score).orderBy(F.desc("score"), by)
    return out.limit(k) if k else out


def funding_opportunities(
    ctx: DataFrame, min_rate: float = 0.0, notional: float = 1000.0, hours: int = 24,
    k: int | None = None,
) -> DataFrame:
    """Markets that pay shorts, best first, with the net result of a hedged position."""
    rate = F.col("funding")
    gross = rate * F.lit(notional) * F.lit(hours)
    fees = F.lit(notional * 0.0011)
    out = ctx.where(rate > min_rate).select(
        "asset", rate.alias("funding_rate"), (rate * 100).alias("funding_rate_pct"),
        (rate * 100 * 365 * 24).alias("annual_rate_pct"), "mark_price",
        gross.alias("gross_profit"), fees.alias("estimated_fees"),
        (gross - fees).alias("net_profit"),
        ((gross - fees) / F.lit(notional) * 100).alias("net_profit_pct"),
    ).orderBy(F.desc("funding_rate"), "asset")
    return out.limit(k) if k else out


def venue_funding(predicted: DataFrame, venue: str, min_rate: float = 0.0) -> DataFrame:
    """T15, nested form: ``predicted(asset, venues: array<struct<venue, fundingRate>>)``."""
    return (
        predicted.select("asset", F.explode("venues").alias("v"))
        .where(F.col("v.venue") == venue)
        .select("asset", F.col("v.fundingRate").cast("double").alias("funding_rate"))
        .where(F.col("funding_rate") > min_rate)
    )


def pool_then_rank(
    df: DataFrame, pool_by: str, k: int, rank_by: str, n: int, ties: Sequence[str] = ()
) -> DataFrame:
    """Best ``n`` by one measure among the best ``k`` by another; ``ties`` make both orders total."""
    pool = df.orderBy(F.desc(pool_by), *ties).limit(k)
    return pool.orderBy(F.desc(rank_by), *ties).limit(n)


def top_k(df: DataFrame, metric: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(metric), *ties).limit(k)


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
