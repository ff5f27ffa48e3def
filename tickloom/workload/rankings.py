"""Assets, leaders and funding opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import ranking as R
from tickloom.session import cut_lineage
from tickloom.workload.inputs import LEADERS, leaders
from tickloom.workload.registry import Tables, query


@query(
    "T10_rank_assets",
    """WITH c AS (SELECT p_name || p_partkey AS symbol, p_retailprice AS price, p_retailprice * (1 - ((p_partkey * 37) % 21 - 10) / 100.0::DOUBLE) AS prev,
  (p_partkey % 100) * 500000.0 AS volume, ((p_partkey % 7) - 3) / 1e5 AS funding, p_size * 10.0 AS oi FROM part),
r AS (SELECT *, (price - prev) / prev * 100 AS change_pct FROM c WHERE price > 0 AND prev > 0),
d AS (SELECT *, CASE WHEN change_pct > 1.5 THEN 'long' WHEN change_pct < -1.5 THEN 'short' END AS direction FROM r WHERE volume >= 1000000)
SELECT symbol, price, change_pct, volume AS volume_24h_usd, funding * 100 AS funding_rate_pct, oi * price AS open_interest_usd, direction,
  abs(change_pct) * least(volume / 1e7, 3) * CASE WHEN (direction = 'short' AND funding < 0) OR (direction = 'long' AND funding > 0) THEN 1.2 ELSE 1 END AS score,
  CASE WHEN abs(change_pct) > 6 THEN 0.03 WHEN abs(change_pct) > 4 THEN 0.025 WHEN abs(change_pct) > 2 THEN 0.02 ELSE 0.015 END AS threshold
FROM d WHERE direction IS NOT NULL ORDER BY score DESC, symbol LIMIT 8""",
    "price change_pct volume_24h_usd funding_rate_pct open_interest_usd score threshold",
)
def _(t: Tables):
    k = F.col("p_partkey")
    ctx = t.part.select(
        F.concat(F.col("p_name"), k.cast("string")).alias("symbol"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_retailprice") * (F.lit(1) - (k * 37 % 21 - 10) / F.lit(100.0))).alias("prev"),
        ((k % 100) * F.lit(500000.0)).alias("volume"), ((k % 7 - 3) / F.lit(1e5)).alias("funding"),
        (F.col("p_size") * F.lit(10.0)).alias("open_interest"),
    )
    return R.rank_assets(ctx, n=8)


SHAPED = f"""{LEADERS},
shaped AS (SELECT *, vlm_month / account_value AS turnover, greatest(roi_day, roi_week) - roi_month AS pop,
  sqrt((pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2) + pow(d - m, 2)) / 4) AS dispersion
  FROM (SELECT *, (a + b + c + d) / 4 AS m FROM (SELECT *, ln(1 + greatest(roi_day, 0)) AS a, ln(1 + greatest(roi_week, 0)) AS b,
    ln(1 + greatest(roi_month, 0)) AS c, ln(1 + greatest(roi_allTime, 0)) AS d FROM leaders))),
conv AS (SELECT *, greatest(roi_day, roi_week) / (1e-6 + dispersion) AS convex_score FROM shaped)"""


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-greatest(least({x}, 60), -60))))"


def _core(norm: str) -> str:
    w = {"day": 0.05, "week": 0.15, "month": 0.35, "allTime": 0.45}
    roi = " + ".join(f"{v} * tanh(roi_{k} / {norm})" for k, v in w.items())
    pnl = " + ".join(f"{v} * ln(1 + greatest(pnl_{k}, 0))" for k, v in w.items())
    return f"(0.7 * ({roi}) + 0.3 * ({pnl}))"


TERMS = f"""{SHAPED},
elig AS (SELECT * FROM conv WHERE account_value >= 100000 AND vlm_month >= 10000000 AND pnl_allTime > 0),
scale AS (SELECT greatest(least(CASE WHEN count(*) FILTER (roi_month > 0) >= 50 THEN quantile_cont(roi_month, 0.75) FILTER (roi_month > 0) ELSE quantile_cont(roi_week, 0.75) END, 0.6), 0.05) AS norm,
  greatest(least(quantile_cont(turnover, 0.75), 250), 20) AS target FROM elig),
t0 AS (SELECT *, 1 / (1 + 3 * dispersion) AS smooth, ((roi_day > 0)::INT + (roi_week > 0)::INT + (roi_month > 0)::INT + (roi_allTime > 0)::INT) / 4 AS positive_share FROM elig, scale),
t1 AS (SELECT *, 0.55 * positive_share + 0.3 * smooth + 0.15 * {_sig("3 * (least(roi_day, roi_week, roi_month, roi_allTime) + 0.05)")} AS consistency_term FROM t0),
terms AS (SELECT *, (0.5 * {_sig("2.5 * greatest(least(roi_allTime, 5), -5)")} + 0.3 * {_sig("2 * greatest(least(roi_month, 2), -2)")} + 0.2 * {_sig("1.5 * greatest(least(roi_week, 2), -2)")})
    * consistency_term / (1 + 1.2 * ln(1 + turnover / target)) * {_sig("3 * (roi_allTime - roi_day)")} AS longevity_term,
  {_core("norm")} * CASE WHEN roi_week < 0 THEN 0.7 ELSE 1 END * CASE WHEN roi_day < 0 THEN 0.85 ELSE 1 END AS core_term FROM t1)"""


@query(
    "T11_score_leaders_v2",
    f"WITH {TERMS} SELECT address, consistency_term, longevity_term, 0.45 * core_term + 0.55 * longevity_term AS score, turnover, dispersion, pop, convex_score FROM terms",
    "consistency_term longevity_term score turnover dispersion pop convex_score",
)
def _(t: Tables):
    return R.score_leaders(leaders(t)).select(
        "address", "consistency_term", "longevity_term", "score", "turnover", "dispersion", "pop",
        "convex_score",
    )


FIXED = f"""{SHAPED}, fixed AS (SELECT *, {_core("0.25")} / (1 + 3 * dispersion) * {_sig("3 * (roi_allTime - roi_day)")} / (1 + 1.2 * ln(1 + turnover / 100))
  * CASE WHEN roi_week < 0 THEN 0.6 ELSE 1 END AS score FROM conv
WHERE account_value >= 100000 AND roi_month > 0 AND roi_allTime > 0 AND pnl_allTime > 0 AND vlm_month >= 10000000)"""


@query("T11b_score_leaders_v1", f"WITH {FIXED} SELECT address, score FROM fixed", "score")
def _(t: Tables):
    return R.score_leaders(leaders(t), version=1).select("address", "score")


TUNED = f"""{TERMS},
tries(step, w) AS (VALUES (0, 0.55::DOUBLE), (1, 0.63::DOUBLE), (2, 0.71::DOUBLE), (3, 0.79::DOUBLE), (4, 0.8::DOUBLE)),
best AS (SELECT step, w, longevity_term FROM terms, tries QUALIFY row_number() OVER (PARTITION BY step ORDER BY (1 - w) * core_term + w * longevity_term DESC, address) <= 10),
steps AS (SELECT step, w, median(longevity_term) AS m FROM best GROUP BY ALL),
chosen AS (SELECT arg_min(w, step) AS w FROM steps WHERE m >= 0.25 OR step = 4),
scored AS (SELECT *, w AS longevity_weight, (1 - w) * core_term + w * longevity_term AS score FROM terms, chosen)"""


@query(
    "T12_tune_longevity",
    f"WITH {TUNED} SELECT address, longevity_weight, score FROM scored",
    "longevity_weight score",
)
def _(t: Tables):
    return R.tune_longevity(leaders(t)).select("address", "longevity_weight", "score")


def _bars() -> str:
    rows = []
    for i, (a, m, d, t) in enumerate(R.ANCHOR_STEPS):
        rows.append(
            f"SELECT {i} AS step, quantile_cont(roi_allTime, {a / 100}) AS b_all, quantile_cont(roi_month, {m / 100}) AS b_month, "
            f"quantile_cont(dispersion, {d / 100}) AS b_disp, quantile_cont(turnover, {t / 100}) AS b_turn, median(longevity_term) AS b_med FROM pool"
        )
    return " UNION ALL ".join(rows)


ANCHORS = f"""{TUNED}, pool AS (SELECT * FROM scored ORDER BY score DESC, address LIMIT 3000), bars AS ({_bars()}),
ok AS (SELECT pool.*, step FROM pool, bars WHERE roi_allTime >= b_all AND roi_month >= b_month AND dispersion <= b_disp AND turnover <= b_turn AND account_value >= 100000
  AND pnl_allTime > 0 AND roi_month > 0 AND pnl_month > 0 AND positive_share >= 0.75 AND longevity_term >= b_med),
sizes AS (SELECT step, count(*) AS n FROM ok GROUP BY step),
pick AS (SELECT step FROM sizes ORDER BY (n >= 3) DESC, CASE WHEN n >= 3 THEN 0 ELSE n END DESC, step LIMIT 1),
anchors AS (SELECT ok.* FROM ok JOIN pick USING (step) ORDER BY score DESC, address LIMIT 3)"""


def _tuned(t: Tables) -> DataFrame:
    """Scored traders, written out once because anchors and the satellite both read them."""
    return cut_lineage(R.tune_longevity(leaders(t)))


@query("T12_tune_anchors", f"WITH {ANCHORS} SELECT address, step::INT AS step, score FROM anchors", "score")
def _(t: Tables):
    return R.tune_anchors(_tuned(t), n=3, k=3000).select("address", "step", "score")


@query(
    "T13_pick_convexity",
    f"""WITH {ANCHORS}, sat AS (SELECT * FROM pool WHERE address NOT IN (SELECT address FROM anchors) AND dispersion BETWEEN 0.18 AND 0.45
  AND turnover <= 300 AND roi_month >= 0.01 AND roi_week >= 0 AND roi_allTime > 0 AND pop > 0), md AS (SELECT greatest(median(longevity_term), 1e-6) AS mid FROM sat)
SELECT address, 0.6 * tanh(pop / 0.25) + 0.2 * tanh(convex_score / 5) + 0.2 * tanh(longevity_term / mid) AS satellite_rank FROM sat, md ORDER BY satellite_rank DESC, address LIMIT 1""",
    "satellite_rank",
)
def _(t: Tables):
    scored = _tuned(t)
    anchors = R.tune_anchors(scored, n=3, k=3000)
    return R.pick_convexity(scored, anchors, k=3000).select("address", "satellite_rank")


@query(
    "T13_pick_convexity_v1",
    f"""WITH {FIXED}, top AS (SELECT * FROM fixed ORDER BY score DESC, address LIMIT 500), anchors AS (SELECT address FROM fixed ORDER BY score DESC, address LIMIT 3)
SELECT address, 0.7 * tanh(pop / 0.25) + 0.3 * tanh(convex_score / 5) AS satellite_rank FROM top WHERE address NOT IN (SELECT address FROM anchors)
  AND dispersion BETWEEN 0.18 AND 0.4 AND roi_week > 0 AND roi_month > 0 AND roi_allTime > 0 AND turnover <= 300 AND pop > 0 ORDER BY satellite_rank DESC, address LIMIT 1""",
    "satellite_rank",
)
def _(t: Tables):
    scored = R.score_leaders(leaders(t), version=1)
    anchors = R.top_k(scored, "score", 3, ["address"])
    return R.pick_convexity_fixed(scored, anchors).select("address", "satellite_rank")


@query(
    "T10_pool_then_rank",
    """WITH pool AS (SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_partkey LIMIT 500)
SELECT * FROM pool ORDER BY p_retailprice DESC, p_partkey LIMIT 20""",
    "p_retailprice",
)
def _(t: Tables):
    rows = t.part.select("p_partkey", "p_size", "p_retailprice")
    return R.pool_then_rank(rows, "p_size", 500, "p_retailprice", 20, ["p_partkey"])


@query(
    "T15_funding_opportunities",
    """WITH c AS (SELECT p_name || p_partkey AS asset, ((p_partkey * 13) % 101 - 50) / 1e6 AS r, p_retailprice AS mark_price FROM part)
SELECT asset, r AS funding_rate, r * 100 AS funding_rate_pct, r * 100 * 365 * 24 AS annual_rate_pct, mark_price, r * 1000 * 24 AS gross_profit, 1.1 AS estimated_fees,
  r * 1000 * 24 - 1.1 AS net_profit, (r * 1000 * 24 - 1.1) / 1000 * 100 AS net_profit_pct FROM c WHERE r > 0""",
    "funding_rate funding_rate_pct annual_rate_pct mark_price gross_profit estimated_fees net_profit net_profit_pct",
    8,
)
def _(t: Tables):
    ctx = t.part.select(
        F.concat(F.col("p_name"), F.col("p_partkey").cast("string")).alias("asset"),
        ((F.col("p_partkey") * 13 % 101 - 50) / F.lit(1e6)).alias("funding"),
        F.col("p_retailprice").alias("mark_price"),
    )
    return R.funding_opportunities(ctx)


@query(
    "T15_venue_funding",
    """SELECT p_name || p_partkey AS asset, p_size / 1e6 AS funding_rate FROM part WHERE p_size > 0""",
    "funding_rate",
    8,
)
def _(t: Tables):
    venue = lambda name, rate: F.struct(
        F.lit(name).alias("venue"), rate.cast("string").alias("fundingRate")
    )
    nested = t.part.select(
        F.concat(F.col("p_name"), F.col("p_partkey").cast("string")).alias("asset"),
        F.array(
            venue("venue_a", F.col("p_size") / F.lit(1e5)),
            venue("venue_b", F.col("p_size") / F.lit(1e6)),
        ).alias("venues"),
    )
    return R.venue_funding(nested, "venue_b")
