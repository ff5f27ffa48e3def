"""Forecast metrics, distributions and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import ml, stats
from tickloom.workload.inputs import PREDS, TICKS, preds
from tickloom.workload.registry import Tables, query

LINE = """p AS (SELECT l_returnflag AS model, l_extendedprice AS y, l_extendedprice * (1 + ((l_partkey % 21) - 10) / 100.0::DOUBLE) AS q,
  l_quantity * 1000 AS ref FROM lineitem)"""


def _line_preds(t: Tables) -> DataFrame:
    tilt = F.lit(1) + ((F.col("l_partkey") % 21) - 10) / F.lit(100.0)
    return t.lineitem.select(
        F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("y_true"),
        (F.col("l_extendedprice") * tilt).alias("y_pred"),
        (F.col("l_quantity") * 1000).alias("reference_price"),
    )


@query(
    "A1_forecast_metrics",
    f"""WITH {LINE} SELECT model, count(*) AS n, sqrt(avg((y - q) ** 2)) AS rmse, avg(abs(y - q)) AS mae,
  coalesce(avg(abs((y - q) / y)) FILTER (y <> 0), 0) AS mape,
  coalesce(avg(2 * abs(y - q) / (abs(y) + abs(q))) FILTER (abs(y) + abs(q) <> 0), 0) AS smape,
  1 - sum((y - q) ** 2) / (count(*) * var_pop(y)) AS r_squared FROM p GROUP BY model""",
    "rmse mae mape smape r_squared",
)
def _(t: Tables):
    return stats.forecast_metrics(_line_preds(t))


@query(
    "A2_directional_accuracy_reference",
    f"""WITH {LINE} SELECT model, coalesce(avg((sign(y - ref) = sign(q - ref))::INT) FILTER (y <> ref), 0.5) AS directional_accuracy FROM p GROUP BY model""",
    "directional_accuracy",
)
def _(t: Tables):
    return stats.directional_accuracy(_line_preds(t), reference="reference_price")


@query(
    "A2_directional_accuracy_steps",
    f"""WITH {PREDS}, s AS (SELECT model, sign(y_true - lag(y_true) OVER w) AS a, sign(y_pred - lag(y_pred) OVER w) AS b FROM preds
  WINDOW w AS (PARTITION BY model ORDER BY sample_index))
SELECT model, coalesce(avg((a = b)::INT), 0) AS directional_accuracy FROM s GROUP BY model""",
    "directional_accuracy",
)
def _(t: Tables):
    return stats.directional_accuracy(preds(t))


PAIRS = """pr AS (SELECT event_type AS pair, value AS y, value * (1 + ((user_id % 21) - 10) / 100.0::DOUBLE) AS a,
  value * (1 + ((event_id % 17) - 8) / 100.0::DOUBLE) AS b FROM events),
e AS (SELECT pair, (y - a) ** 2 AS qa, (y - b) ** 2 AS qb, abs(y - a) - abs(y - b) AS d, (y - a) ** 2 - (y - b) ** 2 AS diff FROM pr),
k AS (SELECT pair, diff, rank() OVER (PARTITION BY pair ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY pair, abs(diff)) - 1) / 2.0::DOUBLE AS rk,
  count(*) OVER (PARTITION BY pair, abs(diff)) AS ties FROM e WHERE diff <> 0),
w AS (SELECT pair, count(*) AS n_nonzero, sum(rk) FILTER (diff > 0) AS rp, sum(rk) FILTER (diff < 0) AS rm, sum(ties * ties - 1.0::DOUBLE) AS t FROM k GROUP BY pair)"""


def _pairs(t: Tables) -> DataFrame:
    tilt = lambda c, m, o: F.lit(1) + ((F.col(c) % m) - o) / F.lit(100.0)
    return t.events.select(
        F.col("event_type").alias("pair"), F.col("value").alias("y_true"),
        (F.col("value") * tilt("user_id", 21, 10)).alias("a"),
        (F.col("value") * tilt("event_id", 17, 8)).alias("b"),
    )


@query(
    "A3_paired_statistics",
    f"""WITH {PAIRS} SELECT pair, count(*) AS n, any_value(n_nonzero) AS n_nonzero, count(*) FILTER (diff = 0) AS zeros,
  (sqrt(avg(qb)) - sqrt(avg(qa))) / sqrt(avg(qb)) * 100 AS rmse_relative_improvement_pct, any_value(least(rp, rm)) AS wilcoxon_w,
  any_value((least(rp, rm) - n_nonzero * (n_nonzero + 1) / 4.0::DOUBLE)
    / sqrt((n_nonzero::DOUBLE * (n_nonzero + 1) * (2 * n_nonzero + 1) - t / 2) / 24.0::DOUBLE)) AS wilcoxon_z,
  avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t_stat, any_value(t > 0) AS has_ties FROM e JOIN w USING (pair) GROUP BY pair""",
    "rmse_relative_improvement_pct wilcoxon_w wilcoxon_z t_stat",
    4,
)
def _(t: Tables):
    return stats.paired_statistics(_pairs(t))


@query("A3_paired_tests")
def _(t: Tables):
    return stats.paired_tests(_pairs(t))


@query("A4_comparison_report")
def _(t: Tables):
    arms = ("baseline", "single_dc", "multi_dc")
    rows = t.events.select(
        F.col("event_id").alias("sample_index"), F.col("value").alias("y_true"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("model"),
                        (F.col("value") + (F.col("user_id") % (5 + 4 * i)) - 2).alias("y_pred"),
                    )
                    for i, m in enumerate(arms)
                ]
            )
        ).alias("m"),
    ).select("sample_index", "y_true", "m.*")
    pairs = [("single_dc", "baseline"), ("multi_dc", "baseline"), ("multi_dc", "single_dc")]
    return stats.comparison_report(rows, pairs)


@query(
    "A11_M1_scaler",
    f"""WITH {TICKS}, tr AS (SELECT * FROM ticks WHERE event_id % 10 < 7),
m AS (SELECT avg(price) AS a, stddev_pop(price) AS s FROM tr)
SELECT event_id, CASE WHEN event_id % 10 < 7 THEN 'train' ELSE 'test' END AS part, price, (price - a) / s AS price_std FROM ticks, m""",
    "price price_std",
)
def _(t: Tables):
    rows = t.ticks.select("event_id", "price")
    train = rows.where(F.col("event_id") % 10 < 7)
    test = rows.where(F.col("event_id") % 10 >= 7)
    fitted, other = ml.zscore_fit_transform(train, [test], ["price"])[:2]
    columns = lambda df, part: df.select("event_id", F.lit(part).alias("part"), "price", "price_std")
    return columns(fitted, "train").unionByName(columns(other, "test"))


@query(
    "D9_inverse_scaler", f"WITH {TICKS} SELECT event_id, price AS price_std FROM ticks", "price_std"
)
def _(t: Tables):
    rows = t.ticks.select("event_id", "price")
    params = stats.scaler_fit(rows, ["price"])
    scaled = ml.apply_scaler(rows, params, ["price"])
    return ml.inverse_scaler(scaled, params, "price", "price_std").select("event_id", "price_std")


@query(
    "A12_percentiles",
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50,
  quantile_cont(l_extendedprice, 0.75) AS p75, quantile_cont(l_extendedprice, 0.9) AS p90, avg(l_extendedprice) AS mean,
  min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS count FROM lineitem GROUP BY 1""",
    "p25 p50 p75 p90 mean min max",
    5,
)
def _(t: Tables):
    return stats.percentiles(t.lineitem, "l_extendedprice", ["l_returnflag"])


@query(
    "A12_percentiles_global",
    """SELECT quantile_cont(l_quantity, 0.05) AS p5, quantile_cont(l_quantity, 0.95) AS p95, avg(l_quantity) AS mean,
  min(l_quantity) AS min, max(l_quantity) AS max, count(*) AS count FROM lineitem""",
    "p5 p95 mean min max",
    5,
)
def _(t: Tables):
    return stats.percentiles(t.lineitem, "l_quantity", ps=(0.05, 0.95))


@query(
    "A14_book_depth",
    """WITH b AS (SELECT p_partkey, p_retailprice AS p, p_size AS s FROM part)
SELECT p_partkey, p - 1 AS best_bid, p + 1 AS best_ask, 2.0 AS spread, 2 / (p - 1) * 100 AS spread_pct, 5.0 * s + 10 AS bid_depth, 5.0 * s + 15 AS ask_depth FROM b""",
    "best_bid best_ask spread spread_pct bid_depth ask_depth",
)
def _(t: Tables):
    def side(sign: int):
        level = lambda i: F.struct(
            (F.col("p_retailprice") + sign * (1 + i)).cast("string").alias("px"),
            (F.col("p_size") + i + (1 if sign > 0 else 0)).cast("string").alias("sz"),
        )
        return F.array(*[level(i) for i in range(7)])

    books = t.part.select("p_partkey", F.array(side(-1), side(1)).alias("levels"))
    return stats.book_depth(books)


@query(
    "A15_equity_metrics",
    """WITH c AS (SELECT user_id AS address, ts, event_id, 100 + value AS equity FROM events),
s AS (SELECT *, equity / lag(equity) OVER w - 1 AS step, (max(equity) OVER u - equity) / max(equity) OVER u AS fall,
  max(ts) OVER (PARTITION BY address) AS now FROM c WINDOW w AS (PARTITION BY address ORDER BY ts, event_id),
  u AS (PARTITION BY address ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT address, arg_max(equity, ts) / arg_min(equity, ts) FILTER (ts >= now - INTERVAL 1 HOUR) - 1 AS ret_1h,
  arg_max(equity, ts) / arg_min(equity, ts) FILTER (ts >= now - INTERVAL 24 HOUR) - 1 AS ret_24h,
  max(fall) AS max_dd, stddev_samp(step) AS vol, count(*) FILTER (step > 0) / greatest(1, count(step)) AS pos_pct FROM s GROUP BY address""",
    "ret_1h ret_24h max_dd vol pos_pct",
)
def _(t: Tables):
    return stats.equity_metrics(_curves(t), tie=["event_id"], span="7 days")


def _curves(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("address"), "ts", "event_id", (F.lit(100) + F.col("value")).alias("equity")
    )


@query(
    "A20_dataset_stats",
    """SELECT l_returnflag, 'l_quantity' AS column, count(*) AS rows, count(*) FILTER (l_quantity IS NULL) AS nulls, count(*) FILTER (l_quantity = 0) AS zeros, count(DISTINCT l_quantity) AS distinct_values,
  avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_discount', count(*), count(*) FILTER (l_discount IS NULL), count(*) FILTER (l_discount = 0), count(DISTINCT l_discount),
  avg(l_discount), stddev_pop(l_discount), min(l_discount), max(l_discount) FROM lineitem GROUP BY 1""",
    "mean std min max",
)
def _(t: Tables):
    return stats.dataset_stats(t.lineitem, ["l_quantity", "l_discount"], ["l_returnflag"])


@query(
    "A12_percentiles_of_columns",
    """SELECT 'l_quantity' AS column, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem
UNION ALL SELECT 'l_discount', quantile_cont(l_discount, 0.25), quantile_cont(l_discount, 0.5), quantile_cont(l_discount, 0.75), quantile_cont(l_discount, 0.9) FROM lineitem""",
    "p25 p50 p75 p90",
)
def _(t: Tables):
    return stats.percentiles(t.lineitem, ["l_quantity", "l_discount"], extras=False)


@query(
    "A21_train_serve_skew",
    """WITH r AS (SELECT l_orderkey % 2 AS s, l_quantity AS v FROM lineitem), m AS (SELECT min(v) AS lo, max(v) AS hi FROM r),
b AS (SELECT s, least(floor((v - lo) / (hi - lo) * 20), 19) AS bin FROM r, m),
c AS (SELECT bin, count(*) FILTER (s = 0) AS a, count(*) FILTER (s = 1) AS z FROM b GROUP BY bin),
p AS (SELECT a / sum(a) OVER () AS p, z / sum(z) OVER () AS q FROM c)
SELECT 'l_quantity' AS column, max(abs(p - q)) AS l_infinity, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS js_divergence, max(abs(p - q)) > 0.001 AS skewed FROM p""",
    "l_infinity js_divergence",
)
def _(t: Tables):
    half = lambda r: t.lineitem.where(F.col("l_orderkey") % 2 == r)
    return stats.train_serve_skew(half(0), half(1), ["l_quantity"])


@query(
    "A22_best_run",
    """SELECT o_orderkey AS run_id, o_custkey AS model, o_totalprice AS rmse FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1""",
    "rmse",
)
def _(t: Tables):
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("model"),
        F.col("o_totalprice").alias("rmse"),
    )
    return stats.best_run(runs, "rmse", by=["model"])


@query(
    "A24_distinct_rows",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem WHERE l_returnflag = 'A' ORDER BY l_shipdate",
)
def _(t: Tables):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_shipdate")
    return stats.distinct_rows(rows, {"l_returnflag": "A"}, ["l_shipdate"])


@query(
    "T14_rank_leaders_by_equity",
    """WITH c AS (SELECT user_id AS address, ts, event_id, 100 + value AS equity FROM events),
s AS (SELECT *, equity / lag(equity) OVER w - 1 AS step, (max(equity) OVER u - equity) / max(equity) OVER u AS fall,
  max(ts) OVER (PARTITION BY address) AS now FROM c WINDOW w AS (PARTITION BY address ORDER BY ts, event_id),
  u AS (PARTITION BY address ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT address, arg_max(equity, ts) / arg_min(equity, ts) FILTER (ts >= now - INTERVAL 24 HOUR) - 1 AS ret_24h,
  max(fall) AS max_dd, stddev_samp(step) AS vol, count(*) FILTER (step > 0) / greatest(1, count(step)) AS pos_pct FROM s GROUP BY address)
SELECT address, ret_24h + 0.1 * pos_pct - 0.8 * max_dd - 0.2 * vol AS score FROM m ORDER BY score DESC LIMIT 10""",
    "score",
)
def _(t: Tables):
    from tickloom.operators.ranking import rank_leaders_by_equity

    out = rank_leaders_by_equity(_curves(t), k=10, tie=["event_id"], span="7 days")
    return out.select("address", "score")


@query("M2_M3_tabular_regression")
def _(t: Tables):
    """Fares by order: encoders fitted on the training lots, boosted trees, test metrics."""
    rows = t.orders.select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("label"),
        (F.col("o_custkey") % 50).cast("double").alias("zone"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.col("o_orderpriority").alias("payment"), F.col("o_orderstatus").alias("company"),
    )
    lot = F.col("o_orderkey") % 10
    train, valid, test = rows.where(lot < 8), rows.where(lot == 8), rows.where(lot == 9)
    enc = ml.encode_features(train, ["zone", "month"], ["payment"], ["company"])
    _model, metrics = ml.tabular_regression(
        enc.transform(train), enc.transform(valid), enc.transform(test), "label",
    )
    return metrics


def _fare_model():
    return lambda pdf: 2.0 * pdf["l_quantity"] + pdf["l_extendedprice"] / 100.0


@query(
    "M4_batch_score",
    "SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, 2 * l_quantity + l_extendedprice / 100 AS score FROM lineitem",
    "l_quantity l_extendedprice score",
)
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    return ml.batch_score(rows, _fare_model, ["l_quantity", "l_extendedprice"])
