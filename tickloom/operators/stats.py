"""Forecast metrics, distributions and data checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.pvalues import normal_sf2, student_sf2, wilcoxon_exact_sf2
from tickloom.operators.timeline import (
    Timeline,
    max_of_key,
    max_so_far,
    micros,
    previous,
    running,
)
from tickloom.session import cut_lineage

_UP = Window.unboundedPreceding
SPLITS = 256


EXACT_UPTO = 50  # samples up to which the signed-rank distribution is enumerated


def forecast_metrics(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """A1: RMSE, MAE, MAPE, sMAPE (0-2) and R2 in one aggregation."""
    y, p = F.col("y_true"), F.col("y_pred")
    err, size = y - p, F.abs(F.col("y_true")) + F.abs(F.col("y_pred"))
    zero = F.lit(0.0)
    total = F.count(y) * F.var_pop(y)
    return preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.coalesce(F.avg(F.when(y != 0, F.abs(F.try_divide(err, y)))), zero).alias("mape"),
        F.coalesce(
            F.avg(F.when(size != 0, F.try_divide(F.lit(2.0) * F.abs(err), size))), zero
        ).alias("smape"),
        F.when(F.min(y) == F.max(y), zero)
        .otherwise(F.lit(1.0) - F.try_divide(F.sum(err * err), total))
        .alias("r_squared"),
    )


def directional_accuracy(
    preds: DataFrame,
    by: Sequence[str] = ("model",),
    reference: str | None = None,
    index: str = "sample_index",
    span: int = 100_000,
) -> DataFrame:
    """A2: share of samples whose predicted direction is right.

    With a reference price, direction is from that price and unmoved samples are left out (0.5 if
    none is left). Without, it is between consecutive samples (0 if there are fewer than two).
    """
    name = "directional_accuracy"
    if reference is not None:
        truth = F.signum(F.col("y_true") - F.col(reference))
        guess = F.signum(F.col("y_pred") - F.col(reference))
        hit = F.when(truth != 0, (truth == guess).cast("double"))
        return preds.groupBy(*by).agg(F.coalesce(F.avg(hit), F.lit(0.5)).alias(name))
    tl = Timeline.of(by, index, span=span)
    out = running(preds, tl, __prev=previous(F.struct("y_true", "y_pred")))
    step = lambda c: F.signum(F.col(c) - F.col(f"__prev.{c}"))
    hit = (step("y_true") == step("y_pred")).cast("double")
    return out.groupBy(*by).agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias(name))


def value_counts(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``by..., column, value, n``: every distinct value of every column with its number of rows, nulls too.

    One scan with map-side combination, written out: ranks, percentiles, distinct counts and moments of all the columns
    come from this table, which is as large as the columns have different values.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    stacked = df.select(*by, F.explode(cells).alias("s")).select(*by, "s.*")
    return cut_lineage(stacked.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")))


def ranks_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., value, n, below``: how many rows of its group are below each value, from ``counts(by..., value, n)`` without nulls.

    The distinct values are cut into ranges at approximate quantiles; exact positions come from running counts
    inside a range plus the totals of the ranges before it. No group is ever sorted in one task.
    """
    points = [i / SPLITS for i in range(1, SPLITS)]
    cuts = counts.groupBy(*by).agg(F.percentile_approx("value", points, 2000).alias("__cuts"))
    placed = counts.join(cuts, list(by), "left") if by else counts.crossJoin(F.broadcast(cuts))
    # Binary search for the number of cuts below the value.
    steps = F.array(*[F.lit(SPLITS >> k) for k in range(1, SPLITS.bit_length())])
    bucket = F.aggregate(
        steps, F.lit(0),
        lambda at, s: at
        + F.when(F.get("__cuts", at + s - 1) < F.col("value"), s).otherwise(F.lit(0)),
    )
    placed = placed.withColumn("__bucket", bucket).drop("__cuts")
    inside = Window.partitionBy(*by, "__bucket").orderBy("value").rowsBetween(_UP, -1)
    totals = placed.groupBy(*by, "__bucket").agg(F.sum("n").alias("__t"))
    across = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(_UP, -1)
    offsets = totals.select(
        *by, "__bucket", F.coalesce(F.sum("__t").over(across), F.lit(0)).alias("__before")
    )
    local = placed.withColumn("__local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(offsets, [*by, "__bucket"]).select(
        *by, "value", "n", (F.col("__before") + F.col("__local")).alias("below")
    )


def ranked_values(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Each distinct value with its count ``n`` and how many rows of its group are ``below`` it."""
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(*by, F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return ranks_of_counts(cut_lineage(counts), by)


def percentiles(
    df: DataFrame,
    col: str | Sequence[str],
    by: Sequence[str] = (),
    ps: Sequence[float] = (0.25, 0.5, 0.75, 0.9),
    extras: bool = True,
) -> DataFrame:
    """Exact percentiles, linearly interpolated, with mean, min, max and count, in one scan of ``df``.

    Percentile ``p`` of ``n`` rows sits at position ``p * (n - 1)``. Of several columns each is a row, named in ``column``.
    """
    cols = [col] if isinstance(col, str) else list(col)
    counts = value_counts(df, by, cols).where("value is not null")
    keys = [*by, "column"]
    ranks = ranks_of_counts(counts, keys)
    v, n = F.col("value"), F.col("n")
    sizes = counts.groupBy(*keys).agg(
        F.sum(n).alias("count"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
    )
    both = ranks.join(sizes, keys)
    covers = lambda pos: (F.col("below") <= pos) & (pos < F.col("below") + F.col("n"))
    wanted = F.lit(False)
    aggs = []
    for p in ps:
        at = F.lit(p) * (F.col("count") - 1)
        lo, frac = F.floor(at), at - F.floor(at)
        hi = F.least(lo + 1, F.col("count") - 1)
        wanted = wanted | covers(lo) | covers(hi)
        part = F.when(covers(lo), F.col("value") * (1 - frac)).otherwise(0.0) + F.when(
            covers(hi), F.col("value") * frac
        ).otherwise(0.0)
        aggs.append(F.sum(part).alias(f"p{p * 100:g}".replace(".", "_")))
    tail = [F.first(c).alias(c) for c in ("mean", "min", "max", "count")] if extras else []
    out = both.where(wanted).groupBy(*keys).agg(*aggs, *tail)
    return out.drop("column") if isinstance(col, str) else out


@F.pandas_udf(T.DoubleType())
def _student_p(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) else student_sf2(a, b - 1) for a, b in zip(t, n)], dtype="float64"
    )


@F.pandas_udf(T.DoubleType())
def _wilcoxon_p(w: pd.Series, z: pd.Series, n: pd.Series, exact: pd.Series) -> pd.Series:
    out = []
    for stat, score, size, small in zip(w, z, n, exact):
        if pd.isna(stat) or pd.isna(size):
            out.append(None)
        elif small:
            out.append(wilcoxon_exact_sf2(stat, int(size)))
        else:
            out.append(None if pd.isna(score) else normal_sf2(score))
    return pd.Series(out, dtype="float64")


def paired_statistics(pairs: DataFrame, by: Sequence[str] = ("pair",)) -> DataFrame:
    """The test statistics of A3 from rows ``(by..., y_true, a, b)``, before p-values.

    Signed ranks use one count per distinct absolute difference, so ties and hot values cost
    nothing, and the rank of a value is known without sorting a pair's samples in one place.
    """
    ea, eb = F.col("y_true") - F.col("a"), F.col("y_true") - F.col("b")
    rows = pairs.select(
        *by, (ea * ea).alias("qa"), (eb * eb).alias("qb"),
        (F.abs(ea) - F.abs(eb)).alias("d_abs"),
    ).withColumn("diff", F.col("qa") - F.col("qb"))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg("qa")).alias("rmse_a"),
        F.sqrt(F.avg("qb")).alias("rmse_b"),
        F.avg("d_abs").alias("__m"),
        F.stddev_samp("d_abs").alias("__s"),
        F.count_if(F.col("diff") == 0).alias("zeros"),
    )
    nonzero = rows.where(F.col("diff") != 0).withColumn("size", F.abs("diff"))
    ranks = ranked_values(nonzero, by, "size").withColumn(
        "rank", F.col("below") + (F.col("n") + 1) / 2.0
    )
    signs = nonzero.groupBy(*by, F.col("size").alias("value")).agg(
        F.count_if(F.col("diff") > 0).alias("plus"),
        F.count_if(F.col("diff") < 0).alias("minus"),
    )
    n = F.col("n").cast("double")
    sums = (
        ranks.join(signs, [*by, "value"])
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n_nonzero"),
            F.sum(F.col("rank") * F.col("plus")).alias("r_plus"),
            F.sum(F.col("rank") * F.col("minus")).alias("r_minus"),
            F.sum(n * n * n - n).alias("__ties"),
        )
    )
    out = base.join(sums, list(by), "left")
    m = F.col("n_nonzero").cast("double")
    spread = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("__ties") / 2) / 24.0)
    w = F.least("r_plus", "r_minus")
    usable = (F.col("n") >= 5) & F.col("n_nonzero").isNotNull()
    return out.select(
        *by,
        "n",
        "n_nonzero",
        "zeros",
        F.when(F.col("rmse_b") == 0, 0.0)
        .otherwise(F.try_divide(F.col("rmse_b") - F.col("rmse_a"), F.col("rmse_b")) * 100)
        .alias("rmse_relative_improvement_pct"),
        F.when(usable, w).alias("wilcoxon_w"),
        F.when(usable, F.try_divide(w - m * (m + 1) / 4.0, spread)).alias("wilcoxon_z"),
        F.when(
            F.col("n") >= 2, F.try_divide(F.col("__m"), F.col("__s") / F.sqrt(F.col("n")))
        ).alias("t_stat"),
        (F.col("__ties") > 0).alias("has_ties"),
    )


def paired_tests(
    pairs: DataFrame, by: Sequence[str] = ("pair",), exact_upto: int = EXACT_UPTO
) -> DataFrame:
    """A3: RMSE gain of ``a`` over ``b``, Wilcoxon and paired-t p-values per pair.

    The signed-rank p-value is exact for at most ``exact_upto`` samples without ties or zeros, and
    by the normal approximation beyond, the usual rule of statistics libraries.
    """
    stats = paired_statistics(pairs, by)
    exact = (F.col("n_nonzero") <= exact_upto) & ~F.col("has_ties") & (F.col("zeros") == 0)
    return stats.select(
        *by,
        "n",
        "rmse_relative_improvement_pct",
        _wilcoxon_p("wilcoxon_w", "wilcoxon_z", "n_nonzero", exact).alias("wilcoxon_p"),
        _student_p("t_stat", "n").alias("paired_ttest_p"),
    )


def model_pairs(
    preds: DataFrame, pairs: Sequence[tuple[str, str]], key: Sequence[str] = ("sample_index",)
) -> DataFrame:
    """Rows ``(pair, y_true, a, b)`` for each named pair of models.

    The models of a sample meet in one map-side combined aggregation rather than in joins.
    """
    names = list(dict.fromkeys(n for p in pairs for n in p))
    at = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    wide = preds.where(F.col("model").isin(names)).groupBy(*key).agg(
        *[at(m, "y_pred").alias(f"p_{m}") for m in names],
        *[at(m, "y_true").alias(f"y_{m}") for m in names],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"{a}_vs_{b}").alias("pair"),
                    F.col(f"y_{b}").alias("y_true"),
                    F.col(f"p_{a}").alias("a"),
                    F.col(f"p_{b}").alias("b"),
                )
                for a, b in pairs
            ]
        )
    )
    out = wide.select(rows.alias("r")).select("r.*")
    return out.where(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("y_true").isNotNull())


def comparison_report(
    preds: DataFrame, pairs: Sequence[tuple[str, str]], key: Sequence[str] = ("sample_index",)
) -> DataFrame:
    """A4: metrics per model and the pairwise rows, as (section, subject, metric, value)."""
    metrics = forecast_metrics(preds).join(directional_accuracy(preds), "model")
    names = ["rmse", "mae", "mape", "smape", "r_squared", "directional_accuracy"]
    arms = metrics.select(F.col("model").alias("subject"), *names).unpivot(
        ["subject"], names, "metric", "value"
    )
    cols = ["rmse_relative_improvement_pct", "wilcoxon_p", "paired_ttest_p"]
    versus = (
        paired_tests(model_pairs(preds, pairs, key))
        .select(F.col("pair").alias("subject"), *cols)
        .unpivot(["subject"], cols, "metric", "value")
    )
    return arms.withColumn("section", F.lit("per_model")).unionByName(
        versus.withColumn("section", F.lit("comparisons"))
    )


def scaler_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of means and population deviations; a constant column gets scale 1."""
    aggs = []
    for c in cols:
        dev = F.stddev_pop(c)
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.when(F.min(c) == F.max(c), 1.0)
            .when(dev == 0, 1.0)
            .otherwise(dev)
            .alias(f"{c}_scale"),
        ]
    return train.agg(*aggs)


def dataset_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per column (and split): counts, nulls, zeros, distinct values, mean, std, min, max; all exact, in one scan of ``df``."""
    counts = value_counts(df, by, cols)
    keys = [*by, "column"]
    v, n = F.col("value"), F.col("n")
    seen = F.when(v.isNotNull(), n)
    sums = counts.groupBy(*keys).agg(
        F.sum(n).alias("rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)).alias("zeros"),
        F.count(v).alias("distinct_values"),
        F.try_divide(F.sum(v * n), F.sum(seen)).alias("mean"),
        F.sum(seen).alias("__seen"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    # Squares around the mean, so that large values with little spread keep their digits.
    off = v - F.col("mean")
    spread = counts.join(sums.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum(off * off * n).alias("__square"))
    out = sums.join(spread, keys, "left").withColumn("std", F.sqrt(F.try_divide("__square", "__seen")))
    return out.select(*keys, "rows", "nulls", "zeros", "distinct_values", "mean", "std", "min", "max")


def train_serve_skew(
    train: DataFrame, serve: DataFrame, cols: Sequence[str], bins: int = 20,
    threshold: float = 0.001,
) -> DataFrame:
    """Distance between the two distributions of each column.

    Both sides are counted into the same equal-width bins (range of the two together), giving the
    largest bin difference (L-infinity) and the Jensen-Shannon divergence in bits.
    """
    stack = lambda df, side: df.select(
        F.lit(side).alias("side"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                    for c in cols
                ]
            )
        ).alias("s"),
    ).select("side", "s.*")
    rows = stack(train, "train").unionByName(stack(serve, "serve")).where("value is not null")
    ranges = rows.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.least(
        F.floor(
            F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * F.lit(bins)
        ),
        F.lit(bins - 1),
    )
    binned = rows.join(F.broadcast(ranges), "column").withColumn(
        "bin", F.coalesce(place, F.lit(0))
    )
    here = lambda s: F.count(F.when(F.col("side") == s, 1)).alias(s)
    counts = binned.groupBy("column", "bin").agg(here("train"), here("serve"))
    totals = counts.groupBy("column").agg(
        F.sum("train").alias("n_train"), F.sum("serve").alias("n_serve")
    )
    p = F.coalesce(F.try_divide(F.col("train"), F.col("n_train")), F.lit(0.0))
    q = F.coalesce(F.try_divide(F.col("serve"), F.col("n_serve")), F.lit(0.0))
    mid = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(F.try_divide(x, mid))).otherwise(0.0)
    out = counts.join(F.broadcast(totals), "column").groupBy("column").agg(
        F.max(F.abs(p - q)).alias("l_infinity"),
        F.sum((part(p) + part(q)) / 2).alias("js_divergence"),
    )
    return out.withColumn("skewed", F.col("l_infinity") > F.lit(threshold))


def best_run(
    runs: DataFrame, metric: str, lower_is_better: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """Champion among runs by one metric; equal values go to the lowest ``run_id``."""
    value = F.col(metric) if lower_is_better else -F.col(metric)
    row = F.struct(*[F.col(c) for c in runs.columns])
    best = runs.where(F.col(metric).isNotNull()).groupBy(*by).agg(
        F.min_by(row, F.struct(value.alias("v"), F.col("run_id"))).alias("r")
    )
    return best.select("r.*")


EXPERIMENT_SCHEMA = (
    "per_model map<string, map<string, double>>, comparisons map<string, map<string, double>>"
)


def experiment_rollup(
    spark: SparkSession, path: str, metrics: Sequence[str] | None = None
) -> DataFrame:
    """One row per results file and model, one column per metric.

    The run's name is the folder the file lies in.
    """
    files = spark.read.schema(EXPERIMENT_SCHEMA).json(path, multiLine=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    long = files.select(
        F.url_decode(name).alias("experiment"), F.explode("per_model").alias("model", "values")
    ).select("experiment", "model", F.explode("values").alias("metric", "value"))
    pivot = long.groupBy("experiment", "model")
    pivot = pivot.pivot("metric", list(metrics)) if metrics else pivot.pivot("metric")
    return pivot.agg(F.first("value", True))


def distinct_rows(
    df: DataFrame, filters: dict[str, object] | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Distinct rows after equality filters, globally ordered if asked."""
    conds = [F.col(k) == F.lit(v) for k, v in (filters or {}).items()]
    out = (df.where(reduce(lambda a, b: a & b, conds)) if conds else df).distinct()
    return out.orderBy(*order) if order else out


def window_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Records per split and the sizes of their windows."""
    size = lambda c: F.max(F.size(c))
    aggs = [F.count(F.lit(1)).alias("windows")]
    aggs += [size(c).alias(f"{c}_len") for c in ("x", "y") if c in df.columns]
    return df.groupBy(split).agg(*aggs)


def equity_metrics(
    curve: DataFrame,
    by: str | Sequence[str] = "address",
    ts: str = "ts",
    value: str = "equity",
    tie: Sequence[str] = (),
    span: str | int = "1 day",
) -> DataFrame:
    """Share of up steps, drawdown, step volatility and 1 h / 24 h return per curve."""
    tl = Timeline.of(by, ts, tie, span)
    v = F.col(value)
    base = curve.withColumn("__at", micros(curve, ts))
    out = running(
        base, tl, __prev=previous(v), __peak=max_so_far(v), __now=max_of_key(F.col("__at"))
    )
    step = F.when(F.col("__prev") > 0, v / F.when(F.col("__prev") > 0, F.col("__prev")) - 1.0)
    fall = F.when(F.col("__peak") > 0, (F.col("__peak") - v) / F.col("__peak"))
    ordered = F.struct("__at", *tl.tie)
    inside = lambda s: F.when(
        F.col("__at") >= F.col("__now") - F.lit(s * 1_000_000), ordered
    )
    agg = (
        out.withColumn("__step", step)
        .withColumn("__fall", fall)
        .groupBy(*tl.by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("__step").alias("steps"),
            F.count_if(F.col("__step") > 0).alias("ups"),
            F.max("__fall").alias("dd"),
            F.stddev_samp("__step").alias("dev"),
            F.max_by(v, ordered).alias("last"),
            F.min_by(v, inside(3600)).alias("b1"),
            F.min_by(v, inside(86400)).alias("b24"),
        )
    )
    enough = F.col("n") >= 3
    gain = lambda b: F.when(
        enough & (F.col(b) > 0), F.col("last") / F.when(F.col(b) > 0, F.col(b)) - 1.0
    ).otherwise(0.0)
    return agg.select(
        *tl.by,
        gain("b1").alias("ret_1h"),
        gain("b24").alias("ret_24h"),
        F.when(enough, F.coalesce("dd", F.lit(0.0))).otherwise(0.0).alias("max_dd"),
        F.when(enough & (F.col("steps") >= 2), F.col("dev")).otherwise(0.0).alias("vol"),
        F.when(enough, F.col("ups") / F.greatest(F.lit(1), F.col("steps")))
        .otherwise(0.0)
        .alias("pos_pct"),
    )


def book_depth(books: DataFrame, levels: int = 5) -> DataFrame:
    """Best prices, spread and size of the top levels. ``levels: [[bids], [asks]]``."""
    side = lambda i: F.get(F.col("levels"), F.lit(i))
    best = lambda i: F.get(side(i), F.lit(0))["px"].cast("double")
    depth = lambda i: F.aggregate(
        F.slice(side(i), 1, levels), F.lit(0.0), lambda a, x: a + x["sz"].cast("double")
    )
    out = books.withColumn("best_bid", best(0)).withColumn("best_ask", best(1))
    spread = F.col("best_ask") - F.col("best_bid")
    return (
        out.where(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull())
        .withColumn("spread", spread)
        .withColumn(
            "spread_pct",
            F.when(F.col("best_bid") > 0, F.try_divide(spread, F.col("best_bid")) * 100).otherwise(0.0),
        )
        .withColumn("bid_depth", depth(0))
        .withColumn("ask_depth", depth(1))
        .drop("levels")
    )
