"""Model preparation on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.joins import single_row
from tickloom.operators.stats import forecast_metrics, scaler_fit


def apply_scaler(
    df: DataFrame, params: DataFrame, cols: Sequence[str], indicators: Sequence[str] = (),
    scale_indicators: bool = False,
) -> DataFrame:
    """``<col>_std`` next to each raw column; indicators pass or become -1 / +1."""
    out = df.crossJoin(F.broadcast(single_row(params, "scaler parameters")))
    new = {f"{c}_std": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale") for c in cols}
    if scale_indicators:
        new |= {f"{c}_std": (F.col(c) - 0.5) * 2 for c in indicators}
    return out.withColumns(new).drop(*[f"{c}_{s}" for c in cols for s in ("mean", "scale")])


def inverse_scaler(df: DataFrame, params: DataFrame, col: str, scaled: str) -> DataFrame:
    """A scaled column back in the units of ``col``."""
    one = single_row(params, "scaler parameters").select(f"{col}_mean", f"{col}_scale")
    out = df.crossJoin(F.broadcast(one))
    raw = F.col(scaled) * F.col(f"{col}_scale") + F.col(f"{col}_mean")
    return out.withColumn(scaled, raw).drop(f"{col}_mean", f"{col}_scale")


def zscore_fit_transform(
    train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str]
) -> list[DataFrame]:
    """M1: parameters from the training split, applied to every split."""
    params = scaler_fit(train, cols)
    return [apply_scaler(d, params, cols) for d in (train, *others)]


def latent_concat(
    df: DataFrame, key: str = "window_id", order: str = "threshold",
    vectors: Sequence[str] = ("z", "z_mean", "z_log_var"), label: str = "first",
    expected: int | None = None,
) -> DataFrame:
    """One row per window with each vector concatenated over thresholds in order.

    ``label`` keeps the first threshold's y or stacks all. A window that does not have
    ``expected`` thresholds stops the job. Groups hold one row per threshold.
    """
    rows = F.sort_array(F.collect_list(F.struct(order, *vectors, "y")))
    out = df.groupBy(key).agg(rows.alias("r"))
    if expected is not None:
        short = F.size("r") != expected
        message = F.lit("window is missing a threshold")
        out = out.where(F.when(short, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    y = F.col("r")[0]["y"] if label == "first" else F.col("r.y")
    return out.select(
        key, *[F.flatten(F.col(f"r.{v}")).alias(v) for v in vectors], y.alias("y")
    )


def pick_label(df: DataFrame, thresholds: Sequence[str], want: int | str) -> DataFrame:
    """The label of one threshold from stacked labels, by clamped index or canonical text."""
    if isinstance(want, str):
        want = list(thresholds).index(want) if want in thresholds else 0
    index = max(0, min(int(want), len(thresholds) - 1))
    return df.withColumn("y", F.col("y")[index])


def long_predictions(
    df: DataFrame, index: str = "sample_index", y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    """Arrays of one row per sample to one row per (sample, horizon)."""
    pairs = F.arrays_zip(F.col(y).alias("y_true"), F.col(p).alias("y_pred"))
    return df.select(index, F.posexplode(pairs).alias("horizon", "v")).select(
        index, "horizon", "v.y_true", "v.y_pred"
    )


def encode_features(
    df: DataFrame, num: Sequence[str], ohe: Sequence[str] = (), ordinal: Sequence[str] = ()
) -> PipelineModel:
    """M2: standardise numbers, one-hot and ordinal encode categories into ``features``.

    Unknown categories get their own ordinal and no one-hot position.
    """
    cats = [*ohe, *ordinal]
    stages: list = [
        VectorAssembler(inputCols=list(num), outputCol="__num", handleInvalid="keep"),
        StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True),
    ]
    if cats:
        stages.append(
            StringIndexer(
                inputCols=cats, outputCols=[f"{c}_ix" for c in cats], handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
    if ohe:
        # The indexer's extra "unknown" slot is the last category, which is the dropped one.
        stages.append(
            OneHotEncoder(
                inputCols=[f"{c}_ix" for c in ohe], outputCols=[f"{c}_1h" for c in ohe],
                dropLast=True,
            )
        )
    parts = ["__scaled", *[f"{c}_1h" for c in ohe], *[f"{c}_ix" for c in ordinal]]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df)


def tabular_regression(
    train: DataFrame, valid: DataFrame, test: DataFrame, label: str, features: str = "features",
    **params,
) -> tuple[object, DataFrame]:
    """M3: gradient-boosted trees and, on the test split, RMSE, MAE, MAPE, R2 and RMSLE.

    Predictions are cut at zero. The validation split stops the boosting early.
    """
    flag = "__valid"
    both = train.withColumn(flag, F.lit(False)).unionByName(valid.withColumn(flag, F.lit(True)))
    model = GBTRegressor(
        featuresCol=features, labelCol=label, validationIndicatorCol=flag, seed=7, **params
    ).fit(both)
    scored = model.transform(test).select(
        F.lit("model").alias("model"),
        F.col(label).cast("double").alias("y_true"),
        F.greatest(F.col("prediction"), F.lit(0.0)).alias("y_pred"),
    )
    gap = F.log1p(F.greatest(F.col("y_pred"), F.lit(0.0))) - F.log1p(
        F.greatest(F.col("y_true"), F.lit(0.0))
    )
    rmsle = scored.groupBy("model").agg(F.sqrt(F.avg(gap * gap)).alias("rmsle"))
    return model, forecast_metrics(scored).join(rmsle, "model")


def batch_score(
    df: DataFrame, model_fn: Callable[[], Callable], cols: Sequence[str], out: str = "score"
) -> DataFrame:
    """M4: score rows in Arrow batches; ``model_fn`` loads the model once per Python worker.

    The loaded callable takes a pandas frame of ``cols`` and returns one number per row.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    names = list(cols)

    def score(batches):
        model = model_fn()
        for pdf in batches:
            yield pdf.assign(**{out: model(pdf[names])})

    return df.mapInPandas(score, schema)
