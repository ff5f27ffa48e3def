"""Registered queries: a Spark callable and, where SQL can express it, an independent SQL check."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """The given tables of one scale folder, read when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        return self.events.select(
            F.col("event_type").alias("symbol"), "ts", (F.col("value") + 50).alias("price"),
            "event_id",
        )


def nudge(digits: int) -> float:
    """Moves exact halves off the rounding border, where two engines may differ."""
    return 3.71 * 10.0 ** (-digits - 2)


def rounded(df: DataFrame, names: list[str], digits: int) -> DataFrame:
    """Doubles rounded (and minus zero made zero) so that two engines can be compared."""
    shift = F.lit(nudge(digits))
    return df.withColumns(
        {c: F.round(F.col(c).cast("double") + shift, digits) + F.lit(0.0) for c in names}
    )


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register ``fn(tables)`` under ``name``; ``doubles`` are rounded on both sides."""
    names = doubles.split()

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(fn(Tables(spark, folder)), names, digits)

        QUERIES[name] = run
        if sql is not None:
            swaps = ", ".join(f"round({c}::DOUBLE + {nudge(digits)!r}::DOUBLE, {digits}) + 0.0 AS {c}"
                for c in names)
            star = f"* REPLACE ({swaps})" if names else "*"
            CHECKS[name] = f"SELECT {star} FROM ({sql}\n)"
        return fn

    return register
