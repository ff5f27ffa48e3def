"""Stream sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tickloom.operators.cleaning import flatten_telemetry, parsed_ticks


def read_tick_stream(
    spark: SparkSession, topic: str | None = None, subscription: str | None = None,
    path: str | None = None, max_files: int = 1000, **options: str,
) -> DataFrame:
    """Raw messages in ``value`` from a Kafka topic, a topic pattern, or JSON line files.

    ``topic`` and ``subscription`` (a pattern) exclude each other.
    """
    if sum(x is not None for x in (topic, subscription, path)) != 1:
        raise ValueError("give exactly one of topic, subscription and path")
    if path is not None:
        return spark.readStream.option("maxFilesPerTrigger", max_files).options(**options).text(path)
    reader = spark.readStream.format("kafka").options(**options)
    reader = reader.option("subscribe", topic) if topic else reader.option("subscribePattern", subscription)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def counted_ticks(raw: DataFrame, payload: str = "value") -> DataFrame:
    """Parsed messages with the counter ``parse_errors`` observed per batch."""
    rows = parsed_ticks(raw, payload)
    return rows.observe(
        "ticks",
        F.count_if(F.col("error").isNull()).alias("parsed"),
        F.count_if(F.col("error").isNotNull()).alias("parse_errors"),
    )


def observed_totals(progress: Iterable, totals: dict[str, int] | None = None) -> dict[str, int]:
    """Observed counters added up over the progress of batches, by ``group.name``."""
    totals = {} if totals is None else totals
    for batch in progress:
        for group, row in batch.observedMetrics.items():
            for name, value in row.asDict().items():
                totals[f"{group}.{name}"] = totals.get(f"{group}.{name}", 0) + (value or 0)
    return totals


class MetricsListener(StreamingQueryListener):
    """Adds up observed counters over the batches of a query."""

    def __init__(self):
        self.totals: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        observed_totals([event.progress], self.totals)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


#: Times to the microsecond, where the default of JSON text is the millisecond.
WHOLE_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_events(
    stream: DataFrame, out: str, checkpoint: str, dead_letter: str | None = None,
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Events as JSON lines, rows with an ``error`` to the dead-letter folder.

    Each batch overwrites its own folder, so a batch that is run again leaves no duplicates.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        failed = F.col("error").isNotNull() if "error" in batch.columns else F.lit(False)
        good = batch.where(~failed).drop("error", "payload")
        good.select(F.to_json(F.struct("*"), WHOLE_TIMES).alias("value")).write.mode("overwrite").text(
            f"{out}/batch={number}"
        )
        if dead_letter and "error" in batch.columns:
            batch.where(failed).select(
                F.to_json(F.struct("error", "payload")).alias("value")
            ).write.mode("overwrite").text(f"{dead_letter}/batch={number}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ingest_telemetry(
    spark: SparkSession, path: str, out: str, checkpoint: str, archive: str | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Append NDJSON telemetry to the seven typed tables (and ``misc``).

    The checkpoint tracks files, finished ones move to ``archive``, and a line that does not parse
    gives a row in ``misc`` instead of stopping the rest.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, table in flatten_telemetry(batch).items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    return (
        reader.text(path)
        .writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
