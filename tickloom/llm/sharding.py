"""Proportional stratified interleaving into shards (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import store

SEED = 17
ROWS = 100_000  # rows of one bucket of equal hash or fraction range, about
LEAST = 256  # buckets at least
OVERHEAD = 16


def _numbered(rows: DataFrame, by: list[str], at: Column, order: list[str], buckets: int, name: str) -> DataFrame:
    """``name``: place from 0 in ``order`` among rows with the same ``by``; ``at`` from 0 to 1 rises with ``order``.

    ``at`` is spread evenly, so its ranges hold about the same number of rows whatever the size of a key. Counts per
    range are aggregated map-side and summed up; a window then numbers the rows of one range only.
    """
    rows = rows.withColumn("bucket", F.least(F.floor(at * buckets), F.lit(buckets - 1)).cast("long"))
    counts = rows.groupBy(*by, "bucket").count()
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(counts.select(*by, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")), "starts")
    own = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(*order)) - 1
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "bucket"]]
    joined = rows.withColumn("own", own).alias("r").join(starts.alias("s"), same)
    return joined.select("r.*", (F.col("own") + F.col("start")).alias(name)).drop("own", "bucket")


def interleave(docs: DataFrame, shards: int = 40, seed: int = SEED, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: every shard has the mixture of the whole.

    Rows of a source are shuffled by a seeded hash of their values and ranked; the r-th of n rows
    stands at (r + 1/2) / n, and rows of all sources are sorted by that (ties by source, then hash). The
    sorted rows are cut into ``shards`` runs whose counts differ by at most one (law ``rows``, so
    ``grown_shard`` is null); every source gives each run its share of rows to within two. ``slot``
    is the place in the run. Equal texts may go to different shards: the law is on counts.

    Texts are read once and not shuffled. A null text has size 16 and the check sum of no bytes; a null source is a
    source of its own; repeated rows each have a place. Other columns don't matter; fewer rows than
    shards leave shards empty; an empty table gives an empty one.
    """
    data = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
    )
    rows = store(rows.withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id", "source", "size", "text_crc32")), "sizes")
    total = rows.count()
    buckets = max(LEAST, -(-total // ROWS))
    at = F.col("shuffled") / F.lit(2.0**64) + 0.5
    ranked = _numbered(rows, ["source"], at, ["shuffled", "doc_id", "size", "text_crc32"], buckets, "rank")
    own = store(rows.groupBy("source").agg(F.count("*").alias("n")), "sources")
    ranked = ranked.alias("r").join(own.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source"))).select("r.*", "n")
    ranked = store(ranked.withColumn("at", (F.col("rank") + 0.5) / F.col("n")), "ranked")
    placed = _numbered(ranked.withColumn("all", F.lit(0)), ["all"], F.col("at"), ["at", "source", "shuffled", "doc_id", "size", "text_crc32"], buckets, "place")
    big, small = -(-total // shards), total // shards  # rows of the first shards and of the rest
    many = total - small * shards
    edge = F.lit(many * big)
    place = F.col("place")
    shard = F.when(place < edge, F.floor(place / F.lit(max(1, big)))).otherwise(F.lit(many) + F.floor((place - edge) / F.lit(max(1, small))))
    start = F.least(F.col("shard"), F.lit(many)) * big + F.greatest(F.col("shard") - many, F.lit(0)) * small
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (place - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
