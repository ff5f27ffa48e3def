"""What several operators need: stored intermediate tables and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that it survives lost executors, and gives Spark exact sizes, so that it
    broadcasts the table only where it is known to be small.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Hand the memory that a Python worker no longer uses back to the system; Spark keeps workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives memory back before and after its task."""

    def tidied(batches) -> Iterator:
        release()
        yield from run(batches)
        release()

    return tidied


def map_batches(df: DataFrame, step: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` for a function that turns the batch's columns (lists) into columns."""

    def run(batches):
        for batch in batches:
            out = step(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(tidy(run), schema)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class Memo(dict):
    """Results by word, in two generations: of a full one, only what is asked for again goes on to the next."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def lacks(self, words: set) -> set:
        """Those of ``words`` that neither generation has; what the old one has goes into this."""
        missing = {w for w in words if w not in self}
        kept = {w for w in missing if w in self.old}  # not intersection(), which would walk through the whole dictionary
        self.update((w, self.old[w]) for w in kept)
        return missing - kept


class HashFilter:
    """Which 64-bit hashes may be in a set: never wrong about a member, sometimes about another hash.

    One bit per hash in a bit field that is sized by the set, between 2**16 and 2**28 bits (32 MB), so
    it can go to the driver and to every task whatever the size of the set. A set too large for the
    field makes it say yes more often; callers count exactly afterwards.
    """

    LEAST, MOST, SPARE = 16, 28, 32

    def __init__(self, field: np.ndarray):
        self.field, self.mask = field, np.uint64(len(field) * 64 - 1)

    @classmethod
    def of(cls, hashes: DataFrame, name: str = "h", most: int = MOST) -> HashFilter:
        bits = 1 << min(most, max(cls.LEAST, (cls.SPARE * hashes.count()).bit_length()))
        bit = F.col(name).bitwiseAND(bits - 1)
        slots = hashes.select(F.shiftright(bit, 6).cast("int").alias("slot"), bit.bitwiseAND(63).cast("int").alias("bit")).where("slot is not null")
        held = slots.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("held")).toArrow()
        field = np.zeros(bits // 64, np.int64)
        field[held.column("slot").to_numpy()] = held.column("held").to_numpy()
        return cls(field.view(np.uint64))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.field[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def has_one(self, h: int) -> bool:
        at = h & int(self.mask)
        return bool(int(self.field[at >> 6]) >> (at & 63) & 1)


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over ``edges`` (``a, b``) from each of their nodes.

    Each round every label that has a smaller neighbour hooks onto its smallest one, the hooks are
    flattened by pointer jumping, and the edges are relabelled and made distinct. At least half of
    the labels with neighbours go in every round. Minima are aggregated map-side and every join has
    a side that is unique by key and stored, so Spark can split a label that many rows share.
    Nothing is gathered on the driver but whether rows are left. Null ends and loops are ignored;
    no edges give an empty table.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = store(ends.where("a < b").distinct(), "edges")
    labels = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = store(labels.withColumn("label", F.col("node")), "labels")
    while not pairs.isEmpty():
        hooks = store(pairs.groupBy("b").agg(F.min("a").alias("to")).select(F.col("b").alias("label"), "to"), "hooks")
        while True:
            up = hooks.select(F.col("label").alias("to"), F.col("to").alias("top"))
            jumped = store(hooks.join(up, "to", "left").select("label", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("label", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = store(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left = pairs.join(hooks.select(F.col("label").alias("a"), F.col("to").alias("to_a")), "a", "left")
        both = left.join(hooks.select(F.col("label").alias("b"), F.col("to").alias("to_b")), "b", "left")
        a, b = F.coalesce("to_a", "a"), F.coalesce("to_b", "b")
        pairs = store(both.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    return labels.select("node", F.col("label").alias("component"))
