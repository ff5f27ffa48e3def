"""Embedding near-duplicates: Euclidean p-stable hashing (operator 2)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import components, store

COSINE = 0.95
TABLES, WIDTH, STEP = 28, 5, 1.0  # tables, projections of a table, width of a quantum
SEED = 5
LARGE = 2048  # members of a bucket that are compared in one task; beyond, pairs of parts are


def recall(cosine: float = COSINE, tables: int = TABLES, width: int = WIDTH, step: float = STEP) -> float:
    """Probability that two vectors of that cosine share a bucket in some table."""
    c = math.sqrt(max(0.0, 2 - 2 * cosine)) or 1e-12
    r = step / c
    one = math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))
    return 1 - (1 - one**width) ** tables


def _projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((dim, TABLES * WIDTH)), rng.uniform(0, STEP, TABLES * WIDTH)


def _normal(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit rows in double precision; all ``raw`` have the same length."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _quanta(x: np.ndarray) -> np.ndarray:
    """Bucket number of each row in each table."""
    a, b = _projections(x.shape[1])
    q = np.floor((x @ a + b) / STEP).astype(np.int64).reshape(len(x), TABLES, WIDTH)
    h = np.full((len(x), TABLES), x.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WIDTH):
            h = (h ^ q[:, :, i].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _valid(kind: str):
    """The bytes of each vector's numbers (0 for -0); null where it can't link."""

    def run(batches):
        for batch in batches:
            raw = []
            for v in batch.column(1).to_pylist():
                x = np.array(v, kind) + 0 if v and None not in v else np.zeros(0)
                raw.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    return run


def _deal(kind: str, whole: bool):
    """A row per vector and table, with the bucket; with the vector if ``whole``."""

    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(raw):
                by_size.setdefault(len(x), []).append(i)
            for at in by_size.values():
                keys, part = _quanta(_normal([raw[i] for i in at], kind)), batch.take(pa.array(at))
                for t in range(TABLES):
                    cols = [pa.array(np.full(len(at), t, np.int32)), pa.array(np.ascontiguousarray(keys[:, t]))]
                    yield pa.RecordBatch.from_arrays(cols + part.columns * whole, ["tab", "key", *["rep", "raw", "copies"] * whole])

    return run


def _chains(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the pairs."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(x), top(y)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _compare(kind: str):
    """Pairs of a tile: cosines in double precision; a pair counts in the first table that has it."""

    def run(batches):
        for batch in batches:
            reps, links, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            ends = batch.column(3).offsets.to_numpy()
            rep, raw, copies, part = batch.column(3).flatten().flatten()
            rep, copies, part, ends = rep.to_numpy(), copies.to_numpy(), part.to_numpy(), ends - ends[0]
            for tab, one, two, start, stop in zip(*(c.to_pylist() for c in batch.columns[:3]), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                data = raw.slice(start, stop - start).to_pylist()
                sizes = np.array(list(map(len, data)))
                for size in np.unique(sizes):  # one, but for keys that meet by chance
                    at = np.flatnonzero(sizes == size)
                    x = _normal([data[k] for k in at], kind)
                    i, j = _near(x, part[start + at], one, two)
                    if not len(i):
                        continue
                    used, where = np.unique(np.r_[i, j], return_inverse=True)
                    keys = _quanta(x[used])[where].reshape(2, len(i), TABLES)
                    first = ~(keys[0, :, :tab] == keys[1, :, :tab]).any(1)
                    i, j = start + at[i[first]], start + at[j[first]]
                    both = np.r_[i, j]
                    ids, where = np.unique(both, return_inverse=True)
                    reps.append(rep[ids])
                    links.append(np.bincount(where, copies[np.r_[j, i]], len(ids)).astype(np.int64))
                    others += [None] * len(ids)
                    chain = _chains(i, j)
                    reps.append(rep[[a for a, _ in chain]])
                    links.append(np.zeros(len(chain), np.int64))
                    others += [int(rep[b]) for _, b in chain]
            yield pa.RecordBatch.from_pydict({"rep": pa.array(np.concatenate(reps)), "links": pa.array(np.concatenate(links)), "other": pa.array(others, pa.int64())})

    return run


def _near(x: np.ndarray, part: np.ndarray, one: int, two: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine of at least COSINE: within part ``one`` if ``two`` is the same, else across."""
    left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
    near = x[left] @ x[right].T >= COSINE
    i, j = np.nonzero(np.triu(near, 1) if one == two else near)
    return left[i], right[j]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Equal vectors collapse to one with a count first. Unit vectors are projected on seeded normal
    directions and quantised (28 tables of 5 projections, quantum 1: a pair of cosine 0.95 shares a
    bucket with probability ``recall()`` = 0.999, nearer pairs more surely); members of a bucket are compared
    exactly. A pair counts in the first table that has it, and only counts and the edges of spanning
    forests leave a task, never all pairs. A bucket of more than ``LARGE`` vectors is split into parts
    and each pair of parts is a task of its own: all pairs are compared, whatever its size. For larger
    corpora ``WIDTH`` should grow with the logarithm of their size.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    neither do vectors of different lengths. Repeated rows (and equal vectors) link to each other and
    count each; an id stands for one vector. Other columns don't matter; an empty table gives an empty one.
    """
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{element}>").alias("v"))
    every = store(rows.mapInArrow(_valid(kind), "vec_id long, raw binary"), "every")
    valid = every.where("raw is not null")
    kinds = store(valid.groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    own = kinds.select("rep", "raw", "copies")
    keys = own.mapInArrow(_deal(kind, False), "tab int, key long")
    sizes = store(keys.groupBy("tab", "key").agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / LARGE).cast("int")), "buckets")
    dealt = own.mapInArrow(_deal(kind, True), "tab int, key long, rep long, raw binary, copies long")
    part = F.pmod(F.xxhash64("rep", "raw"), F.col("parts")).cast("int")
    tiles = dealt.join(sizes, ["tab", "key"]).withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("tab", "key", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("two"), F.struct("rep", "raw", "copies", "part").alias("m"))
    lists = tiles.groupBy("tab", "key", "one", "two").agg(F.collect_list("m").alias("members")).select("tab", "one", "two", "members")
    found = store(lists.where(F.size("members") > 1).mapInArrow(_compare(kind), "rep long, links long, other long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    named = kinds.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = store(named.select("raw", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    linked = valid.join(named, "raw").select("vec_id", "n_links", "component_id")
    rest = every.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
