"""Context-triggered piecewise hashes of documents and their likeness (operator 10)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import store, utf8

WINDOW = 7  # bytes that decide whether a chunk ends
LEAST_BLOCK = 3  # expected bytes of a chunk, the smallest
CHUNKS = 64  # chunks that a signature has room for at its block size
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_PAIRS = [a + b for a in SYMBOLS for b in SYMBOLS]  # 12 bits a chunk


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the window that ends at each byte."""
    with np.errstate(over="ignore"):
        h, x = np.zeros(len(data), np.uint32), data.astype(np.uint32) + np.uint32(1)
        for i in range(min(WINDOW, len(data))):
            h[i:] += x[: len(data) - i] * np.uint32(pow(0x01000193, i + 1, 1 << 32))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        return h ^ (h >> np.uint32(13))


def _signature(h: np.ndarray, block: int) -> str:
    """Two letters per chunk; a chunk ends where the window's hash is block - 1 modulo block."""
    ends = np.flatnonzero(h % np.uint32(block) == block - 1) + 1
    starts = np.r_[0, ends[ends < len(h)]]
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(h * (h >> np.uint32(7) | np.uint32(1)), starts, dtype=np.uint32) * np.uint32(0x9E3779B1)
    return "".join([_PAIRS[i] for i in (sums >> np.uint32(20)).tolist()])


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block``; the block is the smallest 3 * 2**k with room for
    the whole text in 64 chunks, halved while fewer than 32 come out. No bytes: ``3::``."""
    if not data:
        return f"{LEAST_BLOCK}::"
    h, block = _rolling(np.frombuffer(data, np.uint8)), LEAST_BLOCK
    while block * CHUNKS < len(data):
        block *= 2
    fine = _signature(h, block)
    coarse = None
    while len(fine) < CHUNKS and block > LEAST_BLOCK:
        block //= 2
        fine, coarse = _signature(h, block), fine
    return f"{block}:{fine}:{_signature(h, 2 * block) if coarse is None else coarse}"


def _symbols(signature: str) -> list[str]:
    return [signature[i : i + 2] for i in range(0, len(signature), 2)]


def _edits(a: list[str], b: list[str]) -> int:
    """Insertions and deletions that turn ``a`` into ``b``: by the longest common subsequence, in bits."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        if (m := where.get(x)) is not None:
            u = row & m
            row = (row + u | row - u) & full
    common = len(a) - row.bit_count()
    return len(a) + len(b) - 2 * common


def likeness(one: str, two: str) -> float:
    """From 0 to 1: 1 for equal fingerprints; else 1 - edits / symbols at a block size that both have (the
    better of two), and 0 without such a size."""
    if one == two:
        return 1.0
    best = 0.0
    (m, *a), (n, *b) = one.split(":"), two.split(":")
    for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
        if int(m) << x == int(n) << y:
            s, t = _symbols(a[x]), _symbols(b[y])
            if s and t and not set(s).isdisjoint(t):
                best = max(best, 1 - _edits(s, t) / (len(s) + len(t)))
    return best


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) gives way to as many first ones of ``following``."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _compared(one: tuple, following: str, next_fp: str) -> tuple:
    doc, text, data, fp = one
    other = utf8(edited(text, following))
    own = fp if other == data else fingerprint(other)
    return doc, len(text), hashlib.sha256(other).hexdigest(), fp, own, likeness(fp, own), likeness(fp, next_fp)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
OUT = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint`` of every whole text (null: empty); no shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fingerprint": pa.array([fingerprint(utf8(t)) for t in batch.column(1).to_pylist()], pa.string())})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def edit_resistance(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document beside its edited form and the next document, in ascending ``doc_id``; after the last comes the first.

    Texts are shuffled once, to sorted ranges of ``doc_id``; each task streams its rows with one
    neighbour in memory. A range's first text and last document are kept beside the results, and a
    join by range number brings the last document of each range to the first text of the next one.

    Null texts are empty. Null ids come first; equal ids (repeated rows) are ordered by text. A
    single document is its own next. Other columns don't matter; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    names, kinds = ["kind", "range", *OUT, "text"], [pa.string(), pa.int64(), *_KINDS, pa.string()]

    def run(batches):
        number, last = TaskContext.get().partitionId(), None
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            out = []
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = utf8(own)
                fp = fingerprint(data)
                if last is None:
                    out.append(("first", number, doc, None, None, fp, None, None, None, own))
                else:
                    out.append(("whole", number, *_compared(last, own, fp), None))
                last = (doc, own, data, fp)
            if out:
                yield made(out)
        if last is not None:
            yield made([("last", number, last[0], None, None, last[3], None, None, None, last[1])])

    schema = f"kind string, range long, {SCHEMA}, text string"
    found = store(rows.repartitionByRange("k").sortWithinPartitions("k", "text").select("doc_id", "text").mapInArrow(run, schema), "piecewise")
    ranges = found.where("kind = 'first'").select("range")  # a row for each range that has rows
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ranges.select("range", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.first("range").over(every)).alias("next"))
    firsts = found.where("kind = 'first'").select(F.col("range").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("next_fp"))
    ends = found.where("kind = 'last'").select("range", "doc_id", "text", "fingerprint")
    ends = ends.join(after, "range").join(firsts, "next").select("doc_id", "text", "fingerprint", "following", "next_fp")

    def close(batches):
        for batch in batches:
            rows = [_compared((doc, own, utf8(own), fp), following, next_fp) for doc, own, fp, following, next_fp in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], OUT)

    return found.where("kind = 'whole'").select(*OUT).union(ends.mapInArrow(close, SCHEMA))
