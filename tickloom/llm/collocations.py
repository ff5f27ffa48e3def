"""Phrase collocations by partitioned mining (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import HashFilter, store

LEAST, LONGEST, TOP = 100, 5, 2000  # occurrences of a candidate, its words, phrases reported per language
SHARDS = 4  # parts of the corpus that are mined by themselves; they are no tasks, so few do: the local support stays high
CHUNK = 1 << 21  # words that are counted at once in a task
HELD = 1 << 18  # counted phrases from which on a task hands its counts on
SLICE = 1 << 20  # bytes of a text that are split at once
SALTS = 16  # parts of a word that begins or ends very many phrases

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_END = b"\xff"  # no byte of UTF-8: the end of a piece
_FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t" + _UPPER, _END * 10 + b" " + _LOWER)


class _Numbers(dict):
    """Word to number; the numbers of all languages of a chunk are one series."""

    def __init__(self, lang: str, words: list):
        super().__init__({_END: -1})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append((self.lang, word))
        return number


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > SLICE:
        end = max(text.rfind(b" ", at, at + SLICE), text.rfind(_END, at, at + SLICE) + 1)
        if end <= at:  # a word longer than a slice
            ends = [i for i in (text.find(b" ", at + SLICE), text.find(_END, at + SLICE)) if i >= 0]
            end = min(ends, default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


class Chunk:
    """Numbered words of whole texts; -1 ends a piece."""

    def __init__(self):
        self.words, self.numbers, self.parts, self.size = [], {}, [], 0

    def add(self, lang: str, text: bytes) -> None:
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = _Numbers(lang, self.words)
        for part in _slices(text.translate(_FOLD)):
            words = part.replace(_END, b" \xff ").split()
            self.parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
        self.parts.append(np.full(1, -1, np.int32))
        self.size += 1

    def row(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def hashes(self) -> np.ndarray:
        """Spark's ``xxhash64(lang, word)`` of every numbered word."""
        seeds = {lang: xxhash.xxh64_intdigest(lang.encode(), 42) for lang in self.numbers}
        return np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for lang, w in self.words), np.uint64, len(self.words))


def chunks(batches) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            chunk.add(lang, text.as_py())
            if chunk.size >= CHUNK:
                yield chunk
                chunk = Chunk()
    if chunk.size:
        yield chunk


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h * np.uint64(0x9E3779B97F4A7C15) ^ word
        return h ^ h >> np.uint64(29)


def phrases(row: np.ndarray, hashes: np.ndarray, known: HashFilter, filtered: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, starts, hashes)`` of the phrases whose words are all known and, up to the length ``filtered``, that are known themselves.

    A phrase is formed only where both phrases of one word less were, so a longer one costs nothing
    where a part of it is rare.
    """
    at = np.zeros(len(row) + 1, bool)
    own = np.zeros(len(row), np.uint64)
    starts = np.flatnonzero(row >= 0)
    starts = starts[known.has(hashes)[row[starts]]] if len(hashes) else starts
    own[starts] = hashes[row[starts]] if len(hashes) else 0
    h = own.copy()
    for length in range(2, longest + 1):
        at[:] = False
        at[starts] = True
        starts = starts[at[starts + 1]]
        h[starts] = _joined(h[starts], own[starts + length - 1])
        if length <= filtered:
            starts = starts[known.has(h[starts])]
        yield length, starts, h[starts]


def _count_words(batches):
    for chunk in chunks(batches):
        row = chunk.row()
        counts = np.bincount(row[row >= 0], minlength=len(chunk.words))
        langs, words = zip(*chunk.words, strict=True) if chunk.words else ((), ())
        yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.binary()), "n": pa.array(counts, pa.int64())})


def _mine(known: HashFilter, filtered: int, lengths: range, shards: int):
    """Counts of the phrases of ``lengths`` in each chunk, under the shard that the chunk is dealt to."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, chunk in enumerate(chunks(batches)):
            found = [np.zeros(0, np.uint64)]
            for length, _, h in phrases(chunk.row(), chunk.hashes(), known.value, filtered, lengths[-1]):
                if length in lengths:
                    found.append(h)
            h, n = np.unique(np.concatenate(found), return_counts=True)
            shard = xxhash.xxh32_intdigest(f"{part} {number}") % shards
            yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(h), shard, np.int32)), "h": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64())})

    return run


def _count_phrases(known: HashFilter, longest: int):
    """Exact counts of the known phrases: phrases are told apart by the numbers of their words, not by hash.

    A task adds up its chunks, so it gives a phrase once, or once more whenever it holds ``HELD`` of them.
    """

    def rows(held):
        langs, shown, counts = zip(*((lang, p, n) for lang, own in held.items() for p, n in own.items()), strict=True) if any(held.values()) else ((), (), ())
        return pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "phrase": pa.array(shown, pa.binary()), "n": pa.array(counts, pa.int64())})

    def run(batches):
        held = {}
        for chunk in chunks(batches):
            row = chunk.row()
            series, width = row.astype(np.int64), len(chunk.words) + 1
            for length, starts, _ in phrases(row, chunk.hashes(), known.value, longest, longest):
                pairs = series[starts] * width + row[starts + length - 1]
                _, first, inverse, n = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
                series[starts] = inverse
                for s, more in zip(starts[first].tolist(), n.tolist(), strict=True):
                    own = held.setdefault(chunk.words[row[s]][0], {})
                    phrase = b" ".join(chunk.words[i][1] for i in row[s : s + length])
                    own[phrase] = own.get(phrase, 0) + more
            if sum(map(len, held.values())) >= HELD:
                yield rows(held)
                held = {}
        yield rows(held)

    return run


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``lang, n`` (all words), ``lang, phrase, a`` of the frequent words, and of the frequent phrases of 2 to ``longest`` words.

    Partitioned mining in two passes. The corpus is dealt to ``shards`` parts by whole chunks of
    some two million words. Every part is mined completely at the local support ``least / shards``
    (rounded up): a phrase that occurs ``least`` times in all reaches that in one part at least,
    however unequal the parts are. The locally frequent phrases of all parts together are the
    candidates, and a last pass counts every candidate exactly over the whole corpus.

    The number of parts is fixed, so the local support does not sink to one as a corpus grows. A part
    is therefore no task: its chunks are counted by many, and Spark adds them up by (part,
    hash). Words are counted first, then pairs of frequent words, then longer phrases
    whose pairs are all candidates. Candidates reach the tasks as a bit field of bounded size; what it
    lets through by mistake is counted exactly and drops out.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", F.col("word").cast("string").alias("phrase")).agg(F.sum("n").alias("a"))
    sizes_and_words = store(counted.groupBy("lang", F.when(F.col("a") >= least, F.col("phrase")).alias("phrase")).agg(F.sum("a").alias("a")), "words")
    sizes = sizes_and_words.groupBy("lang").agg(F.sum("a").alias("n"))
    words = sizes_and_words.where("phrase is not null")

    local = -(-least // shards)

    def candidates(known: HashFilter, filtered: int, lengths: range) -> DataFrame:
        mined = texts.mapInArrow(_mine(spark.sparkContext.broadcast(known), filtered, lengths, shards), "shard int, h long, n long")
        return store(mined.groupBy("shard", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= local).select("h").distinct(), "candidates")

    known = store(words.select(F.xxhash64("lang", "phrase").alias("h")), "known")
    known = known.union(candidates(HashFilter.of(known), 1, range(2, 3)))
    if longest > 2:
        known = known.union(candidates(HashFilter.of(known), 2, range(3, longest + 1)))
    count = _count_phrases(spark.sparkContext.broadcast(HashFilter.of(known)), longest)
    found = texts.mapInArrow(count, "lang string, phrase binary, n long").groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("a"))
    return sizes, words, store(found.where(F.col("a") >= least), "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by the score of their weakest cut.

    Counts are those of ``frequent_phrases``. A phrase cut into two parts has the score
    ``floor(1000 * a * n / (l * r))``; its lowest counts (ties: the earliest cut). Phrases that occur
    only inside a longer one (as often) go: it is enough to look at longer ones by one word, as counts
    only fall with length. Arithmetic is in decimals of 38 digits.

    A null ``lang`` is ``und``; a null, empty or blank text has no phrases, repeated rows count each
    time, other columns don't matter, an empty table gives an empty table. A very long
    text is split by slices, a word may have any length.
    """
    sizes, words, found = frequent_phrases(docs, text, lang, least, longest, shards)
    ws = F.split("phrase", " ")
    found = found.withColumn("ws", ws)

    def span(first, length):
        return F.array_join(F.slice("ws", first, length), " ")

    shorter = found.where(F.size("ws") > 2).select("lang", "a", F.explode(F.array(span(F.lit(1), F.size("ws") - 1), span(F.lit(2), F.size("ws") - 1))).alias("phrase"))
    inside = shorter.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = store(found.join(inside, ["lang", "phrase"], "left").where("most is null or most < a").select("lang", "phrase", "a", "ws"), "kept")

    cut = kept.select("lang", "phrase", "a", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("first"), span(F.col("k") + 1, F.size("ws") - F.col("k")).alias("rest"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    salted = words.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    parts = salted.union(found.select("lang", "phrase", "a", F.lit(0).alias("salt")))

    def counts(part: str, count: str) -> DataFrame:
        return parts.select("lang", F.col("phrase").alias(part), F.col("a").alias(count), F.col("salt").alias(f"{part}_salt"))

    for part, count in (("first", "l"), ("rest", "r")):
        cut = cut.withColumn(f"{part}_salt", F.when(F.instr(part, " ") == 0, salt).otherwise(0)).join(counts(part, count), ["lang", part, f"{part}_salt"])
    whole = cut.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang")
    scored = whole.withColumn("score", F.expr("(1000 * cast(a as decimal(19, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.*")
    ordered = weakest.select("lang", "phrase", "a", "l", "r", "n", "score")
    rank = F.expr("row_number() over (partition by lang, salt order by score desc, a desc, phrase)")
    some = ordered.withColumn("salt", salt).withColumn("rank", rank).where(F.col("rank") <= top).drop("rank", "salt")
    ranked = some.withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)"))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
