"""Quality by ordinal cumulative-link regression on graded ratings (operator 4)."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import store

BITS = 20  # hashed features
GRADES = ("toxic", "poor", "good")
PER_GRADE = 6000  # rated documents of a grade that the fit takes, about; all if there are fewer
SUPPORT, SIGNS = 8, 5.0  # rated documents with a feature and standard deviations from chance that it needs to get a weight
PREFIX = 5
EPOCHS, RATE, L1, L2 = 12, 0.15, 2e-4, 1e-5
LEAST_TAIL = 0.5  # probability of the top grade from which on a document is kept
MEMO = 200_000  # tokens whose features a Python worker keeps
MARKS = ".,;:!?\"'()[]{}<>#$%&*|-_=+/\\~^`@"


def _hashed(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass"), 1) >> (32 - BITS)


def token_features(token: str) -> tuple[int, ...]:
    """A token's word without the marks around it, a longer word's beginning, and the marks after it where they
    are more than one sign."""
    word = token.strip(MARKS)
    marks = token[len(token.rstrip(MARKS)) :]
    found = ([_hashed("w " + word)] if word else []) + ([_hashed("m " + marks)] if len(marks) > 1 or not word else [])
    if len(word) > PREFIX:
        found.append(_hashed("p " + word[:PREFIX]))
    return tuple(found)


def shape_features(tokens: list[str], distinct: int) -> list[int]:
    """How much the text repeats itself and how much of it is words, in tenths; and whether it is empty."""
    n = len(tokens)
    if not n:
        return [_hashed("empty")]
    again = sum(map(str.__eq__, tokens, tokens[1:]))
    return [_hashed(f"distinct {10 * distinct // n if n >= 20 else 'few'}"), _hashed(f"again {-(-10 * again // n)}")]


def grade(toxic, quality):
    """0: toxic, 1: poor, 2: good; null unless both ratings are there."""
    both = toxic.isNotNull() & quality.isNotNull()
    return F.when(both, F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2))


@dataclass
class Model:
    """P(grade > k) = sigmoid(w x - cut[k]): one weight vector, ascending cuts."""

    weights: dict[int, float]
    cuts: np.ndarray
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "cuts": self.cuts, "memo": {}}

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade > 0), P(grade > 1), ...; a null text counts as empty."""
        tokens = (text or "").lower().split()
        distinct, memo = set(tokens), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for t in distinct.difference(memo):
            memo[t] = tuple(f for f in token_features(t) if f in self.weights)
        found = set(chain.from_iterable(map(memo.__getitem__, distinct)))
        found.update(f for f in shape_features(tokens, len(distinct)) if f in self.weights)
        z = sum(map(self.weights.__getitem__, sorted(found)))
        return 1 / (1 + np.exp(np.clip(self.cuts - z, -500, 500)))


def features(text: str | None) -> np.ndarray:
    tokens = (text or "").lower().split()
    distinct = set(tokens)
    found = set(chain.from_iterable(map(token_features, distinct)))
    return np.array(sorted(found.union(shape_features(tokens, len(distinct)))), np.int32)


def telling(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, many: int) -> np.ndarray:
    """Features in ``SUPPORT`` rated documents whose share at or below some grade differs from the whole by ``SIGNS`` deviations."""
    if not rows:
        return np.zeros(0, np.int64)
    at, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), list(map(len, rows)))
    have = np.bincount(at, minlength=1 << BITS)
    told = np.zeros(1 << BITS, bool)
    for k in range(many - 1):
        low = (grades <= k).astype(float)
        share = low.mean()
        found = np.bincount(at, low[of], 1 << BITS)
        told |= np.abs(found - have * share) > SIGNS * np.sqrt(have * share * (1 - share)) + 0.5
    return np.flatnonzero(told & (have >= SUPPORT))


def fit_cumulative(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, many: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[dict[int, float], np.ndarray]:
    """Weights and cuts by adaptive proximal gradient steps on the cumulative-link log loss.

    The cuts are one free number and the logarithms of the gaps above it, so they stay in order.
    ``weight`` is what a row stands for, so that probabilities follow all ratings and not the sample.
    """
    known = telling(rows, grades, weight, many)
    column = np.full(1 << BITS, -1)
    column[known] = np.arange(len(known))
    rows = [column[r][column[r] >= 0] for r in rows]
    w, h = np.zeros(len(known)), np.full(len(known), 1e-6)
    base, gaps, hc = -1.0, np.zeros(many - 2), np.full(many - 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, y = rows[i], grades[i]
            cuts = base + np.r_[0.0, np.cumsum(np.exp(gaps))]
            s = 1 / (1 + np.exp(np.clip(cuts - w[x].sum(), -500, 500)))  # P(grade > k)
            over, under = (s[y - 1] if y else 1.0), (s[y] if y < many - 1 else 0.0)
            p = max(over - under, 1e-12)
            slope = s * (1 - s)
            g = np.zeros(many - 1)  # of the loss by each cut
            if y:
                g[y - 1] += slope[y - 1] / p
            if y < many - 1:
                g[y] -= slope[y] / p
            g *= weight[i]
            gz = np.clip(-g.sum(), -5, 5)
            if len(x):
                step = gz + L2 * w[x]
                h[x] += step * step
                rate = RATE / np.sqrt(h[x])
                new = w[x] - rate * step
                w[x] = np.sign(new) * np.maximum(np.abs(new) - rate * L1, 0)
            gc = np.r_[g.sum(), [g[k + 1 :].sum() * np.exp(gaps[k]) for k in range(many - 2)]]
            gc = np.clip(gc, -5, 5)
            hc += gc * gc
            move = RATE * gc / np.sqrt(hc)
            base, gaps = base - move[0], np.clip(gaps - move[1:], -5, 3)
    some = np.flatnonzero(w)
    return dict(zip(known[some].tolist(), w[some].tolist(), strict=True)), base + np.r_[0.0, np.cumsum(np.exp(gaps))]


def fit(docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE) -> Model:
    """Learn from ``docs`` (``doc_id, text``) with ``ratings`` (``doc_id, grade``).

    A hashed sample of about ``per_grade`` ratings of each grade (all where there are fewer) is sent to the scan of
    the texts; the fit runs in one task on sparse features, and the driver sees the model alone. Without two
    grades every text gets the same probabilities.
    """
    ratings = ratings.where("doc_id is not null and grade is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    tally = dict(ratings.groupBy("grade").count().collect())  # a row per grade
    if len(tally) < 2:
        return Model({}, np.linspace(-0.5, 0.5, len(GRADES) - 1))
    share = F.create_map(*[x for g, n in tally.items() for x in (F.lit(g), F.lit(min(1.0, per_grade / n)))])
    place = F.xxhash64(F.lit(11), "doc_id") / F.lit(2.0**64) + 0.5
    sample = ratings.withColumn("place", place).where(F.col("place") < F.element_at(share, F.col("grade")))
    sample = F.broadcast(sample.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("place").alias("place")))  # per_grade rows a grade
    rated = docs.join(sample, "doc_id").select("grade", "place", "text")

    def describe(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))], ["grade", "place", "features"])

    rows = store(rated.mapInArrow(describe, "grade int, place double, features array<int>"), "rated")

    def train(batches):
        found = [(p, g, f.values.to_numpy()) for b in batches for g, p, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)]
        found.sort(key=lambda r: (r[0], r[1], len(r[2])))
        grades = np.array([r[1] for r in found], np.int64)
        weight = np.array([max(1.0, tally.get(g, 0) / per_grade) for g in range(len(GRADES))])[grades]
        weights, cuts = fit_cumulative([r[2] for r in found], grades, weight / weight.mean(), len(GRADES))
        yield pa.RecordBatch.from_pydict({"feature": pa.array([[*weights, *([-1] * len(cuts))]], pa.list_(pa.int32())), "weight": pa.array([[*weights.values(), *cuts]], pa.list_(pa.float64()))})

    got = rows.repartition(1).mapInArrow(train, "feature array<int>, weight array<double>").first()
    many = len(GRADES) - 1
    return Model(dict(zip(got[0][:-many], got[1][:-many], strict=True)), np.array(got[1][-many:]))


def rate(docs: DataFrame, ratings: DataFrame, model: Model | None = None, least_tail: float = LEAST_TAIL) -> DataFrame:
    """``doc_id, expected_grade, tail_safe, tail_good, kept`` of every whole text; texts are not shuffled.

    ``tail_safe`` is the probability of a grade over toxic and ``tail_good`` that of the top one; the expected grade is
    their sum, and documents with ``tail_good >= least_tail`` are kept. Null and empty texts are rated like any
    text without words. Ratings with nulls or without a document are not used; of repeated ratings of a
    document the lowest counts. Repeated rows come out repeated; other columns don't matter; an empty
    table gives an empty one.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = model or fit(cols, ratings)

    def run(batches):
        for batch in batches:
            tails = np.array([model.tails(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(GRADES) - 1)
            good = tails[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(good), pa.array(good >= least_tail)], ["doc_id", "expected_grade", "tail_safe", "tail_good", "kept"])

    return cols.mapInArrow(run, "doc_id long, expected_grade double, tail_safe double, tail_good double, kept boolean")


def keep_good(docs: DataFrame, ratings: DataFrame, least_tail: float = LEAST_TAIL, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns, that ``rate`` keeps."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = model or fit(cols, ratings)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.tails(t)[-1] >= least_tail for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
