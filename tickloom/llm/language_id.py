"""Language identification: sparse multinomial regression on TF-IDF character n-grams (operator 6)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import store

BITS = 16  # features: hashed n-grams of one to three characters
ORDERS = (1, 2, 3)
PER_CLASS = 3000  # documents of a language that the fit takes, about; all if there are fewer
TUNE = 5  # of these, one in so many is kept from the fit to set the temperature
EPOCHS, BATCH, STEPS = 4, 16, 1000  # passes over the sample, documents of a step, steps at least
ALPHA, BETA, L1, L2 = 2.0, 0.1, 1e-4, 1e-4
UNKNOWN = "und"
LEAST_SCORE = 0.5
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of the lower-cased text, a space around it; every run of other than letters is a space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters(codes), codes, 32)
    keep = np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)] if len(codes) else np.zeros(0, bool)
    codes = np.r_[np.uint32(32), codes[keep], np.uint32(32)].astype(np.uint32)
    out, h = [], np.zeros(len(codes), np.uint32)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(codes) < n:
                break
            h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * _MIX[n - 1]
            h ^= h >> np.uint32(15)
            out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out)


_TABLE: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0][codes]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature x language, times idf
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest learned language and its calibrated probability; ``und`` and 0 without a letter."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.weights.take(grams(text), axis=0).mean(0, dtype=np.float64) + self.bias
        p = _softmax(z[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _learnable(docs: DataFrame, lang: str) -> DataFrame:
    return docs.where(F.col(lang).isNotNull() & ~held_out() & F.col("text").isNotNull())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _document_counts(batches):
    """One row a task: in how many of its documents each feature is, and how many they are."""
    total, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen = np.zeros(1 << BITS, bool)
            seen[grams(text)] = True
            total += seen
            n += 1
    if n:
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.r_[some, -1].astype(np.int64)), "n": pa.array(np.r_[total[some], n])})


def _sample_features(batches):
    for batch in batches:
        rows = [np.unique(grams(t), return_counts=True) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([(r[1] / r[1].sum()).astype(np.float32) for r in rows], pa.list_(pa.float32())), batch.column(2)],
            ["lang", "features", "tf", "place"],
        )


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, many: int, size: int, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader with elastic net, in small batches.

    Per coordinate: z gathers gradients less their learning rate's share of the weight, n squared gradients;
    the weight is zero while |z| <= L1 and else -(z - sign(z) L1) / ((BETA + sqrt n) / ALPHA + L2).
    """
    z, n = np.zeros((size + 1, many)), np.zeros((size + 1, many))

    def weights(at):
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(max(epochs, -(-STEPS * BATCH // max(1, len(rows))))):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            at, inverse = np.unique(np.concatenate([rows[i][0] for i in some] + [[size]]), return_inverse=True)
            w = weights(at)
            g, done, bias = np.zeros_like(w), 0, len(at) - 1
            for i in some:
                x = rows[i][1]
                own = inverse[done : done + len(x)]
                done += len(x)
                p = _softmax((x @ w[own] + w[bias])[None])[0]
                p[classes[i]] -= 1
                g[own] += x[:, None] * p  # features of a document are distinct
                g[bias] += p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], w[size]


def _temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """Divisor of the logits with the least log loss, by golden section over its logarithm."""
    if not len(logits):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(classes)), classes], 1e-300)).mean()
    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, lang: str = "lang", per_class: int = PER_CLASS) -> Model:
    """Learn from ``text`` and ``lang`` of documents that aren't held out.

    Document frequencies count all of them, one row of counts a task, summed map-side. The regression takes a hashed
    sample of about ``per_class`` documents of each language (all where there are fewer) as sparse features; it
    is fitted in one task, so the driver sees the model alone. No learnable document gives a model without languages.
    """
    spark = docs.sparkSession
    own = _learnable(docs, lang)
    tally = own.groupBy(lang).count().collect()  # a row per language
    languages = sorted(r[0] for r in tally)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    counts = own.select("text").mapInArrow(_document_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df = np.zeros(1 << BITS)
    total = 0
    for feature, n in counts.collect():  # 2**BITS rows at most
        if feature < 0:
            total = n
        else:
            df[feature] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    share = F.create_map(*[x for r in tally for x in (F.lit(r[0]), F.lit(min(1.0, per_class / r[1])))])
    place = F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5
    sample = own.withColumn("place", place).where(F.col("place") < F.element_at(share, F.col(lang))).select(lang, "text", "place")
    features = store(sample.mapInArrow(_sample_features, "lang string, features array<int>, tf array<float>, place double"), "sample")

    def train(batches):
        rows, names, places = [], [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            places += batch.column(3).to_pylist()
            for f, t in zip(batch.column(1), batch.column(2), strict=True):
                at = f.values.to_numpy()
                rows.append((at, t.values.to_numpy() * idf[at]))
        order = np.lexsort((names, places))
        rows, names = [rows[i] for i in order], [names[i] for i in order]
        classes = np.array([languages.index(x) for x in names], np.int64)
        tune = np.arange(len(rows)) % TUNE == TUNE - 1
        w, bias = fit_ftrl([r for r, t in zip(rows, tune, strict=True) if not t], classes[~tune], len(languages), 1 << BITS)
        logits = np.array([r[1] @ w[r[0]] + bias for r, t in zip(rows, tune, strict=True) if t]).reshape(-1, len(languages))
        yield pa.RecordBatch.from_pydict({"model": pa.array([np.r_[_temperature(logits, classes[tune]), bias, w.ravel()].tobytes()], pa.binary())})

    packed = np.frombuffer(features.repartition(1).mapInArrow(train, "model binary").first()[0])
    k = len(languages)
    weights = (packed[1 + k :].reshape(-1, k) * idf[:, None]).astype(np.float32)
    return Model(languages, weights, packed[1 : 1 + k], float(packed[0]))


def identify(docs: DataFrame, model: Model | None = None, lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every whole text, by its own model unless one is given; no shuffle of texts.

    A null text and one without a letter are ``und`` with score 0, and so is everything where nothing could be
    learned. Null languages are not learned. Repeated rows come out repeated; other columns don't matter; an
    empty table gives an empty one.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    model = model or fit(cols)

    def run(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = cols.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is recognised with at least ``least_score``.

    Rejected are texts that are null or without a letter, and those that no learned language explains. Where nothing can be
    learned, every text with a letter stays.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = model or fit(plain)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([has_letter(t) and (not model.languages or model.predict(t)[1] >= least_score) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
