"""Operators 4 and 6: learning, held-out accuracy and odd input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import language_id, ordinal_quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def languages(more):
    return language_id.fit(more)


def test_held_out_language(more, languages):
    got = {r.doc_id: r for r in language_id.identify(more, languages).collect()}
    rows = more.collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert (languages.weights == 0).mean() > 0.3  # sparse


def test_only_the_text_decides(more, languages):
    some = more.limit(50)
    odd = some.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "doc_id": F.col("doc_id") + 10_000_000})
    a = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(some, languages).collect()}
    b = {r.doc_id - 10_000_000: (r.lang_pred, r.score) for r in language_id.identify(odd, languages).collect()}
    assert a == b


def test_held_out_rows_teach_nothing(more):
    lie = more.withColumn("lang", F.when(language_id.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in language_id.fit(lie).languages


def test_language_of_odd_rows(odd_docs, no_docs, languages):
    got = language_id.identify(odd_docs, languages).collect()
    assert len(got) == odd_docs.count()
    blank = [r for r in got if r.doc_id in (0, 1, 2, 3)]
    assert {(r.lang_pred, r.score) for r in blank} == {("und", 0.0)}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 4}) == 1
    assert language_id.identify(no_docs).collect() == []
    nothing = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(nothing).collect()} == {("und", 0.0)}
    assert len(language_id.identify(odd_docs).collect()) == odd_docs.count()
    kept = language_id.keep_identified(odd_docs, 0.0, languages)
    assert kept.columns == odd_docs.columns and not {r.doc_id for r in kept.collect()} & {0, 1, 2, 3}


def test_grams_against_plain_counting():
    for text in ("Ab c", "", "12", "été!! x", "a" * 50):
        clean = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in clean:
            clean = clean.replace("  ", " ")
        if clean == " ":
            clean = "  "
        assert len(language_id.grams(text)) <= sum(max(0, len(clean) - n + 1) for n in (1, 2, 3)) + 3
    assert (language_id.grams("Straße 1") == language_id.grams("straße --")).all()


def test_temperature_and_sparsity():
    rng = np.random.default_rng(0)
    logits = rng.standard_normal((4000, 3)) * 3
    p = language_id._softmax(logits)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(language_id._temperature(logits * 5, y) - 5) < 0.6
    rows = [(np.array([i % 2, 5 + i % 7]), np.array([1.0, 0.01])) for i in range(400)]
    w, _ = language_id.fit_ftrl(rows, np.arange(400) % 2, 2, 20)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and (w[12:] == 0).all()


@pytest.fixture(scope="module")
def ratings(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return labels.select("doc_id", ordinal_quality.grade(F.col("toxic"), F.col("quality")).alias("grade"))


def test_quality_on_held_out_ratings(more, ratings):
    learn, hold = ratings.where("doc_id % 4 <> 0"), ratings.where("doc_id % 4 = 0")
    got = {r.doc_id: r for r in ordinal_quality.rate(more, learn).collect()}
    assert len(got) == more.count()
    by = {0: [], 1: [], 2: []}
    for r in hold.collect():
        by[r.grade].append(got[r.doc_id])
    assert np.mean([r.kept for r in by[2]]) > 0.95
    assert np.mean([r.kept for r in by[0]]) < 0.35
    assert np.mean([r.kept for r in by[1]]) < 0.3
    means = [np.mean([r.expected_grade for r in by[g]]) for g in (0, 1, 2)]
    assert means == sorted(means)
    assert all(0 <= r.tail_good <= r.tail_safe <= 1 and abs(r.expected_grade - r.tail_good - r.tail_safe) < 1e-9 for r in got.values())


def test_quality_of_odd_rows(odd_docs, no_docs, ratings, spark):
    model = ordinal_quality.Model({}, np.array([-0.5, 0.5]))
    got = ordinal_quality.rate(odd_docs, ratings, model).collect()
    assert len(got) == odd_docs.count() and len({r.tail_good for r in got}) == 1
    assert ordinal_quality.rate(no_docs, ratings).collect() == []
    none = ratings.limit(0)
    assert ordinal_quality.rate(odd_docs, none).count() == odd_docs.count()
    odd = spark.createDataFrame([(4, 0), (4, 2), (None, 1), (5, None), (8, 2), (999, 1), (6, 1)], "doc_id long, grade int")
    rated = ordinal_quality.rate(odd_docs, odd).collect()
    assert len(rated) == odd_docs.count() and all(0 <= r.tail_good <= r.tail_safe <= 1 for r in rated)
    kept = ordinal_quality.keep_good(odd_docs, odd)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in rated)


def test_cuts_stay_in_order_and_learn_an_order():
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 3, 900)
    rows = [np.array(sorted({100 + g, 50 + int(rng.integers(0, 20))})) for g in grades]
    weights, cuts = ordinal_quality.fit_cumulative(rows, grades, np.ones(900), 3)
    assert cuts[0] < cuts[1] and weights[100] < weights.get(101, 0) < weights[102]
    assert all(abs(weights.get(50 + i, 0)) < 0.5 for i in range(20))


def test_grade_of_ratings(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 0), (None, 1), (0, None)], "toxic int, quality int")
    assert [r[0] for r in df.select(ordinal_quality.grade(F.col("toxic"), F.col("quality"))).collect()] == [2, 1, 0, 0, None, None]
