import pytest

SF = "/root/testdata/sf0.001"
CLASH = "fp long, row long, key string, component string, label string, rank int, at double, first string, sequence_id long, grade int"
CLASHING = (7, 7, "x", "y", "z", 1, 0.5, "f", 3, 2)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, markless, repeated, tied and very long texts, and odd characters."""
    copy = "the quick brown fox jumps over the lazy dog and runs far away from here"
    return [
        (0, None), (1, ""), (2, "  \n\t "), (3, "12345 !!! ###"), (4, copy), (4, copy), (5, copy), (6, copy.upper()), (7, copy + " today"),
        (8, "word " * 20_000), (9, "x" * 30_000), (10, "été ñandú straße İ ﬁ ½ 日本語 \x00 ​ é"), (11, "a  b\n\n c\t<|endoftext|> it's I'LL"), (None, "a text without an id"), (None, None), (13, "short"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 5 else "s", None, *CLASHING) for i, t in odd_texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
