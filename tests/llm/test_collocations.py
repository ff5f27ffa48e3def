from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tickloom.llm import collocations
from tickloom.llm.common import HashFilter

ODD = [
    (1, "A b, a B! a b a b", "en"), (2, "a b a b a b a b", "en"), (3, "a b\ta b", "en"), (4, None, "en"), (5, "", None), (6, "c d c d. c d", None),
    (7, "é ñ é ñ", "fr"), (8, "a b a b a b a b", "en"), (9, "a b a b a b a b", "fr"), (10, "x" * 3000 + " y " + "x" * 3000 + " y", "de"), (11, " ,;\n. ", "en"),
    (12, "no break no break no break", "en"), (13, "c d c d c d c d c d c d" * 5, None), (None, "a b a b", "en"), (14, "É a É A É a", "en"),
]


def plainly(rows, least, longest, top):
    """Every phrase of every piece in a dictionary."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for c in ".,;:!?\n\x0b\x0c\r":
            text = (text or "").replace(c, "\n")
        for piece in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        within = {q[i : i + k] for q, a in often.items() for k in range(1, len(q)) for i in range(len(q) - k + 1) if counts[q[i : i + k]] == a}
        found = []
        for p, a in often.items():
            if p not in within:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, 1, "h") for i, t, lang in ODD], "doc_id long, text string, lang string, n long, h string").repartition(3)


@pytest.mark.parametrize("least, longest, top, shards", [(2, 5, 100, 4), (3, 4, 3, 16), (1, 2, 100, 1)])
def test_equals_plain_counting(odd, least, longest, top, shards):
    got = collocations.collocations(odd, least=least, longest=longest, top=top, shards=shards)
    assert rows_of(got) == plainly([(t, lang) for _, t, lang in ODD], least, longest, top)


def test_whole_documents(documents):
    rows = [(r.text, r.lang) for r in documents.collect()]
    whole = rows_of(collocations.collocations(documents, least=20))
    assert whole == plainly(rows, 20, 5, 2000)


def test_slices_keep_words_whole(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 7)
    for text in (b"aa bb,cc dd ee", b"abcdefghijklm no", b"abcdefghijklmnop", b"a.bcdefgh.ij", b"", b" , "):
        chunk, whole = collocations.Chunk(), text.translate(collocations._FOLD)
        chunk.add("x", text)
        words = [w for w in whole.replace(b"\xff", b" \xff ").split()] + [b"\xff"]
        assert [chunk.words[i][1] if i >= 0 else b"\xff" for i in chunk.row()] == words


def test_chunks_of_few_words(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 5, "text": [b"a b c", b"", b"a b", b"d", b"a b c d e f"]})
    monkeypatch.setattr(collocations, "CHUNK", 4)
    parts = list(collocations.chunks([batch, batch]))
    assert len(parts) > 3 and sum(int((c.row() >= 0).sum()) for c in parts) == 24


def test_hashes_are_those_of_spark(spark):
    chunk = collocations.Chunk()
    chunk.add("fr", "été x".encode())
    want = [r.h for r in spark.createDataFrame([("fr", "été"), ("fr", "x")], "l string, w string").select(F.xxhash64("l", "w").alias("h")).collect()]
    assert chunk.hashes().view(np.int64).tolist() == want


def test_filter_forgets_none(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    held = HashFilter.of(hashes)
    own = np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)
    other = np.array([r.h for r in spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id").alias("h")).collect()], np.int64).view(np.uint64)
    assert held.has(own).all() and held.has(other).mean() < 0.1
    assert not HashFilter.of(hashes.limit(0)).has(own).any()


def test_large_counts_do_not_overflow(spark):
    q = "(1000 * cast(a as decimal(19, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    a, n, left, right = 10**10 + 7, 9 * 10**12 + 1, 3 * 10**10 + 1, 2 * 10**10 + 3
    assert spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").selectExpr(q).first()[0] == 1000 * a * n // (left * right)


def test_empty_and_blank_tables(spark, no_docs, odd):
    assert collocations.collocations(no_docs).collect() == []
    assert collocations.collocations(odd.where("text is null")).collect() == []
    assert collocations.collocations(odd).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("most, copies", [(1 << 18, 1), (1, 3)])
def test_a_task_adds_up_its_chunks(spark, monkeypatch, most, copies):
    """Three chunks with the same phrases give each phrase once, not once a chunk; only a task that holds too many gives it again."""
    monkeypatch.setattr(collocations, "CHUNK", 4)
    monkeypatch.setattr(collocations, "HELD", most)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "text": [b"a b c d"] * 3})
    chunk = collocations.Chunk()
    chunk.add("en", b"a b c d")
    words = chunk.hashes()
    h = [words, *(h for _, _, h in collocations.phrases(chunk.row(), words, HashFilter(np.full(1 << 10, -1, np.int64).view(np.uint64)), 1, 2))]
    known = HashFilter.of(spark.createDataFrame([(int(x),) for x in np.concatenate(h).view(np.int64)], "h long"))
    count = collocations._count_phrases(type("Known", (), {"value": known}), 2)
    rows = [(r["lang"], r["phrase"], r["n"]) for out in count([batch]) for r in out.to_pylist()]
    assert sorted(rows) == sorted([("en", p, 3 // copies) for p in (b"a b", b"b c", b"c d")] * copies)
