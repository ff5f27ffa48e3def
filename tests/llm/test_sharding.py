import zlib
from collections import Counter

import pytest

from tickloom.llm.sharding import interleave


@pytest.mark.parametrize("fixture,shards", [("odd_docs", 4), ("documents", 7), ("odd_docs", 40)])
def test_counts_slots_and_mixture(request, fixture, shards):
    docs = request.getfixturevalue(fixture)
    rows = docs.collect()
    got = interleave(docs, shards).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    counts = Counter(r.shard for r in got)
    every = [counts.get(s, 0) for s in range(shards)]
    assert sum(every) == len(rows) and max(every) - min(every) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    if fixture == "documents":
        source = {r.doc_id: r.source for r in rows}
        of = Counter((r.shard, source[r.doc_id]) for r in got)
        for name, n in Counter(source.values()).items():
            assert all(abs(of[s, name] - n / shards) <= 2 for s in range(shards))


def test_same_rows_same_places_and_no_rows(documents, no_docs):
    a, b = (sorted(map(tuple, interleave(d, 5).collect()), key=repr) for d in (documents, documents.repartition(6)))
    assert a == b
    assert interleave(no_docs).collect() == []
