import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import simhash
from tickloom.llm.common import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, ids):
    top = list(range(len(fps)))
    for _ in range(len(fps)):
        before = list(top)
        for i in range(len(fps)):
            near = [j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4]
            top[i] = min(top[j] for j in near)
        if top == before:
            break
    groups = {}
    for t, d in zip(top, ids, strict=True):
        if d is not None:
            groups[t] = min(d, groups.get(t, d))
    return [groups.get(t) for t in top]


@pytest.mark.parametrize("fixture", ["odd_docs", "documents"])
def test_against_brute_force(request, fixture):
    docs = request.getfixturevalue(fixture)
    rows = docs.select("doc_id", "text").collect()
    fps, ids = [plain_fingerprint(r.text) for r in rows], [r.doc_id for r in rows]
    want = sorted(zip(ids, (f"{f:016x}" for f in fps), brute(fps, ids), strict=True), key=repr)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr) == want


def test_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def test_blocks_tell_all_values_apart():
    for mask in simhash._MASKS:
        low = int(mask) & -int(mask)
        values = np.arange(int(mask) // low + 1, dtype=np.uint64) * np.uint64(low)
        assert len(np.unique(simhash._packed(values, mask))) == len(values)


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 3)
    rng = np.random.default_rng(0)
    ball = {0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, k)) for k in (1, 2, 3) for _ in range(40)}
    fps = sorted(ball | {int(x) for x in rng.integers(0, 2**63, 60)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    found = {r.node % 2**64: r.component % 2**64 for r in components(simhash.near_links(df)).collect()}
    want = brute(fps, fps)
    groups, expected = {}, {}
    for f, t in zip(fps, want, strict=True):
        groups.setdefault(found.get(f, f), set()).add(f)
        expected.setdefault(t, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain_a_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(60)}
    assert components(df.limit(0)).collect() == []


def test_keep_one_keeps_columns_and_one_of_each_group(odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    fps = [plain_fingerprint(r.text) for r in odd_docs.collect()]
    assert kept.count() == len(set(brute(fps, list(range(len(fps))))))
    left = [plain_fingerprint(r.text) for r in kept.collect()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(left) for b in left[:i])
    assert simhash.keep_one(odd_docs.where(F.lit(False))).count() == 0


def plain_shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def similar_groups(texts):
    sets, top = [plain_shingles(t) for t in texts], list(range(len(texts)))
    near = [[j for j in top if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in top]
    while (after := [min(top[j] for j in near[i]) for i in range(len(texts))]) != top:
        top = after
    return top


@pytest.mark.parametrize("part", [2048, 5])
def test_near_copies_of_similarity_08_go(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = np.random.default_rng(3)
    line = [f"common{i}" for i in range(12)]
    texts = [None, "", "one two", "One  two", "one two three four five", "a b c d e f g h i", "a b c d e f g h"]
    for k in range(30):
        base = [f"w{k}x{i}" for i in rng.integers(0, 500, int(rng.integers(8, 150)))] + line
        for change in (0, 0, 1, 2, 3, 4, 6, 9):
            words = list(base)
            for at in rng.choice(len(words), change, replace=False):
                words[at] = f"new{rng.integers(1 << 40)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    top = similar_groups(texts)
    kept = sorted(r.doc_id for r in simhash.keep_one(docs, width=5, bits=28, similarity=0.8).collect())
    assert kept == sorted(set(top)) and len(kept) < len(simhash.keep_one(docs).collect())
    assert simhash.keep_one(docs.limit(0), width=5, bits=28, similarity=0.8).collect() == []


def edited(copies, changes):
    """Texts of 400 words in families of ``copies`` with some words changed."""
    rng, texts = np.random.default_rng(5), []
    for k in range(4):
        base = [f"w{k}x{i}" for i in range(400)]
        for _ in range(copies):
            words = list(base)
            for at in rng.choice(400, changes, replace=False):
                words[at] = f"new{rng.integers(1 << 40)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("joined, once", [(1024, True), (5, False)])
def test_a_text_is_moved_once(spark, monkeypatch, joined, once):
    """Copies that meet under many keys in ever other company are compared as one group; larger ones in the groups they met in."""
    monkeypatch.setattr(simhash, "JOINED", joined)
    texts, real, moved = edited(9, 8), simhash.store, []

    def spy(df, name):
        out = real(df, name)
        if name == "members":
            moved.append((out.count(), out.select("row").distinct().count()))
        return out

    monkeypatch.setattr(simhash, "store", spy)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    kept = sorted(r.doc_id for r in simhash.keep_one(docs, width=5, bits=28, similarity=0.6).collect())
    assert kept == [0, 9, 18, 27]
    ((rows, distinct),) = moved
    assert (rows == distinct) == once and distinct == 36


def test_pivot_tables_find_the_near_ones_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_prefix", lambda hashes, common, similarity: hashes[:0])
    texts = [t for t in edited(2, 1)]
    fps = [simhash._of_set(simhash.shingles(t, 5)) for t in texts]
    near = [(a ^ b).bit_count() <= 4 for a, b in zip(fps[::2], fps[1::2], strict=True)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    kept = {r.doc_id for r in simhash.keep_one(docs, width=5, bits=28, similarity=0.8).collect()}
    assert any(near) and [2 * i + 1 not in kept for i in range(4)] == near


def test_similar_texts_go_however_far_their_fingerprints(spark):
    words = "w931 w552 w114 w450 w1466 w1192 w1703 w1834 w690".split()
    texts = [" ".join(words[:8]), " ".join(words)]  # 4 of 5 shingles
    a, b = (simhash._of_set(simhash.shingles(t, 5)) for t in texts)
    assert (a ^ b).bit_count() == 29
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in simhash.keep_one(docs, width=5, bits=28, similarity=0.8).collect()] == [0]


def test_parities_leave_no_similar_set_out():
    rng = np.random.default_rng(2)
    for bits in (64, simhash.PARITY):
        base = [rng.integers(0, 1 << 64, n, np.uint64) for n in (1, 4, 9, 60, 300, 3000)]
        sets = [np.unique(np.r_[s[: len(s) - k], rng.integers(0, 1 << 64, m, np.uint64)]) for s in base for k in (0, 1, len(s) // 20, len(s) // 9, len(s) // 5) for m in (0, 1, len(s) // 9, len(s))]
        odds, sizes, kept = np.array([simhash._odd(s, bits) for s in sets]), np.array([len(s) for s in sets]), 0
        for x in range(len(sets)):
            among = np.arange(len(sets))
            near = simhash._close(odds, sizes, x, among, 0.8)
            similar = [len(np.intersect1d(sets[x], s)) >= 0.8 * len(np.union1d(sets[x], s)) for s in sets]
            assert near[similar].all()
            kept += near.sum()
        assert kept < len(sets) ** 2 / 2
