import math

import numpy as np

from tickloom.llm import embeddings

NAN, INF = float("nan"), float("inf")


def brute(rows):
    ok = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for _, v in rows]
    scaled = [np.array(v) / np.abs(v).max() if o else None for (_, v), o in zip(rows, ok, strict=True)]
    unit = [v / np.linalg.norm(v) if v is not None else None for v in scaled]
    near = lambda i, j: ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= embeddings.COSINE
    links = [[j for j in range(len(rows)) if j != i and near(i, j)] for i in range(len(rows))]
    top = [r[0] for r in rows]
    for _ in rows:
        top = [min([top[i], *(top[j] for j in links[i])]) for i in range(len(rows))]
    return sorted((r[0], len(n), t, r[0] == t) for r, n, t in zip(rows, links, top, strict=True))


def planted(n=300, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(60):  # near copies in chains, exact copies, scaled copies
        v = base[i % 12] * (1 + i) + rng.standard_normal(dim) * 0.12 * (1 + i) * (i % 3)
        rows.append((n + i, v.tolist()))
    return rows


def test_links_and_components_against_brute_force(spark):
    odd = [(900, None), (901, []), (902, [0.0] * 64), (903, [NAN] * 64), (904, [INF] + [0.0] * 63), (905, [1.0, None]), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e300, 2e300]), (909, [-0.0, 3.0]), (910, [0.0, 3.0])]
    rows = planted() + odd
    df = spark.createDataFrame([(i, v, "l", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label string, rep int, raw int").repartition(4)
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df).collect())
    want = brute(rows)
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert [g[2:] for g in got] == [w[2:] for w in want]
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_large_buckets_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LARGE", 5)
    rng = np.random.default_rng(3)
    center = rng.standard_normal(32)
    rows = [(i, (center + rng.standard_normal(32) * 0.05).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df).collect())
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_recall_of_the_parameters():
    assert embeddings.recall(0.95) > 0.985
