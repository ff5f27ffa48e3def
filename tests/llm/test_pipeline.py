import corpus_pipeline
import numpy as np
import pytest
from tickloom.llm import simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out, docs = [spark.read.parquet(f"{SF}/documents.parquet")], None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_filter_and_keep_columns(steps):
    docs, *filtered, packed = steps
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert all(s.columns == docs.columns for s in filtered)
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    assert len(ids[1]) > 0.97 * len(ids[0])
    assert len(ids[3]) < len(ids[2])


def test_run_gives_whole_sequences(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    filled = np.zeros(0)
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        parts.sort()
        assert [o for o, _ in parts] == np.r_[0, np.cumsum([n for _, n in parts])[:-1]].tolist()
        filled = np.r_[filled, sum(n for _, n in parts)]
    assert filled.max() <= 2048 and corpus_pipeline.ORACLE_SQL is None


def test_one_of_each_group_of_similar_texts_stays(steps):
    rows, after = sorted(steps[2].collect(), key=lambda r: r.doc_id), {r.doc_id for r in steps[3].collect()}
    words = {r.doc_id: r.text.encode().lower().split() for r in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items()}
    groups = {i: {j for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    for _ in range(8):
        groups = {i: set().union(*(groups[j] for j in g)) for i, g in groups.items()}
    wide = {i for i in sets if any((simhash.fingerprint(b" ".join(words[i]).decode()) ^ simhash.fingerprint(b" ".join(words[j]).decode())).bit_count() > 4 for j in groups[i])}
    assert all(len(g & after) == 1 for g in groups.values()) and wide
