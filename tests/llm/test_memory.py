import numpy as np
import pyarrow as pa
import public_tokenizers
from conftest import rows_of

from tickloom.llm import common, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_the_library_gets_few_words_at_once(monkeypatch):
    words = packing.Words(PATH)
    texts = [" ".join(f"x{i}-{j}" for j in range(50)) for i in range(40)]
    want = [np.array(words.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    sizes, encode = [], words.library.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, some, **options):
            sizes.append(len(some))
            return encode(some, **options)

    monkeypatch.setattr(packing, "PARTS", 100)
    words.library = Counted()
    assert words.encode(texts) == want
    assert max(sizes) <= 100 and sum(sizes) == 2000


def test_a_task_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert list(common.tidy(lambda batches: iter(batches))([1, 2])) == [1, 2] and len(calls) == 2


def test_release_frees_what_a_task_held():
    held = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) // 1024
    before = held()
    words = [str(i) * 4 for i in range(1_000_000)]
    kept = [pa.array(words[:10])]
    del words
    common.release()
    assert held() - before < 60 and len(kept[0]) == 10


def test_places_do_not_depend_on_memo_and_block(spark, documents):
    some = documents.limit(60).repartition(2)
    cut = lambda **x: rows_of(packing.pieces(some, PATH, **x))
    assert cut() == cut(memo=10, block=7)
