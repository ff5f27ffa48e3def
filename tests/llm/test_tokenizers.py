"""Operators 5, 7 and 9 against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from tickloom.llm import byte_bpe, packing, token_counts

RANKS, PIECES, WORDS = map(public_tokenizers.path, ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"))


def hard_texts():
    rng = random.Random(1)
    plain = ["a" * 999 + "b", " " * 301, "#" * 103 + "ab" * 77, "a b ", " a b", "a\n b\n\n c \n d  e 　f", "\n\n\n \t x", "zzzzzzabcabcabc" * 30, "xyxxyxyyx" * 100, "▁a ▁ b▁", "<s> x </s><unk><0x0A>", "a   b    c" + " " * 17 + "d"]
    return plain + ["".join(rng.choice("abcdeéß \n'1") for _ in range(400)) for _ in range(40)]


@pytest.mark.parametrize("fixture", ["odd_docs", "documents"])
def test_byte_bpe_as_the_library(request, fixture):
    docs = request.getfixturevalue(fixture)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    want = []
    for r in docs.collect():
        ids = np.array(own.encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = byte_bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_byte_bpe_of_hard_texts(no_docs):
    coder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for text, (ids, decoded) in zip(hard_texts(), coder.encode(hard_texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert decoded == text.encode()
    assert byte_bpe.encode_digests(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []


def test_byte_bpe_of_single_spaces_beside_other_white_space():
    texts = [f"{a} {b} {c}" for x in "\u00a0\t\n\r\u3000\u2028\x1c\x85" for a in ("a", x, "a" + x, x + "a") for b in (x, x + "b", "b" + x, f"b{x}b") for c in ("c", x, x + "c", "c" + x)]
    coder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    assert own.encode_ordinary("a \u00a0 \u00a0 c") == [64, 11504, 269]
    for text, (ids, decoded) in zip(texts, coder.encode(texts), strict=True):
        assert (text, np.frombuffer(ids, "<u4").tolist(), decoded) == (text, own.encode_ordinary(text), text.encode())


def test_byte_bpe_of_a_long_word_of_varied_letters(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", "48MB")
    monkeypatch.setattr(byte_bpe, "KEPT", 50_000, raising=False)
    coder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    word = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=5000))
    ((ids, decoded),) = coder.encode([word])
    assert (np.frombuffer(ids, "<u4").tolist(), decoded) == (own.encode_ordinary(word), word.encode())


def test_byte_bpe_ids_and_bytes(odd_docs):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in odd_docs.where("doc_id is not null").collect()}
    for r in byte_bpe.encode(odd_docs.where("doc_id is not null"), RANKS, public_tokenizers.PATTERN).collect():
        assert own.decode(r.ids) == bytes(r.decoded).decode() == (texts[r.doc_id] or "")


def test_byte_bpe_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 5)
    coder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for _ in range(3):
        assert [d.decode() for _, d in coder.encode(["one two three four fivesix seveneight ninten"])] == ["one two three four fivesix seveneight ninten"]


@pytest.mark.parametrize("fixture", ["odd_docs", "documents"])
def test_token_counts_as_the_library(request, fixture):
    docs = request.getfixturevalue(fixture)
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for r in docs.collect():
        n = len(own.encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    assert sorted(map(tuple, token_counts.token_counts(docs, PIECES).collect()), key=repr) == sorted(want, key=repr)


def test_token_counts_of_hard_texts(no_docs):
    own, counter = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.Counter(PIECES)
    assert counter.count(hard_texts()) == [len(own.encode(t)) for t in hard_texts()]
    assert token_counts.token_counts(no_docs, PIECES).collect() == []


def library_ids(text):
    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("fixture,room", [("odd_docs", 2048), ("documents", 256)])
def test_packing_is_whole(request, fixture, room):
    docs = request.getfixturevalue(fixture)
    library, want = Tokenizer.from_file(WORDS), []
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, i, s, len(ids[s : s + room]), zlib.crc32(ids[s : s + room].tobytes())) for i, s in enumerate(range(0, len(ids), room))]
    got = packing.pack(docs, WORDS, room).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= room
    assert len(filled) <= 1.02 * sum(w[3] for w in want) / room + 2


def test_packed_sequences_hold_the_ids(odd_docs, odd_texts):
    packed = packing.pack(odd_docs, WORDS, 512, with_ids=True)
    rows = packing.sequences(packed).collect()
    total = sorted(i for r in rows for i in np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert total == sorted(i for _, t in odd_texts for i in library_ids(t))
    assert all(len(r.ids) == 4 * r.n_tokens <= 4 * 512 for r in rows)


def test_packing_no_rows_and_several_groups(no_docs, documents, monkeypatch):
    assert packing.pack(no_docs, WORDS).collect() == []
    monkeypatch.setattr(packing, "PER_GROUP", 50)
    got = packing.pack(documents, WORDS).collect()
    assert {(r.doc_id, r.piece) for r in got} == {(r.doc_id, r.piece) for r in packing.pieces(documents, WORDS).collect()}
    assert len({r.sequence_id >> 32 for r in got}) > 1


def test_best_two_fit_exchanges_the_smallest():
    bins, offsets = packing.best_two_fit(np.array([7, 2, 6, 3, 2]), 10)
    assert bins.max() == 1 and sorted(zip(bins, offsets, strict=True)) == sorted(set(zip(bins, offsets, strict=True)))
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)  # 6 + 3 leaves 1; 6 + 2 + 2 leaves none
    assert bins.tolist() == [0, 1, 0, 0]
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 2049, 3000)
    bins, offsets = packing.best_two_fit(sizes)
    assert np.bincount(bins, sizes).max() <= 2048 and bins.max() + 1 <= 1.02 * max(sizes.sum() / 2048, (sizes > 1024).sum())
    assert packing.best_two_fit(np.zeros(0, int))[0].tolist() == []
