"""Token counts: rank-synchronous merging over ragged numpy arrays (operator 7)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import map_batches, utf8

MEMO = 500_000  # pre-tokens whose count a Python worker keeps
BLOCK = 1000  # texts whose new pre-tokens are merged together
CHUNK = 1 << 20  # symbols of one run of the merger
SPACE = "▁"
NONE = np.iinfo(np.int32).max


class Counter:
    """Counts what the piece model makes of a text, without running the library on it.

    Only pieces of spaces have a space mark that is not their first character, and no piece has a line
    feed; so pre-tokens are a run of spaces with what follows it up to a space or line feed, and no merge
    crosses them. Characters that the model doesn't know count as their bytes.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not skip(i)}
        inner = [p for p in pieces if SPACE in p.lstrip(SPACE) or "\n" in p and len(p) > 1]
        if inner:
            raise ValueError(f"pieces that cross pre-tokens: {inner[:3]}")
        number = {p: i + 1 for i, p in enumerate(pieces)}  # 0: a character that is no piece
        scores = sorted(set(pieces.values()), reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        pairs = sorted((number[p[:i]] << 32 | number[p[i:]], rank[s], number[p]) for p, s in pieces.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.pairs, self.ranks, self.merged = (np.array(c, t) for c, t in zip(zip(*pairs, strict=True), (np.int64, np.int32, np.int32), strict=True))
        own = np.full(len(number) + 1, -1)
        own[self.merged] = self.ranks
        early = np.zeros(len(number) + 1, bool)  # a pair with it goes before its own: one place a round
        for side in (self.pairs >> 32, self.pairs & 0xFFFFFFFF):
            early[side[self.ranks <= own[side]]] = True
        kinds = np.bincount(self.ranks, minlength=len(scores))
        many = [s for s in range(len(scores)) if kinds[s] and len(set(self.merged[self.ranks == s].tolist())) > 1] if len(scores) < len(pieces) else []
        self.single = early[self.merged] | np.isin(self.ranks, many)
        self.letters = {p: n for p, n in number.items() if len(p) == 1}
        self.find = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall
        self.memo: dict[str, int] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges; -1: it doesn't merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1).astype(np.int32)

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each word: in every round each sequence's pair of least rank merges, in all sequences at once."""
        known, sizes = self.letters, np.fromiter(map(len, words), np.int64, len(words))
        syms = np.fromiter((known.get(c, 0) for w in words for c in w), np.int32, sizes.sum())
        weight = np.ones(len(syms), np.int64)
        if (odd := np.flatnonzero(syms == 0)).size:
            text = "".join(words)
            weight[odd] = [len(utf8(text[i])) for i in odd]
        seq = np.repeat(np.arange(len(words)), sizes)
        total = np.bincount(seq, weight, len(words)).astype(np.int64)
        pair = np.full(len(syms), -1, np.int32)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        pair[inside] = self._lookup(syms[inside], syms[inside + 1])
        while True:
            live = np.zeros(len(words), bool)
            live[seq[pair >= 0]] = True
            keep = live[seq]
            syms, seq, pair = syms[keep], seq[keep], pair[keep]
            if not len(syms):
                return total
            rank = np.where(pair >= 0, self.ranks[pair], NONE)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lens = np.diff(np.r_[starts, len(seq)])
            hit = rank == np.repeat(np.minimum.reduceat(rank, starts), lens)
            at = np.flatnonzero(hit)
            first = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
            run = np.r_[True, (at[1:] != at[:-1] + 1) | first[1:]]  # overlapping places: every second one
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            lead = np.flatnonzero(first)
            single = np.repeat(np.maximum.reduceat(self.single[pair[at]], lead), np.diff(np.r_[lead, len(at)]))
            at = at[np.where(single, first, (np.arange(len(at)) - begin) % 2 == 0)]
            total -= np.bincount(seq[at], minlength=len(words))
            syms[at] = self.merged[pair[at]]
            stay = np.ones(len(syms), bool)
            stay[at + 1] = False
            new = np.cumsum(stay)[at] - 1
            syms, seq, pair = syms[stay], seq[stay], pair[stay]
            pair[new] = -1
            touched = np.unique(np.r_[new, new[new > 0] - 1])
            touched = touched[touched + 1 < len(seq)]
            touched = touched[seq[touched] == seq[touched + 1]]
            pair[touched] = self._lookup(syms[touched], syms[touched + 1])

    def _learn(self, words: list[str]) -> None:
        chunk, size = [], 0
        for w in words:
            chunk.append(w)
            size += len(w)
            if size >= CHUNK:
                self.memo.update(zip(chunk, self.merge(chunk).tolist(), strict=True))
                chunk, size = [], 0
        if chunk:
            self.memo.update(zip(chunk, self.merge(chunk).tolist(), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        split = [self.find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*split).difference(self.memo) if split else ()
        self._learn(list(new))
        return [sum(map(self.memo.__getitem__, words)) for words in split]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each Python worker, which Spark uses again for the next task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; no shuffle.

    ``path``: a piece model every executor can read. New pre-tokens of a block of texts are merged
    together; their counts are kept in a bounded memo. Null texts count as empty (0 bytes, 0 tokens),
    repeated rows repeat, other columns don't matter, an empty table gives an empty one.
    """

    def step(ids, texts):
        of, n = counter(path), []
        for at in range(0, len(texts), BLOCK):
            n += of.count(texts[at : at + BLOCK])
        return {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(utf8(t)) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}

    cols = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(cols, step, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
