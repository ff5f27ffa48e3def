"""Best-two-fit packing of documents into token sequences (operator 9)."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Memo, store, tidy

ROOM = 2048
END_ID = 0
MEMO = 400_000  # words of one generation whose ids a Python worker keeps
BLOCK = 1000  # texts whose new words are encoded together
PARTS = 10_000  # words that the library encodes at once
PER_GROUP = 32_768  # pieces that are packed among themselves, on average


class Words:
    """Ids of texts by a word-level tokenizer: it drops white space and no token crosses it, so what
    stands between spaces and line feeds is encoded by the library once and kept.

    Latin letters with at most a comma or full stop behind them are a word and a sign to it whatever
    stands around; such words go to the library's merges in lower case without its regular expressions.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library, self.memo, self.words = Tokenizer.from_file(path), Memo(memo), Memo(memo)
        self.merge, self.simple = self.library.model.tokenize, re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch
        level = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {ord(c): level(c)[0][0] for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ"}
        self.sign = {c: self._ids(self.library.encode(c, add_special_tokens=False).ids) for c in (".", ",")} | {"": b""}

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word) or self.words.old.get(word)
        if ids is None:
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.merge(word.translate(self.letters))])
        self.words[word] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text."""
        self.memo.turn()
        self.words.turn()
        self.memo[""] = b""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        rest = []
        for part in self.memo.lacks(set().union(*split) - {""}):
            if m := self.simple(part):
                self.memo[part] = self._word(m[1].lower()) + self.sign[m[2]]
            else:
                rest.append(part)
        for at in range(0, len(rest), PARTS):  # an encoding holds far more than its ids
            some = rest[at : at + PARTS]
            for part, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.memo[part] = self._ids(e.ids)
        return [b"".join(map(self.memo.__getitem__, parts)) for parts in split]


_WORDS: dict[tuple[str, int], Words] = {}


def tokenizer(path: str, memo: int = MEMO) -> Words:
    """One for each Python worker, which Spark uses again for the next task."""
    if (path, memo) not in _WORDS:
        _WORDS[path, memo] = Words(path, memo)
    return _WORDS[path, memo]


def pieces(docs: DataFrame, path: str, room: int = ROOM, end_id: int = END_ID, text: str = "text", key: str = "doc_id", memo: int = MEMO, block: int = BLOCK) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids``: every document's ids and the end id, cut only where longer than ``room``."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), block):
                part = batch.slice(at, block)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), tokenizer(path, memo).encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for number, start in enumerate(range(0, len(ids) // 4, room)):
                        own = ids[4 * start : 4 * (start + room)]
                        rows.append((doc, number, start, len(own) // 4, zlib.crc32(own), own))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    cols = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def best_two_fit(sizes: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; sizes from 1 to ``room``, and no bin holds more than ``room``.

    A bin is filled greedily, always with the largest item that still fits. Where a gap stays, its
    smallest item is exchanged for the two unpacked items that fill gap and place of it best, if they
    fill them better than it does.
    """
    waiting = [[] for _ in range(room + 1)]
    for i in np.argsort(sizes, kind="stable")[::-1]:
        waiting[sizes[i]].append(i)
    have, there = 0, np.zeros(room + 1, np.int64)
    for size, items in enumerate(waiting):
        there[size] = len(items)
        have |= (1 << size) * bool(items)
    bins, offsets, number = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    numbers = np.arange(room + 1)

    def take(size: int) -> int:
        nonlocal have
        there[size] -= 1
        if not there[size]:
            have &= ~(1 << size)
        return waiting[size].pop()

    while have:
        filled, gap = [], room
        while fits := (have & ((2 << gap) - 1)):
            size = fits.bit_length() - 1
            filled.append(take(size))
            gap -= size
        least = int(sizes[filled[-1]])
        if gap and have and len(filled) > 1:
            target = gap + least
            below = np.maximum.accumulate(np.where(there[: target + 1] > 0, numbers[: target + 1], 0))
            one = numbers[1:target][there[1:target] > 0]
            two = below[target - one]
            alone = (two == one) & (there[one] < 2)
            two = np.where(alone, below[one - 1], two)
            total = np.where(two > 0, one + two, 0)
            if len(total) and total[best := int(total.argmax())] > least:
                back = filled.pop()
                filled += [take(int(one[best])), take(int(two[best]))]
                waiting[least].append(back)
                there[least] += 1
                have |= 1 << least
        at = 0
        for i in filled:
            bins[i], offsets[i] = number, at
            at += int(sizes[i])
        number += 1
    return bins, offsets


def pack(docs: DataFrame, path: str, room: int = ROOM, end_id: int = END_ID, text: str = "text", key: str = "doc_id", with_ids: bool = False, memo: int = MEMO, block: int = BLOCK) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``): whole documents packed.

    Pieces are dealt to groups of some ``PER_GROUP`` by a hash of their place in the stored table (so
    no document, length or repeated row makes a group large) and each group is packed by
    ``best_two_fit``; a group leaves at most a few bins that aren't full, so their share doesn't grow
    with the corpus. Null and empty texts are the end id alone. Repeated rows are packed each.
    Other columns don't matter; an empty table gives an empty one. ``memo`` bounds the words
    that a task keeps and ``block`` the texts it holds split at once; results don't depend on them.
    """
    cut = pieces(docs, path, room, end_id, text, key, memo, block)
    cut = cut if with_ids else cut.drop("ids")
    dealt = store(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-dealt.count() // PER_GROUP))
    group = F.pmod(F.xxhash64("row"), F.lit(groups))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        bins, offsets = best_two_fit(pdf.length.to_numpy(), room)
        return pdf.assign(sequence_id=pdf.packed * 2**32 + bins, offset=offsets).drop(columns="packed")

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    small = dealt.select("row", "doc_id", "piece", "start", "length", "ids_crc32", group.alias("packed"))
    packed = small.groupBy("packed").applyInPandas(run, schema)
    if with_ids:
        packed = packed.join(dealt.select("row", "ids"), "row")
    return packed.drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids binary`` of the result of ``pack(with_ids=True)``; at most ``room`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts)
    return rows.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"])).alias("ids"))
