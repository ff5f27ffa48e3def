"""Byte-level BPE encoding and decoding by recursive DuckDB queries per partition (operator 5)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Memo, map_batches

MEMO = 300_000  # words of one generation whose encoding a Python worker keeps
BLOCK = 3000  # texts whose new words are looked up together
CHUNK = 500_000  # bytes of words of one query
LONG = 64  # bytes from which on a word is contracted at many places a round
KEPT = 1_000_000  # rows of all rounds that one query on long words keeps, about
MEMORY = "512MB"

#: Words of ordinary length. Every round unnests the token-position rows, joins them to the merges and
#: contracts each word's leftmost pair of least rank (a merged token's id is its rank).
_SHORT = """
WITH RECURSIVE step(k, w, toks) AS (
  SELECT 0, w, toks FROM start
  UNION ALL
  SELECT k + 1, w, toks[:(best & 65535) - 1] || [(best >> 16)::INT] || toks[(best & 65535) + 2:]
  FROM step JOIN (
    SELECT w, min(rank::BIGINT << 16 | i) AS best
    FROM (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[2:], 1) AS i FROM step)
    JOIN merges USING (l, r) GROUP BY w) USING (w)
), done AS (SELECT w, arg_max(toks, k) AS ids FROM step GROUP BY w)
SELECT w, ids, decoded
FROM done JOIN (SELECT w, string_agg(hex(bytes), '' ORDER BY i) AS decoded
                FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM done) JOIN vocab USING (id)
                GROUP BY w) USING (w)
"""

#: Long words, in as few rounds as they have different pairs. Every round: the ranks of neighbouring tokens, each word's leftmost pair of least rank, and the
#: row right of a contracted pair goes. A merged token ``plain`` (no pair with it has a lower rank than
#: its own) lets all places of that pair contract in the same round, every second one in a run of
#: overlapping places; that is what single steps from the left come to. A recursive query keeps the rows of all
#: its rounds, so it stops after some ``rounds`` and goes on from the stored rows of the last one.
_LONG_START = """
CREATE OR REPLACE TABLE state AS SELECT w, generate_subscripts(toks, 1) AS p, unnest(toks) AS t FROM start;
CREATE OR REPLACE TABLE ended AS FROM state LIMIT 0
"""
_LONG_ROUNDS = """
CREATE OR REPLACE TABLE after AS
WITH RECURSIVE step(k, w, p, t) AS (
  SELECT 0, w, p, t FROM state
  UNION ALL
  SELECT k + 1, w, p, CASE WHEN hit THEN merged ELSE t END
  FROM (SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY p), false) AS gone
        FROM (SELECT *, at_best AND CASE WHEN plain THEN (n - coalesce(miss, 0)) % 2 = 1 ELSE p = leftmost END AS hit
              FROM (SELECT *, max(CASE WHEN NOT at_best THEN n END)
                         OVER (PARTITION BY w ORDER BY n ROWS UNBOUNDED PRECEDING) AS miss
                    FROM (SELECT *, coalesce(rank = least, false) AS at_best,
                                 min(CASE WHEN rank = least THEN p END) OVER (PARTITION BY w) AS leftmost
                          FROM (SELECT *, min(rank) OVER (PARTITION BY w) AS least
                                FROM (SELECT k, w, p, t, merged, rank, plain, n
                                      FROM (SELECT k, w, p, t, lead(t) OVER o AS nxt, row_number() OVER o AS n
                                            FROM step WHERE k < {rounds} WINDOW o AS (PARTITION BY w ORDER BY p))
                                      LEFT JOIN merges ON l = t AND r = nxt))
                          WHERE least IS NOT NULL))))
  WHERE NOT gone
)
SELECT w, p, t, k = {rounds} AS more FROM step SEMI JOIN (SELECT w, max(k) AS k FROM step GROUP BY w) USING (w, k);
INSERT INTO ended SELECT w, p, t FROM after WHERE NOT more;
CREATE OR REPLACE TABLE state AS SELECT w, p, t FROM after WHERE more;
DROP TABLE after
"""
_LONG = """
SELECT w, list(t ORDER BY p) AS ids, string_agg(hex(bytes), '' ORDER BY p) AS decoded
FROM ended JOIN vocab ON id = t GROUP BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, (x.strip() for x in lines)))}


class Encoder:
    """Ids and decoded bytes of words; state is a bounded memo and DuckDB's merge table."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.find = read_ranks(path), regex.compile(pattern).findall
        self.memo, self.pieces = Memo(MEMO), Memo(MEMO)
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], n) for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        early = {x for left, right, n in merges for x in (left, right) if n < x}  # a pair with it ranks below it
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        left, right, merged = (pa.array(c, pa.int32()) for c in zip(*merges, strict=True))
        pairs = pa.table({"l": left, "r": right, "merged": merged, "rank": merged, "plain": pa.array([n not in early for _, _, n in merges])})
        known = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks, pa.binary())})
        self.db.register("pairs", pairs)
        self.db.register("known", known)
        self.db.execute("CREATE TABLE merges AS FROM pairs; CREATE TABLE vocab AS FROM known")
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    def _contract(self, words: list[str], raw: list[bytes], query: str) -> None:
        ends = np.cumsum([0, *map(len, raw)], dtype=np.int32)
        toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.bytes[np.frombuffer(b"".join(raw), np.uint8)]))
        self.db.register("start", pa.table({"w": pa.array(np.arange(len(raw), dtype=np.int32)), "toks": toks}))
        if query is _LONG:
            self.db.execute(_LONG_START)
            while rows := self.db.sql("SELECT count(*) FROM state").fetchall()[0][0]:
                self.db.execute(_LONG_ROUNDS.format(rounds=max(1, KEPT // rows)))
        found = self.db.sql(query).to_arrow_table().combine_chunks()
        lists = found["ids"].chunk(0)
        data, ends = lists.values.to_numpy().astype("<i4").tobytes(), lists.offsets.to_pylist()
        for w, i, j, decoded in zip(found["w"].to_pylist(), ends, ends[1:], found["decoded"].to_pylist(), strict=False):
            self.memo[words[w]] = (data[4 * i : 4 * j], bytes.fromhex(decoded))

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that the memo lacks. A word that is a token as it stands takes its id."""
        waiting = {query: ([], []) for query in (_SHORT, _LONG)}
        size = 0
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            if (n := self.ranks.get(data)) is not None:
                self.memo[word] = (n.to_bytes(4, "little"), data)
                continue
            chunk, raw = waiting[_LONG if len(data) > LONG else _SHORT]
            chunk.append(word)
            raw.append(data)
            size += len(data)
            if size >= CHUNK:
                self._flush(waiting)
                size = 0
        self._flush(waiting)

    def _flush(self, waiting: dict) -> None:
        for query, (chunk, raw) in waiting.items():
            if chunk:
                self._contract(chunk, raw, query)
                chunk.clear()
                raw.clear()

    def _join(self, words: list[str]) -> tuple[bytes, bytes]:
        return b"".join([self.memo[w][0] for w in words]), b"".join([self.memo[w][1] for w in words])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Little-endian 32-bit ids of each whole text, and the bytes that they decode to.

        No match crosses from a visible character into a following space, so a text whose spaces all
        stand between visible characters falls into pieces that are matched by themselves; ``pieces``
        keeps what each comes to with its space before it. Other texts are matched as a whole.
        """
        self.memo.turn()
        self.pieces.turn()
        split, whole, new = [], [], set()
        for text in texts:
            parts = (text or "").split(" ")
            plain = all(x and not (x[0].isspace() or x[-1].isspace()) for x in parts)
            split.append(parts[1:] if plain else [])
            whole.append(self.find(parts[0] if plain else text or ""))
            new.update(split[-1])
        words = {x: self.find(" " + x) for x in self.pieces.lacks(new)}
        self.learn(self.memo.lacks(set(chain(*whole, *words.values()))))
        self.pieces.update({x: self.memo[w[0]] if len(w) == 1 else self._join(w) for x, w in words.items()})
        for head, parts in zip(whole, split, strict=True):
            found = [self._join(head), *map(self.pieces.__getitem__, parts)]
            yield b"".join([x for x, _ in found]), b"".join([x for _, x in found])


_ENCODERS: dict = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, which Spark uses again for the next task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text; no shuffle.

    ``path``: a rank file every executor can read; ``pattern`` splits texts into words, each encoded
    by itself. A partition's new words go through the recursive query in blocks; their results are
    kept in a bounded memo. Null texts count as empty (no ids), repeated rows repeat, other columns
    don't matter, an empty table gives an empty one. Special strings are ordinary text.
    """

    def step(ids, texts):
        coder, rows = encoder(path, pattern), []
        for at in range(0, len(texts), BLOCK):
            rows += [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(y).hexdigest()) for x, y in coder.encode(texts[at : at + BLOCK])]
        n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return {"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}

    cols = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(cols, step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, ids array<int>, decoded binary``: the encoding itself, under the same rules."""

    def step(ids, texts):
        rows = list(encoder(path, pattern).encode(texts))
        return {"doc_id": pa.array(ids, pa.int64()), "ids": pa.array([np.frombuffer(x, "<i4") for x, _ in rows], pa.list_(pa.int32())), "decoded": pa.array([y for _, y in rows], pa.binary())}

    cols = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(cols, step, "doc_id long, ids array<int>, decoded binary")
