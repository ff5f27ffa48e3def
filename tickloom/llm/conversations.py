"""Repair of conversation structure by weighted interval parsing (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import store

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # what an edit costs; keeping is free
BLOCK = 4096  # rows of a conversation that are parsed into one span before the span is handed on

_SPACE = " \t\n\x0b\x0c\r"
_NAMES = {"u": "user", "a": "assistant"}
#: Legal orders ``(s?(ua)+)?`` as steps between what came last: 0 nothing, 1 s, 2 u, 3 a.
_STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
_STATES, _ENDS = range(4), (0, 3)
_WIDTH = len(_STATES)
#: ``X[p, q] -> X[p, r] X[r, q]``, the binary rules of the grammar.
_RULES = [[(p * _WIDTH + r, r * _WIDTH + q) for r in _STATES] for p in _STATES for q in _STATES]

Cell = tuple  # per nonterminal X[p, q]: the least (cost, audit) of the span, or None


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans."""
    out = []
    for rule in _RULES:
        ways = [(left[i][0] + right[j][0], left[i][1], right[j][1]) for i, j in rule if left[i] and right[j]]
        cost = min((w[0] for w in ways), default=None)
        out.append(None if cost is None else (cost, min(a + b for c, a, b in ways if c == cost)))
    return tuple(out)


def _cell(ways: list[tuple[int, int, int, str]]) -> Cell:
    out: list = [None] * len(_RULES)
    for p, q, cost, edit in ways:
        at = p * _WIDTH + q
        out[at] = min((cost, edit), out[at] or (cost, edit))
    return tuple(out)


_KEPT = _cell([(p, p, 0, "") for p in _STATES])
_ONE = _cell([(p, q, INSERT, "I") for c in "ua" for p, q in _STEPS[c]])
#: Nothing or insertions: the cell of an empty span. Two reach everything that insertions can, a third only costs.
INSERTED = reduce(joined, [tuple(min(filter(None, pair), default=None) for pair in zip(_KEPT, _ONE, strict=True))] * 2)

_terminals: dict = {}


def terminal(initial: str, fault: str) -> Cell:
    """The closed cell of one row: its edits with any insertions around them."""
    key = (initial if initial in _STEPS else "", fault)
    if key not in _terminals:
        extra = TRUNCATED if fault == "truncated" else 0
        ways = [(p, p, DELETE, "D") for p in _STATES]
        if fault not in ("blank", "duplicate"):
            ways += [(p, q, extra, "K") for p, q in _STEPS.get(key[0], ())]
            ways += [(p, q, REROLE + extra, "R") for c in "ua" for p, q in _STEPS[c]]
        _terminals[key] = joined(joined(INSERTED, _cell(ways)), INSERTED)
    return _terminals[key]


class Spans:
    """Adjacent spans, combined bottom-up by length: two of a length become one of the next."""

    def __init__(self, join: Callable):
        self.join, self.held = join, []

    def push(self, item, level: int = 0) -> None:
        while self.held and self.held[-1][0] <= level:
            low, left = self.held.pop()
            item, level = self.join(left, item), max(low, level) + 1
        self.held.append((level, item))

    def whole(self):
        items = [item for _, item in self.held]
        return reduce(lambda right, left: self.join(left, right), reversed(items)) if items else None


def parsed(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """``(cost, audit)`` of a conversation given as ``(initial, fault)`` of its rows."""
    spans = Spans(joined)
    for initial, fault in rows:
        spans.push(terminal(initial, fault))
    cell = spans.whole() or INSERTED
    return min(cell[q] for q in _ENDS if cell[q])


_COUNTS = ("blank", "duplicate", "truncated")
_PIECE = ("start", "first", "last", "low", "high", "first_turn", "last_turn", "turns", *_COUNTS, "illegal", "cell")


def _legal(left: str, right: str) -> bool:
    return left + right in ("su", "ua", "au")


def _piece(pos: int, turn: int | None, initial: str, fault: str) -> dict:
    counts = {c: int(fault == c) for c in _COUNTS}
    return dict(zip(_PIECE, (pos, initial, initial, turn, turn, turn, turn, int(turn is not None), *counts.values(), 0, terminal(initial, fault)), strict=True))


def _merged(a: dict, b: dict) -> dict:
    low, high = (f((x for x in (a[k], b[k]) if x is not None), default=None) for f, k in ((min, "low"), (max, "high")))
    same = a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    return {
        "start": a["start"], "first": a["first"], "last": b["last"], "low": low, "high": high, "first_turn": a["first_turn"], "last_turn": b["last_turn"],
        "turns": a["turns"] + b["turns"] - same, **{c: a[c] + b[c] for c in _COUNTS}, "illegal": a["illegal"] + b["illegal"] + (not _legal(a["last"], b["first"])), "cell": joined(a["cell"], b["cell"]),
    }


_PIECE_TYPE = "start long, first string, last string, low long, high long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, cell array<struct<cost: long, audit: string>>"


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by ``crc32(conv_id:turn) % 20`` (nulls: one space).

    0 drops a row, 1 empties its text, 2 takes ``.!?`` from it, 3 repeats the row, 4 makes the user its role.
    """

    def given(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


HEAD = 32  # characters of a text that rows of one turn are ordered by, before its digest
_ORDER = ("conv_id", "turn", "role", "head", "digest")


def _slim(rows: DataFrame) -> DataFrame:
    """What stands for a text wherever it needn't be read: its head for the order, its digest for equality, whether it is blank or broken off."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", F.substring("text", 1, HEAD).alias("head"), F.unhex(F.md5("text")).alias("digest"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), "text",
    )


def _placed(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts, with their number of ``copies``, their faults and a place ``pos`` in the order of all conversations.

    The order is that of ``_ORDER``, nulls first. Ranges of it are dealt out, so a long conversation is many tasks.
    """
    kinds = _slim(rows).groupBy(*_ORDER, "blank", "cut").agg(F.count("*").alias("copies"))
    firsts = kinds.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    a, b = kinds.alias("a"), firsts.alias("b")
    both = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest")))
    seen = ~F.col("b.first.turn").eqNullSafe(F.col("a.turn"))
    fault = F.when(F.col("a.blank"), "blank").when(seen, "duplicate").when(F.col("a.cut"), "truncated").otherwise("")
    again = F.when(F.col("a.blank"), "blank").otherwise("duplicate")
    named = both.select(*[f"a.{c}" for c in (*_ORDER, "copies")], fault.alias("fault"), again.alias("again"), F.substring("a.role", 1, 1).alias("initial"))
    order = [F.col(c).asc_nulls_first() for c in _ORDER]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order)
    return store(ordered.drop("role", "head", "digest").withColumn("pos", F.monotonically_increasing_id()), "placed")


def _pieces(batches) -> Iterator[pa.RecordBatch]:
    """The spans of the runs of rows that lie together, up to ``BLOCK`` rows each."""
    done, spans, count, before, conv = [], Spans(_merged), 0, None, None

    def close():
        nonlocal spans, count
        if count:
            done.append((conv, spans.whole()))
        spans, count = Spans(_merged), 0

    def flush():
        nonlocal done
        out, done = done, []
        columns = {"conv_id": [c for c, _ in out], **{k: [p[k] for _, p in out] for k in _PIECE[:-1]}}
        columns["cell"] = [[x and {"cost": x[0], "audit": x[1]} for x in p["cell"]] for _, p in out]
        return pa.RecordBatch.from_pydict(columns, schema=schema)

    schema = None
    for batch in batches:
        if schema is None:
            schema = pa.schema([batch.schema.field("conv_id"), *_arrow_piece()])
        for this, pos, turn, initial, fault, again, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if before is None or this != conv or pos != before + 1:
                close()
            conv, before = this, pos
            for copy in range(copies):
                if count == BLOCK:
                    close()
                spans.push(_piece(pos, turn, initial, again if copy else fault))
                count += 1
        if len(done) >= 1000:
            yield flush()
    close()
    if done:
        yield flush()


def _arrow_piece() -> list[pa.Field]:
    cell = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
    types = {"first": pa.string(), "last": pa.string(), "cell": cell}
    return [pa.field(k, types.get(k, pa.int64())) for k in _PIECE]


def _edited(audit: str, rows: Iterator[tuple[str, str, str]]) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of the repaired conversation, from its audit and the ``(initial, role, text)`` of its rows."""
    state, rows = 0, iter(rows)
    for edit in audit:
        initial, role, text = ("", "", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        symbol = initial if edit == "K" else "a" if state == 2 else "u"
        state = dict(_STEPS[symbol])[state]
        yield edit, role if edit == "K" else _NAMES[symbol], text


def _conversations(batches) -> Iterator[tuple]:
    """``(conv_id, verdict, rows)`` of each conversation of a sorted stream; ``rows`` must be used before the next one."""

    def flat():
        for batch in batches:
            yield from batch.to_pylist()

    stream = flat()
    ahead = next(stream, None)
    while ahead is not None:
        conv, spans, last = ahead["conv_id"], Spans(_merged), -1
        while ahead is not None and ahead["conv_id"] == conv and ahead["kind"] < 2:
            if ahead["kind"] == 1:
                piece = ahead | {"cell": tuple(x and (x["cost"], x["audit"]) for x in ahead["cell"])}
                spans.push({k: piece[k] for k in _PIECE})
            ahead = next(stream, None)

        def rows(conv=conv):
            nonlocal ahead
            while ahead is not None and ahead["conv_id"] == conv:
                yield ahead["initial"], ahead["role"], ahead["text"]
                ahead = next(stream, None)

        whole, own = spans.whole(), rows()
        cell = whole["cell"] if whole else INSERTED
        cost, audit = min(cell[q] for q in _ENDS if cell[q])
        yield conv, (whole, cost, audit), own
        for _ in own:
            pass


def _as_long(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _digests(batches) -> Iterator[pa.RecordBatch]:
    def table(done, schema):
        return pa.RecordBatch.from_pylist(done, schema=schema)

    first = next(batches, None)
    if first is None:
        return
    longs = ("gaps", *_COUNTS, "illegal", "cost")
    schema = pa.schema([first.schema.field("conv_id"), *(pa.field(c, pa.int64()) for c in longs), pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])

    def every():
        yield first
        yield from batches

    done = []
    for conv, (whole, cost, audit), rows in _conversations(every()):
        digest, between = hashlib.sha256(), ""
        for _, role, text in _edited(audit, rows):
            digest.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
            between = "\n"
        found = {"conv_id": conv, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest(), "gaps": 0, "illegal": whole["illegal"] if whole else 0}
        if whole and whole["low"] is not None:
            found["gaps"] = _as_long(whole["high"] - whole["low"] + 1 - whole["turns"])
        done.append(found | {c: whole[c] if whole else 0 for c in _COUNTS})
        if len(done) >= 1000:
            yield table(done, schema)
            done = []
    if done:
        yield table(done, schema)


def _repaired(batches) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    schema = pa.schema([first.schema.field("conv_id"), pa.field("place", pa.int64()), *(pa.field(c, pa.string()) for c in ("edit", "role", "text"))])

    def every():
        yield first
        yield from batches

    done = []
    for conv, (_, _, audit), rows in _conversations(every()):
        for place, (edit, role, text) in enumerate(_edited(audit, rows)):
            done.append({"conv_id": conv, "place": place, "edit": edit, "role": role, "text": text})
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def _streamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Each conversation's name, then its spans, then its rows, in order and in one partition. Texts are shuffled here and nowhere else."""
    placed = _placed(rows)
    kind = placed.schema["conv_id"].dataType.simpleString()
    pieces = placed.select("conv_id", "pos", "turn", "initial", "fault", "again", "copies").mapInArrow(_pieces, f"conv_id {kind}, {_PIECE_TYPE}")
    named = names.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"))
    spans = pieces.select("*", F.lit(1).alias("kind"), F.col("start").alias("pos"))
    texts = _slim(rows).select(*_ORDER, F.lit(2).alias("kind"), F.substring("role", 1, 1).alias("initial"), "text")
    both = named.unionByName(spans, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "pos", *_ORDER[1:])]
    return both.repartition("conv_id").sortWithinPartitions(*order).drop("turn", "head", "digest", "pos")


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the rows of every conversation after its cheapest repair, in order of ``place``.

    ``rows`` has ``conv_id, turn, role, text`` (role and text not null). See ``inspect`` for the method.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _streamed(rows, rows).mapInArrow(_repaired, f"conv_id {kind}, place long, edit string, role string, text string")


def inspect(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, one row per conversation of ``names`` (or of ``rows``).

    The repair grammar is in Chomsky normal form. Its nonterminals ``X[p, q]`` stand for stretches of
    rows whose repaired roles lead from ``p`` to ``q``, where ``p`` and ``q`` say what came last (nothing, s, u or a).
    A row is a terminal: kept, given another role or deleted (``X[p, p]``), each at its cost;
    ``X[p, q] -> X[p, r] X[r, q]`` joins spans. The cell of a span holds for each nonterminal the least
    ``(cost, audit)``, closed under insertions before and after. Cells are combined bottom-up by span
    length.

    Every split of a span yields the same cell in this grammar, as ``r`` ranges over all that can lie at the split, so one
    split a span is enough and a conversation of n rows takes n joins, not n**3 (a test compares with all
    splits). Of audits of one span and cost none begins another, for the longer one would have more insertions
    and cost more; so the least audit of a whole is made of least audits of its parts.

    Rows are dealt out by ranges of their order, so a conversation that holds a third of
    all rows is parsed by many tasks, ``BLOCK`` rows at a time; only its spans meet. The digest of a whole conversation is a
    running one, so one task reads its rows in order, in constant memory but for the audit.

    A null ``conv_id`` is a conversation, null turns come first, rows of equal turns are in the order of role, of the first ``HEAD`` characters
    of the text and of its md5 digest.
    Only roles that begin with s, u or a can be kept. Other columns don't matter. An empty table gives an empty table.
    """
    names = rows if names is None else names
    kind = rows.schema["conv_id"].dataType.simpleString()
    columns = ", ".join(f"{c} long" for c in ("gaps", *_COUNTS, "illegal", "cost"))
    return _streamed(rows, names).mapInArrow(_digests, f"conv_id {kind}, {columns}, audit string, repaired_sha256 string")
