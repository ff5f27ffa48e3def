"""Personal data and the terms that give it away (operator 12)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import HashFilter, map_batches, store

KINDS = ("email", "ip", "card", "phone")
TERM = "term"  # the kind of the spans that the method adds
WINDOW = 8  # words on each side of an entity that are its context
SUPPORT = 3  # different contexts in which a term must stand beside an entity to tell anything
GENERALISE, REMOVE = 0.8, 0.95  # disclosure from which on a term is generalised, removed

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_CLUSTER = re.compile(r"[+0-9][ ().0-9+-]{6,}")  # every address, card and phone number lies in one
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"\S+")
_MARKS = ".,;:!?\"'()[]{}<>|*_#%&$/\\=~^`-–—…«»„“”‚‘’¿¡"

Span = tuple[int, int, int]  # start, number of the kind, end


def _emails(text: str) -> Iterator[Span]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, 0, done
        at = text.find("@", at + 1)


def _addresses(text: str, start: int, end: int) -> Iterator[Span]:
    for chain in _NUMBERS.finditer(text, start, end):
        parts, at = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, 1, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _cards(text: str, start: int, end: int) -> Iterator[Span]:
    for found in _CARD.finditer(text, start, end):
        digits = _digits(found.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield found.start(), 2, found.end()


def _phones(text: str, start: int, end: int) -> Iterator[Span]:
    for found in _PHONE.finditer(text, start, end):
        if 9 <= len(_digits(found.group())) <= 15:
            yield found.start(), 3, found.end()


def base_spans(text: str) -> list[Span]:
    """Personal data that has a form of its own, by start and kind; in time linear in the text."""
    out = list(_emails(text))
    for cluster in _CLUSTER.finditer(text):
        at = cluster.span()
        for find in (_addresses, _cards, _phones):
            out.extend(find(text, *at))
    return sorted(out)


def _entity(text: str, span: Span) -> bytes:
    """What is protected: an address or number in whatever spelling."""
    start, kind, end = span
    value = text[start:end]
    value = value.lower() if kind == 0 else ".".join(p.lstrip("0") or "0" for p in value.split(".")) if kind == 1 else _digits(value)
    return xxhash.xxh3_128_digest(f"{kind}:{value}")


def bare(word: str) -> str:
    return word.strip(_MARKS).lower()


def contexts(text: str, spans: list[Span], window: int = WINDOW) -> list[tuple[bytes, str, int, int, int]]:
    """``(entity, term, start, end, context)`` for the words around each entity that aren't part of one."""
    if not spans:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    taken = set()
    for start, _, end in spans:
        taken.update(range(bisect_left(ends, start + 1), bisect_left(starts, end)))
    out = []
    for span in spans:
        first, last = bisect_left(ends, span[0] + 1), bisect_left(starts, span[2])
        near = [i for i in range(max(0, first - window), min(len(words), last + window)) if i not in taken]
        terms = [(bare(text[s:e]), s, e) for s, e in (words[i] for i in near)]
        terms = [t for t in terms if t[0]]
        context = xxhash.xxh3_64_intdigest("\n".join(t for t, _, _ in terms)) - (1 << 63)
        entity = _entity(text, span)
        for term, s, e in terms:
            word = text[s:e]
            s += len(word) - len(word.lstrip(_MARKS))
            out.append((entity, term, s, s + len(word.strip(_MARKS)), context))
    return out


_SPAN = "struct<s: long, k: int, e: long>"
_NEAR = "array<struct<entity: binary, term: string, s: long, e: long, context: long>>"


def scanned(docs: DataFrame, key: str, text: str, row: str, window: int) -> DataFrame:
    """``doc_id, row, base`` (spans), ``entities`` and ``near`` (terms beside them) of every row; no shuffle."""
    columns = docs.select(F.col(key).alias("doc_id"), F.col(row).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def step(ids, rows, texts):
        base = [base_spans(t) for t in texts]
        near = [contexts(t, b, window) for t, b in zip(texts, base, strict=True)]
        return {
            "doc_id": pa.array(ids, kind), "row": pa.array(rows, pa.int64()),
            "base": pa.array([[{"s": s, "k": k, "e": e} for s, k, e in b] for b in base], pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]))),
            "entities": pa.array([list({_entity(t, s) for s in b}) for t, b in zip(texts, base, strict=True)], pa.list_(pa.binary())),
            "near": pa.array([[dict(zip(("entity", "term", "s", "e", "context"), x, strict=True)) for x in n] for n in near],
                pa.list_(pa.struct([("entity", pa.binary()), ("term", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("context", pa.int64())]))),
        }

    kind = pa.string() if docs.schema[key].dataType.simpleString() == "string" else pa.int64()
    name = "string" if kind == pa.string() else "long"
    return store(map_batches(columns, step, f"doc_id {name}, row long, base array<{_SPAN}>, entities array<binary>, near {_NEAR}"), "scanned")


MEMO = 200_000  # words whose terms a task keeps in mind


def _holding(known):
    """Number of documents that hold each known term, summed over a batch."""

    def run(batches):
        memo: dict[str, str | None] = {}
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words = set(text.split())
                new = [w for w in words if w not in memo]
                if len(memo) + len(new) > MEMO:
                    memo, new = {}, list(words)
                for w in new:
                    term = bare(w)
                    memo[w] = term if term and known.value.has_one(xxhash.xxh64_intdigest(term, 42)) else None
                counts.update({memo[w] for w in words} - {None})
            yield pa.RecordBatch.from_pydict({"term": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    return run


def disclosing(docs: DataFrame, found: DataFrame, text: str, support: int, least: float) -> DataFrame:
    """``entity, term, disclosure`` of the terms that tell an entity.

    Over documents, ``PMI(term, entity) / IC(entity)`` with ``PMI = log2(N * both / (n(term) * n(entity)))`` and
    ``IC = log2(N / n(entity))``: the share of the entity's information that the term gives away, 1 where the term is
    never met without it. ``both`` counts documents in which they stand in one context. A term must stand in
    ``support`` different contexts of the entity, so copies of one text tell nothing.
    """
    near = found.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term", "x.context")
    pairs = near.select("entity", "term", "context").distinct().groupBy("entity", "term").count().where(F.col("count") >= support).select("entity", "term")
    pairs = store(pairs, "pairs")
    terms = store(pairs.select("term").distinct(), "terms")
    both = near.join(pairs, ["entity", "term"], "left_semi").select("row", "entity", "term").distinct().groupBy("entity", "term").agg(F.count("*").alias("both"))
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    known = docs.sparkSession.sparkContext.broadcast(HashFilter.of(terms.select(F.xxhash64("term").alias("h"))))
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")))
    holding = texts.mapInArrow(_holding(known), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    counted = both.join(entities, "entity").join(holding, "term").withColumn("n", F.lit(found.count()))
    disclosure = F.when(F.col("n") > F.col("n_entity"), 1 - F.log2(F.col("n_term") / F.col("both")) / F.log2(F.col("n") / F.col("n_entity"))).otherwise(0.0)
    return store(counted.select("entity", "term", disclosure.alias("disclosure")).where(F.col("disclosure") >= least), "disclosing")


def private_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None, window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``doc_id, row, base, terms``: per row of ``docs`` its base spans ``(s, k, e)`` and the terms ``(s, e, remove)`` that tell its entities.

    Entities are the values of the base spans. The corpus is read twice, once for spans and contexts and
    once to count the documents of the few terms that could tell something; contexts are of bounded
    size, so nothing grows faster than the text. Terms are only sought beside the entities of a
    document: a document without personal data has no spans.

    Null texts are empty. Repeated rows and ids come out repeated, ties can't arise, other columns don't matter, an
    empty table gives an empty table.
    """
    if row is None:
        row = next(name for name in ("row", *(f"row_{i}" for i in range(len(docs.columns) + 1))) if name not in docs.columns)
        docs = docs.withColumn(row, F.monotonically_increasing_id())
    found = scanned(docs, key, text, row, window)
    telling = disclosing(docs, found, text, support, generalise)
    near = found.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term", "x.s", "x.e")
    hits = near.join(telling, ["entity", "term"]).groupBy("row", "s", "e").agg(F.max("disclosure").alias("most"))
    terms = hits.groupBy("row").agg(F.collect_list(F.struct("s", "e", (F.col("most") >= remove).alias("remove"))).alias("terms"))
    none = F.expr("cast(array() as array<struct<s: long, e: long, remove: boolean>>)")
    return found.select("doc_id", "row", "base").join(store(terms, "terms"), "row", "left").select("doc_id", "row", "base", F.coalesce(F.array_sort("terms"), none).alias("terms"))


def digests(spans: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` from ``private_spans``."""
    names = F.array(*(F.lit(k) for k in (*KINDS, TERM)))

    def listed(column):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")

    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    terms = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e")))
    return spans.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", terms))).alias("spans"))


def general(word: str) -> str:
    """A word's form instead of the word."""
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]"


def masked(text: str, base: list[Span], terms: list[tuple[int, int, bool]]) -> str:
    """The text with the kinds of personal data in its place, telling terms generalised or removed; what overlaps goes together."""
    marks = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base] + [(s, e, "" if gone else general(text[s:e])) for s, e, gone in terms]
    out, done = [], 0
    for s, e, mark in sorted(marks):
        if s >= done:
            out += [text[done:s], mark]
        done = max(done, e)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with their columns, texts without personal data and without the terms that tell it. A null text stays null."""
    row = next(name for name in ("row", *(f"row_{i}" for i in range(len(docs.columns) + 1))) if name not in docs.columns)
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    spans = private_spans(numbered, key, text, row, **how).where((F.size("base") > 0) | (F.size("terms") > 0)).select("row", "base", "terms")
    hit = numbered.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text")).join(spans, "row")

    def step(rows, texts, base, terms):
        new = [masked(t, [(x["s"], x["k"], x["e"]) for x in b], [(x["s"], x["e"], x["remove"]) for x in m]) for t, b, m in zip(texts, base, terms, strict=True)]
        return {"row": pa.array(rows, pa.int64()), "masked": pa.array(new, pa.string())}

    new = store(map_batches(hit, step, "row long, masked string"), "masked")
    mask = next(name for name in ("masked", *(f"masked_{i}" for i in range(len(docs.columns) + 1))) if name not in docs.columns)
    joined = numbered.join(new.select(F.col("row").alias(row), F.col("masked").alias(mask)), row, "left")
    return joined.select(*(F.coalesce(mask, text).alias(c) if c == text else c for c in docs.columns))
