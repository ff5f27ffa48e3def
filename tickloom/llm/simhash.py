"""SimHash near-duplicates: pivot distance tables (operator 1)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import HashFilter, components, map_batches, store, tidy, utf8

WIDTH, SEED = 4, 42  # words of a shingle, seed of its hash
DISTANCE = 4  # bits in which linked fingerprints may differ
BLOCKS, SAME = 7, 3  # of 7 blocks at least 3 agree where 4 bits differ
REFERENCES = 16
LARGE = 4096  # members from which on a bucket is dealt again by finer blocks
FINE, FINE_SAME = 8, 4  # the four other blocks of such a bucket, as 8 parts of which 4 agree
PART = 2048  # members of a shingle from which on it is split into parts
JOINED = 1024  # members up to which groups that hang together are compared as one
PARITY = 4096  # bits of the parities by which sets are told apart before they are compared
SAMPLE, FREQUENT = 20_000, 200_000  # texts whose shingles are counted, shingles whose counts are kept

_REFS = np.array([xxhash.xxh64_intdigest(b"reference %d" % i, SEED) for i in range(REFERENCES)], np.uint64)


def fingerprint(text: str | None) -> int:
    """64 bits, unsigned: bit set where over half of the shingle hashes have it; 0 without words."""
    words = utf8(text).lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(WIDTH)), strict=False) if len(words) >= WIDTH else [words]
    join, digest = b" ".join, xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(join(g), SEED) for g in grams), np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fp`` (signed long with the fingerprint's bits); one row per row of ``docs``, no shuffle."""

    def step(ids, texts):
        fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
        return {"doc_id": pa.array(ids, pa.int64()), "fp": pa.array(fps)}

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), step, "doc_id long, fp long")


def _cuts(bits: list[int], parts: int) -> list[np.uint64]:
    """Masks of ``parts`` nearly equal runs of the given bit numbers."""
    edges = np.linspace(0, len(bits), parts + 1).astype(int)
    return [np.uint64(sum(1 << b for b in bits[i:j])) for i, j in zip(edges, edges[1:], strict=False)]


def distances(fps: np.ndarray, mask: int = 2**64 - 1) -> np.ndarray:
    """Row per fingerprint, column per reference: Hamming distance to it within ``mask``."""
    return np.bitwise_count((fps[:, None] ^ _REFS) & np.uint64(mask))


def _packed(fps: np.ndarray, mask: np.uint64) -> np.ndarray:
    """The distances within a block of at most 15 bits, 4 bits each, as one number."""
    return (distances(fps, mask).astype(np.uint64) << (np.arange(REFERENCES, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64)


def _mix(h: np.ndarray, x) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


_MASKS = _cuts(list(range(64)), BLOCKS)
_TABLES = list(combinations(range(BLOCKS), SAME))


def _keys(fps: np.ndarray) -> np.ndarray:
    """Row per table, column per fingerprint: bucket from the reference distances of the table's blocks."""
    packed = [_packed(fps, m) for m in _MASKS]
    out = []
    for number, blocks in enumerate(_TABLES):
        h = np.full(len(fps), number + 1, np.uint64)
        for b in blocks:
            h = _mix(h, packed[b])
        out.append(h)
    return np.array(out)


def _fine_keys(fp: np.ndarray, table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Buckets within the bucket ``key`` of ``table``: the distances in 4 of 8 parts of its other blocks."""
    out = np.zeros((len(list(combinations(range(FINE), FINE_SAME))), len(fp)), np.uint64)
    for t in np.unique(table):
        at = table == t
        bits = [i for i in range(64) if not any(int(_MASKS[b]) >> i & 1 for b in _TABLES[t])]
        packed = [_packed(fp[at], m) for m in _cuts(bits, FINE)]
        for number, parts in enumerate(combinations(range(FINE), FINE_SAME)):
            h = _mix(key[at], np.uint64(number + 1))
            for p in parts:
                h = _mix(h, packed[p])
            out[number, at] = h
    return out


def _groups(fps: np.ndarray) -> list[np.ndarray]:
    """Members of a bucket that hang together: candidates by reference distances, survivors verified."""
    table, rest, found = distances(fps).astype(np.int8), np.arange(len(fps)), []
    while len(rest) > 1:
        group, at, rest = [rest[0]], 0, rest[1:]
        while at < len(group) and len(rest):
            x, at = group[at], at + 1
            near = np.abs(table[rest] - table[x]).max(1) <= DISTANCE
            near[near] = np.bitwise_count(fps[rest[near]] ^ fps[x]) <= DISTANCE
            group.extend(rest[near])
            rest = rest[~near]
        if len(group) > 1:
            found.append(fps[group])
    return found


def _bucket_edges(batches):
    for batch in batches:
        lists = batch.column(0)
        values, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sizes, a, b = np.diff(ends), [], []
        two = ends[:-1][sizes == 2]
        x, y = values[two], values[two + 1]
        near = np.abs(distances(x).astype(np.int8) - distances(y).astype(np.int8)).max(1, initial=0) <= DISTANCE
        near &= np.bitwise_count(x ^ y) <= DISTANCE
        a.append(x[near])
        b.append(y[near])
        for i in np.flatnonzero(sizes > 2):
            for group in _groups(values[ends[i] : ends[i + 1]]):
                a.append(group[:-1])  # a chain: as connected as all pairs, and no end has many edges
                b.append(group[1:])
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a).view(np.int64)), "b": pa.array(np.concatenate(b).view(np.int64))})


def near_links(fps: DataFrame) -> DataFrame:
    """``a, b``: edges that connect exactly the fingerprints which chains of links connect.

    ``fps`` has distinct ``fp``. Hamming distances to 16 reference fingerprints are tabulated per
    block of 9 or 10 bits, where they tell all values of a block apart. Fingerprints that differ in
    at most 4 bits have the same distances in at least 3 of 7 blocks, so one of 35 tables puts them in
    one bucket: no pair is missed. Within a bucket, pairs whose distances to any reference differ by
    more than 4 go, and the rest is verified bit by bit.

    Buckets of more than ``LARGE`` members are dealt again by the distances in 4 of 8 parts of their
    other blocks (complete by the same argument); at most 2**19 fingerprints can share such a bucket,
    whatever the size of the corpus.
    """

    def deal(batches):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for number, keys in enumerate(_keys(values)):
                yield pa.RecordBatch.from_pydict({"tab": pa.array(np.full(len(values), number, np.int32)), "key": pa.array(keys.view(np.int64)), "fp": batch.column(0)})

    def deal_again(batches):
        for batch in batches:
            tab, key, fp = (c.to_numpy() for c in batch.columns)
            for keys in _fine_keys(fp.view(np.uint64), tab, key.view(np.uint64)):
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "fp": batch.column(2)})

    dealt = fps.select("fp").mapInArrow(deal, "tab int, key long, fp long")
    large = store(dealt.groupBy("key").count().where(F.col("count") > LARGE).select("key"), "large")
    small = dealt.join(large, "key", "left_anti").select("key", "fp")
    again = dealt.join(large, "key").select("tab", "key", "fp").mapInArrow(deal_again, "key long, fp long")

    def edges(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        return lists.mapInArrow(_bucket_edges, "a long, b long")

    return edges(small).union(edges(again)).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Equal fingerprints collapse to one before the search; copies are never paired. A null or blank
    text has fingerprint zero and links like any other. ``component_id`` is the smallest ``doc_id``
    reachable, the row's own included; null ids are ignored there (a component of null ids alone has
    null). Repeated rows come out repeated. Other columns of ``docs`` don't matter. An empty table
    gives an empty table.
    """
    own = store(fingerprints(docs, text, key), "fingerprints")
    kinds = store(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "kinds")
    parts = components(near_links(kinds))
    joined = store(kinds.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "joined")
    least = store(joined.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = store(joined.join(least, "component").select("fp", "component_id"), "named")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(named, "fp").select("doc_id", shown, "component_id")


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text with fewer words is one shingle, a blank one has none."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    join, digest = b" ".join, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(join(g), SEED) for g in grams), np.uint64))


def _of_set(hashes: np.ndarray) -> int:
    """The fingerprint of distinct shingles, each counted once."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of sampled frequency and hash: sets that are similar enough share one of them."""
    known, counts = common
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    often = np.where(known[at] == hashes, counts[at], 0) if len(known) else np.zeros(len(hashes), np.int64)
    n = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1 if len(hashes) else 0
    return hashes[np.lexsort((hashes, often))[:n]]


def _frequent(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that most of some ``SAMPLE`` texts share, and in how many they are. They set an order, no result depends on them."""

    def step(texts):
        return {"h": pa.array(np.concatenate([np.zeros(0, np.uint64), *(shingles(t, width) for t in texts)]).view(np.int64))}

    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = map_batches(docs.select(F.col(text).cast("string")).where(F.rand(SEED) < share), step, "h long")
    rows = some.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    known, counts = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r["count"] for r in rows], np.int64)
    order = np.argsort(known)
    return known[order], counts[order]


def _odd(hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each of ``bits`` (a power of two) slots of a set's hashes whether an odd number falls into it, as 64-bit words.

    Where two sets differ in a bit, a hash is in one of them alone, so they differ in at least as many hashes as bits.
    """
    slots = (hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=bits) & 1, bitorder="little").view("<u8").astype(np.uint64)


def _close(odds: np.ndarray, sizes: np.ndarray, x: int, among: np.ndarray, similarity: float) -> np.ndarray:
    """Which of ``among`` can be similar to member ``x`` by set size and parities: none that is similar is left out."""
    least, most = np.minimum(sizes[among], sizes[x]), np.maximum(sizes[among], sizes[x])
    near = least + 1e-9 >= similarity * most
    apart = np.bitwise_count(odds[among[near]] ^ odds[x]).sum(1, dtype=np.int64)
    near[near] = apart * (1 + similarity) <= (1 - similarity) * (least + most)[near] + 1e-9
    return near


def _spread(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[list[int]]:
    """The groups of ``n`` members that hang together by ``linked(x, others)``, without those of one."""
    rest, found = np.arange(n), []
    while len(rest) > 1:
        group, at, rest = [int(rest[0])], 0, rest[1:]
        while at < len(group) and len(rest):
            near = linked(group[at], rest)
            group.extend(rest[near].tolist())
            rest, at = rest[~near], at + 1
        if len(group) > 1:
            found.append(group)
    return found


def similar_links(docs: DataFrame, key: str, text: str, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``row, first`` (the least row with the same shingles) of every row, and edges ``a, b`` between firsts that connect
    exactly those which chains of pairs of Jaccard similarity ``similarity`` or more connect, however far apart their fingerprints are.

    A set's least frequent shingles, as many as a similar set can lack and one more, are its keys (prefix filter), so each
    similar pair meets under a key. Under a key, members are parted by set size and parities (``_close``), equal groups
    collapse, and the shingles of the texts of a group are compared exactly. Keys of more than ``PART`` members are
    split, and every pair of parts is a group: complete, but quadratic in a key's parts.

    The near ones of all, whose fingerprints differ in at most ``DISTANCE`` bits, are found by the pivot tables (``near_links``) and compared
    likewise. Groups that hang together, up to ``JOINED`` rows in all, become one, so each text is moved and
    cut into shingles once; of larger ones, each group is compared by itself. Only texts of rows in a group are moved.
    """
    spark = docs.sparkSession
    common = _frequent(docs, text, width)

    def sketch(rows, texts):
        sets = [shingles(t, width) for t in texts]
        return {
            "row": pa.array(rows, pa.int64()), "same": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), "n": pa.array([len(s) for s in sets], pa.int32()),
            "fp": pa.array(np.fromiter(map(_of_set, sets), np.uint64, len(sets)).view(np.int64)), "odd": pa.array([int(_odd(s, 64).view(np.int64)[0]) for s in sets], pa.int64()),
            "keys": pa.array([_prefix(s, common, similarity).view(np.int64) for s in sets], pa.list_(pa.int64())),
        }

    texts = docs.select(F.col(key).alias("row"), F.col(text).cast("string").alias("text"))
    own = store(map_batches(texts, sketch, "row long, same binary, n int, fp long, odd long, keys array<long>"), "sketches")
    firsts = store(own.groupBy("same").agg(F.min("row").alias("first")), "firsts")
    kinds = own.join(firsts.select(F.col("first").alias("row")), "row", "left_semi")
    # Most keys stand in one text only. Keys are counted by themselves, and only texts with a key that others have are dealt out.
    counts = store(kinds.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    shared = spark.sparkContext.broadcast(HashFilter.of(counts, "key", 26))

    def deal(batches):
        for batch in batches:
            keys, ends = batch.column("keys").flatten().to_numpy(), batch.column("keys").offsets.to_numpy()
            keep = np.flatnonzero(shared.value.has(keys.view(np.uint64)))
            own = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends))[keep])
            columns = {name: batch.column(name).take(own) for name in ("row", "n", "odd")}
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[keep]), **columns})

    dealt = kinds.select("row", "n", "odd", "keys").mapInArrow(tidy(deal), "key long, row long, n int, odd long").select("key", F.struct("row", "n", "odd").alias("member"))
    parts = counts.select("key", F.ceil(F.col("m") / PART).alias("parts"))
    lists = dealt.join(parts, "key").groupBy("key", "parts", F.pmod(F.xxhash64("member.row"), "parts").alias("part")).agg(F.collect_list("member").alias("members"))
    small = lists.where("parts = 1").select("members")
    many = store(lists.where("parts > 1").select("key", "part", "members"), "many")
    other = many.select("key", F.col("part").alias("part_b"), F.col("members").alias("members_b"))
    crossed = many.join(other, "key").where("part <= part_b").select(F.when(F.col("part") == F.col("part_b"), F.col("members")).otherwise(F.concat("members", "members_b")).alias("members"))

    def narrow(batches):
        for batch in batches:
            lists, groups = batch.column(0), []
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            rows, sizes, odds = flat.field("row").to_numpy(), flat.field("n").to_numpy(), flat.field("odd").to_numpy().view(np.uint64)[:, None]
            for i, j in zip(ends, ends[1:], strict=False):
                if j - i > 1:
                    groups += [np.sort(rows[i:j][g]) for g in _spread(j - i, lambda x, among, i=i, j=j: _close(odds[i:j], sizes[i:j], x, among, similarity))]
            yield pa.RecordBatch.from_pydict({"rows": pa.array(groups, pa.list_(pa.int64()))})

    # Rows of one fingerprint, and the least rows of fingerprints that the pivot tables link, are candidates too.
    faces = store(kinds.select("row", "fp"), "faces")
    least = store(faces.groupBy("fp").agg(F.min("row").alias("least")), "least")
    ends = near_links(least).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    pivoted = ends.select(F.array(F.least("x", "y"), F.greatest("x", "y")).alias("rows"))
    equal = faces.join(least, "fp").where("row <> least").select(F.array("least", "row").alias("rows"))
    groups = store(small.union(crossed).mapInArrow(tidy(narrow), "rows array<long>").union(pivoted).union(equal).distinct(), "groups")
    behind = [F.slice("rows", at, F.size("rows") - 1) for at in (1, 2)]
    chains = groups.select(F.explode(F.zip_with(*behind, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("c")).select("c.a", "c.b")
    whole = store(components(chains), "whole")
    sizes = whole.groupBy("component").agg((F.count("*") > JOINED).alias("large"))
    placed = store(whole.join(sizes, "component").select("node", "component", "large"), "placed")
    apart = groups.withColumn("node", F.col("rows")[0]).join(placed.where("large").select("node"), "node", "left_semi")
    members = apart.select(F.xxhash64("rows").alias("group"), F.explode("rows").alias("row"))  # two groups under one number do no harm
    members = members.union(placed.where("not large").select(F.xxhash64("component").alias("group"), F.col("node").alias("row")))
    meant = spark.sparkContext.broadcast(HashFilter.of(placed.select(F.xxhash64("node").alias("h")), most=26))

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(meant.value.has(batch.column(0).to_numpy().view(np.uint64)))).select([1, 2])

    needed = texts.select(F.xxhash64("row").alias("h"), "row", "text").mapInArrow(tidy(pick), "row long, text string")
    filled = store(members, "members").join(needed, "row").select("group", "row", "text")

    def verify(batches):
        def edges(held):
            rows, sets = np.array([r for r, _ in held]), [shingles(t, width) for _, t in held]
            odds = np.array([_odd(s, PARITY) for s in sets])
            sets = [frozenset(s.tolist()) for s in sets]
            sizes = np.array([len(s) for s in sets])

            def linked(x, among):
                near = _close(odds, sizes, x, among, similarity)
                both = np.array([len(sets[x] & sets[y]) for y in among[near]], np.int64)
                near[near] = both + 1e-9 >= similarity * (sizes[x] + sizes[among[near]] - both)
                return near

            pairs = [pair for g in _spread(len(rows), linked) for pair in zip(rows[g[:-1]].tolist(), rows[g[1:]].tolist(), strict=True)]
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

        held, current = [], None
        for batch in batches:
            for group, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != current and held:
                    yield edges(held)
                    held = []
                current = group
                held.append(member)
        if held:
            yield edges(held)

    links = filled.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(verify), "a long, b long").distinct()
    return own.select("row", "same").join(firsts, "same").select("row", "first"), links


def keep_one(docs: DataFrame, text: str = "text", width: int = WIDTH, bits: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns, less all but the first row of each group of near duplicates.

    Without ``similarity``, rows are linked by the law of ``near_duplicates``, which ``width`` and ``bits`` don't change;
    with it, by the similarity of their sets of shingles of ``width`` words alone: no pair is left out for its fingerprints, whatever ``bits`` is. Rows are numbered in a stored copy, so null and repeated ids need no care.
    """
    row = next(name for name in ("row", *(f"row_{i}" for i in range(len(docs.columns) + 1))) if name not in docs.columns)
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    if similarity is None:
        if (width, bits) != (WIDTH, DISTANCE):
            raise ValueError("width and bits are those of the contract unless a similarity is given")
        near = near_duplicates(numbered, text, row)
        gone = near.where("doc_id <> component_id").select(F.col("doc_id").alias(row))
    else:
        firsts, links = similar_links(numbered, row, text, width, similarity)
        named = firsts.join(components(links).withColumnRenamed("node", "first"), "first", "left")
        gone = named.where(F.col("row") != F.coalesce("component", "first")).select(F.col("row").alias(row))
    return numbered.join(store(gone, "gone"), row, "left_anti").select(*docs.columns)
