import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from conftest import rows_of

from tickloom.llm import conversations
from tickloom.llm.conversations import INSERTED, TRUNCATED, joined, parsed, terminal

INITIALS, FAULTS = ["s", "u", "a", "t", " ", ""], ["", "truncated", "blank", "duplicate"]
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_search(rows, most=3):
    """Every way to edit, with up to ``most`` insertions at each place."""
    found = []
    ways = []
    for initial, fault in rows:
        own = [("D", "", 3)]
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED * (fault == "truncated")
            own += [("K", initial or "-", extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        ways.append(own)
    inserts = [("I" * n, s, 2 * n) for n in range(most) for s in map("".join, product("ua", repeat=n))]
    for chosen in product(inserts, *(product(w, inserts) for w in ways)):
        parts = [chosen[0], *(x for pair in chosen[1:] for x in pair)]
        if re.fullmatch("(s?(ua)+)?", "".join(p[1] for p in parts)):
            found.append((sum(p[2] for p in parts), "".join(p[0] for p in parts)))
    return min(found)


def by_all_splits(rows):
    """The cubic table: every span, every split."""
    n = len(rows)
    cells = {(i, i + 1): terminal(*rows[i]) for i in range(n)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            ways = [joined(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
            cells[i, i + size] = tuple(min(filter(None, at), default=None) for at in zip(*ways, strict=True))
    cell = cells.get((0, n), INSERTED)
    return min(cell[q] for q in (0, 3) if cell[q])


def by_rows(rows):
    """One row after another over the states of the pattern."""
    steps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def filled(best):
        for _ in range(3):
            for s in "ua":
                for p, q in steps[s].items():
                    if p in best:
                        way = (best[p][0] + 2, best[p][1] + "I")
                        best[q] = min(way, best.get(q, way))
        return best

    best = filled({0: (0, "")})
    for initial, fault in rows:
        new = {}
        extra = int(fault == "truncated")
        for p, (cost, audit) in best.items():
            ways = [(p, cost + 3, "D")]
            if fault not in ("blank", "duplicate"):
                ways += [(steps[initial][p], cost + extra, "K")] if p in steps.get(initial, {}) else []
                ways += [(steps[s][p], cost + 2 + extra, "R") for s in "ua" if p in steps[s]]
            for q, c, e in ways:
                new[q] = min((c, audit + e), new.get(q, (c, audit + e)))
        best = filled(new)
    return min(best[q] for q in (0, 3) if q in best)


def test_cheapest_of_all_ways():
    for rows in product(product(INITIALS[:4], FAULTS[:3]), repeat=2):
        assert parsed(list(rows)) == by_search(rows)
    assert parsed([]) == (0, "")
    rng = random.Random(1)
    for _ in range(15):
        rows = [(rng.choice(INITIALS), rng.choice(FAULTS)) for _ in range(3)]
        assert parsed(rows) == by_search(rows, 2) or by_search(rows, 2)[0] > parsed(rows)[0]


def test_any_split_gives_the_same():
    rng = random.Random(2)
    for n in [*range(9), 20, 33]:
        for _ in range(12 if n < 10 else 2):
            rows = [(rng.choice(INITIALS), rng.choice(FAULTS)) for _ in range(n)]
            assert parsed(rows) == by_all_splits(rows) == by_rows(rows)


def test_long_conversation():
    rng = random.Random(3)
    rows = [(rng.choice("ssuuuaaat"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(5000)]
    assert parsed(rows) == by_rows(rows)


def plainly(rows, names, damaged=False):
    """Conversation by conversation, row by row."""
    after = {n: [] for n in names}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = 99 if damaged else zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(d, text)
        after[conv] += [(turn, "user" if d == 4 else role, text)] * {0: 0, 3: 2}.get(d, 1)
    out = []
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:32].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults, turns = set(), [], {r[0] for r in own} - {None}
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        cost, audit = by_rows([(r[1][:1], f) for r, f in zip(own, faults, strict=True)])
        lines, left, last = [], iter(own), "-"
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(left)
            if edit != "D":
                role = role if edit == "K" else "assistant" if last == "u" else "user"
                last = role[0]
                lines.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, pos long, kind string, cell int"


def odd_rows():
    rng = random.Random(4)
    texts = [None, "", " \t\n", "ok.", "ok", "same.", "Same!  \n", "é? ", "x" * 50_000, "last. ", ":", "a:b\nc."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "Émile", "super"]
    rows = [(i % 40 if i % 41 else None, rng.choice([None, 0, 1, 2, 3, 5, 9, -4]), rng.choice(roles), rng.choice(texts)) for i in range(400)]
    rows += [(100 + i, 0, "user", "alone.") for i in range(60)]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"row {t % 50}.") for t in range(3000)]
    return rows + rows[:20]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in odd_rows()], SCHEMA).repartition(5)


def test_digests_equal_a_plain_repair(odd, monkeypatch):
    rows = odd_rows()
    names = {r[0] for r in rows}
    assert rows_of(conversations.inspect(conversations.damage(odd), odd)) == plainly(rows, names)


def test_rows_without_damage(odd):
    rows = [(c, t, r or " ", " " if x is None else x) for c, t, r, x in odd_rows() if r != ""]
    given = odd.where("role is null or role <> ''").fillna(" ", ["role", "text"])
    assert rows_of(conversations.inspect(given)) == plainly(rows, {r[0] for r in rows}, damaged=True)


def test_repaired_rows_are_legal_and_agree_with_the_digest(odd):
    rows = conversations.damage(odd)
    said = {r.conv_id: r for r in conversations.inspect(rows, odd).collect()}
    lines = {}
    for r in sorted(conversations.repair(rows).collect(), key=lambda r: (repr(r.conv_id), r.place)):
        lines.setdefault(r.conv_id, []).append(r)
    for conv, verdict in said.items():
        own = lines.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own))
        assert [r.edit for r in own] == [e for e in verdict.audit if e != "D"]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == verdict.repaired_sha256


def test_a_conversation_lies_in_several_tasks(spark):
    rows = spark.range(20_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat(id, '.') as text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        assert conversations._placed(rows).selectExpr("shiftright(pos, 33) as part").distinct().count() > 1
        got = conversations.inspect(rows).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (got.gaps, got.cost, got.audit) == (0, 0, "K" * 20_000)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert conversations.inspect(conversations.damage(none), none).collect() == []
    assert conversations.repair(none).collect() == []
    assert conversations.inspect(conversations.damage(odd), odd).columns == COLUMNS
