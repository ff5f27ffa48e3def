import hashlib
import random

import pytest

from tickloom.llm import piecewise


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        other = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, new, following = (piecewise.fingerprint(t.encode()) for t in (text, other, after))
        out.append((doc, len(text), hashlib.sha256(other.encode()).hexdigest(), own, new, piecewise.likeness(own, new), piecewise.likeness(own, following)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fixture", ["odd_docs", "documents"])
def test_neighbours_and_edits_against_brute_force(request, fixture):
    docs = request.getfixturevalue(fixture)
    got = sorted((tuple(r) for r in piecewise.edit_resistance(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_none_one_and_two_rows(odd_docs, no_docs):
    assert piecewise.edit_resistance(no_docs).collect() == []
    one = odd_docs.where("doc_id = 7")
    assert [tuple(r) for r in piecewise.edit_resistance(one).collect()] == brute([(7, one.first().text)])
    two = odd_docs.where("doc_id in (7, 13)")
    assert sorted((tuple(r) for r in piecewise.edit_resistance(two).collect()), key=repr) == brute([(r.doc_id, r.text) for r in two.collect()])


def lcs_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_edit_distance_and_likeness():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(0, 70))] for _ in range(2))
        assert piecewise._edits(a, b) == lcs_edits(a, b)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "pi"]) + str(rng.randrange(99)) for _ in range(900))
    own = piecewise.fingerprint(text.encode())
    assert piecewise.likeness(own, own) == 1
    assert piecewise.likeness(own, piecewise.fingerprint(("new start " + text).encode())) > 0.9
    other = " ".join(str(rng.random()) for _ in range(300))
    assert piecewise.likeness(own, piecewise.fingerprint(other.encode())) < 0.2
    assert piecewise.likeness(piecewise.fingerprint(b""), own) == 0


def test_fingerprints_of_rows(odd_docs):
    got = {(r.doc_id, r.fingerprint) for r in piecewise.fingerprints(odd_docs).collect()}
    assert got == {(r.doc_id, piecewise.fingerprint((r.text or "").encode())) for r in odd_docs.collect()}
