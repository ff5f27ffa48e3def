import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import disclosure
from tickloom.llm.disclosure import KINDS, base_spans, masked

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def by_patterns(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits)))
            good = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else None, 12 <= len(digits) <= 19 and total % 10 == 0, 9 <= len(digits) <= 15]
            if good[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


CASES = [
    "", "a@b", "a@b.c", "a@b.c@d.e", "x.y+z@a-b.co.uk, é@b.c", "@b.c a@@b.c a@b..c", "a@b.c.", "1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3.4.5.6.7", "256.1.1.1 1.1.1.256 001.002.003.004", "0.0.0.0000255",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  1111 1111 1111", "4111 1111 1111 1112", "0 0 0 0 0 0 0 0 0 0 0 0", "1" * 19, "1" * 25, "+1 (171) 555-2028", "+1 (171) 555", "+1(((((((", "++49 30 1234567-8)",
    "+1 171 555 20281234567890", "+12.34.56.78.90", "tel:+4930123456789x", "日本 4111 1111 1111 1111 日本 a@b.c", "+1 555 1234 567 +1 555 1234 567", "٣.٣.٣.٣",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_of_cases(text):
    assert base_spans(text) == by_patterns(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="012459 .-+()@ax%_é\n", max_size=60))
def test_base_spans_of_any_text(text):
    assert base_spans(text) == by_patterns(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+1 (171) 555-2028", ".", " ", "-", "9", "+", "@", "x"]), max_size=12))
def test_base_spans_of_neighbours(parts):
    assert base_spans("".join(parts)) == by_patterns("".join(parts))


def test_base_spans_of_the_given_documents(documents):
    for r in documents.collect():
        assert base_spans(r.text or "") == by_patterns(r.text or "")


@pytest.mark.parametrize("text", ["a" * 10**6 + "@", "1" * 10**6, "a@" * 300_000, "+" * 10**6, "+1((" * 200_000, "1." * 400_000, "1 " * 400_000, "a." * 500_000 + "@b"])
def test_linear_time(text):
    at = time.perf_counter()
    base_spans(text)
    assert time.perf_counter() - at < 8


def plainly(rows, window, support, generalise, remove):
    """Spans of the given texts with the counts in dictionaries."""
    texts = [t or "" for _, t in rows]
    base = [by_patterns(t) for t in texts]

    def value(t, s):
        v = t[s[0] : s[2]]
        return (s[1], v.lower() if s[1] == 0 else tuple(map(int, v.split("."))) if s[1] == 1 else re.sub("[^0-9]", "", v))

    near, both, holders = [], defaultdict(set), defaultdict(set)
    shown = defaultdict(set)
    for i, (t, spans) in enumerate(zip(texts, base, strict=True)):
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
        for s, e in words:
            holders[disclosure.bare(t[s:e])].add(i)
        free = {w for w in words if not any(w[0] < e and s < w[1] for s, _, e in spans)}
        for span in spans:
            before, after = [w for w in words if w[1] <= span[0]], [w for w in words if w[0] >= span[2]]
            own = [(disclosure.bare(t[s:e]), s, e) for s, e in before[len(before) - window if len(before) > window else 0 :] + after[:window] if (s, e) in free]
            own = [x for x in own if x[0]]
            for term, s, e in own:
                word = t[s:e]
                s += len(word) - len(word.lstrip(disclosure._MARKS))
                near.append((i, value(t, span), term, s, s + len(word.strip(disclosure._MARKS))))
                both[value(t, span), term].add(i)
                shown[value(t, span), term].add(tuple(x[0] for x in own))
    having = defaultdict(set)
    for i, (t, spans) in enumerate(zip(texts, base, strict=True)):
        for s in spans:
            having[value(t, s)].add(i)
    extra, n = defaultdict(dict), len(rows)
    for i, entity, term, s, e in near:
        if len(shown[entity, term]) >= support and n > len(having[entity]):
            told = 1 - math.log2(len(holders[term]) / len(both[entity, term])) / math.log2(n / len(having[entity]))
            if told >= generalise:
                extra[i][s, e] = max(told, extra[i].get((s, e), 0))
    out = []
    for i, ((doc, _), spans) in enumerate(zip(rows, base, strict=True)):
        def listed(spans):
            return ",".join(f"{(*KINDS, 'term')[k]}:{s}:{e}" for s, k, e in sorted(spans))

        counts = [sum(k == j for _, k, _ in spans) for j in range(4)]
        out.append((doc, *counts, hashlib.sha256(listed(spans).encode()).hexdigest(), listed(spans + [(s, 4, e) for s, e in extra[i]])))
    return sorted(out, key=repr)


def telling_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        own = [rng.choice(words) for _ in range(30)]
        if i % 10 == 0:
            own[10:10] = ["Alice", "(Smithson),", "alice@x.org", "director"]
        if i % 15 == 0:
            own[20:20] = ["ring", "+1 (171) 555-2028", "Bob"]
        if i % 25 == 0:
            own.append("director")
        rows.append((i, " ".join(own)))
    return rows + [rows[10]] * 50 + [(1000 + i, "secretword c@d.ef secretword") for i in range(20)] + [(2000, None), (2001, ""), (None, "a@b.c"), (2002, "x " * 20_000 + "a@b.c"), (2002, "1.2.3.4 " * 50)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "e", 2, "m") for i, t in rows], "doc_id long, text string, row long, entity string, n int, masked string").repartition(4)


@pytest.mark.parametrize("window, support", [(8, 3), (2, 2)])
def test_equals_plain_counting(spark, window, support):
    rows = telling_rows()
    got = rows_of(disclosure.digests(disclosure.private_spans(frame(spark, rows), window=window, support=support)))
    want = plainly(rows, window, support, 0.8, 0.95)
    assert got == want
    assert any("term" in r[-1] for r in want) and not any("term" in r[-1] for r in want if r[0] and 1000 <= r[0] < 2000)


def test_odd_and_empty_tables(odd_docs, odd_texts, no_docs):
    got = rows_of(disclosure.digests(disclosure.private_spans(odd_docs)))
    assert got == plainly(odd_texts, 8, 3, 0.8, 0.95)
    assert disclosure.digests(disclosure.private_spans(no_docs)).collect() == []
    assert disclosure.sanitise(no_docs).collect() == []


def test_masked_texts():
    assert masked("mail a@b.c now", [(5, 0, 10)], []) == "mail [EMAIL] now"
    assert masked("+1 171 555 2028 x", [(0, 3, 15), (3, 2, 15)], [(16, 17, True)]) == "[PHONE] "
    assert masked("Alice 7th x", [], [(0, 5, False), (6, 9, False), (10, 11, False)]) == "[NAME] [NUMBER] [WORD]"
    assert masked("", [], []) == ""


def test_sanitised_documents_tell_nothing(spark):
    rows = telling_rows()
    docs = frame(spark, rows)
    out = disclosure.sanitise(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = [r.text for r in out.collect()]
    assert not any(t and base_spans(t) for t in texts) and not any(t and "Smithson" in t for t in texts)
    clean = {(i, t) for i, t in rows if not base_spans(t or "")}
    assert clean <= {(r.doc_id, r.text) for r in out.collect()}
