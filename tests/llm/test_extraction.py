import html
import re
import time

import numpy as np
import pytest

from tickloom.llm import extraction

SF = "/root/testdata/sf0.001"


def test_articles_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(filter(None, parts))
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


PAGE = """<!doctype html><HTML><head><title>No</title><style>p{}</style></head><body class="page ad-free">
<header>Top</header><nav><ul><li>Home<li>News</ul></nav><div id="cookie-notice">We use cookies</div>
<main><article class="post"><header><h1>A &amp; B&nbsp;C</h1></header><p>First   line<br>second<p>Third &lt;tag&gt; <b>bold</b><script>if (a < b) {x = "</p>"}</script>
<aside>See also</aside><div class="advert-box">Buy</div><form>Name <input> <button>Send</button></form><ul><li>one<li>two</ul>
<table><tr><td>x<td>y</table><pre>a
 b</pre><!-- hidden <p>no</p> --></article><section class="comments"><article class="comment"><p>Nice</p></article></section></main>
<aside class="sidebar">Side</aside><footer>&copy; me</footer></body></html>"""


def test_structure():
    got = extraction.main_texts([extraction.blocks(PAGE)])[0]
    assert got == "A & B C\n\nFirst line second\n\nThird <tag> bold\n\none\n\ntwo\n\nx\n\ny\n\na b"


def test_host_boilerplate_without_an_article():
    menu = "<div>home about contact terms of service and our privacy page</div>"
    own = ["<p>" + " ".join(f"w{k}x{i}" for i in range(15)) + "</p>" for k in range(4)]
    pages = [extraction.blocks(menu + p) for p in own]
    assert extraction.main_texts(pages) == [re.sub("</?p>", "", p) for p in own]
    copies = [extraction.blocks(menu + own[0]), extraction.blocks(menu + own[0]), extraction.blocks(menu + own[1])]
    assert extraction.main_texts(copies)[0] == re.sub("</?p>", "", own[0])


def brute(streams, run):
    out = []
    for s in streams:
        n = [1] * len(s)
        for i in range(len(s) - run + 1):
            shared = sum(any(t[j : j + run] == s[i : i + run] for j in range(len(t) - run + 1)) for t in streams)
            n[i : i + run] = [max(shared, x) for x in n[i : i + run]]
        out.append(n)
    return out


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(0)
    for run in (1, 3, 8):
        streams = [rng.integers(0, 3, rng.integers(0, 40)).tolist() for _ in range(8)]
        got = extraction.repeated([np.array(s, np.int64) for s in streams], run)
        assert [g.tolist() for g in got] == brute(streams, run)
    assert extraction.repeated([]) == []


def test_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(extraction, "PAGES", 2)
    rows = [(1, "http://a.b/c", None), (2, None, ""), (None, "nonsense", "<p>text"), (4, "http://A.b", "<p>x"), (4, "http://A.b", "<p>x"), (5, "http://a.b", "<" * 50), (6, "http://a.b", "<div " + "a" * 20_000), (7, "u", "<article>" + "<p>w" * 5000), (8, "u", "plain &amp; simple"), (9, "u", "<script>never closed"), (10, "u", "</p></div></article>t")]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, array int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extraction.extract(df).collect()), key=repr)
    assert all(n == len(t) for *_, t, n in got)
    texts = {(i, u): t for i, u, t, _ in got}
    assert len(got) == len(rows) and texts[1, "http://a.b/c"] == "" == texts[2, None] == texts[9, "u"]
    assert texts[None, "nonsense"] == "text" and texts[4, "http://A.b"] == "x" and texts[8, "u"] == "plain & simple" and texts[10, "u"] == "t"
    assert texts[7, "u"] == "\n\n".join(["w"] * 5000)
    assert extraction.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("page", ["<a " * 330_000, "<a href=\"x>" * 90_001, "<a '" * 250_000, "<" * 10**6, "<!" * 500_000, "<p>" * 300_000, "<a \"'" * 200_000, "<a b='<" * 150_000 + ">"])
def test_tags_that_do_not_close_take_linear_time(page):
    at = time.perf_counter()
    extraction.blocks(page)
    assert time.perf_counter() - at < 10


def test_tags_that_do_not_close_are_text():
    text = lambda page: " | ".join(t for _, t in extraction.blocks(page))
    assert text("<p>a</p><p>b <i c") == "a | b <i c"
    assert text("a < b and c > d") == "a < b and c > d"
    assert text('<p title="x>y">a</p><b q=\'">\'>c') == "a | c"
    assert text('<p>a <i "b <u>c</u>') == 'a <i "b c'
    assert text("a<!-- b") == "a" and text("a<!b") == "a<!b" and text("<?x?>a") == "a"


def test_runs_decide_on_named_parts_of_an_article():
    own = lambda k, c: " ".join(f"{c}{k}y{i}" for i in range(12))
    bar = "share this page with friends by mail post or phone"
    page = lambda k: extraction.blocks(f'<article><p>{own(k, "w")}</p><div class="share price">{own(k, "s")}</div><p class="notice period">{own(k, "n")}<div class="share">{bar}</div><div class="ad">{own(k, "a")}</div></article>')
    want = [f"{own(k, 'w')}\n\n{own(k, 's')}\n\n{own(k, 'n')}" for k in range(4)]
    pages = [page(k) for k in range(4)]
    assert extraction.main_texts(pages) == want
    assert extraction.main_texts([*pages, pages[0]]) == [*want, want[0]]  # a copy's text is no more repeated than its article
    assert extraction.main_texts(pages[:1]) == [own(0, "w")]  # nothing to compare with: the name decides


def test_runs_decide_without_an_article_but_in_main(monkeypatch):
    own = lambda k, c: " ".join(f"{c}{k}y{i}" for i in range(12))
    pages = [extraction.blocks(f'<main><p>{own(k, "w")}</p><div id="notice">{own(k, "n")}</div><div id="cookie-notice">{own(0, "c")}</div></main>') for k in range(3)]
    assert extraction.main_texts(pages) == [f"{own(k, 'w')}\n\n{own(k, 'n')}" for k in range(3)]
    monkeypatch.setattr(extraction, "repeated", lambda streams: [np.ones(len(s), np.int64) for s in streams])
    assert extraction.main_texts(pages) == [f"{own(k, 'w')}\n\n{own(k, 'n')}\n\n{own(0, 'c')}" for k in range(3)]


def test_runs_are_counted_over_all_pages_of_a_host(spark, monkeypatch):
    """A run on two of a host's pages is found though they fall into different arrays."""
    monkeypatch.setattr(extraction, "PAGES", 2)
    own = lambda k, c: " ".join(f"{c}{k}y{i}" for i in range(12))
    rare = lambda k, c: " ".join(f"{c}{k // 2}z{i}" for i in range(10))  # on two pages
    rows = []
    for h in range(3):
        for k in range(16):
            named = f'<article><p>{own(k, "w")}</p><p class="notice">{rare(k, "n")}</p><p class="notice">{own(k, "s")}</p></article>'
            plain = f'<div>{rare(k, "m")}</div><p>{own(k, "v")}</p>'
            rows.append((len(rows), f"http://h{h}.org/{k}", (named, plain, f"<article><p>{own(k, 'u')}</p></article>")[h]))
    rows += [(100, "http://small.org/1", f'<article><p>{own(1, "w")}</p><p class="notice">{own(1, "s")}</p></article>')]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows)
    hosts = [rows[:16], rows[16:32], rows[32:48], rows[48:]]
    want = {i: t for host in hosts for (i, *_), t in zip(host, extraction.main_texts([extraction.blocks(r[2]) for r in host]), strict=True)}
    assert got == want
    assert got[0] == f"{own(0, 'w')}\n\n{own(0, 's')}" and got[16] == own(0, "v") and got[100] == own(1, "w")
