"""Main text of web pages: markup structure and host suffix arrays (operator 8)."""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import HashFilter, store, utf8

RUN = 8  # tokens from which on a repeated run counts
PAGES = 256  # pages of a host whose token streams make one array, about
_MAIN = {"s": "a", "t": "m"}  # where a block stands whose class or id alone speaks against it
COVERED = 0.8  # share of a block's tokens in repeated runs from which on it is boilerplate

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile("[>\"']")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "xmp")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_OUT = set("head nav footer aside form button menu dialog object canvas fieldset".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = re.compile(
    r"(?:ads?|adbox|adslot|adunit|advert\w*|sponsor\w*|promo\w*|banner\w*|side(?:bar)?|sidebar\w*|menu\w*|nav|navbar|navigation|topnav|breadcrumbs?|cookies?|consent|gdpr|notices?"
    r"|disclaimer|popup|modal|overlay|newsletter|subscri\w+|signup|login|social|shar(?:e|ing)|related|recommend\w*|comments?|commentlist|disqus|repl(?:y|ies)|footer|footnav|pagination|pager|widget|toolbar|masthead)"
)
#: Of these, what a host repeats on its pages; inside an article a name like "share price" may be text, which the array tells.
_REPEATED = re.compile(
    r"(?:banner\w*|menu\w*|nav|navbar|navigation|topnav|cookies?|consent|gdpr|notices?|disclaimer|popup|modal|overlay|newsletter|subscri\w+|signup|login|social|shar(?:e|ing)|footer|footnav|pagination"
    r"|pager|widget|toolbar|masthead)"
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class _Tags:
    """The tags of a page one after another, in time linear in the page.

    A tag ends at the next ``>`` outside quotes. One that doesn't end is text: if there is no ``>`` any more, with all that
    follows; if one of its quotes doesn't close, up to that quote.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}

    def _end(self, at: int) -> tuple[int, int]:
        """Where the tag whose name ends at ``at`` ends (or -1), and from where to go on if it doesn't."""
        while at <= self.last[">"]:
            stop = _STOP.search(self.page, at)
            if stop[0] == ">":
                return stop.start(), 0
            if stop.start() == self.last[stop[0]]:
                return -1, stop.end()
            at = self.page.find(stop[0], stop.end()) + 1
        return -1, len(self.page)

    def next(self, at: int) -> tuple[int, int, str, str, bool]:
        """``(start, end, name, attributes, closing)`` of the next tag; without a name for comments and the like; start -1 at the end."""
        page, find = self.page, at
        while m := _OPEN.search(page, find):
            if m[2]:
                end, find = self._end(m.end())
                if end >= 0:
                    return m.start(), end + 1, m[2].lower(), page[m.end() : end], bool(m[1])
            elif m[0] == "<!--":
                end = page.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else len(page), "", "", False
            elif (end := page.find(">", m.end())) >= 0:
                return m.start(), end + 1, "", "", False
            else:
                break
        return -1, len(page), "", "", False


def _outside(tag: str, attrs: str, inside: bool) -> str:
    """``x`` if an element is other than main text by its tag, role, class or id; ``s`` inside main text if its class or id
    alone says so, by words for what a host repeats; else nothing."""
    if tag in _OUT or tag == "header" and not inside:
        return "x"
    if not attrs.strip():
        return ""
    named = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
    if "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", ""):
        return "x"
    if named.get("role") in _ROLES and not (named["role"] == "banner" and inside):
        return "x"
    words = re.split(r"[^a-z0-9]+", f"{named.get('class', '')} {named.get('id', '')}")
    if tag in ("html", "body", "article", "main"):
        return "x" if tag == "article" and any(w.startswith("comment") for w in words) else ""
    found = [w for w in words if _WORDS.fullmatch(w)]
    return "" if not found else "s" if inside and all(map(_REPEATED.fullmatch, found)) else "x"


def blocks(page: str | None) -> list[tuple[str, str]]:
    """``(region, text)`` of every visible block in page order: ``a`` in an article, ``m`` in a main element, ``b``
    elsewhere in the body, ``x`` in a part that is not main text, ``s`` (in an article) or ``t`` (in a main element) in one that
    is not by its class or id alone. White space is one space, references are decoded."""
    page = page or ""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements that matter, with the region inside
    region, parts, at, tags = "b", [], 0, _Tags(page)

    def flush() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((region, text))
            parts.clear()

    while True:
        start, end, tag, attrs, closing = tags.next(at)
        parts.append(page[at:start] if start >= 0 else page[at:])
        if start < 0:
            break
        at = end
        if not tag:
            continue
        if closing:
            if tag in _BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    del stack[i:]
                    region = stack[-1][1] if stack else "b"
                    break
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if tag == "body":  # an unclosed head ends here
            stack, region = [e for e in stack if e[0] != "head"], "b"
        away = "x" if region == "x" else _outside(tag, attrs, region in "amst")
        inner = "x" if away == "x" else region if region in "st" else "st"[region == "m"] if away else "a" if tag == "article" or region == "a" else "m" if tag == "main" or region == "m" else "b"
        if inner != region or tag in ("article", "main") or any(e[0] == tag for e in stack):
            if inner != region:
                flush()
            if not attrs.endswith("/"):
                stack.append((tag, inner))
                region = inner
    flush()
    return out


def suffixes(streams: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, ...]:
    """``text, page, number, count, first, whole`` of some pages' token numbers, one after another as ``text``: of each position
    its page, the number of the run of ``run`` tokens that begins there and whether the page has so many left; of each run on how many pages it is and a position of it.

    The suffixes are sorted by prefix doubling, as deep as the shortest run that
    counts; suffixes with the same rank there begin with the same run. Runs don't cross pages.
    """
    sizes = np.array([len(s) for s in streams])
    text = np.concatenate(streams).astype(np.int64)
    page = np.repeat(np.arange(len(streams)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)  # where the page of a position ends
    rank, depth = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.where(np.arange(len(text)) + step < ends, np.r_[rank[step:], np.zeros(step, np.int64)][: len(text)] + 1, 0)
        rank, depth = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)[1], depth + step
    order = np.argsort(rank, kind="stable")  # the suffix array to that depth, by page within equal runs
    new = np.r_[True, (rank[order][1:] != rank[order][:-1])]
    other = np.r_[True, new[1:] | (page[order][1:] != page[order][:-1])]
    number = np.empty(len(text), np.int64)
    number[order] = np.cumsum(new) - 1
    count = np.bincount(number[order], other).astype(np.int64)
    return text, page, number, count, order[new], np.arange(len(text)) + run <= ends


def repeated(streams: list[np.ndarray], run: int = RUN, elsewhere: Callable | None = None) -> list[np.ndarray]:
    """For each page's token numbers: on how many pages the most shared run of ``run`` tokens over a token is (1: unique).

    Runs are counted on the pages given, or, where ``elsewhere(text, positions)`` knows more pages with the run at a position, on those.
    """
    if not streams:
        return []
    if not sum(map(len, streams)):
        return [np.zeros(0, np.int64) for _ in streams]
    text, page, number, pages, first, whole = suffixes(streams, run)
    if elsewhere is not None:
        at = np.flatnonzero(whole[first])
        pages[at] = np.maximum(pages[at], elsewhere(text, first[at]))
    count = np.where(whole, pages[number], 1)  # not too near the page's end for a run
    cover = count.copy()
    for i in range(1, run):  # a run covers the tokens after its first
        np.maximum(cover[i:], np.where(page[i:] == page[:-i], count[:-i], 1), out=cover[i:])
    return np.split(cover, np.cumsum([len(s) for s in streams])[:-1])


def _streams(pages: list[list[tuple[str, str]]]) -> tuple[list[np.ndarray], list[str]]:
    """The token numbers of pages by their blocks, and the tokens; number 0 ends a block."""
    numbers: dict[str, int] = {"": 0}
    streams = []
    for page in pages:
        words = [w for _, text in page for w in (*text.split(" "), "")]
        streams.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
    return streams, list(numbers)


def _digests(text: np.ndarray, at: np.ndarray, words: list[str], host: str) -> np.ndarray:
    """Two 64-bit numbers for the run of ``RUN`` tokens at each position, the same for the same tokens on pages of the same host."""
    out = np.empty((2, len(at)), np.uint64)
    for seed, total in enumerate(out, 1):
        of_word = np.fromiter((xxhash.xxh64_intdigest(utf8(w), seed) for w in words), np.uint64, len(words))
        total[:] = xxhash.xxh64_intdigest(utf8(host), seed)
        for i in range(RUN):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += of_word[text[at + i]]
    return out.view(np.int64)


def _asks(page: list[tuple[str, str]]) -> bool:
    """Whether runs decide on a part of a page, as ``main_texts`` has it."""
    regions = {_MAIN.get(r, r) for r, _ in page}
    if best := next((r for r in "am" if r in regions), None):
        return any(_MAIN.get(r) in (best, "a") and text.count(" ") + 1 >= RUN for r, text in page)
    return any(r == "b" for r, _ in page)


def main_texts(pages: list[list[tuple[str, str]]], elsewhere: Callable | None = None) -> list[str]:
    """The main text of each of the pages of a host, by their blocks. If these are some of its pages only, ``elsewhere(words, text, positions)`` tells
    on how many of all the runs at these positions are, as far as it knows more.

    An article's blocks are main text, or those of a main element, though other pages have the same text (copies and
    quotations are text). Those whose class or id alone speaks against them stay if they are long enough for a run and no
    run in them is on more pages than the middle one of the article's other blocks; on the only page of a host they go. On pages without either, a body block is boilerplate where repeated runs cover it; if
    that takes every block, those that the fewest pages share stay.
    """
    streams, words = _streams(pages)
    covers = repeated(streams) if elsewhere is None else repeated(streams, RUN, lambda text, at: elsewhere(words, text, at))
    several = len(pages) > 1 or elsewhere is not None
    out = []
    for page, cover in zip(pages, covers, strict=True):
        regions = {_MAIN.get(r, r) for r, _ in page}
        if best := next((r for r in "am" if r in regions), None):
            sizes = [t.count(" ") + 1 for _, t in page]
            spans = [cover[end - n - 1 : end - 1] for n, end in zip(sizes, np.cumsum([n + 1 for n in sizes]), strict=True)]
            shares = [int(own.min()) for (r, _), own in zip(page, spans, strict=True) if r in (best, "a") and len(own) >= RUN]
            usual = np.median(shares) if shares else 1
            stays = [r in (best, "a") or _MAIN.get(r) in (best, "a") and several and len(own) >= RUN and own.max() <= usual for (r, _), own in zip(page, spans, strict=True)]
            out.append("\n\n".join(t for (_, t), stay in zip(page, stays, strict=True) if stay))
            continue
        at, kept, shared = 0, [], []
        for r, text in page:
            n = text.count(" ") + 1
            own, at = cover[at : at + n], at + n + 1
            if r == "b":
                (shared if (own > 1).mean() >= COVERED else kept).append((int(own.min()), text))
        if not kept and shared:
            least = min(c for c, _ in shared)
            kept = [(c, t) for c, t in shared if c == least]
        out.append("\n\n".join(t for _, t in kept))
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Pages are parsed where they are read and their blocks, compressed, shuffled once by host. A host's pages
    are dealt to arrays of some ``PAGES`` by a hash, however many it has. Runs are counted over all pages of a host: where a host has several arrays, these
    give, of the runs on pages on which runs decide, those they have, with their pages; the sums come back to them. Which runs that are is found by a reading of such
    hosts before, and known to tasks as a bit field of at most 32 MB. Null html is an empty text; a null or odd url is a host of its own; repeated rows come out repeated; other columns
    don't matter; an empty table gives an empty one.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    sizes = store(rows.select(host.alias("host")).groupBy("host").agg(F.ceil(F.count("*") / PAGES).alias("arrays")), "hosts")

    def parse(batches):
        for batch in batches:
            data = [zlib.compress(json.dumps(blocks(h)).encode(), 1) for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], ["host", "page_id", "url", "blocks"])

    parsed = rows.select(host.alias("host"), "page_id", "url", "html").mapInArrow(parse, "host string, page_id long, url string, blocks binary")
    dealt = parsed.join(sizes, "host").withColumn("array", F.pmod(F.xxhash64("page_id", "url"), F.col("arrays")))

    of_array = dealt.select("host", "array", "arrays", "page_id", "url", "blocks").groupBy("host", "array")

    def extracted(pdf: pd.DataFrame, elsewhere: Callable | None = None) -> pd.DataFrame:
        texts = main_texts([json.loads(zlib.decompress(b)) for b in pdf.blocks], elsewhere)
        return pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": texts, "n_chars": [len(t) for t in texts]})

    schema = "page_id long, url string, text string, n_chars long"
    asked = _asked(rows, host, sizes.where("arrays > 1"))
    if asked is None:  # runs decide nothing where a host has several arrays
        return of_array.applyInPandas(lambda pdf: extracted(pdf), schema)

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        streams, words = _streams([json.loads(zlib.decompress(b)) for b in pdf.blocks] if pdf["arrays"][0] > 1 else [])
        a, b, pages = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if sum(map(len, streams)):
            text, _, _, pages, first, whole = suffixes(streams)
            a, b = _digests(text, first[whole[first]], words, key[0])
            keep = HashFilter(asked.value).has(a.view(np.uint64))
            a, b, pages = a[keep], b[keep], pages[whole[first]][keep]
        return pd.DataFrame({"host": key[0], "array": key[1], "a": a, "b": b, "pages": pages})

    counts = of_array.applyInPandas(count, "host string, array long, a long, b long, pages long")
    sums = counts.groupBy("a", "b").agg(F.first("host").alias("host"), F.sum("pages").alias("pages"), F.collect_list("array").alias("arrays")).where(F.size("arrays") > 1)
    known = sums.select("host", F.explode("arrays").alias("array"), "a", "b", "pages")

    def run(key: tuple, pdf: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        total = dict(zip(zip(more.a, more.b, strict=True), more.pages, strict=True))

        def elsewhere(words, text, at):
            return np.fromiter((total.get(k, 0) for k in zip(*_digests(text, at, words, key[0]).tolist(), strict=True)), np.int64, len(at))

        return extracted(pdf, elsewhere if pdf["arrays"][0] > 1 else None)

    return of_array.cogroup(known.groupBy("host", "array")).applyInPandas(run, schema)


def _asked(rows: DataFrame, host: Column, large: DataFrame) -> Broadcast | None:
    """The runs of the pages on which runs decide, of ``large`` hosts, as a bit field; nothing if there are none."""
    if large.isEmpty():
        return None

    def ask(batches):
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for name, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if _asks(page := blocks(html)):
                    (stream,), words = _streams([page])
                    found.append(_digests(stream, np.arange(max(0, len(stream) - RUN + 1)), words, name)[0])
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.unique(np.concatenate(found)))})

    pages = rows.select(host.alias("host"), "html").join(large.select("host"), "host", "left_semi")
    runs = store(pages.select("host", "html").mapInArrow(ask, "a long"), "asked")
    return None if runs.isEmpty() else rows.sparkSession.sparkContext.broadcast(HashFilter.of(runs, "a").field)
