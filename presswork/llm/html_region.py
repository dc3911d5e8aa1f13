"""Main text of web pages: the maximum-scoring run of words and tags.

Words score positive and tags negative (Pasternack and Roth, "Extracting Article Text
from the Web with Maximum Subsequence Segmentation", WWW 2009). Elements that carry no
article text by their name, role or class are taken out first, but no element for its
class or id that holds an article or most of the words around it: layout wrappers have
such names too. A linear scan then
finds the contiguous run of highest score, and its blocks are the text.

The weights come from labelled pages: pages that mark their article with ``article``
or ``main``. What stands inside is content, what stands outside is not. Each tag costs
the logarithm of its share inside; a word, with or without a link around it, earns its
share inside. The share is counted over a bounded sample of such pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm import common as C

# About so many labelled pages are counted for the weights.
SAMPLE = 4000

# Elements without article text.
DROPPED = set(
    "script style noscript template nav footer aside form iframe svg canvas object embed audio video map "
    "button select textarea input label fieldset dialog menu head title".split())
DROPPED_ROLES = set("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar form".split())
# Words of a class or id that mark such elements.
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget rail "
    "header masthead footer copyright comment comments disqus replies respond cookie cookies consent gdpr notice "
    "notification alert popup modal overlay share sharing social related recommended newsletter subscribe "
    "subscription signup login form search skip toolbar tags".split())
BLOCKS = set(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main "
    "ol p pre section summary table tbody td tfoot th thead tr ul header caption".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = ("article", "main")
COUNTED = BLOCKS | set("a abbr b br cite code em i img small span strong sub sup u".split())
# Weights where no page is labelled.
DEFAULTS = {"word": 1.0, "linked": 0.2, "a": -2.0, "li": -2.0, "td": -1.0, "tr": -1.0, "div": -1.0}
OTHER_TAG = -0.5

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S | re.I)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

Item = tuple[str, str, str, bool]  # kind ("text", "open", "close"), tag name, raw text, inside a link


def _marked(rest: str) -> set[str] | bool:
    """Whether attributes mark an element that isn't article text; if only class and id do, their words."""
    marks: set[str] = set()
    for name, a, b, c in _NAMED.findall(rest):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id"):
            marks |= DROPPED_WORDS.intersection(w.lower() for w in _WORDS.findall(value))
    return marks


class _Page:
    """Words, article elements and headings between two places of a page."""

    def __init__(self, found: list[tuple]):
        self.words, self.articles, self.headings = [0], [0], [0]
        for kind, name, text, _ in found:
            self.words.append(self.words[-1] + (len(text.split()) if kind == "text" else 0))
            self.articles.append(self.articles[-1] + (kind == "open" and name in CONTENT))
            self.headings.append(self.headings[-1] + (kind == "open" and name in ("h1", "h2")))

    def keeps(self, marks: set[str], first: int, last: int, around: tuple[int, int]) -> bool:
        """Whether the element from ``first`` to ``last`` stays in spite of its class or id.

        It does when it holds an article, most of the words of the article or page
        around it, or, marked as a header only, a heading.
        """
        held = lambda sums, a, b: sums[b + 1] - sums[a]
        return (held(self.articles, first, last) > 0
                or 2 * held(self.words, first, last) > held(self.words, *around)
                or marks == {"header"} and held(self.headings, first, last) > 0)


def items(page: str) -> tuple[list[Item], list[bool]]:
    """Text runs and tags left after the removal, and whether each stands inside the marked article."""
    found = []
    place = 0
    for m in _TAG.finditer(page):
        if m.start() > place:
            found.append(("text", "", page[place:m.start()], ""))
        place = m.end()
        if m["name"]:
            name = m["name"].lower()
            found.append(("close" if m["end"] else "open", name, "", m["rest"]))
        elif m["raw"] or m[0].startswith("<!--"):
            found.append(("gap", "", "", ""))
    if place < len(page):
        found.append(("text", "", page[place:], ""))

    ends = _ends(found)
    out, inside = [], []
    linked = article = 0
    i, n = 0, len(found)
    sums: _Page | None = None
    around = [(0, n - 1)]  # the page and the articles around the place
    while i < n:
        kind, name, text, rest = found[i]
        if kind == "open" and name not in EMPTY:
            # An open tag without an end hides nothing but itself.
            drop = name in DROPPED or (name == "header" and not article)
            if not drop and rest and i in ends and name not in ("html", "body", *CONTENT):
                drop = _marked(rest)
                if drop and drop is not True:
                    sums = sums or _Page(found)
                    while around[-1][1] < i:
                        around.pop()
                    drop = not sums.keeps(drop, i, ends[i], around[-1])
            if drop and i in ends:
                out.append(("close", name, "", False))
                inside.append(article > 0)
                i = ends[i] + 1
                continue
            linked += name == "a"
            article += name in CONTENT
            if name in CONTENT and i in ends:
                while around[-1][1] < i:
                    around.pop()
                around.append((i, ends[i]))
        elif kind == "close":
            linked = max(0, linked - (name == "a"))
            article = max(0, article - (name in CONTENT))
        if kind != "gap":
            out.append((kind, name, text, linked > 0))
            inside.append(article > 0)
        i += 1
    return out, inside


def _ends(found: list[tuple]) -> dict[int, int]:
    """The place of the close tag of each open tag that has one."""
    waiting: dict[str, list[int]] = {}
    ends = {}
    for i, (kind, name, _, _) in enumerate(found):
        if kind == "open":
            waiting.setdefault(name, []).append(i)
        elif kind == "close" and waiting.get(name):
            ends[waiting[name].pop()] = i
    return ends


def best_region(rows: list[Item], weights: dict[str, float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest score, the earliest and longest of equals."""
    word, link = weights["word"], weights["linked"]
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for i, (kind, name, text, linked) in enumerate(rows):
        if kind == "text":
            total += len(text.split()) * (link if linked else word)
        else:
            total += weights.get(name, OTHER_TAG)
        if total < 0:
            total, start = 0.0, i + 1
        elif total >= best and total > 0:
            best, first, last = total, start, i + 1
    return first, last


def blocks(rows: list[Item]) -> list[str]:
    """Text of the blocks: references decoded, white space squeezed, empty ones left out."""
    out, run = [], []
    for kind, name, text, _ in [*rows, ("open", "p", "", False)]:
        if kind == "text":
            run.append(text)
        elif name in BLOCKS:
            block = " ".join(html.unescape("".join(run)).split())
            if block:
                out.append(block)
            run = []
        elif name == "br":
            run.append(" ")
    return out


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page, blocks on lines of their own; empty if there is none."""
    rows, _ = items(page or "")
    first, last = best_region(rows, weights)
    # The run is widened to whole blocks.
    while first > 0 and not (rows[first - 1][0] != "text" and rows[first - 1][1] in BLOCKS):
        first -= 1
    while last < len(rows) and not (rows[last][0] != "text" and rows[last][1] in BLOCKS):
        last += 1
    return "\n".join(blocks(rows[first:last]))


# -- weights ------------------------------------------------------------------------

def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for page in batch.column(0):
            rows, inside = items(page.as_py())
            if True not in inside:
                continue
            for (kind, name, text, linked), within in zip(rows, inside):
                if kind == "text":
                    counts["linked" if linked else "word", within] += len(text.split())
                elif name in COUNTED:
                    counts[name, within] += 1
    yield pa.RecordBatch.from_pydict({
        "name": pa.array([k[0] for k in counts], pa.string()), "inside": pa.array([k[1] for k in counts], pa.bool_()),
        "n": pa.array(list(counts.values()), pa.int64())})


def learn_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from about ``sample`` of the pages that mark their article, picked by a hash of the page."""
    marked = pages.select("html").filter(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    count = marked.count()
    if not count:
        return dict(DEFAULTS)
    share = int(min(1.0, sample / count) * 1_000_000)
    picked = marked.filter(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < share)
    rows = picked.mapInArrow(_counter, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n"))
    seen = {(name, within): n for name, within, n in rows.collect()}
    weights = dict(DEFAULTS)
    for name in {name for name, _ in seen}:
        within, outside = seen.get((name, True), 0), seen.get((name, False), 0)
        share = (within + 1) / (within + outside + 2)
        weights[name] = share if name in ("word", "linked") else math.log(share)
    return weights


def _extractor(weights: dict[str, float]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = C.utf8(batch.column(2))
            for first, last in C.slices(offsets):
                part = batch.slice(first, last - first)
                texts = [extract(page, weights) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])
    return work


def main_texts(pages: DataFrame, weights: dict[str, float] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``.

    A null or empty page, or one without words, gives the empty text. Ids and URLs may
    be null or repeat; every row gives a row. Pages of any length are read whole, in
    time linear in their length. Other columns are not read. An empty table gives an
    empty table.
    """
    weights = weights or learn_weights(pages, sample)
    return pages.select("page_id", "url", "html").mapInArrow(
        _extractor(weights), "page_id long, url string, text string, n_chars long")
