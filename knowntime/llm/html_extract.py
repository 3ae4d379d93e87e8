"""Main text of web pages as the best contiguous region: words score by where they stand, tags score against.

Weights come from labelled pages, whose markup names the article itself: log-odds of a word's place (boilerplate hint, region and
block element) and of each tag to lie inside the article. The article's own tags are no features, so pages without them are
scored alike. One linear scan finds the run of tokens with the greatest sum; the element that holds the run gives the text,
without blocks whose words score against.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm.common import per_text

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas title textarea select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
                  "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
BOILER = frozenset("aside button dialog footer form header label legend menu nav search head".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role attributes that name boilerplate.
HINTS = frozenset("ad ads adbox adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment commentlist comments complementary "
                  "consent contentinfo cookie cookies copyright dialog disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter "
                  "notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing "
                  "sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split())
#: Pseudo-words outside the article with which a hinted place starts.
HINTED = 1000
#: Words that may follow a hint in a name ("ad-container"), and words that turn one off ("no-sidebar").
GENERIC = frozenset("area bar block body bottom box container content inner item items left list outer panel right section slot top unit wrap wrapper".split())
NOT = frozenset("has no not with without".split())
#: Raw elements whose content HTML ends at their end tag alone.
PLAIN = frozenset("script style title textarea".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[^\s/>=][^\s/>=]*")
SPACE = re.compile(r"[\s/]*")
SET_TO = re.compile(r"\s*=\s*")
UNQUOTED = re.compile(r"[^\s>]*")
TELLING = frozenset("class id role hidden style aria-hidden".split())
WORD = re.compile(r"[^\W\d_]+")
WORDS = re.compile(r"\S+")


class Element:
    __slots__ = ("name", "parent", "boiler", "content", "block", "holder", "number", "last", "own", "hinted")

    def __init__(self, name: str, parent: Element | None, attributes: list[tuple[str, str]], number: int):
        self.name, self.parent, self.number, self.last = name, parent, number, number
        self.content = name in CONTENT or bool(parent and parent.content)
        hints = boilerplate(attributes) if attributes else ""
        if name in ("body", "html") and hints != "hidden":
            hints = ""
        own = name if name in BOILER else hints
        if own == "header" and parent and parent.content:
            own = ""                                   # an article's own header holds its title
        self.own, self.hinted = own, name not in BOILER and own != "hidden"
        self.boiler = ""                               # set by tokens(), when all of the page is read
        self.block = name if name in BLOCK else parent.block if parent else "body"
        self.holder = self if name in BLOCK or not parent else parent.holder


def boilerplate(attributes: list[tuple[str, str]]) -> str:
    """The hint that an element's attributes give, or nothing; of a name only its head word counts."""
    for name, value in attributes:
        value = value.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return "hidden"
        if name in ("class", "id", "role"):
            for one in value.split():
                words = WORD.findall(one)
                while len(words) > 1 and words[-1] in GENERIC:
                    words.pop()
                if words and words[-1] in HINTS and NOT.isdisjoint(words):
                    return "header" if words[-1] in ("header", "masthead") else words[-1]
    return ""


class Reader:
    """Reads a page's tags in one pass; every search that fails is not tried again further on."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        """Place of the next ``what``, or -1."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end_of(self, name: str, at: int) -> int:
        """Place after the next end tag of a raw element, or -1."""
        if name in self.gone:
            return -1
        found = CLOSERS[name].search(self.page, at)
        if not found:
            self.gone.add(name)
        return found.end() if found else -1

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """The attributes that tell something, whether the tag closes itself, and the place after its end (-1: it has none).

        A value whose quote is never closed ends at the next white space.
        """
        page, size, out = self.page, len(self.page), []
        while True:
            at = SPACE.match(page, at).end()
            if at >= size:
                return out, False, -1
            if page[at] == ">":
                return out, page[at - 1] == "/", at + 1
            m = ATTRIBUTE.match(page, at)
            if not m:                                  # a stray equals sign
                at += 1
                continue
            at, value = m.end(), ""
            sign = SET_TO.match(page, at)
            if sign:
                at = sign.end()
                quote = page[at:at + 1]
                close = self.find(quote, at + 1) if quote in ("'", '"') else -1
                if close >= 0:
                    value, at = page[at + 1:close], close + 1
                else:
                    m2 = UNQUOTED.match(page, at)
                    value, at = m2[0], m2.end()
            name = m[0].lower()
            if name in TELLING:
                out.append((name, value))

    def marks(self) -> Iterator[tuple[int, int, str, bool, list, bool]]:
        """(start, end, name, is an end tag, attributes, closes itself) of every tag; name "" for comments and the like."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                yield at, end + 3 if end >= 0 else len(page), "", False, [], False
                at = end + 3 if end >= 0 else len(page)
                continue
            if page.startswith(("<!", "<?"), at):
                end = self.find(">", at)
                yield at, end + 1 if end >= 0 else len(page), "", False, [], False
                at = end + 1 if end >= 0 else len(page)
                continue
            closing = page.startswith("/", at + 1)
            m = NAME.match(page, at + 1 + closing)
            if not m:
                at += 1
                continue
            end = self.find(">", m.end())
            if end < 0:                                # the page breaks off inside a tag
                yield at, len(page), "", False, [], False
                return
            if end == m.end():
                attributes, alone = [], False
            else:
                attributes, alone, end = self.attributes(m.end())
                end = len(page) if end < 0 else end - 1
            name = m[0].lower()
            skip = end + 1
            if not closing and name in RAW and not alone:
                close = self.end_of(name, skip)
                skip = close if close >= 0 else len(page) if name in PLAIN else skip
            yield at, skip, name, closing, attributes, alone
            at = skip


CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


def tokens(page: str) -> list[tuple[str, str, Element]]:
    """(kind, value, element): text runs, and tags as "+name" or "-name"; hints on the page's main element, its first article (inside
    main, if there is one) and whatever holds these do not count."""
    made: list[Element] = []
    runs = list(scan(page, made))
    main = next((e for e in made if e.name == "main"), None)
    article = next((e for e in made if e.name == "article" and (not main or e.parent.content)), None)
    for node in (main, article):
        while node:
            if node.hinted:
                node.own = ""
            node = node.parent
    for e in made:                                     # parents come before children
        e.boiler = e.parent and e.parent.boiler or e.own
    for e in reversed(made):
        if e.parent:
            e.parent.last = max(e.parent.last, e.last)
    return runs


def scan(page: str, made: list[Element]) -> Iterator[tuple[str, str, Element]]:
    """Runs of a page; its elements go to ``made``."""
    root = here = Element("html", None, [], 0)
    made.append(root)
    at, opened = 0, Counter()                          # opened: open elements by name

    def leave(node: Element) -> Element:
        """Close everything up to and with ``node``."""
        e = here
        while True:
            opened[e.name] -= 1
            if e is node:
                return node.parent or root
            e = e.parent

    for start, end, name, closing, attributes, alone in Reader(page).marks():
        if start > at:
            yield "text", page[at:start], here
        at = end
        if not name:
            continue
        if closing:
            if opened[name] > 0:
                node = here
                while node.name != name:
                    node = node.parent
                here = leave(node)
            yield "tag", "-" + name, here
        elif name in RAW or name in VOID or alone:
            yield "tag", "+" + name, here
        else:
            if name in ("body", "html"):
                here = root
                opened.clear()
            if name in BLOCK:                          # an open paragraph ends where a block begins
                node = here.holder
                if node is not root and (node.name == "p" or (node.name == name and name in ("li", "dt", "dd", "td", "th", "tr"))):
                    here = leave(node)
            here = Element(name, here, attributes, len(made))
            opened[name] += 1
            made.append(here)
            yield "tag", "+" + name, here
    if at < len(page):
        yield "text", page[at:], here


def place(e: Element) -> str:
    """Feature of a word: the boilerplate it stands in, or its block element."""
    if e.boiler == "header" and e.content:
        return e.block
    return f"boiler:{e.boiler}" if e.boiler else "body" if e.block in CONTENT else e.block


def known(tag: str) -> str:
    """Tags outside the fixed sets count as one; the labelled element's own tags are no feature."""
    name = tag[1:]
    return "" if name in CONTENT else tag if name in BLOCK or name in VOID or name in RAW or name in BOILER else tag[0] + "other"


def count_features(pages: list[str]) -> Counter:
    """(feature, inside the labelled article): words and tags of labelled pages."""
    out: Counter = Counter()
    for page in pages:
        for kind, value, e in tokens(page):
            if kind == "text":
                n = len(WORDS.findall(value))
                if n:
                    out[place(e), e.content] += n
            elif known(value):
                out[known(value), e.content] += 1
    return out


def weigh(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds, one pseudo-word each way; tags never score above a small charge. A hinted place starts with HINTED words outside
    the article: the labelled pages decide, but a few words do not."""
    out = {}
    for feature in {f for f, _ in counts}:
        start = HINTED if feature.startswith("boiler:") else 1
        odds = math.log((counts.get((feature, True), 0) + 1) / (counts.get((feature, False), 0) + start))
        if feature[0] in "+-":
            out[feature] = min(-0.1, max(-3.0, odds / 4))
        else:
            out[feature] = max(-4.0, min(4.0, odds))
    return out


def word_weight(weights: dict[str, float], e: Element) -> float:
    p = place(e)
    return weights.get(p, -2.0 if p.startswith("boiler:") else 1.0)


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best region, joined by newlines; white space inside a block is one space."""
    runs = tokens(page)
    best, total, start, found = 0.0, 0.0, 0, None
    for i, (kind, value, e) in enumerate(runs):
        total += word_weight(weights, e) * len(WORDS.findall(value)) if kind == "text" else weights.get(known(value), -0.1) if known(value) else 0.0
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i)
    if not found:
        return ""
    holders = [e for kind, value, e in runs[found[0]:found[1] + 1] if kind == "text" and value.strip() and word_weight(weights, e) > 0]
    top = holders[0]
    for e in holders[1:]:                              # least element that holds the region
        while top is not e and top.parent and not above(top, e):
            top = top.parent
    node = top
    while node and node.name not in CONTENT:
        node = node.parent
    top = node or block_of(top)
    blocks, words, last = [], [], None
    for kind, value, e in runs:
        if kind == "tag":
            if value[1:] in BLOCK and words:
                blocks.append(words)
                words = []
            elif value == "+br":
                words.append(" ")
        elif above(top, e) and word_weight(weights, e) > 0:
            words.append(entities.unescape(value))
    blocks.append(words)
    joined = (" ".join("".join(w).split()) for w in blocks)
    return "\n".join(b for b in joined if b)


def block_of(e: Element) -> Element:
    """The element that a lone block stands in; a page of one block has no other holder."""
    while e.parent and e.name not in BLOCK:
        e = e.parent
    return e


def above(top: Element, e: Element | None) -> bool:
    return e is not None and top.number <= e.number <= top.last


def fit_weights(pages: DataFrame, most: int = 2000) -> dict[str, float]:
    """Weights from a sample of about ``most`` labelled pages (those whose html has an article or main element), by page hash.

    Only counts per feature reach the driver; features are drawn from fixed sets.
    """
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(max(labelled.count(), 1))) < most
    chosen = labelled.where(share).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, inside, n) for (f, inside), n in count_features(b.column(0).to_pylist()).items()]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.int64())],
                                             names=["feature", "inside", "n"])

    sums = chosen.mapInArrow(run, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    return weigh({(r.feature, r.inside): r.n for r in sums.collect()})


def extract_pages(pages: DataFrame, most: int = 2000) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html); null html, or none that scores, gives empty text."""
    weights = fit_weights(pages, most)

    def fn(texts: list[str]) -> list[tuple]:
        out = (main_text(t, weights) for t in texts)
        return [(t, len(t)) for t in out]

    return per_text(pages.select("page_id", "url", "html"), "html", "text string, n_chars long", fn, drop=("html",))
