"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read as a stream of words and tags. Words score by the element
around them, tags by their name: words for the region, tags against it. The
weights are log-odds from labelled pages, those that mark their own content
with ``article`` or ``main``: how often a feature stands inside and outside,
whatever its elements are called. One linear scan (``best_region``) finds the
contiguous part with the highest sum. It is only ever widened: to whole
blocks, and where it begins or ends in an ``article`` or ``main``, to the whole
of that element (those inside another are part of the outer one). Where no
word scores above zero, the prior weights are used.

Elements that are never main text by their tag (``SKIPPED``), hidden ones and
reader comments score as a single tag and their text is left out, inside the
region too. Of a header inside an article its headings stay.

A class, id or role counts if all of it is known names (``SKIPPED_NAMES``), but
for affixes (``AFFIXES``: "nav-menu", "site-footer", "comments-wrapper"); ids
of headings and text blocks don't count. An element named so is scored when it
has ended, over the whole of it, and left out if its score isn't above zero.
Outside an article its words have the name's weight, which the labelled pages
can raise; an element that holds an article stays. Inside one, words in links
count against it, other words for it, and a name costs ``NAME_COST`` words
(headings and text blocks: nothing).

Character references are decoded, white space inside a block becomes one
space, and blocks are joined by a line feed in page order. A null or empty
html gives an empty text; html without tags is one block; unclosed tags,
quotes and comments end with the page. Repeated rows are extracted each; extra
columns are ignored; an empty table gives no row, and without labelled pages
the prior weights hold. Ties go to the earlier, then the longer region.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramvec.llm.common import shipped

#: Labelled pages that the weights are fitted on, at most.
LABELLED_PAGES = 2000

SKIPPED = set(
    "aside audio button canvas dialog footer form head iframe math menu nav noscript object script select style svg template textarea title video".split()
)
#: Of these, those that may stand inside a line and don't end its block.
INLINE = set("audio button canvas iframe math noscript object script select style svg template textarea video".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
SKIPPED_NAMES = set(
    """ad ads adsense advert advertisement advertising adverts alert alerts banner breadcrumb breadcrumbs captcha
    comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu menus
    modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion
    recommended related replies reply respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe
    subscription survey teaser toolbar topbar widget widgets complementary contentinfo""".split()
)
COMMENTS = {"comment", "comments", "reply", "replies"}
# A name that says something about the page around it, such as "has-sidebar".
ABOUT = {"has", "no", "with", "without", "is", "layout"}
#: Parts of a name that don't change what its other parts say.
AFFIXES = set(
    """area bar block body bottom box container desktop entry footer global header holder inner item items left link links list
    main mobile outer page panel post primary right secondary section site slot top unit wrap wrapper""".split()
)
#: What a name costs an element inside an article, in words outside links.
NAME_COST = 30
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold blocks, and blocks that the next block ends.
CONTAINERS = set("article blockquote body center details div dl fieldset figure header hgroup html main ol section table tbody tfoot thead ul".split())
BLOCKS = set("address caption dd dt figcaption hr legend li option p pre summary td th tr".split()) | HEADINGS
CONTENT = {"article", "main"}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|/|$)|hidden\s*=|aria-hidden\s*=\s*[\"']?true)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


class Token(NamedTuple):
    """``feature`` with its number of words (0: a tag), the block of its text, the article around it, and names around it."""

    feature: str
    words: int
    block: int
    article: int
    under: frozenset[str] = frozenset()


class Named:
    """An element whose names speak against it: tokens ``start`` to ``end``."""

    def __init__(self, names: set[str], start: int, article: int, text_block: bool):
        self.names, self.start, self.end, self.article, self.text_block = names, start, -1, article, text_block
        self.content = False  # whether it holds an article


def names_of(name: str, attributes: str) -> set[str]:
    """The parts of each class, id and role of element ``name`` that is made of ``SKIPPED_NAMES`` and affixes."""
    out: set[str] = set()
    for m in NAMES.finditer(attributes):
        if m[1].lower() == "id" and name in BLOCKS:
            continue
        for one in (m[2] or m[3] or m[4] or "").split():
            parts = {x for x in re.split(r"[^a-z]+", CAMEL.sub("-", one).lower()) if len(x) > 1}
            if not parts & ABOUT and parts <= SKIPPED_NAMES | AFFIXES:
                out |= parts & SKIPPED_NAMES
    return out


class Page:
    """The tokens of a page and the texts of its blocks."""

    def __init__(self, html: str):
        self.tokens: list[Token] = []
        self.blocks: list[list[tuple[int, str]]] = [[]]  # texts, each with the number of its token
        self.article_of: list[int] = [0]  # article of each block
        self.named: list[Named] = []
        self._read(html)
        self.kept = [True] * len(self.tokens)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, bool, bool, int, Named | None]] = []  # name, skipped, header, article, its entry in ``named``
        at, articles = 0, 0
        inside, lone, link, heading = "", False, 0, False  # open block, whether it is skipped, open links, heading
        own: Named | None = None  # the open block, if it is named
        skipped = header = False
        article = 0
        under: frozenset[str] = frozenset()

        def around() -> frozenset[str]:
            return frozenset().union(*(s[4].names for s in stack if s[4]), own.names if own else ())

        def part(name: str = "") -> None:
            nonlocal inside, lone, heading, own, under
            inside, lone, heading = name, False, name in HEADINGS
            if own:
                own.end, own = len(self.tokens), None
                under = around()
            if self.blocks[-1]:
                self.blocks.append([])
                self.article_of.append(article)
            else:
                self.article_of[-1] = article

        while at < len(html):
            m = TAG.search(html, at)
            text = html[at : m.start() if m else len(html)]
            if text and not (skipped or lone or (header and not heading)):
                words = len(text.split())
                self.blocks[-1].append((len(self.tokens), entities.unescape(text)))
                if words:
                    kind = "link" if link else inside or "none"
                    self.tokens.append(Token(f"words in {kind}", words, len(self.blocks) - 1, article, under))
            if not m:
                break
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if not closing:
                out, names = (False, set()) if skipped else self._judged(name, attributes or "", article)
                if not skipped:
                    self.tokens.append(Token(f"tag {'inline' if name in INLINE else 'skipped' if out else name}", 0, len(self.blocks) - 1, article))
                if name in RAW and not (attributes or "").endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                    if name in ("iframe", "noscript") and not end:
                        continue
                    at = end.start() if end else len(html)
                if name in VOID:
                    if name == "hr":
                        part()
                    elif name == "br" and self.blocks[-1]:
                        self.blocks[-1].append((len(self.tokens), " "))
                elif name in CONTAINERS or name in SKIPPED or ((out or names) and name not in BLOCKS):
                    if name in CONTENT and not out and not skipped:
                        if not article:
                            articles += 1
                            article = articles
                        for s in stack:
                            if s[4]:
                                s[4].content = True
                    if name in CONTAINERS or name in SKIPPED - INLINE:
                        link = 0
                        part()
                    entry = Named(names, len(self.tokens), article, False) if names else None
                    stack.append((name, out, name == "header" and article > 0, article, entry))
                    if entry:
                        self.named.append(entry)
                        under = around()
                    skipped, header = skipped or out, header or stack[-1][2]
                elif name in BLOCKS:
                    part(name)
                    lone = out
                    if names:
                        own = Named(names, len(self.tokens), article, True)
                        self.named.append(own)
                        under = around()
                elif name == "a":
                    link = 1
            elif name == "a":
                link = 0
            else:
                if not skipped and name not in INLINE:
                    self.tokens.append(Token(f"tag /{name}", 0, len(self.blocks) - 1, article))
                open_ = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if open_ is not None:
                    block = name in CONTAINERS or name in SKIPPED - INLINE
                    ended = [s[4] for s in stack[open_:] if s[4]]
                    for entry in ended:
                        entry.end = len(self.tokens)
                    del stack[open_:]
                    skipped, header = any(s[1] for s in stack), any(s[2] for s in stack)
                    article = stack[-1][3] if stack else 0
                    if block:
                        link = 0
                        part()
                    if ended:
                        under = around()
                elif name in BLOCKS:
                    part()
        for entry in self.named:
            if entry.end < 0:
                entry.end = len(self.tokens)

    @staticmethod
    def _judged(name: str, attributes: str, article: int) -> tuple[bool, set[str]]:
        """Whether an element is never main text; and the names that its score must outweigh."""
        if name in SKIPPED:
            return True, set()
        if name in ("html", "body"):
            return False, set()
        if name == "header" and not article:
            return True, set()
        if not attributes:
            return False, set()
        found = names_of(name, attributes)
        if name in CONTENT:
            return bool(found & COMMENTS), set()
        return bool(found & COMMENTS or HIDDEN.search(attributes)), found

    def leave_out(self, weights: dict[str, float]) -> None:
        """Drop the named elements whose score isn't above zero; sums over a prefix make each one's score a difference."""
        words, linked = [0], [0]
        for t in self.tokens:
            words.append(words[-1] + t.words)
            linked.append(linked[-1] + (t.words if t.feature == "words in link" else 0))
        self.kept = [True] * len(self.tokens)
        done = 0
        for e in self.named:
            if e.end <= done or e.content:
                continue
            n, links = words[e.end] - words[e.start], linked[e.end] - linked[e.start]
            if e.article:
                score = n - 2 * links - (0 if e.text_block else NAME_COST)
            else:
                score = n * min(weights.get(f"under {x}", prior(f"under {x}")) for x in e.names)
            if score <= 0:
                done = e.end
                for i in range(e.start, e.end):
                    self.kept[i] = False

    def text_of(self, first: int, last: int) -> str:
        """Blocks ``first`` to ``last`` (inclusive), cleaned and joined."""
        kept = [*self.kept, True]
        lines = (SPACE.sub(" ", "".join(text for i, text in b if kept[i])).strip() for b in self.blocks[first : last + 1])
        return "\n".join(x for x in lines if x)


# ------------------------------------------------------------------ weights
def prior(feature: str) -> float:
    """Weight of a feature that no labelled page shows."""
    kind, _, name = feature.partition(" ")
    if kind == "words":
        return -0.5 if name == "in link" else 1.0
    if kind == "under":
        return -1.0
    name = name.removeprefix("/")
    if name in CONTAINERS or name == "skipped":
        return -1.5
    return -1.0 if name in ("li", "td", "th", "tr") else -0.3


def region_counts(page: Page) -> Counter:
    """``(feature, inside)`` of a labelled page: inside is its ``article`` or ``main``."""
    out: Counter = Counter()
    for t in page.tokens:
        out[t.feature, t.article > 0] += max(1, t.words)
        for name in t.under:
            out[f"under {name}", t.article > 0] += t.words
    return out


def fit_weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Half the log-odds of standing inside, added to the prior weight; words stay above tags."""
    weights = {}
    for feature in {f for f, _ in counts}:
        odds = math.log((counts.get((feature, True), 0) + 1.0) / (counts.get((feature, False), 0) + 1.0))
        if feature.startswith(("words", "under")):
            weights[feature] = min(3.0, max(-1.0, prior(feature) + odds / 4))
        else:
            weights[feature] = min(-0.05, max(-6.0, prior(feature) + min(0.0, odds) / 4))
    return weights


def learn_weights(pages: DataFrame, most: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from the ``most`` labelled pages with the smallest hash of page_id."""
    labelled = pages.where(F.lower("html").rlike("<(article|main)[\\s>]")).select("page_id", "html")
    # the share that holds about twice as many, so that the sort is small
    n = labelled.count()
    if n > 2 * most:
        labelled = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_003)) < int(1_000_003 * 2 * most / n))
    sample = labelled.orderBy(F.xxhash64("page_id"), "page_id").limit(most).select("html")

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                total.update(region_counts(Page(html)))
        rows = [(f, i, n) for (f, i), n in total.items()]
        kinds = [pa.string(), pa.bool_(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds)], ["feature", "inside", "n"])

    found = shipped(sample).mapInArrow(run, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    return fit_weights({(r["feature"], r["inside"]): r["n"] for r in found.collect()})


def best_region(scores: list[float]) -> tuple[int, int] | None:
    """First and last index of the contiguous part with the highest positive sum."""
    best, found, total, start = 0.0, None, 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i)
    return found


def main_text(html: str | None, weights: dict[str, float]) -> str:
    page = Page(html or "")
    page.leave_out(weights)
    tokens = [t for t, kept in zip(page.tokens, page.kept) if kept]
    region = best_region([weights.get(t.feature, prior(t.feature)) * max(1, t.words) for t in tokens])
    if region is None:
        region = best_region([prior(t.feature) * max(1, t.words) for t in tokens])
    if region is None:
        return ""
    inside = [t for t in tokens[region[0] : region[1] + 1] if t.words]
    first, last = inside[0].block, inside[-1].block
    article = inside[0].article, inside[-1].article
    if article[0]:
        first = min(first, page.article_of.index(article[0]))
    if article[1]:
        last = max(last, len(page.article_of) - 1 - page.article_of[::-1].index(article[1]))
    return page.text_of(first, last)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; ``weights`` are learned from the pages if not given."""
    weights = learn_weights(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return shipped(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")
