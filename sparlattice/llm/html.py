"""Operator 2: main text of web pages by the maximum-scoring subsequence.

A page is a sequence of blocks of words and of tags. A word scores by its
block: the block's element, the share of its words in links, its length, whether
it begins as a copyright line, and the elements and names (class, id, role) of
the containers around it, with weights learned from labelled pages; a tag scores
below zero. One linear scan finds the contiguous region with the greatest sum.
Blocks inside the region whose containers speak against them (a notice, a form,
reader comments) are left out.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled pages of the fit: those of lowest hash. Most features: the commonest.
FIT_PAGES, FIT_FEATURES = 2_000, 2_000
#: Blocks inside more containers than this play no part in the fit.
FIT_DEPTH = 64

# Names of HTML elements.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math")
DROPPED = frozenset((*RAW, "head", "title", "object", "select", "button"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = frozenset("nav header footer aside form menu dialog article main section figure table".split())
CONTAINERS = frozenset((*DROPPED, *SECTIONS, "div", "body", "ul", "ol", "dl", "details", "p", "span"))
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption div section article main body".split())

#: Elements that say nothing of what is in them.
GENERIC = frozenset("div section article main body".split())
#: A tag scores between these, by how seldom it stands in main text.
TAG_SCORES = -0.05, -0.3

#: Weights of features that no labelled page shows: how far one of a word's
#: block speaks for main text. ``name`` is what a class, id or role says. All others are learned from nothing.
PRIOR = {
    "word": 1.0, "in p": 1.0, "in h1": 0.5, "in h2": 0.5, "in h3": 0.3, "in pre": 0.5, "in blockquote": 0.5, "in li": -0.3,
    "links most": -2.0, "links some": -0.3, "copyright": -3.0, "words 1": -0.3, "words 4": -0.1, "words 32": 0.3, "words 64": 0.6,
    "under nav": -5.0, "under footer": -5.0, "under header": -5.0, "under aside": -5.0, "under form": -5.0, "under menu": -5.0, "under dialog": -5.0, "under dropped": -50.0, "under article": 2.0, "under main": 1.0,
}
PRIOR_NAMES = {
    -4.0: "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promos promotion related respond replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary alert dialog menubar".split(),
    -1.5: "header search legal login links banner bottom copyright".split(),
    3.0: "article content entry post story main body text prose markdown".split(),
}
for _weight, _names in PRIOR_NAMES.items():
    PRIOR |= {f"name {n}": _weight for n in _names}
DEAREST = 10.0
#: Containers speak against a block inside the region from this sum on.
AGAINST = -1.6
#: Blocks of labelled main text in a container that weighs so little are no evidence: the label holds for what is around them.
DOUBTFUL = -2.0
#: As how many words all labelled ones together count beside a penalty of one for a weight of one.
STRENGTH = 1_500.0
#: Labels of the fit, which are no features of it.
LABELS = ("under article", "under main")

#: Of raw elements those with tags of their own inside, which nest and may be empty by ``/>``.
DRAWINGS = ("svg", "math")
#: Elements that end a drawing which is never closed. Fixed values.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

_RAW_BODY = "|".join(RAW)
# Attributes are bounded in number and length here, so that a page of stray quotes takes linear time;
# a tag beyond the bounds ends where ``_tag_end`` says.
_ATTRIBUTES = r"""(?:[^<>"']++|"[^"]{0,1000}"|'[^']{0,1000}'){0,60}+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|</?([a-zA-Z][^\s/<>]*)({_ATTRIBUTES})>|<[!?][^>]*>|<(?:/?[a-zA-Z!?])[^<>]*(?:>|\Z)?",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
COPYRIGHT = re.compile(r"\s*(?:©|\(c\)|&copy;|copyright\b|all rights reserved)", re.IGNORECASE)

TAG = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
RAW_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
RAW_MARK = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.IGNORECASE) for tag in DRAWINGS}
ANY_START = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>])")
DELIMITER = re.compile(r"""[<>]|=\s*+["']""")


def _tag_end(page: str, at: int, known: dict[int, int]) -> int:
    """Behind the > that ends a tag's attributes, -1 if a < or the end of the page comes first.

    A quote opens a value behind = only and has no longest length. ``known``
    holds the outcome by opening quote, so that none is followed twice.
    """
    passed = []
    end = -1
    while m := DELIMITER.search(page, at):
        if m[0] in "<>":
            end = m.end() if m[0] == ">" else -1
            break
        quote = m.end() - 1
        if quote in known:
            end = known[quote]
            break
        passed.append(quote)
        at = page.find(page[quote], quote + 1) + 1
        if not at:
            break
    known.update(dict.fromkeys(passed, end))
    return end


def _raw_end(page: str, tag: str, end: int, known: dict[int, int], unclosed: set[str]) -> int:
    """Behind the end of a raw element whose start tag ends at ``end``.

    A drawing ends with the end tag that matches its start, or is empty by ``/>``;
    one that is never closed ends where an element begins that can't be in it. Others end at
    their first end tag, else with the page. ``unclosed`` holds the kinds
    that are known to have no end tag any more.
    """
    if tag not in DRAWINGS:
        close = RAW_CLOSE[tag].search(page, end)
        return close.end() if close else len(page)
    if page[end - 2] == "/":
        return end
    depth, at = 1, end
    while tag not in unclosed and (m := RAW_MARK[tag].search(page, at)):
        stop = _tag_end(page, m.end(), known)
        at = stop if stop > 0 else m.end()
        if m[1]:
            depth -= 1
            if not depth:
                return at
        elif page[at - 2] != "/":
            depth += 1
    # From here on no drawing of this kind is closed as often as it is begun.
    unclosed.add(tag)
    outside = (m for m in ANY_START.finditer(page, end) if m[1].lower() in BREAKOUT or m[1].lower() in SECTIONS)
    return next((m.start() for m in outside), len(page))


def tokens(page: str) -> Iterator[tuple[int, int, str | None, str | None]]:
    """(start, end, tag, attributes); no tag for comments, declarations, whole raw elements and broken tags."""
    known: dict[int, int] = {}
    unclosed: set[str] = set()
    at: int | None = 0
    while at is not None:
        found, at = TOKEN.finditer(page, at), None
        for m in found:
            head = TAG.match(page, m.start())
            if not head:
                yield m.start(), m.end(), None, None
                continue
            whole = m[1] is not None
            end = m.end() if whole else _tag_end(page, head.end(), known)
            if end < 0:
                yield m.start(), m.end(), None, None
                continue
            tag = head[1].lower()
            if tag in RAW and page[m.start() + 1] != "/":
                at = _raw_end(page, tag, end, known, unclosed)
                yield m.start(), at, None, None
                break
            yield m.start(), end, head[1], m[2] if whole else page[head.end() : end - 1]
            if not whole:
                at = end
                break


@lru_cache(maxsize=10_000)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """The features that a container gives to what is in it."""
    if tag in DROPPED:
        return ("under dropped",)
    out = {f"under {tag}"} if tag in SECTIONS else set()
    if attributes and tag not in ("body", "html"):
        for m in ATTRIBUTE.finditer(attributes):
            value = HUMP.sub(" ", m[2] or m[3] or m[4] or "").lower()
            out.update(f"name {w}" for w in NAME.findall(value) if len(w) > 1)
    return tuple(sorted(out))


@dataclass
class Block:
    """A run of text between tags that break it, or one such tag (``text`` None)."""

    tag: str
    text: str | None
    words: int = 0
    features: tuple[str, ...] = ()
    #: What the containers around it say: a sum of weights, or in the fit their features.
    around: float = 0.0
    marks: tuple[str, ...] = ()
    closing: bool = False
    #: Whether an element around it is never main text, such as a list of choices.
    dropped: bool = False


def blocks(page: str, weight: dict[str, float] | None = None) -> Iterator[Block]:
    """The page in order. With ``weight`` the containers of each block are summed
    up as they open and close; without, their features are listed."""
    open_tags: list[tuple[str, tuple[str, ...]]] = []
    n_open: Counter = Counter()
    active: Counter = Counter()
    total = 0.0
    within: list[str] = []
    n_within: Counter = Counter()
    parts: list[str] = []
    linked = in_link = 0

    def opened(tag: str, marks: tuple[str, ...]) -> None:
        nonlocal total
        open_tags.append((tag, marks))
        n_open[tag] += 1
        for m in marks:
            active[m] += 1
            if weight is not None and active[m] == 1:
                total += weight.get(m, 0.0)

    def closed() -> str:
        nonlocal total
        tag, marks = open_tags.pop()
        n_open[tag] -= 1
        for m in marks:
            active[m] -= 1
            if not active[m]:
                del active[m]
                if weight is not None:
                    total -= weight.get(m, 0.0)
        return tag

    def flushed() -> Iterator[Block]:
        nonlocal linked
        if parts:
            text = "".join(parts)
            n = len(text.split())
            if n:
                own = ["word", f"words {next(k for k in (64, 32, 16, 4, 1) if n >= k)}"]
                if within and within[-1] not in GENERIC:
                    own.append(f"in {within[-1]}")
                if linked:
                    own.append("links most" if 2 * linked > n else "links some")
                if COPYRIGHT.match(text):
                    own.append("copyright")
                marks = tuple(sorted(active)) if weight is None and len(open_tags) <= FIT_DEPTH else ()
                yield Block(within[-1] if within else "body", text, n, tuple(own), total, marks, dropped=active["under dropped"] > 0)
            parts.clear()
        linked = 0

    at = 0
    for start, end, name, attributes in tokens(page):
        if start > at:
            text = page[at:start]
            parts.append(text)
            if in_link:
                linked += len(text.split())
        at = end
        if name is None:  # a comment, a declaration, a raw element as a whole, a broken tag
            continue
        tag, closing = name.lower(), page[start + 1] == "/"
        if tag == "br":  # white space within a block
            parts.append("\n")
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        marks = () if closing or tag not in CONTAINERS or tag in VOID or page.endswith("/>", start, end) else _marks(tag, attributes or "")
        if tag in INLINE and not marks and not (closing and n_open[tag]):
            continue
        yield from flushed()  # a named span is a container too
        if closing:
            if n_open[tag]:
                while closed() != tag:
                    pass
            if n_within[tag]:
                while (left := within.pop()) != tag:
                    n_within[left] -= 1
                n_within[tag] -= 1
        else:
            if tag in ("body", "main", "article") and n_open["head"]:
                while open_tags:
                    closed()
                within.clear()
                n_within.clear()
            if tag == "p" and open_tags and open_tags[-1][0] == "p":
                closed()
            if tag in BLOCKS:
                if tag in ("p", "li", "dt", "dd", "td", "th") and within and within[-1] == tag:
                    within[-1] = tag
                else:
                    within.append(tag)
                    n_within[tag] += 1
            if tag in CONTAINERS and tag not in VOID and not page.endswith("/>", start, end) and (tag not in ("p", "span") or marks):
                opened(tag, marks)
        if tag not in INLINE:
            yield Block(tag, None, closing=closing)
    if at < len(page):
        parts.append(page[at:])
    yield from flushed()


@dataclass
class Weights:
    """Log odds of a word's features for main text, and scores of tags, which are below zero."""

    words: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    tags: dict[str, float] = field(default_factory=dict)
    other_tag: float = TAG_SCORES[0]

    def of(self, block: Block) -> float:
        """The score of a block: of each word the log odds, between -2 and 2, halved.
        What is never main text neither speaks for a region nor parts it. No single block costs more than ``DEAREST`` words, so that a long notice
        inside an article doesn't part it."""
        if block.dropped:
            return 0.0
        odds = sum(self.words.get(f, 0.0) for f in block.features) + block.around
        return max(-DEAREST, block.words * max(-2.0, min(2.0, odds)) / 2)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the greatest sum, the first and longest of equals; empty if none is above 0."""
    best = total = 0.0
    start = low = high = 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and total > 0 and start == low):
            best, low, high = total, start, i + 1
    return low, high


def main_text(page: str | None, weights: Weights) -> str:
    parts = list(blocks(page or "", weights.words))
    scores = [weights.tags.get(b.tag, weights.other_tag) if b.text is None else weights.of(b) for b in parts]
    low, high = best_region(scores)
    kept = (b.text for b, s in zip(parts[low:high], scores[low:high], strict=True) if b.text is not None and not b.dropped and not (s < 0 and b.around <= AGAINST))
    return " ".join(html.unescape(" ".join(kept)).split())


def contexts(page: str) -> Counter:
    """((features of the word, of its containers), in main text or not) -> words, and (tag, ...) -> tags.

    Pages label their main text by ``article`` or ``main``; blocks of other
    sections inside it are neither. Each block counts three times, once without its
    containers and once without its element too, so that what has no names, or
    stands in a plain division, can be told by the rest.
    """
    out: Counter = Counter()
    inside = 0
    for b in blocks(page):
        if b.text is not None:
            marks = [m for m in b.marks if m not in LABELS]
            if b.dropped:
                continue
            if inside and any(PRIOR.get(m, 0.0) <= DOUBTFUL for m in marks):
                continue
            out[json.dumps([*b.features, *marks]), inside > 0] += b.words
            out[json.dumps(b.features), inside > 0] += b.words
            out[json.dumps([f for f in b.features if not f.startswith("in ")]), inside > 0] += b.words
        elif b.tag in ("article", "main"):
            inside = max(0, inside + (-1 if b.closing else 1))
        else:
            out[json.dumps(b.tag), inside > 0] += 1
    return out


def learned(counts: dict[tuple[str, bool], int], strength: float = STRENGTH) -> dict[str, float]:
    """Log odds of features by logistic regression, those that the pages don't show as ``PRIOR`` has
    them. Each feature that they show starts at 0, whatever ``PRIOR`` says: what it weighs
    comes from how its words lie inside and outside of main text."""
    named = {k for k, _ in counts}
    rows = [(json.loads(k), counts.get((k, True), 0), counts.get((k, False), 0)) for k in sorted(named)]
    total = sum(a + b for _, a, b in rows)
    often: Counter = Counter()
    for features, a, b in rows:
        often.update(dict.fromkeys(features, a + b))
    names = sorted(often, key=lambda f: (-often[f], f))[:FIT_FEATURES]
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (features, _, _) in enumerate(rows):
        x[i, [place[f] for f in features if f in place]] = 1
    n = np.array([[a, b] for _, a, b in rows], dtype=float)
    # Both kinds count alike, however long articles are.
    n *= strength / 2 / np.maximum(1, n.sum(axis=0))
    w = np.zeros(len(names))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        both = n.sum(axis=1)
        slope = x.T @ (n[:, 0] - both * p) - w
        step = np.linalg.solve((x * (both * p * (1 - p))[:, None]).T @ x + np.eye(len(names)), slope)
        w += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return dict(PRIOR) | dict(zip(names, w.tolist(), strict=True)) if total else dict(PRIOR)


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Weights:
    """Weights from at most ``fit_pages`` pages that label their main text by an
    ``article`` or ``main`` element; the prior ones if there are none."""
    labelled = pages.where(F.col("page_id").isNotNull() & F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    # The ids alone are ranked; one page, the first in order, stands for an id.
    chosen = labelled.select(F.col("page_id").alias("__page")).distinct().orderBy(F.xxhash64("__page"), "__page").limit(fit_pages)
    labelled = labelled.join(F.broadcast(chosen), F.col("page_id") == F.col("__page"), "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                seen.update(contexts(page))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())], names=["context", "inside", "n"])

    counted = labelled.select("html").mapInArrow(run, "context string, inside boolean, n long").groupBy("context", "inside").agg(F.sum("n").alias("n"))
    n = {(r["context"], r["inside"]): r["n"] for r in counted.collect()}
    of_tags = {k: v for k, v in n.items() if k[0].startswith('"')}
    if not n:
        return Weights()
    words = learned({k: v for k, v in n.items() if k not in of_tags})

    def of_tag(tag: str) -> float:
        out, into = (of_tags.get((json.dumps(tag), side), 0) + 1 for side in (False, True))
        return TAG_SCORES[0] + (TAG_SCORES[1] - TAG_SCORES[0]) * out / (out + into)

    return Weights(words, {json.loads(k): of_tag(json.loads(k)) for k, _ in of_tags})


def extracted(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Character references are decoded, white space is one space. A null or empty
    page, or one without words, has an empty text; a page that breaks off is
    taken as far as it goes; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
