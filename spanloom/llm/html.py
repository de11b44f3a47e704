"""Main text of web pages: a linear-chain conditional random field over the pages' leaf blocks.

A page is cut into leaf blocks, runs of text between the borders of block elements, each with its open elements.  Two
labels, content and rest, are scored by features of the open elements, of their class and id words and of the text, and by
the step from one block to the next; Viterbi decoding gives the page's labels.  The model is fitted on a bounded sample of
labelled pages (``MAX_PAGES``, by hash of page_id).  Where no labels are given, ``structural_labels`` marks the sample by
the elements that name their role.  For every third page the fit doesn't see those names, so that the other features learn
to stand in for them; into the others it mixes content that is wrapped up as comments, forms, notices and so on, since a
sample may lack some of these.

Defined cases: a null or empty page, and one without content blocks, gives an empty text; end tags may be missing, as may
the rest of a tag at the page's end (it is markup); scripts, styles and comments are never text, nor are a drawing's labels,
a formula's source annotation, templates, frames, text areas and the title; formulas and objects are part of the text around
them; what noscript and select hold is taught as rest; white space, also a
no-break space or a line break element, becomes one space; equal pages give equal texts; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .tokens import slices

MAX_PAGES = 600
MAX_TRAIN_BLOCKS = 400  # blocks in a row that the fit takes at once; longer pages come in several such parts
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z))""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea iframe title".split())
FOREIGN = frozenset("svg math foreignobject annotation annotation-xml".split())
UNSEEN = frozenset("svg annotation annotation-xml".split())
# Start tags that end a drawing or formula left open.
BREAKS = frozenset("address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr li main menu nav ol p pre section table ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words in class, id and role by what they announce.
ROLE_WORDS = {
    "good": "article body content entry main post story text",
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pagination pager toc",
    "ad": "ad ads advert advertisement banner promo promoted sponsor sponsored",
    "notice": "alert consent cookie cookies gdpr modal newsletter notice popup signup subscribe",
    "side": "aside rail related recommended sidebar widget",
    "talk": "comment comments disqus discussion replies reply respond",
    "foot": "copyright footer legal",
    "head": "header masthead topbar",
    "form": "form login register search",
    "share": "share sharing social",
}
ROLE_OF = {w: role for role, ws in ROLE_WORDS.items() for w in ws.split()}
BAD_TAGS = frozenset("nav aside header footer form head button menu dialog label noscript select".split())
GOOD_TAGS = frozenset("article main".split())
TEXT_TAGS = frozenset("p pre blockquote h1 h2".split())


@dataclass(frozen=True, eq=False)
class Place:
    """A spot between open block elements, shared by all that stands there: each element adds its tag and roles once."""

    outer: Place | None
    own: str  # the innermost block element
    tags: frozenset[str]
    roles: frozenset[str]
    trail: object  # equal for equal lines of open block elements

    def inside(self, tag: str, roles: frozenset[str], trail: object) -> Place:
        tags = self.tags if tag in self.tags else self.tags | {tag}
        return Place(self, tag, tags, self.roles if roles <= self.roles else self.roles | roles, trail)


TOP = Place(None, "none", frozenset(), frozenset(), 0)


@dataclass
class Block:
    text: str
    place: Place
    inline: frozenset[tuple[str, int]]  # open inline elements and how many of each
    linked: float  # share of its text inside links

    @property
    def roles(self) -> frozenset[str]:
        return self.place.roles

    def within(self, tags: frozenset[str]) -> bool:
        return not tags.isdisjoint(self.place.tags) or any(t in tags for t, _ in self.inline)


class Line:
    """Open elements, outermost first; the innermost of a tag is found, and elements are closed, at constant cost each."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.where: dict[str, list[int]] = {}

    def add(self, tag: str) -> None:
        self.where.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)

    def last(self, tag: str) -> int:
        """Where the innermost ``tag`` stands, or -1."""
        return (self.where.get(tag) or (-1,))[-1]

    def cut(self, at: int) -> None:
        while len(self.tags) > at:
            self.where[self.tags.pop()].pop()


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order.  The work grows with the page's length, however deep its elements lie."""
    page = page or ""
    out: list[Block] = []
    solid, places = Line(), [TOP]  # block elements, and the place inside each
    inline: Counter[str] = Counter()  # inline elements open inside the innermost block element; they end with it
    trails: dict[tuple[object, str], int] = {}
    text: list[str] = []
    linked, at = 0, 0
    foreign = Line()  # open elements of drawings and formulas; these cut no block
    endless: set[str] = set()  # elements that no end tag follows

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join(entities.unescape("".join(text)).split())
            if said:
                out.append(Block(said, places[-1], frozenset(inline.items()), min(1.0, linked / len(said))))
            text.clear()
        linked = 0

    def close(last: int) -> None:
        solid.cut(last)
        del places[last + 1 :]
        inline.clear()

    while at < len(page):
        start = page.find("<", at)
        stop = len(page) if start < 0 else start
        unseen = bool(foreign.tags) and foreign.tags[-1] in UNSEEN
        if stop > at and not unseen:
            text.append(page[at:stop])
            if inline["a"]:
                linked += stop - at
        if start < 0:
            break
        m = TAG.match(page, start)
        if m is None:  # a sign that opens no tag
            if not unseen:
                text.append("<")
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if foreign.tags and tag not in RAW:
            if m[1] and foreign.last(tag) >= 0:
                foreign.cut(foreign.last(tag))
                continue
            if foreign.tags[-1] != "foreignobject":
                outer = m[1] and tag not in INLINE and solid.last(tag) >= 0
                if not (outer or (not m[1] and tag in BREAKS)):
                    if not m[1] and tag in FOREIGN and not m[3].endswith("/"):
                        foreign.add(tag)
                    continue
                foreign.cut(0)
        if tag in ("svg", "math"):
            if not m[1] and not m[3].endswith("/"):
                foreign.add(tag)
        elif tag == "br":
            text.append(" ")
        elif tag in INLINE:
            inline[tag] += -1 if m[1] else 1
            if inline[tag] <= 0:
                del inline[tag]
        elif m[1]:
            flush()
            if solid.last(tag) >= 0:
                close(solid.last(tag))
        else:
            if foreign.tags and m[3].endswith("/"):
                continue
            if not foreign.tags:
                flush()
            if tag in RAW:
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(tag)
                continue
            if foreign.tags:
                flush()
            if tag in VOID:
                continue
            for i in range(len(solid.tags) - 1, -1, -1):
                if solid.tags[i] in SIBLINGS.get(tag, ()) or (solid.tags[i] == "p" and tag in CLOSES_P):
                    close(i)
                    break
                if solid.tags[i] != "p":
                    break
            inline.clear()  # an inline element left open ends with its block
            said = " ".join(x for g in NAMES.findall(m[3]) for x in g).lower()
            roles = frozenset(ROLE_OF[w] for w in WORD.findall(said) if w in ROLE_OF)
            trail = trails.setdefault((places[-1].trail, tag), len(trails) + 1)
            solid.add(tag)
            places.append(places[-1].inside(tag, roles, trail))
    flush()
    return out


def structural_labels(page: list[Block]) -> list[int]:
    """1 for content by the elements' own names, where a page names any main element; else by tag and length."""
    named = any(b.within(GOOD_TAGS) for b in page)
    out = []
    for b in page:
        bad = b.within(BAD_TAGS) or bool(b.roles - {"good"}) or (b.linked > 0.6 and "article" not in b.place.tags)
        good = b.within(GOOD_TAGS) if named else "good" in b.roles or b.within(TEXT_TAGS)
        out.append(int(good and not bad))
    return out


def wrapped(page: list[Block], rng: random.Random, groups: int = 4) -> list[Block]:
    """``page`` with some of its content repeated inside elements, or under class names, that mark the rest of a page."""
    content = [b for b, y in zip(page, structural_labels(page), strict=True) if y]
    out = list(page)
    for _ in range(groups if content else 0):
        around = rng.choice(content).place.outer or TOP
        tags, roles = around.tags, frozenset()
        if rng.random() < 0.5:
            tags -= GOOD_TAGS
        if rng.random() < 0.5:
            wrapper = rng.choice(sorted(BAD_TAGS))
        else:
            wrapper = rng.choice(("div", "section", "ul"))
            roles = frozenset({rng.choice(sorted(set(ROLE_WORDS) - {"good"}))})
        outer = Place(None, around.own, tags, frozenset(), object()).inside(wrapper, roles, object())
        at = rng.randrange(len(out) + 1)
        again = rng.choices(content, k=rng.randrange(1, 4))
        out[at:at] = [Block(b.text, outer.inside(t, frozenset(), (outer.trail, t)), frozenset(), b.linked) for b in again for t in (rng.choice(("p", "div", "li")),)]
    return out


def describe(page: list[Block], hide: bool = False) -> list[list[str]]:
    """Feature names of each block; ``hide`` leaves out the elements that name their role."""
    rows = []
    for i, b in enumerate(page):
        tags = b.place.tags - (GOOD_TAGS | BAD_TAGS) if hide else b.place.tags
        names = ["bias", f"own:{b.place.own}", *(f"in:{t}" for t in tags if t not in INLINE)]
        if not hide:
            names += [f"role:{r}" for r in b.roles]
        names.append(f"length:{min(11, int(math.log2(len(b.text) + 1)))}")
        names.append(f"linked:{int(b.linked * 4)}")
        names.append("ends" if b.text[-1] in ".!?:;…»”\"'" else "open")
        if "©" in b.text:
            names.append("copyright")
        if i == 0:
            names.append("first")
        if i == len(page) - 1:
            names.append("last")
        if i and (page[i - 1].place.trail, page[i - 1].inline) == (b.place.trail, b.inline):
            names.append("as before")
        rows.append(names)
    return rows


@dataclass
class Field:
    """Weights of a two-label linear chain: one row per feature, a step matrix, and what a page starts with."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    step: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    start: tuple[float, float] = (0.0, 0.0)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the best labels of a page."""
        if not rows:
            return []
        nothing = (0.0, 0.0)
        back: list[tuple[int, int]] = []
        a, b = self.start
        (s00, s01), (s10, s11) = self.step
        for i, names in enumerate(rows):
            e0 = e1 = 0.0
            for n in names:
                w = self.weights.get(n, nothing)
                e0 += w[0]
                e1 += w[1]
            if i:
                to0, to1 = int(b + s10 > a + s00), int(b + s11 > a + s01)
                back.append((to0, to1))
                a, b = (b + s10 if to0 else a + s00) + e0, (b + s11 if to1 else a + s01) + e1
            else:
                a, b = a + e0, b + e1
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by forward and backward sums over all pages at once, with Adam."""
    begins = np.array([i == 0 for r, _ in pages for i in range(0, len(r), MAX_TRAIN_BLOCKS)], bool)
    pages = [(r[i : i + MAX_TRAIN_BLOCKS], y[i : i + MAX_TRAIN_BLOCKS]) for r, y in pages for i in range(0, len(r), MAX_TRAIN_BLOCKS)]
    if not pages:
        return Field()
    names = sorted({n for rows, _ in pages for r in rows for n in r})
    number = {n: i for i, n in enumerate(names)}
    long = max(len(r) for r, _ in pages)
    size = np.array([len(r) for r, _ in pages])
    y = np.zeros((len(pages), long), np.int64)
    rows, cols = [], []
    for p, (page, labels) in enumerate(pages):
        y[p, : len(labels)] = labels
        for t, r in enumerate(page):
            rows += [p * long + t] * len(r)
            cols += [number[n] for n in r]
    rows, cols = np.array(rows), np.array(cols)
    real = np.arange(long)[None, :] < size[:, None]
    total = real.sum()
    hot = np.eye(2)[y] * real[..., None]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
    theta = np.zeros(2 * len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, step, start = theta[: 2 * len(names)].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        e = np.stack([np.bincount(rows, w[cols, k], len(pages) * long) for k in (0, 1)], axis=1).reshape(len(pages), long, 2)
        e[begins, 0] += start
        f = np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for i in range(1, long):
            f[:, i] = np.where(real[:, i, None], np.logaddexp(f[:, i - 1, 0, None] + step[0], f[:, i - 1, 1, None] + step[1]) + e[:, i], f[:, i - 1])
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        g = np.zeros_like(e)
        expected = np.zeros((2, 2))
        for i in range(long - 1, 0, -1):
            after = e[:, i] + g[:, i]
            both = f[:, i - 1, :, None] + step + after[:, None, :] - z[:, None, None]
            expected += (np.exp(both) * real[:, i, None, None]).sum(axis=0)
            g[:, i - 1] = np.where(real[:, i, None], np.logaddexp(step[:, 0] + after[:, 0, None], step[:, 1] + after[:, 1, None]), 0.0)
        q = np.exp(np.minimum(f + g - z[:, None, None], 0)) * real[..., None]
        off = (q - hot).reshape(-1, 2)
        gw = np.stack([np.bincount(cols, off[rows, k], len(names)) for k in (0, 1)], axis=1)
        grad = np.concatenate([gw.ravel(), (expected - pairs).ravel(), (q[:, 0] - hot[:, 0])[begins].sum(axis=0)]) / total + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    w = theta[: 2 * len(names)].reshape(-1, 2)
    return Field({n: (float(w[i, 0]), float(w[i, 1])) for n, i in number.items()}, tuple(map(tuple, theta[-6:-2].reshape(2, 2).tolist())), tuple(theta[-2:].tolist()))


def main_text(page: str | None, model: Field) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, model.decode(describe(found)), strict=True) if y)


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> Field:
    """Fit on about ``max_pages`` pages, chosen by hash of page_id and labelled by ``structural_labels``."""
    n = pages.count()
    portion = int(min(1.0, max_pages / max(n, 1)) * (1 << 30))
    sample = pages.select("page_id", "html").filter(F.pmod(F.xxhash64(F.lit("labelled"), "page_id"), F.lit(1 << 30)) < portion)
    # Bounded by max_pages; a page_id that many rows share can't make it more.
    labelled = []
    for row in sample.limit(2 * max_pages).toLocalIterator():
        page, place = blocks(row["html"]), zlib.crc32(str(row["page_id"]).encode())
        hide = place % 3 == 0
        if not hide:
            page = wrapped(page, random.Random(place))
        labelled.append((describe(page, hide), structural_labels(page)))
    return fit(labelled)


def _extract(model: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(h, model) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """page_id, url, text of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
