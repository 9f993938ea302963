"""Operator 4, HTML extraction by a linear-chain CRF over the leaf blocks.

A page becomes its sequence of leaf blocks: runs of text between block-level
tags, with the tags and class names they stand in.  Scripts, styles, the head,
comments and form controls have no text.  The CRF labels each block article or
not from its ancestor tags, class names and text; it is trained by gradient
steps on labelled pages and decoded by Viterbi.

Labelled pages are a bounded sample of the given ones in which a landmark
(``article``, ``main`` or ``articleBody``) says what the article is, and the
same texts set into layouts whose parts are known: menus, headers, sidebars,
notices, adverts, forms, related links, reader comments and footers, with
landmarks and without.

Cases: null, empty and textless pages give an empty text; broken nesting,
unclosed tags and stray angle brackets are read as browsers do, roughly; null
ids and urls and repeated rows are pages like any other; an empty table gives
no rows; an input column called like a result column is replaced by it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chains import Chains, adam
from .common import add_fields, without

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript template head title textarea select option button "
                    "svg math iframe object canvas audio video".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag ends an open element of these before the nearest stop.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>\"'<]*+))")
NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
FEATURE_BITS = 16
NEAREST = 12  # ancestors that features look at one by one
FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
          T.StructField("n_blocks", T.IntegerType())]


class Ends:
    """Where tags end: the first ``>`` outside quotes behind a place.  A tag without one is
    text.  Quotes and ends are listed once and every answer is kept for the places passed
    on the way, so a page full of broken tags costs no more than its length."""

    def __init__(self, html: str):
        self.of = {c: [m.start() for m in re.finditer(c, html)] for c in "\"'>"}
        self.marks = sorted(p for places in self.of.values() for p in places)
        self.html, self.known = html, {}

    def next(self, char: str, at: int) -> int:
        """The next ``char`` from ``at`` on, or -1."""
        places = self.of[char]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def tag(self, at: int) -> int:
        """The ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        passed, end = [], -1
        k = bisect_left(self.marks, at)
        while k < len(self.marks):
            if k in self.known:
                end = self.known[k]
                break
            passed.append(k)
            mark = self.marks[k]
            if self.html[mark] == ">":
                end = mark
                break
            close = self.next(self.html[mark], mark + 1)
            if close < 0:
                break
            k = bisect_left(self.marks, close + 1)
        for k in passed:
            self.known[k] = end
        return end


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of the tags, comments and declarations (no
    name); text that looks like the start of a tag but has no end is no tag.  Sending a
    place goes on from there."""
    ends, at = Ends(html), 0
    while True:
        m = OPENING.search(html, at)
        if m is None:
            return
        if m.group(1):
            end = html.find("-->", m.end())
            stop = len(html) if end < 0 else end + 3
        elif m.group(2):
            stop = ends.next(">", m.end()) + 1
        else:
            stop = ends.tag(m.end()) + 1
        if not stop:
            at = m.end()
            continue
        name = m.group(4) or ""
        goto = yield m.start(), stop, bool(m.group(3)), name.lower(), html[m.end():stop - 1] if name else ""
        at = stop if goto is None else goto


class Block:
    """A leaf block: its text and what it stands in."""

    __slots__ = ("text", "tags", "names", "all_tags", "linked")

    def __init__(self, text, tags, names, all_tags, linked):
        self.text, self.tags, self.names, self.all_tags, self.linked = text, tags, names, all_tags, linked


def leaf_blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    inside: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                near = open_[-NEAREST:]
                out.append(Block(text, [t for t, _ in near], [n for _, names in near for n in names],
                                 frozenset(inside), linked / max(len(text), 1)))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        for tag, _ in open_[upto:]:
            inside[tag] -= 1
            if not inside[tag]:
                del inside[tag]
        del open_[upto:]

    def nearest(tags: set[str], stops: set[str]) -> int:
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] in tags:
                return k
            if open_[k][0] in stops:
                return -1
        return -1

    def words(raw: str) -> None:
        nonlocal linked
        if raw and not silent:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if inside.get("a"):
                linked += len(text)

    at, silent = 0, 0  # silent: open elements without text
    found, goto = tags(html), None
    while True:
        try:
            start, stop, closing, tag, attributes = found.send(goto)
        except StopIteration:
            words(html[at:])
            break
        words(html[at:start])
        at, goto = stop, None
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if closing:
            if inside.get(tag):
                k = nearest({tag}, set())
                close(k)
                silent = sum(inside.get(t, 0) for t in NO_TEXT) if silent else 0
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK and inside.get("p"):
            k = nearest({"p"}, {"table", "div", "article", "section", "button", "li", "td"})
            if k >= 0:
                close(k)
        if tag in ENDS:
            k = nearest(*ENDS[tag])
            if k >= 0:
                close(k)
        if tag == "body" and inside.get("head"):
            close(nearest({"head"}, set()))
            silent = sum(inside.get(t, 0) for t in NO_TEXT)
        names = tuple(dict.fromkeys(
            w for x in NAMES.findall(attributes) for w in WORD.findall("".join(x).lower()))) \
            if attributes else ()
        open_.append((tag, names))
        inside[tag] += 1
        if tag in NO_TEXT:
            silent += 1
        if tag in RAW:  # everything up to its own end is no markup
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = goto = end.start() if end else len(html)
    flush()
    return out


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def block_features(blocks: list[Block]) -> list[list[int]]:
    """Feature numbers of each block: ancestor tags, class names and text."""
    out = []
    for k, b in enumerate(blocks):
        words = b.text.split()
        n = len(words)
        own = [f"tag {b.tags[-1] if b.tags else ''}", f"words {_bucket(n, (2, 4, 7, 12, 20, 40, 80))}",
               f"linked {_bucket(b.linked, (0.05, 0.3, 0.6, 0.9))}",
               f"stop {b.text[-1] in '.!?…\"”»'}", f"commas {_bucket(b.text.count(',') / n, (0.01, 0.05, 0.2))}",
               f"sign {any(c in b.text for c in '©®™|»›·')}", f"digits {_bucket(sum(map(str.isdigit, b.text)) / len(b.text), (0.02, 0.2))}",
               f"place {_bucket(k / len(blocks), (0.1, 0.3, 0.7, 0.9))}", "every"]
        own += [f"in {t}" for t in b.all_tags]
        own += [f"path {a} {c}" for a, c in zip(b.tags[-4:-1], b.tags[-3:], strict=True)] if len(b.tags) > 3 else []
        own += [f"name {x}" for x in dict.fromkeys(b.names)]
        if n <= 8:
            own += [f"word {w}" for w in WORD.findall(b.text.lower())]
        out.append([zlib.crc32(x.encode()) >> (32 - FEATURE_BITS) for x in dict.fromkeys(own)])
    return out


# Parts of the layouts that training pages are set in.  Names that sites give
# such parts; any order of them does.
OUTSIDE = {
    "menu": (("nav", ""), ("div", "nav menu"), ("div", "navbar"), ("ul", "main-menu"), ("div", "navigation")),
    "header": (("header", ""), ("div", "header"), ("div", "site-header masthead"), ("div", "topbar")),
    "sidebar": (("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "side-column related")),
    "notice": (("div", "cookie-notice"), ("div", "banner consent"), ("div", "notice alert"), ("div", "gdpr")),
    "advert": (("div", "ad"), ("div", "advert"), ("div", "promo sponsored"), ("ins", "adsbygoogle")),
    "form": (("form", ""), ("form", "newsletter subscribe"), ("div", "search-form login")),
    "comments": (("section", "comments"), ("div", "comment-list"), ("div", "comment reply"), ("ol", "responses")),
    "footer": (("footer", ""), ("div", "footer"), ("div", "site-footer copyright"), ("div", "legal")),
    "share": (("div", "share social"), ("div", "breadcrumb"), ("div", "tags meta"), ("p", "byline-share")),
}
HOLDERS = (("article", ""), ("main", ""), ("div", "article-body"), ("div", "post-content"),
           ("div", "entry-content"), ("div", "content"), ("section", "story"), ("div", ""), ("body", ""))
SHORT = {"notice": "We use cookies to give you the best experience . Accept", "form": "Subscribe to our newsletter Sign up",
         "footer": "© All rights reserved · Privacy · Terms", "share": "Share Tweet Print", "advert": "Advertisement"}


def layout(title: str, paragraphs: list[str], other: list[str], rng: np.random.Generator
           ) -> tuple[str, list[str]]:
    """A page with these texts in a random layout, and its article's blocks."""
    pick = lambda x: x[int(rng.integers(len(x)))]

    def outside(kind: str) -> str:
        tag, name = pick(OUTSIDE[kind])
        few = [" ".join(pick(other).split()[:int(rng.integers(1, 5))]) for _ in range(int(rng.integers(2, 7)))]
        if kind in ("menu", "sidebar") and rng.random() < 0.7:
            inner = "<ul>" + "".join(f'<li><a href="#">{x}</a></li>' for x in few) + "</ul>"
        elif kind == "comments":
            inner = "".join(f'<div class="comment"><b>{few[0]}</b><p>{pick(other)}</p></div>'
                            for _ in range(int(rng.integers(1, 4))))
        elif kind in SHORT and rng.random() < 0.6:
            inner = f"<p>{SHORT[kind]}</p>" if rng.random() < 0.5 else SHORT[kind]
        else:
            inner = f"<p>{pick(other)}</p>" if rng.random() < 0.5 else pick(other)
        return f'<{tag} class="{name}">{inner}</{tag}>'

    body, article = "", []
    for kind in ("header", "menu", "notice", "share", "advert", "sidebar"):
        body += outside(kind) if rng.random() < 0.5 else ""
    tag, name = pick(HOLDERS)
    body += f'<{tag} class="{name}">' if tag != "body" else ""
    if rng.random() < 0.8:
        body += f"<h1>{title}</h1>"
        article.append(title)
    for x in paragraphs:
        if rng.random() < 0.08:
            body += outside(pick(("advert", "share", "form", "sidebar")))
        kind = pick(("p", "p", "p", "p", "p", "h2", "li", "blockquote"))
        x = " ".join(x.split()[:8]) if kind == "h2" else x
        body += f"<ul><li>{x}</li></ul>" if kind == "li" else f"<{kind}>{x}</{kind}>"
        article.append(x)
    for kind in ("share", "comments") if tag not in ("body",) and rng.random() < 0.3 else ():
        body += outside(kind)
    body += f"</{tag}>" if tag != "body" else ""
    for kind in ("share", "sidebar", "form", "comments", "advert", "menu", "notice", "footer"):
        body += outside(kind) if rng.random() < 0.4 else ""
    return f"<html><body>{body}</body></html>", article


def layout_labels(blocks: list[Block], article: list[str]) -> list[int]:
    """1 for the blocks of a layout that are its article's: a part around it may
    hold the same text."""
    wanted = {" ".join(x.split()) for x in article}
    around = {w for kinds in OUTSIDE.values() for _, names in kinds for w in WORD.findall(names)}
    return [int(b.text in wanted and SET_ASIDE.isdisjoint(b.all_tags) and around.isdisjoint(b.names))
            for b in blocks]


LANDMARKS = frozenset(("article", "main"))
SET_ASIDE = frozenset("nav aside footer form header".split())


def landmark_labels(blocks: list[Block]) -> list[int] | None:
    """1 for the blocks of the page's landmark, 0 for others; None without one."""
    found = [int((not LANDMARKS.isdisjoint(b.all_tags) or "articlebody" in b.names)
                 and SET_ASIDE.isdisjoint(b.all_tags) and "comment" not in b.names
                 and "comments" not in b.names) for b in blocks]
    return found if 0 < sum(found) else None


class Model:
    def __init__(self) -> None:
        self.weights = np.zeros((1 << FEATURE_BITS, 2))
        self.moves = np.zeros((2, 2))

    def emissions(self, features: list[list[int]]) -> np.ndarray:
        edge = np.concatenate(([0], np.cumsum([len(f) for f in features])))[:-1]
        flat = np.array([x for f in features for x in f])
        return np.add.reduceat(self.weights[flat], edge, axis=0)


def fit(pages: list[str], *, layouts: int = 3, steps: int = 60, rate: float = 0.1, decay: float = 1e-4,
        seed: int = 11) -> Model:
    """A model from pages: those with a landmark as they are, and their texts in
    ``layouts`` random layouts each."""
    rng = np.random.default_rng(seed)
    labelled: list[tuple[list[Block], list[int]]] = []
    for html in sorted(pages):
        blocks = leaf_blocks(html)
        labels = landmark_labels(blocks)
        if labels is None:
            continue
        labelled.append((blocks, labels))
        own = [b.text.replace("<", "").replace("&", "") for b, y in zip(blocks, labels, strict=True) if y]
        for _ in range(layouts):
            some = own[:1 + int(rng.integers(1, 14))]
            made, article = layout(own[0][:80], some[1:] or some, own, rng)
            blocks_ = leaf_blocks(made)
            y = layout_labels(blocks_, article)
            labelled.append((blocks_, y))
    model = Model()
    if not labelled:
        return model
    features = [f for blocks, _ in labelled for f in block_features(blocks)]
    gold = np.array([y for _, labels in labelled for y in labels])
    begins = np.zeros(len(gold), bool)
    begins[np.cumsum([0, *(len(b) for b, _ in labelled)])[:-1][[len(b) > 0 for b, _ in labelled]]] = True
    chains = Chains(begins, len(gold) + 1)
    follows = np.ones(len(gold), bool)
    follows[chains.first] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[np.flatnonzero(follows) - 1], gold[follows]), 1)
    flat, size = np.array([x for f in features for x in f]), np.array([len(f) for f in features])
    edge = np.cumsum(size) - size

    def gradient(_: int) -> list[np.ndarray]:
        emit = np.add.reduceat(model.weights[flat], edge, axis=0)
        found, moved, _z = chains.marginals(emit, model.moves)
        found[np.arange(len(gold)), gold] -= 1
        out = np.stack([np.bincount(flat, np.repeat(found[:, k], size), len(model.weights))
                        for k in range(2)], axis=1)
        return [out / len(gold) + decay * model.weights, (moved - seen) / len(gold)]

    adam([model.weights, model.moves], gradient, steps, rate)
    return model


def train(pages: DataFrame, *, html_col: str = "html", most: int = 300, seed: int = 5) -> Model:
    """Fit on a sample of about ``most`` pages, chosen by a hash of the page."""
    rows = pages.select(F.col(f"`{html_col}`").alias("html")).where("html is not null")
    total = max(rows.count(), 1)
    chance = F.pmod(F.xxhash64(F.lit(seed), "html"), F.lit(1 << 30)) / float(1 << 30)
    return fit([r["html"] for r in rows.where(chance < most / total).limit(2 * most).collect()])


def extract(pages: DataFrame, model: Model, *, html_col: str = "html") -> DataFrame:
    """``pages`` with the article's ``text``, ``n_chars`` and ``n_blocks``."""
    pages = without(pages, [f.name for f in FIELDS])
    sent = pages.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.weights, own.moves = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts, counts = [""] * batch.num_rows, [0] * batch.num_rows
                blocks = [leaf_blocks(x) if x else [] for x in batch.column(html_col).to_pylist()]
                features = [f for b in blocks for f in block_features(b)]
                if features:
                    emit = own.emissions(features)
                    first = np.cumsum([0, *(len(b) for b in blocks)])
                    begins = np.zeros(len(features), bool)
                    begins[first[:-1][[len(b) > 0 for b in blocks]]] = True
                    label = Chains(begins, len(features) + 1).best(emit, own.moves)
                    for k, b in enumerate(blocks):
                        kept = [x.text for x, y in zip(b, label[first[k]:first[k + 1]], strict=True) if y]
                        texts[k], counts[k] = "\n".join(kept), len(kept)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string()),
                     pa.array([len(x) for x in texts], pa.int64()), pa.array(counts, pa.int32())],
                    [*batch.schema.names, *[f.name for f in FIELDS]])

    return pages.mapInArrow(run, add_fields(pages.schema, FIELDS))
