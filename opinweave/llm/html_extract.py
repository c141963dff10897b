"""Main-text extraction with a tree-structured graphical model over the DOM.

A page becomes a tree of elements. Each element has a binary state, content or not, a potential
from its features (tag, words of its class and id, length of its text in and outside links, share
of links in its own block), and a potential with its parent for the four combinations of states,
of which there is a table for each kind of child: one whose tag or names speak for content,
against it, both or neither. Sum-product messages pass from
the leaves to the root and back, for all pages of a batch at once, level by level, and give
every element's marginal. The weights are trained on labelled pages by gradient ascent of the
likelihood, whose gradient is observed minus expected features, both from the same messages.

An element's own text counts if its marginal is above one half; text inside an inline element
belongs to the block around it. Blocks are joined in page order by one space.

Scripts, styles, graphics, form choices and the like are no text of the page. One that is never
closed ends with the element around it, an option at the next one or the next block; a script or
style, as in HTML, at its own end tag only. Formulas are text of the block around them.

Cases: a null or empty page gives an empty text; unclosed elements end with their parents or
where HTML ends them; pages without any tag are one block of text; very deep pages cost a level
of messages per depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, small_batches
from .html_pages import labelled_pages

# Element names of HTML.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SILENT = frozenset(
    "script style noscript template iframe object svg canvas select textarea title".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr"
    " math annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom"
    " mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover"
    " none semantics".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hr main menu nav ol p pre section table ul".split()
)
# An element that starts ends an open one of the same group, up to the group's container.
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

TAGS = [
    ["article"], ["main"], ["section"], ["div"], ["p"], ["h1"], ["h2", "h3", "h4", "h5", "h6"],
    ["ul", "ol", "dl", "menu"], ["li", "dt", "dd"], ["table", "tbody", "tr", "td", "th"],
    ["blockquote", "pre", "figure", "figcaption"], ["nav"], ["header"], ["footer"], ["aside"],
    ["form", "fieldset", "button", "input", "label", "dialog"], ["head", "title"], ["body", "html"],
]
HINTS = [
    r"article|content|entry|main|post|story|text|body",
    r"nav|menu|breadcrumb|tabs?|pagination|pager|toolbar",
    r"header|masthead|logo|brand|topbar",
    r"footer|copyright|legal|imprint",
    r"side|sidebar|widget|related|recommend\w*|promo|popular|teaser",
    r"ads?|advert\w*|sponsor\w*|banner|commercial",
    r"cookies?|notice|consent|gdpr|alert|popup|modal|overlay|warning|newsletter|subscribe|signup|paywall",
    r"comment\w*|discussion|discuss|reply|replies|respond|disqus|thread|feedback",
    r"share|social|follow|login|search",
]
_HINT = [re.compile(rf"(?:^|[\s_\-])(?:{h})(?:\d|$|[\s_\-])", re.I) for h in HINTS]
_TAG_OF = {t: i for i, group in enumerate(TAGS) for t in group}
LINK, LENGTH = len(TAGS) + len(HINTS), [0, 1, 20, 80, 250]
N_FEATURES = LINK + 3 + 3 * len(LENGTH) + 1
#: Tag groups that speak for content and against it; the first hint speaks for it, all others against.
FOR, AGAINST = {_TAG_OF["article"], _TAG_OF["main"]}, {_TAG_OF[t] for t in ("nav", "header", "footer", "aside", "form")}
KINDS = 4
ROUNDS, RATE, DECAY = 800, 0.5, 1e-4


class Page(HTMLParser):
    """The elements of a page (0 is the root) and its runs of text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.hint, self.mark = ["html"], [-1], [()], [None]
        self.open = [0]
        self.silent: list[str] = []  # an open silent element and the open ones in it
        self.option = 0  # open elements when an option outside a select began
        self.runs: list[tuple[int, int, str]] = []  # block, element, text; element -1: a break
        self.feed(html)
        self.close()

    def _end_open(self, names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[k]]
            if tag in until:
                return
            if tag in names:
                self._shut(k)
                self._break()
                return

    def _shut(self, k: int) -> None:
        del self.open[k:]
        if k < self.option:
            self.option = 0

    def _break(self) -> None:
        self.runs.append((self.open[-1], -1, ""))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            if tag == "select" and self.silent[0] == tag:
                self.silent = []  # a select never holds another
            elif tag not in VOID:
                self.silent.append(tag)
            return
        if tag in SILENT:
            self.silent = [tag]
            return
        if tag == "option":
            self._break()
            self.option = len(self.open)
            return
        if tag in CLOSES_P or tag in SAME_LEVEL:
            self.option = 0
        if tag in CLOSES_P:
            self._end_open({"p"}, frozenset(("button", "td", "th", "li", "div", "article", "section", "blockquote")))
        if tag in SAME_LEVEL:
            self._end_open(*SAME_LEVEL[tag])
        if tag not in INLINE:
            self._break()
        if tag in VOID:
            return
        if tag in ("html", "body") and tag in (self.tag[i] for i in self.open[:2]):
            return
        given = dict(attrs)
        names = " ".join(given.get(k) or "" for k in ("class", "id", "role"))
        hint = tuple(i for i, p in enumerate(_HINT) if p.search(names)) if names.strip() else ()
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.hint.append(hint)
        self.mark.append(True if "y" in given else False if "n" in given else None)
        self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in CLOSES_P:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
                return
            if not self._opened(tag):
                return
            self.silent = []  # never closed: it ends with the element around it
        if tag == "option":
            self.option = 0
        if tag not in INLINE:
            self._break()
        k = self._opened(tag)
        if k:
            self._shut(k)

    def _opened(self, tag: str) -> int:
        """Where the open element is that an end tag ends, 0 for none."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] == tag:
                return k
            if tag in INLINE and self.tag[self.open[k]] not in INLINE:
                break  # an inline end never ends a block
        return 0

    def handle_data(self, data: str) -> None:
        if self.silent or self.option:
            return
        at = self.open[-1]
        block = at
        while self.tag[block] in INLINE and block:
            block = self.parent[block]
        self.runs.append((block, at, data))

    def depths(self) -> np.ndarray:
        out = np.zeros(len(self.parent), np.int64)
        for i in range(1, len(out)):
            out[i] = out[self.parent[i]] + 1
        return out

    def features(self) -> np.ndarray:
        n = len(self.tag)
        x = np.zeros((n, N_FEATURES))
        own, linked, block, block_linked = (np.zeros(n) for _ in range(4))
        in_link = [False] * n
        for i in range(n):
            in_link[i] = self.tag[i] == "a" or (i > 0 and in_link[self.parent[i]])
            group = _TAG_OF.get(self.tag[i])
            if group is not None:
                x[i, group] = 1
            for h in self.hint[i]:
                x[i, len(TAGS) + h] = 1
        for around, at, text in self.runs:
            if at >= 0:
                size = len(text.strip())
                own[at] += size
                linked[at] += size * in_link[at]
                block[around] += size
                block_linked[around] += size * in_link[at]
        for i in range(n - 1, 0, -1):  # an element's text is its own and its children's
            own[self.parent[i]] += own[i]
            linked[self.parent[i]] += linked[i]
        x[:, LINK] = linked / np.maximum(own, 1)
        x[:, LINK + 1] = block_linked / np.maximum(block, 1)
        x[:, LINK + 2] = np.minimum(np.log1p(own) / 8, 1.5)
        for k, least in enumerate(LENGTH):
            x[:, LINK + 3 + k] = own > least
            x[:, LINK + 3 + len(LENGTH) + k] = own - linked > least
            x[:, LINK + 3 + 2 * len(LENGTH) + k] = block - block_linked > least
        x[:, -1] = 1
        return x

    def kinds(self) -> np.ndarray:
        """Of every element whether its tag or names speak for content (1), against it (2), both (3) or neither."""
        out = np.zeros(len(self.tag), np.int64)
        for i, (tag, hints) in enumerate(zip(self.tag, self.hint, strict=True)):
            group = _TAG_OF.get(tag)
            out[i] = (group in FOR or 0 in hints) + 2 * (group in AGAINST or any(hints))
        return out

    def text(self, content: np.ndarray) -> str:
        """The blocks whose element is content, in page order."""
        out: list[str] = []
        held: list[str] = []
        block = -1
        for at, element, text in self.runs:
            if element < 0 or at != block:
                out.append("".join(held))
                held, block = [], at
            if element >= 0 and content[at]:
                held.append(text)
        out.append("".join(held))
        return " ".join(" ".join(out).split())


class Forest:
    """Many trees in one set of arrays, with the levels of their elements."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, self.first[:-1], strict=True)])
        depth = np.concatenate([p.depths() for p in pages])
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.features = np.concatenate([p.features() for p in pages])
        self.kind = np.concatenate([p.kinds() for p in pages])

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of elements (n x 2) and of parent and child (n x 2 x 2), and the log partition."""
        own = np.stack([np.zeros(len(self.parent)), self.features @ weights], axis=1)
        up = own.copy()  # log potential of an element and all below it
        to_parent = np.zeros_like(own)
        for level in self.levels[:0:-1]:
            joint = pair[self.kind[level]] + up[level][:, None, :]
            to_parent[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(up, self.parent[level], to_parent[level])
        down = np.zeros_like(own)
        pairs = np.zeros((len(own), 2, 2))
        for level in self.levels[1:]:
            outside = (up + down)[self.parent[level]] - to_parent[level]
            joint = outside[:, :, None] + pair[self.kind[level]]
            down[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            both = joint + up[level][:, None, :]
            both -= np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None]
            pairs[level] = np.exp(both)
        belief = up + down
        whole = np.logaddexp(belief[:, 0], belief[:, 1])
        return np.exp(belief - whole[:, None]), pairs, float(whole[self.levels[0]].sum())


def train(pages: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and the parent-child tables, from pages with ``y`` and ``n`` marks.

    Text or paragraphs of the article outside any element make the root content.
    """
    parsed = [Page(p) for p in (labelled_pages() if pages is None else pages)]
    forest = Forest(parsed)
    state = np.zeros(len(forest.parent), np.int64)
    for page, first in zip(parsed, forest.first[:-1], strict=True):
        bare = any(at == 0 and text.strip() for _, at, text in page.runs)
        state[first] = bare or any(p == 0 and t == "p" and y for p, t, y in zip(page.parent, page.tag, page.mark, strict=True))
        for i in range(1, len(page.tag)):
            mark = page.mark[i]
            state[first + i] = state[first + page.parent[i]] if mark is None else mark
    child = np.concatenate(forest.levels[1:])
    kind = forest.kind[child]
    seen_pair = np.zeros((KINDS, 2, 2))
    np.add.at(seen_pair, (kind, state[forest.parent[child]], state[child]), 1)
    seen = state @ forest.features
    weights, pair = np.zeros(N_FEATURES), np.zeros((KINDS, 2, 2))
    speed_w, speed_p = np.full(N_FEATURES, 1e-8), np.full(pair.shape, 1e-8)
    for _ in range(ROUNDS):
        single, pairs, _ = forest.marginals(weights, pair)
        step_w = (seen - single[:, 1] @ forest.features) / len(state) - DECAY * weights
        expected = np.zeros_like(pair)
        np.add.at(expected, kind, pairs[child])
        step_p = (seen_pair - expected) / len(state) - DECAY * pair
        speed_w += step_w**2
        speed_p += step_p**2
        weights += RATE * step_w / np.sqrt(speed_w)
        pair += RATE * step_p / np.sqrt(speed_p)
    return weights, pair


def extract(htmls: list[str], weights: np.ndarray, pair: np.ndarray) -> list[str]:
    """The main texts of pages."""
    pages = [Page(h) for h in htmls]
    if not pages:
        return []
    forest = Forest(pages)
    content = forest.marginals(weights, pair)[0][:, 1] > 0.5
    return [
        p.text(content[a:b]) for p, a, b in zip(pages, forest.first[:-1], forest.first[1:], strict=True)
    ]


def extract_pages(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All columns but ``html``, with the main text in ``out`` and its length in ``n_chars``."""
    bounded_batches(pages)
    weights, pair = train()
    kept = [c for c in pages.columns if c not in (html, out, "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, html, 2 << 20):
            cells = batch.column(batch.schema.get_field_index(html)).to_pylist()
            texts = extract([c or "" for c in cells], weights, pair)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, out, "n_chars"])

    rows = pages.select(*kept, html)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != html]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{out}` STRING", "n_chars BIGINT"]))
