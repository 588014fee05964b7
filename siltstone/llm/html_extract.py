"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element of the page is a variable, content or not.  A potential joins it with its parent, by its tag;
another joins it with what is seen of it: words of its class and id, share of its text that is link
text, and length of its text.  Both are estimated by counting on labelled pages, with
smoothing.  On a tree, sum-product is exact: messages go up from the leaves and down from the root,
and give each element's content marginal.  Text whose element is content with a marginal of at least one
half is the article.

Messages are passed for some megabytes of pages at once, level by level.  Time is linear in a page's length, however
deep its elements are nested.

Edge cases: a null page counts as empty and has an empty text; markup that is never closed ends where an element
around it or the page ends; what is not shown (scripts, styles, templates, head, comments, form controls) is
never content; repeated rows are extracted alike; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siltstone.llm.common import chunks, pick, shared
from siltstone.llm.html_pages import page

#: Elements without content, without an end tag, and those whose content is not markup.  Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements of which nothing is shown as text of the page.  Fixed values.
HIDDEN = frozenset("script style template head title noscript textarea select option button iframe svg object audio video canvas annotation annotation-xml".split())
#: Elements that stay within a block.  Fixed values.
INLINE = frozenset(
    "math semantics mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd "
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Open elements that the start of another ends, and where the search for them stops.  Fixed values.
_BLOCK_STARTS = "address article aside blockquote details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
ENDS = {tag: ("p",) for tag in _BLOCK_STARTS} | {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
SCOPES = frozenset("ul ol dl table article section div aside nav header footer main body html form blockquote td th button".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|</?[a-zA-Z][^>]*+(?:>|\Z)""", re.DOTALL
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_CLOSES = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE) for tag in RAW}


class Dom:
    """Elements of one or more pages in order of their start tags, and their texts in page order."""

    def __init__(self):
        self.tags: list[str] = []
        self.names: list[str] = []
        self.parents: list[int] = []
        self.depths: list[int] = []
        #: (element, block, text): block numbers change where a block begins or ends.
        self.texts: list[tuple[int, int, str]] = []

    def _element(self, tag: str, names: str, parent: int) -> int:
        self.tags.append(tag)
        self.names.append(names)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        return len(self.tags) - 1

    def add(self, markup: str | None) -> int:
        """Parse a page; the number of its root, an element of its own that stands above all others."""
        markup = markup or ""
        root = self._element("#page", "", -1)
        stack, block, at, end = _Open(self.tags, root), 0, 0, len(markup)
        texts = self.texts
        while at < end:
            token = _TOKEN.search(markup, at)
            start = token.start() if token else end
            if start > at and not stack.hidden:
                texts.append((stack.top, block, markup[at:start]))
            if not token:
                break
            at = token.end()
            tag = token[2]
            if tag is None:
                continue
            tag = tag.lower()
            if token[1]:
                if tag not in INLINE:
                    block += 1
                stack.close(tag)
                continue
            if tag not in INLINE:
                block += 1
                stack.end_implied(ENDS.get(tag, ()))
            elif tag == "br" and not stack.hidden:
                texts.append((stack.top, block, " "))
            if tag in VOID:
                continue
            attributes = token[3]
            names = " ".join(filter(None, (x for m in _NAMES.findall(attributes) for x in m))).lower() if "=" in attributes else ""
            element = self._element(tag, names, stack.top)
            if tag in RAW and not attributes.endswith("/"):
                close = _CLOSES[tag].search(markup, at)
                at = close.end() if close else end
                continue
            if attributes.endswith("/") and tag in HIDDEN:
                continue
            stack.push(element)
        return root

    def levels(self) -> list[np.ndarray]:
        """The elements of each depth, from the roots on."""
        depths = np.array(self.depths)
        order = np.argsort(depths, kind="stable")
        return np.split(order, np.searchsorted(depths[order], np.arange(1, depths.max(initial=0) + 1)))


class _Open:
    """The elements that are open, with counts by tag, so that a search for one that is not there takes no steps.

    ``within`` counts the elements above the uppermost scope, and for each scope below those between it and the next.
    """

    def __init__(self, tags: list[str], root: int):
        self.tags, self.stack, self.top, self.hidden = tags, [root], root, 0
        self.whole: Counter[str] = Counter()
        self.within: list[Counter[str]] = [Counter()]
        self.scopes: list[str] = []

    def push(self, element: int) -> None:
        tag = self.tags[element]
        self.stack.append(element)
        self.top = element
        self.whole[tag] += 1
        self.hidden += tag in HIDDEN
        if tag in SCOPES:
            self.within.append(Counter())
            self.scopes.append(tag)
        else:
            self.within[-1][tag] += 1

    def pop(self) -> str:
        tag = self.tags[self.stack.pop()]
        self.top = self.stack[-1]
        self.whole[tag] -= 1
        self.hidden -= tag in HIDDEN
        if tag in SCOPES:
            self.within.pop()
            self.scopes.pop()
        else:
            self.within[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """End the uppermost element of the tag, and all above it, if there is one."""
        if self.whole[tag]:
            while self.pop() != tag:
                pass

    def end_implied(self, ended: tuple[str, ...]) -> None:
        """End the elements of these tags, and all above them, down to the first scope that is none of them."""
        while ended:
            here = sum(self.within[-1][t] for t in ended)
            while here:
                here -= self.pop() in ended
            if not self.scopes or self.scopes[-1] not in ended:
                return
            within = len(self.within)
            while len(self.within) == within:
                self.pop()


def _length_bucket(n: np.ndarray) -> np.ndarray:
    return np.minimum(7, np.log2(n + 1) / 1.5).astype(int)


@dataclass
class Model:
    """Counts as logarithms: words and buckets by label, children by tag, parent's and own label."""

    words: dict[str, int]
    emissions: np.ndarray  # (word or bucket, label)
    tags: dict[str, int]
    transitions: np.ndarray  # (tag, parent's label, own label)


def _observed(dom: Dom, words: dict[str, int], grow: bool) -> tuple[np.ndarray, np.ndarray]:
    """(element, number of what is seen of it) for all that is seen; grow: words not met before get a number."""
    n = len(dom.tags)
    parents = np.array(dom.parents)
    length, linked = np.zeros(n), np.zeros(n)
    in_link = np.zeros(n, dtype=bool)
    for i, (tag, parent) in enumerate(zip(dom.tags, dom.parents)):
        in_link[i] = tag == "a" or (parent >= 0 and in_link[parent])
    if dom.texts:
        of = np.array([e for e, _, _ in dom.texts])
        sizes = np.array([len(t) for _, _, t in dom.texts])
        np.add.at(length, of, sizes)
        np.add.at(linked, of[in_link[of]], sizes[in_link[of]])
    for at in reversed(dom.levels()[1:]):
        np.add.at(length, parents[at], length[at])
        np.add.at(linked, parents[at], linked[at])
    share = np.where(length > 0, np.ceil(4 * linked / np.maximum(length, 1)), 5).astype(int)
    who, what = [], []
    for i, names in enumerate(dom.names):
        for word in set(_WORDS.findall(names)) if names else ():
            number = words.get(word)
            if number is None:
                if not grow:
                    continue
                number = words[word] = len(words)
            who.append(i)
            what.append(number)
    buckets = [words.setdefault(f"#length{b}", len(words)) if grow else words[f"#length{b}"] for b in range(8)]
    shares = [words.setdefault(f"#links{b}", len(words)) if grow else words[f"#links{b}"] for b in range(6)]
    everyone = np.arange(n)
    return (
        np.concatenate([np.array(who, dtype=int), everyone, everyone]),
        np.concatenate([np.array(what, dtype=int), np.array(buckets)[_length_bucket(length)], np.array(shares)[share]]),
    )


def train(pages: list[tuple[str, list[int]]], smooth: float = 0.5) -> Model:
    """Count labels of (markup, label of each element) pages."""
    dom, labels = Dom(), []
    for markup, own in pages:
        before = len(dom.tags)
        dom.add(markup)
        found = len(dom.tags) - before - 1
        if found != len(own):
            raise ValueError(f"{len(own)} labels for {found} elements")
        labels += [0, *own]
    y, words = np.array(labels), {}
    who, what = _observed(dom, words, grow=True)
    counts = np.zeros((len(words), 2))
    np.add.at(counts, (what, y[who]), 1)
    totals = np.bincount(y, minlength=2)
    emissions = np.log((counts + smooth) / (totals + 2 * smooth))
    tags = {t: i + 1 for i, t in enumerate(dict.fromkeys(dom.tags))}
    joint = np.zeros((len(tags) + 1, 2, 2))
    for i, parent in enumerate(dom.parents):
        if parent >= 0:
            joint[tags[dom.tags[i]], y[parent], y[i]] += 1
    joint[0] = joint.sum(axis=0)
    whole = joint[0] / joint[0].sum(axis=1, keepdims=True)
    joint[1:] += 2 * smooth * whole
    joint[0] += smooth
    return Model(words, emissions, tags, np.log(joint / joint.sum(axis=2, keepdims=True)))


def marginals(dom: Dom, model: Model) -> np.ndarray:
    """The probability that each element is content, by messages up and down the trees."""
    n = len(dom.tags)
    parents, depths = np.array(dom.parents), np.array(dom.depths)
    kinds = np.array([model.tags.get(t, 0) for t in dom.tags])
    who, what = _observed(dom, model.words, grow=False)
    own = np.zeros((n, 2))
    np.add.at(own, who, model.emissions[what])
    own[depths == 0] = (0.0, -50.0)  # what stands above a page is not content
    moves = model.transitions[kinds]
    levels = dom.levels()
    up = np.zeros((n, 2))  # message from an element to its parent, by the parent's label
    gathered = own.copy()
    for at in reversed(levels[1:]):
        both = moves[at] + gathered[at][:, None, :]
        up[at] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        np.add.at(gathered, parents[at], up[at])
    down = np.zeros((n, 2))  # message from the parent, by the element's own label
    for at in levels[1:]:
        p = parents[at]
        rest = (gathered[p] + down[p] - up[at])[:, :, None] + moves[at]
        down[at] = np.logaddexp(rest[:, 0], rest[:, 1])
    belief = gathered + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


@lru_cache(maxsize=1)
def trained(pages: int = 600) -> Model:
    """The model fitted on that many generated pages."""
    return train([page(seed) for seed in range(pages)])


def _decoded(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def extract_pages(pages: list[str | None], model: Model, least: float = 0.5) -> list[str]:
    """The article text of each page."""
    dom = Dom()
    roots = [dom.add(p) for p in pages]
    if not roots:
        return []
    content = marginals(dom, model) >= least
    blocks: list[list[str]] = [[] for _ in pages]
    which, current, parts = 0, None, []

    def end_block() -> None:
        text = " ".join("".join(parts).split())
        if text:
            blocks[current[0]].append(text)

    ends = [*roots[1:], len(dom.tags)]
    for element, block, text in dom.texts:
        while element >= ends[which]:
            which += 1
        if not content[element]:
            continue
        if current != (which, block):
            if current is not None:
                end_block()
            current, parts = (which, block), []
        parts.append(_decoded(text))
    if current is not None:
        end_block()
    return ["\n".join(b) for b in blocks]


def page_groups(pages: Iterable[str | None], chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """Pages in groups of about so many characters, which are handled at once."""
    group, held = [], 0
    for page in pages:
        group.append(page)
        held += len(page or "")
        if held >= chars:
            yield group
            group, held = [], 0
    yield group


def extract(
    pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of pages."""
    told = shared(model or trained())

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for markup in chunks(batches):
            yield pd.Series([text for group in page_groups(markup) for text in extract_pages(group, told.value)], dtype=object)

    out = pick(pages, id_col, url_col, html_col).select(id_col, url_col, extracted(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
