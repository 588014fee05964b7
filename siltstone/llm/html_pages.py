"""Labelled pages to train the HTML extractor on, made from templates.

No table says which parts of a page are its article, so pages are generated with the answer known: a
layout is drawn at random from the usual ways to mark up an article and what surrounds it, and each
element is labelled as it is written.  Texts are runs of invented words of any length, since what a part
is must be told from the tree, not from the language.
"""

from __future__ import annotations

import random

#: Ways to hold an article, and the parts around it, as (tag, class or id) pairs.  Fixed values.
HOLDERS = (
    ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("section", "story"),
    ("div", "post entry-content"), ("div", "main-text"), ("section", "article"), ("div", "entry"), ("td", "content"), ("div", "body-text"),
)
AROUND = {
    "menu": (("nav", ""), ("nav", "menu"), ("ul", "menu"), ("div", "navigation"), ("div", "navbar"), ("ol", "breadcrumb"), ("div", "toc"), ("div", "pagination")),
    "header": (("header", ""), ("div", "header"), ("header", "site-header"), ("div", "masthead"), ("div", "top-bar"), ("div", "logo")),
    "footer": (("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright"), ("div", "legal")),
    "side": (("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "related"), ("section", "recommended"), ("div", "widget"), ("div", "trending"), ("div", "popular")),
    "notice": (("div", "cookie-notice"), ("div", "notice"), ("div", "banner"), ("div", "consent"), ("div", "alert"), ("dialog", ""), ("div", "popup"), ("div", "modal"), ("section", "gdpr")),
    "advert": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("ins", "adsbygoogle"), ("div", "sponsored"), ("div", "promo"), ("aside", "advertisement")),
    "form": (("form", ""), ("form", "search"), ("form", "login"), ("div", "newsletter"), ("div", "subscribe"), ("form", "signup")),
    "share": (("div", "share"), ("ul", "social"), ("div", "share-buttons"), ("div", "tags"), ("div", "follow")),
    "comments": (("div", "comments"), ("section", "comments"), ("ol", "comment-list"), ("div", "reader-comments"), ("div", "disqus"), ("section", "responses"), ("div", "replies")),
}
WRAPPERS = (("div", ""), ("div", "wrapper"), ("div", "container"), ("div", "page"), ("div", "row"), ("section", ""), ("div", "col"), ("table", ""))


class Page:
    """A page as it is written: html, and the label of each element in order of its start tag."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []

    def words(self, least: int, most: int) -> str:
        n = min(most, max(least, int(self.rng.lognormvariate(2.5, 1.2))))
        return " ".join("".join(self.rng.choice("aeiounrstl") for _ in range(self.rng.randint(1, 9))) for _ in range(n))

    def open(self, tag: str, name: str, content: int) -> None:
        attribute = f' {self.rng.choice(("class", "class", "id"))}="{name}"' if name else ""
        self.html.append(f"<{tag}{attribute}>")
        self.labels.append(content)

    def close(self, tag: str) -> None:
        self.html.append(f"</{tag}>")

    def leaf(self, tag: str, content: int, least: int = 1, most: int = 120, name: str = "") -> None:
        self.open(tag, name, content)
        self.html.append(self.words(least, most))
        for inline in ("b", "i", "a", "em", "span", "strong", "code", "sup", "cite"):
            if tag != "title" and self.rng.random() < 0.06:
                self.open(inline, "", content)
                self.html.append(self.words(1, 4))
                self.close(inline)
        if content and tag == "p" and self.rng.random() < 0.04:
            self.formula()
        self.html.append(self.rng.choice((".", "", "!")))
        self.close(tag)

    def formula(self) -> None:
        for tag in ("math", "mrow"):
            self.open(tag, "", 1)
        for tag in self.rng.choices(("mi", "mo", "mn", "msup", "mfrac", "msqrt", "mtext"), k=self.rng.randint(1, 6)):
            self.open(tag, "", 1)
            if tag in ("msup", "mfrac", "msqrt"):
                for inner in ("mi", "mn"):
                    self.open(inner, "", 1)
                    self.html.append(self.rng.choice("xyz0123"))
                    self.close(inner)
            else:
                self.html.append(self.rng.choice("abxyz0123+="))
            self.close(tag)
        for tag in ("mrow", "math"):
            self.close(tag)

    def links(self, content: int, item: str | None) -> None:
        for _ in range(self.rng.randint(1, 9)):
            if item:
                self.open(item, "", content)
            self.open("a", "", content)
            self.html.append(self.words(1, 4))
            self.close("a")
            if item:
                self.close(item)

    def around(self, kind: str) -> None:
        tag, name = self.rng.choice(AROUND[kind])
        self.open(tag, name, 0)
        if kind == "menu":
            if tag in ("ul", "ol"):
                self.links(0, "li")
            elif self.rng.random() < 0.6:
                self.open("ul", "", 0)
                self.links(0, "li")
                self.close("ul")
            else:
                self.links(0, None)
        elif kind == "form":
            for part in self.rng.sample(("label", "button", "p", "h3", "legend", "option"), 2):
                self.leaf(part, 0, 1, 8)
        elif kind == "comments":
            if self.rng.random() < 0.5:
                self.leaf(self.rng.choice(("h2", "h3", "h4")), 0, 1, 3)
            for _ in range(self.rng.randint(1, 5)):
                inner, its = self.rng.choice((("div", "comment"), ("li", ""), ("article", "comment"), ("div", "reply"), ("p", "")))
                self.open(inner, its, 0)
                if inner == "p":
                    self.html.append(self.words(1, 60))
                else:
                    for _ in range(self.rng.randint(1, 3)):
                        self.leaf("p", 0, 1, 60)
                self.close(inner)
        else:
            if self.rng.random() < 0.4:
                self.html.append(self.words(1, 12))
            for _ in range(self.rng.randint(0, 3)):
                self.leaf(self.rng.choice(("p", "h2", "h3", "span", "div", "a", "small")), 0, 1, 30)
            if self.rng.random() < 0.3:
                self.open("ul", "", 0)
                self.links(0, "li")
                self.close("ul")
        self.close(tag)

    def article(self) -> None:
        tag, name = self.rng.choice(HOLDERS)
        self.open(tag, name, 1)
        inner = self.rng.random() < 0.15
        if inner:
            self.open(*self.rng.choice((("div", ""), ("section", ""), ("div", "text"))), 1)
            inner = self.html[-1][1:].split(" ")[0].rstrip(">")
        if self.rng.random() < 0.8:
            self.leaf("h1", 1, 1, 12)
        for _ in range(self.rng.randint(1, 14)):
            kind = self.rng.random()
            if kind < 0.75:
                self.leaf("p", 1)
            elif kind < 0.82:
                self.leaf(self.rng.choice(("h2", "h3", "h4")), 1, 1, 10)
            elif kind < 0.87:
                self.open(which := self.rng.choice(("ul", "ol")), "", 1)
                for _ in range(self.rng.randint(1, 5)):
                    self.leaf("li", 1, 1, 30)
                self.close(which)
            elif kind < 0.90:
                self.open("blockquote", "", 1)
                self.leaf("p", 1, 1, 40)
                self.close("blockquote")
            elif kind < 0.92:
                self.leaf(self.rng.choice(("pre", "div", "figcaption", "td")), 1, 1, 40)
            else:
                self.around(self.rng.choice(("advert", "share", "side", "form", "notice", "menu")))
        if self.rng.random() < 0.1:
            self.around("comments")
        if inner:
            self.close(inner)
        self.close(tag)


def page(seed: int) -> tuple[str, list[int]]:
    """A page, and for each of its elements in order whether it belongs to the article."""
    rng = random.Random(seed)
    p = Page(rng)
    p.open("html", "", 0)
    p.open("head", "", 0)
    p.leaf("title", 0, 1, 10)
    p.close("head")
    p.open("body", "", 0)
    wraps = []
    for _ in range(rng.choice((0, 0, 1, 2))):
        wraps.append(rng.choice(WRAPPERS))
        p.open(*wraps[-1], 0)
    for kind in rng.sample(("menu", "header", "notice", "advert", "form", "side", "menu"), rng.randint(1, 4)):
        p.around(kind)
    p.article()
    for kind in rng.sample(("comments", "footer", "side", "advert", "share", "form", "menu", "notice"), rng.randint(1, 4)):
        p.around(kind)
    for tag, _ in reversed(wraps):
        p.close(tag)
    p.close("body")
    p.close("html")
    return "".join(p.html), p.labels
