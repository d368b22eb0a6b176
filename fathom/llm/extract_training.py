"""Training of the block classifier of ``extract`` on generated layouts.

A layout is a page of random words: an article in one of many kinds of container, under wrappers of any name, among menus,
headers, footers, sidebars, notices, adverts, forms, related lists and reader comments, by tag, by role or by name alone.
Every block is labelled by the part that it was made for. ``fit`` learns the weights that ``extract`` stores.
"""

from __future__ import annotations

import random

import numpy as np

from fathom.llm import extract

_WRAPPERS = ["", "css-1x9", "page", "tags-page", "social-science", "search-engines", "menu-planning", "ad-hoc", "layout", "wrapper", "site", "has-sidebar", "header-on-top", "row"]
_BODIES = ["css-8kq", "content", "post-content", "entry", "story-body", "main-content", "article-text", "x12", "prose", "", "text-col", "head-to-head", "tag-team"]
_ASIDES = ["sidebar", "related-posts", "advert", "ad", "cookie-notice", "newsletter-signup", "share-bar", "popular", "site-header", "site-footer", "breadcrumbs", "promo-box", "trending", "widget", "top-menu", "legal", "sidebar-weather", "ad-slot", "footer-contact", "promo-summer"]


class Layout:
    """One page: its markup, and for each block in page order whether it is the article's."""

    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.labels = rng, [], []
        self._page()
        self.html = "".join(self.parts)

    def words(self, least: int, most: int, stops: bool = True) -> str:
        own = ["".join(self.rng.choices("abcdefghijklmnoprstuvw", k=self.rng.randrange(2, 9))) for _ in range(self.rng.randrange(least, most + 1))]
        text = " ".join(w + ("," if stops and self.rng.random() < 0.08 else "") for w in own)
        return text.capitalize() + ("." if stops else "")

    def block(self, tag: str, text: str, content: bool, link: bool = False) -> None:
        self.parts.append(f"<{tag}>" + (f'<a href="/x">{text}</a>' if link else text) + f"</{tag}>")
        self.labels.append(content)

    def open(self, tag: str, name: str = "", role: str = "") -> str:
        where = self.rng.choice(("class", "class", "id"))
        self.parts.append(f"<{tag}" + (f' {where}="{name}"' if name else "") + (f' role="{role}"' if role else "") + ">")
        return f"</{tag}>"

    def menu(self) -> None:
        close = self.open(*self.rng.choice([("nav", ""), ("div", "menu"), ("div", "top-nav"), ("div", "", "navigation"), ("nav", "css-2")]))
        self.parts.append("<ul>")
        for _ in range(self.rng.randrange(2, 8)):
            self.block("li", self.words(1, 3, False), False, True)
        self.parts.append("</ul>" + close)

    def aside(self) -> None:
        kinds = [("aside", ""), ("aside", "css-7"), ("div", "", "complementary"), ("dialog", ""), ("div", "", "alert"), *[("div", n) for n in _ASIDES], *[("section", n) for n in _ASIDES[:6]]]
        close = self.open(*self.rng.choice(kinds))
        if self.rng.random() < 0.4:
            self.block("h3", self.words(1, 4, False), False)
        for _ in range(self.rng.randrange(1, 4)):
            linked = self.rng.random() < 0.4
            self.block(self.rng.choice(("p", "li", "div", "p")), self.words(3, 9 if linked else 45, not linked), False, linked)
        self.parts.append(close)

    def form(self) -> None:
        close = self.open("form", self.rng.choice(("", "", "search", "newsletter", "css-3")))
        for _ in range(self.rng.randrange(1, 3)):
            self.parts.append("<p><label>" + self.words(1, 12, False) + "</label><input></p>")
            self.labels.append(False)
        self.parts.append(close)

    def comments(self) -> None:
        close = self.open(self.rng.choice(("section", "div", "ol")), self.rng.choice(("comments", "comment-list", "disqus", "replies", "respond", "user-comments")))
        self.block("h3", self.words(1, 3, False), False)
        for _ in range(self.rng.randrange(1, 12)):
            inner = self.open(self.rng.choice(("div", "article", "li")), self.rng.choice(("comment", "comment-body", "comment reply")))
            self.block("p", self.words(2, 60), False)
            self.parts.append(inner)
        self.parts.append(close)

    def head(self) -> None:
        close = self.open(*self.rng.choice([("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "", "banner")]))
        self.block(self.rng.choice(("h1", "h2", "p", "div")), self.words(1, 6, False), False, self.rng.random() < 0.5)
        if self.rng.random() < 0.6:
            self.menu()
        self.parts.append(close)

    def foot(self) -> None:
        close = self.open(*self.rng.choice([("footer", ""), ("footer", "css-5"), ("div", "footer"), ("div", "", "contentinfo"), ("div", "site-footer")]))
        for _ in range(self.rng.randrange(1, 4)):
            self.block(self.rng.choice(("p", "div")), self.rng.choice(("", "\u00a9 ", "&copy; ")) + self.words(2, 20), False, self.rng.random() < 0.2)
        self.parts.append(close)

    def article(self) -> None:
        kind = self.rng.random()
        if kind < 0.45:
            close = self.open("article", self.rng.choice(["", "", *_BODIES]))
        elif kind < 0.6:
            close = self.open("main", self.rng.choice(["", *_BODIES]))
        else:
            close = self.open(self.rng.choice(("div", "section", "td")), self.rng.choice(_BODIES))
        if self.rng.random() < 0.25:
            self.parts.append("<header>")
            self.block("h1", self.words(2, 12, False), True)
            self.parts.append("</header>")
        elif self.rng.random() < 0.8:
            self.block("h1", self.words(2, 12, False), True)
        inner = self.open("div", self.rng.choice(_BODIES + ["search-results", "notice-of-intent"])) if self.rng.random() < 0.3 else ""
        for _ in range(self.rng.randrange(1, 14)):
            u = self.rng.random()
            if u < 0.7:
                self.block("p", self.words(1, 90) if self.rng.random() < 0.8 else self.words(1, 3), True, self.rng.random() < 0.02)
            elif u < 0.78:
                self.block("h2", self.words(1, 8, False), True)
            elif u < 0.86:
                for _ in range(self.rng.randrange(1, 6)):
                    self.block("li", self.words(1, 20, self.rng.random() < 0.5), True)
            elif u < 0.9:
                self.block("blockquote", self.words(4, 40), True)
            elif u < 0.93:
                self.block("pre", self.words(2, 30, False), True)
            elif u < 0.96:
                self.aside()
            elif u < 0.97:
                self.form()
            elif u < 0.98:
                self.foot()
            else:
                self.menu()
        self.parts.append(inner)
        if self.rng.random() < 0.1:
            self.comments()
        self.parts.append(close)

    def _page(self) -> None:
        rng = self.rng
        self.parts.append("<html><head><title>t</title></head><body>")
        closes = [self.open("form")] if rng.random() < 0.08 else []
        closes += [self.open("div", rng.choice(_WRAPPERS)) for _ in range(rng.randrange(0, 4))]
        before = [f for f in (self.head, self.menu, self.aside, self.form) if rng.random() < 0.5]
        after = [f for f in (self.aside, self.aside, self.form, self.comments, self.foot) if rng.random() < 0.5]
        for f in before:
            f()
        self.article()
        for f in after:
            f()
        self.parts += closes[::-1] + ["</body></html>"]


def rows(layouts: list[Layout]) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for page in layouts:
        own = extract.blocks(page.html)
        if len(own) != len(page.labels):
            raise ValueError("a layout's blocks are not those it was made of")
        for values, y in zip(extract.features(own), page.labels):
            x = np.zeros(len(extract.FEATURES))
            x[list(values)] = list(values.values())
            xs.append(x)
            ys.append(float(y))
    return np.array(xs), np.array(ys)


def fit(pages: int = 3000, seed: int = 5, l2: float = 1e-4, steps: int = 15) -> dict[str, float]:
    """Logistic regression by Newton's steps; every feature has its weight, rounded."""
    x, y = rows([Layout(random.Random(seed * 1_000_003 + i)) for i in range(pages)])
    w = np.zeros(x.shape[1])
    ridge = l2 * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge
        w -= np.linalg.solve(curve, x.T @ (p - y) / len(y) + ridge @ w)
    return {name: round(float(a), 2) for name, a in zip(extract.FEATURES, w)}
