"""HTML extraction by minimum-cut labelling of text blocks.

A page is read into blocks of text in page order, each with its path of elements. A logistic classifier turns a block's
evidence (what encloses it, its share of link text, its length and punctuation) into the price of calling it boilerplate or
content; these are the capacities from the source and to the sink. Blocks that follow each other, and blocks that share a
parent, are tied by smoothness edges, weaker the farther apart they stand in the tree. The minimum cut is the labelling of
least total cost: a short paragraph among an article's is kept with them, and a long notice inside a sidebar goes with the
sidebar.

The classifier's weights are learnt by ``extract_training`` on generated layouts and stored here. Each kind of evidence
counts once, from whichever of the elements around a block has it, so no depth of nesting outweighs the rest; and an element
that encloses the article, or nearly all of the page's text, is no evidence against what it encloses.

Elements that hold no text for readers (scripts, styles, templates, form controls, comments in markup) are never blocks.

Tags are read by the states of HTML attributes: a quote opens a value after an equals sign only. Time is linear in the page's
length for any nesting of tags and quotes.

Defined cases: null and empty html, and pages without content, give the empty text; broken markup is read as far as it
goes: unclosed elements end with their parent, stray end tags are ignored, a tag that never closes is text up to the next
tag, an unclosed comment hides the rest; repeated rows give equal results; an empty table gives an empty result; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names by their part in a page.
HIDDEN = frozenset("script style noscript template svg head title iframe object embed canvas audio video map select option textarea button input datalist annotation".split())
RAW = frozenset("script style textarea title noscript iframe noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
SECTIONS = frozenset("article main section nav footer aside header div td ul ol menu".split())
IMPLIED = {
    tag: (frozenset(same.split()), frozenset(stop.split()))
    for tag, same, stop in (("li", "li", "ul ol menu dir"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table tbody thead tfoot"), ("td", "td th", "tr"), ("th", "td th", "tr"))
}

#: Tags and roles that mark parts of a page, by kind of part.
KIND_OF_TAG = {"nav": "menu", "menu": "menu", "footer": "foot", "aside": "side", "header": "head", "form": "form", "dialog": "note"}
KIND_OF_ROLE = {
    "navigation": "menu", "menu": "menu", "menubar": "menu", "toolbar": "menu", "contentinfo": "foot", "complementary": "side", "banner": "head",
    "search": "form", "form": "form", "dialog": "note", "alert": "note", "alertdialog": "note",
}

#: Words in class and id names that mark what is not the article, what is, and what says nothing.
COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus discussion".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement adbox adsense banner sponsor sponsored promo promotion sidebar footer foot nav navbar navigation menu header head headbar masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended recommendations trending popular widget widgets tag tags pagination pager copyright legal disclaimer toolbar search skip outbrain taboola".split()
)
GOOD_WORDS = frozenset("article content entry post story main body text prose".split())
PLAIN_WORDS = frozenset("site top bottom left right page block box wrap wrapper container section area global list bar items links posts stories form inner outer col column row layout the and of".split())

KINDS = ("menu", "foot", "side", "head", "form", "note", "name", "part", "comment")

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|$))|<[!?][^>]*+>|</[^a-zA-Z>][^>]*+>|</>"""
    r"""|<(/?)([a-zA-Z][^\s/><]*+)((?:[\s/]++|=?[^\s/>=<]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'><][^\s><]*+)?+)?+)*+)>|[^<]++|<""",
    re.S,
)
_ATTR = re.compile(r"""([^\s/>=<]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'><][^\s><]*+))?+)?+""")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: "Node | None"
    depth: int
    hidden: bool
    link: bool
    kinds: frozenset[str] = frozenset()  # of parts that are not the article, by this element's own tag, role and names
    good: str = ""  # "tag" or "name" of this element's own
    block: "Node | None" = None  # the nearest block element, itself included
    chars: int = 0  # of text inside
    holds: bool = False  # an article, a main element or a first heading inside
    inside: bool = False  # of an article or a main element
    named: bool = False  # inside of an element with a good name
    against: dict[str, bool] = field(default_factory=dict)  # kind of evidence around -> whether it is inside the article


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    node: Node


def _kinds_of_names(names: str) -> tuple[set[str], bool]:
    """Kinds of parts that class and id names speak of, and whether they speak of an article.

    A name made of telling and plain words only is "name"; one that has a telling word among others is a mere "part".
    """
    kinds, good = set(), False
    for name in names.split():
        own = [w.lower() for w in _WORD.findall(name)]
        bad = [w for w in own if w in BAD_WORDS]
        if any(w in COMMENT_WORDS for w in own):
            kinds.add("comment")
        elif bad:
            kinds.add("name" if all(w in BAD_WORDS or w in PLAIN_WORDS or w in GOOD_WORDS for w in own) else "part")
        elif any(w in GOOD_WORDS for w in own):
            good = True
    return kinds, good


def _marked(tag: str, attrs: str) -> tuple[frozenset[str], str, bool]:
    """(kinds of evidence against, evidence for, hidden) of one element by itself."""
    kinds = {KIND_OF_TAG[tag]} if tag in KIND_OF_TAG else set()
    good = "tag" if tag in ("article", "main") else ""
    if not attrs or attrs.isspace():
        return frozenset(kinds), good, False
    own: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        own.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    hidden = "hidden" in own or "display:none" in own.get("style", "").replace(" ", "").lower()
    role = own.get("role", "").lower()
    if role in KIND_OF_ROLE:
        kinds.add(KIND_OF_ROLE[role])
    if role in ("main", "article"):
        good = "tag"
    if tag not in ("html", "body"):
        named, well = _kinds_of_names(f"{own.get('class', '')} {own.get('id', '')}")
        if tag in ("article", "main"):
            named -= {"part", "name"}
            good = "" if "comment" in named else good
        kinds |= named
        good = good or ("name" if well and not kinds else "")
    return frozenset(kinds), good, hidden


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    root = Node("#", None, 0, False, False)
    root.block = root
    at, out, parts, link_chars = root, [], [], 0
    owner = root
    nodes = [root]
    opened: Counter[object] = Counter()  # open block elements by tag, open inline elements by their block and tag

    def flush() -> None:
        nonlocal parts, link_chars
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(text, min(link_chars, len(text)), owner))
            owner.chars += len(text)
        parts, link_chars = [], 0

    def key(node: Node) -> object:
        return node.tag if node.block is node else (id(node.block), node.tag)

    def close_to(node: Node) -> None:
        nonlocal at
        while at is not node:
            opened[key(at)] -= 1
            at = at.parent

    place, end = 0, len(page)
    last = page.rfind(">")
    while place < end:
        m = _TOKEN.match(page, place) if place <= last or page[place] != "<" else None
        token, tag = (m[0], m[2]) if m else ("<", None)
        place += len(token)
        if tag is None:
            if token.startswith("<") and len(token) > 1 or at.hidden:
                continue
            text = entities.unescape(token) if "&" in token else token
            if not parts:
                owner = at.block
            parts.append(text)
            if at.link:
                link_chars += len(text.strip())
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if m[1]:
            if block:
                flush()
            if opened[tag if block else (id(at.block), tag)] > 0:
                node = at
                while node.tag != tag:
                    node = node.parent
                close_to(node.parent)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if block:
            flush()
            if tag in CLOSES_P and at.block.tag == "p":
                close_to(at.block.parent)
            if tag in IMPLIED:
                same, stop = IMPLIED[tag]
                if any(opened[t] > 0 for t in same):
                    node = at
                    while node.parent and node.tag not in stop:
                        if node.tag in same:
                            close_to(node.parent)
                            break
                        node = node.parent
        if tag in VOID:
            continue
        if tag in RAW:
            close = _CLOSE[tag].search(page, place)
            place = close.end() if close else end
            continue
        if m[3].endswith("/") and not block:
            continue
        kinds, good, hidden = _marked(tag, m[3])
        inner = Node(tag, at, at.depth + 1, hidden or tag in HIDDEN or at.hidden, at.link or tag == "a", kinds, good)
        inner.block = inner if block else at.block
        nodes.append(inner)
        opened[key(inner)] += 1
        at = inner
    flush()
    _spread(nodes)
    return out


def _spread(nodes: list[Node]) -> None:
    """Sums of text from the leaves up, then evidence from the root down; nodes are in page order, parents first."""
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.holds |= n.holds or n.good == "tag" or n.tag == "h1"
    total = max(1, nodes[0].chars)
    for n in nodes[1:]:
        up = n.parent
        n.inside, n.named, n.against = up.inside, up.named, up.against
        share = n.chars / total
        around = share > 0.9 or n.holds and share > 0.3  # this element encloses the article, whatever it is called
        if n.kinds and not (around and n.kinds.isdisjoint({"comment"}) or share > 0.97):
            n.against = {**{k: n.inside for k in n.kinds}, **up.against}
        n.inside = n.inside or n.good == "tag" and not n.against
        n.named = n.named or n.good == "name"


FEATURES = (
    "bias", "inside", "outside", "named", "elsewhere", "long", "short", "tiny", "stops", "links", "all_links", "heading", "paragraph", "item", "cell", "copyright",
    *(f"{k}_{where}" for k in KINDS for where in ("around", "inside")),
)
_AT = {name: i for i, name in enumerate(FEATURES)}
_STOPS = re.compile(r"[.!?,;:]")


def features(own: list[Block]) -> list[dict[int, float]]:
    """Of each block, the values of the features that are not 0, by place in FEATURES."""
    has_article, has_named = any(b.node.inside for b in own), any(b.node.named for b in own)
    out = []
    for b in own:
        node, n = b.node, len(b.text)
        dense = b.link_chars / n
        values = {
            "bias": 1.0, "inside": node.inside, "outside": has_article and not node.inside, "named": node.named,
            "elsewhere": has_named and not node.named and not node.inside, "long": min(n, 400) / 200, "short": n < 40,
            "tiny": n < 12, "stops": bool(_STOPS.search(b.text)), "links": dense, "all_links": dense > 0.8, "heading": node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            "paragraph": node.tag in ("p", "pre", "blockquote", "figcaption"), "item": node.tag == "li", "cell": node.tag in ("td", "th", "dd", "dt"),
            "copyright": "\u00a9" in b.text,
        }
        for kind, inside in node.against.items():
            values[f"{kind}_{'inside' if inside else 'around'}"] = 1.0
        out.append({_AT[k]: float(v) for k, v in values.items() if v})
    return out


#: Learnt by extract_training.fit(); above 0 for content.
WEIGHTS: dict[str, float] = {
    "bias": 0.27, "inside": 0.98, "outside": -4.24, "named": 1.04, "elsewhere": -2.96, "long": 0.58, "short": -0.02, "tiny": 0.04,
    "stops": 0.55, "links": -1.49, "all_links": -1.49, "heading": 2.56, "paragraph": 1.95, "item": 2.09, "cell": 0.0, "copyright": -2.26,
    "menu_around": -3.54, "menu_inside": -3.73, "foot_around": -3.86, "foot_inside": -3.49, "side_around": -4.33, "side_inside": -3.69,
    "head_around": -1.4, "head_inside": 0.63, "form_around": -4.96, "form_inside": -4.7, "note_around": -4.03, "note_inside": -3.3,
    "name_around": -6.43, "name_inside": -6.29, "part_around": -2.06, "part_inside": -1.1, "comment_around": -7.34, "comment_inside": -7.41,
}


def costs(own: list[Block]) -> list[tuple[float, float]]:
    """(cost of calling it boilerplate, cost of calling it content) of each block, from the classifier's log odds."""
    w = [WEIGHTS.get(name, 0.0) for name in FEATURES]
    odds = [sum(w[i] * v for i, v in f.items()) for f in features(own)]
    return [(math.log1p(math.exp(min(x, 30.0))), math.log1p(math.exp(min(-x, 30.0)))) for x in odds]


def smoothness(a: Block, b: Block) -> float:
    """The price of labelling two blocks differently: less for each level between them. Blocks that follow each other are
    joined by the tree's own walk, so all steps of a page are at most twice its elements."""
    x, y, steps, crossed = a.node, b.node, 0, 0
    while x is not y:
        if x.depth >= y.depth:
            crossed += x.tag in SECTIONS
            x = x.parent
        else:
            crossed += y.tag in SECTIONS
            y = y.parent
        steps += 1
    return 1.5 / ((1 + steps) * (1 + 2 * crossed))


def min_cut(content: list[float], away: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the blocks on the source's side of a minimum cut: Dinic's algorithm over the blocks and two terminals."""
    n = len(content)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(u: int, v: int, c: float, back: float) -> None:
        head[u].append(len(to))
        to.append(v)
        cap.append(c)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):
        through = min(content[i], away[i])  # this much flows from source to sink through the block in any case
        if content[i] > through:
            add(s, i, content[i] - through, 0.0)
        elif away[i] > through:
            add(i, t, away[i] - through, 0.0)
    for u, v, w in edges:
        add(u, v, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for u in queue:
            for e in head[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(head[u]):
                e = head[u][nxt[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(head[u]):
                path.append(head[u][nxt[u]])
                u = to[path[-1]]
            elif path:
                level[u] = -1
                u = to[path.pop() ^ 1]
            else:
                break


def labelled(own: list[Block]) -> list[bool]:
    """True for the blocks of the article."""
    pairs = [(i, i + 1, smoothness(own[i], own[i + 1])) for i in range(len(own) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(own):  # blocks of one parent that are not neighbours
        p = id(b.node.parent or b.node)
        if p in last and last[p] < i - 1:
            pairs.append((last[p], i, 0.5))
        last[p] = i
    both = costs(own)
    return min_cut([c for c, _ in both], [a for _, a in both], pairs)


def extract(page: str | None) -> str:
    """The article's blocks, joined by empty lines."""
    own = blocks(page) if page else []
    return "\n\n".join(b.text for b, k in zip(own, labelled(own)) if k) if own else ""


def main_text(pages: DataFrame) -> DataFrame:
    """A row for each page row: page_id, url, text, n_chars."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(over, f"page_id {kind}, url string, text string, n_chars long")
