"""Main text of web pages: gradient-boosted trees over features of DOM nodes, decoded along the tree.

A page is read into its block elements. Every node has features of its subtree's density,
of its tag, class, id and role, of its depth and its siblings; the trees turn them into
log-odds of being main content. Decoding keeps or drops whole nodes so that the sum of the
kept ones' log-odds is largest and no node is kept under a dropped one. The trees are
fitted here, on a fixed number of generated pages whose main text is known.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import text_of

#: Buckets of attribute tokens that are no known word.
NAMED = 8
#: Generated pages, trees, their depth, cuts tried for a feature, and the step of each tree.
PAGES, TREES, DEPTH, CUTS, RATE = 480, 60, 4, 24, 0.3

# Elements by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select option datalist button textarea".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table", "tbody", "thead", "tfoot"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"])}
# Words of attributes, by what they tend to mark.
MARKS = {
    "main": "article content main post story entry text body prose",
    "menu": "nav menu navbar breadcrumb breadcrumbs links pagination pager tabs toc",
    "edge": "header footer masthead copyright colophon banner topbar bottom legal",
    "side": "sidebar aside side related widget recommended more popular trending",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe gdpr toast overlay signup",
    "talk": "comment comments reply replies discussion disqus respond reader",
    "form": "form search login contact input",
    "share": "share social tags meta byline author tools",
}
MARK_OF = {w: k for k, ws in enumerate(MARKS.values()) for w in ws.split()}
TAGS = ("p", "h1", "h2", "h3", "li", "ul", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "body")
TAG_OF = {t: i for i, t in enumerate(TAGS)}

NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*+")
#: An attribute's name, and whether a value follows it; an unquoted value.
ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(\s*+=\s*+)?)?")
UNQUOTED = re.compile(r"[^\s>]*+")
PART = re.compile(r"[A-Za-z]+")
STEP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("at", "chars", "children", "hidden", "links", "marks", "named", "parent", "points", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, at: int, attributes: dict[str, str] = {}):
        self.tag, self.parent, self.at = tag, parent, at
        self.chars = self.points = 0
        self.children: list[Node | int] = []  # nodes, and numbers of own text blocks between them
        self.text: list[list[tuple[str, Node]]] = []  # blocks: pieces, each with the node it is of
        self.links = 0
        self.marks, self.named, self.hidden = 0, 0, False
        for name, value in attributes.items():
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                self.hidden = True
            elif name in ("class", "id", "role"):
                for w in PART.findall(STEP.sub(" ", value)):
                    if (k := MARK_OF.get(w.lower())) is not None:
                        self.marks |= 1 << k
                    else:
                        self.named |= 1 << zlib.crc32(w.lower().encode()) % NAMED


class Page:
    """A page read from left to right, each character a fixed number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.last_end: dict[str, int] = {}

    def ends(self, tag: str, at: int) -> bool:
        """Whether an end tag of this name stands anywhere behind `at`."""
        if tag not in self.last_end:
            self.last_end[tag] = max((m.start() for m in re.finditer(f"(?i)</{tag}(?=[\\s/>])", self.page)), default=-1)
        return self.last_end[tag] >= at

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """Names and values from behind a tag's name (the first of equal names counts), the place behind the tag, and whether it closes itself.

        A quote that is never closed is a character as any other; a tag that is never closed goes on to the end.
        """
        page, n, found = self.page, len(self.page), {}
        while at < n:
            m = ATTRIBUTE.match(page, at)
            at = m.end()
            if m[1] is None:
                return found, min(at + 1, n), page[at - 1 : at] == "/"
            value = ""
            if m[2]:
                quote = page[at : at + 1]
                if quote in self.last_quote and self.last_quote[quote] > at:
                    end = page.index(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    value = UNQUOTED.match(page, at)[0]
                    at += len(value)
            found.setdefault(m[1].lower(), html.unescape(value))
        return found, n, False


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes, in page order: blocks, and inline or unknown elements that an attribute marks or hides.

    Other inline elements' text belongs to the block around them. A marked one is a node of its own, but
    its text stays a piece of that block, until a block begins within it: then it is a block.
    """
    root = Node("#root", None, 0)
    nodes, stack = [root], [root]
    open_: dict[str, list[int]] = {}  # of each tag, where it stands on the stack
    source, unseen = Page(page), []
    links = 0
    inline: list[Node] = []  # marked elements that are open within the current block
    pieces: list[tuple[str, Node, bool]] = []

    def flush() -> None:
        if not pieces:
            return
        own, block = stack[-1], []
        for text, node, linked in pieces:
            text = html.unescape(text)
            n = len(text.strip())
            node.chars += n
            node.points += text.count(".") + text.count(",")
            node.links += n if linked else 0
            if block and block[-1][1] is node:
                block[-1] = (block[-1][0] + text, node)
            else:
                block.append((text, node))
        pieces.clear()
        if any(text.strip() for text, _ in block):
            own.children.append(len(own.text))
            own.text.append(block)

    def words(text: str) -> None:
        if text and not unseen:
            pieces.append((text, inline[-1] if inline else stack[-1], bool(links)))

    def enclose() -> None:
        """A block begins or ends: marked elements around it become blocks."""
        for node in inline:
            stack[-1].children.append(node)
            open_.setdefault(node.tag, []).append(len(stack))
            stack.append(node)
        inline.clear()

    def leave(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop().tag].pop()

    def innermost(tags) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    at, n, last_section = 0, len(page), page.rfind("]]>")
    while at < n:
        here = page.find("<", at)
        words(page[at:] if here < 0 else page[at:here])
        if here < 0:
            break
        if page.startswith("<!--", here):
            end = page.find("-->", here + 2)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", here) and here < last_section:
            end = page.index("]]>", here)
            words(html.escape(page[here + 9 : end]))
            at = end + 3
            continue
        if page[here + 1 : here + 2] in ("!", "?") or page.startswith("</>", here):
            end = page.find(">", here)
            at = n if end < 0 else end + 1
            continue
        closing = page[here + 1 : here + 2] == "/"
        name = NAME.match(page, here + 1 + closing)
        if not name:
            words("<")
            at = here + 1
            continue
        tag = name[0].lower()
        attributes, at, itself = source.attributes(name.end())
        if unseen and not closing and tag in BLOCK and all(u in ("svg", "math") for u in unseen):
            unseen.clear()  # a block leaves drawings and formulas
        if unseen:
            if tag == unseen[-1]:
                if closing:
                    unseen.pop()
                elif tag not in RAW:
                    unseen.append(tag)
            continue
        if tag in UNSEEN:
            if closing or itself or tag == "head":
                continue  # what a head holds is left out by itself, and it may have no end
            if tag in ("script", "style") or source.ends(tag, at):
                if tag in RAW:
                    end = re.compile(f"</{tag}(?=[\\s/>])[^>]*+>?", re.I).search(page, at) if source.ends(tag, at) else None
                    at = end.end() if end else n
                else:
                    unseen.append(tag)
            if tag in ("iframe", "object", "video", "audio", "canvas", "svg"):
                words(" ")
            continue
        if tag == "br" or tag == "img":
            words(" ")
        elif tag in BLOCK:
            flush()
            links = 0
            if closing:
                if open_.get(tag):
                    inline.clear()
                    leave(open_[tag][-1])
                continue
            enclose()
            if stack[-1].tag == "p":
                leave(len(stack) - 1)
            if tag in CLOSED_BY and (outer := innermost(CLOSED_BY[tag])) > innermost(SCOPE[tag]):
                leave(outer)
            if tag == "hr":
                continue
            node = Node(tag, stack[-1], len(nodes), attributes)
            stack[-1].children.append(node)
            nodes.append(node)
            open_.setdefault(tag, []).append(len(stack))
            stack.append(node)
        else:
            if tag == "a":
                links = 0 if closing else 1
            if closing:
                k = max((i for i, x in enumerate(inline) if x.tag == tag), default=-1)
                if k >= 0:
                    del inline[k:]
                elif open_.get(tag):
                    flush()
                    inline.clear()
                    leave(open_[tag][-1])
            elif not itself and tag not in VOID:
                node = Node(tag, inline[-1] if inline else stack[-1], len(nodes), attributes)
                if node.marks or node.hidden:
                    nodes.append(node)
                    inline.append(node)
    flush()
    return root, nodes


def features(pages: list[list[Node]]) -> np.ndarray:
    """A row for each node of each page, in page order (parents before children)."""
    rows: list[tuple] = []
    for nodes in pages:
        n = len(nodes)
        parent = [x.parent.at if x.parent is not None else 0 for x in nodes]
        marks = [x.marks | TAG_MARKS.get(x.tag, 0) for x in nodes]
        chars, links, points = [x.chars for x in nodes], [x.links for x in nodes], [x.points for x in nodes]
        size, inner = [1] * n, [len(x.text) for x in nodes]
        depth, above, children = [0] * n, [0] * n, [0] * n
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = parent[i]
            depth[i], above[i] = depth[p] + 1, above[p] | marks[p]
            children[p] += 1
            key = (p, nodes[i].tag)
            alike[key] = alike.get(key, 0) + 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            points[p] += points[i]
            size[p] += size[i]
            inner[p] += inner[i]
        # whether anything on the page says that it is the main text: only then does the lack of such a mark tell
        marked = max((m & 1 for m in marks), default=0)
        for i, x in enumerate(nodes):
            p = parent[i]
            rows.append((chars[i], links[i], points[i], size[i], inner[i], chars[0], depth[i], children[p], alike.get((p, x.tag), 1), chars[p] - nodes[p].chars, TAG_OF.get(x.tag, len(TAGS)), x.chars, marks[i], above[i], x.hidden, x.named, marked))
    chars, links, points, size, inner, total, depth, siblings, alike, beside, tag, own, marks, above, hidden, named, marked = np.array(rows, np.int64).reshape(-1, 17).T
    some = np.maximum(chars, 1)
    columns = [np.log1p(chars), links / some, points / some * 100, chars / size, chars / np.maximum(inner, 1), chars / np.maximum(total, 1), depth, siblings, alike / np.maximum(siblings, 1), chars / np.maximum(beside, 1), tag, np.log1p(own)]
    columns += [(marks >> k & 1) + 2 * (above >> k & 1) for k in range(len(MARKS))]
    columns += [named >> k & 1 for k in range(NAMED)]
    return np.stack([*columns, hidden, marked], axis=1).astype(np.float64)


# Elements that say by their name what others say by their class.
TAG_MARKS = {
    tag: 1 << [*MARKS].index(mark)
    for tag, mark in (("nav", "menu"), ("menu", "menu"), ("header", "edge"), ("footer", "edge"), ("aside", "side"), ("form", "form"), ("fieldset", "form"), ("dialog", "notice"), ("article", "main"), ("main", "main"))
}


Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    """Log-odds of the mean, and trees (feature, cut, value; a full binary tree in level order) by Newton boosting of the logistic loss."""
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin, trees = np.full(len(y), base), []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) for c in x.T]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(2**DEPTH)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                own = np.flatnonzero(at == k)
                if len(own) < 8:
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                best = (1e-6, 0, np.inf)
                for f, points in enumerate(cuts):
                    if not len(points):
                        continue
                    bins = np.searchsorted(points, x[own, f], "left")
                    gl = np.cumsum(np.bincount(bins, g[own], len(points) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins, h[own], len(points) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], f, points[i])
                feature[k], cut[k] = best[1], best[2]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        margin += value[leaf]
        trees.append((feature, cut, value))
    return base, trees


def log_odds(x: np.ndarray, model: tuple[float, list[Tree]]) -> np.ndarray:
    base, trees = model
    out, row = np.full(len(x), base), np.arange(len(x))
    for feature, cut, value in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
        out += value[at - (2**DEPTH - 1)]
    return out


def worth(nodes: list[Node], odds: np.ndarray) -> list[float]:
    """What keeping each node adds by itself; a hidden one is never worth it."""
    return [-math.inf if x.hidden else o * math.log1p(x.chars) if x.chars else 0.5 * min(o, 0.0) for x, o in zip(nodes, odds.tolist(), strict=True)]


def decode(nodes: list[Node], odds: np.ndarray) -> list[str]:
    """Blocks of the kept nodes in page order.

    A node counts by its own text, so that containers without text cost and bring nothing
    themselves; keeping a node's subtree is worth the best choice below it plus its own.
    """
    best = worth(nodes, odds)
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent.at] += best[i]
    kept = [True] * len(nodes)
    for x in nodes[1:]:
        kept[x.at] = kept[x.parent.at] and best[x.at] > 0
    out: list[str] = []
    work: list[Node | list] = [nodes[0]]
    while work:
        node = work.pop()
        if isinstance(node, list):
            if text := " ".join("".join([t if kept[x.at] else " " for t, x in node]).split()):
                out.append(text)
            continue
        work += [node.text[c] if isinstance(c, int) else c for c in reversed(node.children) if isinstance(c, int) or kept[c.at]]
    return out


def _page(rnd: random.Random) -> tuple[str, set[int]]:
    """A generated page; the numbers of its text pieces (t1, t2, ...) that are main text."""
    word = lambda: "".join(rnd.choice(("th", "on", "er", "in", "re", "at", "es", "ou", "st", "la")) for _ in range(rnd.randint(1, 4)))
    main: set[int] = set()
    count = 0

    def piece(n: int, good: bool) -> str:
        nonlocal count
        count += 1
        if good:
            main.add(count)
        return f"\x01{count}\x02 " + " ".join(word() + rnd.choice(("", "", "", "", ",", ".")) for _ in range(n)) + rnd.choice((".", ".", ""))

    # a page in plain style says nothing by its elements or their classes
    plain = rnd.random() < 0.4
    hashed = plain and rnd.random() < 0.4
    noise = lambda: f' class="{word()}{rnd.randint(0, 99)} {word()}"' if hashed and rnd.random() < 0.6 else ""
    attr = lambda *ws: rnd.choice(("", f' class="{rnd.choice(ws)}"', f' id="{rnd.choice(ws)}"', f' class="{word()} {rnd.choice(ws)}"')) if ws else ""
    link = lambda good=False: f'<a href="/{word()}">{piece(rnd.randint(1, 3), good)}</a>'
    some = lambda p: rnd.random() < p

    def menu() -> str:
        own = "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(3, 9)))
        if plain and some(0.8):
            listed = " ".join(link() for _ in range(rnd.randint(2, 9)))
            return rnd.choice((f"<ul{noise()}>{own}</ul>", f"<div{noise()}><ul>{own}</ul></div>", f"<div{noise()}>{listed}</div>", f"<p{noise()}>{listed}</p>"))
        return rnd.choice((f"<nav{attr('nav', 'menu')}><ul>{own}</ul></nav>", f'<div class="{rnd.choice(("menu", "navbar", "breadcrumb"))}"><ul>{own}</ul></div>', f"<ul{attr('menu', 'nav', 'links')}>{own}</ul>"))

    def header() -> str:
        return f"<header{attr('masthead', 'topbar')}>{rnd.choice(('', f'<h1>{piece(2, False)}</h1>', f'<p>{piece(6, False)}</p>'))}{menu() if some(0.5) else ''}</header>"

    def footer() -> str:
        body = f"&copy; {piece(rnd.randint(3, 25), False)}"
        if plain and some(0.7):
            return f"<div{noise()}>{body}</div>"
        return rnd.choice((f"<footer{attr('footer', 'legal')}>{body}</footer>", f"<footer><p>{body}</p>{menu() if some(0.3) else ''}</footer>", f'<div class="footer">{body}</div>'))

    def aside() -> str:
        body = f"<h3>{piece(2, False)}</h3>" + "".join(rnd.choice((f"<p>{piece(rnd.randint(5, 30), False)}</p>", f"<li>{link()}</li>")) for _ in range(rnd.randint(1, 4)))
        return rnd.choice((f"<aside{attr('sidebar', 'related', 'widget')}>{body}</aside>", f'<div class="{rnd.choice(("sidebar", "related", "widget"))}">{body}</div>'))

    def odd() -> str:
        name, tag = rnd.choice((("ad", "div"), ("ads", "div"), ("advert", "div"), ("sponsored", "section"), ("promo", "div"), ("cookie", "div"), ("cookie-consent", "div"), ("notice", "div"), ("newsletter", "section"), ("popup", "div"), ("share", "div")))
        return f'<{tag} class="{name}">{rnd.choice((piece(rnd.randint(3, 30), False), f"<p>{piece(rnd.randint(4, 30), False)}</p>"))}</{tag}>'

    def comments() -> str:
        own = "".join(f'<{t} class="comment"><p>{piece(rnd.randint(3, 50), False)}</p></{t}>' for t in [rnd.choice(("div", "li", "article"))] * rnd.randint(1, 5))
        return f'<{(t := rnd.choice(("section", "div", "div", "user-comments")))} {rnd.choice(("class", "id"))}="{rnd.choice(("comments", "discussion", "replies"))}"><h3>{piece(2, False)}</h3>{own}</{t}>'

    def form() -> str:
        return f"<form{attr('search', 'login', 'contact')}><label>{piece(2, False)}</label><input><p>{piece(rnd.randint(2, 8), False)}</p></form>"

    def article() -> str:
        parts = [f"<{h}{noise()}>{piece(rnd.randint(2, 12), True)}</{h}>" for h in (["h1"] if some(0.85) else [])]
        for _ in range(rnd.choice((1, 2, 3, 5, 8, 14))):
            kind = rnd.random()
            if kind < 0.04:
                # a marked element within a paragraph, or around blocks
                bad = rnd.choice((f'<span class="{rnd.choice(("advert", "ad", "sponsored", "share", "promo"))}">{piece(rnd.randint(1, 6), False)}</span>', f'<span class="{rnd.choice(("text", "entry", "story"))}">{piece(4, True)}</span>', f"<span hidden>{piece(3, False)}</span>"))
                parts.append(f"<p>{piece(10, True)} {bad} {piece(10, True)}</p>")
            elif kind < 0.7:
                parts.append(f"<p{noise()}>{piece(rnd.choice((1, 4, 10, 30, 60, 120)), True)}</p>")
            elif kind < 0.76:
                parts.append(f"<h{(k := rnd.randint(2, 3))}>{piece(rnd.randint(1, 6), True)}</h{k}>")
            elif kind < 0.82:
                parts.append("<ul>" + "".join(f"<li>{piece(rnd.randint(2, 12), True)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                parts.append(f"<blockquote>{rnd.choice((piece(20, True), f'<p>{piece(20, True)}</p>'))}</blockquote>")
            elif kind < 0.9:
                parts.append("<table>" + "".join(f"<tr><td>{piece(2, True)}</td><td>{piece(2, True)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.95:
                parts.append(f"<p>{piece(10, True)} {link(True)} {piece(10, True)}</p>")
            elif some(0.5):
                parts.append(odd())
            elif some(0.5):
                parts.append(f"<pre>{piece(12, True)}</pre>")
            else:
                parts.append(f"<div>{piece(rnd.randint(10, 60), True)}</div>")
        body = "".join(parts)
        extra = (comments() if some(0.1) else "") + (aside() if some(0.06) else "") + (f"<footer>{piece(5, False)}</footer>" if some(0.06) else "")
        kind = rnd.random()
        if plain:
            inner = body
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
                inner = f"<div{noise()}>{inner}</div>"
            if some(0.2):
                cells = [f"<td{noise()}>{inner}</td>"] + [f"<td{noise()}>{menu()}</td>" for _ in range(rnd.randint(0, 2))]
                rnd.shuffle(cells)
                inner = f"<table{noise()}><tr>{''.join(cells)}</tr></table>"
            return inner + (comments() if some(0.1) else "")
        if kind < 0.6:
            return f"<article{attr('post', 'entry')}>{body}{extra}</article>"
        if kind < 0.75:
            return f"<main>{rnd.choice((body, f'<article>{body}</article>', f'<div>{body}</div>'))}{extra}</main>"
        return f'<div class="{rnd.choice(("content", "post", "article-body", "story", "entry-content", "main"))}">{body}{extra}</div>'

    before = [f() for f, p in ((header, 0.5), (menu, 0.6), (odd, 0.5), (form, 0.2), (aside, 0.2)) if some(p)]
    after = [f() for f, p in ((aside, 0.3), (comments, 0.35), (odd, 0.3), (form, 0.2), (menu, 0.15)) if some(p)]
    rnd.shuffle(before)
    # some pages have no article at all
    body = "".join([*before, article() if some(0.9) else menu(), *after, footer() if some(0.85) else ""])
    if some(0.15):
        body = f"<div{attr('wrapper', 'page', 'container')}>{body}</div>"
    return f"<html><head><title>{word()}</title></head><body>{body}</body></html>", main


@lru_cache(1)
def fit(pages: int = PAGES, seed: int = 11) -> tuple[float, list[Tree]]:
    """Trees fitted on the nodes of generated pages: a node with text is main if its text is; one without, if what it holds mostly is."""
    rnd = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, main = _page(rnd)
        _, nodes = parse(page)
        x = features([nodes])
        good, bad = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i in range(len(nodes)):
            for t in nodes[i].text:
                for piece, own in t:
                    for m in re.finditer("\x01(\\d+)\x02", piece):
                        (good if int(m[1]) in main else bad)[own.at] += 1
        for i in range(len(nodes) - 1, 0, -1):
            p = nodes[i].parent.at
            good[p] += good[i]
            bad[p] += bad[i]
        use = np.flatnonzero(good + bad > 0)
        xs.append(x[use])
        ys.append((good[use] > 0) & ((good[use] >= bad[use]) | (use < 4)))
    return boost(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def main_text(page: str, model: tuple[float, list[Tree]]) -> str:
    _, nodes = parse(page)
    return "\n".join(decode(nodes, log_odds(features([nodes]), model)))


def extract(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """pages with the string `out`: the main text of each whole page, its blocks joined by a line feed.

    A null, empty or textless page gives an empty string; markup may be broken or end
    early, and a page without any tag is one block. Rows are independent; an empty table
    gives an empty one; a column `out` that is there already is replaced.
    """
    model = pages.sparkSession.sparkContext.broadcast(fit())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parsed = [parse(p)[1] for p in batch]
            if not parsed:
                yield pd.Series([], dtype=object)
                continue
            odds = log_odds(features(parsed), model.value)
            cuts = np.cumsum([len(nodes) for nodes in parsed])[:-1]
            yield pd.Series(["\n".join(decode(nodes, o)) for nodes, o in zip(parsed, np.split(odds, cuts), strict=True)], dtype=object)

    return pages.withColumn(out, run(text_of(page)))
