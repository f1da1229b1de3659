"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded top-down without contradictions.

Every block element gets a feature vector (attribute tokens, tag, depth, subtree density, link share,
sibling statistics) and a probability of being article.  Decoding picks the most probable labelling
in which nothing below a dropped node is kept.  The trees are fitted on pages written by a seeded
generator that knows which of its blocks are article; nothing is taken from the tables.
"""

from __future__ import annotations

import gc
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, prepare, read_table

#: Generated training pages, trees, their depth, shrinkage, bins of a feature, and the seed.
PAGES, TREES, DEPTH, SHRINK, BINS, SEED = 900, 60, 5, 0.25, 16, 20
#: Nodes that the trees see at once (a single page may have more).
NODES = 8_000

# fixed values: HTML's void, vanishing, transparent, block and implied-end elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
VANISH = frozenset("script style title textarea select iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button canvas cite code data del dfn em font i ins kbd label map mark meter object audio video noscript output picture progress q rp rt ruby s samp slot small span strike strong sub sup template time tt u var br wbr img math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mstyle munder mover munderover mtable mtr mtd semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Of a start tag: the group it belongs to, and the open elements of that group that it ends.
IMPLIED = {"li": ("list", {"li"}), "dt": ("terms", {"dt", "dd"}), "dd": ("terms", {"dt", "dd"}), "tr": ("table", {"tr", "td", "th"}), "td": ("table", {"td", "th"}), "th": ("table", {"td", "th"})}
#: Elements that a search for an open element of a group stops at.
GROUPS = {"list": "li ul ol menu", "terms": "dt dd dl", "table": "tr td th table", "p": "p td th li div article section"}
_GROUPS_OF: dict[str, list[str]] = {}
for _g, _tags in GROUPS.items():
    for _t in _tags.split():
        _GROUPS_OF.setdefault(_t, []).append(_g)

# All quantifiers are possessive: a tag is read once, from left to right, whatever follows.  A quote opens
# a value only after "="; one that never closes is an ordinary character, so the tag ends at the next ">".
_MARK = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in VANISH}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "parts", "depth", "text", "links", "tags", "label", "near")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list = []  # text, link text as (text,), or child nodes, in page order
        self.depth = parent.depth + 1 if parent else 0
        self.label = ""
        #: the nearest element of each group, itself included
        self.near: dict[str, Node] = parent.near if parent else {}
        if tag in _GROUPS_OF:
            self.near = self.near | dict.fromkeys(_GROUPS_OF[tag], self)


def parse(page: str) -> Node:
    """The page's block tree; the garbage collector waits, or it would walk through the growing tree again and again."""
    waits = gc.isenabled()
    gc.disable()
    try:
        return _parse(page)
    finally:
        if waits:
            gc.enable()


def _parse(page: str) -> Node:
    """A forgiving block tree, in time linear in the page.

    Inline elements dissolve into their block, CDATA is text, and scripts, styles, form controls with
    hidden text, frames and drawings vanish.  A tag that is cut off by the end of the page is dropped."""
    root = Node("root", "", None)
    here, at, in_link = root, 0, 0
    opened: dict[str, int] = {}  # open elements by tag
    endless: set[str] = set()  # vanishing elements without an end from here on
    n = len(page)

    def add(text: str) -> None:
        if text:
            here.parts.append((text,) if in_link else text)

    def leave(node: Node) -> Node:
        """Close everything up to ``node``."""
        k = here
        while True:
            opened[k.tag] -= 1
            if k is node:
                return node.parent
            k = k.parent

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                add(page[lt + 9 : end if end >= 0 else n].replace("&", "&amp;"))
                at = end + 3 if end >= 0 else n
                continue
            comment = page.startswith("<!--", lt)
            end = page.find("-->", lt + 2) if comment else page.find(">", lt)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        m = _MARK.match(page, lt)
        if m is None:
            if after == "/" and page[lt + 2 : lt + 3].isalpha() or after.isascii() and after.isalpha():
                break  # no tag ends any more
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tag, closing, attrs = m[2].lower(), bool(m[1]), m[3]
        if tag in VANISH:
            if not closing and not attrs.endswith("/") and tag not in endless:
                end = _ENDS[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = n
                else:
                    endless.add(tag)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in INLINE or tag in VOID and tag != "hr":
            continue
        in_link = 0
        if closing:
            if opened.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                here = leave(node)
            continue
        if tag in CLOSES_P:
            node = here.near.get("p")
            if node is not None and node.tag == "p":
                here = leave(node)
        if tag in IMPLIED:
            group, ends = IMPLIED[tag]
            while (node := here.near.get(group)) is not None and node.tag in ends:
                here = leave(node)
        if tag == "hr":
            continue
        child = Node(tag, attrs, here)
        here.children.append(child)
        here.parts.append(child)
        if not attrs.endswith("/"):
            here = child
            opened[tag] = opened.get(tag, 0) + 1
    return root


def walk(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


TAGS = ["root", "html", "head", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "dl", "fieldset", "dialog", "menu"]
#: Attribute words that count, by what they speak of.
TOKENS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sitemap tabs topbar",
    "header": "header masthead banner hero logo topline",
    "footer": "footer copyright legal colophon bottom imprint",
    "side": "sidebar side aside widget rail related recommended trending popular more also promoted complementary",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo banner adsense dfp",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay dialog newsletter subscribe signup paywall",
    "comment": "comment comments reply replies respond discussion disqus discuss reader",
    "form": "form search login contact input newsletter subscribe",
    "share": "share social follow tweet facebook sharing tags meta byline",
    "article": "article content post story entry body main text maincontent articlebody prose",
}
_TOKENS = {w: k for k, (_, words) in enumerate(TOKENS.items()) for w in words.split()}
_TAG = {t: k for k, t in enumerate(TAGS)}
#: Elements that count as surroundings of what stands in them.
ABOVE = {t: k for k, t in enumerate(["article", "main", "nav", "header", "footer", "aside", "form", "ul", "section"])}
_NUMBERS, _WIDTH = 16, 16 + len(TAGS) + 2 * len(TOKENS) + len(ABOVE)


def features(nodes: list[Node]) -> np.ndarray:
    """A row a node.  Fills the nodes' subtree totals on the way."""
    for node in reversed(nodes):
        text = links = 0
        tags = 1
        for part in node.parts:
            if isinstance(part, Node):
                text, links, tags = text + part.text, links + part.links, tags + part.tags
            else:
                size = len(part[0] if isinstance(part, tuple) else part)
                text += size
                links += size if isinstance(part, tuple) else 0
        node.text, node.links, node.tags = text, links, tags
    total = max(1, nodes[0].text)
    out = np.zeros((len(nodes), _WIDTH), dtype=np.float32)
    numbers: list[tuple] = []
    ones_row: list[int] = []
    ones_col: list[int] = []
    first = _NUMBERS + len(TAGS)
    above: dict[int, frozenset[int]] = {}  # columns that a node hands down
    tally: dict[int, dict[str, int]] = {}
    place: dict[int, int] = {}
    for i, node in enumerate(nodes):
        parent = node.parent
        if node.children:
            count = tally[id(node)] = {}
            for k, child in enumerate(node.children):
                count[child.tag] = count.get(child.tag, 0) + 1
                place[id(child)] = k
        kin = len(parent.children) if parent else 1
        own_text = "".join([p[0] if type(p) is tuple else p for p in node.parts if type(p) is not Node])
        words = own_text.count(" ") + 1
        numbers.append((
            node.depth, min(node.text, 5000), min(len(own_text), 2000), node.links / max(1, node.text), node.text / node.tags, node.text / total,
            len(node.children), kin, tally[id(parent)][node.tag] if parent else 1, place[id(node)] / (kin - 1) if kin > 1 else 0.5, node.text / max(1, parent.text if parent else node.text),
            words, len(own_text) / words, (own_text.count(".") + own_text.count(",") + own_text.count("!") + own_text.count("?")) / words, node.tags, own_text.count("|") + own_text.count("©") + own_text.count("&copy;"),
        ))
        handed = above[id(parent)] if parent else frozenset()
        cols = list(handed)
        if node.tag in _TAG:
            cols.append(_NUMBERS + _TAG[node.tag])
        mine = {_TOKENS[w] for value in _ATTRIBUTE.findall(node.attrs) for x in _WORD.findall(value) if (w := x.lower()) in _TOKENS} if node.attrs else ()
        cols += [first + k for k in mine]
        if mine:
            handed = handed | {first + len(TOKENS) + k for k in mine}
        if node.tag in ABOVE:
            handed = handed | {first + 2 * len(TOKENS) + ABOVE[node.tag]}
        above[id(node)] = handed
        ones_row += [i] * len(cols)
        ones_col += cols
    out[:, :_NUMBERS] = numbers
    out[ones_row, ones_col] = 1
    return out


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, shrink: float = SHRINK, bins: int = BINS):
        self.trees, self.depth, self.shrink, self.bins = trees, depth, shrink, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [self._cuts(c) for c in x.T]
        b = self._binned(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin, self.forest = np.full(len(y), self.base), []
        two = np.flatnonzero([len(c) < 2 for c in self.cuts])  # features of two bins at most
        many = np.flatnonzero([len(c) > 1 for c in self.cuts])
        ones, cells = (b[:, two] > 0).astype(np.float32), b[:, many].astype(np.int64) + self.bins * np.arange(len(many))
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree, leaf = self._grow(b, g, h, two, ones, many, cells)
            self.forest.append(tree)
            margin += leaf
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, c, "right").astype(np.uint8) for cut, c in zip(self.cuts, x.T)], 1)

    def _cuts(self, c: np.ndarray) -> np.ndarray:
        """Between all values where they are few, else at quantiles."""
        values = np.unique(c)
        if len(values) <= self.bins:
            return (values[1:] + values[:-1]) / 2
        return np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1]))

    def _grow(self, b, g, h, two, ones, many, cells):
        """A complete binary tree: arrays of feature and bin for the inner nodes, values for the leaves.

        Sums of gradients are taken for all nodes of a level at once."""
        inner = (1 << self.depth) - 1
        feature, cut, value = np.zeros(inner, dtype=int), np.full(inner, self.bins, dtype=int), np.zeros(inner + 1)
        place = np.zeros(len(g), dtype=int)  # within the level
        for level in range(self.depth):
            k, first = 1 << level, (1 << level) - 1
            total = np.stack([np.bincount(place, v, k) for v in (g, h)])
            rows = np.bincount(place, minlength=k)
            left = np.zeros((2, k, b.shape[1], self.bins - 1))
            at = (cells + (place * (len(many) * self.bins))[:, None]).ravel()
            for i, v in enumerate((g, h)):
                sums = np.bincount(at, np.repeat(v, len(many)), k * len(many) * self.bins).reshape(k, len(many), self.bins)
                left[i][:, many] = sums.cumsum(2)[:, :, :-1]
                by = np.zeros((k, len(g)), dtype=np.float32)
                by[place, np.arange(len(g))] = v
                left[i][:, two] = (total[i][:, None] - by @ ones)[:, :, None]
            gs, hs = total[:, :, None, None]
            gain = left[0] ** 2 / (left[1] + 1) + (gs - left[0]) ** 2 / (hs - left[1] + 1) - gs**2 / (hs + 1)
            for node in range(k):
                f, c = np.unravel_index(gain[node].argmax(), gain[node].shape)
                if rows[node] >= 10 and gain[node, f, c] > 1e-6:
                    feature[first + node], cut[first + node] = f, c
            place = 2 * place + (b[np.arange(len(g)), feature[first + place]] > cut[first + place])
        sums = [np.bincount(place, v, inner + 1) for v in (g, h)]
        value = self.shrink * sums[0] / (sums[1] + 1)
        return (feature, cut, value), value[place]

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        margin, inner = np.full(len(x), self.base), (1 << self.depth) - 1
        rows = np.arange(len(x))
        for feature, cut, value in self.forest:
            place = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                place = 2 * place + 1 + (b[rows, feature[place]] > cut[place])
            margin += value[place - inner]
        return 1 / (1 + np.exp(-margin))


class Generator:
    """Writes random pages; article blocks carry the marker attribute ``data-kept``."""

    def __init__(self, seed: int = SEED):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        syllables = "an the er ing tion re in on es st or ea ti ed ou is ha nt".split()
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(3, 18).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self) -> str:
        r = self.r
        if r.random() < 0.15:
            return self.words(1, 6)
        if r.random() < 0.1:
            return " ".join([self.words(1, 2)] * r.randint(3, 30))
        text = " ".join(self.sentence() for _ in range(r.randint(1, 8)))
        if r.random() < 0.15:  # odd texts: separators, shouting, trailing signs
            text = r.choice([" | ", "!! ", "%%% ", " » ", ", "]).join(text.split())
        return text.upper() if r.random() < 0.03 else text

    def article(self) -> str:
        r, out = self.r, []
        kept = ' data-kept="1"'
        if r.random() < 0.05:  # a stub: little text, often only the headline said again
            head = self.sentence()
            body = r.choice([head, self.sentence(), self.words(1, 4)])
            return f"<h1{kept}>{head}</h1><p{kept}>{r.choice(['', '<b>'])}{body}{r.choice(['', '<br>', '</p>'])}"
        if r.random() < 0.7:
            out.append(f"<h1{kept}>{self.words(2, 12)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 4, 5, 6, 8])):
            k = r.random()
            text = self.prose()
            if r.random() < 0.1:  # what articles hold besides paragraphs
                out.append(self.piece(kept))
                continue
            if r.random() < 0.2:
                text = f"{text} <a href='/x'>{self.words(1, 3)}</a> {self.sentence()}"
            if k < 0.75:
                out.append(f"<p{kept}>{r.choice(['', '<b>', '<em>'])}{text}{r.choice(['', '<br>'])}{r.choice(['</p>', ''])}")
            elif k < 0.82:
                out.append(f"<h2{kept}>{self.words(1, 6)}</h2>")
            elif k < 0.89:
                out.append(f"<ul{kept}>" + "".join(f"<li{kept}>{self.prose()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.94:
                out.append(f"<blockquote{kept}><p{kept}>{text}</p></blockquote>")
            else:
                out.append(f"<div{kept}>{text}</div>")
            if r.random() < 0.2:
                out.append(self.junk(r.choice(["ad", "ad", "notice", "share", "related", "form", "comment", "nav"])))
        return "".join(out)

    def piece(self, kept: str) -> str:
        """A part of an article that is no plain paragraph: links by themselves, terms, tables, figures, code."""
        r = self.r
        rows, kind = r.randint(1, 4), r.choice(["link", "link", "links", "links", "links", "terms", "terms", "table", "figure", "code"])
        if kind == "link":
            return "".join(f"<p{kept}><a href='/x'>{r.choice([self.sentence(), self.words(2, 8)])}</a></p>" for _ in range(rows))
        if kind == "links":
            return f"<ul{kept}>" + "".join(f"<li{kept}><a href='/x'>{r.choice([self.sentence(), self.words(1, 3), self.words(2, 8)])}</a>{r.choice(['', '', ' ' + self.sentence()])}</li>" for _ in range(rows + 1)) + "</ul>"
        if kind == "terms":
            return f"<dl{kept}>" + "".join(f"<dt{kept}>{self.words(1, 4)}</dt><dd{kept}>{self.prose()}</dd>" for _ in range(rows)) + "</dl>"
        if kind == "table":
            cell = lambda tag: f"<{tag}{kept}>{r.choice([self.words(1, 4), str(r.randint(1, 9999)), self.sentence()])}</{tag}>"
            line = lambda tag: f"<tr{kept}>" + "".join(cell(tag) for _ in range(3)) + "</tr>"
            return f"<table{kept}>" + r.choice(["", line("th")]) + "".join(line("td") for _ in range(rows)) + "</table>"
        if kind == "figure":
            return f"<figure{kept}><img src=x><figcaption{kept}>{self.sentence()}</figcaption></figure>"
        return f"<pre{kept}>{self.words(3, 20)}</pre>"

    def junk(self, kind: str) -> str:
        r = self.r
        link = lambda: f"<a href='/{self.words(1, 1)}'>{self.words(1, 3)}</a>"
        links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
        token = {"ad": TOKENS["ad"], "notice": TOKENS["notice"], "share": TOKENS["share"], "related": TOKENS["side"], "comment": TOKENS["comment"], "nav": TOKENS["nav"], "header": TOKENS["header"], "footer": TOKENS["footer"], "form": TOKENS["form"]}[kind].split()
        name = f'{r.choice(["class", "id"])}="{r.choice(["", "site-", "page-", "js-", "x "])}{r.choice(token)}{r.choice(["", "-box", "_inner", " wide", "1"])}"'
        if kind == "nav":
            return r.choice([f"<nav>{links()}</nav>", f"<nav {name}>{links()}</nav>", f"<div {name}>{links()}</div>", f"<ul {name}>" + "".join(f"<li>{link()}</li>" for _ in range(4)) + "</ul>"])
        if kind == "header":
            return r.choice([f"<header><h1>{self.words(1, 4)}</h1>{links()}</header>", f"<div {name}><p>{self.words(1, 8)}</p></div>", f"<header {name}>{self.words(1, 6)}</header>"])
        if kind == "footer":
            text = f"&copy; {self.words(1, 4)} &middot; {self.prose()}"
            return r.choice([f"<footer>{text}</footer>", f"<footer {name}><p>{text}</p>{links()}</footer>", f"<div {name}>{text} {link()} | {link()}</div>"])
        if kind == "form":
            return f"<form {name}><p>{self.words(1, 8)}</p><label>{self.words(1, 3)}</label><input name=q></form>"
        if kind == "comment":
            one = lambda: f"<div class='{r.choice(['comment', 'reply', 'item'])}'><p>{self.prose()}</p></div>"
            tag = r.choice(["section", "div", "ol", "aside"])
            return f"<{tag} {name}><h3>{self.words(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind == "related":
            return r.choice([f"<aside {name}><h3>{self.words(1, 3)}</h3>{links()}</aside>", f"<aside><p>{self.prose()}</p></aside>", f"<div {name}>{links()}<p>{self.prose()}</p></div>"])
        tag = r.choice(["div", "section", "p", "aside"])
        return f"<{tag} {name}>{r.choice(['', '<p>' if tag != 'p' else ''])}{self.prose()}</{tag}>"

    def page(self) -> str:
        r = self.r
        body = self.article()
        kept = ' data-kept="1"'
        kind = r.choice(["article", "article", "main", "div", "both", "section", "bare"])
        words = TOKENS["article"].split()
        name = f' class="{r.choice(words)}"' if r.random() < 0.6 else ""
        wrap = {"article": f"<article{kept}{name}>{body}</article>", "main": f"<main{kept}>{body}</main>", "div": f'<div{kept} class="{r.choice(words)}">{body}</div>', "section": f"<section{kept}{name}>{body}</section>", "both": f"<main{kept}><article{kept}>{body}</article></main>", "bare": body}[kind]
        before = [self.junk(k) for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.5]
        after = [self.junk(k) for k in ("comment", "related", "share", "ad", "notice", "form", "nav") if r.random() < 0.35]
        r.shuffle(before)
        r.shuffle(after)
        inner = "".join(before) + wrap + "".join(after) + (self.junk("footer") if r.random() < 0.8 else "")
        if r.random() < 0.3:
            inner = f'<div{kept} id="{r.choice(["page", "wrapper", "container"])}">{inner}</div>'
        return f"<html{kept}><head><title>{self.words(2, 6)}</title></head><body{kept}>{inner}</body></html>"


_model: list[Boosted] = []


def train(pages: int = PAGES, seed: int = SEED) -> Boosted:
    """The trees, fitted once a process; the generator's seed makes them the same everywhere."""
    if not _model:
        made, xs, ys = Generator(seed), [], []
        for _ in range(pages):
            nodes = walk(parse(made.page()))
            xs.append(features(nodes))
            ys.append(np.array([1.0 if "data-kept" in n.attrs or n.parent is None else 0.0 for n in nodes]))
        _model.append(Boosted().fit(np.concatenate(xs), np.concatenate(ys)))
    return _model[0]


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """The most probable labels in which no node below a dropped one is kept (one pass up, one down)."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log(1 - p)
    at = {id(n): i for i, n in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        k = at[id(nodes[i].parent)]
        keep[k] += max(keep[i], drop[i])
        drop[k] += drop[i]
    out = [True] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[at[id(nodes[i].parent)]] and bool(keep[i] > drop[i])
    return out


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page; the trees see the nodes of many pages at once."""
    out: list[str] = []
    held: list[list[Node]] = []

    def flush() -> None:
        p, at = model.probability(np.concatenate([features(nodes) for nodes in held])), 0
        for nodes in held:
            kept = {id(n) for n, k in zip(nodes, decode(nodes, p[at : at + len(nodes)])) if k}
            out.append(render(nodes[0], kept))
            at += len(nodes)
        held.clear()

    for page in pages:
        held.append(walk(parse(page or "")))
        if sum(map(len, held)) > NODES:
            flush()
    if held:
        flush()
    return out


def render(root: Node, kept: set[int]) -> str:
    """The kept blocks in page order, one a line."""
    blocks: list[str] = []

    def flush(run: list[str]) -> None:
        text = "".join(run)
        text = _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
        if text:
            blocks.append(text)
        run.clear()

    todo: list[tuple[Node, int]] = [(root, 0)]
    run: list[str] = []
    while todo:
        node, k = todo.pop()
        while k < len(node.parts):
            part = node.parts[k]
            k += 1
            if isinstance(part, Node):
                flush(run)
                if id(part) in kept:
                    todo.append((node, k))
                    node, k = part, 0
            else:
                run.append(part[0] if isinstance(part, tuple) else part)
        flush(run)
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars.

    White space is what ``\\s`` matches after character references are decoded.  A null or empty page,
    or one without article blocks, has an empty text.  Repeated rows and nulls in id or url give a row
    each; other columns are not read."""
    prepare(pages.sparkSession)
    model = train()

    def work(batches):
        for b in batches:
            rows = b.column(2).to_pylist()
            texts = main_texts(rows, model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = map_arrow(src, work, "page_id long, url string, text string, n_chars long")
    return out.withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
