"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements and, as leaves, the runs of inline content between block
boundaries; each is content or boilerplate.  A node's own potential comes from its tag, the words of
its class, id and role, and for a run its length, link share and punctuation taken together, its parent
and a copyright sign; an edge's potential from how labels of parent and child go together.  Both are smoothed counts over labelled
pages.  Sum-product messages, up to the root and down again, give each run's marginal; runs of 1/2 or
more are the main text.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Elements by their role in the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())  # their content is no markup: without an end tag they take the rest of the page
HIDDEN = frozenset("noscript template iframe canvas video audio".split())  # left out up to the matching end tag; without one the tag alone is
INLINE = frozenset("svg select button option datalist".split())  # left out, but they end at any block boundary
BLOCK = frozenset("html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset legend address details summary dialog hgroup center menu caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes these if they are open, up to the nearest of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>|<[a-zA-Z!?/][^>]*+\Z", re.S)
_INLINE_END = re.compile(rf"</?({'|'.join(sorted(BLOCK | INLINE))})(?![^\s/>])[^>]*>", re.I)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    tag: str
    names: tuple[str, ...] = ()
    text: list[str] = field(default_factory=list)  # of a run
    linked: int = 0  # characters of the run inside links
    label: int | None = None  # in labelled pages
    children: list[Node] = field(default_factory=list)


def _names(attributes: str) -> tuple[tuple[str, ...], str | None]:
    names, label = [], None
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "itemprop"):
            names += [w.lower() for w in _WORD.findall(value)]
        elif key in ("hidden", "aria-hidden") or key == "style" and re.search(r"display\s*:\s*none", value):
            names.append("hidden")
        elif key == "data-label":
            label = value
    return tuple(dict.fromkeys(names)), label


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where the content of each element of this tag begins and its end tag ends, nested ones matched; unclosed ones are not listed."""
    found, opened = {}, []
    for m in re.finditer(rf"<(/?){tag}(?![^\s/>])[^>]*>", page, re.I):
        if not m[1]:
            opened.append(m.end())
        elif opened:
            found[opened.pop()] = m.end()
    return found


def _inline_end(page: str, tag: str, at: int) -> int:
    """End of a control or drawing: after its end tag, or before the first block boundary or further start of its tag; no end at all leaves out the tag alone."""
    for m in _INLINE_END.finditer(page, at):
        other = m[1].lower()
        if other == tag:
            return m.start() if m[0][1] != "/" else m.end()
        if other in BLOCK:
            return m.start()
    return at


def parse(page: str, labelled: bool = False) -> Node:
    """The tree of block elements and runs.  Scripts, forms' controls and the like leave nothing; ``labelled`` pages are read with their labels."""
    root = Node("root")
    stack, anchors, run = [root], 0, None
    places: dict[str, list[int]] = defaultdict(list)  # of each open tag, its places in the stack: no search, however deep the page
    at, end = 0, len(page)
    ends: dict[str, dict[int, int]] = {}

    def add(text: str) -> None:
        nonlocal run
        if run is None:
            if not text or text.isspace():
                return
            run = Node("#run")
            stack[-1].children.append(run)
        run.text.append(text)
        if anchors:
            run.linked += len(text)

    def close(k: int) -> None:
        nonlocal run
        run = None
        while len(stack) > k:
            places[stack.pop().tag].pop()

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(_html.unescape(page[at:]))
            break
        if m.start() > at:
            add(_html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if tag in BLOCK:
                run = None
                if places[tag]:
                    close(places[tag][-1])
            elif tag == "a":
                anchors = max(0, anchors - 1)
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in HIDDEN and not attributes.endswith("/"):
            if tag not in ends:
                ends[tag] = _ends(page, tag)
            at = ends[tag].get(at, at)
            continue
        if tag in INLINE and not attributes.endswith("/"):
            at = _inline_end(page, tag, at)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                add(" ") if run is not None else None
            continue
        if tag == "a":
            anchors += 1
        if tag not in BLOCK:
            continue
        anchors = 0
        if any(n.tag == "p" for n in stack[-1:]):  # any block ends a paragraph
            close(len(stack) - 1)
        if tag in CLOSES:
            these, stops = (max((places[t][-1] for t in tags if places[t]), default=0) for tags in CLOSES[tag])
            if these > stops:
                close(these)
        names, label = _names(attributes) if attributes else ((), None)
        node = Node(tag, names, label=int(label) if labelled and label is not None else None)
        stack[-1].children.append(node)
        run = None
        if not attributes.endswith("/"):
            places[tag].append(len(stack))
            stack.append(node)
    return root


def text_of(run: Node) -> str:
    return " ".join("".join(run.text).split())


def features(node: Node, parent: Node | None, place: int) -> list[str]:
    if node.tag != "#run":
        return ["tag=" + node.tag, *("name=" + n for n in node.names)]
    text = text_of(node)
    n = text.count(" ") + 1 if text else 0
    size = sum(n >= x for x in (1, 2, 4, 7, 12, 25, 60))
    share = node.linked / max(1, sum(map(len, node.text)))
    links = 0 if not node.linked else 1 if share < 0.25 else 2 if share < 0.7 else 3
    stop = text[-1:] in ".!?…”\"'»:;" if text else False
    sign = "" if "\N{COPYRIGHT SIGN}" not in text else "first" if text[0] == "\N{COPYRIGHT SIGN}" else "later"
    # joint features: parts that go together would count twice if each had a potential of its own
    return [f"run={size},{links},{int(stop)}", f"in={parent.tag if parent else ''},{min(size, 3)},{links}", f"sign={sign},{min(size, 5)}"]


def kind(node: Node) -> str:
    """Of what sort a child is: headings go with their parent's label far more often than other elements."""
    return "run" if node.tag == "#run" else "heading" if node.tag in HEADINGS else "block"


def walk(root: Node) -> tuple[list[Node], list[int]]:
    """Nodes in page order, each after its parent, and the parents' places; no recursion, so depth is no limit."""
    nodes, parents, stack = [], [], [(root, -1)]
    while stack:
        node, up = stack.pop()
        at = len(nodes)
        nodes.append(node)
        parents.append(up)
        stack += [(c, at) for c in reversed(node.children)]
    return nodes, parents


@dataclass
class Model:
    """Log potentials: of each feature, content minus boilerplate; of each edge by (parent's label, child's label)."""

    feature: dict[str, float]
    edge: dict[str, list[list[float]]]  # by the child's kind
    prior: float

    def marginals(self, nodes: list[Node], parents: list[int]) -> list[float]:
        """P(content) of every node: messages from the leaves up, then from the root down."""
        n = len(nodes)
        own = [sum(self.feature.get(f, 0.0) for f in features(x, nodes[p] if p >= 0 else None, k)) for k, (x, p) in enumerate(zip(nodes, parents))]
        zero, one = [0.0] * n, own[:]  # log beliefs from the node and all below it
        one[0] += self.prior
        up0, up1 = [0.0] * n, [0.0] * n
        for k in range(n - 1, 0, -1):
            e = self.edge[kind(nodes[k])]
            up0[k], up1[k] = _add(zero[k] + e[0][0], one[k] + e[0][1]), _add(zero[k] + e[1][0], one[k] + e[1][1])
            p = parents[k]
            zero[p] += up0[k]
            one[p] += up1[k]
        for k in range(1, n):
            p = parents[k]
            e = self.edge[kind(nodes[k])]
            rest0, rest1 = zero[p] - up0[k], one[p] - up1[k]
            top = max(rest0, rest1)  # only the ratio counts
            rest0, rest1 = rest0 - top, rest1 - top
            zero[k] += _add(rest0 + e[0][0], rest1 + e[1][0])
            one[k] += _add(rest0 + e[0][1], rest1 + e[1][1])
        return [1 / (1 + math.exp(min(700.0, max(-700.0, z - o)))) for z, o in zip(zero, one)]


def _add(a: float, b: float) -> float:
    return (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))


def _labelled(nodes: list[Node], parents: list[int]) -> list[int]:
    """Labels of all nodes: a run's is that of the nearest labelled element; an element's is whether it holds content."""
    given: list[int] = []
    for x, p in zip(nodes, parents):
        given.append(x.label if x.label is not None else given[p] if p >= 0 else 0)
    out = [g if x.tag == "#run" else 0 for x, g in zip(nodes, given)]
    for k in range(len(nodes) - 1, 0, -1):
        out[parents[k]] |= out[k]
    return out


def train(pages: list[str], alpha: float = 1.0) -> Model:
    """From pages whose elements carry ``data-label`` 0 or 1; what lies below inherits it."""
    seen = {False: (Counter(), Counter()), True: (Counter(), Counter())}  # elements, runs
    total = {False: [0, 0], True: [0, 0]}
    pairs = {k: [[alpha, alpha], [alpha, alpha]] for k in ("run", "heading", "block")}
    roots = [0, 0]
    for page in pages:
        nodes, parents = walk(parse(page, True))
        labels = _labelled(nodes, parents)
        roots[labels[0]] += 1
        for k, (x, p, y) in enumerate(zip(nodes, parents, labels)):
            is_run = x.tag == "#run"
            total[is_run][y] += 1
            seen[is_run][y].update(set(features(x, nodes[p] if p >= 0 else None, k)))
            if p >= 0:
                pairs[kind(x)][labels[p]][y] += 1
    feature = {}
    for is_run, (bad, good) in seen.items():
        for f in {*bad, *good}:
            if bad[f] + good[f] >= 3:
                feature[f] = math.log((good[f] + alpha) / (total[is_run][1] + 2 * alpha)) - math.log((bad[f] + alpha) / (total[is_run][0] + 2 * alpha))
    # the edge potential is the pointwise mutual part: the features already hold the child's own share
    edge = {}
    for what, t in pairs.items():
        n = sum(map(sum, t))
        col = [(t[0][y] + t[1][y]) / n for y in (0, 1)]
        bad, good = total[what == "run"]
        edge[what] = [[math.log(t[x][y] / sum(t[x]) / col[y]) + y * math.log((good + alpha) / (bad + alpha)) for y in (0, 1)] for x in (0, 1)]
    return Model(feature, edge, math.log((roots[1] + alpha) / (roots[0] + alpha)))


def training_pages(count: int = 600, seed: int = 7) -> list[str]:
    """Labelled pages of many layouts, made up from a seed: what is content and what is not is known by construction."""
    rng = random.Random(seed)
    syllables = "an be ca do el fi go ha in jo ka lo mi na or pe qui re so ta un ve wa xi yo ze".split()

    def words(low: int, high: int, stop: bool = True) -> str:
        n = rng.randint(low, high)
        out = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
        return out.capitalize() + (rng.choice(["", ".", ".", ".", "!", "?", ".</b>"[:1]]) if stop else "")

    def named(*names: str) -> str:
        name = rng.choice(names) + rng.choice(["", "", "-" + rng.choice(["box", "wrap", "area", "inner", "1", "left", "top"])])
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{rng.choice(syllables)} {name}"'])

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 4, False)}</a></li>' for _ in range(rng.randint(low, high)))

    def sentence(low: int = 3, high: int = 25) -> str:
        return words(low, high)

    def menu() -> str:
        body = rng.choice([f"<ul>{links(3, 9)}</ul>", " | ".join(f'<a href="/x">{words(1, 3, False)}</a>' for _ in range(rng.randint(3, 8)))])
        tag = rng.choice(["nav", "nav", "nav", "div" + named("menu", "nav", "navigation", "navbar", "breadcrumb", "breadcrumbs", "toc")])
        return f'<{tag} data-label="0">{body}</{tag.split()[0]}>'

    def advert() -> str:
        inner = rng.choice([sentence(), f"<p>{sentence()}</p>", f'<a href="/x">{sentence(3, 12)}</a>', f"<h3>{words(2, 5, False)}</h3><p>{sentence(5, 40)}</p>"])
        tag = rng.choice(["div", "div", "section", "aside", "p"] if inner[0] != "<" else ["div", "div", "section", "aside"])
        return f'<{tag}{named("ad", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor")} data-label="0">{inner}</{tag}>'

    def notice() -> str:
        inner = rng.choice([sentence(8, 40), f"<p>{sentence(8, 40)}</p><button>{words(1, 2, False)}</button>", f"<p>{sentence(5, 25)} <a href='/x'>{words(1, 3, False)}</a></p>"])
        return f'<div{named("cookie", "cookies", "consent", "notice", "gdpr", "privacy", "alert", "popup", "modal", "overlay", "paywall", "disclaimer", "warning")} data-label="0">{inner}</div>'

    def sidebar() -> str:
        inner = rng.choice([f"<h3>{words(1, 4, False)}</h3><ul>{links(3, 8)}</ul>", f"<p>{sentence(5, 40)}</p>", f"<h4>{words(1, 3, False)}</h4><p>{sentence(5, 30)}</p><ul>{links(2, 5)}</ul>"])
        tag = rng.choice(["aside", "aside", "div" + named("sidebar", "widget", "related", "recommended", "popular", "trending", "side", "more", "rail")])
        return f'<{tag} data-label="0">{inner}</{tag.split()[0]}>'

    def form() -> str:
        inner = f"<label>{words(1, 4, False)}</label><input type='text'><p>{sentence(3, 20)}</p><button>{words(1, 2, False)}</button>"
        return rng.choice([f'<form data-label="0">{inner}</form>', f'<div{named("newsletter", "subscribe", "signup", "login", "search", "form", "register")} data-label="0"><p>{sentence(4, 25)}</p><form>{inner}</form></div>'])

    def comments() -> str:
        one = lambda: f'<{(t := rng.choice(["div", "li", "article"]))}{named("comment", "reply", "response")}><p>{sentence(3, 60)}</p></{t}>'
        tag = rng.choice(["section", "div"])
        return f'<{tag}{named("comments", "comments", "responses", "discussion", "replies", "disqus")} data-label="0"><h2>{words(1, 3, False)}</h2>{"".join(one() for _ in range(rng.randint(1, 6)))}</{tag}>'

    def share() -> str:
        return f'<div{named("share", "social", "tags", "pagination", "pager", "meta", "byline", "sharing")} data-label="0">{"".join(f"<a href=x>{words(1, 2, False)}</a> " for _ in range(rng.randint(2, 6)))}</div>'

    def header() -> str:
        return f'<header{rng.choice(["", named("header", "masthead", "site", "top")])} data-label="0"><div{named("logo", "brand", "site")}><a href="/">{words(1, 3, False)}</a></div>{rng.choice(["", menu(), f"<p>{sentence(3, 12)}</p>"])}</header>'

    def footer() -> str:
        inner = rng.choice([f"&copy; {words(1, 3, False)} &middot; {sentence(2, 20)}", f"<p>&copy; {words(1, 6)}</p><ul>{links(2, 6)}</ul>", f"<div><p>{sentence(4, 30)}</p></div>", sentence(3, 20)])
        tag = rng.choice(["footer", "footer", "footer", "div" + named("footer", "bottom", "copyright", "legal", "colophon")])
        return f'<{tag} data-label="0">{inner}</{tag.split()[0]}>'

    def paragraph() -> str:
        kind = rng.random()
        text = words(1, 4) if kind < 0.25 else words(5, 30) if kind < 0.6 else words(30, 140)
        if rng.random() < 0.04:
            text = rng.choice([f"{text} &copy; {words(1, 12)}", f"&copy; {words(4, 40)}", f"{words(3, 20)} &#169; {text}"])
        if rng.random() < 0.15:
            text += f' <a href="/x">{words(1, 4, False)}</a> {words(2, 20)}'
        if rng.random() < 0.1:
            text = f"<b>{text}<br>"
        tag = "p" if rng.random() < 0.85 else rng.choice(["div", "blockquote", "h2", "h3", "h4", "pre"])
        if tag[0] == "h":
            text = words(1, 8, False)
        return f"<{tag}>{text}" + ("" if tag == "p" and rng.random() < 0.1 else f"</{tag}>")

    def article() -> str:
        parts = [f"<h1>{words(1, 12, False)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 14)):
            parts.append(paragraph())
            if rng.random() < 0.06:
                parts.append("<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            if rng.random() < 0.04:
                parts.append(f"<table><tr><td>{words(1, 3, False)}</td><td>{words(1, 3, False)}</td></tr></table>")
            if rng.random() < 0.08:
                parts.append(rng.choice([advert, share, sidebar, form])())
        if rng.random() < 0.15:
            parts.append(rng.choice([comments, share])())
        tag = rng.choice(["article", "article", "article", "main", "div" + named("content", "article", "post", "entry", "main", "story", "body", "text")])
        return f'<{tag} data-label="1">{"".join(parts)}</{tag.split()[0]}>'

    pages = []
    for _ in range(count):
        before = [f() for f in (header, menu, notice, advert, sidebar, form) if rng.random() < 0.45]
        after = [f() for f in (share, sidebar, comments, form, advert, notice) if rng.random() < 0.35]
        rng.shuffle(before)
        rng.shuffle(after)
        body = "".join([*before, article() if rng.random() < 0.97 else "", *after, footer() if rng.random() < 0.85 else ""])
        if rng.random() < 0.4:
            body = f'<div{named("page", "wrapper", "container", "layout", "row")}>{body}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 8, False)}</title></head><body>{body}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(training_pages())


def main_text(page: str, model: Model) -> str:
    nodes, parents = walk(parse(page))
    chances = model.marginals(nodes, parents)
    return " ".join(t for x, p in zip(nodes, chances) if x.tag == "#run" and p >= 0.5 and (t := text_of(x)))


def _extracted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [main_text(t.as_py() or "", model) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Null and empty html give an empty text; text before or without any element counts as a page of
    one block; repeated rows each get their own equal result; an empty table gives no rows; other
    columns are ignored.  A page of any length or depth is read whole, in time that grows with its
    length; runs of equal chance are treated alike, and a chance of exactly 1/2 is content.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(shared), rows.drop("html").schema.add("text", "string").add("n_chars", "long"))
