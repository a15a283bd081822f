"""Main-text extraction with a tree-structured graphical model over the DOM.

A page becomes a tree of elements and text runs. Every node has a hidden state,
content or not. Unary potentials come from a node's tag, the words of its class
and id, its length and its share of links; parent-child potentials say how the
state carries over an edge of that kind. Sum-product messages go from the leaves
up and from the root down, which gives each text run's exact marginal. The
weights are trained by conditional likelihood on pages whose labels are known
because ``labelled_pages`` builds them.

Defined cases: null or empty html gives the empty text; a page without content
gives the empty text; broken markup (tags never closed, a page that ends in the
middle of a tag) is read as a browser would, but that elements shown in other ways
(frames, drawings) are passed over, and their content too where they are closed;
a page without a wrapper around its content, or without markup, is read like any
other; repeated rows stay repeated; an
empty table gives an empty table; only the named columns are read. A page of any
length is read whole.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, map_batches, row_slices, text_buffers

# Fixed values of HTML: what closes what, what holds raw text, what stays in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg xmp noframes math".split())
#: Never closed, these take the rest of the page; the other ones of RAW are then passed over.
TO_THE_END = frozenset("script style textarea title xmp noframes".split())
#: Elements of other vocabularies may close themselves.
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

TAGS = "html body head main article section div p span a b ul ol li dl dt dd table tr td th h1 h2 h3 h4 h5 h6 nav header footer aside form button select option input label figure figcaption blockquote pre code em strong i small br address details summary dialog".split()
WORDS = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense adslot",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall subscribe newsletter signup toast announcement warning",
    "comment": "comment comments disqus reply replies respond discussion responses",
    "side": "sidebar side aside widget widgets rail related recommended recommendations popular trending more similar",
    "menu": "menu nav navigation navbar breadcrumb breadcrumbs pagination pager toc skip tabs links tags",
    "head": "header masthead topbar logo branding site",
    "foot": "footer foot copyright bottom colophon legal",
    "share": "share sharing social follow buttons toolbar",
    "form": "form login search searchbox register contact",
    "meta": "meta byline author date timestamp",
    "body": "article content main post entry body story text prose",
    "hidden": "hidden offscreen invisible",
}
GROUP = {w: g for g, ws in WORDS.items() for w in ws.split()}
LENGTHS = (1, 20, 60, 150, 400)
#: A page is plain where neither these elements nor any of WORDS part it.
PARTS = frozenset("article main nav header footer aside form".split())

_names = [f"tag:{t}" for t in [*TAGS, "other"]] + [f"word:{g}" for g in WORDS] + [f"links:{i}" for i in range(4)] + [f"size:{i}" for i in range(6)]
_names += [f"leaf:{t}" for t in [*TAGS, "other"]] + [f"length:{i}" for i in range(6)] + ["leaf", "in link", "stops", "no stop", "first word capital", "element", "plain whole"]
FEATURE = {n: i for i, n in enumerate(_names)}
EDGES = {t: i for i, t in enumerate([*TAGS, "other", "#text"])}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A class that begins so tells what a page has or lacks elsewhere, not what the element is.
ELSEWHERE = frozenset("has have no with without not".split())
SPLIT = re.compile(r"[^a-z]+")


def element_words(tag: str, attrs: str) -> tuple[str, ...]:
    """Groups of the words in an element's class, id and role, and ``hidden``; the classes of a body tell its site, not its part."""
    found = set()
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role") and tag != "body":
            for part in value.lower().split():
                words = SPLIT.split(part)
                if words[0] not in ELSEWHERE or len(words) == 1:
                    found |= {GROUP.get(w) for w in words}
        if (name == "hidden" and value.lower() != "until-found") or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and UNSEEN.search(value)):
            found.add("hidden")
    return tuple(sorted(found - {None}))


class Page:
    """Nodes in document order: parent, tag or text, words of class and id; blocks: lists of text nodes that share a line."""

    __slots__ = ("parents", "tags", "words", "texts", "linked", "blocks", "marks")

    def __init__(self, source: str):
        self.parents, self.tags, self.words, self.texts, self.linked = [-1], ["html"], [()], [None], [False]
        self.blocks: list[list[int]] = []
        self.marks: list[str] = [""]
        self._read(source)

    def _add(self, parent: int, tag: str, words=(), text=None, linked=False, mark="") -> int:
        self.parents.append(parent)
        self.tags.append(tag)
        self.words.append(words)
        self.texts.append(text)
        self.linked.append(linked)
        self.marks.append(mark)
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        stack, block, at, links = [0], [], 0, 0
        tags = self.tags
        open_tags: Counter[str] = Counter()
        raw_ends: dict[str, int] = {}  # of elements whose end tag is not found any more, from where on
        size = len(source)

        def flush() -> None:
            nonlocal block
            if block:
                self.blocks.append(block)
                block = []

        def pop_to(k: int) -> None:
            nonlocal links
            for n in stack[k:]:
                links -= tags[n] == "a"
                open_tags[tags[n]] -= 1
                if tags[n] not in INLINE:
                    flush()
            del stack[k:]

        def text(i: int, j: int) -> None:
            t = source[i:j]
            if t and not t.isspace():
                block.append(self._add(stack[-1], "#text", text=html.unescape(t), linked=links > 0))
            elif t and block:
                self.texts[block[-1]] += " "

        while at < size:
            m = TOKEN.search(source, at)
            if not m:
                text(at, size)
                break
            text(at, m.start())
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if tag in VOID or not open_tags[tag]:
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        pop_to(k)
                        break
                continue
            if tag == "br":
                if block:
                    self.texts[block[-1]] += " "
                continue
            attrs = m[3] if m[2] else m[6]
            if tag in RAW:
                if tag not in INLINE:
                    flush()
                if tag in FOREIGN and attrs.endswith("/"):
                    continue
                end = None
                if tag not in raw_ends and not (end := re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)):
                    raw_ends[tag] = at
                if end:
                    at = end.end()
                elif tag in TO_THE_END:
                    at = size
                continue
            if tag == "html" and "data-label" in attrs:
                self.marks[0] = attrs.partition("data-label=")[2].strip("\"' ")[:1]
            if tag in ("html", "head"):
                continue
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        pop_to(k)
                        break
                    if tags[stack[k]] not in INLINE:
                        break
            if tag in SIBLINGS:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in SIBLINGS[tag]:
                        pop_to(k)
                        break
                    if tags[stack[k]] in BARRIER[tag]:
                        break
            if tag not in INLINE:
                flush()
            words, mark = (), ""
            if attrs and not attrs.isspace() and tag != "a":
                words = element_words(tag, attrs)
                if "data-label" in attrs:
                    mark = attrs.partition("data-label=")[2].strip("\"' ")[:1]
            node = self._add(stack[-1], tag, words, mark=mark)
            if tag not in VOID:
                stack.append(node)
                open_tags[tag] += 1
                links += tag == "a"
        pop_to(0)


def _features(page: Page) -> list[list[int]]:
    n = len(page.tags)
    total, linked = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if page.texts[i] is not None:
            total[i] = len(page.texts[i])
            linked[i] = total[i] if page.linked[i] else 0
        if i:
            total[page.parents[i]] += total[i]
            linked[page.parents[i]] += linked[i]
    parted = any(page.tags[i] in PARTS or page.words[i] for i in range(n))
    out, f = [], FEATURE
    for i in range(n):
        size = sum(total[i] >= x for x in LENGTHS)
        if page.texts[i] is None:
            share = linked[i] / total[i] if total[i] else 0
            row = [f.get(f"tag:{page.tags[i]}", f["tag:other"]), f[f"links:{min(3, int(share * 4))}"], f[f"size:{size}"], f["element"]]
            row += [f[f"word:{w}"] for w in page.words[i]]
            if not parted and page.tags[i] in ("html", "body"):
                row.append(f["plain whole"])
        else:
            t = page.texts[i].strip()
            row = [f.get(f"leaf:{page.tags[page.parents[i]]}", f["leaf:other"]), f[f"length:{size}"], f["leaf"], f["stops" if t[-1:] in ".!?…:;\"" else "no stop"]]
            if page.linked[i]:
                row.append(f["in link"])
            if t[:1].isupper():
                row.append(f["first word capital"])
        out.append(row)
    return out


class Forest:
    """The nodes of many pages as arrays, grouped by depth for message passing."""

    def __init__(self, pages: list[Page]):
        rows = [r for p in pages for r in _features(p)]
        self.starts = np.cumsum([0, *[len(p.tags) for p in pages]])
        self.parents = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + s) for p, s in zip(pages, self.starts[:-1], strict=True)]).astype(np.int64)
        self.flat = np.concatenate([np.array(r) for r in rows])
        self.node = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.kinds = np.array([EDGES.get(t, EDGES["other"]) for p in pages for t in p.tags])
        depth = np.zeros(len(rows), np.int64)
        # like siblings say the same thing many times over: together they weigh as much as one
        alike = [(p, t, w) for page, at in zip(pages, self.starts.tolist(), strict=False) for p, t, w in zip((x + at for x in page.parents), page.tags, page.words, strict=True)]
        count = Counter(alike)
        self.weight = np.ones(len(rows))
        for i, p in enumerate(self.parents.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
                self.weight[i] = self.weight[p] / count[alike[i]]
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])

    def marginals(self, unary: np.ndarray, pair: np.ndarray, edges: bool = False):
        """P(content) of each node; with ``edges``, also the joint 2 x 2 of each node with its parent."""
        n = len(self.parents)
        up = np.zeros((n, 2))
        up[:, 1] = np.bincount(self.node, weights=unary[self.flat], minlength=n) * self.weight
        pair = normal(pair)
        message = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            x = pair[self.kinds[level]] + up[level][:, None, :]
            message[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            np.add.at(up, self.parents[level], message[level])
        down = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parents[level]
            rest = down[p] + up[p] - message[level]
            x = pair[self.kinds[level]] + rest[:, :, None]
            down[level] = np.logaddexp(x[:, 0], x[:, 1])
            if edges:
                x = x + up[level][:, None, :]
                x -= x.reshape(-1, 4).max(1)[:, None, None]
                x = np.exp(x)
                joint[level] = x / x.sum((1, 2))[:, None, None]
        both = up + down
        content = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
        return (content, joint) if edges else content


def normal(pair: np.ndarray) -> np.ndarray:
    """Pair tables as log-probabilities of the child's state given the parent's, so that a child without evidence of its own says nothing about its parent."""
    return pair - np.logaddexp(pair[:, :, :1], pair[:, :, 1:])


def _words(rng: random.Random, lo: int, hi: int, stop: bool = True) -> str:
    letters = "aeiounrstlmdhc"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(lo, hi))]
    for k in range(rng.randint(5, 14), len(words) - 1, rng.randint(6, 15)):
        words[k] += rng.choice([".", ","])
    text = " ".join(words).capitalize()
    return text + "." if stop else text


def labelled_page(rng: random.Random) -> str:
    """A page whose elements carry data-label: 1 where content begins, 0 where it ends; the label holds for all below."""

    def item() -> str:
        return f'<li><a href="/x">{_words(rng, 1, 3, False)}</a></li>'

    def name(group: str, extra: str = "") -> str:
        w = rng.choice(WORDS[group].split())
        return rng.choice([f'class="{w}"', f'id="{w}"', f'class="{w} box"', f'class="{extra}{w}-wrap"'])

    def off(tag: str, attrs: str, inner: str) -> str:
        return f"<{tag} {attrs} data-label=0>{inner}</{tag}>"

    def paragraph() -> str:
        t = _words(rng, *rng.choice([(1, 5), (4, 30), (20, 90), (60, 200)]), stop=rng.random() < 0.9)
        kind = rng.random()
        if kind < 0.1:
            t = f"<b>{t}<br>"
            return f"<p>{t}" + rng.choice(["", "</p>"])
        if kind < 0.2:
            t += f' <a href="/y">{_words(rng, 1, 3, False)}</a> ' + _words(rng, 3, 20)
        if kind < 0.27:
            return f"<ul>{''.join(f'<li>{_words(rng, 2, 25, rng.random() < 0.6)}</li>' for _ in range(rng.randint(2, 6)))}</ul>"
        if kind < 0.3:
            return f"<blockquote>{t}</blockquote>"
        if kind < 0.33:
            return f"<h2>{_words(rng, 2, 7, False)}</h2>"
        if kind < 0.36:
            return f"<table><tr><td>{_words(rng, 1, 6, False)}</td><td>{_words(rng, 1, 8)}</td></tr></table>"
        if kind < 0.38:
            return f"<pre>{t}</pre>"
        if kind < 0.41:
            return f"<{(o := rng.choice(['object', 'canvas', 'figure', 'center']))}><p>{t}</p></{o}>"
        return f"<p>{t}</p>"

    def clutter(inside: bool = False) -> str:
        kind = rng.randrange(9)
        text = _words(rng, 3, 30)
        if kind == 0:
            return off(rng.choice(["div", "section", "aside"]), name("ad"), rng.choice([text, f"<p>{text}</p>"]))
        if kind == 1:
            return off(rng.choice(["div", "section"]), name("notice"), f"<p>{text}</p>" + rng.choice(["", "<button>OK</button>"]))
        if kind == 2:
            posts = "".join(f"<{(c := rng.choice(['div', 'li', 'p', 'div', 'li', 'p', 'article']))}>{_words(rng, 3, 40)}</{c}>" for _ in range(rng.randint(1, 5)))
            return off(rng.choice(["div", "section", "ol"]), name("comment"), rng.choice(["", "<h3>" + _words(rng, 1, 3, False) + "</h3>"]) + posts)
        if kind == 3:
            return off("div", name("share"), "".join(f'<a href="/s">{_words(rng, 1, 2, False)}</a> ' for _ in range(3)))
        if kind == 4:
            return off(rng.choice(["div", "ul"]), name("menu"), "".join(item() for _ in range(rng.randint(2, 7))))
        if kind == 5:
            return off("form", rng.choice(["", name("form")]), f"<label>{_words(rng, 1, 4, False)}</label><input name=q><button>{_words(rng, 1, 2, False)}</button>" + rng.choice(["", f"<p>{text}</p>"]))
        if kind == 6:
            return off(rng.choice(["aside", "div"]), name("side"), f"<h3>{_words(rng, 1, 3, False)}</h3>" + rng.choice([f"<ul>{item()}{item()}{item()}</ul>", f"<p>{text}</p>"]))
        if kind == 7 and not inside:
            return off("aside", "", rng.choice([f"<p>{text}</p>", f"<ul>{item()}{item()}</ul>", text]))
        return off("div", name("hidden") if rng.random() < 0.5 else "hidden", text)

    def alone() -> str:
        """Nothing but content, right in the body, in plain elements or without any markup, at times with one piece of clutter."""
        head = f"<h1>{_words(rng, 2, 12, rng.random() < 0.5)}</h1>" if rng.random() < 0.4 else ""
        kind = rng.random()
        if kind < 0.12:
            return f"<html data-label=1>{' '.join(_words(rng, 5, 60) for _ in range(rng.randint(1, 4)))}"
        elif kind < 0.42:
            inner = head + "".join(f"<div>{_words(rng, 12, 120)}</div>" for _ in range(rng.choice([1, 1, 2, 3, 5])))
        elif kind < 0.55:
            inner = head + f"<div>{''.join(paragraph() for _ in range(rng.randint(1, 6)))}</div>"
        elif kind < 0.63:
            inner = head + "<br>".join(_words(rng, 10, 80) for _ in range(rng.randint(1, 6)))
        else:
            inner = head + "".join(paragraph() for _ in range(rng.randint(1, 8)))
        if rng.random() < 0.2:
            inner += clutter()
        return rng.choice([f"<html data-label=1>{inner}", f"<html data-label=1><body data-label=1>{inner}</body></html>", f"<!DOCTYPE html><html data-label=1><head><title>t</title></head><body data-label=1>{inner}</body></html>"])

    if rng.random() < 0.3:
        return alone()
    title = f"<h1>{_words(rng, 2, 12, rng.random() < 0.5)}</h1>"
    body = [title] if rng.random() < 0.7 else []
    long = rng.random() < 0.08  # as long pages are, each of their paragraphs must speak for the content
    for _ in range(rng.randint(20, 60) if long else rng.choice([1, 1, 1, 2, 3, 5, 9])):
        body.append(paragraph())
        if rng.random() < (0.02 if long else 0.12):
            body.append(clutter(True))
    inner = "".join(body)
    layout = rng.random()
    if layout < 0.4:
        inner = f"<article data-label=1>{inner}</article>"
    elif layout < 0.55:
        inner = f"<main data-label=1>{inner}</main>"
    elif layout < 0.65:
        inner = f"<main data-label=1><article>{inner}</article>" + (clutter() if rng.random() < 0.4 else "") + "</main>"
    elif layout < 0.78:
        inner = f"<{(t := rng.choice(['div', 'section']))} {name('body')} data-label=1>{inner}</{t}>"
    elif layout < 0.86:
        inner = f"<div data-label=1>{inner}</div>"
    loose = layout >= 0.86  # right in the body, which is then content but for what is marked as none
    parts = []
    bare = rng.random() < 0.15  # nothing but the content, and perhaps one piece of clutter
    if not bare and rng.random() < 0.8:
        links = f"<ul>{''.join(item() for _ in range(rng.randint(2, 8)))}</ul>"
        parts.append(rng.choice([f"<nav data-label=0>{links}</nav>", f"<header data-label=0>{_words(rng, 1, 4, False)}<nav>{links}</nav></header>", off("div", name("menu"), links), off("header", name("head"), f"<h1>{_words(rng, 1, 4, False)}</h1><p>{_words(rng, 2, 9)}</p>"), off("div", name("head"), links)]))
    for _ in range(rng.choice([0, 1] if bare else [0, 1, 1, 2])):
        parts.append(clutter())
    if not bare and rng.random() < 0.3:
        parts.append(f"<aside data-label=0><p>{_words(rng, 4, 40)}</p></aside>")
    parts.append(inner)
    for _ in range(0 if bare else rng.choice([0, 0, 1, 2])):
        parts.append(clutter())
    if not bare and rng.random() < 0.8:
        foot = rng.choice([_words(rng, 4, 25), f"<p>{_words(rng, 4, 20)}</p>", f"<ul>{item()}{item()}</ul><p>&copy; {_words(rng, 2, 6)}</p>"])
        parts.append(rng.choice([f"<footer data-label=0>{foot}</footer>", off("div", name("foot"), foot)]))
    whole = "".join(parts)
    if rng.random() < 0.25:
        whole = f"<div {rng.choice(['', 'class=page', 'id=wrapper', 'class=container'])}>{whole}</div>"
    label = " data-label=1" if loose else ""
    page = f"<!DOCTYPE html><html{label}><head><title>t</title><style>p{{}}</style></head><body{label}>{whole}</body></html>"
    return page[: int(len(page) * rng.uniform(0.6, 1))] if rng.random() < 0.08 else page


def page_labels(page: Page) -> list[int]:
    out = [int(page.marks[0] == "1")] + [0] * (len(page.tags) - 1)
    for i in range(1, len(out)):
        out[i] = int(page.marks[i]) if page.marks[i] in ("0", "1") else out[page.parents[i]]
    return out


@functools.cache
def train(n_pages: int = 900, rounds: int = 200, rate: float = 0.15, decay: float = 0.002, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(unary weights, pair tables) of greatest penalised conditional likelihood on the labelled pages (Adam, full batch)."""
    rng = random.Random(seed)
    pages = [Page(labelled_page(rng)) for _ in range(n_pages)]
    forest = Forest(pages)
    truth = np.array([x for p in pages for x in page_labels(p)])
    unary, pair = np.zeros(len(FEATURE)), np.zeros((len(EDGES), 2, 2))
    below = np.flatnonzero(forest.parents >= 0)
    seen = np.zeros_like(pair)
    np.add.at(seen, (forest.kinds[below], truth[forest.parents[below]], truth[below]), 1)
    moments = [np.zeros_like(unary), np.zeros_like(unary), np.zeros_like(pair), np.zeros_like(pair)]
    for t in range(1, rounds + 1):
        content, joint = forest.marginals(unary, pair, edges=True)
        expected = np.zeros_like(pair)
        np.add.at(expected, forest.kinds[below], joint[below])
        g_unary = np.bincount(forest.flat, weights=((truth - content) * forest.weight)[forest.node], minlength=len(unary)) - decay * n_pages * unary / 10
        g_pair = seen - expected
        g_pair = g_pair - np.exp(normal(pair)) * g_pair.sum(2, keepdims=True) - decay * n_pages * pair / 10
        for x, g, a, b in ((unary, g_unary, 0, 1), (pair, g_pair, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.99 * moments[b] + 0.01 * g * g
            x += rate * (moments[a] / (1 - 0.9**t)) / (np.sqrt(moments[b] / (1 - 0.99**t)) + 1e-8)
    return unary, pair


def main_texts(sources: list[str], unary: np.ndarray, pair: np.ndarray) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    content = forest.marginals(unary, pair) >= 0.5
    out = []
    for page, start in zip(pages, forest.starts.tolist(), strict=False):
        lines = []
        for block in page.blocks:
            line = " ".join("".join(page.texts[i] for i in block if content[start + i]).split())
            if line:
                lines.append(line)
        out.append("\n".join(lines))
    return out


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, text): the main text of each page; ``keep`` names further columns to carry along. A kept column called ``text`` gives way to the main text."""
    unary, pair = train()
    names = [id_col, *keep]
    # columns are carried under numbers: one of them may be called text
    carried = [f"_{k}" for k in range(len(names))]

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        data, ends = text_buffers(batch.column(len(names)))
        for lo, hi in row_slices(ends, 1 << 20):
            texts = main_texts([data[ends[i] : ends[i + 1]].tobytes().decode() for i in range(lo, hi)], unary, pair)
            yield {c: batch.column(k).slice(lo, hi - lo) for k, c in enumerate(carried)} | {"text": texts}

    types = ", ".join(f"{c} {df.schema[n].dataType.simpleString()}" for c, n in zip(carried, names, strict=True))
    out = map_batches(df.select(*[F.col(n).alias(c) for c, n in zip(carried, names, strict=True)], F.col(html_col).cast("string")), fn, f"{types}, text string")
    kept = [F.col(c).alias(n) for c, n in zip(carried, names, strict=True) if n != "text"]
    return out.select(*kept, "text")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    pages = extract(load(spark, sf_dir, "pages"), keep=("url",))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLES: dict[str, str] = {}
