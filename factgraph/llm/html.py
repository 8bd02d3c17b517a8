"""Operator 1, HTML extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

A tolerant parser turns a page into nodes in document order: block elements, inline elements that
have a class, id or role, and leaves, which are runs of text between block borders.  Each node gets
features of its tag, attribute tokens, depth, siblings and the density of its subtree; boosted trees
give the odds that it holds main text.  Decoding picks the likeliest set of nodes in which nothing
is kept below a node that is not: a dropped ancestor and a kept descendant cannot meet.

No table labels DOM nodes, so the trees are fitted on ``Params.pages`` pages that ``training_page``
writes with known labels, in many layouts, from a fixed seed; that number bounds the fit.

Defined cases: a null or empty page has an empty text; a page without markup is one leaf; markup that
is not closed ends with its parent, a head with its page's first body element, and a script, style,
title, textarea or iframe with the page, as in browsers; quotes inside a value without quotes, and a
quote that the page never closes, are part of the value; a comment left open ends with the page; comments, these five and other raw markup never
are text; a page of any length is read whole; equal rows get equal results; an empty table gives an empty
result.  Only the three named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._words import chunks, tidied


@dataclass(frozen=True)
class Params:
    pages: int = 700
    trees: int = 40
    depth: int = 4
    rate: float = 0.25
    bins: int = 32
    seed: int = 1


#: Quotes only delimit a value right after an equals sign, as in HTML; a value whose quote is never closed
#: ends with its tag.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>|<[!?][^>]*>""", re.S)
#: What can still be markup after a page's last ``>``.
_TAIL = re.compile(r"<!--.*", re.S)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")
#: Their content is no markup: it ends at the first end tag of the same name and nowhere else.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in ("script", "style", "title", "textarea", "iframe")}
#: Their content is markup that is never main text; left open, they end with their parent.
_SKIP = {"template", "noscript", "object", "svg", "math", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: An opening tag ends these open ones: what HTML lets authors leave out.
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOSCRIPT = re.compile(r"<(/?)noscript(?=[\s/>])", re.I)
#: An opening tag ends these skipped ones, unless it stands in one of _WITHIN.
_FOREIGN = {"b", "big", "blockquote", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img", "li", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strike", "strong", "sub", "sup", "table", "tt", "u", "ul", "var"}
_ENDS_SKIP = {"svg": _FOREIGN, "math": _FOREIGN, "select": {"input", "keygen", "select", "textarea", "caption", "table", "tbody", "td", "tfoot", "th", "thead", "tr"}}
_WITHIN = {"foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "body"}


@dataclass
class Nodes:
    """Nodes of pages in document order; end is the index after a node's subtree."""

    tag: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    text: list[list[str] | None] = field(default_factory=list)
    breaks: list[bool] = field(default_factory=list)


def parse(page: str, out: Nodes) -> None:
    """Appends the nodes of a page; its first node is a root without a tag."""
    tag, attrs, parent, end, depth, place = out.tag, out.attrs, out.parent, out.end, out.depth, out.place
    chars, links, stops, words, text, breaks = out.chars, out.links, out.stops, out.words, out.text, out.breaks
    root = len(tag)
    kids: dict[int, int] = {}

    def add(name: str, raw: str, up: int, level: int, leaf: list[str] | None) -> int:
        k = len(tag)
        n = kids.get(up, 0)
        kids[up] = n + 1
        tag.append(name)
        attrs.append(raw)
        parent.append(up)
        end.append(k + 1)
        depth.append(level)
        place.append(n)
        chars.append(0)
        links.append(0)
        stops.append(0)
        words.append(0)
        text.append(leaf)
        breaks.append(brk)
        return k

    brk = True
    stack: list[tuple[str, int, bool]] = [("", add("", "", -1, 0, None), True)]  # name, node, block
    leaf = -1
    in_link = 0
    at = 0
    body = False
    skip = ""
    inner: list[str] = []  # what is open in a skipped element

    def close(i: int) -> None:
        """Pops the stack down to i entries."""
        nonlocal leaf, brk, in_link
        while len(stack) > i:
            name, k, block = stack.pop()
            if name == "a":
                in_link -= 1
            if k >= 0:
                end[k] = len(tag)
                leaf = -1
            if block:
                leaf, brk = -1, True

    def opened(name: str) -> int:
        """The place in the stack that an end tag closes, or 0."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                return i
            if name in _INLINE and stack[i][2]:
                break
        return 0

    def say(s: str) -> None:
        nonlocal leaf, brk
        if leaf < 0:
            if not s.strip():
                if s and text and text[-1] is not None and not brk:
                    text[-1].append(" ")
                elif s:
                    brk = True
                return
            k = next(n for _, n, _ in reversed(stack) if n >= 0)
            leaf = add("#", "", k, len(stack), [])
            brk = False
        text[leaf].append(s)
        n = len(s)
        chars[leaf] += n
        if in_link:
            links[leaf] += n
        stops[leaf] += s.count(".") + s.count(",")
        words[leaf] += s.count(" ") + 1

    last = page.rfind(">")
    while m := _TOKEN.search(page, at) if at <= last else _TAIL.search(page, at):
        a = m.start()
        if a > at and not skip:
            say(page[at:a])
        at = m.end()
        if a > last or (name := m[2]) is None:
            continue
        name = name.lower()
        raw = m[3]
        if skip:
            if m[1]:
                if name in inner:
                    while inner.pop() != name:
                        pass
                    continue
                if name == skip:
                    skip = ""
                    continue
                if not opened(name) and name not in ("head", "body", "html"):
                    continue
            elif name != "body" and (name not in _ENDS_SKIP.get(skip, ()) or not _WITHIN.isdisjoint(inner)):
                if raw.endswith("/") or name in _VOID:
                    continue
                if name not in _RAW:
                    inner.append(name)
                    continue
                if end_tag := _RAW[name].search(page, at):
                    at = end_tag.end()
                    continue
                at = len(page)
                break
            skip = ""  # it was left open
        if m[1]:
            if i := opened(name):
                close(i)
            continue
        if name == "body" or name == "html" or name == "head":
            body |= name == "body"
            if name == "body" and raw:
                attrs[root] = raw
            continue
        if name in _RAW:
            leaf = -1
            if not raw.endswith("/"):
                end_tag = _RAW[name].search(page, at)
                at = end_tag.end() if end_tag else len(page)
            continue
        if name in _SKIP:
            in_head = not body and len(stack) == 1 and len(tag) == root + 1
            if name == "noscript" and in_head and not ((n := _NOSCRIPT.search(page, at)) and n[1]):
                continue  # left open in the head, which the first body element ends
            if not raw.endswith("/"):
                skip = name
                inner.clear()
            leaf = -1
            continue
        if name in _VOID:
            if name == "br" and leaf >= 0:
                text[leaf].append(" ")
            elif name in ("hr", "br"):
                leaf, brk = -1, True
            continue
        if name in _INLINE:
            node = -1
            if raw and ("class" in raw or "id=" in raw or "role" in raw or "style" in raw or "hidden" in raw):
                leaf = -1
                k = next(n for _, n, _ in reversed(stack) if n >= 0)
                node = add(name, raw, k, len(stack), None)
            in_link += name == "a"
            stack.append((name, node, False))
            continue
        if name in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][2]:
                    break
        elif name in _ENDS_SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _ENDS_SAME[name]:
                    close(i)
                    break
                if stack[i][0] in _SCOPE:
                    break
        leaf, brk = -1, True
        k = next(n for _, n, _ in reversed(stack) if n >= 0)
        stack.append((name, add(name, raw, k, len(stack), None), True))
    if not skip and at < len(page):
        say(page[at:])
    close(0)


def attribute_tokens(raw: str) -> list[str]:
    out = []
    for name, value in _ATTR.findall(raw):
        name = name.lower()
        if name in ("hidden", "aria-hidden"):
            out += ["hidden"] if value.strip("\"'").lower() not in ("false", "until-found") else []
        elif name == "style":
            out += ["hidden"] if "none" in value.replace(" ", "") and "display" in value else []
        else:
            out += _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return out


@dataclass
class Model:
    """tags and tokens: log-odds of main text; trees: (feature, edge, leaf values) in heap order."""

    tags: dict[str, float]
    tokens: dict[str, float]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    seen: dict[str, tuple[float, float]] = field(default_factory=dict)

    def odds(self, raw: str) -> tuple[float, float]:
        """Least and largest log-odds of the tokens of an attribute string."""
        if (out := self.seen.get(raw)) is None:
            found = [self.tokens.get(t, 0.0) for t in attribute_tokens(raw)] if raw else []
            out = (min(found, default=0.0), max(found, default=0.0))
            if len(self.seen) < 100_000:
                self.seen[raw] = out
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, edge, value in self.trees:
            k = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(value)))):
                k = 2 * k + 1 + (x[rows, feature[k]] > edge[k])
            out += value[k - len(feature)]
        return out


def features(nodes: Nodes, model: Model) -> np.ndarray:
    n = len(nodes.tag)
    parent, end = np.array(nodes.parent), np.array(nodes.end)
    own = np.array([model.tags.get(t, 0.0) for t in nodes.tag])
    token = np.array([model.odds(a) if a else (0.0, 0.0) for a in nodes.attrs]).reshape(n, 2)
    low, high = np.minimum(own, token[:, 0]).tolist(), np.maximum(own, token[:, 1]).tolist()
    parents = nodes.parent
    for i in range(n):  # a parent stands before its children
        if (p := parents[i]) >= 0:
            low[i] = min(low[i], low[p])
            high[i] = max(high[i], high[p])
    start = np.arange(n)

    def below(values: list[int] | np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return (total[end] - total[start]).astype(float)

    chars, links, stops, words = below(nodes.chars), below(nodes.links), below(nodes.stops), below(nodes.words)
    leaf = np.array([t is not None for t in nodes.text])
    leaves, items = below(leaf), below(np.array([t == "li" for t in nodes.tag]))
    root = np.where(parent < 0, start, 0)
    root = np.maximum.accumulate(root)
    before = np.concatenate([[0], np.cumsum(nodes.chars)])[:n]
    before = (before - before[root]).astype(float)
    up = np.where(parent < 0, start, parent)
    kids = np.bincount(parent[parent >= 0], minlength=n)
    size = (end - start).astype(float)
    whole = np.maximum(chars[root], 1)
    return np.stack(
        [
            own, token[:, 0], token[:, 1], np.array(low), np.array(high), np.array(nodes.depth, float), np.log1p(chars), links / np.maximum(chars, 1), chars / size,
            stops / np.maximum(chars, 1), words / np.maximum(leaves, 1), np.array(nodes.place, float), kids[up].astype(float), np.array(nodes.place) / np.maximum(kids[up], 1),
            chars / whole, before / whole, chars / np.maximum(chars[up], 1), leaves, items / size, leaf.astype(float), own[up], np.log1p(chars[up]),
        ],
        axis=1,
    )


def decode(nodes: Nodes, odds: np.ndarray) -> list[bool]:
    """The likeliest labels in which a node is kept only if its parent is; a root is always kept."""
    n, parent = len(nodes.tag), nodes.parent
    yes = (-np.logaddexp(0, -odds)).tolist()
    no = (-np.logaddexp(0, odds)).tolist()
    for i in range(n - 1, -1, -1):
        if (p := parent[i]) >= 0:
            yes[p] += max(yes[i], no[i])
            no[p] += no[i]
    keep = [True] * n
    for i in range(n):
        if (p := parent[i]) >= 0:
            keep[i] = keep[p] and yes[i] > no[i]
    return keep


def extract(pages: list[str | None], model: Model) -> list[str]:
    """Main text of each page."""
    nodes, first = Nodes(), []
    for page in pages:
        first.append(len(nodes.tag))
        parse(page or "", nodes)
    if not pages:
        return []
    keep = decode(nodes, model.score(features(nodes, model)))
    first.append(len(nodes.tag))
    out = []
    for a, b in zip(first, first[1:], strict=False):
        said: list[str] = []
        for i in range(a, b):
            if keep[i] and (t := nodes.text[i]) is not None:
                if nodes.breaks[i]:
                    said.append(" ")
                said += [entities.unescape(s) if "&" in s else s for s in t]
        out.append(" ".join("".join(said).split()))
    return out


# training -------------------------------------------------------------------------------------

#: Names that authors give to the two kinds of regions in the pages written for training.
MAIN_NAMES = ("content", "article", "post", "entry", "main", "story", "body", "text", "page-content", "post-body", "entry-content", "article-body", "prose")
OTHER_NAMES = {
    "nav": ("nav", "menu", "navbar", "breadcrumb", "topnav", "navigation", "toc", "pagination", "pager"),
    "header": ("header", "masthead", "topbar", "site-header", "logo", "branding"),
    "footer": ("footer", "site-footer", "copyright", "legal", "colophon", "bottom"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "rail", "teaser"),
    "notice": ("cookie", "consent", "notice", "alert", "banner", "popup", "modal", "gdpr", "cookie-banner", "overlay", "paywall"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adbox", "ad-slot"),
    "form": ("form", "search", "login", "signup", "newsletter", "subscribe", "contact"),
    "comments": ("comments", "comment", "comment-list", "discussion", "replies", "disqus", "reply", "reader-comments", "respond"),
    "share": ("share", "social", "sharing", "tags", "byline-tools", "meta", "author-box"),
}
_OTHER_TAGS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "notice": ("div", "section", "aside"), "ad": ("div", "aside", "section"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "share": ("div", "ul")}


def training_page(r: random.Random) -> tuple[str, str]:
    """A page and its main text, both made up: words that end in "Q" are main text."""

    def words(n: int, mark: str) -> str:
        out = []
        for i in range(n):
            w = "".join(r.choice("aeioulnrst") for _ in range(r.choice((0, 1, 2, r.randint(1, 8), r.randint(1, 8))) if mark else r.randint(1, 9))) + mark
            out.append((w[:1].upper() + w[1:] if i == 0 else w) + ("." if i == n - 1 or r.random() < 0.09 else "," if r.random() < 0.07 else ""))
        return " ".join(out)

    def attr(names: tuple[str, ...], p: float) -> str:
        if r.random() > p:
            return ""
        return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}{r.choice(("", "", " x", "-1", " wide"))}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(r.randint(1, 4), "")}</a></li>' for i in range(n))

    def inline(s: str) -> str:
        parts = s.split(" ")
        for _ in range(r.choice((0, 0, 1, 2))):
            i = r.randrange(len(parts))
            t = r.choice(("b", "i", "em", "strong", "a", "span", "code"))
            parts[i] = f"<{t}{' href=x' if t == 'a' else ''}>{parts[i]}" + (f"</{t}>" if r.random() < 0.85 else "")
        return " ".join(parts)

    def other(kind: str) -> str:
        t = r.choice(_OTHER_TAGS[kind])
        named = 1.0 if t in ("div", "section", "ul", "ol") else 0.5
        open_, end = f"<{t}{attr(OTHER_NAMES[kind], named)}>", f"</{t}>"
        if kind in ("nav", "share") or kind in ("aside", "footer", "header") and r.random() < 0.4:
            inner = links(r.randint(1, 9))
            inner = inner if t in ("ul", "ol") else f"<ul>{inner}</ul>"
            if kind == "aside":
                inner = f"<h3>{words(2, '')}</h3>" + inner
        elif kind == "form":
            inner = f"<label>{words(r.randint(1, 4), '')}</label><input name=q><button>{words(1, '')}</button>" + (f"<p>{words(r.randint(4, 25), '')}</p>" if r.random() < 0.4 else "")
        elif kind == "comments":
            inner = f"<h3>{words(2, '')}</h3>" + "".join(f"<{'li' if t == 'ol' else 'div'}{attr(OTHER_NAMES['comments'], 0.5)}><p>{inline(words(r.randint(3, 60), ''))}</p></{'li' if t == 'ol' else 'div'}>" for _ in range(r.randint(1, 6)))
        else:
            long = r.randint(1, 40)
            inner = words(long, "") if r.random() < 0.6 else f"<p>{words(long, '')}</p>"
        return open_ + inner + (end if r.random() < 0.97 else "")

    def main() -> str:
        out = [f"<h1>{words(r.randint(1, 12), 'Q')}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((r.randint(1, 9), r.randint(1, 9), r.randint(10, 40)))):
            k = r.random()
            size = r.choice((1, r.randint(1, 4), r.randint(1, 90), r.randint(1, 90), r.randint(5, 150)))
            if k < 0.75:
                out.append(f"<p>{inline(words(size, 'Q'))}" + ("</p>" if r.random() < 0.85 else r.choice(("", "<br>"))))
            elif k < 0.82:
                out.append(f"<h2>{words(r.randint(1, 6), 'Q')}</h2>")
            elif k < 0.88:
                out.append("<ul>" + "".join(f"<li>{inline(words(r.randint(2, 20), 'Q'))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.92:
                out.append(f"<blockquote><p>{words(size, 'Q')}</p></blockquote>")
            elif k < 0.95:
                out.append(f"<table><tr><td>{words(3, 'Q')}</td><td>{words(5, 'Q')}</td></tr></table>")
            elif k < 0.97:
                out.append(f"<div>{words(size, 'Q')}</div>")
            else:
                out.append(f"<pre>{words(8, 'Q')}</pre>")
            if r.random() < 0.08:
                out.append(other(r.choice(("ad", "share", "aside", "notice", "form"))))
        return "".join(out)

    if r.random() < 0.03:
        return (p := r.choice(("", "<p>")) + words(r.randint(5, 80), "Q")), p
    kinds = list(OTHER_NAMES)
    top = [k for k in ("header", "notice", "nav", "ad") if r.random() < 0.55]
    tail = [k for k in ("share", "comments", "aside", "form", "ad", "footer") if r.random() < 0.5]
    r.shuffle(top)
    shell = r.choice(("article", "article", "main", "div", "div", "section"))
    core = f"<{shell}{attr(MAIN_NAMES, 1.0 if shell in ('div', 'section') else 0.4)}>" + main()
    if r.random() < 0.15:
        core += other(r.choice(("comments", "share", "footer", "aside")))
    core += f"</{shell}>" if r.random() < 0.95 else ""
    if r.random() < 0.4:
        extra = [other(r.choice(kinds)) for _ in range(r.randint(0, 2))]
        core = f"<div{attr(('wrapper', 'container', 'page', 'layout', 'row', 'root'), 0.8)}>" + "".join([*extra[:1], core, *extra[1:]]) + "</div>"
        if r.random() < 0.3:
            core = f"<main>{core}</main>"
    page = "<!DOCTYPE html><html><head><title>" + words(5, "") + "</title><style>p{}</style><script>var t='<p>';</script></head><body>"
    page += "".join(map(other, top)) + core + "".join(map(other, tail)) + ("</body></html>" if r.random() < 0.9 else "")
    return page, ""


def labels(nodes: Nodes) -> np.ndarray:
    """1 for nodes of training pages that hold main text."""
    mark = np.array([t is not None and bool(re.search(r"Q\b", "".join(t))) for t in nodes.text])
    total = np.concatenate([[0], np.cumsum(mark)])
    return (total[np.array(nodes.end)] - total[np.arange(len(mark))] > 0).astype(float)


def fit(p: Params = Params()) -> Model:
    r = random.Random(p.seed)
    nodes = Nodes()
    for _ in range(p.pages):
        parse(training_page(r)[0], nodes)
    y = labels(nodes)

    def log_odds(groups: list[list[str]]) -> dict[str, float]:
        """Of names: how much likelier main text is in nodes with them, smoothed towards 0."""
        good: dict[str, float] = {}
        seen: dict[str, int] = {}
        for names, v in zip(groups, y, strict=True):
            for x in set(names):
                seen[x] = seen.get(x, 0) + 1
                good[x] = good.get(x, 0) + v
        return {x: math.log((good[x] + 0.5) / (n - good[x] + 0.5)) for x, n in seen.items() if n >= 5}

    model = Model(log_odds([[t] for t in nodes.tag]), log_odds([attribute_tokens(a) if a else [] for a in nodes.attrs]), 0.0, [])
    boost(model, features(nodes, model), y, p)
    return model


def boost(model: Model, x: np.ndarray, y: np.ndarray, p: Params) -> None:
    """Fits ``p.trees`` trees to the logistic loss, by histograms of ``p.bins`` quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model.base = math.log(mean / (1 - mean))
    odds = np.full(len(y), model.base)
    inner = 2**p.depth - 1
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-odds))
        g, h = y - prob, prob * (1 - prob)
        feature, edge = np.zeros(inner, np.int64), np.full(inner, np.inf)
        k = np.zeros(len(y), np.int64)
        for level in range(p.depth):
            base, width = 2**level - 1, 2**level
            at = k - base
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = at * p.bins + binned[:, j]
                sg = np.bincount(key, g, width * p.bins).reshape(width, -1).cumsum(1)
                sh = np.bincount(key, h, width * p.bins).reshape(width, -1).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                gain[(sh < 1) | (th - sh < 1)] = 0
                cut = gain[:, : len(e)].argmax(1)
                top = gain[np.arange(width), cut]
                win = top > best
                best[win], feature[base : base + width][win], edge[base : base + width][win] = top[win], j, e[cut[win]]
            k = 2 * k + 1 + (x[np.arange(len(y)), feature[k]] > edge[k])
        at = k - inner
        value = p.rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        odds += value[at]
        model.trees.append((feature, edge, value))


_fitted: dict[Params, Model] = {}


def fitted(p: Params = Params()) -> Model:
    """The model of a set of parameters; fitted once in a process, the same everywhere."""
    if p not in _fitted:
        _fitted[p] = fit(p)
    return _fitted[p]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", p: Params = Params()) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = fitted(p)
    three = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "html", 1 << 20):
                text = extract(c.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([c.column("page_id"), c.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return three.mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
