"""Main text of HTML pages as a maximum-scoring contiguous region.

A page becomes a sequence of words and tags. Words score positive, the more the surer their
place is one of content: a place is described by the elements that are open there, by name,
by name within the next one, and by the words of their class, id and role, and by links and headings being such elements. Tags
score negative, the more the rarer a tag of that name and class stands inside of content.
One linear scan finds the contiguous region of the best sum. Of the region those
words are kept whose place is more likely content than not.

All weights are log odds fitted on labelled pages: pages of the input that mark their
content with one <article> element (the first SAMPLE by id, a bounded sample), and pages of
made-up layouts whose content is known, which hold what the input's pages don't show.
There are no lists of names of what is content and what is not.

A region becomes text so: character references are decoded, white space inside a block
becomes one space, blocks are trimmed, empty ones dropped, and the rest joined by two
line feeds in page order.

Defined results: a null or empty page and a page without words give an empty text;
unclosed, crossing and unknown tags are taken as they come, an end tag closing what is
open inside its element; pages of any length and depth are read whole in one pass; of equally
good regions the first and longest is taken; an empty table gives an empty result; labelled
pages without an id count last. Columns other than those named are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_texts
from .common import table

#: Labelled pages that are taken from the input at most, and made-up ones.
SAMPLE, LAYOUTS = 200, 300

# HTML's element names by their role in a page.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "xmp")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCK = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul", "head", "title", "button", "select", "option", "optgroup", "iframe", "noscript", "script", "style", "template", "caption",
)

_RAW, _VOID, _BLOCK = map(frozenset, (RAW, VOID, BLOCK))
_TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*>?|/?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>?)", re.DOTALL)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
# An end tag may close these together, and a new one of a kind closes the one before.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset({"ul", "ol", "dl", "table", "select", "article", "section", "div", "main", "body", "html", "nav", "aside", "footer", "header", "form", "blockquote"})


class Node:
    """An open element: its name, its own features, and the features of all that is open there."""

    __slots__ = ("name", "own", "features", "score")

    def __init__(self, name: str, own: tuple[str, ...], features: frozenset[str]):
        self.name, self.own, self.features, self.score = name, own, features, None


_ROOT = Node("", (), frozenset())


@lru_cache(maxsize=50_000)
def _own_features(name: str, tag: str, parent: str) -> tuple[str, ...]:
    words: set[str] = set()
    if name not in ("html", "body"):  # what these are called tells of the page, not of a place in it
        for m in _ATTRIBUTE.finditer(tag) if "=" in tag else ():
            words.update(w.lower() for w in _SPLIT.split(m[2] or m[3] or m[4] or "") if len(w) > 1)
    return (f"<{name}>", f"<{parent}><{name}>", *sorted(words))


def _open(name: str, tag: str, parent: Node) -> Node:
    own = _own_features(name, tag, parent.name)
    return Node(name, own, parent.features if parent.features.issuperset(own) else parent.features.union(own))


def items(page: str):
    """('text', raw text, node, 0), ('tag', name, node that opens or closes, 1 if it opens, else -1) in page order."""
    stack, at, end = [_ROOT], 0, len(page)
    held: dict[str, int] = {}  # open elements by name: the stack is only searched for what it holds

    def cut(k: int) -> None:
        for node in stack[k:]:
            held[node.name] -= 1
        del stack[k:]

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            yield "text", page[at:], stack[-1], 0
            return
        if m.start() > at:
            yield "text", page[at : m.start()], stack[-1], 0
        tag, at = m[0], m.end()
        name = _NAME.match(tag)
        if name is None:
            continue
        name, closing = name[1].lower(), tag[1] == "/"
        if not closing:
            if name in _CLOSES and any(held.get(x) for x in _CLOSES[name]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in _CLOSES[name]:
                        cut(k)
                        break
                    if stack[k].name in _SCOPES:
                        break
            elif name not in _CLOSES and name in _BLOCK and held.get("p"):  # a block ends an open paragraph
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        cut(k)
                        break
                    if stack[k].name in _SCOPES:
                        break
            node = _open(name, tag, stack[-1])
            yield "tag", name, node, 1
            if name in _VOID or tag.endswith("/>") and name in ("svg", "math"):
                continue
            if name in _RAW:  # its text ends at its end tag, whatever stands between
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = close.start() if close else end
                continue
            stack.append(node)
            held[name] = held.get(name, 0) + 1
        else:
            closed = stack[-1]
            for k in range(len(stack) - 1, 0, -1) if held.get(name) else ():
                if stack[k].name == name:
                    closed = stack[k]
                    cut(k)
                    break
            yield "tag", name, closed, -1


def made_up_pages(n: int = LAYOUTS, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """(page, stretches of it that are content) of random layouts of known content."""
    r = random.Random(seed)
    words = lambda a, b: " ".join("".join(r.choice(["an", "er", "in", "on", "th", "re", "st", "ou", "el", "la", "de", "ka"]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(a, b)))
    plain = ["row", "col", "container", "wrapper", "inner", "outer", "box", "block", "item", "left", "right", "top", "clearfix", "large", "small", "dark", "first", "last", "area", "group", "results", "work", "list"]

    def named(name: str, inside: bool = False) -> str:
        """An attribute whose value holds a name, alone or joined to others."""
        if r.random() < 0.35:
            name = (r.choice(["article", "post", "content", "entry", "story", "main"]) if inside or r.random() < 0.5 else r.choice(["site", "page", "global", "top"])) + r.choice(["-", "_"]) + name
        elif r.random() < 0.3:
            name = name + r.choice(["-", "_"]) + r.choice(["links", "box", "list", "area", "wrapper", "inner", "section", "posts", "bar", "container"])
        value = name if r.random() < 0.6 else f"{name} {r.choice(plain)}"
        return r.choice(["class", "class", "id"]) + f'="{value}"'

    link = lambda: f"<a href='/{words(1, 1)}'>{words(1, 3)}</a>"
    listed = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"
    said = lambda: f"<div {named('comment')}><p>{words(4, 30)}</p></div>"
    # What is no content, by the elements and names that pages use for it.
    other = {
        "menu": (["nav", "div", "menu"], ["menu", "nav", "navigation", "navbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip"], lambda: r.choice([listed(), link() + " | " + link()])),
        "top": (["header", "div"], ["header", "masthead", "topbar", "branding", "logo", "banner", "toolbar"], lambda: r.choice([f"<h1>{words(1, 3)}</h1>", f"<p>{words(2, 8)}</p>", link(), words(1, 6), f"<h2>{words(1, 3)}</h2>" + listed()])),
        "foot": (["footer", "div"], ["footer", "copyright", "colophon", "disclaimer", "legal", "contentinfo"], lambda: r.choice([words(3, 14), "&copy; " + words(3, 9), f"<p>{words(3, 14)}</p>", listed(), f"<p>&copy; {words(1, 4)} {link()}</p>"])),
        "side": (["aside", "div", "section"], ["sidebar", "widget", "aside", "complementary", "rail", "tagcloud", "tags"], lambda: r.choice([listed(), f"<p>{words(4, 20)}</p>", f"<h3>{words(1, 3)}</h3>" + listed(), words(3, 12)])),
        "notice": (["div", "div", "section", "dialog"], ["notice", "cookie", "cookies", "consent", "gdpr", "alert", "notification", "modal", "popup", "overlay", "warning", "message"], lambda: f"<p>{words(4, 18)}</p>" if r.random() < 0.5 else words(4, 18)),
        "advert": (["div", "aside", "section"], ["ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "promoted", "adsbox"], lambda: r.choice([words(4, 16), f"<p>{words(3, 14)}</p>", link()])),
        "form": (["form", "div"], ["search", "signup", "newsletter", "subscribe", "login", "feedback", "contact"], lambda: f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>" if r.random() < 0.7 else f"<p>{words(3, 10)}</p><input><button>{words(1, 1)}</button>"),
        "share": (["div", "ul", "aside"], ["share", "social", "sharing", "related", "recommended", "recommendations", "trending", "popular"], lambda: r.choice([listed(), link() + " " + link(), f"<p>{words(2, 8)}</p>", words(2, 6)])),
        "said": (["section", "div", "ol"], ["comments", "comment", "commentlist", "disqus", "discussion", "replies", "reply", "respond", "responses", "reactions"], lambda: "".join(r.choice([said, lambda: f"<p>{words(4, 30)}</p>", lambda: f"<article {named('comment')}><p>{words(4, 25)}</p></article>"])() for _ in range(r.randint(1, 4)))),
    }

    def aside(kind: str | None = None, inside: bool = False) -> str:
        kind = kind or r.choice(list(other))
        tags, names, fill = other[kind]
        tag = r.choice(tags)
        own = tag in ("nav", "menu", "header", "footer", "aside", "form", "dialog") and not (inside and tag in ("header", "footer"))
        attribute = "" if own and r.random() < 0.5 else " " + named(r.choice(names), inside)
        return f"<{tag}{attribute}>{fill()}</{tag}>"

    def paragraph() -> str:
        text = words(6, 60)
        if r.random() < 0.25:
            text = f"{text} {link()} {words(2, 20)}"
        if r.random() < 0.2:
            text = f"{text} <b>{words(1, 3)}</b> <em>{words(1, 3)}</em> {words(3, 9)}"
        x = r.random()
        wrap = "p" if x < 0.75 else "blockquote" if x < 0.8 else "div" if x < 0.86 else "pre" if x < 0.89 else "ul" if x < 0.95 else "table"
        if wrap == "ul":
            return "<ul>" + "".join(f"<li>{words(4, 20)}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
        if wrap == "table":
            return "<table>" + "".join(f"<tr><th>{words(1, 2)}</th><td>{words(1, 6)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
        return f"<{wrap}>{text}</{wrap}>" if r.random() < 0.85 else f"<section class='{r.choice(plain)}-{r.choice(['related', 'search', 'contact', 'tags', 'comment', 'notice', 'work'])}-{r.choice(plain)}'><p>{text}</p></section>" if r.random() < 0.3 else f"<div class='{r.choice(plain)}'><p>{text}</p></div>"

    pages = []
    for _ in range(n):
        roots = [("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<div class='%s'>" % r.choice(["content", "post-content", "entry", "entry-content", "article-body", "story", "post", "main", "text", "prose"]), "</div>"), ("<div id='content'><article class='post'>", "</article></div>"), ("<div>", "</div>"), ("", ""), ("<table><tr><td>", "</td></tr></table>")]
        opening, closing = r.choice(roots[:5] if r.random() < 0.75 else roots[5:])
        body, marks = [], []
        body += [f"<html><head><title>{words(2, 5)}</title></head><body>"]
        body += [aside(k) for k in ("top", "menu", None, None) if r.random() < 0.7]
        about = f"<div class='{r.choice(['page', 'layout', 'site', 'grid'])}-{r.choice(['with', 'has', 'no'])}-{r.choice(['sidebar', 'comments', 'menu', 'header', 'footer', 'ads'])}'>"
        shell = r.choice(["", "<div class='%s'>" % r.choice(plain), "<div id=page><div class='%s'>" % r.choice(plain), about])
        body += [shell, opening]
        at = sum(map(len, body))

        def content(x: str) -> None:
            nonlocal at
            marks.append((at, at + len(x)))
            body.append(x)
            at += len(x)

        def no_content(x: str) -> None:
            nonlocal at
            body.append(x)
            at += len(x)

        if r.random() < 0.8:
            content(f"<h1>{words(2, 8)}</h1>" if r.random() < 0.6 or not opening else f"<header><h1>{words(2, 8)}</h1></header>")
        for _ in range(r.randint(2, 9)):
            content(paragraph() if r.random() < 0.92 else f"<h2>{words(1, 5)}</h2>")
            if opening and r.random() < 0.15:
                no_content(aside(inside=True))
        if opening and r.random() < 0.3:
            no_content(aside("said", inside=True))
        body += [closing, "</div>" * shell.count("<div")]
        body += [aside(k) for k in ("said", None, "foot") if r.random() < 0.6] + ["</body></html>"]
        pages.append(("".join(body), marks))
    return pages


def marked_page(page: str | None) -> tuple[str, list[tuple[int, int]]] | None:
    """A page with one <article> element, and the stretch inside of it."""
    found = [m for m in _TAG.finditer(page or "") if re.match(r"</?article[\s>]", m[0], re.IGNORECASE)]
    if len(found) != 2 or found[0][0][1] == "/" or found[1][0][1] != "/":
        return None
    return page, [(found[0].end(), found[1].start())]


class Weights:
    """Log odds of content for places, by what is open there, and for tags."""

    def __init__(self, pages: list[tuple[str, list[tuple[int, int]]]]):
        places: dict[frozenset, list[float]] = {}
        tags: dict[str, list[float]] = {}
        for page, marks in pages:
            at = 0
            for kind, value, node, way in items(page):
                if kind == "text":
                    at = page.index(value, at) + len(value)
                    inside = any(a < at <= b for a, b in marks)
                    places.setdefault(node.features, [0.0, 0.0])[inside] += min(20, len(value.split()))
                else:
                    at = (page.find("<", at) if way else at) + 1
                    inside = any(a < at <= b for a, b in marks)
                    for f in node.own:
                        tags.setdefault(f if way > 0 else "/" + f, [0.5, 0.5])[inside] += 1
        self.index = {f: k for k, f in enumerate(sorted(frozenset().union(*places)))} if places else {}
        self.bias, self.place = self._fit(places)
        #: An end tag and a tag of a class weigh what their rarest part weighs; all are negative.
        self.tags = {f: max(-1.2, min(-0.05, math.log(inside / outside) - 0.5)) for f, (outside, inside) in tags.items()}

    def _fit(self, places: dict[frozenset, list[float]], rounds: int = 25, penalty: float = 0.3) -> tuple[float, np.ndarray]:
        """Logistic regression by Newton's steps: the log odds of content are linear in the features."""
        k = len(self.index) + 1
        x, n, y = np.zeros((len(places), k)), np.zeros(len(places)), np.zeros(len(places))
        for row, (features, (outside, inside)) in enumerate(places.items()):
            x[row, [self.index[f] for f in features]] = 1
            n[row], y[row] = outside + inside, inside
        x[:, -1] = 1
        n, y = n / 10, y / 10  # the words of one element are no independent witnesses
        w = np.zeros(k)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (y - n * p) - penalty * w
            w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(k), grad)
        return float(w[-1]), w[:-1]

    def odds(self, node: Node) -> float:
        """Log odds that words right inside of node are content."""
        if node.score is None:
            node.score = self.bias + sum(float(self.place[self.index[f]]) for f in node.features if f in self.index)
        return node.score

    def word(self, node: Node) -> float:
        return min(5.0, max(0.02, self.odds(node)))

    def tag(self, node: Node, way: int) -> float:
        return min((self.tags.get(f if way > 0 else "/" + f, -0.5) for f in node.own if "><" not in f), default=-0.5)


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return Weights(made_up_pages())


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from made-up pages and from the first `sample` pages by id that hold an <article>, a documented bound."""
    rows = pages.filter(F.lower(html_col).contains("<article")).orderBy(F.col(id_col).asc_nulls_last(), html_col).limit(sample).select(html_col).collect()
    marked = [m for m in (marked_page(r[0]) for r in rows) if m]
    return Weights(made_up_pages() + marked)


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous stretch of the largest sum, by one linear scan; empty if no sum is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best or total == best and region[0] == start:
            best, region = total, (start, k + 1)
    return region


def extract(page: str | None, weights: Weights | None = None) -> str:
    weights = weights or default_weights()
    seq = list(items(page or ""))
    scores = [len(value.split()) * weights.word(node) if kind == "text" else weights.tag(node, way) for kind, value, node, way in seq]
    start, end = best_region(scores)
    blocks, now = [], []

    def flush():
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    for kind, value, node, _ in seq[start:end]:
        if kind == "tag":
            if value in _BLOCK:
                flush()
            elif value == "br":
                now.append(" ")
        elif weights.odds(node) > 0:
            now.append(html.unescape(value))
    flush()
    return "\n\n".join(blocks)


def extract_main(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """Per row of pages: id_col, text and n_chars; weights as fitted by fit_weights, else those of made-up pages alone."""
    held = pages.sparkSession.sparkContext.broadcast(weights or default_weights())

    def make():
        own = held.value

        def each(texts):
            out = [extract(t, own) for t in texts]
            return {"text": out, "n_chars": list(map(len, out))}

        return each

    return map_texts(pages, id_col, html_col, make, [("text", T.StringType()), ("n_chars", T.LongType())])


def op2_html_main(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    key = pages.select(F.struct("page_id", "url").alias("key"), "html")
    return extract_main(key, "key", "html", fit_weights(pages)).select("key.page_id", "key.url", "text", "n_chars")
