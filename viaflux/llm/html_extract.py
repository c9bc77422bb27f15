"""Main text of HTML pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree, each either content or
boilerplate. Unary potentials come from the element and its text, potentials of
a parent and child say how likely both are alike. Sum-product messages go up
and down the tree and give each node's content marginal; blocks of nodes of 0.5
or more are the text. Weights are trained by the exact gradient of the
likelihood of labelled pages (`labelled_pages` makes them). Messages run by
depth over all pages of a slice at once.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import textkit as tk

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
#: Elements whose content isn't text of the page, whatever the model says.
HIDDEN = frozenset("head title template svg math canvas object audio video noscript select option optgroup datalist textarea button map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture output meter progress".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: An opening tag closes the nearest of these, unless one of the limits stands between.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"})}

#: Where markup may begin, or a page is cut off as it does; any other "<" is text.
_MARKUP = re.compile(r"<(?=[a-zA-Z!?/]|\Z)")
#: A tag's name and attributes by the states of the HTML standard: names run to white space, /, > or =, a quoted value to its quote
#: wherever that is, another to white space or >. A tag without its end doesn't match.
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>))|(?!\s*+=)))*+)>"
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-label|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Groups of what elements are, for unary and pair weights.
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "list", "li", "table", "cell", "quote", "pre", "figure", "nav", "header", "footer", "aside", "form", "body", "address", "other"]
_TAG_OF = {t: t for t in TAGS} | {"ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "tr": "table", "tbody": "table", "thead": "table", "tfoot": "table", "td": "cell", "th": "cell", "blockquote": "quote", "figcaption": "figure", "h4": "h3", "h5": "h3", "h6": "h3", "fieldset": "form", "legend": "form", "html": "body", "dialog": "aside", "search": "form"}
_TAG_NO = {t: TAGS.index(g) for t, g in _TAG_OF.items()}
#: Words in class, id and role that tell of a kind of element.
NAMES = {
    "content": r"article|content|main|post|entry|story|body|text|prose|markdown",
    "menu": r"nav|menu|breadcrumb|pagination|pager|toc\b|tabs|skip",
    "header": r"header|masthead|topbar|banner|logo|branding|site-?title",
    "footer": r"footer|copyright|legal|colophon|bottom",
    "side": r"side|aside|widget|related|recommend|trending|popular|more-|promo|teaser|rail",
    "advert": r"\bads?\b|advert|sponsor|\bad[-_]|[-_]ad\b|adslot|adsbygoogle|doubleclick|dfp",
    "notice": r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri|paywall|toast|message",
    "comment": r"comment|reply|replies|discussion|disqus|respond|review",
    "form": r"form|search|login|signup|contact|input|dialog",
    "share": r"share|social|follow|tags|meta|byline|author|date|rating|toolbar|print",
    "hidden": r"display:\s*none|visibility:\s*hidden",
}
_NAME_RES = [re.compile(p) for p in NAMES.values()]
NUMBERS = ["bias", "link_share", "no_text", "own_share"]
TEXTUAL = ("p", "h1", "h2", "h3", "list", "li", "table", "cell", "quote", "pre", "figure")
WIDTH = len(TAGS) + len(NAMES) + len(NUMBERS)
#: Pair weights depend on the child's group.
PAIRS = len(TAGS)


@lru_cache(200_000)
def _name_features(names: str) -> tuple[int, ...]:
    return tuple(k for k, r in enumerate(_NAME_RES) if r.search(names))


#: Ends of a comment: the standard also takes <!--> and <!---> as whole ones.
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
_GREATER = re.compile(">")


@lru_cache(32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I)


class Page:
    """The block tree of one page: parents, groups, names, and its text blocks in order."""

    def __init__(self, source: str):
        self.parent, self.group, self.names, self.blocks = [0], [_TAG_NO["body"]], [""], []
        self.depth = [0]
        open_tags: Counter = Counter()
        self.linked = [0]
        self.labels: list[int] = [0]
        parts: list[str] = []
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the node each stands in
        node, in_link, hidden = 0, 0, 0

        def flush():
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((node, text))
                parts.clear()

        def pop_to(k: int):
            nonlocal node, in_link, hidden
            for tag, _ in stack[k:]:
                in_link -= tag == "a"
                hidden -= tag in HIDDEN
                open_tags[tag] -= 1
            if any(tag not in INLINE for tag, _ in stack[k:]):
                flush()
            del stack[k:]
            node = stack[-1][1]

        at, end = 0, len(source)
        while at < end:
            m = _MARKUP.search(source, at)
            stop = m.start() if m else end
            if stop > at and not hidden:
                piece = source[at:stop]
                if "&" in piece:
                    piece = _html.unescape(piece)
                parts.append(piece)
                if in_link:
                    self.linked[node] += len(piece.split())
            if m is None:
                break
            tag_at = _TAG.match(source, stop)
            if tag_at is None:
                after = source[stop + 1 : stop + 4]
                if after.startswith("!--"):  # a comment; the shortest are <!--> and <!--->
                    close = _COMMENT_END.search(source, stop + 4)
                elif after[:1] in ("!", "?") or after[:1] == "/" and not after[1:2].isalpha():
                    close = _GREATER.search(source, stop)
                else:
                    close = None  # the page ends within a tag
                if close is None:
                    break
                at = close.end()
                continue
            at = tag_at.end()
            tag = tag_at[2].lower()
            if tag_at[1]:
                if open_tags[tag] > 0:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            pop_to(k)
                            break
                        if stack[k][0] in ("td", "th", "table") and tag in ("p", "div", "li", "b", "i", "a", "span"):
                            break
                continue
            if tag in RAW:
                close = _raw_end(tag).search(source, at)
                at = close.end() if close else end
                continue
            if tag == "br" or tag == "hr":
                if tag == "hr":
                    flush()
                else:
                    parts.append(" ")
                continue
            if tag in VOID:
                continue
            if tag in CLOSES_P and open_tags["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            if tag in IMPLIED:
                closed, limits = IMPLIED[tag]
                for k in range(0) if not any(open_tags[x] > 0 for x in closed) else range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closed:
                        pop_to(k)
                        break
                    if stack[k][0] in limits:
                        break
            if tag in ("html", "body"):
                continue
            if tag == "a" and in_link:  # links don't nest
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "a":
                        pop_to(k)
                        break
            open_tags[tag] += 1
            if tag in INLINE:
                stack.append((tag, node))
                in_link += tag == "a"
                continue
            flush()
            hidden += tag in HIDDEN
            rest = tag_at[3]
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.group.append(_TAG_NO.get(tag, len(TAGS) - 1))
            self.names.append(" ".join(x for a in _ATTRIBUTE.findall(rest) for x in a[1:] if x).lower() if rest and "=" in rest else "")
            self.linked.append(0)
            self.labels.append(1 if 'data-y="1"' in rest else 0)
            node = len(self.parent) - 1
            stack.append((tag, node))
        flush()


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, parents, depths and groups of the nodes of many pages; roots are their own parents."""
    sizes = np.array([len(p.parent) for p in pages])
    base = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, base, strict=True)])
    group = np.concatenate([np.array(p.group) for p in pages])
    linked = np.concatenate([np.array(p.linked, float) for p in pages])
    words = np.zeros(n)
    total = np.zeros(len(pages))
    for k, page in enumerate(pages):
        seen = 0
        for node, text in page.blocks:
            count = text.count(" ") + 1
            at = base[k] + node
            words[at] += count
            seen += count
        total[k] = seen
    depth = np.concatenate([np.array(p.depth) for p in pages])
    sub_words, sub_linked = words.copy(), linked.copy()
    for at in levels_of(depth)[:0:-1]:
        np.add.at(sub_words, parent[at], sub_words[at])
        np.add.at(sub_linked, parent[at], sub_linked[at])
    page_no = np.repeat(np.arange(len(pages)), sizes)
    x = np.zeros((n, WIDTH), np.float32)
    x[np.arange(n), group] = 1
    for k, page in enumerate(pages):
        for i, names in enumerate(page.names):
            if names:
                for f in _name_features(names):
                    x[base[k] + i, len(TAGS) + f] = 1
    share = np.minimum(sub_linked / np.maximum(sub_words, 1), 1)
    columns = [np.ones(n), share, sub_words == 0, sub_words / np.maximum(total[page_no], 1)]
    for k, c in enumerate(columns):
        x[:, len(TAGS) + len(NAMES) + k] = c
    # a paragraph, heading or row inside another element tells nothing by its mere kind, however many there are
    nested = (depth >= 2) & np.isin(group, [TAGS.index(t) for t in TEXTUAL])
    x[np.ix_(nested, [*range(len(TAGS)), *[len(TAGS) + len(NAMES) + NUMBERS.index(k) for k in ("bias", "no_text")]])] = 0
    return x, parent, depth, group


def levels_of(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, ascending."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def messages(unary: np.ndarray, pair: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Node marginals (n, 2), pair marginals (n, 2 parent, 2 child) and the log partition, by sum-product on trees.

    `unary` (n, 2) and `pair` (n, 2, 2) are log potentials; pairs of roots are
    not used. Messages of one depth are computed at once, over all trees.
    """
    n = len(parent)
    up = unary.astype(float)
    to_parent = np.zeros((n, 2))
    levels = levels_of(depth)
    for at in levels[:0:-1]:
        joint = pair[at] + up[at][:, None, :]
        to_parent[at] = _lse(joint[:, :, 0], joint[:, :, 1])
        np.add.at(up, parent[at], to_parent[at])
    roots = levels[0]
    z = float(_lse(up[roots, 0], up[roots, 1]).sum())
    belief = up.copy()
    pairs = np.zeros((n, 2, 2))
    for at in levels[1:]:
        outside = belief[parent[at]] - to_parent[at]
        joint = outside[:, :, None] + pair[at] + up[at][:, None, :]
        belief[at] = _lse(joint[:, 0], joint[:, 1])
        joint -= _lse(belief[at][:, 0], belief[at][:, 1])[:, None, None]
        pairs[at] = np.exp(joint)
    marginal = np.exp(belief - _lse(belief[:, 0], belief[:, 1])[:, None])
    return marginal, pairs, z


def potentials(weights: dict, x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unary = np.zeros((len(x), 2))
    unary[:, 1] = x @ weights["unary"]
    return unary, weights["pair"][group]


def train(sources: list[str], rounds: int = 400, rate: float = 0.15, decay: float = 2e-4) -> dict:
    """Weights from pages whose content elements carry data-y="1", by exact likelihood gradients."""
    pages = [Page(s) for s in sources]
    x, parent, depth, group = features(pages)
    y = np.concatenate([np.array(p.labels) for p in pages])
    n = len(y)
    weights = {"unary": np.zeros(WIDTH), "pair": np.zeros((PAIRS, 2, 2))}
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in weights.items()}
    inner = np.flatnonzero(depth > 0)
    plain = [TAGS.index(t) for t in TEXTUAL]
    seen = np.zeros((PAIRS, 2, 2))
    np.add.at(seen, (group[inner], y[parent[inner]], y[inner]), 1)
    for step in range(1, rounds + 1):
        unary, pair = potentials(weights, x, group)
        marginal, pairs, _ = messages(unary, pair, parent, depth)
        expected = np.zeros((PAIRS, 2, 2))
        np.add.at(expected, group[inner], pairs[inner])
        grads = {"unary": x.T @ (marginal[:, 1] - y) / n, "pair": (expected - seen) / n}
        # both ways of agreeing weigh the same, so that the number of children alone says nothing
        agree = grads["pair"][:, [0, 1], [0, 1]].mean(1)
        grads["pair"][:, 0, 0] = grads["pair"][:, 1, 1] = agree
        # likewise both ways of differing for a paragraph or row, of which a page may have any number
        differ = grads["pair"][plain][:, [0, 1], [1, 0]].mean(1)
        grads["pair"][plain, 0, 1] = grads["pair"][plain, 1, 0] = differ
        for k, g in grads.items():
            g = g + decay / 10 * weights[k]
            m, v = moment[k]
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def labelled_pages(count: int = 300, seed: int = 7) -> list[str]:
    """Made pages of many layouts; elements of the article carry data-y="1"."""
    r = random.Random(seed)
    syllables = "the er an in on re th of ed ing ou is ha le de la que en ión os ar sch ein ung au eau tre".split()

    def word():
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(a, b):
        return " ".join(word() for _ in range(r.randint(a, b)))

    style = ["plain"]

    def sentence(a=3, b=20):
        if style[0] == "bars":
            return " | ".join(word() for _ in range(r.randint(a, b))) + " |"
        if style[0] == "bare":
            return words(a, b)
        if style[0] == "upper":
            return " ".join(w.upper() + "!!" for w in words(a, b).split(" "))
        if style[0] == "repeat":
            return " ".join([word().capitalize()] * r.randint(a, b))
        if style[0] == "short":
            return word().capitalize() + r.choice([".", "", " " + word() + "."])
        return words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?", ", " + words(2, 8) + "."])

    def prose(a=1, b=7):
        text = " ".join(sentence() for _ in range(r.randint(a, b)))
        if r.random() < 0.25:
            cut = text.split(" ")
            k = r.randrange(len(cut))
            cut[k] = f'<{r.choice(["b", "i", "em", "strong"])}>{cut[k]}</b>' if r.random() < 0.5 else f'<a href="/x">{cut[k]}</a>'
            text = " ".join(cut)
        if r.random() < 0.1:
            text = " ".join(w + r.choice(["", "&amp;&amp;", "###", "%%%", "***"]) for w in text.split(" "))
        return text

    def attr(*names):
        return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if names else ""

    def links(a=3, b=9):
        rows = "".join(f"<li><a href='/{word()}'>{words(1, 3)}</a></li>" for _ in range(r.randint(a, b)))
        return f"<ul>{rows}</ul>" if r.random() < 0.7 else "".join(f"<a href='/{word()}'>{words(1, 2)}</a> " for _ in range(r.randint(a, b)))

    def box(tag, names, inner):
        """An element by its own tag or as a named div."""
        kind = r.random()
        if kind < 0.4:
            return f"<{tag}>{inner}</{tag}>"
        if kind < 0.6:
            return f"<{tag}{attr(*names)}>{inner}</{tag}>"
        return f"<div{attr(*names)}>{inner}</div>"

    def menu():
        return box("nav", ["nav", "menu", "main-nav", "navbar", "breadcrumbs", "topmenu"], links())

    def header():
        inner = r.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f"<div>{words(1, 4)}</div>", f'<a href="/">{words(1, 3)}</a>']) + r.choice(["", "", menu()])
        return box("header", ["header", "site-header", "masthead", "page-header", "banner"], inner)

    def footer():
        inner = r.choice([f"&copy; {words(2, 5)} &middot; {sentence()}", f"<p>&copy; {word()}. {sentence()}</p>", f"<p>{prose(1, 2)}</p>{links(2, 5)}"])
        return box("footer", ["footer", "site-footer", "copyright", "page-footer"], inner)

    def side():
        return box("aside", ["sidebar", "side", "related", "widget", "right-rail", "recommended"], r.choice([f"<h3>{words(1, 4)}</h3>" + links(), f"<p>{prose(1, 3)}</p>", f"<h2>{words(1, 3)}</h2><p>{prose(1, 2)}</p>" + links()]))

    def advert():
        return f'<div{attr("ad", "ads", "advert", "advertisement", "sponsored", "ad-slot", "banner-ad", "promo")}>{r.choice([sentence(), prose(1, 3), "<p>" + prose(1, 2) + "</p>", "<a href=x>" + words(3, 9) + "</a>"])}</div>'

    def notice():
        return f'<{(t := r.choice(["div", "section", "aside", "div"]))}{attr("cookie-notice", "cookie-banner", "consent", "notice", "alert", "newsletter", "popup", "gdpr", "subscribe")}>{r.choice(["<p>" + prose(1, 3) + "</p>", sentence()])}<button>{word()}</button></{t}>'

    def form():
        return r.choice([f'<form action="/s"><label>{words(1, 3)}</label><input name=q><button>{word()}</button></form>', f"<form><p>{words(2, 6)}</p><input><textarea>{word()}</textarea><p>{sentence()}</p></form>", f'<div class="search-form"><form><input>{words(1, 3)}</form></div>'])

    def comments():
        one = r.choice(['<div class="comment"><p>{}</p></div>', '<li class="comment"><b>{}</b> {}</li>', '<article class="comment"><p>{}</p></article>', "<p>{}</p>", '<div class="reply"><span>{}</span><p>{}</p></div>', "<li><p>{}</p></li>"])
        rows = "".join(one.format(*(prose(1, 4) for _ in range(one.count("{}")))) for _ in range(r.randint(1, 6)))
        if one.startswith("<li"):
            rows = f"<{(t := r.choice(['ul', 'ol']))}>{rows}</{t}>"
        head = r.choice(["", f"<h2>{words(1, 3)}</h2>", f"<h3>{words(1, 3)}</h3>"])
        return f'<{(t := r.choice(["section", "div", "div", "aside"]))}{attr("comments", "comment-list", "discussion", "reader-comments", "replies", "comments-area")}>{head}{rows}{r.choice(["", form()])}</{t}>'

    def share():
        return f'<div{attr("share", "social", "tags", "share-buttons")}>{links(2, 4)}</div>'

    def article():
        y = ' data-y="1"'
        parts = [f"<{(h := r.choice(['h1', 'h1', 'h2']))}{y}>{words(2, 12)}</{h}>"] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 15, 30, 50, 80])):
            kind = r.random()
            if kind < 0.62:
                parts.append(f"<p{y}>{prose()}</p>")
            elif kind < 0.67:
                parts.append(f"<p{y}><b>{sentence()}<br>")
            elif kind < 0.72:
                parts.append(f"<p{y}>{words(1, 3).capitalize()}.</p>")
            elif kind < 0.78:
                parts.append(f"<{(h := r.choice(['h2', 'h3', 'h4']))}{y}>{words(1, 7)}</{h}>")
            elif kind < 0.84:
                parts.append(f"<{(t := r.choice(['ul', 'ol']))}{y}>" + "".join(f"<li{y}>{prose(1, 2)}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>")
            elif kind < 0.88:
                parts.append(f"<blockquote{y}>{prose(1, 3)}</blockquote>" if r.random() < 0.5 else f"<blockquote{y}><p{y}>{prose(1, 3)}</p></blockquote>")
            elif kind < 0.91:
                parts.append(f"<pre{y}><code>{words(3, 30)}</code></pre>")
            elif kind < 0.94:
                parts.append(f"<table{y}>" + "".join(f"<tr{y}>" + "".join(f"<td{y}>{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.97:
                parts.append(f"<figure{y}><img src=x><figcaption{y}>{words(2, 12)}</figcaption></figure>")
            else:
                parts.append(f"<div{y}>{prose(1, 5)}</div>")
            if r.random() < 0.06:
                parts.append(r.choice([advert, share, notice, side, form])())
        if r.random() < 0.2:
            parts.append(r.choice([comments, comments, share, form, notice])())
        inner = "".join(parts)
        if r.random() < 0.2:
            inner = f'<div{y}{attr("body", "article-body", "entry-content", "text")}>{inner}</div>'
        kind = r.random()
        if kind < 0.6:
            out = f"<article{y}>{inner}</article>"
        elif kind < 0.75:
            out = f"<main{y}>{inner}</main>"
        elif kind < 0.95:
            out = f'<{(t := r.choice(["div", "div", "section"]))}{y}{attr("content", "article", "post", "main", "main-content", "story", "entry")}>{inner}</{t}>'
        else:
            out = f"<div{y}>{inner}</div>"
        return f"<main{y}>{out}</main>" if r.random() < 0.2 else out

    pages = []
    for _ in range(count):
        style[0] = r.choice(["plain", "plain", "plain", "bars", "bare", "upper", "repeat", "short"])
        top = [f() for f in (header, menu, advert, notice, form) if r.random() < (0.6 if f in (header, menu) else 0.3)]
        bottom = [f() for f in (comments, side, share, advert, form, notice) if r.random() < 0.35]
        r.shuffle(top)
        tail = [footer()] if r.random() < 0.8 else []
        core = article()
        if r.random() < 0.25:
            core = f'<div{attr("wrapper", "container", "page", "row", "layout")} data-y="1">{core}{"".join(bottom)}</div>'
            bottom = []
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{''.join(top)}{core}{''.join(bottom + tail)}</body></html>")
    return pages


@lru_cache(1)
def default_weights() -> dict:
    """Weights from the made pages."""
    return train(labelled_pages())


def extract(sources: list[str | None], weights: dict) -> list[str]:
    """Main texts of pages; null and empty ones give empty texts."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    x, parent, depth, group = features(pages)
    unary, pair = potentials(weights, x, group)
    marginal, _, _ = messages(unary, pair, parent, depth)
    out, at = [], 0
    for page in pages:
        out.append("\n".join(text for node, text in page.blocks if marginal[at + node, 1] >= 0.5))
        at += len(page.parent)
    return out


def extract_pages(pages: DataFrame, *, html: str = "html", weights: dict | None = None) -> DataFrame:
    """`pages` without the html, with text and n_chars (code points) of each row's main text.

    Null, empty and blank html and pages without content give an empty text.
    Markup is read by the states of the HTML standard: a tag that the page's end
    cuts off is dropped with what it holds, an unbalanced quote reaches to the
    next one, so no markup gets into a text. Repeated rows are repeated. An empty
    table gives an empty one. Input columns of the added names are replaced;
    others may have any name. A page is worked on as a whole, at any depth.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or default_weights())
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in tk.slices(batches, html, 1 << 20):
            texts = extract(batch.column(batch.schema.get_field_index(html)).to_pylist(), shared.value)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*[f"`{c}`" for c in kept], html).mapInArrow(run, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
