"""Main text of HTML pages by a tree-structured graphical model over the DOM.

The page is parsed to a tree of elements and text leaves. Every node has a hidden label, content or not, with
a potential from its own features (tag, class and id words, text length, link share, position) and, with its
parent, a potential by label pair and edge kind. Sum-product messages go up to the root and down again and
give each node's exact content marginal; text leaves of a half or more are kept. The weights are fitted by
exact maximum likelihood (observed less expected features, from the same messages) to labelled pages: a fixed
number of pages built by :func:`labelled_pages` from many layouts, each text leaf labelled. These are made, not taken
from the web: no labelled pages come with the tables. :func:`fit` takes any labelled pages.

Kept leaves are joined in page order: blocks by one space, white space inside a block as one space.

Defined cases: null and empty pages, and pages without kept text, give an empty text. Unclosed, unmatched and
deeply nested tags are read like a browser's simple rules do; scripts, styles, comments and the contents of closed
``template``, ``iframe``, ``textarea`` and ``title`` elements are never text. Only an unclosed script or style hides the
rest of a page; of the others where unclosed the start tag alone is skipped. Formulas, drawings, objects and selections
are elements like others.
Repeated rows are returned each time. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 13
#: fixed values: elements of HTML by how a parser treats them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title".split())
SWALLOW = frozenset(("script", "style"))
INLINE = frozenset("a abbr acronym annotation b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mroot mrow ms msqrt msub msup mtext q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: fixed values: elements that end at the start of one of the others
ENDED = ("select", "svg", "math")
ENDS = CLOSES_P | frozenset("b big br center code dd dt em i img li p small span strong strike sub sup tt tr td th u var".split())
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
NAME = re.compile(r"[a-z]+")


class Tree:
    """Nodes in page order: parent, tag ("#" for text), text, words of its attributes, and whether a block starts there."""

    __slots__ = ("parent", "tag", "text", "names")

    def __init__(self):
        self.parent, self.tag, self.text, self.names = [-1], ["html"], [""], [()]

    def add(self, parent: int, tag: str, text: str = "", names: tuple = ()) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.text.append(text)
        self.names.append(names)
        return len(self.tag) - 1


@lru_cache(20000)
def _names(attrs: str) -> tuple:
    out = []
    for m in ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        kind = m[1].lower()
        if kind in ("hidden", "aria-hidden"):
            out.append("hidden" if value != "false" else "")
        else:
            out += NAME.findall(value)
    return tuple(dict.fromkeys(x for x in out if x))


def parse(html: str) -> Tree:
    t = Tree()
    stack, open_count = [0], {}
    at, n = 0, len(html)
    parent, tags = t.parent, t.tag

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_count[tags[stack.pop()]] -= 1

    def tags_from(tag: str) -> int:
        depth = len(stack) - 1
        while tags[stack[depth]] != tag:
            depth -= 1
        return depth

    while at < n:
        m = TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at:
            text = html[at:end]
            if not text.isspace():
                t.add(stack[-1], "#", unescape(text))
            else:
                t.add(stack[-1], " ")
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                t.add(stack[-1], "br")
            elif open_count.get(tag):
                pop_to(tags_from(tag))
            continue
        if not (m[2] or m[4]):
            continue
        tag, attrs = (m[2] or m[4]).lower(), m[3] or m[5] or ""
        if tag in ("html", "body"):
            continue
        if tag in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = close.end() if close else n if tag in SWALLOW else at
            continue
        if tag in ENDS:
            for x in ENDED:
                if open_count.get(x):
                    pop_to(tags_from(x))
        if tag in CLOSES_P and open_count.get("p"):
            pop_to(tags_from("p"))
        if tag in CLOSED_BY:
            depth = len(stack) - 1
            found = None
            while depth > 0 and tags[stack[depth]] not in SCOPE[tag]:
                if tags[stack[depth]] in CLOSED_BY[tag]:
                    found = depth
                depth -= 1
            if found:
                pop_to(found)
        k = t.add(stack[-1], tag, "", _names(attrs) if attrs else ())
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(k)
            open_count[tag] = open_count.get(tag, 0) + 1
    return t


@lru_cache(100000)
def _hash(x: str) -> int:
    return zlib.crc32(x.encode()) % (1 << BITS)


class Batch:
    """Pages as flat arrays: parents, depths, edge kinds and feature ids (with starts), of all nodes."""

    def __init__(self, trees: list[Tree]):
        parents, depth, kinds, ids, starts, self.first = [], [], [], [], [], []
        base = 0
        for t in trees:
            n = len(t.tag)
            self.first.append(base)
            chars, linked = [0] * n, [0] * n
            in_link = [False] * n
            d = [0] * n
            for i in range(1, n):
                p = t.parent[i]
                d[i] = d[p] + 1
                in_link[i] = in_link[p] or t.tag[i] == "a"
                if t.tag[i] == "#":
                    chars[i] = len(t.text[i].strip())
                    linked[i] = chars[i] if in_link[i] else 0
            total = sum(chars)
            for i in range(n - 1, 0, -1):
                chars[t.parent[i]] += chars[i]
                linked[t.parent[i]] += linked[i]
            before = 0
            for i in range(n):
                starts.append(len(ids))
                tag, p = t.tag[i], t.parent[i]
                size = chars[i].bit_length()
                share = (4 * linked[i]) // max(1, chars[i])
                if tag == "#":
                    kind = 0
                    ids += (_hash(f"text|{size}"), _hash(f"text|{t.tag[p]}|{min(size, 8)}"), _hash(f"text|link|{in_link[i]}"), _hash(f"text|at|{4 * before // max(1, total)}"))
                    before += chars[i]
                else:
                    kind = 1 if tag in INLINE else 2 if tag == "p" else 3
                    ids += (_hash(f"tag|{tag}"), _hash(f"tag|{tag}|{share}"), _hash(f"size|{size}|{share}"), _hash(f"tag|{tag}|{t.tag[p] if p >= 0 else ''}"))
                    ids += [_hash(f"name|{x}") for x in t.names[i]]
                parents.append(base + p if p >= 0 else -1)
                depth.append(d[i])
                kinds.append(kind)
            base += n
        self.parent, self.depth, self.kind = np.array(parents, np.int64), np.array(depth, np.int64), np.array(kinds, np.int64)
        self.ids, self.starts, self.n = np.array(ids, np.int64), np.array(starts, np.int64), base
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1]) if base else []


@dataclass
class TreeModel:
    """unary: a weight per feature id for the label 1; pair: log potentials [edge kind, parent's label, own label]."""

    unary: np.ndarray
    pair: np.ndarray

    def messages(self, b: Batch):
        """Marginals P(content) of all nodes, and P(parent's label, own label) of all that have a parent."""
        own = np.zeros((b.n, 2))
        own[:, 1] = np.add.reduceat(self.unary[b.ids], b.starts) if b.n else 0
        up, pair = own.copy(), self.pair[b.kind]  # own potential and the children's messages, in logs
        sent = np.zeros((b.n, 2))
        for level in b.levels[:0:-1]:
            sent[level] = np.logaddexp(pair[level, :, 0] + up[level, None, 0], pair[level, :, 1] + up[level, None, 1])
            for y in (0, 1):
                up[:, y] += np.bincount(b.parent[level], sent[level, y], b.n)
        full = up.copy()  # with the message from the parent
        joint = np.zeros((b.n, 2, 2))
        for level in b.levels[1:]:
            p = b.parent[level]
            rest = full[p] - sent[level]
            both = rest[:, :, None] + pair[level] + up[level, None, :]
            joint[level] = both
            full[level] = np.logaddexp(both[:, 0], both[:, 1])
        joint -= joint.reshape(b.n, 4).max(1)[:, None, None] if b.n else 0
        joint = np.exp(joint)
        joint /= joint.sum((1, 2), keepdims=True)
        joint[b.parent < 0] = 0
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), joint


def fit(pages: list[tuple[str, list[bool]]], epochs: int = 150, rate: float = 0.1, l2: float = 1e-3) -> TreeModel:
    """Weights by gradient ascent on the exact likelihood. A page comes with a label for each text leaf in order.

    An element's label is that of most of its text; an element without text has its parent's.
    """
    trees = [parse(h) for h, _ in pages]
    b = Batch(trees)
    y = np.zeros(b.n)
    for t, (_, labels), base in zip(trees, pages, b.first, strict=True):
        n = len(t.tag)
        yes, all_ = np.zeros(n), np.zeros(n)
        k = 0
        for i in range(n):
            if t.tag[i] == "#":
                all_[i] = len(t.text[i].strip())
                yes[i] = all_[i] * labels[k]
                k += 1
        if k != len(labels):
            raise ValueError("a page's labels do not fit its text leaves")
        for i in range(n - 1, 0, -1):
            yes[t.parent[i]] += yes[i]
            all_[t.parent[i]] += all_[i]
        for i in range(n):
            y[base + i] = yes[i] > all_[i] / 2 if all_[i] else (y[base + t.parent[i]] if i else 0)
    lengths = np.diff(np.append(b.starts, len(b.ids)))
    node = np.repeat(np.arange(b.n), lengths)
    model = TreeModel(np.zeros(1 << BITS), np.zeros((4, 2, 2)))
    seen = np.zeros((4, 2, 2))
    inner = b.parent >= 0
    np.add.at(seen, (b.kind[inner], y[b.parent[inner]].astype(int), y[inner].astype(int)), 1)
    m = [np.zeros_like(model.unary), np.zeros_like(model.pair)]
    s = [np.zeros_like(model.unary), np.zeros_like(model.pair)]
    for step in range(1, epochs + 1):
        p, joint = model.messages(b)
        expected = np.zeros((4, 2, 2))
        np.add.at(expected, b.kind[inner], joint[inner])
        grads = [np.bincount(b.ids, (y - p)[node], 1 << BITS) / len(pages) - l2 * model.unary, (seen - expected) / len(pages) - l2 * model.pair]
        for i, (g, w) in enumerate(zip(grads, (model.unary, model.pair), strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            w += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-6)
    return model


#: fixed values: words that name parts of pages, for the layouts of the labelled pages
BAD_NAMES = {
    "menu": "menu nav navbar navigation topnav breadcrumb breadcrumbs pagination pager tabs toc skip".split(),
    "header": "header masthead banner topbar logo site-header page-header branding".split(),
    "footer": "footer site-footer page-footer bottom copyright legal colophon".split(),
    "side": "sidebar aside widget related recommended popular trending more-stories tags share social rail".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner-notice message paywall".split(),
    "ad": "ad ads advert advertisement adsense sponsored promo promotion sponsor banner-ad".split(),
    "form": "form login search subscribe newsletter signup contact-form".split(),
    "comments": "comments comment-list comment discussion replies reply disqus respond user-comments".split(),
}
GOOD_NAMES = "content article post entry story main text body article-body post-content entry-content main-content page-content".split()


def labelled_pages(count: int = 480, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """``count`` pages of mixed layouts, with a label for each text leaf: the training set's size is this parameter."""
    r = random.Random(seed)
    extra = random.Random(seed + 1)  # what these choose leaves the other choices as they are
    syllables = "ba ke lo mi nu ra se ti vo da fe gi ho ju".split()

    def words(n: int) -> str:
        out = " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))
        return out[:1].upper() + out[1:] + r.choice([".", ".", ".", "?", "!", ""])

    def made(n: int) -> str:
        return " ".join("".join(extra.choice(syllables) for _ in range(extra.randint(1, 4))) for _ in range(n))

    def page() -> tuple[str, list[bool]]:
        html, labels = [], []

        def put(text: str, label: bool) -> None:
            html.append(text)
            labels.append(label)

        def attr(kind: str) -> str:
            x = r.choice(BAD_NAMES[kind])
            return r.choice([f' class="{x}"', f' id="{x}"', f' class="{x} box"', f" class='{x}-wrap'"])

        def link(text: str, label: bool) -> None:
            html.append(f'<a href="/{r.randrange(99)}">')
            put(text, label)
            html.append("</a>")

        def links(n: int, list_: bool = True) -> None:
            html.append("<ul>" if list_ else "<div>")
            for _ in range(n):
                html.append("<li>" if list_ else "<span>")
                link(words(r.randint(1, 4)), False)
                if not list_ and extra.random() < 0.5:
                    put(extra.choice([" | ", " - ", " / "]), False)
                html.append("</li>" if list_ else "</span>")
            html.append("</ul>" if list_ else "</div>")

        tabled = extra.random() < 0.25

        def bad(kind: str) -> None:
            row = "<tr>" if extra.random() < 0.5 else ""  # cells may share a row
            cell = f"{row}<td{attr_of(kind) if extra.random() < 0.3 else ''}>" if tabled else ""
            html.append(cell)
            part(kind)
            html.append("</td>" if cell else "")

        def attr_of(kind: str) -> str:
            x = extra.choice(BAD_NAMES[kind])
            return extra.choice([f" class={x}", f' id="{x}"'])

        def part(kind: str) -> None:
            if tabled and kind == "menu" and extra.random() < 0.7:  # bare links in a cell
                for _ in range(extra.randint(2, 7)):
                    html.append('<a href="/m">')
                    put(made(extra.randint(1, 2)), False)
                    html.append("</a>")
                    if extra.random() < 0.5:
                        put(extra.choice([" | ", " - "]), False)
                    else:
                        html.append("<br>")
                return
            tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, r.choice(["div", "section", "div"]))
            semantic = tag not in ("div", "section") and r.random() < 0.6
            html.append(f"<{tag}{attr(kind) if r.random() < 0.4 else ''}>" if semantic else f"<{(tag := r.choice(['div', 'div', 'section', 'p']))}{attr(kind)}>")
            if kind == "menu":
                links(r.randint(2, 9), r.random() < 0.8)
            elif kind == "comments":
                for _ in range(r.randint(1, 5)):
                    html.append(r.choice(["<div class='comment'>", "<li>", "<p>", "<div>", "<article>"]))
                    close = html[-1][1:].split(" ")[0].rstrip(">")
                    put(words(r.randint(3, 60)), False)
                    html.append(f"</{close}>")
            elif kind == "form":
                html.append("<label>")
                put(words(2), False)
                html.append('</label><input name="q">')
                if extra.random() < 0.4:
                    html.append("<select>")
                    for _ in range(extra.randint(1, 4)):
                        html.append("<option>")
                        put(made(2), False)
                    html.append("</select>")
                html.append("<button>")
                put(words(1), False)
                html.append("</button>")
            elif kind in ("side", "header") and r.random() < 0.6:
                if r.random() < 0.6:
                    html.append("<h3>")
                    put(words(2), False)
                    html.append("</h3>")
                links(r.randint(1, 6))
            elif r.random() < 0.5:
                x = r.choice(["h1", "h1", "h2", "p", "span"] if kind == "header" else ["h2", "h3", "p", "p", "p"])
                html.append(f"<{x}>")
                put(words(r.randint(1, 6) if x != "p" else r.randint(3, 40)), False)
                html.append(f"</{x}>")
            else:
                put(words(r.randint(2, 25)), False)
                if r.random() < 0.3:
                    link(words(2), False)
            html.append(f"</{tag}>")

        def paragraph() -> None:
            kind = r.random()
            if kind < 0.62:
                html.append("<p>")
                put(words(r.choice([1, 2, 5, 12, 30, 60, 120])), True)
                while r.random() < 0.3:
                    x = r.choice(["b", "i", "em", "strong", "a", "code", "span"])
                    html.append(f"<{x}>" if x != "a" else '<a href="/x">')
                    put(words(r.randint(1, 4)), True)
                    html.append(f"</{x}>" if r.random() < 0.85 else "<br>")
                    put(" " + words(r.randint(1, 20)), True)
                if extra.random() < 0.1:
                    html.append("<math><mi>")
                    put(made(1), True)
                    html.append("</mi></math>")
                html.append("</p>" if r.random() < 0.9 else "")
            elif kind < 0.70:
                html.append("<p><b>")
                put(words(r.randint(1, 30)), True)
                html.append("<br>")
            elif kind < 0.78:
                x = r.choice(["h2", "h3", "blockquote", "pre", "figcaption", "div"])
                html.append(f"<{x}>")
                put(words(r.randint(1, 12)), True)
                html.append(f"</{x}>")
            elif kind < 0.9:
                x = r.choice(["ul", "ol"])
                html.append(f"<{x}>")
                for _ in range(r.randint(1, 5)):
                    html.append("<li>")
                    put(words(r.randint(2, 20)), True)
                    html.append("</li>")
                html.append(f"</{x}>")
            else:
                html.append("<table>")
                for _ in range(r.randint(1, 3)):
                    html.append("<tr>")
                    for _ in range(r.randint(1, 3)):
                        html.append("<td>")
                        put(words(r.randint(1, 5)), True)
                        html.append("</td>")
                    html.append("</tr>")
                html.append("</table>")

        html.append("<html><head><title>t</title><style>p{}</style></head><body>" + "<table width=100%>" * tabled)
        for k in ("header", "menu", "notice", "ad", "form"):
            if r.random() < 0.55:
                bad(k)
        wrap = r.random() < 0.4
        html.append("<div class='wrapper'>" if wrap else "")
        if r.random() < 0.3:
            bad("side")
        box = r.choice(["<article>", "<article>", "<main>", "<article class='post'>", "<main><article>", *(f'<div class="{x}">' for x in r.sample(GOOD_NAMES, 3)), f'<div id="{r.choice(GOOD_NAMES)}">', f'<section class="{r.choice(GOOD_NAMES)}">', "<div>"])
        html.append(extra.choice(["<tr><td>", "<td>"]) * tabled + box * (not tabled or extra.random() < 0.5))
        if r.random() < 0.8:
            title = extra.choice(["h1", "h1", "h2"])
            html.append(f"<{title}>")
            put(words(r.randint(1, 12)), True)
            html.append(f"</{title}>")
        for _ in range(r.randint(1, 14)):
            paragraph()
            if r.random() < 0.06:
                bad(r.choice(["ad", "side", "notice", "form", "menu"]))
        if r.random() < 0.15:
            bad("comments")
        html.append("".join(f"</{x}>" for x in reversed(re.findall(r"<(\w+)", box))) + "</td>" * tabled)
        if r.random() < 0.35:
            bad("comments")
        for k in ("side", "ad", "menu", "notice", "form", "footer"):
            if r.random() < (0.7 if k == "footer" else 0.3):
                bad(k)
        html.append(("</div>" if wrap else "") + "</table>" * tabled)
        html.append(r.choice(["</body></html>", ""]))
        return "".join(html), labels

    return [page() for _ in range(count)]


@lru_cache(1)
def default_model() -> TreeModel:
    return fit(labelled_pages())


def text_of(t: Tree, content: np.ndarray) -> str:
    """The kept leaves' text, with a space wherever a block or a line break stands between two of them."""
    out, n = [], len(t.tag)
    parent, tag = t.parent, t.tag
    block = [0] * n  # the innermost block of each node
    last_block, gap = 0, False
    for i in range(1, n):
        p = parent[i]
        x = tag[i]
        block[i] = block[p] if x in INLINE or x in ("#", " ", "br", "img") else i
        if x in ("br", " "):
            gap = True
        elif x not in INLINE and x not in ("#", "img"):
            gap = True
        elif x == "#":
            if block[i] != last_block:
                gap = True
                last_block = block[i]
            if content[i]:
                if gap:
                    out.append(" ")
                out.append(t.text[i])
                gap = False
    return " ".join("".join(out).split())


def extract(pages: list[str | None], model: TreeModel) -> list[str]:
    trees = [parse(h or "") for h in pages]
    b = Batch(trees)
    p = model.messages(b)[0]
    ends = [*b.first[1:], b.n]
    return [text_of(t, p[a:e] >= 0.5) for t, a, e in zip(trees, b.first, ends, strict=True)]


def main_text(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, in one pass without a shuffle."""
    model = model or default_model()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 128):
                part = b.slice(s, 128)
                texts = extract(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
