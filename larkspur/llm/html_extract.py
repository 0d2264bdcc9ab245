"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks (leaves between block-level
tags). Each block is a vector: the mean of learned vectors of its hashed tag
path (tags, class and id words, and pairs of them), the mean of those of its hashed words, and a
few measures. A bidirectional LSTM in numpy reads the whole sequence, so every
block is judged with the document around it. It is trained on pages that are
made up here, whose labels are known: menus, notices, adverts, sidebars, forms,
comments and footers around an article, in many spellings of tags and classes.

Blocks judged as article are joined in page order. Scripts, styles, form
controls and markup hold no text; all other elements are read, and only those
of the list BLOCK end a block. Character references are decoded, white space
becomes single spaces. Reading a page takes time and memory in proportion to its
length, whatever its markup: each open tag knows its place in a tree of paths.

Defined results: null or empty html, or pages without article blocks, give an
empty text. Broken markup is read as far as it goes: tags left open end with
their parent, an unclosed script, style or comment ends with the page, a tag
that has no > is text. If quotes hide the end of a tag up to the end of the page,
quotes count for nothing from there on. Rows are extracted one by one, so
repeated rows and null ids change nothing. An empty table gives an empty table.
All other columns pass on; ``main_text`` replaces those of that name in any case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.columns import by_place, place, with_results
from larkspur.runtime import ensure_importable

TAGS, WORDS, MEASURES = 4096, 2048, 4
TAG_SIZE, WORD_SIZE, HIDDEN = 16, 8, 16
INPUT = TAG_SIZE + WORD_SIZE + MEASURES
#: Blocks of a batch, with padding, at most.
BATCH = 40_000

#: Paths that a task remembers between pages.
REMEMBERED = 200_000
#: Places of a sequence whose gates are computed at once.
STEPS = 2048

#: Fixed values of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li listing main menu nav noframes ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead title tr ul xmp".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I) for tag in ("script", "style")}
CONTROLS = frozenset("button datalist select textarea".split())
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
HOLDS = frozenset("html body article main section div aside nav header footer form table ul ol dl blockquote td th figure fieldset details".split())
TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
HIDDEN_TEXT = re.compile(r"<[!?]")
TAG_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z0-9]+")
TERMINAL = re.compile(r"[.!?…。:;][\"'”’)»]*$")


def names(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag and its class, id and role words."""
    if not attributes or attributes.isspace():
        return (tag,)
    found = [tag]
    for kind, *values in NAMES.findall(attributes):
        found += ("." + w for w in WORD.findall("".join(values).lower()))
    return tuple(found)


class Node:
    """A tag below its parent, in the tree of all paths met."""

    __slots__ = ("parent", "words", "below", "total", "count")

    def __init__(self, parent: Node | None = None, words: tuple[str, ...] = ()):
        self.parent, self.words, self.below = parent, words, {}
        self.total, self.count = None, 0

    def path(self) -> tuple[str, ...]:
        out, node = [], self
        while node:
            out.append(node.words)
            node = node.parent
        return tuple(w for words in reversed(out) for w in words)


@lru_cache(maxsize=100_000)
def own_buckets(before: tuple[str, ...], words: tuple[str, ...]) -> np.ndarray:
    """Buckets of path words, and of their pairs, the first with the word before."""
    pairs = [f"{a} {b}" for a, b in pairwise((*before, *words))]
    return np.array([xxhash.xxh32_intdigest(w) % TAGS for w in (*words, *pairs)], np.int64)


def tag_buckets(path: tuple[str, ...]) -> np.ndarray:
    return own_buckets((), path) if path else np.zeros(1, np.int64)


class Paths:
    """Paths met so far, each with the sum of the learned vectors of its words."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.root, self.size = Node(), 0
        self.root.total = np.zeros(self.table.shape[1])

    def below(self, node: Node, words: tuple[str, ...]) -> Node:
        found = node.below.get(words)
        if found is None:
            found = node.below[words] = Node(node, words)
            self.size += 1
        return found

    def mean(self, node: Node) -> np.ndarray:
        todo, at = [], node
        while at.total is None:
            todo.append(at)
            at = at.parent
        for at in reversed(todo):
            own = own_buckets(at.parent.words[-1:], at.words)
            at.total, at.count = at.parent.total + self.table[own].sum(0), at.parent.count + len(own)
        return node.total / node.count if node.count else self.table[0]


def blocks(html: str, paths: Paths) -> list[tuple[Node, str, float]]:
    """(path, text, part of the text in links) of each text block."""
    out: list[tuple[Node, str, float]] = []
    stack: list[tuple[str, Node]] = []
    opened: dict[str, list[int]] = {}
    holding: list[int] = []
    controls: list[int] = []
    held: list[str] = []
    own: Node | None = None
    linked = links = 0

    def text(s: str) -> None:
        nonlocal own, linked
        if not s or controls:
            return
        if own is None and not s.isspace():
            own = stack[-1][1] if stack else paths.root
        held.append(s)
        if links:
            linked += len(s)

    def flush() -> None:
        nonlocal own, linked
        if held:
            whole = " ".join(unescape("".join(held)).split())
            if whole:
                out.append((own, whole, min(1.0, linked / len(whole))))
            held.clear()
        own, linked = None, 0

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            tag, _ = stack.pop()
            opened[tag].pop()
            if holding and holding[-1] == len(stack):
                holding.pop()
            if controls and controls[-1] == len(stack):
                controls.pop()
            links -= tag == "a"

    at, last, quotes = 0, html.rfind(">"), True
    while m := TAG.search(html, at):
        if m.start() > last:  # no tag ends from here on
            m = HIDDEN_TEXT.search(html, at)
            text(html[at : m.start() if m else len(html)])
            at = len(html)
            break
        text(html[at : m.start()])
        tag = m[2]
        if not tag:
            end = html.find("-->", m.start() + 2) + 3 if m[0] == "<!--" else html.find(">", m.end()) + 1
            at = end if end > m.start() else len(html)
            continue
        end = TAG_END.match(html, m.end()) if quotes else None
        quotes = end is not None
        at = end.end() if end else html.find(">", m.end()) + 1
        attributes, tag = html[m.end() : at - 1], tag.lower()
        if tag in RAW:
            if not m[1]:
                end = RAW[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        block = tag in BLOCK and not (tag == "title" and opened.get("svg"))
        # what this tag ends: the element that it closes, or an open one that can't hold it
        ends = -1
        if m[1]:
            ends = opened[tag][-1] if opened.get(tag) else -1
        elif closes := CLOSES.get(tag) or (CLOSES["p"] if block else ()):
            nearest = max((opened[c][-1] for c in closes if opened.get(c)), default=-1)
            ends = nearest if nearest >= (holding[-1] if holding else 0) else -1
        if block and (not controls or 0 <= ends < controls[0]):
            flush()
        elif tag == "br":
            text(" ")
        if ends >= 0:
            pop_to(ends)
        if m[1] or tag in VOID or (attributes.endswith("/") and (opened.get("svg") or opened.get("math"))):
            continue
        opened.setdefault(tag, []).append(len(stack))
        if tag in HOLDS:
            holding.append(len(stack))
        stack.append((tag, paths.below(stack[-1][1] if stack else paths.root, names(tag, attributes))))
        if tag in CONTROLS or (tag == "title" and opened.get("svg")):  # a picture's title isn't shown
            controls.append(len(stack) - 1)
        links += tag == "a"
    text(html[at:])
    flush()
    return out


class _WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = b = xxhash.xxh32_intdigest(word.lower()) % WORDS
        return b


def encoded(path: np.ndarray, text: str, linked: float, known: dict) -> tuple[np.ndarray, np.ndarray, tuple[float, ...]]:
    """A block as path (buckets, or the mean of their vectors), buckets of words, and measures."""
    words = text.split()
    digits = sum(map(text.count, "0123456789"))
    measures = (linked, np.log1p(len(words)) / 4, float(bool(TERMINAL.search(text))), min(1.0, 4 * digits / len(text)))
    return path, np.array([known[w] for w in words], np.int64), measures


class Model(dict):
    """Parameters by name, as arrays."""

    @staticmethod
    def new(seed: int) -> Model:
        r = np.random.default_rng(seed)
        scale = lambda *s: r.standard_normal(s) * 0.3 / np.sqrt(s[0]) ** 0.5
        m = Model(tags=scale(TAGS, TAG_SIZE) * 2, words=scale(WORDS, WORD_SIZE), out=scale(2 * HIDDEN + INPUT), bias=np.zeros(1))
        for way in "fb":
            m |= {f"w{way}": scale(INPUT, 4 * HIDDEN), f"u{way}": scale(HIDDEN, 4 * HIDDEN), f"c{way}": np.zeros(4 * HIDDEN)}
            m[f"c{way}"][HIDDEN : 2 * HIDDEN] = 1.0
        return Model(m)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def bag_means(table: np.ndarray, bags: list[np.ndarray]) -> np.ndarray:
    """Mean of the table's rows for each bag; empty bags give zeros."""
    sizes = np.array([len(b) for b in bags])
    out = np.zeros((len(bags), table.shape[1]))
    full = sizes > 0
    if full.any():
        rows = table[np.concatenate([b for b in bags if len(b)])]
        out[full] = np.add.reduceat(rows, np.cumsum(np.append(0, sizes[full]))[:-1]) / sizes[full, None]
    return out


def inputs(m: Model, pages: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """(pages, longest, INPUT) with padding, and which places are blocks."""
    flat = [b for page in pages for b in page]
    paths = [b[0] for b in flat]
    means = np.array(paths) if paths[0].dtype.kind == "f" else bag_means(m["tags"], paths)
    x = np.hstack([means, bag_means(m["words"], [b[1] for b in flat]), np.array([b[2] for b in flat])])
    longest = max(map(len, pages))
    mask = np.arange(longest) < np.array([len(p) for p in pages])[:, None]
    out = np.zeros((len(pages), longest, INPUT))
    out[mask] = x
    return out, mask


def lstm(m: Model, way: str, x: np.ndarray, mask: np.ndarray):
    """Hidden states in the order of x, and what backpropagation needs; way b reads from the end."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    out, saved = np.zeros((n, steps, HIDDEN)), []
    gates_x = x @ m["w" + way] + m["c" + way]
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = gates_x[:, t] + h @ m["u" + way]
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
        g = np.tanh(z[:, 3 * HIDDEN :])
        on = mask[:, t, None]
        c_new = np.where(on, f * c + i * g, c)
        h_new = np.where(on, o * np.tanh(c_new), h)
        saved.append((t, i, f, o, g, c, c_new, h, on))
        h, c = h_new, c_new
        out[:, t] = h
    return out, saved


def lstm_scores(m: Model, way: str, x: np.ndarray, mask: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Hidden states times weights, without keeping states or all gates."""
    n, steps, _ = x.shape
    h, c, out = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, steps))
    starts = range(0, steps, STEPS)
    for start in starts if way == "f" else reversed(starts):
        gates = x[:, start : start + STEPS] @ m["w" + way] + m["c" + way]
        own = range(gates.shape[1])
        for t in own if way == "f" else reversed(own):
            z = gates[:, t] + h @ m["u" + way]
            ifo = sigmoid(z[:, : 3 * HIDDEN])
            on = mask[:, start + t, None]
            c_new = ifo[:, HIDDEN : 2 * HIDDEN] * c + ifo[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
            c = np.where(on, c_new, c)
            h = np.where(on, ifo[:, 2 * HIDDEN :] * np.tanh(c_new), h)
            out[:, start + t] = h @ weights
    return out


def probabilities(m: Model, pages: list[list]) -> list[np.ndarray]:
    """Probability of article for every block of each (non-empty) page."""
    x, mask = inputs(m, pages)
    w = m["out"]
    z = lstm_scores(m, "f", x, mask, w[:HIDDEN]) + lstm_scores(m, "b", x, mask, w[HIDDEN : 2 * HIDDEN]) + x @ w[2 * HIDDEN :]
    p = sigmoid(z + m["bias"])
    return [p[k, : len(page)] for k, page in enumerate(pages)]


def gradients(m: Model, pages: list[list], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy, by backpropagation through time."""
    x, mask = inputs(m, pages)
    states = {way: lstm(m, way, x, mask) for way in "fb"}
    features = np.concatenate([states["f"][0], states["b"][0], x], 2)
    y = np.zeros(mask.shape)
    y[mask] = np.concatenate(labels)
    d = np.where(mask, sigmoid(features @ m["out"] + m["bias"]) - y, 0) / mask.sum()
    g = {"out": np.einsum("ntk,nt->k", features, d), "bias": np.array([d.sum()])}
    back = d[:, :, None] * m["out"]
    dx = back[:, :, 2 * HIDDEN :].copy()
    for k, way in enumerate("fb"):
        own, u = back[:, :, k * HIDDEN : (k + 1) * HIDDEN], m["u" + way]
        dh, dc = np.zeros((len(pages), HIDDEN)), np.zeros((len(pages), HIDDEN))
        dz_all, gu = np.zeros((*mask.shape, 4 * HIDDEN)), np.zeros_like(u)
        for t, i, f, o, gate, c, c_new, h, on in reversed(states[way][1]):
            dh = dh + own[:, t]
            th = np.tanh(c_new)
            dc_new = dc + np.where(on, dh * o * (1 - th * th), 0)
            do = np.where(on, dh * th, 0)
            live = np.where(on, dc_new, 0)
            dz = np.hstack([live * gate * i * (1 - i), live * c * f * (1 - f), do * o * (1 - o), live * i * (1 - gate * gate)])
            dz_all[:, t] = dz
            gu += h.T @ dz
            dh = np.where(on, dz @ u.T, dh)
            dc = np.where(on, live * f, dc_new)
        g["u" + way] = gu
        g["w" + way] = np.einsum("nti,ntz->iz", x, dz_all)
        g["c" + way] = dz_all.sum((0, 1))
        dx += dz_all @ m["w" + way].T
    flat = [b for page in pages for b in page]
    for name, k, lo, hi in (("tags", 0, 0, TAG_SIZE), ("words", 1, TAG_SIZE, TAG_SIZE + WORD_SIZE)):
        sizes = np.array([len(b[k]) for b in flat])
        rows = dx[mask][:, lo:hi] / np.maximum(1, sizes)[:, None]
        g[name] = np.zeros_like(m[name])
        np.add.at(g[name], np.concatenate([b[k] for b in flat]), np.repeat(rows, sizes, axis=0))
    return g


#: How pages spell the parts that a made-up page is put together from.
FRAMES = {
    "nav": ["nav", "nav .menu", "div .nav .menu", "ul .menu", "div .navigation", "div .navbar", "header/nav", "div .breadcrumb", "div .main .nav", "section .related .links", "div .pagination", "div .tags", "div .share .social"],
    "header": ["header", "div .header", "div .masthead", "div .banner .top", "div .site .header", "div .site .title", "header .page .header"],
    "footer": ["footer", "div .footer", "div .site .footer", "footer .page .footer", "div .copyright", "div .bottom", "section .footer .links"],
    "sidebar": ["aside", "aside .sidebar", "div .sidebar", "div .widget", "div .related .posts", "section .sidebar", "div .right .column", "div .newsletter", "div .author .box", "div .trending"],
    "notice": ["div .cookie .notice", "div .notice", "div .alert", "div .banner .cookie", "div .popup", "div .consent", "p .notice", "div .message .warning", "section .gdpr", "div .disclaimer", "div .subscribe"],
    "advert": ["div .ad", "div .ads", "div .advert", "div .advertisement", "div .sponsored", "aside .ad", "div .promo", "div .banner .ad", "section .sponsor", "ins .adsbygoogle", "div .ad .slot"],
    "form": ["form", "form .search", "form .login", "div .form", "form .comment .form", "fieldset", "div .search", "form .newsletter", "div .signup"],
    "comments": ["div .comments", "section .comments", "div .comment .list", "section .discussion", "ol .commentlist", "div .disqus .thread", "div .replies", "section .reader .comments", "div .responses", "article .comment", "ul .comments"],
}
ARTICLES = ["article", "main", "main/article", "div .content", "div .article", "div .post", "div .entry .content", "div .article .body", "section .content", "div .post .body", "section .article", "div .main .content", "div .story", "main .main", "article .post", "div .text", ""]
INSIDE = {
    "nav": ["ul/li/a", "li/a", "a", "ul/li", "span/a", ""],
    "header": ["h1", "h1/a", "p", "div", "span", "a", ""],
    "footer": ["p", "", "div", "ul/li/a", "span", "p/small", "a"],
    "sidebar": ["h3", "ul/li/a", "p", "div/p", "h4", "div/a", "h2", ""],
    "notice": ["p", "", "span", "div/p", "button", "strong"],
    "advert": ["", "p", "a", "div/a", "span", "h3"],
    "form": ["label", "p", "button", "div/label", "legend", "p/label", ""],
    "comments": ["h3", "div .comment/p", "li/p", "article .comment/p", "div .comment .body/p", "p", "div .comment .author", "li .comment/div/p", "span .reply/a", "div .reply/p", "h2", "div .author", ""],
}
PARAGRAPHS = ["p", "p", "p", "p", "p", "p/b", "p/a", "h2", "h3", "p/em", "ul/li", "ol/li", "blockquote/p", "blockquote", "section/p", "div/p", "pre", "table/tr/td", "p/strong", "figure/figcaption", "dl/dd"]
SAYINGS = {
    "nav": "home about contact news sports world business menu next previous login".split(),
    "header": "welcome site the blog daily news".split(),
    "footer": "copyright © all rights reserved privacy terms contact imprint © ·".split(),
    "sidebar": "popular posts recent related archive categories tags about author follow read more".split(),
    "notice": "we use cookies accept privacy policy consent this site by continuing agree settings subscribe".split(),
    "advert": "buy now sponsored sale free offer click here advertisement discount shop deal".split(),
    "form": "email name password search submit send login your message subscribe".split(),
    "comments": "reply comments said posted great thanks by anonymous ago report like says comment agree".split(),
}


def made_up_page(r: np.random.Generator) -> tuple[list, np.ndarray]:
    """Blocks of a page, and which are of the article."""
    pick = lambda a: a[int(r.integers(len(a)))]
    letters = np.array(list("aeiounrstlhdcmpgbvé"))

    def words(n: int, said: list[str], share: float) -> str:
        own = ["".join(letters[r.integers(len(letters), size=int(r.integers(2, 11)))]) for _ in range(n)]
        numbers = pick([0.0, 0.0, 0.02, 0.1])  # years, dates, prices and counts come in all parts
        own = [str(r.integers(10 ** int(r.integers(1, 7)))) if r.random() < numbers else w for w in own]
        return " ".join(pick(said) if said and r.random() < share else w for w in own)

    def path(*parts: str) -> tuple[str, ...]:
        return tuple(w for part in parts for w in part.replace("/", " ").split())

    outer = pick(["", "", "", "div", "div .container", "div .wrapper", "div .page", "div/div"])
    page: list[tuple[tuple[str, ...], str, float]] = []
    labels: list[bool] = []

    def add(p: tuple[str, ...], text: str, linked: float, label: bool) -> None:
        page.append((("html", *p), text, linked))
        labels.append(label)

    def part(kind: str, below: str) -> None:
        frame = pick(FRAMES[kind])
        many = int(r.integers(1, 4)) if kind not in ("nav", "comments", "sidebar") else int(r.integers(2, 12))
        one = pick(INSIDE[kind])
        for _ in range(many):
            inner = one if kind == "nav" else pick(INSIDE[kind])
            long_ = kind in ("comments", "footer", "notice", "advert", "sidebar") and r.random() < 0.6
            n = int(r.integers(4, 60)) if long_ else int(r.integers(1, 6))
            text = words(n, SAYINGS[kind], pick([0.0, 0.1, 0.5])) + ("." if long_ and r.random() < 0.7 else "")
            add(path("body", outer, below, frame, inner), text, 1.0 if inner.endswith("a") else 0.0, False)

    if r.random() < 0.9:
        add(path("head", "title"), words(int(r.integers(2, 12)), [], 0), 0.0, False)
    for kind in ("notice", "header", "nav", "advert", "sidebar", "form"):
        if r.random() < (0.7 if kind == "nav" else 0.4):
            part(kind, "")
    body = pick(ARTICLES)
    if r.random() < 0.8:
        add(path("body", outer, body, pick(["h1", "h1", "header/h1", "h2"])), words(int(r.integers(2, 14)), [], 0), 0.0, True)
    for _ in range(int(r.integers(1, 14))):
        inner = pick(PARAGRAPHS[:8] if r.random() < 0.8 else PARAGRAPHS)
        n = int(r.integers(1, 8)) if r.random() < 0.45 else int(r.integers(8, 160))
        text = words(n, [], 0)
        if r.random() < 0.1:
            text += " " + words(6, SAYINGS[pick(list(SAYINGS))], 0.5)
        add(path("body", outer, body, inner), text.capitalize() + pick(["."] * 7 + ["", "", "!", "***"]), float(r.random() < 0.05), True)
        if body and r.random() < 0.06:
            part(pick(["advert", "sidebar", "form", "nav", "notice"]), body)
    if body and r.random() < 0.15:
        part(pick(["comments", "footer", "nav"]), body)
    for kind in ("advert", "comments", "sidebar", "form", "nav", "footer"):
        if r.random() < (0.8 if kind == "footer" else 0.35):
            part(kind, "")
    return page, np.array(labels, float)


@lru_cache(maxsize=2)
def trained(seed: int = 5, pages: int = 900, epochs: int = 10, batch: int = 32) -> Model:
    """The labeller, trained on made-up pages; the same for equal arguments."""
    r, known = np.random.default_rng(seed), _WordBuckets()
    made = [made_up_page(r) for _ in range(pages)]
    data = [([encoded(tag_buckets(path), text, linked, known) for path, text, linked in page], labels) for page, labels in made]
    m = Model.new(seed)
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    t = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = r.permutation(pages)
        for start in range(0, pages, batch):
            own = [data[i] for i in order[start : start + batch]]
            t += 1
            for k, g in gradients(m, [p for p, _ in own], [y for _, y in own]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return m


def articles(m: Model, pages: list[str], known: dict, paths: Paths | None = None) -> list[str]:
    """Main texts of a list of pages."""
    paths = paths or Paths(m["tags"])
    if paths.size > REMEMBERED:
        paths.clear()
    parsed = [blocks(p, paths) for p in pages]
    order = sorted((i for i, p in enumerate(parsed) if p), key=lambda i: len(parsed[i]))
    out = [""] * len(pages)
    group: list[int] = []
    for place, i in enumerate(order):
        group.append(i)
        following = len(parsed[order[place + 1]]) if place + 1 < len(order) else 0
        if not following or (len(group) + 1) * following > BATCH:
            found = probabilities(m, [[encoded(paths.mean(node), text, linked, known) for node, text, linked in parsed[g]] for g in group])
            for g, p in zip(group, found, strict=True):
                out[g] = "\n\n".join(b[1] for b, x in zip(parsed[g], p, strict=True) if x >= 0.5)
            group = []
    return out


def _texts(model):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, paths = _WordBuckets(), Paths(model.value["tags"])
        for pages in batches:
            html = pages.to_pylist()
            out = []
            for start in range(0, len(html), 256):
                out += articles(model.value, [h or "" for h in html[start : start + 256]], known, paths)
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with main_text instead of its markup's column."""
    spark = pages.sparkSession
    ensure_importable(spark)
    model = spark.sparkContext.broadcast(trained())
    own = by_place(pages)
    article = F.arrow_udf(_texts(model), "string")(F.col(f"c{place(pages.columns, html)}"))
    found = with_results(own.withColumn("article", article), pages.columns, {"main_text": F.col("article")})
    # by place again: a name may differ from another in case only
    left = [(k, c) for k, c in enumerate(found.columns) if c != html]
    return by_place(found).select(*(F.col(f"c{k}") for k, _ in left)).toDF(*(c for _, c in left))
