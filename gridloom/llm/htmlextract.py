"""Main text of web pages: gradient-boosted trees over DOM-node features with hierarchical decoding.

A tolerant parser makes a tree of block-level elements; runs of text beside child blocks are nodes of their own. Each
node has features of its tag, its class, id and role tokens and those of its ancestors, its depth, its place among its
siblings, and the size, link share and density of its subtree. The trees are boosted on logistic loss from pages that
``examples`` builds with a fixed seed. Decoding maximises the sum of log-probabilities under the rule that below a
dropped node all is dropped, by one pass up and one down the tree.

Scripts, styles, comments, forms' controls and markup never count as text. Character references are decoded, white
space in a block (with that of <br>) becomes one space, blocks are trimmed and joined by a blank line, in page order.

Cases: null, empty or textless html gives an empty text; html that ends early keeps what it has; a page without markup
is one block; a quote in a tag that never ends counts as none from there on; a very long page is parsed in one pass;
labellings of equal likelihood keep the node; rows that repeat are judged alike; a null page_id or url is kept; other
columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg math canvas select option textarea button input audio video datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}

# Possessive, so that a tag that never ends is given up in one pass.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_OPENS = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_ATTR = re.compile(r"([^\s=\"'<>/]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_SPACE = re.compile(r"[\s\xa0]+")

GOOD = frozenset("article content contents main body post entry story text page copy prose blog read hentry paragraph".split())
BAD = {
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs tabs toolbar pagination pager skip topbar toc links",
    "frame": "header footer masthead banner copyright legal colophon foot top bottom brand logo",
    "side": "sidebar aside side rail widget related recommended trending popular more also latest tags categories archive",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion affiliate commercial outbrain taboola",
    "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay privacy disclaimer message banner",
    "form": "form login signup subscribe newsletter search register contact share social follow buttons signin",
    "comment": "comment comments reply replies respond disqus discussion thread feedback review reviews reader readers",
}
GROUPS = {name: frozenset(words.split()) for name, words in BAD.items()}
TAGS = ("p", "li", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "td", "blockquote", "pre", "figure", "dialog", "#text")


class Node:
    __slots__ = ("bad", "children", "end", "good", "groups", "index", "kids", "linked", "parent", "pieces", "size", "tag", "words")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent = tag, parent
        self.children: list[Node] = []
        self.pieces: list[tuple[str, bool]] = []
        self.groups = set()
        self.good = False
        if attrs:
            for name, value in _ATTR.findall(attrs):
                if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                    tokens = set(_SPLIT.split(value.strip("\"'").lower()))
                    self.good |= bool(tokens & GOOD)
                    self.groups |= {g for g, w in GROUPS.items() if tokens & w}
        if parent is not None:
            parent.children.append(self)


def parse(source: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order; text lies in the pieces (text, in a link) of leaf nodes."""
    root = Node("#root", None)
    order = [root]
    stack: list[tuple[str, Node]] = [("#root", root)]
    silent = linked = 0
    text_node: list[Node | None] = [None]
    at, n = 0, len(source)
    opened: dict[str, int] = {}

    def text(s: str) -> None:
        if silent or not s:
            return
        run = text_node[0]
        if run is None:
            if not s.strip():
                return
            run = Node("#text", stack[-1][1])
            order.append(run)
            text_node[0] = run
        run.pieces.append((s, linked > 0))

    def pop() -> None:
        nonlocal silent, linked
        tag, _ = stack.pop()
        opened[tag] -= 1
        silent -= tag in SILENT
        linked -= tag == "a"
        if tag not in INLINE:
            text_node[0] = None

    def close(names: set[str] | frozenset[str], stop: set[str]) -> None:
        if not any(opened.get(x) for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in stop:
                return

    pattern, seen = _TAG, 0
    while at < n:
        begin = _OPENS.search(source, max(at, seen))
        if not begin:
            text(source[at:])
            break
        first = begin.start()
        if source[first + 1] in "!?":
            comment = source.startswith("<!--", first)
            stop = source.find("-->" if comment else ">", first + 2)
            if stop < 0:
                # A comment that never ends goes to the end of the page, another mark is cut off there.
                text(source[at:first])
                break
            text(source[at:first])
            at = stop + (3 if comment else 1)
            continue
        m = pattern.match(source, first)
        if not m and pattern is _TAG:
            # A quote that never ends: from here on tags end at the next >, so no later tag looks for its end in vain.
            pattern = _PLAIN_TAG
            m = pattern.match(source, first)
        if not m:
            if source.find(">", first) < 0:
                text(source[at:first])
                break
            seen = first + 1
            continue
        text(source[at:first])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                close({tag}, {"table"} if tag in INLINE or tag == "p" else set())
            continue
        if tag in ("html", "body"):
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "article", "section", "div", "body", "li", "blockquote"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag == "a" and linked:
            close({"a"}, {"table"})
        if tag not in INLINE:
            text_node[0] = None
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).search(source, at)
            at = source.find(">", end.end()) + 1 if end else 0
            at = at or n
            continue
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
        else:
            node = Node(tag, stack[-1][1], m[3])
            order.append(node)
            stack.append((tag, node))
        opened[tag] = opened.get(tag, 0) + 1
        silent += tag in SILENT
        linked += tag == "a"
    # A node whose only child is a run of text takes it; there is then one decision for both.
    kept = []
    for node in order:
        if node.tag == "#text" and len(node.parent.children) == 1 and node.parent.parent is not None:
            node.parent.pieces = node.pieces
            node.parent.children = []
        else:
            kept.append(node)
    return root, kept


def measure(order: list[Node]) -> np.ndarray:
    """A row of features for each node but the root; also sets the sizes of subtrees."""
    for i, node in enumerate(order):
        node.index = i
        node.size = sum(len(s) for s, _ in node.pieces)
        node.linked = sum(len(s) for s, link in node.pieces if link)
        node.kids = 1
        node.words = sum(s.count(" ") for s, _ in node.pieces)
    for node in reversed(order[1:]):
        up = node.parent
        up.size += node.size
        up.linked += node.linked
        up.kids += node.kids
        up.words += node.words
    total = max(order[0].size, 1)
    rows, above, place = [], {0: (0, False, frozenset())}, {}
    for node in order:
        for j, c in enumerate(node.children):
            place[c.index] = (j, len(node.children))
    before = 0
    for node in order[1:]:
        depth, good, groups = above[node.parent.index]
        own = frozenset(node.groups)
        above[node.index] = (depth + 1, good or node.good or node.tag in ("article", "main"), groups | own | ({node.tag} & {"nav", "header", "footer", "aside", "form", "dialog", "menu"}))
        j, many = place[node.index]
        size = max(node.size, 1)
        biggest = max((c.size for c in node.parent.children), default=1)
        tag = "#text" if node.tag == "#text" else node.tag if node.tag in TAGS else "h" if re.fullmatch("h[1-6]", node.tag) else "other"
        rows.append(
            [
                *(tag == t for t in TAGS), tag == "h", node.good, *(g in own for g in GROUPS), good, *(g in groups for g in GROUPS), *(t in groups for t in ("nav", "header", "footer", "aside", "form")),
                depth + 1, j, many, j / max(many - 1, 1), np.log1p(node.size), node.size / total, node.linked / size, np.log1p(node.kids), np.log1p(node.size / node.kids), node.size / max(biggest, 1), np.log1p(node.words), np.log1p(node.parent.size), node.parent.linked / max(node.parent.size, 1), before / total,
            ]
        )
        before += 0 if node.children else node.size
    return np.array(rows, dtype=np.float32) if rows else np.zeros((0, 0), dtype=np.float32)


class Boosted:
    """Gradient-boosted regression trees on logistic loss, with quantile thresholds."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, least: float = 1.0, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.l2 = rounds, depth, rate, least, l2
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 24))) for c in x.T]
        cuts = [np.unique(np.concatenate([c, [0.5]])) if set(np.unique(col)) <= {0.0, 1.0} else c for c, col in zip(cuts, x.T, strict=True)]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
        f = np.zeros(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            at = np.zeros(len(y), dtype=np.int64)
            levels = []
            for d in range(self.depth):
                width = 1 << d
                feature, cut = np.zeros(width, np.int64), np.full(width, np.inf)
                best = np.full(width, 1e-6)
                for j, c in enumerate(cuts):
                    b = len(c) + 1
                    gs = np.bincount(at * b + binned[:, j], weights=g, minlength=width * b).reshape(width, b)
                    hs = np.bincount(at * b + binned[:, j], weights=h, minlength=width * b).reshape(width, b)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain = np.where((hl >= self.least) & (ht - hl >= self.least), gain, 0)
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better], feature[better], cut[better] = top[better], j, c[k[better]]
                levels.append((feature, cut))
                at = at * 2 + (x[np.arange(len(y)), feature[at]] > cut[at])
            leaf = -np.bincount(at, weights=g, minlength=1 << self.depth) / (np.bincount(at, weights=h, minlength=1 << self.depth) + self.l2)
            self.trees.append((levels, leaf * self.rate))
            f += leaf[at] * self.rate
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        f, all_rows = np.zeros(len(x)), np.arange(len(x))
        for levels, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for feature, cut in levels:
                at = at * 2 + (x[all_rows, feature[at]] > cut[at])
            f += leaf[at]
        return f


def examples(pages: int = 400, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Training pages (html, main blocks) of many layouts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9)))
    say = lambda lo, hi: " ".join(word() for _ in range(rnd.randint(lo, hi))).capitalize() + rnd.choice([".", ".", "", "!"])
    link = lambda: f'<a href="/{word()}">{say(1, 3)}</a>'
    out = []
    for _ in range(pages):
        main: list[str] = []

        def block(tag: str, s: str, into: list[str] = main) -> str:
            into.append(s)
            return f"<{tag}>{s}</{tag}>"

        def menu() -> str:
            tag = rnd.choice(["<nav>{}</nav>", '<div class="nav">{}</div>', '<div id="menu">{}</div>', '<div class="breadcrumbs">{}</div>', '<nav class="main-menu">{}</nav>', '<nav role="navigation">{}</nav>'])
            return tag.format(rnd.choice(["<ul>{}</ul>", "{}"]).format("".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 9)))))

        def junk() -> str:
            few = "".join(f"<p>{say(3, 40)}</p>" for _ in range(rnd.randint(1, 4)))
            links = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 8))) + "</ul>"
            comments = "".join(f'<div class="comment"><h4>{say(1, 2)}</h4><p>{say(4, 60)}</p></div>' for _ in range(rnd.randint(1, 6)))
            comment_list = "<ol>" + "".join(f"<li><p>{say(4, 60)}</p></li>" for _ in range(rnd.randint(1, 6))) + "</ol>"
            return rnd.choice(
                [
                    f'<div class="{rnd.choice(["ads", "advert", "sponsored", "promo", "top-advert", "advertisement"])}">{rnd.choice([say(3, 30), few])}</div>',
                    f'<aside{rnd.choice(["", " class=sidebar"])}><h3>{say(1, 3)}</h3>{rnd.choice([links, few])}</aside>',
                    f'<div class="{rnd.choice(["sidebar", "related", "widget", "side", "popular-posts", "recommended"])}"><h3>{say(1, 3)}</h3>{rnd.choice([links, few])}</div>',
                    f'<div class="{rnd.choice(["cookie-notice", "cookie", "notice", "consent", "gdpr-banner", "alert", "popup"])}">{rnd.choice([say(5, 30), few])}<button>ok</button></div>',
                    f"<form{rnd.choice(['', ' class=newsletter', ' id=search'])}><label>{say(1, 4)}</label><input><p>{say(3, 20)}</p><button>{say(1, 2)}</button></form>",
                    f'<{(t := rnd.choice(["section", "div"]))} {rnd.choice(["class", "id"])}="{rnd.choice(["comments", "reader-comments", "discussion", "responses comments", "comment-list"])}"><h2>{say(1, 3)}</h2>{rnd.choice([comments, comment_list, few])}</{t}>',
                    f'<div class="{rnd.choice(["share", "social", "tags", "newsletter", "subscribe"])}">{rnd.choice([links, say(2, 12)])}</div>',
                    f'<section class="{rnd.choice(["newsletter", "related-posts", "comments"])}"><h2>{say(1, 3)}</h2>{rnd.choice([few, links])}</section>',
                    f"<dialog><p>{say(3, 20)}</p></dialog>",
                ]
            )

        head = f"<header{rnd.choice(['', ' class=masthead'])}><h1>{say(1, 4)}</h1>{rnd.choice([menu(), ''])}<p>{say(2, 10)}</p></header>" if rnd.random() < 0.4 else ""
        parts = []
        if rnd.random() < 0.9:
            parts.append(block("h1", say(1, 12)))
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = rnd.random()
            long = rnd.choice([6, 20, 60, 150])
            if kind < 0.08:
                parts.append("<ul>" + "".join(block("li", say(1, 14)) for _ in range(rnd.randint(2, 6))) + "</ul>")
            elif kind < 0.13:
                parts.append(block(rnd.choice(["h2", "h3"]), say(1, 8)))
            elif kind < 0.17:
                parts.append("<blockquote>" + block("p", say(3, 50)) + "</blockquote>")
            elif kind < 0.2:
                parts.append("<table><tr>" + "".join(block("td", say(1, 5)) for _ in range(4)) + "</tr></table>")
            elif kind < 0.23:
                parts.append(block("pre", say(3, 30)))
            elif kind < 0.27:
                parts.append(block("div", say(5, long)))
            else:
                s = say(1, long)
                main.append(s)
                parts.append(rnd.choice([f"<p>{s}</p>", f"<p><em>{s}</em></p>", f"<p>{s}"]))
            if rnd.random() < 0.08:
                parts.append(junk())
        body = "".join(parts)
        article = rnd.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main"><article>{}</article></div>', '<div class="post-body">{}</div>', '<main><div class="entry">{}</div></main>', '<article class="post">{}</article>', '<div class="wrap"><section class="article">{}</section></div>', "<div>{}</div>"]).format(body)
        pre = [menu() if rnd.random() < 0.8 else "", head, *(junk() for _ in range(rnd.choice([0, 1, 1, 2])))]
        post = [*(junk() for _ in range(rnd.choice([0, 1, 1, 2, 3]))), rnd.choice(["", f"<footer>{say(2, 14)}</footer>", f"<footer>{say(1, 3)} | {say(2, 20)}</footer>", f'<div class="footer"><p>{say(2, 14)}</p>{link()}</div>', f"<footer><ul><li>{link()}</li><li>{link()}</li></ul><p>{say(2, 10)}</p></footer>"])]
        rnd.shuffle(pre)
        page = "".join(pre) + article + "".join(post)
        page = rnd.choice(["{}", '<div class="container">{}</div>', '<div id="page">{}</div>', "<div>{}</div>"]).format(page)
        out.append((f"<!DOCTYPE html><html><head><title>{say(1, 5)}</title></head><body>{page}</body></html>", main))
    return out


def _text(node: Node) -> str:
    return _SPACE.sub(" ", entities.unescape("".join(s for s, _ in node.pieces))).strip()


@functools.lru_cache(1)
def trained() -> Boosted:
    """Trees learned from examples(); a node is main if it holds more main than other text."""
    xs, ys = [], []
    for source, main in examples():
        left: dict[str, int] = {}
        for s in main:
            left[s] = left.get(s, 0) + 1
        root, order = parse(source)
        x = measure(order)
        good, whole = np.zeros(len(order)), np.zeros(len(order))
        for node in order:
            s = _text(node)
            if s:
                whole[node.index] = len(s)
                if left.get(s, 0):
                    left[s] -= 1
                    good[node.index] = len(s)
        for node in reversed(order[1:]):
            good[node.parent.index] += good[node.index]
            whole[node.parent.index] += whole[node.index]
        some = whole[1:] > 0
        xs.append(x[some])
        ys.append((good[1:] * 2 > whole[1:])[some])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def decode(order: list[Node], logit: np.ndarray) -> list[bool]:
    """Kept nodes: the labelling of greatest log-likelihood in which all below a dropped node is dropped."""
    keep = -np.logaddexp(0, -logit)
    drop = -np.logaddexp(0, logit)
    best, none = [0.0, *keep.tolist()], [0.0, *drop.tolist()]
    for node in reversed(order[1:]):
        up = node.parent.index
        best[up] += max(best[node.index], none[node.index])
        none[up] += none[node.index]
    kept = [True] * len(order)
    for node in order[1:]:
        kept[node.index] = kept[node.parent.index] and best[node.index] >= none[node.index]
    return kept


def main_texts(sources: list[str | None], model: Boosted) -> list[str]:
    trees, rows = [], []
    for source in sources:
        _, order = parse(source or "")
        trees.append(order)
        rows.append(measure(order))
    some = [r for r in rows if len(r)]
    logit = model.logit(np.concatenate(some)) if some else np.zeros(0)
    out, at = [], 0
    for order, x in zip(trees, rows, strict=True):
        own = logit[at : at + len(x)]
        at += len(x)
        if len(order) == 2 and order[1].tag == "#text":
            kept = [True, True]
        else:
            kept = decode(order, own)
        blocks = (_text(node) for node in order if kept[node.index] and node.pieces)
        out.append("\n\n".join(b for b in blocks if b))
    return out


def _extract(held):
    def run(batches):
        model = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    held = pages.sparkSession.sparkContext.broadcast(trained())
    base = pages.selectExpr(f"cast(`{key}` as bigint) page_id", f"cast(`{url}` as string) url", f"cast(`{html}` as string) html")
    return base.mapInArrow(_extract(held), "page_id long, url string, text string, n_chars long")


def op10(pages: DataFrame) -> DataFrame:
    return extract(pages)
