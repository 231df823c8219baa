"""Main text of web pages by gradient-boosted trees over DOM-node features, decoded along the tree.

A forgiving parser turns a page into block nodes (inline markup belongs to the block it is in). Each node has
features: its tag and attribute tokens and those above it, depth, place among its siblings and on the page, link
share, punctuation, and the text density of its subtree. Boosted trees give the probability that a node belongs to
the article. Decoding chooses the best consistent labels: a path from the root is outside, then inside, then cut
out again (an advert in an article), never inside below a cut; the choice maximises the log-likelihood by dynamic
programming over the tree.

The trees are trained here, on pages made by a seeded generator of templates (``training_pages`` of them).

Defined cases: a null or empty html has an empty text, an empty table an empty result. A page without any likely
article has an empty text. Tags cut off at the end are dropped; unclosed elements end with the page. White space is
any Unicode white space, ``<br>`` included. Text of other elements than scripts, styles, form fields and what no
browser shows stays (formulas, fallbacks, drawings). Very long and very deep pages are judged whole, in time and
memory of their own size. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetta.llm.common import by_batch

BLOCK_TAGS = (
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption blockquote pre figure figcaption "
    "nav header footer aside form fieldset legend label button menu address details summary dialog center hr"
).split()
CODE = {t: i for i, t in enumerate(BLOCK_TAGS)}
#: Elements whose whole content is no text of the page: scripts, styles, what no browser shows, parts of forms, the title.
RAW = "script|style|template|iframe|noembed|noframes|textarea|select|title"
TOKEN = re.compile(
    rf"<(?:!--.*?(?:-->|\Z)|(?P<raw>{RAW})\b(?>[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?/][^>]*>|[a-z!/?][^<>]*\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop|data-main|data-cut)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: What a new element closes, up to the nearest of the barriers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Attribute tokens by what they tell; matched as whole parts of class, id, role and itemprop.
KINDS = {
    "body": "article content post entry story body main text prose articlebody page column maincontent singlepost",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar sitemap links toc",
    "head": "header masthead banner top topbar logo brand hero site",
    "foot": "footer bottom copyright legal colophon imprint credits contentinfo",
    "side": "sidebar side aside widget rail complementary related recommended recommendations popular trending more teaser",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted adsense outbrain taboola",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay disclaimer warning newsletter subscribe subscription paywall message",
    "form": "form search login signup register contact input field",
    "talk": "comment comments commentlist reply replies respond discussion disqus reviews feedback reader",
    "share": "share sharing social follow tags tag meta byline author date",
}
TOKEN_KIND = {t: i for i, words in enumerate(KINDS.values()) for t in words.split()}
N_KINDS, N_TAGS = len(KINDS), len(BLOCK_TAGS)
ABOVE = [CODE[t] for t in ("nav", "header", "footer", "aside", "form", "article", "main", "ul", "ol", "table", "blockquote")]


@dataclass
class Page:
    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def kinds_of(attrs: str) -> tuple[int, int]:
    """Bit set of attribute kinds; training marks."""
    bits = marks = 0
    for name, *values in ATTR.findall(attrs):
        name = name.lower()
        if name == "data-main":
            marks |= 1
        elif name == "data-cut":
            marks |= 2
        else:
            value = next((v for v in values if v), "")
            for token in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
                if token in TOKEN_KIND:
                    bits |= 1 << TOKEN_KIND[token]
    return bits, marks


def parse(source: str) -> Page:
    """Block nodes in page order, and text blocks with their node and length of linked text."""
    page = Page([CODE["html"]], [-1], [0], [0])
    stack, names = [0], ["html"]
    places: dict[str, list[int]] = {}  # of the open elements of a tag, outermost first
    words: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush():
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                page.owner.append(stack[-1])
                page.text.append(text)
                page.linked.append(min(linked, len(text)))
            words.clear()
            linked = 0

    def pop_to(i: int):
        for name in names[i:]:
            places[name].pop()
        del stack[i:], names[i:]

    def last(tags) -> int:
        """Where the innermost open element of some tags is; 0 without one."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def add(piece: str):
        nonlocal linked
        if "&" in piece:
            piece = entities.unescape(piece)
        words.append(piece)
        if in_link:
            linked += len(piece.strip())

    for m in TOKEN.finditer(source):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                words.append(" ")
            continue
        tag = tag.lower()
        if tag in CODE:
            flush()
            if m["end"]:
                if places.get(tag):
                    pop_to(last((tag,)))
                if tag != "p":
                    in_link = 0
                continue
            if tag == "html" or tag == "body" and places.get("body"):
                continue
            if names[-1] == "p":
                pop_to(len(names) - 1)
            if tag in CLOSES:
                closed, barrier = map(last, CLOSES[tag])
                if closed > barrier:
                    pop_to(closed)
            if tag == "hr":
                continue
            bits, marks = kinds_of(m["attrs"]) if m["attrs"] else (0, 0)
            page.tag.append(CODE[tag])
            page.parent.append(stack[-1])
            page.kinds.append(bits)
            page.marks.append(marks)
            places.setdefault(tag, []).append(len(stack))
            stack.append(len(page.tag) - 1)
            names.append(tag)
        elif tag == "a":
            in_link = 0 if m["end"] else 1
        elif tag in ("br", "img", "input", "option"):
            words.append(" ")
    if at < len(source):
        add(source[at:])
    flush()
    return page


NUMERIC = 24
WIDTH = N_TAGS + 3 * N_KINDS + len(ABOVE) + NUMERIC


def features(page: Page) -> np.ndarray:
    """(nodes, WIDTH) of float32."""
    n = len(page.tag)
    tag, parent = np.array(page.tag), np.array(page.parent)
    own, link, marks, commas, count, first = (np.zeros(n) for _ in range(6))
    first[:] = -1
    seen = 0.0
    for node, text, linked in zip(page.owner, page.text, page.linked):
        own[node] += len(text)
        link[node] += linked
        marks[node] += text.count(". ") + text.count("? ") + text.count("! ") + (text[-1] in ".!?")
        commas[node] += text.count(",")
        count[node] += text.count(" ") + 1
        if first[node] < 0:
            first[node] = seen
        seen += len(text)
    total = max(seen, 1.0)
    sub, sublink, submarks, subwords, size, paras = own.copy(), link.copy(), marks.copy(), count.copy(), np.ones(n), (tag == CODE["p"]).astype(float)
    depth, place, last = np.zeros(n), np.zeros(n), np.zeros(n, int)
    children, sums, same = np.zeros(n), np.zeros(n), np.zeros(n)
    above_tag, above_kind = [0] * n, [0] * n
    tags, parents = page.tag, page.parent
    for i in range(1, n):
        p = parents[i]
        depth[i] = depth[p] + 1
        place[i] = children[p]
        children[p] += 1
        above_tag[i] = above_tag[p] | 1 << tags[p]
        above_kind[i] = above_kind[p] | page.kinds[p]
        same[i] = tags[last[p]] == tags[i] if last[p] else 0
        last[p] = i
    for i in range(n - 1, 0, -1):
        p = parents[i]
        for x in (sub, sublink, submarks, subwords, size, paras):
            x[p] += x[i]
        sums[p] += sub[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    up = np.maximum(parent, 0)
    siblings = children[up]
    around = np.maximum(sums[up] - sub, 0) / np.maximum(siblings - 1, 1)
    out = np.zeros((n, WIDTH), np.float32)
    out[np.arange(n), tag] = 1
    bit = 1 << np.arange(N_KINDS)
    own_kind, over, mother = np.array(page.kinds), np.array(above_kind), np.array(page.kinds)[up] * (parent >= 0)
    at = N_TAGS
    for x in (own_kind, over, mother):
        out[:, at : at + N_KINDS] = (x[:, None] & bit) > 0
        at += N_KINDS
    over_tag = np.array(above_tag, dtype=np.int64)
    out[:, at : at + len(ABOVE)] = (over_tag[:, None] >> np.array(ABOVE)) & 1
    at += len(ABOVE)
    safe = np.maximum(sub, 1)
    numeric = (
        np.log1p(own), np.log1p(sub), link / np.maximum(own, 1), sublink / safe, submarks / safe * 100, marks, commas / np.maximum(own, 1) * 100,
        np.log1p(subwords), sub / size, np.log1p(size), depth, place, siblings, place / np.maximum(siblings, 1), same, children, np.log1p(around),
        np.log1p(paras), sub / total, np.maximum(first, 0) / total, sub / np.maximum(subwords, 1), np.log1p(sub[up]), sublink[up] / np.maximum(sub[up], 1), np.log1p(paras[up]),
    )
    out[:, at:] = np.stack(numeric, axis=1)
    return out


@dataclass(frozen=True)
class Boosted:
    """Trees of one depth as arrays: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Boosted:
    """Histogram boosting of the logistic loss; ties go to the first feature, so reruns agree."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int64)
    flat = code + np.arange(width) * bins
    p = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    margin = np.full(n, start)
    inner = 2**depth - 1
    features_, thresholds, values = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = (y - q) * weight, q * (1 - q) * weight
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            base = 2**level - 1
            for node in range(base, 2 * base + 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 20:
                    continue
                cells = flat[rows].ravel()
                gs = np.bincount(cells, np.repeat(g[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(cells, np.repeat(h[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
                ga, ha = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                j, b = divmod(int(np.argmax(gain)), bins)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    f[node], t[node] = j, edges[j][b]
            right = x[np.arange(n), f[at]] > t[at]
            at = 2 * at + 1 + right
        leaf = at - inner
        v = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += v[leaf]
        features_.append(f)
        thresholds.append(t)
        values.append(v)
    return Boosted(np.array(features_), np.array(thresholds), np.array(values), start, depth)


SYLLABLES = "the an er on re ha in ou ti st or ent ing con ver de la es ra men te cion ge ein sch ich le que ai pa tre un ed ly is wh at".split()


class Writer:
    """Makes pages of varied templates; the article's root has data-main, parts to cut have data-cut."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, least: int = 3, most: int = 22) -> str:
        words = [self.word() + ("," if self.r.random() < 0.1 else "") for _ in range(self.r.randint(least, most))]
        return " ".join(words).capitalize().rstrip(",") + self.r.choice("....?!")

    def prose(self, most: int = 9) -> str:
        return " ".join(self.sentence(self.r.choice((1, 3, 3)), self.r.choice((4, 12, 22))) for _ in range(self.r.randint(1, most)))

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, 4)))}</a></{tag}>' for _ in range(n))

    def name(self, kind: str, chance: float = 0.85) -> str:
        r = self.r
        token = r.choice(KINDS[kind].split()) if r.random() < chance else self.word()
        more = r.choice(("", "", f"{self.word()} ", f"{self.word()}-"))
        return f' {r.choice(("class", "class", "id"))}="{more}{token}{r.choice(("", "", "-1", "-box", "_inner", " wrap"))}"'

    def boilerplate(self, kind: str) -> str:
        r, cut = self.r, ' data-cut="1"'
        if kind == "menu":
            tag = r.choice(("nav", "nav", "div", "ul"))
            inner = self.links(r.randint(3, 14))
            return f"<{tag}{self.name('menu') if tag != 'nav' or r.random() < 0.4 else ''}{cut}>{inner if tag == 'ul' else f'<ul>{inner}</ul>'}</{tag}>"
        if kind == "head":
            tag = r.choice(("header", "div"))
            title = r.choice((f"<h1>{self.sentence(1, 4)}</h1>", f"<p>{self.sentence(1, 8)}</p>", f'<div><a href="/">{self.word()}</a></div>'))
            return f"<{tag}{self.name('head') if tag == 'div' or r.random() < 0.5 else ''}{cut}>{title}{r.choice(('', f'<p>{self.sentence()}</p>'))}</{tag}>"
        if kind == "foot":
            tag = r.choice(("footer", "footer", "div"))
            inner = r.choice((f"&copy; {self.word()} &middot; {self.sentence()}", f"<p>{self.prose(3)}</p><ul>{self.links(4)}</ul>", f"<p>{self.prose(2)}</p>"))
            return f"<{tag}{self.name('foot') if tag == 'div' or r.random() < 0.3 else ''}{cut}>{inner}</{tag}>"
        if kind == "side":
            tag = r.choice(("aside", "aside", "div", "section"))
            inner = "".join(f"<h3>{self.sentence(1, 5)}</h3>" + r.choice((f"<ul>{self.links(r.randint(2, 8))}</ul>", f"<p>{self.prose(3)}</p>")) for _ in range(r.randint(1, 3)))
            return f"<{tag}{self.name('side', 0.95) if tag != 'aside' or r.random() < 0.4 else ''}{cut}>{inner}</{tag}>"
        if kind == "form":
            fields = "".join(f"<label>{self.sentence(1, 3)}</label><input>" for _ in range(r.randint(1, 4)))
            return f"<form{self.name('form') if r.random() < 0.4 else ''}{cut}>{r.choice(('', f'<p>{self.prose(2)}</p>'))}{fields}<button>{self.word()}</button></form>"
        if kind == "talk":
            tag = r.choice(("div", "section", "ol", "aside"))
            item = "li" if tag == "ol" else r.choice(("div", "article", "p"))
            items = "".join(f"<{item}{self.name('talk', 1) if r.random() < 0.6 else ''}>" + (f"<b>{self.word()}</b> {self.prose(5)}" if item == "p" or r.random() < 0.5 else f"<p>{self.word()}</p><p>{self.prose(6)}</p>") + f"</{item}>" for _ in range(r.randint(1, 6)))
            return f"<{tag}{self.name('talk', 1)}{cut}>{r.choice(('', f'<h3>{self.sentence(1, 3)}</h3>')) if tag != 'ol' else ''}{items}</{tag}>"
        tag = r.choice(("div", "div", "p", "section", "aside"))
        inner = self.prose(r.choice((1, 2, 4))) if tag == "p" or r.random() < 0.6 else f"<p>{self.prose(3)}</p>"
        return f"<{tag}{self.name(kind, 1)}{cut}>{inner}</{tag}>"

    def article(self) -> str:
        r = self.r
        parts = [f"<h1>{self.sentence(1, 9)}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.25:
            parts.append(f"<h2>{self.sentence(2, 9)}</h2>")
        loose = r.random() < 0.25
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14, 30))):
            kind = r.random()
            if kind < 0.72:
                parts.append(f"<p>{self.prose()}" + ("" if loose else "</p>"))
            elif kind < 0.78:
                parts.append(f"<p><b>{self.prose(2)}<br>")
            elif kind < 0.84:
                parts.append(f"<h{r.choice('234')}>{self.sentence(1, 7)}</h{r.choice('234')}>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote><p>{self.prose(3)}</p></blockquote>")
            elif kind < 0.97:
                parts.append(f'<p>{self.prose(2)} <a href="/x">{self.sentence(2, 5)}</a> {self.prose(2)}</p>')
            else:
                parts.append(f"<table><tr><td>{self.word()}</td><td>{self.sentence()}</td></tr></table>")
        if r.random() < 0.35:
            parts.insert(r.randint(0, len(parts)), self.boilerplate(r.choice(("advert", "advert", "share", "notice", "side", "talk", "form"))))
        return "".join(parts) or f"<p>{self.prose()}</p>"

    def page(self) -> str:
        r = self.r
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        attrs = self.name("body", 0.9) if tag in ("div", "section") or r.random() < 0.3 else ""
        main = f'<{tag}{attrs} data-main="1">{self.article()}</{tag}>'
        before = [self.boilerplate(k) for k in ("head", "menu", "notice", "advert", "form", "side") if r.random() < 0.45]
        after = [self.boilerplate(k) for k in ("talk", "side", "advert", "form", "notice", "menu", "foot") if r.random() < 0.45]
        if r.random() < 0.5:
            r.shuffle(before)
        if r.random() < 0.35:
            near = r.randint(0, len(after))
            main = f"<{(w := r.choice(('main', 'div', 'div', 'section')))}{self.name('body', 0.5)}>{main}{''.join(after[:near])}</{w}>"
            after = after[near:]
        body = "".join(before) + main + "".join(after)
        if r.random() < 0.4:
            body = f"<div{self.name(r.choice(('body', 'head')), 0.3)}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><script>x('</p>')</script></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def truth(page: Page) -> np.ndarray:
    """1 for the nodes of the article."""
    y = np.zeros(len(page.tag))
    for i in range(1, len(y)):
        inside = y[page.parent[i]] > 0 or page.marks[i] & 1
        y[i] = bool(inside and not page.marks[i] & 2)
    return y


@lru_cache(maxsize=2)
def train(training_pages: int = 700, seed: int = 11) -> Boosted:
    writer = Writer(seed)
    pages = [parse(writer.page()) for _ in range(training_pages)]
    x = np.concatenate([features(p) for p in pages])
    weights = [1 + np.sqrt(np.bincount(p.owner, [len(t) for t in p.text], len(p.tag))) / 8 for p in pages]
    return boost(x, np.concatenate([truth(p) for p in pages]), np.concatenate(weights))


#: Log-likelihood that a cut inside the article, and an article's beginning, must gain: both are few on a page.
CUT_COST, ENTER_COST = 1.5, 1.0


def decode(page: Page, margin: np.ndarray) -> list[int]:
    """1 for each node inside the article; along a path: outside, inside, cut."""
    n = len(page.tag)
    own = np.bincount(page.owner, [len(t) for t in page.text], n) if page.owner else np.zeros(n)
    weight = np.where(own > 0, 1 + np.sqrt(own) / 4, 0.25)
    inside = (-np.logaddexp(0, -margin) * weight).tolist()
    outside = (-np.logaddexp(0, margin) * weight).tolist()
    cut, within, above = outside.copy(), inside.copy(), outside.copy()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        cut[p] += cut[i]
        within[p] += max(within[i], cut[i] - CUT_COST)
        above[p] += max(above[i], within[i] - ENTER_COST)
    state = [0] * n  # 0 outside, 1 inside, 2 cut
    state[0] = 0 if above[0] >= within[0] else 1
    for i in range(1, n):
        up = state[page.parent[i]]
        state[i] = 2 if up == 2 else (1 if within[i] >= cut[i] - CUT_COST else 2) if up == 1 else (1 if within[i] - ENTER_COST > above[i] else 0)
    return [s == 1 for s in state]


def extract(sources: list[str | None], model: Boosted) -> list[str]:
    """The main texts of some pages; the trees run over all their nodes together."""
    pages = [parse(s) if s else None for s in sources]
    some = [p for p in pages if p is not None and p.text]
    if not some:
        return [""] * len(sources)
    margins = model.margin(np.concatenate([features(p) for p in some]))
    cuts = np.cumsum([0, *(len(p.tag) for p in some)])
    found = {}
    for p, a, b in zip(some, cuts[:-1], cuts[1:]):
        keep = decode(p, margins[a:b])
        found[id(p)] = "\n".join(t for node, t in zip(p.owner, p.text) if keep[node])
    return [found.get(id(p), "") if p is not None else "" for p in pages]


def main_texts(pages: DataFrame, model: Boosted | None = None, at_once: int = 128) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts: list[str] = []
        for i in range(0, batch.num_rows, at_once):
            texts += extract(batch.column(2).slice(i, at_once).to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return by_batch(pages.select("page_id", "url", "html"), one, "page_id long, url string, text string, n_chars long")
