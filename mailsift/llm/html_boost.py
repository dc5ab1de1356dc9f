"""Main text of web pages by gradient-boosted trees over DOM nodes and a consistent decoding of the tree.

The trees give every node the odds of belonging to the article, from the density of its subtree, learned weights of its tag
and attribute tokens, its depth and its siblings. The decoding then chooses the best labelling in which a node below
something removed is removed as well and everything above the article is outside: a sum over the tree, solved from the
leaves to the root, so that no node contradicts its ancestors or descendants.

Labels for training come from a bounded sample of the pages: the sampled pages themselves where they mark their article by
a tag, and pages composed from the sample's own paragraphs and short texts in layouts with and without such marks, with menus,
notices, adverts, forms, sidebars and comments in many wordings.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm import dom
from mailsift.llm.common import batched

SAMPLE_PAGES = 256  # expected number of pages that training sees, of any number of pages; at most twice as many
SAMPLE_CHARS = 1 << 17  # longer pages are not used for training
COMPOSED = 400  # pages composed from the texts of the sample
ROUNDS, LEAVES, RATE, L2, BINS, LEAST_NODES = 60, 16, 0.2, 1.0, 48, 12
BATCH_CHARS = 2 << 20

# --- words by which layouts name their parts -----------------------------------------
MAIN_NAMES = ("content article post entry story main body text post-content entry-content article-body story-body main-content "
              "page-content post-body articleBody rich-text prose single-post news-item markdown-body content-body").split()
NEUTRAL_NAMES = ("container wrapper row col inner box grid section block module layout page site app root left right center top clearfix "
                 "widget-area primary secondary wrap outer flex item card panel region area").split()
ASIDE_NAMES = {
    "menu": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs pagination pager tabs toc site-nav skip-links "
            "menu-item nav-links submenu".split(),
    "header": "header masthead site-header banner topbar branding logo tagline page-header".split(),
    "footer": "footer site-footer copyright colophon legal bottom credits footer-links".split(),
    "sidebar": "sidebar aside widget related recommended most-read popular teaser trending more-stories side-column archive tags tag-cloud "
               "see-also related-posts recirculation".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert warning popup modal overlay paywall subscribe-notice cookies disclaimer "
              "message announcement toast privacy".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsbox ad-slot google-ad dfp outbrain taboola "
              "affiliate commercial partner".split(),
    "form": "form newsletter signup subscribe login search search-form contact-form subscription register poll survey".split(),
    "comments": "comments comment comment-list comments-area comment-body discussion reply replies respond disqus comment-content user-comments "
                "reader-comments feedback responses".split(),
    "share": "share social sharing share-buttons social-links follow likes print author-box byline-links".split(),
}
TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"],
        "notice": ["div", "section", "aside", "p", "dialog"], "advert": ["div", "aside", "ins", "section"], "form": ["form", "div", "section"],
        "comments": ["section", "div", "ol", "aside"], "share": ["div", "ul", "aside"]}


@dataclass
class Tree:
    """Splits ``x[feature] <= threshold`` as arrays; leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.feature) - 1


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, leaves: int = LEAVES) -> tuple[float, list[Tree]]:
    """Prior log-odds and trees grown leaf by leaf on histograms of the logistic loss."""
    p = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 0.01, 0.99)
    prior = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return prior, []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)])
    flat = bins + np.arange(x.shape[1]) * (BINS + 1)
    size = x.shape[1] * (BINS + 1)
    margin, trees = np.full(len(y), prior), []

    def histogram(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(flat[rows].ravel(), np.repeat(values[rows], x.shape[1]), size).reshape(x.shape[1], -1)

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = weight * (q - y), weight * q * (1 - q)
        tree = Tree()

        def best(rows: np.ndarray):
            """(gain, feature, bin) of a leaf's best split."""
            sums = [histogram(rows, v).cumsum(1) for v in (g, h, np.ones(len(y)))]
            gl, hl, nl = (s[:, :-1] for s in sums)
            gt, ht, nt = (s[0, -1] for s in sums)
            gain = gl ** 2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt ** 2 / (ht + L2)
            gain[(nl < LEAST_NODES) | (nt - nl < LEAST_NODES)] = -1
            k = int(np.argmax(gain))
            return float(gain.flat[k]), k // gain.shape[1], k % gain.shape[1]

        def leaf(rows: np.ndarray) -> int:
            return tree.add(float(-RATE * g[rows].sum() / (h[rows].sum() + L2)))

        everything = np.arange(len(y))
        open_leaves = [(best(everything), leaf(everything), everything)]
        done = []
        while open_leaves and len(open_leaves) + len(done) < leaves:
            k = max(range(len(open_leaves)), key=lambda i: open_leaves[i][0][0])
            (gain, f, b), at, rows = open_leaves.pop(k)
            if gain <= 1e-6:
                done.append((at, rows))
                continue
            lower = bins[rows, f] <= b
            tree.feature[at], tree.threshold[at] = f, float(cuts[f][b]) if b < len(cuts[f]) else np.inf
            sides = [rows[lower], rows[~lower]]
            tree.left[at], tree.right[at] = leaf(sides[0]), leaf(sides[1])
            open_leaves += [(best(r), i, r) for r, i in zip(sides, (tree.left[at], tree.right[at]))]
        for at, rows in [*done, *((i, r) for _, i, r in open_leaves)]:
            margin[rows] += tree.value[at]
        trees.append(tree)
    return prior, trees


class Forest:
    """All trees side by side, so that one walk scores every node by every tree."""

    def __init__(self, prior: float, trees: list[Tree]):
        self.prior, self.n = prior, len(trees)
        start = np.cumsum([0, *[len(t.feature) for t in trees]])
        self.roots = start[:-1]
        join = lambda name, kind, shift: np.concatenate(
            [np.array(getattr(t, name), kind) + (s if shift else 0) for t, s in zip(trees, start)]) if trees else np.zeros(0, kind)
        self.feature, self.threshold, self.value = join("feature", int, 0), join("threshold", float, 0), join("value", float, 0)
        own = np.arange(len(self.feature))
        inner = self.feature >= 0
        self.left = np.where(inner, join("left", int, 1), own)
        self.right = np.where(inner, join("right", int, 1), own)
        self.feature = np.where(inner, self.feature, 0)
        self.depth = 0
        todo = [(int(r), 0) for r in self.roots]
        while todo:
            i, d = todo.pop()
            self.depth = max(self.depth, d)
            if inner[i]:
                todo += [(int(self.left[i]), d + 1), (int(self.right[i]), d + 1)]

    def margins(self, x: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at:at + 4096]
            rows = np.arange(len(part))[:, None]
            place = np.broadcast_to(self.roots, (len(part), self.n))
            for _ in range(self.depth):
                place = np.where(part[rows, self.feature[place]] <= self.threshold[place], self.left[place], self.right[place])
            out[at:at + 4096] = self.prior + self.value[place].sum(1)
        return out


def decode(page: dom.Page, margins: np.ndarray) -> np.ndarray:
    """Nodes of the article. Outside is followed by outside or article, article by article or removed, removed by removed."""
    n = len(page.tag)
    own = [0] * n
    for m in page.measures:
        own[m[0]] += m[1]
    score = (margins * (1 + np.sqrt(own))).tolist()
    inside, outside = score, [0.0] * n
    parent = page.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if inside[i] > 0:
            inside[p] += inside[i]
        outside[p] += max(outside[i], inside[i])
    kept = np.zeros(n, bool)
    state = [0] * n  # 0 outside, 1 article, 2 removed
    for i in range(n):
        above = state[parent[i]] if i else 0
        if above == 0:
            state[i] = 1 if inside[i] > outside[i] else 0
        else:
            state[i] = 1 if above == 1 and inside[i] > 0 else 2
        kept[i] = state[i] == 1
    return kept


# --- training pages -------------------------------------------------------------------

def marks(page: dom.Page) -> np.ndarray | None:
    """1 for nodes of the article, 0 for others, by the marks of composed pages or else by telling tags; None without any."""
    n = len(page.tag)
    marked = any(m is not None for m in page.mark)
    label = [0] * n
    found = False
    for i in range(1, n):
        above = label[page.parent[i]]
        if marked:
            label[i] = above if page.mark[i] is None else int(page.mark[i])
        elif page.tag[i] == "article" or "articlebody" in page.tokens[i]:
            label[i] = 1
        else:
            label[i] = 0 if page.tag[i] in ("nav", "aside", "footer", "form") else above
        found |= label[i] == 1
    return np.array(label) if found else None


def texts_of(page: dom.Page) -> tuple[list[str], list[str]]:
    """Paragraphs and short texts of a page."""
    label = marks(page)
    long, short = [], []
    for i, tag in enumerate(page.tag):
        if tag in ("p", "li", "a", "div", "footer", "h1", "h2"):
            inner = np.zeros(len(page.tag), bool)
            inner[i:page.end[i]] = True
            if not page.end[i] - i > 12:
                text = page.text(inner)
                if text and len(text) < 4000:
                    (long if tag == "p" and (label is None or label[i]) else short).append(text)
    return long, short


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class Composer:
    """Pages in varied layouts with known articles, from given texts."""

    def __init__(self, paragraphs: list[str], shorts: list[str], seed: int):
        self.r = random.Random(seed)
        filler = ["Some words that stand for a paragraph of text, with a comma and an end."]
        self.paragraphs, self.shorts = paragraphs or filler, shorts or ["Short"]

    def words(self, low: int, high: int) -> str:
        words = self.r.choice(self.paragraphs).split() or ["word"]
        n = self.r.randint(low, high)
        at = self.r.randrange(max(len(words) - n, 1))
        return escape(" ".join(words[at:at + n]))

    def short(self) -> str:
        return escape(" ".join(self.r.choice(self.shorts).split()[:self.r.randint(1, 4)]) or "Go")

    def names(self, own: list[str], share: float = 0.85) -> str:
        """Attributes that tell the part, or neutral ones, or none."""
        r = self.r
        if r.random() > share:
            own = NEUTRAL_NAMES if r.random() < 0.6 else []
        if not own:
            return f' class="c{r.randrange(16 ** 5):05x}"' if r.random() < 0.4 else ""
        chosen = [r.choice(own)]
        if r.random() < 0.3:
            chosen.append(r.choice(NEUTRAL_NAMES))
        if r.random() < 0.2:
            chosen.append(f"x{r.randrange(16 ** 4):04x}")
        return f' {r.choice(["class"] * 4 + ["id"])}="{" ".join(chosen)}"'

    def links(self, n: int) -> str:
        item = [f'<a href="/{k}">{self.short()}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in item) + "</ul>" if self.r.random() < 0.7 else " | ".join(item)

    def aside(self, part: str) -> str:
        """One part that isn't article."""
        r = self.r
        tag = r.choice(TAGS[part])
        telling = tag not in ("div", "section", "p", "ul", "ol")
        attributes = ' data-y="0"' + self.names(ASIDE_NAMES[part], 0.5 if telling else 0.93)
        if tag == "ul":
            return f"<ul{attributes}>" + "".join(f'<li><a href="/{k}">{self.short()}</a></li>' for k in range(r.randint(2, 9))) + "</ul>"
        if part in ("menu", "share"):
            inner = self.links(r.randint(2, 10))
        elif part == "header":
            inner = f'<a href="/">{self.short()}</a>' + (f"<p>{self.words(2, 9)}</p>" if r.random() < 0.5 else "")
        elif part == "footer":
            inner = f"&copy; {self.short()} &middot; {self.words(3, 20)}" + (self.links(r.randint(2, 6)) if r.random() < 0.4 else "")
        elif part == "sidebar":
            inner = f"<h3>{self.short()}</h3>" + (self.links(r.randint(3, 8)) if r.random() < 0.6 else "".join(
                f'<div><a href="/{k}">{self.words(3, 9)}</a><p>{self.words(6, 30)}</p></div>' for k in range(r.randint(1, 4))))
        elif part in ("notice", "advert"):
            inner = self.words(3, 35)
            inner = inner if tag == "p" or r.random() < 0.5 else f"<p>{inner}</p>"
            inner += f'<a href="/x">{self.short()}</a>' if r.random() < 0.4 else ""
            inner += f"<button>{self.short()}</button>" if part == "notice" and r.random() < 0.5 else ""
        elif part == "form":
            inner = (f"<p>{self.words(3, 20)}</p>" if r.random() < 0.6 else "") + f"<label>{self.short()}</label><input name=q>"
            inner += f"<button>{self.short()}</button>" if r.random() < 0.8 else ""
        else:
            one = r.choice(ASIDE_NAMES["comments"])
            item = "li" if tag == "ol" else "div"
            inner = "".join(f'<{item} class="{one}"><b>{self.short()}</b><p>{self.words(4, 60)}</p></{item}>' for _ in range(r.randint(1, 5)))
            inner = (f"<h3>{self.short()}</h3>" if tag != "ol" and r.random() < 0.5 else "") + inner
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def article(self) -> str:
        r = self.r
        tag = r.choice(["article"] * 6 + ["main", "div", "div", "div", "section", ""])
        telling = tag in ("article", "main")
        attributes = self.names(MAIN_NAMES, 0.5 if telling else 0.8)
        blocks = [f"<h1>{self.words(3, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = r.random()
            text = escape(r.choice(self.paragraphs)) if r.random() < 0.5 else self.words(1, 60)
            if kind < 0.1:
                text = f"<b>{text}<br>"  # never closed
            elif kind < 0.2:
                text = f'<a href="/in">{self.short()}</a> {text}' if r.random() < 0.5 else f"<em>{text}</em> {self.words(1, 9)}"
            if kind > 0.93:
                blocks.append("<ul>" + "".join(f"<li>{self.words(2, 12)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind > 0.88:
                blocks.append(f"<h2>{self.words(2, 8)}</h2>")
            elif kind > 0.85:
                blocks.append(f"<blockquote>{text}</blockquote>")
            elif kind > 0.82:
                blocks.append(f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>")
            else:
                blocks.append(f"<p>{text}" + ("</p>" if r.random() < 0.9 else ""))
        for part in r.sample(["advert", "notice", "sidebar", "form", "comments", "share"], r.choice([0, 0, 0, 1, 1, 2])):
            blocks.insert(r.randrange(len(blocks) + 1) if part != "comments" else len(blocks), self.aside(part))
        if not tag:  # straight in the page
            return "".join(b if "data-y" in b else b.replace(">", ' data-y="1">', 1) for b in blocks)
        inner = "".join(blocks)
        if r.random() < 0.2:
            inner = f"<div{self.names(NEUTRAL_NAMES)}>{inner}</div>"
        return f'<{tag} data-y="1"{attributes}>{inner}</{tag}>'

    def page(self) -> str:
        r = self.r
        before = [self.aside(p) for p in ("menu", "header", "notice", "advert", "form") if r.random() < 0.4]
        after = [self.aside(p) for p in ("comments", "sidebar", "share", "advert", "form", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        inner = "".join([*before, self.article(), *after])
        if r.random() < 0.4:
            inner = f"<div{self.names(NEUTRAL_NAMES)}>{inner}</div>"
        return f"<html><head><title>{self.short()}</title></head><body>{inner}" + ("</body></html>" if r.random() < 0.9 else "")


@dataclass
class Model:
    odds: dict[str, float]
    forest: Forest

    def nodes(self, page: dom.Page) -> np.ndarray:
        return decode(page, self.forest.margins(dom.features(page, self.odds)))


def train(sources: list[str], composed: int = COMPOSED, seed: int = 11) -> Model:
    """From the html of sampled pages."""
    pages = [dom.Page(s) for s in sources]
    paragraphs, shorts = [], []
    for page in pages:
        long, short = texts_of(page)
        paragraphs += long
        shorts += short
    composer = Composer(paragraphs, shorts, seed)
    labelled = [(p, m) for p in pages if (m := marks(p)) is not None]
    labelled += [(p, m) for p in (dom.Page(composer.page()) for _ in range(composed)) if (m := marks(p)) is not None]
    counts: dict[str, list[int]] = {}
    for page, label in labelled:
        for tokens, y in zip(page.tokens, label.tolist()):
            for t in set(tokens):
                counts.setdefault(t, [0, 0])[y] += 1
    odds = {t: float(np.log((c[1] + 0.5) / (c[0] + 0.5))) for t, c in counts.items() if sum(c) > 1}
    x = [dom.features(page, odds) for page, _ in labelled]
    weight = []
    for page, _ in labelled:
        own = np.zeros(len(page.tag))
        for m in page.measures:
            own[m[0]] += m[1]
        weight.append(1 + np.log1p(own))
    if not x:
        return Model(odds, Forest(0.0, []))
    x, y, w = np.concatenate(x), np.concatenate([m for _, m in labelled]), np.concatenate(weight)
    return Model(odds, Forest(*boost(x, y, w)))


def sample(pages: DataFrame, html: str, key: str, expected: int = SAMPLE_PAGES) -> list[str]:
    """About ``expected`` pages by a hash of their key, whatever the number of pages: all of few."""
    usable = pages.select(F.col(html).alias("html"), F.xxhash64(key).alias("h")).filter(
        F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    n = usable.count()
    chosen = usable.filter(F.pmod("h", F.lit(max(n // expected, 1))) == 0).limit(2 * expected)
    return sorted(r["html"] for r in chosen.collect())


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", model: Model | None = None) -> DataFrame:
    """All columns of ``pages`` but the html, with ``text``, the main text (empty if there is none), and ``n_chars``.

    Null and empty html give an empty text. Existing columns ``text`` and ``n_chars`` are replaced. Every row is read alone and
    whole, so repeated rows give repeated results and an empty table gives none.
    """
    model = model or train(sample(pages, html, key))
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*[pages[c] for c in kept], F.coalesce(pages[html], F.lit("")).alias("_html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("_html").to_pylist()
            at = 0
            for group in batched(sources, [len(s) for s in sources], BATCH_CHARS):
                texts = list(texts_from(group, model))
                part = batch.slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*kept, "text", "n_chars"])

    schema = ", ".join([f"`{c}` {t}" for c, t in source.dtypes if c != "_html"] + ["text string", "n_chars long"])
    return source.mapInArrow(run, schema)


def texts_from(sources: list[str], model: Model) -> Iterator[str]:
    """Main texts of several pages, whose nodes are scored together."""
    pages = [dom.Page(s) for s in sources]
    margins = model.forest.margins(np.concatenate([dom.features(p, model.odds) for p in pages]))
    at = 0
    for page in pages:
        yield page.text(decode(page, margins[at:at + len(page.tag)]))
        at += len(page.tag)


