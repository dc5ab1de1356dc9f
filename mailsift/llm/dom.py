"""A forgiving reader of HTML: nodes in page order with their text, and numbers that describe them.

Unclosed and misplaced tags, missing ends and stray quotes are taken as browsers take them in the common cases: a new block ends
an open paragraph, list items and table cells end their like, scripts and styles hold raw text, comments are skipped. Reading
is linear in the length of the page.
"""

from __future__ import annotations

import html
import re

import numpy as np

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noembed noframes xmp svg math object canvas select".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("html body div section article main header footer nav aside form fieldset table tbody thead tfoot tr "
                 "td th ul ol dl figure details dialog address center hgroup menu search".split())
BLOCKS = CONTAINERS | HEADINGS | set("p li dt dd blockquote pre hr figcaption summary caption legend option button "
                                     "label head optgroup".split())
CONTROLS = set("input button select textarea label option".split())
#: A start tag ends the open element of these names, looked for up to one of the second names.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
        "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"),
        "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select"),
        "body": ("head", "html")}
ENDS = {k: (set(a.split()), set(b.split())) for k, (a, b) in ENDS.items()}
CLOSES_P = BLOCKS - set("button label option optgroup td th tr tbody thead tfoot body html head".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"\b(class|id|role|itemprop|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPLIT = re.compile(r"[^0-9a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}
_PUNCT = str.maketrans("", "", ".,;:!?")
_DIGITS = str.maketrans("", "", "0123456789")

#: Numbers of a text run: characters, punctuation marks, digits, words.
MEASURES = 4


class Page:
    """Nodes of one page in page order. ``end[i]`` is the number of the first node after the subtree of ``i``."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#page"]
        self.tokens: list[tuple[str, ...]] = [()]
        self.mark: list[str | None] = [None]  # the attribute data-y, by which training pages carry their labels
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.end: list[int] = [0]
        self.pieces: list[tuple[int, str]] = []  # (node, text), -1 for a break between blocks
        self.measures: list[tuple[int, int, int, int, int]] = []  # node and measures of a text run
        self._read(source)
        self.end = [e or len(self.tag) for e in self.end]

    def _read(self, source: str) -> None:
        stack = [0]
        at, n, strict = 0, len(source), True
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self._text(stack[-1], source[at:])
                break
            if lt > at:
                self._text(stack[-1], source[at:lt])
            if source.startswith("<!--", lt):
                close = source.find("-->", lt + 4)
                at = n if close < 0 else close + 3
                continue
            if source.startswith(("<!", "<?"), lt):
                close = source.find(">", lt)
                at = n if close < 0 else close + 1
                continue
            m = _TAG.match(source, lt) if strict else None
            if m is None:
                m = _LOOSE.match(source, lt)
                if m is None:
                    if source[lt + 1:lt + 2].isalpha() or source[lt + 1:lt + 2] == "/":
                        if source.find(">", lt) < 0:
                            break  # the page ends inside a tag
                    self._text(stack[-1], "<")
                    at = lt + 1
                    continue
                strict = False  # a quote never closes, so quotes tell nothing from here on
            at = m.end()
            name = m[2].lower()
            if m[1]:
                self._close(stack, name)
            else:
                at = self._open(stack, name, m[3], source, at)

    def _text(self, node: int, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append((node, text))
        n = len(text)
        if n and not text.isspace():
            self.measures.append((node, n, n - len(text.translate(_PUNCT)), n - len(text.translate(_DIGITS)), text.count(" ") + 1))

    def _pop_to(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self.end[node] = len(self.tag)
        del stack[k:]

    def _open(self, stack: list[int], name: str, attributes: str, source: str, at: int) -> int:
        if name in RAW:
            if not attributes.endswith("/"):
                close = _RAW_END[name].search(source, at)
                if close is None:
                    return len(source)
                gt = source.find(">", close.end())
                at = len(source) if gt < 0 else gt + 1
            return at
        block = name in BLOCKS
        if block or name == "br":
            self.pieces.append((-1, " "))
        if name in CLOSES_P:
            k = len(stack) - 1
            while k and self.tag[stack[k]] not in CONTAINERS:
                if self.tag[stack[k]] == "p":
                    self._pop_to(stack, k)
                    break
                k -= 1
        if name in ENDS:
            own, until = ENDS[name]
            k, found = len(stack) - 1, 0
            while k and self.tag[stack[k]] not in until:
                if self.tag[stack[k]] in own:
                    found = k
                k -= 1
            if found:
                self._pop_to(stack, found)
        if name in ("html", "body") and name in (self.tag[s] for s in stack[:4]):
            return at
        if name in VOID and name != "input":
            return at
        tokens, mark = ["<" + name], None
        if attributes and "=" in attributes:
            for key, a, b, c in _NAMED.findall(attributes):
                value = a or b or c
                if key.lower() == "data-y":
                    mark = value
                else:
                    tokens += [t.lower() for t in _SPLIT.split(value) if t]
        parent = stack[-1]
        self.tag.append(name)
        self.tokens.append(tuple(tokens))
        self.mark.append(mark)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        node = len(self.tag) - 1
        if name in VOID:
            self.end.append(node + 1)
        else:
            self.end.append(0)
            stack.append(node)
        return at

    def _close(self, stack: list[int], name: str) -> None:
        block = name in BLOCKS
        if block or name == "br":
            self.pieces.append((-1, " "))
        if name in ("html", "body"):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == name:
                self._pop_to(stack, k)
                return
            if not block and tag in BLOCKS:
                return  # an inline end never closes a block
            if name in ("p", "li") and tag in CONTAINERS and not (name == "li" and tag not in ("ul", "ol")):
                return

    def text(self, kept: np.ndarray) -> str:
        """Text of the nodes kept, with white space as one space inside blocks and one space between them."""
        flags = kept.tolist()
        return " ".join("".join(t if node < 0 or flags[node] else "" for node, t in self.pieces).split())


FEATURES = ["depth", "text", "own text", "link share", "nodes", "density", "punctuation", "digits", "children", "place among siblings",
            "siblings alike", "share of parent", "text before", "text after", "place on page", "token sum", "token least", "token most",
            "least above", "most above", "kind", "controls", "links", "mean sibling text", "page text", "word length"]


def kind(tag: str) -> int:
    if tag in HEADINGS:
        return 2
    if tag in CONTROLS:
        return 6
    return {"p": 1, "li": 3, "blockquote": 1, "pre": 1, "a": 5, "ul": 3, "ol": 3}.get(tag, 4 if tag in BLOCKS else 0)


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """One row of FEATURES per node. ``odds`` are learned log-odds of tag names and attribute tokens."""
    n = len(page.tag)
    parent, end = np.array(page.parent), np.array(page.end)
    depth = np.array(page.depth, float)
    own = np.zeros((n, MEASURES))
    if page.measures:
        m = np.array(page.measures)
        np.add.at(own, m[:, 0], m[:, 1:])
    sums = np.concatenate([np.zeros((1, MEASURES)), np.cumsum(own, 0)])
    below = sums[end] - sums[:n]
    chars = below[:, 0]
    is_link = np.array([t == "a" for t in page.tag])
    ones = np.concatenate([[0], np.cumsum(is_link)])
    links = ones[end] - ones[:n]
    # Links don't nest, so the text below all links of a subtree is a sum over them.
    linked = np.concatenate([[0.0], np.cumsum(np.where(is_link, chars, 0))])
    link_text = linked[end] - linked[:n]
    controls = np.concatenate([[0], np.cumsum([t in CONTROLS for t in page.tag])])
    controls = controls[end] - controls[:n]
    nodes = end - np.arange(n)
    up = np.maximum(parent, 0)
    kids = np.bincount(up[1:], minlength=n) if n > 1 else np.zeros(n)
    # Siblings: order by parent, then place.
    order = np.argsort(up, kind="stable") if n else np.zeros(0, int)
    order = order[parent[order] >= 0]
    place, before, after = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(order):
        same = np.concatenate([[False], up[order][1:] == up[order][:-1]])
        starts = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        place[order] = np.arange(len(order)) - starts
        before[order[1:]] = np.where(same[1:], chars[order[:-1]], 0)
        after[order[:-1]] = np.where(same[1:], chars[order[1:]], 0)
    alike_of: dict[tuple[int, str], int] = {}
    for key in zip(page.parent, page.tag):
        alike_of[key] = alike_of.get(key, 0) + 1
    alike = np.array([alike_of[key] for key in zip(page.parent, page.tag)], float)
    scores = [[odds.get(t, 0.0) for t in ts] or [0.0] for ts in page.tokens]
    total, least, most = (np.array([f(s) for s in scores]) for f in (sum, min, max))
    low, high = least.tolist(), most.tolist()
    for i, p in enumerate(page.parent):
        if p >= 0:
            low[i] = min(low[i], low[p])
            high[i] = max(high[i], high[p])
    whole = max(chars[0], 1.0) if n else 1.0
    log = np.log1p
    return np.column_stack([
        depth, log(chars), log(own[:, 0]), link_text / np.maximum(chars, 1), log(nodes), chars / nodes, below[:, 1] / np.maximum(chars, 1),
        below[:, 2] / np.maximum(chars, 1), log(kids), place, alike, chars / np.maximum(chars[up], 1), log(before), log(after),
        sums[:n, 0] / whole, total, least, most, low, high, [kind(t) for t in page.tag], controls, log(links),
        log(chars[up] / np.maximum(kids[up], 1)), np.full(n, np.log1p(whole)), chars / np.maximum(below[:, 3], 1)])
