"""Main text of pages: the reader of HTML, the trees, the decoding, and held-out accuracy."""

import collections
import html
import itertools
import random
import re

import numpy as np
import pytest

from mailsift.llm import dom, html_boost as B

SF = "/root/testdata/sf0.01"


def truth(source):
    """Text of the only article of a given page, by patterns that fit its layout."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def everything(source):
    page = dom.Page(source)
    return page.text(np.ones(len(page.tag), bool))


@pytest.fixture(scope="module")
def sources(spark):
    return [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(sources):
    return B.train(sources[:100])


@pytest.mark.parametrize("source, text", [
    ("", ""), ("plain", "plain"), ("a<b>b</b>c <i>d</i>", "abc d"), ("<p>one<p>two</p>three", "one two three"),
    ("<p><b>open.<br><p>next</p>", "open. next"), ("x<!-- <p>no</p> -->y", "xy"), ("x<!-- never closed", "x"),
    ("<script>var t='</p>';</script>z", "z"), ("<style>p{}</style><SCRIPT>no</script >yes", "yes"), ("<script>never closed", ""),
    ("a &amp; b &lt;p&gt; &#233;&nbsp;c", "a & b <p> é c"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("cut <a href='x", "cut"),
    ('<a title="1 > 0">t</a>', "t"), ('<p class="a>b</p>c', "b c"), ("</p></div>stray", "stray"), ("<ul><li>a<li>b</ul>c", "a b c"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<title>no</title>body", "body"), ("a<br>b<br/>c<hr>d", "a b c d"),
    ("<div>\n a \t b\n</div>c", "a b c"), ("<p>a</b>b</p>", "ab"), ("<p/>a", "a"), ("\0x", "\0x"),
])
def test_reader(source, text):
    assert everything(source) == text


def test_reader_survives_noise():
    rng = random.Random(2)
    parts = ["<p>", "</p>", "<b", "<div class=\"x y\">", "</div>", "<!--", "-->", "<li>", "</ul>", "<", ">", "&", "&amp;", "'", '"', "x y ",
             "<script>", "</script>", "<td>", "</table>", "<table>", "\n", "<a href='", "<br>", "é"]
    for _ in range(400):
        page = dom.Page("".join(rng.choice(parts) for _ in range(rng.randrange(40))))
        n = len(page.tag)
        assert all(len(c) == n for c in (page.tokens, page.mark, page.parent, page.depth, page.end))
        for i in range(1, n):
            p = page.parent[i]
            assert 0 <= p < i < page.end[i] <= page.end[p] <= n and page.depth[i] == page.depth[p] + 1
        assert np.isfinite(dom.features(page, {"<p": 1.0})).all()


def test_long_pages_take_linear_time():
    for source in ("<p>" * 60_000, "<div>" * 60_000, '<a "' * 60_000, "<b>x" * 60_000, "<" * 200_000, "<!--" * 60_000):
        page = dom.Page(source)
        B.decode(page, np.zeros(len(page.tag)))
        dom.features(page, {})


def test_subtree_sums():
    page = dom.Page("<div><p>abc</p><ul><li><a>de</a></li><li>f.</li></ul></div>")
    x = dict(zip(dom.FEATURES, dom.features(page, {}).T))
    at = page.tag.index("ul")
    assert np.isclose(np.expm1(x["text"][at]), 4) and np.isclose(x["link share"][at], 0.5) and np.isclose(np.expm1(x["nodes"][at]), 4)
    assert np.isclose(x["share of parent"][at], 4 / 7) and x["place among siblings"][at] == 1
    assert np.isclose(np.expm1(x["text before"][at]), 3) and x["siblings alike"][page.tag.index("li")] == 2


def test_trees_find_the_best_split_and_lower_the_loss():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = ((x[:, 2] > 0.3) ^ (x[:, 0] > 1.0)).astype(float)
    w = rng.uniform(0.5, 2, 300)
    prior, trees = B.boost(x, y, w, rounds=30, leaves=6)
    q = 1 / (1 + np.exp(-prior))
    g, h = w * (q - y), w * q * (1 - q)

    def gain(f, t):
        low = x[:, f] <= t
        if min(low.sum(), (~low).sum()) < B.LEAST_NODES:
            return -1
        return sum(g[s].sum() ** 2 / (h[s].sum() + B.L2) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + B.L2)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, B.BINS + 1)[1:-1])) for c in x.T]
    best = max(gain(f, t) for f in range(4) for t in cuts[f])
    assert np.isclose(gain(trees[0].feature[0], trees[0].threshold[0]), best)
    forest = B.Forest(prior, trees)

    def walked(row):
        out = prior
        for t in trees:
            i = 0
            while t.feature[i] >= 0:
                i = t.left[i] if row[t.feature[i]] <= t.threshold[i] else t.right[i]
            out += t.value[i]
        return out
    assert np.allclose(forest.margins(x), [walked(r) for r in x])
    loss = [np.mean(w * np.logaddexp(0, np.where(y > 0, -1, 1) * B.Forest(prior, trees[:k]).margins(x))) for k in (0, 5, 30)]
    assert loss[0] > loss[1] > loss[2]


def test_decoding_is_the_best_consistent_labelling():
    rng = random.Random(4)
    for _ in range(60):
        page = dom.Page("".join(rng.choice(["<div>", "<p>t", "</div>", "ab ", "<b>c</b>"]) for _ in range(rng.randrange(1, 9))))
        n = len(page.tag)
        if n > 8:
            continue
        margins = np.array([rng.gauss(0, 1) for _ in range(n)])
        own = collections.Counter()
        for m in page.measures:
            own[m[0]] += m[1]
        score = [margins[i] * (1 + own[i] ** 0.5) for i in range(n)]

        def allowed(states):
            return all((states[page.parent[i]], states[i]) in {(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)} for i in range(1, n)) and states[0] < 2
        best = max(sum(score[i] for i in range(n) if s[i] == 1) for s in itertools.product(range(3), repeat=n) if allowed(s))
        kept = B.decode(page, margins)
        assert np.isclose(sum(score[i] for i in range(n) if kept[i]), best)


def test_given_pages(model, sources):
    held_out = sources[100:]
    assert list(B.texts_from(held_out, model)) == [truth(s) for s in held_out]


def test_other_layouts(model, sources):
    long, short = [], []
    for s in sources[150:]:
        a, b = B.texts_of(dom.Page(s))
        long, short = long + a, short + b
    composer = B.Composer(long, short, 77)
    hit = wrong = missed = 0
    for _ in range(300):
        source = composer.page()
        page = dom.Page(source)
        want, got = B.marks(page), model.nodes(dom.Page(re.sub(r' data-y="."', "", source)))
        for m in page.measures:
            hit += m[1] * (want[m[0]] == 1 and got[m[0]])
            wrong += m[1] * (want[m[0]] == 0 and got[m[0]])
            missed += m[1] * (want[m[0]] == 1 and not got[m[0]])
    assert hit / (hit + wrong) > 0.98 and hit / (hit + missed) > 0.98


def test_extract(spark, model, sources):
    schema = "page_id long, url string, html string, text string, n_chars int, h long, _x string"
    rows = [(1, "u", sources[0], "old", 1, 2, "x"), (1, "u", sources[0], "old", 1, 2, "x"), (None, None, None, None, None, None, None),
            (2, "v", "", "", 0, 0, ""), (3, "w", " \n", "", 0, 0, ""), (4, "y", sources[1] * 40, "", 0, 0, "")]
    got = B.extract(spark.createDataFrame(rows, schema), model=model)
    assert got.columns == ["page_id", "url", "h", "_x", "text", "n_chars"]
    got = {r["page_id"]: r for r in got.collect()}
    assert got[1]["text"] == truth(sources[0]) and got[1]["n_chars"] == len(truth(sources[0]))
    assert got[None]["text"] == got[2]["text"] == got[3]["text"] == "" and got[4]["n_chars"] > 0
    none = spark.createDataFrame([], schema)
    assert B.extract(none).count() == 0
    assert B.extract(spark.createDataFrame(rows[2:4], schema)).select("text").distinct().collect()[0][0] == ""


def test_sample_is_bounded(spark):
    df = spark.range(20_000).selectExpr("id AS page_id", "concat('<p>', id) AS html")
    assert 100 < len(B.sample(df, "html", "page_id", 200)) <= 400
    same = spark.range(5000).selectExpr("7L AS page_id", "'<p>' AS html")
    assert len(B.sample(same, "html", "page_id", 10)) <= 20
