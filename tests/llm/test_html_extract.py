import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import CLASHING, SMALL
from pyspark.sql import functions as F

from drillsight.llm import boosting, dom, html_extract
from drillsight.llm.layouts import MARK, Layouts

LONG = [
    "The council voted on Tuesday to keep the old bridge open for another ten years, despite its cost.",
    "Engineers had warned that two of the pillars were weaker than they had seemed in the last survey.",
    "Nobody in the hall spoke against the plan, and the mayor thanked all who had written to her office.",
    "Work is to start in spring; until then lorries have to take the longer road along the river bank.",
]


@pytest.fixture(scope="module")
def blocks(spark):
    return html_extract.sampled_blocks(spark.read.parquet(f"{SMALL}/pages.parquet"), F.col("page_id"))


@pytest.fixture(scope="module")
def model(blocks):
    return html_extract.fit(*blocks)


def texts(tree):
    return [x for x in tree.texts if x]


def test_parser_is_forgiving():
    page = (
        "<!DOCTYPE html><html><head><title>a<b</title><style>p{}</style><script>x='<p>no</p><a ';</script></head>"
        "<body><!-- <p>no</p> --><ul><li>one<li>two</ul><p>A &amp; B&nbsp;\n c<br>d<p>e <b>f</b>g</div> h"
        "<table><tr><td>1<td>2</div>3</table>&lt;tail&copy 1 < 2<textarea>no</textarea><p hidden>i</p><a href='never"
    )
    assert texts(dom.parse(page)) == ["one", "two", "A & B c d", "e fg", "h", "1", "2", "3", "<tail© 1 < 2", "i"]
    tree = dom.parse('<div class="sideBar news-items" id=x><p>t</p></div>')
    assert set(tree.tokens[1]) == {"<div>", "side", "bar", "new", "item"}
    assert [texts(dom.parse(x)) for x in ("", "<", "a<!-- b", "<script>x", "x</p>y", "<p")] == [[], ["<"], ["a"], [], ["x", "y"], []]


@settings(max_examples=300, database=None, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<ul>", "<li>", "</ul>", "<a href='x'>", "</a>", "<td>", "<table>", "</table>", "<svg>", "</svg>", "<select>", "</select>", "<body>", "</body>", "<br>", "<hr/>", "<!--", "-->", "<script>", "</script>", "a b", "&am", "<", '"', "<x-y>", "\0"]), max_size=40))
def test_trees_are_well_formed(parts):
    tree = dom.parse("".join(parts))
    for k, (parent, end) in enumerate(zip(tree.parents, tree.ends, strict=True)):
        assert parent < k < end <= len(tree.tags) and (k == 0) == (parent < 0)
        if k:
            assert end <= tree.ends[parent] and tree.depths[k] == tree.depths[parent] + 1
        assert tree.texts[k] or tree.tags[k] != dom.TEXT
        assert not tree.texts[k] or end == k + 1


def test_trees_learn_what_lines_cannot():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    fitted = boosting.fit_trees(x[:1500], y[:1500], rounds=30, depth=3)
    assert ((fitted.logit(x[1500:]) > 0) == y[1500:]).mean() > 0.93
    for one in (np.zeros(5), np.ones(5)):
        assert len(set(boosting.fit_trees(x[:5], one).probability(x).tolist())) == 1
    flat = boosting.fit_trees(np.ones((10, 2)), np.arange(10) % 2)
    assert np.allclose(flat.probability(np.ones((1, 2))), 0.5)


def random_tree(draw):
    tree = dom.Tree()
    tree.add("body", -1, (), "")

    def fill(parent, depth):
        for _ in range(draw.randrange(0, 4)):
            if draw.random() < 0.4 or depth > 2:
                tree.texts[tree.add(dom.TEXT, parent, (), "")] = "x"
            else:
                at = tree.add("div", parent, (), "")
                fill(at, depth + 1)
                tree.ends[at] = len(tree.tags)

    fill(0, 0)
    tree.ends[0] = len(tree.tags)
    return tree


def test_decoding_is_the_best_labelling():
    draw = random.Random(5)
    for _ in range(200):
        tree = random_tree(draw)
        n = len(tree.tags)
        if n > 11:
            continue
        p = np.array([draw.uniform(0.05, 0.95) for _ in range(n)])
        best, value = None, -math.inf
        for labels in itertools.product((False, True), repeat=n):
            children = Counter(tree.parents[k] for k in range(n) if labels[k])
            if any(labels[k] and k and not labels[tree.parents[k]] for k in range(n)):
                continue
            if any(labels[k] and not tree.texts[k] and not children[k] for k in range(n)):
                continue
            score = sum(math.log(p[k] if labels[k] else 1 - p[k]) for k in range(n))
            if score > value:
                best, value = labels, score
        assert html_extract.decode(html_extract.Nodes([tree]), p).tolist() == list(best)


def test_layouts_not_seen_in_training(model, blocks):
    draw, hit, wrong, missed = Layouts(*blocks, seed=77), 0, 0, 0
    for page in [draw.page() for _ in range(150)]:
        tree = dom.parse(page, MARK)
        want = Counter(x for x, m in zip(tree.texts, tree.marks, strict=True) if x and m == "1")
        got = Counter(x for x in model.texts([dom.parse(page)])[0].split("\n\n") if x)
        hit, wrong, missed = hit + (got & want).total(), wrong + (got - want).total(), missed + (want - got).total()
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


PAGES = {
    "blog": (
        f"""<body class="home"><div id="page"><header id="masthead" class="site-header"><p class="site-title"><a href="/">My blog</a></p>
        <nav><ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>
        <div id="content" class="site-content"><main><article class="post"><header class="entry-header"><h1 class="entry-title">A bridge</h1></header>
        <div class="entry-content"><p>{LONG[0]}</p><p>{LONG[1]} <a href="/x">Read</a> {LONG[2]}</p><h2>Why?</h2><ul><li>{LONG[3]}</li><li>Cost</li></ul></div></article>
        <div id="comments" class="comments-area"><h2>2 comments</h2><ol class="comment-list"><li class="comment"><p>{LONG[2]}</p></li><li class="comment"><p>{LONG[1]}</p></li></ol>
        <form class="comment-form"><label>Name</label><input name="n"><textarea></textarea></form></div></main>
        <aside class="sidebar widget-area"><h3>Recent</h3><ul><li><a href="/1">One post</a></li><li><a href="/2">Another post</a></li></ul></aside></div>
        <footer class="site-footer"><p>&copy; 2020 My blog</p></footer></div>""",
        ["A bridge", LONG[0], f"{LONG[1]} Read {LONG[2]}", "Why?", LONG[3], "Cost"],
    ),
    "divisions": (
        f"""<div class="cookie-notice"><p>We use cookies to give you a better experience on this site, and to count visits.</p></div>
        <div class="navbar"><a href="/a">News</a> <a href="/b">Sports</a></div><div class="container"><div class="story">
        <h1>Bridge stays open</h1><p>{LONG[0]}</p><div class="advert"><p>{LONG[3]}</p></div><p>{LONG[1]}<p>{LONG[2]}</div>
        <div class="sidebar"><div class="related"><a href="/c">Other news of the day</a></div></div></div><div class="footer">Imprint &middot; {LONG[3]}</div>""",
        ["Bridge stays open", LONG[0], LONG[1], LONG[2]],
    ),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_by_hand(model, name):
    html, want = PAGES[name]
    assert model.texts([dom.parse(html)])[0].split("\n\n") == want


def test_odd_rows(spark, model):
    article = f"<nav><ul><li><a href=x>Home</a></li></ul></nav><article><p>{LONG[0]}</p></article>"
    long_page = "<article>" + f"<p>{LONG[1]} {{}}</p>" * 20_000 + "</article>"
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (None, "", ""), (3, "u", "no markup at all"), (4, "u", "<p"), (5, "u", long_page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in (*CLASHING, "text", "page url")})
    got = html_extract.extract(df, model, "page_id", "url")
    assert got.columns == ["page_id", "url", "text"]
    out = {(r["page_id"], r["url"]): r["text"] for r in got.collect()}
    assert got.count() == 7 and out[1, "u"] == LONG[0] and out[2, None] == out[None, ""] == out[4, "u"] == ""
    assert out[5, "u"].count(LONG[1]) == 20_000
    assert html_extract.extract(df.limit(0), model, "page_id", "url").count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "SAMPLED_PAGES", 5)
    monkeypatch.setattr(html_extract, "SAMPLED_BLOCKS", 20)
    rows = [(k % 50, f"<p>{k} {LONG[0]}</p><p>short {k}</p>") for k in range(2000)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    long, short = html_extract.sampled_blocks(df, F.col("page_id"))
    assert len(long) + len(short) == 20
    assert html_extract.sampled_blocks(df.limit(0), F.col("page_id")) == ([], [])


def test_query(spark):
    """The pages of the sample have one layout; the parser alone finds its article."""
    want = {}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        tree = dom.parse(r["html"])
        at = tree.tags.index("article")
        want[r["page_id"]] = (r["url"], "\n\n".join(x for x in tree.texts[at : tree.ends[at]] if x))
    rows = html_extract.query(spark, SMALL).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
