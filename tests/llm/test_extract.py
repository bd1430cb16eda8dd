"""Main text: broken markup, names of elements, unnamed layouts that the tree has not seen, edge rows."""

from __future__ import annotations

import time

import pytest

from scrubframe.llm import extract
from scrubframe.llm.labelled import layout_pages

HELD_OUT = [
    """<body><div class="banner"><a href=/>Mill</a> <a href=1>Login</a></div><ul class="breadcrumbs"><li><a href=1>Home</a></li><li><a href=2>Region</a></li></ul>
    <div><h1>[[{h}]]</h1><p>[[{b}]]</p><blockquote>[[{a}]]</blockquote><p>[[{d}]]</p></div><div class="ads">{n}</div>
    <div class="tags"><a href=1>mill</a> <a href=2>river</a></div><div class="footer">{f}</div></body>""",
    """<body><div class="masthead"><a href=/>Mill</a></div><div class="x"><h2>[[{h}]]</h2><div>[[{b}]]</div><pre>[[{a}]]</pre><div>[[{d}]]</div></div>
    <div class="alert">{n}</div><div class="pager"><a href=1>Next</a></div></body>""",
    """<section><h2>[[{h}]]</h2><p>[[{c}]]</p><p>[[{a}]]</p><p>[[{b}]]</p></section><div class="widget"><ul><li><a href=1>{g}</a></li>
    <li><a href=2>Old pages</a></li></ul></div><div class="popup">{n}</div>""",
    """<div class="sidebar"><div>{n}</div><a href=1>Read on</a></div><div class="entry"><h1>[[{h}]]</h1><p>[[{d}]]</p><p>[[{a}]]</p></div>
    <footer><p><a href=2>Imprint</a></p></footer>""",
]


@pytest.fixture(scope="module")
def tree(spark):
    return extract.train(spark)


@pytest.mark.parametrize(("page", "text"), [
    ('<body class="has-sidebar"><article><p>One two.</p></article></body>', "One two."),
    ('<body class="page nav"><article><p>One two.</p></article></body>', "One two."),
    ('<div class="layout-no-sidebar"><article><p>One two.</p></article></div>', "One two."),
    ('<article><p class="advert">Buy now.</p><p>One two.</p></article>', "One two."),
    ('<article><ul><li class="comment">Me too.<li>One two.</ul></article>', "One two."),
    ('<article><table><tr><td class="sidebar">Old pages.<td>One two.</table></article>', "One two."),
    ("<article><p data-x=it's>One two.</p></article>", "One two."),
    ('<article><p data-x=it"s>One two.</p><p>Three "four".</p></article>', 'One two.\nThree "four".'),
    ("<article><p>One two.</p><svg><path d=1><p>Three.</p></article>", "One two.\nThree."),
    ("<article><p>One two.</p><select><option>no<p>Three.</p></article>", "One two.\nThree."),
    ("<article><p>One two.</p><canvas><p>Three.</p></article>", "One two.\nThree."),
    ("<article><p><a href=1>One two.</p><p>Three.</p></article>", "One two.\nThree."),
    ("<article><script src=/a/>no</script><p title='a>b'>One <!--> two.</p></ ><style>no", "One two."),
    ("<article><p>1 < 2 &amp; 3 &lt; 4&#33;</article>", "1 < 2 & 3 < 4!"),
])
def test_pages(tree, page, text):
    assert extract.main_text(page, tree) == text


def test_layouts_not_seen(tree):
    for pages in (layout_pages(HELD_OUT)[0::2], layout_pages(HELD_OUT)[1::2]):
        right = total = 0
        for source, article in pages:
            wanted = [" ".join(t.split()) for t in article]
            blocks = extract.blocks_of(source)
            right += sum(tree.says(x) == (b.text in wanted) for b, x in zip(blocks, extract.features(blocks), strict=True))
            total += len(blocks)
        assert right >= 0.9 * total


def test_tree_uses_words_and_neighbours(tree):
    used = {extract.FEATURES[f] for f, *_ in tree.nodes if f >= 0}
    assert "words" in used and any(name.startswith(("prev_", "next_")) for name in used)


@pytest.mark.parametrize("part", ["<div>", "<a ", "<svg>", "<p class='", "<li>x", "<div><p>x</p>", "</div>", "<p a = ", "<div></section>", "<dt></dt>", "<!--"])
def test_broken_pages_in_linear_time(part):
    start = time.process_time()
    extract.blocks_of("<div>" * 50_000 + part * 50_000 + "x")
    assert time.process_time() - start < 10


def test_edge_rows(spark, tree):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    assert extract.extract(spark.createDataFrame([], schema), tree).count() == 0
    long = "<article>" + "<p>word &amp; word</p>" * 100_000 + "</article>"
    rows = [(1, "u", "<p>Hi.</p>", "x", "y"), (1, "u", "<p>Hi.</p>", "x", "y"), (None, None, None, None, None), (2, "v", long, None, None)]
    got = extract.extract(spark.createDataFrame(rows, schema), tree)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {(r["page_id"], r["n_chars"]) for r in got.collect()}
    assert found == {(1, 3), (None, 0), (2, 100_000 * 12 - 1)} and got.count() == 4
