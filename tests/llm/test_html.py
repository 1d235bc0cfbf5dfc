from __future__ import annotations

import itertools
import re
from html import unescape

import numpy as np
import pytest

from factorspark.llm import html_crf as h
from factorspark.llm.labelled_pages import labelled_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A  title &amp; more</h1><p>First <b>para</b>graph,
 with&nbsp;a &lt;tag&gt;.<br>Next line.<p>Second paragraph &#8212; long enough to be read, and unclosed
<div class="ad">Buy now!</div><p>Third one.</p><script>var x = "<p>no</p>";</script><!-- <p>no</p> --></article>
<section id=comments><div class="comment"><p>Nice article, thanks a lot for it.</p></div></section>
<form class="newsletter"><label>Mail</label><button>Go</button></form><footer>&copy; us</footer>"""


@pytest.fixture(scope="module")
def model():
    return h.default_field()


def test_page(model):
    assert h.main_text(model, PAGE).split("\n\n") == [
        "A title & more", "First paragraph, with a <tag>. Next line.",
        "Second paragraph — long enough to be read, and unclosed", "Third one.",
    ]


ARTICLE = "<article><h1>A title of it</h1><p>First paragraph, long enough to be read by anyone.</p><p>Second paragraph, which is longer still.</p></article>"
TEXT = ["A title of it", "First paragraph, long enough to be read by anyone.", "Second paragraph, which is longer still."]


@pytest.mark.parametrize("after", [
    '<div class="replies"><p>Great read, thank you for sharing this with us all.</p></div>',
    '<div class="responses"><h3>3 responses</h3><div class="response"><p>I do not agree with any of this, sorry.</p></div></div>',
    '<section id="discussion"><p>What do the others think about it?</p><p>Nothing, as far as I know.</p></section>',
    '<ul class="comments-area"><li><p>Nice article, thanks a lot for it.</p></li></ul>',
    '<div class="share-buttons"><a href="/x">Share</a> <a href="/y">Send</a></div>',
    '<div class="cookies"><p>We use cookies to make this better for you.</p></div>',
])
def test_company_that_no_generator_made(model, after):
    assert h.main_text(model, f"<html><head><title>t</title></head><body>{ARTICLE}{after}</body></html>").split("\n\n") == TEXT
    assert h.main_text(model, f"<body>{after}{ARTICLE}<footer>&copy; us</footer>").split("\n\n") == TEXT


def test_buttons_inside_an_article(model):
    page = ARTICLE.replace("</h1>", "</h1><button>Share</button>").replace("by anyone.</p>", "by anyone.<button class=x>Like it</button></p>")
    assert h.main_text(model, page).split("\n\n") == TEXT


@pytest.mark.parametrize("page", [
    "<p>A page that is one bare paragraph of text, and nothing else.</p>", "A page that is one bare paragraph of text, and nothing else.",
    "<html><body><p>A page that is one bare paragraph of text, and nothing else.</p></body></html>",
    "<body>A page that is one bare paragraph of text, and nothing else.", "<div>A page that is one bare paragraph of text, and nothing else.</div>",
])
def test_bare_pages(model, page):
    assert h.main_text(model, page) == "A page that is one bare paragraph of text, and nothing else."


def test_forward_backward_gives_the_gradient():
    """One step of training against differences of the likelihood, by adding up all labellings."""
    pages = [p for p in labelled_pages(60) if 2 <= len(h.leaf_blocks(p)) <= 6][:3]
    rows = [h.leaf_blocks(p) for p in pages]
    names = sorted({f for b in rows for x in b for f in h.features(x)})

    def loss(theta):
        w, steps, first = dict(zip(names, theta)), theta[-6:-2].reshape(2, 2), theta[-2:]
        total = 0.0
        for blocks in rows:
            own = [sum(w[f] for f in h.features(b)) for b in blocks]
            value = lambda y: first[y[0]] + sum(a * b for a, b in zip(own, y)) + sum(steps[a, b] for a, b in zip(y, y[1:]))
            every = [value(y) for y in itertools.product([0, 1], repeat=len(blocks))]
            total += np.logaddexp.reduce(every) - value([b.label for b in blocks])
        return total / len(rows) + 1e-4 * (theta**2).sum() / 2

    theta = np.zeros(len(names) + 6)
    grad = np.array([(loss(theta + e) - loss(theta - e)) / 2e-5 for e in np.eye(len(theta)) * 1e-5])
    model = h.train(pages, epochs=1, rate=0.2)
    got = np.array([model.weights[f] for f in names] + [x for row in model.steps for x in row] + list(model.first))
    clear = np.abs(grad) > 1e-6
    assert np.allclose(got[clear], -0.2 * np.sign(grad[clear]), atol=1e-3) and clear.sum() > 10


BODY = "<article><h1>A title</h1><p>First paragraph, long enough to be read by anyone.</p><p>Second one.</p></article>"


@pytest.mark.parametrize("head", [
    "<html><head><title>t</title><body>", "<html><head><meta charset=utf-8><link rel=x><style>p{}</style><div>", "<head>\n<script>a</script><iframe></iframe>",
])
def test_head_without_end(head):
    blocks = h.leaf_blocks(head + BODY)
    assert [b.text for b in blocks] == ["A title", "First paragraph, long enough to be read by anyone.", "Second one."]
    assert not any("head" in b.tags for b in blocks)


def test_head_ends_at_text():
    assert [b.text for b in h.leaf_blocks("<html><head><title>t</title> Bare text<p>More")] == ["Bare text", "More"]


@pytest.mark.parametrize("tag", ["noscript", "iframe", "svg", "select", "object", "template", "title"])
def test_hidden_element_without_end(tag):
    page = f"<html><body><p>Before.<{tag} class=x>{BODY}<{tag}><p>After."
    assert [b.text for b in h.leaf_blocks(page)] == ["Before.", "A title", "First paragraph, long enough to be read by anyone.", "Second one.", "After."]
    assert [b.text for b in h.leaf_blocks(f"<p>a<{tag}>b</{tag}>c<p>d<{tag}><p>e<script>f")] == ["a c", "d", "e"]


def test_held_out_pages(model):
    right = total = 0
    for page in labelled_pages(60, seed=99):
        blocks = h.leaf_blocks(page)
        right += sum(a == b.label for a, b in zip(h.viterbi(model, blocks), blocks))
        total += len(blocks)
    assert right / total > 0.97


def test_viterbi_is_the_best_of_all(model):
    weights = {f: w for f, w in model.weights.items()}
    blocks = h.leaf_blocks(PAGE)[:9]

    def value(labels):
        s = model.first[labels[0]] + sum(model.steps[a][b] for a, b in zip(labels, labels[1:]))
        return s + sum(sum(weights.get(f, 0) for f in h.features(b)) for b, y in zip(blocks, labels) if y)

    best = max(itertools.product([0, 1], repeat=len(blocks)), key=value)
    assert np.isclose(value(h.viterbi(model, blocks)), value(best))


@pytest.mark.parametrize("page,want", [(None, []), ("", []), ("plain", ["plain"]), ("<p>a<p>b</div>c", ["a", "b c"]), ("<p", ["<p"]),
                                       ("a < b <3", ["a < b <3"]), ("<b>x</b>y<br>z", ["xy z"]), ("<script>a", []), ("<!-- a", [])])
def test_blocks(page, want):
    assert [b.text for b in h.leaf_blocks(page or "")] in (want, ["a", "b", "c"] if want == ["a", "b c"] else want)


def test_odd_pages(spark):
    long = "<article>" + "<p>Some words in a row, again.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, "u", long), (4, "u", "<" * 50_000), (5, "u", "<a b='" * 5_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = h.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[None].count("\n\n") == 19_999
    assert h.extract(df.where("false")).count() == 0


def test_query_finds_the_articles(spark):
    """The pages of the tables keep their article in one element; its blocks are what is wanted."""
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in h.op3_html(spark, sf_dir).collect()}
    for key, page in pages.items():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[key] == "\n\n".join(b for b in blocks if b)
