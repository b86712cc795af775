"""Which part of a page is the article, and hosts with very many shapes."""

from __future__ import annotations

import random

import pytest

from framewright.llm import html_text
from tests.llm.test_operators import shape, texts_of

LONG = "a reader says a lot here, and more than the article does, " * 6
COMMENTS = ["<div class='user-comments'>{}</div>", "<div id=commentlist><p>{}</p></div>", "<div class=readerComments><h2>What you say</h2><p>{}</p></div>", "<div><p>{}</p><p>{}</p></div>", "<section class=x><h1>Replies</h1><p>{}</p></section>", "<article class='comment'><p>{}</p></article><article class='comment odd'><p>{}</p></article>"]


def comments(form, i):
    return form.format(*[f"{LONG} {i} {k}" for k in range(2)])


@pytest.mark.parametrize("form", COMMENTS)
def test_comments_longer_than_the_article(spark, form):
    page = lambda i, tag: f"<body><div class=siteHeader>Our site</div><{tag}><h1>Title {i}</h1><p>short body {i}</p></{tag}>{comments(form, i)}<div class=siteFooter>rights</div></body>"
    got = texts_of(spark, [(f"http://a.org/{i}", page(i, "article")) for i in range(4)] + [(f"http://b.org/{i}", page(i, "main")) for i in range(4)] + [("http://c.org/", page(9, "article"))])
    assert got == [f"Title {i} short body {i}" for i in [0, 1, 2, 3, 0, 1, 2, 3, 9]]


def test_article_within_main_and_lead_beside_it(spark):
    page = lambda i: f"<body><div class=lead><p>{LONG} {i}</p></div><main><article><header><h1>T {i}</h1></header><p>body {i}</p></article><section><p>{LONG} {i}</p></section></main></body>"
    assert texts_of(spark, [(f"http://a.org/{i}", page(i)) for i in range(3)]) == [f"T {i} body {i}" for i in range(3)]


def test_parts_called_main(spark):
    page = lambda i: f"<body><div class=top>{LONG} {i}</div><div id=main><div class='post-body'><p>one page {i}</p><p>and on</p></div><div class='commentList'>{LONG} {i}</div></div></body>"
    assert texts_of(spark, [(f"http://a.org/{i}", page(i)) for i in range(3)]) == [f"one page {i} and on" for i in range(3)]
    assert texts_of(spark, [("http://a.org/", "<div class='siteHeader'>Site menu here</div><div id='main'><p>one page"), ("http://b.org/", "<div>before</div><div role=main>inside</div>")]) == ["one page", "inside"]


def test_headings_go_before_length(spark):
    page = lambda i: f"<body><div class=the-body><h1>Title {i}</h1><p>body of {i}</p></div><div class=the-talk><p>{LONG} {i}</p></div></body>"
    assert texts_of(spark, [(f"http://a.org/{i}", page(i)) for i in range(4)]) == [f"Title {i} body of {i}" for i in range(4)]


def test_listed_articles_are_no_region_of_their_own(spark):
    page = lambda i: "<body>" + "".join(f"<article><h2>Item {i} {k}</h2><p>text {k}</p></article>" for k in range(3)) + "</body>"
    assert texts_of(spark, [(f"http://a.org/{i}", page(i)) for i in range(3)]) == [" ".join(f"Item {i} {k} text {k}" for k in range(3)) for i in range(3)]


@pytest.mark.parametrize("name,words", [("siteHeader", {"site", "header"}), ("commentlist", {"comment", "list"}), ("user-comments", {"user", "comments"}), ("HTMLNav", {"html", "nav"}), ("roadmap", {"roadmap"}), ("share-price", {"share", "price"}), ("navbar", {"navbar"})])
def test_words_of_names(name, words):
    assert html_text.words_of(name) == words


def irregular(rnd, blocks=40):
    tags = ["h2", "p", "ul", "pre", "blockquote", "div", "table", "section"]
    return "".join(f"<{t}{'' if rnd.random() < 0.5 else f' class=k{chr(97 + rnd.randrange(8))}'}>text {rnd.random()}</{t}>" for t in (rnd.choice(tags) for _ in range(blocks)))


def test_many_shapes_stay_bounded(spark):
    """Each page has a shape of its own; the wrapper has no more children than it may, and the texts are whole."""
    rnd = random.Random(1)
    inner = [irregular(rnd) for _ in range(200)]
    got = texts_of(spark, [(f"http://a.org/{i}", f"<body><nav>menu</nav><article>{x}</article><p>rights</p></body>") for i, x in enumerate(inner)])
    assert got == [html_text.squeeze([t for p in html_text.parse(x)[1] for t in (" ", *p[0])]) for x in inner]
    shapes = [shape(f"<article>{x}</article>") for x in inner]
    whole = html_text.wrapper_of(shapes[:60])
    assert len(html_text.expression(whole)) < 5000
    for x in shapes[:60]:
        assert len(html_text.match(x, whole)) == len(list(html_text.leaves(x)))


def test_operators_run_on_a_plain_session(tmp_path):
    """Without a shared folder named, in local mode: written tables and queries over them."""
    from tests.test_session import on_a_plain_session

    on_a_plain_session(tmp_path, """
from framewright.llm.line_dedup import dedup_lines
from framewright.llm.mixing import mix
docs = spark.createDataFrame([(1, "a b", "s"), (2, "a", "s")], "doc_id long, text string, source string")
assert dedup_lines(docs, min_docs=2).count() == 2 and mix(docs).count() == 2
""")
