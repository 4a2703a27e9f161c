from pyspark.sql import functions as F

from pandwerk.llm import html_text

LONG = "A first sentence, with a comma. A second one, longer than the first; it goes on and on, for a while."
ARTICLE = f"<h1>Head &amp; line</h1><p>{LONG}<p>Un&shy;closed <b>bold<br>next</b> line.</p><ul><li>one<li>two</ul><p>Short.</p>"
TEXT = ["Head & line", LONG, "Un\xadclosed bold next line.", "one", "two", "Short."]


def blocks(page):
    text = html_text.main_text(page)
    return text.split("\n\n") if text else []


def test_article_without_the_parts_beside():
    beside = ("<header><h1>Site name, here</h1></header><nav><ul><li><a href='/x'>x</a></li></ul></nav>"
              f"<div class='ad'>{LONG}</div><div id=sidebar><p>{LONG}</p></div><div class=\"cookie-notice\"><p>{LONG}</p></div>"
              f"<form><p>{LONG}</p></form><script>var t='</p>{LONG}';</script><style>p{{}}</style><!-- <p>{LONG}</p> -->")
    after = f"<section class='comments'><p>{LONG}</p><p>{LONG}</p></section><aside>{LONG}</aside><footer>{LONG}</footer>"
    for holder in ("article", "main", "div class='content'", "section"):
        name = holder.split()[0]
        page = f"<html><head><title>T</title></head><body>{beside}<{holder}>{ARTICLE}</{name}>{after}"
        assert blocks(page) == TEXT, holder


def test_parts_inside_the_article_go_too():
    page = f"<article>{ARTICLE}<div class='share'>Share this, now.</div><div class=ads>Buy, buy.</div><p>End.</p></article>"
    assert blocks(page) == [*TEXT, "End."]


def test_wrappers_with_marking_names_and_page_wide_forms_stay():
    comments = f"<div class='comments'><div class=comment><p>{LONG}</p></div><div class=comment><p>{LONG} {LONG}</p></div></div>"
    menu = "<ul class=menu><li><a href=/a>A</a><li><a href=/b>B</a></ul>"
    for name in ("content has-sidebar", "page-header-fixed", "page-comments-open", "no-sidebar widget-area"):
        for tag in ("div", "section"):
            page = f"<body><div id=x class='{name}'>{menu}<{tag}>{ARTICLE}</{tag}><div class=sidebar>{LONG}</div>{comments}</div><footer>{LONG}</footer>"
            assert blocks(page) == TEXT, (name, tag)
            assert blocks(f"<body><div class='{name}'>{menu}<article>{ARTICLE}</article><div class=sidebar>{LONG}</div></div>{comments}") == TEXT
    assert blocks(f"<body><form action=/><input name=q>{menu}<div>{ARTICLE}</div><div class=ad>{LONG}</div></form>") == TEXT
    assert blocks(f"<body><form action=/><article>{ARTICLE}</article></form>{comments}") == TEXT
    assert blocks(f"<body><article>{ARTICLE}</article><section class=comments><article class=comment><p>{LONG * 9}</p></article></section>") == TEXT


def test_link_lists_inside_the_content_go_and_links_in_sentences_stay():
    links = "<ul><li><a href=/1>First other story</a></li><li><a href=/2>Second other story</a></li><li><a href=/3>Third</a></li></ul>"
    inline = f"<p>{LONG} <a href=/4>With a link, here</a> inside.</p><p><a href=/5>One link of its own.</a></p>"
    want = [*TEXT, f"{LONG} With a link, here inside.", "One link of its own."]
    for holder in ("article", "div"):
        assert blocks(f"<body><{holder}>{ARTICLE}{links}{inline}</{holder}>") == want, holder
        assert blocks(f"<body><{holder}>{links}{ARTICLE}{inline}</{holder}>") == want, holder


def test_bare_blocks_beside_unnamed_content_go():
    rights = "Copyright 2020 Some Firm, all rights reserved"
    content = ARTICLE.replace("<p>Short.", f"<p>{LONG} {LONG} {LONG}<p>{LONG} {LONG}<p>Short.")
    want = [*TEXT[:-1], f"{LONG} {LONG} {LONG}", f"{LONG} {LONG}", TEXT[-1]]
    assert blocks(f"<body><div class=content>{content}</div><div>{rights}</div>") == want
    assert blocks(f"<body><div>Home of the site</div>{content}<div>{rights}</div>") == want
    assert blocks(f"<body><table><tr><td><a href=/>x</a></td><td>{content}</td></tr></table><div>{rights}</div>") == want
    assert blocks(f"<body><div>{content}</div><div class=x><p>{LONG}</p><p>{LONG}</p></div>")[:len(want)] == want


def test_the_threshold_decides(monkeypatch):
    page = f"<body><div>{ARTICLE}</div><div><a href=/1>Other one</a></div><div><a href=/2>Other two</a></div>"
    assert blocks(page) == TEXT
    monkeypatch.setattr(html_text, "THRESHOLD", 0.0)
    assert blocks(page) != TEXT


def test_broken_and_empty_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert blocks("plain text, no markup") == ["plain text, no markup"]
    assert blocks("<p>a<p>b</div></p><p") == ["a", "b"]
    assert blocks("<article><p>x &amp y &bogus; &#233; < z</p>") == ["x & y &bogus; é < z"]
    assert html_text.main_text("<p>" + "word, " * 50_000 + "</p>").count("word") == 50_000


def test_table_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>"), (None, None, None), (2, "u", "")] * 2,
                                  "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted(r["text"] for r in html_text.extracted(pages, carry=("page_id", "url")).collect())
    assert got == ["", "", "", "", "\n\n".join(TEXT), "\n\n".join(TEXT)]
    assert html_text.extracted(pages.limit(0)).count() == 0
