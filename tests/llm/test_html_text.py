"""Main text of pages."""

import time

import pytest

from plumbline.llm.html_text import extract_main_text, main_text

PROSE = "A sentence, with commas, that goes on for a while, so that it counts as text. " * 3
ONE = " ".join(PROSE.split())


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


def test_furniture_goes_and_the_article_stays():
    html = page(
        "<nav><ul><li><a href=/>Home</a></li></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies, many, many cookies, on this site.</p></div>"
        "<header><p>Site name, and a slogan, here</p></header>"
        f"<article><h1>Title</h1><p>{PROSE}</p><script>var x = '</p>';</script>"
        f"<div class='ad'>Buy, buy, buy</div><p>Second <b>bold</b><br>line &amp; more&nbsp;x</p>"
        "<style>p{}</style><!-- comment, with, commas --></article>"
        f"<aside><p>{PROSE}</p></aside>"
        f"<section id='comments'><p>{PROSE}</p></section>"
        "<form><p>Search, please, here</p><input></form><footer>(c)</footer>")
    assert main_text(html) == f"Title\n\n{ONE}\n\nSecond bold line & more x"


def test_without_semantic_elements_the_best_container_wins():
    html = page(
        "<div class='menu'><a href=/a>a, b, c</a></div>"
        f"<div><div><p>{PROSE}</p><p>{PROSE}</p><p>Short end.</p></div>"
        "<div><a href=/x>Link, one</a> <a href=/y>Link, two</a> <a href=/z>Link, three</a></div></div>"
        "<div class='sidebar'><p>Other, things</p></div>")
    assert main_text(html) == f"{ONE}\n\n{ONE}\n\nShort end."


def test_good_siblings_are_kept():
    html = page(f"<div id='wrap'><h1>Head</h1><div><p>{PROSE}</p><p>{PROSE}</p></div>"
                f"<div><p>{PROSE}</p></div><p>After it.</p></div>")
    assert main_text(html) == f"Head\n\n{ONE}\n\n{ONE}\n\n{ONE}\n\nAfter it."


@pytest.mark.parametrize("html,text", [
    ("", ""), ("   \n ", ""), ("no markup", "no markup"), ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>x<li>y</ul>", "x\n\ny"), ("<div>a</div>tail", "a\n\ntail"),
    ("<script>only", ""), ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"), ("<p title='>'>x</p>", "x"),
    ("<p hidden>no</p><p>yes</p>", "yes"), ("<p>un<b>clo</p><p>sed</p>", "unclo\n\nsed"),
    ("</div></p>stray", "stray"), ("<p>a<br/>b</p>", "a b"), ("<!-- never ends", ""),
    ("<table><tr><td>a<td>b</table>", "a\n\nb")])
def test_small_pages(html, text):
    assert main_text(html) == text


def test_names_of_layouts_and_titles():
    assert main_text(f"<body class='menu'><div class='page has-sidebar'><p>{PROSE}</p></div></body>") == ONE
    html = page(f"<div class='post'><div class='post-header'><h1>T</h1></div><p>{PROSE}</p></div>"
                "<div class='site-header'>S</div><div class='user-comments'><p>c, c, c</p></div>")
    assert main_text(html) == f"T\n\n{ONE}"


def test_quotes_open_values_only_after_an_equals_sign():
    assert main_text("<p title=don't>Lost, one?</p>") == "Lost, one?"
    assert main_text("<p class=it's>Hello there, all.</p><p>You don't lose this, ever.</p>") == (
        "Hello there, all.\n\nYou don't lose this, ever.")
    assert main_text("<p ' \" x>a</p><p data-x = 'b>c'>d</p>") == "a\n\nd"
    assert main_text('<p title="never closed>text</p>') == "text"


def test_names_count_only_as_a_whole():
    article = "<article><h1>T</h1>{}</article>"
    for name in ("related-work", "notice-free", "social-history", "tagsoup", "shared-memory", "bannerman"):
        for attribute in ("class", "id"):
            assert main_text(page(article.format(f"<p>{PROSE}</p><div {attribute}={name}><p>In, here.</p></div>"))
                             ) == f"T\n\n{ONE}\n\nIn, here."
    for name in ("related-posts", "cookie-notice", "site_header", "socialLinks", "ad", "user-comments", "share"):
        assert main_text(page(article.format(f"<p>{PROSE}</p><div class={name}><p>Out, there.</p></div>"))
                         ) == f"T\n\n{ONE}"


def test_articles_side_by_side_stay_and_teasers_go():
    html = page(f"<article><p>{PROSE}</p></article><article><p>{PROSE} End.</p></article>"
                "<article><a href=/x>Read, this, too</a></article>")
    assert main_text(html) == f"{ONE}\n\n{ONE} End."


def test_unmatched_tags_take_linear_time():
    started = time.time()
    assert main_text("<b>" * 100_000 + "x" + "</i>" * 100_000) == "x"
    assert main_text("<ul>" * 50_000 + "y" + "</div>" * 50_000 + "</p>" * 50_000) == "y"
    assert time.time() - started < 8


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000


def test_table(spark):
    rows = [(1, "u", "<p>x</p>", 5), (1, "u", "<p>x</p>", 5), (None, None, None, None), (3, "v", "", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    assert sorted(map(tuple, extract_main_text(table).collect()), key=str) == sorted(
        [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (3, "v", "", 0)], key=str)
    assert extract_main_text(table.limit(0)).count() == 0
