"""Pages whose article lies in a form, and constant parts however large a host's pages are."""

import pytest
from sheaf.llm.html_wrapper import extract_pages


def words(k, n):
    return " ".join(f"w{k}x{i}" for i in range(n))


def extracted(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("article", ["<article><p>{}</p></article>", "<div><p>{}</p></div>"])
def test_an_article_inside_a_form_stays(spark, article):
    page = lambda k: f"<html><body><form id='frm' action='.'><div class=menu><a href=/>Menu</a></div>{article.format(words(k, 80))}<input type=hidden value=x></form></body></html>"
    got = extracted(spark, [page(k) for k in range(6)])
    assert got == {k: words(k, 80) for k in range(6)}


def test_forms_beside_the_article_go(spark):
    page = lambda k: f"<body><article><p>{words(k, 60)}</p><form><p>Your name and comment {k}</p></form></article><form><label>Search {k}</label></form></body>"
    assert extracted(spark, [page(k) for k in range(5)]) == {k: words(k, 60) for k in range(5)}


@pytest.mark.parametrize("n", [20, 120, 200, 400])
def test_a_constant_part_goes_however_many_sections_there_are(spark, n):
    def page(k):
        parts = "".join(f"<h2>Head {words(k * 1000 + i, 2)}</h2><p>{words(k * 1000 + i, 9)}</p>" for i in range(n))
        return f"<body><article>{parts}<p>Read our terms before you copy any of this text.</p></article></body>"

    for text in extracted(spark, [page(k) for k in range(12)]).values():
        assert "our terms" not in text and text.count("Head") == n
