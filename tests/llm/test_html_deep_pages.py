"""Deep and wide pages: time and output stay in proportion to the page."""

import time

import pytest

from reviewlake.llm import html_text


@pytest.mark.parametrize("page", [
    "<blockquote>a" * 60_000, "<li>a" * 60_000, "<ul><li>a" * 40_000, "<div>a" * 60_000, "<dl><dd>a" * 40_000,
    "<table><tr><td>" + "x" * 50_000 + "</td></tr>" + "<tr><td>y<td>z</td></tr>" * 5000,
])
def test_time_and_output(page):
    start = time.time()
    text = html_text.render(page)
    assert time.time() - start < 20 and len(text) < 12 * len(page)
    assert text.count("a") == page.count(">a")


def test_indents_and_marks():
    assert html_text.render("<blockquote>a<blockquote>b<ul><li>c<li><blockquote>d") == "  a\n\n    b\n\n    - c\n    -   d"
    deep = html_text.render("<blockquote>" * 100 + "a<p>b")
    assert deep.split("\n") == [" " * html_text.DEEPEST + "a", "", " " * html_text.DEEPEST + "b"]
    assert html_text.render("<ol><li>a<p>b<li><ol><li>c") == "1. a\n\n   b\n2. 1. c"
    assert html_text.render("<li><br>") in ("", "- ")
    wide = html_text.render("<table><tr><td>" + "x" * 300 + "<td>y<tr><td>a<td>b").split("\n")
    assert wide[0] == "x" * 300 + " | y" and wide[1] == "a".ljust(html_text.WIDEST) + " | b"
