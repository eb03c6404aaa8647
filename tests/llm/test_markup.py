"""Deep and unclosed markup: right texts in time that grows with the page, not with its square."""

import time

import pytest

from tidemark.llm import html_extract, warc

N = 150_000  # tags; about a megabyte


def seconds(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began


@pytest.mark.parametrize("start,end,text", [
    ("<div>" * N + "deep words", "", "deep words"),
    ("<div class=widget>" * (N // 3) + "deep words", "", "deep words"),
    ("<b>" * N + "<p>one</p>" * 3, "", "one one one"),
    ("<p>one</p>" + "<div>" * (N // 2), "</section>" * N, "one"),
    ("<i><div>" + "<b>" * (N // 2), "</i>" * N + "last", "last"),
    ("<section><article>words of it " * (N // 8), "", " ".join(["words of it"] * (N // 8))),
])
def test_main_text_of_deep_pages(start, end, text):
    assert html_extract.main_text(start + end) == text
    half = seconds(html_extract.main_text, start[: len(start) // 2] + end[: len(end) // 2])
    assert seconds(html_extract.main_text, start + end) < 6 * half + 1


@pytest.mark.parametrize("page,text", [
    ("<script " * N, ""), ("x<p " * N, "x"), ("a<!--" * N, "a"), ("a<style>" * N, "a"), ("a</script " * N, "a"), ("<p <" * N + ">b", "b"), ("<b>a" * N, "a" * N),
])
def test_plain_text_of_unclosed_pages(page, text):
    assert warc.plain_text(page) == text
    assert seconds(warc.plain_text, page) < 5


def test_what_is_left_open_hides_the_rest():
    assert warc.plain_text("a<script>b > c") == "a" and warc.plain_text("a<!-- b > c") == "a" and warc.plain_text("a<b>c<!-- d") == "ac"
    assert warc.plain_text("a<script>b</script>c<p") == "ac" and warc.plain_text("1 < 2 <i>x</i> <3") == "1 < 2 x <3"
