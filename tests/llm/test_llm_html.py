"""Pages whose main text a list of words would lose, and pages that take long to read."""

from __future__ import annotations

import time

import pytest

from quern.llm import pages


def host_of_pages(spark, n, body, host="a.example"):
    rows = [(k, f"http://{host}/p{k}", f"<html><head><title>t</title></head><body><nav><a href='/'>menu here</a></nav>{body(k)}<footer>all rights</footer></body></html>") for k in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(spark, n, body):
    return [r.text for r in pages.extract(host_of_pages(spark, n, body)).orderBy("page_id").collect()]


def varying(k, n=30):
    return " ".join(f"word{(k * 7919 + i * 104729) % 9973}" for i in range(n))


@pytest.mark.parametrize("name", ["search-engine-tutorial", "login-flow-explained", "share-price-history", "related-work", "comment-syntax"])
def test_a_word_in_a_longer_name_loses_nothing(spark, name):
    assert texts(spark, 12, lambda k: f"<div class='{name}'><p>{varying(k)}</p><p>second {varying(k + 50)}</p></div>") == [f"{varying(k)}\nsecond {varying(k + 50)}" for k in range(12)]
    assert texts(spark, 12, lambda k: f"<article><p>{varying(k)}</p><section id='{name}'><p>also {varying(k + 50)}</p></section></article>") == [f"{varying(k)}\nalso {varying(k + 50)}" for k in range(12)]


@pytest.mark.parametrize("name", ["ad", "ads top-ad", "cookie-banner", "side-bar", "related-posts", "discussion-thread", "comments", "newsletter-box", "ad-300", "popup"])
def test_whole_names_of_boilerplate_go(spark, name):
    assert texts(spark, 12, lambda k: f"<article><p>{varying(k)}</p><div class='{name}'>other {varying(k + 90)}</div></article>") == [varying(k) for k in range(12)]


@pytest.mark.parametrize("n", [6, 7, 8, 12])
def test_constant_notices_go_and_headings_stay(spark, n):
    body = lambda k: f"<article><h1>Daily report</h1><p>{varying(k)}</p><p>This page is printed on recycled paper.</p></article>"
    assert texts(spark, n, body) == [f"Daily report\n{varying(k)}" for k in range(n)]


def test_names_of_boilerplate():
    for name in ("ad", "top-ad", "nav_bar", "site-footer", "log-in", "related-posts", "cookie-notice"):
        assert pages.boilerplate(name)
    for name in ("add", "related-work", "search-engine", "story", "content", "", "header-files", "adverbs"):
        assert not pages.boilerplate(name)


@pytest.mark.parametrize("shape", ["<div></span>", "<div>", "<li>x</b>", "<p><b>"])
def test_deep_and_broken_markup_is_read_in_linear_time(shape):
    page = "<span><i>" + shape * (2_000_000 // len(shape))
    began = time.time()
    pages.walk(page, None)
    assert time.time() - began < 20


def test_paths_of_deep_blocks(spark):
    body = lambda k: "<div>" * 3000 + f"<p>{varying(k)}</p>" + "<div>text</div>" * 50
    got = texts(spark, 4, body)
    assert all(varying(k) in t for k, t in enumerate(got))
