"""Furniture under compound names, deep and broken markup, and a second plain reading of the supplied pages."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from riskloom.llm import html_extract, queries

STORY = "Long words of the story go on and on until the page is full. " * 6


@pytest.mark.parametrize(
    "furniture",
    [
        "<div class='comment-list'><p>Great article, I really liked reading it today.</p></div>",
        "<ol class=user-comments><li>No, I did not like it at all, sorry about that.</li></ol>",
        "<div class='ad-slot'><p>Buy the new car now for very little money.</p></div>",
        "<p class='ad'>Buy the new car now for very little money.</p>",
        "<div class='top-advert x'>Buy it</div>",
        "<div class='newsletter-signup'><p>Sign up for our newsletter and get it on each day.</p></div>",
        "<section id=site-footer>About us and <a href=a>more</a></section>",
        "<div role=navigation><a href=x>home</a></div>",
        "<div role='search'>find</div>",
        "<div class='cookie-consent-banner'><p>We use cookies, as everyone does on this web.</p></div>",
        "<div class='notice-box'><p>This site will be down for an hour on Sunday.</p></div>",
        "<div class='sidebar-left'><p>A few words about the people behind this site.</p></div>",
        "<ul class='related-articles'><li><a href=a>One more story of ours</a><li><a href=b>And another one</a></ul>",
        "<p class='share'>Share this</p>",
        "<div class='comment-list'><div class='inner'><article>no</article></div></div>" * 0 + "<div class='disqus-thread'><h3>Replies</h3></div>",
    ],
)
def test_furniture_under_compound_names_goes(furniture):
    for page in ("<body>%s<article><h1>Head</h1><p>%s</p></article></body>", "<body><article><h1>Head</h1>%s<p>%s</p></article></body>", "<body><div>%s<p>%s</p></div></body>"):
        text = html_extract.text_under(html_extract.blocks(page % (furniture, STORY)), None)
        assert text.replace("Head\n", "") == STORY.strip()


@pytest.mark.parametrize(
    "own",
    [
        "<p class='share'>Share prices rose for the third day in a row, the bank said.</p>",
        "<li class='comment-free'>A point that belongs to the list of the story itself.</li>",
        "<h2 class='related-work'>Related work</h2>",
        "<section id='related-work'><p>Others have written about the same matter before us.</p></section>",
        "<div class='no-comments'><p>What follows belongs to the story as much as the rest.</p></div>",
        "<div class='share-price'><p>The price of one share went up by two in a week.</p></div>",
        "<div class='article-header'><h2>What they found</h2></div>",
        "<p class='notice'>Notice that the words of this line are the story's own.</p>",
    ],
)
def test_the_pages_own_text_stays_whatever_its_class(own):
    found = html_extract.blocks(f"<body><nav>x</nav><article><h1>Head</h1><p>{STORY}</p>{own}</article></body>")
    assert len(html_extract.text_under(found, None).split("\n")) == 3


def test_a_wrapper_named_like_furniture_keeps_its_article():
    for name in ("sidebar-right", "ad-supported", "comments-page", "widget-area"):
        found = html_extract.blocks(f"<div class='{name}'><article><h1>Head</h1><p>{STORY}</p></article></div>")
        assert html_extract.text_under(found, None) == "Head\n" + STORY.strip()


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x", "<a " * 100_000, "<a '" * 100_000, '<a "' * 100_000, "<script " * 50_000, "<!" * 100_000, "<ul><li>" * 50_000 + "<p>x", "<b>" * 50_000 + "</i>" * 50_000]
    + ["<div class='sidebar-x'>" * 30_000 + "<p>x", "<div class=a>x" * 30_000],
)
def test_broken_markup_takes_seconds(page):
    start = time.process_time()
    html_extract.text_under(html_extract.blocks(page), "div>div.a>p")
    assert time.process_time() - start < 10


def test_deep_pages_through_the_operator(spark):
    pages = [(1, "http://a.org/1", "<div>" * 5000 + "<p>" + STORY), (2, "http://a.org/2", None), (3, None, "<a " * 5000)]
    out = html_extract.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {1: STORY.strip(), 2: "", 3: ""}


class Plain(HTMLParser):
    """The text of the first article or main element, or of the body, by the standard library's parser."""

    LEFT_OUT = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "select", "button"}
    BREAKS = {"p", "h1", "h2", "h3", "h4", "div", "li", "ul", "ol", "article", "main", "section", "table", "tr", "td", "blockquote", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts, self.blocks = [], [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        skipped = any(t in self.LEFT_OUT and not (t == "header" and "article" in tags) or c == "ad" for (t, c), tags in zip(self.stack, self.seen()))
        if text and not skipped:
            self.blocks.append((any(t in ("article", "main") for t, _ in self.stack), text))

    def seen(self):
        names = [t for t, _ in self.stack]
        return [names[:i] for i in range(len(names))]

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS or tag in self.LEFT_OUT:
            self.flush()
        if tag not in html_extract.VOID:
            self.stack.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag in self.BREAKS or tag in self.LEFT_OUT:
            self.flush()
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.parts.append(data)


def test_the_supplied_pages_read_twice(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["text"] for r in queries.op1_html_extraction(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").where(F.col("html").isNotNull()).collect()
    differ = 0
    for r in pages:
        plain = Plain()
        plain.feed(r["html"])
        plain.flush()
        inside = [t for within, t in plain.blocks if within] or [t for _, t in plain.blocks]
        differ += "\n".join(inside) != got[r["page_id"]]
    assert len(pages) >= 50 and differ == 0
