"""HTML extraction, URL filter, chat formatting, packing and quality scores."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import chat, html_extract, packing, quality, queries, url_filter


def test_blocks_leave_out_furniture():
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var x='</p><p>no';</script></head><body>"
        "<nav><ul><li><a href='/'>menu</a></ul></nav><div class='ad-1 big'>buy</div><main class='c12'><article><header><h1>Head &amp; line</h1></header>"
        "<p>one  <b>two\n<br>three<p>four &lt;five&gt; &eacute;&#233;<!-- <p>no --><form>in<input></form>"
        "<div class='comments'><p>reader</div><aside>side</aside></article></main><footer>&copy; me</footer>"
    )
    found = html_extract.blocks(page)
    assert [b.text for b in found] == ["Head & line", "one two three", "four <five> éé"]
    assert html_extract.best_container(found)[0] == "html>body>main.c>article"
    assert html_extract.text_under(found, "html>body>main.c>article") == "Head & line\none two three\nfour <five> éé"
    assert html_extract.text_under(found, "html>body>div.gone") == "Head & line\none two three\nfour <five> éé"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='no-sidebar comments-open'><p>%s",
        "<body class='sidebar' aria-hidden='true'><main class='widget' id='comments'><p>%s",
        "<article class='post has-comments'><p>%s",
        "<article class='post comment'><p>%s",
        "<div class='entry-header'><h1>%s</h1></div>",
        "<article><div class='header'><h1>%s</h1></div></article>",
        "<h2 id='related-work'>%s</h2>",
        "<section><h2 id='comments'>%s</h2></section>",
        "<main class='overflow-hidden' style='overflow-x:hidden'><p>%s",
        "<div data-hidden='no' data-class='ad' title='hidden' style='x-display:none'><p>%s",
    ],
)
def test_names_that_only_hold_a_furniture_word_cost_nothing(page):
    found = html_extract.blocks("<div class='ad'>x</div>" + page % "the text")
    assert [b.text for b in found] == ["the text"]
    assert html_extract.text_under(found, None) == "the text"


@pytest.mark.parametrize(
    "attributes", ["class='x ad'", "class=ad-12", "id=comments", "class='cookie-notice'", "hidden", "HIDDEN=''", "aria-hidden='true'", "style='color:red; display : none'"]
)
def test_furniture_by_name_goes(attributes):
    found = html_extract.blocks(f"<body><div {attributes}><p>gone<div>too</div></div><p>stays")
    assert [b.text for b in found] == ["stays"]


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- a", "<script>x", "</p></div>", "a < b & c", "<p>" * 500, "&am", "<div class=>x"])
def test_odd_pages(page):
    html_extract.text_under(html_extract.blocks(page), None)


LEAD = "A short lead says what happened on that day."
STORY = "The story itself goes on for very many words and has the weight of the page. " * 4
ABOVE = [
    ("<article><h1>Headline</h1><p>%s</p><div class=content><p>%s</p></div></article>", ["Headline", LEAD, STORY]),
    ("<article><header><h1>Headline</h1></header><p>%s</p><div><div class=c><p>%s</p></div></div></article>", ["Headline", LEAD, STORY]),
    ("<main><section class=intro><p>%s</p></section><section class=body><p>%s</p></section></main>", [LEAD, STORY]),
    ("<div class=page><section class=intro><p>%s</p></section><section class=body><h2>Two</h2><p>%s</p></section></div>", [LEAD, "Two", STORY]),
    ("<h1>Headline</h1><div class=lead>%s</div><div class=body><p>%s</p></div><div>Imprint</div>", ["Headline", LEAD, STORY, "Imprint"]),
    ("<div class=top><a href='/'>Home of all the news there is, and more of it, and more.</a></div><div><p>%s</p><div class=body><p>%s</p></div></div>", [LEAD, STORY]),
]


@pytest.mark.parametrize("page, want", ABOVE)
def test_headline_lead_and_sections_come_along(page, want):
    found = html_extract.blocks("<html><body><nav>menu</nav>" + page % (LEAD, STORY) + "<footer>foot</footer></body></html>")
    path = html_extract.best_container(found)[0]
    text = "\n".join(w.strip() for w in want)
    assert html_extract.text_under(found, path) == html_extract.text_under(found, None) == text


def test_the_vote_is_on_the_wider_container(spark):
    page, want = ABOVE[0]
    plain = "<html><body><div class=box><p>%s</p></div>%s</body></html>"
    bodies = [plain % ("x " * 3, page % (LEAD, STORY)) for _ in range(3)] + [plain % (STORY * 3, page % (LEAD, LEAD))]
    rows = spark.createDataFrame([(i, "http://a.org/x", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    got = html_extract.host_paths(rows).collect()
    assert [(r.path, r.votes) for r in got] == [("html>body>article", 3)]
    texts = {r.page_id: r.text for r in html_extract.extract_text(rows).collect()}
    assert texts[0] == texts[2] == "\n".join(w.strip() for w in want)


def test_hosts_vote(spark):
    body = "<html><body><div class='story'><p>%s</div><div class='extra'><p>%s</div></body></html>"
    long, short = "many words of a story " * 5, "few words"
    rows = [(i, "http://A.org/x", body % (long, short), "own") for i in range(4)] + [(4, "http://a.org/y", body % (short, long), "own")]
    rows += [(5, None, None, "own"), (6, None, "<p>no host", "own"), (7, "http://b.org", "", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for hosts in (100, 0):
        got = {r.page_id: r.text for r in html_extract.extract_text(pages, broadcast_hosts=hosts).collect()}
        assert got == {**{i: long.strip() for i in range(4)}, 4: short, 5: "", 6: "no host", 7: ""}
    assert html_extract.extract_text(pages.limit(0)).collect() == []


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best


def test_url_rules(spark):
    urls = [None, "", "net/", "http://x.net", "http://X.NET/a?b=/en/", "a://example.net/en/x", "http://www.Example.net/en/#", "http://notexample.com/de/1"]
    urls += ["http://example.com/de/1?x=1&y=2", "https://a.example.com/en/", "http://org/fr/", "http://a.org/de/", "x://y://z.net/", "http://a\nb.net/\n", "http://xnet/", "://"]
    rows = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)] * 2, "page_id long, url string, path string")
    got = url_filter.judge_urls(rows, queries.RULES).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host, path, rule = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text), urls[r.page_id]
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(rows.limit(0), queries.RULES).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(rows, []).collect()} == {"allow"}


def test_url_model_learns_from_labels(spark):
    rng = random.Random(1)
    urls = [(f"http://h{i % 7}.org/{rng.randrange(10**9)}?a=1&b=2&c=3", "block") for i in range(200)]
    urls += [(f"http://h{i % 7}.org/{'-'.join(rng.choices(['news', 'story', 'day'], k=3))}", "allow") for i in range(200)]
    labelled = spark.createDataFrame(urls, "url string, verdict string")
    got = url_filter.judge_urls(labelled.withColumnRenamed("verdict", "truth"), [], labelled).collect()
    assert np.mean([r.verdict == r.truth for r in got]) > 0.97


def test_escapes_are_reversible():
    rng = random.Random(2)
    parts = ["\\", "###", "#", "</turn>", "</turn", "\n", " a ", "<", "\\\\", ": ", "é", "\U0001f600"]
    for _ in range(300):
        messages = [("".join(rng.choices(parts, k=3)), "".join(rng.choices(parts, k=rng.randrange(8)))) for _ in range(rng.randrange(4))]
        text, spans = chat.render(messages, frozenset(r for r, _ in messages))
        assert chat.parse(text) == messages
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for _, t in messages]
    with pytest.raises(ValueError):
        chat.parse("### user\nno end")


def test_events_are_folded(spark):
    rows = [
        (1, 5, "b", "delta", None, "lo"), (1, 4, "b", "delta", "assistant", "Hel"), (1, 1, "a", "message", "user", "hi"),
        (1, 6, "c", "message", "user", "gone later"), (1, 7, "b", "regenerate", None, "Good "), (1, 8, "b", "delta", None, "day"),
        (1, 9, "a", "edit", None, "hi!"), (1, 10, None, "message", None, None), (1, 11, "x", "message", "user", "?"), (1, 12, "x", "remove", None, None),
        (2, 1, "z", "remove", None, None), (None, 1, None, "message", "user", "u"), (None, 1, None, "message", "user", "u"),
    ]
    got = {r.conv: r for r in chat.format_chats(spark.createDataFrame(rows, chat.EVENTS).withColumn("n_turns", F.lit(1))).collect()}
    assert chat.parse(got[1].formatted) == [("user", "hi!"), ("assistant", "Good day"), ("", "")]
    assert [got[1].formatted[s["from"] : s["to"]] for s in got[1].loss] == ["Good day"]
    assert got[2].formatted == "" and got[2].n_turns == 0
    assert chat.parse(got[None].formatted) == [("user", "u"), ("user", "u")]
    assert chat.format_chats(spark.createDataFrame([], chat.EVENTS)).collect() == []


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(1)
    for size in (1, 5, 400):
        lengths = np.sort(rng.integers(1, 65, size))[::-1]
        numbers, offsets = packing.best_fit(lengths, 64)
        room = []
        for length, number, offset in zip(lengths, numbers, offsets):
            fits = [r for r in room if r >= length]
            want = min(fits) if fits else 64
            if fits:
                room.remove(want)
            assert 64 - offset == want
            room.append(want - length)
        assert len(set(zip(numbers, offsets))) == size


def test_pieces_are_the_ids_of_whole_texts(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rng = random.Random(3)
    odd = ["It's", "don't", " ", "\n", "\t", "\x1c", "\u00a0", "\u0301e", "é", "e\u0301", "ΣΑΣ", "<|endoftext|>", "12ab", "...", "\u2028", "日本", "\U0001f600", "a"]
    texts = [None, "", "  \n "] + ["".join(rng.choices(odd, k=rng.randrange(1, 30))) for _ in range(200)] + ["word " * 9000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "y")], "doc_id long, text string, ids string")
    got = packing.pack_pieces(packing.token_pieces(docs, path, window=256), 256, group_pieces=64).collect()
    tokenizer = Tokenizer.from_file(path)
    by_doc = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        own = by_doc[i] if i else by_doc[i][:1]
        assert b"".join(bytes(r["ids"]) for r in own) == ids, repr(text)
        assert [r.start for r in own] == list(range(0, len(ids) // 4, 256)) and {r.doc_tokens for r in own} == {len(ids) // 4}
    assert len(by_doc[0]) == 2
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 256
    assert packing.pack_pieces(packing.token_pieces(docs.limit(0), path)).collect() == []


def test_packing_leaves_little_room(spark):
    out = queries.op5_packing(spark, "/root/testdata/sf0.01")
    row = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("s")).first()
    assert row.n / (4096 * row.s) > 0.99


def test_pooled_neighbours():
    assert quality.pooled_neighbours(np.array([1.0, 0.0, 2.0, 2.0, 1.0]), np.ones(5)).tolist() == [0.5, 0.5, 5 / 3, 5 / 3, 5 / 3]


def test_quality_on_rows_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op7_quality_classifier(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.5) for r in got)
    seen = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in seen]) > 0.9


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "a b", 0.1), (3, "a b", 0.1), (3, "a b", 0.1), (4, "x" * 300_000, 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 5)] * 3 + [(3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, some).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(docs, none).count() == 6
    assert quality.quality_scores(docs.limit(0), some).collect() == []
