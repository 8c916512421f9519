from __future__ import annotations

import html
import itertools
import re
from html.parser import HTMLParser

import numpy as np
import pytest

from pricetrail.llm import crf, extraction, training_pages
from pricetrail.llm.blocks import UNSEEN, blocks

SCHEMA = "page_id long, url string, html string, text string, blocks int, id string"


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>one <b>two</b> three<p>four &amp; five&nbsp;six") == ["one two three", "four & five six"]
    assert texts("a<script>if (a < b) '</p>'</script>b<style>p{}</style><!-- <p>no</p> -->c") == ["abc"]
    assert texts('<div title="a > b">x</div><a href=\'/?a="\'>y</a>') == ["x", "y"]
    assert texts("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert texts("<p>a<br>b</p><p>a<wbr>b</p>")[0] == "a b"
    assert texts("1 < 2 and <b>3</b> > 2") == ["1 < 2 and 3 > 2"]
    assert texts("<article><p><b>x<br><p>y</article><footer>z") == ["x", "y", "z"]
    assert [b.path[-1][0] for b in blocks("<article><p><b>x<br><p>y</article><footer>z")] == ["b", "p", "footer"]
    assert texts("<p>cut &am") == ["cut &am"] and texts("<p>cut <a hre") == ["cut"] and texts("a<!-- open") == ["a"]
    assert texts("<SCRIPT>x</ScRiPt><P CLASS='A'>İ<script>y</SCRIPT>") == ["İ"]
    assert texts("") == texts("<p> \n</p>") == []
    assert texts("</p></div>x</b>") == ["x"]


def test_long_and_deep_pages():
    assert texts("<div>" * 3000 + "x" + "</div>" * 3000) == ["x"]
    assert len(texts("<p>word</p>" * 50_000)) == 50_000
    assert texts("<p>" + "long " * 200_000) == [("long " * 200_000).strip()]


class Plain(HTMLParser):
    """All visible text by the parser of the standard library."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.hidden, self.found = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in UNSEEN
        self.found.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in UNSEEN
        self.found.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def test_no_text_is_lost():
    for page in training_pages.pages(60, 3):
        if page.endswith("</html>"):
            letters = lambda s: re.sub(r"\s+", "", s)
            assert letters("".join(texts(page))) == letters("".join(Plain(page).found))


def test_chain_against_all_label_sequences():
    rng = np.random.default_rng(0)
    between, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    scores, mask = rng.normal(size=(2, 5, 2)), np.array([[True] * 5, [True] * 3 + [False] * 2])
    total, single, pair = crf.marginals(scores, mask, between, start)
    for b, length in enumerate((5, 3)):
        weight = {y: start[y[0]] + sum(scores[b, t, y[t]] for t in range(length)) + sum(between[y[t - 1], y[t]] for t in range(1, length)) for y in itertools.product((0, 1), repeat=length)}
        z = sum(map(np.exp, weight.values()))
        assert total[b] == pytest.approx(np.log(z))
        for t in range(length):
            assert single[b, t, 1] == pytest.approx(sum(np.exp(w) for y, w in weight.items() if y[t]) / z)
        for t in range(1, length):
            assert pair[b, t - 1, 0, 1] == pytest.approx(sum(np.exp(w) for y, w in weight.items() if (y[t - 1], y[t]) == (0, 1)) / z)
        chain = crf.Chain({f"{b} {t}": tuple(scores[b, t]) for t in range(length)}, tuple(map(tuple, between)), tuple(start))
        assert tuple(chain.decode([[f"{b} {t}", "unknown"] for t in range(length)])) == max(weight, key=weight.get)
    assert chain.decode([]) == []


def test_held_out_pages():
    chain, right = extraction.model(), 0
    held_out = training_pages.pages(200, 11)
    for page in held_out:
        want = " ".join(b.text for b in blocks(page) if b.label == "main")
        right += extraction.main_text(page, chain) == want
    assert right >= 0.95 * len(held_out)


def test_odd_rows(spark):
    article = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title</h1><p>Some words here, and more of them.</p></article><footer>&copy; x</footer>"
    rows = [(1, "u", article, "t", 1, "i"), (1, "u", article, "t", 1, "i"), (2, None, None, "t", 1, "i"), (3, "u", "", "t", 1, "i"), (None, "u", article, "t", 1, "i"), (4, "u", "<nav><a href=/>a</a></nav>", "t", 1, "i")]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = extraction.extract(pages, extraction.model(), keep=("url",)).collect()
    want = "Title Some words here, and more of them."
    assert sorted((str(r["id"]), str(r["url"]), r["text"]) for r in got) == sorted([("1", "u", want)] * 2 + [("2", "None", ""), ("3", "u", ""), ("None", "u", want), ("4", "u", "")])
    assert extraction.extract(pages.limit(0), extraction.model()).collect() == []


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in extraction.op7_extraction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])
