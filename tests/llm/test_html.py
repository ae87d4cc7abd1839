import html
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import html_extract as H
from tidemark.llm.dom import blocks, features


def text_of(source):
    return H.main_texts(H.model(), [source])[0]


def article(source):
    inside = re.search(r"<article>(.*)</article>", source, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))).split())


def test_pages_against_their_articles(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for r in H.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        assert r.text == article(r.html) and r.n_chars == len(r.text)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_every_page_of_a_folder(folder):
    """All pages, those of one-sentence articles above text-only footers too."""
    sources = pq.read_table(f"/root/testdata/{folder}/pages.parquet", columns=["html"])["html"].to_pylist()
    assert [k for k, (s, t) in enumerate(zip(sources, H.main_texts(H.model(), sources), strict=True)) if t != article(s)] == []


def test_a_footer_longer_than_its_article():
    for foot in ("&copy; site.example.org &middot; Some words that say a little more than the article above does, and more.", "All that is written here may be read, told and printed again by all. Ask us first."):
        for said in ("<b>Short one.<br>", "Short one.</p>", "<b>Short one.</b>"):
            assert text_of(f"<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>Short one.</h1><p>{said}</article><footer>{foot}</footer></body></html>") == "Short one. Short one."


def test_generated_pages_not_trained_on():
    rng, wrong = random.Random(5), 0
    for _ in range(120):
        source = H.Forge(rng).page()
        page = blocks(source)
        want = " ".join(b.text for b, g in zip(page, H.gold(page), strict=True) if g and b.text)
        wrong += want != text_of(source)
    assert wrong <= 12


def test_decoding_keeps_no_block_below_a_dropped_one():
    page = blocks("<div><p>a b</p><p>c</p></div><section><p>d</p></section>")
    assert [b.tag for b in page] == ["#root", "div", "p", "p", "section", "p"]
    assert H.decode(page, np.array([1, -5, 2, 2, -1, 3.0])) == ["d"]
    assert H.decode(page, np.array([1, -1, 2, -2, 1, -3.0])) == ["a b"]


def test_decoding_is_the_best_choice():
    page = blocks("<div><p>a</p><div><p>b</p>c<p>d</p></div></div><p>e</p>")
    rng = np.random.default_rng(3)
    for _ in range(40):
        odds = rng.normal(size=len(page)) * 2
        best = 0.0
        for pick in range(2 ** (len(page) - 1)):
            on = [True, *(bool(pick >> i & 1) for i in range(len(page) - 1))]
            if all(on[b.up] for b, k in zip(page, on, strict=True) if k and b.up >= 0):
                best = max(best, sum(o for o, k in zip(odds[1:], on[1:], strict=True) if k))
        kept = H.decode(page, odds)
        worth = odds.copy()
        for i in range(len(page) - 1, 0, -1):
            worth[page[i].up] += max(0, worth[i])
        assert abs(worth[0] - odds[0] - best) < 1e-9 and isinstance(kept, list)


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("<p>a&amp;b &lt;i&gt; &quo <b>c</b>d<p>e<br>f", ["a&b <i> &quo cd", "e f"]),
        ("<ul><li>a<li>b</ul>x<script>'</p>'</script>y", ["a", "b", "xy"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("a <!-- <p>no</p> --> b < c <3 <p title='>'>d</p></div>", ["a b < c <3", "d"]),
        ("<p>cut<foo", ["cut"]),
        ("<p>cut</p><script>x", ["cut"]),
        ("<head><title>t</title><body><p>a", ["a"]),
        ("<a href=x>l<p>m</p></a>n", ["l", "m", "n"]),
        ("", []),
    ],
)
def test_blocks(source, texts):
    assert [b.text for b in blocks(source) if b.text] == texts


def test_odd_pages(spark):
    rows = [(None, None, None, 1), (1, "u", None, 2), (2, None, "", 3), (2, None, "", 3), (3, "v", "<div>" * 3000 + "deep", 4), (4, "w", "<article><p>" + "long text. " * 60_000 + "</p></article>", 5), (5, "x", "\0<p>&#0;&#x110000;</p>", 6)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows) and got[0].text == "" and got[0].n_chars == 0
    assert next(r for r in got if r.page_id == 4).n_chars == 60_000 * 11 - 1
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert features(blocks("")).shape[0] == 1


def test_parsing_takes_time_in_proportion():
    n = 100_000
    for source in ("<b>" * n + "</i>" * n, "<i>" * n + "<b>" * n + "</i>" * n, "<p><table><tr><td>" + "<b>" * n + "<div>" * n, "<div>" * n + "</div>" * n, "<p>x" * n):
        began = time.process_time()
        blocks(source)
        assert time.process_time() - began < 8


@pytest.mark.parametrize("name", ["button", "object", "noscript", "canvas", "select", "svg", "template", "video", "math", "datalist"])
def test_an_element_left_open_hides_no_article(name):
    prose = "The river rose in the night and the town woke to water in its streets. " * 4
    source = f"<html><body><div class='menu'><{name}><p>OK</div><article><h1>Flood</h1><p>{prose}</p><p>{prose}</p></article></body></html>"
    assert prose.strip() in text_of(source)


def test_text_of_formulas_buttons_and_noscript_stays():
    prose = "The lake is cold, and nobody swims there before the end of May. " * 4
    source = f"<html><body><article><h1>Cold</h1><p>{prose}</p><p>We have <math><mi>x</mi> = <mn>2</mn></math> as result.</p><noscript><p>{prose}</p></noscript><p>{prose} Press <button>OK</button> to go.</p></article></body></html>"
    got = text_of(source)
    assert "We have x = 2 as result." in got and got.count("nobody swims") == 12 and "Press OK to go." in got
