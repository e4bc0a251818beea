"""Main text of held-out pages: none of them is a labelled page, each has its article written beside it."""

import html
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from lodestream.llm import html_extract

A = "The river rose in the night and the town woke to water in the lower streets, said the mayor on Monday."
B = "By noon the bridge was closed, and trains stood still between the two stations for most of the day."
NAV = "<nav><a href=/a>Home</a> <a href=/b>News of the day</a></nav>"
FOOT = "<footer>Copyright 2024 <a href=/p>Privacy</a></footer>"
TWO = f"<p>{A}</p><p>{B}</p>"
PAGES = {
    "body marked": (f"<body class='no-sidebar'>{NAV}<h1>Flood</h1>{TWO}{FOOT}</body>", ["Flood", A, B]),
    "html marked": (f"<html class='has-header'><body>{NAV}<h1>Flood</h1>{TWO}{FOOT}</body></html>", ["Flood", A, B]),
    "wrapper marked": (f"<body><div id='ad-free'>{NAV}<h1>Flood</h1>{TWO}{FOOT}</div></body>", ["Flood", A, B]),
    "page in a form": (f"<body><form action=/x>{NAV}<h1>Flood</h1>{TWO}{FOOT}</form></body>", ["Flood", A, B]),
    "title in a post header": (f"<body>{NAV}<article><div class='post-header'><h1>Flood</h1></div>{TWO}</article>{FOOT}</body>", ["Flood", A, B]),
    "two short paragraphs": ("<body><p>A short note for all.</p><p>And one more line here.</p></body>", ["A short note for all.", "And one more line here."]),
    "main with contents": (f"<body>{NAV}<main class='with-toc'><h1>Flood</h1>{TWO}</main>{FOOT}", ["Flood", A, B]),
    "comments beside": (f"<article><h1>Flood</h1>{TWO}</article><div class='comments'><p>{'I liked it very much and so did all of us here. ' * 3}</p></div>", ["Flood", A, B]),
    "comments longer than the article": (f"<article><h1>Flood</h1><p>{A}</p></article><section id=discussion>{''.join(f'<p>{B} {B}</p>' for _ in range(9))}</section>{FOOT}", ["Flood", A]),
    "advert inside, aside behind": (f"<article><h1>Flood</h1><p>{A}</p><div class='ad'>Buy now the best of all things</div><p>{B}</p></article><aside><h3>Related</h3><p>{'Other stories you may like. ' * 4}</p></aside>", ["Flood", A, B]),
    "menu without nav": (f"<div><a href=1>One</a><a href=2>Two</a><a href=3>Three</a></div><div><h1>Flood</h1>{TWO}</div><div>Contact us <a href=4>Terms</a></div>", ["Flood", A, B]),
    "last words are few": (f"{NAV}<article><h1>Flood</h1>{TWO * 5}<p>More soon.</p></article>", ["Flood", *[A, B] * 5, "More soon."]),
    "list and table": (f"{NAV}<article><h1>Flood</h1><p>{A}</p><ul><li>Bridge shut<li>Trains late</ul><table><tr><td>Level<td>7 m</table></article>", ["Flood", A, "Bridge shut", "Trains late", "Level", "7 m"]),
    "cookie notice and newsletter": (f"<div class='cookie-banner'><p>{'We use cookies to make it all better. ' * 5}</p><button>Accept</button></div><article><h1>Flood</h1><p>{A}</p><div class='newsletter'><h3>Stay informed</h3><p>{'Get the news each day. ' * 4}</p></div><p>{B}</p></article>", ["Flood", A, B]),
    "references and formulas": (f"<article><p>Caf&eacute; &amp; <math><mi>x</mi></math>\n is&nbsp;open.</p><p>{A}</p></article>", ["Café & x is open.", A]),
    "links only": ("<nav><a href=1>A</a></nav><ul><li><a href=1>First story of all</a><li><a href=2>Second story</a><li><a href=3>Third</a></ul>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_held_out_pages(name):
    page, expected = PAGES[name]
    assert html_extract.main_text(page).split("\n") == (expected or [""])


def test_the_tree_asks_more_than_names():
    asked = set()

    def walk(tree):
        if not isinstance(tree, int):
            asked.add(html_extract.FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(html_extract.TREE)
    assert {"density", "words after", "share of the page", "article"} <= asked
    rows = html_extract.labelled_rows()
    right = sum(html_extract.decide(html_extract.TREE, r[:-1]) == r[-1] for r in rows)
    assert right >= 0.98 * len(rows)


def test_pages_of_the_table_equal_their_articles(spark):
    """The given pages have one article each; its words, without the adverts in it, are the text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_extract.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article[^>]*>(.*)</article>", r.html, re.S)[1]
        inner = re.sub(r'<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<div class="ad">.*?</div>', "", inner, flags=re.S)
        assert r.text.split() == html.unescape(re.sub(r"<[^>]+>", " ", inner)).split() and r.n_chars == len(r.text)


def test_null_repeated_long_and_clashing_pages(spark):
    long = "<article>" + "".join(f"<p>{A} {i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", long, "x"), (3, "u", long, "x"), (None, "u", "<p>" * 3000 + "deep", "x"), (4, "u", "<" * 5000 + "a" * 100, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_extract.extract(frame).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == len(rows) and by[1].text == by[2].text == "" and by[1].n_chars == 0
    assert by[3].text.count("\n") == 19_999 and by[None].text == "deep"
    assert html_extract.extract(frame.limit(0)).count() == 0


ODD_PAGES = {
    "an endless tag": "<p>hello</p><" + "a" * 1_000_000,
    "endless declarations": "<p>hello</p>" + "<?" * 500_000,
    "endless links": "<p>hello</p>" + "<a" * 500_000,
    "closing tags of nothing": "<p>hello</p>" + "<div>" * 60_000 + "</p>" * 60_000 + "</nav>" * 60_000,
    "items far below a list": "<p>hello</p><li><ul>" + "<nav>" * 60_000 + "<li></li>" * 50_000,
    "sources that end nowhere": "<p>hello</p>" + "<annotation>" * 80_000,
}


@pytest.mark.parametrize("name", sorted(ODD_PAGES))
def test_odd_pages_of_a_megabyte_take_linear_time(name):
    began = time.process_time()
    html_extract.blocks(ODD_PAGES[name])
    assert time.process_time() - began < 8  # seconds or hours


def article_words(page):
    body = re.sub(r'<div class="ad">.*?</div>', " ", re.search(r"<article>(.*?)</article>", page, re.S)[1], flags=re.S)
    return html.unescape(re.sub(r"<[^>]*>", " ", body)).split()


def test_given_pages_with_and_without_their_marks():
    """With their marks the given pages give their article; without any, nearly its words: counts and densities decide there."""
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    shares = []
    for page in pages:
        wanted = article_words(page)
        assert html_extract.main_text(page).split() == wanted
        bare = re.sub(r"<(/?)(?:nav|footer|article)\b[^>]*>", r"<\1div>", page).replace(' class="ad"', "")
        got = Counter(html_extract.main_text(bare).split())
        shares.append(2 * sum((got & Counter(wanted)).values()) / max(1, sum(got.values()) + len(wanted)))
    assert sum(shares) / len(shares) > 0.95


def test_upper_nodes_on_pages_without_marks_are_counts_and_densities():
    k, _, bare, _ = html_extract.TREE
    assert html_extract.FEATURES[k] == "page has marks"
    upper = [bare[0], *(side[0] for side in bare[2:] if isinstance(side, tuple))]
    assert {html_extract.FEATURES[f] for f in upper} <= {"words", "density", "words before", "density before", "words after", "density after"}
