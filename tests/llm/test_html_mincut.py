"""Cuts against all labellings, reading of odd markup, and whole pages with planted articles."""

import itertools
import random
import re
from html import unescape

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tablepact.llm import html_mincut as H

PRIOR_ODDS = H.shape_odds({})
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def total(unary, edges, content):
    return (sum(u for u, c in zip(unary, content) if u > 0 and not c) - sum(u for u, c in zip(unary, content) if u < 0 and c)
            + sum(w for i, j, w in edges if content[i] != content[j]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=9), st.data())
def test_cut_is_the_least_of_all_labellings(unary, data):
    n = len(unary)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 6)).filter(lambda e: e[0] != e[1]), max_size=14))
    got = H.minimum_cut(unary, edges)
    best = min(total(unary, edges, c) for c in itertools.product((False, True), repeat=n))
    assert total(unary, edges, got) == best
    widest = max((c for c in itertools.product((False, True), repeat=n) if total(unary, edges, c) == best), key=sum)
    assert tuple(got) == widest  # of equal labellings the one with most content


def test_long_chain_of_blocks():
    rng = random.Random(1)
    unary = [rng.choice([700, -700, 200, -200, 0]) for _ in range(5_000)]
    edges = [(i, i + 1, 500) for i in range(len(unary) - 1)]
    # least cost by dynamic programming along the chain
    keep = drop = 0
    for i, u in enumerate(unary):
        if i:
            keep, drop = min(keep, drop + 500), min(drop, keep + 500)
        keep, drop = keep + max(0, -u), drop + max(0, u)
    assert total(unary, edges, H.minimum_cut(unary, edges)) == min(keep, drop)


def blocks(html):
    return [b[0] for b in H.Page(html).blocks]


@pytest.mark.parametrize("html, expected", [
    ("", []), (" \n ", []), ("plain &amp; text", ["plain & text"]),
    ("<p>a<b>b</b>c<p>d", ["abc", "d"]), ("<p>a<br>b</p>", ["a b"]), ("<p>x &lt; y &#8364; &eacute; &copy 1 &am</p>", ["x < y € é © 1 &am"]),
    ("a < b <3 </p>", ["a < b <3"]), ("<p>one\n\t two three</p>", ["one two three"]),
    ("<!-- c <p>x</p> --><p>a</p><!-->b", ["a", "b"]), ("<p>a<!-- open", ["a"]), ("<script>var t='<p>no</p>';</script><p>a", ["a"]),
    ("<script>if (a</b/) {}</SCRIPT >x", ["x"]), ("<script>never closed <p>a</p>", []), ("<style>p{}</style>b", ["b"]),
    ("<head><title>t</title><p>a", ["a"]), ("<head><meta charset=utf-8><title>t</title></head><body>a", ["a"]),
    ('<p title="a > b">c</p>', ["c"]), ("<p title='open>c</p>", ["c"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<div>a<div>b</div>c</div>", ["a", "b", "c"]),
    ("<p><b>bold<br><p>next</b> one</p>", ["bold", "next one"]), ("<select><option>a<option>b</select><button>go</button>t", ["t"]),
    ("<P>A</P><DIV>B</DIV>", ["A", "B"]), ("<p>a</div>b</p>", ["a", "b"]), ("<p>a", ["a"]), ("<p", []), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
])
def test_blocks(html, expected):
    assert blocks(html) == expected


BODY = ["A Heading", "The first paragraph tells, at some length, what the matter is and why it should be told at all.", "Short.",
        "A second one with a link in it goes on for a good while, as paragraphs do when there is more to say.", "One item", "Another item",
        "It ends here, with a closing sentence that is neither very short nor very long."]
INNER = (f"<h1>{BODY[0]}</h1><p>{BODY[1]}</p><p>{BODY[2]}</p><p>A second one with <a href=/x>a link</a> in it goes on for a good while, as paragraphs do when "
         f"there is more to say.</p><ul><li>{BODY[4]}</li><li>{BODY[5]}</li></ul><p>{BODY[6]}</p>")
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News and views</a></li><li><a href=/c>About us</a></li></ul>"
SENTENCE = "This is a whole sentence of boilerplate that reads just like the article, with commas, and ends as one."
COMMENTS = f"<h3>2 comments</h3><div><p>{SENTENCE}</p></div><article><p>I agree with all of it, and would like to add that I do so wholeheartedly.</p></article>"

SITES = {
    "semantic": f"<body><header><a href=/>Site</a><p>{SENTENCE}</p></header><nav>{MENU}</nav><main><article>{INNER}</article></main>"
                f"<aside><p>{SENTENCE}</p></aside><section id=comments>{COMMENTS}</section><form><label>Mail</label><input><p>{SENTENCE}</p></form>"
                f"<footer><p>{SENTENCE}</p></footer>",
    "names": f"<body class='page sidebar-right'><div id=top-header><h1>The Site</h1></div><div class=main-menu>{MENU}</div><div id=cookieNotice>{SENTENCE}</div>"
             f"<div class='wrapper has-sidebar'><div class=post-content>{INNER}</div><div class=sidebar><p>{SENTENCE}</p></div></div>"
             f"<div class='ad'>{SENTENCE}</div><div class=comments-area>{COMMENTS}</div><div class=footer>&copy; 2024 Site</div>",
    "inside": f"<body><article><header>{INNER[: INNER.index('<p>')]}</header>{INNER[INNER.index('<p>') :].replace('<ul>', f'<div class=ads>{SENTENCE}</div><ul>', 1)}"
              f"<aside>{SENTENCE}</aside><div class=share>{MENU}</div><footer>{SENTENCE}</footer><section class=comments>{COMMENTS}</section></article>",
    "framed": f"<body><form action=/page><div role=navigation>{MENU}</div><div>{INNER}</div><div role=contentinfo>{SENTENCE}</div></form>",
    "bare": f"<body><div>{MENU}</div><div>{INNER}</div><div><a href=/p>Privacy</a> <a href=/t>Terms</a> &copy; 2024 Site</div>",
    "related": f"<body><article class='post tag-news'>{INNER}</article><div class=related><article><a href=/1>Other</a><p>{SENTENCE}</p></article></div>"
               f"<div hidden><p>{SENTENCE}</p></div><div style='display: none'>{SENTENCE}</div><noscript>{SENTENCE}</noscript>",
}


@pytest.mark.parametrize("site", SITES)
def test_articles_of_many_sites(site):
    html = f"<!DOCTYPE html><html><head><title>T</title><style>x</style><script>y</script></head>{SITES[site]}</html>"
    assert H.main_text(html, PRIOR_ODDS).split("\n") == BODY


def test_smoothness_holds_short_blocks_by_their_neighbours():
    html = f"<div><p>{BODY[1]}</p><p>Hm</p><p>{BODY[3]}</p></div><div><a href=/a>x</a> y</div>"
    page = H.Page(html)
    unary, edges = H.costs(page, PRIOR_ODDS), H.smoothness(page)
    assert unary[1] < 0 and H.minimum_cut(unary, [])[1] is False and H.minimum_cut(unary, edges)[1] is True


def truth(html):
    body = re.search(r"<article>(.*)</article>", html, re.S)[1]
    parts = (" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


def test_given_pages_give_their_articles(spark):
    sf = "/root/testdata/sf0.001"
    html = {r["page_id"]: r["html"] for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    rows = H.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: truth(h) for i, h in html.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_training_learns_from_cues_and_keeps_counts_small(spark):
    link = "".join(f"<a href=/{i}>word{i} more</a> " for i in range(9))
    pages = spark.createDataFrame([(i, f"u{i}", f"<nav><p>{SENTENCE}</p></nav><article><p>{link}</p></article>") for i in range(200)], PAGES)
    odds = H.train(pages)
    assert odds["links", 3] > 0 > odds["links", 0]  # against the prior: here the articles are all links
    assert PRIOR_ODDS["links", 3] < 0 < PRIOR_ODDS["links", 0]
    assert H.train(pages.limit(0)) == PRIOR_ODDS
    some = H.train(pages, sample_pages=20)
    assert PRIOR_ODDS["links", 3] < some["links", 3] < odds["links", 3]


def test_odd_rows(spark):
    long = f"<article><p>{'word ' * 200_000}</p>" + "<p>x.</p>" * 5_000 + "</article>"
    deep = "<div>" * 20_000 + "<p>deep down there is one sentence, and it is here.</p>"
    rows = [(1, None, None), (2, "u", ""), (None, "u", f"<article>{INNER}</article>"), (4, "u", f"<article>{INNER}</article>"), (4, "u", f"<article>{INNER}</article>"),
            (5, "u", "<nav>only a menu</nav>"), (6, "u", long), (7, "u", deep)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS odds")
    got = H.extract(pages).collect()
    texts = sorted(((r["page_id"], r["url"], r["text"]) for r in got), key=repr)
    whole = "\n".join([("word " * 200_000).strip()] + ["x."] * 5_000)
    assert texts == sorted([(1, None, ""), (2, "u", ""), (None, "u", "\n".join(BODY)), (4, "u", "\n".join(BODY)), (4, "u", "\n".join(BODY)), (5, "u", ""),
                            (6, "u", whole), (7, "u", "deep down there is one sentence, and it is here.")], key=repr)
    assert H.extract(pages.limit(0)).count() == 0
