"""Operator 6: hand-made pages of several builds."""

import html
import re

from tagweave.llm import queries as Q
from tagweave.llm.html_text import extract_pages, main_text

SF = "/root/testdata/sf0.001"
LONG = ["The first paragraph of the story has enough words to be read.", "A second one, with a comma &amp; a sign, follows it here.",
        "The third closes the page with yet more words than needed."]


def test_named_surroundings_are_left_out():
    page = f"""<html><body class="has-sidebar"><header id="top"><a href=/>Home</a> Site</header>
<div class="cookie-notice">We use cookies, accept all of them please now.</div>
<div id="wrapper"><div class="sidebar"><ul><li><a>One</a><li><a>Two</a></ul></div>
<div class="post"><h2>Title &lt;x&gt;</h2><p>{LONG[0]}<p>{LONG[1]}\n  <b>bold</b><a href="x"> link</a>
<form><input> Name</form><ul><li>item one<li>item two</ul><script>var a="<p>no</p>"</script></div>
<div id="comments"><div class="comment"><p>Great post, I like it very much indeed, thanks for that and more.</p></div></div></div>
<footer>foot</footer></body>"""
    assert main_text(page) == "\n\n".join(["Title <x>", LONG[0], html.unescape(LONG[1]) + " bold link", "item one", "item two"])


def test_density_chooses_without_names():
    links = "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(30))
    body = "".join(f"<p>{p}</p>" for p in LONG)
    page = f"<body><div><ul>{links}</ul></div><div><div>{body}</div></div><div><a>x</a> <a>y</a></div></body>"
    assert main_text(page) == "\n\n".join(html.unescape(p) for p in LONG)


def test_sections_of_one_article():
    page = "<body><div>" + "".join(f"<section><p>{p}</p><p>{p}</p></section>" for p in LONG) + "</div><div><a>l</a></div></body>"
    assert main_text(page).split("\n\n") == [html.unescape(p) for p in LONG for _ in (0, 1)]


def test_names_are_a_hint():
    text = [html.unescape(p) for p in LONG]
    body = "".join(f"<p>{p}</p>" for p in LONG)
    links = "<div class='sidebar'><ul><li><a href=/>One</a><li><a href=/>Two</a></ul></div>"
    for attrs in ("id=page class='content with-sidebar'", "class=has-comments", "class='no-widgets'", "class='post notice-free'", "class=layoutWithSidebar",
                  "class='sidebar-layout'", "class=widget", "class='page related'"):
        assert main_text(f"<body><div {attrs}>{body}{links}</div><div class=footer>All rights.</div></body>").split("\n\n") == text, attrs
    # each block of the text in a box that is named among other words
    boxes = "".join(f"<div class='el el-widget el-text'><p>{p}</p><p>{p}</p></div>" for p in LONG)
    assert main_text(f"<body><div>{boxes}</div>{links}</body>").split("\n\n") == [p for p in text for _ in (0, 1)]
    # inside a kept article
    more = f"<div class='related-work'><p>{LONG[0]}</p></div><p class='form'>{LONG[2]}</p>"
    share = "<div class='share'>Share this with friends</div><div class='my-related'><a href=/a>A link to more</a> <a href=/b>And one more</a></div>"
    assert main_text(f"<body><article>{body}{more}{share}</article></body>").split("\n\n") == [*text, text[0], text[2]]
    # many named comments are longer than the article, but none of them is it
    said = "".join(f"<div class=comment><p>{p} {p}</p></div>" for p in LONG * 3)
    assert main_text(f"<body><div>{body}</div><div id=comments>{said}</div></body>").split("\n\n") == text


def test_several_articles():
    text = [html.unescape(p) for p in LONG for _ in (0, 1)]
    parts = [f"<article><h2></h2><p>{p}</p><p>{p}</p></article>" for p in LONG]
    teaser = "<article><a href=/x>Another story with a long title</a></article>"
    said = f"<section id=comments><article><p>{LONG[1]} {LONG[1]}</p></article><article class=comment><p>{LONG[0]}</p></article></section>"
    assert main_text(f"<body><main>{''.join(parts)}</main></body>").split("\n\n") == text
    nested = f"<article><p>{LONG[0]}</p><p>{LONG[0]}</p><article><p>{LONG[1]}</p><p>{LONG[1]}</p></article><p>{LONG[2]}</p><p>{LONG[2]}</p></article>"
    assert main_text(f"<body>{nested}<div><a href=/>Home</a></div></body>").split("\n\n") == text
    # one of them holds the densest text, the others stand beside it or in boxes of their own
    big = f"<article><div>{''.join(f'<p>{p} {p} {p}</p>' for p in LONG)}</div></article>"
    long = [" ".join([html.unescape(p)] * 3) for p in LONG]
    for page in (f"<main>{parts[0]}{big}{parts[2]}{teaser}</main>", f"<div><div>{parts[0]}</div><div>{big}</div><div>{parts[2]}</div></div>{said}"):
        assert main_text(f"<body>{page}</body>").split("\n\n") == [*text[:2], *long, *text[4:]], page


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<script>x") == main_text("<!-- a") == ""
    assert main_text("plain  text\nonly") == "plain text only" and main_text("<p>x") == "x"
    assert main_text("<div>" * 5000 + "deep text") == "deep text"
    assert main_text("<p>a < b & c &lt;p&gt; &#233;&nbsp;x") == "a < b & c <p> é x"


def test_given_pages(spark):
    rows = spark.read.parquet(SF + "/pages.parquet").collect()
    got = {r.page_id: r for r in Q.op6_html(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "old"), (2, "u", None, None)], "page_id long, url string, html string, text string")
    assert [r.text for r in extract_pages(df).orderBy("page_id").collect()] == ["x", ""]
    assert extract_pages(df.limit(0)).count() == 0
