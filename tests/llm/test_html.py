import re

import duckdb
import pytest

from vellumist.llm import html_text

ARTICLE = "<article><h1>Title</h1><p>One &amp; two.<p><b>Un.<br>closed</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></ul></nav><div class='ad'>Buy the best of all things now</div>{ARTICLE}<footer>&copy; x</footer></body></html>",
        f"<header><h1>Site</h1></header><div id='cookie-notice'><p>We use cookies.</p></div>{ARTICLE}<aside><p>More</p></aside><section class='comments'><h2>Comments</h2><div class='comment'>I like it</div></section>",
        f"<div class=ad>never closed<p>x {ARTICLE} <form><label>Mail</label><input></form><!-- a > b -->",
        f"<body><div role='navigation'><a href=x>y</a></div><main>{ARTICLE}</main><div style='display: none'>hidden</div>",
        "<article><header><h1>Title</h1></header><p>One\n\n &#38;\ttwo.</p><div class='share'>Share</div><p>Un. closed</p><div class='comments'><p>first!</p></div></article>",
        "<ARTICLE><H1>Title</H1><P data-x=\"a>b\">One &amp; two.</P><SCRIPT>x</SCRIPT><P>Un.<BR>closed</ARTICLE>",
    ],
)
def test_article_only(page):
    assert html_text.main_text(page) == "Title\n\nOne & two.\n\nUn. closed"


def test_without_article_the_second_pass_decides():
    long = "The house is on the hill and it was built for the people of the town, who had come from all over to see it. " * 3
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><div><h1>A hill</h1><p>{long}</p><p>Short one.</p><p>{long}</p></div><div><a href=3>About</a> <a href=4>Imprint</a></div>"
    assert html_text.main_text(page).split("\n\n") == ["A hill", long.strip(), "Short one.", long.strip()]
    assert html_text.main_text("just text") == "just text"


def test_tables_agree_with_a_plain_cut(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    got = {r.page_id: r for r in html_text.extract(spark.read.parquet(path)).collect()}
    rows = duckdb.sql(f"select page_id, html from '{path}'").fetchall()
    assert len(got) == len(rows)
    for i, page in rows:
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        import html

        want = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inner))]
        assert got[i].text == "\n\n".join(filter(None, want)) and got[i].n_chars == len(got[i].text)


def test_nulls_empty_and_odd_markup(spark):
    pages = [(1, None), (2, ""), (2, ""), (3, "<"), (4, "<p"), (5, "<script>never closed <p>x"), (None, "<p>a<br><br>b<td>c"), (6, "<p>" * 20_000 + "x"), (7, "<!-- open"), (8, "<a '>" * 500)]
    df = spark.createDataFrame([(i, "u", h, "t", 1) for i, h in pages], "page_id long, url string, html string, text string, n_chars long")
    rows = html_text.extract(df).collect()
    assert len(rows) == len(pages)
    text = {r.page_id: r.text for r in rows}
    assert text[1] == text[2] == text[5] == text[7] == "" and text[6] == "x" and text[None] == "a\n\nb\n\nc"
    assert html_text.extract(df.limit(0)).count() == 0


def test_wrappers_that_only_a_class_condemns():
    long = "The house is on the hill and it was built for the people of the town, who had come from all over to see it. " * 3
    side = "<div class='sidebar'><p>Most read in the town</p><ul><li><a href=1>One</a></ul></div>"
    for wrapper in ("<div id='wrapper' class='has-sidebar'>", "<div class='content-sidebar-wrap'>", "<form action='/'>"):
        page = f"<body><nav><a href=1>Home</a></nav>{wrapper}<div><p>{long}</p><p>Short.</p><p>{long}</p></div>{side}</div></form><footer>Imprint</footer></body>"
        assert html_text.main_text(page).split("\n\n") == [long.strip(), "Short.", long.strip()]
    comments = f"<div><p>It is the day of the week that we are in.</p></div><div class='comments'><p>{long}</p><p>{long}</p></div>"
    assert long.strip() not in html_text.main_text(comments)
    middling = "<nav><a href=1>Home</a></nav><p>It was the first day of the week and all of them were in the house on the hill.</p><footer>Imprint</footer>"
    assert html_text.main_text(middling) == "It was the first day of the week and all of them were in the house on the hill."


def test_broken_markup_takes_linear_time():
    import time

    began = time.perf_counter()
    for piece in ("<a ", "<a x='", "<a '>'", "<head>", "<!-", "<div class=ad>", "<", "</script ", '<p class="a" ', "&#"):
        html_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 50
    assert html_text.main_text("<p title='a>b'>one</p><p title='x>two</p><p>three</p>") == "one\n\ntwo\n\nthree"
