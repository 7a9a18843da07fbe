"""Main text of pages, against a plain reading of the given pages and hand-written ones."""

import html
import re

import pytest

from logweave.llm.pages import extract_text, main_text, op11_html_text

SF = "/root/testdata/sf0.01"
PAGE = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1><p>tag line</p></header>
<div id="cookie-notice"><p>We use cookies, yes we do, on all of our pages.</p></div><div class="wrap"><h1>Head &lt;line&gt;</h1>
<div class="content"><p>First para, with <a href="x>y">a link</a>, and more.<p>Second &amp; para<br>goes&nbsp;on.<ul><li>one<li>two</ul><blockquote>Quote.</blockquote>
<table><tr><td>a<td>b<tr><td>c</table><div class="share"><a>Tweet</a></div></div><div><h3>Comments (2)</h3><div><p>I like this, it is very good; really, really.</p></div></div></div>
<aside>side</aside><form><p>Your name, please.</p></form><footer>foot</footer><script>if (a<b) "</p>"</script></body>"""


def plain(text):
    """The article of the given pages, whose blocks are headings and paragraphs."""
    article = re.search("<article>(.*)</article>", text, re.DOTALL)[1]
    blocks = [html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))) for x in re.split("</?(?:p|h1)>", article)]
    return "\n\n".join(" ".join(b.split()) for b in blocks if b.strip())


def test_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op11_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.text, r.n_chars) == (plain(pages[r.page_id]), len(r.text))


def test_written_page():
    assert main_text(PAGE).split("\n\n") == ["Head <line>", "First para, with a link, and more.", "Second & para goes on.", "one", "two", "Quote.", "a", "b", "c"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""), ("<", "<"), ("<a", ""), ("x", "x"), ("<!-- x", ""), ("<script>x", ""), ("a<b c", "a"), ("1 < 2, so.", "1 < 2, so."), ("<p>\n one,\t two \n</p>", "one, two"),
        ("<P CLASS=x>One.</P><NAV>menu</NAV>", "One."), ("<p>A&#x41;&amp;amp; &bogus; &#xD800;.", "AA&amp; &bogus; �."), ('<p title="a>b" x=\'">\'>One.</p>', "One."), ('<p title=">One.', "One."), ("<p title='>One.</p>", "One."),
        ("<style>p{}</style><p>One.</p><textarea>no</textarea>", "One."), ("<div hidden>no, no.</div><div style='display: none'>no.</div><p>One, two.</p>", "One, two."),
        ("<nav><a>only, a menu.</a></nav>", ""), ("<ul><li><a>x</a><li><a>y</a></ul><article><h2>T</h2><p>One.</p><ul><li>i</ul></article>", "T\n\nOne.\n\ni"),
        ("<div>" * 30_000 + "deep, one." + "</div>" * 30_000, "deep, one."), ("</p>" * 50_000 + "<p>late, one.", "late, one."), ("<p>" + "long, word. " * 50_000, " ".join(["long, word."] * 50_000)),
    ],
)
def test_markup(text, want):
    assert main_text(text) == want


def test_rows(spark):
    """Null pages and ids, repeated rows, clashing names, other columns and empty tables."""
    rows = [(1, PAGE, "old", 3), (1, PAGE, "old", 3), (None, None, None, None), (2, "", "t", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars long")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()), key=str)
    one = main_text(PAGE)
    assert got == sorted([(1, one, len(one)), (1, one, len(one)), (None, "", 0), (2, "", 0)], key=str)
    assert extract_text(df.limit(0)).collect() == []
    assert extract_text(df.select("page_id", "html")).columns == ["page_id", "html", "text", "n_chars"]
