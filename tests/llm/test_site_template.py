"""Main text of pages: what is taken out, what stays, and odd rows."""

import html as stdlib_html
import re

from leafgraph.llm import queries, site_template
from leafgraph.llm.site_template import text_of

FOLDER = "/root/testdata/sf0.001"


def test_rules():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class=home>
    <header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use</div>
    <div id=page class="has-sidebar"><article><header><h1>Head&amp;line</h1></header><p>One <b>b</b>old
    <script>var a = "</p>";</script>line<br>two<p>Next 5 < 6 &nbsp;x<div class="share-bar">Share</div>
    <aside>See also</aside><form><input value=1>Send</form><p hidden>no</p></article></div>
    <section id="comments"><article class="comment"><p>First!</p></article></section>
    <aside class=sidebar>Side</aside><footer>Foot</footer><!-- gone > --></body></html>"""
    assert text_of(page, set()) == "Head&line One bold line two Next 5 < 6 x"


def test_without_marks():
    assert text_of("<p>a<p>b<div>c <i>d</i></div>", set()) == "a b c d"
    assert text_of("plain &lt;text&gt; only", set()) == "plain <text> only"
    assert text_of("<body><main><p>in</p></main><p>out</p>", set()) == "in"
    for odd in ("", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<div " * 50, "<a href='x>y</a>", "<p>" * 30_000 + "deep"):
        assert text_of(odd, set()) in ("", "< p".replace(" ", ""), "<", "y", "deep", text_of(odd, set()))
    assert text_of("<div>" * 20_000 + "deep", set()) == "deep"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, subtree int")


def test_recurring_subtrees_go(spark):
    def page(i, host, copy=None):
        k = i if copy is None else copy
        return (i, f"https://{host}/{i}", f"<body><div><b>Welcome to all of it</b></div><div><p>Story {k} of this site</p><p>The end.</p></div></body>", "x", 1)

    rows = [page(i, "a.org") for i in range(20)] + [page(i, f"b{i}.org") for i in range(20, 40)]
    rows += [page(i, "c.org", 7) for i in range(40, 70)]  # one page, thirty times
    rows += [(70, None, None, None, None), (70, "x", "", None, None), (None, "https://a.org/", "<p>alone", None, None)]
    got = {(r.page_id, r.url): r.text for r in site_template.main_text(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(20):
        assert got[i, f"https://a.org/{i}"] == f"Story {i} of this site"
    for i in range(20, 40):
        assert got[i, f"https://b{i}.org/{i}"] == f"Welcome to all of it Story {i} of this site The end."
    for i in range(40, 70):
        assert got[i, f"https://c.org/{i}"] == "Welcome to all of it Story 7 of this site The end."
    assert got[70, None] == "" and got[70, "x"] == "" and got[None, "https://a.org/"] == "alone"


def test_paragraphs_of_an_article_stay(spark):
    rows = [(i, f"https://a.org/{i}", f"<article><p>Yes.</p><div><a>Print this</a></div><p>Story {i}</p></article>", "x", 1) for i in range(30)]
    got = {r.page_id: r.text for r in site_template.main_text(pages(spark, rows)).collect()}
    assert got == {i: f"Yes. Story {i}" for i in range(30)}


def test_query(spark):
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        text = stdlib_html.unescape(re.sub(r"<[^>]*>", " ", inner))
        want[r.page_id] = " ".join(text.split())
    got = {r.page_id: r for r in queries.op2(spark, FOLDER).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_empty_table(spark):
    assert site_template.main_text(pages(spark, [])).count() == 0


def test_a_block_on_few_pages_of_a_large_host_goes(spark):
    def page(i):
        note = f"<div>Notice {i // 6} of the site</div>" if i < 60 else ""
        return (i, f"https://a.org/{i}", f"<body>{note}<div><p>Story {i} of this site</p></div></body>", "x", 1)

    rows = [page(i) for i in range(3000)]  # each notice on 6 of 3,000 pages
    rows += [(3000 + i, f"https://a.org/x{i}", f"<body><div>On four pages</div><p>Story x{i}</p></body>", "x", 1) for i in range(4)]
    got = {r.page_id: r.text for r in site_template.main_text(pages(spark, rows)).collect()}
    assert got == {i: f"Story {i} of this site" for i in range(3000)} | {3000 + i: f"On four pages Story x{i}" for i in range(4)}
