import html
import re

import pytest
from pyspark.sql import functions as F

from graphlens.llm import html_text, queries
from graphlens.llm.html_text import Page

PAGES = "page_id long, url string, html string, text string, host string, paths int"


def text(source):
    return Page(source).extract([])


STORY = "<p>It rained all day, and the river rose over the old stones.</p><p>By night the bridge was gone; nobody had seen it fall.</p>"
READ = "It rained all day, and the river rose over the old stones.\nBy night the bridge was gone; nobody had seen it fall."


@pytest.mark.parametrize(
    "source",
    [
        f"<html><body><nav>Home About</nav><article>{STORY}</article><footer>Ours</footer></body></html>",
        f"<body><div id=main-content>{STORY}</div><div class='sidebar left'><p>{'Many other things to read here. ' * 20}</p></div></body>",
        f"<div class=wrap><div class='post-123 entry'>{STORY}<div class=share>Share this</div><form><label>Mail</label><input value=x></form></div><section id=comments><p>{'I liked it very much indeed, thanks. ' * 20}</p></section></div>",
        f"<main><header><p>Site notice</p></header>{STORY}<aside>More</aside><script>var p = '<p>no</p>';</script><style>p {{}}</style></main>",
        f"<body class=has-sidebar><form action=/><div class=content>{STORY}</div></form>".replace("<form action=/>", "<form action=/><h1 hidden>x</h1>"),
        f"<article><div class='cookie-notice' role=alert>We use cookies</div><!-- <p>no</p> -->{STORY}<ol class=commentlist><li>First!</ol></article>",
        f"<table><tr><td class=menu><a href=1>One</a> <a href=2>Two</a></td><td>{STORY}</td></tr></table>",
        f"<article>{STORY.replace('</p>', '')}</article>",
        f"<body><div class=ad>Buy<article>{STORY}</article></div>".replace("<div class=ad>Buy", "<div class=notice>"),
        f"<div class=page><div class=header><h1>Our site</h1></div><div class=story id=s>{STORY}<ins class=adsbygoogle>Buy</ins></div><div class=footer>x</div></div>",
        f"<article id=share-of-the-menu class=no-sidebar>{STORY}<ul class='toc'><li>One</ul></article>",
        f"<ARTICLE><P STYLE='display: none'>hidden</P>{STORY}<svg><text>no</text></svg><noscript>no</noscript></ARTICLE>",
    ],
)
def test_layouts(source):
    assert text(source) == READ


def test_blocks_and_references():
    assert text("<article><h1> A &amp;\n\t B </h1>one<br>two&nbsp;&#8364;<p>x<b>y</b> z<ul><li>i<li>j</ul><pre>a\n  b</pre>c</article>") == "A & B\none two €\nxy z\ni\nj\na b\nc"
    assert text("<article><header><p>By N.</p><h2>Title</h2></header><p>Text</p></article>") == "Title\nText"
    assert text("<div class=post-7><div class=entry-header><h1 id=related-comments>Title</h1><p>By N.</div><p>Text</p></div>") == "Title\nText"
    assert text("<p>a < b and c > d, 1<2 &lt;b&gt; &bogus; &#0; &#xD800;") == "a < b and c > d, 1<2 <b> &bogus; � �"
    assert text("<article><p>a<p>b</article") == "a\nb</article"
    assert text("<article><p title='x>y</p><p>z") == "y\nz"
    assert text("<article><table><tr><td>1<td>2<tr><td>3</table><dl><dt>k<dd>v</dl><![CDATA[<&>]]></article>") == "1 2\n3\nk\nv\n<&>"
    assert text("") == text("<nav>a</nav>") == text("<!-- x") == text("<script>x") == text(" \n ") == ""
    assert text("plain") == "plain"


def test_long_and_deep_pages():
    words = "word " * 400_000
    assert text(f"<article><p>{words}</article>") == words.strip()
    assert text("<div>" * 20_000 + STORY) == READ
    assert text("<p>" + "<b>" * 20_000 + "x" + "</i>" * 20_000) == "x"
    assert text("<p>y</p>" + "<a '" * 50_000 + "> x") == "y\nx"
    assert text("<a name=top>" + STORY) == READ
    assert text("<p>" + "a<" * 100_000) == "a<" * 100_000


def test_general_paths():
    page = Page("<body><div class='b item-17 a'><div class='css-1x9 Big'><p>x")
    assert page.paths[page.best()] == "html>body>div.a.b.item>div.big.css"


def short(k):
    return f"<body><div class=lead>{'Long words about nothing, always the same. ' * 9}</div><article><p>Short {k}.</article>"


def rows():
    known = [(k, "https://A.example.org:80/x", f"<body><div class=lead>Hm</div><article><p>{'Real text. ' * 30}{k}</article>", "t", "h", 1) for k in range(6)]
    odd = [(10, "http://a.example.org/y", short(1)), (11, None, short(2)), (12, "nothing", short(3)), (13, "http://b.example.org", short(4)), (None, "http://a.example.org", None), (15, "http://a.example.org", "")]
    return known + [(*r, "t", "h", 1) for r in [*odd, odd[0], odd[0]]]


@pytest.mark.parametrize("most_hosts", [10_000, 0])
def test_hosts_agree(spark, most_hosts):
    """A page with a long lead is read by its host's path; pages without a host, or alone on it, by their own."""
    pages = spark.createDataFrame(rows(), PAGES)
    got = html_text.main_text(pages, most_hosts)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    lead = ("Long words about nothing, always the same. " * 9).strip()
    want = [(k, r[1], "Short 1." if k == 10 else lead if k in (11, 12, 13) else "" if not r[2] else ("Real text. " * 30) + str(k)) for k, r in ((r[0], r) for r in rows())]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*w, len(w[2])) for w in want), key=repr)
    assert html_text.main_text(pages.limit(0), most_hosts).count() == 0


def test_winners(spark):
    pages = spark.createDataFrame(rows(), PAGES)
    got = {r.host: r.paths for r in html_text.winning_paths(pages).collect()}
    assert got == {"a.example.org": ["html>body>article", "html>body>div.lead"], "b.example.org": ["html>body>div.lead"]}


def test_whole_table_against_a_plain_reading(spark):
    """The tables' pages have one article each: what stands between its tags, cut at its blocks' tags."""
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article\b[^>]*>(.*?)</article>", r.html or "", re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        own = "\n".join(x for x in parts if x)
        want[r.page_id] = (r.url, own, len(own))
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op12_html_text(spark, sf).collect()}
    assert got == want and spark.read.parquet(f"{sf}/pages.parquet").filter(F.col("page_id").isNull()).count() == 0
