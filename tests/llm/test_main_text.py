"""Main text of pages: given articles, boilerplate of all kinds, broken markup."""

import html as entities
import os
import re

import pytest
from pyspark.sql import functions as F

from roundsman.llm.main_text import Tree, _left_out, densities, extract, main_text
from roundsman.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
P1, P2, P3 = (f"<p>{w} paragraph with a good many words of plain running text in it.</p>" for w in ("First", "Second", "Third"))
TEXT = "\n".join(f"{w} paragraph with a good many words of plain running text in it." for w in ("First", "Second", "Third"))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_query_gives_the_articles(spark):
    """The given pages mark their article, which the operator does not rely on."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["op12_html_extraction"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for row in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[row.page_id], re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert row.text == "\n".join(b for b in blocks if b) and row.n_chars == len(row.text)
        unmarked = pages[row.page_id].replace("<article>", "<div>").replace("</article>", "</div>")
        assert main_text(unmarked) == row.text


MENU = "<ul>" + "".join(f"<li><a href=/{i}>Entry {i}</a>" for i in range(8)) + "</ul>"
AROUND = [
    f"<nav>{MENU}</nav>", f"<header><a href=/>Site</a>{MENU}</header>", "<footer><p>&copy; all rights reserved by us</p></footer>",
    "<aside><p>Read this as well, it is quite a long teaser text about it.</p></aside>", "<div class='ad banner'><p>Buy now, cheap and good!</p></div>",
    "<div id=cookie-notice><p>We use cookies to give you the best experience.</p></div>", "<form><label>Name</label><input><textarea>t</textarea></form>",
    "<script>var t='<p>x</p>';</script><style>p{margin:0}</style><noscript><p>Turn scripts on</p></noscript>",
    "<section id=comments><h2>Comments</h2><article class=comment><p>I like this, and I have a lot to say on it, too much.</p></article></section>",
    "<div role=navigation><a href=/1>Back</a> <a href=/2>Next</a></div>", "<!-- <p>hidden</p> -->", f"<div class=sidebar>{MENU}</div>",
    "<div role=alert><p>This shop closes early today, be quick.</p></div>",
]


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='post with-sidebar'><h1></h1>%s</div>", "<div><div>%s</div></div>"])
def test_boilerplate_goes(wrap):
    body = P1 + AROUND[4] + P2 + P3
    for before in AROUND:
        for after in AROUND:
            page = f"<!doctype html><html><head><title>T</title></head><body>{before}{wrap % body}{after}</body></html>"
            assert main_text(page) == TEXT, page


def test_blocks_and_white_space():
    page = f"""<body><div><h1>A&nbsp; title &amp; more&#33;</h1>{P1}<p>one<br>two   <b>th</b>ree
      <i>four</i><p>unclosed<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>1<td>2<tr><th>3</table><pre> x\n  y </pre>tail</div>"""
    assert main_text(page).split("\n") == [
        "A title & more!", "First paragraph with a good many words of plain running text in it.", "one two three four", "unclosed",
        "a", "b", "c", "d", "1", "2", "3", "x y", "tail",
    ]
    assert main_text("&lt;p&gt; stays text &eacute; &#x1F600; &unknown; ") == "<p> stays text é 😀 &unknown;"


def test_sections_of_one_article():
    page = f"<body><nav>{MENU}</nav><div id=page><div class=wrap><h1>Title</h1><div>{P1}</div><div>{P2}{P3}</div></div></div></body>"
    assert main_text(page) == "Title\n" + TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("<p>one", "one"), ("<", "<"), ("</p></div>x", "x"), ("<div", ""),
    ("<b><p>x</b> y</p>", "x y"), ("<body><body><p>x", "x"), ("<p>a</p>b<p>c</p>", "a\nb\nc"), ("<nav>only</nav>", ""), ("<![CDATA[x]]>y", "y"),
])
def test_small_and_broken(page, text):
    assert main_text(page) == text


def test_deep_and_long():
    assert main_text("<div>" * 100_000 + "deep" + "</div>" * 50_000) == "deep"
    assert main_text("<p>x y</p>" * 100_000).count("\n") == 99_999
    assert main_text("<b>" * 50_000 + "</i>" * 50_000 + "x") == "x"


def test_densities():
    tree = Tree("<body><div><p>twelve chars</p></div><div><a href=/>twelve chars</a></div></body>")
    density, sums = densities(tree, _left_out(tree))
    div_text, div_link = [n for n, t in enumerate(tree.tag) if t == "div"]
    assert density[div_text] > density[div_link] > 0
    assert sums[tree.tag.index("body")] == density[div_text] + density[div_link]


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    pages = spark.createDataFrame([(1, "u", P1, "mine", "own"), (1, "u", P1, "mine", "own"), (None, None, None, None, None)], schema)
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    line = TEXT.split("\n")[0]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", line, len(line))] * 2 + [(None, None, "", 0)], key=str)
    assert extract(pages.limit(0)).count() == 0
    assert extract(pages.withColumn("url", F.lit(1.5))).schema["url"].dataType.simpleString() == "double"
    with pytest.raises(ValueError, match="rename"):
        extract(pages, keep=("page_id", "text"))
