import re

import pytest

from launchlens.llm import queries
from launchlens.llm.htmltext import extract, to_text

CASES = [
    ("<p>One<p>Two <b>bold</b> x", "One\n\nTwo bold x"),
    ("a<div>b</div>c", "a\nb\nc"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>end", "- x\n- y\n  - z\n\nend"),
    ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>n<th>long head<tr><td>12345<td>v</table>", "n      long head\n12345  v"),
    ("<table><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("x<script>var t='</p>'; if (a<b) {}</script>y<style>p{}</style><!-- c --><title>t</title>z", "xyz"),
    ("<div hidden>no</div><p style='color:red; display : none'>no</p><span style=visibility:hidden>no</span>yes", "yes"),
    ("a &lt; b &amp;&eacute;&#233; 1 < 2", "a < b &éé 1 < 2"),
    ("<p>a<br>b<br><br>c</p>", "a\nb\n\nc"),
    ("<a href=\"x>y\" title='<'>link</a></p></div>tail", "link\n\ntail"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<td>stray</td> cell", "stray cell"),
    ("<head><title>t</title></head><body>b</body>", "b"),
    ("", ""), ("<", "<"), ("<p", "<p"), ("<!-- open", ""), ("<script>open", ""), ("  \n ", ""),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table>b<td>c</table>", "a in ner b  c"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_layout(page, text):
    assert to_text(page) == text


def test_deep_and_long_pages():
    assert to_text("<div>" * 50_000 + "x") == "x"
    assert to_text("<ul><li>" * 300 + "x").strip().endswith("x")
    assert to_text("<b>" * 30_000 + "y" + "</b>" * 30_000) == "y"
    assert to_text("word " * 200_000).count("word") == 200_000


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x", 1), (2, "<p>a", "x", 1), (2, "<p>a", "x", 1), (None, "b", "x", 1)], "page_id long, html string, text string, doc_id int")
    assert sorted((str(r.page_id), r.text) for r in extract(df).collect()) == [("1", ""), ("2", "a"), ("2", "a"), ("None", "b")]
    assert extract(df.limit(0)).count() == 0


def test_query_keeps_all_visible_words(spark):
    import html as h

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op2_html_text(spark, sf).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        shown = re.sub(r"(?is)<!--.*?-->|<(script|style|title|noscript|svg|select|template)\b.*?</\1\s*>", "", page)
        words = h.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", " ", shown)).split()
        assert sorted("".join(words)) == sorted("".join(got[i].split())) or "hidden" in page or "display" in page or "<li" in page, i
