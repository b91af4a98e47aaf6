"""Main text of pages: pages written for it, hosts that agree, odd rows, and the given pages."""

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from logweir.llm import htmltext
from logweir.llm.queries import op11_html_text
from tests.llm.test_operators import SF

SCHEMA = "page_id long, url string, html string, host string, winners int"
LONG = "The river rose in the night and by morning the lower fields were under water."

#: A page, and its main text.
PAGES = [
    ("<p>One<p>Two &amp; three", "One\nTwo & three"),
    ("<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><main><h1>Head</h1><p>Body&nbsp;text,\n  twice</p></main><footer>&copy; Me</footer></body></html>", "Head\nBody text, twice"),
    (f"<body><div id=top-menu>Menu</div><div class='col main-col'><h2>Head</h2><p>{LONG}<p>{LONG}</div><div class=sidebar>{LONG}{LONG}{LONG}</div></body>", f"Head\n{LONG}\n{LONG}"),
    (f"<article><header><span>By me</span><h1>Head</h1></header><p>{LONG}</p><aside>See also</aside><form><input><p>Search</p></form><footer>tags</footer></article>", f"Head\n{LONG}"),
    (f"<article>{LONG}<script>var x = '<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --></article><section id='comments'><article class=comment>{LONG}</article></section>", LONG),
    (f"<article><p>{LONG}</p><div class='ad-box'>Buy</div><div class=adage>An old saying.</div></article>", f"{LONG}\nAn old saying."),
    ("<article><ul><li>one<li>two <b>bold</b>er<li>three</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "one\ntwo bolder\nthree\na\nb\nc"),
    ("<article><p>a<br>b<br/>c</p><pre>x\n  y</pre>tail</article>", "a b c\nx y\ntail"),
    ('<article title="a > b" data-x=\'<p>\'><p>kept</p></article>', "kept"),
    ("<article><p>1 < 2 &lt; 3 &#233;&#x41; &am &amp&lt;</p></article>", "1 < 2 < 3 éA &am &<"),
    (f"<form id=all><main><p>{LONG}</p><select><option>a</select></main></form>", LONG),
    ("<article><p>cut off he", "cut off he"),
    ("<article><p>cut off</p><a href='", "cut off"),
    ("<article><p hidden>no</p><p>yes</p><div role='dialog'>no</div></article>", "yes"),
    (f"<div class=cookie-notice>We use cookies</div><div><p>{LONG}</p></div>", LONG),
    ("<article><p><b>Bold.<br><p>After.</p></article>", "Bold.\nAfter."),
    ("<nav>only a menu</nav>", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_pages(html, text):
    assert htmltext.main_text(html, None)[0] == text


def page(kind, i):
    noise = LONG * 12
    body = {
        "post": f"<div class='post-{i} wide'><div class=entry><h1>Post {i}</h1><p>{LONG} {i}</p></div><div class=x1><p>{noise if i % 7 == 0 else 'Short.'}</p></div></div>",
        "wiki": f"<div id=w><div class=article-text><p>Wiki {i}. {LONG}</p></div></div>",
    }[kind]
    return f"<html><body><div class=header>Site</div>{body}</body></html>"


def expected(kind, i):
    return f"Post {i}\n{LONG} {i}" if kind == "post" else f"Wiki {i}. {LONG}"


@pytest.mark.parametrize("broadcast", [htmltext.MAX_BROADCAST, -1])
def test_hosts_agree(spark, monkeypatch, broadcast):
    """Pages on which something else is longer follow the host's other pages; other layouts keep their own."""
    monkeypatch.setattr(htmltext, "MAX_BROADCAST", broadcast)
    kinds = [("post" if i % 3 else "wiki", i) for i in range(80)]
    rows = [(i, f"https://www.Site.example/p/{i}", page(k, i), "h", 1) for k, i in kinds]
    rows += [(1000, "https://other.example/", page("post", 7), None, None), (1001, None, page("post", 7), None, None), (1001, None, page("post", 7), None, None), (None, "nonsense", None, None, None)]
    found = htmltext.extract_text(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found.columns == ["page_id", "url", "text", "n_chars", "container"]
    got = found.collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for kind, i in kinds:
        assert by[i].text == expected(kind, i) and by[i].n_chars == len(by[i].text), i
    assert by[2].container == "html>body>div.post-#.wide>div.entry"
    assert by[1000].text == by[1001].text == LONG * 12 and by[None].text == ""
    assert htmltext.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + LONG + "</div>" * 20_000
    assert htmltext.main_text(deep, None)[0] == LONG
    long = "<article>" + "<p>word <b>x</b> &amp;" * 50_000
    assert htmltext.main_text(long, None)[0].count("\n") == 49_999
    assert htmltext.main_text("<a b='" * 20_000, None)[0] == ""
    assert htmltext.main_text("<" * 50_000 + "form>" * 10_000, None)[0]
    assert htmltext.main_text("<form>" * 20_000 + "x", None)[0] == ""


def test_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op11_html_text(spark, SF).collect():
        body = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id])[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)
    assert op11_html_text(spark, SF).filter(F.col("text") == "").count() == 0
