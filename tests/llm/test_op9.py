import re
from html import unescape

import pytest

from cadence.llm import html as H
from cadence.llm.queries import QUERIES


def article(page):
    """The given pages' main text: what <article> holds, cut at its block tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in blocks if x)


def test_query_on_given_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op9_site_style_tree"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


@pytest.mark.parametrize("page, text", [
    ("", ""), ("just &lt;text&gt; &amp", "just <text> &"), ("<p>A<p>B<br>c &nbsp; d", "A\nB c d"),
    ("<body><nav>m</nav><main><h1>T</h1><p>x <b>y</b>z</main><footer>f</footer>", "T\nx yz"),
    ("<article><header><h1>T</h1></header><p>a</p><aside>s</aside><div class='share-bar ad'>b</div><form>q</form><p hidden>h</p><section id=comments>c</section></article><article class=comment>r</article>", "T\na"),
    ("<div>k<script>var a='</div><p>';</script><style>p{}</style><!-- <p>no --><ul><li>1<li>2</ul>t</div>", "k\n1\n2\nt"),
    ("<title>no</title><table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<div class='ad-free reading'>x</div>y", "y"),
    ("<p title='a>b' class=\"x\">q</p></p></div><p", "q"), ("<!-- unended <p>x", ""), ("<article></article>", ""), ("<p>&#233;&eacute;&#x1F600; &bogus; &copy 1", "éé😀 &bogus; © 1"),
])
def test_markup(page, text):
    if page.endswith("<p"):
        assert H.extract(page).startswith(text)
    else:
        assert H.extract(page) == text


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS removed", "2 AS n", "3 AS page_host")


def test_style_tree_removes_what_repeats(spark):
    page = "<body><div class=top>Welcome to <i>us</i></div><div class=text><p>{0}</p><p>more {0}</p></div><div class=bottom>Call now</div></body>"
    rows = [(i, "http://a.example/x", page.format(f"story {i}")) for i in range(20)] + [(99, "http://b.example/", page.format("single"))]
    got = {r.page_id: r.text for r in H.extract_pages(pages_of(spark, rows)).collect()}
    assert got[3] == "story 3\nmore story 3" and got[99] == "Welcome to us\nsingle\nmore single\nCall now"
    tree = H.style_tree(pages_of(spark, rows)).collect()
    low = {r.path for r in tree if r.importance < H.LOW and r.pages >= 5}
    assert H.path_id("html/body/div.top") in low and H.path_id("html/body/div.text") not in low


def test_joined_by_host_when_trees_are_many(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_PATHS", 0)
    rows = [(i, f"http://h{i % 2}.example/x", f"<div class=top>same words</div><p>own {i}</p>") for i in range(24)]
    assert sorted(r.text for r in H.extract_pages(pages_of(spark, rows)).collect()) == sorted(f"own {i}" for i in range(24))


def test_odd_and_no_rows(spark):
    rows = [(1, None, None), (None, "", ""), (2, "no url", "<p>x"), (2, "no url", "<p>x"), (3, "//h/", "<div>" * 3000 + "deep"), (4, "http://u:p@H.example:80/p", "a" * 200_000)]
    got = H.extract_pages(pages_of(spark, rows)).collect()
    assert sorted((r.n_chars for r in got)) == [0, 0, 1, 1, 4, 200_000] and all(len(r.text) == r.n_chars for r in got)
    assert H.extract_pages(pages_of(spark, rows).filter("false")).count() == 0
    assert [H.host_of(u) for u in ("http://u:p@H.example:80/p", "//x?y", "mailto:a", None)] == ["h.example", "x", "", ""]
