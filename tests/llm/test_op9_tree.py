"""The style tree inside declared content and on hot hosts, and names that name no role."""

import pytest

from cadence.llm import html as H


def texts(spark, rows):
    pages = spark.createDataFrame([(i, f"http://{host}.example/{i}", page) for i, (host, page) in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in H.extract_pages(pages).orderBy("page_id").collect()]


def test_repeated_block_inside_article(spark):
    own = "<div><p>own story {0} tells of {0} and of more, at such length as stories have</p></div>"
    note = "<div><p>Sign up to hear from us each week</p></div>"
    rows = [("a", f"<article><h1>Daily</h1>{own.format(i)}{note}<section><p>By the desk</p></section></article>") for i in range(8)]
    copies = [("b", f"<article><h1>Daily</h1>{own.format('one')}{note}</article>")] * 8
    near = [("c", f"<article><div><p>the same long tale of many words told again and again</p></div><p>v{i}</p></article>") for i in range(8)]
    got = texts(spark, rows + copies + near)
    assert got[:8] == [f"Daily\nown story {i} tells of {i} and of more, at such length as stories have" for i in range(8)]
    assert got[8:16] == ["Daily\nown story one tells of one and of more, at such length as stories have\nSign up to hear from us each week"] * 8
    assert got[16:] == [f"the same long tale of many words told again and again\nv{i}" for i in range(8)]


@pytest.mark.parametrize("most", [0, 50_000])
def test_branch_of_a_small_section_of_a_hot_host(spark, monkeypatch, most):
    monkeypatch.setattr(H, "BROADCAST_PATHS", most)
    rows = [("hot", f"<p>own {i}</p>" + ("<div class=desk>The same words</div>" if i % 12 == 0 else "")) for i in range(96)]
    assert texts(spark, rows) == [f"own {i}" for i in range(96)]


@pytest.mark.parametrize("page, text", [
    ("<article><h2 id='related-work'>Related work</h2><section id='search-algorithms'>Trees</section><p class='reply'>Yes</p></article>", "Related work\nTrees\nYes"),
    ("<div class='layout has-sidebar'><article>a</article><div class='sidebar'>s</div></div>", "a"),
    ("<div class='sidebar widget'><article>a</article></div>", "a"), ("<div class='has-sidebar'><p>x</p><div class='related-posts'>r</div></div>", "x"),
    ("<aside><article>no</article></aside><div class=widget><article>teaser</article></div><main>x</main>", "x"),
])
def test_names(page, text):
    assert H.extract(page) == text


def test_bare_paragraphs_of_an_article_stay(spark):
    rows = [("a", f"<article><h1>T {i}</h1><p>own words {i} of this one story here</p><p>The same closing sentence in many articles of this host</p></article>") for i in range(20)]
    assert texts(spark, rows) == [f"T {i}\nown words {i} of this one story here\nThe same closing sentence in many articles of this host" for i in range(20)]


def test_larger_table_is_what_its_markup_says(spark, sf):
    from tests.llm.test_op9 import article

    pages = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet")
    html = {r.page_id: r.html for r in pages.select("page_id", "html").collect()}
    got = {r.page_id: r.text for r in H.extract_pages(pages.repartition(8)).collect()}
    assert len(got) > 2000 and [i for i, t in got.items() if t != article(html[i])] == []


def test_the_tree_alone_where_markup_says_nothing(spark, sf):
    """Without article tags, classes, ids and roles, and with div and p for all that names a role by its tag."""
    import re
    from collections import Counter

    from tests.llm.test_op9 import article

    rows = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet").select("page_id", "url", "html").collect()
    bare = lambda h: re.sub(r"<(/?)(?:article|main|nav|aside|footer|header|section)\b[^>]*>", r"<\1div>", re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", h))
    pages = spark.createDataFrame([(r.page_id, r.url, bare(r.html)) for r in rows], "page_id long, url string, html string").repartition(8)
    got, same, own, full = {r.page_id: r.text for r in H.extract_pages(pages).collect()}, 0, 0, 0
    for r in rows:
        want, found = Counter(article(r.html).split()), Counter(got[r.page_id].split())
        same, own, full = same + (want & found).total(), own + found.total(), full + want.total()
    assert 2 * same / (own + full) >= 0.95
