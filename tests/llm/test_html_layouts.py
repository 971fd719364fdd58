"""Template text, layouts, and what class words may not do; and the query against the markup of the test tables."""

import html
import os
import random
import re

import pytest

from factledger.llm import html_extract

SF = "/root/testdata/sf0.01"


def test_constant_block_that_other_layouts_lack(spark):
    full = "<article><h1>Head {0}</h1><p>Words of {0}</p><div><p>Terms apply to all readers</p></div></article>"
    stub = "<ul><li>Entry {0}</li></ul>"
    hosts = range(8)
    pages = [(1000 * h + i, f"http://h{h}.org/{i}", (full if i < 12 else stub).format(f"{h}-{i}")) for h in hosts for i in range(20)]
    pages += [(9000 + i, f"http://few.org/{i}", full.format(i)) for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    for h in hosts:
        assert [got[1000 * h + i] for i in range(20)] == [f"Head {h}-{i}\nWords of {h}-{i}" if i < 12 else f"Entry {h}-{i}" for i in range(20)]
    assert got[9000].endswith("Terms apply to all readers")  # three pages are too few to tell


def test_ids_inside_an_article_name_its_parts(spark):
    kept = [f'<h2 id="{x}">Part {x}</h2><p>Words</p>' for x in ("comments", "navigation", "share")] + [f'<section id="{x}"><p>Part {x}</p></section>' for x in ("search", "social", "discussion")]
    gone = [f'<{tag} {how}="{x}"><p>Not this</p></{tag}>' for tag, how, x in (("section", "class", "reader-comments"), ("div", "id", "discussion"), ("div", "class", "user-responses"), ("section", "id", "comments"), ("div", "class", "gdpr-banner"), ("div", "class", "cookie-wall"), ("div", "class", "comment-list"))]
    pages = [(i, f"http://a{i}.org/x", f"<article><p>First</p>{x}<p>Last</p></article>") for i, x in enumerate([*kept, *gone])] + [(99, "http://a.org/x", "<div id='navigation'>Menu</div><article><p>First</p></article>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all("Part " in got[i] for i in range(len(kept)))
    assert [got[i] for i in range(len(kept), len(kept) + len(gone))] == ["First\nLast"] * len(gone) and got[99] == "First"


def test_induction_decides_by_slot(spark):
    """Constant nodes without any telling tag or class go, the same words in another slot stay, and without induction all of it stays."""
    page = "<div class='a{0}'><ul><li>Latest news</li><li>All rights</li></ul></div><div class='b'><p>Text of page {0} that varies</p><p>{1}</p></div><div class='c'><p>Read more here</p></div>"
    pages = [(i, f"http://s.net/{i}", page.format(i, "Latest news" if i == 7 else f"end {i}")) for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {i: f"Text of page {i} that varies\n{'Latest news' if i == 7 else f'end {i}'}" for i in range(20)}
    off = {r.page_id: r.text for r in html_extract.extract(df, share=2.0).collect()}
    assert all(off[i].startswith("Latest news\nAll rights\n") and off[i].endswith("\nRead more here") for i in range(20))


def test_class_words_do_not_take_the_article(spark):
    cases = [
        ('<div class="main no-sidebar"><article><p>one</p></article></div>', "one"),
        ('<article class="article-with-comments"><p>two</p></article>', "two"),
        ('<article><p class="share-price">three</p><p id="search-engines">four</p></article>', "three\nfour"),
        ('<form><div class="sidebar"><main><p>five</p></main></div></form>', "five"),
        ('<article><p>six</p><div class="share-buttons">x</div></article><aside><article>teaser</article></aside><section class="comments"><article class="comment">hm</article></section>', "six"),
        ('<div class="site-header">x</div><div class="ad-slot">y</div><div id="cookie-consent">z</div><p>seven</p>', "seven"),
    ]
    df = spark.createDataFrame([(i, f"http://c{i}.org/", x) for i, (x, _) in enumerate(cases)] + [(90, None, cases[0][0]), (90, None, cases[0][0])], "page_id long, url string, html string")
    rows = html_extract.extract(df).collect()
    assert sorted((r.page_id, r.text) for r in rows) == [*enumerate(t for _, t in cases), (90, "one"), (90, "one")]


def test_wide_unlike_pages():
    rng = random.Random(3)
    one, two = (html_extract.skeleton(tuple(f"div/{rng.choice(['p', 'ul', 'h2', 'pre'])}" for _ in range(1500))) for _ in range(2))
    shapes = {}
    html_extract.shape(one, shapes)
    html_extract.shape(two, shapes)
    size, pairs = html_extract.match(one.children[0], two.children[0], {})
    assert size == 1 + len(pairs) and all(i < k and j < n for (i, j), (k, n) in zip(pairs, pairs[1:], strict=False))


def plain(page):
    """Articles of the test tables straight from their markup: one block a tag that begins or ends one."""
    found = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
    if not found:
        return ""
    body = re.sub(r"<br>", " ", found[1])
    lines = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|li|ul|div)[^>]*>", body)]
    return "\n".join(x for x in lines if x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_query_against_the_markup_of_the_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in html_extract.op3_html_extract(spark, SF).collect()}
    assert got == {k: plain(v) for k, v in pages.items()}
