import html
import os
import re

import pytest
from pyspark.sql import functions as F

from lexivec.llm import html_main as h

TABLES = "/root/testdata/sf0.1"


def text(page, template=()):
    return h.main_text(h.parsed(page)[0], set(template))


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a&amp;b &lt;c&gt; &eacute;&#233;&#x e9;", "a&b <c> éé&#x e9;"),
        ("<article><h1>T</h1><p>a\n  b<br>c<p>d</article><footer>f</footer>", "T\na b c\nd"),
        ("<nav><a>m</a></nav><main><p>x</p></main><aside>s</aside>", "x"),
        ("<header>h</header><p>x</p>", "x"),
        ("<article><header><h1>T</h1></header><p>x</p></article>", "T\nx"),
        ('<div class="ad">buy</div><p>x</p><div class="cookie-notice">c</div>', "x"),
        ('<article><p>x</p><section id="comments"><p>c</p></section></article>', "x"),
        ('<p>x</p><div role="navigation">n</div><form><p>f</p></form>', "x"),
        ('<script>var t="</p>";</script><style>p{}</style><p>x</p><!-- <p>no</p> -->', "x"),
        ("<ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>", "1\n2\na b\nc"),
        ("<p>one <b>two</b>three</p>four", "one twothree\nfour"),
        ("<p>cut off <b attr='", "cut off"),
        ("<p>cut &am", "cut &am"),
        ("<p>x</p><script>never closed <p>y", "x"),
        ('<article class="comment"><p>c</p></article><article><p>a</p></article>', "a"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<P CLASS=x>Up</P>", "Up"),
        ("<article><p>read more</p><div>download</div></article>", "read more\ndownload"),
        ('<div class="page with-sidebar"><p>body text</p></div>', "body text"),
        ('<article class="post no-comments"><p>x</p></article>', "x"),
        ('<p id="widget-theory">a</p><p data-role="menu">b</p><p title="role=menu class=ad hidden">c</p>', "a\nb\nc"),
        ('<p>x</p><div class="site-footer">f</div><div id="commentList">c</div><div class="x related_posts">r</div>', "x"),
    ],
)
def test_cases(page, want):
    assert text(page) == want


def test_deep_pages_do_not_recurse(spark):
    rows = [(0, "http://a.com/0", "<div>" * 3000 + "deep"), (1, "http://a.com/1", "<font>" * 1200 + "fonts"), (2, None, "<article>" * 4000 + "many")]
    rows.append((3, None, "<article>a</article>" * 4000))
    got = {r["page_id"]: r["text"] for r in h.extract(pages(spark, *rows)).collect()}
    assert got == {0: "deep", 1: "fonts", 2: "many", 3: "\n".join("a" * 4000)}


def test_slots_go_by_recurrence_alone():
    """Adverts, menus and footers that differ from page to page, on pages without article or main."""
    made = []
    for i in range(12):
        menu = "".join(f"<li><a>m{i}{j}</a></li>" for j in range(3))
        story = "".join(f"<p>story {i} has words {j} of its own and more of them</p>" for j in range(4))
        made.append((f"<h1>title {i}</h1>" + story, f"<nav><ul>{menu}</ul></nav><div class=zone7>buy {i}</div>", f"<footer>{i} foot</footer>"))
    whole = [h.parsed(f"<body>{side}<div class=body>{story}</div>{foot}</body>") for story, side, foot in made]
    n, words = {}, {}
    for _, order in whole:
        for key, (kind, count) in h.judged(order).items():
            if kind == h.SLOT:
                n[key], words[key] = n.get(key, 0) + 1, words.get(key, 0) + count
    total = sum(root.words for root, _ in whole)
    template = {k for k in n if n[k] >= 6 and words[k] <= h.SLOT_WORDS * total}
    for (root, _), (story, _, _) in zip(whole, made):
        assert h.main_text(root, template, by_name=False, by_root=False) == text(story)
        assert "buy" in h.main_text(root, set(), by_name=False, by_root=False)


def test_slots_of_a_host_go(spark):
    rows = [(i, f"http://a.com/{i}", f"<div class=zone7>buy {i}</div><div class=body><p>{'own words here ' * 9}{i}</p></div>") for i in range(12)]
    rows += [(100, "http://b.org/x", "<div class=zone7>alone</div>")]
    got = {r["page_id"]: r["text"] for r in h.extract(pages(spark, *rows)).collect()}
    assert got[100] == "alone" and all(got[i] == "own words here " * 9 + str(i) for i in range(12))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_the_table_against_its_articles(spark):
    """Each page's article as a plain pattern finds it; recurrence alone gives the same on hosts of enough pages."""
    from collections import Counter

    found = spark.read.parquet(f"{TABLES}/pages.parquet")
    rows = found.select("page_id", "url", "html").collect()
    want = {}
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        lines = [html.unescape(re.sub("<[^>]*>", "", x)) for x in re.split("</?(?:h1|p)>", body.replace("<br>", " "))]
        want[r["page_id"]] = "\n".join(" ".join(x.split()) for x in lines if x.strip())
    got = {r["page_id"]: r["text"] for r in h.extract(found).collect()}
    assert got == want
    host = lambda url: url.split("://")[1].split("/")[0].lower()
    own = found.withColumn("host", F.xxhash64(h.split_url(F.col("url"))[0])).select("host", "html", "page_id")
    template: dict[int, set[int]] = {}
    for r in h.template_subtrees(own).collect():
        template.setdefault(r["host"], set()).add(r["subtree"])
    key = {r["page_id"]: r["host"] for r in own.collect()}
    pages_of = Counter(host(r["url"]) for r in rows)
    alone = [r["page_id"] for r in rows if pages_of[host(r["url"])] >= h.MIN_PAGES]
    by_id = {r["page_id"]: r["html"] for r in rows}
    same = sum(h.main_text(h.parsed(by_id[i])[0], template.get(key[i], set()), by_name=False, by_root=False) == want[i] for i in alone)
    assert alone and same >= 0.95 * len(alone), (same, len(alone))


def test_deep_and_long():
    assert text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(text("<p>word</p>" * 50_000).split("\n")) == 50_000


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, p, "extra", 1) for i, u, p in rows], "page_id long, url string, html string, text string, host int")


def test_template_of_a_host_goes(spark):
    promo = "<div><span>Our great offer</span></div>"
    rows = [(i, f"http://A.com/{i}", f"<body>{promo}<div>own story {i}</div></body>") for i in range(20)]
    rows += [(100, "http://b.org/x", f"<body>{promo}<div>other</div></body>"), (101, None, None), (102, "no scheme", "<p>t"), (100, "http://b.org/x", "<p>again")]
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in h.extract(pages(spark, *rows)).collect()))
    assert got[:2] == [(0, "own story 0", 11), (1, "own story 1", 11)]
    assert (100, "Our great offer\nother", 21) in got and (101, "", 0) in got and (102, "t", 1) in got and (100, "again", 5) in got
    assert h.extract(pages(spark, (1, "u", "x")).limit(0)).count() == 0


def test_paragraphs_of_copied_articles_stay(spark):
    page = "<article><h1>Same</h1><p>copied paragraph</p><div class='x'>widget</div></article>"
    got = {r["text"] for r in h.extract(pages(spark, *[(i, "http://a.com/1", page) for i in range(10)])).collect()}
    assert got == {"Same\ncopied paragraph"}


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(h, "BROADCAST_ROWS", -1)
    rows = [(i, "http://a.com/1", f"<div>menu of all</div><div>own {i}</div>") for i in range(10)]
    assert {r["text"] for r in h.extract(pages(spark, *rows)).collect()} == {f"own {i}" for i in range(10)}


def test_a_large_host_has_no_higher_bar(spark):
    side = "<div><span>Office closed on Monday</span></div>"
    rows = [(i, f"http://a.com/{i}", f"<article>{side if i < 40 else ''}<p>own {i}</p></article>") for i in range(300)]
    rows += [(300 + i, "http://a.com/c", "<article><div>copied story</div><p>as it was</p></article>") for i in range(40)]
    got = {r["page_id"]: r["text"] for r in h.extract(pages(spark, *rows)).collect()}
    assert all(got[i] == f"own {i}" for i in range(300))
    assert {got[300 + i] for i in range(40)} == {"copied story\nas it was"}


def test_text_of_every_article_goes(spark):
    extra = "<p>Subscribe now</p><table><tr><td><div>Call us</div>cell {0}</td></tr></table>"
    rows = [(i, f"http://a.com/{i}", f"<article><p>own {i}</p>{extra.format(i)}{'<p>shared line</p>' if i < 6 else ''}</article>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in h.extract(pages(spark, *rows)).collect()}
    assert all(got[i] == f"own {i}\ncell {i}" + "\nshared line" * (i < 6) for i in range(20))
