import random
import re
from html.parser import HTMLParser

import pytest

from quillspark.llm.html_wrapper import MAX_NODES, align_children, coarsen, content_paths, expression, fold, host_wrappers, infer_wrapper, main_text, page_slots

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>Home</a></li><li>News</li></ul></nav><!-- ad --><div class="ad">Buy &amp; go</div>
<article><header><h1>The <b>title</b></h1></header><p>One&nbsp;&lt;two&gt;<br>three<p>four &#233;t&eacute;<aside>side</aside><form>f</form>
<div class="comments">rude</div><script>x</script><p>five</p></article><div id="cookie-notice">Cookies</div><footer>&copy; x</footer></body></html>"""


def slots(html):
    return page_slots(html)[0]


def wrapper_of(*pages):
    return infer_wrapper(expression(*page_slots(p)) for p in pages)


class Article(HTMLParser):
    """Brute force for the tables here: all text between the first <article> and its end."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag not in ("b", "i", "a", "em", "strong", "span"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        self.handle_starttag("end of " + tag, ()) if tag not in ("b", "i", "a", "em", "strong", "span") else None

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def article_of(html):
    parser = Article()
    parser.feed(html or "")
    parser.close()
    return " ".join("".join(parser.parts).split())


@pytest.mark.parametrize("least, change", [(0, lambda h: h), (0, lambda h: re.sub(r' class="[^"]*"', "", h)), (0, lambda h: re.sub(r"(</?)article\b", r"\1div", h)), (200, lambda h: re.sub(r"(</?)(article|nav|footer)\b", r"\1div", re.sub(r' class="[^"]*"', "", h)))])
def test_brute_force_whatever_names_parts_have(spark, small, least, change):
    """Without any names, an article of a few words cannot be told from a footer; so ``least`` characters."""
    from quillspark.tables import table

    pages = [(r.page_id, r.url, r.html) for r in table(spark, small, "pages").collect()]
    changed = spark.createDataFrame([(i, u, change(h)) for i, u, h in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(changed).collect()}
    want = {i: article_of(h) for i, u, h in pages}
    assert got.keys() == want.keys() and [i for i in want if len(want[i]) >= least and got[i] != want[i]] == []


def test_main_text(spark):
    pages = [(1, "http://a.org/1", PAGE), (2, "http://a.org/2", PAGE[: PAGE.index("five")]), (3, None, None), (4, "http://b.org", ""), (5, "http://a.org/1", PAGE), (None, "nourl", "<article>x"), (7, "http://c.org", "<article><p>a<p>b " + "z" * 50000)]
    got = [(r.page_id, r.text) for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    text = "The title One <two> three four été five"
    assert sorted(got, key=repr) == sorted([(1, text), (2, text.removesuffix(" five")), (3, ""), (4, ""), (5, text), (None, "x"), (7, "a b " + "z" * 50000)], key=repr)


def test_pages_without_regions_use_the_wrapper(spark):
    page = "<body><div><p>Welcome to us</p></div><section><p>{0}</p><p>{0} more</p></section><div><i>All rights</i></div>"
    pages = [(i, f"http://plain.org/{i}", page.format(f"story {i} " * 20)) for i in range(5)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == " ".join(("story %d " % i * 20).split()) + " " + " ".join(("story %d " % i * 20).split()) + " more"


def test_regions_are_decided_page_by_page(spark):
    article, other = "<body><article><p>{0}</article>", "<body><div class=text><section><h2>Head {0}</h2><p>{0}</section></div><footer>f</footer>"
    pages = [(1, "http://a.org/1", article.format("one " * 50)), (2, "http://a.org/2", other.format("two " * 50)), (3, None, article.format("three")), (4, None, other.format("four")), (5, "nohost", "<body><p>five")]
    got = {r.page_id: r.text.split() for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: ["one"] * 50, 2: ["Head"] + ["two"] * 100, 3: ["three"], 4: ["Head", "four", "four"], 5: ["five"]}


def test_weak_slots_of_open_pages_stay(spark):
    page = "<body><h1>Top</h1><div><h1>Title</h1><p>" + "long " * 1000 + "</p><h2>Sub</h2><ul><li>a<li>b</ul><blockquote>Said</blockquote><figure><figcaption>Seen</figcaption></figure><section><p>End</p></section></div><section><p>Elsewhere</p></section><nav>n</nav>"
    pages = [(1, "http://lone.org/1", page), (2, "http://twice.org/1", page), (2, "http://twice.org/1", page), (3, "http://b.org", "<article><p>x<figure><figcaption>Seen</figcaption></figure></article>")]
    got = sorted((r.page_id, r.text) for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    text = "Top Title " + "long " * 1000 + "Sub a b Said Seen End"
    assert got == [(1, text), (2, text), (2, text), (3, "x Seen")]


def test_template_text_is_known_across_expressions(spark):
    page = "<body><div><p>Welcome to us</p>{1}<h2>{0}</h2></div>"
    pages = [(i, f"http://plain.org/{i}", page.format(f"story {i}", "<ul><li>x%d</ul>" % i * (i % 2))) for i in range(4)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {0: "story 0", 1: "x1 story 1", 2: "story 2", 3: "x3 story 3"}


def test_template_text_in_articles_goes(spark):
    page = "<body><article><h1>{0}</h1><p>{0} text</p><p>more of {0}</p><div><p>Subscribe now</p></div></article>"
    pages = [(i, f"http://host.org/{i}", page.format(f"story {i}")) for i in range(9)] + [(100, "http://lone.org", page.format("alone"))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 story 3 text more of story 3" and got[100] == "alone alone text more of alone Subscribe now"


def test_names_are_priors_only():
    form = "<body><form><div><h1>Head {0}</h1><p>" + "words {0} " * 50 + "</p></div></form></body>"
    w = wrapper_of(*(form.format(i) for i in range(6)))
    s = slots(form.format(1))
    assert content_paths([p for p, _, _ in s], w) == {p for p, _, _ in s}
    s = slots("<article><h1 class='article-header'>Head</h1><div class=share-of-market>Share</div><div class='comment-list'>rude</div><p>Text</p></article>")
    kept = content_paths([p for p, _, _ in s], wrapper_of("<article><h1 class='article-header'>Head</h1><div class=share-of-market>Share</div><div class='comment-list'>rude</div><p>Text</p></article>"))
    assert [t for p, t, _ in s if p in kept] == ["Head", "Share", "Text"]


def test_elements_that_end_early_or_never():
    for html in ("<article><p>a</p><svg/><p>b</p></article>", "<article><p>a</p><svg><text>x</text></svg><p>b</p></article>", "<article><p>a</p><noscript>x</noscript><p>b</p></article>", "<article><p>a<iframe src=x><p>b</article>", "<article><div><p>a</p><template>x</div><p>b</p></article>"):
        kept = content_paths([p for p, _, _ in slots(html)], wrapper_of(html))
        assert " ".join(t for p, t, _ in slots(html) if p in kept) == "a b", html


def test_folding_and_alignment():
    assert fold(list("abbc")) == [["a"], ["b"], ["c"]] and fold(list("abcbd")) == [["a"], ["b", "c"], ["d"]]
    assert align_children([["x"], ["y"], ["z"]], [["x"], ["z"], ["w"]]) == [["x"], ["y"], ["z"], ["w"]]
    assert align_children([["x"], ["y"], ["z"]], [["z"], ["x"]]) == [["x", "y", "z"]]
    assert align_children([["x"], ["y"]], [["v"], ["x", "u", "y"]]) == [["v"], ["x", "u", "y"]]
    w = wrapper_of("<div><h1>t</h1><p>a<p>b</div>", "<div><p>c</div>")
    assert w["/div"][:2] == [2, 1] and w["/div/h1"][0] == 1 and w["/div/p"][:2] == [2, 2] and w["/div"][7] == [["h1"], ["p"]]


def test_combining_in_any_order_decides_alike():
    rng = random.Random(3)
    pages = ["<body>" + "".join(f"<{t}>{rng.random()}</{t}>" for t in rng.choices(["div", "p", "section", "h2", "ul"], k=8)) + "<div><p>" + "long words " * rng.randrange(40) + "</div>" for _ in range(40)]
    one = wrapper_of(*pages)
    other = infer_wrapper([wrapper_of(*pages[30:]), wrapper_of(*pages[10:30]), wrapper_of(*pages[:10])])
    strip = lambda w: {p: n[:7] for p, n in w.items()}
    assert strip(one) == strip(other)


def test_wrappers_are_bounded():
    rng = random.Random(5)
    pages = ["".join("<%s>" % t for t in rng.choices(["div", "section", "ul", "td", "ol", "dl"], k=9)) + "x%d" % i for i in range(400)]
    assert len(wrapper_of(*pages)) <= MAX_NODES
    exprs = [expression(*page_slots(p)) for p in pages]
    whole = coarsen(infer_wrapper(exprs[:200]), 50)
    parts = coarsen(infer_wrapper([coarsen(infer_wrapper(exprs[:90]), 50), coarsen(infer_wrapper(exprs[90:200]), 50)]), 50)
    assert {p: n[:7] for p, n in whole.items()} == {p: n[:7] for p, n in parts.items()}
    html = "<div>" * 200 + "deep" + "</div>" * 200
    assert [t for _, t, _ in slots(html)] == ["deep"] and content_paths([p for p, _, _ in slots(html)], wrapper_of(html))


def test_host_wrappers_and_names_that_clash(spark):
    pages = spark.createDataFrame([(i, "http://a.org/x", "<p>t%d" % i, "w", 1) for i in range(3)], "page_id long, url string, html string, wrapper string, `a.b` int")
    assert [r.text for r in main_text(pages).orderBy("page_id").collect()] == ["t0", "t1", "t2"]
    (row,) = host_wrappers(pages.selectExpr("'a.org' as host", "html")).collect()
    assert row.host == "a.org" and row.pages == 3


def test_broken_html():
    for html in ("<", "<p", "</", "<!--", "<a href='", "&", "<script>", "<p><![CDATA[x", "a<b>c</i>d", "<p>" * 2000 + "x"):
        assert isinstance(slots(html), list)


def test_empty(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
