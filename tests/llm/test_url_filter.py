import pytest

from quillspark.llm.url_filter import host_of, path_of, url_filter

URLS = [
    (0, "HTTP://Sub.Example.COM/en/7x?q#f"), (1, "https://a.org/es/"), (2, "http://x.net?q=/de/"), (3, "nourl/en/"), (4, None), (5, ""),
    (6, "ftp://B.co.uk#/en/1"), (7, "http://example.net/de/81"), (8, "http://example.net/de/9"), (9, "http://com/en/"), (10, "http://notcom/en/"), (11, "a://b://c/d"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(URLS, "page_id long, url string")


def test_host_and_path(spark, pages):
    got = {r.page_id: (r.h, r.p) for r in pages.select("page_id", host_of(pages.url).alias("h"), path_of(pages.url).alias("p")).collect()}
    assert got[0] == ("sub.example.com", "/en/7x") and got[2] == ("x.net", "") and got[3] == ("", "") and got[6] == ("b.co.uk", "") and got[11] == ("b:", "//c/d")


def test_rules_and_reputation(spark, pages):
    bad = [(100 + i, f"http://bad.example.org/fr/{i}") for i in range(40)]
    good = [(200 + i, f"http://good.example.org/fr/{100 + i}") for i in range(40)]
    table = pages.unionByName(spark.createDataFrame(bad + good + [(999, "http://bad.example.org/fr/none")], pages.schema))
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i in range(140)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter(table, labels).collect()}
    assert len(got) == table.count()
    rules = {0: ("example.com/en/7", "allow"), 1: ("org/es/", "block"), 7: ("example.net/de/8", "block"), 8: ("net/de/", "allow"), 9: ("com/en/", "block")}
    for i, rule in rules.items():
        assert (got[i].uf_rule, got[i].uf_verdict) == rule
    assert got[10].uf_rule is None
    assert got[999].uf_verdict == "block" and got[200].uf_verdict == "allow"
    assert got[4].uf_host == "" and got[4].uf_verdict in ("allow", "block")


def test_empty_tables(spark, pages):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_filter(pages.limit(0), none).count() == 0
    assert {r.uf_verdict for r in url_filter(pages, none).where("uf_rule is null").collect()} == {"allow"}


def test_names_that_clash(spark, pages):
    names = ["page_id", "url", "uf_pages", "uf_r", "a.b", "host", "l1"]
    odd = pages.selectExpr("page_id", "url", *["'x'"] * 5).toDF(*names)
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    out = url_filter(odd, labels)
    assert out.columns == [*names, "uf_host", "uf_path", "uf_rule", "uf_verdict", "uf_rate", "uf_low"]
    assert {tuple(r[2:7]) for r in out.collect()} == {("x",) * 5}
    assert {tuple(r[-6:]) for r in out.collect()} == {tuple(r[-6:]) for r in url_filter(pages, labels).collect()}
