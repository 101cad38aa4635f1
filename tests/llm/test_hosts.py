"""Verdicts against plain code, shrinkage down the tree, and odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from panelgrid.llm.hosts import RULES, judge_corpus, judge_pages, reputations

SF = "/root/testdata/sf0.01"


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_rules(spark):
    urls = ["https://Example.NET/en/x?q", "http://a.example.com/de/", "http://b.org/fr/1#t", "http://b.org/fr", "net://net", "http://net/", "//x.net/", None, "", "nope", "a://b://c/d", "http://badexample.net", "http://xexample.com/de/z", "http://É.net/ñ?", "http://u:p@h.net:80/a?b/c", "x://y.net?z://q/en/", "http://example.com/de/fr/\nx"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in judge_corpus(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    for i, url in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == plain(url), url
        assert got[i].verdict == (RULES[got[i].rule] if got[i].rule else "allow")


def test_counts_of_the_corpus(spark):
    pages, labels = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id: max(1 - r.quality, r.toxic) for r in labels.collect()}
    seen = {}
    for r in pages.collect():
        number = re.search("://[^/?#]*/[^/?#]*/([0-9]+)", r.url)
        if number and int(number[1]) in bad:
            n, k = seen.get(plain(r.url)[0], (0, 0))
            seen[plain(r.url)[0]] = n + 1, k + bad[int(number[1])]
    got = judge_corpus(pages, labels).collect()
    assert len(got) == pages.count() and seen
    assert all((r.n_labelled, r.n_bad) == seen.get(r.host, (0, 0)) for r in got)


@pytest.fixture(scope="module")
def shrunk(spark):
    rows = [("a.bad.com", 200, 160), ("b.bad.com", 150, 120), ("new.bad.com", 0, 0), ("one.good.com", 1, 1), ("x.good.com", 300, 3), ("y.fine.org", 200, 2), ("z.fine.org", 0, 0), ("", 1, 0), ("plain", 3, 0)]
    return {r.host: r for r in reputations(spark.createDataFrame(rows, "host string, n long, k long")).collect()}


def test_shrinkage(shrunk):
    assert shrunk["a.bad.com"].blocked and shrunk["b.bad.com"].blocked
    assert not any(shrunk[h].blocked for h in ("one.good.com", "x.good.com", "y.fine.org", "z.fine.org", "", "plain"))
    assert shrunk["x.good.com"].bound < shrunk["new.bad.com"].bound < shrunk["a.bad.com"].bound  # no label, but a bad domain


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://h.com/en/5", "x"), (1, "http://h.com/en/5", "x"), (None, None, None), (2, "http://" + "a." * 20000 + "com/en/7", "v")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(5, 0, 0), (5, 1, 1), (5, None, None), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int").withColumn("bad", F.lit("x"))
    got = judge_corpus(pages, labels).collect()
    assert len(got) == 4 and sorted(r.n_bad for r in got if r.host == "h.com") == [2, 2]
    assert judge_corpus(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in judge_corpus(pages, labels.limit(0)).collect()} == {"allow"}
    assert judge_pages(pages, spark.createDataFrame([(1, 1)], "doc_id long, bad int"), F.lit(1), {}).where("rule is null").count() == 4
