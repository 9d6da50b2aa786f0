from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from loomsift.functions import urls
from loomsift.operators import links

URLS = [
    "https://Example.com/a/b/?q=1#f",
    "HTTP://user:pw@host.org:8080/x///",
    "https://h.com/a;p=1/b;c=2;d",
    "https://h.com;x/y",
    "https://h.com",
    "https://h.com?x=/y/",
    "//h.com/p",
    "",
    "localhost/path",
    "https://localhost/",
    "https://h.com/a b?c",
    "  https://lead.com/x",
    "https://[bad/x",
    "mailto:someone@x.org",
]


def _canonical(url):
    try:
        p = urlparse(url)
    except ValueError:
        return url
    return f"{p.scheme}://{p.netloc}{p.path}".rstrip("/")


def _domain(url):
    try:
        return urlparse(url).netloc.lower()
    except ValueError:
        return ""


def test_canonical_and_domain_follow_the_standard_split(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    rows = df.select("url", urls.canonical(F.col("url")), urls.domain(F.col("url")), urls.root_domain(F.col("url"))).collect()
    for url, canonical, domain, root in rows:
        assert canonical == _canonical(url), url
        assert domain == _domain(url), url
        assert root == ".".join(_domain(url).split(":")[0].split(".")[-2:]), url


def _one(spark, url, column):
    return spark.createDataFrame([(url,)], "url string").select(column).first()[0]


@pytest.mark.parametrize(
    "url,depth,expected",
    [
        ("https://h.com/blog/x", 0, -30),
        ("https://h.com/blog/docs/x", 1, 50),
        ("https://h.com/category/login", 0, 140),
        ("https://h.com/a?b", 2, 220),
        ("https://h.com/1/2/3/4/5", 0, 15),
        ("https://h.com/1/2/3/4", 0, 0),
    ],
)
def test_priority(spark, url, depth, expected):
    assert _one(spark, url, urls.priority(F.col("url"), F.lit(depth))) == expected


@pytest.mark.parametrize(
    "url,expected",
    [
        ("https://h.com/x", 50),
        ("https://h.com/blog/x", 80),
        ("https://h.com/tag/x", 25),
        ("https://h.com/blog/tag/x", 55),
        ("https://h.com/about", 0),
        ("https://h.com/browse/letter/a", 0),
        ("https://h.com/" + "a" * 136, 50),
        ("https://h.com/" + "a" * 137, 35),
        ("https://h.com/a?b?c", 35),
        ("https://h.com/1/2/3/4/5/6", 50),
        ("https://h.com/1/2/3/4/5/6/7", 40),
    ],
)
def test_url_quality(spark, url, expected):
    assert _one(spark, url, urls.quality(F.col("url"))) == expected


@pytest.mark.parametrize(
    "url,expected",
    [
        ("https://h.com/privacy", "browse"),
        ("https://h.com/API/v1", "non_content"),
        ("https://h.com/x.JPG", "non_content"),
        ("https://h.com/apiary", None),
    ],
)
def test_url_gate(spark, url, expected):
    assert _one(spark, url, urls.gate_reason(F.col("url"))) == expected


def test_links_are_resolved_like_urljoin(spark):
    base = "https://h.com/dir/page?x=1"
    rooted = ["/x", "/x?y=1#z", "/a/../b", "/../x", "/a/./b/", "/a/..", "/", "/x#", "/x?"]
    html = "".join(f'<a href="{r}">' for r in rooted) + (
        "<a HREF='https://o.org/p'><a href='//cdn.net/q'><a href=\"x.html\"><a href=\"../y\">"
        f'<a href="{base}"><a href="/x">'
    )
    df = spark.createDataFrame([(base, html)], "url string, html string")
    got = {r.dst_url for r in links.extract_links(df).collect()}
    assert got == {urljoin(base, r) for r in rooted} | {"https://o.org/p", "https://cdn.net/q"}


def test_subdomains(spark):
    html = '<a href="https://Blog.site.org/x"><a href="http://www.site.org"><a href="https://other.com">'
    pages = spark.createDataFrame([(1, "https://site.org/a", html)], "page_id bigint, url string, html string")
    observed = {r[0] for r in links.observed_subdomains(pages).collect()}
    assert observed == {"https://Blog.site.org", "https://www.site.org"}
    candidates = links.subdomain_candidates(pages)
    assert candidates.count() == 39
    assert {r.candidate for r in links.verified_candidates(candidates, pages).collect()} == {
        "https://blog.site.org",
        "https://www.site.org",
    }
    assert tuple(links.discovery_stats(pages).first()) == (2, 2, 37)
