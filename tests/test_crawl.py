import hashlib
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from loomsift.options import CrawlOptions, GateOptions
from loomsift.operators.ranking import ranked_in_groups
from loomsift.plans import crawl

FILLER = "<p>" + "words of a page that has some content in it 1 2 3 " * 3 + "</p>"


def _pages(spark, graph):
    rows = [(i, url, "".join(f'<a href="{t}">x</a>' for t in targets) + FILLER) for i, (url, targets) in enumerate(graph.items())]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def _seeds(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def _depths(frontier):
    return {r.url: r.depth for r in frontier.collect()}


def test_levels_and_dedup(spark):
    a, b, c, d = (f"https://h.com/{x}" for x in "abcd")
    graph = {a: [b, c, a + "?again=1"], b: [c, d, a], c: [d], d: []}
    assert _depths(crawl.crawl_frontier(_pages(spark, graph), _seeds(spark, a + "#t", a), CrawlOptions(max_depth=2))) == {a: 0, b: 1, c: 1}
    assert _depths(crawl.crawl_frontier(_pages(spark, graph), _seeds(spark, a), CrawlOptions(max_depth=3))) == {a: 0, b: 1, c: 1, d: 2}
    assert _depths(crawl.crawl_frontier(_pages(spark, graph), _seeds(spark, a), CrawlOptions(crawler_enabled=False))) == {a: 0}


def test_sites(spark):
    seed = "https://www.h.com/a"
    graph = {seed: ["https://h.com/x", "https://sub.h.com/y", "https://other.org/z"]}
    inside = _depths(crawl.crawl_frontier(_pages(spark, graph), _seeds(spark, seed), CrawlOptions(max_depth=2)))
    assert set(inside) == {seed, "https://h.com/x", "https://sub.h.com/y"}
    everywhere = _depths(crawl.crawl_frontier(_pages(spark, graph), _seeds(spark, seed), CrawlOptions(max_depth=2, same_domain=False)))
    assert "https://other.org/z" in everywhere
    none = _seeds(spark, "").limit(0)
    assert crawl.same_site(_seeds(spark, "https://a.b/c"), none).count() == 1


def test_gated_and_empty_pages_give_no_links(spark):
    a, gated, empty = "https://h.com/a", "https://h.com/privacy", "https://h.com/e"
    pages = _pages(spark, {a: [gated, empty], gated: ["https://h.com/g1"]}).unionAll(
        spark.createDataFrame([(9, empty, '<a href="https://h.com/e1">x</a>')], "page_id bigint, url string, html string")
    )
    assert set(_depths(crawl.crawl_frontier(pages, _seeds(spark, a), CrawlOptions(max_depth=3)))) == {a, gated, empty}


def test_domain_cap_leaves_urls_for_later(spark):
    a = "https://h.com/a"
    graph = {a: [f"https://x.org/{i}" for i in range(5)] + ["https://y.org/1"], "https://y.org/1": ["https://x.org/4"]}
    options = CrawlOptions(max_depth=3, same_domain=False, max_per_domain=2)
    got = crawl.crawl_frontier(_pages(spark, graph), _seeds(spark, a), options)
    counts = {r.domain: r["count"] for r in got.groupBy("domain").count().collect()}
    assert counts == {"h.com": 1, "x.org": 2, "y.org": 1}


@pytest.mark.parametrize("seed", ["", "a", "b", "c", "d"])
def test_refused_links_take_no_quota(spark, seed):
    a = "https://h.com/a"
    graph = {a: [f"https://x.org/{i}" for i in range(5)] + ["https://y.org/1"]}
    options = CrawlOptions(max_depth=2, same_domain=False, max_per_domain=1, links_per_page=3, order_seed=seed)
    got = crawl.crawl_frontier(_pages(spark, graph), _seeds(spark, a), options)
    assert sorted(r.domain for r in got.collect()) == ["h.com", "x.org", "y.org"]


def test_verified_subdomains_come_first(spark):
    early = _seeds(spark, "https://s.h.com", "https://h.com/a")
    got = crawl.crawl_frontier(_pages(spark, {}), _seeds(spark, "https://h.com/a", "https://h.com/b"), CrawlOptions(max_depth=1), subdomains=early)
    assert set(_depths(got)) == {"https://s.h.com", "https://h.com/a", "https://h.com/b"}


def _priority(url, depth):
    return depth * 100  # the URLs of the random graph hold no rated words


def _simulate(graph, seeds, o):
    """One page after the other, one link after the other, as a crawler with a queue does it within a level."""
    order = lambda u: hashlib.md5(u.encode()).hexdigest()
    admitted, used = {}, {}

    def push(url, depth):
        name = urlparse(url).netloc
        if url in admitted or used.get(name, 0) >= o.max_per_domain:
            return False
        admitted[url] = depth
        used[name] = used.get(name, 0) + 1
        return True

    level = [u for u in sorted(seeds, key=lambda u: (_priority(u, 0), order(u), u)) if push(u, 0)]
    for depth in range(1, o.max_depth):
        found = []
        for src in sorted(level, key=lambda u: (_priority(u, depth - 1), u)):
            targets = sorted({t for t in graph.get(src, []) if t != src}, key=lambda t: (order(t), t))[: 2 * o.links_per_page]
            added = 0
            for url in targets:
                if added >= o.links_per_page:
                    break
                if push(url, depth):
                    added += 1
                    found.append(url)
        level = found
    return admitted


def _random_graph(seed, hosts=5, urls=60, most=9):
    rng = random.Random(seed)
    names = [f"https://h{rng.randrange(hosts)}.org/p{i}" for i in range(urls)]
    return names, {u: [rng.choice(names) for _ in range(rng.randint(0, most))] for u in names[: urls * 5 // 6]}


@pytest.mark.parametrize(("seed", "quota", "cap"), [(1, 2, 6), (2, 2, 3), (5, 3, 100)])
def test_frontier_equals_a_simulation(spark, seed, quota, cap):
    names, graph = _random_graph(seed)
    options = CrawlOptions(max_depth=4, links_per_page=quota, max_per_domain=cap, same_domain=False)
    got = _depths(crawl.crawl_frontier(_pages(spark, graph), _seeds(spark, *names[:4]), options))
    assert got == _simulate(graph, names[:4], options)


def test_refused_links_leave_their_place_to_others(spark):
    a, b, c = "https://h.com/a", "https://h.com/b", "https://h.com/c"
    graph = {c: [a, b], a: [f"https://x.org/{i}" for i in range(10)], b: ["https://x.org/z"]}
    options = CrawlOptions(max_depth=3, same_domain=False, max_per_domain=6, links_per_page=4)
    got = crawl.crawl_frontier(_pages(spark, graph), _seeds(spark, c), options)
    assert got.filter("domain = 'x.org'").count() == 5 and "https://x.org/z" in _depths(got)


def test_no_page_with_quota_has_a_refused_link_to_a_domain_with_room(spark):
    rng = random.Random(9)
    links, quota, rooms = [], 3, {f"d{k}": rng.randrange(1, 25) for k in range(8)}
    for p in range(60):
        for place in range(rng.randrange(0, 7)):
            domain = rng.choice([*rooms, "d0", "d0"])
            links.append((p % 3, f"p{p:02d}", f"{place}", f"{domain}/{rng.randrange(12)}", domain, rooms[domain]))
    df = spark.createDataFrame(links, "src_priority int, src_url string, ord string, url string, domain string, room bigint")
    got = {(r.src_url, r.url) for r in crawl.joint_admission(df, quota).collect()}
    used, pages, taken = {}, {}, set()
    for _, page, _, url, domain, room in sorted(links):
        if url not in taken and used.get(domain, 0) < room and pages.get(page, 0) < quota:
            taken.add(url)
            used[domain], pages[page] = used.get(domain, 0) + 1, pages.get(page, 0) + 1
            assert (page, url) in got
    assert len(got) == len(taken) and any(used.get(d, 0) == n for d, n in rooms.items()) and quota in pages.values()


def test_only_reached_pages_are_extracted(spark, monkeypatch):
    names, graph = _random_graph(6)
    pages, read = _pages(spark, graph), []
    whole = crawl.read_pages
    monkeypatch.setattr(crawl, "read_pages", lambda df, *a: read.append(sorted(r.url for r in df.select("url").collect())) or whole(df, *a))
    options = CrawlOptions(max_depth=2, links_per_page=2, same_domain=False)
    reached = _depths(crawl.crawl_frontier(pages, _seeds(spark, names[0]), options))
    assert read == [[names[0]]] and len(reached) == 3
    read.clear()
    crawl.crawl_and_curate(pages, _seeds(spark, names[0]), options).count()
    assert read == [sorted(u for u in reached if u in graph and d == reached[u]) for d in (0, 1)]


def test_pages_beyond_a_broadcast_are_filtered_ahead_of_the_shuffle(spark):
    names, graph = _random_graph(7)
    folder = crawl.table_of(_pages(spark, graph), "pages")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = crawl.pages_at(folder, crawl.page_index(folder), _seeds(spark, *names[:5]))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "might_contain" in plan
        assert sorted(r.url for r in found.collect()) == sorted(names[:5])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("n", [3, 500])
def test_a_crawl_stops_at_accepted_pages(spark, n):
    names, graph = _random_graph(8)
    pages = _pages(spark, graph)
    gate = GateOptions(use_quality_filter=False, digit_density=False, min_chars=50)
    o = CrawlOptions(max_depth=3, links_per_page=3, same_domain=False, stop_after=n)
    got = sorted(r.url for r in crawl.crawl_and_curate(pages, _seeds(spark, names[0]), o, gate).select("url").collect())
    reached = _simulate(graph, names[:1], o)
    order = sorted((d, _priority(u, d), hashlib.md5(u.encode()).hexdigest(), u) for u, d in reached.items() if u in graph)
    assert got == sorted(u for *_, u in order[:n])


def test_curated_pages_are_those_reached(spark):
    a, b = "https://h.com/a", "https://h.com/b"
    pages = _pages(spark, {a + "?x=1": [b], b: [], "https://h.com/not": []})
    gate = GateOptions(use_quality_filter=False, digit_density=False, min_chars=50)
    rows = crawl.crawl_and_curate(pages, _seeds(spark, a), CrawlOptions(max_depth=2), gate).select("url").collect()
    assert sorted(r.url for r in rows) == [a, b]


def test_a_large_cap_on_one_domain_is_spread(spark):
    text = F.col("id").cast("string")
    df = spark.range(120_000).select(F.lit("x.org").alias("domain"), (F.col("id") % 5).alias("priority"), F.md5(text).alias("ord"), text.alias("url"))
    got = crawl.domain_cap(df.repartition(4), None, 100_000)
    assert got.count() == 100_000 and got.agg(F.max("priority")).first()[0] == 4
    sizes = ranked_in_groups(df, ["domain"], ["priority", "ord", "url"])
    assert sizes.agg(F.max("rn"), F.min("rn"), F.count_distinct("rn")).first()[:] == (120_000, 1, 120_000)
    # the sort of the one domain is dealt over all partitions
    placed = df.repartitionByRange("domain", "priority", "ord", "url").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) > 1 and max(r["count"] for r in placed) < 60_000
