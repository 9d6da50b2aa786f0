"""Bounded-depth crawl over a table of pages.

A narrow table of canonical URLs is made once. Each level joins it with the URLs that the level before admitted, and only the pages found
are extracted, so the work follows what the crawl reaches and not the size of the table.
"""

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.functions import urls
from loomsift.functions.session import cut, table_of
from loomsift.operators.links import base_columns, link_array, subdomain_candidates, verified_candidates
from loomsift.operators.ranking import first_per_group, ranked_in_groups
from loomsift.options import CrawlOptions, GateOptions, RenderOptions
from loomsift.plans.curate import apply_gates, gated_text, stop_after, training_rows


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Candidates that are not queued yet; exact, so no URL is lost."""
    return candidates.join(seen.select(key), key, "left_anti")


def sites_of(seeds: DataFrame, url: str = "url") -> DataFrame:
    return seeds.select(urls.site_key(F.col(url)).alias("_site")).filter("_site <> ''").distinct()


def of_sites(candidates: DataFrame, sites: DataFrame, url: str = "url") -> DataFrame:
    return candidates.withColumn("_site", urls.site_key(F.col(url))).join(sites, "_site", "left_semi").drop("_site")


def same_site(candidates: DataFrame, seeds: DataFrame, url: str = "url") -> DataFrame:
    """Candidates of the sites of the seeds; all of them when there are no seeds.

    A domain is allowed when it, or its last two labels, is a seed domain or the last two labels
    of one. That comes down to equal last two labels: one semi join.
    """
    sites = sites_of(seeds)
    return candidates if sites.isEmpty() else of_sites(candidates, sites, url)


def first_seen(arrivals: DataFrame, key: str = "url", order: tuple[str, ...] = ("src_priority", "src_url", "ord")) -> DataFrame:
    """First arrival of every URL. A minimum per key: copies are merged before the shuffle."""
    rest = [c for c in arrivals.columns if c != key and c not in order]
    first = arrivals.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(key, "_first.*")


def link_order(url, options: CrawlOptions):
    """Pseudo-random but fixed order of links."""
    return F.md5(F.concat(F.lit(options.order_seed), url))


def links_per_page(links: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """At most ``n`` links of every source page."""
    return first_per_group(links, ["src_url"], [F.asc(order), F.asc("url")], n).drop("rn")


def with_room(candidates: DataFrame, used: DataFrame | None, cap: int) -> DataFrame:
    """Candidates of domains that take more, with ``room``: the cap less what ``used`` (domain, n) holds already."""
    if used is None:
        return candidates.withColumn("room", F.lit(cap).cast("bigint"))
    left = candidates.join(used.select("domain", F.col("n").alias("_used")), "domain", "left")
    return left.withColumn("room", F.lit(cap) - F.coalesce("_used", F.lit(0))).drop("_used").filter("room > 0")


def domain_cap(candidates: DataFrame, used: DataFrame | None, cap: int, order: tuple[str, ...] = ("priority", "ord")) -> DataFrame:
    """At most ``cap`` URLs per domain, less those that ``used`` (domain, n) holds already; a domain and a cap may be of any size."""
    ranked = ranked_in_groups(with_room(candidates, used, cap), ["domain"], [*order, "url"])
    return ranked.filter("rn <= room").drop("rn", "room")


_ARRIVAL = ("src_priority", "src_url", "ord", "url")


def joint_admission(candidates: DataFrame, n: int) -> DataFrame:
    """Links ``(src_priority, src_url, ord, url, domain, room)`` that come in when pages, one after the other, offer theirs in order.

    A link comes in unless its URL is in already, its domain has no room left, or its page has ``n`` links in. That is found
    for all pages at once: each page offers its first ``n`` links that are not refused; a URL holds the first offer, a domain
    the first ``room`` of those, in order of arrival; every link that comes after what is held is refused for good. The
    offers that nobody refuses any more are those of the one-by-one order, as URLs and domains all prefer the same arrivals.
    """
    copies = candidates.groupBy("src_priority", "src_url", "url", "domain", "room").agg(F.min("ord").alias("ord"))
    live, own = cut(copies), F.struct(*_ARRIVAL)
    while True:
        offered = first_per_group(live, ["src_url"], [F.asc("ord"), F.asc("url")], n).drop("rn")
        held = cut(offered.groupBy("url", "domain", "room").agg(F.min(own).alias("_held"), F.count("*").alias("_offers")))
        counts = held.groupBy("domain", "room").agg(F.count("*").alias("_n"), F.sum("_offers").alias("_offers"))
        told = counts.agg(F.sum(F.col("_offers") - F.col("_n")).alias("again"), F.count_if(F.col("_n") > F.col("room")).alias("full")).first()
        if not told["again"] and not told["full"]:
            return offered
        stays = F.coalesce(own <= F.col("_held"), F.lit(True))
        left = live.join(held.select("url", "_held"), "url", "left")
        if told["full"]:
            rows = held.join(counts.filter("_n > room").select("domain"), "domain", "left_semi").select("domain", "room", "_held")
            last = ranked_in_groups(rows, ["domain"], ["_held"]).filter("rn = room").select("domain", F.col("_held").alias("_last"))
            left = left.join(last, "domain", "left")
            stays = stays & F.coalesce(own <= F.col("_last"), F.lit(True))
        live = cut(left.filter(stays).select(live.columns))


def read_pages(pages: DataFrame, gate: GateOptions, options: CrawlOptions) -> DataFrame:
    """Every page under its canonical URL: URL gate, text, error and links.

    Links are in fixed order, 2n at most; ordering and cutting happen inside the row. Gated pages
    and pages without content have none.
    """
    canonical = pages.withColumn("url", urls.canonical(F.col("url"))).withColumn("_raw", F.col("html"))
    read = gated_text(canonical, gate)
    ok = F.col("url_gate").isNull() & F.col("error").isNull()
    read = base_columns(read)
    read = read.withColumn("_links", F.when(ok, link_array(F.col("url"), F.col("_raw"), F.col("_scheme"), F.col("_netloc"))))
    keyed = F.transform("_links", lambda x: F.struct(link_order(x, options).alias("ord"), x.alias("url")))
    first = F.slice(F.array_sort(keyed), 1, 2 * options.links_per_page)
    return read.select("page_id", "url", "url_gate", "text", "error", first.alias("dst"))


def link_table(read: DataFrame) -> DataFrame:
    """``(src_url, dst)`` of pages with links; of pages with one canonical URL the lowest id counts."""
    found = read.select(F.col("url").alias("src_url"), "page_id", "dst")
    one = first_per_group(found, ["src_url"], [F.asc("page_id")], 1).drop("rn", "page_id")
    return one.filter(F.size("dst") > 0)


def page_links(pages: DataFrame, gate: GateOptions, options: CrawlOptions) -> DataFrame:
    """Link table straight from pages."""
    return link_table(read_pages(pages, gate, options))


def expand(level: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the pages of a level, canonical, with the order in which they arrive."""
    joined = level.select(F.col("url").alias("src_url"), F.col("priority").alias("src_priority")).join(links, "src_url")
    each = joined.select("src_url", "src_priority", F.explode("dst").alias("d"))
    return each.select("src_url", "src_priority", F.col("d.ord").alias("ord"), urls.canonical(F.col("d.url")).alias("url"))


def subdomain_seeds(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Common subdomains of the seeds' root domains whose host occurs in the pages, as URLs."""
    found = verified_candidates(subdomain_candidates(seeds), pages)
    return found.select(F.col("candidate").alias("url"))


def _fresh(arrivals: DataFrame, seen: DataFrame | None, sites: DataFrame | None, depth: int, options: CrawlOptions) -> DataFrame:
    fresh = arrivals if seen is None else unseen(arrivals, seen)
    if sites is not None:
        fresh = of_sites(fresh, sites)
    return fresh.withColumn("domain", urls.domain(F.col("url")))


def _rated(admitted: DataFrame, depth: int, options: CrawlOptions) -> DataFrame:
    priority = urls.priority(F.col("url"), F.lit(depth), options.prioritize_content)
    return admitted.select("url", F.lit(depth).alias("depth"), "domain", priority.alias("priority"), "ord")


def page_index(pages: DataFrame) -> DataFrame:
    """``(url, page_id)``: the lowest id of each canonical URL. Narrow, and the only thing made of all pages."""
    return pages.select(urls.canonical(F.col("url")).alias("url"), "page_id").groupBy("url").agg(F.min("page_id").alias("page_id"))


def pages_at(pages: DataFrame, index: DataFrame, level: DataFrame) -> DataFrame:
    """The pages of the URLs of a level, under their canonical URL.

    Ids are found on narrow tables. With few of them the join broadcasts them; with many, Spark filters the pages by a Bloom filter of the ids
    ahead of the shuffle (it does so where there is a condition on them): html of pages that are not reached does not move.
    """
    ids = table_of(index.join(level.select("url"), "url", "left_semi").select("page_id", F.col("url").alias("_url")), "ids")
    some = ids.filter("_url >= ''")
    found = pages.join(some, "page_id").withColumn("url", urls.canonical(F.col("url")))
    return found.filter(F.col("url") == F.col("_url")).drop("_url")


def crawl_levels(
    pages: DataFrame,
    seeds: DataFrame,
    options: CrawlOptions = CrawlOptions(),
    gate: GateOptions = GateOptions(),
    subdomains: DataFrame | None = None,
    links: DataFrame | None = None,
    read_last: bool = False,
) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """Level by level ``(url, depth, domain, priority, ord)`` and the pages read there as :func:`read_pages` has them.

    A caller that needs no further level just stops. The last level is read only if asked for; with a link table in
    ``links`` no other level is, either.
    """
    starts = seeds.select(urls.canonical(F.col("url")).alias("url"), F.lit(1).alias("src_priority"))
    if subdomains is not None:
        early = subdomains.select(urls.canonical(F.col("url")).alias("url"), F.lit(0).alias("src_priority"))
        starts = early.unionByName(starts)
    starts = starts.select("url", "src_priority", F.lit("").alias("src_url"), link_order(F.col("url"), options).alias("ord"))
    sites = cut(sites_of(seeds)) if options.same_domain else None
    # merging the copies of a URL first keeps a much-linked URL out of the joins
    first = _rated(_fresh(first_seen(starts), None, sites, 0, options), 0, options)
    level = cut(domain_cap(first, None, options.max_per_domain))
    index = cut(page_index(pages))
    links = links if links is None else cut(links)
    seen, used, depths = level.select("url"), None, options.max_depth if options.crawler_enabled else 1
    for depth in range(max(1, depths)):
        last = depth + 1 >= depths
        read = None
        if read_last if last else read_last or links is None:
            read = table_of(read_pages(pages_at(pages, index, level), gate, options), "read")
        yield level, read
        if last:
            return
        counts = level.groupBy("domain").agg(F.count("*").alias("n"))
        used = cut(counts if used is None else used.unionByName(counts).groupBy("domain").agg(F.sum("n").alias("n")))
        fresh = _fresh(expand(level, link_table(read) if links is None else links), seen, sites, depth + 1, options)
        admitted = joint_admission(with_room(fresh, used, options.max_per_domain), options.links_per_page)
        level = cut(_rated(admitted, depth + 1, options))
        if level.isEmpty():
            return
        seen = seen.unionByName(level.select("url"))


def crawl_frontier(
    pages: DataFrame,
    seeds: DataFrame,
    options: CrawlOptions = CrawlOptions(),
    gate: GateOptions = GateOptions(),
    subdomains: DataFrame | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """URLs a crawl reaches: ``(url, depth, domain, priority, ord)``.

    Seeds come in at depth 0, up to the cap of their domain; ``subdomains`` ahead of them. At each further level the pages of the one
    before offer their unseen links of allowed sites, see :func:`joint_admission`. A URL that a cap or quota turns away is not
    marked as seen and may come in at a later level. ``links`` takes a link table that exists already.
    """
    levels = [level for level, _ in crawl_levels(pages, seeds, options, gate, subdomains, links)]
    return reduce(DataFrame.unionByName, levels)


def crawl_and_curate(
    pages: DataFrame,
    seeds: DataFrame,
    options: CrawlOptions = CrawlOptions(),
    gate: GateOptions = GateOptions(),
    render: RenderOptions = RenderOptions(),
) -> DataFrame:
    """Training rows of the pages that a crawl reaches.

    With ``options.stop_after`` the crawl ends at so many accepted pages, taken level by level in order of (priority, ord, url):
    what comes after is neither read nor expanded.
    """
    done, left = [], options.stop_after
    for level, read in crawl_levels(pages, seeds, options, gate, read_last=True):
        funnel = apply_gates(read.drop("dst"), gate)
        if options.stop_after:
            accepted = funnel.filter("outcome = 'success'").join(level.select("url", "priority", "ord"), "url")
            accepted = stop_after(table_of(accepted, "accepted"), left, "priority", "ord", "url", "page_id")
            left -= accepted.count()
            funnel = accepted.select(funnel.columns)
        done.append(funnel)
        if options.stop_after and left <= 0:
            break
    return training_rows(reduce(DataFrame.unionByName, done), render)
