"""Column expressions on URLs: parts, canonical form, domains and scores."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsift.functions import vocab
from loomsift.functions.dialect import contains_any, occurrences

# scheme, authority and path; what follows ("?" or "#") is left out
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def _tidy(url: Column) -> Column:
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(_tidy(url), _SPLIT, group)


def _broken_host(netloc: Column) -> Column:
    return netloc.contains("[") != netloc.contains("]")


def canonical(url: Column) -> Column:
    """Scheme, authority and path; no parameters, query, fragment or trailing slashes."""
    scheme, netloc, path = F.lower(_part(url, 1)), _part(url, 2), _part(url, 3)
    path = F.when(scheme.isin(vocab.PARAM_SCHEMES), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    joined = F.regexp_replace(F.concat(scheme, F.lit("://"), netloc, path), "/+$", "")
    return F.when(_broken_host(netloc), url).otherwise(joined)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def domain(url: Column) -> Column:
    """Lower-cased authority, with port and user information."""
    host = netloc(url)
    return F.when(_broken_host(host), "").otherwise(F.lower(host))


def last_two_labels(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def root_domain(url: Column) -> Column:
    """Last two labels of the host, without the port."""
    return last_two_labels(F.substring_index(domain(url), ":", 1))


def site_key(url: Column) -> Column:
    """Last two labels of the authority as it is. Two URLs are of one site when this is equal."""
    return last_two_labels(domain(url))


def priority(url: Column, depth: Column, prefer_content: bool = True) -> Column:
    """Crawl priority; lower comes first."""
    base = depth * vocab.PRIORITY_PER_DEPTH
    if not prefer_content:
        return base.cast("int")
    lowered = F.lower(url)
    steps = [F.when(contains_any(lowered, words), change).otherwise(0) for words, change in vocab.PRIORITY_RULES]
    steps.append(F.when(url.contains("?"), vocab.PRIORITY_QUERY).otherwise(0))
    deep = occurrences(url, "/") > vocab.PRIORITY_MAX_SLASHES
    steps.append(F.when(deep, vocab.PRIORITY_DEEP_PATH).otherwise(0))
    return reduce(lambda a, b: a + b, steps, base).cast("int")


def quality(url: Column) -> Column:
    """URL quality score, 0..100."""
    lowered = F.lower(url)
    score = (
        F.lit(50)
        + F.when(contains_any(lowered, vocab.URL_GOOD), 30).otherwise(0)
        - F.when(contains_any(lowered, vocab.URL_BAD), 25).otherwise(0)
        - F.when((F.length(url) > 150) | (occurrences(url, "?") > 1), 15).otherwise(0)
        - F.when(occurrences(url, "/") > 8, 10).otherwise(0)
    )
    return F.when(contains_any(lowered, vocab.URL_FAIL), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))


def gate_reason(url: Column) -> Column:
    """``browse`` or ``non_content`` for URLs that are not worth reading, else NULL."""
    lowered = F.lower(url)
    return F.when(contains_any(lowered, vocab.BROWSE_URLS), "browse").when(
        contains_any(lowered, vocab.NON_CONTENT_URLS), "non_content"
    )


def _without_dot_segments(path: Column) -> Column:
    segments = F.split(path, "/", -1)
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    ends_open = F.element_at(segments, -1).isin(".", "..")
    joined = F.array_join(F.when(ends_open, F.concat(resolved, F.array(F.lit("")))).otherwise(resolved), "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve_rooted(base_scheme: Column, base_netloc: Column, link: Column) -> Column:
    """Absolute form of a link that starts with ``/`` (or ``//host``) on a page of the given base.

    Most links hold nothing to be resolved, which substring tests tell without a pattern.
    """
    special = reduce(lambda a, b: a | b, [link.contains(c) for c in ("#", "?", "/.", "\t", "\r", "\n")], link.startswith("//"))
    plain = F.concat(base_scheme, F.lit("://"), base_netloc, link)
    return F.when(special, _resolve(base_scheme, base_netloc, link)).otherwise(plain)


def _resolve(base_scheme: Column, base_netloc: Column, link: Column) -> Column:
    link = F.regexp_replace(F.regexp_replace(link, r"[\t\r\n]", ""), r"#$", "")
    link = F.regexp_replace(link, r"^([^?#]*)\?(#|$)", "$1$2")
    path = F.regexp_extract(link, r"^[^?#]*", 0)
    rest = F.substr(link, F.length(path) + 1)
    clean = F.when(path.rlike(r"/\.\.?(/|$)"), _without_dot_segments(path)).otherwise(path)
    return F.when(link.startswith("//"), F.concat(base_scheme, F.lit(":"), link)).otherwise(
        F.concat(base_scheme, F.lit("://"), base_netloc, clean, rest)
    )
