"""Tables derived from the given ones.

The expressions are plain SQL that Spark and the check engine both run unchanged, so that the
queries and their checks start from the same rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.operators.ranking import with_global_rank
from loomsift.sources.tables import read_table

NL = "chr(10)"

_ELEMENTS = ["blog", "meal", "tag", "browse", "login", "privacy", "static/css", "docs/api", "category", "page"]


def _by_remainder(column: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {value}" for i, value in enumerate(values))
    return f"CASE {column} % {len(values)} {arms} END"


DOC_URL = (
    "concat('https://', source, '.example.org/', "
    + _by_remainder("doc_id", [f"'{e}'" for e in _ELEMENTS])
    + ", '/', cast(doc_id AS string))"
)

# one block per group of score branches
_BLOCKS = [
    "'How to learn this: a short guide. First the basics of it, second an example, finally the conclusion. '",
    "'The definition and meaning: it refers to the origin, consists of details and gives an overview of the history. '",
    "'The algorithm is a method whose function takes a parameter; usage, syntax and output format follow. '",
    "'A review and comparison: each advantage, each drawback, the pros and cons, such as cost. '",
    "'Home | About us | Contact | Privacy policy | Sitemap | Search | Menu | Follow us | Share '",
    "'Buy now! Add to cart, checkout, price US$99, free shipping, sponsored, all rights reserved, copyright. '",
    "'Click here to read more. Loading, please wait. Error 404. Accept cookies. '",
    "'Lorem ipsum placeholder, coming soon. A test of example.com with terms of use and data protection. '",
    f"concat('Items:', {NL}, '- mix 2 cups of flour', {NL}, '- 3 tbsp sugar', {NL}, '- 1 pinch of salt', {NL})",
    f"concat('Plan', {NL}, '1. Heat the pan', {NL}, '2) Stir it', {NL}, '3. Serve after 5 minutes', {NL})",
    f"concat('Use `code` here', {NL}, '> a quoted line', {NL}, '# Heading one', {NL})",
    f"concat('First part.', {NL}, {NL}, 'Second part.', {NL}, {NL}, 'Third part: done.', {NL}, {NL})",
]
_NOTES = [
    "concat('How to keep note ', cast(doc_id AS string), ' of ', source, ': first boil it, then serve it. Tip: wait 5 minutes, finally stir in the rest of the milk and salt.')",
    "concat('Entry ', cast(doc_id AS string), ' of ', source, ' holds a plain remark in ', lang, ' that is neither long nor of much use to anybody who reads it today.')",
]
RICH_TEXT = (
    f"CASE WHEN doc_id % 20 = 7 THEN concat({_NOTES[0]}, {NL}, text) WHEN doc_id % 20 = 13 THEN concat({_NOTES[1]}, {NL}, text) "
    f"ELSE concat({_by_remainder('doc_id', _BLOCKS)}, text) END"
)

_PAGE_BLOCKS = [
    "concat('<h2>Ingredients</h2><ul><li>2 cups flour</li><li class=\"x\">150 g butter</li></ul><p>Mix the dough</p>')",
    f"concat('<ol><li>1. Heat the oven</li>{chr(10)}<li>2) Bake it for 20 minutes</li></ol><p>10 medium eggs<br/>Serve</p>')",
    "'<p>Fish &amp; chips &lt;b&gt; &quot;hot&quot; &#39;fresh&#39; &mdash; done &ndash; ok&nbsp;now &amp;lt; &copy;</p>'",
    "'<p>Privacy Policy | Share this | Skip to main content | Browse all Meals/Countries. Click here to go on. Copyright 2024</p>'",
    "'<pre>def f(a): return a</pre><p>Some <code>inline</code> text</p>'",
    "'<form action=\"/s\"><input type=\"text\"><select><option>a</option></select><button>Go</button></form><aside>ad</aside>'",
]
RICH_HTML = f"replace(html, '<article>', concat('<article>', {_by_remainder('page_id', _PAGE_BLOCKS)}))"

# a link to a host that is one of the common subdomains of the page's site
HOST_LINK = (
    "concat('<a href=\"https://', " + _by_remainder("page_id", ["'docs.example.com'", "'blog.example.net'", "'www.example.org'"])
    + ", '/start/', cast(page_id % 10 AS string), '\">docs</a>')"
)

CODE_CONTENT = (
    f"concat('def f', cast(doc_id AS string), '(a):', {NL}, 'class C', cast(doc_id AS string), ':', {NL}, "
    f"'# note', {NL}, 'int g(int a) {{ // x', {NL}, text)"
)
CODE_PATH = (
    "concat('src/', " + _by_remainder("doc_id", ["'lib/'", "'build/'", "'web/'", "'docs/'"]) + ", source, '/', "
    "cast(doc_id AS string), " + _by_remainder("doc_id", ["'.py'", "'.PY'", "'.txt'", "'.js'", "'.bak'"]) + ")"
)
BLOB = (
    "concat(text, ' 10.', cast(doc_id % 250 AS string), '.7.1', ' : ', cast(8000 + doc_id % 1000 AS string), ' end')"
)
JSON_BLOB = (
    "concat('{\"data\":[{\"ip\":\"10.9.', cast(doc_id % 256 AS string), '.2\",\"port\":\"', "
    "cast(3000 + doc_id % 50 AS string), '\"},{\"ip\":\"10.0.0.1\"}]}')"
)
ENDPOINT_TEXT = _by_remainder("doc_id", [
    f"concat('host', cast(doc_id AS string), '.example.org:8080', {NL}, {NL}, '10.1.', cast(doc_id % 250 AS string), '.9:3128  ', {NL}, 'user:key@10.2.3.4:80', {NL})",
    f"""concat('{{', {NL}, '  "data": [', {NL}, '    {{', {NL}, '      "ip": "10.3.', cast(doc_id % 250 AS string), '.1",', {NL}, '      "country": "x",', {NL},
        '      "port": ', cast(9000 + doc_id % 90 AS string), {NL}, '    }}, {{"port": "81",', {NL}, '"ip": "10.4.0.', cast(doc_id % 250 AS string), '"}}', {NL},
        '    , {{"ip": "10.9.9.9"}}, {{"port": "1"}}', {NL}, '  ]', {NL}, '}}', {NL})""",
    f"concat(text, {NL}, 'see 10.5.', cast(doc_id % 250 AS string), '.2 - 4000: ok', {NL})",
])
SEED_LINE = "concat('  ', " + _by_remainder("page_id", ["url", "concat('see ', url)", "concat(url, '#x')"]) + ", ' ')"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages")


def docs_rich(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.expr(DOC_URL).alias("url"), F.expr(RICH_TEXT).alias("text"))


def all_urls(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("url").unionAll(documents(spark, sf).select(F.expr(DOC_URL).alias("url")))


def rich_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).withColumn("html", F.expr(RICH_HTML))


def linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with absolute links to the next three pages by id, the last ones to the first, and to a subdomain."""
    base = pages(spark, sf)
    placed, n = with_global_rank(base.select("page_id", "url"), F.asc("page_id"))
    placed = placed.withColumn("place", F.col("rank") - 1)
    steps = placed.select("place", "url", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    targets = steps.select(F.pmod(F.col("place") - F.col("k") + n, F.lit(n)).alias("place"), "k", "url")
    urls = targets.groupBy("place").agg(*[F.max(F.when(F.col("k") == k, F.col("url"))).alias(f"u{k}") for k in (1, 2, 3)])
    anchors = [F.concat(F.lit('<a href="'), F.col(f"u{k}"), F.lit('">next</a>')) for k in (1, 2, 3)]
    own = placed.select("page_id", "place").join(urls, "place")
    return base.join(own, "page_id").select("page_id", "url", F.concat(*anchors, F.expr(HOST_LINK), F.col("html")).alias("html"))


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Pages on blog hosts: where a crawl starts."""
    return pages(spark, sf).filter("url LIKE '%://blog.%'").select("url")


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.expr(CODE_PATH).alias("rel_path"), F.expr(CODE_CONTENT).alias("content"))


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    return as_requests(read_table(spark, sf, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    """Every event is a request of its user; errors are failures."""
    return events.select(
        F.col("user_id").alias("key"),
        "ts",
        F.col("event_id").alias("id"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("value").alias("seconds"),
    )


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return docs.select(F.expr(BLOB).alias("text")).unionAll(docs.select(F.expr(JSON_BLOB).alias("text")))


def endpoint_texts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.expr("concat('set/f', cast(doc_id AS string), '.txt')").alias("rel_path"), F.expr(ENDPOINT_TEXT).alias("text"))


TABLES = {
    "docs_rich": f"SELECT doc_id, {DOC_URL} AS url, {RICH_TEXT} AS text FROM documents",
    "all_urls": f"SELECT url FROM pages UNION ALL SELECT {DOC_URL} FROM documents",
    "rich_pages": f"SELECT page_id, url, {RICH_HTML} AS html FROM pages",
    "linked_pages": f"""SELECT p.page_id, p.url, concat('<a href="', a.url, '">next</a><a href="', b.url,
        '">next</a><a href="', c.url, '">next</a>', {HOST_LINK.replace("page_id", "p.page_id")}, p.html) AS html
        FROM (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS place, count(*) OVER () AS n FROM pages) p
        JOIN (SELECT url, row_number() OVER (ORDER BY page_id) - 1 AS place FROM pages) a ON a.place = (p.place + 1) % n
        JOIN (SELECT url, row_number() OVER (ORDER BY page_id) - 1 AS place FROM pages) b ON b.place = (p.place + 2) % n
        JOIN (SELECT url, row_number() OVER (ORDER BY page_id) - 1 AS place FROM pages) c ON c.place = (p.place + 3) % n""",
    "seeds": "SELECT url FROM pages WHERE url LIKE '%://blog.%'",
    "code_files": f"SELECT doc_id, {CODE_PATH} AS rel_path, {CODE_CONTENT} AS content FROM documents",
    "request_log": "SELECT user_id AS key, ts, event_id AS id, event_type <> 'error' AS ok, value AS seconds FROM events",
    "endpoint_texts": f"SELECT doc_id, {ENDPOINT_TEXT} AS text FROM documents",
    "blobs": f"SELECT {BLOB} AS text FROM documents UNION ALL SELECT {JSON_BLOB} FROM documents",
}

CONTENT_TYPE = _by_remainder("doc_id", ["'Recipe'", "'News'", "'FAQ'", "'Generic'", "'Code File'", "'Tutorial'"])
