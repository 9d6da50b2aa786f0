"""Connected components of a table of links, without a driver-side structure."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import stored

#: Alternating star contraction halves distances; so many rounds are never needed by links of 64-bit ids.
ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``links`` (``u, v`` bigint): the smallest id reachable. Self links and repeats do no harm.

    Each round links all larger neighbours of a node to the smallest one, then all smaller ones. Minima are taken
    with map-side merging and stored; the join that follows has one row per node on that side, so that adaptive execution
    can split a node with very many links. Every round is written to the shared folder.
    """
    edges = stored(_larger_first(links.select("u", "v")), "links")
    before = None
    for _ in range(ROUNDS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _larger_first(large)
        smallest = stored(large.groupBy("u").agg(F.min("v").alias("m")), "smallest")
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(_larger_first(small.unionAll(smallest.select("u", F.col("m").alias("v")))), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 30))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not done after {ROUNDS} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionAll(roots)


def _larger_first(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
