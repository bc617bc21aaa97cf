"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.durable import Workspace


def _signature(links: DataFrame) -> tuple[int, int]:
    got = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return got["n"], int(got["h"] or 0)


def connected_components(links: DataFrame, space: Workspace) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps: each hangs a node's neighbours
    below the smallest of them, so the paths shrink to stars in a number of
    rounds about logarithmic in their length. Minima are combined before the
    shuffle, and each round is a written table; the driver sees two numbers of it.
    Edges of a hub lie in one partition of a join that nothing but a combining
    aggregate follows, so that the adaptive skew join splits it.
    """
    links = space.settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while (now := _signature(links)) != before:
        before = now
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("low"))
        large = both.join(low, both["a"] == low["node"]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        small = large.join(low, large["a"] == low["node"])
        hung = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()
        done, links = links, space.settle(hung, "stars")
        space.drop(done)
    # every node now hangs below its component's smallest node
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
