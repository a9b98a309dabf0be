"""Connected components of an edge table, by alternating star contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b: larger neighbours go to the smallest one of b and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).select(F.col("a").alias("b"), "m")
    return edges.join(low, "b").select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b: smaller neighbours of a, and a, go to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.explode(F.array("a", "b")).alias("a")
    return edges.join(low, "a").select(ends, F.col("m").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Each round joins stars of neighbours to their smallest member, so paths shorten geometrically. Rounds are written
    to the shared folder, each in place of the one before; the end is reached when a round changes neither the number of edges nor their hash sum.
    Edges with a null end are left out, loops count as nodes of their own."""
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    now = stored(given.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        large = stored(_large_star(now))
        discard(now)
        now = stored(_small_star(large))
        discard(large)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
