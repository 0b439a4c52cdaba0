"""Connected components of a link table, wholly as DataFrame operations.

Alternating large-star and small-star rounds: each replaces links by links to a neighbourhood's smallest
id until every link points at its component's smallest id. A neighbourhood is only ever aggregated
(min, combined before the shuffle) and joined back, never gathered; the links of a hub are joined where they
are, see common.spread_join(). Every round is stored in the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import discard, spread_join, stored


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, component) of every id in links (a long, b long); component is the smallest id reachable."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-links")
    seen, total = None, now.count()
    while True:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        near = both(now)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = spread_join(near.where("b > a"), least, ["a"], 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, f"{name}-large")
        # small star: neighbours below a node, and the node, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, ["a"], total)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = stored(small, f"{name}-small")
        discard(large)
        # the links are stars with the smallest ids at their centres once no round changes them
        state = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = small
        if state == seen or not state[0]:
            break
        seen, total = state, state[0]
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stored(ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), f"{name}-components")
