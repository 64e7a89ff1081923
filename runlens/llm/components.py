"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.registry import discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each component, for every node that has a link.

    Each round takes the smallest root among the neighbours and then the root's own root, so that the
    number of rounds grows with the logarithm of long chains. A round is two joins on nodes, whose hot
    keys are folded before the shuffle, and ends in a written table.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = stored(both.union(both.select("other", "node")).where("node <> other").distinct(), "links")
    roots = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "roots")
    while True:
        near = (both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("met")), "other")
                .groupBy("node").agg(F.min("met").alias("met")))
        lower = roots.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "met").alias("root"))
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        nxt = stored(lower.join(above, "root").select("node", "was", F.least("root", "top").alias("root")), "roots")
        discard(roots)
        if nxt.where("root <> was").isEmpty():
            discard(both)
            return nxt.select("node", "root")
        roots = nxt
