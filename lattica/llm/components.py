"""Connected components of an edge table, by min-label spreading with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """Give each node of ``edges(a, b)`` the least node reachable: rows (node, root).

    Every round takes the least root among a node and its neighbours and then
    that root's own root.  Stars end after two rounds, a path after about the
    logarithm of its length.  Nothing but one count goes to the driver.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy(F.col("a").alias("n1")).agg(F.min("root").alias("m"))
        step = cut(roots.join(cut(near), F.col("node") == F.col("n1")).select("node", F.col("root").alias("old"), F.least("root", "m").alias("new")))
        up = step.select(F.col("node").alias("n2"), F.col("new").alias("above"))
        new = cut(step.join(up, F.col("new") == F.col("n2")).select("node", "old", F.col("above").alias("root")))
        changed = new.where(F.col("old") != F.col("root")).limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots
