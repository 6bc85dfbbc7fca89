"""Agglomerative merging of a subject's series: a tree of nodes, one subject in each Spark task group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def merged_tree(panel: DataFrame, value: str = "state") -> DataFrame:
    """Merge the two series whose sum has the greatest sum of squares, put the sum in their place, and go on.

    Rows subject, parent, left, right, height: leaves are nodes, parents are
    numbered on from the largest; height is the sum of squares at the merge.
    Ties go to the pair of smallest numbers.  Products come from the blocked sums
    of :func:`pair_sums`, so that a group holds a square of nodes, not a series:
    the products of a sum with others are sums of products.
    """
    from .moments import pair_sums

    sums = pair_sums(panel, value, ("subject",), diagonal=True).select("subject", "i", "j", "sxy")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(own["i"]) | set(own["j"]))
        at = {n: k for k, n in enumerate(names)}
        total = 2 * len(names) - 1
        dot, label = np.zeros((total, total)), [*names, *range(names[-1] + 1, names[-1] + len(names))]
        for i, j, x in zip(own["i"], own["j"], own["sxy"], strict=True):
            dot[at[i], at[j]] = dot[at[j], at[i]] = x
        alive, rows = list(range(len(names))), []
        for new in range(len(names), total):
            d = dot[np.ix_(alive, alive)]
            square = np.diag(d)[:, None] + np.diag(d)[None, :] + 2 * d
            square[np.tril_indices(len(alive))] = -np.inf
            a, b = (alive[k] for k in np.unravel_index(int(np.argmax(square)), square.shape))
            rows.append((label[new], label[a], label[b], float(square.max())))
            alive = [k for k in alive if k not in (a, b)]
            dot[new, alive] = dot[alive, new] = dot[a, alive] + dot[b, alive]
            dot[new, new] = dot[a, a] + dot[b, b] + 2 * dot[a, b]
            alive.append(new)
        return pd.DataFrame(rows, columns=["parent", "left", "right", "height"]).assign(subject=own["subject"].iloc[0])

    return sums.groupBy("subject").applyInPandas(run, "parent long, left long, right long, height double, subject string")


def leaves_of(tree: DataFrame, node: int, subject: str) -> DataFrame:
    """The leaves under a node of one subject's tree; a leaf's own is itself.

    Every number points to its parent and then, round after round, to where its
    pointer points, but not beyond ``node``: a tree of depth d takes about log2(d) rounds.
    """
    own = tree.where(F.col("subject") == subject)
    up = own.select(F.explode(F.array("left", "right")).alias("node"), F.col("parent").alias("to"))
    leaves = up.select("node").join(own.select(F.col("parent").alias("node")), "node", "left_anti")
    top = own.select(F.col("parent").alias("node")).join(up.select("node"), "node", "left_anti")
    here = F.lit(int(node)).cast("long")
    points = written(up.unionByName(top.withColumn("to", F.col("node"))).withColumn("to", F.when(F.col("node") == here, here).otherwise(F.col("to"))))
    while True:
        then = points.select(F.col("node").alias("to"), F.col("to").alias("then"))
        new = written(points.join(then, "to").select("node", "to", "then"))
        if not new.where("then != to").limit(1).count():
            break
        points = new.select("node", F.col("then").alias("to"))
    return leaves.join(points.where(F.col("to") == here), "node", "left_semi")
