"""Pairwise binary models: energies, exact enumeration, pseudolikelihood and moment estimates.

A model is two long tables, ``fields(model, node, h)`` and ``couplings(model,
i, j, w)`` with i < j.  A state's negative energy is sum h s + sum w s s.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .moments import node_pairs, ratio


def negative_energy(panel: DataFrame, fields: DataFrame, couplings: DataFrame) -> DataFrame:
    """``neg_energy`` of each step of each subject under the model of the same name (larger is likelier)."""
    single = panel.join(fields.withColumnRenamed("model", "subject"), ["subject", "node"]).groupBy("subject", "step").agg(F.sum(F.col("h") * F.col("state")).alias("_h"))
    pairs = node_pairs(panel, "state").join(couplings.withColumnRenamed("model", "subject"), ["subject", "i", "j"])
    double = pairs.groupBy("subject", "step").agg(F.sum(F.col("w") * F.col("x") * F.col("y")).alias("_w"))
    return single.join(double, ["subject", "step"]).select("subject", "step", (F.col("_h") + F.col("_w")).alias("neg_energy"))


def both_ways(couplings: DataFrame) -> DataFrame:
    """Rows (model, node, other, w): each coupling seen from both its nodes."""
    return couplings.select("model", F.col("i").alias("node"), F.col("j").alias("other"), "w").unionByName(couplings.select("model", F.col("j").alias("node"), F.col("i").alias("other"), "w"))


def local_fields(panel: DataFrame, fields: DataFrame, couplings: DataFrame) -> DataFrame:
    """``local``: h + sum of w times the other nodes' states, for each node and step."""
    others = panel.select("subject", "step", F.col("node").alias("other"), F.col("state").alias("_s"))
    pulls = both_ways(couplings).withColumnRenamed("model", "subject").join(others, ["subject", "other"])
    summed = pulls.groupBy("subject", "step", "node").agg(F.sum(F.col("w") * F.col("_s")).alias("_p"))
    rows = panel.join(fields.withColumnRenamed("model", "subject"), ["subject", "node"]).join(summed, ["subject", "step", "node"])
    return rows.withColumn("local", F.col("h") + F.col("_p")).drop("h", "_p")


def flip_change(panel: DataFrame, fields: DataFrame, couplings: DataFrame) -> DataFrame:
    """Change of the negative energy on flipping each node: -2 s * local."""
    return local_fields(panel, fields, couplings).select("subject", "step", "node", (-2 * F.col("state") * F.col("local")).alias("change"))


def second_change(panel: DataFrame, couplings: DataFrame) -> DataFrame:
    """How flipping j changes the change on flipping i: 4 w s_i s_j."""
    pairs = node_pairs(panel, "state").join(couplings.withColumnRenamed("model", "subject"), ["subject", "i", "j"])
    return pairs.select("subject", "step", "i", "j", (4 * F.col("w") * F.col("x") * F.col("y")).alias("change"))


def pseudolikelihood_step(panel: DataFrame, fields: DataFrame, couplings: DataFrame, rate: float) -> tuple[DataFrame, DataFrame]:
    """One gradient step of the pseudolikelihood: new fields and couplings.

    The gradient of h is the mean of s - tanh(local), that of w the mean of
    both nodes' (s - tanh(local)) times the other's state.
    """
    rows = local_fields(panel, fields, couplings).withColumn("_e", F.col("state") - F.tanh("local"))
    h = rows.groupBy(F.col("subject").alias("model"), "node").agg(F.avg("_e").alias("_g"))
    new_h = fields.join(h, ["model", "node"]).select("model", "node", (F.col("h") + rate * F.col("_g")).alias("h"))
    both = node_pairs(rows.withColumn("_v", F.struct(F.col("state").alias("s"), F.col("_e").alias("e"))), "_v")
    cross = F.col("x.e") * F.col("y.s") + F.col("y.e") * F.col("x.s")
    w = both.groupBy(F.col("subject").alias("model"), "i", "j").agg(F.avg(cross).alias("_g"))
    return new_h, couplings.join(w, ["model", "i", "j"]).select("model", "i", "j", (F.col("w") + rate * F.col("_g")).alias("w"))


def enumerate_states(fields: DataFrame, couplings: DataFrame, n_nodes: int, beta: float = 1.0) -> DataFrame:
    """Exact probability of each of the 2 ** n_nodes states of every model (few nodes): rows model, code, p.

    Bit k of ``code`` is 1 where node k is up.
    """
    if n_nodes > 20:
        raise ValueError("exact enumeration is for 20 nodes at most")
    codes = fields.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2**n_nodes - 1).cast("long"))).alias("code"))
    up = lambda node: F.when(F.expr(f"shiftright(code, cast({node} as int)) & 1") == 1, 1).otherwise(-1)
    single = codes.join(fields, "model").groupBy("model", "code").agg(F.sum(F.col("h") * up("node")).alias("_h"))
    double = codes.join(couplings, "model").groupBy("model", "code").agg(F.sum(F.col("w") * up("i") * up("j")).alias("_w"))
    rows = single.join(double, ["model", "code"], "left").withColumn("_e", beta * (F.col("_h") + F.coalesce("_w", F.lit(0.0))))
    top = rows.groupBy("model").agg(F.max("_e").alias("_top"))
    rows = rows.join(top, "model").withColumn("_x", F.exp(F.col("_e") - F.col("_top")))
    total = rows.groupBy("model").agg(F.sum("_x").alias("_z"))
    return rows.join(total, "model").select("model", "code", (F.col("_x") / F.col("_z")).alias("p"))


def expected(probabilities: DataFrame, n_nodes: int) -> DataFrame:
    """Expected state of each node and product of each pair (i = j: the node itself): rows model, i, j, value."""
    nodes = F.sequence(F.lit(0), F.lit(n_nodes - 1))
    state = lambda c: F.expr(f"CASE WHEN shiftright(code, {c}) & 1 = 1 THEN 1 ELSE -1 END")
    rows = probabilities.select("*", F.explode(nodes).alias("i")).select("*", F.explode(F.sequence("i", F.lit(n_nodes - 1))).alias("j"))
    value = F.when(F.col("i") == F.col("j"), state("i")).otherwise(state("i") * state("j"))
    return rows.groupBy("model", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.sum(F.col("p") * value).alias("value"))


def independent_model(means: DataFrame) -> DataFrame:
    """Field of each node alone from its mean state: atanh(mean); null where the mean is -1 or 1."""
    inside = F.abs("mean") < 1
    return means.select(F.col("subject").alias("model"), "node", F.when(inside, F.log((1 + F.col("mean")) / F.nullif(1 - F.col("mean"), F.lit(0.0))) / 2).alias("h"))


def from_state_counts(counts: DataFrame) -> DataFrame:
    """Log-count estimate of each node's field: half the difference of the mean log counts of the states with the node up and down.

    ``counts`` are rows (subject, key, n) as of unique states.
    """
    rows = counts.select("subject", F.log(F.col("n").cast("double")).alias("_l"), F.posexplode(F.split("key", "")).alias("node", "_c"))
    up, down = F.avg(F.when(F.col("_c") == "+", F.col("_l"))), F.avg(F.when(F.col("_c") == "-", F.col("_l")))
    return rows.where("_c <> ''").groupBy("subject", F.col("node").cast("long").alias("node")).agg(((up - down) / 2).alias("h"))


def moment_error(model_pairs: DataFrame, target_pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean square error of simulated against target values over pairs, by key."""
    both = model_pairs.join(target_pairs, [k for k in target_pairs.columns if k != "target"])
    return both.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("target"), 2))).alias("rmse"))


def most_probable(probabilities: DataFrame, k: int = 2) -> DataFrame:
    place = F.row_number().over(W.partitionBy("model").orderBy(F.desc(F.round("p", 12)), "code"))
    return probabilities.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)


def mean_fields(means: DataFrame) -> DataFrame:
    return means.select(F.col("subject").alias("model"), "node", F.col("mean").alias("h"))


def mean_couplings(products: DataFrame) -> DataFrame:
    return products.select(F.col("subject").alias("model"), "i", "j", F.col("product").alias("w"))


def shares(counts: DataFrame) -> DataFrame:
    """``p``: each state's share of its subject's steps."""
    whole = counts.groupBy("subject").agg(F.sum("n").alias("_t"))
    return counts.join(whole, "subject").withColumn("p", ratio(F.col("n"), F.col("_t"))).drop("_t")
