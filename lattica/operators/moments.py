"""Moments of states and values over time: means, products, covariance, correlation.

Pairs are not made by a self-join.  Sums over steps are products of blocks of
steps (see :mod:`lattica.operators.blocked`).  Where each step's pairs are asked
for themselves, :func:`node_pairs` gathers the nodes of one step in a row (as
many as the panel has nodes) and expands the pairs i < j from there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocked import observable_sums, pair_sums

#: Observables are numbered i * STRIDE + j.
STRIDE = 1 << 32


def node_pairs(panel: DataFrame, value: str, keys: Sequence[str] = ("subject",), step: str = "step", diagonal: bool = False) -> DataFrame:
    """Rows (keys, step, i, j, x, y) of the pairs i < j (or i <= j) of nodes in each step."""
    own = panel.groupBy(*keys, step).agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("n"), F.col(value).alias("v")))).alias("_s"))
    first = 1 if diagonal else 2

    def with_later(a: Column, at: Column) -> Column:
        later = F.slice("_s", at + first, F.size("_s") - at - (first - 1))
        return F.transform(later, lambda b: F.struct(a["n"].alias("i"), b["n"].alias("j"), a["v"].alias("x"), b["v"].alias("y")))

    return own.select(*keys, step, F.explode(F.flatten(F.transform("_s", with_later))).alias("_p")).select(*keys, step, "_p.*")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def state_mean(panel: DataFrame, keys: Sequence[str] = ("subject",), value: str = "state") -> DataFrame:
    return panel.groupBy(*keys, "node").agg(ratio(F.sum(value), F.count(value)).alias("mean"))


def product_mean(panel: DataFrame, keys: Sequence[str] = ("subject",), value: str = "state") -> DataFrame:
    """Mean of x * y over the steps, for each pair i < j."""
    return pair_sums(panel, value, keys).select(*keys, "i", "j", ratio(F.col("sxy"), F.col("n")).alias("product"))


def pair_moments(panel: DataFrame, value: str = "state", keys: Sequence[str] = ("subject",)) -> DataFrame:
    """n, mean_i, mean_j, product, cov (1/n) and the two standard deviations (1/n) of each pair."""
    sums = pair_sums(panel, value, keys).withColumnsRenamed({"sx": "_x", "sy": "_y", "sxy": "_xy", "sxx": "_xx", "syy": "_yy"}).withColumn("n", F.col("n").cast("long"))
    mean = lambda c: ratio(F.col(c), F.col("n"))
    # over whole numbers n * sum(xy) - sum(x) * sum(y) is exact
    cross = lambda a, b, ab: F.col("n") * F.col(ab) - F.col(a) * F.col(b)
    square = F.col("n") * F.col("n")
    return sums.select(
        *keys, "i", "j", "n", mean("_x").alias("mean_i"), mean("_y").alias("mean_j"), mean("_xy").alias("product"),
        ratio(cross("_x", "_y", "_xy"), square).alias("cov"),
        F.sqrt(F.greatest(ratio(cross("_x", "_x", "_xx"), square), F.lit(0.0))).alias("sd_i"),
        F.sqrt(F.greatest(ratio(cross("_y", "_y", "_yy"), square), F.lit(0.0))).alias("sd_j"),
    )


def functional_connectivity(panel: DataFrame, value: str = "state", keys: Sequence[str] = ("subject",), epsilon: float = 0.0) -> DataFrame:
    """``fc``: (cov + epsilon) / (sd_i * sd_j + epsilon), Pearson's correlation without epsilon; null for constant series."""
    m = pair_moments(panel, value, keys)
    return m.select(*keys, "i", "j", ((F.col("cov") + epsilon) / F.nullif(F.col("sd_i") * F.col("sd_j") + epsilon, F.lit(0.0))).alias("fc"))


def correlation(x: Column, y: Column, compat: bool = False, epsilon: float = 0.0) -> Column:
    """Aggregate: Pearson's correlation from moments, null for constant columns.

    ``compat`` divides the 1/n covariance by the product of the 1/(n-1)
    standard deviations, with ``epsilon`` above and below.
    """
    x, y = x.cast("double"), y.cast("double")
    if compat:
        return (F.avg(x * y) - F.avg(x) * F.avg(y) + epsilon) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y) + epsilon, F.lit(0.0))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def rmse(x: Column, y: Column) -> Column:
    return F.sqrt(F.avg(F.pow(x.cast("double") - y.cast("double"), 2)))


def r_squared(target: Column, prediction: Column) -> Column:
    """1 - mean squared error / variance (n - 1) of the target; null for constant targets."""
    error = F.avg(F.pow(target.cast("double") - prediction.cast("double"), 2))
    return 1 - error / F.nullif(F.var_samp(target.cast("double")), F.lit(0.0))


def similarity(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """corr, compat_corr, rmse and r2 (x the target) of two columns by key."""
    a, b = F.col(x), F.col(y)
    return rows.groupBy(*keys).agg(correlation(a, b).alias("corr"), correlation(a, b, True, 1e-9).alias("compat_corr"), rmse(a, b).alias("rmse"), r_squared(a, b).alias("r2"))


def binary_connectivity(panel: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """FC of states with the shortcut sd = sqrt(1 - mean^2)."""
    m = pair_moments(panel, "state", keys)
    sd = lambda c: F.sqrt(F.greatest(1 - F.col(c) * F.col(c), F.lit(0.0)))
    return m.select(*keys, "i", "j", (F.col("cov") / F.nullif(sd("mean_i") * sd("mean_j"), F.lit(0.0))).alias("fc"))


def observables(panel: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Every state and every product of two states, as rows (keys, step, node, state).

    ``node`` is i * STRIDE + j for a product and i * STRIDE + i for a single state.
    """
    both = node_pairs(panel, "state", keys, diagonal=True)
    value = F.when(F.col("i") == F.col("j"), F.col("x")).otherwise(F.col("x") * F.col("y"))
    return both.select(*keys, "step", (F.col("i") * F.lit(STRIDE) + F.col("j")).alias("node"), value.alias("state"))


def fisher_information(panel: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Covariance (1/n) of all observables, a <= b.  Its size is that of the nodes to the fourth power; it is made in tiles."""
    sums = observable_sums(panel, keys, lambda i, j: i * STRIDE + j)
    cov = ratio(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("n"))
    return sums.select(*keys, F.col("i").alias("a"), F.col("j").alias("b"), cov.alias("information"))


def fisher_diagonal(panel: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Variance (1/n) of each observable: the diagonal, at the cost of the nodes squared."""
    sums = pair_sums(panel, "state", keys, diagonal=True)
    # a product of states is a state squared on the diagonal; both have squares of 1 for states of -1 and 1
    own = F.col("i") == F.col("j")
    first = F.when(own, F.col("sx")).otherwise(F.col("sxy"))
    var = ratio(F.col("n") * F.col("n") - first * first, F.col("n") * F.col("n"))
    return sums.select(*keys, (F.col("i") * F.lit(STRIDE) + F.col("j")).alias("a"), var.alias("information"))


def degree(edges: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Sum of the weights of each node's edges, and how many are not 0; ``edges(i, j)`` holds each pair once."""
    ends = edges.select(*keys, F.explode(F.array("i", "j")).alias("node"), weight)
    return ends.groupBy(*keys, "node").agg(F.sum(weight).alias("strength"), F.count_if(F.col(weight) != 0).alias("n_edges"), F.avg(F.when(F.col(weight) != 0, 1.0).otherwise(0.0)).alias("density"))


def central_moments(panel: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """mean, variance (1/n), skewness and (non-excess) kurtosis; the last two null for constant series."""
    v = F.col(value).cast("double")
    m = panel.groupBy(*keys).agg(F.avg(v).alias("_m"))
    rows = panel.join(m, list(keys)).withColumn("_d", v - F.col("_m"))
    d = F.col("_d")
    out = rows.groupBy(*keys).agg(F.first("_m").alias("mean"), F.avg(d * d).alias("variance"), F.avg(d * d * d).alias("_3"), F.avg(d * d * d * d).alias("_4"))
    var = F.nullif(F.col("variance"), F.lit(0.0))
    return out.select(*keys, "mean", "variance", (F.col("_3") / F.pow(var, 1.5)).alias("skewness"), (F.col("_4") / (var * var)).alias("kurtosis"))


def graph_loss(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], weight: float = 0.5) -> DataFrame:
    """Mean squared error over nodes(x, y) and edges(x, y) of each key, and their weighted mean."""
    error = F.avg(F.pow(F.col("x").cast("double") - F.col("y").cast("double"), 2))
    a, b = nodes.groupBy(*keys).agg(error.alias("node_loss")), edges.groupBy(*keys).agg(error.alias("edge_loss"))
    return a.join(b, list(keys)).withColumn("loss", (1 - weight) * F.col("node_loss") + weight * F.col("edge_loss"))


def group_moments(panel: DataFrame, subject: str = "subject") -> DataFrame:
    """Mean states (i = j) and products (i < j), averaged over subjects: rows i, j, value."""
    sums = pair_sums(panel, "state", (subject,), diagonal=True)
    own = ratio(F.when(F.col("i") == F.col("j"), F.col("sx")).otherwise(F.col("sxy")), F.col("n"))
    return sums.withColumn("_v", own).groupBy("i", "j").agg(F.avg("_v").alias("value"))


def fisher_fields(panel: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """The Fisher information's block of the fields alone: rows i <= j of the states' covariance (1/n)."""
    sums = pair_sums(panel, "state", keys, diagonal=True)
    cov = ratio(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("n"))
    return sums.select(*keys, "i", "j", cov.alias("information"))


def in_sets(rows: DataFrame, category: Column, sets: Mapping[int, Sequence[str]], name: str) -> DataFrame:
    """A row for each set that a row's category stands in; ``sets`` is a short list in the plan."""
    names = None
    for k, own in sets.items():
        one = F.array(*[F.lit(x) for x in own])
        names = F.when(category == k, one) if names is None else names.when(category == k, one)
    return rows.withColumn(name, F.explode(names))


def mean_arrays(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mean of each array column, position by position."""
    out = None
    for c in columns:
        each = rows.select(F.posexplode(c).alias("_i", "_x")).groupBy("_i").agg(F.avg("_x").alias("_x"))
        one = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda x: x["_x"]).alias(c)).withColumn("_g", F.lit(0))
        out = one if out is None else out.join(one, "_g")
    return out.drop("_g")
