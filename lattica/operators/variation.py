"""How estimates vary: over scans, over every start of a window, with edited parameters, under a fitted law."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .moments import functional_connectivity, ratio
from .sampling import _rng
from .statistics import mann_whitney


def over_scans(panel: DataFrame, scan: str = "scan", value: str = "state") -> DataFrame:
    """Variance (n - 1) and span (greatest minus least) of each pair's connectivity over a subject's scans."""
    fc = functional_connectivity(panel, value, ("subject", scan))
    return fc.groupBy("subject", "i", "j").agg(F.var_samp("fc").alias("variance"), (F.max("fc") - F.min("fc")).alias("span"))


def density(edges: DataFrame, keys: Sequence[str], weight: str, least: float = 0.0) -> DataFrame:
    """Share of the edges whose weight is further from 0 than ``least``."""
    return edges.groupBy(*keys).agg(ratio(F.count_if(F.abs(weight) > least), F.count("*")).alias("density"))


def with_gaps(results: DataFrame, keys: Sequence[str], index: str, first: int, last: int) -> DataFrame:
    """Every number of the range for every key, with its results, and ``missing`` where there are none."""
    numbers = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))
    every = results.select(*keys).distinct().withColumn(index, F.explode(numbers))
    there = results.withColumn("_there", F.lit(True))
    return every.join(there, [*keys, index], "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def time_trend(states: DataFrame, keys: Sequence[str] = ("subject", "node")) -> DataFrame:
    """Whether active states come late: U and z of the steps of active against those of other states."""
    return mann_whitney(states.withColumn("_g", F.when(F.col("state") == 1, 1).otherwise(0)), keys, "step", "_g")


def wrapped_windows(panel: DataFrame, lengths: Sequence[int], n_steps: int, value: str = "state") -> DataFrame:
    """Distance of node means in a window from those of the whole series, for windows from every start step.

    Windows that pass the end go on at the beginning.  For each length:
    mean, sd, least and greatest root mean squared distance over the starts.
    """
    series = W.partitionBy("subject", "node")
    whole = panel.withColumn("_m", ratio(F.sum(value).over(series), F.count(value).over(series)))
    twice = whole.withColumn("step", F.explode(F.array(F.col("step"), F.col("step") + n_steps)))
    sums = [F.struct(F.lit(n).cast("long").alias("length"), F.sum(value).over(series.orderBy("step").rowsBetween(0, n - 1)).alias("sum")) for n in lengths]
    rows = twice.select("subject", "node", "step", "_m", F.array(*sums).alias("_w")).where(F.col("step") < n_steps)
    rows = rows.select("subject", "step", "_m", F.explode("_w").alias("_w")).select("subject", "step", "_m", "_w.*")
    apart = ratio(F.col("sum"), F.col("length")) - F.col("_m")
    each = rows.groupBy("subject", "length", "step").agg(F.sqrt(F.avg(apart * apart)).alias("rmse"))
    return each.groupBy("subject", "length").agg(F.avg("rmse").alias("mean"), F.stddev_samp("rmse").alias("sd"), F.min("rmse").alias("least"), F.max("rmse").alias("greatest"))


def homogenized(values: DataFrame, keys: Sequence[str], node: str, value: str, order: Sequence[Column], sizes: Sequence[int]) -> DataFrame:
    """Progressive edits: for each size, the first nodes of the order take their common mean, the others keep their value.

    A key's window holds its nodes, whatever the data's size.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    many = values.withColumn("_n", place).withColumn("edited", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])))
    inside = F.col("_n") <= F.col("edited")
    common = F.avg(F.when(inside, F.col(value))).over(W.partitionBy(*keys, "edited"))
    return many.select(*keys, "edited", node, F.when(inside, common).otherwise(F.col(value)).alias(value))


def wide(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of the keys that all tables hold, with the columns of each."""
    return reduce(lambda a, b: a.join(b, list(keys)), tables)


def _zeta(exponents: np.ndarray, first: int, terms: int = 200) -> np.ndarray:
    """Sums of k ** -exponent from ``first`` on; see :func:`lattica.operators.statistics.zeta_from`."""
    k, end = np.arange(first, first + terms, dtype=float), float(first + terms)
    return (k[:, None] ** -exponents).sum(axis=0) + end ** (1 - exponents) / (exponents - 1) + end**-exponents / 2 + exponents * end ** (-exponents - 1) / 12


def power_law_bootstrap(fits: DataFrame, keys: Sequence[str], n: str, x_min: int, largest: int, exponents: Sequence[float], n_replicas: int, seed: int = 1) -> DataFrame:
    """Goodness of fitted power laws: ``p``, the share of drawn samples that lie further from their own fit.

    ``fits(keys, n, exponent, ks)`` holds sample sizes, exponents and distances,
    as :func:`power_law_grid` finds them.  A replica draws the counts of values
    up to ``largest`` and of the tail beyond at once, so that its cost does not
    grow with ``n``; the tail's sum of logarithms is that of a continuous law.
    The exponent is fitted again in each replica.  Replicas are rows of their
    own, spread over the cluster, and seeded by key and number.
    """
    grid, values = np.asarray(exponents, float), np.arange(x_min, largest + 1, dtype=float)
    names = [*keys]

    def distance(size: int, exponent: float, rng: np.random.Generator) -> float:
        whole = _zeta(np.array([exponent]), x_min)[0]
        share = values**-exponent / whole
        drawn = rng.multinomial(size, np.append(share, max(0.0, 1 - share.sum())))
        beyond = drawn[-1]
        logs = (drawn[:-1] * np.log(values)).sum() + beyond * np.log(largest) + (rng.gamma(beyond) / (exponent - 1) if beyond else 0.0)
        totals = _zeta(grid, x_min)
        at = int(np.argmax(-size * np.log(totals) - grid * logs))
        return float(np.abs(drawn[:-1].cumsum() / size - (values ** -grid[at] / totals[at]).cumsum()).max())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = zip(part[names].itertuples(index=False), part[n], part["exponent"], part["replica"], strict=True)
            yield part.assign(drawn_ks=[distance(int(size), a, _rng(seed, *key, rep)) for key, size, a, rep in rows])

    numbers = F.sequence(F.lit(0).cast("long"), F.lit(n_replicas - 1).cast("long"))
    usable = fits.where(F.col("exponent").isNotNull() & (F.col(n) > 0))
    rows = usable.select(*keys, n, F.col("exponent").cast("double").alias("exponent"), "ks", F.explode(numbers).alias("replica")).repartition(*keys, "replica")
    drawn = rows.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", drawn_ks double")
    return drawn.groupBy(*keys).agg(F.first("exponent").alias("exponent"), F.first("ks").alias("ks"), ratio(F.count_if(F.col("drawn_ks") >= F.col("ks")), F.count("*")).alias("p"))
