"""Time-ordered operators: differences, windows, runs, transitions.

Windows are partitioned by series; their partitions hold one series, as long as
the panel has steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import array_sums
from .moments import correlation, functional_connectivity, ratio

SERIES = ("subject", "node")


def flips(panel: DataFrame, keys: Sequence[str] = SERIES, step: str = "step", value: str = "state") -> DataFrame:
    """Add ``flip``: 1 where the state differs from the one before, null at the first step."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(step))
    return panel.withColumn("flip", F.when(before.isNotNull(), F.when(F.col(value) != before, 1).otherwise(0)))


def flip_rate(panel: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return flips(panel, keys).groupBy(*keys).agg(F.sum("flip").alias("n_flips"), ratio(F.sum("flip"), F.count("flip")).alias("flip_rate"))


def flip_histogram(panel: DataFrame, n_nodes: int, subject: str = "subject") -> DataFrame:
    """How many steps flip 0 .. n_nodes nodes, zeros included."""
    per_step = flips(panel).where("flip is not null").groupBy(subject, "step").agg(F.sum("flip").alias("n_flipped"))
    counts = per_step.groupBy(subject, "n_flipped").agg(F.count("*").alias("n"))
    every = panel.select(subject).distinct().select(subject, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_nodes).cast("long"))).alias("n_flipped"))
    return every.join(counts, [subject, "n_flipped"], "left").select(subject, "n_flipped", F.coalesce("n", F.lit(0)).alias("n"))


def activations(panel: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Per step the number of nodes that go from -1 to +1 there (none at the first step)."""
    before = F.lag("state").over(W.partitionBy(*keys).orderBy("step"))
    starts = F.when((before == -1) & (F.col("state") == 1), 1).otherwise(0)
    return panel.withColumn("_a", starts).groupBy("subject", "step").agg(F.sum("_a").alias("n_active"))


def branching(counts: DataFrame, per: str = "ancestors") -> DataFrame:
    """Mean of descendants / ancestors: over the steps with ancestors, or (``all``) over all steps with a next one."""
    after = F.lead("n_active").over(W.partitionBy("subject").orderBy("step"))
    rows = counts.withColumn("_d", after).where(F.col("_d").isNotNull())
    share = ratio(F.col("_d"), F.col("n_active"))
    mean = F.avg(share) if per == "ancestors" else ratio(F.sum(F.coalesce(share, F.lit(0.0))), F.count("*"))
    return rows.groupBy("subject").agg(mean.alias("branching"))


def runs(counts: DataFrame, value: str = "n_active", censored: bool = False) -> DataFrame:
    """Runs of steps with (avalanche) and without (gap) activity: rows subject, run, active, begin, duration, size.

    Runs that touch either end of the series are left out unless ``censored``.
    """
    series = W.partitionBy("subject").orderBy("step")
    on = F.col(value) > 0
    rows = counts.withColumn("_on", on).withColumn("_new", F.when(F.lag("_on").over(series) == F.col("_on"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("_new").over(series))
    ends = W.partitionBy("subject")
    rows = rows.withColumn("_last", F.max("step").over(ends)).withColumn("_first", F.min("step").over(ends))
    out = rows.groupBy("subject", "run").agg(
        F.first("_on").alias("active"), F.min("step").alias("begin"), F.count("*").alias("duration"), F.sum(value).alias("size"),
        F.max("step").alias("_e"), F.first("_last").alias("_last"), F.first("_first").alias("_first"),
    )
    if not censored:
        out = out.where((F.col("begin") > F.col("_first")) & (F.col("_e") < F.col("_last")))
    return out.drop("_e", "_last", "_first")


def avalanches(panel: DataFrame) -> DataFrame:
    """Runs of steps with any node up: begin, duration, size (states up) and how many different nodes take part."""
    per_step = panel.groupBy("subject", "step").agg(F.count_if(F.col("state") == 1).alias("n_active"))
    found = runs(per_step).where("active").select("subject", "run", "begin", "duration", "size")
    inside = F.explode(F.sequence("begin", F.col("begin") + F.col("duration") - 1)).alias("step")
    members = found.select("subject", "run", inside).join(panel.where("state = 1").select("subject", "step", "node"), ["subject", "step"])
    nodes = members.groupBy("subject", "run").agg(F.count_distinct("node").alias("n_nodes"))
    return found.join(nodes, ["subject", "run"])


def mean_size_by_duration(found: DataFrame) -> DataFrame:
    return found.groupBy("subject", "duration").agg(F.count("*").alias("n"), ratio(F.sum("size"), F.count("*")).alias("mean_size"))


def state_keys(panel: DataFrame) -> DataFrame:
    """One row a step: the whole state as a string of + and -, nodes in order."""
    gathered = F.sort_array(F.collect_list(F.struct("node", "state")))
    return panel.groupBy("subject", "step").agg(F.array_join(F.transform(gathered, lambda x: F.when(x["state"] == 1, "+").otherwise("-")), "").alias("key"))


def unique_states(panel: DataFrame) -> DataFrame:
    return state_keys(panel).groupBy("subject", "key").agg(F.count("*").alias("n"))


def transitions(panel: DataFrame) -> DataFrame:
    """For each state and node: the sum of 1 / (nodes flipped) over the transitions out of it that flip the node."""
    after = F.lead("state").over(W.partitionBy("subject", "node").orderBy("step"))
    moves = panel.withColumn("_f", F.when(after != F.col("state"), 1).otherwise(0))
    per_step = moves.groupBy("subject", "step").agg(F.sum("_f").alias("n_flipped"))
    flipped = moves.where("_f = 1").select("subject", "step", "node").join(per_step, ["subject", "step"]).join(state_keys(panel), ["subject", "step"])
    return flipped.groupBy("subject", "key", "node").agg(F.sum(1 / F.col("n_flipped").cast("double")).alias("weight"))


def tumbling(panel: DataFrame, length: int, n_steps: int) -> DataFrame:
    """Add ``window`` of ``length`` steps; the ragged tail is left out."""
    return panel.withColumn("window", F.floor(F.col("step") / length).cast("long")).where(F.col("window") < n_steps // length)


def sliding(panel: DataFrame, length: int, every: int, n_steps: int) -> DataFrame:
    """One row for each window that a step stands in; window w covers steps w * every .. w * every + length - 1."""
    first = F.greatest(F.lit(0), F.ceil((F.col("step") - length + 1) / every)).cast("long")
    last = F.least(F.lit((n_steps - length) // every), F.floor(F.col("step") / every)).cast("long")
    return panel.where(first <= last).withColumn("window", F.explode(F.sequence(first, last)))


def window_similarity(panel: DataFrame, length: int, every: int, n_steps: int, value: str = "value") -> DataFrame:
    """Correlation between the connectivity patterns of two sliding windows (a < b) of a subject."""
    fc = functional_connectivity(sliding(panel, length, every, n_steps), value, ("subject", "window"))
    # windows are the nodes, pairs the steps, of a second panel
    same_pair = fc.select("subject", F.concat_ws("-", "i", "j").alias("step"), F.col("window").alias("node"), "fc").where("fc is not null")
    both = functional_connectivity(same_pair, "fc")
    return both.select("subject", F.col("i").alias("window_a"), F.col("j").alias("window_b"), F.col("fc").alias("similarity"))


def expanding(panel: DataFrame, every: int, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Cumulative mean and variance (1/n) up to each ``every``-th step."""
    w = W.partitionBy(*keys).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    v = F.col(value)
    rows = panel.select(*keys, "step", F.count("*").over(w).alias("n"), F.sum(v).over(w).alias("_s"), F.sum(v * v).over(w).alias("_q"))
    mean = ratio(F.col("_s"), F.col("n"))
    variance = ratio(F.col("n") * F.col("_q") - F.col("_s") * F.col("_s"), F.col("n") * F.col("n"))
    return rows.where(F.col("n") % every == 0).select(*keys, "n", mean.alias("mean"), variance.alias("variance"))


def convergence(panel: DataFrame, n_steps: int, value: str = "value") -> DataFrame:
    """Windows from every start, wrapping round: by length, the root mean square over nodes of (window mean - full mean),
    then mean, standard deviation, least and greatest over the starts.

    A series' prefix sums stand in one row.  All windows of a length are one
    difference of arrays, made in the tasks; what is shuffled is an array of starts a
    task, subject and length, whatever the number of nodes.  Steps that lack a value count as 0.
    """
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    series = panel.groupBy("subject", "node").agg(F.collect_list(F.struct(F.col("step").alias("t"), v.alias("v"))).alias("_s"))
    subjects = sorted(r.subject for r in panel.select("subject").distinct().collect())  # one name a subject
    number = {s: k for k, s in enumerate(subjects)}
    series = series.select("subject", F.transform("_s", lambda x: x["t"]).alias("t"), F.transform("_s", lambda x: x["v"]).alias("v")).sortWithinPartitions("subject")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        subject, total, nodes = None, np.zeros((n_steps, n_steps)), 0
        for batch in batches:
            for name, t, x in zip(batch["subject"].to_pylist(), batch["t"], batch["v"], strict=True):
                if name != subject:
                    yield from ((number[subject] * n_steps + k, np.append(total[k], nodes)) for k in range(n_steps if nodes else 0))
                    subject, total, nodes = name, np.zeros((n_steps, n_steps)), 0
                own = np.zeros(n_steps)
                np.add.at(own, t.values.to_numpy(), x.values.to_numpy())
                run = np.concatenate([[0.0], np.cumsum(np.concatenate([own, own]))])
                nodes += 1
                for k in range(n_steps):  # windows of k + 1 steps
                    total[k] += ((run[k + 1 : k + 1 + n_steps] - run[:n_steps]) / (k + 1) - run[n_steps] / n_steps) ** 2
        yield from ((number[subject] * n_steps + k, np.append(total[k], nodes)) for k in range(n_steps if nodes else 0))

    def summed(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        x = np.frombuffer(b"".join(c.as_py() for c in group["x"]))
        e, key = np.sqrt(x[:-1] / x[-1]), group["key"][0].as_py()
        sd = float(e.std(ddof=1)) if n_steps > 1 else None
        return pa.table({"_k": [key // n_steps], "length": [key % n_steps + 1], "mean": [float(e.mean())], "sd": pa.array([sd], pa.float64()), "least": [float(e.min())], "greatest": [float(e.max())]})

    summed.__annotations__ = {"group": pa.Table, "return": pa.Table}
    out = array_sums(series, part).groupBy("key").applyInArrow(summed, "_k long, length long, mean double, sd double, least double, greatest double")
    names = panel.sparkSession.createDataFrame(list(enumerate(subjects)), f"_k long, subject {panel.schema['subject'].dataType.simpleString()}")
    return out.join(F.broadcast(names), "_k").select("subject", "length", "mean", "sd", "least", "greatest")


def moving_average(panel: DataFrame, length: int, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Mean of the last ``length`` steps, where there are as many."""
    series = W.partitionBy(*keys).orderBy("step")
    rows = panel.withColumn("average", F.avg(value).over(series.rowsBetween(1 - length, 0))).withColumn("_n", F.row_number().over(series))
    return rows.where(F.col("_n") >= length).drop("_n")


def lag_correlation(panel: DataFrame, lag: int, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    before = F.lag(value, lag).over(W.partitionBy(*keys).orderBy("step"))
    rows = panel.withColumn("_b", before).where("_b is not null")
    return rows.groupBy(*keys).agg(correlation(F.col(value), F.col("_b")).alias("autocorrelation"))


def cumulative_share(counts: DataFrame, keys: Sequence[str], by: str, n: str) -> DataFrame:
    """``below``: share of counts up to ``by``; ``from_above``: count from ``by`` on."""
    up = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys).orderBy(F.desc(by)).rowsBetween(W.unboundedPreceding, 0)
    whole = F.sum(n).over(W.partitionBy(*keys))
    return counts.withColumns({"below": ratio(F.sum(n).over(up), whole), "from_above": F.sum(n).over(down)})


def components_needed(variances: DataFrame, keys: Sequence[str], order: str, variance: str, share: float = 0.95) -> DataFrame:
    """How many components, greatest variance first, explain ``share`` of the sum."""
    w = W.partitionBy(*keys).orderBy(F.desc(variance), order).rowsBetween(W.unboundedPreceding, 0)
    rows = variances.withColumn("_c", F.sum(variance).over(w)).withColumn("_t", F.sum(variance).over(W.partitionBy(*keys)))
    return rows.groupBy(*keys).agg((F.count_if(F.col("_c") < share * F.col("_t")) + 1).alias("n_components"))


def magnetization(panel: DataFrame) -> DataFrame:
    return panel.groupBy("subject", "step").agg(ratio(F.sum("state"), F.count("*")).alias("magnetization"))
