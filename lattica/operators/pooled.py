"""Pseudolikelihood fits of models to the pooled series of many subjects, by data-parallel gradients.

Steps are packed once into blocks, small matrices of states, that stay where
they are.  A pass sends the parameters to the tasks; each task goes through its
blocks, adds up the residuals s - tanh(h + w s) and their products with the
states, and one sum a coupling is reduced over tasks.  No task holds a series,
and its memory does not grow with subjects or steps: it is a block and the
gradients of one batch of models.  Models go through in batches whose parameters
stay within ``batch_bytes``; the driver holds one batch's parameters, as any
optimizer must.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import last_checkpoint
from ..sources.scratch import written
from .arrays import summed_arrays

HISTORY = "model string, update long, n_steps long, log_likelihood double, gradient double"


def step_blocks(panel: DataFrame, block: int = 512) -> tuple[DataFrame, list[int]]:
    """Blocks (subject, number, n, x) of at most ``block`` whole steps as 8-bit matrices, and the nodes of their columns.

    Steps that lack a node's state are left out.  ``number`` names a block.
    """
    nodes = sorted(r.node for r in panel.select("node").distinct().collect())  # one number a node
    state = F.col("state").cast("byte")
    steps = panel.where(F.col("state").isNotNull()).groupBy(F.col("subject").cast("string").alias("subject"), "step").agg(F.sort_array(F.collect_list(F.struct("node", state.alias("s")))).alias("v"))
    steps = steps.where(F.size("v") == len(nodes)).select("subject", "step", F.transform("v", lambda x: x["s"]).alias("v")).sortWithinPartitions("subject", "step")

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        subject, held = None, []

        def full() -> pa.RecordBatch:
            nonlocal number, held
            number, rows, held = number + 1, held, []
            x = np.concatenate(rows)
            return pa.RecordBatch.from_pydict({"subject": [subject], "number": pa.array([number], pa.int64()), "n": pa.array([len(x)], pa.int64()), "x": pa.array([x.tobytes()], pa.binary())})

        for part in parts:
            names = part["subject"].to_pylist()
            x = part["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int8).reshape(len(names), -1)
            at = 0
            while at < len(names):
                if held and (names[at] != subject or sum(map(len, held)) == block):
                    yield full()
                subject, to = names[at], at + 1
                room = block - sum(map(len, held))
                while to < len(names) and names[to] == subject and to - at < room:
                    to += 1
                held.append(x[at:to])
                at = to
        if held:
            yield full()

    return written(steps.select("subject", "v").mapInArrow(pack, "subject string, number long, n long, x binary")), nodes


class Adam:
    """The moments of one model's gradients."""

    def __init__(self, rate: float, t: int = 0, m: np.ndarray | None = None, v: np.ndarray | None = None) -> None:
        self.rate, self.t, self.m, self.v = rate, t, m, v

    def step(self, g: np.ndarray) -> np.ndarray:
        if self.m is None:
            self.m, self.v = np.zeros_like(g), np.zeros_like(g)
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def gradient_pass(blocks: DataFrame, theta: np.ndarray, owners: dict[str, Sequence[int]] | None, symmetric: bool) -> dict[int, np.ndarray]:
    """Summed gradients of the models ``theta`` (fields, then couplings, a row each): gradient, log pseudolikelihood and steps of those that have any.

    ``owners`` names the models that are fitted to each subject; without it all are fitted to all.
    """
    n = int(round((np.sqrt(4 * theta.shape[1] + 1) - 1) / 2))
    everyone = range(len(theta))

    def part(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros((len(theta), theta.shape[1] + 2))
        for batch in parts:
            for subject, data in zip(batch["subject"].to_pylist(), batch["x"].to_pylist(), strict=True):
                x = np.frombuffer(data, np.int8).reshape(-1, n).astype(float)
                for k in everyone if owners is None else owners.get(subject, ()):
                    local = theta[k, :n] + x @ theta[k, n:].reshape(n, n).T
                    e = x - np.tanh(local)
                    g = e.T @ x
                    total[k, :n] += e.sum(axis=0)
                    total[k, n:-2] += (g + g.T if symmetric else g).ravel()
                    total[k, -2] += (x * local - np.logaddexp(local, -local)).sum()
                    total[k, -1] += len(x)
        for k in np.flatnonzero(total[:, -1]):
            yield int(k), total[k]

    return summed_arrays(blocks.select("subject", "x"), part)


def fit_pooled(
    models: DataFrame, panel: DataFrame, n_updates: int, rate: float, pairs: DataFrame | None = None, optimizer: str = "gradient", parts: int = 1,
    symmetric: bool = True, with_fields: bool = True, tolerance: float = 0.0, path: str | None = None, every: int = 50, block: int = 512, batch_bytes: int = 64 << 20, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Maximum pseudolikelihood of ``models(model, beta, h, w)`` on the pooled series of their subjects.

    ``pairs(model, subject)`` tells which subjects a model is fitted to, so that
    a group, replicas of it and single subjects are fitted alike; without it
    every model is fitted to all subjects.  Subjects without a model are not
    read for any; a model without subjects stays as it starts.

    ``gradient`` climbs by the mean gradient, ``adam`` scales it.  With ``parts``
    an update takes one part of the blocks after another, in an order drawn anew
    each time round (stochastic gradient).  ``symmetric`` adds both nodes'
    gradients of a coupling; otherwise each row of w is its node's own
    regression.  A batch ends early when all its gradients' root mean squares are
    below ``tolerance``.  Under ``path`` every ``every``-th update is kept, and a
    run that was broken off goes on from the last one.

    Returns the models, and rows (model, update, n_steps, log_likelihood,
    gradient) of the state before each update, a step's mean likelihood.
    """
    spark = models.sparkSession
    blocks, nodes = step_blocks(panel, block)
    n = len(nodes)
    out, history = [], []
    for number, batch in enumerate(_batches(models, n, batch_bytes)):
        names = [r.model for r in batch]
        if not n:  # no series at all
            out.append(_models(batch, np.zeros((len(batch), 0)), 0))
            continue
        theta = np.array([[*r.h, *r.w] for r in batch], float).reshape(len(batch), n + n * n)
        owners = None
        if pairs is not None:
            owners = {}
            place = {m: k for k, m in enumerate(names)}
            for r in pairs.where(F.col("model").isin(names)).select("model", F.col("subject").cast("string").alias("subject")).distinct().collect():
                owners.setdefault(r.subject, []).append(place[r.model])
        own = blocks if owners is None else blocks.where(F.col("subject").isin(sorted(owners)))
        if not with_fields:
            theta[:, :n] = 0.0
        adam = [Adam(rate) for _ in batch]
        at = f"{path}/batch-{number}" if path else None
        first = _resumed(spark, at, names, theta, adam) if at else 0
        rng = np.random.default_rng([seed, number])
        order = list(range(parts))
        for update in range(n_updates):
            if update % parts == 0:
                rng.shuffle(order)
            if update < first:
                continue
            some = own if parts == 1 else own.where(F.pmod(F.xxhash64("number"), F.lit(parts)) == order[update % parts])
            sums, steepest = gradient_pass(some, theta, owners, symmetric), 0.0
            for k, total in sums.items():
                g = total[:-2] / total[-1]
                g[n:].reshape(n, n)[np.diag_indices(n)] = 0.0
                if not with_fields:
                    g[:n] = 0.0
                size = float(np.sqrt(np.mean(g * g)))
                steepest = max(steepest, size)
                history.append((names[k], update, int(total[-1]), float(total[-2] / total[-1]), size))
                theta[k] += adam[k].step(g) if optimizer == "adam" else rate * g
            if at and (update + 1) % every == 0:
                _save(spark, at, update + 1, names, theta, adam)
            if steepest < tolerance:
                break
        out.append(_models(batch, theta, n))
    schema = pa.schema([("model", pa.string()), ("beta", pa.float64()), ("h", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))])
    fitted = pa.Table.from_batches(out, schema)
    return spark.createDataFrame(fitted) if len(fitted) else models.select("model", "beta", "h", "w").limit(0), spark.createDataFrame(history, HISTORY)


def _batches(models: DataFrame, n: int, most: int) -> Iterator[list]:
    rows = max(1, most // max(1, 8 * (n + n * n)))
    batch = []
    for r in models.select("model", "beta", "h", "w").orderBy("model").toLocalIterator():
        batch.append(r)
        if len(batch) == rows:
            yield batch
            batch = []
    if batch:
        yield batch


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.array(np.ascontiguousarray(x).ravel()))


def _models(batch: list, theta: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.model for r in batch]), pa.array([float(r.beta) for r in batch]), _lists(theta[:, :n]), _lists(theta[:, n:])], names=["model", "beta", "h", "w"])


def _save(spark, path: str, updates: int, names: list[str], theta: np.ndarray, adam: list[Adam]) -> None:
    zero = np.zeros_like(theta)
    m, v = (np.array([z if getattr(a, x) is None else getattr(a, x) for a, z in zip(adam, zero, strict=True)]) for x in ("m", "v"))
    table = pa.table({"model": names, "t": [a.t for a in adam], "theta": _lists(theta), "m": _lists(m), "v": _lists(v)})
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/updates={updates}")


def _resumed(spark, path: str, names: list[str], theta: np.ndarray, adam: list[Adam]) -> int:
    """Take up the last parameters under ``path``; the number of updates behind them."""
    try:
        rows = {r.model: r for r in last_checkpoint(spark, path).collect()}  # one batch
    except AnalysisException:  # nothing was kept yet
        return 0
    for k, name in enumerate(names):
        r = rows[name]
        theta[k] = r.theta
        adam[k] = Adam(adam[k].rate, r.t, np.array(r.m), np.array(r.v)) if r.t else adam[k]
    return int(next(iter(rows.values())).updates)
