"""Small regression networks by Adam, one setting and key in each Spark task group.

With no hidden layer this is the linear model by gradient descent; with ``skip``
each hidden layer adds to its input.  A group holds one key's rows (a node over
subjects, say), which should be of bounded size; keys, splits and settings are
rows of a grid and spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .relate import neighbour_mean
from .sampling import _rng

CURVE = "epoch long, train_rmse double, test_rmse double, corr double, stopped boolean"


def _forward(x: np.ndarray, layers: list[np.ndarray], skip: bool) -> list[np.ndarray]:
    out = [x]
    for k, w in enumerate(layers):
        z = np.column_stack([out[-1], np.ones(len(x))]) @ w
        if k < len(layers) - 1:
            z = np.maximum(z, 0.0)
            z = z + out[-1] if skip and z.shape == out[-1].shape else z
        out.append(z)
    return out


def trained(x: np.ndarray, y: np.ndarray, test: np.ndarray, width: int, depth: int, rate: float, epochs: int, batch: int, patience: int, skip: bool, rng: np.random.Generator) -> pd.DataFrame:
    """Errors on both parts after each epoch, until the test part's has not fallen for ``patience`` epochs."""
    mean, sd = x[~test].mean(axis=0), x[~test].std(axis=0)
    x = (x - mean) / np.where(sd > 0, sd, 1.0)
    sizes = [x.shape[1], *[width] * depth, 1]
    layers = [np.vstack([rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros((1, b))]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    m, v, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    own, rows, best, since = np.flatnonzero(~test), [], np.inf, 0
    for epoch in range(epochs):
        order = rng.permutation(own)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            acts = _forward(x[part], layers, skip)
            back, grads = 2 * (acts[-1] - y[part, None]) / len(part), [np.zeros(0)] * len(layers)
            for k in reversed(range(len(layers))):
                straight = skip and k < depth and acts[k + 1].shape == acts[k].shape
                inner = back
                if k < depth:  # through the bend of a hidden layer
                    inner = back * ((acts[k + 1] - acts[k] if straight else acts[k + 1]) > 0)
                grads[k] = np.column_stack([acts[k], np.ones(len(part))]).T @ inner
                back = inner @ layers[k][:-1].T + (back if straight else 0.0)
            t += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                layers[k] = layers[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        p = _forward(x, layers, skip)[-1][:, 0]
        rmse = lambda at: float(np.sqrt(np.mean((p[at] - y[at]) ** 2)))
        spread = p[test].std() * y[test].std()
        corr = float(np.mean((p[test] - p[test].mean()) * (y[test] - y[test].mean())) / spread) if spread > 0 else np.nan
        rows.append((epoch, rmse(~test), rmse(test), corr, False))
        best, since = (rows[-1][2], 0) if rows[-1][2] < best - 1e-9 else (best, since + 1)
        if since >= patience:
            rows[-1] = (*rows[-1][:4], True)
            break
    return pd.DataFrame(rows, columns=["epoch", "train_rmse", "test_rmse", "corr", "stopped"])


def learning_curves(rows: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, settings: DataFrame, epochs: int = 200, patience: int = 20, test_share: float = 0.5, seed: int = 1) -> DataFrame:
    """Curves of every key at every setting(setting, width, depth, rate, batch, skip, split): keys, setting, split and ``CURVE``.

    ``settings`` is a short table.  A split's test part is drawn from (seed,
    key, split), so that all settings are tested on the same rows.
    """
    names = [*keys]
    grid = settings.select("setting", "width", "depth", "rate", "batch", "skip", "split").withColumn("_g", F.lit(0))
    many = rows.select(*names, *xs, y).withColumn("_g", F.lit(0)).join(F.broadcast(grid), "_g").drop("_g")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values([*xs, y], kind="stable")
        x, target, one = own[[*xs]].to_numpy(float), own[y].to_numpy(float), own.iloc[0]
        key = [one[k] for k in names]
        test = _rng(seed, *key, one["split"]).random(len(own)) < test_share
        if not 0 < test.sum() < len(own):
            return pd.DataFrame(columns=[*names, "setting", "split", "epoch", "train_rmse", "test_rmse", "corr", "stopped"])
        curve = trained(x, target, test, int(one["width"]), int(one["depth"]), float(one["rate"]), epochs, int(one["batch"]), patience, bool(one["skip"]), _rng(seed, *key, one["split"], one["setting"]))
        return curve.assign(**dict(zip(names, key, strict=True)), setting=one["setting"], split=one["split"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names)
    return many.groupBy(*names, "setting", "split").applyInPandas(run, f"{kinds}{', ' if names else ''}setting string, split long, {CURVE}")


def best_settings(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key the setting with the least mean of its splits' best test errors."""
    each = curves.groupBy(*keys, "setting", "split").agg(F.min("test_rmse").alias("e"), F.max_by("corr", -F.col("test_rmse")).alias("c"))
    mean = each.groupBy(*keys, "setting").agg(F.avg("e").alias("rmse"), F.avg("c").alias("corr"))
    return mean.groupBy(*keys).agg(F.min_by(F.struct("setting", "rmse", "corr"), F.struct("rmse", "setting")).alias("x")).select(*keys, "x.*")


def convolved(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], weight: str, feature: str, passes: int) -> DataFrame:
    """Features of repeated message passing: pass_0 is the feature, pass_k the edge-weighted mean over neighbours of pass_k-1."""
    edges = written(edges.select(*keys, "i", "j", weight))  # every pass reads them
    out = written(nodes.select(*keys, "node", F.col(feature).alias("pass_0")))
    last = out.withColumnRenamed("pass_0", "_f")
    for k in range(1, passes + 1):
        last = neighbour_mean(edges, last, keys, weight, "_f").withColumnRenamed("message", "_f")
        out = out.join(last.withColumnRenamed("_f", f"pass_{k}"), [*keys, "node"], "left")
    return out
