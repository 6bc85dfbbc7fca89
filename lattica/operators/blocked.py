"""Sums of products of a panel's columns over steps, in blocks.

A step is gathered into one row, the vector of its nodes.  Each task stacks the
vectors of a key into matrices and adds up their products X'X; one sum a task,
key and pair is shuffled, whatever the number of steps.  Beyond ``tile`` columns
the matrix is cut into tiles, each pair of which is a task's work of its own,
so that a task holds a few tiles and never the whole square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import written

#: Steps that are multiplied at once.
BLOCK = 512
SUMS = ("n", "sx", "sy", "sxy", "sxx", "syy")
Expand = Callable[[np.ndarray, np.ndarray], np.ndarray]


def step_vectors(panel: DataFrame, value: str, keys: Sequence[str], step: str = "step") -> DataFrame:
    """One row a step: the nodes that it holds, in order, and their values."""
    got = F.sort_array(F.collect_list(F.struct(F.col("node").alias("n"), F.col(value).cast("double").alias("v"))))
    rows = panel.where(F.col(value).isNotNull()).groupBy(*keys, step).agg(got.alias("_s"))
    return rows.select(*keys, F.transform("_s", lambda x: x["n"]).alias("nodes"), F.transform("_s", lambda x: x["v"]).alias("values"))


def pair_sums(panel: DataFrame, value: str, keys: Sequence[str], diagonal: bool = False, tile: int = 1024) -> DataFrame:
    """Rows (keys, i, j, n, sx, sy, sxy, sxx, syy) of the pairs i < j (or i <= j) of nodes that stand in one step.

    Sums of whole numbers are exact below 2 ** 53.
    """
    names = sorted(r.node for r in panel.select("node").distinct().collect())  # one number a node
    return _sums(step_vectors(panel, value, keys), keys, np.array(names, np.int64), diagonal, tile)


def observable_sums(panel: DataFrame, keys: Sequence[str], code: Callable[[np.ndarray, np.ndarray], np.ndarray], tile: int = 512) -> DataFrame:
    """``pair_sums`` of all observables, states and products of two states; ``code`` numbers those of nodes i <= j.

    Products are made in the tasks, tile by tile, and never stand in a row.
    """
    names = np.array(sorted(r.node for r in panel.select("node").distinct().collect()), np.int64)
    a, b = np.triu_indices(len(names))

    def expand(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        i, j = a[at], b[at]
        return np.where(i == j, x[:, i], x[:, i] * x[:, j])

    return _tile_rows(step_vectors(panel, "state", keys), [*keys], names, code(names[a], names[b]), expand, tile)


#: Steps that a task of a row of tiles holds, a byte a node.
HELD = 1 << 16
MISSING = -128


def _tile_rows(vectors: DataFrame, keys: list[str], names: np.ndarray, columns: np.ndarray, expand: Expand, tile: int) -> DataFrame:
    """Sums over pairs of observables, a row of tiles a task.

    Steps are packed a byte a node and sent once to every row of tiles; the task
    makes the observables of its own tile, and of one tile after it at a time, from
    the states that it holds.  States are whole numbers within a byte.
    """
    kinds = "".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}, " for k in keys)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = [part[k].to_pylist() for k in keys]
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*own, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items() if keys else [((), range(len(part)))]:
                x = np.full((len(at), len(names)), MISSING, np.int8)
                for k, i in enumerate(at):
                    x[k, np.searchsorted(names, part["nodes"][i].values.to_numpy())] = part["values"][i].values.to_numpy()
                yield pa.RecordBatch.from_arrays([*(pa.array([v], part[k].type) for k, v in zip(keys, key, strict=True)), pa.array([len(at)], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=[*keys, "_n", "_x"])

    packed = written(vectors.sortWithinPartitions(*keys).mapInArrow(pack, f"{kinds}_n long, _x binary") if keys else vectors.mapInArrow(pack, "_n long, _x binary"))
    most = packed.groupBy(*keys).agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] or 0  # one number
    chunks, n_tiles = max(1, -(-most // HELD)), -(-max(1, len(columns)) // tile)
    rows = packed.withColumn("_c", F.pmod(F.xxhash64("_x", F.monotonically_increasing_id()), F.lit(chunks)).cast("int")).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
    order = [*keys, "_t", "_c"]
    rows = rows.repartition(*order).sortWithinPartitions(*order)

    types = {k: to_arrow_type(vectors.schema[k].dataType) for k in keys}

    def sums(held: list[np.ndarray], ta: int, tb: int) -> list[np.ndarray]:
        at, bt = (np.arange(t * tile, min(len(columns), (t + 1) * tile)) for t in (ta, tb))
        total = [np.zeros((len(at), len(bt))) for _ in range(6)]
        for whole in held:
            for s in range(0, len(whole), BLOCK):
                x = whole[s : s + BLOCK].astype(float)
                seen = x != MISSING
                if seen.all():
                    a, b = expand(x, at), expand(x, bt)
                    more = [len(x), a.sum(axis=0)[:, None], b.sum(axis=0)[None, :], a.T @ b, (a * a).sum(axis=0)[:, None], (b * b).sum(axis=0)[None, :]]
                else:
                    x, seen = np.where(seen, x, 0.0), seen.astype(float)
                    a, b, u, v = expand(x, at), expand(x, bt), expand(seen, at), expand(seen, bt)
                    more = [u.T @ v, a.T @ v, u.T @ b, a.T @ b, (a * a).T @ v, u.T @ (b * b)]
                for k, m in enumerate(more):
                    total[k] += m
        return total

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[np.ndarray] = []

        def results() -> Iterator[pa.RecordBatch]:
            ta = key[-2]
            for tb in range(ta, n_tiles):
                total = sums(held, ta, tb)
                i, j = np.nonzero(total[0])
                ok = i + ta * tile <= j + tb * tile
                i, j = i[ok], j[ok]
                fixed = [pa.array([v] * len(i), types[k]) for k, v in zip(keys, key, strict=False)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(columns[i + ta * tile]), pa.array(columns[j + tb * tile]), *(pa.array(t[i, j]) for t in total)], names=[*keys, "i", "j", *SUMS])

        for part in parts:
            for row in zip(*(part[c].to_pylist() for c in [*order, "_x"]), strict=True):
                if row[:-1] != key:
                    if held:
                        yield from results()
                    key, held = row[:-1], []
                held.append(np.frombuffer(row[-1], np.int8).reshape(-1, len(names)))
        if held:
            yield from results()

    added = rows.mapInArrow(run, f"{kinds}i long, j long, {', '.join(f'{c} double' for c in SUMS)}")
    return added.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def _sums(vectors: DataFrame, keys: Sequence[str], names: np.ndarray, diagonal: bool, tile: int) -> DataFrame:
    keys, n_tiles = [*keys], -(-max(1, len(names)) // tile)
    pairs = F.array(*[F.struct(F.lit(a).alias("ta"), F.lit(b).alias("tb")) for a in range(n_tiles) for b in range(a, n_tiles)])
    rows = vectors.select(*keys, "nodes", "values", F.explode(pairs).alias("_t")).select(*keys, "nodes", "values", "_t.*")
    order = [*keys, "ta", "tb"]
    rows = (rows.repartition(*order) if n_tiles > 1 else rows).sortWithinPartitions(*order)

    def products(x: np.ndarray, seen: np.ndarray, ta: int, tb: int) -> list[np.ndarray]:
        at, bt = (slice(t * tile, (t + 1) * tile) for t in (ta, tb))
        a, b, u, v = x[:, at], x[:, bt], seen[:, at], seen[:, bt]
        return [u.T @ v, a.T @ v, u.T @ b, a.T @ b, (a * a).T @ v, u.T @ (b * b)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        total: list[np.ndarray] | None = None
        held: list[tuple] = []

        def add() -> None:
            nonlocal total, held
            if not held:
                return
            x, seen = np.zeros((len(held), len(names))), np.zeros((len(held), len(names)))
            for k, (nodes, values) in enumerate(held):
                at = np.searchsorted(names, nodes)
                x[k, at], seen[k, at] = values, 1.0
            more = products(x, seen, *key[len(keys) :])
            total = more if total is None else [s + m for s, m in zip(total, more, strict=True)]
            held = []

        def result() -> pd.DataFrame:
            i, j = np.nonzero(total[0])
            ci, cj = names[i + key[-2] * tile], names[j + key[-1] * tile]
            ok = (i + key[-2] * tile <= j + key[-1] * tile) if diagonal else (i + key[-2] * tile < j + key[-1] * tile)
            out = {k: [v] * int(ok.sum()) for k, v in zip(keys, key, strict=False)}
            return pd.DataFrame(out | {"i": ci[ok], "j": cj[ok]} | {c: s[i, j][ok] for c, s in zip(("n", "sx", "sy", "sxy", "sxx", "syy"), total, strict=True)})

        for part in parts:
            for row in part.itertuples(index=False, name=None):
                own = (*row[: len(keys)], *row[-2:])
                if own != key:
                    add()
                    if total is not None:
                        yield result()
                    key, total = own, None
                held.append(row[len(keys) : len(keys) + 2])
                if len(held) >= BLOCK:
                    add()
        add()
        if total is not None:
            yield result()

    kinds = ", ".join(f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys)
    sums = rows.mapInPandas(run, f"{kinds}{', ' if keys else ''}i long, j long, n double, sx double, sy double, sxy double, sxx double, syy double")
    return sums.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")])
