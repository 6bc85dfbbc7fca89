"""Leading eigenpairs of covariances too wide to be written down.

The covariance of D columns over many rows is never formed.  A pass multiplies
it with a block of b vectors: every task goes through its rows, takes their
coordinates along the block, and adds up rows times coordinates; D times b sums
are reduced over tasks, in chunks.  Columns may be made in the tasks, a tile at a
time (the 64,980 observables of 360 nodes, say), so a task holds a block of rows, a tile
of columns and the b vectors.  Between passes the driver makes the new vectors
orthogonal and solves the small problem in the space searched so far (a block
Lanczos iteration, restarted from its best vectors); it stops when the residuals
of the wanted pairs are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import summed_arrays

#: Gives the base rows of a batch, and the columns ``at`` of base rows.
RowsOf = Callable[[pa.RecordBatch], Iterator[np.ndarray]]
Expand = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Spectrum:
    """The first eigenpairs, the mean row, the sum of all eigenvalues, the rows counted and the passes made."""

    values: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    trace: float
    n_rows: int
    residuals: np.ndarray
    passes: int


def leading(blocks: DataFrame, rows_of: RowsOf, dim: int, k: int, expand: Expand = lambda x, at: x[:, at], tile: int = 4096, extra: int = 4, width: int = 5, tolerance: float = 1e-8, most_passes: int = 200, seed: int = 1) -> Spectrum:
    """The ``k`` leading eigenpairs of the covariance (over n) of the rows of ``blocks``.

    ``rows_of`` gives the base rows of a batch and ``expand`` their columns; each
    vector has its largest entry positive.  Residuals are within ``tolerance``
    of the largest eigenvalue, unless ``most_passes`` run out.
    """
    k = min(k, dim)
    tiles = [np.arange(a, min(dim, a + tile)) for a in range(0, dim, tile)]

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros(dim + 2)
        for batch in parts:
            for x in rows_of(batch):
                for at in tiles:
                    o = expand(x, at)
                    total[at] += o.sum(axis=0)
                    total[dim] += float((o * o).sum())
                total[dim + 1] += len(x)
        yield 0, total

    total = summed_arrays(blocks, first).get(0, np.zeros(dim + 2))
    n = int(total[-1])
    if not n:
        return Spectrum(np.zeros(0), np.zeros((dim, 0)), np.zeros(dim), 0.0, 0, np.zeros(0), 1)
    mean = total[:dim] / n
    trace = max(0.0, total[dim] / n - float(mean @ mean))

    def times(q: np.ndarray) -> np.ndarray:
        shift = mean @ q

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            total, along = np.zeros((dim, q.shape[1])), np.zeros(q.shape[1])
            for batch in parts:
                for x in rows_of(batch):
                    c = sum(expand(x, at) @ q[at] for at in tiles) - shift
                    for at in tiles:
                        total[at] += expand(x, at).T @ c
                    along += c.sum(axis=0)
            yield 0, total - np.outer(mean, along)

        return summed_arrays(blocks, run)[0].reshape(dim, -1) / n

    size = min(dim, k + extra)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(dim, size)))[0]
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    passes = 1
    while True:
        basis, image, passes = np.hstack([basis, q]), np.hstack([image, times(q)]), passes + 1
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        x, ax = basis @ y[:, :size], image @ y[:, :size]
        rest = ax - x * values[:size]
        left = np.linalg.norm(rest[:, :k], axis=0)
        if (left <= tolerance * max(values[0], 1e-300)).all() or passes >= most_passes or basis.shape[1] >= dim:
            break
        if basis.shape[1] + size > width * size:
            basis, image = x, ax
        for _ in range(2):  # orthogonal to what is there, also after rounding
            rest = rest - basis @ (basis.T @ rest)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        q = u[:, s > 1e-14 * max(values[0], 1e-300)][:, : dim - basis.shape[1]]
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        if not q.shape[1]:
            break
    vectors = x[:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Spectrum(np.maximum(values[:k], 0.0), vectors * np.where(sign == 0, 1, sign), mean, trace, n, left, passes)


def explained(found: Spectrum, dim: int, tolerance: float) -> tuple[list[tuple[int, float, float, bool]], int | None]:
    """Rows (n_components, explained, rmse, stable) of a spectrum's first components, and the stable number if it is among them.

    Stable is the first number after which one more component lowers the root mean
    squared error of reconstruction by less than ``tolerance`` of the whole spread.
    """
    run = np.cumsum(found.values)
    rmse = np.sqrt(np.maximum(found.trace - run, 0.0) / dim)
    whole = np.sqrt(found.trace / dim)
    known = np.flatnonzero(rmse[:-1] - rmse[1:] < tolerance * whole)
    if len(found.values) == dim and not len(known):
        known = np.array([dim - 1])
    first = int(known[0]) if len(known) else None
    rows = [(i + 1, float(run[i] / found.trace) if found.trace else 0.0, float(rmse[i]), i == first) for i in range(len(run))]
    return rows, None if first is None else first + 1


def until_stable(blocks: DataFrame, rows_of: RowsOf, dim: int, tolerance: float, start: int = 8, most: int = 512, **how) -> tuple[Spectrum, list[tuple[int, float, float, bool]]]:
    """As many leading components as it takes for the error of reconstruction to be stable, at most ``most``; the number doubles until then."""
    k = min(start, dim)
    while True:
        found = leading(blocks, rows_of, dim, k, **how)
        rows, stable = explained(found, dim, tolerance)
        if stable is not None or k == dim or k >= most:
            return found, rows
        k = min(dim, 2 * k)


# --- rows of states, and rows that hold their vector


def observables(n_nodes: int) -> tuple[np.ndarray, np.ndarray, Expand]:
    """Nodes i <= j of the observables (a node's state where i = j, else the product of two), and how they are made of states."""
    i, j = np.triu_indices(n_nodes)

    def expand(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        a, b = i[at], j[at]
        return np.where(a == b, x[:, a], x[:, a] * x[:, b])

    return i, j, expand


def states_in(n_nodes: int) -> RowsOf:
    """Of batches of :func:`lattica.operators.pooled.step_blocks`."""

    def rows_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for data in batch["x"].to_pylist():
            yield np.frombuffer(data, np.int8).reshape(-1, n_nodes).astype(float)

    return rows_of


def fisher_leading(blocks: DataFrame, n_nodes: int, k: int, **how) -> Spectrum:
    """The ``k`` leading eigenpairs of the Fisher information (the covariance of all observables) of the steps in ``blocks``."""
    i, _, expand = observables(n_nodes)
    return leading(blocks.select("x"), states_in(n_nodes), len(i), k, expand, **how)


def vectors_in(column: str) -> RowsOf:
    """Of batches with an array column, all of one length."""

    def rows_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        if len(batch):
            yield batch[column].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)

    return rows_of


def coordinates(rows: DataFrame, column: str, found: Spectrum, keep: list[str], without: tuple[int, ...] = ()) -> DataFrame:
    """``keep`` and the coordinates of each row along a spectrum's vectors, and what they rebuild, with ``without`` left out of that."""
    used = np.array([c for c in range(found.vectors.shape[1]) if c not in without], int)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = next(vectors_in(column)(batch), np.zeros((0, len(found.mean))))
            c = (x - found.mean) @ found.vectors
            back = c[:, used] @ found.vectors[:, used].T + found.mean
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * np.int32(m.shape[1])), pa.array(m.ravel())) for m in (c, back)]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), *lists], names=[*keep, "coordinates", "rebuilt"])

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keep)
    return rows.select(*keep, column).mapInArrow(run, f"{kinds}coordinates array<double>, rebuilt array<double>")
