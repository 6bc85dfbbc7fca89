"""Sums of numpy arrays over all tasks of a job.

Data-parallel passes (gradients, degrees, matrix products) end in a few large
arrays.  Each task adds up its own part and hands it on in chunks; one group a
chunk adds those of all tasks, so that no task and not the driver ever holds
more than one array of each key, and a group no more than one chunk a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Numbers in a chunk.
CHUNK = 8192
Part = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]]


def array_sums(rows: DataFrame, part: Part, kind: str = "float64") -> DataFrame:
    """Rows (key, chunk, x): the sums, over tasks, of the flat arrays that ``part`` gives for a task's batches.

    Arrays of one key have one length.  Within a chunk tasks are added in the
    order of their numbers, so that sums of floats do not depend on the order of arrival.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        for key, x in part(batches):
            x = np.ascontiguousarray(x, kind).ravel()
            for c in range(0, len(x), CHUNK):
                yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "chunk": pa.array([c // CHUNK], pa.int64()), "task": pa.array([me], pa.int64()), "x": pa.array([x[c : c + CHUNK].tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        total = None
        for x in group["x"]:
            x = np.frombuffer(x.as_py(), kind)
            total = x.copy() if total is None else total + x
        return pa.table({"key": group["key"].slice(0, 1), "chunk": group["chunk"].slice(0, 1), "x": pa.array([total.tobytes()], pa.binary())})

    add.__annotations__ = {"group": pa.Table, "return": pa.Table}
    return rows.mapInArrow(run, "key long, chunk long, task long, x binary").groupBy("key", "chunk").applyInArrow(add, "key long, chunk long, x binary")


def summed_arrays(rows: DataFrame, part: Part, kind: str = "float64") -> dict[int, np.ndarray]:
    """``array_sums`` on the driver, one array a key; for arrays whose sizes are bounded by parameters, not by rows."""
    found: dict[int, dict[int, bytes]] = {}
    for r in array_sums(rows, part, kind).collect():
        found.setdefault(r.key, {})[r.chunk] = bytes(r.x)
    return {k: np.frombuffer(b"".join(c[i] for i in sorted(c)), kind) for k, c in found.items()}
