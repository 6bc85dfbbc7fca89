"""Streams with state that the built-in aggregates cannot hold: runs of activity in event time, and sums of pairs.

Both keep their state in maps of the state store, entry by entry, so that a batch
reads and writes only what it touches.  They need the RocksDB store:
``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNS = "subject string, active boolean, begin long, duration long, size long, late long"


class _Runs(StatefulProcessor):
    """Steps wait in a map until the watermark has passed them, and are then put in order into the run they end or prolong."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, step long", "n long")
        self.now = handle.getValueState("now", "active boolean, begin long, last long, size long")
        self.late = handle.getValueState("late", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        late, out, timers = (self.late.get()[0] if self.late.exists() else 0), [], set()
        for part in rows:
            for step, n, ms in part[["step", "n_active", "ms"]].itertuples(index=False):
                if ms <= mark:
                    late += 1
                    out.append((key[0], None, int(step), None, int(n), late))
                else:
                    self.waiting.updateValue((int(ms), int(step)), (int(n),))
                    timers.add(int(ms))
        if out:
            self.late.update((late,))
        for ms in timers:
            self.handle.registerTimer(ms)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        active, begin, last, size = self.now.get() if self.now.exists() else (None, None, None, 0)
        out = []
        for at in sorted(k for k in self.waiting.keys() if k[0] <= until):
            (n,), step = self.waiting.getValue(at), at[1]
            self.waiting.removeKey(at)
            on = n > 0
            if active is not None and on != active:
                out.append((key[0], active, begin, last - begin + 1, size, None))
                begin, size = step, 0
            if active is None:
                begin = step
            active, last, size = on, step, size + n
        if active is not None:
            self.now.update((bool(active), int(begin), int(last), int(size)))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["subject", "active", "begin", "duration", "size", "late"], dtype=object)
    return out.astype({"begin": "Int64", "duration": "Int64", "size": "Int64", "late": "Int64"})


def runs_in_order(counts: DataFrame, time: str, late: str) -> DataFrame:
    """Runs of active steps and the gaps between them, as they end, of ``counts(subject, step, n_active)`` in any order.

    A step is placed once the watermark of ``time`` (which grows with the steps)
    has passed it, ``late`` behind the newest row.  Rows subject, active, begin,
    duration, size; of a step behind the watermark a row with ``active`` null,
    its number in begin, its activity in size, and in ``late`` how many there
    were of the subject so far.  Of a step that comes twice the last value before it is placed counts.
    """
    own = counts.withWatermark(time, late).select(F.col("subject").cast("string").alias("subject"), F.col("step").cast("long").alias("step"), F.col("n_active").cast("long").alias("n_active"), F.unix_millis(time).alias("ms"))
    return own.groupBy("subject").transformWithStateInPandas(_Runs(), RUNS, "append", "eventtime")


TILE = "subject string, tile_i long, tile_j long, n long, waiting long, sums binary"


class _Tiles(StatefulProcessor):
    """The sums of products of one pair of tiles of nodes; steps wait until all of both tiles' nodes have come."""

    def __init__(self, n_nodes: int, tile: int) -> None:
        self.n_nodes, self.tile = n_nodes, tile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "step long", "nodes array<long>, values array<double>")
        self.total = handle.getValueState("total", "n long, sums binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        subject, a, b = key
        size = lambda t: min(self.n_nodes, (t + 1) * self.tile) - t * self.tile
        first, wide, tall = np.array([a, b]) * self.tile, size(a), size(b)
        whole = wide if a == b else wide + tall
        n, sums = self.total.get() if self.total.exists() else (0, None)
        sums = np.zeros((wide + 1, tall + 1)) if sums is None else np.frombuffer(bytes(sums)).reshape(wide + 1, tall + 1).copy()
        got = pd.concat(list(rows))
        done = []
        for step, own in got.groupby("step"):
            seen = dict(zip(own["node"].tolist(), own["value"].tolist(), strict=True))
            at = (int(step),)
            if self.waiting.containsKey(at):
                nodes, values = self.waiting.getValue(at)
                seen = dict(zip(nodes, values, strict=True)) | seen
            if len(seen) == whole:
                done.append(seen)
                self.waiting.removeKey(at)
            else:
                self.waiting.updateValue(at, ([int(k) for k in seen], [float(v) for v in seen.values()]))
        if done:
            x = np.ones((2, len(done), max(wide, tall) + 1))
            for k, seen in enumerate(done):
                x[0, k, :wide] = [seen[first[0] + i] for i in range(wide)]
                x[1, k, :tall] = [seen[first[1] + i] for i in range(tall)]
            sums += np.hstack([x[0, :, :wide], x[0, :, -1:]]).T @ np.hstack([x[1, :, :tall], x[1, :, -1:]])
            n += len(done)
            self.total.update((int(n), sums.tobytes()))
        left = sum(1 for _ in self.waiting.keys())
        yield pd.DataFrame({"subject": [subject], "tile_i": [a], "tile_j": [b], "n": [n], "waiting": [left], "sums": [sums.tobytes()]})

    def close(self) -> None:
        pass


def running_pairs(panel: DataFrame, n_nodes: int, tile: int = 64, value: str = "state") -> DataFrame:
    """Sums of products of all pairs of ``panel(subject, node, step, value)`` so far, by tile of nodes; for update mode.

    A step's nodes may come in several batches and in any order; it counts
    once all have come (``waiting`` tells how many steps are incomplete), and a
    node that comes again before that counts by its last value.  A tile's state
    is a matrix of ``tile + 1`` numbers a side, whatever the length of the stream.
    :func:`pairs_of` expands the newest rows.
    """
    last = -(-n_nodes // tile) - 1
    own = F.floor(F.col("node") / tile).cast("long")
    first = F.transform(F.sequence(F.lit(0).cast("long"), own), lambda t: F.struct(t.alias("tile_i"), own.alias("tile_j")))
    second = F.transform(F.sequence(own, F.lit(last).cast("long")), lambda t: F.struct(own.alias("tile_i"), t.alias("tile_j")))
    rows = panel.where(F.col(value).isNotNull() & F.col("node").between(0, n_nodes - 1))
    rows = rows.select(F.col("subject").cast("string").alias("subject"), F.col("node").cast("long").alias("node"), F.col("step").cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    rows = rows.withColumn("_t", F.explode(F.array_distinct(F.concat(first, second)))).select("subject", "_t.tile_i", "_t.tile_j", "node", "step", "value")
    return rows.groupBy("subject", "tile_i", "tile_j").transformWithStateInPandas(_Tiles(n_nodes, tile), TILE, "update", "none")


def pairs_of(tiles: DataFrame, n_nodes: int, tile: int = 64) -> DataFrame:
    """Rows (subject, i, j, n, sx, sy, sxy) of the nodes i <= j from the newest row of each tile of :func:`running_pairs`."""
    newest = tiles.groupBy("subject", "tile_i", "tile_j").agg(F.max_by(F.struct("n", "sums"), "n").alias("x")).select("subject", "tile_i", "tile_j", "x.*")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                tall = min(n_nodes, (r.tile_j + 1) * tile) - r.tile_j * tile
                sums = np.frombuffer(bytes(r.sums)).reshape(-1, tall + 1)
                i, j = np.indices((len(sums) - 1, tall))
                at = (i + r.tile_i * tile <= j + r.tile_j * tile) & (r.n > 0)
                i, j = i[at], j[at]
                yield pd.DataFrame({"subject": r.subject, "i": i + r.tile_i * tile, "j": j + r.tile_j * tile, "n": r.n, "sx": sums[i, -1], "sy": sums[-1, j], "sxy": sums[i, j]})

    return newest.mapInPandas(run, "subject string, i long, j long, n long, sx double, sy double, sxy double")
