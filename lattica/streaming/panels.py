"""Streams of panel rows: running moments, windows on event time, and file ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16, clean: str = "off") -> DataFrame:
    """Parquet files that appear under ``path``; ``clean`` may be ``delete`` to remove those that are done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("cleanSource", clean).parquet(path)


def running_moments(states: DataFrame) -> DataFrame:
    """Count, sum and sum of squares of each node so far; for update or complete mode.

    The state is one row a node, whatever the length of the stream.
    """
    x = F.col("state")
    return states.groupBy("subject", "node").agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))


def windowed_activity(events: DataFrame, time: str, length: str, late: str, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Activity by tumbling windows of event time; rows later than ``late`` are left out and windows are then closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def bursts(events: DataFrame, time: str, gap: str, late: str, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Runs of activity with pauses of less than ``gap``: begin, end and size of each."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("run"), *keys).agg(F.count("*").alias("size"))
    return found.select(*keys, F.col("run.start").alias("begin"), F.col("run.end").alias("end"), "size")


def avalanches(counts: DataFrame) -> DataFrame:
    """Runs of active steps and the gaps between them, as they end: rows subject, active, begin, duration, size.

    ``counts(subject, step, n_active)`` arrives in order of step.  A subject's
    state is four numbers: whether it stands in a run or a gap, since when, its
    last step and the size so far, whatever the length of the stream.  Batches
    may cut a run anywhere.  Steps that were passed already are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, begin, last, size = state.get if state.exists else (None, None, None, 0)
        out = []
        for step, n in pd.concat(list(parts))[["step", "n_active"]].sort_values("step").itertuples(index=False):
            if last is not None and step <= last:
                continue
            now = bool(n > 0)
            if active is not None and now != active:
                out.append((key[0], active, begin, last - begin + 1, size))
                begin, size = step, 0
            if active is None:
                begin = step
            active, last, size = now, int(step), int(size + n)
        state.update((active, int(begin), last, size))
        yield pd.DataFrame(out, columns=["subject", "active", "begin", "duration", "size"])

    kinds = "subject string, active boolean, begin long, duration long, size long"
    rows = counts.select("subject", "step", "n_active").groupBy("subject")
    return rows.applyInPandasWithState(run, kinds, "active boolean, begin long, last long, size long", "append", GroupStateTimeout.NoTimeout)
