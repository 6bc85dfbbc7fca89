"""Sums over the rows near each row, without making the pairs.

Two cells of a grid either lie so close that all their rows are near one another,
or so far apart that none are, or neither.  In the first case the sums of one
cell are added to the other as they are; only in the last one the cells are cut in
halves, and once few rows are left in a pair of cells these are compared
themselves.  Rows with equal coordinates are one point with a weight, so that a
full cell always comes apart.  The number of comparisons is that of the rows at
the borders of the neighbourhoods, not that of near pairs, and no pair of cells
brings more than ``limit`` of them to a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Halvings after which cells are compared row by row in any case.
DEEPEST = 40


def near_moments(rows: DataFrame, keys: Sequence[str], axes: Mapping[str, float], value: str, limit: int = 4096, deepest: int = DEEPEST, weight: str | None = None) -> DataFrame:
    """``rows`` with n_near, mean_near and sd_near: count, mean and sample standard deviation of ``value`` over the rows of
    the same key that differ by at most its half width on every axis, the row itself included.

    A null value is not counted; a row with a null key or coordinate has n_near 0,
    and mean and deviation are null where there are no (or less than two) values.
    A row with a whole-number ``weight`` stands for so many.
    """
    keys, axes = [*keys], dict(axes)
    at = [f"_x{i}" for i in range(len(axes))]
    cell = [f"_c{i}" for i in range(len(axes))]
    key = [f"_k{i}" for i in range(len(keys))]
    fine = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, *axes]])
    own = rows.where(fine).select(*[F.col(k).alias(n) for k, n in zip(keys, key, strict=True)], *[F.col(a).cast("double").alias(n) for a, n in zip(axes, at, strict=True)], F.col(value).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    centre = own.groupBy(*key).agg(F.avg("v").alias("_m")) if key else own.agg(F.avg("v").alias("_m"))
    centre = written(centre)
    # values are moved to their key's mean, so that sums of squares lose no digits
    moved = (own.join(centre, key) if key else own.crossJoin(F.broadcast(centre))).withColumn("v", F.col("v") - F.col("_m"))
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")]
    points = written(moved.groupBy(*key, *at).agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("w"))), F.lit(0).cast("long")).alias("n"), F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("v") * F.col("v") * F.col("w")), F.lit(0.0)).alias("q"),
    ))
    widths = list(axes.values())

    def placed(level: int) -> DataFrame:
        return points.withColumns({c: F.floor(F.col(x) / float(w) * float(1 << level)).cast("long") for c, x, w in zip(cell, at, widths, strict=True)})

    def cells(level: int) -> DataFrame:
        return written(placed(level).groupBy(*key, *cell).agg(F.count("*").alias("p"), *sums))

    def named(df: DataFrame, side: str, *more: str) -> DataFrame:
        return df.select(*key, *[F.col(c).alias(f"{side}{c}") for c in (*cell, *more)])

    def same(side: str) -> list[str]:
        return [*key, *[f"{side}{c}" for c in cell]]

    def parents(df: DataFrame, side: str) -> DataFrame:
        return df.withColumns({f"_up{side}{c}": F.floor(F.col(f"{side}{c}") / 2).cast("long") for c in cell})

    level, now = 0, cells(0)
    around = now.select(*key, *cell)
    for c in cell:  # all cells that may hold a near row
        around = around.withColumn(f"b{c}", F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2)))
    pairs = around.withColumnsRenamed({c: f"a{c}" for c in cell}).join(named(now, "b"), same("b"))
    inner, exact = [], []
    while True:
        g = 1 << level
        apart = [F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in cell]
        inside = reduce(lambda a, b: a & b, [d <= g - 2 for d in apart])
        outside = reduce(lambda a, b: a | b, [d >= g + 2 for d in apart])
        both = pairs.where(~outside).withColumn("_in", inside).join(named(now, "a", "p"), same("a")).join(named(now, "b", "p", "n", "s", "q"), same("b"))
        both = written(both.withColumn("_few", F.lit(level == deepest) | (F.col("ap") * F.col("bp") <= limit)))
        added = both.where("_in").groupBy(*same("a")).agg(*[F.sum(f"b{c}").alias(c) for c in ("n", "s", "q")])
        inner.append(added.select(*key, F.lit(level).alias("_level"), *[F.col(f"a{c}").alias(c) for c in cell], "n", "s", "q"))
        exact.append(_compared(both.where("not _in and _few"), placed(level), key, at, cell, widths))
        split = both.where("not _in and not _few").select(*key, *[f"{x}{c}" for x in "ab" for c in cell])
        if not split.limit(1).count():
            break
        level, now = level + 1, cells(level + 1)
        for side in "ab":
            up = {f"{side}{c}": f"_up{side}{c}" for c in cell}
            finer = parents(named(now, side), side)
            split = split.withColumnsRenamed(up).join(finer, [*key, *up.values()]).drop(*up.values())
        pairs = split
    whole = reduce(DataFrame.unionByName, inner)
    found = reduce(DataFrame.unionByName, [placed(k).withColumn("_level", F.lit(k)).select(*key, *at, "_level", *cell).join(whole.where(F.col("_level") == k), [*key, "_level", *cell]).select(*key, *at, "n", "s", "q") for k in range(level + 1)] + exact)
    found = found.groupBy(*key, *at).agg(*sums)
    found = (found.join(centre, key) if key else found.crossJoin(F.broadcast(centre)))
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s") / n, F.lit(0.0)) / (F.col("n") - 1)))
    found = found.select(*key, *at, F.col("n").alias("n_near"), (F.col("s") / n + F.col("_m")).alias("mean_near"), spread.alias("sd_near"))
    on: list[Column] = [F.col(k) == F.col(n) for k, n in zip(keys, key, strict=True)] + [F.col(a).cast("double") == F.col(x) for a, x in zip(axes, at, strict=True)]
    out = rows.join(found, reduce(lambda a, b: a & b, on), "left").drop(*key, *at)
    return out.withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def _compared(pairs: DataFrame, placed: DataFrame, key: Sequence[str], at: Sequence[str], cell: Sequence[str], widths: Sequence[float]) -> DataFrame:
    """Sums over the near points of the pairs of cells, by comparing their points."""
    side = lambda x, *more: placed.select(*key, *[F.col(c).alias(f"{x}{c}") for c in (*cell, *at, *more)])
    near = reduce(lambda a, b: a & b, [F.abs(F.col(f"a{x}") - F.col(f"b{x}")) <= float(w) for x, w in zip(at, widths, strict=True)])
    rows = pairs.select(*key, *[f"{x}{c}" for x in "ab" for c in cell]).join(side("a"), [*key, *[f"a{c}" for c in cell]]).join(side("b", "n", "s", "q"), [*key, *[f"b{c}" for c in cell]])
    return rows.where(near).groupBy(*key, *[F.col(f"a{x}").alias(x) for x in at]).agg(*[F.sum(f"b{c}").alias(c) for c in ("n", "s", "q")])
