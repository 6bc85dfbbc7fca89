"""Joins, set operations, top-k and deterministic permutations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .neighbourhood import near_moments


def present(rows: DataFrame, others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Semi join: rows whose keys stand in ``others``."""
    return rows.join(others, list(on), "left_semi")


def missing(rows: DataFrame, others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Anti join: rows whose keys do not stand in ``others``; also what a resumed grid has yet to run."""
    return rows.join(others, list(on), "left_anti")


def in_band(rows: DataFrame, keys: Sequence[str], axes: dict[str, float], id_: str = "id") -> DataFrame:
    """Pairs of rows of one key whose every axis differs by at most its half width (rows match themselves).

    Axes are cut into cells of the half width; the left side is looked up in
    its own and the neighbouring cells of every axis, so that the join has
    equality keys, and the exact differences are checked after it.
    """
    cell = lambda c, w: F.floor(F.col(c) / w).cast("long")
    left, right = rows, rows.select(*keys, *[F.col(c).alias(f"{c}_other") for c in (id_, *axes)])
    for n, (c, w) in enumerate(axes.items()):
        left = left.withColumn(f"_cell{n}", F.explode(F.array(*[cell(c, w) + d for d in (-1, 0, 1)])))
        right = right.withColumn(f"_cell{n}", cell(f"{c}_other", w))
    on = [*keys, *[f"_cell{n}" for n in range(len(axes))]]
    close = [F.abs(F.col(c) - F.col(f"{c}_other")) <= w for c, w in axes.items()]
    out = left.join(right, on)
    for c in close:
        out = out.where(c)
    return out.drop(*[f"_cell{n}" for n in range(len(axes))])


def band_links(rows: DataFrame, keys: Sequence[str], axes: dict[str, float], id_: str = "id") -> DataFrame:
    """``rows`` with class_id and n_links: the least id of the rows that are equal in keys and axes, and how many rows
    :func:`in_band` pairs with the row (0 for a row with a null key or axis).

    One row for each of ``rows``: links are counted between cells and points, not made.
    """
    on = [*keys, *axes]
    classes = rows.groupBy(*on).agg(F.min(id_).alias("class_id"), F.count("*").alias("_rows"))
    linked = near_moments(classes, keys, axes, "_rows", weight="_rows").select(*[F.col(c).alias(f"_{c}") for c in on], "class_id", F.col("n_near").alias("n_links"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
    return rows.join(linked, same).drop(*[f"_{c}" for c in on])


def nearest(rows: DataFrame, value: str, grid: Sequence[float]) -> DataFrame:
    """Add the position and value of the nearest grid point; ties go to the earlier one.  The grid is a list in the plan."""
    points = F.array(*[F.struct(F.abs(F.col(value) - float(g)).alias("d"), F.lit(n).cast("long").alias("n"), F.lit(float(g)).alias("g")) for n, g in enumerate(grid)])
    best = F.array_min(points)
    return rows.withColumn("grid_index", best["n"]).withColumn("grid_value", best["g"])


def best(rows: DataFrame, keys: Sequence[str], goodness: str, carry: Sequence[str], tie: str, largest: bool = True) -> DataFrame:
    """The row of the best ``goodness`` of each key; not-a-number and null lose, ties go to the least ``tie``."""
    g = F.col(goodness).cast("double")
    clean = F.when(g.isNull() | F.isnan(g), F.lit(float("-inf"))).otherwise(g if largest else -g)
    whole = F.struct(tie, goodness, *[c for c in carry if c not in (tie, goodness)])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(clean, -F.col(tie))).alias("_b")).select(*keys, "_b.*")


def top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, with their rank; ranks are limited before rows are gathered."""
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def ranked_by_digest(rows: DataFrame, group: str, digest: str, tie: str, buckets: int = 64) -> DataFrame:
    """Add ``rank`` (from 1) in each group by a hexadecimal digest, ties by ``tie``.

    Digests are uniform, so rows are counted by ranges of them, and a window
    ranks inside a range: no task sorts a whole group.
    """
    bucket = F.floor(F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("long")
    rows = rows.withColumn("_b", bucket)
    counts = rows.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, "_b", before.alias("_before"))  # at most ``buckets`` rows a group
    inside = F.row_number().over(W.partitionBy(group, "_b").orderBy(digest, tie))
    return rows.withColumn("_i", inside).join(counts, [group, "_b"]).withColumn("rank", (F.col("_before") + F.col("_i")).cast("long")).drop("_b", "_i", "_before")


def permuted(ids: DataFrame, key: str, n_permutations: int, name: str = "perm", tag: str = "") -> DataFrame:
    """Rows (perm, key, partner): in each permutation every key gets the key at its rank of a digest order.

    Keys stand in the order of md5(key), and are drawn in that of md5(tag key-perm): the
    same in every engine and run.
    """
    many = ids.select(key).distinct().withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_permutations - 1).cast("long"))))
    digest = F.md5(F.concat(F.lit(tag), F.col(key).cast("string"), F.lit("-"), F.col(name).cast("string")).cast("binary"))
    place = F.md5(F.col(key).cast("string").cast("binary"))
    ranked = lambda c, out: ranked_by_digest(many.select(name, key, c.alias("_o")), name, "_o", key).select(name, F.col(key).alias(out), "rank")
    return ranked(place, key).join(ranked(digest, "partner"), [name, "rank"]).drop("rank")


def endpoints(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Each edge with the features of both its nodes, as ``<feature>_i`` and ``<feature>_j``."""
    for end in ("i", "j"):
        edges = edges.join(nodes.select(*keys, F.col("node").alias(end), *[F.col(f).alias(f"{f}_{end}") for f in features]), [*keys, end])
    return edges


def neighbour_mean(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], weight: str, feature: str) -> DataFrame:
    """Message passing: the edge-weighted mean of a feature over each node's neighbours."""
    both = edges.select(*keys, F.col("i").alias("node"), F.col("j").alias("_n"), weight).unionByName(edges.select(*keys, F.col("j").alias("node"), F.col("i").alias("_n"), weight))
    found = both.join(nodes.select(*keys, F.col("node").alias("_n"), feature), [*keys, "_n"])
    return found.groupBy(*keys, "node").agg((F.sum(F.col(weight) * F.col(feature)) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0))).alias("message"))


def region_mean(voxels: DataFrame, regions: DataFrame, value: str = "value") -> DataFrame:
    """Parcellation: the mean over the voxels of each region and step; voxels of no region are left out."""
    return voxels.join(regions, "voxel").groupBy("region", "step").agg(F.avg(value).alias("value"))


def region_image(voxels: DataFrame, values: DataFrame, default: float = 0.0) -> DataFrame:
    """The reverse look-up: each voxel with its region's value, ``default`` where there is none."""
    return voxels.join(values, "region", "left").withColumn("value", F.coalesce("value", F.lit(default)))
