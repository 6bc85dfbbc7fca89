"""Permutation nulls of correlations, a million permutations at a time.

Nothing that is permuted is shuffled.  Each key's values stand in one row, a
matrix of units by columns; a task takes a batch of such rows and a range of
permutations, draws these from its seed, multiplies, and keeps of each key only
how many permuted correlations lie as far from 0 as the seen one, and the largest
few.  Counts add up and lists of the largest merge, so that the permutations of
a key may be dealt to many tasks.

The units (subjects, or nodes) are a list that every task holds, and a key's
matrix (units times columns) stands in one row: both are bounded by the study,
not by its permutations.  Where units grow with the tables, :func:`many_units_summary`
deals them to tasks as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .moments import ratio
from .relate import ranked_by_digest

#: Numbers that a task gathers at once.
GATHERED = 4_000_000
#: Permutations that are drawn at once.
DRAWN = 1024


def partners(units: Sequence, first: int, count: int, draw: str, seed: int, tag: str) -> np.ndarray:
    """Permutations ``first`` .. as rows of places in ``units``: whose value each unit gets.

    ``seeded`` draws depend on the seed and the permutation's number; ``digest``
    ones are those of :func:`lattica.operators.relate.permuted`, the same in every engine.
    """
    n = len(units)
    if draw == "seeded":
        out = np.empty((count, n), np.int32)
        for block in range(first // DRAWN, (first + count - 1) // DRAWN + 1):
            rng = np.random.default_rng([seed, *tag.encode(), block])
            own = rng.permuted(np.tile(np.arange(n, dtype=np.int32), (DRAWN, 1)), axis=1)
            a, b = max(first, block * DRAWN), min(first + count, (block + 1) * DRAWN)
            out[a - first : b - first] = own[a - block * DRAWN : b - block * DRAWN]
        return out
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    place = np.array(sorted(range(n), key=lambda i: (md5(str(units[i])), units[i])))
    out = np.empty((count, n), np.int32)
    for p in range(count):
        out[p, place] = sorted(range(n), key=lambda i: (md5(f"{tag}{units[i]}-{first + p}"), units[i]))
    return out


def correlated(x: np.ndarray, y: np.ndarray, units: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """Correlations of x with y at permuted units, for keys by permutations.

    ``x`` and ``y`` are keys by units by columns, with not-a-number where a cell
    is missing; ``units`` (and ``columns``, if these move too) have a row for each permutation.
    """
    keys, n, width = x.shape
    known_x, known_y = ~np.isnan(x), ~np.isnan(y)

    def centred(v: np.ndarray, known: np.ndarray) -> np.ndarray:
        seen = known.sum(axis=(1, 2), keepdims=True)
        v = np.where(known, v, 0.0)
        return np.where(known, v - v.sum(axis=(1, 2), keepdims=True) / np.maximum(seen, 1), 0.0)

    x, y = centred(x, known_x), centred(y, known_y)

    def moved(v: np.ndarray, at: slice) -> np.ndarray:
        """keys, permutations, units times columns"""
        out = v[:, units[at]] if columns is None else v[:, units[at][:, :, None], columns[at][:, None, :]]
        return out.reshape(keys, -1, n * width)

    step = max(1, GATHERED // max(1, keys * n * width))
    out = np.empty((keys, len(units)))
    if known_x.all() and known_y.all():
        size = np.sqrt((x * x).sum(axis=(1, 2)) * (y * y).sum(axis=(1, 2)))
        with np.errstate(all="ignore"):
            x = x / size[:, None, None]
        flat = x.reshape(keys, -1)
        if width == 1 and (y == y[:1]).all():  # one variable for all keys: a product of matrices
            for a in range(0, len(units), DRAWN):
                out[:, a : a + DRAWN] = flat @ y[0, units[a : a + DRAWN], 0].T
        else:
            for a in range(0, len(units), step):
                out[:, a : a + step] = np.einsum("kbu,ku->kb", moved(y, slice(a, a + step)), flat)
        out[~(size > 0)] = np.nan
        return out
    fx, mx = x.reshape(keys, -1), known_x.reshape(keys, -1).astype(float)
    for a in range(0, len(units), step):
        at = slice(a, a + step)
        gy, my = moved(y, at), moved(known_y.astype(float), at)
        sums = lambda p, q: np.einsum("kbu,ku->kb", p, q)
        seen, sx, sy, sxy = sums(my, mx), sums(my, fx), sums(gy, mx), sums(gy, fx)
        vx, vy = sums(my, fx * fx) * seen - sx * sx, sums(gy * gy, mx) * seen - sy * sy
        with np.errstate(all="ignore"):
            out[:, at] = np.where((vx > 1e-12) & (vy > 1e-12), (seen * sxy - sx * sy) / np.sqrt(vx * vy), np.nan)
    return out


def permuted_summary(
    rows: DataFrame, unit: str, by: Sequence[str], x: str, y: str, n: int, top: int, column: str | None = None, shuffle: str = "units",
    draw: str = "seeded", tags: tuple[str, str] = ("", "n"), digits: int | None = None, parts: int | None = None, seed: int = 1,
) -> DataFrame:
    """Rows (by, corr, n_null, n_beyond, top): the seen correlation of x and y, of how many permutations there is one,
    how many lie as far from 0, and the ``top`` largest distances, greatest first.

    A permutation moves all of a unit's values together.  A key with several
    cells of a unit has a ``column`` to tell them apart (nodes of a subject), and
    is correlated over all of them; with ``shuffle="both"`` columns are permuted
    too.  A cell that stands twice counts by its mean; rows without unit or
    column are left out, and so are null values.  With ``digits`` correlations
    are rounded before they are compared.  ``parts`` cuts the permutations of a
    key for as many tasks; by default as many as the cluster can use.
    """
    spark = rows.sparkSession
    by = [*by]
    rows = rows.where(F.col(unit).isNotNull()).withColumn("_c", F.col(column) if column else F.lit(0)).where(F.col("_c").isNotNull())
    cells = rows.groupBy(*by, unit, "_c").agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    units = sorted(r[0] for r in rows.select(unit).distinct().collect())  # the bounded lists
    columns = sorted(r[0] for r in rows.select("_c").distinct().collect())
    n_units, width = len(units), len(columns)
    own = F.struct("_x", "_y", F.col(unit).alias("u"), "_c")
    matrix = cells.groupBy(*by).agg(F.collect_list(own).alias("_m"))
    place_u, place_c = {u: k for k, u in enumerate(units)}, {c: k for k, c in enumerate(columns)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for cell in batch["_m"]:
                m = np.full((2, n_units, width), np.nan)
                got = cell.values
                at = [place_u[u] for u in got.field("u").to_pylist()], [place_c[c] for c in got.field("_c").to_pylist()]
                m[0][at], m[1][at] = (got.field(f).to_numpy(zero_copy_only=False).astype(float) for f in ("_x", "_y"))
                data.append(m.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch[b] for b in by), pa.array(data, pa.binary())], names=[*by, "_m"])

    kinds = "".join(f"`{b}` {rows.schema[b].dataType.simpleString()}, " for b in by)
    matrices = written(matrix.mapInArrow(pack, f"{kinds}_m binary"))
    n_keys = max(1, matrices.count())
    parts = parts or max(1, min(-(-n // DRAWN), -(-4 * spark.sparkContext.defaultParallelism // -(-n_keys // 64))))
    size = -(-n // parts)
    tasks = matrices.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if parts > 1:  # the rows of a part side by side, so that a batch holds many keys of one
        tasks = tasks.repartition(4 * spark.sparkContext.defaultParallelism, "_part", *by).sortWithinPartitions("_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounded = (lambda v: np.round(v, digits)) if digits is not None else (lambda v: v)
        for batch in batches:
            which = batch["_part"].to_numpy(zero_copy_only=False)
            for part in np.unique(which):
                at = np.flatnonzero(which == part)
                m = np.stack([np.frombuffer(batch["_m"][int(i)].as_py()).reshape(2, n_units, width) for i in at])
                x, y = m[:, 0], m[:, 1]
                seen = rounded(correlated(x, y, np.arange(n_units)[None], np.arange(width)[None] if shuffle == "both" else None)[:, 0])
                first, count = int(part) * size, max(0, min(size, n - int(part) * size))
                found, beyond, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.full((len(at), 0), 0.0)
                for a in range(first, first + count, DRAWN):
                    more = min(DRAWN, first + count - a)
                    moves = partners(units, a, more, draw, seed, tags[0])
                    cols = partners(columns, a, more, draw, seed, tags[1]) if shuffle == "both" else None
                    far = np.abs(rounded(correlated(x, y, moves, cols)))
                    ok = ~np.isnan(far)
                    found += ok.sum(axis=1)
                    beyond += (ok & (far >= np.abs(seen)[:, None])).sum(axis=1)
                    best = np.concatenate([best, np.where(ok, far, -1.0)], axis=1)
                    if best.shape[1] > top:
                        best = -np.partition(-best, top - 1, axis=1)[:, :top]
                lists = [np.sort(b[b >= 0])[::-1].tolist() for b in best]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[b].take(pa.array(at)) for b in by), pa.array(seen, mask=np.isnan(seen)), pa.array(found), pa.array(beyond), pa.array(lists, pa.list_(pa.float64()))],
                    names=[*by, "corr", "n_null", "n_beyond", "top"],
                )

    if not n_units:
        return spark.createDataFrame([], f"{kinds}corr double, n_null long, n_beyond long, top array<double>")
    out = tasks.mapInArrow(run, f"{kinds}corr double, n_null long, n_beyond long, top array<double>")
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, top)
    return out.groupBy(*by).agg(F.max("corr").alias("corr"), F.sum("n_null").alias("n_null"), F.sum("n_beyond").alias("n_beyond"), merged.alias("top"))


def many_units_summary(rows: DataFrame, unit: str, by: Sequence[str], x: str, y: str, n: int, top: int, tag: str = "", bucket: int = 1 << 16, block: int = 1 << 13) -> DataFrame:
    """:func:`permuted_summary` of ``digest`` draws for any number of units, where y is one variable of the units, whatever cells a key has.

    Units stand in blocks by their places, and each permutation's drawn order is sorted by ranges of
    digests of about ``bucket`` units, cut into the same blocks, and multiplied with them; only sums of
    blocks are added up.  No task, list or row holds all units; the keys of a unit are its row.
    """
    spark, by = rows.sparkSession, [*by]
    own = rows.where(F.col(unit).isNotNull()).select(*by, F.col(unit).alias("_u"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    names = spark.createDataFrame([(k, *r) for k, r in enumerate(own.select(*by).distinct().collect())], "_k int, " + ", ".join(f"`{b}` {own.schema[b].dataType.simpleString()}" for b in by))
    cells = own.repartition("_u").groupBy("_u", *by).agg(F.avg("_x").alias("_x"), F.avg("_y").alias("_y")).join(F.broadcast(names), by)  # the bounded list
    wide = written(cells.groupBy("_u").agg(F.collect_list(F.struct("_k", "_x")).alias("_m"), F.avg("_y").alias("_y")))
    n_units, n_keys, middle_y = wide.agg(F.count("*"), F.max(F.array_max(F.transform("_m", lambda c: c["_k"]))), F.avg("_y")).first()
    n_keys, middle_y = 0 if n_keys is None else n_keys + 1, middle_y or 0.0
    middle = np.zeros(n_keys)
    for k, m in wide.select(F.explode("_m").alias("c")).groupBy("c._k").agg(F.avg("c._x")).collect():
        middle[k] = m or 0.0
    buckets = max(1, -(-n_units // bucket))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, float]] = []

        def full() -> Iterator[pa.RecordBatch]:
            texts, values = [f"{tag}{u}-".encode() for u, _ in held], np.array([v for _, v in held], "<f8")
            for p in range(n):
                end = str(p).encode()
                raw = np.frombuffer(b"".join([hashlib.md5(t + end).digest() for t in texts]), "V16")
                to = (np.frombuffer(raw.tobytes(), ">u4")[::4].astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)
                at = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[at], np.arange(buckets + 1))
                kept = [(k, at[a:b]) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(kept), p, np.int32)), pa.array(np.array([k for k, _ in kept], np.int64)), pa.array([raw[i].tobytes() for _, i in kept], pa.binary()), pa.array([values[i].tobytes() for _, i in kept], pa.binary())],
                    names=["p", "bucket", "digests", "y"],
                )

        for batch in batches:
            held += zip(batch["_u"].to_pylist(), batch["_y"].to_numpy(zero_copy_only=False).astype(float), strict=True)
            if len(held) >= bucket:
                yield from full()
                held = []
        if held:
            yield from full()

    def in_order(group: pa.Table) -> pa.Table:
        digests = np.frombuffer(b"".join(group["digests"].to_pylist()), ">u8").reshape(-1, 2)
        values = np.frombuffer(b"".join(group["y"].to_pylist()), "<f8")
        own = values[np.lexsort((digests[:, 1], digests[:, 0]))]
        return pa.table({"p": group["p"][:1], "bucket": group["bucket"][:1], "n": pa.array([len(own)], pa.int64()), "y": pa.array([own.tobytes()], pa.binary())})

    in_order.__annotations__ = {"group": pa.Table, "return": pa.Table}
    drawn = wide.select(F.col("_u").cast("string").alias("_u"), "_y").mapInArrow(draw, "p int, bucket long, digests binary, y binary")
    drawn = written(drawn.groupBy("p", "bucket").applyInArrow(in_order, "p int, bucket long, n long, y binary"))
    lower = F.coalesce(F.sum("n").over(W.partitionBy("p").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a bucket
    drawn = drawn.join(drawn.select("p", "bucket", lower.alias("first")), ["p", "bucket"]).select("p", "first", "y")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, first, data in zip(*(batch[c].to_pylist() for c in ("p", "first", "y")), strict=True):
                end = first + len(data) // 8
                for b in range(first // block, -(-end // block)):
                    start, stop = max(first, b * block), min(end, (b + 1) * block)
                    out.append((b, p, start - b * block, data[8 * (start - first) : 8 * (stop - first)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["b", "p", "at", "y"])

    def products(units: pa.Table, moved: pa.Table) -> pa.Table:
        xs, ys = np.full((n_keys, block), np.nan), np.full((n + 1, block), np.nan)
        at, lists = units["at"].to_numpy(), units["_m"].combine_chunks()
        flat = lists.flatten()
        xs[flat.field("_k").to_numpy(), np.repeat(at, lists.value_lengths().to_numpy())] = flat.field("_x").to_numpy(zero_copy_only=False)
        ys[n, at] = units["_y"].to_numpy()  # the last one moves nothing
        for p, a, data in zip(*(moved[c].to_pylist() for c in ("p", "at", "y")), strict=True):
            ys[p, a : a + len(data) // 8] = np.frombuffer(data, "<f8")
        mx, my = (~np.isnan(xs)).astype(float), (~np.isnan(ys)).astype(float)
        xs, ys = np.where(mx > 0, xs - middle[:, None], 0.0), np.where(my > 0, ys - middle_y, 0.0)
        sums = np.stack([mx @ my.T, xs @ my.T, mx @ ys.T, xs @ ys.T, (xs * xs) @ my.T, mx @ (ys * ys).T], axis=1)
        return pa.table({"_k": pa.array(np.arange(n_keys, dtype=np.int32)), "sums": pa.array([v.tobytes() for v in sums], pa.binary())})

    products.__annotations__ = {"units": pa.Table, "moved": pa.Table, "return": pa.Table}

    def summed(group: pa.Table) -> pa.Table:
        total = np.zeros((6, n + 1))
        for data in group["sums"]:
            total += np.frombuffer(data.as_py()).reshape(6, n + 1)
        seen, sx, sy, sxy, sxx, syy = total
        vx, vy = seen * sxx - sx * sx, seen * syy - sy * sy
        with np.errstate(all="ignore"):
            c = np.where((vx > 1e-12) & (vy > 1e-12), (seen * sxy - sx * sy) / np.sqrt(vx * vy), np.nan)
        far = np.abs(c[:n])
        ok = ~np.isnan(far)
        best = np.sort(far[ok])[::-1][:top].tolist()
        return pa.table({"_k": group["_k"][:1], "corr": pa.array(c[n:], mask=np.isnan(c[n:])), "n_null": pa.array([int(ok.sum())]), "n_beyond": pa.array([int((far[ok] >= abs(c[n])).sum())]), "top": pa.array([best], pa.list_(pa.float64()))})

    summed.__annotations__ = {"group": pa.Table, "return": pa.Table}
    placed = ranked_by_digest(wide.select("_u", "_m", "_y", F.lit(0).alias("_g"), F.md5(F.col("_u").cast("string").cast("binary")).alias("_o")), "_g", "_o", "_u", max(64, buckets))
    placed = placed.select(F.floor((F.col("rank") - 1) / block).alias("b"), ((F.col("rank") - 1) % block).cast("int").alias("at"), "_m", F.coalesce("_y", F.lit(float("nan"))).alias("_y"))
    sums = placed.groupBy("b").cogroup(drawn.mapInArrow(cut, "b long, p int, at int, y binary").groupBy("b")).applyInArrow(products, "_k int, sums binary")
    out = sums.groupBy("_k").applyInArrow(summed, "_k int, corr double, n_null long, n_beyond long, top array<double>")
    return out.join(F.broadcast(names), "_k").select(*by, "corr", "n_null", "n_beyond", "top")


def tested(summary: DataFrame, n: int, n_tests: int, alpha: float) -> DataFrame:
    """``summary`` with p, p_corrected and the Bonferroni critical value, the k-th largest distance of the null for
    k = max(1, floor(alpha / n_tests * n)); a summary with a shorter list has the last of it."""
    k = critical_place(n, n_tests, alpha)
    p = ratio(F.col("n_beyond"), F.col("n_null"))
    critical = F.when(F.size("top") > 0, F.element_at("top", F.least(F.lit(k), F.greatest(F.size("top"), F.lit(1)))))
    return summary.withColumns({"p": p, "critical": critical, "p_corrected": F.least(p * n_tests, F.lit(1.0))}).drop("n_beyond", "n_null", "top")


def critical_place(n: int, n_tests: int, alpha: float) -> int:
    return max(1, int(alpha / n_tests * n))


def quantile_of_top(share: float, n: int) -> tuple[int, Column]:
    """How long a list of the largest has to be for the ``share``-quantile (interpolated) of n values, and the quantile from it."""
    at = (n - 1) * (1 - share)
    low, rest = int(at), at - int(at)
    a, b = (F.try_element_at("top", F.lit(low + 1 + d)) for d in (0, 1))
    return low + 2, a if rest == 0 else a + (b - a) * rest
