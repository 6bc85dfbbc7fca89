"""File sources and sinks: raw matrices, id lists, atlases, checkpoints, tables and tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrices(spark: SparkSession, path: str, n_columns: int, pattern: str = "*.bin") -> DataFrame:
    """Rows (path, row, col, value) of raw little-endian double matrices, row by row.

    A file is read by one task; files are of one scan each and of bounded size.
    A ragged tail, shorter than a row, is an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                x = np.frombuffer(content, "<f8").reshape(-1, n_columns)
                for at in range(0, len(x), 4096):
                    block = x[at : at + 4096]
                    yield pd.DataFrame({"path": path, "row": np.repeat(np.arange(at, at + len(block)), n_columns), "col": np.tile(np.arange(n_columns), len(block)), "value": block.ravel()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row long, col long, value double")


def series_panel(matrices: DataFrame, n_steps: int, file_name: str = r"ts_(\d+)_(\w+)\.bin") -> DataFrame:
    """Matrices of steps by nodes as a panel (subject, scan, node, step, value); short scans are padded with 0."""
    name = lambda k: F.regexp_extract("path", file_name, k)
    rows = matrices.select(name(1).cast("long").alias("subject"), name(2).alias("scan"), F.col("col").alias("node"), F.col("row").alias("step"), "value")
    grid = rows.select("subject", "scan", "node").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_steps - 1).cast("long"))).alias("step"))
    return grid.join(rows, ["subject", "scan", "node", "step"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def read_ids(spark: SparkSession, **paths: str) -> DataFrame:
    """Ids of white-space separated list files, one a split, as (split, position, id); position counts within the split."""
    out = None
    for split, path in paths.items():
        one = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("position", "id"))
        one = one.select(F.lit(split).alias("split"), F.col("position").cast("long").alias("position"), F.col("id").cast("long").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


def read_atlas(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return spark.read.csv(path, sep=separator, header=True, schema="name string, x double, y double, z double")


def read_regions(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """Region tables: tab-separated coordinates, value, size and label."""
    return spark.read.csv(path, sep="\t", header=header, schema="x double, y double, z double, value double, size double, label string")


def write_regions(rows: DataFrame, path: str) -> None:
    """The same tables written with a header, numbers to three significant digits."""
    short = lambda c: F.format_string("%.3g", F.col(c).cast("double")).alias(c)
    rows.select(*[short(c) for c in ("x", "y", "z", "value", "size")], "label").write.mode("overwrite").csv(path, sep="\t", header=True)


def save_checkpoint(models: DataFrame, path: str, updates: int) -> None:
    """Models after a number of updates; each number is a partition of its own, written anew if it is there."""
    models.write.mode("overwrite").parquet(f"{path}/updates={updates}")


def last_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The models of the greatest number of updates under ``path``, to resume from."""
    saved = spark.read.parquet(path)
    newest = saved.agg(F.max("updates").alias("u")).first().u
    return saved.where(F.col("updates") == newest)


def tiles(square: DataFrame, side: int) -> DataFrame:
    """Add the tile of each entry of a square matrix."""
    return square.withColumn("tile_i", F.floor(F.col("i") / side).cast("long")).withColumn("tile_j", F.floor(F.col("j") / side).cast("long"))


def write_tiles(square: DataFrame, path: str, side: int) -> None:
    """A square matrix as one folder a tile, so that a reader of a block prunes the rest."""
    at: list[Column] = [F.col("tile_i"), F.col("tile_j")]
    tiles(square, side).repartition(*at).write.mode("overwrite").partitionBy("tile_i", "tile_j").parquet(path)


def read_short_series(spark: SparkSession, path: str, n_nodes: int, pattern: str = "*.bin") -> DataFrame:
    """Series files stored node by node, of any number of steps: rows (path, node, step, value).

    A file is read by one task; a size that is no multiple of ``n_nodes`` is an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                x = np.frombuffer(content, "<f8").reshape(n_nodes, -1)
                for at in range(0, x.shape[1], 4096):
                    block = x[:, at : at + 4096]
                    yield pd.DataFrame({"path": path, "node": np.repeat(np.arange(n_nodes), block.shape[1]), "step": np.tile(np.arange(at, at + block.shape[1]), n_nodes), "value": block.ravel()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, node long, step long, value double")


def stacked_stats(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each file its nodes' means and standard deviations (1/n), and its pairs' mean products (i < j)."""
    from ..operators.moments import product_mean

    v = F.col("value")
    nodes = series.groupBy("path", "node").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
    return nodes, product_mean(series, ("path",), "value")


def pending(grid: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The grid's settings that no finished row has: what a run that was broken off has still to do."""
    return grid.join(finished.select(*keys).distinct(), [*keys], "left_anti")


def run_grid(grid: DataFrame, path: str, keys: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Results of ``run`` for each setting of a grid, one setting a task group, kept under ``path``.

    A setting's result is a file of its own, named by a digest of its keys, that
    its task moves into place as soon as it is through.  So a run that is broken
    off keeps what was finished, the list of files is the log of finished settings,
    and those are not run again, whether they gave rows or not.
    """
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    from .stores import written_whole

    spark = grid.sparkSession
    kind = spark.createDataFrame([], schema).schema
    columns = kind.fieldNames()
    name = F.sha1(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).cast("binary"))
    todo = grid.withColumn("_name", name)
    done = finished_settings(spark, path)
    todo = todo if done is None else todo.join(done, "_name", "left_anti")

    def kept(setting: pd.DataFrame) -> pd.DataFrame:
        own = setting["_name"].iloc[0]
        found = run(setting.drop(columns="_name"))[columns]
        out = io.BytesIO()
        pq.write_table(pa.Table.from_pandas(found, to_arrow_schema(kind), preserve_index=False), out)
        written_whole(f"{path}/part-{own}.parquet", out.getvalue())
        return pd.DataFrame({"n": [len(found)]})

    todo.groupBy("_name").applyInPandas(kept, "n long").agg(F.sum("n")).collect()  # one number
    return spark.read.schema(kind).parquet(path)


def finished_settings(spark: SparkSession, path: str) -> DataFrame | None:
    """Digests (_name) of the settings that are finished under ``path``; nothing if there are none yet."""
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet").load(path)
    except AnalysisException:  # nothing is there yet
        return None
    return files.select(F.regexp_extract("path", r"part-([0-9a-f]{40})\.parquet$", 1).alias("_name"))


def merged(group: DataFrame, individuals: DataFrame) -> DataFrame:
    """Group and individual rows in one table, told apart by ``kind``."""
    return group.withColumn("kind", F.lit("group")).unionByName(individuals.withColumn("kind", F.lit("individual")), allowMissingColumns=True)


def zero_models(spark: SparkSession, n_models: int, n_nodes: int) -> DataFrame:
    """Models without fields and couplings, to be filled: rows model, beta, h, w."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return spark.range(n_models).select(F.col("id").cast("string").alias("model"), F.lit(1.0).alias("beta"), zeros(n_nodes).alias("h"), zeros(n_nodes * n_nodes).alias("w"))


def training_set(series: DataFrame, graphs: DataFrame, features: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """One row a subject and scan: its series by node, its graph and its features, of the subjects that have all three.

    Each is gathered into one array a subject (series by node and step, graph
    by i and j, features by node), as large as one scan.  Nothing is read
    before rows are asked for; ``split`` (a list of ids) is a semi-join in front.
    """
    gather = lambda df, keys, fields, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    if split is not None:
        series = series.join(split.select(F.col("id").alias("subject")), "subject", "left_semi")
    x = gather(series, ["subject", "scan"], ["node", "step", "value"], "series")
    g = gather(graphs, ["subject"], ["i", "j", "w"], "graph")
    names = [c for c in features.columns if c not in ("subject", "node")]
    return x.join(g, "subject").join(gather(features, ["subject"], ["node", *names], "features"), "subject")
