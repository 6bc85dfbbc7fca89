"""Raw matrices of steps by nodes as a data source: ``spark.read.format("series")``.

Files of little-endian doubles, a step after another, are planned by byte ranges,
so that a large file is read by many tasks.  Filters on subject and scan leave
out files, filters on steps leave out ranges, and filters on nodes leave out
columns before any row is made.  ``spark.read.format("series").option("nodes", n).load(path)``
gives (subject, scan, node, step, value).

:func:`save_series` writes panels back through the same format: every scan is
written beside its place by a task, and the driver moves the files there once
all tasks are through, so that a run that was broken off leaves nothing behind.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .stores import opened

SCHEMA = "subject string, scan string, node long, step long, value double"
FILES = "subject string, scan string, x binary"
#: Steps in a batch.
BATCH = 1024


@dataclass
class Piece(InputPartition):
    """A range of steps of one file."""

    name: str
    subject: str
    scan: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote: where they are, and where they belong."""

    moves: list[tuple[str, str]]


class SeriesSource(DataSource):
    """Options: path, nodes (columns of a matrix), bytes (of a range; 32 MB), file_name (a pattern with subject and scan)."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SeriesReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if schema.fieldNames() != ["subject", "scan", "x"]:
            raise ValueError(f"the columns to write are {FILES}")
        return SeriesWriter(self.options["path"], overwrite)


class SeriesReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.nodes = options["path"], int(options["nodes"])
        self.bytes = int(options.get("bytes", 32 << 20))
        self.pattern = options.get("file_name", r"ts_([^_]+)_(\w+)\.bin")
        self.only: dict[str, set] = {}
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]):
        """Take the filters that files, ranges and columns can answer; the others are given back."""
        for f in filters:
            column = f.attribute[0]
            if isinstance(f, IsNotNull):
                continue  # nothing is null here
            if isinstance(f, (EqualTo, In)) and column in ("subject", "scan", "node"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only.get(column, values) & values
            elif column == "step" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, int(f.value) + 1 - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        where, at = opened(self.path)
        width, out = 8 * self.nodes, []
        steps = max(1, self.bytes // width)
        for info in where.get_file_info(fs.FileSelector(at, recursive=True)):
            named = re.fullmatch(self.pattern, info.base_name) if info.is_file else None
            if named is None or any(c in self.only and v not in self.only[c] for c, v in (("subject", named[1]), ("scan", named[2]))):
                continue
            if info.size % width:
                raise ValueError(f"{info.path} does not hold whole steps of {self.nodes} nodes")
            end = min(self.high, info.size // width)
            out += [Piece(info.path, named[1], named[2], a, min(end, a + steps)) for a in range(self.low, end, steps)]
        return out or [Piece("", "", "", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.first >= piece.last:
            return
        where, _ = opened(self.path)
        nodes = np.array([n for n in range(self.nodes) if n in self.only.get("node", range(self.nodes))], np.int64)
        with where.open_input_file(piece.name) as f:
            for a in range(piece.first, piece.last, BATCH):
                b = min(piece.last, a + BATCH)
                x = np.frombuffer(f.read_at(8 * self.nodes * (b - a), 8 * self.nodes * a), "<f8").reshape(b - a, self.nodes)[:, nodes]
                n = x.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece.subject] * n, pa.string()), pa.array([piece.scan] * n, pa.string()), pa.array(np.tile(nodes, b - a)), pa.array(np.repeat(np.arange(a, b), len(nodes))), pa.array(x.ravel())],
                    names=["subject", "scan", "node", "step", "value"],
                )


class SeriesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, at = opened(self.path)
        where.create_dir(f"{at}/_writing", recursive=True)
        moves = []
        for batch in batches:
            for subject, scan, x in zip(*(batch[c].to_pylist() for c in ("subject", "scan", "x")), strict=True):
                name = f"{at}/_writing/{uuid.uuid4().hex}"
                with where.open_output_stream(name) as f:
                    f.write(x)
                moves.append((name, f"{at}/ts_{subject}_{scan}.bin"))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        where, at = opened(self.path)
        if self.overwrite:
            for info in where.get_file_info(fs.FileSelector(at)):
                if info.is_file and info.base_name.endswith(".bin"):
                    where.delete_file(info.path)
        for m in messages:
            for a, b in m.moves if m else ():
                where.move(a, b)
        where.delete_dir(f"{at}/_writing")

    def abort(self, messages: list[Written | None]) -> None:
        where, at = opened(self.path)
        if where.get_file_info(f"{at}/_writing").type != fs.FileType.NotFound:
            where.delete_dir(f"{at}/_writing")


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it see filters."""
    spark.dataSource.register(SeriesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def save_series(panel: DataFrame, path: str, n_nodes: int, n_steps: int, value: str = "value", mode: str = "append") -> None:
    """Write ``panel(subject, scan, node, step, value)`` as one matrix a scan; cells that are missing hold 0."""
    register(panel.sparkSession)

    def matrix(group: pa.Table) -> pa.Table:
        x = np.zeros((n_steps, n_nodes))
        x[group["step"].to_numpy(), group["node"].to_numpy()] = group["value"].fill_null(0.0).to_numpy()
        return pa.table({"subject": group["subject"].slice(0, 1), "scan": group["scan"].slice(0, 1), "x": pa.array([x.astype("<f8").tobytes()], pa.binary())})

    matrix.__annotations__ = {"group": pa.Table, "return": pa.Table}
    rows = panel.select(F.col("subject").cast("string").alias("subject"), F.col("scan").cast("string").alias("scan"), F.col("node").cast("long").alias("node"), F.col("step").cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    rows.groupBy("subject", "scan").applyInArrow(matrix, FILES).write.format("series").mode(mode).save(path)
