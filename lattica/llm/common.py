"""Helpers that several operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.scratch import remove_at_end, shared_dir  # noqa: F401  the operators take it from here

#: White space of the word rules: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most rows of a table that may be broadcast; all such tables have narrow rows.
BROADCAST_ROWS = 20_000
ARROW = "spark.sql.execution.arrow"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get by bytes, as whole texts stand in them.

    Settings that the session names itself stay.
    """
    for key, value in ((f"{ARROW}.maxBytesPerBatch", str(4 << 20)), (f"{ARROW}.maxRecordsPerBatch", "512")):
        if spark.conf.get(key) in ("10000", str((1 << 31) - 1), str(64 << 20), "64MB", "2147483647b", "67108864b"):
            spark.conf.set(key, value)


#: Folders that ``cut`` has written and nothing has removed, in order.
written: list[str] = []


def swept(since: int, *results: DataFrame) -> None:
    """Remove what was cut after the first ``since`` tables and is not read by ``results``."""
    if len(written) == since:
        return
    read = {m[0] for df in results for f in df.inputFiles() if (m := re.search(r"cut-[0-9a-f]{32}", f))}
    for path in [p for p in written[since:] if p[-36:] not in read]:
        remove(results[0].sparkSession, path)
        written.remove(path)


def cut(df: DataFrame, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, without its lineage.

    A written table also has a known size, by which Spark chooses join
    strategies, and none of the constraints that a plan's history piles up.
    ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    remove_at_end(spark, path)
    written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``rows`` rows.

    Beyond that the hint is left out, and Spark shuffles the join.  ``df``
    should be cut before, as it is counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def count_words(c: Column) -> Column:
    """Number of runs of characters other than white space; null counts as none."""
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
