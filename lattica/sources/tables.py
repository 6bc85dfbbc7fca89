"""Tables, and the dense panels that are derived from them.

A panel is a DataFrame ``(subject, node, step, value)`` with one row for every
node and step of a subject; steps without data hold 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes, and steps of six hours, of the event panel.
EVENT_NODES, EVENT_STEPS = 16, 120
#: Nodes, and months from January 1995 on, of the line-item panel.
LINE_NODES, LINE_STEPS = 24, 84


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def densify(rows: DataFrame, n_nodes: int, n_steps: int, fill: int | float = 0) -> DataFrame:
    """``rows(subject, node, step, value)``, one a cell, completed to the full grid.

    The grid is generated from the distinct subjects by sequences; missing cells
    hold ``fill``.  A row outside the grid is an error.
    """
    inside = F.col("node").between(0, n_nodes - 1) & F.col("step").between(0, n_steps - 1)
    rows = rows.withColumn("step", F.when(inside, F.col("step")).otherwise(F.raise_error(F.concat(F.lit("outside the grid: node "), F.coalesce(F.col("node").cast("string"), F.lit("null")), F.lit(", step "), F.coalesce(F.col("step").cast("string"), F.lit("null")))).cast("long")))
    kind = rows.schema["value"].dataType
    subjects = rows.select("subject").distinct()
    grid = subjects.select("subject", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_nodes - 1).cast("long"))).alias("node"))
    grid = grid.select("subject", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_steps - 1).cast("long"))).alias("step"))
    filled = F.coalesce(F.col("value"), F.lit(fill).cast(kind))
    return grid.join(rows, ["subject", "node", "step"], "left").select("subject", "node", "step", filled.alias("value"))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents by event type, user modulo 16 and six hours of January 2024."""
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    step = F.floor((_micros(F.col("ts")) - start) / F.lit(21_600_000_000)).cast("long")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("subject"), (F.col("user_id") % EVENT_NODES).alias("node"), step.alias("step"))
    return densify(rows.agg(cents.alias("value")), EVENT_NODES, EVENT_STEPS)


def line_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by return flag, supplier modulo 24 and month of shipping."""
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("subject"), (F.col("l_suppkey") % LINE_NODES).alias("node"), month.alias("step"))
    return densify(rows.agg(F.sum(F.col("l_quantity").cast("long")).alias("value")), LINE_NODES, LINE_STEPS)


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (vec_id, label, feature, value) of the embeddings' components."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("feature", "x"))
    return rows.select("vec_id", "label", F.col("feature").cast("long").alias("feature"), F.col("x").cast("double").alias("value"))
