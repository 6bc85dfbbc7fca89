"""Grids, zeta, SQL functions, first states, and the streaming state machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import sampling as K
from lattica.operators import temporal as T
from lattica.streaming import panels


def test_grids_and_zeta(spark):
    x = spark.range(1).select(S.linear_grid(0, 2, 5).alias("a"), S.log_grid(1e-3, 10, 5).alias("b"), S.zeta(F.lit(2.0), F.lit(1)).alias("z")).first()
    assert np.allclose(x.a, np.linspace(0, 2, 5)) and np.allclose(x.b, np.geomspace(1e-3, 10, 5)) and abs(x.z - np.pi**2 / 6) < 1e-9


def test_sql_functions(spark):
    S.register(spark)
    assert [tuple(x) for x in spark.sql("SELECT i, j FROM triu(3) ORDER BY i, j").collect()] == [(0, 1), (0, 2), (1, 2)]
    assert spark.sql("SELECT * FROM triu(1)").count() == 0
    assert abs(spark.sql("SELECT hurwitz_zeta(2.0D, 1.0D) AS z").first().z - np.pi**2 / 6) < 1e-9


def test_first_states(spark):
    models = spark.createDataFrame([("a", 1e-12, [50.0] * 3, [0.0] * 9)], K.MODEL)
    frozen = spark.createDataFrame([("a", 1.0, [-50.0] * 3, [0.0] * 9)], K.MODEL)
    assert {x.state for x in K.simulated_series(frozen, 5, start="negative").collect()} == {-1}
    assert {x.value for x in K.simulated_means(frozen, 5, start="negative").where("i = j").collect()} == {-1.0}
    assert models.count() == 1


def test_streamed_avalanches_are_those_of_the_whole_series(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = [int(v) for v in rng.choice([0, 0, 1, 2], 60)]
    rows = [(s, t, n[t] if s == "a" else n[-t - 1]) for s in ("a", "b") for t in range(60)]
    schema = "subject string, step long, n_active long"
    source, out = tmp_path / "in", str(tmp_path / "out")
    whole = spark.createDataFrame(rows, schema)
    for k in range(4):  # batches that cut runs
        whole.where(F.col("step").between(15 * k, 15 * k + 14)).coalesce(1).write.mode("append").parquet(str(source))
        q = panels.avalanches(spark.readStream.schema(schema).parquet(str(source))).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).format("parquet").option("path", out).start()
        q.awaitTermination(120)
    got = sorted((x.subject, x.active, x.begin, x.duration, x["size"]) for x in spark.read.parquet(out).collect())
    runs = T.runs(whole, censored=True).collect()
    last = {s: max(x.begin for x in runs if x.subject == s) for s in ("a", "b")}
    assert got == sorted((x.subject, x.active, x.begin, x.duration, x["size"]) for x in runs if x.begin != last[x.subject])
