"""Sources, sinks, streams and scalar helpers, by round trips."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lattica.functions import scalars
from lattica.sources import files
from lattica.streaming import panels


def test_matrix_files_become_a_padded_panel(spark, tmp_path):
    np.arange(6, dtype="<f8").reshape(3, 2).tofile(tmp_path / "ts_7_LR.bin")
    np.arange(4, dtype="<f8").reshape(2, 2).tofile(tmp_path / "ts_8_LR.bin")
    panel = files.series_panel(files.read_matrices(spark, str(tmp_path), 2), 3)
    got = {(x.subject, x.node, x.step): x.value for x in panel.collect()}
    assert len(got) == 12 and got[7, 1, 2] == 5.0 and got[8, 0, 1] == 2.0 and got[8, 1, 2] == 0.0


def test_id_lists_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("30 10\n20\n")
    (tmp_path / "b.txt").write_text("5")
    got = files.read_ids(spark, train=str(tmp_path / "a.txt"), test=str(tmp_path / "b.txt")).orderBy("split", "position").collect()
    assert [(x.split, x.id) for x in got] == [("test", 5), ("train", 30), ("train", 10), ("train", 20)]


def test_regions_checkpoints_and_tiles(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 0.123456, 1.0, "r")], "x double, y double, z double, value double, size double, label string")
    files.write_regions(rows, str(tmp_path / "r"))
    assert files.read_regions(spark, str(tmp_path / "r"), True).first().value == 0.123
    for updates in (10, 20):
        files.save_checkpoint(spark.range(1).withColumn("u", F.lit(updates)), str(tmp_path / "c"), updates)
    assert files.last_checkpoint(spark, str(tmp_path / "c")).first().u == 20
    square = spark.range(16).select((F.col("id") % 4).alias("i"), F.floor(F.col("id") / 4).alias("j"))
    files.write_tiles(square, str(tmp_path / "t"), 2)
    assert spark.read.parquet(str(tmp_path / "t")).where("tile_i = 1 and tile_j = 0").count() == 4


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", k % 3, 1 if k % 2 else -1) for k in range(30)], "subject string, node long, state int")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = panels.running_moments(panels.arriving(spark, str(tmp_path / "in"), "subject string, node long, state int", 1))
    run = stream.writeStream.format("memory").queryName("moments").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(spark.table("moments").collect()) == sorted(panels.running_moments(rows).collect())


def test_scalars(spark):
    x = spark.range(1).select(
        scalars.pairs_of(F.lit(360)).alias("p"), scalars.nodes_of(F.lit(64620)).alias("n"), scalars.two_sided_p(F.lit(1.959964)).alias("q"),
        scalars.to_spherical(F.lit(1.0), F.lit(2.0), F.lit(2.0)).alias("s"),
    ).select("*", scalars.to_cartesian(F.col("s.radius"), F.col("s.inclination"), F.col("s.azimuth")).alias("c")).first()
    assert (x.p, x.n) == (64620, 360) and abs(x.q - 0.05) < 1e-5
    assert math.dist(x.c, (1.0, 2.0, 2.0)) < 1e-9
