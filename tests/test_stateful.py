"""Streams out of order, cut into batches and restarted, against the batch operators."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import blocked
from lattica.operators import temporal as T
from lattica.streaming import stateful as S

SCHEMA = "subject string, step long, n_active long, time timestamp"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def row(s, t, n):
    return s, t, n, START + datetime.timedelta(seconds=t)


def finished(df, mode, at, out, spark):
    (df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/check").trigger(availableNow=True)
     .foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).start().awaitTermination())
    return spark.read.parquet(out)


def test_shuffled_stream_gives_the_runs_of_the_whole_series(spark, tmp_path):
    rng = random.Random(12)
    n = {s: [rng.choice([0, 0, 1, 3]) for _ in range(90)] for s in "ab"}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: S.runs_in_order(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), "time", "20 seconds")
    for k in range(3):  # each part of 30 steps in shuffled files, and a restart after each
        rows = [row(s, t, n[s][t]) for s in "ab" for t in range(30 * k, 30 * k + 30)]
        near = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 15))
        for a in range(0, len(near), 20):
            spark.createDataFrame(near[a : a + 20], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        finished(stream(), "append", tmp_path, out, spark)
    # far steps push the watermark beyond all; step 5 comes again, long after it was placed
    for last in ([row(s, t, 0 if n[s][-1] else 1) for s in "ab" for t in (90, 200)], [row("a", 5, 7), row("a", 6, 7), row("b", 300, 0)], [row("b", 400, 1)]):
        spark.createDataFrame(last, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    got = finished(stream(), "append", tmp_path, out, spark).collect()
    assert sorted((r.begin, r.late) for r in got if r.active is None) == [(5, 1), (6, 2)]
    counts = spark.createDataFrame([(s, t, v) for s in "ab" for t, v in enumerate(n[s])], "subject string, step long, n_active long")
    want = {(r.subject, r.active, r.begin, r.duration, r.size) for r in T.runs(counts, censored=True).collect()}
    seen = {(r.subject, r.active, r.begin, r.duration, r.size) for r in got if r.active is not None and r.begin + r.duration <= 90}
    assert seen == want


@pytest.mark.parametrize("tile", [2, 8])
def test_running_pairs(spark, tmp_path, tile):
    rng = np.random.default_rng(13)
    x = {s: rng.integers(-3, 4, (25, 5)) for s in "ab"}
    rows = [(s, i, t, int(v[t, i])) for s, v in x.items() for t in range(25) for i in range(5)]
    schema = "subject string, node long, step long, state int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    random.Random(14).shuffle(rows)
    stream = lambda: S.running_pairs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 5, tile)
    for a in range(0, 250, 50):
        spark.createDataFrame(rows[a : a + 50], schema).coalesce(1).write.mode("append").parquet(source)
        if a in (50, 200):  # a restart between
            tiles = finished(stream(), "update", tmp_path, out, spark)
    got = {(r.subject, r.i, r.j): (r.n, r.sx, r.sy, r.sxy) for r in S.pairs_of(tiles, 5, tile).collect()}
    panel = spark.createDataFrame(rows, schema)
    want = {(r.subject, r.i, r.j): (r.n, r.sx, r.sy, r.sxy) for r in blocked.pair_sums(panel, "state", ("subject",), diagonal=True).collect()}
    assert got == want
    assert tiles.groupBy("subject", "tile_i", "tile_j").agg(F.max_by("waiting", "n").alias("w")).where("w > 0").count() == 0
