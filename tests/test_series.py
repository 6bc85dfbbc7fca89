"""The series format by ranges and filters, its writer, and grids that keep what is finished."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.sources import files, series


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("series"), np.random.default_rng(16)
    x = {(s, scan): rng.normal(size=(n, 5)) for s, n in (("100", 700), ("101", 3), ("102", 0)) for scan in ("LR", "RL")}
    for (s, scan), m in x.items():
        m.astype("<f8").tofile(at / f"ts_{s}_{scan}.bin")
    (at / "notes.txt").write_text("not a matrix")
    series.register(spark)
    return str(at), x


def read(spark, at, size=4000):
    return spark.read.format("series").option("nodes", 5).option("bytes", size).load(at)


def test_a_file_is_read_by_many_tasks(spark, stored):
    at, x = stored
    df = read(spark, at)
    assert df.rdd.getNumPartitions() == 2 * 7 + 2
    got = df.toPandas()
    assert len(got) == 2 * 703 * 5
    for (s, scan), m in x.items():
        own = got[(got.subject == s) & (got.scan == scan)].sort_values(["step", "node"])
        assert (own.value.to_numpy().reshape(-1, 5) == m).all()


def test_filters_leave_out_files_ranges_and_columns(spark, stored):
    at, x = stored
    df = read(spark, at).where("subject = '100' and scan in ('LR') and node in (1, 3) and step >= 250 and step < 420 and value > 0")
    assert df.rdd.getNumPartitions() == 2
    got = df.orderBy("step", "node").collect()
    own = x["100", "LR"][250:420][:, [1, 3]]
    assert [r.value for r in got] == [v for v in own.ravel().tolist() if v > 0]
    assert read(spark, at).where("step = 2 and subject = '101'").count() == 10
    assert read(spark, at).where("subject = 'nobody'").count() == 0
    reader = series.SeriesReader({"path": at, "nodes": "5"})
    left = list(reader.pushFilters([series.EqualTo(("subject",), "100"), series.GreaterThan(("step",), 7), series.GreaterThan(("value",), 0.0)]))
    assert len(left) == 1 and (reader.low, reader.only) == (8, {"subject": {"100"}})


def test_a_ragged_file_is_an_error(spark, tmp_path):
    np.zeros(7).tofile(tmp_path / "ts_1_LR.bin")
    with pytest.raises(Exception, match="whole steps"):
        read(spark, str(tmp_path)).count()


def test_written_series_come_back(spark, stored, tmp_path):
    at, x = stored
    out = str(tmp_path / "out")
    series.save_series(read(spark, at).where("step < 3 and not (step = 1 and node = 2)"), out, 5, 3)
    assert sorted(os.listdir(out)) == [f"ts_{s}_{scan}.bin" for s in ("100", "101") for scan in ("LR", "RL")]
    got = np.fromfile(f"{out}/ts_101_RL.bin").reshape(3, 5)
    want = x["101", "RL"].copy()
    want[1, 2] = 0
    assert (got == want).all()
    bad = read(spark, at).withColumn("step", F.col("step") + 2)
    with pytest.raises(Exception):  # noqa: B017  steps beyond the matrix: nothing new is left
        series.save_series(bad, out, 5, 3)
    assert sorted(os.listdir(out)) == [f"ts_{s}_{scan}.bin" for s in ("100", "101") for scan in ("LR", "RL")]


def test_a_broken_grid_keeps_what_is_finished(spark, tmp_path):
    at, ran = str(tmp_path / "grid"), str(tmp_path / "ran")
    os.mkdir(ran)
    grid = spark.createDataFrame([(k, float(k) / 2) for k in range(8)], "k long, rate double")

    def run(fail):
        def one(setting: pd.DataFrame) -> pd.DataFrame:
            k = int(setting["k"].iloc[0])
            if k == fail:
                import time

                time.sleep(5)  # the others are through by then
                raise RuntimeError("broken off")
            with open(f"{ran}/{k}", "a") as f:
                f.write("x")
            return pd.DataFrame({"k": [k] * (k % 3), "rate": setting["rate"].iloc[0], "score": 1.5})

        return one

    with pytest.raises(Exception, match="broken off"):
        files.run_grid(grid, at, ["k", "rate"], run(6), "k long, rate double, score double")
    kept = len([f for f in os.listdir(at) if f.startswith("part-")])
    assert 1 <= kept <= 7
    got = files.run_grid(grid, at, ["k", "rate"], run(None), "k long, rate double, score double")
    assert sorted(r.k for r in got.collect()) == [1, 2, 2, 4, 5, 5, 7]
    assert sorted(os.listdir(ran)) == [str(k) for k in range(8)] and all(open(f"{ran}/{k}").read() == "x" for k in range(8))
    assert files.finished_settings(spark, at).count() == 8
