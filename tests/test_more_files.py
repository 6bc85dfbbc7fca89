"""Short series, grids that resume, merged tables, zero models, training sets, atlases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lattica.sources import files as S


def test_short_series_and_their_statistics(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = {f"s{k}": rng.normal(size=(3, 5 + k)) for k in range(3)}
    for name, x in data.items():
        (tmp_path / f"{name}.bin").write_bytes(x.astype("<f8").tobytes())
    series = S.read_short_series(spark, str(tmp_path), 3)
    nodes, pairs = S.stacked_stats(series)
    for r in nodes.collect():
        x = data[r.path.split("/")[-1][:-4]][r.node]
        assert np.allclose([r.mean, r.sd], [x.mean(), x.std()])
    for r in pairs.collect():
        x = data[r.path.split("/")[-1][:-4]]
        assert np.isclose(r.product, (x[r.i] * x[r.j]).mean())
    assert nodes.count() == 9 and pairs.count() == 9


def test_grid_resumes(spark, tmp_path):
    grid = spark.createDataFrame([(a, b) for a in (1, 2) for b in (0.1, 0.2)], "depth int, rate double")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        return own.assign(error=own["depth"] * own["rate"])

    path, schema = str(tmp_path / "grid"), "depth int, rate double, error double"
    assert S.run_grid(grid.where("depth = 1"), path, ["depth", "rate"], run, schema).count() == 2
    assert S.run_grid(grid, path, ["depth", "rate"], run, schema).count() == 4
    assert S.run_grid(grid, path, ["depth", "rate"], run, schema).count() == 4


def test_merged_and_zero(spark):
    a = spark.createDataFrame([("g", 1.0)], "model string, h double")
    b = spark.createDataFrame([("s", 2.0, 3)], "model string, h double, scan int")
    assert {(x.kind, x.model, x.scan) for x in S.merged(a, b).collect()} == {("group", "g", None), ("individual", "s", 3)}
    zero = S.zero_models(spark, 3, 4).collect()
    assert len(zero) == 3 and all(len(x.h) == 4 and len(x.w) == 16 and not any(x.w) for x in zero)


def test_training_set(spark):
    series = spark.createDataFrame([(s, 0, n, t, float(s + n + t)) for s in (1, 2, 3) for n in range(2) for t in range(3)], "subject long, scan int, node long, step long, value double")
    graphs = spark.createDataFrame([(s, 0, 1, 0.5) for s in (1, 2)], "subject long, i long, j long, w double")
    features = spark.createDataFrame([(s, n, float(n)) for s in (1, 2, 3) for n in range(2)], "subject long, node long, thickness double")
    rows = S.training_set(series, graphs, features, spark.createDataFrame([(0, 1), (1, 3)], "position long, id long")).collect()
    assert [x.subject for x in rows] == [1] and [v.value for v in rows[0].series] == [1.0, 2.0, 3.0, 2.0, 3.0, 4.0] and rows[0].graph[0].w == 0.5


def test_atlas(spark, tmp_path):
    (tmp_path / "atlas.csv").write_text("name,x,y,z\nV1,1.5,2,3\nV2,-1,0,4\n")
    got = S.read_atlas(spark, str(tmp_path / "atlas.csv")).orderBy("name").collect()
    assert [(x.name, x.x) for x in got] == [("V1", 1.5), ("V2", -1.0)] and got[1].z == 4.0


def test_nothing_outside_a_grid_is_lost(spark):
    import pytest

    from lattica.sources.tables import densify

    rows = spark.createDataFrame([("a", 0, 0, 1), ("a", 5, 0, 1)], "subject string, node long, step long, value long")
    assert densify(rows.where("node = 0"), 2, 2).count() == 4
    with pytest.raises(Exception, match="outside the grid"):
        densify(rows, 2, 2).collect()
    assert densify(rows, 6, 2).agg(F.sum("value")).first()[0] == 2
