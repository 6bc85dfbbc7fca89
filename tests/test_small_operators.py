"""Operators that no registered query runs, against numpy and plain loops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattica.operators import binarize as B
from lattica.operators import models as P
from lattica.operators import moments as M
from lattica.operators import relate as R
from lattica.operators import statistics as S
from lattica.streaming import panels


def panel_of(spark, x):
    return spark.createDataFrame([("a", i, t, float(x[t, i])) for t in range(x.shape[0]) for i in range(x.shape[1])], "subject string, node long, step long, value double")


def test_scaling(spark):
    x = np.array([[1.0, 5.0, 7.0], [2.0, 5.0, -7.0], [6.0, 5.0, 3.0]])
    panel = panel_of(spark, x)
    wide = lambda df, c: df.toPandas().pivot(index="step", columns="node", values=c).to_numpy(float)
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0, ddof=1) > 0, x.std(axis=0, ddof=1), np.nan)
    got = wide(B.score_sign(panel), "state")
    assert np.array_equal(got[:, [0, 2]], np.sign(z[:, [0, 2]] - 0.1)) and np.isnan(got[:, 1]).all()
    for how, want in (("z", (x - x.mean()) / x.std(ddof=1)), ("max_abs", x / 7), ("min_max", 2 * (x + 7) / 14 - 1), ("min_max_pos", (x + 7) / 14)):
        assert np.allclose(wide(B.normalized(panel, how, keys=()), "scaled"), want)
    fit = B.fitted_scaler(panel.where("step < 2"), ["node"])
    there = B.apply_scaler(panel, fit, ["node"], keep_constant=True)
    s = wide(there, "scaled")
    assert np.allclose(s[:, 0], (x[:, 0] - 1.5) / np.std([1, 2], ddof=1)) and np.allclose(s[:, 1], 5.0)
    back = B.apply_scaler(B.apply_scaler(panel, fit, ["node"]).drop("value").withColumnRenamed("scaled", "value"), fit, ["node"], inverse=True)
    assert np.allclose(wide(back, "scaled")[:, [0, 2]], x[:, [0, 2]])


def test_squares(spark):
    square = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(6) for j in range(6)], "i long, j long, v double")
    assert {x.v for x in B.without_diagonal(square, "v").where("i = j").collect()} == {0.0}
    assert sorted((x.i, x.j) for x in B.downsampled(square, 3).collect()) == [(0, 0), (0, 3), (3, 0), (3, 3)]


def test_losses_endpoints_and_images(spark):
    nodes = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 2.0)], "k string, x double, y double")
    edges = spark.createDataFrame([("a", 0.0, 1.0)], "k string, x double, y double")
    x = M.graph_loss(nodes, edges, ["k"], 0.25).first()
    assert (x.node_loss, x.edge_loss, x.loss) == (2.0, 1.0, 1.75)
    own = spark.createDataFrame([("a", 0, 1.5), ("a", 1, 2.5)], "k string, node long, f double")
    x = R.endpoints(spark.createDataFrame([("a", 0, 1)], "k string, i long, j long"), own, ["k"], ["f"]).first()
    assert (x.f_i, x.f_j) == (1.5, 2.5)
    voxels = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "voxel long, region long")
    image = R.region_image(voxels, spark.createDataFrame([(1, 0.5), (2, -1.0)], "region long, value double"))
    assert sorted((x.voxel, x.value) for x in image.collect()) == [(0, 0.5), (1, -1.0), (2, 0.0)]


def test_surrogate_counts(spark):
    seen = spark.createDataFrame([("a", -1.0)], "k string, observed double")
    null = spark.createDataFrame([("a", v) for v in (-2.0, -1.0, 0.0, 1.5)], "k string, value double")
    got = {m: S.surrogate_count(seen, null, ["k"], m).first().n_beyond for m in ("above", "below", "abs_above", "abs_below")}
    assert got == {"above": 3, "below": 2, "abs_above": 3, "abs_below": 2}


def test_most_probable(spark):
    rows = spark.createDataFrame([("a", 0, 0.2), ("a", 1, 0.4), ("a", 2, 0.4)], "model string, code long, p double")
    assert [(x.code, x.rank) for x in P.most_probable(rows).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_ranks(spark):
    x = np.random.default_rng(2).integers(0, 30, 500) ** 3
    df = spark.createDataFrame([(i, i % 2, int(v)) for i, v in enumerate(x)], "id long, g int, v long")
    import pandas as pd

    want = pd.DataFrame({"g": np.arange(500) % 2, "v": x}).groupby("g")["v"].rank()
    assert all(want[r.id] == r.rank for r in S.with_ranks(df, ["g"], "v", "rank").collect())


def test_event_time_windows(spark, tmp_path):
    schema = "subject string, ts timestamp, value double"
    rows = spark.createDataFrame([("a", s, 1.0) for s in (0, 5, 9, 200, 203, 900)] + [("b", 3, 2.0)], "subject string, s long, value double").select("subject", F.timestamp_seconds("s").alias("ts"), "value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make, want in (
        ("w", lambda df: panels.windowed_activity(df, "ts", "10 seconds", "10 seconds").select("subject", "n"), [("a", 2), ("a", 3), ("b", 1)]),
        ("b", lambda df: panels.bursts(df, "ts", "20 seconds", "10 seconds").select("subject", "size"), [("a", 2), ("a", 3), ("b", 1)]),
    ):
        q = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"at-{name}")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / name)).start()
        q.awaitTermination(120)
        assert sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / name)).collect()) == want


def test_leaves_of_a_chain_of_merges(spark):
    """A tree as deep as 360 nodes can make it, and a node in its middle."""
    from lattica.operators.cluster import leaves_of

    n = 360
    rows = [(n + k, 0 if k == 0 else n + k - 1, k + 1, float(k), "a") for k in range(n - 1)]
    tree = spark.createDataFrame(rows, "parent long, left long, right long, height double, subject string")
    assert sorted(r.node for r in leaves_of(tree, 2 * n - 2, "a").collect()) == list(range(n))
    assert sorted(r.node for r in leaves_of(tree, n + 99, "a").collect()) == list(range(101))
    assert [r.node for r in leaves_of(tree, 5, "a").collect()] == [5]
    assert leaves_of(tree, 2 * n - 2, "b").count() == 0


def test_observable_sums_by_rows_of_tiles(spark, monkeypatch):
    """Small tiles, several chunks of steps, and steps that lack nodes, against plain sums; no step is sent once a pair of tiles."""
    import numpy as np

    from lattica.operators import blocked

    rng = np.random.default_rng(17)
    rows = [(s, n, t, int(rng.choice([-1, 1]))) for s in "ab" for t in range(60) for n in range(5) if rng.random() > 0.1]
    panel = spark.createDataFrame(rows, "subject string, node long, step long, state int")
    monkeypatch.setattr(blocked, "HELD", 20)
    got = {(r.subject, r.i, r.j): (r.n, r.sx, r.sy, r.sxy, r.sxx, r.syy) for r in blocked.observable_sums(panel, ["subject"], lambda i, j: i * 100 + j, tile=4).collect()}
    want = {}
    for s in "ab":
        steps = {}
        for name, n, t, v in rows:
            if name == s:
                steps.setdefault(t, {})[n] = v
        for own in steps.values():
            o = {i * 100 + j: own[i] if i == j else own[i] * own[j] for i in own for j in own if i <= j}
            for a in o:
                for b in o:
                    ia, ib = ((i // 100, i % 100) for i in (a, b))
                    if ia <= ib:
                        x = want.setdefault((s, a, b), [0.0] * 6)
                        for k, v in enumerate((1, o[a], o[b], o[a] * o[b], 1, 1)):
                            x[k] += v
    assert got == {k: tuple(v) for k, v in want.items()}


def test_ranges_of_heavy_tails_and_heaps(spark):
    """No range of values holds much more than its share, whatever the values' spread, and ranks over ranges are those of a sort."""
    import numpy as np
    from lattica.operators import statistics as S

    rng = np.random.default_rng(18)
    v = np.concatenate([np.exp(30 * rng.random(5000)), 1e-9 * rng.random(5000), np.repeat(3.5, 500)])
    rows = spark.createDataFrame([("a", float(x), int(k % 2)) for k, x in enumerate(v)] + [("b", 1.0, 0), ("b", 1.0, 1)], "key string, v double, g int")
    counts = rows.groupBy("key", "v").count()
    assert S.ranged(counts, ["key"], "v").where("key = 'a'").groupBy("_range").count().agg(F.max("count")).first()[0] <= 3 * 10_001 / 256
    got = {(r.key, r.v): (r._n, r._before) for r in S.placed(rows, ["key"], "v").collect()}
    order = np.sort(v)
    assert got["b", 1.0] == (2, 0) and len(got) == 10_002
    for x in np.unique(v):
        assert got["a", x] == ((v == x).sum(), np.searchsorted(order, x))
    d = {r.key: r.distance for r in S.kolmogorov_smirnov(rows, ["key"], "v", "g").collect()}
    one, two = np.sort(v[1::2]), np.sort(v[0::2])
    far = np.abs(np.searchsorted(one, order, "right") / len(one) - np.searchsorted(two, order, "right") / len(two)).max()
    assert abs(d["a"] - far) < 1e-12 and d["b"] == 0


def test_bins_of_rows_whose_order_changes(spark):
    """Ranges are the same for all that reads them, though the rows come in another order whenever they are made."""
    import numpy as np
    from lattica.operators import statistics as S

    n = 150_000
    drawn = spark.range(0, n, 1, 6).mapInPandas(lambda parts: (p.sample(frac=1) for p in parts), "id long")
    rows = drawn.select(F.lit("a").alias("key"), F.sin(F.col("id") * F.col("id")).alias("v"), F.col("id").cast("double").alias("p"), "id")
    v = np.array([r.v for r in rows.orderBy("id").collect()])
    order = np.lexsort([np.arange(n), v])
    spark.conf.set("spark.sql.exchange.reuse", "false")  # as where Spark does not see that two parts of a plan are one
    try:
        got = {r.bin: (r.feature_mean, r.param_mean) for r in S.equal_count_bins(rows, ["key"], "v", "p", 50, "id").collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(got) == n // 50
    for k in range(n // 50):
        own = order[50 * k : 50 * k + 50]
        assert abs(got[k][0] - v[own].mean()) < 1e-9 and abs(got[k][1] - own.mean()) < 1e-6


def test_rank_sums_of_rows_whose_order_changes(spark):
    """U, signed ranks and ranks among null keys and values, with rows in another order whenever they are made."""
    import numpy as np
    from lattica.operators import statistics as S

    n = 150_000
    drawn = spark.range(0, n, 1, 6).mapInPandas(lambda parts: (p.sample(frac=1) for p in parts), "id long")
    rows = drawn.select(F.lit(None).cast("string").alias("key"), F.sin(F.col("id") * F.col("id")).alias("v"), (F.col("id") % 3 == 0).cast("int").alias("g"), F.lit(0.0).alias("zero"))
    v = np.array([r.v for r in drawn.select(F.sin(F.col("id") * F.col("id")).alias("v"), "id").orderBy("id").collect()])
    rank = lambda x: np.searchsorted(np.sort(x), x) + (np.searchsorted(np.sort(x), x, "right") - np.searchsorted(np.sort(x), x) + 1) / 2
    one = np.arange(n) % 3 == 0
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        u = S.mann_whitney(rows, ["key"], "v", "g").collect()
        w = S.wilcoxon(rows, ["key"], "v", "zero").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert [(r.n1, r.n0, r.u) for r in u] == [(n // 3, n - n // 3, rank(v)[one].sum() - (n // 3) * (n // 3 + 1) / 2)]
    far = rank(np.abs(v[v != 0]))
    assert [(r.n, r.w_plus, r.w_minus) for r in w] == [(len(far), far[v[v != 0] > 0].sum(), far[v[v != 0] < 0].sum())]
    with_null = spark.createDataFrame([("a", 1.0, 0), ("a", 3.0, 1), ("a", None, 1), ("a", None, 0), ("b", 2.0, 0)], "key string, v double, g int")
    got = {r.key: (r.n1, r.n0, r.u) for r in S.mann_whitney(with_null, ["key"], "v", "g").collect()}
    assert got == {"a": (2, 2, 2 + 3.5 - 3), "b": (0, 1, None)}  # as SQL: null ranks last, and no rank sums to null


def test_quantiles_of_heaps_and_null_keys(spark):
    """Quantiles at the ends, in heaps and between them are those of a sort; a null key is a key."""
    import numpy as np
    from lattica.operators import statistics as S

    rng = np.random.default_rng(19)
    own = {None: rng.normal(size=3000), "heap": np.repeat([1.0, 2.0, 3.0], [1400, 200, 1400]), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "tail": np.exp(20 * rng.random(2000))}
    rows = spark.createDataFrame([(k, float(x)) for k, v in own.items() for x in v] + [("heap", None)], "key string, v double").repartition(5)
    shares = (0.0, 0.05, 0.46, 0.5, 0.95, 1.0)
    got = {r.key: r[1:] for r in S.quantile_summary(rows, ["key"], "v", shares).collect()}
    assert got.keys() == own.keys()
    for k, v in own.items():
        assert np.allclose(got[k], [v.min(), *np.quantile(v, shares), v.max()], rtol=1e-12)
    assert np.allclose(S.quantile_summary(rows.where("key = 'tail'"), [], "v").first()[:], [own["tail"].min(), *np.quantile(own["tail"], (0.05, 0.5, 0.95)), own["tail"].max()], rtol=1e-12)


def test_rank_correlation_with_null_keys(spark):
    """A null key is a key, and null values rank last, as in SQL."""
    import numpy as np
    from lattica.operators import statistics as S

    rng = np.random.default_rng(20)
    x, y = rng.integers(0, 9, 400), rng.normal(size=400).round(2)
    rows = [(None, int(a), float(b)) for a, b in zip(x, y, strict=True)] + [("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 3.0), ("b", None, 2.0), ("b", 2, None)]
    got = {r.key: r.rho for r in S.spearman(spark.createDataFrame(rows, "key string, x long, y double"), ["key"], "x", "y").collect()}
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert abs(got[None] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-12
    assert got["a"] is None and abs(got["b"] - np.corrcoef([1, 3, 2], [2, 1, 3])[0, 1]) < 1e-12
