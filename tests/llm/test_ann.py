"""Recall and share of the index compared, ties of scaled copies, lengths and repeated ids."""

from __future__ import annotations

import os
import sys

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from lattica.llm import ann  # noqa: E402

def every() -> Column:
    return F.col("vec_id") % 50 == 0


def recall(spark, rows, **more) -> float:
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    want = {(q, v) for q, own in brute.nearest(ids, x).items() for v, _ in own}
    got = {(r.query_id, r.vec_id) for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every(), **more).collect()}
    return len(want & got) / len(want)


def test_recall_on_independent_components(spark):
    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    assert recall(spark, rows) >= 0.9


def test_clusters_need_a_small_share(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + 0.1 * rng.normal(size=32)).tolist()) for i in range(3000)]
    assert recall(spark, rows, search=0.08) >= 0.9


def test_scaled_copies_go_by_id(spark):
    v = np.random.default_rng(2).normal(size=8)
    rows = [(0, v.tolist())] + [(i, (v * 2.0 ** (40 - i)).tolist()) for i in range(1, 41)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every()).orderBy("rank").collect()
    assert [x.vec_id for x in got] == [1, 2, 3, 4, 5]


def test_the_commonest_length_counts(spark):
    rows = [(7, [1.0])] + [(i, [1.0, float(i)]) for i in (0, 1, 2)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), every()).collect()
    assert {(x.query_id, x.vec_id) for x in got} == {(0, 1), (0, 2)}


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("v", "cid", "qid", "score", "rank", "leaf", "_n"):
        df = df.withColumn(name, F.lit(1))
    got = ann.neighbours(df, every()).orderBy("rank").collect()
    assert [x.vec_id for x in got] == [1, 2] and got[0].score > 0.99
