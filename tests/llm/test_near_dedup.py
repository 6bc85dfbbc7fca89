"""Sketches that never drop a pair, full buckets that come apart, and large sets against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import near_dedup as N


@pytest.mark.parametrize("n", [50, 2040, 2060, 9000, 40_000])
def test_sketches_bound_the_difference(n):
    rng = np.random.default_rng(n)
    common = rng.integers(0, 2**64, n, np.uint64)
    for share in (0.02, 0.15, 1.0):
        own = int(n * share / 2)
        a, b = (np.unique(np.concatenate([common[own:], rng.integers(0, 2**64, own, np.uint64)])) for _ in range(2))
        away = len(np.setxor1d(a, b))
        la, lb = N.level_of(len(a)), N.level_of(len(b))
        low = min(la, lb)
        x, y = N.odd_sketch(a, low), N.odd_sketch(b, low)
        seen = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert seen <= away
        most = 15 / 185 * (len(a) + len(b))
        if share == 1.0 and n > 100:  # unlike sets are told apart
            assert seen > most
    high = N.odd_sketch(common, 3).view(np.uint8)
    assert (np.packbits(np.unpackbits(high).reshape(2, -1).sum(0) & 1) == N.odd_sketch(common, 2).view(np.uint8)).all()


def test_a_bucket_of_5000_unlike_classes(spark, monkeypatch):
    """No join key holds more than a bounded share of the bucket, and every pair of like size meets once."""
    monkeypatch.setattr(N, "SQUARE", 500)
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("h"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("key"), (F.lit(1000) + F.col("id") % 3).alias("n"), "id")
    rows = rows.unionByName(spark.createDataFrame([(1, "far", 5000, 5000), (2, "alone", 1000, 5001)], "h long, key string, n long, id long"))
    right = rows.select(F.col("h").alias("_h"), F.col("key").alias("a_key"), F.col("n").alias("a_n"), F.col("id").alias("a_id"))
    left, other = N.squares(rows, right, 85)
    for df, key in ((left, ("h", "_z", "_i", "_j")), (other, ("_h", "_z2", "r_i", "r_j"))):
        assert df.groupBy(*key).count().agg(F.max("count")).first()[0] < 1.3 * 500
    met = N.same_bucket(rows.where("id < 300 or id >= 5000"), right, 85)
    got = met.agg(F.count("*").alias("n"), F.count_distinct("id", "a_id").alias("d")).first()
    assert got.n == got.d == 300 * 5000 + 2
    small = N.same_bucket(rows.where("id < 20"), right.where("a_id < 20"), 100)
    assert small.count() == sum(a % 3 == b % 3 for a in range(20) for b in range(20))


def test_long_texts(spark):
    """Sets of thousands of shingles, just above and just below the threshold, beside unlike ones with a common passage."""
    rng = np.random.default_rng(15)
    words = [f"w{i}" for i in range(50_000)]
    text = rng.choice(words, 6000).tolist()
    passage = rng.choice(words, 400).tolist()

    def changed(k):
        out = list(text)
        for at in rng.choice(len(out), k, replace=False):
            out[at] = "x" + out[at]
        return out

    docs = [text, changed(100), changed(140), changed(250), changed(400)] + [passage + rng.choice(words, 5600).tolist() for _ in range(6)]
    sets = [{tuple(d[i : i + 3]) for i in range(len(d) - 2)} for d in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(rows, k=3, percent=85).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert len(set(root)) < len(docs)
