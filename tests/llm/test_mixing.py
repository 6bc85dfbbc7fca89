"""The mix through its tree: quotas, disjoint blocks, words, reruns, clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lattica.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def rows_of(n, sources=("a", "b", None), long=900):
    return [(i, "w " * (long if i % 40 == 0 else 3 + i % 17), sources[i % len(sources)]) for i in range(n)]


@pytest.fixture(scope="module")
def mixed(spark):
    out = mixing.mix(spark.createDataFrame(rows_of(600), SCHEMA), shards=5, block_words=100)
    return out.cache()


def test_words_meet_the_targets(mixed):
    for x in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert x.taken == int(x.target) and x.over <= 0


def test_blocks_are_disjoint_and_meet_their_quotas(spark, mixed):
    rows = mixing.emit(mixed).collect()
    for s in ("a", "b", None):
        own = [x for x in rows if x.source == s]
        where: dict = {}
        for x in own:  # a block of a pass stands in one shard
            assert where.setdefault((x["pass"], x.block), x.shard) == x.shard
        size, passes = own[0].source_size, int(own[0].target) // own[0].source_size
        for i in range(passes):  # whole passes take every word once
            assert sum(x.words for x in own if x["pass"] == i) == size
        # documents stand whole in the block of their first word: blocks start in their place on the line
        before = 0
        for b in sorted({x.block for x in own if x["pass"] == 0}) if passes else ():
            assert b * 100 <= before < (b + 1) * 100
            before += sum(x.words for x in own if x["pass"] == 0 and x.block == b)
    assert all(0 <= x.shard < 5 for x in rows)


def test_tree_deals_quotas_evenly(spark):
    quotas = [("a", 400), ("b", 37), (None, 1), ("c", 0)]
    deal = mixing.split_tree(spark.createDataFrame(quotas, "source string, blocks long"), 5, 17).collect()
    for s, n in quotas:
        own = sorted((x.shard, x.first, x.blocks) for x in deal if x.source == s)
        assert sum(b for _, _, b in own) == n
        assert [f for _, f, _ in own] == [sum(b for _, _, b in own[:i]) for i in range(5)]
    per_shard = [sum(x.blocks for x in deal if x.shard == i) for i in range(5)]
    assert max(per_shard) - min(per_shard) <= 1


def test_taken_comes_from_the_tree(spark, monkeypatch):
    """Blocks that the tree gives to no shard are in no document's taken words."""
    docs = spark.createDataFrame(rows_of(200), SCHEMA)
    whole = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda q, n, seed: whole(q, n, seed).where("shard != 2"))
    copies = mixing.emit(mixing.mix(docs, shards=4, block_words=50))
    monkeypatch.undo()
    every = mixing.emit(mixing.mix(docs, shards=4, block_words=50))
    assert copies.where("shard = 2").count() == 0
    lost = every.where("shard = 2").agg(F.sum("words")).first()[0]
    assert lost > 0 and every.agg(F.sum("words")).first()[0] - copies.agg(F.sum("words")).first()[0] == lost


def test_draws_follow_the_distribution(spark):
    """Of 20 with 8 marked, 5 drawn: mean 2, variance 5 * .4 * .6 * 15 / 19."""
    u = (F.col("id") + 0.5) / 2000
    k = spark.range(2000).select(mixing.hypergeometric(u, F.lit(20), F.lit(8), F.lit(5)).alias("k"))
    mean, var = k.agg(F.avg("k"), F.var_pop("k")).first()
    assert abs(mean - 2) < 0.01 and abs(var - 5 * 0.4 * 0.6 * 15 / 19) < 0.02


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.createDataFrame(rows_of(300), SCHEMA)
    a = mixing.mix(docs.repartition(1), block_words=64).collect()
    b = mixing.mix(docs.repartition(7), block_words=64).collect()
    assert sorted(a, key=lambda x: x.doc_id) == sorted(b, key=lambda x: x.doc_id)


def test_clashing_columns_long_texts_and_ties(spark):
    rows = [(1, "w " * 50_000, "a"), (2, "x y", "a"), (2, "x y", "a"), (3, None, "b"), (4, "", None), (None, "z", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("size", "target", "source_size", "passes", "blocks", "shard", "taken", "copies", "rest", "block_words"):
        docs = docs.withColumn(name, F.lit(1))
    got = mixing.mix(docs)
    assert got.count() == 6 and got.columns.count("target") == 1 and "passes" in got.columns
    taken = {(x.doc_id, x["size"]): x.taken for x in got.collect()}
    assert taken[3, 0] == taken[4, 0] == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_shards_are_written_in_the_order_of_their_shuffle(spark, mixed, tmp_path):
    mixing.write(mixing.emit(mixed), str(tmp_path / "mix"))
    n = 0
    for shard in range(5):
        files = sorted((tmp_path / "mix" / f"shard={shard}").glob("*.parquet"))
        places = [x.place for f in files for x in spark.read.parquet(str(f)).select("place").collect()]
        assert places == sorted(places)
        n += len(places)
    assert n == mixing.emit(mixed).count()
