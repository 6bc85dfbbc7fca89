"""The pipeline's stages, one by one, against plain versions of what each decides."""

from __future__ import annotations

import hashlib
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from lattica.llm import quality_classifier, secrets  # noqa: E402
from lattica.llm.queries import PIECE_MODEL  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def run(spark, smoke, tmp_path_factory):
    """Rows before each stage and after the last."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{smoke}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, frames[-1], smoke).write.parquet(str(at / str(k)))
        frames.append(spark.read.parquet(str(at / str(k))))
    return frames


def texts(df):
    return {x.doc_id: x.text for x in df.collect()}


def test_stages_return_the_columns_of_documents(run):
    assert all(f.columns == list(P.COLUMNS) for f in run[:5])
    assert [name for name, _ in P.STAGES] == ["quality classifier", "near duplicates", "secret scans", "mixing sources", "sentencepiece"]


def test_quality_keeps_what_the_model_accepts(spark, smoke, run):
    before, after = texts(run[0]), texts(run[1])
    labels = spark.read.parquet(f"{smoke}/labels.parquet")
    model = quality_classifier.train(run[0], labels.where(~quality_classifier.held_out()))
    powers = quality_classifier.Powers()
    assert after == {d: t for d, t in before.items() if model.score(t, powers) >= 0.7}
    good = {x.doc_id for x in labels.where("quality = 1").collect()} & set(before)
    assert len(good & set(after)) >= 0.95 * len(good)


def test_near_duplicates_leave_one_of_each_group(run):
    before, after = texts(run[1]), texts(run[2])
    found = brute.near_components(before, 5, 80)
    assert set(after) == {d for d, (_, c) in found.items() if c == d} and len(after) < len(before)


def test_secrets_are_taken_out_and_nothing_else(run):
    before, after = texts(run[2]), texts(run[3])
    assert set(before) == set(after)
    n = 0
    for d, t in before.items():
        base = brute.secret_base(t)
        n += bool(base)
        if not base:
            assert after[d] == t
        assert not brute.secret_base(after[d])
    assert n and all(x.n_chars == len(x.text or "") for x in run[3].collect() if x.text is not None)


def test_the_mix_meets_its_targets(run):
    before, after = run[3].collect(), run[4].collect()
    size = {x.doc_id: len(brute.WORD.findall(x.text or "")) for x in before}
    sizes: dict = {}
    for x in before:
        sizes[x.source] = sizes.get(x.source, 0) + size[x.doc_id]
    want, taken, times = brute.mix_targets(sizes), dict.fromkeys(sizes, 0), {}
    for x in after:
        taken[x.source] += size[x.doc_id]
        times[x.doc_id] = times.get(x.doc_id, 0) + 1
    longest = {s: max(size[x.doc_id] for x in before if x.source == s) for s in sizes}
    assert all(int(want[s]) <= taken[s] < want[s] + max(1, longest[s]) for s in sizes) and max(times.values()) <= 3
    assert set(texts(run[4]).items()) <= set(texts(run[3]).items())


def test_the_last_stage_encodes_every_row(run):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))
    want = sorted((x.doc_id, hashlib.sha256(",".join(map(str, sp.encode(x.text or ""))).encode()).hexdigest()) for x in run[4].collect())
    assert sorted((x.doc_id, x.ids_sha256) for x in run[5].collect()) == want


def test_run_is_the_stages_and_leaves_nothing_behind(spark, smoke, run):
    from lattica.llm.common import shared_dir

    mark = set(os.listdir(shared_dir(spark))) if os.path.isdir(shared_dir(spark)) else set()
    got = P.run(spark, smoke)
    assert sorted(got.collect()) == sorted(run[5].collect())
    left = set(os.listdir(shared_dir(spark))) - mark
    assert len([x for x in left if x.startswith("stage-")]) <= 2 and not [x for x in left if x.startswith("cut-")]


def test_nulls_empty_long_repeated_and_empty_tables(spark, smoke):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (4, "password = hunter2hunter2x", None, "t", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, (_, stage) in enumerate(P.STAGES):
        if k == 0:  # the labels' own documents are what its model is made of
            continue
        assert stage(spark, docs.withColumn("shard", F.lit(1)), smoke).count() > 0
        assert stage(spark, docs.limit(0), smoke).count() == 0
    assert P.STAGES[0][1](spark, docs.limit(0), smoke).count() == 0
    kept = P.secret_stage(spark, docs, smoke).where("doc_id = 4").first()
    assert kept.text == "[assign]" and kept.n_chars == 8
    assert secrets.KINDS[0] == "assign"
