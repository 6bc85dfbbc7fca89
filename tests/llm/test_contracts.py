"""The registered queries on whole small tables, against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from lattica.llm import queries as Q  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, smoke):
    return spark.read.parquet(f"{smoke}/documents.parquet").collect()


@pytest.fixture(scope="module")
def text(docs):
    return {d.doc_id: d.text for d in docs}


def test_quality_rules(spark, smoke, text):
    rows = Q.op1_quality_rules(spark, smoke).collect()
    assert len(rows) == len(text)
    for x in rows:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute.quality_base(text[x.doc_id])
        assert not (x.kept and x.base_failed)


def test_secret_scans(spark, smoke, text):
    for x in Q.op2_secret_scans(spark, smoke).collect():
        base = brute.secret_base(text[x.doc_id])
        assert [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")] == [x.n_assign, x.n_access, x.n_hex]
        assert hashlib.sha256(brute.spans_text(base).encode()).hexdigest() == x.base_sha256
        assert {brute.spans_text([b]) for b in base} <= set(x.spans.split(","))


def test_url_filters(spark, smoke):
    url = {p.page_id: p.url for p in spark.read.parquet(f"{smoke}/pages.parquet").collect()}
    for x in Q.op3_url_filters(spark, smoke).collect():
        host, path = brute.url_parts(url[x.page_id])
        rule, verdict = brute.url_rule(host, path)
        assert (x.host, x.path, x.rule) == (host, path, rule)
        assert x.verdict == verdict or rule is None and x.verdict in ("allow", "block")


def test_license_scans(spark, smoke, text):
    for x in Q.op4_license_scans(spark, smoke).collect():
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute.license_base(text[x.doc_id])
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1


def test_near_dedup(spark, smoke, text):
    want = brute.near_components(text, 3, 85)
    for x in Q.op5_near_dedup(spark, smoke).collect():
        assert (x.n_shingles, x.component_id) == want[x.doc_id]
        assert x.kept == (x.doc_id == x.component_id)


def test_warc(spark, smoke):
    pages = [(p.page_id, p.html) for p in spark.read.parquet(f"{smoke}/pages.parquet").collect()]
    want = brute.archive(pages)
    got = {x.page_id: (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in Q.op6_warc(spark, smoke).collect()}
    assert got == want


def test_sentencepiece(spark, smoke, text):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(Q.PIECE_MODEL))
    for x in Q.op7_sentencepiece(spark, smoke).collect():
        ids = sp.encode(text[x.doc_id] or "")
        assert x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_mixing(spark, smoke, docs):
    rows = Q.op8_mixing(spark, smoke).collect()
    source = {d.doc_id: d.source for d in docs}
    sizes: dict = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + len(brute.WORD.findall(d.text or ""))
    target, taken = brute.mix_targets(sizes), dict.fromkeys(sizes, 0)
    for x in rows:
        taken[source[x.doc_id]] += x.taken
        assert x.source_size == sizes[source[x.doc_id]] and x.taken <= 3 * x["size"]
        assert abs(x.target - target[source[x.doc_id]]) < 1e-6 * max(1, x.target)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(rows) == sorted(Q.op8_mixing(spark, smoke).collect())


def test_nearest(spark, smoke):
    rows = spark.read.parquet(f"{smoke}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute.nearest(ids, x)
    got = Q.op9_nearest(spark, smoke).collect()
    exact = {(q, v): s for q, vs in want.items() for v, s in vs}
    hits = [(r.query_id, r.vec_id) for r in got if (r.query_id, r.vec_id) in exact]
    assert len(hits) >= 0.9 * len(exact)
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)


def test_quality_classifier(spark, smoke, text):
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{smoke}/labels.parquet").collect() if x.quality is not None}
    rows = Q.op10_quality_classifier(spark, smoke).collect()
    assert all(x.held_out == brute.held_out(x.doc_id) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in rows)
    tested = [(x.score, labels[x.doc_id]) for x in rows if x.held_out and x.doc_id in labels]
    assert np.mean([(s >= 0.7) == y for s, y in tested]) >= 0.9
