"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lattica.llm import ann, licenses, mixing, near_dedup, quality_classifier, quality_rules, secrets, url_filters, warc
from lattica.llm.queries import encoded

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ROWS = [(1, "a b c d e f g h i j k l", "en", "s", 1), (1, "a b c d e f g h i j k l", "en", "s", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, "a b c d e f g h i j k l m", "en", "s", 1), (4, LONG, "de", "s", 1), (5, "one two", "en", "t", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_rules(docs, none):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(ROWS) and all(not x.kept for x in got if x.n_words < 10)
    assert quality_rules.judge(none).count() == 0


def test_secrets(spark, docs, none):
    model = secrets.train(secrets.labelled_samples(docs))
    got = secrets.scan(docs.withColumn("spans", F.lit(1)), model)
    assert got.count() == len(ROWS) and got.columns.count("spans") == 1
    assert secrets.scan(none, None).count() == 0
    assert secrets.train(secrets.labelled_samples(none)) is None
    key = spark.createDataFrame([("password = hunter2hunter2 x",), (None,)], "text string")
    assert [x.text for x in secrets.scan(key, None, redact=True).collect()] == ["[assign] x", None]


def test_random_tokens_stand_out(spark, smoke):
    words = spark.read.parquet(f"{smoke}/documents.parquet")
    model = secrets.train(secrets.labelled_samples(words))
    rows = spark.createDataFrame([("Zx9QpL2vRt7KmW4sYb8NcD1f",), ("internationalization_configuration",)], "text string")
    assert [len(x.spans) for x in secrets.scan(rows, model).collect()] == [1, 0]


def test_random_parts_of_tokens(spark, smoke):
    """A value behind a long name, and the rest of a secret around a run of hexadecimal digits."""
    model = secrets.train(secrets.labelled_samples(spark.read.parquet(f"{smoke}/documents.parquet")))
    name, value = "database_connection_credential=", "q7Zx9QpL2vRt7KmW4sYb"
    assert secrets.all_spans(name + value, model)[-1][2] == len(name + value)
    behind = "/usr/local/share/application/configuration/" * 4
    assert secrets.all_spans(behind + value, model) == [(len(behind), 3, len(behind + value))]
    mixed = "Zx9QpL2vRtKW" + "0123456789abcdef" + "Qm4sYpNxTkWv"
    assert secrets.all_spans(f"see {mixed} there", model) == [(4, 3, 16), (16, 2, 32), (32, 3, 44)]
    assert secrets.all_spans(behind, model) == []


def test_ordinary_pairs_of_all_documents(spark):
    """The model follows every document, not those of least hash."""
    word = "qzjxqzjxqzjxqzjx"
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(word).alias("text"))
    counted = secrets.labelled_samples(docs).where("label = 0")
    assert sum(secrets.ordinary(x.text).split("\n").count(word) for x in counted.collect()) == 4000


def test_url_filters(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.org/es/x?q"), (4, "http://bad.net/x"), (5, "http://bad.net/y")], "page_id long, url string")
    outcomes = spark.createDataFrame([("http://bad.net/x", 1)] * 40 + [("http://good.net/", 0)] * 400 + [("http://x.net/", None)], "url string, bad int")
    got = {x.page_id: x for x in url_filters.judge(pages, outcomes, (("block", "example.org/es/"),)).collect()}
    assert (got[1].host, got[2].host, got[3].host, got[3].rule) == ("", "", "a.example.org", "example.org/es/")
    assert got[4].verdict == "block" and got[1].verdict == "allow"
    assert url_filters.judge(pages, outcomes.limit(0), ()).where("verdict = 'block'").count() == 0


def test_licenses(docs, none, spark):
    assert licenses.scan(docs.withColumn("score", F.lit(1))).count() == len(ROWS) and licenses.scan(none).count() == 0
    notice = licenses.NOTICES["MIT"][0].upper()
    x = licenses.scan(spark.createDataFrame([(f"intro {notice} end",)], "text string")).first()
    assert [m.template for m in x.matches] == ["MIT"] and x.score == 1.0


def test_near_dedup(spark, docs, none):
    got = {(x.doc_id, x.n_shingles): x for x in near_dedup.near_duplicates(docs).collect()}
    assert got[2, 0].kept and got[3, 0].component_id == 3 and got[1, 8].kept
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_stage_with_repeated_ids(spark):
    import corpus_pipeline

    text = lambda name, n=40, more="": " ".join(f"{name}{i}" for i in range(n)) + more
    rows = [
        (1, text("a"), "en"), (1, text("a"), "de"), (1, text("a"), "de"), (2, text("a"), "en"),  # repeated rows of the least id
        (3, text("b"), "en"), (4, text("b", more=" x"), "en"), (4, text("c"), "en"),  # an id on a copy and on a clean text
        (5, text("d"), "en"), (5, text("d", more=" y"), "en"), (6, text("d"), "en"),  # two texts of the least id in one group
        (7, text("e"), "en"), (8, text("e"), "en"), (7, text("f"), "en"), (9, text("f"), "en"),  # two groups of one least id
        (10, "", "en"), (10, "", "en"), (10, None, "en"), (None, text("a"), "en"), (None, text("a"), "en"),
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], DOCS)
    got = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    have = sorted((x.doc_id or 0, (x.text or "-")[:2]) for x in got)
    assert have == sorted([(1, "a0"), (3, "b0"), (4, "c0"), (5, "d0"), (7, "e0"), (7, "f0"), (10, "-"), (10, "-"), (0, "a0"), (0, "a0")])
    assert [x.lang for x in got if x.doc_id == 1] == ["de"]


def test_near_dedup_links_a_long_chain(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(10 - k, " ".join(words[: 200 + 12 * k])) for k in range(8)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80).collect()
    assert {x.component_id for x in got} == {3} and sum(x.kept for x in got) == 1


def test_warc(spark, tmp_path):
    long = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.0\r\n</p>"
    pages = spark.createDataFrame([(5, "http://a/", long), (3, None, long), (3, None, long), (7, "u", None), (None, "u", long), (8, "u", "short"), (9, "u", "short")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w"))
    got = warc.assemble(records).collect()
    # a wholly repeated row is one capture, archived twice
    assert len(got) == 7 and all(x.n_requests == x.n_metadata == (2 if x.uri == "" else 1) for x in got)
    assert sorted(x.response.type for x in got) == ["response"] * 6 + ["revisit"]
    assert {x.response.payload for x in got} == {long, "", "short", None}
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.assemble(warc.read(spark, str(tmp_path / "e"))).count() == 0


def test_encoding(docs, none):
    got = {(x.doc_id, x.n_tokens) for x in encoded(docs).collect()}
    assert (2, 0) in got and (3, 0) in got and encoded(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(x.taken <= 3 * x["size"] for x in got)
    assert mixing.mix(none).count() == 0
    copies = mixing.emit(mixing.mix(docs))
    assert copies.agg(F.sum("words")).first()[0] == sum(x.taken for x in got)


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.rank, x.vec_id) for x in ann.neighbours(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 9), (4, 8)]
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_classifier(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (4, None)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == len(ROWS) and all(0 <= x.score <= 1 for x in got)
    assert quality_classifier.score(none, model).count() == 0
    alone = quality_classifier.train(docs, labels.limit(0))
    assert {x.score for x in quality_classifier.score(docs, alone).collect()} == {0.5}


def test_classifier_with_repeated_labels_and_clashing_columns(spark):
    rows = [(i, "good plain words here" if i % 2 else "bad ||| #### junk") for i in range(40)] + [(100, "word " * 30_000), (100, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_y", "_id", "quality", "score", "held_out"):
        docs = docs.withColumn(name, F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(1, 0), (3, None)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == 42 and len({x.score for x in got if x.doc_id == 100}) == 1
    assert min(x.score for x in got if x.doc_id < 100 and x.doc_id % 2) > max(x.score for x in got if x.doc_id < 100 and x.doc_id % 2 == 0)
    # of two labels the least holds, and rows come in any order
    again = quality_classifier.train(docs.repartition(5), labels.repartition(3))
    assert abs(again.bias - model.bias) < 1e-9 and (abs(again.weight - model.weight) < 1e-5).all()


def test_near_dedup_reads_two_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words stand in this text here")], "doc_id long, text string")
    for name in ("key", "bands", "h", "component_id", "root", "kept", "text_hash", "m"):
        docs = docs.withColumn(name, F.lit("x"))
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
