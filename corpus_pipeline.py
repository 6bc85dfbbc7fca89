"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``, in their
order, whatever other columns come in.  Empty tables stay empty.  Null and empty
texts are scored by the trained prior, link with nothing, hold no secret and are
never taken into a mix.  Texts of any length are handled whole.  Repeated rows are
scored and cleaned alike; near-duplicate removal keeps one of them.  Ties (equal
scores, equal texts) are decided by doc_id and a hash of the text, so that reruns agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import mixing, near_dedup, quality_classifier, secrets
from lattica.llm.common import bounded_batches, cut, remove, shared_dir, small, swept, table, written
from lattica.llm.queries import encoded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts; it learns from labels outside the held-out rows."""
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.where(~quality_classifier.held_out()))
    return quality_classifier.score(docs, model).where("score >= 0.7").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each group of near duplicates (five-word shingles, 0.8).

    Rows are told apart by id and text: an id on two texts loses only those that
    are copies.  If the least id of a group has several rows in it, one text (of
    least hash) and one row of it stay; so does one of wholly repeated rows
    without words.  Rows without an id all stay.
    """
    found = cut(near_dedup.grouped(docs, k=5, percent=80).select("doc_id", "text_hash", "component_key", "kept"))
    gone = found.where("not kept").select("doc_id", "text_hash")
    alone = F.when(F.col("component_key").isNull(), F.col("text_hash"))
    heads = found.where("kept and doc_id is not null").groupBy("doc_id", "component_key", alone.alias("alone"))
    heads = cut(heads.agg(F.min("text_hash").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n", "alone"))
    docs = docs.select(*COLUMNS)
    if not heads.limit(1).count():
        return _without(docs, gone)
    rows = found.where("kept").join(heads.withColumnsRenamed({"doc_id": "_d", "component_key": "_k"}), (F.col("doc_id") == F.col("_d")) & F.col("component_key").eqNullSafe(F.col("_k")))
    gone = gone.union(rows.where("component_key is not null and text_hash != head").select("doc_id", "text_hash"))
    again = heads.select("doc_id", F.col("head").alias("text_hash"))
    # the repeated heads are cut out, and one row of each put back
    of = again.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    own = docs.join(small(cut(of)), (F.col("doc_id") == F.col("_d")) & (near_dedup.text_hash() == F.col("_h")), "left_semi")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = own.groupBy("doc_id", near_dedup.text_hash()).agg(F.min(F.struct(*rest, "text")).alias("x")).select("doc_id", "x.*")
    return _without(docs, gone.union(again)).unionByName(one).select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone(doc_id, text_hash)``."""
    gone = cut(gone.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct())
    return docs.join(small(gone, near_dedup.FEW), (F.col("doc_id") == F.col("_d")) & (near_dedup.text_hash() == F.col("_h")), "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by the name of their kind; n_chars follows the new text."""
    model = secrets.train(secrets.labelled_samples(docs))
    clean = secrets.scan(docs, model, redact=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that the mix takes a document, by shard and in the order of the local shuffle.

    Every copy is a whole document, so a source may give more words than its
    target by less than one document, that which its last words begin.
    Documents without words are never taken.
    """
    return mixing.dealt(mixing.emit(mixing.mix(docs.select(*COLUMNS)))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, as digests, and what they decode to."""
    return encoded(docs.select("doc_id", "source", "text")).drop("text")


def _bounded(stage: Stage) -> Stage:
    """A stage whose Python workers get batches of bounded bytes."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _bounded(quality_stage)),
    ("near duplicates", _bounded(near_dedup_stage)),
    ("secret scans", _bounded(secret_stage)),
    ("mixing sources", _bounded(mixing_stage)),
    ("sentencepiece", _bounded(encoding_stage)),
]
#: The classifier, the near-duplicate groups and the encoder cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages before it wrote is removed as soon as the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, mark = f"{shared_dir(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}", len(written)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        swept(mark, docs)
        if before:
            remove(spark, before)
        before = path
    return docs
