"""The robust estimates against a plain search of the same kind in numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import quality_rules as Q

VS = list(Q.VECTOR)


def plain_distances(x: np.ndarray, spread: np.ndarray, rng: np.random.Generator, core: float = 0.75) -> np.ndarray:
    """Distances by random starts, concentration on exactly the nearest rows, and one reweighting."""
    n, p = x.shape

    def fit(rows: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        h = len(rows)
        cov = factor * np.cov(rows.T, bias=True).reshape(p, p)
        return rows.mean(axis=0), (h * cov + Q.PRIOR_ROWS * np.diag(spread**2)) / (h + Q.PRIOR_ROWS)

    def distance(m: np.ndarray, s: np.ndarray) -> np.ndarray:
        d = x - m
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)

    h, best = math.ceil(core * n), None
    for _ in range(30):
        m, s = fit(x[rng.choice(n, min(n, p + 1), replace=False)], 1.0)
        for _ in range(40):
            m, s = fit(x[np.argsort(distance(m, s), kind="stable")[:h]], Q.consistency(core, p))
        if best is None or np.linalg.slogdet(s)[1] < best[0]:
            best = (np.linalg.slogdet(s)[1], m, s)
    m, s = fit(x[distance(*best[1:]) <= Q.chi_square_beyond(0.025, p)], Q.consistency(0.975, p))
    return distance(m, s)


def test_chi_square():
    assert abs(Q.chi_square_beyond(0.05, 5) - 11.0705) < 1e-3 and abs(Q.chi_square_beyond(0.025, 4) - 11.1433) < 1e-3
    assert abs(Q.chi_square_cdf(11.0705, 5) - 0.95) < 1e-5 and abs(Q.consistency(1 - 1e-12, 5) - 1) < 1e-6


@pytest.fixture(scope="module")
def judged(spark):
    return Q.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()


def test_every_group_agrees_with_a_plain_search(judged):
    wide = {}
    for lang, own in judged.groupby("lang"):
        q = own[VS].quantile([0.25, 0.75]).to_numpy()
        wide[lang] = np.maximum((q[1] - q[0]) / 1.349, [Q.VECTOR[v] for v in VS])
    rng, same, n = np.random.default_rng(1), 0, 0
    limit = Q.chi_square_beyond(Q.TAIL, len(VS))
    for (lang, _), own in judged.groupby(["lang", "source"]):
        want = ~own["base_failed"] & (plain_distances(own[VS].to_numpy(), wide[lang], rng) <= limit)
        same, n = same + (want == own["kept"]).sum(), n + len(own)
    assert n == len(judged) == 1000 and same >= 0.995 * n


def test_clean_documents_stay(spark, judged):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = judged[~judged["base_failed"]].merge(labels, on="doc_id")
    rejected = both[~both["kept"]]
    assert len(rejected) >= 20 and (rejected["quality"] == 0).all()


def test_small_and_constant_groups(spark):
    rows = [(i, "plain words of one kind stand here in this text again", "en", "s") for i in range(30)]
    rows += [(100, "plain words of another kind stand there in that text too", "xx", "alone"), (101, "a" * 50_000 + " b" * 20, None, None), (102, "|||| #### &&&& " * 9, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_words", F.lit("x")).withColumn("distance", F.lit("x")).withColumn("start", F.lit(1))
    got = {x.doc_id: x for x in Q.judge(docs).collect()}
    assert len(got) == 33 and all(got[i].kept for i in range(30)) and got[100].kept and not got[102].kept
