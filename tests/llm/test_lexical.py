"""Ranked search against scoring every document, and the parts of the index."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from lattica.llm import lexical as X
from lattica.llm.queries import op12_lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=50):
    own = [(i, Counter(split(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(x for _, c in own for x in c)
    out = []
    for item, text in items:
        got = []
        for i, c in own:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(split(text)) if x in c)
            if s > 0:
                got.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(got)[:k])]
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1], r[2] is None, r[2]))


def test_query(spark, smoke):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{smoke}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{smoke}/benchmark.parquet").collect()]
    assert key(op12_lexical(spark, smoke).collect()) == key(plain(docs, items))


def test_edges(spark):
    """Nulls, texts without terms, copies, ties, repeated ids, missing ids, very long texts, extra columns."""
    docs = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, ".,; --"), (None, "alpha gamma"), (5, "Alpha-ALPHA alpha"), (6, "word " * 30_000 + "alpha"), (7, "éa中 éA 09")] + [(i, "same text beta") for i in range(100, 170)]
    items = [(1, "alpha"), (2, "beta same"), (2, "beta same"), (3, None), (4, "--"), (5, "unheard of"), (6, "09 ÉA éa"), (None, "gamma")]
    rows = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, shard int, cluster string")
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    for levels, shard_docs in ((0, 4096), (3, 10)):
        index = X.build(rows, levels=levels, rounds=2, shard_docs=shard_docs)
        got = X.search(index, asked, k=20).collect()
        wanted = plain(docs, [x for x in dict.fromkeys(items)], k=20)
        place = lambda rows: sorted(((r[0] or -1, r[1], r[2] or -1, r[3]) for r in rows))
        assert place(got) == place(wanted)
        assert index.shards.count() >= (8 if shard_docs == 10 else 1)
    empty = rows.limit(0)
    assert X.search(X.build(empty), asked).count() == 0
    assert X.search(index, asked.limit(0)).count() == 0


def test_bisection_gathers_what_belongs_together(spark):
    """Texts of two vocabularies are halved by vocabulary, and search leaves clusters out without losing a rank."""
    rng = np.random.default_rng(3)
    words = [[f"w{t}x{i}" for i in range(300)] for t in range(8)]
    docs = [(i, " ".join(rng.choice(words[i % 8], 40))) for i in range(800)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    index = X.build(rows, levels=3, rounds=3, shard_docs=64)
    of = {}
    for r in index.shards.collect():
        for i in np.frombuffer(bytes(r.ids), np.int64):
            of[int(i)] = r.cluster
    assert len(of) == 800
    topics = [Counter(i % 8 for i in of if of[i] == c) for c in set(of.values())]
    assert sum(max(t.values()) for t in topics) >= 0.45 * 800  # one in eight by chance
    seen = []
    items = [(t, " ".join(words[t][:12])) for t in range(8)]
    got = X.search(index, spark.createDataFrame(items, "item_id long, text string"), k=10, visited=seen).collect()
    assert key(got) == key(plain(docs, items, k=10))
    assert seen[0][0] < seen[0][1]


def test_items_in_batches(spark, monkeypatch):
    monkeypatch.setattr(X, "BATCH_ITEMS", 2)
    docs = [(i, f"a{i % 5} b{i % 3}") for i in range(30)]
    index = X.build(spark.createDataFrame(docs, "doc_id long, text string"), levels=1)
    items = [(i, f"a{i} b1") for i in range(5)]
    assert key(X.search(index, spark.createDataFrame(items, "item_id long, text string"), k=7).collect()) == key(plain(docs, items, k=7))
