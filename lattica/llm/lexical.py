"""Ranked lexical search over an index clustered by recursive graph bisection.

1. **Order.**  The bipartite graph of documents and terms is bisected again and
   again, as in the reordering of inverted indexes: a document goes to the half in
   which its terms are denser, by the gain in the log-gap cost of their posting
   lists, first-order: the sum over its terms of log2(d'/n') - log2(d/n), with d of
   a half's n documents holding the term.  A round is two passes over all
   documents: the degrees of all nodes' halves are added up (terms hashed to
   ``FEATURES`` features), and the median gain of each node halves its documents
   anew.  A level's nodes are bisected at once; what is kept of it is a table of
   bounded size, from which any task tells a document's cluster.
2. **Index.**  A cluster's documents are dealt to shards of bounded size.  A shard
   is one row: its documents in order of doc_id, its distinct terms (64-bit
   hashes), the greatest impact of each term, and the postings with their impacts.
3. **Search.**  A cluster's bound for an item is the greatest, over its shards, of
   the sum of the item's weighted greatest impacts.  Each item visits its clusters
   by falling bound, one, two, four ... of them a pass, and within them only shards
   whose own bound reaches its present ``k``-th score.  It stops when no unvisited
   cluster's bound reaches that score; equal scores go on, as a smaller doc_id may
   stand there.  So the result is that of scoring every document.

A document's score is the sum, over the item's terms, once each, of

    w * ((1000000000 * tf) div (1000 * tf + 20 * m)),  m = 50 + (50 * n * N) div L,
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))

with N documents that hold a term, L terms in all, n in the document, tf of this one.
Texts are read twice (features, then postings) and shuffled once, as postings.

Null and empty texts, and those without terms, count in nothing and are never
found.  Repeated rows are documents of their own and are ranked one after the
other; rows without a doc_id come last among equal scores.  Repeated items are
searched once, an item id on several texts once for each; items without terms
find nothing.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.operators.arrays import summed_arrays

from .common import cut
from .textvec import Powers, code_points, mix64, span_hashes

#: Features to which terms are hashed for the bisection.
FEATURES = 8192
#: Stands for a missing doc_id in a shard.
NO_ID = np.iinfo(np.int64).max
#: Items, and terms of theirs, that are searched at once.
BATCH_ITEMS, BATCH_TERMS = 512, 500_000


def terms(text: str | None, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the text's terms, and how often each occurs.

    Terms are runs of digits, letters A-Z (lower-cased) and characters beyond U+007F.
    """
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cp = code_points(text, lower=True)
    ink = ((cp >= 97) & (cp <= 122) | (cp >= 48) & (cp <= 57) | (cp >= 128)).astype(np.int8)
    edge = np.diff(ink, prepend=np.int8(0), append=np.int8(0))
    return np.unique(span_hashes(cp, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), powers), return_counts=True)


def features(docs: DataFrame) -> DataFrame:
    """Rows (n, own, f) of the texts with a term: its terms, its distinct ones, and their features as 16-bit numbers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in parts:
            n, own, f = [], [], []
            for text in part["text"]:
                h, tf = terms(text.as_py(), powers)
                if len(h):
                    n.append(int(tf.sum()))
                    own.append(len(h))
                    f.append(np.unique((h >> np.uint64(40)) % np.uint64(FEATURES)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(own, pa.int64()), pa.array(f, pa.binary())], names=["n", "own", "f"])

    return docs.select("text").mapInArrow(run, "n long, own long, f binary")


@dataclass
class Level:
    """Of each node of a level: the weights of the features towards its second half, and the sum from which on a document goes there."""

    weight: np.ndarray
    least: np.ndarray


def _gains(f: list[np.ndarray], node: np.ndarray, weight: np.ndarray) -> np.ndarray:
    size = np.array([len(x) for x in f])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    return np.add.reduceat(weight[np.repeat(node, size), np.concatenate(f)].astype(np.float64), start)


def descend(f: list[np.ndarray], levels: list[Level]) -> np.ndarray:
    """The node that each document, given by its features, reaches below ``levels``."""
    node = np.zeros(len(f), np.int64)
    if f:
        for x in levels:
            node = 2 * node + (_gains(f, node, x.weight) >= x.least[node])
    return node


def _features_of(part: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in part["f"].to_pylist()]


def bisect(found: DataFrame, levels: int, rounds: int, seed: int = 12) -> list[Level]:
    """The bisection of ``found``, the rows of :func:`features`, over all of them."""
    rng, done = np.random.default_rng(seed), []

    def medians(weight: np.ndarray) -> np.ndarray:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if len(part):
                    f = _features_of(part)
                    node = descend(f, done)
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(_gains(f, node, weight))], names=["node", "g"])

        got = found.select("f").mapInArrow(run, "node long, g double").groupBy("node").agg(F.percentile_approx("g", 0.5, 1000).alias("g")).collect()
        out = np.zeros(len(weight))
        for r in got:
            out[r.node] = r.g
        return out

    def degrees(below: list[Level]) -> dict[int, np.ndarray]:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            total = np.zeros(((1 << len(below)), FEATURES + 1), np.int64)
            for part in parts:
                if len(part):
                    f = _features_of(part)
                    node = descend(f, below)
                    size = np.array([len(x) for x in f])
                    at = np.repeat(node * (FEATURES + 1), size) + np.concatenate(f)
                    total += np.bincount(at, minlength=total.size).reshape(total.shape)
                    total[:, FEATURES] += np.bincount(node, minlength=len(total))
            for half in np.flatnonzero(total[:, FEATURES]):
                yield int(half), total[half]

        return summed_arrays(found.select("f"), run, "int64")

    for depth in range(levels):
        weight = rng.choice(np.array([-1.0, 1.0], np.float32), (1 << depth, FEATURES))
        now = Level(weight, medians(weight))
        for _ in range(rounds):
            got = degrees([*done, now])
            none = np.zeros(FEATURES + 1, np.int64)
            d = np.array([got.get(i, none) for i in range(2 << depth)], np.float64)
            dense = np.log2((d[:, :FEATURES] + 1) / (d[:, FEATURES :] + 2))
            weight = (dense[1::2] - dense[0::2]).astype(np.float32)
            now = Level(weight, medians(weight))
        done.append(now)
    return done


@dataclass
class Index:
    """A table of shards, and the counts that scores need."""

    shards: DataFrame
    n_docs: int
    n_terms: int


SHARD = "shard long, cluster long, ids binary, words binary, starts binary, most binary, docs binary, impacts binary"


def build(docs: DataFrame, levels: int = 5, rounds: int = 2, shard_docs: int = 2048, shard_postings: int = 1 << 19, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index all ``docs`` in ``2 ** levels`` clusters, in shards of about so many documents or postings at most."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = cut(features(docs))
    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = total.n, total.l
    tree = bisect(found, levels, rounds) if n_docs else []

    def weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array(descend(_features_of(part), tree)), part["own"]], names=["cluster", "own"])

    held = found.select("f", "own").mapInArrow(weigh, "cluster long, own long").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("own").alias("p")).collect()
    spread = np.ones(1 << len(tree), np.int64)
    for r in held:
        spread[r.cluster] = max(-(-r.n // shard_docs), -(-r.p // shard_postings))
    base = np.concatenate([[0], np.cumsum(spread)[:-1]])

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        turn = mix64(np.full(1, TaskContext.get().partitionId(), np.uint64))[0] % np.uint64(1 << 20)
        turn = np.full(len(spread), turn, np.int64)
        for part in parts:
            rows = []
            for i, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                h, tf = terms(text.as_py(), powers)
                if len(h):
                    rows.append((i, h, tf))
            f = [np.unique((h >> np.uint64(40)) % np.uint64(FEATURES)).astype(np.int64) for _, h, _ in rows]
            cluster = descend(f, tree)
            shard = []
            for c in cluster.tolist():  # in turn, so that copies do not meet in one shard
                shard.append(int(base[c] + turn[c] % spread[c]))
                turn[c] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int64()), pa.array(cluster), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary())],
                names=["shard", "cluster", "doc_id", "h", "tf"],
            )

    def pack(group: pa.Table) -> pa.Table:
        ids = group["doc_id"].fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        (h, size), (tf, _) = _joined(group["h"], np.uint64), _joined(group["tf"], np.uint32)
        length = np.add.reduceat(tf.astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
        m = 100 - 50 + (50 * length * n_docs) // n_terms
        doc, tf = np.repeat(place, size), tf.astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, size))
        put = np.argsort(h, kind="stable")
        words, starts = np.unique(h[put], return_index=True)
        row = {
            "shard": group["shard"].slice(0, 1), "cluster": group["cluster"].slice(0, 1), "ids": [ids[order].tobytes()], "words": [words.tobytes()], "starts": [np.append(starts, len(h)).astype("<u4").tobytes()],
            "most": [np.maximum.reduceat(impact[put], starts).astype("<u4").tobytes()], "docs": [doc[put].astype("<u4" if len(ids) > 1 << 16 else "<u2").tobytes()], "impacts": [impact[put].astype("<u4").tobytes()],
        }
        return pa.table(row, schema=pa.schema([("shard", pa.int64()), ("cluster", pa.int64())] + [(x, pa.binary()) for x in ("ids", "words", "starts", "most", "docs", "impacts")]))

    pack.__annotations__ = {"group": pa.Table, "return": pa.Table}
    dealt = docs.mapInArrow(deal, "shard long, cluster long, doc_id long, h binary, tf binary")
    shards = dealt.groupBy("shard").applyInArrow(pack, SHARD)
    return Index(cut(shards, maxRecordsPerFile=4), n_docs, n_terms)


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of binaries, one after another, and how many each holds."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], np.uint8)[edge[0] : edge[-1]].view(kind), np.diff(edge) // width


def _asked(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Rows (item_id, words) of the items that hold a term."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part in parts:
            own = [terms(t.as_py(), powers)[0].view(np.int64) for t in part["text"]]
            yield pa.RecordBatch.from_arrays([part["item_id"], pa.array([x.tolist() for x in own], pa.list_(pa.int64()))], names=["item_id", "words"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    return rows.mapInArrow(run, "item_id long, words array<long>").where(F.size("words") > 0)


def _batches(rows) -> Iterator[list]:
    out, size = [], 0
    for r in rows:
        if out and (len(out) == BATCH_ITEMS or size + len(r.words) > BATCH_TERMS):
            yield out
            out, size = [], 0
        out.append(r)
        size += len(r.words)
    if out:
        yield out


def search(index: Index, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text", visited: list | None = None) -> DataFrame:
    """The ``k`` best documents of each of ``items``: rows (item_id, rank, doc_id, score).

    Items go through in batches of bounded size.  ``visited`` gets, for each
    batch, the pairs of items and clusters that were scored and all that hold a term of the item.
    """
    asked = cut(_asked(items, item_id, text))
    spark = items.sparkSession
    out = None
    for batch in _batches(asked.orderBy("item_id", "words").toLocalIterator()):
        found = _search(index, batch, k, visited)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


class Batch:
    """Items as rows of a sparse matrix over their distinct terms."""

    def __init__(self, words: list[list[int]]) -> None:
        own = [np.array(w, np.int64).view(np.uint64) for w in words]
        self.words = np.unique(np.concatenate(own))
        self.at = np.searchsorted(self.words, np.concatenate(own))
        self.start = np.concatenate([[0], np.cumsum([len(w) for w in own])[:-1]])
        self.stop = self.start + [len(w) for w in own]
        self.weight = np.zeros(len(self.words), np.int64)

    def spots(self, words: np.ndarray) -> np.ndarray:
        """Where each of the batch's terms stands in the sorted ``words`` of a shard, -1 if nowhere."""
        at = np.minimum(np.searchsorted(words, self.words), len(words) - 1)
        return np.where(words[at] == self.words, at, -1)

    def bounds(self, spots: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each item, what no document of the shard exceeds."""
        greatest = np.where(spots >= 0, most[spots], 0) * self.weight
        return np.add.reduceat(greatest[self.at], self.start)


def _lists(part: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    kinds = {"ids": np.int64, "words": np.uint64, "starts": "<u4", "most": "<u4", "docs": "", "impacts": "<u4"}
    for i in range(len(part)):
        row = {n: part[n][i].as_buffer() if n in kinds else part[n][i].as_py() for n in names}
        for n in names:
            if n == "docs":
                row[n] = np.frombuffer(row[n], "<u2" if 2 * (row["impacts"].size // 4) == row[n].size else "<u4")
        yield tuple(np.frombuffer(row[n], kinds[n]) if n in kinds and n != "docs" else row[n] for n in names)


def _search(index: Index, rows: list, k: int, visited: list | None) -> DataFrame:
    batch = Batch([r.words for r in rows])
    spark = index.shards.sparkSession

    def frequencies(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros(len(batch.words), np.int64)
        for part in parts:
            for words, starts in _lists(part, "words", "starts"):
                spots = batch.spots(words)
                total += np.where(spots >= 0, np.diff(starts.astype(np.int64))[spots], 0)
        yield 0, total

    df = summed_arrays(index.shards.select("words", "starts"), frequencies, "int64").get(0, np.zeros(len(batch.words), np.int64))
    batch.weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)

    def bounds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for part in parts:
            for cluster, words, most in _lists(part, "cluster", "words", "most"):
                b = batch.bounds(batch.spots(words), most.astype(np.int64))
                best[cluster] = np.maximum(best[cluster], b) if cluster in best else b
        for cluster, b in best.items():
            item = np.flatnonzero(b)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.full(len(item), cluster)), pa.array(b[item])], names=["item", "cluster", "bound"])

    got = index.shards.select("cluster", "words", "most").mapInArrow(bounds, "item long, cluster long, bound long").groupBy("item", "cluster").agg(F.max("bound").alias("bound"))
    ahead: list[list[tuple[int, int]]] = [[] for _ in rows]  # at most one entry an item and cluster
    for r in got.collect():
        ahead[r.item].append((-r.bound, r.cluster))
    for x in ahead:
        x.sort()
    passed, all_ = 0, sum(map(len, ahead))
    least = np.ones(len(rows), np.int64)  # what a score must reach
    best, width = None, 1
    while True:
        now = {}
        for i, x in enumerate(ahead):
            now[i] = {c for b, c in x[:width] if -b >= least[i]}
            ahead[i] = [y for y in x[width:] if -y[0] >= least[i]]
        if not any(now.values()):
            break
        passed += sum(map(len, now.values()))
        scored = cut(_scored(index, batch, now, least.copy(), k))
        every = scored if best is None else scored.unionByName(best)
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        best = cut(every.withColumn("rank", place).where(F.col("rank") <= k).drop("rank"))
        for r in best.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k).collect():
            least[r.item] = r.s
        width *= 2
    if visited is not None:
        visited.append((passed, all_))
    if best is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item long, item_id long")  # one batch
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return best.withColumn("rank", place).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _scored(index: Index, batch: Batch, wanted: dict[int, set[int]], least: np.ndarray, k: int) -> DataFrame:
    """Rows (item, doc_id, score): of each shard of the wanted clusters, the ``k`` best documents that reach ``least``."""
    by_cluster: dict[int, list[int]] = {}
    for i, clusters in wanted.items():
        for c in clusters:
            by_cluster.setdefault(c, []).append(i)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for cluster, ids, words, starts, most, docs, impacts in _lists(part, "cluster", "ids", "words", "starts", "most", "docs", "impacts"):
                if cluster not in by_cluster:
                    continue
                spots, starts = batch.spots(words), starts.astype(np.int64)
                bound = batch.bounds(spots, most.astype(np.int64))
                for i in by_cluster[cluster]:
                    if bound[i] < least[i]:
                        continue
                    score = np.zeros(len(ids), np.int64)
                    for t in batch.at[batch.start[i] : batch.stop[i]]:
                        if (s := spots[t]) >= 0:  # a term's documents are distinct
                            a, b = starts[s], starts[s + 1]
                            score[docs[a:b]] += batch.weight[t] * impacts[a:b]
                    d = np.flatnonzero(score >= least[i])
                    if len(d) > k:  # documents stand in order of their ids
                        edge = -np.partition(-score[d], k - 1)[k - 1]
                        d = np.concatenate([d[score[d] > edge], d[score[d] == edge]])[:k]
                    if len(d):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i)), pa.array(ids[d], mask=ids[d] == NO_ID), pa.array(score[d])], names=["item", "doc_id", "score"])

    return index.shards.where(F.col("cluster").isin(sorted(by_cluster))).drop("shard").mapInArrow(run, "item long, doc_id long, score long")
