"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample of distinct vectors (``sample_rows``,
those of least hash, and of at most ``sample_bytes``; everything else covers all rows): a node splits its part
of the sample at the median of the projection on the difference of two of its
points.  All vectors are then dealt to the leaves, and the index is written once,
by tree and leaf, in blocks of bounded size.  A query goes through one
priority queue that all trees share, nearest margins first, and collects leaves
until they hold ``search`` vectors.  Queries come in batches of bounded size that
every task of the index has at hand: a task goes through its leaves, multiplies
each with the queries that visit it, and keeps each query's nearest by the exact
cosine in double precision.  So neither the index nor the queries are shuffled
for a search, and a leaf that many queries visit is no task's group.

Equal vectors are one node of the index, with the ids of its ``k + 1`` least
rows, so that a vector that many rows hold meets a query once; queries with
equal vectors are searched once.

The queue's budget is a share of the index, as recall depends on that share: of
64 independent normal components, as the test tables hold, half the index must
be compared for nine of ten neighbours, at any size.  Vectors that lie in
clusters or in few dimensions need a far smaller ``search``.

Vectors that are null, empty, zero, or hold null or non-finite components take
no part, neither as queries nor as candidates; nor do rows without an id or with
another length than that of most rows (of the smaller, if two are as common).  Of rows that repeat an id, each
distinct vector is a candidate, and the query's own id is never returned.  Ties
go to the smaller id.  A table without usable rows gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut


@dataclass
class Tree:
    """Nodes in arrays: plane and offset of inner nodes, children, and the sample's rows in each node."""

    plane: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    count: np.ndarray


def fit_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    plane, offset, left, right, count = [], [], [], [], []

    def node(rows: np.ndarray) -> int:
        me = len(left)
        plane.append(np.zeros(x.shape[1], np.float32))
        offset.append(0.0)
        left.append(-1)
        right.append(-1)
        count.append(len(rows))
        return me

    todo = [(node(np.arange(len(x))), np.arange(len(x)))]
    while todo:
        me, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        a, b = x[rng.choice(rows, 2, replace=False)]
        way = a - b
        size = np.linalg.norm(way)
        if size == 0:
            continue
        way = (way / size).astype(np.float32)
        at = x[rows] @ way
        middle = float(np.median(at))
        low = at < middle
        if not 0 < low.sum() < len(rows):
            continue
        plane[me], offset[me] = way, middle
        for side, part in ((left, rows[low]), (right, rows[~low])):
            side[me] = node(part)
            todo.append((side[me], part))
    return Tree(np.array(plane), np.array(offset, np.float32), np.array(left), np.array(right), np.array(count))


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(tree.left[at] >= 0)
        if not len(inner):
            return at
        n = at[inner]
        right = np.einsum("ij,ij->i", x[inner], tree.plane[n]) >= tree.offset[n]
        at[inner] = np.where(right, tree.right[n], tree.left[n])


def search_leaves(trees: list[Tree], q: np.ndarray, search: float) -> list[tuple[int, int]]:
    """Leaves (tree, node) in order of their nearest margin, until they hold ``search`` sampled rows."""
    queue = [(-np.inf, t, 0) for t in range(len(trees))]
    heapq.heapify(queue)
    out, held = [], 0.0
    while queue and held < search:
        margin, t, n = heapq.heappop(queue)
        tree = trees[t]
        while tree.left[n] >= 0:
            d = float(q @ tree.plane[n]) - float(tree.offset[n])
            near, far = (tree.right[n], tree.left[n]) if d >= 0 else (tree.left[n], tree.right[n])
            heapq.heappush(queue, (max(margin, abs(d)), t, int(far)))
            n = near
        out.append((t, int(n)))
        held += tree.count[n]
    return out


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.col(vec_id).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


_KEY = pa.struct([("cid", pa.int64()), ("h", pa.int64())])


def _batches(probes: DataFrame, most: int) -> Iterator[list]:
    rows = []
    for r in probes.toLocalIterator():
        rows.append(r)
        if len(rows) == most:
            yield rows
            rows = []
    if rows:
        yield rows


def _searched(asked: list, k: int, trees: int):
    """What a task makes of its part of the index for a batch of queries: (qid, cid, score) of the nearest of each."""
    q = np.array([r.v for r in asked], np.float64)
    sizes = np.sqrt((q * q).sum(axis=1))
    qid = np.array([(r.qid.cid, r.qid.h) for r in asked], np.int64)
    leaf = np.concatenate([np.array(r.visits, np.int64) for r in asked])
    owner = np.repeat(np.arange(len(asked)), [len(r.visits) for r in asked])
    order = np.argsort(leaf, kind="stable")
    leaf, owner = leaf[order], owner[order].astype(np.int32)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = -1
        best: tuple[np.ndarray, ...] = ()
        least = np.full(len(asked), -np.inf)

        def result() -> pa.RecordBatch:
            who, cid, h, score = best
            struct = lambda a, b: pa.StructArray.from_arrays([pa.array(a), pa.array(b)], fields=list(_KEY))
            return pa.RecordBatch.from_arrays([struct(qid[who, 0], qid[who, 1]), struct(cid, h), pa.array(score)], names=["qid", "cid", "score"])

        for part in parts:
            if not len(part):
                continue
            c, own = _matrix(part["v"]), part["leaf"].to_numpy(zero_copy_only=False)
            which = part["tree"].to_numpy(zero_copy_only=False)
            cid, h = (part["cid"].field(f).to_numpy(zero_copy_only=False) for f in ("cid", "h"))
            norm = np.sqrt((c * c).sum(axis=1))
            turns = np.flatnonzero(np.diff(which, prepend=-1) | np.diff(own, prepend=-1))
            found = []
            for a, b in zip(turns, np.append(turns[1:], len(c)), strict=True):
                if which[a] != tree:  # a vector stands once in a tree, so nothing is kept twice
                    best = _merged(best, found, k)
                    found = []
                    if len(best) and len(best[0]):
                        yield result()
                    tree, best = int(which[a]), ()
                    least[:] = -np.inf
                at = int(own[a]) * trees + tree
                who = owner[np.searchsorted(leaf, at) : np.searchsorted(leaf, at, "right")]
                if not len(who):
                    continue
                near = (q[who] @ c[a:b].T) / (sizes[who][:, None] * norm[a:b])
                edge = least[who]
                if b - a > k + 1:
                    edge = np.maximum(edge, -np.partition(-near, k, axis=1)[:, k])
                i, j = np.nonzero(near >= (edge - 1e-9)[:, None])
                j = j + a
                # once more, element by element, so that a pair has one score whatever the batch
                score = (q[who[i]] * c[j]).sum(axis=1) / (sizes[who[i]] * norm[j])
                found.append((who[i], cid[j], h[j], score))
            best = _merged(best, found, k)
            if len(best):
                counts = np.bincount(best[0], minlength=len(asked))
                full = counts > k
                least[full] = best[3][np.cumsum(counts)[full] - 1]
        if len(best) and len(best[0]):
            yield result()

    return run


def _merged(best: tuple, found: list[tuple], k: int) -> tuple:
    """The ``k + 1`` nearest of each query, ordered by query, score and id."""
    if not found:
        return best
    who, cid, h, score = (np.concatenate(x) for x in zip(*([best] if best else []), *found, strict=True))
    order = np.lexsort((h, cid, -score, who))
    who = who[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) <= k
    order = order[keep]
    return who[keep], cid[order], h[order], score[order]


def neighbours(
    rows: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    trees: int = 8, leaves: int = 64, least_leaf: int = 8, search: float = 1.0, block: int = 16_384, batch: int = 4096, sample_rows: int = 100_000, sample_bytes: int = 64 << 20, seed: int = 9,
) -> DataFrame:
    """Of each row for which the column ``is_query`` holds, the ``k`` nearest rows found.

    Returns query_id, rank, vec_id, score.  A tree has about ``leaves`` leaves
    (of ``least_leaf`` sampled rows at least); a query's queue ends when the
    leaves taken from all trees together hold ``search`` times the index, with
    repeats among trees.  The index is written in blocks of about ``block`` vectors
    of a tree, and ``batch`` queries are searched at once.
    """
    rows = usable(rows, vec_id, vector)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim = lengths.d if lengths else 1
    sample_rows = max(1, min(sample_rows, sample_bytes // (8 * dim)))
    rows = rows.where(F.size("v") == dim)
    least = rows.distinct().withColumn("_n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    classes = cut(least.groupBy("v").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("cid", F.struct("cid", F.xxhash64("v").alias("h"))))
    queries = cut(rows.where(is_query).select("vec_id", "v").distinct().join(classes.select("v", "cid"), "v").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")))
    wanted = queries.select("qid").distinct()

    sample = classes.orderBy(F.col("cid.h"), F.col("cid.cid")).limit(sample_rows).select("v").toArrow()
    n_all = classes.count()
    x = _unit(_matrix(sample["v"])) if len(sample) else np.zeros((0, dim), np.float32)
    rng = np.random.default_rng(seed)
    leaf = max(least_leaf, -(-len(x) // leaves))
    shared = rows.sparkSession.sparkContext.broadcast([fit_tree(x, leaf, rng) for _ in range(trees)])  # bounded by sample_rows
    goal = search * len(x)
    blocks = max(1, -(-n_all // block))

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _unit(_matrix(part["v"]))
            own = part["cid"].field("h").to_numpy(zero_copy_only=False) % blocks
            for t, tree in enumerate(shared.value):
                names = ["tree", "own", "leaf", "cid", "v"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t)), pa.array(own), pa.array(leaves_of(tree, x)), part["cid"], part["v"]], names=names)

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [[n * trees + t for t, n in search_leaves(shared.value, q, goal)] for q in _unit(_matrix(part["v"]))]
            yield pa.RecordBatch.from_arrays([part["qid"], part["v"], pa.array(found, pa.list_(pa.int64()))], names=["qid", "v", "visits"])

    key = "struct<cid:long,h:long>"
    kind = classes.schema["v"].dataType.simpleString()
    index = classes.select("v", "cid").mapInArrow(deal, f"tree long, own long, leaf long, cid {key}, v {kind}")
    index = cut(index.repartition("tree", "own").sortWithinPartitions("tree", "own", "leaf"))
    probes = cut(classes.join(wanted, F.col("cid") == F.col("qid")).select("v", "qid").mapInArrow(probe, f"qid {key}, v {kind}, visits array<long>"))
    scored = None
    for asked in _batches(probes.orderBy("qid"), batch):
        found = cut(index.mapInArrow(_searched(asked, k, trees), f"qid {key}, cid {key}, score double"))
        scored = found if scored is None else scored.unionByName(found)
    if scored is None:
        scored = probes.select("qid", F.col("qid").alias("cid"), F.lit(0.0).alias("score"))  # no queries
    scored = scored.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    # one class more than asked for: a query's own may hold no other row
    best = scored.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "cid"))).where(F.col("_n") <= k + 1)
    best = cut(best.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id")))
    out = queries.join(best, "qid").where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
