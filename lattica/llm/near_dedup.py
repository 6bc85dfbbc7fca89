"""Near-duplicate documents by min-max hashing.

Under each permutation both the least and the greatest value of a document's
shingles are kept, so that half as many permutations are evaluated as the
signature has values; the values are banded as usual.

1. Documents with equal shingle sets form one class (a 128-bit digest of the
   set); only one of each goes on, so exact copies never meet in a bucket.
2. Classes in one bucket of a band are candidates.  A bucket of m classes is
   not expanded into pairs: each class is first checked against one class, the
   most central (that with the most bucket mates over all bands) of all that
   stand in its buckets.
3. In buckets that still hold several components, each class outside the most
   central one's component is checked against that one of the component's
   spread-out members which looks nearest by sketch, for some rounds; and
   then against every class of its buckets in another component, unless their
   sketches differ by more than a pair at the threshold can.  This last step
   makes the result whole: no bucket, partner or pair is capped.  Only classes of
   like size meet, and the classes of a full bucket are dealt to squares of at
   most ``SQUARE`` a side, each a join key of its own, so that no task gets a bucket whole.
4. Links are confirmed on the full sets (64-bit shingle hashes of whole texts,
   sorted; the chance that a collision changes a comparison is below 1e-9).
   Components of the links give each document its ``component_id``.

A sketch holds the parity of the number of shingles in each of its cells (an odd
sketch), of which it has ``BITS`` for up to ``FULL`` shingles and twice as many for
each doubling.  Two sketches differ in no more cells than the sets differ in
shingles, so that a pair at the threshold is never dropped, whatever its size.
A sketch of twice the cells is folded to compare it with a smaller one.

Lists of keys, buckets and pairs are broadcast if a count shows that they are
few (``FEW`` narrow rows), so that whole texts are not shuffled to find the few
that are compared; beyond that Spark shuffles these joins.

With four values a band, so many bands are used that two documents exactly at
the threshold share none with a chance of at most ``miss``.

Null and empty texts have no shingles, link with nothing and stay.  Texts with
fewer words than a shingle have one, the whole sequence.  Repeated rows share
one class.  A null doc_id is kept apart: it has component null and is kept, but
does not name a component.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .components import components
from .textvec import Powers, mix64, set_key, shingles

ROWS = 4
#: Spread-out members of a bucket's central component that others are checked against.
REPRESENTATIVES = 8
#: Cells of a sketch of a set of at most so many shingles.
BITS, FULL = 1024, 2048
#: Classes of a bucket on each side of a join key, about.
SQUARE = 1024
#: Shingles of texts compared before that a worker keeps, 8 bytes each.
MOST_HELD = 1 << 20
#: Most rows, of a few numbers each, of a list that may be broadcast.
FEW = 500_000


def bands_for(threshold: float, miss: float) -> int:
    n = math.ceil(math.log(miss) / math.log1p(-(threshold**ROWS)))
    return n + n % 2  # as many minima as maxima


def min_max(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of the upper halves of a * s + b, over all of ``s``."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    for at in range(0, len(s), 2048):
        x = s[at : at + 2048, None] * a + b
        np.minimum(low, x.min(axis=0), out=low)
        np.maximum(high, x.max(axis=0), out=high)
    return np.concatenate([low, high]) >> np.uint64(32)


def level_of(n: int) -> int:
    """Doublings of the cells for a set of n shingles."""
    return max(0, (n - 1).bit_length() - FULL.bit_length() + 1)


def odd_sketch(s: np.ndarray, level: int) -> np.ndarray:
    """Parity of each of ``BITS << level`` cells as signed words; none below level 0."""
    cells = BITS << level if level >= 0 else 0
    if not cells:
        return np.zeros(0, np.int64)
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def same_bucket(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """``left(h, key, n, ..)`` joined with ``right(_h, a_key, a_n, ..)`` of the same bucket and of a size within ``percent``, square by square."""
    left, right = squares(left, right, percent)
    on = (F.col("h") == F.col("_h")) & (F.col("_z") == F.col("_z2")) & (F.col("_i") == F.col("r_j")) & (F.col("_j") == F.col("r_i"))
    fits = 100 * F.least("n", "a_n") >= percent * F.greatest("n", "a_n")
    return left.join(right, on).where(fits).drop("_z", "_z2", "_i", "_j", "r_i", "r_j")


def squares(left: DataFrame, right: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of :func:`same_bucket` with the columns of its join key.

    Sizes are cut into ranges so wide that two sizes within ``percent`` lie in
    the same or in neighbouring ones; bucket and range are the join's key, with the
    numbers of a square where they hold more than ``SQUARE`` classes of a side.
    """
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    size = lambda n: F.floor(F.log(F.col(n).cast("double")) / width).cast("long")
    left = left.withColumn("_z", F.explode(F.sequence(size("n") - 1, size("n") + 1)))
    right = right.withColumn("_z2", size("a_n"))
    full = []
    for df, h, z, parts in ((left, "h", "_z", "_p"), (right, "_h", "_z2", "_q")):
        held = df.groupBy(F.col(h).alias("_b"), F.col(z).alias("_s")).agg(F.ceil(F.count("*") / SQUARE).cast("int").alias(parts))
        full.append(held.where(F.col(parts) > 1))
    full = cut(full[0].join(full[1], ["_b", "_s"], "full_outer").select("_b", "_s", F.coalesce("_p", F.lit(1)).alias("_p"), F.coalesce("_q", F.lit(1)).alias("_q")))
    split = small(full)

    def dealt(df: DataFrame, h: str, z: str, own: str, other: str, side: str) -> DataFrame:
        """Rows dealt to their own parts by key, and copied to each part of the other side."""
        df = df.join(split, (F.col(h) == F.col("_b")) & (F.col(z) == F.col("_s")), "left").drop("_b", "_s")
        mine = F.coalesce(F.pmod(F.xxhash64("key" if side == "" else "a_key"), F.col(own)), F.lit(0)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        return df.withColumn(f"{side}_i", mine).withColumn(f"{side}_j", theirs).drop("_p", "_q")

    return dealt(left, "h", "_z", "_p", "_q", ""), dealt(right, "_h", "_z2", "_q", "_p", "r")


def text_hash() -> Column:
    """Tells apart the texts that stand under one doc_id."""
    return F.xxhash64("text").alias("text_hash")


def signatures(docs: DataFrame, k: int, bands: int, seed: int = 5) -> DataFrame:
    """doc_id, text_hash, key (of the shingle set), n_shingles, bands, and the sketches of the set's level and the one below, for each row."""
    perms = bands * ROWS // 2

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        a, b = (rng.integers(0, 2**63, perms, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        powers = Powers()
        for part in parts:
            keys, counts, buckets, fine, coarse = [], [], [], [], []
            for text in part["text"]:
                s = shingles(text, k, powers)
                keys.append(set_key(s))
                counts.append(len(s))
                if not len(s):
                    buckets.append(None)
                    fine.append(None)
                    coarse.append(None)
                    continue
                sig = min_max(s, a, b)
                h = salt.copy()
                for v in sig.reshape(bands, ROWS).T:
                    h = mix64(h ^ v) + v
                buckets.append(h.view(np.int64))
                fine.append(odd_sketch(s, level_of(len(s))))
                coarse.append(odd_sketch(s, level_of(len(s)) - 1))
            yield pd.DataFrame({"doc_id": part["doc_id"], "text_hash": part["text_hash"], "key": keys, "n_shingles": counts, "bands": buckets, "fine": fine, "coarse": coarse})

    return docs.select("doc_id", "text", text_hash()).mapInPandas(run, "doc_id long, text_hash long, key binary, n_shingles long, bands array<long>, fine array<long>, coarse array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of ``pairs(a, a_doc, b, b_doc)``, keys and a document of each, those that reach ``percent``."""

    def with_text(x: str) -> DataFrame:
        own = texts.select(F.col("doc_id").alias(f"{x}_doc"), F.col("text").alias(f"{x}_text"))
        return own.join(small(pairs, FEW), f"{x}_doc").select("a", "b", f"{x}_text")

    full = with_text("a").join(with_text("b"), ["a", "b"]).select("a", "a_text", "b", "b_text").sortWithinPartitions("a")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, known, held = Powers(), {}, [0]

        def get(key: bytes, text: str) -> np.ndarray | None:
            if (s := known.get(key)) is None:
                s = shingles(text, k, powers)
                if set_key(s) != key:  # another text under the same doc_id
                    return None
                held[0] += len(s)
                if held[0] > MOST_HELD:  # at most about so many shingles are kept
                    known.clear()
                    held[0] = len(s)
                known[key] = s
            return s

        for part in parts:
            keep = []
            for a, at, b, bt in zip(part["a"], part["a_text"], part["b"], part["b_text"], strict=True):
                x, y = get(bytes(a), at), get(bytes(b), bt)
                if x is None or y is None:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.loc[keep, ["a", "b"]]

    return cut(full.mapInPandas(run, "a binary, b binary").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, rounds: int = 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``percent`` is the least share, in hundredths, of the intersection in the
    union of two sets that links them.
    """
    return grouped(docs, k, percent, miss, rounds).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, rounds: int = 2) -> DataFrame:
    """``near_duplicates`` with each row's text_hash and component_key, a key of its component.

    Where one id stands on several texts, two components may have the same
    component_id, but not the same key.  Rows that link with nothing for want
    of shingles or an id have none.
    """
    every = cut(signatures(docs, k, bands_for(percent / 100, miss)))
    classes = cut(
        every.where("n_shingles > 0 and doc_id is not null").groupBy("key")
        .agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("fine").alias("fine"), F.first("coarse").alias("coarse"))
    )
    rows = classes.select("key", "doc", "n", F.explode("bands").alias("h"))
    shared = cut(rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"))
    members = cut(rows.join(small(shared, FEW), "h"))
    mates = members.groupBy("key").agg(F.sum("m").alias("mates"))
    members = cut(members.drop("m").join(small(cut(mates), FEW), "key"))
    ids = members.select(F.col("doc").alias("_id")).distinct()
    texts = cut(docs.select("doc_id", "text").join(small(cut(ids), FEW), F.col("doc_id") == F.col("_id"), "left_semi"))

    centres = cut(members.groupBy("h").agg(F.max(F.struct("mates", "key", "doc", "n")).alias("c")))
    fits = lambda m: 100 * F.least("n", m) >= percent * F.greatest("n", m)
    stars = members.join(small(centres, FEW), "h").where((F.col("key") != F.col("c.key")) & fits(F.col("c.n"))).groupBy("key", "doc").agg(F.max("c").alias("c"))
    tried = cut(_pairs(stars.select("key", "doc", F.col("c.key").alias("a_key"), F.col("c.doc").alias("a_doc"))))
    edges = confirmed(tried, texts, k, percent)
    roots = components(edges)

    # two sets at the threshold differ in so many shingles at most, and their sketches in no more cells
    level = lambda n: F.greatest(F.lit(0), F.ceil(F.log2(F.col(n).cast("double"))) - (FULL.bit_length() - 1)).cast("int")
    common = F.least(F.col("level"), F.col("a_level"))
    of = lambda side: F.when(F.col(f"{side}level") == common, F.col(f"{side}fine")).otherwise(F.col(f"{side}coarse"))
    differ = F.aggregate(F.zip_with(of(""), of("a_"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (F.abs(F.col("level") - F.col("a_level")) > 1) | (differ <= (100 - percent) / (100 + percent) * (F.col("n") + F.col("a_n")) + 1e-9)
    apart = differ / (F.col("n") + F.col("a_n"))
    whole = ("key", "doc", "n", "root", "level", "fine", "coarse")
    for last in [False] * rounds + [True]:
        # buckets of several components, and the component of the most central class of each
        placed = members.join(small(roots, FEW), F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
        placed = cut(placed)
        held = placed.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(F.struct("mates", "key", "root")).alias("c"))
        mixed = cut(held.where("r0 != r1").select("h", F.col("c.root").alias("main")))
        wide = placed.join(small(mixed, FEW), "h").join(classes.select(F.col("key").alias("_k"), "fine", "coarse"), F.col("key") == F.col("_k")).drop("_k")
        wide = cut(wide.withColumn("level", level("n")))
        right = wide
        if not last:
            picks = [F.min_by(F.struct(*whole), F.xxhash64(F.lit(i), "key")) for i in range(REPRESENTATIVES)]
            chosen = wide.where("root = main").groupBy("h").agg(F.array_distinct(F.array(*picks)).alias("x"))
            right = cut(chosen.select("h", F.explode("x").alias("x")).select("h", "x.*"))
        right = right.select(F.col("h").alias("_h"), *[F.col(c).alias(f"a_{c}") for c in whole])
        found = same_bucket(wide.where("root != main"), right, percent).where((F.col("root") != F.col("a_root")) & near)
        a, b = tried.select(F.col("a").alias("_a"), F.col("b").alias("_b")), _pairs(found.select("key", "doc", "a_key", "a_doc", apart.alias("apart")), "apart", "key")
        new = b.join(small(cut(a), FEW), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
        if not last:  # the one that looks nearest
            new = new.groupBy("key").agg(F.min_by(F.struct("a", "a_doc", "b", "b_doc"), F.struct("apart", "a", "b")).alias("x")).select("x.*")
        new = cut(new.select("a", "a_doc", "b", "b_doc").distinct())
        tried = tried.unionByName(new)
        more = confirmed(new, texts, k, percent)
        if more.limit(1).count():
            edges = edges.unionByName(more)
            roots = components(edges)

    # a class that links with nothing has its own documents' least id
    known = classes.select("key", "doc").join(small(roots, FEW), F.col("key") == F.col("node"), "left").select("key", "doc", F.coalesce("root", "key").alias("root"))
    known = cut(known)
    least = cut(known.where("root != key").groupBy("root").agg(F.min("doc").alias("_least")).withColumnRenamed("root", "_r"))
    named = known.join(small(least, FEW), F.col("root") == F.col("_r"), "left").select(F.col("key").alias("_key"), F.least("doc", "_least").alias("component"), "root", "_r", "doc")
    # the root itself is not among those above, and may hold the least id
    heads = cut(named.where("_key = root and _r is not null").select(F.col("root").alias("_r2"), F.col("component").alias("_c")))
    named = cut(named.join(small(heads, FEW), F.col("root") == F.col("_r2"), "left").select("_key", F.coalesce("_c", "doc").alias("component"), F.col("root").alias("component_key")))
    out = every.select("doc_id", "text_hash", "key", "n_shingles").join(named, (F.col("key") == F.col("_key")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), "component_key", kept)


def _pairs(found: DataFrame, *more: str) -> DataFrame:
    """``found(key, doc, a_key, a_doc)`` as pairs with a < b."""
    swap = F.col("key") < F.col("a_key")
    either = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    return found.select(either("key", "a_key").alias("a"), either("doc", "a_doc").alias("a_doc"), either("a_key", "key").alias("b"), either("a_doc", "doc").alias("b_doc"), *more)
