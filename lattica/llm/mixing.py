"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

1. Each source's target is its weight's share of all words, at most ``most``
   times its own words; what that cuts off goes to the others by weight.
2. Documents stand on a line of words in their source, in a fixed pseudo-random
   order (a hash of id and text).  The words before each are found digit by
   digit of the hash, from sums over ranges of it, never by sorting a source.
   The line is cut into blocks of ``block_words`` words (longer ones where a
   source would have over ``most_blocks``); a document is whole in the block of
   its first word.
3. A source's quota is a number of blocks: all of them for each whole pass that
   its target holds, and in a last pass, in an order of its own, as many as its
   rest of words fills by the blocks' exact words.  The last block is taken in
   part, up to the last word of the target.
4. A binary tree splits the quotas among the output shards: each node draws its
   left child's counts from the multivariate hypergeometric distribution by
   inverting its probability function.
5. Each pass permutes a source's blocks by an affine map.  The shards draw
   disjoint ranges of the numbers so given, and what no shard has drawn is not in the
   mix: shard, place and ``taken`` all come from the draws.  Rows are shuffled
   inside each shard by a hash (``dealt``, ``write``).

Only built-in functions are used, and all draws come from hashes of ``seed``,
so that reruns agree.  Sources are assumed to be few enough for a table with a
row a source to stand in one task; that is all that such windows hold.

Null and empty texts have size 0 and are never taken; a null source is a source
of its own, last in order.  A source without words has target 0.  Rows that are
wholly equal stand at the same place of the order and share what it is given.
Texts of any length count whole.  Tables without rows give none.  Columns named
as those that are added are replaced; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, cut, small


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Add ``target`` to one row a source with its words ``source_size``.

    A source stands at ``most`` times its size as long as that is less than its
    weight's share of what the sources before it, in order of size by weight,
    leave over.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    n = F.row_number().over(order) - 1
    sizes = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int")))
    sizes = sizes.withColumn("_cap", F.col("source_size") * float(most))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    sizes = sizes.withColumn("_share", left / rest)
    # the shares rise up to the first source that isn't full, and fall from there on
    sizes = sizes.withColumn("_level", F.max("_share").over(everything))
    return sizes.withColumn("target", F.least(F.col("_cap"), F.col("_level") * F.col("_w"))).select("source", "source_size", "target")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which stands in the expression and is evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _ln_factorial(n: Column) -> Column:
    """Stirling's series at n + 8, then down again."""
    x = n + F.lit(9.0)
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return series - F.log((n + 1) * (n + 2) * (n + 3) * (n + 4)) - F.log((n + 5) * (n + 6) * (n + 7) * (n + 8))


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """The number of marked ones among ``drawn`` of ``total``, for a uniform ``u``.

    Probabilities are gone through from the most likely value outwards, one up
    and one down by turns, until they exceed ``u``.
    """
    d = lambda c: c.cast("double")
    given = F.struct(u.alias("u"), d(total).alias("t"), d(marked).alias("m"), d(drawn).alias("d"))

    def draw(g: Column) -> Column:
        t, m, n = g["t"], g["m"], g["d"]
        low, high = F.greatest(F.lit(0.0), n - (t - m)), F.least(m, n)
        mode = d(F.least(high, F.greatest(low, F.floor((n + 1) * (m + 1) / (t + 2)))))
        return _let(F.struct(low.alias("low"), high.alias("high"), mode.alias("mode")), lambda e: walk(g, e))

    def walk(g: Column, e: Column) -> Column:
        t, m, n, k = g["t"], g["m"], g["d"], e["mode"]
        plus, minus = F.array(m, t - m, n, t - n), F.array(k, m - k, n - k, t - m - n + k, t)
        total_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + _ln_factorial(x))
        # beyond twelve standard deviations on either side lies less than the 2 ** -54 that u keeps from 0 and 1
        var = n * m * (t - m) * (t - n) / (F.greatest(t, F.lit(1.0)) * F.greatest(t, F.lit(1.0)) * F.greatest(t - 1, F.lit(1.0)))
        steps = F.least(e["high"] - e["low"], F.ceil(24 * F.sqrt(var) + 40)).cast("int")
        start = lambda p: F.struct(k.alias("a"), p.alias("pa"), k.alias("b"), p.alias("pb"), (g["u"] - p).alias("u"), F.when(g["u"] <= p, k).alias("k"))
        return F.aggregate(F.sequence(F.lit(0), steps), _let(F.exp(total_of(plus) - total_of(minus)), start), lambda acc, i: step(g, e, acc, i), lambda acc: F.coalesce(acc["k"], k).cast("long"))

    def step(g: Column, e: Column, acc: Column, i: Column) -> Column:
        t, m, n, a, b = g["t"], g["m"], g["d"], acc["a"], acc["b"]
        rises = ((i % 2 == 0) & (a < e["high"])) | (b <= e["low"])
        up = acc["pa"] * (m - a) * (n - a) / ((a + 1) * (t - m - n + a + 1))
        down = acc["pb"] * b * (t - m - n + b) / ((m - b + 1) * (n - b + 1))
        kept = lambda x: {"a": a, "pa": acc["pa"], "b": b, "pb": acc["pb"]} | x

        def to(k: Column, q: Column, names: tuple[str, str]) -> Column:
            return _let(q, lambda p: F.struct(*[v.alias(c) for c, v in kept({names[0]: k, names[1]: p}).items()], (acc["u"] - p).alias("u"), F.when(acc["u"] <= p, k).alias("k")))

        done = acc["k"].isNotNull() | ((a >= e["high"]) & (b <= e["low"]))
        return F.when(done, acc).when(rises, to(a + 1, up, ("a", "pa"))).otherwise(to(b - 1, down, ("b", "pb")))

    return _let(given, draw)


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deal ``quotas(source, blocks)`` to shards: rows source, shard, first, blocks.

    ``first`` is the number of the source's blocks that lie in earlier shards.
    Shards hold equally many blocks, give or take one.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("z"), "source", "blocks"))).alias("q"))
    node = node.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.transform("q", lambda x: x["blocks"]).alias("n"), F.transform("q", lambda x: x["source"]).alias("sources"))
    for _ in range(max(0, (shards - 1).bit_length())):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        node = node.withColumn("mid", mid).withColumn("all", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))
        node = node.withColumn("draw", F.floor(F.col("all") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long"))

        def one(acc: Column, x: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), F.size(acc["out"])), 11).cast("double") + 0.5) / float(2**53)
            split = lambda k: F.struct((acc["total"] - x).alias("total"), (acc["draw"] - k).alias("draw"), F.concat(acc["out"], F.array(k)).alias("out"))
            return _let(hypergeometric(u, acc["total"], x, acc["draw"]), split)

        begin = F.struct(F.col("all").alias("total"), F.col("draw").alias("draw"), F.array().cast("array<bigint>").alias("out"))
        node = node.withColumn("left", F.aggregate("n", begin, one, lambda acc: acc["out"]))
        node = node.withColumn("left", F.when(F.col("mid") > F.col("lo"), F.col("left")).otherwise(F.transform("n", lambda _: F.lit(0).cast("long"))))
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("n")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.zip_with("n", "left", lambda a, b: a - b).alias("n")),
        )
        node = node.select("sources", F.explode(F.filter(halves, lambda h: h["lo"] < h["hi"])).alias("h")).select("sources", "h.*")
    rows = node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("n").alias("blocks"))).alias("x")).select("shard", "x.*")
    first = F.coalesce(F.sum("blocks").over(W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return rows.withColumn("first", first)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, shards: int = 16, block_words: int = 4096, most_blocks: int = 1 << 16, seed: int = 17) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, taken and ``copies``.

    ``copies`` lists the shares of a document in the mix, a struct of pass,
    words, block, shard and place (the order inside the shard), one for each pass that
    takes it.  ``taken`` is the sum of their words.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "copies", "_h", "_p", "_before", "_ties", "_block")
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 1)
    docs = docs.withColumn("size", count_words(F.col("text"))).withColumn("_h", h)
    slim = cut(docs.select("source", "_h", "size"))
    by_source = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    words = F.greatest(F.lit(block_words), F.ceil(F.col("source_size") / most_blocks)).cast("long")
    by_source = by_source.withColumn("block_words", words).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    whole = F.floor(F.col("target")).cast("long")
    by_source = by_source.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long"))
    by_source = cut(by_source.withColumn("rest", whole - F.col("passes") * F.col("source_size")))
    docs = _on_lines(docs, slim, by_source)
    quotas, last = _quotas(_on_lines(slim, slim, by_source), by_source, seed)
    deal = cut(split_tree(cut(quotas), shards, seed)).where("blocks > 0")
    deal = deal.groupBy(F.col("source").alias("_s")).agg(F.sort_array(F.collect_list(F.struct("first", "shard", "blocks"))).alias("deal"))
    given = by_source.join(deal, F.col("_s").eqNullSafe(F.col("source")), "left").drop("_s")
    given = given.join(last, F.col("_s").eqNullSafe(F.col("source")), "left").drop("_s")
    given = cut(given.select(F.col("source").alias("_s"), F.struct(*[c for c in given.columns if c != "source"]).alias("_p")))
    out = docs.join(small(given), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    p = lambda name: F.col(f"_p.{name}")
    # of the last pass's last block only the first words are taken; equal rows share theirs
    part = F.floor(F.greatest(p("cut_words") - (F.col("_before") - p("cut_start")), F.lit(0)) / F.col("_ties"))
    ends = F.when(F.col("_block") == p("cut_block"), F.least(part, F.col("size"))).otherwise(F.col("size"))

    def copy(i: Column) -> Column:
        number = i * p("blocks") + _permuted(F.col("_block"), p("blocks"), i, seed)
        drawn = F.filter(p("deal"), lambda d: (d["first"] <= number) & (number < d["first"] + d["blocks"]))
        n = F.when(i < p("passes"), F.col("size")).otherwise(ends).cast("long")
        return F.struct(i.alias("pass"), n.alias("words"), F.col("_block").alias("block"), F.get(drawn, F.lit(0))["shard"].alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("_h"), i).alias("place"))

    every = F.transform(F.sequence(F.lit(0), p("passes").cast("int")), copy)
    out = out.withColumn("copies", F.filter(every, lambda x: x["shard"].isNotNull() & (x["words"] > 0)))
    out = out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
    kept = [c for c in docs.columns if c not in ("_h", "_before", "_ties", "_block")]
    return out.select(*kept, p("source_size").alias("source_size"), p("target").alias("target"), "copies", "taken")


def _on_lines(docs: DataFrame, slim: DataFrame, by_source: DataFrame) -> DataFrame:
    """Add to ``docs(source, _h, size)`` the words before each on its source's line, the rows at its place, and its block."""
    bits = max(8, (slim.count() >> 16).bit_length())
    bucket = F.shiftright("_h", 63 - bits)
    sums = slim.groupBy(F.col("source").alias("_s"), bucket.alias("_b")).agg(F.sum("size").alias("_words"))
    run = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("_s", "_b", F.coalesce(F.sum("_words").over(run), F.lit(0).cast("long")).alias("_base"))
    per = by_source.select(F.col("source").alias("_s2"), F.col("block_words").alias("_length"), F.col("blocks").alias("_most"))
    base = small(cut(base.join(small(per), F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")))
    own = W.partitionBy("source", "_bucket")
    out = docs.withColumn("_bucket", bucket).withColumn("_cum", F.sum("size").over(own.orderBy("_h").rangeBetween(W.unboundedPreceding, 0)))
    out = out.withColumn("_ties", F.count("*").over(W.partitionBy("source", "_bucket", "_h")))
    out = out.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    out = out.withColumn("_before", F.col("_base") + F.col("_cum") - F.col("_ties") * F.col("size"))
    block = F.least(F.floor(F.col("_before") / F.col("_length")).cast("long"), F.col("_most") - 1)
    return out.select(*docs.columns, "_before", "_ties", block.alias("_block"))


def _quotas(line: DataFrame, by_source: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Blocks that each source gives (source, blocks), and the block that it gives in part (_s, cut_block, cut_words, cut_start)."""
    held = line.where("size > 0").groupBy(F.col("source").alias("_s"), "_block").agg(F.sum("size").alias("_words"), F.min("_before").alias("_start"))
    held = held.join(small(by_source), F.col("_s").eqNullSafe(F.col("source")))
    held = held.withColumn("_at", _permuted(F.col("_block"), F.col("blocks"), F.col("passes"), seed))
    run = W.partitionBy("_s").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)  # of at most most_blocks rows
    before = F.coalesce(F.sum("_words").over(run), F.lit(0).cast("long"))
    drawn = cut(held.withColumn("_sum", before).where(F.col("_sum") < F.col("rest")).withColumn("_left", F.col("rest") - F.col("_sum")))
    last = drawn.groupBy("_s").agg(F.max_by(F.struct("_block", "_left", "_start", "_at"), "_at").alias("x"))
    last = cut(last.select("_s", F.col("x._block").alias("cut_block"), F.col("x._left").alias("cut_words"), F.col("x._start").alias("cut_start"), (F.col("x._at") + 1).alias("_n")))
    quotas = by_source.join(small(last), F.col("_s").eqNullSafe(F.col("source")), "left")
    quotas = quotas.select("source", (F.col("passes") * F.col("blocks") + F.coalesce("_n", F.lit(0))).cast("long").alias("blocks"))
    return quotas, last.drop("_n")


def _permuted(block: Column, n: Column, pass_: Column, seed: int) -> Column:
    """An affine permutation of 0 .. n-1 for each pass: the multiplier is a prime that does not divide n."""
    a = F.when(n % 1000003 != 0, 1000003).otherwise(998244353)
    return F.pmod(block * a + F.pmod(F.xxhash64(F.lit(seed), n, pass_.cast("long")), n), n)


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy, with its pass, words, block, shard and place."""
    return mixed.select("*", F.explode("copies").alias("_c")).select(*[c for c in mixed.columns if c not in ("copies", "taken")], "_c.*")


def dealt(copies: DataFrame) -> DataFrame:
    """``emit``'s rows by shard, shuffled locally: in order of place in each shard.

    Partitions are ranges of shard and place, so a shard may go over several,
    that follow one another.
    """
    return copies.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def write(copies: DataFrame, path: str) -> None:
    """Write ``emit``'s rows, a folder a shard; its files in order of name are its rows in order of place."""
    dealt(copies).write.partitionBy("shard").parquet(path)
