"""Quality rules: per-document statistics and robust multivariate outliers.

Everything is built-in DataFrame functions.  :func:`statistics` computes the
counts of each text, :func:`robust_outliers` fits one minimum-covariance-
determinant (MCD) estimate for each language and source and gives each
document its squared Mahalanobis distance from it.

The search is the deterministic one.  Each group has three starts: its medians
and quartile ranges, its plain moments, and the moments of its hyperbolic
tangents.  A concentration step takes the ``core`` of the group that lies
nearest to an estimate and estimates again from it.  After two steps of every
start the one of the least determinant goes on, until the determinant no longer
falls; the last estimate is reweighted once, over the rows inside the 97.5 %
ellipse.  Both carry the factor that makes them consistent for normal data.
A step is one pass: sums of distance bins (of 2 %) are added up to the bin in
which the core is full, which counts whole; groups that stand still are left
out of further passes.

Covariances are regularised: a group of h core rows weighs its own by h and its
language's squared quartile ranges (a diagonal, with a floor for each statistic)
by ``PRIOR_ROWS``.  So every group has its own estimate, down to one row, and
there is no size at which the rule changes.  A row is rejected beyond the
chi-square quantile of ``TAIL``.

Null and empty texts have no words and fail the base rule.  Null ``lang`` and
``source`` are values of their own.  Texts of any length are counted whole.
Repeated rows and ties are judged alike, each row by itself.  Columns other
than doc_id, text, lang and source are not read, whatever their names.  Tables
without rows give none.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, cut, small

#: Statistics of the outlier vector, with the least standard deviation of each.
VECTOR = {"v_word_len": 0.03, "v_symbols": 0.10, "v_marks": 0.10, "v_upper": 0.05, "v_repeat": 0.10}
#: Pseudo-words by which short texts are drawn to their group's usual rates.
PRIOR_WORDS = 40.0
#: Rows that a language's spread weighs in each group's covariance.
PRIOR_ROWS = 20.0
#: Share of clean documents that may be rejected.
TAIL = 1e-9
BIN = 0.02


def chi_square_cdf(x: float, p: float) -> float:
    """By the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= half / k
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi_square_tail(x: float, p: int) -> float:
    """1 - cdf without cancellation, for whole p: the recurrence in steps of two."""
    out = math.erfc(math.sqrt(x / 2)) if p % 2 else math.exp(-x / 2)
    for k in range(3 if p % 2 else 4, p + 1, 2):
        out += math.exp((k / 2 - 1) * math.log(x / 2) - x / 2 - math.lgamma(k / 2))
    return out


def chi_square_beyond(tail: float, p: int) -> float:
    """The value that ``tail`` of the distribution lies beyond, by bisection."""
    low, high = 1e-12, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, p) > tail else (low, mid)
    return high


def consistency(share: float, p: int) -> float:
    """Factor of a covariance over the nearest ``share`` of normal rows."""
    return share / chi_square_cdf(chi_square_beyond(1 - share, p), p + 2)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marks, n_upper.

    ``n_repeat_words`` counts the words inside a five-word window that stands
    twice or more in the text; windows are first compared by hash, and only
    texts with equal hashes are compared by the words themselves.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_words", F.filter(F.split(t, f"[{SPACE}]+"), lambda w: w != ""))
    docs = docs.withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike(f"[^{SPACE}]"))
    docs = docs.withColumn("_lines", lines).withColumn("n_lines", F.size("_lines").cast("long"))
    starts = F.when(F.col("n_words") >= 5, F.sequence(F.lit(1), (F.col("n_words") - 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn("_starts", starts)
    docs = docs.withColumn("_hashes", F.transform("_starts", lambda i: F.xxhash64(*[F.element_at("_words", i + k) for k in range(5)])))
    docs = docs.withColumn("_twice", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    docs = docs.withColumn(
        "_sorted",
        F.when(F.col("_twice"), F.sort_array(F.transform("_starts", lambda i: F.struct(F.concat_ws(" ", F.slice("_words", i, 5)).alias("w"), i.alias("i"))))),
    )
    # of neighbours in order of their words, those equal to the one before or after
    n = F.size("_sorted")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.transform("_sorted", lambda x: x["w"]), F.lit(1), n - 1))
    after = F.concat(F.slice(F.transform("_sorted", lambda x: x["w"]), F.lit(2), n - 1), F.array(F.lit(None).cast("string")))
    docs = docs.withColumn("_same", F.when(F.col("_twice"), F.arrays_zip(F.col("_sorted").alias("s"), before.alias("b"), after.alias("a"))))
    again = F.filter("_same", lambda x: (x["s"]["w"] == x["b"]) | (x["s"]["w"] == x["a"]))
    docs = docs.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["s"]["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    docs = docs.withColumn("n_repeat_words", F.when(F.col("_twice"), covered).otherwise(F.lit(0)).cast("long"))
    return docs.withColumns({
        "word_chars": F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.col("n_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_marks": F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")).cast("long"),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
    }).drop("_words", "_lines", "_starts", "_hashes", "_twice", "_sorted", "_same", "_at")


def vector(stats: DataFrame, group: list[str]) -> DataFrame:
    """Add the transformed statistics; rates of short texts are drawn to their group's."""
    rates = stats.groupBy(*group).agg(*[
        (F.sum(c).cast("double") / F.greatest(F.sum("n_words"), F.lit(1))).alias(f"_r_{c}") for c in ("word_chars", "n_symbols", "n_marks", "n_upper", "n_repeat_words")
    ])
    stats = _with(stats, rates, group)
    rate = lambda c: (F.col(c) + PRIOR_WORDS * F.col(f"_r_{c}")) / (F.col("n_words") + PRIOR_WORDS)
    return stats.withColumns({
        "v_word_len": F.log(rate("word_chars") + 1),
        "v_symbols": F.log1p(4 * rate("n_symbols")),
        "v_marks": F.log1p(4 * rate("n_marks")),
        "v_upper": F.log1p(4 * rate("n_upper")),
        "v_repeat": F.log1p(4 * rate("n_repeat_words")),
    }).drop(*[f"_r_{c}" for c in ("word_chars", "n_symbols", "n_marks", "n_upper", "n_repeat_words")])


def _with(rows: DataFrame, by_group: DataFrame, group: list[str]) -> DataFrame:
    """Give each row its group's values; null keys meet null keys."""
    renamed = small(cut(by_group.select(*[F.col(g).alias(f"_k_{g}") for g in group], *[c for c in by_group.columns if c not in group])))
    on = reduce(lambda a, b: a & b, [rows[g].eqNullSafe(renamed[f"_k_{g}"]) for g in group])
    return rows.join(renamed, on, "left").drop(*[f"_k_{g}" for g in group])


def _quartiles(rows: DataFrame, group: list[str], vs: list[str]) -> DataFrame:
    """For each group and statistic its quartiles q1, q2, q3, from exact counts of fine bins: columns q1_0, ..."""
    bins = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(v) / (VECTOR[v] / 8)).alias("bin")) for i, v in enumerate(vs)])
    bins = rows.select(*group, F.explode(bins).alias("_b")).groupBy(*group, "_b.i", "_b.bin").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*group, "i")
    up = bins.withColumn("_cum", F.sum("_n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    at = lambda i, q: ((F.min(F.when((F.col("i") == i) & (F.col("_cum") >= F.ceil(F.col("_all") * q / 4)), F.col("bin"))) + 0.5) * (VECTOR[vs[i]] / 8)).alias(f"q{q}_{i}")
    return up.groupBy(*group).agg(*[at(i, q) for i in range(len(vs)) for q in (1, 2, 3)])


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _factored(fit: DataFrame, p: int) -> DataFrame:
    """Replace c00, c10, ... (a covariance), h (its rows) and t0, ... (the language's spread) by its regularised Cholesky factor l00, ... and log_det."""
    for i in range(p):
        for j in range(i + 1):
            rest = (F.col("h") * F.col(f"c{i}{j}") + (PRIOR_ROWS * F.col(f"t{i}") * F.col(f"t{i}") if i == j else F.lit(0.0))) / (F.col("h") + PRIOR_ROWS)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            fit = fit.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    fit = fit.withColumn("log_det", sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(p)), F.lit(0.0)))
    return fit.drop("h", *[f"c{i}{j}" for i, j in _pairs(p)])


def _distance(rows: DataFrame, vs: list[str]) -> Column:
    """Squared Mahalanobis distance from the estimate that stands beside each row."""
    y: list[Column] = []
    for i, v in enumerate(vs):
        x = F.col(v) - F.col(f"m{i}")
        for k in range(i):
            x = x - F.col(f"l{i}{k}") * y[k]
        y.append(x / F.col(f"l{i}{i}"))
    return sum((x * x for x in y), F.lit(0.0))


def _sums(vs: list[str]) -> list[Column]:
    """Aggregates n, s0, ... and s00, ... of the deviations from the estimate beside each row."""
    d = [F.col(v) - F.col(f"m{i}") for i, v in enumerate(vs)]
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(d)], *[F.sum(d[i] * d[j]).alias(f"s{i}{j}") for i, j in _pairs(len(vs))]]


def _estimate(sums: DataFrame, fits: DataFrame, keys: list[str], factor: float, p: int) -> DataFrame:
    """The estimates that follow from sums of deviations from ``fits``."""
    known = fits.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"m{i}" for i in range(p)], *[f"t{i}" for i in range(p)])
    both = sums.join(known, reduce(lambda a, b: a & b, [sums[k].eqNullSafe(known[f"_k_{k}"]) for k in keys]))
    mean = [F.col(f"s{i}") / F.col("n") for i in range(p)]
    cov = [(factor * (F.col(f"s{i}{j}") / F.col("n") - mean[i] * mean[j])).alias(f"c{i}{j}") for i, j in _pairs(p)]
    return _factored(both.select(*keys, F.col("n").cast("double").alias("h"), *[(F.col(f"m{i}") + mean[i]).alias(f"m{i}") for i in range(p)], *[f"t{i}" for i in range(p)], *cov), p)


def _starts(rows: DataFrame, group: list[str], lang: str, vs: list[str]) -> DataFrame:
    """Three estimates of each group, numbered by ``start``."""
    p = len(vs)
    floor = [F.lit(VECTOR[v]) for v in vs]
    spread = lambda i: F.greatest((F.col(f"q3_{i}") - F.col(f"q1_{i}")) / 1.349, floor[i])
    wide = _quartiles(rows, [lang], vs).select(lang, *[spread(i).alias(f"t{i}") for i in range(p)])
    own = _quartiles(rows, group, vs).select(*group, *[F.col(f"q2_{i}").alias(f"m{i}") for i in range(p)], *[spread(i).alias(f"u{i}") for i in range(p)])
    own = cut(_with(own, wide, [lang]))
    beside = _with(rows, own, group)
    bent = [F.tanh((F.col(v) - F.col(f"m{i}")) / F.col(f"u{i}")) for i, v in enumerate(vs)]
    moments = []
    for name, xs in (("a", [F.col(v) for v in vs]), ("b", bent)):
        moments += [F.avg(x).alias(f"{name}{i}") for i, x in enumerate(xs)] + [F.covar_pop(xs[i], xs[j]).alias(f"{name}{i}{j}") for i, j in _pairs(p)]
    every = cut(_with(own, beside.groupBy(*group).agg(F.count("*").cast("double").alias("h"), *moments), group))
    t = [f"t{i}" for i in range(p)]
    u = lambda i: F.col(f"u{i}")
    quartile = every.select(*group, F.lit(0).alias("start"), "h", *t, *[f"m{i}" for i in range(p)], *[(u(i) * u(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _pairs(p)])
    plain = every.select(*group, F.lit(1).alias("start"), "h", *t, *[F.col(f"a{i}").alias(f"m{i}") for i in range(p)], *[F.col(f"a{i}{j}").alias(f"c{i}{j}") for i, j in _pairs(p)])
    tanh = every.select(*group, F.lit(2).alias("start"), "h", *t, *[(F.col(f"m{i}") + u(i) * F.col(f"b{i}")).alias(f"m{i}") for i in range(p)], *[(u(i) * u(j) * F.col(f"b{i}{j}")).alias(f"c{i}{j}") for i, j in _pairs(p)])
    return cut(_factored(quartile.unionByName(plain).unionByName(tanh), p))


def concentrate(rows: DataFrame, fits: DataFrame, group: list[str], vs: list[str], core: float) -> DataFrame:
    """One concentration step of every estimate of ``fits``, in one pass over the rows of their groups."""
    p, keys = len(vs), [*group, "start"]
    known = small(fits.withColumnsRenamed({g: f"_k_{g}" for g in group}))
    near = rows.join(known, reduce(lambda a, b: a & b, [rows[g].eqNullSafe(known[f"_k_{g}"]) for g in group]))
    bins = near.withColumn("_bin", F.floor(F.log(_distance(near, vs) + 1e-6) / BIN)).groupBy(*keys, "_bin").agg(*_sums(vs))
    w = W.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(w.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = bins.withColumn("_before", before).withColumn("_all", F.sum("n").over(w)).where(F.col("_before") < F.ceil(F.col("_all") * core))
    names = ["n", *[f"s{i}" for i in range(p)], *[f"s{i}{j}" for i, j in _pairs(p)]]
    sums = inside.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
    return cut(_estimate(sums, fits, keys, consistency(core, p), p))


def robust_outliers(rows: DataFrame, lang: str, source: str, vs: list[str], core: float = 0.75) -> DataFrame:
    """Add ``distance`` from a reweighted MCD estimate of each language and source over the vector ``vs``.

    ``rows`` should be cut; each step reads it once.
    """
    p, group = len(vs), [lang, source]
    fits = _starts(rows, group, lang, vs)
    for _ in range(2):
        fits = concentrate(rows, fits, group, vs, core)
    values = [c for c in fits.columns if c not in group]
    best = cut(fits.groupBy(*group).agg(F.min_by(F.struct(*values), F.struct("log_det", "start")).alias("x")).select(*group, "x.*"))
    ended, moving = [], best
    while True:  # the determinant is bounded from below by the floors, so every group comes to rest
        new = concentrate(rows, moving, group, vs, core)
        old = moving.select(*[F.col(g).alias(f"_k_{g}") for g in group], F.struct(*values).alias("_old"))
        both = new.select(*group, F.struct(*values).alias("_new")).join(old, reduce(lambda a, b: a & b, [new[g].eqNullSafe(old[f"_k_{g}"]) for g in group]))
        falls = F.col("_new.log_det") < F.col("_old.log_det") - 1e-6
        both = cut(both.withColumn("falls", falls).select(*group, "falls", F.when(F.col("falls"), F.col("_new")).otherwise(F.col("_old")).alias("x")))
        ended.append(both.where("not falls").select(*group, "x.*"))
        moving = both.where("falls").select(*group, "x.*")
        if not moving.limit(1).count():
            break
    fits = cut(reduce(DataFrame.unionByName, ended))
    known = _with(rows, fits.drop("log_det", "start"), group)
    sums = known.where(_distance(known, vs) <= chi_square_beyond(0.025, p)).groupBy(*group).agg(*_sums(vs))
    final = cut(_estimate(sums, fits, group, consistency(0.975, p), p).drop("log_det", *[f"t{i}" for i in range(p)]))
    out = _with(rows, final, group)
    return out.withColumn("distance", _distance(out, vs)).drop(*[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i, j in _pairs(p)])


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The statistics of every document, base_failed, distance and kept."""
    keep = [F.col(c) for c in ("doc_id", "lang", "source", "text")]
    base = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper"]
    stats = cut(statistics(docs.select(*keep)).select("doc_id", "lang", "source", *base))
    stats = stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    stats = cut(vector(stats, ["lang", "source"]))
    out = robust_outliers(stats, "lang", "source", list(VECTOR))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi_square_beyond(tail, len(VECTOR))))
