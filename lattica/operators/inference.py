"""Correlation families, permutation nulls with critical values, linear models, and matrix products."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .moments import correlation, ratio
from .relate import permuted


# --- correlations of features with parameters


def by_mean_over(rows: DataFrame, over: str, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and standard deviation over ``over`` (subjects or replicas) of each value, by node, pair or feature."""
    return rows.groupBy(*by).agg(*[f(v).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def group_correlation(rows: DataFrame, node: str, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation over nodes of the subjects' mean values."""
    means = rows.groupBy(node, *by).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    return means.groupBy(*by).agg(correlation(F.col("_x"), F.col("_y")).alias("corr"))


def individual_correlation(rows: DataFrame, node: str, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation over subjects at each node."""
    return rows.groupBy(node, *by).agg(correlation(F.col(x), F.col(y)).alias("corr"))


def offsets(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``values`` minus their mean over all rows of ``by`` (a node's mean over subjects), pre-aggregated and joined."""
    means = rows.groupBy(*by).agg(*[F.avg(v).alias(f"_m_{v}") for v in values])
    return rows.join(means, [*by]).withColumns({v: F.col(v) - F.col(f"_m_{v}") for v in values}).drop(*[f"_m_{v}" for v in values])


def permuted_correlations(rows: DataFrame, subject: str, node: str, by: Sequence[str], x: str, y: str, n: int, shuffle: str = "subjects") -> DataFrame:
    """Correlations (by, perm, corr) with x moved to other ``subjects``, other ``nodes``, or ``both``.

    One permutation moves all values of a subject (node) together.
    """
    left = rows.select(subject, node, *[b for b in by if b not in (subject, node)], F.col(x).alias("_x"))
    if shuffle in ("subjects", "both"):
        moved = permuted(rows, subject, n, tag="s")
        left = left.join(moved, subject).drop(subject).withColumnRenamed("partner", subject)
    if shuffle in ("nodes", "both"):
        moved = permuted(rows, node, n, tag="n")
        left = left.join(moved, [node, "perm"] if "perm" in left.columns else [node]).drop(node).withColumnRenamed("partner", node)
    on = list(dict.fromkeys([subject, node, *by]))
    both = left.join(rows.select(*on, F.col(y).alias("_y")), on)
    return both.groupBy(*by, "perm").agg(correlation(F.col("_x"), F.col("_y")).alias("corr"))


def against_null(seen: DataFrame, null: DataFrame, by: Sequence[str], alpha: float, n_tests: int, n: int) -> DataFrame:
    """corr, p, p_corrected and the Bonferroni critical value.

    The critical value is the k-th largest distance of the null from 0 for
    k = max(1, floor(alpha / n_tests * n)): only k values of each key go on.
    """
    k = max(1, int(alpha / n_tests * n))
    far = null.withColumn("_a", F.abs("corr"))
    w = W.partitionBy(*by).orderBy(F.desc("_a"), "perm")
    top = far.where("_a is not null").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).groupBy(*by).agg(F.min("_a").alias("critical"))
    beyond = far.join(seen.select(*by, F.col("corr").alias("_c")), [*by]).groupBy(*by).agg(ratio(F.count_if(F.col("_a") >= F.abs("_c")), F.count("_a")).alias("p"))
    out = seen.join(beyond, [*by]).join(top, [*by], "left")
    return out.withColumn("p_corrected", F.least(F.col("p") * n_tests, F.lit(1.0)))


# --- linear models of any number of features


def least_squares_many(rows: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Coefficients b_<x>, intercept and r2 of each key, by the Cholesky factor of the centred normal equations.

    Null where a feature is a combination of those before it.  One pass over the rows.
    """
    cols = [F.col(c).cast("double") for c in (*xs, y)]
    p = len(xs)
    ok = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    sums = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)] + [F.covar_pop(cols[i], cols[j]).alias(f"_c{i}_{j}") for i in range(p + 1) for j in range(i + 1)]
    out = rows.where(ok).groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    c = lambda i, j: F.col(f"_c{max(i, j)}_{min(i, j)}")
    for i in range(p + 1):
        for j in range(min(i, p - 1) + 1):
            rest = c(i, j)
            for k in range(j):
                rest = rest - F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}")
            fine = F.when(rest > 1e-12 * c(i, i), F.sqrt(rest)) if i == j else rest / F.col(f"_l{j}_{j}")
            out = out.withColumn(f"_l{i}_{j}", fine)
    for j in reversed(range(p)):  # the last row of the factor holds the right-hand side
        rest = F.col(f"_l{p}_{j}")
        for k in range(j + 1, p):
            rest = rest - F.col(f"_l{k}_{j}") * F.col(f"_b{k}")
        out = out.withColumn(f"_b{j}", rest / F.col(f"_l{j}_{j}"))
    intercept, explained = F.col(f"_m{p}"), F.lit(0.0)
    for j in range(p):
        intercept = intercept - F.col(f"_b{j}") * F.col(f"_m{j}")
        explained = explained + F.col(f"_b{j}") * c(p, j)
    return out.select(*keys, "n", *[F.col(f"_b{j}").alias(f"b_{x}") for j, x in enumerate(xs)], intercept.alias("intercept"), (explained / F.nullif(c(p, p), F.lit(0.0))).alias("r2"))


def predicted(rows: DataFrame, fits: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """``rows`` with ``prediction`` by the coefficients of their key."""
    own = fits.select(*keys, *[f"b_{x}" for x in xs], "intercept")
    value = reduce(lambda a, b: a + b, [F.col(x) * F.col(f"b_{x}") for x in xs], F.col("intercept"))
    return rows.join(own, [*keys]).withColumn("prediction", value).drop("intercept", *[f"b_{x}" for x in xs])


def fit_quality(rows: DataFrame, keys: Sequence[str], y: str, prediction: str = "prediction") -> DataFrame:
    """corr, rmse and r2 of predictions."""
    target, error = F.col(y).cast("double"), F.pow(F.col(y) - F.col(prediction), 2)
    return rows.groupBy(*keys).agg(correlation(target, F.col(prediction)).alias("corr"), F.sqrt(F.avg(error)).alias("rmse"), (1 - F.avg(error) / F.nullif(F.var_pop(target), F.lit(0.0))).alias("r2"))


def split_fits(rows: DataFrame, key: str, by: Sequence[str], xs: Sequence[str], y: str, n_splits: int, train_share: float = 0.5, null: bool = False) -> DataFrame:
    """Fit and test on random splits of ``key``; with ``null`` the features are first moved to other keys, the splits' null."""
    if null:
        moved = permuted(rows, key, n_splits, "split", "null")
        left = rows.select(key, *by, *xs).join(moved, key).drop(key).withColumnRenamed("partner", key)
        rows = left.join(rows.select(key, *by, y), [key, *by])
    ids = rows.select(key).distinct().withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long"))))
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit("-"), F.col("split").cast("string")).cast("binary"))
    # a key is trained on by its own digest, so that no task ranks a whole split
    train = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") < F.lit(float(train_share) * 2**32)
    parts = rows.join(ids.select(key, "split", train.alias("_train")), [key, "split"] if null else [key])
    fits = least_squares_many(parts.where("_train"), ["split", *by], xs, y)
    return fit_quality(predicted(parts.where(~F.col("_train")), fits, ["split", *by], xs), ["split", *by], y)


def group_coefficients_on_individuals(rows: DataFrame, subject: str, node: str, xs: Sequence[str], y: str) -> DataFrame:
    """Coefficients fitted over nodes to the subjects' standardised means, applied to each subject's own values.

    Both sides are standardised by the group's mean and spread over nodes; rows
    subject, node, y, prediction in y's own units.
    """
    means = rows.groupBy(node).agg(*[F.avg(c).alias(c) for c in (*xs, y)])
    scale = means.agg(*[f(c).alias(f"_{n}_{c}") for c in (*xs, y) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).withColumn("_g", F.lit(0))
    z = lambda df: df.withColumn("_g", F.lit(0)).join(F.broadcast(scale), "_g").withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in (*xs, y)})
    fits = least_squares_many(z(means), ["_g"], xs, y)  # one row
    out = predicted(z(rows.select(subject, node, *xs, y)), F.broadcast(fits), ["_g"], xs)
    back = lambda c: F.col(c) * F.col(f"_s_{y}") + F.col(f"_m_{y}")
    return out.select(subject, node, back(y).alias(y), back("prediction").alias("prediction"))


def variance_correlation(first: DataFrame, second: DataFrame, node: str, value: str) -> DataFrame:
    """Correlation over nodes of the spread over one table's replicas with that over another's subjects."""
    a = first.groupBy(node).agg(F.stddev_samp(value).alias("_a"))
    b = second.groupBy(node).agg(F.stddev_samp(value).alias("_b"))
    return a.join(b, node).agg(F.count("*").alias("n"), correlation(F.col("_a"), F.col("_b")).alias("corr"))


# --- matrices as long tables


def matrix_product(a: DataFrame, b: DataFrame, keys: Sequence[str], inner: str, row: str, col: str) -> DataFrame:
    """Rows (keys, row, col, x): sums of a(row, inner, x) times b(inner, col, x)."""
    left = a.select(*keys, row, inner, F.col("x").alias("_x"))
    right = b.select(*keys, inner, col, F.col("x").alias("_y"))
    return left.join(right, [*keys, inner]).groupBy(*keys, row, col).agg(F.sum(F.col("_x") * F.col("_y")).alias("x"))


def sandwiched(jacobian: DataFrame, middle: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """J M J' of jacobian(f, k, x) and middle(k, l, x): rows (keys, f, g, x)."""
    first = matrix_product(jacobian, middle, keys, "k", "f", "l")
    other = jacobian.select(*keys, F.col("f").alias("g"), F.col("k").alias("l"), "x")
    return matrix_product(first, other, keys, "l", "f", "g")


def projected(rows: DataFrame, vectors: DataFrame, keys: Sequence[str], at: str = "node", value: str = "value") -> DataFrame:
    """Coordinates of each row set along vectors(keys, component, at, v): rows (keys and row keys, component, coordinate)."""
    others = [c for c in rows.columns if c not in (at, value)]
    both = rows.join(vectors, [*keys, at])
    return both.groupBy(*others, "component").agg(F.sum(F.col(value) * F.col("v")).alias("coordinate"))


def rebuilt(coordinates: DataFrame, vectors: DataFrame, keys: Sequence[str], others: Sequence[str], at: str = "node", without: int | None = None) -> DataFrame:
    """Values from coordinates, all components or all but ``without``: the inverse of :func:`projected`."""
    used = coordinates if without is None else coordinates.where(F.col("component") != without)
    both = used.join(vectors, [*keys, "component"])
    return both.groupBy(*dict.fromkeys([*keys, *others]), at).agg(F.sum(F.col("coordinate") * F.col("v")).alias("value"))


def reconstruction(spectrum: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """From eigenvalues (keys, component from 0, eigenvalue): explained share and root mean squared error of the first components.

    ``stable`` marks the first number of components after which one more lowers
    the error by less than ``tolerance`` of the whole spread.
    """
    w = W.partitionBy(*keys)
    run = w.orderBy("component").rowsBetween(W.unboundedPreceding, 0)
    value = F.greatest(F.col("eigenvalue"), F.lit(0.0))
    rows = spectrum.select(*keys, "component", value.alias("_v")).withColumn("_sum", F.sum("_v").over(run)).withColumn("_all", F.sum("_v").over(w)).withColumn("_d", F.count("*").over(w))
    rows = rows.withColumn("rmse", F.sqrt(F.greatest(F.col("_all") - F.col("_sum"), F.lit(0.0)) / F.col("_d")))
    after = F.coalesce(F.lead("rmse").over(w.orderBy("component")), F.lit(0.0))
    small = F.col("rmse") - after < tolerance * F.sqrt(F.col("_all") / F.col("_d"))
    first = F.min(F.when(small, F.col("component"))).over(w)
    return rows.withColumn("_small", small).select(*keys, (F.col("component") + 1).alias("n_components"), (F.col("_sum") / F.nullif(F.col("_all"), F.lit(0.0))).alias("explained"), "rmse", (F.col("component") == first).alias("stable"))


def cosines(a: DataFrame, b: DataFrame, at: str = "node") -> DataFrame:
    """Cosine of each direction a(component, at, v) with each of b."""
    right = b.select(F.col("component").alias("other"), at, F.col("v").alias("_w"))
    dots = a.join(right, at).groupBy("component", "other").agg(F.sum(F.col("v") * F.col("_w")).alias("_d"))
    norm = lambda df, name, out: df.groupBy(F.col("component").alias(name)).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias(out))
    rows = dots.join(norm(a, "component", "_na"), "component").join(norm(b, "other", "_nb"), "other")
    return rows.select("component", "other", (F.col("_d") / F.nullif(F.col("_na") * F.col("_nb"), F.lit(0.0))).alias("cosine"))


# --- power laws on intervals


def log_zeta_between(exponent: Column, first: Column, last: Column | None, terms: int = 64) -> Column:
    """Log of the sum of k ** -exponent over first .. last (without end if null), for any exponent if there is an end.

    Euler and Maclaurin after ``terms`` terms from the first, and before the end.
    """
    head_end = first + terms if last is None else F.least(first + terms, last + 1)
    ks = F.sequence(first.cast("long"), (head_end - 1).cast("long"))
    head = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.pow(k.cast("double"), -exponent))
    a = head_end.cast("double")

    def integral(x: Column) -> Column:
        return F.when(F.abs(exponent - 1) < 1e-9, F.log(x)).otherwise(F.pow(x, 1 - exponent) / (1 - exponent))

    edge = lambda x, sign: F.pow(x, -exponent) / 2 + sign * exponent * F.pow(x, -exponent - 1) / 12
    if last is None:
        return F.log(head - integral(a) + edge(a, 1))
    b = last.cast("double")
    tail = integral(b) - integral(a) + edge(a, 1) + edge(b, -1)
    return F.log(head + F.when(head_end <= last, tail).otherwise(0.0))


def power_law_refined(sums: DataFrame, keys: Sequence[str], passes: int, tries: int, low: float = 1.0001, high: float = 10.0) -> DataFrame:
    """Most likely exponent of sums(keys, first, last or null, n, logs), by a bracket that each pass narrows to the neighbours of its best.

    The bracket's upper end doubles while the best of its tries stands there.
    Adds exponent and likelihood.  ``logs`` is the sum of the values' logarithms.
    """
    rows = sums.withColumn("_lo", F.lit(float(low))).withColumn("_hi", F.lit(float(high)))
    bounded = "last" in sums.columns
    for k in range(passes):
        steps = F.sequence(F.lit(0), F.lit(tries - 1))

        def tried(i: Column) -> Column:
            a = F.col("_lo") + i * (F.col("_hi") - F.col("_lo")) / (tries - 1)
            z = log_zeta_between(a, F.col("first"), F.col("last") if bounded else None)
            return F.struct((-F.col("n") * z - a * F.col("logs")).alias("l"), (-i).alias("i"), a.alias("a"))

        rows = rows.withColumn("_b", F.array_max(F.transform(steps, tried)))
        width = (F.col("_hi") - F.col("_lo")) / (tries - 1)
        at = F.col("_b.a")
        top = F.col("_b.i") == -(tries - 1)
        rows = rows.select(*sums.columns, F.greatest(at - width, F.lit(float(low))).alias("_lo"), F.when(top & (F.col("_hi") >= high), 2 * at).otherwise(at + width).alias("_hi"), F.col("_b.a").alias("exponent"), F.col("_b.l").alias("likelihood"))
        if k < passes - 1:
            rows = rows.drop("exponent", "likelihood")
    return rows.drop("_lo", "_hi")


def interval_sums(counts: DataFrame, keys: Sequence[str], value: str, n: str, least_length: int = 3, least_values: int = 3) -> DataFrame:
    """first, last, n and logs of every interval of each key's values with enough different values.

    Ends stand at values that occur; sums come from running sums at both ends.
    """
    run = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    log = F.col(n) * F.log(F.col(value).cast("double"))
    rows = counts.select(*keys, value, n, log.alias("_l"), F.sum(n).over(run).alias("_cn"), F.sum(log).over(run).alias("_cl"), F.count("*").over(run).alias("_k"))
    a = rows.select(*keys, F.col(value).alias("first"), (F.col("_cn") - F.col(n)).alias("_an"), (F.col("_cl") - F.col("_l")).alias("_al"), F.col("_k").alias("_ak"))
    b = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("last"), F.col("_cn").alias("_bn"), F.col("_cl").alias("_bl"), F.col("_k").alias("_bk"))
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in keys])
    both = a.join(b, on & (F.col("last") - F.col("first") >= least_length) & (F.col("_bk") - F.col("_ak") + 1 >= least_values))
    return both.select(*keys, "first", "last", (F.col("_bn") - F.col("_an")).cast("double").alias("n"), (F.col("_bl") - F.col("_al")).alias("logs"))


def interval_distance(fits: DataFrame, counts: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """``fits`` (keys, first, last, n, exponent) with ks, the largest distance of the two distribution functions on the interval."""
    inside = fits.join(counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_v"), F.col(n).alias("_m")), reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in keys]) & F.col("_v").between(F.col("first"), F.col("last")))
    run = W.partitionBy(*keys, "first", "last").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    whole = log_zeta_between(F.col("exponent"), F.col("first"), F.col("last"))
    model = F.exp(log_zeta_between(F.col("exponent"), F.col("first"), F.col("_v")) - whole)
    d = F.abs(F.sum("_m").over(run) / F.col("n") - model)
    out = inside.withColumn("_d", d).groupBy(*keys, "first", "last").agg(F.max("_d").alias("ks"))
    return fits.join(out, [*keys, "first", "last"])


def criticality_distance(rows: DataFrame, duration: str, size: str, scaling: str) -> DataFrame:
    """``distance``: (duration exponent - 1) / (size exponent - 1) minus the exponent of mean size by duration."""
    return rows.withColumn("distance", (F.col(duration) - 1) / F.nullif(F.col(size) - 1, F.lit(0.0)) - F.col(scaling))
