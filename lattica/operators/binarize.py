"""Binarization, normalisation and re-indexing of panels.

States are the integers -1 and +1, so that moments of states are exact.  Every
operator works within the series of its ``keys`` (subject and node) and needs
one shuffle on them at most.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES = ("subject", "node")


def _over(keys: Sequence[str]):
    return W.partitionBy(*keys)


def state(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(-1)


def lower_median(value: str = "value") -> Column:
    """The lower of the two middle values: an observed value, never interpolated."""
    return F.percentile_disc(F.lit(0.5), value) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")


def with_stats(panel: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Give each row aggregates of its series.  They are pre-aggregated and joined, so that no series is sorted."""
    found = panel.groupBy(*keys).agg(*[c.alias(k) for k, c in stats.items()])
    return panel.join(found, list(keys))


def median_balanced(panel: DataFrame, keys: Sequence[str] = SERIES, step: str = "step", value: str = "value") -> DataFrame:
    """Sign of value minus lower median; values at the median go, in order of steps,
    to +1 while fewer states are up than down, and to -1 otherwise."""
    rows = with_stats(panel, keys, _median=lower_median(value))
    sign = F.signum(F.col(value) - F.col("_median")).cast("int")
    rows = rows.withColumn("_sign", sign)
    series = _over(keys)
    rank = F.row_number().over(W.partitionBy(*keys, "_sign").orderBy(step))
    short = F.sum("_sign").over(series)  # up minus down, before the ties
    rows = rows.withColumn("_rank", rank).withColumn("_short", short)
    # the first |short| ties restore the balance; then -1 and +1 alternate
    past = F.col("_rank") - F.abs("_short")
    tie = F.when(past <= 0, F.when(F.col("_short") < 0, 1).otherwise(-1)).otherwise(F.when(past % 2 == 1, -1).otherwise(1))
    return rows.withColumn("state", F.when(F.col("_sign") != 0, F.col("_sign")).otherwise(tie)).drop("_median", "_sign", "_rank", "_short")


def by_score(panel: DataFrame, z: float = 0.0, inclusive: bool = True, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """+1 where value is at least (``inclusive``) or above mean + z standard deviations (n - 1)."""
    rows = with_stats(panel, keys, _mean=F.avg(value), _sd=F.stddev_samp(value))
    at = F.col("_mean") + z * F.coalesce(F.col("_sd"), F.lit(0.0))
    return rows.withColumn("state", state(F.col(value) >= at if inclusive else F.col(value) > at)).drop("_mean", "_sd")


def by_mean(panel: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """+1 where value is at least the mean, compared without division: n * value >= sum."""
    rows = with_stats(panel, keys, _n=F.count(value), _sum=F.sum(value))
    return rows.withColumn("state", state(F.col(value) * F.col("_n") >= F.col("_sum"))).drop("_n", "_sum")


def by_threshold(panel: DataFrame, mode: str | float = "median", keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """+1 above a threshold: ``median`` (lower), ``mean``, ``none`` (sign of the value) or a quantile in (0, 1)."""
    if mode == "none":
        return panel.withColumn("state", F.signum(F.col(value)).cast("int"))
    if mode == "mean":
        at = F.avg(value)
    elif mode == "median":
        at = lower_median(value)
    else:
        at = F.percentile(value, F.lit(float(mode)))  # linear interpolation
    return with_stats(panel, keys, _at=at).withColumn("state", state(F.col(value) > F.col("_at"))).drop("_at")


def score_sign(panel: DataFrame, theta: float = 0.1, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Sign of the z-score minus ``theta`` (0 is possible); null for constant series."""
    rows = with_stats(panel, keys, _mean=F.avg(value), _sd=F.stddev_samp(value))
    score = (F.col(value) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return rows.withColumn("state", F.signum(score - theta).cast("int")).drop("_mean", "_sd")


def normalized(panel: DataFrame, how: str, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Add ``scaled``: ``z`` score, ``max_abs``, ``min_max`` to [-1, 1] or ``min_max_pos`` to [0, 1].

    Null where the series has no spread.  Without keys the whole panel is one series.
    """
    v = F.col(value)
    if how == "z":
        stats, out = {"_a": F.avg(value), "_b": F.stddev_samp(value)}, lambda a, b: (v - a) / F.nullif(b, F.lit(0.0))
    elif how == "max_abs":
        stats, out = {"_a": F.max(F.abs(v)), "_b": F.lit(0)}, lambda a, b: v / F.nullif(a.cast("double"), F.lit(0.0))
    elif how in ("min_max", "min_max_pos"):
        stats = {"_a": F.min(value), "_b": F.max(value)}
        share = lambda a, b: (v - a) / F.nullif((b - a).cast("double"), F.lit(0.0))
        out = share if how == "min_max_pos" else lambda a, b: 2 * share(a, b) - 1
    else:
        raise ValueError(how)
    found = panel.groupBy(*keys).agg(*[c.alias(k) for k, c in stats.items()])
    rows = panel.join(found, list(keys)) if keys else panel.join(F.broadcast(found))  # one row
    return rows.withColumn("scaled", out(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def fitted_scaler(train: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and standard deviation of each key, to be kept and applied to other rows."""
    return train.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def apply_scaler(rows: DataFrame, scaler: DataFrame, keys: Sequence[str], value: str = "value", inverse: bool = False, keep_constant: bool = False) -> DataFrame:
    """``scaled``: the z-score by a fitted scaler, or with ``inverse`` the value of a z-score.

    Without spread it is null, or with ``keep_constant`` the value as it is, as an intercept's must stay.
    """
    v = F.col(value)
    out = v * F.col("sd") + F.col("mean") if inverse else (v - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    if keep_constant:
        out = F.when(F.col("sd") == 0, v.cast("double")).otherwise(out)
    return rows.join(scaler, list(keys)).withColumn("scaled", out).drop("mean", "sd")


def invalid(rows: DataFrame, keys: Sequence[str], value: str, most: float = 1.0) -> DataFrame:
    """Counts of null, not-a-number, infinite and out-of-range values of each key."""
    v = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(
        F.count_if(v.isNull()).alias("n_null"),
        F.count_if(F.isnan(v)).alias("n_nan"),
        F.count_if(F.abs(v) == float("inf")).alias("n_inf"),
        F.count_if(~F.isnan(v) & (F.abs(v) > most)).alias("n_outside"),
        F.count("*").alias("n_rows"),
    )


def constant_series(panel: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """The series without spread: least equals greatest, exactly."""
    return panel.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).where("lo = hi").drop("hi").withColumnRenamed("lo", "constant")


def rolled(panel: DataFrame, offset: int, n_steps: int, step: str = "step") -> DataFrame:
    """Shift every series cyclically by ``offset`` steps."""
    return panel.withColumn(step, F.pmod(F.col(step) + offset, F.lit(n_steps)).cast("long"))


def reversed_time(panel: DataFrame, n_steps: int, step: str = "step") -> DataFrame:
    return panel.withColumn(step, F.lit(n_steps - 1) - F.col(step))


def mirrored(pairs: DataFrame, keys: Sequence[str], value: str, diagonal: float) -> DataFrame:
    """The full square of pairs i < j: both triangles, and the diagonal as given."""
    up = pairs.select(*keys, "i", "j", value)
    down = pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), value)
    nodes = pairs.select(*keys, F.explode(F.array("i", "j")).alias("i")).distinct()
    return up.unionByName(down).unionByName(nodes.select(*keys, "i", F.col("i").alias("j"), F.lit(diagonal).cast("double").alias(value)))


def upper(square: DataFrame) -> DataFrame:
    return square.where("i < j")


def without_diagonal(square: DataFrame, value: str, fill: float = 0.0) -> DataFrame:
    return square.withColumn(value, F.when(F.col("i") == F.col("j"), F.lit(fill)).otherwise(F.col(value)))


def folded(pairs: DataFrame, fold_size: int) -> DataFrame:
    """Pairs inside one block of ``fold_size`` nodes, renumbered in their block."""
    fold = lambda c: F.floor(F.col(c) / fold_size).cast("long")
    inside = pairs.where(fold("i") == fold("j")).withColumn("fold", fold("i"))
    return inside.withColumns({"i": F.col("i") - F.col("fold") * fold_size, "j": F.col("j") - F.col("fold") * fold_size})


def downsampled(square: DataFrame, factor: int) -> DataFrame:
    return square.where((F.col("i") % factor == 0) & (F.col("j") % factor == 0))


def entropy_weight(panel: DataFrame, epsilon: float = 1e-10) -> DataFrame:
    """``weighted``: the state times p ln p + q ln q of its step's share of states up."""
    rows = with_stats(panel, ("subject", "step"), _p=F.avg(F.when(F.col("state") > 0, 1.0).otherwise(0.0)))
    p, q = F.col("_p"), 1 - F.col("_p")
    return rows.withColumn("weighted", F.col("state") * (p * F.log(p + epsilon) + q * F.log(q + epsilon))).drop("_p")


def log_shifted(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``logged``: log10(value + 1 - least value of the key)."""
    return with_stats(rows, keys, _lo=F.min(value)).withColumn("logged", F.log10(F.col(value) + 1 - F.col("_lo"))).drop("_lo")


def by_mode(panel: DataFrame, mode: str | float, fill: int, value: str = "value", keys: Sequence[str] = ("subject", "node")) -> DataFrame:
    """States by ``median`` (the lower one), a fixed number, or ``none`` (the sign); values at the threshold get ``fill``."""
    if mode == "median":
        at = panel.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("_t"))
        panel = panel.join(at, [*keys])
    else:
        panel = panel.withColumn("_t", F.lit(0.0 if mode == "none" else float(mode)))
    state = F.when(F.col(value) > F.col("_t"), 1).when(F.col(value) < F.col("_t"), -1).otherwise(fill)
    return panel.withColumn("state", state).drop("_t")


def over_thresholds(panel: DataFrame, scores: Sequence[float], value: str = "value", keys: Sequence[str] = ("subject", "node")) -> DataFrame:
    """The panel at each threshold of a short list: ``state`` is 1 from mean + threshold * sd on."""
    v = F.col(value).cast("double")
    stats = panel.groupBy(*keys).agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"))
    rows = panel.join(stats, [*keys]).withColumn("threshold", F.explode(F.array(*[F.lit(float(z)) for z in scores])))
    return rows.withColumn("state", F.when(v >= F.col("_m") + F.col("threshold") * F.col("_s"), 1).otherwise(-1)).drop("_m", "_s")


def relabelled(rows: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    """Labels of a short list replaced, the others kept."""
    return rows.replace(dict(names), subset=[column])


def augmented(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features with the products of each two of them and ``one``, the intercept's column."""
    two = {f"{a}_{b}": F.col(a) * F.col(b) for k, a in enumerate(features) for b in features[k + 1 :]}
    return rows.withColumns(two | {"one": F.lit(1.0)})


def views(rows: DataFrame, keys: Sequence[str], param: str, beta: float, feature: str) -> DataFrame:
    """``size`` and ``scaled`` of a parameter, and ``shifted``, log10 of the feature moved so that its least is 1."""
    least = rows.groupBy(*keys).agg(F.min(feature).alias("_l"))
    out = rows.join(least, [*keys])
    return out.withColumns({"size": F.abs(param), "scaled": F.col(param) * beta, "shifted": F.log10(F.col(feature) + 1 - F.col("_l"))}).drop("_l")


def accepted(rows: DataFrame, goodness: DataFrame, keys: Sequence[str], measure: str, below: float) -> DataFrame:
    """Rows of the keys whose measure is below a bound; null and not-a-number are not."""
    good = goodness.where(F.col(measure).isNotNull() & ~F.isnan(measure) & (F.col(measure) < below)).select(*keys)
    return rows.join(good, [*keys], "left_semi")
