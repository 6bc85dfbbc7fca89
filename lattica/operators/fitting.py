"""Fitting and judging pairwise binary models, one model in each Spark task group.

A model is a row (model, beta, h, w): fields by node and couplings row by row.
Its targets are a row (model, m, p): mean states and the matrix of mean products.
Rows of a grid (inverse temperatures, learning rates, replicas) are models of
their own, so that they spread over the cluster; a group holds a model's
parameters and, for fits to a series, one subject's series.  All draws are
seeded by (seed, model, beta), so that reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import last_checkpoint, save_checkpoint
from ..sources.scratch import written
from .pooled import Adam
from .sampling import MODEL, _each, _rng, _simulate, advance, fit_by_simulation

#: Measures of a fit, and whether the larger value is the better one.
MEASURES = {"mean_rmse": False, "product_rmse": False, "cov_rmse": False, "fc_rmse": False, "fc_corr": True, "flip_distance": False}
REPORT = "model string, beta double, n_steps long, flip_rate double, mean_rmse double, product_rmse double, cov_rmse double, fc_rmse double, fc_corr double, flip_distance double"


def _measured(one: np.ndarray, two: np.ndarray, flips: np.ndarray, n: int, m: np.ndarray, p: np.ndarray, flip_rate: float | None) -> dict[str, float]:
    """Distances of simulated from wanted moments, over nodes and over pairs i < j."""
    at = np.triu_indices(len(m), 1)
    one, two, rate = one / n, two / n, float(flips.mean() / n)

    def cov(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b - np.outer(a, a))[at]

    def fc(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sd = np.sqrt(np.maximum(1 - a * a, 0))
        both = np.outer(sd, sd)[at]
        return np.divide(cov(a, b), both, out=np.full(len(both), np.nan), where=both > 0)

    rmse = lambda a, b: float(np.sqrt(np.mean((a - b) ** 2)))
    x, y = fc(one, two), fc(m, p)
    ok = ~np.isnan(x) & ~np.isnan(y)
    spread = float(np.std(x[ok]) * np.std(y[ok])) if ok.any() else 0.0
    corr = float(np.mean((x[ok] - x[ok].mean()) * (y[ok] - y[ok].mean())) / spread) if spread > 0 else None
    return {
        "flip_rate": rate, "mean_rmse": rmse(one, m), "product_rmse": rmse(two[at], p[at]), "cov_rmse": rmse(cov(one, two), cov(m, p)),
        "fc_rmse": rmse(x[ok], y[ok]) if ok.any() else None, "fc_corr": corr, "flip_distance": None if flip_rate is None else abs(rate - flip_rate),
    }


def goodness(models: DataFrame, targets: DataFrame, lengths: Sequence[int], schedule: str = "sweep", seed: int = 1) -> DataFrame:
    """How far each model's simulation lies from its targets after each number of steps of ``lengths``.

    With one length this is the report of a fit, over :func:`over_betas` the
    sweep of inverse temperatures, with several the convergence by length.
    ``targets`` may hold a wanted ``flip_rate``.
    """
    lengths = sorted({int(x) for x in lengths})
    if "flip_rate" not in targets.columns:
        targets = targets.withColumn("flip_rate", F.lit(None).cast("double"))

    def kernel(x: pd.Series) -> pd.DataFrame:
        h, n = np.asarray(x["h"], float), len(x["h"])
        w, m, p = np.asarray(x["w"], float).reshape(n, n), np.asarray(x["m"], float), np.asarray(x["p"], float).reshape(n, n)
        rng, s, done, out = _rng(seed, x["model"], x["beta"]), None, 0, []
        one, two, flips = np.zeros(n), np.zeros((n, n)), np.zeros(n)
        for length in lengths:
            a, b, c, s = _simulate(h, w, x["beta"], length - done, rng, s, schedule)
            one, two, flips, done = one + a, two + b, flips + c, length
            rate = None if pd.isna(x["flip_rate"]) else float(x["flip_rate"])
            out.append({"model": x["model"], "beta": x["beta"], "n_steps": length} | _measured(one, two, flips, length, m, p, rate))
        return pd.DataFrame(out).astype({"fc_rmse": float, "fc_corr": float, "flip_distance": float})

    return _each(models.select("model", "beta", "h", "w").join(targets, "model"), kernel, REPORT)


def search_beta(models: DataFrame, targets: DataFrame, measure: str, n_rounds: int, n_betas: int, n_steps: int, low: float = 1e-9, high: float = 1.0, doubling: bool = False, seed: int = 1) -> DataFrame:
    """The best inverse temperature of every model by its own interval: rows model, round, beta, score, low, high.

    Each round simulates ``n_betas`` temperatures of each model's interval, one
    group a model and temperature.  If the best lies inside, its neighbours are
    the next interval.  If it is the upper end, the interval moves on by half
    its width (with ``doubling``: from the best to twice it), as it does
    downwards at the lower end, where ``low`` itself only narrows it.  Scores that are null or not a number are never
    chosen.  The rounds are tables of a few numbers a model; nothing is collected.
    """
    models, targets = written(models.select("model", "beta", "h", "w")), written(targets)
    at = models.select("model", F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    rounds = []
    sign = 1.0 if MEASURES[measure] else -1.0
    for k in range(n_rounds):
        steps = F.sequence(F.lit(0), F.lit(n_betas - 1))
        grid = at.select("model", F.explode(F.transform(steps, lambda i: F.col("low") + i * (F.col("high") - F.col("low")) / (n_betas - 1))).alias("beta"))
        scored = goodness(models.drop("beta").join(grid, "model"), targets, [n_steps], seed=seed + k)
        value = F.col(measure)
        value = F.when(value.isNull() | F.isnan(value), float("-inf")).otherwise(sign * value)
        tried = scored.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("beta", value.alias("v"), F.col(measure).alias("score")))).alias("t"))
        best = F.aggregate("t", F.lit(float("-inf")), lambda acc, x: F.greatest(acc, x["v"]))
        tried = tried.withColumn("b", F.array_position(F.transform("t", lambda x: x["v"]), best).cast("int"))
        beta = lambda i: F.element_at("t", i)["beta"]
        mine, half = beta(F.col("b")), (beta(F.lit(n_betas)) - beta(F.lit(1))) / 2
        up = F.col("b") == n_betas
        down = F.col("b") == 1
        least = F.when(up, mine if doubling else mine - half).when(down, F.greatest(mine - half, F.lit(float(low)))).otherwise(beta(F.greatest(F.col("b") - 1, F.lit(1))))
        most = F.when(up, 2 * mine if doubling else mine + half).when(down & (mine <= low), beta(F.lit(2))).when(down, mine + half).otherwise(beta(F.least(F.col("b") + 1, F.lit(n_betas))))
        found = written(tried.select("model", F.lit(k).alias("round"), mine.alias("beta"), F.element_at("t", F.col("b"))["score"].alias("score"), least.alias("low"), most.alias("high")))
        rounds.append(found)
        at = found.select("model", "low", "high")
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def at_best_beta(models: DataFrame, found: DataFrame, largest: bool) -> DataFrame:
    """Each model at the temperature of its best round."""
    score = F.col("score") if largest else -F.col("score")
    best = found.where("score is not null and not isnan(score)").groupBy("model").agg(F.max_by("beta", F.struct(score, -F.col("round"))).alias("beta"))
    return models.drop("beta").join(best, "model").select("model", "beta", "h", "w")


# --- starts and edits of parameters


def initial(targets: DataFrame, how: str, seed: int = 1) -> DataFrame:
    """Models to start from: zero, means, centred, log_means, inverse_cov, uniform or normal.

    ``centred`` has the covariances as couplings; ``log_means`` the log-odds of
    the means as fields and log(p / m m') as couplings (0 where undefined);
    ``normal`` draws from the means' and products' own mean and spread.
    """

    def one(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        m, n = np.asarray(x["m"], float), len(x["m"])
        p, rng = np.asarray(x["p"], float).reshape(n, n), _rng(seed, x["model"], how)
        if how == "zero":
            h, w = np.zeros(n), np.zeros((n, n))
        elif how == "means":
            h, w = m, p
        elif how == "centred":
            h, w = m, p - np.outer(m, m)
        elif how == "inverse_cov":
            h, w = m, -np.linalg.pinv(p - np.outer(m, m), hermitian=True)
        elif how == "log_means":
            with np.errstate(all="ignore"):
                h, w = -np.log(1 / m - 1), np.log(p / np.outer(m, m))
            h, w = np.nan_to_num(h, nan=0.0, posinf=0.0, neginf=0.0), np.nan_to_num(w, nan=0.0, posinf=0.0, neginf=0.0)
        elif how == "uniform":
            h, w = rng.random(n), 2 * rng.random((n, n)) - 1
        elif how == "normal":
            h, w = rng.normal(m.mean(), m.std(ddof=1) if n > 1 else 0.0, n), rng.normal(p.mean(), p.std(ddof=1), (n, n))
        else:
            raise ValueError(how)
        w = (w + w.T) / 2
        np.fill_diagonal(w, 0.0)
        return h, w

    def run(parts):
        for part in parts:
            made = [one(x) for _, x in part.iterrows()]
            yield pd.DataFrame({"model": part["model"], "beta": 1.0, "h": [h for h, _ in made], "w": [w.ravel() for _, w in made]})

    return targets.select("model", "m", "p").mapInPandas(run, MODEL)


def overridden(models: DataFrame, how: str, areas: Sequence[int] | None = None) -> DataFrame:
    """Models with zero_h, zero_w, mean_h (all fields their mean) or area_h (the mean over each node's area)."""
    mean: Column = F.aggregate("h", F.lit(0.0), lambda a, x: a + x) / F.size("h")
    if how == "zero_h":
        return models.withColumn("h", F.transform("h", lambda x: x * 0.0))
    if how == "zero_w":
        return models.withColumn("w", F.transform("w", lambda x: x * 0.0))
    if how == "mean_h":
        return models.withColumn("h", F.transform("h", lambda x: x * 0.0 + mean))
    if how != "area_h" or areas is None:
        raise ValueError(how)
    of = F.array(*[F.lit(int(a)) for a in areas])
    both = F.zip_with("h", of, lambda x, a: F.struct(x.alias("h"), a.alias("a")))

    def by_area(x: Column) -> Column:
        own = F.filter(both, lambda y: y["a"] == x["a"])
        return F.aggregate(own, F.lit(0.0), lambda acc, y: acc + y["h"]) / F.size(own)

    return models.withColumn("h", F.transform(both, by_area))


def best_models(models: DataFrame, reports: DataFrame, measure: str) -> DataFrame:
    """Of each group's replicas, named group/replica, the best model by ``measure``, renamed to its group."""
    value = F.col(measure) if MEASURES[measure] else -F.col(measure)
    found = reports.where(F.col(measure).isNotNull() & ~F.isnan(measure)).select(F.col("model").alias("_m"), F.col("beta").alias("_b"), value.alias("_v"))
    group = F.substring_index("model", "/", 1)
    rows = models.join(found, (F.col("model") == F.col("_m")) & (F.col("beta") == F.col("_b")))
    return rows.groupBy(group.alias("group")).agg(F.max_by(F.struct("beta", "h", "w", "model"), F.struct("_v", F.col("model"))).alias("x")).select(F.col("group").alias("model"), "x.beta", "x.h", "x.w", F.col("x.model").alias("replica"))


def individual(groups: DataFrame, members: DataFrame) -> DataFrame:
    """A copy of its group's model for each row of ``members(model, group)``, to fit from."""
    start = groups.select(F.col("model").alias("group"), "beta", "h", "w")
    return members.select("model", "group").join(start, "group").select("model", "beta", "h", "w")


def replicas(models: DataFrame, n: int) -> DataFrame:
    """``n`` copies of each model, named model/number."""
    many = models.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return many.withColumn("model", F.concat_ws("/", "model", F.col("_r").cast("string"))).drop("_r")


def folded(panel: DataFrame, size: int) -> DataFrame:
    """A panel whose subjects are subject/block for blocks of ``size`` nodes; pairs across blocks fall away, as does a ragged block."""
    block = F.floor(F.col("node") / size).cast("long")
    whole = (panel.agg(F.max("node")).first()[0] + 1) // size  # one number
    rows = panel.withColumn("_b", block).where(F.col("_b") < whole)
    return rows.withColumn("subject", F.concat_ws("/", "subject", F.col("_b").cast("string"))).withColumn("node", F.col("node") - F.col("_b") * size).drop("_b")


# --- fits by simulation, saved and resumed


def fit_and_save(models: DataFrame, targets: DataFrame, path: str, n_saves: int, updates_per_save: int, steps_per_update: int, rate: float | None, seed: int = 1, **how) -> DataFrame:
    """Fit in ``n_saves`` rounds, each written under ``path`` with its number of updates and read by the next.

    What is there already is not fitted again: a run that was broken off goes
    on from its last round.
    """
    spark = models.sparkSession
    done = _saved(spark, path)
    start = last_checkpoint(spark, path).drop("updates") if done else models
    for k in range(done // updates_per_save, n_saves):
        updates = (k + 1) * updates_per_save
        kept = start.select("model", *[c for c in ("rate",) if c in start.columns])
        fitted = fit_by_simulation(start, targets, updates_per_save, steps_per_update, rate, seed=seed + updates, **how)
        save_checkpoint(fitted.join(kept, "model") if "rate" in kept.columns else fitted, path, updates)
        start = last_checkpoint(spark, path).drop("updates")
    return start


def _saved(spark: SparkSession, path: str) -> int:
    """Updates of the last round under ``path``, 0 if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return int(spark.read.parquet(path).agg(F.max("updates")).first()[0] or 0)
    except AnalysisException:
        return 0


# --- fits to a series


def _series(own: pd.DataFrame) -> np.ndarray:
    return own.pivot(index="step", columns="node", values="state").sort_index().sort_index(axis=1).to_numpy(float)


def _beside(models: DataFrame, panel: DataFrame, kernel) -> DataFrame:
    """``kernel(model row, series)`` gives h, w for each model and its subject's series.

    A model's subject is its column ``subject`` if there is one, otherwise its
    name up to the first "/", so that replicas share their subject's series.
    Models without a series and series without a model give no row.
    """
    subject = F.col("subject").cast("string") if "subject" in models.columns else F.substring_index("model", "/", 1)
    models = models.select(subject.alias("subject"), "model", "beta", "h", "w")

    def run(m: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        made = {"model": [], "beta": [], "h": [], "w": []}
        x = _series(own) if len(m) and len(own) else None
        for _, row in m.iterrows() if x is not None else ():
            h, w = kernel(row, x)
            for key, value in (("model", row["model"]), ("beta", row["beta"]), ("h", h), ("w", w.ravel())):
                made[key].append(value)
        return pd.DataFrame(made) if made["model"] else pd.DataFrame({"model": pd.Series(dtype=str), "beta": pd.Series(dtype=float), "h": pd.Series(dtype=object), "w": pd.Series(dtype=object)})

    own = panel.select(F.col("subject").cast("string").alias("subject"), "node", "step", "state")
    return models.groupBy("subject").cogroup(own.groupBy("subject")).applyInPandas(run, MODEL)


def fit_pseudolikelihood(models: DataFrame, panel: DataFrame, n_updates: int, rate: float, optimizer: str = "gradient", block: int | None = None, symmetric: bool = True, with_fields: bool = True, seed: int = 1) -> DataFrame:
    """Maximum pseudolikelihood of each model on the series of its own subject, a group each.

    For series of many subjects, or of any length, see :func:`lattica.operators.pooled.fit_pooled`.
    Subjects are found by a column ``subject`` or by the model's name up to "/"; without a series a model gives no row.

    ``gradient`` climbs the whole series' gradient; with ``block`` it is added
    up block by block, in bounded memory, with the same result.  ``sgd`` climbs
    random blocks one after another, ``adam`` scales the whole gradient.
    ``symmetric`` adds both nodes' gradients of a coupling, otherwise each row of
    w is a node's own regression.  Without fields h stays 0.
    """

    def gradient(x: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = x - np.tanh(h + x @ w.T)
        g = e.T @ x
        return e.sum(axis=0), (g + g.T if symmetric else g)

    def kernel(row: pd.Series, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rng = x.shape[1], _rng(seed, row["model"])
        h, w = np.array(row["h"], float) * with_fields, np.array(row["w"], float).reshape(n, n)
        size = block or len(x)
        adam = Adam(rate)
        for _ in range(n_updates):
            starts = list(range(0, len(x), size))
            if optimizer == "sgd":
                rng.shuffle(starts)
            gh, gw, seen = np.zeros(n), np.zeros((n, n)), 0
            for k, at in enumerate(starts):
                part = x[at : at + size]
                a, b = gradient(part, h, w)
                gh, gw, seen = gh + a, gw + b, seen + len(part)
                if optimizer == "sgd" or k == len(starts) - 1:
                    np.fill_diagonal(gw, 0.0)
                    step = np.concatenate([gh * with_fields, gw.ravel()]) / (size if optimizer == "sgd" else seen)  # a ragged block counts by its steps
                    step = adam.step(step) if optimizer == "adam" else rate * step
                    h, w = h + step[:n], w + step[n:].reshape(n, n)
                    gh, gw, seen = np.zeros(n), np.zeros((n, n)), 0
        return h, w

    return _beside(models, panel, kernel)


def fit_windows(models: DataFrame, panel: DataFrame, length: int, rate: float, how: str = "fixed", n_epochs: int = 1, every: int = 1, keep: float = 1.0, schedule: str = "sweep", seed: int = 1) -> DataFrame:
    """Boltzmann learning window by window: the moments of each window are the targets of one update.

    ``fixed`` windows follow one another, ``sliding`` ones start at each
    ``every``-th step, ``random`` ones as many as fixed ones at random.  A window
    of one step updates by every step.  An update is made with probability ``keep``.
    """

    def kernel(row: pd.Series, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rng, s = x.shape[1], _rng(seed, row["model"], how), None
        h, w = np.array(row["h"], float), np.array(row["w"], float).reshape(n, n)
        last = len(x) - length
        for _ in range(n_epochs):
            starts = range(0, last + 1, length if how == "fixed" else every)
            for at in rng.integers(0, last + 1, len(range(0, last + 1, length))) if how == "random" else starts:
                own = x[at : at + length]
                one, two, _, s = _simulate(h, w, row["beta"], length, rng, s, schedule)
                if keep < 1 and rng.random() >= keep:
                    continue
                h = h + rate * (own.mean(axis=0) - one / length)
                w = w + rate * (own.T @ own / length - two / length)
                np.fill_diagonal(w, 0.0)
        return h, w

    return _beside(models, panel, kernel)


def transition_table(panel: DataFrame) -> DataFrame:
    """What :func:`fit_transitions` reads: distinct states, how often each is left, and by which nodes' flips.

    A state's next one is joined by step, so that no task holds a series.
    """
    whole = panel.groupBy(F.col("subject").cast("string").alias("model"), "step").agg(F.array_sort(F.collect_list(F.struct("node", "state"))).alias("s"))
    whole = whole.select("model", "step", F.transform("s", lambda x: x["state"].cast("int")).alias("state"))
    after = whole.select("model", (F.col("step") - 1).alias("step"), F.col("state").alias("_next"))
    both = whole.join(after, ["model", "step"])
    flips = F.zip_with("state", "_next", lambda a, b: F.when(a != b, 1).otherwise(0))
    summed = both.select("model", "state", F.posexplode(flips).alias("i", "f")).groupBy("model", "state", "i").agg(F.sum("f").alias("f"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda x: x["f"])
    return summed.groupBy("model", "state").agg(F.max("n").alias("n"), ordered.alias("flips"))


def fit_transitions(states: DataFrame, n_updates: int, rate: float) -> DataFrame:
    """Models whose flip probabilities min(1, exp(change)) fit those seen in each state.

    ``states(model, state, n, flips)`` holds distinct states (arrays of -1 and
    1), their counts, and how often each node flipped next.  The seen
    probability is min(1, nodes * flips / n), as one node at a time is tried;
    the squared distance, weighted by n, falls by Adam.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x, c = np.array(own["state"].tolist(), float), own["n"].to_numpy(float)
        f, n = np.array(own["flips"].tolist(), float), len(own["state"].iloc[0])
        seen = np.minimum(1, n * f / c[:, None])
        theta, adam = np.zeros(n + n * n), Adam(rate)
        for _ in range(n_updates):
            h, w = theta[:n], theta[n:].reshape(n, n)
            raw = np.exp(np.minimum(-2 * x * (h + x @ w), 50))
            slope = np.where(raw <= 1, 2 * (np.minimum(raw, 1) - seen) * raw, 0.0) * c[:, None] / c.sum() * (-2 * x)
            gw = slope.T @ x
            gw = gw + gw.T
            np.fill_diagonal(gw, 0.0)
            theta = theta - adam.step(np.concatenate([slope.sum(axis=0), gw.ravel()]))
        return pd.DataFrame({"model": [own["model"].iloc[0]], "beta": [1.0], "h": [theta[:n]], "w": [theta[n:]]})

    return states.groupBy("model").applyInPandas(run, MODEL)


# --- what a running state shows


def running_bursts(models: DataFrame, n_steps: int, schedule: str = "sweep", seed: int = 1) -> DataFrame:
    """Histograms of bursts of activity in a running simulation, whose series is never kept.

    A node is active when it flips from -1 to 1.  Rows model, beta, measure
    (duration, size: activations, nodes: distinct nodes), value, n, of runs of
    active steps; a run that the simulation's ends cut off counts as it is.
    """

    def kernel(x: pd.Series) -> pd.DataFrame:
        h, n = np.asarray(x["h"], float), len(x["h"])
        w, rng = np.asarray(x["w"], float).reshape(n, n), _rng(seed, x["model"], x["beta"])
        s, seen = rng.choice([-1.0, 1.0], n), {}
        duration = size = 0
        nodes = np.zeros(n, bool)

        def end() -> None:
            nonlocal duration, size
            for key in (("duration", duration), ("size", size), ("nodes", int(nodes.sum()))):
                seen[key] = seen.get(key, 0) + 1
            duration = size = 0
            nodes[:] = False

        before = None
        for _ in range(n_steps):
            advance(s, h, w, x["beta"], rng, schedule)
            up = (before < 0) & (s > 0) if before is not None else np.zeros(n, bool)
            before = s.copy()
            if up.any():
                duration, size = duration + 1, size + int(up.sum())
                nodes |= up
            elif duration:
                end()
        if duration:
            end()
        keys = sorted(seen)
        return pd.DataFrame({"model": x["model"], "beta": x["beta"], "measure": [k for k, _ in keys], "value": [v for _, v in keys], "n": [seen[k] for k in keys]})

    return _each(models, kernel, "model string, beta double, measure string, value long, n long")


def simulated_connectivity(means: DataFrame) -> DataFrame:
    """product, cov and fc of each pair, and both nodes' flip rates, from ``simulated_means``."""
    own = means.where("i = j")
    node = lambda k: own.select("model", "beta", F.col("i").alias(k), F.col("value").alias(f"m_{k}"), F.col("flip_rate").alias(f"flip_{k}"))
    rows = means.where("i < j").select("model", "beta", "i", "j", F.col("value").alias("product")).join(node("i"), ["model", "beta", "i"]).join(node("j"), ["model", "beta", "j"])
    cov = F.col("product") - F.col("m_i") * F.col("m_j")
    sd = F.sqrt((1 - F.col("m_i") * F.col("m_i")) * (1 - F.col("m_j") * F.col("m_j")))
    return rows.select("model", "beta", "i", "j", "product", cov.alias("cov"), (cov / F.nullif(sd, F.lit(0.0))).alias("fc"), "flip_i", "flip_j")

