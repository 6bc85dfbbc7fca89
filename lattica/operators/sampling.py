"""Sequential kernels, one model or series in each Spark task group: sampling, fitting, spectra.

Models are independent of one another, so each is one group of a grouped map;
all draws come from a generator seeded by (seed, model), so that reruns and
retried tasks agree.  A group's data are a model's parameters or one series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "model string, beta double, h array<double>, w array<double>"


def assemble(fields: DataFrame, couplings: DataFrame) -> DataFrame:
    """One row a model: h by node, and w row by row as a full symmetric matrix with a zero diagonal."""
    h = fields.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "h"))), lambda x: x["h"].cast("double")).alias("h"))
    full = couplings.select("model", "i", "j", "w").unionByName(couplings.select("model", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    full = full.unionByName(fields.select("model", F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.0).alias("w")))
    w = full.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "w"))), lambda x: x["w"].cast("double")).alias("w"))
    return h.join(w, "model").select(F.col("model").cast("string").alias("model"), F.lit(1.0).alias("beta"), "h", "w")


def over_betas(models: DataFrame, betas: list[float]) -> DataFrame:
    """Each model at each inverse temperature of a list."""
    return models.drop("beta").select("*", F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta")).select("model", "beta", "h", "w")


def _rng(seed: int, *names: object) -> np.random.Generator:
    return np.random.default_rng([seed, *np.frombuffer("|".join(map(str, names)).encode(), np.uint8).tolist()])


def sweep(s: np.ndarray, h: np.ndarray, w: np.ndarray, beta: float, rng: np.random.Generator) -> None:
    """One Metropolis sweep in random node order, in place.  A flip is taken if log u < -2 beta s (h + w s)."""
    pull = h + w @ s
    for i, u in zip(rng.permutation(len(s)), np.log(rng.random(len(s))), strict=True):
        if u < -2 * beta * s[i] * pull[i]:
            pull -= 2 * w[:, i] * s[i]
            s[i] = -s[i]


def advance(s: np.ndarray, h: np.ndarray, w: np.ndarray, beta: float, rng: np.random.Generator, schedule: str = "sweep") -> None:
    """One step in place: a sweep, all nodes at once (``synchronous``), or one node drawn at random (``random_node``)."""
    if schedule == "sweep":
        sweep(s, h, w, beta, rng)
    elif schedule == "synchronous":
        s[np.log(rng.random(len(s))) < -2 * beta * s * (h + w @ s)] *= -1
    elif schedule == "random_node":
        i = int(rng.integers(len(s)))
        if np.log(rng.random()) < -2 * beta * s[i] * (h[i] + w[i] @ s):
            s[i] = -s[i]
    else:
        raise ValueError(schedule)


def _simulate(h: np.ndarray, w: np.ndarray, beta: float, n_steps: int, rng: np.random.Generator, s: np.ndarray | None = None, schedule: str = "sweep") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of states, of products and of flips over the sweeps, and the last state."""
    n = len(h)
    s = rng.choice([-1.0, 1.0], n) if s is None else s
    one, two, flips = np.zeros(n), np.zeros((n, n)), np.zeros(n)
    for _ in range(n_steps):
        before = s.copy()
        advance(s, h, w, beta, rng, schedule)
        one += s
        two += np.outer(s, s)
        flips += before != s
    return one, two, flips, s


def _each(models: DataFrame, kernel: Callable[[pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([kernel(m) for _, m in group.iterrows()], ignore_index=True)

    return models.groupBy("model", "beta").applyInPandas(run, schema)


def _start(n: int, start: str, rng: np.random.Generator) -> np.ndarray:
    """A first state: random, or all -1 (``negative``)."""
    return rng.choice([-1.0, 1.0], n) if start == "random" else np.full(n, -1.0)


def simulated_means(models: DataFrame, n_steps: int, seed: int = 1, start: str = "random") -> DataFrame:
    """Rows model, beta, i, j, value, flip_rate: mean states (i = j, with the node's flip rate) and mean products (i < j)."""

    def kernel(m: pd.Series) -> pd.DataFrame:
        h, n = np.asarray(m["h"], float), len(m["h"])
        rng = _rng(seed, m["model"], m["beta"])
        one, two, flips, _ = _simulate(h, np.asarray(m["w"], float).reshape(n, n), m["beta"], n_steps, rng, _start(n, start, rng))
        i, j = np.triu_indices(n)
        value = np.where(i == j, one[i], two[i, j]) / n_steps
        return pd.DataFrame({"model": m["model"], "beta": m["beta"], "i": i, "j": j, "value": value, "flip_rate": np.where(i == j, flips[i] / n_steps, np.nan)})

    return _each(models, kernel, "model string, beta double, i long, j long, value double, flip_rate double")


def simulated_series(models: DataFrame, n_steps: int, seed: int = 1, start: str = "random") -> DataFrame:
    """The states themselves, as a panel (subject, beta, node, step, state)."""

    def kernel(m: pd.Series) -> pd.DataFrame:
        h, n = np.asarray(m["h"], float), len(m["h"])
        w, rng = np.asarray(m["w"], float).reshape(n, n), _rng(seed, m["model"], m["beta"])
        s, out = _start(n, start, rng), np.zeros((n_steps, n), np.int8)
        for t in range(n_steps):
            sweep(s, h, w, m["beta"], rng)
            out[t] = s
        return pd.DataFrame({"subject": m["model"], "beta": m["beta"], "node": np.tile(np.arange(n), n_steps), "step": np.repeat(np.arange(n_steps), n), "state": out.ravel().astype(int)})

    return _each(models, kernel, "subject string, beta double, node long, step long, state int")


def moved(want: np.ndarray, got: np.ndarray, rule: str) -> np.ndarray:
    """The direction of an update: the difference, its cube root (``power``), its cube, or the log of the ratio with its sign."""
    d = want - got
    if rule == "linear":
        return d
    if rule == "power":
        return np.cbrt(d)
    if rule == "cubic":
        return d**3
    if rule == "log":
        with np.errstate(all="ignore"):
            ratio = np.abs(np.log(np.abs(want / got)))
        return np.sign(d) * np.where(np.isfinite(ratio), ratio, 0.0)
    raise ValueError(rule)


def fit_by_simulation(models: DataFrame, targets: DataFrame, n_updates: int, steps_per_update: int, rate: float | None = None, seed: int = 1, rule: str = "linear", with_fields: bool = True, schedule: str = "sweep") -> DataFrame:
    """Boltzmann learning: after each short simulation h and w move towards the targets by ``rate`` times what ``rule`` makes of the difference.

    ``targets(model, m, p)`` holds each model's mean states and full matrix of
    mean products as arrays.  Without ``rate`` each model has its own, in a column of
    that name.  Without fields h stays 0.  Starting from a fitted group model,
    this is the individual fit; from a saved one, the resumed fit.
    """

    def kernel(m: pd.Series) -> pd.DataFrame:
        h, n = np.array(m["h"], float) * with_fields, len(m["h"])
        w, rng = np.array(m["w"], float).reshape(n, n), _rng(seed, m["model"], m["beta"])
        want1, want2, s = np.asarray(m["m"], float), np.asarray(m["p"], float).reshape(n, n), None
        own = float(m["rate"]) if rate is None else rate
        for _ in range(n_updates):
            one, two, _, s = _simulate(h, w, m["beta"], steps_per_update, rng, s, schedule)
            h += own * with_fields * moved(want1, one / steps_per_update, rule)
            w += own * moved(want2, two / steps_per_update, rule)
            np.fill_diagonal(w, 0.0)
        return pd.DataFrame({"model": [m["model"]], "beta": [m["beta"]], "h": [h], "w": [w.ravel()]})

    return _each(models.join(targets.select("model", "m", "p"), "model"), kernel, MODEL)


# --- one series in a group


def _per_series(panel: DataFrame, kernel: Callable[[np.ndarray], pd.DataFrame], schema: str, value: str) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("step")
        out = kernel(group[value].to_numpy(float))
        return out.assign(subject=group["subject"].iloc[0], node=group["node"].iloc[0])

    return panel.select("subject", "node", "step", value).groupBy("subject", "node").applyInPandas(run, f"{schema}, subject string, node long")


def power_spectrum(panel: DataFrame, resolution: float = 1.0, value: str = "value") -> DataFrame:
    """One-sided power of each series' real Fourier transform: rows subject, node, frequency, power."""

    def kernel(x: np.ndarray) -> pd.DataFrame:
        power = np.abs(np.fft.rfft(x)) ** 2 * resolution / len(x)
        power[1 : (len(x) + 1) // 2] *= 2  # all but the mean and, for even lengths, the last stand for two
        return pd.DataFrame({"frequency": np.fft.rfftfreq(len(x), resolution), "power": power})

    return _per_series(panel, kernel, "frequency double, power double", value)


# --- one small matrix in a group


def matrices(square: DataFrame, value: str, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Apply ``kernel`` to each subject's square matrix, given as rows (subject, i, j, value)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        m = group.pivot(index="i", columns="j", values=value).sort_index().sort_index(axis=1)
        return pd.DataFrame(kernel(m.to_numpy(float))).assign(subject=group["subject"].iloc[0])

    return square.select("subject", "i", "j", value).groupBy("subject").applyInPandas(run, f"{schema}, subject string")


def inverse(square: DataFrame, value: str) -> DataFrame:
    """The (pseudo-)inverse, as rows subject, i, j, precision."""

    def kernel(m: np.ndarray) -> dict[str, np.ndarray]:
        i, j = np.indices(m.shape)
        return {"i": i.ravel(), "j": j.ravel(), "precision": np.linalg.pinv(m, hermitian=True).ravel()}

    return matrices(square, value, kernel, "i long, j long, precision double")


def eigen(square: DataFrame, value: str) -> DataFrame:
    """Eigenvalues, greatest first, and vectors with their largest entry positive: rows subject, component, eigenvalue, vector."""

    def kernel(m: np.ndarray) -> dict[str, list]:
        values, vectors = np.linalg.eigh(m)
        values, vectors = values[::-1], vectors[:, ::-1]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(m))])
        return {"component": list(range(len(m))), "eigenvalue": list(values), "vector": list(vectors.T)}

    return matrices(square, value, kernel, "component long, eigenvalue double, vector array<double>")
