"""Filters and surrogates of single series, one series or one subject in each Spark task group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .sampling import _per_series, _rng


def chebyshev_two(order: int, attenuation: float, low: float, high: float, rate: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the digital band-pass of Chebyshev's second kind.

    ``low`` and ``high`` are the stop band's edges, where the gain is
    ``attenuation`` decibels down; ``rate`` is the number of steps a unit of time.
    """
    # the prototype: zeros on the imaginary axis, poles inverse to those of the first kind
    m = np.arange(1 - order, order, 2)
    ripple = 1 / np.sqrt(10 ** (attenuation / 10) - 1)
    bend = np.arcsinh(1 / ripple) / order
    angle = np.pi * m / (2 * order)
    zeros = 1j / np.sin(angle[m != 0])
    poles = 1 / -(np.sinh(bend) * np.cos(angle) + 1j * np.cosh(bend) * np.sin(angle))
    gain = np.real(np.prod(-poles) / np.prod(-zeros))
    # to the band between both edges, bent beforehand for the bilinear map
    edge = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, middle = edge[1] - edge[0], np.sqrt(edge[0] * edge[1])
    more = len(poles) - len(zeros)

    def banded(x: np.ndarray) -> np.ndarray:
        half = x * width / 2
        root = np.sqrt(half**2 - middle**2 + 0j)
        return np.concatenate([half + root, half - root])

    zeros, poles, gain = np.concatenate([banded(zeros), np.zeros(more)]), banded(poles), gain * width**more
    # to discrete time
    gain = gain * np.real(np.prod(2 * rate - zeros) / np.prod(2 * rate - poles))
    more = len(poles) - len(zeros)
    to_disc = lambda x: (2 * rate + x) / (2 * rate - x)
    return np.concatenate([to_disc(zeros), -np.ones(more)]), to_disc(poles), float(gain)


def _filtered(x: np.ndarray, zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """One pass of the filter, pole by pole, from the state that a constant series of the first value leaves."""
    y = x.astype(complex)
    # the poles nearest the circle last, each with the zero nearest to it
    left = list(zeros)
    for p in sorted(poles, key=abs):
        z = left.pop(int(np.argmin(np.abs(np.array(left) - p))))
        last_x = y[0]
        last_y = y[0] * (1 - z) / (1 - p)
        out = np.empty_like(y)
        for t, now in enumerate(y):
            last_y = now - z * last_x + p * last_y
            last_x = now
            out[t] = last_y
        y = out
    return np.real(y) * gain


def band_pass(panel: DataFrame, low: float, high: float, resolution: float = 1.0, order: int = 5, attenuation: float = 40.0, value: str = "value") -> DataFrame:
    """Zero-phase Chebyshev-II band-pass of each series, forwards and then backwards.

    Series are continued by point reflection at both ends, and cut back.
    """
    zeros, poles, gain = chebyshev_two(order, attenuation, low, high, 1 / resolution)

    def kernel(x: np.ndarray) -> pd.DataFrame:
        pad = min(6 * order + 3, len(x) - 1)
        wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
        there = _filtered(wide, zeros, poles, gain)
        back = _filtered(there[::-1], zeros, poles, gain)[::-1]
        return pd.DataFrame({"step": np.arange(len(x)), "value": back[pad : pad + len(x)]})

    return _per_series(panel, kernel, "step long, value double", value)


def phase_surrogate(panel: DataFrame, seed: int = 1, value: str = "value", shared: bool = False, shuffle: bool = True) -> DataFrame:
    """A series of the same spectrum with random phases.

    Phases are drawn for each node, which takes away what nodes have in common;
    or, with ``shared``, once for a subject's nodes, which keeps their
    cross-correlations.  Without ``shuffle`` each keeps its own phases: the round trip.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        wide = group.pivot(index="step", columns="node", values=value).sort_index()
        f = np.fft.rfft(wide.to_numpy(float), axis=0)
        subject = group["subject"].iloc[0]
        draws = [_rng(seed, subject, *(() if shared else (node,))).random(len(f)) for node in wide.columns]
        phase = np.exp(2j * np.pi * np.array(draws).T) if shuffle else np.ones(f.shape)
        size = np.abs(f) if shuffle and not shared else f
        if shuffle:
            phase[0] = 1 if shared else np.sign(f[0].real)
            if len(wide) % 2 == 0:
                phase[-1] = 1 if shared else np.sign(f[-1].real)
        x = np.fft.irfft(size * phase, len(wide), axis=0)
        return pd.DataFrame({"subject": subject, "node": np.tile(wide.columns, len(wide)), "step": np.repeat(wide.index, wide.shape[1]), "value": x.ravel()})

    return panel.select("subject", "node", "step", value).groupBy("subject").applyInPandas(run, "subject string, node long, step long, value double")
