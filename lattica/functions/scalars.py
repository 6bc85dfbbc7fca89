"""Column helpers and functions for SQL: pair counts, coordinates, grids, the error and zeta functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def pairs_of(n_nodes: Column) -> Column:
    return (n_nodes * (n_nodes - 1) / 2).cast("long")


def nodes_of(n_pairs: Column) -> Column:
    """The number of nodes that have so many pairs."""
    return F.round((1 + F.sqrt(1 + 8 * n_pairs)) / 2).cast("long")


def pair_position(i: Column, j: Column, n_nodes: Column) -> Column:
    """Place of the pair i < j in the row-by-row upper triangle, from 0."""
    return (i * n_nodes - i * (i + 1) / 2 + (j - i - 1)).cast("long")


def to_spherical(x: Column, y: Column, z: Column) -> Column:
    """radius, inclination from the z axis and azimuth; angles are 0 at the origin."""
    radius = F.sqrt(x * x + y * y + z * z)
    share = F.coalesce(z / F.nullif(radius, F.lit(0.0)), F.lit(1.0))
    return F.struct(radius.alias("radius"), F.acos(share).alias("inclination"), F.atan2(y, x).alias("azimuth"))


def to_cartesian(radius: Column, inclination: Column, azimuth: Column) -> Column:
    flat = radius * F.sin(inclination)
    return F.struct((flat * F.cos(azimuth)).alias("x"), (flat * F.sin(azimuth)).alias("y"), (radius * F.cos(inclination)).alias("z"))


def two_sided_p(z: Column) -> Column:
    """Two-sided probability of a normal score, by a rational approximation (error below 2e-7)."""
    # Coefficients of the approximation of the complementary error function.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return poly * F.exp(-x * x)


def linear_grid(low: float, high: float, n: int) -> Column:
    """Array of n evenly spaced numbers, both ends included."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * step)


def log_grid(low: float, high: float, n: int) -> Column:
    """Array of n numbers evenly spaced by their logarithms, both ends included."""
    return F.transform(linear_grid(math.log(low), math.log(high), n), F.exp)


def zeta(exponent: Column, first: Column, terms: int = 64) -> Column:
    """Hurwitz's zeta function, the sum of (first + k) ** -exponent, for exponents above 1."""
    ks = F.sequence(F.lit(0), F.lit(terms - 1))
    head = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.pow(first + k, -exponent))
    end = first.cast("double") + terms
    return head + F.pow(end, 1 - exponent) / (exponent - 1) + F.pow(end, -exponent) / 2 + exponent * F.pow(end, -exponent - 1) / 12


class _Triu:
    """Rows (i, j) of the pairs i < j of n nodes, row by row."""

    def eval(self, n: int):
        if n is not None:
            for i in range(n):
                for j in range(i + 1, n):
                    yield i, j


def register(spark: SparkSession) -> None:
    """Make the table function ``triu(n)`` and the scalar function ``hurwitz_zeta(exponent, first)`` known to SQL."""
    spark.udtf.register("triu", F.udtf(_Triu, returnType="i long, j long"))

    def hurwitz(exponent: pd.Series, first: pd.Series) -> pd.Series:
        a, q, n = exponent.to_numpy(float), first.to_numpy(float), 64
        head = ((q[:, None] + np.arange(n)) ** -a[:, None]).sum(axis=1)
        end = q + n
        return pd.Series(head + end ** (1 - a) / (a - 1) + end**-a / 2 + a * end ** (-a - 1) / 12)

    hurwitz.__annotations__ = {"exponent": pd.Series, "first": pd.Series, "return": pd.Series}
    spark.udf.register("hurwitz_zeta", F.pandas_udf(hurwitz, "double"))
