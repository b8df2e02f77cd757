"""Scalar and vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expit(x: Column) -> Column:
    """1 / (1 + exp(-x)), split at 0 so that no exponential overflows."""
    return F.when(x > 0, 1 / (1 + F.exp(-x))).otherwise(1 - 1 / (1 + F.exp(x)))


def log_logistic(x: Column) -> Column:
    """log(expit(x)) without overflow."""
    return F.when(x > 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def mean_centre(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.transform(a, lambda x: x - mean)


def l2_normalise(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def l2_ball(a: Column, radius: float) -> Column:
    """The nearest vector of norm ``radius`` at most."""
    n = norm(a)
    return F.when(n > radius, F.transform(a, lambda x: x * radius / n)).otherwise(a)


def elastic_net(w: Column, eta: float, l1: float, l2: float, compat: bool = False) -> Column:
    """The proximal step of l1 |w| + l2/2 w^2; compat leaves the l2 shrink out for positive weights."""
    core = F.signum(w) * F.greatest(F.lit(0.0), F.abs(w) - eta * l1)
    shrunk = core / (eta * l2 + 1)
    return F.when(w > 0, core).otherwise(shrunk) if compat else shrunk


def with_bias(a: Column, bias: float) -> Column:
    return F.array_append(a, F.lit(float(bias)))


def clamp(x: Column, radius: float) -> Column:
    return F.least(F.greatest(x, F.lit(-radius)), F.lit(radius))


def zero_small(w: Column, least: float = 1e-3) -> Column:
    return F.when(F.abs(w) < least, 0.0).otherwise(w)
