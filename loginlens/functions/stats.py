"""Closed-form statistics as native column expressions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from numpy.polynomial.chebyshev import Chebyshev, cheb2poly
from pyspark.sql import Column
from pyspark.sql import functions as F

CHI2_KNOTS = (0.0, 6.0, 18.0, 42.0, 100.0)
CHI2_DEGREE = 18


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid_z(z) -> Column:
    """Logistic curve centred on three standard deviations."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-0.5) * (_col(z) - 3)))


def clip01(x) -> Column:
    x = _col(x)
    return F.when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x)


def _chi2_over_power(t: float) -> float:
    """CDF divided by t^1.5, by the incomplete-gamma series with x = t/2:
    x^1.5 e^-x / gamma(1.5) * sum_k x^k / (1.5 * 2.5 * ... * (1.5 + k)).
    """
    x, term, total = t / 2, 1 / 1.5, 0.0
    for k in range(1, 400):
        total += term
        term *= x / (k + 1.5)
    return 0.5 ** 1.5 * math.exp(-x) / (math.sqrt(math.pi) / 2) * total


@lru_cache(maxsize=1)
def _chi2_pieces() -> list[tuple[float, float, list[float]]]:
    """Polynomial of the scaled variable on each interval, highest power first."""
    pieces = []
    for low, high in zip(CHI2_KNOTS, CHI2_KNOTS[1:]):
        fit = Chebyshev.interpolate(np.vectorize(_chi2_over_power), CHI2_DEGREE, domain=[low, high])
        pieces.append((low, high, [float(c) for c in cheb2poly(fit.coef)[::-1]]))
    return pieces


def chi2_cdf_3(d) -> Column:
    """Chi-square CDF with 3 degrees of freedom.

    Spark has no error function. The CDF over t^1.5 is smooth, so four short
    polynomials, derived above from its series, give it to about 1e-13 with
    plain arithmetic that stays inside code generation.
    """
    d = _col(d)
    value = F.when(d <= 0, 0.0)
    for low, high, coefficients in _chi2_pieces():
        s = (d - (low + high) / 2) / ((high - low) / 2)
        polynomial = F.lit(coefficients[0])
        for c in coefficients[1:]:
            polynomial = polynomial * s + c
        value = value.when(d <= high, polynomial * d * F.sqrt(d))
    return clip01(value.when(d > CHI2_KNOTS[-1], 1.0))
