"""Gamma-family functions as plain column arithmetic (asymptotic series)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SHIFT = 8


def _shifted(x: Column) -> Column:
    return x + F.lit(float(SHIFT))


def log_gamma(x: Column) -> Column:
    y = _shifted(x)
    inv = 1 / y
    series = inv * (F.lit(1 / 12) - inv * inv * (F.lit(1 / 360) - inv * inv * F.lit(1 / 1260)))
    out = (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series
    for k in range(SHIFT):
        out = out - F.ln(x + F.lit(float(k)))
    return out


def digamma(x: Column) -> Column:
    y = _shifted(x)
    i2 = 1 / (y * y)
    out = F.ln(y) - 1 / (2 * y) - i2 * (F.lit(1 / 12) - i2 * (F.lit(1 / 120) - i2 * (F.lit(1 / 252) - i2 * F.lit(1 / 240))))
    for k in range(SHIFT):
        out = out - 1 / (x + F.lit(float(k)))
    return out


def trigamma(x: Column) -> Column:
    y = _shifted(x)
    i1, i2 = 1 / y, 1 / (y * y)
    out = i1 + i2 / 2 + i1 * i2 * (F.lit(1 / 6) - i2 * (F.lit(1 / 30) - i2 * (F.lit(1 / 42) - i2 * F.lit(1 / 30))))
    for k in range(SHIFT):
        out = out + 1 / ((x + F.lit(float(k))) * (x + F.lit(float(k))))
    return out


FEW = 64


def _falling(a: Column, d: Column, term, closed: Column) -> Column:
    """Sum of term(a - l) for l = 0 .. d - 1: added up when d is small, else closed."""
    exact = F.aggregate(F.sequence(F.lit(0), F.greatest(F.least(d, F.lit(FEW)), F.lit(1)).cast("int") - 1),
                        F.lit(0.0), lambda acc, i: acc + term(a - i))
    return F.when(d <= 0, 0.0).when(d == 1, term(a)).when(d <= FEW, exact).otherwise(closed)


def sum_inverse(a: Column, d: Column) -> Column:
    """1/a + 1/(a-1) + ... with d terms."""
    return _falling(a, d, lambda v: 1 / v, digamma(a + 1) - digamma(a - d + 1))


def sum_inverse_square(a: Column, d: Column) -> Column:
    return _falling(a, d, lambda v: 1 / (v * v), trigamma(a - d + 1) - trigamma(a + 1))


def sum_log(a: Column, d: Column) -> Column:
    return _falling(a, d, lambda v: F.ln(v), log_gamma(a + 1) - log_gamma(a - d + 1))
