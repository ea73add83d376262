"""Numeric expressions: distance, scores, covariates, bins, hash draws, normal curve."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brisa.constants import EARTH_RADIUS_KM, REFERENCE_POWER_MW, REFERENCE_YEAR


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, o1, a2, o2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def model_covariates(df: DataFrame, power: str = "potencia_mw", subsystem: str = "id_subsistema",
                     start: str = "data_entrada_operacao") -> DataFrame:
    """Centred log power, subsystem marks with SE as reference, centred first year."""
    new = {"log_potencia_mw_c": F.ln(power) - F.ln(F.lit(REFERENCE_POWER_MW))}
    for code in ("NE", "S", "N"):
        new[f"subsistema_{code}"] = F.coalesce((F.col(subsystem) == code).cast("double"), F.lit(0.0))
    new["ano_entrada_c"] = (F.year(start) - REFERENCE_YEAR).cast("double")
    return df.withColumns(new)


def linear_score(terms: Mapping[str, tuple[float, float]]) -> Column:
    """Sum of beta x (value - reference) for {column: (reference, beta)}; null adds 0."""
    total = F.lit(0.0)
    for name, (reference, beta) in terms.items():
        total = total + F.coalesce(F.col(name) - F.lit(reference), F.lit(0.0)) * F.lit(beta)
    return total


def bin_of(c: Column, edges: Sequence[float], labels: Sequence | None = None,
           include_lowest: bool = True) -> Column:
    """Right-closed bin of a value: number from 1, or the label; outside, or without edges, null."""
    names = list(labels) if labels is not None else list(range(1, len(edges)))
    if len(edges) < 2:
        return F.lit(None).cast("int" if labels is None else "string")
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        low = (c >= F.lit(lo)) if i == 0 and include_lowest else (c > F.lit(lo))
        cond = low & (c <= F.lit(hi))
        out = F.when(cond, F.lit(names[i])) if out is None else out.when(cond, F.lit(names[i]))
    return out


def hash_unit(*columns: Column, seed: int | str = 42) -> Column:
    """Uniform number in [0, 1) that depends only on the key and the seed, so a
    task that runs again draws the same."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


# Coefficients of the rational normal curve (Hart, as given by West, 2005).
_NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
              112.079291497871, 221.213596169931, 220.206867912376)
_DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
                296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + F.lit(k)
    return out


def normal_cdf(z: Column) -> Column:
    """Normal distribution function as plain arithmetic, inside codegen."""
    x = F.abs(z)
    density = F.exp(-x * x / 2)
    middle = density * _horner(x, _NUMERATOR) / _horner(x, _DENOMINATOR)
    far = x + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        far = x + F.lit(k) / far
    tail = F.when(x > 37, 0.0).when(x < 7.07106781186547, middle).otherwise(density / far / 2.506628274631)
    return F.when(z > 0, 1 - tail).otherwise(tail)
