"""Quality expressions: reasons, flags and lists of missing measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brisa.constants import (EARLIEST_DATE, FILL_VALUE, LATITUDE_RANGE, LONGITUDE_RANGE,
                             SENTINEL_DATE)


def date_reason(c: Column) -> Column:
    """Why a start date cannot be trusted; null when it can."""
    return (F.when(c == F.lit(SENTINEL_DATE).cast("date"), "sentinela_1900")
            .when(c < F.lit(EARLIEST_DATE).cast("date"), "implausivel_pre_1990"))


def coordinate_reason(lat: Column, lon: Column) -> Column:
    """'zerada' for (0,0), 'fora_do_brasil' outside the box or unknown; else null."""
    inside = lat.between(*LATITUDE_RANGE) & lon.between(*LONGITUDE_RANGE)
    return (F.when((lat == 0) & (lon == 0), "zerada")
            .when(~F.coalesce(inside, F.lit(False)), "fora_do_brasil"))


def fill_to_null(df: DataFrame, columns: Sequence[str], fill: float = FILL_VALUE) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(fill)) for c in columns})


def clip_negative(c: Column) -> tuple[Column, Column]:
    """(value not below 0, reason 'negativo_zerado' or null)."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c), F.when(c < 0, "negativo_zerado")


def missing_list(columns: Sequence[str]) -> Column:
    """Names of the null columns of a row, comma-separated; null when none."""
    return F.nullif(F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), F.lit(""))


def quality_flag(interpolated: Column, missing: Column, extra: Column | None = None) -> Column:
    """Precedence: faltante, interpolado, extra, original."""
    flag = F.when(missing, "faltante").when(interpolated, "interpolado")
    other = F.lit("original") if extra is None else F.coalesce(extra, F.lit("original"))
    return flag.otherwise(other)


def check_rows(df: DataFrame, rules: dict[str, Column]) -> None:
    """Stop with the count of every broken rule. `rules` say what is wrong."""
    row = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()]).first()
    broken = {name: row[name] for name in rules if row[name]}
    if broken:
        raise ValueError(f"rows break the rules: {broken}")
