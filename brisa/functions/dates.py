"""Time expressions: zones, calendar parts, cycles and durations."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from brisa.constants import DAYS_PER_UNIT, DAYS_PER_YEAR, LOCAL_ZONE, MAX_WINDOW_DAYS


def local_to_utc(c: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall clock of a local time; a time that does not exist, or exists
    twice, gives null."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), c)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    hour_later = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc + F.expr("INTERVAL 1 HOUR"))
    hour_before = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc - F.expr("INTERVAL 1 HOUR"))
    return F.when((back == c) & (hour_later != c) & (hour_before != c), utc)


def utc_to_local(c: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz"))


def local_day(c: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(utc_to_local(c, zone))


CALENDAR = {
    "ano": lambda c: F.year(c),
    "mes": lambda c: F.month(c),
    "dia": lambda c: F.dayofmonth(c),
    "dia_semana": lambda c: F.weekday(c),
    "dia_ano": lambda c: F.dayofyear(c),
    "semana": lambda c: F.weekofyear(c),
    "trimestre": lambda c: F.quarter(c),
    "hora": lambda c: F.hour(c),
    "minuto": lambda c: F.minute(c),
    "fim_de_semana": lambda c: (F.weekday(c) >= 5).cast("int"),
    "inicio_mes": lambda c: (F.dayofmonth(c) == 1).cast("int"),
    "fim_mes": lambda c: (F.to_date(c) == F.last_day(c)).cast("int"),
}
CYCLES = {"mes": 12, "dia_semana": 7, "hora": 24}


def calendar_features(df: DataFrame, column: str, parts: Sequence[str] | None = None,
                      cyclic: bool = False, prefix: str | None = None) -> DataFrame:
    p, c = prefix or column, F.col(column)
    new = {f"{p}_{part}": CALENDAR[part](c) for part in (parts or CALENDAR)}
    if cyclic:
        for part, period in CYCLES.items():
            angle = F.lit(2.0) * F.pi() * CALENDAR[part](c) / F.lit(float(period))
            new[f"{p}_{part}_sen"] = F.sin(angle)
            new[f"{p}_{part}_cos"] = F.cos(angle)
    return df.withColumns(new)


def years_to_days(years: Column) -> Column:
    """Whole days of a length in years, half to even, at least one."""
    return F.greatest(F.bround(years * F.lit(DAYS_PER_YEAR), 0), F.lit(1.0)).cast("long")


def days_between(start: Column, end: Column) -> Column:
    return F.greatest(F.datediff(end, start), F.lit(1)).cast("long")


def duration(start: Column, end: Column, unit: str = "dias") -> Column:
    return F.datediff(end, start) / F.lit(DAYS_PER_UNIT[unit])


def in_days(c: Column, first: date | str | None = None, last: date | str | None = None) -> Column:
    """Rows from the first day to the end of the last day."""
    cond = F.lit(True)
    if first is not None:
        cond = cond & (c >= F.lit(str(first)).cast("timestamp_ntz"))
    if last is not None:
        cond = cond & (c < F.lit(str(last)).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return cond


def check_window(first: date | str | None, last: date | str | None, limit: int = MAX_WINDOW_DAYS) -> None:
    if first is None or last is None:
        return
    a, b = date.fromisoformat(str(first)), date.fromisoformat(str(last))
    if a > b:
        raise ValueError("the first day must not be after the last day")
    if (b - a).days > limit:
        raise ValueError(f"a window of {(b - a).days} days exceeds {limit}")
