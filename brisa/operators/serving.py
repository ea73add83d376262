"""Read queries over the star: roll-ups, series, pages, shares and totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brisa.constants import LATENCY_BUCKETS_MS, LOCAL_ZONE
from brisa.functions.dates import check_window, in_days, local_day
from brisa.operators import ordered

UNIT_COLUMNS = ("usina_id", "nome", "fonte", "regiao", "id_estado", "municipio", "potencia_mw", "lat", "lon",
                "data_operacao", "tipo_unidade", "qualidade_vinculo")
UNIT_DETAIL = (*UNIT_COLUMNS, "n_usinas_aneel", "pico_geracao_mw", "primeira_medicao_utc", "ultima_medicao_utc")


def daily_generation(fact: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Unit x local day: energy and hours with a measure."""
    return fact.groupBy("usina_id", local_day(F.col("timestamp_utc"), zone).alias("dia")).agg(
        F.sum("energia_mwh").alias("energia_mwh"),
        F.count_if(F.col("flag_qualidade") != "faltante").alias("horas_validas"))


def _dealt(fact: DataFrame) -> DataFrame:
    """Rows dealt to a fixed number of tasks by unit and hour. Repeated hours compress so well that a
    shuffle sized by its bytes gives few tasks, whose table of units and hours grows without bound."""
    return fact.repartition(ordered.bucket_count(fact), "usina_id", "timestamp_utc")


def national_hourly(fact: DataFrame) -> DataFrame:
    """Hour x source x region: energy and distinct units."""
    return _dealt(fact).groupBy("timestamp_utc", "fonte", "regiao").agg(
        F.sum("energia_mwh").alias("energia_mwh"), F.count_distinct("usina_id").alias("usinas"))


def capacity_factor(fact: DataFrame, dim: DataFrame, climate: DataFrame) -> DataFrame:
    """Daily capacity factor on complete days of units with known power."""
    days = daily_generation(fact).filter("horas_validas = 24")
    units = dim.filter(F.col("potencia_mw").isNotNull()).select("usina_id", "fonte", "regiao", "potencia_mw")
    weather = climate.select("usina_id", F.col("data").alias("dia"), "irradiancia_kwh_m2", "vento_ms",
                             "temperatura_c")
    return (days.join(units, "usina_id").join(weather, ["usina_id", "dia"], "left")
            .select("usina_id", "dia", "fonte", "regiao", "energia_mwh", "potencia_mw",
                    F.try_divide(F.col("energia_mwh"), F.col("potencia_mw") * 24).alias("fator_capacidade"),
                    "irradiancia_kwh_m2", "vento_ms", "temperatura_c"))


def national_rollup(fact: DataFrame, by: str = "dia", first: date | str | None = None,
                    last: date | str | None = None, source: str | None = None) -> DataFrame:
    """Energy and distinct units by hour or local day and source."""
    check_window(first, last)
    period = F.col("timestamp_utc") if by == "hora" else local_day(F.col("timestamp_utc"))
    return (where(fact.filter(in_days(F.col("timestamp_utc"), first, last)), {"fonte": source})
            .groupBy(period.alias("periodo"), "fonte")
            .agg(F.sum("energia_mwh").alias("energia_mwh"), F.count_distinct("usina_id").alias("usinas")))


def where(df: DataFrame, equals: Mapping[str, object]) -> DataFrame:
    """Filters joined with AND; a filter without a value is left out."""
    for c, v in equals.items():
        if v is not None:
            df = df.filter(F.col(c) == F.lit(v))
    return df


def find_unit(dim: DataFrame, unit: int) -> DataFrame:
    """Detail of one unit; an unknown id is an error."""
    found = dim.filter(F.col("usina_id") == unit).select(*[c for c in UNIT_DETAIL if c in dim.columns])
    if found.isEmpty():
        raise LookupError(f"no unit with id {unit}")
    return found


def unit_series(fact: DataFrame, unit: int, first: date | str | None = None,
                last: date | str | None = None) -> DataFrame:
    check_window(first, last)
    return (fact.filter(F.col("usina_id") == unit).filter(in_days(F.col("timestamp_utc"), first, last))
            .select(F.col("timestamp_utc").alias("timestamp"), "energia_mwh", "flag_qualidade")
            .orderBy("timestamp"))


def series_summary(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First, last, total and number of hours of a series, or of every series."""
    aggs = [F.min("timestamp_utc").alias("inicio"), F.max("timestamp_utc").alias("fim"),
            F.coalesce(F.sum("energia_mwh"), F.lit(0.0)).alias("total_mwh"), F.count(F.lit(1)).alias("horas")]
    return fact.groupBy(*by).agg(*aggs) if by else fact.agg(*aggs)


def unit_climate(climate: DataFrame, unit: int, first: date | str | None = None,
                 last: date | str | None = None) -> DataFrame:
    """Climate days of one unit with their reference point; none is an error."""
    check_window(first, last)
    rows = climate.filter(F.col("usina_id") == unit)
    if first is not None:
        rows = rows.filter(F.col("data") >= F.lit(str(first)).cast("date"))
    if last is not None:
        rows = rows.filter(F.col("data") <= F.lit(str(last)).cast("date"))
    if rows.isEmpty():
        raise LookupError(f"no climate for unit {unit} in the period")
    return rows.orderBy("data")


def shares(fact: DataFrame, days: int = 30) -> DataFrame:
    """Share of every unit in its source over the last observed days."""
    limit = fact.agg((F.max("timestamp_utc") - F.expr(f"INTERVAL {int(days)} DAY")).alias("__corte"))
    recent = fact.join(F.broadcast(limit), F.col("timestamp_utc") >= F.col("__corte"))
    units = recent.groupBy("fonte", "usina_id").agg(F.sum("energia_mwh").alias("usina_mwh"))
    totals = units.groupBy("fonte").agg(F.sum("usina_mwh").alias("fonte_mwh"))
    return units.join(totals, "fonte").select(
        "usina_id", "fonte", F.coalesce(F.try_divide("usina_mwh", "fonte_mwh"), F.lit(0.0)).alias("participacao"))


def share_of_unit(fact: DataFrame, unit: int, source: str, days: int = 30) -> DataFrame:
    """One row: share of a unit in a source over the last observed days."""
    limit = fact.agg((F.max("timestamp_utc") - F.expr(f"INTERVAL {int(days)} DAY")).alias("__corte"))
    recent = (fact.filter(F.col("fonte") == source)
              .join(F.broadcast(limit), F.col("timestamp_utc") >= F.col("__corte")))
    return recent.agg(F.coalesce(F.try_divide(
        F.sum(F.when(F.col("usina_id") == unit, F.col("energia_mwh")).otherwise(0.0)),
        F.sum("energia_mwh")), F.lit(0.0)).alias("participacao"))


def coverage(fact: DataFrame, climate: DataFrame, dim: DataFrame) -> DataFrame:
    """One row: units, period and size of the facts."""
    g = fact.agg(F.min("timestamp_utc").alias("geracao_inicio"), F.max("timestamp_utc").alias("geracao_fim"),
                 F.count(F.lit(1)).alias("geracao_linhas"))
    c = climate.agg(F.min("data").alias("clima_inicio"), F.max("data").alias("clima_fim"),
                    F.count(F.lit(1)).alias("clima_linhas"))
    return dim.agg(F.count(F.lit(1)).alias("usinas")).join(F.broadcast(g)).join(F.broadcast(c))


def smoke_summary(fact: DataFrame, dim: DataFrame, factors: DataFrame, events: DataFrame) -> DataFrame:
    """(medida, grupo, valor) of the checks a fresh build must answer."""
    def rows(df: DataFrame, name: str, group: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("medida"), group.cast("string").alias("grupo"),
                         value.cast("double").alias("valor"))
    week = fact.agg(F.max("timestamp_utc").alias("__fim"), F.min("usina_id").alias("__u"))
    recent = fact.join(F.broadcast(week), (F.col("usina_id") == F.col("__u")) & (
        F.col("timestamp_utc") >= F.col("__fim") - F.expr("INTERVAL 7 DAY")))
    parts = [
        rows(dim.groupBy("fonte").count(), "usinas_por_fonte", F.col("fonte"), F.col("count")),
        rows(fact.groupBy("fonte").agg((F.sum("energia_mwh") / 1000).alias("v")), "gwh_por_fonte",
             F.col("fonte"), F.col("v")),
        rows(factors.groupBy("fonte").agg(F.avg("fator_capacidade").alias("v")), "fator_medio",
             F.col("fonte"), F.col("v")),
        rows(events.groupBy("evento_ocorreu").count(), "eventos", F.col("evento_ocorreu"), F.col("count")),
        rows(recent.agg(F.sum("energia_mwh").alias("v")), "ultimos_7_dias", F.lit("primeira_usina"), F.col("v"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_totals(rollup: DataFrame) -> DataFrame:
    """Energy per source and number of distinct periods of a roll-up."""
    return rollup.groupBy("fonte").agg(F.sum("energia_mwh").alias("total_mwh"),
                                       F.count_distinct("periodo").alias("periodos"))


def missing_counts(fact: DataFrame, climate: DataFrame, measure: str) -> DataFrame:
    """Per unit: hours without energy and days on which a measure is missing."""
    hours = fact.groupBy("usina_id").agg(F.count_if(F.col("energia_mwh").isNull()).alias("horas_sem_medida"))
    days = climate.groupBy("usina_id").agg(F.count_if(F.coalesce(F.array_contains(
        F.split("medidas_faltantes", ","), measure), F.lit(False))).alias("dias_sem_medida"))
    return hours.join(days, "usina_id", "left").withColumn("dias_sem_medida", F.coalesce("dias_sem_medida", F.lit(0)))


def factor_per_plant(fact: DataFrame, dim: DataFrame, bridge: DataFrame) -> DataFrame:
    """Capacity factor in (0, 1] per unit, then the mean per registry code."""
    hours = fact.groupBy("usina_id").agg(F.coalesce(F.sum("energia_mwh"), F.lit(0.0)).alias("e"),
                                         F.count(F.lit(1)).alias("h"))
    units = (hours.join(dim.select("usina_id", "potencia_mw"), "usina_id")
             .withColumn("fator_capacidade", F.try_divide(F.col("e"), F.col("potencia_mw") * F.col("h")))
             .filter("fator_capacidade > 0 and fator_capacidade <= 1"))
    return (bridge.select("ceg_aneel", "usina_id").join(units, "usina_id")
            .groupBy("ceg_aneel").agg(F.avg("fator_capacidade").alias("fator_capacidade")))


def phase_counts(registry: DataFrame, kind: str = "sig_tipo_geracao", phase: str = "fase") -> DataFrame:
    return registry.groupBy(kind, phase).agg(F.count(F.lit(1)).alias("usinas"))


def access_counts(log: DataFrame, buckets: Sequence[int] = LATENCY_BUCKETS_MS) -> DataFrame:
    """Requests by method, route and status with latency sum and cumulative buckets.
    The same expression runs on a stream."""
    return log.groupBy("metodo", "rota", "status").agg(
        F.count(F.lit(1)).alias("requisicoes"), F.sum("latencia_ms").alias("latencia_soma_ms"),
        *[F.count_if(F.col("latencia_ms") <= b).alias(f"ate_{b}_ms") for b in buckets])


def top_units(fact: DataFrame, n: int = 3) -> DataFrame:
    return (fact.groupBy("usina_id").agg(F.sum("energia_mwh").alias("energia_mwh"))
            .orderBy(F.desc_nulls_last("energia_mwh"), "usina_id").limit(n))


def page(dim: DataFrame, limit: int, after: int | None = None, source: str | None = None,
         region: str | None = None, kind: str | None = None) -> tuple[list, int | None, int]:
    """(rows, next key, total): keyset page; one row more than asked tells whether
    a next page exists."""
    kept = where(dim, {"fonte": source, "regiao": region, "tipo_unidade": kind})
    ahead = kept if after is None else kept.filter(F.col("usina_id") > after)
    rows = ahead.select(*[c for c in UNIT_COLUMNS if c in dim.columns]).orderBy("usina_id").limit(limit + 1).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    return rows, (rows[-1]["usina_id"] if more and rows else None), kept.count()


def page_table(dim: DataFrame, limit: int, after: int | None = None) -> DataFrame:
    """A page as a table with the next key and the total on every row."""
    ahead = dim if after is None else dim.filter(F.col("usina_id") > after)
    some = ahead.orderBy("usina_id").limit(limit + 1)
    marked = some.withColumn("__i", F.row_number().over(W.orderBy("usina_id")))   # limit + 1 rows
    last = marked.agg(F.when(F.max("__i") > limit, F.max(F.when(F.col("__i") == limit, F.col("usina_id"))))
                      .alias("proxima_chave"))
    total = dim.agg(F.count(F.lit(1)).alias("total"))
    return (marked.filter(F.col("__i") <= limit).drop("__i")
            .join(F.broadcast(last)).join(F.broadcast(total)))


def top_categories(df: DataFrame, column: str, n: int = 10, rest: str = "(outras)") -> DataFrame:
    """Counts of the n most frequent values, the others as one, with percent."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("categoria")).agg(
        F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "categoria").limit(n).select("categoria", F.lit(True).alias("__top"))
    named = counts.join(F.broadcast(best), "categoria", "left").withColumn(
        "categoria", F.when(F.col("__top"), F.col("categoria")).otherwise(F.lit(rest)))
    out = named.groupBy("categoria").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    return out.join(F.broadcast(total)).select("categoria", "n", (100 * F.col("n") / F.col("__t")).alias("pct"))


def extremes(df: DataFrame, column: str, n: int, *, largest: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    order = F.desc_nulls_last(column) if largest else F.asc_nulls_last(column)
    return df.orderBy(order, *tie).limit(n)


def median_distance(df: DataFrame, group: str, column: str) -> DataFrame:
    """Rows with the exact median of their group and the distance to it."""
    medians = ordered.quantiles_wide(df, column, {"mediana": 0.5}, [group])
    return ordered.null_safe(df, medians, [group], "left").withColumn(
        "distancia", F.abs(F.col(column) - F.col("mediana")))
