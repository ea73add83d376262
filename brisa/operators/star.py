"""Unit attributes, plant links, stable ids, the dimension and the facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brisa.constants import (CURATED_SOURCES, MIN_CORE_LENGTH, MIN_LINK_POWER_MW, PEAK_RATIO_RANGE)
from brisa.functions.quality import missing_list
from brisa.functions.text import base_code, core_name
from brisa.operators import ordered
from brisa.operators.joins import climate_point, safe_join
from brisa.schemas import DIM_USINA, PONTE, typed
from brisa.session import cut


def latest(column: str, time: str) -> Column:
    """Last non-null value in time order."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(F.col(time), F.col(column))))


def unit_attributes(clean: DataFrame, sources: Sequence[str] | None = CURATED_SOURCES) -> DataFrame:
    """One row per unit: latest attributes, first and last hour, peak."""
    rows = clean.filter(F.col("fonte").isin(*sources)) if sources else clean
    t = "data_hora_utc"
    names = {"id_ons": "id_ons", "ceg_ons": "ceg", "nome": "nome_usina",
             "nome_normalizado": "nome_usina_normalizado", "fonte": "fonte",
             "tipo_unidade": "tipo_unidade", "modalidade_ons": "modalidade_ons",
             "id_estado": "id_estado", "regiao": "id_subsistema"}
    return rows.filter(F.col("chave_unidade").isNotNull()).groupBy("chave_unidade").agg(
        *[latest(c, t).alias(name) for name, c in names.items()],
        F.min(t).alias("primeira_medicao_utc"), F.max(t).alias("ultima_medicao_utc"),
        F.max("geracao_mwh").alias("pico_geracao_mw"))


# ----------------------------------------------------------------------- links
def link_by_code(units: DataFrame, registry: DataFrame) -> DataFrame:
    """Plants whose code, without version, equals the code of a unit."""
    a = units.filter(F.col("ceg_ons").isNotNull()).select(
        "chave_unidade", base_code(F.col("ceg_ons")).alias("ceg_base"))
    b = registry.select(F.col("ceg").alias("ceg_aneel"), base_code(F.col("ceg")).alias("ceg_base"))
    return a.join(b, "ceg_base").select("ceg_aneel", "chave_unidade", F.lit("ceg").alias("metodo_vinculo"),
                                        F.lit(None).cast("string").alias("nucleo_usado"))


def _prefixes(core: Column) -> Column:
    """(text, words) of every prefix of a core that is long enough. The reduction
    from the end stops at the first one that is too short."""
    words = F.split(core, " ")
    all_prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.struct(
        F.array_join(F.slice(words, F.lit(1), n), " ").alias("trecho"), n.alias("palavras")))
    return F.filter(all_prefixes, lambda p: F.length(p["trecho"]) >= MIN_CORE_LENGTH)


def _runs(name: Column) -> Column:
    """Every run of neighbouring words of a name."""
    words = F.split(name, " ")
    starts = F.sequence(F.lit(1), F.size(words))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.size(words) - i + 1),
        lambda n: F.array_join(F.slice(words, i, n), " ")))))


def link_by_name(sets: DataFrame, plants: DataFrame) -> DataFrame:
    """Give each plant to one set whose core name it holds as whole words.

    Sets with the longest core choose first (ties by key); a set takes every
    free plant of its longest prefix that still has one. Pairs of set and plant
    are never made: sets and plants meet at nodes (state, source, prefix). In
    each round a set settles when no other open set comes before it on any plant
    it could take; rounds go on until no open set has a free plant. Plants of one
    state and source with the same name fare alike: rounds see each name once.

    `sets`: chave_unidade, id_estado, fonte, nucleo. `plants`: ceg, id_estado,
    fonte, nome_normalizado.
    """
    node = ["id_estado", "fonte", "trecho"]
    wants = (sets.filter(F.col("nucleo") != "")
             .select("chave_unidade", "id_estado", "fonte",
                     # the smallest goes first: longest core, then the key
                     F.struct((-F.length("nucleo")).alias("tamanho"),
                              F.col("chave_unidade").alias("chave")).alias("vez"),
                     F.explode(_prefixes(F.col("nucleo"))).alias("__p"))
             .select("chave_unidade", "id_estado", "fonte", "vez", "__p.*"))
    nodes = wants.select(*node).distinct()
    # a plant listed under several names stands for itself
    known = plants.filter(F.col("nome_normalizado").isNotNull())
    name = F.struct("id_estado", "fonte", "nome_normalizado")
    single = known.groupBy("ceg").agg((F.min(name) == F.max(name)).alias("__um"))
    known = known.join(single, "ceg").withColumn(
        "__classe", F.struct(F.when(~F.col("__um"), F.col("ceg")).alias("ceg"), F.when(F.col("__um"), name).alias("nome")))
    known = cut(known.select("ceg", "id_estado", "fonte", "nome_normalizado", "__classe"))
    offers = (known.select(F.col("__classe").alias("ceg"), "id_estado", "fonte", "nome_normalizado").distinct()
              .select("ceg", "id_estado", "fonte", F.explode(_runs(F.col("nome_normalizado"))).alias("trecho"))
              .filter(F.length("trecho") >= MIN_CORE_LENGTH)
              .join(nodes, node, "left_semi"))
    all_wants, all_offers = cut(wants), cut(offers)
    links = None
    while True:
        offers, wants = all_offers, all_wants
        if links is not None:
            offers = offers.join(links.select(F.col("ceg_aneel").alias("ceg")), "ceg", "left_anti")
            wants = wants.join(links.select("chave_unidade").distinct(), "chave_unidade", "left_anti")
        wants = wants.join(offers.select(*node).distinct(), node, "left_semi")   # a free plant is left
        top = wants.groupBy(*node).agg(F.min("vez").alias("vez"))
        per_plant = offers.join(top, node).groupBy("ceg").agg(F.min("vez").alias("primeiro"))
        span = (offers.join(per_plant, "ceg").groupBy(*node)
                .agg(F.min("primeiro").alias("de"), F.max("primeiro").alias("ate")))
        ready = (wants.join(span, node)
                 .groupBy("chave_unidade").agg(
                     F.min(((F.col("de") == F.col("vez")) & (F.col("ate") == F.col("vez"))).cast("int")).alias("ok"),
                     F.max_by(F.struct(*node), "palavras").alias("no"))
                 .filter("ok = 1").select("chave_unidade", "no.*"))
        taken = cut(offers.join(ready, node).select(
            F.col("ceg").alias("ceg_aneel"), "chave_unidade", F.lit("nome").alias("metodo_vinculo"),
            F.col("trecho").alias("nucleo_usado")))
        if taken.isEmpty():
            break
        links = taken if links is None else links.unionByName(taken)
    found = (taken if links is None else links).withColumnRenamed("ceg_aneel", "__de")
    return known.select("ceg", "__classe").distinct().join(found, F.col("ceg").isNotNull() & F.col("__classe").eqNullSafe(F.col("__de"))).select(
        F.col("ceg").alias("ceg_aneel"), "chave_unidade", "metodo_vinculo", "nucleo_usado")


def link_units(units: DataFrame, registry: DataFrame) -> DataFrame:
    """Bridge from registry plants to units: by code in any phase, then by name
    among plants in operation that no code link uses."""
    curated = registry.filter(F.col("fonte").isin(*CURATED_SOURCES))
    by_code = link_by_code(units, curated)
    sets = (units.filter(F.col("tipo_unidade") == "conjunto")
            .withColumn("nucleo", core_name(F.col("nome_normalizado"))))
    free = (curated.filter((F.col("fase") == "Operação")
                           & (F.col("potencia_outorgada_mw") >= MIN_LINK_POWER_MW))
            .join(by_code.select(F.col("ceg_aneel").alias("ceg")), "ceg", "left_anti"))
    by_name = link_by_name(sets, free)
    details = curated.select(F.col("ceg").alias("ceg_aneel"), "potencia_outorgada_mw", "latitude",
                             "longitude", "municipio", "data_entrada_operacao")
    return by_code.unionByName(by_name).join(details, "ceg_aneel", "left")


# ------------------------------------------------------------------- dimension
def member_summary(bridge: DataFrame, key: str = "chave_unidade") -> DataFrame:
    """Linked plants of each unit: power, centroid, most frequent town, first date."""
    towns = (bridge.filter(F.col(key).isNotNull() & F.col("municipio").isNotNull())
             .groupBy(key, "municipio").agg(F.count(F.lit(1)).alias("n"))
             .groupBy(key).agg(F.min_by("municipio", F.struct(-F.col("n"), F.col("municipio"))).alias("municipio")))
    sums = bridge.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.coalesce(F.sum("potencia_outorgada_mw"), F.lit(0.0)).alias("potencia_mw"),
        F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"),
        F.min("data_entrada_operacao").alias("data_operacao"),
        F.count(F.lit(1)).alias("n_usinas_aneel"), F.min("metodo_vinculo").alias("metodo_vinculo"))
    return sums.join(towns, key, "left")


def judge_link(df: DataFrame) -> DataFrame:
    """Compare the observed peak with the linked power and keep only trusted power."""
    low, high = PEAK_RATIO_RANGE
    ratio = F.try_divide(F.col("pico_geracao_mw"), F.col("potencia_mw"))
    quality = (F.when(F.col("metodo_vinculo") == "ceg", "exata")
               .when((F.col("metodo_vinculo") == "nome") & F.coalesce(ratio.between(low, high), F.lit(False)),
                     "consistente")
               .when(F.col("metodo_vinculo") == "nome", "inconsistente").otherwise("sem_vinculo"))
    trusted = quality.isin("exata", "consistente")
    return df.withColumns({
        "potencia_aneel_vinculada_mw": F.col("potencia_mw"), "razao_pico_potencia": ratio,
        "qualidade_vinculo": quality, "potencia_mw": F.when(trusted, F.col("potencia_mw"))})


ID_ORDER = ("fonte", "regiao", "id_estado", "nome", "chave_unidade")


def stable_ids(units: DataFrame, previous: DataFrame | None = None,
               order: Sequence[str] = ID_ORDER, key: str = "chave_unidade", name: str = "usina_id") -> DataFrame:
    """Keep the id a key already has; new keys get the next numbers in order."""
    if previous is None:
        return ordered.row_numbers(units, order, name).withColumn(name, F.col(name).cast("long"))
    known = previous.groupBy(key).agg(F.max(name).cast("long").alias(name))
    start = (previous.agg(F.max(name)).first()[0] or 0) + 1
    kept = units.join(known, key)
    fresh = ordered.row_numbers(units.join(known, key, "left_anti"), order, name, start=int(start))
    return kept.unionByName(fresh.withColumn(name, F.col(name).cast("long")))


def build_dimension(clean: DataFrame, registry: DataFrame,
                    previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dimension, bridge) from clean generation and clean registry."""
    units = unit_attributes(clean)
    bridge = link_units(units, registry)
    dim = safe_join(units, member_summary(bridge), ["chave_unidade"], "left", validate="one_to_one")
    dim = dim.withColumns({"metodo_vinculo": F.coalesce("metodo_vinculo", F.lit("sem_vinculo")),
                           "n_usinas_aneel": F.coalesce("n_usinas_aneel", F.lit(0))})
    dim = typed(stable_ids(judge_link(dim), previous), DIM_USINA)
    bridge = bridge.join(dim.select("chave_unidade", "usina_id"), "chave_unidade", "left")
    return dim, typed(bridge, PONTE)


# ----------------------------------------------------------------------- facts
def generation_fact(clean: DataFrame, dim: DataFrame,
                    sources: Sequence[str] | None = CURATED_SOURCES) -> DataFrame:
    """Unit x hour; hours without a measure stay as null with their flag."""
    rows = clean.filter(F.col("fonte").isin(*sources)) if sources else clean
    picked = rows.select("chave_unidade", F.col("data_hora_utc").alias("timestamp_utc"),
                         F.col("geracao_mwh").alias("energia_mwh"), "fonte",
                         F.col("id_subsistema").alias("regiao"), "flag_qualidade")
    return picked.join(dim.select("chave_unidade", "usina_id"), "chave_unidade").select(
        "usina_id", "timestamp_utc", "energia_mwh", "fonte", "regiao", "flag_qualidade")


CLIMATE_NAMES = {"irradiancia_kwh_m2_dia": "irradiancia_kwh_m2", "vento_50m_ms": "vento_ms",
                 "temperatura_2m_c": "temperatura_c"}
CLIMATE_MEASURES = ("irradiancia_kwh_m2", "vento_ms", "vento_10m_ms", "temperatura_c",
                    "temperatura_max_c", "temperatura_min_c")


def climate_points(daily: DataFrame) -> DataFrame:
    """One row per collection point, at its earliest day."""
    attrs = ["id_estado", "id_subsistema", "latitude", "longitude"]
    return daily.groupBy("local").agg(F.min_by(F.struct(*attrs), "data").alias("__a")).select("local", "__a.*")


def climate_fact(daily: DataFrame, dim: DataFrame) -> DataFrame:
    """Unit x day with the climate of the reference point of the unit."""
    link = climate_point(dim, climate_points(daily))
    renamed = daily.withColumnsRenamed(CLIMATE_NAMES).withColumnRenamed("local", "local_clima")
    fact = link.join(renamed, "local_clima")
    return fact.withColumn("medidas_faltantes", missing_list(CLIMATE_MEASURES)).select(
        "usina_id", "data", *CLIMATE_MEASURES, "flag_qualidade", "medidas_faltantes", "local_clima",
        "distancia_km", "metodo_vinculo_clima")


def maintenance_fact(events: DataFrame, bridge: DataFrame) -> DataFrame:
    """First event of a unit over its plants, or censored at the cut-off."""
    members = safe_join(events.drop("usina_id"), bridge.select(F.col("ceg_aneel").alias("ceg"), "usina_id"),
                        ["ceg"], "inner", validate="one_to_one")
    first = members.groupBy("usina_id").agg(
        F.min(F.to_date("data_entrada_operacao")).alias("inicio"),
        F.max(F.to_date("data_corte")).alias("corte"),
        F.min(F.to_date("data_evento")).alias("data_primeiro_evento"),
        F.min_by("tipo_evento", F.when(F.col("tipo_evento").isNotNull(), F.struct(
            F.coalesce(F.to_date("data_evento"), F.lit("9999-12-31").cast("date")), F.col("tipo_evento")))
            ).alias("tipo_evento"),
        F.count(F.lit(1)).alias("n_usinas_consideradas"))
    end = F.coalesce("data_primeiro_evento", "corte")
    return first.select(
        "usina_id", F.greatest(F.datediff(end, "inicio"), F.lit(1)).cast("int").alias("tempo_dias"),
        F.col("data_primeiro_evento").isNotNull().alias("evento_ocorreu"), "data_primeiro_evento",
        "tipo_evento", F.col("n_usinas_consideradas").cast("int").alias("n_usinas_consideradas"),
        F.lit(True).alias("simulado"))
