"""The layers: raw tables to clean tables to the validated star."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from brisa import constants as K
from brisa.functions import dates, quality, text
from brisa.operators import grid, star, validate
from brisa.operators.cleaning import deduplicate, require_unique
from brisa.session import table_in_shared_folder
from brisa.sources.readers import POSITION, with_position
from brisa.sources.writers import publish

GENERATION_TEXT = ("id_subsistema", "nom_subsistema", "id_estado", "nom_estado", "cod_modalidadeoperacao",
                   "nom_tipousina", "nom_tipocombustivel", "nom_usina", "id_ons", "ceg")
UNIT_ATTRIBUTES = ("id_ons", "ceg", "modalidade_ons", "tipo_unidade", "fonte", "combustivel",
                   "id_subsistema", "id_estado", "nome_usina")
SITE_ATTRIBUTES = ("municipio", "id_estado", "id_subsistema", "latitude", "longitude")


def clean_generation(raw: DataFrame, order: tuple[str, ...] = ("arquivo_origem",)) -> DataFrame:
    """Hourly generation: one row per unit and hour, gaps marked, UTC. Of rows for the same unit and
    hour the last by `order` stays, and of those the last in its file."""
    raw = with_position(raw)
    df = text.clean_texts(raw.withColumn("din_instante", F.col("din_instante").cast("timestamp_ntz")),
                          [c for c in GENERATION_TEXT if c in raw.columns], ("", "-"))
    df = deduplicate(df, ["din_instante", "id_estado", "nom_usina", "cod_modalidadeoperacao", "nom_tipousina"],
                     [c for c in order if c in df.columns], "last").drop(*POSITION)
    df = df.withColumns({
        "fonte": text.map_code(F.col("nom_tipousina"), K.SOURCE_BY_PLANT_TYPE),
        "chave_unidade": text.natural_key(F.col("id_ons"), F.col("nom_usina"), F.col("id_estado")),
        "tipo_unidade": text.map_code(F.col("cod_modalidadeoperacao"), K.UNIT_KIND_BY_MODALITY, "usina"),
    }).withColumnsRenamed({"cod_modalidadeoperacao": "modalidade_ons", "nom_tipocombustivel": "combustivel",
                           "val_geracao": "geracao_mwh"})
    # written once: the checks, the names and the grid below read this table, not the raw files
    df = require_unique(table_in_shared_folder(df, "generation"), ["chave_unidade", "din_instante"])
    names, _ = grid.canonical_name(df, "chave_unidade", "nom_usina", "din_instante")
    df = df.join(names.withColumnRenamed("nome_canonico", "nome_usina"), "chave_unidade", "left")
    full = grid.complete_grid(df, "chave_unidade", "din_instante", UNIT_ATTRIBUTES)
    value, negative = quality.clip_negative(F.col("geracao_mwh"))
    full = full.withColumns({"__neg": negative, "geracao_mwh": value})
    full = grid.fill_short_gaps(full, "chave_unidade", "din_instante", ["geracao_mwh"], K.MAX_GAP_HOURS)
    return full.withColumns({
        "flag_qualidade": quality.quality_flag(F.col("interpolado"), F.col("faltante"), F.col("__neg")),
        "data_hora_utc": dates.local_to_utc(F.col("din_instante")),
        "nome_usina_normalizado": text.name_key(F.col("nome_usina")),
    }).withColumn("data_hora_brasilia", F.when(F.col("data_hora_utc").isNotNull(), F.col("din_instante"))).select(
        "data_hora_utc", "data_hora_brasilia", "chave_unidade", "id_ons", "ceg", "nome_usina",
        "nome_usina_normalizado", "tipo_unidade", "modalidade_ons", "fonte", "combustivel", "id_subsistema",
        "id_estado", "geracao_mwh", "flag_qualidade", "arquivo_origem")


def _clean_climate(raw: DataFrame, names: Mapping[str, str], time: str, step: str, max_gap: int) -> DataFrame:
    measures = list(names.values())
    df = quality.fill_to_null(raw.withColumnsRenamed(dict(names)), measures)
    df = deduplicate(df, ["local", time], keep="last").drop(*POSITION)
    full = grid.complete_grid(df, "local", time, SITE_ATTRIBUTES, step)
    full = grid.fill_short_gaps(full, "local", time, measures, max_gap, step)
    return full.withColumns({
        "flag_qualidade": quality.quality_flag(F.col("interpolado"), F.col("faltante")),
        "medidas_faltantes": quality.missing_list(measures)})


def clean_hourly_climate(raw: DataFrame) -> DataFrame:
    timed = with_position(raw).withColumn("data_hora_utc", F.try_to_timestamp(
        F.col("data_hora_utc"), F.lit("yyyyMMddHH")).cast("timestamp_ntz"))
    df = _clean_climate(timed, K.HOURLY_CLIMATE, "data_hora_utc", "hour", K.MAX_GAP_HOURS)
    return df.withColumn("data_hora_brasilia", dates.utc_to_local(F.col("data_hora_utc"))).select(
        "local", *SITE_ATTRIBUTES, "data_hora_utc", "data_hora_brasilia", *K.HOURLY_CLIMATE.values(),
        "flag_qualidade", "medidas_faltantes")


def clean_daily_climate(raw: DataFrame) -> DataFrame:
    timed = with_position(raw).withColumn("data", F.try_to_timestamp(F.col("data_lst"), F.lit("yyyyMMdd")).cast("date"))
    df = _clean_climate(timed, K.DAILY_CLIMATE, "data", "day", K.MAX_GAP_DAYS)
    return df.select("local", *SITE_ATTRIBUTES, "data", *K.DAILY_CLIMATE.values(),
                     "flag_qualidade", "medidas_faltantes")


NUMBERS = ("potencia_outorgada_kw", "potencia_fiscalizada_kw", "garantia_fisica_kw", "latitude", "longitude")
DATES = ("data_retrato", "data_entrada_operacao", "inicio_vigencia", "fim_vigencia")


def clean_registry(raw: DataFrame) -> DataFrame:
    """Plant registry: typed, one row per code, doubtful dates and places to null."""
    df = with_position(text.rename_and_drop(text.rename_clean(raw), K.REGISTRY_COLUMNS, K.REGISTRY_DROPPED))
    df = text.clean_texts(df, [n for n, t in df.dtypes if t == "string"])
    order = [c for c in ("data_retrato",) if c in df.columns]
    df = deduplicate(df, ["ceg"], order, "last")
    df = text.convert_types(df, NUMBERS, DATES, date_format="yyyy-MM-dd")
    df = df.withColumns({c: F.col(c).cast("date") for c in DATES})
    df = df.withColumns({
        "flag_data_operacao": quality.date_reason(F.col("data_entrada_operacao")),
        "flag_coordenada": quality.coordinate_reason(F.col("latitude"), F.col("longitude")),
        "municipios": F.when(F.lower("municipios") != "não informado", F.col("municipios"))})
    place, state = text.split_place(text.first_of_list(F.col("municipios")))
    return df.withColumns({
        "data_entrada_operacao": F.when(F.col("flag_data_operacao").isNull(), F.col("data_entrada_operacao")),
        "latitude": F.when(F.col("flag_coordenada").isNull(), F.col("latitude")),
        "longitude": F.when(F.col("flag_coordenada").isNull(), F.col("longitude")),
        "municipio": place, "uf_municipio": state, "municipio_normalizado": text.name_key(place),
        "nome_normalizado": text.name_key(F.col("nome")),
        "fonte": text.map_code(F.col("sig_tipo_geracao"), K.SOURCE_BY_REGISTRY_CODE),
        "id_subsistema": text.map_code(F.col("id_estado"), K.SUBSYSTEM_BY_STATE),
        **{c.replace("_kw", "_mw"): F.col(c) / 1000 for c in NUMBERS[:3]},
    }).select(
        "ceg", "nucleo_ceg", "nome", "nome_normalizado", "sig_tipo_geracao", "fonte", "fase", "tipo_outorga",
        "origem_combustivel", "fonte_combustivel", "id_estado", "id_subsistema", "municipio", "uf_municipio",
        "municipio_normalizado", "municipios", "potencia_outorgada_mw", "potencia_fiscalizada_mw",
        "garantia_fisica_mw", "latitude", "longitude", "flag_coordenada", "data_entrada_operacao",
        "flag_data_operacao", "inicio_vigencia", "fim_vigencia", "geracao_qualificada", "data_retrato")


def event_rules() -> dict:
    return {
        "tempo <= 0": F.col("tempo_anos") <= 0,
        "evento fora de {0,1}": ~F.coalesce(F.col("evento").isin(0, 1), F.lit(False)),
        "evento sem data": (F.col("evento") == 1) & F.col("data_evento").isNull(),
        "censurado com data": (F.col("evento") == 0) & F.col("data_evento").isNotNull(),
        "evento após o corte": F.col("data_evento") > F.col("data_corte"),
    }


def clean_events(raw: DataFrame) -> DataFrame:
    """First-event table: one row per plant, rules checked, days added."""
    df = deduplicate(raw, ["ceg"], ["data_corte"], "last")
    quality.check_rows(df, event_rules())
    return df.withColumns({"tempo_dias": dates.years_to_days(F.col("tempo_anos")),
                           "evento": F.col("evento").cast("long"), "simulado": F.lit(True)})


def curate(generation: DataFrame, registry: DataFrame, climate: DataFrame, events: DataFrame,
           previous: DataFrame | None = None) -> dict[str, DataFrame]:
    """The star and its bridge from clean tables."""
    dim, bridge = star.build_dimension(generation, registry, previous)
    return {"dim_usina": dim, "fato_geracao": star.generation_fact(generation, dim),
            "fato_clima": star.climate_fact(climate, dim),
            "fato_manutencao": star.maintenance_fact(events, bridge), "ponte_usina_aneel": bridge}


def publish_star(tables: Mapping[str, DataFrame], root: str) -> str:
    """Publish the star when every rule holds; otherwise the old one stays."""
    return publish(tables, root, check=validate.validate)
