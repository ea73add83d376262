"""Star schema: columns, types, keys and accepted ranges of each table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

L, I, D, S, B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
DATE, TS = T.DateType(), T.TimestampNTZType()


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...]
    columns: tuple[tuple[str, T.DataType, bool], ...]
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, not required) for n, t, required in self.columns])

    @property
    def required(self) -> list[str]:
        return [n for n, _, required in self.columns if required]


DIM_USINA = Table("dim_usina", ("usina_id",), (
    ("usina_id", L, True), ("chave_unidade", S, True), ("id_ons", S, False), ("ceg_ons", S, False),
    ("nome", S, True), ("nome_normalizado", S, False), ("fonte", S, True), ("tipo_unidade", S, True),
    ("modalidade_ons", S, False), ("regiao", S, True), ("id_estado", S, False), ("municipio", S, False),
    ("potencia_mw", D, False), ("lat", D, False), ("lon", D, False), ("data_operacao", DATE, False),
    ("n_usinas_aneel", I, True), ("metodo_vinculo", S, True), ("qualidade_vinculo", S, True),
    ("potencia_aneel_vinculada_mw", D, False), ("pico_geracao_mw", D, False),
    ("razao_pico_potencia", D, False), ("primeira_medicao_utc", TS, False), ("ultima_medicao_utc", TS, False),
), ranges={"potencia_mw": (0, None), "lat": (-34, 5.5), "lon": (-74, -34)})

FATO_GERACAO = Table("fato_geracao", ("usina_id", "timestamp_utc"), (
    ("usina_id", L, True), ("timestamp_utc", TS, True), ("energia_mwh", D, False), ("fonte", S, True),
    ("regiao", S, True), ("flag_qualidade", S, True),
), {"usina_id": ("dim_usina", "usina_id")}, {"energia_mwh": (0, None)})

FATO_CLIMA = Table("fato_clima", ("usina_id", "data"), (
    ("usina_id", L, True), ("data", DATE, True), ("irradiancia_kwh_m2", D, False), ("vento_ms", D, False),
    ("vento_10m_ms", D, False), ("temperatura_c", D, False), ("temperatura_max_c", D, False),
    ("temperatura_min_c", D, False), ("flag_qualidade", S, True), ("medidas_faltantes", S, False),
    ("local_clima", S, True), ("distancia_km", D, False), ("metodo_vinculo_clima", S, True),
), {"usina_id": ("dim_usina", "usina_id")},
    {"irradiancia_kwh_m2": (0, 12), "vento_ms": (0, 60), "temperatura_c": (-10, 50)})

FATO_MANUTENCAO = Table("fato_manutencao", ("usina_id",), (
    ("usina_id", L, True), ("tempo_dias", I, True), ("evento_ocorreu", B, True),
    ("data_primeiro_evento", DATE, False), ("tipo_evento", S, False),
    ("n_usinas_consideradas", I, True), ("simulado", B, True),
), {"usina_id": ("dim_usina", "usina_id")}, {"tempo_dias": (1, None)})

PONTE = Table("ponte_usina_aneel", ("ceg_aneel",), (
    ("ceg_aneel", S, True), ("usina_id", L, True), ("chave_unidade", S, True), ("metodo_vinculo", S, True),
    ("nucleo_usado", S, False), ("potencia_outorgada_mw", D, False), ("municipio", S, False),
    ("data_entrada_operacao", DATE, False),
), {"usina_id": ("dim_usina", "usina_id")})

STAR = {t.name: t for t in (DIM_USINA, FATO_GERACAO, FATO_CLIMA, FATO_MANUTENCAO, PONTE)}


def typed(df: DataFrame, table: Table) -> DataFrame:
    """Every declared column, cast to its type, in the declared order."""
    return df.select(*[F.col(n).cast(t).alias(n) for n, t, _ in table.columns])
