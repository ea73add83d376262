"""Fixed values of the domain: maps, limits and words that decide results."""

# Zone of the source clock and the limits of each rule.
LOCAL_ZONE = "America/Sao_Paulo"
MAX_GAP_HOURS = 3
MAX_GAP_DAYS = 1
FILL_VALUE = -999.0
MIN_LINK_POWER_MW = 1.0
MIN_CORE_LENGTH = 4
PEAK_RATIO_RANGE = (0.40, 1.15)
MAX_CLIMATE_KM = 300.0
MAX_WINDOW_DAYS = 120
SENTINEL_DATE = "1900-01-03"
EARLIEST_DATE = "1990-01-01"
LATITUDE_RANGE = (-34.0, 5.5)
LONGITUDE_RANGE = (-74.0, -34.0)
EARTH_RADIUS_KM = 6371.0

# Codes of the generation source.
SOURCE_BY_PLANT_TYPE = {
    "FOTOVOLTAICA": "solar",
    "EOLIELÉTRICA": "eolica",
    "HIDROELÉTRICA": "hidraulica",
    "TÉRMICA": "termica",
    "NUCLEAR": "nuclear",
}
SOURCE_BY_REGISTRY_CODE = {"UFV": "solar", "EOL": "eolica"}
CURATED_SOURCES = ("solar", "eolica")
UNIT_KIND_BY_MODALITY = {
    "Conjunto de Usinas": "conjunto",
    "Pequenas Usinas (MMGD)": "pequenas_usinas",
    "Pequenas Usinas (Tipo III)": "pequenas_usinas",
}

# States of each grid subsystem.
STATES_BY_SUBSYSTEM = {
    "N": ("AM", "PA", "AP", "RR", "TO", "MA"),
    "NE": ("BA", "RN", "PI", "CE", "PE", "PB", "SE", "AL"),
    "SE": ("MG", "SP", "RJ", "ES", "GO", "DF", "MT", "MS", "RO", "AC"),
    "S": ("RS", "SC", "PR"),
}
SUBSYSTEM_BY_STATE = {uf: sub for sub, ufs in STATES_BY_SUBSYSTEM.items() for uf in ufs}

# Words that carry no identity in the name of a set of plants.
GENERIC_SET_WORDS = (
    "conjunto", "complexo", "cj", "eolico", "eolica", "eolicas", "fotovoltaico",
    "fotovoltaica", "fotovoltaicas", "solar", "ufv", "eol", "usina", "usinas",
)

# Published registry column -> name used here.
REGISTRY_COLUMNS = {
    "datgeracaoconjuntodados": "data_retrato",
    "nomempreendimento": "nome",
    "idenucleoceg": "nucleo_ceg",
    "codceg": "ceg",
    "sigufprincipal": "id_estado",
    "sigtipogeracao": "sig_tipo_geracao",
    "dscfaseusina": "fase",
    "dscorigemcombustivel": "origem_combustivel",
    "dscfontecombustivel": "fonte_combustivel",
    "dsctipooutorga": "tipo_outorga",
    "datentradaoperacao": "data_entrada_operacao",
    "mdapotenciaoutorgadakw": "potencia_outorgada_kw",
    "mdapotenciafiscalizadakw": "potencia_fiscalizada_kw",
    "mdagarantiafisicakw": "garantia_fisica_kw",
    "idcgeracaoqualificada": "geracao_qualificada",
    "numcoordnempreendimento": "latitude",
    "numcoordeempreendimento": "longitude",
    "datiniciovigencia": "inicio_vigencia",
    "datfimvigencia": "fim_vigencia",
    "dscmuninicpios": "municipios",
}
REGISTRY_DROPPED = ("_id", "nomfontecombustivel", "dscpropriregimepariticipacao", "dscsubbacia")

# Published climate parameter -> name used here.
HOURLY_CLIMATE = {
    "ALLSKY_SFC_SW_DWN": "irradiancia_wh_m2",
    "WS10M": "vento_10m_ms",
    "WS50M": "vento_50m_ms",
    "T2M": "temperatura_2m_c",
}
DAILY_CLIMATE = {
    "ALLSKY_SFC_SW_DWN": "irradiancia_kwh_m2_dia",
    "WS10M": "vento_10m_ms",
    "WS50M": "vento_50m_ms",
    "T2M": "temperatura_2m_c",
    "T2M_MAX": "temperatura_max_c",
    "T2M_MIN": "temperatura_min_c",
}

# Forecasting set-up.
HORIZON_H = 24
BACKTEST_WINDOWS = 6
MIN_TRAIN_H = 720
LAGS_H = (24, 25, 26, 48, 72, 168)
ROLLING_H = (24, 72, 168)
MAPE_FLOOR = 0.05

# Survival set-up.
REFERENCE_POWER_MW = 30.0
REFERENCE_YEAR = 2018
MODEL_COVARIATES = ("log_potencia_mw_c", "subsistema_NE", "subsistema_S",
                    "subsistema_N", "ano_entrada_c")
HORIZON_MONTHS = (6, 12, 24, 36)
MIN_AT_RISK = 20
MAX_EPISODE_STRATUM = 6
OLD_COHORT_YEARS = 15.0
LATENCY_BUCKETS_MS = (5, 10, 25, 50, 100, 250, 500, 1000)
DAYS_PER_UNIT = {"dias": 1.0, "semanas": 7.0, "meses": 30.44, "anos": 365.25}
DAYS_PER_YEAR = 365.25
