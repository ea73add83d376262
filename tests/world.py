"""A small world to check by hand: six units, eight plants, three sites. The faults are planted
here and named beside the rows that hold them."""

from datetime import date, datetime, timedelta

START = datetime(2025, 3, 10)
HOURS = 96
CUT = date(2025, 3, 20)

GENERATION = ("din_instante timestamp_ntz, id_subsistema string, nom_subsistema string, id_estado string, nom_estado string, "
              "cod_modalidadeoperacao string, nom_tipousina string, nom_tipocombustivel string, nom_usina string, id_ons string, "
              "ceg string, val_geracao double, arquivo_origem string")

UNITS = [  # id, code, name, modality, type, state, subsystem, top
    ("PITAB", "UFV.RS.PI.037711-4.01", "UFV MONTE TABOR 3", "TIPO I", "FOTOVOLTAICA", "PI", "NE", 16.0),
    ("CEGRL", "-", "CONJUNTO EOLICO GRAVATA DO LESTE 500 KV", "Conjunto de Usinas", "EOLIELÉTRICA", "CE", "NE", 56.0),
    ("PEPED", "-", "CJ EOLICO PEDRA RACHADA", "Conjunto de Usinas", "EOLIELÉTRICA", "PE", "NE", 24.0),
    ("PEAGU", "-", "CONJUNTO SOLAR AGUA FINA", "Conjunto de Usinas", "FOTOVOLTAICA", "PE", "NE", 9.0),
    (None, "-", "PQU SERRA GAUCHA", "Pequenas Usinas (Tipo III)", "EOLIELÉTRICA", "RS", "S", 0.5),
    ("TORIO", "UTE.GN.TO.027045-9.01", "RIO TORTO", "TIPO II-A", "TÉRMICA", "TO", "N", 90.0),
]
LATE_FILE = 60          # hours from here on come in a second file


def shape(hour):
    """Share of the top in an hour: a ramp of seven steps."""
    return (hour * 3 % 7 + 1) / 7


def generation(spark):
    """Rows in the order of the files; no column says which of two rows is newer."""
    first, second = [], []
    for uid, code, name, modality, kind, state, sub, top in UNITS:
        for h in range(HOURS):
            value, shown = round(top * shape(h), 4), name
            if uid == "PITAB" and h in (33, 34):
                continue                                            # two hours without a row
            if uid == "PITAB" and h == 71:
                value = -0.25                                       # below zero
            if uid == "CEGRL" and 40 <= h <= 47:
                value = None                                        # eight hours without a value
            if uid == "PEPED" and h < 30:
                shown = "  CJ  PDR ANTIGO"                           # another name at first
            row = lambda v: (START + timedelta(hours=h), sub, "s", state, "e", modality, kind, "c", shown, uid, code, v,  # noqa: B023, E731
                             "b" if h >= LATE_FILE else "a")  # noqa: B023
            rows = second if h >= LATE_FILE else first
            if uid == "PEAGU" and h in (12, 80):
                rows.append(row(77.0))                              # a stale row, larger than the good one after it
            rows.append(row(value))
            if uid == "TORIO" and h == 5:
                rows[-1:] = [row(1.0), row(value)]                  # a stale row, smaller
    return spark.createDataFrame(first + second, GENERATION)


PLANTS = [  # code, name, kind, state, phase, kW, latitude, longitude, start, towns
    ("EOL.CV.CE.031202-5.1", "Gravatá do Leste B", "EOL", "CE", "Operação", "38.400,00", "-3,80", "-40,50", "2016-02-05", "Itarema - CE, Acaraú - CE"),
    ("EOL.CV.CE.031201-7.1", "Gravatá do Leste A", "EOL", "CE", "Operação", "41.600,00", "-3,40", "-40,10", "2014-11-20", "Acaraú - CE"),
    ("EOL.CV.CE.031205-9.1", "Gravatá do Leste C", "EOL", "CE", "Operação", "20.000,00", "-3,60", "-40,30", "2017-12-01", "Acaraú - CE"),
    ("EOL.CV.CE.031207-1.1", "Gravatá do Leste D", "EOL", "CE", "Construção não iniciada", "38.400,00", "-3,90", "-40,60", "1900-01-03", "Acaraú - CE"),
    ("UFV.RS.PI.037711-4.1", "Monte Tabor 3", "UFV", "PI", "Operação", "18.250,50", "-8,25", "-43,75", "2020-09-15", "Dom Inocêncio - PI"),
    ("EOL.CV.PE.029988-1.1", "Pedra Rachada I", "EOL", "PE", "Operação", "12.000,00", "-8,60", "-37,20", "2018-04-30", "Buíque - PE"),
    ("UFV.RS.PE.044100-2.1", "Agua Fina 1", "UFV", "PE", "Operação", "900,00", "-8,70", "-37,30", "2022-06-11", "Buíque - PE"),
    ("UFV.RS.GO.040404-6.1", "Cerrado Aberto", "UFV", "GO", "Operação", "7.000,00", "12,5", "-48,1", "1987-05-02", "Não Informado"),
]


def registry(spark, day="2025-03-21"):
    names = ["_id", "DatGeracaoConjuntoDados", "NomEmpreendimento", "IdeNucleoCEG", "CodCEG", "SigUFPrincipal",
             "SigTipoGeracao", "DscFaseUsina", "DscOrigemCombustivel", "DscFonteCombustivel", "DscTipoOutorga",
             "NomFonteCombustivel", "DatEntradaOperacao", "MdaPotenciaOutorgadaKw", "MdaPotenciaFiscalizadaKw",
             "MdaGarantiaFisicaKw", "IdcGeracaoQualificada", "NumCoordNEmpreendimento", "NumCoordEEmpreendimento",
             "DatInicioVigencia", "DatFimVigencia", "DscPropriRegimePariticipacao", "DscSubBacia", "DscMuninicpios"]
    rows = [(i, day, name, "9", code, state, kind, phase, "origem", "fonte", "Autorização", "nome", start, kw, "0,00", "1.500,00", "Sim",
             lat, lon, "2012-08-01", "2042-08-01", "dono", "bacia", towns)
            for i, (code, name, kind, state, phase, kw, lat, lon, start, towns) in enumerate(PLANTS, 100)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'int' if n == '_id' else 'string'}" for n in names))


SITES = [("inocencio_pi", "Dom Inocêncio", "PI", "NE", -8.0, -42.0), ("buique_pe", "Buíque", "PE", "NE", -8.65, -37.15),
         ("acarau_ce", "Acaraú", "CE", "NE", -3.0, -40.0)]


def daily_climate(spark):
    """Nine days; the first site has no row on the fourth, the second no irradiance on the last."""
    rows = []
    for k, site in enumerate(SITES):
        for d in range(9):
            if k == 0 and d == 3:
                continue
            day = (START + timedelta(days=d)).strftime("%Y%m%d")
            light = -999.0 if k == 1 and d == 8 else 4.0 + k / 2 + d * d / 20
            rows.append((*site, day, light, 2.5 + d / 4, 7.0 - d / 8, 24.0 + k, 33.0 + k, 18.0 + d))
    return spark.createDataFrame(rows, "local string, municipio string, id_estado string, id_subsistema string, "
                                 "latitude double, longitude double, data_lst string, ALLSKY_SFC_SW_DWN double, "
                                 "WS10M double, WS50M double, T2M double, T2M_MAX double, T2M_MIN double")


def hourly_climate(spark):
    """Thirty hours; wind at 50 m lacks hours 11 to 13, at 10 m hours 3 to 8."""
    rows = []
    for site in SITES:
        for h in range(30):
            when = (START + timedelta(hours=h)).strftime("%Y%m%d%H")
            rows.append((*site, when, 100.0 + h, -999.0 if 3 <= h <= 8 else 4.0, -999.0 if 11 <= h <= 13 else 2.0 * h, 21.5))
    return spark.createDataFrame(rows, "local string, municipio string, id_estado string, id_subsistema string, "
                                 "latitude double, longitude double, data_hora_utc string, ALLSKY_SFC_SW_DWN double, "
                                 "WS10M double, WS50M double, T2M double")


def maintenance(spark):
    rows = [(31, "EOL.CV.CE.031205-9.1", date(2017, 12, 1), CUT, 2.5, 1, date(2020, 6, 1), "pá"),
            (32, "UFV.RS.PI.037711-4.1", date(2020, 9, 15), CUT, 4.51, 0, None, None),
            (33, "EOL.CV.CE.031201-7.1", date(2014, 11, 20), CUT, 7.0, 1, date(2021, 11, 20), "gerador"),
            (34, "EOL.CV.CE.031207-1.1", date(2019, 1, 1), CUT, 1.0, 1, date(2020, 1, 1), "pá"),
            (35, "EOL.CV.PE.029988-1.1", date(2018, 4, 30), CUT, 6.89, 0, None, None)]
    return spark.createDataFrame(rows, "id_usina int, ceg string, data_entrada_operacao date, data_corte date, "
                                 "tempo_anos double, evento int, data_evento date, tipo_evento string")
