"""Duplicates, nulls, outliers, encodings, scales, grids and gaps on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brisa.operators import cleaning as C, grid
from brisa.plans import adapters as A
from brisa.plans.adapters import rounded, table, text_time
from brisa.plans.registry import query


# ------------------------------------------------------------------ duplicates
@query("CL1", "SELECT user_id, event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY 1, 2")
def duplicates_keep_last(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    out = C.deduplicate(e, ["user_id", "event_type"], ["ts", "event_id"], "last")
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("CL1", "SELECT lang, source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1, 2")
def duplicates_keep_first(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars")
    return C.deduplicate(d, ["lang", "source"], ["doc_id"], "first")


@query("CL1", "SELECT min(doc_id) AS doc_id, md5(text) AS texto FROM documents GROUP BY text HAVING count(*) = 1")
def duplicates_keep_none(spark, sf):
    """Documents whose whole text occurs once."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return C.deduplicate(d, ["text"], ["doc_id"], "none").select("doc_id", F.md5("text").alias("texto"))


@query("CL1", "SELECT count(*) AS linhas, count(DISTINCT text) AS chaves, count(*) - count(DISTINCT text) AS removidas FROM documents")
def duplicates_report(spark, sf):
    return C.duplicate_report(table(spark, sf, "documents"), ["text"])


@query("CL2", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def unique_key_required(spark, sf):
    return C.require_unique(table(spark, sf, "orders"), ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------- nulls
def _holes(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("saldo"),
        F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("nacao"),
        F.when(F.col("c_acctbal") > 500, F.col("c_mktsegment")).alias("segmento"))


HOLES = """b AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS saldo, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS nacao,
  CASE WHEN c_acctbal > 500 THEN c_mktsegment END AS segmento FROM customer)"""


@query("CL3", f"WITH {HOLES}, m AS (SELECT avg(saldo) AS v FROM b) SELECT c_custkey, round(coalesce(saldo, v), 6) AS saldo FROM b, m")
def nulls_mean(spark, sf):
    return rounded(C.fill_nulls(_holes(spark, sf), "media", ["saldo"]).select("c_custkey", "saldo"), 6, "saldo")


@query("CL3", f"WITH {HOLES}, m AS (SELECT quantile_cont(saldo, 0.5) AS v, quantile_cont(nacao::DOUBLE, 0.5) AS w FROM b) SELECT c_custkey, round(coalesce(saldo, v), 6) AS saldo, coalesce(nacao, w) AS nacao FROM b, m")
def nulls_median(spark, sf):
    return rounded(C.fill_nulls(_holes(spark, sf), "mediana", ["saldo", "nacao"]).select("c_custkey", "saldo", "nacao"), 6, "saldo")


@query("CL3", f"""WITH {HOLES}, m AS (SELECT segmento AS s FROM b WHERE segmento IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  k AS (SELECT nacao AS n FROM b WHERE nacao IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  SELECT c_custkey, coalesce(segmento, s) AS segmento, coalesce(nacao, n) AS nacao FROM b, m, k""")
def nulls_mode(spark, sf):
    return C.fill_nulls(_holes(spark, sf), "moda", ["segmento", "nacao"]).select("c_custkey", "segmento", "nacao")


@query("CL3 CL6", f"WITH {HOLES} SELECT c_custkey, coalesce(saldo, -1.0::DOUBLE) AS saldo, saldo IS NULL AS saldo_era_nulo, segmento IS NULL AS segmento_era_nulo FROM b")
def nulls_constant_with_mark(spark, sf):
    df = C.null_indicator(_holes(spark, sf), ["saldo", "segmento"])
    return C.fill_nulls(df, "constante", ["saldo"], -1.0).select("c_custkey", "saldo", "saldo_era_nulo", "segmento_era_nulo")


@query("CL6", f"WITH {HOLES} SELECT c_custkey, nacao FROM b WHERE nacao IS NOT NULL AND segmento IS NOT NULL")
def nulls_dropped_rows(spark, sf):
    return C.drop_null_rows(_holes(spark, sf), ["nacao", "segmento"]).select("c_custkey", "nacao")


@query("CL6", "SELECT c_custkey, c_acctbal AS cheia FROM customer")
def nulls_dropped_columns(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("cheia"),
                                            F.when(F.col("c_nationkey") == 1, F.lit(1)).alias("vazia"))
    return C.drop_null_columns(c, 0.5)


_GRID = f"""WITH {A.HOURLY}, lim AS (SELECT usina_id, min(timestamp_utc) AS a, max(timestamp_utc) AS z FROM horas GROUP BY 1),
  g AS (SELECT usina_id, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS t FROM lim),
  c AS (SELECT g.usina_id, g.t, v, row_number() OVER (PARTITION BY g.usina_id ORDER BY t) AS i FROM g LEFT JOIN horas h ON h.usina_id = g.usina_id AND h.timestamp_utc = t)"""


@query("CL4", f"""{_GRID} SELECT usina_id, CAST(t AS VARCHAR) AS timestamp_utc, round(last_value(v IGNORE NULLS) OVER (PARTITION BY usina_id ORDER BY t), 4) AS energia_mwh FROM c""")
def nulls_forward(spark, sf):
    full = grid.complete_grid(A.hourly(spark, sf), "usina_id", "timestamp_utc").drop("criada")
    return rounded(text_time(C.fill_along(full, ["usina_id"], "timestamp_utc", ["energia_mwh"]), "timestamp_utc"), 4, "energia_mwh")


@query("CL4", f"""{_GRID} SELECT usina_id, CAST(t AS VARCHAR) AS timestamp_utc, round(first_value(v IGNORE NULLS) OVER (PARTITION BY usina_id ORDER BY t
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS energia_mwh FROM c""")
def nulls_backward(spark, sf):
    full = grid.complete_grid(A.hourly(spark, sf), "usina_id", "timestamp_utc").drop("criada")
    return rounded(text_time(C.fill_along(full, ["usina_id"], "timestamp_utc", ["energia_mwh"], backward=True), "timestamp_utc"), 4, "energia_mwh")


@query("CL5", f"""{_GRID}, d AS (SELECT usina_id, t, CASE WHEN hour(t) < 2 THEN NULL ELSE v END AS v, i FROM c),
  w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(v IGNORE NULLS) OVER p AS pv,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni, first_value(v IGNORE NULLS) OVER n AS nv FROM d
  WINDOW p AS (PARTITION BY usina_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY usina_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT usina_id, CAST(t AS VARCHAR) AS timestamp_utc, round(CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
  ELSE pv + (nv - pv) * (i - pi)::DOUBLE / (ni - pi) END, 9) AS energia_mwh FROM w""")
def nulls_interpolated(spark, sf):
    """Every gap on a line, ends with the nearest value."""
    full = grid.complete_grid(A.hourly(spark, sf), "usina_id", "timestamp_utc").drop("criada")
    full = full.withColumn("energia_mwh", F.when(F.hour("timestamp_utc") >= 2, F.col("energia_mwh")))
    return rounded(text_time(C.interpolate_along(full, ["usina_id"], "timestamp_utc", "energia_mwh"), "timestamp_utc"), 9, "energia_mwh")


@query("CL11", f"""WITH {HOLES}, g AS (SELECT segmento, avg(saldo) AS m FROM b GROUP BY 1), t AS (SELECT avg(saldo) AS a FROM b)
  SELECT c_custkey, round(coalesce(saldo, m, a), 6) AS saldo, saldo IS NULL AS saldo_imputado FROM b JOIN g ON b.segmento IS NOT DISTINCT FROM g.segmento, t""")
def nulls_group_mean(spark, sf):
    return rounded(C.group_mean_fill(_holes(spark, sf), "saldo", ["segmento"]).select("c_custkey", "saldo", "saldo_imputado"), 6, "saldo")


# -------------------------------------------------------------------- outliers
def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity")


@query("CL7", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
  SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem, q WHERE l_extendedprice BETWEEN a - 0.4 * (b - a) AND b + 0.4 * (b - a)""")
def outliers_iqr_removed(spark, sf):
    return C.treat_outliers(_lines(spark, sf), ["l_extendedprice"], "iqr", "remover", factor=0.4)


@query("CL7", """WITH q AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)
  SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, round(least(greatest(l_extendedprice, m - 1.5 * s), m + 1.5 * s), 4) AS l_extendedprice FROM lineitem, q""")
def outliers_zscore_clipped(spark, sf):
    return rounded(C.treat_outliers(_lines(spark, sf), ["l_extendedprice"], "zscore", "limitar", z=1.5), 4, "l_extendedprice")


@query("CL7", """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.01, 0.99]) AS p, quantile_cont(l_quantity, [0.01, 0.99]) AS k FROM lineitem)
  SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity, l_extendedprice < p[1] OR l_extendedprice > p[2] OR l_quantity < k[1] OR l_quantity > k[2] AS _outlier FROM lineitem, q""")
def outliers_quantile_marked(spark, sf):
    return C.treat_outliers(_lines(spark, sf), ["l_extendedprice", "l_quantity"], "quantil", "marcar")


# ------------------------------------------------------------------- encodings
@query("CL8", """SELECT c_custkey, c_name, (c_mktsegment = 'BUILDING')::INTEGER AS c_mktsegment_BUILDING, (c_mktsegment = 'FURNITURE')::INTEGER AS c_mktsegment_FURNITURE,
  (c_mktsegment = 'HOUSEHOLD')::INTEGER AS c_mktsegment_HOUSEHOLD, (c_mktsegment = 'MACHINERY')::INTEGER AS c_mktsegment_MACHINERY FROM customer""")
def one_hot_columns(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return C.one_hot(c, ["c_mktsegment", "c_name"], drop_first=True)


@query("CL9", """WITH l AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS k FROM (SELECT DISTINCT p_name FROM part))
  SELECT p_partkey, k AS p_name, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 END AS p_type FROM part JOIN l USING (p_name)""")
def label_and_ordinal(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return C.ordinal_encode(C.label_encode(p, "p_name"), {"p_type": ["SMALL", "MEDIUM", "LARGE"]})


@query("CL9", """WITH f AS (SELECT l_returnflag AS r, count(*) * 1.0 / (SELECT count(*) FROM lineitem) AS s FROM lineitem GROUP BY 1),
  m AS (SELECT l_linestatus AS l, avg(l_quantity) AS a FROM lineitem GROUP BY 1)
  SELECT l_orderkey, l_partkey, l_linenumber, round(s::DOUBLE, 8) AS l_returnflag, round(a, 6) AS l_linestatus FROM lineitem JOIN f ON l_returnflag = r JOIN m ON l_linestatus = l""")
def frequency_and_target(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    li = C.target_encode(C.frequency_encode(li, "l_returnflag"), "l_linestatus", "l_quantity").drop("l_quantity")
    return rounded(rounded(li, 8, "l_returnflag"), 6, "l_linestatus")


# ---------------------------------------------------------------------- scales
@query("CL10", """WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS d, min(l_quantity) AS lo, max(l_quantity) AS hi,
  quantile_cont(l_tax, [0.25, 0.5, 0.75]) AS q FROM lineitem)
  SELECT l_orderkey, l_partkey, l_linenumber, round((l_extendedprice - m) / d, 6) + 0.0 AS padrao, round((l_quantity - lo) / (hi - lo), 6) AS minmax,
  round((l_tax - q[2]) / (q[3] - q[1]), 6) + 0.0 AS robusta, round(ln(l_extendedprice), 6) AS log, round(ln(1 + l_discount), 6) AS log1p FROM lineitem, s""")
def scaled_columns(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").alias("padrao"), F.col("l_quantity").alias("minmax"),
        F.col("l_tax").alias("robusta"), F.col("l_extendedprice").alias("log"), F.col("l_discount").alias("log1p"))
    out = li
    for column, method in (("padrao", "standard"), ("minmax", "minmax"), ("robusta", "robust"), ("log", "log"), ("log1p", "log")):
        out = C.fit_scale(li, [column], method).apply(out)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("padrao", "minmax", "robusta", "log", "log1p")})


_U = "('0x' || substr(md5(concat_ws('|', '42', c_custkey::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0"


@query("CL12", f"""WITH b AS (SELECT c_custkey, c_mktsegment, {_U} AS u FROM customer), n AS (SELECT c_mktsegment, count(*) AS n FROM b GROUP BY 1),
  r AS (SELECT b.*, n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY u) AS i, (SELECT max(n) FROM n) AS m FROM b JOIN n USING (c_mktsegment))
  SELECT c_custkey, c_mktsegment, unnest(range(1, (m // n + (i <= m % n)::INTEGER + 1)::BIGINT))::BIGINT AS copia FROM r""")
def classes_oversampled(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return C.balance(c, "c_mktsegment", ["c_custkey"], "oversample").withColumn("copia", F.col("copia").cast("long"))


@query("CL12", f"""WITH b AS (SELECT c_custkey, c_mktsegment, {_U} AS u FROM customer), n AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM b GROUP BY c_mktsegment))
  SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY u) AS i FROM b), n WHERE i <= m""")
def classes_undersampled(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return C.balance(c, "c_mktsegment", ["c_custkey"], "undersample").drop("copia")


# ---------------------------------------------------------------- grid and gaps
@query("TS1", f"""{_GRID}, e AS (SELECT c.usina_id, t, v, CASE WHEN v IS NULL THEN NULL WHEN v > 50 THEN 'alta' ELSE 'baixa' END AS classe FROM c)
  SELECT usina_id, CAST(t AS VARCHAR) AS timestamp_utc, round(v, 4) AS energia_mwh, v IS NULL AS criada,
  last_value(classe IGNORE NULLS) OVER (PARTITION BY usina_id ORDER BY t) AS classe FROM e""")
def complete_hourly_grid(spark, sf):
    h = A.hourly(spark, sf).withColumn("classe", F.when(F.col("energia_mwh") > 50, "alta").otherwise("baixa"))
    out = grid.complete_grid(h, "usina_id", "timestamp_utc", ["classe"])
    return rounded(text_time(out, "timestamp_utc"), 4, "energia_mwh")


@query("TS2 FN19", f"""WITH {A.CLEAN} SELECT usina_id, CAST(timestamp_utc AS VARCHAR) AS timestamp_utc, round(energia_mwh, 4) AS energia_mwh, flag_qualidade FROM limpa""")
def short_gaps_filled(spark, sf):
    df = A.clean_hourly(spark, sf).select("usina_id", "timestamp_utc", "energia_mwh", "flag_qualidade")
    return rounded(text_time(df, "timestamp_utc"), 4, "energia_mwh")


@query("WN3", f"""{_GRID}, s AS (SELECT *, count(v) OVER (PARTITION BY usina_id ORDER BY t) AS sequencia FROM c)
  SELECT usina_id, CAST(t AS VARCHAR) AS timestamp_utc, sequencia, (CASE WHEN v IS NULL THEN sum((v IS NULL)::INTEGER) OVER (PARTITION BY usina_id, sequencia) ELSE 0 END)::BIGINT AS tamanho_gap FROM s""")
def gap_numbers(spark, sf):
    full = grid.complete_grid(A.hourly(spark, sf), "usina_id", "timestamp_utc").drop("criada")
    out = grid.gap_groups(full, "usina_id", "timestamp_utc", "energia_mwh")
    return text_time(out.select("usina_id", "timestamp_utc", F.col("sequencia").cast("long").alias("sequencia"),
                                F.col("tamanho_gap").cast("long").alias("tamanho_gap")), "timestamp_utc")


@query("TS3", """SELECT user_id::VARCHAR AS unidade, arg_max(event_type, struct_pack(a := ts, b := event_type)) AS nome_canonico, count(DISTINCT event_type) AS n_nomes FROM events GROUP BY 1""")
def canonical_names(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("unidade"), "event_type", "ts")
    latest, report = grid.canonical_name(e, "unidade", "event_type", "ts")
    return latest.join(report, "unidade", "left").select("unidade", "nome_canonico", F.coalesce("n_nomes", F.lit(1)).cast("long").alias("n_nomes"))


@query("TS4", f"""WITH bruto AS (SELECT date_trunc('hour', ts) AS t, user_id, max(event_type) AS tipo, sum(value) - 20 AS v FROM events GROUP BY ALL),
  horas AS (SELECT user_id AS usina_id, t AS timestamp_utc, greatest(v, 0.0) AS v, v < 0 AS neg FROM bruto),
  {A.gaps_sql('horas')}
  SELECT l.usina_id::VARCHAR AS chave_unidade, CAST(l.timestamp_utc + INTERVAL 3 HOUR AS VARCHAR) AS data_hora_utc, round(energia_mwh, 4) AS geracao_mwh,
  CASE WHEN neg THEN 'negativo_zerado' ELSE flag_qualidade END AS flag_qualidade, 'user ' || l.usina_id AS nome_usina_normalizado
  FROM limpa l LEFT JOIN horas h ON l.usina_id = h.usina_id AND l.timestamp_utc = h.timestamp_utc""")
def clean_generation_end_to_end(spark, sf):
    """The whole hourly clean over the events: negatives, names, grid, gaps, UTC."""
    from brisa.plans.layers import clean_generation
    e = table(spark, sf, "events").groupBy(A.hour_of("ts").alias("din_instante"), "user_id").agg((F.sum("value") - 20).alias("val_geracao"))
    uid = F.col("user_id").cast("string")
    raw = e.select(
        "din_instante", F.lit("NE").alias("id_subsistema"), F.lit("BA ").alias("id_estado"),
        F.when(F.dayofmonth("din_instante") > 15, F.concat(F.lit("TIPO"), F.lit(" I"))).otherwise("TIPO I").alias("cod_modalidadeoperacao"),
        F.lit("EOLIELÉTRICA").alias("nom_tipousina"), F.lit("-").alias("nom_tipocombustivel"),
        F.concat(F.lit(" User-  "), uid).alias("nom_usina"), F.concat(uid, F.lit(" ")).alias("id_ons"), F.lit("-").alias("ceg"),
        "val_geracao", F.lit("f").alias("arquivo_origem"))
    out = clean_generation(raw).select("chave_unidade", F.col("data_hora_utc").cast("string").alias("data_hora_utc"),
                                       "geracao_mwh", "flag_qualidade", "nome_usina_normalizado")
    return rounded(out, 4, "geracao_mwh")


def _climate_sql(gap):
    return f"""WITH d AS (SELECT l_suppkey AS usina_id, (DATE '2024-01-01' + (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) % 61)::INTEGER)::DATE AS timestamp_utc,
    avg(l_quantity) AS w, count(*) AS n FROM lineitem GROUP BY ALL),
  f AS (SELECT usina_id, timestamp_utc, CASE WHEN w > 28 THEN NULL ELSE w END AS v FROM d),
  {A.gaps_sql('f', step='DAY', kind='DATE', limit=gap)}
  SELECT usina_id::VARCHAR AS local, CAST(timestamp_utc AS VARCHAR) AS data, round(energia_mwh, 4) AS vento_10m_ms, flag_qualidade,
  CASE WHEN energia_mwh IS NULL THEN 'vento_10m_ms' END AS medidas_faltantes FROM limpa"""


@query("TS6", _climate_sql(1))
def clean_daily_climate_end_to_end(spark, sf):
    from brisa.plans.layers import clean_daily_climate
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")), F.lit(61)).cast("int"))
    d = table(spark, sf, "lineitem").groupBy("l_suppkey", day.alias("d")).agg(F.avg("l_quantity").alias("w"))
    wind = F.when(F.col("w") > 28, -999.0).otherwise(F.col("w"))
    raw = d.select(F.col("l_suppkey").cast("string").alias("local"), F.lit("m").alias("municipio"), F.lit("BA").alias("id_estado"),
                   F.lit("NE").alias("id_subsistema"), F.lit(-10.0).alias("latitude"), F.lit(-40.0).alias("longitude"),
                   F.date_format("d", "yyyyMMdd").alias("data_lst"), wind.alias("WS10M"),
                   *[F.lit(1.0).alias(c) for c in ("ALLSKY_SFC_SW_DWN", "WS50M", "T2M", "T2M_MAX", "T2M_MIN")])
    # the constant measures are null on days the grid adds; they are judged apart
    df = clean_daily_climate(raw)
    missing = F.when(F.col("vento_10m_ms").isNull(), "vento_10m_ms")
    flag = (F.when(F.col("vento_10m_ms").isNull(), "faltante")
            .when(F.col("flag_qualidade") == "faltante", "interpolado").otherwise(F.col("flag_qualidade")))
    out = df.select("local", F.col("data").cast("string").alias("data"), "vento_10m_ms", flag.alias("flag_qualidade"), missing.alias("medidas_faltantes"))
    return rounded(out, 4, "vento_10m_ms")


@query("TS5", f"""WITH {A.CLEAN} SELECT usina_id::VARCHAR AS local, CAST(timestamp_utc AS VARCHAR) AS data_hora_utc, CAST(timestamp_utc - INTERVAL 3 HOUR AS VARCHAR) AS data_hora_brasilia,
  round(energia_mwh, 4) AS temperatura_2m_c, flag_qualidade, CASE WHEN energia_mwh IS NULL THEN 'irradiancia_wh_m2,vento_10m_ms,vento_50m_ms,temperatura_2m_c' END AS medidas_faltantes FROM limpa""")
def clean_hourly_climate_end_to_end(spark, sf):
    from brisa.plans.layers import clean_hourly_climate
    h = A.hourly(spark, sf)
    raw = h.select(F.col("usina_id").cast("string").alias("local"), F.lit("m").alias("municipio"), F.lit("BA").alias("id_estado"),
                   F.lit("NE").alias("id_subsistema"), F.lit(-10.0).alias("latitude"), F.lit(-40.0).alias("longitude"),
                   F.date_format("timestamp_utc", "yyyyMMddHH").alias("data_hora_utc"),
                   *[F.col("energia_mwh").alias(c) for c in ("ALLSKY_SFC_SW_DWN", "WS10M", "WS50M", "T2M")])
    df = clean_hourly_climate(raw)
    out = df.select("local", "data_hora_utc", "data_hora_brasilia", "temperatura_2m_c", "flag_qualidade", "medidas_faltantes")
    return rounded(text_time(out, "data_hora_utc", "data_hora_brasilia"), 4, "temperatura_2m_c")


@query("TS7", f"""SELECT c_name AS ceg, lower(replace(c_name, '#', '')) AS nome_normalizado, round(greatest(c_acctbal, 0) / 1000, 6) AS potencia_outorgada_mw,
  CASE WHEN c_nationkey = 0 THEN NULL ELSE -10.0 - c_nationkey / 100.0 END::DOUBLE AS latitude, CASE WHEN c_nationkey = 0 THEN 'zerada' END AS flag_coordenada,
  CASE WHEN c_nationkey = 1 THEN NULL ELSE '2015-03-01' END AS data_entrada_operacao, CASE WHEN c_nationkey = 1 THEN 'sentinela_1900' END AS flag_data_operacao,
  CASE WHEN c_nationkey = 2 THEN NULL ELSE 'Caetité' END AS municipio, CASE WHEN c_nationkey = 2 THEN NULL ELSE 'BA' END AS uf_municipio,
  CASE WHEN c_nationkey = 2 THEN NULL ELSE 'caetite' END AS municipio_normalizado, 'eolica' AS fonte, 'NE' AS id_subsistema FROM customer""")
def clean_registry_end_to_end(spark, sf):
    from brisa.plans.layers import clean_registry
    c, n = table(spark, sf, "customer"), F.col("c_nationkey")
    br = lambda x: F.translate(F.format_string("%,.2f", x), ",.", ".,")
    raw = c.select(
        F.col("c_custkey").cast("int").alias("_id"), F.lit("2026-07-04").alias("DatGeracaoConjuntoDados"), F.col("c_name").alias("NomEmpreendimento"),
        F.lit("1").alias("IdeNucleoCEG"), F.concat(F.lit(" "), "c_name").alias("CodCEG"), F.lit("BA").alias("SigUFPrincipal"), F.lit("EOL").alias("SigTipoGeracao"),
        F.lit("Operação").alias("DscFaseUsina"), F.lit("o").alias("DscOrigemCombustivel"), F.lit("f").alias("DscFonteCombustivel"),
        F.lit("R").alias("DscTipoOutorga"), F.lit("n").alias("NomFonteCombustivel"),
        F.when(n == 1, "1900-01-03").otherwise("2015-03-01").alias("DatEntradaOperacao"), br(F.greatest("c_acctbal", F.lit(0.0))).alias("MdaPotenciaOutorgadaKw"),
        F.lit("1,00").alias("MdaPotenciaFiscalizadaKw"), F.lit("0,00").alias("MdaGarantiaFisicaKw"), F.lit("Não").alias("IdcGeracaoQualificada"),
        F.when(n == 0, "0").otherwise(br(-10.0 - n / 100)).alias("NumCoordNEmpreendimento"), F.when(n == 0, "0").otherwise("-41,10").alias("NumCoordEEmpreendimento"),
        F.lit("2015-01-01").alias("DatInicioVigencia"), F.lit("2045-01-01").alias("DatFimVigencia"), F.lit("p").alias("DscPropriRegimePariticipacao"),
        F.lit("").alias("DscSubBacia"), F.when(n == 2, "Não Informado").otherwise("Caetité - BA, Igaporã - BA").alias("DscMuninicpios"))
    out = clean_registry(raw).select("ceg", "nome_normalizado", "potencia_outorgada_mw", "latitude", "flag_coordenada",
                                     F.col("data_entrada_operacao").cast("string").alias("data_entrada_operacao"), "flag_data_operacao",
                                     "municipio", "uf_municipio", "municipio_normalizado", "fonte", "id_subsistema")
    return rounded(out, 6, "potencia_outorgada_mw", "latitude")


@query("TS8 FN29", """SELECT o_orderkey::VARCHAR AS ceg, greatest(round_even(t * 365.25, 0), 1)::BIGINT AS tempo_dias, e::BIGINT AS evento, true AS simulado FROM (
  SELECT o_orderkey, greatest(max(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)), 1) / 365.25 AS t, max((l_returnflag = 'R')::INTEGER) AS e
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""")
def clean_events_end_to_end(spark, sf):
    from brisa.plans.layers import clean_events
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    base = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("o_orderkey").agg(
        (F.greatest(F.max(F.datediff("l_shipdate", "o_orderdate")), F.lit(1)) / 365.25).alias("tempo_anos"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("evento"),
        F.max(F.to_date("l_shipdate")).alias("ultimo"))
    raw = base.select(F.col("o_orderkey").cast("string").alias("ceg"), "tempo_anos", "evento",
                      F.when(F.col("evento") == 1, F.col("ultimo")).alias("data_evento"), F.lit("2002-01-01").cast("date").alias("data_corte"))
    return clean_events(raw).select("ceg", "tempo_dias", "evento", "simulado")


@query("TS9", """WITH d AS (SELECT event_type, user_id % 50 AS grupo, ts::DATE AS periodo, sum(value) AS valor FROM events GROUP BY ALL),
  g AS (SELECT event_type, grupo, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS periodo
    FROM (SELECT event_type, grupo, min(periodo)::TIMESTAMP AS a, max(periodo)::TIMESTAMP AS z FROM d GROUP BY ALL))
  SELECT event_type, grupo, CAST(periodo AS VARCHAR) AS periodo, round(valor, 4) AS valor,
  round(avg(valor) OVER (PARTITION BY event_type, grupo ORDER BY periodo ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS media_movel
  FROM g LEFT JOIN d USING (event_type, grupo, periodo)""")
def resampled_daily(spark, sf):
    """All events, by type and group of users, on every day from the first to the last of the group."""
    e = table(spark, sf, "events").withColumn("grupo", F.expr("user_id % 50"))
    out = grid.resample(e, "ts", "value", "D", F.sum("value"), 7, by=["event_type", "grupo"])
    return rounded(text_time(out, "periodo"), 4, "valor", "media_movel")


@query("TS9", "SELECT CAST(date_trunc('quarter', o_orderdate)::DATE AS VARCHAR) AS periodo, round(quantile_cont(o_totalprice, 0.5), 4) AS valor FROM orders GROUP BY 1")
def resampled_quarterly_median(spark, sf):
    from brisa.operators import ordered
    o = table(spark, sf, "orders").withColumn("periodo", F.trunc("o_orderdate", "quarter").cast("string"))
    return rounded(ordered.quantiles_wide(o, "o_totalprice", {"valor": 0.5}, ["periodo"]), 4, "valor")


