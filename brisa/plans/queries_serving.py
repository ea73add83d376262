"""Roll-ups, series, pages, shares and totals on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brisa.operators import serving as S
from brisa.plans import adapters as A
from brisa.plans.adapters import rounded, table, text_time
from brisa.plans.registry import query

DAY = "CAST(timestamp_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/Sao_Paulo' AS DATE)"


@query("AG7", f"""WITH {A.FACT} SELECT usina_id, CAST({DAY} AS VARCHAR) AS dia, round(sum(energia_mwh), 4) AS energia_mwh,
  count(*) FILTER (WHERE flag_qualidade <> 'faltante') AS horas_validas FROM fato GROUP BY usina_id, {DAY}""")
def daily_generation(spark, sf):
    return rounded(text_time(S.daily_generation(A.fact(spark, sf)), "dia"), 4, "energia_mwh")


@query("AG8", f"""WITH {A.FACT} SELECT CAST(timestamp_utc AS VARCHAR) AS timestamp_utc, fonte, regiao, round(sum(energia_mwh), 4) AS energia_mwh, count(DISTINCT usina_id) AS usinas
  FROM fato GROUP BY ALL""")
def national_hourly(spark, sf):
    return rounded(text_time(S.national_hourly(A.fact(spark, sf)), "timestamp_utc"), 4, "energia_mwh")


_RCLIMATE = f"""{A.CLIMATE}, rclima AS (SELECT r_regionkey::BIGINT AS usina_id, data, avg(irradiancia_kwh_m2) AS irradiancia_kwh_m2, avg(vento_ms) AS vento_ms, avg(temperatura_c) AS temperatura_c
  FROM clima JOIN region ON id_subsistema = r_name GROUP BY ALL)"""


def _regional_climate(spark, sf):
    c = A.daily_climate(spark, sf).join(F.broadcast(table(spark, sf, "region")), F.col("id_subsistema") == F.col("r_name"))
    return c.groupBy(F.col("r_regionkey").cast("long").alias("usina_id"), "data").agg(
        *[F.avg(x).alias(x) for x in ("irradiancia_kwh_m2", "vento_ms", "temperatura_c")])


@query("AG9 JN12", f"""WITH {A.REGIONAL}, {_RCLIMATE}, d AS (SELECT usina_id, {DAY} AS dia, sum(energia_mwh) AS e, count(*) FILTER (WHERE flag_qualidade <> 'faltante') AS h FROM rfato GROUP BY usina_id, {DAY})
  SELECT d.usina_id, CAST(dia AS VARCHAR) AS dia, fonte, regiao, round(e, 4) AS energia_mwh, round(potencia_mw, 6) AS potencia_mw, round(e / (potencia_mw * 24), 6) AS fator_capacidade,
  round(irradiancia_kwh_m2, 6) AS irradiancia_kwh_m2, round(vento_ms, 6) AS vento_ms, round(temperatura_c, 6) AS temperatura_c
  FROM d JOIN rdim USING (usina_id) LEFT JOIN rclima c ON c.usina_id = d.usina_id AND c.data = dia WHERE h = 24 AND potencia_mw IS NOT NULL""")
def daily_capacity_factor(spark, sf):
    out = S.capacity_factor(A.regional_fact(spark, sf), A.regional_dim(spark, sf), _regional_climate(spark, sf))
    return rounded(rounded(text_time(out, "dia"), 4, "energia_mwh"), 6, "potencia_mw", "fator_capacidade", "irradiancia_kwh_m2", "vento_ms", "temperatura_c")


_ROLL = f"""WITH {A.FACT} SELECT CAST({{p}} AS VARCHAR) AS periodo, fonte, round(sum(energia_mwh), 4) AS energia_mwh, count(DISTINCT usina_id) AS usinas FROM fato {{w}} GROUP BY {{p}}, fonte"""


@query("AG10", _ROLL.format(p=DAY, w=""))
def national_rollup_by_day(spark, sf):
    return rounded(text_time(S.national_rollup(A.fact(spark, sf), "dia"), "periodo"), 4, "energia_mwh")


@query("AG10", _ROLL.format(p="timestamp_utc", w="WHERE timestamp_utc >= '2024-01-03' AND timestamp_utc < '2024-01-26' AND fonte = 'BUILDING'"))
def national_rollup_by_hour(spark, sf):
    out = S.national_rollup(A.fact(spark, sf), "hora", "2024-01-03", "2024-01-25", "BUILDING")
    return rounded(text_time(out, "periodo"), 4, "energia_mwh")


@query("AG11", f"""WITH {A.FACT} SELECT CAST(timestamp_utc AS VARCHAR) AS timestamp, round(energia_mwh, 4) AS energia_mwh, flag_qualidade FROM fato
  WHERE usina_id = 12 AND timestamp_utc >= '2024-01-02' AND timestamp_utc < '2024-01-29'""")
def unit_series(spark, sf):
    return rounded(text_time(S.unit_series(A.fact(spark, sf), 12, "2024-01-02", "2024-01-28"), "timestamp"), 4, "energia_mwh")


@query("AG11 AG17", f"""WITH {A.FACT} SELECT usina_id, CAST(min(timestamp_utc) AS VARCHAR) AS inicio, CAST(max(timestamp_utc) AS VARCHAR) AS fim,
  round(coalesce(sum(energia_mwh), 0), 4) AS total_mwh, count(*) AS horas FROM fato GROUP BY 1""")
def series_totals(spark, sf):
    return rounded(text_time(S.series_summary(A.fact(spark, sf), ["usina_id"]), "inicio", "fim"), 4, "total_mwh")


def _unit_days(spark, sf):
    """Climate of the first point of the state of each unit, by day."""
    first = A.points(spark, sf).groupBy("id_estado").agg(F.min("local").alias("local"))
    return (A.dim(spark, sf).select("usina_id", "id_estado").join(first, "id_estado").drop("id_estado")
            .join(A.daily_climate(spark, sf), "local"))


_UNIT_DAYS = f"""{A.CLIMATE}, primeiro AS (SELECT id_estado, min(local) AS local FROM pontos GROUP BY 1),
  uclima AS (SELECT usina_id, clima.* FROM dim JOIN primeiro USING (id_estado) JOIN clima ON clima.local = primeiro.local)"""


@query("AG12", f"""WITH {A.DIM}, {_UNIT_DAYS} SELECT CAST(data AS VARCHAR) AS data, round(irradiancia_kwh_m2, 6) AS irradiancia_kwh_m2, round(vento_ms, 6) AS vento_ms, medidas_faltantes, local
  FROM uclima WHERE usina_id = 3 AND data BETWEEN '2024-01-05' AND '2024-01-20'""")
def unit_climate_series(spark, sf):
    out = S.unit_climate(_unit_days(spark, sf), 3, "2024-01-05", "2024-01-20")
    return rounded(text_time(out.select("data", "irradiancia_kwh_m2", "vento_ms", "medidas_faltantes", "local"), "data"), 6, "irradiancia_kwh_m2", "vento_ms")


@query("AG13", f"""WITH {A.FACT}, r AS (SELECT * FROM fato, (SELECT max(timestamp_utc) - INTERVAL 10 DAY AS c FROM fato) WHERE timestamp_utc >= c),
  u AS (SELECT fonte, usina_id, sum(energia_mwh) AS e FROM r GROUP BY ALL), t AS (SELECT fonte, sum(e) AS s FROM u GROUP BY 1)
  SELECT usina_id, fonte, round(coalesce(e / nullif(s, 0), 0), 8) AS participacao FROM u JOIN t USING (fonte)""")
def unit_shares(spark, sf):
    return rounded(S.shares(A.fact(spark, sf), 10), 8, "participacao")


@query("AG13 JN13", f"""WITH {A.FACT} SELECT round(coalesce(sum(CASE WHEN usina_id = 9 THEN energia_mwh ELSE 0 END) / nullif(sum(energia_mwh), 0), 0), 8) AS participacao
  FROM fato, (SELECT max(timestamp_utc) - INTERVAL 10 DAY AS c FROM fato) WHERE fonte = (SELECT fonte FROM dim WHERE usina_id = 9) AND timestamp_utc >= c""")
def share_of_one_unit(spark, sf):
    fact = A.fact(spark, sf)
    source = A.dim(spark, sf).filter("usina_id = 9").first()["fonte"]
    return rounded(S.share_of_unit(fact, 9, source, 10), 8, "participacao")


@query("AG14", f"""WITH {A.FACT}, {A.CLIMATE} SELECT (SELECT count(*) FROM dim) AS usinas, CAST(min(timestamp_utc) AS VARCHAR) AS geracao_inicio, CAST(max(timestamp_utc) AS VARCHAR) AS geracao_fim,
  count(*) AS geracao_linhas, (SELECT CAST(min(data) AS VARCHAR) FROM clima) AS clima_inicio, (SELECT CAST(max(data) AS VARCHAR) FROM clima) AS clima_fim, (SELECT count(*) FROM clima) AS clima_linhas FROM fato""")
def data_coverage(spark, sf):
    out = S.coverage(A.fact(spark, sf), A.daily_climate(spark, sf), A.dim(spark, sf))
    return text_time(out, "geracao_inicio", "geracao_fim", "clima_inicio", "clima_fim")


@query("AG15", f"""WITH {A.REGIONAL}, d AS (SELECT usina_id, {DAY} AS dia, sum(energia_mwh) AS e, count(*) FILTER (WHERE flag_qualidade <> 'faltante') AS h FROM rfato GROUP BY usina_id, {DAY}),
  f AS (SELECT fonte, e / (potencia_mw * 24) AS fc FROM d JOIN rdim USING (usina_id) WHERE h = 24)
  SELECT 'usinas_por_fonte' AS medida, fonte AS grupo, count(*)::DOUBLE AS valor FROM rdim GROUP BY 2
  UNION ALL SELECT 'gwh_por_fonte', fonte, round(sum(energia_mwh) / 1000, 6) FROM rfato GROUP BY 2
  UNION ALL SELECT 'fator_medio', fonte, round(avg(fc), 6) FROM f GROUP BY 2
  UNION ALL SELECT 'eventos', (o_orderstatus = 'F')::VARCHAR, count(*)::DOUBLE FROM orders GROUP BY 2
  UNION ALL SELECT 'ultimos_7_dias', 'primeira_usina', round(sum(energia_mwh), 6) FROM rfato, (SELECT max(timestamp_utc) AS z, min(usina_id) AS u FROM rfato) WHERE usina_id = u AND timestamp_utc >= z - INTERVAL 7 DAY""")
def build_summary(spark, sf):
    fact, dim = A.regional_fact(spark, sf), A.regional_dim(spark, sf)
    factors = S.capacity_factor(fact, dim, _regional_climate(spark, sf))
    events = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("evento_ocorreu"))
    return rounded(S.smoke_summary(fact, dim, factors, events), 6, "valor")


@query("AG16", f"""WITH {A.FACT} SELECT fonte, round(sum(energia_mwh), 4) AS total_mwh, count(DISTINCT {DAY}) AS periodos FROM fato GROUP BY 1""")
def totals_per_source(spark, sf):
    return rounded(S.source_totals(S.national_rollup(A.fact(spark, sf), "dia")), 4, "total_mwh")


@query("AG17", f"""WITH {A.FACT}, {_UNIT_DAYS}, h AS (SELECT usina_id, count(*) FILTER (WHERE energia_mwh IS NULL) AS horas_sem_medida FROM fato GROUP BY 1),
  d AS (SELECT usina_id, count(*) FILTER (WHERE medidas_faltantes LIKE '%vento_ms%') AS k FROM uclima GROUP BY 1)
  SELECT usina_id, horas_sem_medida, coalesce(k, 0) AS dias_sem_medida FROM h LEFT JOIN d USING (usina_id)""")
def missing_counts(spark, sf):
    return S.missing_counts(A.fact(spark, sf), _unit_days(spark, sf), "vento_ms")


@query("AG19", "SELECT p_type AS tipo, p_brand AS fase, count(*) AS usinas FROM part GROUP BY ALL")
def phases_by_type(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("tipo"), F.col("p_brand").alias("fase"))
    return S.phase_counts(p, "tipo", "fase")


@query("AG21", "SELECT event_type AS metodo, 'r' || (user_id % 10) AS rota, 200 + user_id % 3 AS status, count(*) AS requisicoes, round(sum(value), 4) AS latencia_soma_ms, "
       + ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS ate_{b}_ms" for b in (5, 10, 25, 50, 100, 250, 500, 1000)) + " FROM events GROUP BY 1, 2, 3")
def access_log_counts(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("metodo"), F.concat(F.lit("r"), F.pmod("user_id", F.lit(10)).cast("string")).alias("rota"),
        (200 + F.pmod("user_id", F.lit(3))).alias("status"), F.col("value").alias("latencia_ms"))
    return rounded(S.access_counts(e), 4, "latencia_soma_ms")


@query("AG22", f"WITH {A.DIM} SELECT usina_id, nome, fonte, regiao, id_estado, potencia_mw, lat, lon, tipo_unidade FROM dim WHERE usina_id = 42")
def one_unit(spark, sf):
    return S.find_unit(A.dim(spark, sf), 42).drop("data_operacao")


@query("WN4 FC2", """SELECT user_id::BIGINT AS usina_id, round(sum(value), 4) AS energia_mwh FROM events GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 10""")
def top_units(spark, sf):
    return rounded(S.top_units(A.hourly(spark, sf), 10), 4, "energia_mwh")


@query("WN5", f"""WITH {A.DIM}, k AS (SELECT * FROM dim WHERE fonte = 'BUILDING'), a AS (SELECT *, row_number() OVER (ORDER BY usina_id) AS i FROM k WHERE usina_id > 100)
  SELECT usina_id, nome, (SELECT max(usina_id) FROM a WHERE i = 20) AS proxima_chave, (SELECT count(*) FROM k) AS total FROM a WHERE i <= 20""")
def keyset_page(spark, sf):
    kept = S.where(A.dim(spark, sf), {"fonte": "BUILDING", "regiao": None})
    return S.page_table(kept, 20, 100).select("usina_id", "nome", "proxima_chave", "total")


@query("WN6", """WITH c AS (SELECT p_name AS k, count(*) AS n FROM part GROUP BY 1), t AS (SELECT k FROM c ORDER BY n DESC, k LIMIT 5)
  SELECT CASE WHEN k IN (SELECT k FROM t) THEN k ELSE '(outras)' END AS categoria, sum(n)::BIGINT AS n, round(100.0::DOUBLE * sum(n) / (SELECT sum(n) FROM c), 6) AS pct FROM c GROUP BY 1""")
def top_categories(spark, sf):
    return rounded(S.top_categories(table(spark, sf, "part"), "p_name", 5), 6, "pct")


@query("WN7", """(SELECT 'maior' AS lado, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15)
  UNION ALL (SELECT 'menor', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15)""")
def largest_and_smallest(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    high = S.extremes(o, "o_totalprice", 15, tie=["o_orderkey"]).select(F.lit("maior").alias("lado"), "*")
    low = S.extremes(o, "o_totalprice", 15, largest=False, tie=["o_orderkey"]).select(F.lit("menor").alias("lado"), "*")
    return high.unionByName(low)


@query("WN8", """WITH m AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS mediana FROM lineitem GROUP BY 1)
  SELECT l_orderkey, l_partkey, l_linenumber, round(mediana, 4) AS mediana, round(abs(l_extendedprice - mediana), 4) AS distancia FROM lineitem JOIN m USING (l_returnflag)""")
def distance_to_group_median(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return rounded(S.median_distance(li, "l_returnflag", "l_extendedprice"), 4, "mediana", "distancia").drop("l_returnflag", "l_extendedprice")


@query("WN11", """WITH q AS (SELECT quantile_cont(c_acctbal, [0, 1.0/3, 2.0/3, 1]) AS e FROM customer)
  SELECT c_custkey, CASE WHEN c_acctbal <= e[2] THEN 'g1' WHEN c_acctbal <= e[3] THEN 'g2' ELSE 'g3' END AS grupo_risco FROM customer, q""")
def equal_count_groups(spark, sf):
    from brisa.functions.numeric import bin_of
    from brisa.operators.cleaning import bin_edges
    c = table(spark, sf, "customer")
    edges = bin_edges(c, "c_acctbal", "quantil", 3)
    return c.select("c_custkey", bin_of(F.col("c_acctbal"), edges, ["g1", "g2", "g3"]).alias("grupo_risco"))
