"""Joins, links, nearest points, curve look-ups, the star and its rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from brisa.operators import joins as J, sites, star, validate
from brisa.operators.serving import factor_per_plant
from brisa.plans import adapters as A
from brisa.plans.adapters import rounded, table, text_time
from brisa.plans.registry import query
from brisa.schemas import FATO_GERACAO, Table

KM = """2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians({a}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({a})) * pow(sin((radians({c}) - radians({d})) / 2), 2))))"""


def km_sql(lat1, lon1, lat2, lon2):
    return KM.format(a=lat2, b=lat1, c=lon2, d=lon1)


#: Keys that find no partner: all rows are read, every fifth key is another number.
LOST = "CASE WHEN {0} % 5 = 0 THEN -{0} ELSE {0} END"


# ---------------------------------------------------------------- checked join
@query("JN1", """WITH a AS (SELECT CASE WHEN c_nationkey > 20 THEN NULL ELSE c_nationkey END AS chave, c_name AS nome, c_custkey FROM customer),
  b AS (SELECT CASE WHEN n_nationkey = 24 THEN NULL ELSE n_nationkey + 2 END AS chave, n_name AS nome, n_regionkey FROM nation)
  SELECT coalesce(a.chave, b.chave) AS chave, a.nome, c_custkey, b.nome AS nome_dir, n_regionkey FROM a FULL OUTER JOIN b ON a.chave IS NOT DISTINCT FROM b.chave""")
def checked_outer_join(spark, sf):
    a = table(spark, sf, "customer").select(F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")).alias("chave"),
                                            F.col("c_name").alias("nome"), "c_custkey")
    b = table(spark, sf, "nation").select(
        F.when(F.col("n_nationkey") != 24, F.col("n_nationkey") + 2).alias("chave"), F.col("n_name").alias("nome"), "n_regionkey")
    return J.safe_join(a, b, "chave", "outer", validate="many_to_one")


@query("JN1", """WITH b AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey FROM orders), l AS (SELECT l_orderkey, count(*) AS a FROM lineitem GROUP BY 1)
  SELECT sum(a)::BIGINT AS linhas_esquerda, sum(a - 1)::BIGINT AS repetidas_esquerda, sum(CASE WHEN o_orderkey IS NOT NULL THEN a END)::BIGINT AS com_par,
  sum(CASE WHEN o_orderkey IS NULL THEN a END)::BIGINT AS sem_par, sum(CASE WHEN o_orderkey IS NOT NULL THEN a END)::BIGINT AS linhas_internas,
  (SELECT count(*) FROM b) AS linhas_direita, 0::BIGINT AS repetidas_direita FROM l LEFT JOIN b ON l_orderkey = o_orderkey""")
def join_match_report(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    o = table(spark, sf, "orders").withColumn("o_orderkey", F.expr(LOST.format("o_orderkey"))).withColumnRenamed("o_orderkey", "k")
    return J.join_report(li, o, "k")


# ----------------------------------------------------------------------- links
@query("JN2 JN4 JN5", """WITH r AS (SELECT 'EOL.' || p_partkey || '-0.1' AS ceg, p_name, p_type FROM part),
  u AS (SELECT c_custkey::VARCHAR AS chave_unidade, CASE WHEN c_acctbal > 0 THEN 'EOL.' || c_custkey || '-0.0' || c_nationkey END AS ceg_ons FROM customer)
  SELECT ceg AS ceg_aneel, chave_unidade, 'ceg' AS metodo_vinculo, p_name AS nome FROM r JOIN u ON regexp_replace(ceg, '\\.[^.]*$', '') = regexp_replace(ceg_ons, '\\.[^.]*$', '')
  UNION ALL SELECT ceg, NULL, 'livre', p_name FROM r WHERE regexp_replace(ceg, '\\.[^.]*$', '') NOT IN (SELECT regexp_replace(ceg_ons, '\\.[^.]*$', '') FROM u WHERE ceg_ons IS NOT NULL)""")
def code_links(spark, sf):
    """Plants linked by code, with their attributes, and the plants that stay free."""
    r = table(spark, sf, "part").select(F.concat(F.lit("EOL."), F.col("p_partkey").cast("string"), F.lit("-0.1")).alias("ceg"), F.col("p_name").alias("nome"))
    u = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("chave_unidade"), F.when(
        F.col("c_acctbal") > 0, F.concat(F.lit("EOL."), F.col("c_custkey").cast("string"), F.lit("-0.0"), F.col("c_nationkey").cast("string"))).alias("ceg_ons"))
    linked = star.link_by_code(u, r)
    details = r.withColumnRenamed("ceg", "ceg_aneel")
    free = details.join(linked, "ceg_aneel", "left_anti").select(
        "ceg_aneel", F.lit(None).cast("string").alias("chave_unidade"), F.lit("livre").alias("metodo_vinculo"), "nome")
    return linked.drop("nucleo_usado").join(details, "ceg_aneel", "left").select(*free.columns).unionByName(free)


@query("JN3")
def name_links(spark, sf):
    """Sets named after a colour and a thing choose parts of the same type whose name holds them."""
    p = table(spark, sf, "part")
    plants = p.select(F.col("p_partkey").cast("string").alias("ceg"), F.col("p_type").alias("id_estado"), F.lit("eolica").alias("fonte"),
                      F.concat_ws(" ", F.lit("parque"), F.lower("p_name"), F.lower("p_brand")).alias("nome_normalizado"))
    sets = p.groupBy("p_type", "p_name").agg(F.min("p_brand").alias("b")).select(
        F.concat_ws("/", "p_type", "p_name").alias("chave_unidade"), F.col("p_type").alias("id_estado"), F.lit("eolica").alias("fonte"),
        F.concat_ws(" ", F.lower("p_name"), F.lower("b")).alias("nucleo"))
    return star.link_by_name(sets, plants)


# --------------------------------------------------------------- nearest point
@query("JN6", f"""WITH {A.DIM}, {A.POINTS}, d AS (SELECT usina_id, local, {km_sql('lat', 'lon', 'latitude', 'longitude')} AS km FROM dim, pontos WHERE lat IS NOT NULL)
  SELECT usina_id, arg_min(local, struct_pack(a := km, b := local)) AS local, round(min(km), 4) AS distancia_km FROM d GROUP BY 1""")
def nearest_points(spark, sf):
    return rounded(J.nearest_point(A.dim(spark, sf), A.points(spark, sf), "usina_id", "local"), 4, "distancia_km")


@query("JN6 JN18", f"""WITH {A.DIM}, {A.POINTS}, d AS (SELECT usina_id, local, {km_sql('lat', 'lon', 'latitude', 'longitude')} AS km FROM dim, pontos WHERE lat IS NOT NULL)
  SELECT usina_id, arg_min(local, struct_pack(a := km, b := local)) AS local, round(min(km), 4) AS distancia_km FROM d GROUP BY 1""")
def nearest_points_by_cells(spark, sf):
    """The same answer without sending the points to every task."""
    return rounded(J.nearest_point(A.dim(spark, sf), A.points(spark, sf), "usina_id", "local", broadcast_limit=0), 4, "distancia_km")


_LADDER = f"""{A.DIM}, {A.POINTS}, d AS (SELECT usina_id, local, {km_sql('lat', 'lon', 'latitude', 'longitude')} AS km FROM dim, pontos WHERE lat IS NOT NULL),
  perto AS (SELECT usina_id, arg_min(local, struct_pack(a := km, b := local)) AS local, min(km) AS km FROM d GROUP BY 1),
  uf AS (SELECT id_estado, min(local) AS l FROM pontos GROUP BY 1), sub AS (SELECT id_subsistema, min(local) AS l FROM pontos GROUP BY 1),
  vinculo AS (SELECT dim.usina_id, coalesce(perto.local, uf.l, sub.l) AS local_clima, km AS distancia_km,
  CASE WHEN km <= 300 THEN 'mais_proximo' WHEN km IS NOT NULL THEN 'mais_proximo_distante' WHEN uf.l IS NOT NULL THEN 'mesma_uf' ELSE 'mesmo_subsistema' END AS metodo_vinculo_clima
  FROM dim LEFT JOIN perto USING (usina_id) LEFT JOIN uf USING (id_estado) LEFT JOIN sub ON regiao = id_subsistema WHERE coalesce(perto.local, uf.l, sub.l) IS NOT NULL)"""


@query("JN7", f"WITH {_LADDER} SELECT usina_id, local_clima, round(distancia_km, 4) AS distancia_km, metodo_vinculo_clima FROM vinculo")
def climate_reference_points(spark, sf):
    return rounded(J.climate_point(A.dim(spark, sf), A.points(spark, sf)), 4, "distancia_km")


_DAILY = "clima AS" + A.CLIMATE.split("clima AS", 1)[1]


@query("JN8", f"""WITH {_LADDER}, {_DAILY}
  SELECT usina_id, CAST(data AS VARCHAR) AS data, round(irradiancia_kwh_m2, 6) AS irradiancia_kwh_m2, round(vento_ms, 6) AS vento_ms, medidas_faltantes, local_clima
  FROM vinculo JOIN clima ON local_clima = clima.local""")
def climate_per_unit_and_day(spark, sf):
    link = J.climate_point(A.dim(spark, sf), A.points(spark, sf)).select("usina_id", "local_clima")
    daily = A.daily_climate(spark, sf).withColumnRenamed("local", "local_clima")
    out = link.join(daily, "local_clima").select("usina_id", "data", "irradiancia_kwh_m2", "vento_ms", "medidas_faltantes", "local_clima")
    return rounded(text_time(out, "data"), 6, "irradiancia_kwh_m2", "vento_ms")


@query("JN18 JN6", f"""WITH {A.DIM}, {A.CLIMATE}, m AS (SELECT local, any_value(latitude) AS latitude, any_value(longitude) AS longitude, avg(vento_ms) AS vento, avg(temperatura_c) AS temp FROM clima GROUP BY 1),
  d AS (SELECT usina_id, m.local, vento, temp, {km_sql('lat', 'lon', 'latitude', 'longitude')} AS km FROM dim, m WHERE lat IS NOT NULL),
  b AS (SELECT *, row_number() OVER (PARTITION BY usina_id ORDER BY km, local) AS i FROM d)
  SELECT usina_id, local AS ponto_clima, round(vento, 6) AS vento, round(temp, 6) AS temp FROM b WHERE i = 1""")
def mean_climate_of_nearest_point(spark, sf):
    means = A.daily_climate(spark, sf).groupBy("local", "latitude", "longitude").agg(
        F.avg("vento_ms").alias("vento"), F.avg("temperatura_c").alias("temp"))
    near = J.nearest_point(A.dim(spark, sf), means, "usina_id", "local").drop("distancia_km")
    return rounded(near.join(means.select("local", "vento", "temp"), "local").withColumnRenamed("local", "ponto_clima"), 6, "vento", "temp")


# ----------------------------------------------------------------- star pieces
@query("JN9 JN10", f"""WITH {A.FACT} SELECT usina_id, CAST(timestamp_utc AS VARCHAR) AS timestamp_utc, round(energia_mwh, 4) AS energia_mwh, fonte, regiao, flag_qualidade
  FROM fato WHERE fonte IN ('BUILDING', 'MACHINERY')""")
def generation_fact(spark, sf):
    clean = A.clean_hourly(spark, sf).join(A.dim(spark, sf), "usina_id").select(
        F.col("nome").alias("chave_unidade"), F.col("timestamp_utc").alias("data_hora_utc"), F.col("energia_mwh").alias("geracao_mwh"),
        "fonte", F.col("regiao").alias("id_subsistema"), "flag_qualidade")
    units = A.dim(spark, sf).select(F.col("nome").alias("chave_unidade"), "usina_id")
    return rounded(text_time(star.generation_fact(clean, units, ("BUILDING", "MACHINERY")), "timestamp_utc"), 4, "energia_mwh")


@query("JN11 VA4", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT CASE WHEN o_custkey % 5 = 0 THEN -o_custkey ELSE o_custkey END FROM orders)")
def orphan_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.expr(LOST.format("o_custkey")).alias("user_id"))
    return validate.orphans(table(spark, sf, "events"), o, "user_id").select("event_id")


@query("JN13", """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT max(ts) - INTERVAL 7 DAY AS c FROM events) WHERE ts >= c GROUP BY 1""")
def last_days_by_one_row_join(spark, sf):
    e = J.since_last_days(table(spark, sf, "events"), "ts", 7)
    return rounded(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4, "total")


@query("JN14", f"""WITH {A.HOURLY}, d AS (SELECT user_id AS usina_id, ts::DATE AS dia, max(value) AS pico FROM events WHERE event_type = 'view' GROUP BY ALL)
  SELECT h.usina_id, CAST(timestamp_utc AS VARCHAR) AS timestamp_utc, pico FROM horas h LEFT JOIN d ON h.usina_id = d.usina_id AND timestamp_utc::DATE = dia""")
def daily_value_on_every_hour(spark, sf):
    d = table(spark, sf, "events").filter("event_type = 'view'").groupBy(
        F.col("user_id").cast("long").alias("usina_id"), F.to_date("ts").alias("dia")).agg(F.max("value").alias("pico"))
    out = J.repeat_daily(A.hourly(spark, sf), d, "timestamp_utc", "dia", ["usina_id"], ["pico"])
    return text_time(out.select("usina_id", "timestamp_utc", "pico"), "timestamp_utc")


@query("JN15", """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderdate >= '2000-01-01' THEN 'O' ELSE o_orderstatus END AS s FROM orders WHERE o_orderdate < '2001-01-01')
  SELECT o_orderkey, o_orderpriority, coalesce(s, '(não cadastrada)') AS fase_antes, o_orderstatus AS fase_depois FROM orders LEFT JOIN a USING (o_orderkey) WHERE s IS NULL OR s <> o_orderstatus""")
def snapshot_phase_changes(spark, sf):
    o = table(spark, sf, "orders")
    before = o.filter("o_orderdate < '2001-01-01'").withColumn(
        "o_orderstatus", F.when(F.col("o_orderdate") >= "2000-01-01", "O").otherwise(F.col("o_orderstatus")))
    return J.snapshot_changes(before, o, "o_orderkey", "o_orderstatus", ["o_orderpriority"])


_CURVE = "c AS (SELECT l_returnflag AS g, l_quantity AS t, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"


def _curve(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("t")).agg(F.avg("l_extendedprice").alias("v"))


# times before, between, on and after the points of the curve
_ASKS = "q AS (SELECT p_partkey, p_size * 1.25::DOUBLE - 5 AS em, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS g FROM part)"


def _asks(spark, sf):
    g = F.pmod("p_partkey", F.lit(3))
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 1.25 - 5).alias("em"), F.when(g == 0, "A").when(g == 1, "N").otherwise("R").alias("g"))


@query("JN16", f"""WITH {_CURVE}, {_ASKS}, p AS (SELECT q.*, (SELECT max(t) FROM c WHERE c.g = q.g AND t <= em) AS t0, (SELECT min(t) FROM c WHERE c.g = q.g AND t >= em) AS t1 FROM q),
  x AS (SELECT p.*, a.v AS v0, b.v AS v1 FROM p LEFT JOIN c a ON a.g = p.g AND a.t = t0 LEFT JOIN c b ON b.g = p.g AND b.t = t1)
  SELECT p_partkey, em, g, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (em - t0) / (t1 - t0) END, 4) AS valor FROM x""")
def curve_interpolation(spark, sf):
    return rounded(J.curve_lookup(_asks(spark, sf), _curve(spark, sf), "em", "t", "v", ["g"]), 4, "valor")


@query("JN17", f"""WITH {_CURVE}, {_ASKS} SELECT p_partkey, em, q.g AS g, round(coalesce(v, 1.0), 4) AS valor FROM q ASOF LEFT JOIN c ON q.g = c.g AND em >= t""")
def curve_step(spark, sf):
    return rounded(J.step_lookup(_asks(spark, sf), _curve(spark, sf), "em", "t", "v", ["g"], before=1.0), 4, "valor")


# ------------------------------------------------------------------- dimension
@query("AG1", f"""WITH e AS (SELECT user_id, ts, CASE WHEN value > 5 THEN event_type END AS tipo, value FROM events)
  SELECT user_id::VARCHAR AS chave_unidade, arg_max(tipo, struct_pack(a := ts, b := tipo)) FILTER (WHERE tipo IS NOT NULL) AS nome,
  CAST(date_trunc('second', min(ts)) AS VARCHAR) AS primeira_medicao_utc, CAST(date_trunc('second', max(ts)) AS VARCHAR) AS ultima_medicao_utc, max(value) AS pico_geracao_mw FROM e GROUP BY 1""")
def unit_attributes(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("chave_unidade"), F.col("ts").alias("data_hora_utc"), F.when(F.col("value") > 5, F.col("event_type")).alias("nome_usina"),
        F.col("value").alias("geracao_mwh"), *[F.lit("x").alias(c) for c in (
            "id_ons", "ceg", "nome_usina_normalizado", "fonte", "tipo_unidade", "modalidade_ons", "id_estado", "id_subsistema")])
    out = star.unit_attributes(e, None).select("chave_unidade", "nome", "primeira_medicao_utc", "ultima_medicao_utc", "pico_geracao_mw")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("primeira_medicao_utc", "ultima_medicao_utc")})


_BRIDGE = """ponte AS (SELECT l_partkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice / 1000 END AS potencia, l_suppkey * 1.0::DOUBLE AS lat, l_shipdate::DATE AS d, l_linestatus AS m,
  s_name AS municipio FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def _bridge(spark, sf):
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    return li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(
        F.col("l_partkey").alias("chave_unidade"), F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") / 1000).alias("potencia_outorgada_mw"),
        F.col("l_suppkey").cast("double").alias("latitude"), F.lit(-40.0).alias("longitude"), F.to_date("l_shipdate").alias("data_entrada_operacao"),
        F.lit("nome").alias("metodo_vinculo"), F.col("s_name").alias("municipio"))


@query("AG2", f"""WITH {_BRIDGE}, t AS (SELECT l_partkey, municipio, count(*) AS n FROM ponte GROUP BY ALL)
  SELECT l_partkey AS chave_unidade, round(coalesce(sum(potencia), 0), 7) AS potencia_mw, round(avg(lat), 6) AS lat, CAST(min(d) AS VARCHAR) AS data_operacao, count(*) AS n_usinas_aneel,
  (SELECT municipio FROM t WHERE t.l_partkey = ponte.l_partkey ORDER BY n DESC, municipio LIMIT 1) AS municipio FROM ponte GROUP BY 1""")
def member_summary(spark, sf):
    out = star.member_summary(_bridge(spark, sf)).select("chave_unidade", "potencia_mw", "lat", "data_operacao", "n_usinas_aneel", "municipio")
    return rounded(rounded(text_time(out, "data_operacao"), 7, "potencia_mw"), 6, "lat")


@query("AG3", f"""WITH {A.DIM}, {A.HOURLY}, p AS (SELECT usina_id, max(v) AS pico FROM horas GROUP BY 1), b AS (SELECT usina_id, pico, coalesce(potencia_mw, 0) * 2 AS pot,
  CASE fonte WHEN 'BUILDING' THEN 'ceg' WHEN 'FURNITURE' THEN 'sem_vinculo' ELSE 'nome' END AS m FROM dim JOIN p USING (usina_id)),
  r AS (SELECT *, pico / nullif(pot, 0) AS razao, CASE WHEN m = 'ceg' THEN 'exata' WHEN m = 'nome' AND coalesce(pico / nullif(pot, 0) BETWEEN 0.4 AND 1.15, false) THEN 'consistente'
  WHEN m = 'nome' THEN 'inconsistente' ELSE 'sem_vinculo' END AS q FROM b)
  SELECT usina_id, round(razao, 6) AS razao_pico_potencia, q AS qualidade_vinculo, CASE WHEN q IN ('exata', 'consistente') THEN round(pot, 6) END AS potencia_mw, round(pot, 6) AS potencia_aneel_vinculada_mw FROM r""")
def judged_links(spark, sf):
    peak = A.hourly(spark, sf).groupBy("usina_id").agg(F.max("energia_mwh").alias("pico_geracao_mw"))
    method = F.when(F.col("fonte") == "BUILDING", "ceg").when(F.col("fonte") == "FURNITURE", "sem_vinculo").otherwise("nome")
    d = A.dim(spark, sf).select("usina_id", (F.coalesce("potencia_mw", F.lit(0.0)) * 2).alias("potencia_mw"), method.alias("metodo_vinculo")).join(peak, "usina_id")
    out = star.judge_link(d).select("usina_id", "razao_pico_potencia", "qualidade_vinculo", "potencia_mw", "potencia_aneel_vinculada_mw")
    return rounded(out, 6, "razao_pico_potencia", "potencia_mw", "potencia_aneel_vinculada_mw")


@query("AG4", f"""WITH {A.DIM}, velho AS (SELECT usina_id + 7 AS id, nome FROM dim WHERE tipo_unidade = 'conjunto'),
  novo AS (SELECT nome, (SELECT max(id) FROM velho) + row_number() OVER (ORDER BY fonte, regiao, id_estado, nome) AS id FROM dim WHERE tipo_unidade <> 'conjunto')
  SELECT nome AS chave_unidade, id AS novo_id FROM velho UNION ALL SELECT nome, id FROM novo""")
def stable_unit_ids(spark, sf):
    d = A.dim(spark, sf)
    before = d.filter("tipo_unidade = 'conjunto'").select(F.col("nome").alias("chave_unidade"), (F.col("usina_id") + 7).alias("novo_id"))
    units = d.select(F.col("nome").alias("chave_unidade"), "fonte", "regiao", "id_estado", "nome")
    return star.stable_ids(units, before, name="novo_id").select("chave_unidade", "novo_id")


@query("AG5")
def dimension_and_bridge(spark, sf):
    """Dimension from hourly events of customers and parts as registry plants."""
    sub = F.when(F.pmod("usina_id", F.lit(2)) == 0, "solar").otherwise("eolica")
    d = A.dim(spark, sf)
    clean = A.hourly(spark, sf).join(d, "usina_id").select(
        F.col("nome").alias("chave_unidade"), F.lit(None).cast("string").alias("id_ons"),
        F.when(F.col("tipo_unidade") == "usina", F.concat(F.lit("UFV."), F.col("usina_id").cast("string"), F.lit("-0.01"))).alias("ceg"),
        F.concat(F.lit("CONJUNTO "), F.col("fonte")).alias("nome_usina"), F.lower(F.concat(F.lit("conjunto "), F.col("fonte"))).alias("nome_usina_normalizado"),
        sub.alias("fonte"), "tipo_unidade", F.lit("TIPO I").alias("modalidade_ons"), "id_estado", F.col("regiao").alias("id_subsistema"),
        F.col("timestamp_utc").alias("data_hora_utc"), F.col("energia_mwh").alias("geracao_mwh"))
    p = table(spark, sf, "part").join(table(spark, sf, "nation"), F.pmod("p_partkey", F.lit(25)) == F.col("n_nationkey")).select(
        F.concat(F.lit("UFV."), F.col("p_partkey").cast("string"), F.lit("-0.1")).alias("ceg"),
        F.concat_ws(" ", F.when(F.pmod("p_partkey", F.lit(2)) == 0, "building").otherwise("machinery"), F.lower("p_name")).alias("nome_normalizado"),
        F.when(F.pmod("p_partkey", F.lit(2)) == 0, "solar").otherwise("eolica").alias("fonte"), F.lit("Operação").alias("fase"),
        F.col("n_name").alias("id_estado"), (F.col("p_retailprice") / 100).alias("potencia_outorgada_mw"), F.lit(-10.0).alias("latitude"),
        F.lit(-40.0).alias("longitude"), F.col("p_type").alias("municipio"), F.lit("2015-01-01").cast("date").alias("data_entrada_operacao"))
    dim, _ = star.build_dimension(clean, p)
    return dim


@query("AG6", """WITH m AS (SELECT o_custkey AS usina_id, o_orderdate::DATE AS ini, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 400 END AS ev, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS tipo FROM orders),
  f AS (SELECT usina_id, min(ini) AS ini, min(ev) AS ev, count(*) AS n, arg_min(tipo, struct_pack(a := ev, b := tipo)) FILTER (WHERE ev IS NOT NULL) AS tipo FROM m GROUP BY 1)
  SELECT usina_id, greatest(date_diff('day', ini, coalesce(ev, DATE '2004-01-01')), 1)::INTEGER AS tempo_dias, ev IS NOT NULL AS evento_ocorreu, CAST(ev AS VARCHAR) AS data_primeiro_evento, tipo AS tipo_evento,
  n::INTEGER AS n_usinas_consideradas, true AS simulado FROM f""")
def first_event_per_unit(spark, sf):
    o = table(spark, sf, "orders")
    event = F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), 400))
    ev = o.select(F.col("o_orderkey").cast("string").alias("ceg"), F.to_date("o_orderdate").alias("data_entrada_operacao"), F.lit("2004-01-01").cast("date").alias("data_corte"),
                  event.alias("data_evento"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("tipo_evento"))
    bridge = o.select(F.col("o_orderkey").cast("string").alias("ceg_aneel"), F.col("o_custkey").alias("usina_id"))
    return text_time(star.maintenance_fact(ev, bridge), "data_primeiro_evento")


@query("AG18", f"""WITH {A.FACT}, h AS (SELECT usina_id, coalesce(sum(energia_mwh), 0) AS e, count(*) AS n FROM fato GROUP BY 1),
  f AS (SELECT usina_id, e / (potencia_mw * n) AS fc FROM h JOIN dim USING (usina_id) WHERE potencia_mw IS NOT NULL),
  k AS (SELECT * FROM f WHERE fc > 0 AND fc <= 1) SELECT o_orderpriority || '/' || (o_custkey % 40) AS ceg_aneel, round(avg(fc), 6) AS fator_capacidade FROM orders JOIN k ON o_custkey = usina_id GROUP BY 1""")
def capacity_factor_per_plant(spark, sf):
    bridge = table(spark, sf, "orders").select(
        F.concat_ws("/", "o_orderpriority", F.pmod("o_custkey", F.lit(40)).cast("string")).alias("ceg_aneel"), F.col("o_custkey").alias("usina_id"))
    return rounded(factor_per_plant(A.fact(spark, sf), A.dim(spark, sf), bridge), 6, "fator_capacidade")


# ----------------------------------------------------------------- validation
RULES = Table("linhas", ("l_orderkey", "l_linenumber"), tuple(
    (c, FATO_GERACAO.schema["fonte"].dataType, True) for c in ("l_orderkey", "l_returnflag")),
    {"l_orderkey": ("pedidos", "o_orderkey")}, {"l_quantity": (2, 49), "l_discount": (None, 0.08)})


@query("VA1 VA2 VA3 VA4 VA5 VA6", """SELECT 'linhas' AS tabela, 'chave' AS regra, 'l_orderkey,l_linenumber' AS coluna, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS linhas FROM lineitem
  UNION ALL SELECT 'linhas', 'nulos', 'l_orderkey', count(*) FILTER (WHERE l_orderkey IS NULL) FROM lineitem
  UNION ALL SELECT 'linhas', 'nulos', 'l_returnflag', count(*) FILTER (WHERE l_returnflag = 'N') FROM lineitem
  UNION ALL SELECT 'linhas', 'faixa', 'l_quantity', count(*) FILTER (WHERE l_quantity < 2 OR l_quantity > 49) FROM lineitem
  UNION ALL SELECT 'linhas', 'faixa', 'l_discount', count(*) FILTER (WHERE l_discount > 0.08) FROM lineitem
  UNION ALL SELECT 'linhas', 'orfao', 'l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END FROM orders)""")
def rule_report(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_returnflag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    tables = {"linhas": li, "pedidos": table(spark, sf, "orders").withColumn("o_orderkey", F.expr(LOST.format("o_orderkey")))}
    return validate.table_report("linhas", tables, RULES)


# ------------------------------------------------------------------------ sites
@query("WN8", """WITH c AS (SELECT n_name AS id_estado, c_custkey, -33 + (c_custkey * 37 % 3800)::DOUBLE / 100 AS latitude, -73 + (c_custkey * 53 % 3800)::DOUBLE / 100 AS longitude FROM customer JOIN nation ON c_nationkey = n_nationkey),
  m AS (SELECT id_estado, quantile_cont(latitude, 0.5) AS a, quantile_cont(longitude, 0.5) AS o FROM c GROUP BY 1)
  SELECT c_custkey FROM c JOIN m USING (id_estado) WHERE """ + km_sql("latitude", "longitude", "a", "o") + " <= 1500")
def near_median_of_state(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("id_estado"), k, (-33 + F.pmod(k * 37, F.lit(3800)) / 100).alias("latitude"), (-73 + F.pmod(k * 53, F.lit(3800)) / 100).alias("longitude"))
    return sites.near_state_median(c, 1500.0).select("c_custkey")


def _candidates(spark, sf):
    k = F.col("usina_id")
    return A.dim(spark, sf).filter("potencia_mw is not null").select(
        "fonte", F.col("id_estado"), F.col("regiao").alias("id_subsistema"), "potencia_mw", F.col("nome").alias("ceg"), F.col("nome").alias("usina_referencia"),
        (-33 + F.pmod(k * 37, F.lit(3800)) / 100).alias("latitude"), (-73 + F.pmod(k * 53, F.lit(3800)) / 100).alias("longitude"),
        F.concat(F.lit("M"), F.pmod(k, F.lit(7)).cast("string")).alias("municipio"))


@query("WN9")
def chosen_sites(spark, sf):
    return sites.choose(_candidates(spark, sf), per_group=2, min_group_mw=50.0, min_km=150.0)


@query("WN10", f"""WITH {A.POINTS}, c AS (SELECT c_custkey, c_acctbal / 100 AS mw, -33 + (c_custkey * 37 % 3800)::DOUBLE / 100 AS latitude, -73 + (c_custkey * 53 % 3800)::DOUBLE / 100 AS longitude FROM customer WHERE c_acctbal > 0),
  d AS (SELECT c_custkey, any_value(mw) AS mw, min({km_sql('c.latitude', 'c.longitude', 'pontos.latitude', 'pontos.longitude')}) AS km FROM c, pontos GROUP BY 1)
  SELECT round(max(km), 4) AS distancia_maxima_km, round(sum(CASE WHEN km <= 100 THEN mw ELSE 0 END), 4) AS mw_cobertos, round(sum(mw), 4) AS mw_total,
  round(100 * sum(CASE WHEN km <= 100 THEN mw ELSE 0 END) / sum(mw), 6) AS pct_coberto, round(quantile_cont(km, 0.5), 4) AS distancia_mediana_km, round(quantile_cont(km, 0.9), 4) AS distancia_p90_km FROM d""")
def covered_capacity(spark, sf):
    out = sites.covered(_candidates(spark, sf), A.points(spark, sf), 100.0)
    return rounded(rounded(out, 4, "distancia_maxima_km", "mw_cobertos", "mw_total", "distancia_mediana_km", "distancia_p90_km"), 6, "pct_coberto")
