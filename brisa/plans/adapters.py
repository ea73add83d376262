"""The driver tables in the shapes the operators expect, with the same shapes as SQL.

events are hourly measures (user = unit), customer x nation x region the plant
dimension, supplier the climate points, lineitem x orders the time-to-event
cohort, error events the repeated events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brisa.functions.quality import missing_list, quality_flag
from brisa.operators import grid

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hour_of(column: str) -> Column:
    return F.expr(f"timestampadd(HOUR, timestampdiff(HOUR, {EPOCH}, {column}), {EPOCH})")


def text_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# ------------------------------------------------------------------ dimension
def dim(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, x) for x in ("customer", "nation", "region"))
    k = F.col("c_custkey")
    return (c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(k.cast("long").alias("usina_id"), F.col("c_name").alias("nome"), F.col("c_mktsegment").alias("fonte"),
                    F.col("r_name").alias("regiao"), F.col("n_name").alias("id_estado"),
                    F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100).alias("potencia_mw"),
                    F.when(F.col("c_acctbal") > 500, -33 + F.pmod(k * 37, F.lit(3800)) / 100).alias("lat"),
                    F.when(F.col("c_acctbal") > 500, -73 + F.pmod(k * 53, F.lit(3800)) / 100).alias("lon"),
                    F.date_add(F.lit("2010-01-01").cast("date"), F.pmod(k * 7, F.lit(3650)).cast("int")).alias("data_operacao"),
                    F.when(F.col("c_acctbal") < 1000, "conjunto").otherwise("usina").alias("tipo_unidade")))


DIM = """dim AS (SELECT c_custkey::BIGINT AS usina_id, c_name AS nome, c_mktsegment AS fonte, r_name AS regiao,
  n_name AS id_estado, CASE WHEN c_acctbal > 0 THEN c_acctbal / 100 END AS potencia_mw,
  CASE WHEN c_acctbal > 500 THEN -33 + (c_custkey * 37 % 3800)::DOUBLE / 100 END AS lat,
  CASE WHEN c_acctbal > 500 THEN -73 + (c_custkey * 53 % 3800)::DOUBLE / 100 END AS lon,
  (DATE '2010-01-01' + (c_custkey * 7 % 3650)::INTEGER)::DATE AS data_operacao,
  CASE WHEN c_acctbal < 1000 THEN 'conjunto' ELSE 'usina' END AS tipo_unidade
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# ------------------------------------------------------------------- hourly
def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Unit x hour with events: sum of the values."""
    ev = table(spark, sf, "events")
    return ev.groupBy(F.col("user_id").cast("long").alias("usina_id"), hour_of("ts").alias("timestamp_utc")).agg(
        F.sum("value").alias("energia_mwh"))


HOURLY = """horas AS (SELECT user_id::BIGINT AS usina_id, date_trunc('hour', ts) AS timestamp_utc, sum(value) AS v
  FROM events GROUP BY ALL)"""


def clean_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Complete grid per unit, gaps of at most three hours filled, flags."""
    full = grid.complete_grid(hourly(spark, sf), "usina_id", "timestamp_utc").drop("criada")
    full = grid.fill_short_gaps(full, "usina_id", "timestamp_utc", ["energia_mwh"], 3)
    return full.withColumn("flag_qualidade", quality_flag(F.col("interpolado"), F.col("faltante")))


def gaps_sql(source: str, key: str = "usina_id", time: str = "timestamp_utc", value: str = "v", limit: int = 3,
             step: str = "HOUR", out: str = "limpa", kind: str = "TIMESTAMP") -> str:
    return f"""lim AS (SELECT {key}, min({time}) AS a, max({time}) AS z FROM {source} GROUP BY 1),
grade AS (SELECT {key}, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 {step}))::{kind} AS {time} FROM lim),
cheia AS (SELECT g.{key}, g.{time}, h.{value} AS v,
  row_number() OVER (PARTITION BY g.{key} ORDER BY g.{time}) AS i
  FROM grade g LEFT JOIN {source} h ON g.{key} = h.{key} AND g.{time} = h.{time}),
viz AS (SELECT *,
  last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w1 AS pi, last_value(v IGNORE NULLS) OVER w1 AS pv,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w2 AS ni, first_value(v IGNORE NULLS) OVER w2 AS nv
  FROM cheia WINDOW w1 AS (PARTITION BY {key} ORDER BY {time} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  w2 AS (PARTITION BY {key} ORDER BY {time} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
{out} AS (SELECT {key}, {time},
  CASE WHEN v IS NOT NULL THEN v WHEN ni - pi - 1 <= {limit} THEN pv + (nv - pv) * (i - pi)::DOUBLE / (ni - pi) END AS energia_mwh,
  CASE WHEN v IS NOT NULL THEN 'original' WHEN ni - pi - 1 <= {limit} THEN 'interpolado' ELSE 'faltante' END AS flag_qualidade
  FROM viz)"""


CLEAN = f"{HOURLY},\n{gaps_sql('horas')}"


def fact(spark: SparkSession, sf: str) -> DataFrame:
    return clean_hourly(spark, sf).join(dim(spark, sf).select("usina_id", "fonte", "regiao"), "usina_id").select(
        "usina_id", "timestamp_utc", "energia_mwh", "fonte", "regiao", "flag_qualidade")


FACT = f"""{DIM},
{CLEAN},
fato AS (SELECT usina_id, timestamp_utc, energia_mwh, fonte, regiao, flag_qualidade FROM limpa JOIN dim USING (usina_id))"""


# ------------------------------------------------------- one series per region
def regional_dim(spark: SparkSession, sf: str) -> DataFrame:
    d = dim(spark, sf).join(F.broadcast(table(spark, sf, "region")), F.col("regiao") == F.col("r_name"))
    return d.groupBy(F.col("r_regionkey").cast("long").alias("usina_id"), "regiao").agg(
        (F.sum("potencia_mw") / 100).alias("potencia_mw")).withColumn(
        "fonte", F.when(F.col("usina_id") <= 2, "solar").otherwise("eolica"))


def regional_hours(spark: SparkSession, sf: str) -> DataFrame:
    d = dim(spark, sf).select("usina_id", "regiao").join(
        F.broadcast(table(spark, sf, "region")), F.col("regiao") == F.col("r_name")).select(
        F.col("usina_id").alias("user"), F.col("r_regionkey").cast("long").alias("usina_id"))
    ev = table(spark, sf, "events").select("user_id", hour_of("ts").alias("timestamp_utc"), "value")
    part = ev.groupBy("user_id", "timestamp_utc").agg(F.sum("value").alias("value"))
    return part.join(d, part["user_id"] == d["user"]).groupBy("usina_id", "timestamp_utc").agg(
        F.sum("value").alias("energia_mwh"))


def regional_fact(spark: SparkSession, sf: str) -> DataFrame:
    full = grid.complete_grid(regional_hours(spark, sf), "usina_id", "timestamp_utc").drop("criada")
    full = grid.fill_short_gaps(full, "usina_id", "timestamp_utc", ["energia_mwh"], 3)
    full = full.withColumn("flag_qualidade", quality_flag(F.col("interpolado"), F.col("faltante")))
    return full.join(F.broadcast(regional_dim(spark, sf).select("usina_id", "fonte", "regiao")), "usina_id").select(
        "usina_id", "timestamp_utc", "energia_mwh", "fonte", "regiao", "flag_qualidade")


REGIONAL = f"""{DIM},
rdim AS (SELECT r_regionkey::BIGINT AS usina_id, regiao, sum(potencia_mw) / 100 AS potencia_mw,
  CASE WHEN r_regionkey <= 2 THEN 'solar' ELSE 'eolica' END AS fonte
  FROM dim JOIN region ON regiao = r_name GROUP BY r_regionkey, regiao),
rhoras AS (SELECT r_regionkey::BIGINT AS usina_id, date_trunc('hour', ts) AS timestamp_utc, sum(value) AS v
  FROM events JOIN dim ON user_id = dim.usina_id JOIN region ON regiao = r_name GROUP BY ALL),
{gaps_sql('rhoras', out='rlimpa')},
rfato AS (SELECT usina_id, timestamp_utc, energia_mwh, fonte, regiao, flag_qualidade FROM rlimpa JOIN rdim USING (usina_id))"""


# -------------------------------------------------------------------- climate
def points(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    return (s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_name").alias("local"), F.col("n_name").alias("id_estado"),
                    F.col("r_name").alias("id_subsistema"), k.alias("s_suppkey"),
                    (-32 + F.pmod(k * 71, F.lit(3700)) / 100).alias("latitude"),
                    (-72 + F.pmod(k * 97, F.lit(3700)) / 100).alias("longitude")))


POINTS = """pontos AS (SELECT s_name AS local, n_name AS id_estado, r_name AS id_subsistema, s_suppkey,
  -32 + (s_suppkey * 71 % 3700)::DOUBLE / 100 AS latitude, -72 + (s_suppkey * 97 % 3700)::DOUBLE / 100 AS longitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def daily_climate(spark: SparkSession, sf: str) -> DataFrame:
    """Point x day of January 2024, means of line items; wind above 30 counts as missing."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")), F.lit(30)).cast("int"))
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", day.alias("data")).agg(
        (F.avg("l_discount") * 50).alias("irradiancia_kwh_m2"), F.avg("l_quantity").alias("__w"),
        (F.avg("l_tax") * 400).alias("temperatura_c"))
    df = li.join(points(spark, sf), F.col("l_suppkey") == F.col("s_suppkey")).withColumn(
        "vento_ms", F.when(F.col("__w") <= 30, F.col("__w")))
    return df.select("local", "id_estado", "id_subsistema", "latitude", "longitude", "data", "irradiancia_kwh_m2",
                     "vento_ms", "temperatura_c").withColumn(
        "medidas_faltantes", missing_list(["irradiancia_kwh_m2", "vento_ms", "temperatura_c"]))


CLIMATE = f"""{POINTS},
clima AS (SELECT local, id_estado, id_subsistema, latitude, longitude, data, irradiancia_kwh_m2,
  CASE WHEN w <= 30 THEN w END AS vento_ms, temperatura_c, CASE WHEN w <= 30 THEN NULL ELSE 'vento_ms' END AS medidas_faltantes
  FROM (SELECT l_suppkey, (DATE '2024-01-01' + (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) % 30)::INTEGER)::DATE AS data,
    avg(l_discount) * 50 AS irradiancia_kwh_m2, avg(l_quantity) AS w, avg(l_tax) * 400 AS temperatura_c
    FROM lineitem GROUP BY ALL) JOIN pontos ON l_suppkey = s_suppkey)"""


# ------------------------------------------------------------------- survival
def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """Line items shipped after their order: days between, returned or not."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).filter(F.to_date("l_shipdate") > F.to_date("o_orderdate")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.datediff("l_shipdate", "o_orderdate").cast("double").alias("tempo"),
        (F.col("l_returnflag") == "R").cast("int").alias("evento"), F.col("l_linestatus").alias("fonte"),
        F.col("o_orderpriority").alias("grupo"), F.col("l_quantity").cast("double").alias("quantidade"),
        F.col("l_discount").cast("double").alias("desconto"), F.col("l_tax").cast("double").alias("imposto"),
        F.ln("l_extendedprice").alias("log_preco"),
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_quantity") > 25, "grande").otherwise("pequena")).alias("causa"))


COHORT = """coorte AS (SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS tempo,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS evento, l_linestatus AS fonte, o_orderpriority AS grupo,
  l_quantity AS quantidade, l_discount AS desconto, l_tax AS imposto, ln(l_extendedprice) AS log_preco,
  CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_quantity > 25 THEN 'grande' ELSE 'pequena' END END AS causa
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate::DATE > o_orderdate::DATE)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Error events per user as repeated events in days since the first event of the user."""
    from brisa.operators.recurrent import episodes
    ev = table(spark, sf, "events").select(
        F.col("user_id").cast("long").alias("id_usina"), F.col("event_type"), F.expr(
            f"timestampdiff(SECOND, {EPOCH}, ts)").cast("double").alias("s"))
    spans = ev.groupBy("id_usina").agg((F.min("s") / 86400).alias("a"), ((F.max("s") + 1) / 86400).alias("z"))
    errors = ev.filter("event_type = 'error'").select("id_usina", (F.col("s") / 86400).alias("t"))
    pts = spans.join(errors, "id_usina", "left")
    out = episodes(pts, "id_usina", "t", F.col("a"), F.col("z"))
    d = dim(spark, sf).select(F.col("usina_id").alias("id_usina"), F.when(F.col("regiao") < "B", "solar").otherwise(
        "eolica").alias("fonte"), F.coalesce("potencia_mw", F.lit(10.0)).alias("potencia_mw"), F.col("id_estado"))
    return out.join(d, "id_usina").withColumns({
        "log_potencia": F.ln("potencia_mw"), "tipo_s": (F.pmod("id_usina", F.lit(3)) == 0).cast("double")})


PANEL = f"""{DIM},
vida AS (SELECT user_id::BIGINT AS id_usina, min(epoch(date_trunc('second', ts))) / 86400 AS a,
  (max(epoch(date_trunc('second', ts))) + 1) / 86400 AS z FROM events GROUP BY 1),
falhas AS (SELECT DISTINCT user_id::BIGINT AS id_usina, epoch(date_trunc('second', ts)) / 86400 AS t FROM events WHERE event_type = 'error'),
paradas AS (SELECT f.id_usina, t, 1 AS evento FROM falhas f JOIN vida v ON f.id_usina = v.id_usina WHERE t > a AND t < z
  UNION ALL SELECT id_usina, z, 0 FROM vida),
episodios AS (SELECT p.id_usina, evento, p.t - a AS t_fim_anos,
  coalesce(lag(p.t) OVER w - a, a - a) AS t_inicio_anos, row_number() OVER w AS episodio
  FROM paradas p JOIN vida v ON p.id_usina = v.id_usina WINDOW w AS (PARTITION BY p.id_usina ORDER BY p.t)),
painel AS (SELECT e.*, CASE WHEN regiao < 'B' THEN 'solar' ELSE 'eolica' END AS fonte, coalesce(potencia_mw, 10.0) AS potencia_mw
  FROM episodios e JOIN dim ON e.id_usina = dim.usina_id)"""
