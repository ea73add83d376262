"""Sources, sinks and scalar functions on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brisa import constants as K
from brisa.functions import dates, numeric, quality, text
from brisa.operators.cleaning import bin_edges
from brisa.plans import adapters as A
from brisa.plans.adapters import rounded, table
from brisa.plans.registry import query
from brisa.session import shared_folder
from brisa.sources import readers, snapshots, writers


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/brisa-{uuid.uuid4().hex}"


# ------------------------------------------------------------------- sources
@query("SRC1", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def read_parquet_totals(spark, sf):
    df = readers.read_parquet(spark, f"{sf}/events.parquet")
    return rounded(df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 2, "total")


@query("SRC7 SNK1", "SELECT c_custkey, c_name, c_acctbal AS saldo FROM customer")
def csv_round_trip(spark, sf):
    """Customers saved as ';' text with Brazilian decimals and read back typed."""
    folder = _folder(spark)
    c = table(spark, sf, "customer")
    br = F.translate(F.format_string("%,.2f", "c_acctbal"), ",.", ".,")
    writers.save(c.select("c_custkey", "c_name", br.alias("saldo")), folder, "csv", sep=";")
    return readers.read_any(spark, folder, "csv", schema="c_custkey long, c_name string, saldo string", separator=";",
                            brazilian_numbers=["saldo"])


@query("SRC7 SNK1", "SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS dia FROM orders")
def json_round_trip(spark, sf):
    folder = _folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "dd/MM/yyyy").alias("dia"))
    writers.save(o, folder, "json")
    back = readers.read_any(spark, folder, "json", schema="o_orderkey long, o_orderstatus string, dia string", dates=["dia"])
    return back.withColumn("dia", F.date_format("dia", "yyyy-MM-dd"))


@query("SRC7", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def xml_round_trip(spark, sf):
    folder = _folder(spark)
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.format("xml").option(
        "rowTag", "row").save(folder)
    return readers.read_any(spark, folder, "xml", schema="s_suppkey long, s_name string, s_acctbal double")


@query("SRC8 WN12", """SELECT tabela, chave, nome, saldo FROM (
  SELECT 'customer' AS tabela, c_custkey AS chave, c_name AS nome, c_acctbal AS saldo FROM customer
  UNION ALL SELECT 'part', p_partkey, p_name, NULL FROM part)""")
def files_united_by_name(spark, sf):
    """Two folders with different columns read as one, each row with its file."""
    folder = _folder(spark)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("chave"), F.col("c_name").alias("nome"),
                                            F.col("c_acctbal").alias("saldo"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("chave"), F.col("p_name").alias("nome"))
    writers.save(c, f"{folder}/customer")
    writers.save(p, f"{folder}/part")
    both = readers.unite([readers.read_many(spark, f"{folder}/{n}/*.parquet", "parquet").withColumn("tabela", F.lit(n))
                          for n in ("customer", "part")])
    return both.filter(F.col("arquivo_origem").endswith(".parquet")).select("tabela", "chave", "nome", "saldo")


@query("SRC8 WN12", """SELECT n_nationkey AS chave, n_name AS nome, NULL AS saldo, n_regionkey AS regiao FROM nation
  UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer""")
def delimited_files_united_by_name(spark, sf):
    """Text files whose headers have other columns, in other orders."""
    folder = _folder(spark)
    frames = {"nation": ("n_regionkey AS regiao", "n_nationkey AS chave", "n_name AS nome"),
              "supplier": ("s_name AS nome", "s_acctbal AS saldo", "s_suppkey AS chave"),
              "customer": ("c_custkey AS chave", "c_nationkey AS regiao", "c_acctbal AS saldo", "c_name AS nome")}
    for name, columns in frames.items():
        writers.save(table(spark, sf, name).selectExpr(*columns), f"{folder}/{name}", "csv", sep="|")
    df = readers.read_many(spark, f"{folder}/*/*.csv", "csv", sep="|")
    return df.select(F.col("chave").cast("long"), "nome", F.col("saldo").cast("double"), F.col("regiao").cast("long"))


@query("SRC9", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def sql_query_source(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("brisa_orders")
    return readers.read_query(spark, "SELECT o_orderpriority, count(*) AS n FROM brisa_orders "
                              "WHERE o_orderstatus = 'F' GROUP BY 1")


@query("SRC10", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS r_k FROM events")
def nested_json_flat(spark, sf):
    """Property records of the events, one flat row each."""
    wrapped = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"resposta":{"itens":[{"r":'), F.col("props"),
                                                                     F.lit("}]}}")).alias("corpo"))
    return readers.parse_records(wrapped, "corpo", "resposta struct<itens: array<struct<r: struct<k: long>>>>",
                                 "resposta.itens", ["event_id"])


@query("SRC11", "SELECT event_id, user_id::VARCHAR AS local, event_type AS tempo, value AS valor, user_id::DOUBLE AS usuario FROM events")
def parameter_maps_to_rows(spark, sf):
    ev = table(spark, sf, "events")
    body = F.to_json(F.create_map(F.lit("valor"), F.create_map(F.col("event_type"), F.col("value")),
                                  F.lit("usuario"), F.create_map(F.col("event_type"), F.col("user_id").cast("double"))))
    return readers.parameter_maps(ev.select("event_id", F.col("user_id").cast("string").alias("local"), body.alias("corpo")),
                                  "corpo", ["valor", "usuario"], "tempo", ["event_id", "local"])


@query("SRC2 SRC3 SRC4 SRC5", """SELECT o_orderkey, o_orderstatus, strftime(m, '%Y-%m-%d') AS data_coleta
  FROM orders, (SELECT max(o_orderdate) AS m FROM orders)""")
def newest_snapshot(spark, sf):
    """Two dated snapshots of the orders; the second one is named by its own largest
    date and is the one that is found."""
    root = _folder(spark)
    o = table(spark, sf, "orders")
    snapshots.archive(o.filter("o_orderdate < '1998-01-01'"), root, "1997-12-31")
    snapshots.archive_by_content(o, root, "o_orderdate")
    if snapshots.archive_by_content(o, root, "o_orderdate") or len(snapshots.snapshots(spark, root)) != 2:
        raise AssertionError("a snapshot must be kept once")
    return snapshots.locate(spark, root).select("o_orderkey", "o_orderstatus", F.col("data_coleta").cast("string").alias("data_coleta"))


@query("SRC6 SNK2", """SELECT strftime(o_orderdate, '%Y-%m') AS ano_mes, count(*) AS n,
  round(sum(CASE WHEN o_orderdate >= '1998-01-01' THEN o_totalprice * 2 ELSE o_totalprice END), 1) AS total FROM orders GROUP BY 1""")
def monthly_reload(spark, sf):
    """All months loaded, then the months from 1998 on again with new values."""
    root = _folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    snapshots.load_months(o, root, "o_orderdate")
    snapshots.load_months(o.filter("o_orderdate >= '1998-01-01'").withColumn("o_totalprice", F.col("o_totalprice") * 2),
                          root, "o_orderdate")
    months = snapshots.read_months(spark, root).groupBy(F.col("ano_mes").cast("string").alias("ano_mes"))
    return rounded(months.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 1, "total")


@query("SRC6", """SELECT strftime(o_orderdate, '%Y-%m') AS ano_mes, count(*) AS n,
  round(sum(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1""")
def monthly_batches(spark, sf):
    """Orders of every month come in two overlapping streams of files; the second one has new
    values for some of the keys of the first."""
    from brisa.streaming.access_log import start_monthly_load
    folder = _folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    writers.save(o.filter("o_orderkey % 3 <> 0 or o_orderkey % 5 = 0"), f"{folder}/in/1")
    writers.save(o.filter("o_orderkey % 3 = 0 or o_orderkey % 5 = 0").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))), f"{folder}/in/2")
    for part in ("1", "2"):
        stream = spark.readStream.schema(o.schema).parquet(f"{folder}/in/{part}")
        start_monthly_load(stream, f"{folder}/months", "o_orderdate", f"{folder}/state{part}", ["o_orderkey"]).awaitTermination()
    months = snapshots.read_months(spark, f"{folder}/months").groupBy(F.col("ano_mes").cast("string").alias("ano_mes"))
    return rounded(months.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2, "total")


@query("SNK3 SRC12", "SELECT n_name AS nome, count(*) AS clientes FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def published_set(spark, sf):
    """Two tables published together and read through the pointer."""
    readers.require_inputs(spark, {n: f"{sf}/{n}.parquet" for n in ("customer", "nation")}, "the table build")
    root = _folder(spark)

    def check(written):
        if written["customer"].join(written["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").count():
            raise ValueError("customers without a nation")
    writers.publish({n: table(spark, sf, n) for n in ("customer", "nation")}, root, check)
    got = writers.published(spark, root)
    return got["customer"].join(got["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("nome")).agg(F.count(F.lit(1)).alias("clientes"))


@query("SNK4", """SELECT user_id::BIGINT AS usina_id, ts AS t, value::DOUBLE AS energia_mwh, event_type AS fonte,
  'x' AS regiao, 'original' AS flag_qualidade FROM (SELECT user_id, CAST(ts AS VARCHAR) AS ts, value, event_type FROM events)""")
def typed_load(spark, sf):
    """Text columns cast to the declared type in the declared order."""
    from brisa.schemas import FATO_GERACAO, typed
    raw = table(spark, sf, "events").select(
        F.lit("x").alias("regiao"), F.col("event_type").alias("fonte"), F.lit("original").alias("flag_qualidade"),
        F.col("value").cast("string").alias("energia_mwh"), F.col("ts").cast("string").alias("timestamp_utc"),
        F.col("user_id").cast("string").alias("usina_id"))
    return typed(raw, FATO_GERACAO).withColumn("t", F.col("timestamp_utc").cast("string")).drop("timestamp_utc")


# ----------------------------------------------------------------- functions
@query("FN1 FN2", "SELECT c_custkey AS codigo_cliente, c_acctbal AS saldo_r, c_acctbal * 2 AS saldo_r_2, c_nationkey AS col_2024_n FROM customer")
def clean_column_names(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Código-Cliente "), F.col("c_acctbal").alias("Saldo (R$)"),
        (F.col("c_acctbal") * 2).alias("SALDO r"), F.col("c_nationkey").alias("2024 Nº".replace("º", "")), F.col("c_name").alias("Nome"))
    return text.rename_and_drop(text.rename_clean(c), {}, ["nome"])


@query("FN3", """SELECT doc_id, CASE WHEN trim(t) IN ('', 'en') THEN NULL ELSE trim(t) END AS lingua
  FROM (SELECT doc_id, '  ' || lang || ' ' AS t FROM documents)""")
def trimmed_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("  "), "lang", F.lit(" ")).alias("lingua"))
    return text.clean_texts(d, ["lingua"], ("", "en"))


@query("FN4", "SELECT p_partkey, p_retailprice AS preco, NULL::DOUBLE AS ruim FROM part")
def numbers_from_text(spark, sf):
    br = F.concat(F.lit("R$ "), F.translate(F.format_string("%,.2f", "p_retailprice"), ",.", ".,"))
    p = table(spark, sf, "part").select("p_partkey", br.alias("preco"), F.col("p_name").alias("ruim"))
    return text.convert_types(p, ["preco", "ruim"])


@query("FN5", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, NULL::VARCHAR AS c FROM orders")
def dates_from_text(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("a"),
                                          F.date_format("o_orderdate", "yyyyMMdd").alias("b"), F.col("o_orderpriority").alias("c"))
    o = o.withColumns({"a": text.to_date_time(F.col("a")), "b": text.to_date_time(F.col("b"), "yyyyMMdd"),
                       "c": text.to_date_time(F.col("c"))})
    return o.withColumns({x: F.date_format(x, "yyyy-MM-dd") for x in "abc"})


@query("FN6", "SELECT o_orderkey, o_totalprice AS numero, strftime(o_orderdate, '%Y-%m-%d') AS data, o_orderpriority AS texto FROM orders")
def detected_types(spark, sf):
    br = F.translate(F.format_string("%,.2f", "o_totalprice"), ",.", ".,")
    o = table(spark, sf, "orders").select("o_orderkey", br.alias("numero"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("data"),
                                          F.col("o_orderpriority").alias("texto"))
    return text.detect_types(o).withColumn("data", F.date_format("data", "yyyy-MM-dd"))


_SPACES = r"trim(regexp_replace(regexp_replace(text, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g'), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))"
_ASCII = r"regexp_replace(strip_accents({}), '[^\x00-\x7F]', '', 'g')"


@query("FN7 FN8", f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace({_ASCII.format(f'lower({_SPACES})')},
  '[^a-zA-Z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS chave FROM documents""")
def name_keys(spark, sf):
    """Comparison key over whole texts, given by its digest."""
    return table(spark, sf, "documents").select("doc_id", F.md5(text.name_key(F.col("text"))).alias("chave"))


@query("FN7", """SELECT p_partkey, CASE p_name WHEN 'small ring' THEN 'anel' ELSE array_to_string(list_transform(string_split(p_name, ' '),
  lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS nome FROM (SELECT p_partkey, p_name FROM part)""")
def standard_values(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), F.upper("p_name")).alias("nome"))
    return p.withColumn("nome", text.standardise(F.col("nome"), lower=True, accents=True, title=True,
                                                 replacements={"Small Ring": "anel"}))


@query("FN9", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')),
  '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM documents""")
def slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.slug(F.col("text"))).alias("slug"))


@query("FN10", """SELECT c_custkey, 'São ' || c_name || ' - x' AS nome, 'BA' AS uf FROM customer""")
def first_place_of_list(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" São "), "c_name", F.lit(" - x - BA , "), "c_mktsegment", F.lit(" - RN")).alias("l"))
    name, state = text.split_place(text.first_of_list(F.col("l")))
    return c.select("c_custkey", name.alias("nome"), state.alias("uf"))


@query("FN11 FN13", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE 'EOL.CV.' || c_custkey || '-0' END AS base,
  CASE WHEN c_acctbal > 0 THEN c_name ELSE 'PQU|' || c_name || '|' || c_mktsegment END AS chave FROM customer""")
def code_base_and_key(spark, sf):
    c = table(spark, sf, "customer")
    code = F.when(F.pmod("c_custkey", F.lit(5)) == 0, F.col("c_name")).otherwise(
        F.concat(F.lit("EOL.CV."), F.col("c_custkey").cast("string"), F.lit("-0."), F.pmod("c_custkey", F.lit(99)).cast("string")))
    return c.select("c_custkey", text.base_code(code).alias("base"), text.natural_key(
        F.when(F.col("c_acctbal") > 0, F.col("c_name")), F.col("c_name"), F.col("c_mktsegment")).alias("chave"))


@query("FN12", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fechado' WHEN 'O' THEN 'aberto' ELSE 'outro' END AS estado FROM orders""")
def mapped_codes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.map_code(
        F.col("o_orderstatus"), {"F": "fechado", "O": "aberto"}, "outro").alias("estado"))


@query("FN14 FN15", f"""WITH {A.POINTS}, b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN DATE '1900-01-03'
    WHEN s_suppkey % 7 = 1 THEN DATE '1985-01-01' ELSE DATE '2015-06-01' END AS inicio,
  CASE WHEN s_suppkey % 6 = 0 THEN 0 WHEN s_suppkey % 6 = 1 THEN latitude + 40 WHEN s_suppkey % 6 = 2 THEN NULL ELSE latitude END AS lat,
  CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE longitude END AS lon FROM pontos)
  SELECT s_suppkey, CASE WHEN inicio = DATE '1900-01-03' THEN 'sentinela_1900' WHEN inicio < DATE '1990-01-01' THEN 'implausivel_pre_1990' END AS flag_data,
  CASE WHEN lat = 0 AND lon = 0 THEN 'zerada' WHEN NOT coalesce(lat BETWEEN -34 AND 5.5 AND lon BETWEEN -74 AND -34, false)
    THEN 'fora_do_brasil' END AS flag_coordenada FROM b""")
def doubtful_dates_and_places(spark, sf):
    k = F.col("s_suppkey")
    b = A.points(spark, sf).select(
        k, F.when(F.pmod(k, F.lit(7)) == 0, "1900-01-03").when(F.pmod(k, F.lit(7)) == 1, "1985-01-01").otherwise("2015-06-01").cast("date").alias("inicio"),
        F.when(F.pmod(k, F.lit(6)) == 0, 0.0).when(F.pmod(k, F.lit(6)) == 1, F.col("latitude") + 40).when(
            F.pmod(k, F.lit(6)) == 2, None).otherwise(F.col("latitude")).alias("lat"),
        F.when(F.pmod(k, F.lit(6)) == 0, 0.0).otherwise(F.col("longitude")).alias("lon"))
    return b.select("s_suppkey", quality.date_reason(F.col("inicio")).alias("flag_data"),
                    quality.coordinate_reason(F.col("lat"), F.col("lon")).alias("flag_coordenada"))


@query("FN16 FN17 FN18", """WITH b AS (SELECT c_custkey, CASE WHEN c_nationkey < 3 THEN NULL ELSE c_acctbal END AS saldo,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_nationkey::DOUBLE END AS nacao FROM customer)
  SELECT c_custkey, CASE WHEN saldo < 0 THEN 0.0 ELSE saldo END AS saldo, CASE WHEN saldo < 0 THEN 'negativo_zerado' END AS motivo, nacao,
  nullif(concat_ws(',', CASE WHEN saldo IS NULL THEN 'saldo' END, CASE WHEN nacao IS NULL THEN 'nacao' END), '') AS faltantes FROM b""")
def fill_values_and_missing_list(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") < 3, -999.0).otherwise(F.col("c_acctbal")).alias("saldo"),
        F.when(F.col("c_mktsegment") == "FURNITURE", -999.0).otherwise(F.col("c_nationkey").cast("double")).alias("nacao"))
    c = quality.fill_to_null(c, ["saldo", "nacao"])
    value, reason = quality.clip_negative(F.col("saldo"))
    return c.withColumn("motivo", reason).withColumn("saldo", value).withColumn("faltantes", quality.missing_list(["saldo", "nacao"]))


def _zone_sql(name, days):
    return f"""{name} AS (SELECT event_id, CASE WHEN volta = l AND depois <> l AND antes <> l THEN date_trunc('second', u) END AS utc, l FROM (
  SELECT *, u AT TIME ZONE 'UTC' AT TIME ZONE 'America/Sao_Paulo' AS volta,
    (u + INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Sao_Paulo' AS depois,
    (u - INTERVAL 1 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Sao_Paulo' AS antes FROM (
  SELECT event_id, ts - INTERVAL {days} DAY AS l, (ts - INTERVAL {days} DAY) AT TIME ZONE 'America/Sao_Paulo' AT TIME ZONE 'UTC' AS u FROM events)))"""


@query("FN20 FN21", f"""WITH {_zone_sql('a', 2270)}, {_zone_sql('b', 2150)}
  SELECT event_id, CAST(a.utc AS VARCHAR) AS utc_inicio, CAST(b.utc AS VARCHAR) AS utc_fim,
  CAST(CAST(a.l AT TIME ZONE 'UTC' AT TIME ZONE 'America/Sao_Paulo' AS DATE) AS VARCHAR) AS dia_local FROM a JOIN b USING (event_id)""")
def local_time_to_utc(spark, sf):
    """Event times moved to the start (2017) and the end (2018) of a summer time:
    an hour that never was and an hour that was twice give null."""
    e = table(spark, sf, "events")
    first, last = F.col("ts") - F.expr("INTERVAL 2270 DAY"), F.col("ts") - F.expr("INTERVAL 2150 DAY")
    show = lambda c: F.date_format(dates.local_to_utc(c), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", show(first).alias("utc_inicio"), show(last).alias("utc_fim"),
                    dates.local_day(first).cast("string").alias("dia_local"))


@query("FN22", f"""WITH {A.DIM} SELECT usina_id, round(2 * 6371 * asin(least(1, sqrt(pow(sin((radians(-12.5) - radians(lat)) / 2), 2)
  + cos(radians(lat)) * cos(radians(-12.5)) * pow(sin((radians(-45.0) - radians(lon)) / 2), 2)))), 4) AS km FROM dim WHERE lat IS NOT NULL""")
def haversine_distance(spark, sf):
    d = A.dim(spark, sf).filter("lat is not null")
    return d.select("usina_id", F.round(numeric.haversine_km(F.col("lat"), F.col("lon"), F.lit(-12.5), F.lit(-45.0)), 4).alias("km"))


@query("FN23 FN24", """SELECT event_id, year(ts) AS ts_ano, month(ts) AS ts_mes, day(ts) AS ts_dia, isodow(ts) - 1 AS ts_dia_semana,
  dayofyear(ts) AS ts_dia_ano, weekofyear(ts) AS ts_semana, quarter(ts) AS ts_trimestre, hour(ts) AS ts_hora, minute(ts) AS ts_minuto,
  (isodow(ts) >= 6)::INTEGER AS ts_fim_de_semana, (day(ts) = 1)::INTEGER AS ts_inicio_mes, (ts::DATE = last_day(ts::DATE))::INTEGER AS ts_fim_mes,
  round(sin(2 * pi() * month(ts) / 12.0), 6) + 0.0 AS ts_mes_sen, round(cos(2 * pi() * month(ts) / 12.0), 6) + 0.0 AS ts_mes_cos,
  round(sin(2 * pi() * (isodow(ts) - 1) / 7.0), 6) + 0.0 AS ts_dia_semana_sen, round(cos(2 * pi() * (isodow(ts) - 1) / 7.0), 6) + 0.0 AS ts_dia_semana_cos,
  round(sin(2 * pi() * hour(ts) / 24.0), 6) + 0.0 AS ts_hora_sen, round(cos(2 * pi() * hour(ts) / 24.0), 6) + 0.0 AS ts_hora_cos FROM events""")
def calendar_features(spark, sf):
    df = dates.calendar_features(table(spark, sf, "events").select("event_id", "ts"), "ts", cyclic=True).drop("ts")
    cycles = [c for c in df.columns if c.endswith(("_sen", "_cos"))]
    ints = [c for c in df.columns if c not in (*cycles, "event_id")]
    df = df.withColumns({c: F.round(c, 6) + 0.0 for c in cycles})
    return df.withColumns({c: F.col(c).cast("long") for c in ints})


@query("FN25", """SELECT l_orderkey, l_linenumber, greatest(date_diff('day', o_orderdate::DATE, l_shipdate::DATE), 1) AS dias,
  round(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 30.44, 6) AS meses,
  greatest(round_even((l_quantity / 100.0) * 365.25, 0), 1)::BIGINT AS de_anos FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def durations(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        "l_orderkey", "l_linenumber", dates.days_between(F.to_date("o_orderdate"), F.to_date("l_shipdate")).alias("dias"),
        F.round(dates.duration(F.to_date("o_orderdate"), F.to_date("l_shipdate"), "meses"), 6).alias("meses"),
        dates.years_to_days(F.col("l_quantity") / 100).alias("de_anos"))


@query("FN26 FN34", f"""WITH {A.DIM}, b AS (SELECT usina_id, round(ln(coalesce(potencia_mw, 1)) - ln(30), 6) AS log_potencia_mw_c,
  (regiao = 'ASIA')::INTEGER::DOUBLE AS subsistema_NE, (regiao = 'EUROPE')::INTEGER::DOUBLE AS subsistema_S, (regiao = 'AFRICA')::INTEGER::DOUBLE AS subsistema_N,
  (year(data_operacao) - 2018)::DOUBLE AS ano_entrada_c, potencia_mw FROM dim)
  SELECT usina_id, log_potencia_mw_c, subsistema_NE, subsistema_S, subsistema_N, ano_entrada_c,
  round(coalesce(potencia_mw - 30, 0) * 0.02 + coalesce(ano_entrada_c, 0) * -0.1, 6) AS escore FROM b""")
def model_covariates(spark, sf):
    sub = text.map_code(F.col("regiao"), {"ASIA": "NE", "EUROPE": "S", "AFRICA": "N"}, "SE")
    d = A.dim(spark, sf).withColumn("sub", sub).withColumn("p", F.coalesce("potencia_mw", F.lit(1.0)))
    d = numeric.model_covariates(d, "p", "sub", "data_operacao")
    score = numeric.linear_score({"potencia_mw": (30.0, 0.02), "ano_entrada_c": (0.0, -0.1)})
    return rounded(d.select("usina_id", *K.MODEL_COVARIATES, score.alias("escore")), 6, "log_potencia_mw_c", "escore")


@query("FN27", """WITH q AS (SELECT quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) AS e, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice <= e[2] THEN 1 WHEN l_extendedprice <= e[3] THEN 2
    WHEN l_extendedprice <= e[4] THEN 3 ELSE 4 END AS quartil,
  CASE WHEN l_quantity <= lo + (hi - lo) / 4 THEN 1 WHEN l_quantity <= lo + (hi - lo) * 2 / 4 THEN 2 WHEN l_quantity <= lo + (hi - lo) * 3 / 4 THEN 3 ELSE 4 END AS largura,
  CASE WHEN l_discount BETWEEN 0 AND 0.03 THEN 'baixo' WHEN l_discount > 0.03 AND l_discount <= 0.07 THEN 'medio' END AS corte FROM lineitem, q""")
def value_bins(spark, sf):
    li = table(spark, sf, "lineitem")
    by_count = bin_edges(li, "l_extendedprice", "quantil", 4)
    by_width = bin_edges(li, "l_quantity", "largura", 4)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", numeric.bin_of(F.col("l_extendedprice"), by_count).alias("quartil"),
                     numeric.bin_of(F.col("l_quantity"), by_width).alias("largura"),
                     numeric.bin_of(F.col("l_discount"), [0.0, 0.03, 0.07], ["baixo", "medio"]).alias("corte"))


@query("FN28", r"""SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower('CONJUNTO ' || p_name || ' ' || p_type || ' 230 KV'),
  '\b\d+\s*kv\b', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('conjunto', 'solar') AND w <> ''), ' ') AS nucleo FROM part""")
def core_names(spark, sf):
    name = F.lower(F.concat(F.lit("CONJUNTO "), "p_name", F.lit(" "), "p_type", F.lit(" 230 KV")))
    return table(spark, sf, "part").select("p_partkey", text.core_name(name).alias("nucleo"))


@query("FN29", "SELECT count(*) AS linhas, min(l_quantity) AS menor FROM lineitem")
def row_rules_hold(spark, sf):
    li = table(spark, sf, "lineitem")
    quality.check_rows(li, {"quantidade": F.col("l_quantity") <= 0, "desconto": ~F.col("l_discount").between(0, 1)})
    return li.agg(F.count(F.lit(1)).alias("linhas"), F.min("l_quantity").alias("menor"))


@query("FN30", f"""WITH {A.DIM} SELECT usina_id, nome FROM dim WHERE tipo_unidade = 'usina' AND fonte IN ('BUILDING', 'MACHINERY')
  AND potencia_mw >= 1 AND data_operacao >= DATE '2012-01-01' AND data_operacao < DATE '2019-06-01' AND regiao <> 'ASIA'""")
def eligible_units(spark, sf):
    d = A.dim(spark, sf).withColumn("id_subsistema", F.when(F.col("regiao") != "ASIA", F.col("regiao")))
    return d.filter((F.col("tipo_unidade") == "usina") & F.col("fonte").isin("BUILDING", "MACHINERY") & (F.col("potencia_mw") >= 1)
                    & (F.col("data_operacao") >= "2012-01-01") & (F.col("data_operacao") < "2019-06-01")
                    & F.col("id_subsistema").isNotNull()).select("usina_id", "nome")


@query("FN31 FN32 FN33", """SELECT event_id, event_type FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-21' AND event_type = 'click'""")
def date_window_filter(spark, sf):
    from brisa.operators.serving import where
    dates.check_window("2024-01-05", "2024-01-20")
    e = table(spark, sf, "events").filter(dates.in_days(F.col("ts"), "2024-01-05", "2024-01-20"))
    return where(e, {"event_type": "click", "user_id": None}).select("event_id", "event_type")


