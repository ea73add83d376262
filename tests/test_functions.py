import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from brisa.functions import dates, numeric, quality, special, text
from brisa.operators import cleaning, joins, serving
from brisa.sources import readers, snapshots


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def test_column_names():
    assert text.clean_column_names(["Ângulo (graus)", "angulo  graus", "3x4", "", " ", "Já%Não"]) == \
        ["angulo_graus", "angulo_graus_2", "col_3x4", "coluna_sem_nome", "coluna_sem_nome_2", "ja_nao"]


@pytest.mark.parametrize("raw,want", [("R$ 98.765.432,10", 98765432.10), ("-0,5", -0.5), ("77,25 %", 77.25), ("n/d", None),
                                      ("   ", None), ("4,5,6", None), ("8kg", None), ("2.500,00", 2500.0)])
def test_numbers(spark, raw, want):
    assert one(spark, raw, text.to_number) == want


@pytest.mark.parametrize("raw,want", [("09/11/2021", datetime(2021, 11, 9)), ("2021-11-09", datetime(2021, 11, 9)),
                                      ("2021-11-09 23:59:58", datetime(2021, 11, 9, 23, 59, 58)), ("30/02/2021", None), ("ontem", None)])
def test_day_first(spark, raw, want):
    assert one(spark, raw, text.to_date_time) == want


def test_names(spark):
    assert one(spark, "\tÓbidos-7   Três\n Irmãos ", text.name_key) == "obidos7 tres irmaos"
    assert one(spark, "Pau d'Óleo & Cia / AL", text.slug) == "pau_d_oleo_cia_al"
    assert one(spark, "poço d'anta", lambda c: text.standardise(c, title=True)) == "Poço D'Anta"
    assert one(spark, "EOL.CV.PB.061616-4.02", text.base_code) == "EOL.CV.PB.061616-4"
    assert one(spark, "nada", text.base_code) == "nada"
    assert one(spark, None, lambda c: text.natural_key(c, F.lit(None).cast("string"), F.lit("PB"))) is None


def test_places(spark):
    name, state = text.split_place(text.first_of_list(F.col("x")))
    row = spark.createDataFrame([("Ponte - Alta - TO, Nova - GO, Velha - MG",)], "x string").select(name, state).first()
    assert tuple(row) == ("Ponte - Alta", "TO")


def test_zone(spark):
    day = lambda s: one(spark, datetime.fromisoformat(s), dates.local_to_utc, "timestamp_ntz")
    assert day("2023-01-31 21:00:00") == datetime(2023, 2, 1, 0)
    assert day("2016-10-16 00:10:00") is None          # never was
    assert day("2017-02-18 23:59:59") is None          # was twice
    assert day("2017-02-19 00:00:00") == datetime(2017, 2, 19, 3)


def test_days(spark):
    assert one(spark, 10.0, dates.years_to_days, "double") == 3652
    assert one(spark, 0.001, dates.years_to_days, "double") == 1
    with pytest.raises(ValueError, match="151"):
        dates.check_window("2022-03-01", "2022-07-30")
    with pytest.raises(ValueError):
        dates.check_window("2022-03-02", "2022-03-01")


def test_reasons(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, -40.0), (None, -40.0), (-34.0, -74.0)], "a double, o double")
    got = [r[0] for r in df.select(quality.coordinate_reason(F.col("a"), F.col("o"))).collect()]
    assert got == ["zerada", "fora_do_brasil", "fora_do_brasil", None]


def test_normal_and_gamma_family(spark):
    xs = [-9.0, -3.2, -0.5, 0.0, 0.7, 2.5, 7.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, got in zip(xs, [r[0] for r in df.select(numeric.normal_cdf(F.col("x"))).collect()]):
        assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-9)
    for a, d in ((5.0, 3), (400.0, 200), (200.0, 200), (1e6, 300)):
        row = spark.createDataFrame([(a, d)], "a double, d long").select(
            special.sum_inverse(F.col("a"), F.col("d")), special.sum_inverse_square(F.col("a"), F.col("d")),
            special.sum_log(F.col("a"), F.col("d"))).first()
        assert row[0] == pytest.approx(sum(1 / (a - i) for i in range(d)), rel=1e-8)
        assert row[1] == pytest.approx(sum(1 / (a - i) ** 2 for i in range(d)), rel=1e-6)
        assert row[2] == pytest.approx(sum(math.log(a - i) for i in range(d)), rel=1e-9)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (1, 3, None)], "k int, o int, v string")
    pick = lambda keep: {(r["k"], r["v"]) for r in cleaning.deduplicate(df, ["k"], ["o"], keep).collect()}
    assert pick("last") == {(1, None), (2, "c")} and pick("first") == {(1, "a"), (2, "c")} and pick("none") == {(2, "c")}
    with pytest.raises(ValueError, match="share"):
        cleaning.require_unique(df, ["k"])


def test_safe_join(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(None, "p"), (2, "q")], "k int, v string")
    got = {tuple(r) for r in joins.safe_join(a, b, "k", "outer").select("k", "v", "v_dir").collect()}
    assert got == {(1, "x", None), (None, "y", "p"), (2, None, "q")}
    with pytest.raises(ValueError):
        joins.safe_join(a, b.unionByName(b), "k", validate="many_to_one")


def test_nearest_by_cells_equals_brute_force(spark):
    import random
    rnd = random.Random(1)
    spots = [(i, rnd.uniform(-60, 60), rnd.uniform(-180, 180)) for i in range(200)] + [(999, -10.0, 179.9)]
    pts = [(f"p{i:03d}", rnd.gauss(-10, 0.01), rnd.gauss(-40, 0.01)) for i in range(150)] + \
          [(f"q{i}", rnd.uniform(-60, 60), rnd.uniform(-180, 180)) for i in range(30)] + [("west", -10.0, -179.9)]
    u = spark.createDataFrame(spots, "usina_id long, lat double, lon double")
    p = spark.createDataFrame(pts, "local string, latitude double, longitude double")
    pick = lambda df: {r["usina_id"]: (r["local"], round(r["distancia_km"], 6)) for r in df.collect()}
    a = pick(joins.nearest_point(u, p, "usina_id", "local"))
    b = pick(joins.nearest_point(u, p, "usina_id", "local", broadcast_limit=0))
    assert a == b and a[999][0] == "west" and len(a) == 201


def test_snapshot_changes(spark):
    a = spark.createDataFrame([("1", "Construção"), ("2", "Operação")], "ceg string, fase string")
    b = spark.createDataFrame([("1", "Operação"), ("2", "Operação"), ("3", "Construção")], "ceg string, fase string")
    got = {tuple(r) for r in joins.snapshot_changes(a, b, "ceg", "fase").collect()}
    assert got == {("1", "Construção", "Operação"), ("3", "(não cadastrada)", "Construção")}
    assert joins.snapshot_changes(b, b, "ceg", "fase").count() == 0


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "raw")
    df = spark.createDataFrame([("2026-07-01", 1), ("2026-07-04", 2)], "d string, v int")
    assert snapshots.archive_by_content(df, root, "d") and not snapshots.archive_by_content(df, root, "d")
    snapshots.archive(df.limit(1), root, date(2026, 6, 1))
    assert snapshots.snapshots(spark, root) == ["2026-06-01", "2026-07-04"]
    assert snapshots.locate(spark, root).count() == 2 and snapshots.locate(spark, root, "2026-06-01").count() == 1
    with pytest.raises(FileNotFoundError):
        snapshots.locate(spark, root, "2020-01-01")
    with pytest.raises(FileNotFoundError, match="b"):
        readers.require_inputs(spark, {"a": root, "b": str(tmp_path / "none")}, "the raw step")
    with pytest.raises(FileNotFoundError):
        readers.read_parquet(spark, str(tmp_path / "none"))


def test_pages_and_units(spark):
    dim = spark.range(1, 8).selectExpr("id as usina_id", "concat('u', id) as nome", "if(id % 2 = 0, 'solar', 'eolica') as fonte")
    seen, after = [], None
    while True:
        rows, after, total = serving.page(dim, 2, after, source="eolica")
        seen += [r["usina_id"] for r in rows]
        assert total == 4
        if after is None:
            break
    assert seen == [1, 3, 5, 7]
    with pytest.raises(LookupError):
        serving.find_unit(dim, 99)


def test_views_on_two_units(spark):
    rows = [(u, datetime(2026, 7, 1 + (h + 3) // 24, (h + 3) % 24), None if (u, h) == (2, 5) else 0.5, "solar", "NE",
             "faltante" if (u, h) == (2, 5) else "original") for u in (1, 2) for h in range(48)]
    fact = spark.createDataFrame(rows, "usina_id long, timestamp_utc timestamp_ntz, energia_mwh double, fonte string, regiao string, "
                                 "flag_qualidade string")
    dim = spark.createDataFrame([(1, "solar", "NE", 1.0), (2, "solar", "NE", None)], "usina_id long, fonte string, regiao string, potencia_mw double")
    clima = spark.createDataFrame([(1, date(2026, 7, 1), 5.0, 6.0, 25.0)], "usina_id long, data date, irradiancia_kwh_m2 double, vento_ms double, temperatura_c double")
    days = {(r["usina_id"], r["dia"].day): (r["energia_mwh"], r["horas_validas"]) for r in serving.daily_generation(fact).collect()}
    assert days == {(1, 1): (12.0, 24), (1, 2): (12.0, 24), (2, 1): (11.5, 23), (2, 2): (12.0, 24)}
    cf = {r["dia"].day: (r["fator_capacidade"], r["vento_ms"]) for r in serving.capacity_factor(fact, dim, clima).collect()}
    assert cf == {1: (0.5, 6.0), 2: (0.5, None)}
    hour = serving.national_hourly(fact).filter("hour(timestamp_utc) = 3 and day(timestamp_utc) = 1").first()
    assert (hour["energia_mwh"], hour["usinas"]) == (1.0, 2)


def test_access_counts_on_a_stream(spark, tmp_path):
    from brisa.streaming.access_log import running_counts, start_counts
    log = spark.createDataFrame([("GET", "/a", 200, 4.0), ("GET", "/a", 200, 80.0), ("GET", "/b", 404, 2000.0)],
                                "metodo string, rota string, status int, latencia_ms double")
    log.write.parquet(str(tmp_path / "log"))
    want = {tuple(r) for r in running_counts(log).collect()}
    q = start_counts(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), str(tmp_path / "ck"), "contagens_teste")
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("contagens_teste").collect()} == want


def test_two_batches_of_one_month_keep_both(spark, tmp_path):
    """A month that comes in two triggers keeps the rows of both; running a batch again adds nothing."""
    from brisa.streaming.access_log import start_monthly_load
    root, rows = str(tmp_path / "months"), "quando timestamp, valor int"
    for k, values in enumerate(([(datetime(2022, 5, 3), 1), (datetime(2022, 6, 1), 2)], [(datetime(2022, 5, 9), 3)], [(datetime(2022, 5, 9), 3)])):
        folder = str(tmp_path / f"in{k}")
        spark.createDataFrame(values, rows).write.parquet(folder)
        start_monthly_load(spark.readStream.schema(rows).parquet(folder), root, "quando", str(tmp_path / f"state{k}")).awaitTermination()
    got = snapshots.read_months(spark, root)
    assert sorted((str(r["ano_mes"]), r["valor"]) for r in got.collect()) == [("2022-05", 1), ("2022-05", 3), ("2022-06", 2)]


def test_equal_rows_of_a_month_stay(spark, tmp_path):
    root, rows = str(tmp_path / "months"), "quando timestamp, valor int"
    day = datetime(2022, 5, 3)
    df = spark.createDataFrame([(day, 1), (day, 1), (day, None), (day, 2)], rows)
    for _ in range(2):
        snapshots.add_to_months(df, root, "quando")
    snapshots.add_to_months(spark.createDataFrame([(day, 2), (day, 1)], rows), root, "quando")
    assert sorted(str(r["valor"]) for r in snapshots.read_months(spark, root).collect()) == ["1", "1", "2", "None"]


def test_batches_are_added_exactly_once(spark, tmp_path):
    root, rows = str(tmp_path / "batches"), "id int, quando timestamp, valor int"
    may, june = datetime(2022, 5, 3), datetime(2022, 6, 1)
    batches = [[(1, may, 1), (1, may, 1), (2, june, 5)], [(1, may, 7), (3, may, 2)], [(2, june, 6)]]
    add = lambda k: snapshots.append_batch(spark.createDataFrame(batches[k], rows), root, "quando", k)
    got = lambda key=None: sorted((r["id"], r["ano_mes"], r["valor"]) for r in snapshots.read_batches(spark, root, key).collect())
    for k in (0, 1, 1, 0):
        add(k)
    first = [(1, "2022-05", 1), (1, "2022-05", 1), (1, "2022-05", 7), (2, "2022-06", 5), (3, "2022-05", 2)]
    assert got() == first and got(["id"]) == [(1, "2022-05", 7), (2, "2022-06", 5), (3, "2022-05", 2)]
    before = sorted(str(p) for p in (tmp_path / "batches" / "ano_mes=2022-05").rglob("*.parquet"))
    snapshots.compact_months(spark, root, ["2022-05", "2022-06"])
    add(1)
    add(2)
    assert got() == sorted([*first, (2, "2022-06", 6)]) and set(before) <= {str(p) for p in (tmp_path / "batches" / "ano_mes=2022-05").rglob("*.parquet")}
    snapshots.compact_months(spark, root, ["2022-05", "2022-06"])
    assert got() == sorted([*first, (2, "2022-06", 6)])


def test_delimited_files_are_united_by_their_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,nome,saldo\n1,rita,7\n")
    (tmp_path / "b.csv").write_text("saldo,id,extra,nome\n9,2,sim,caio\n")
    (tmp_path / "c.csv").write_text("")
    got = readers.read_many(spark, str(tmp_path / "[ab].csv"), "csv")
    want = [("1", "rita", "7", None, "a.csv"), ("2", "caio", "9", "sim", "b.csv")]
    pick = lambda df: sorted(tuple(r[c] for c in ("id", "nome", "saldo", "extra", "arquivo_origem")) for r in df.collect())
    assert pick(got) == want
    with pytest.raises(ValueError, match="c.csv"):
        readers.read_many(spark, str(tmp_path / "*.csv"), "csv")
    with pytest.warns(UserWarning, match="c.csv"):
        assert pick(readers.read_many(spark, str(tmp_path / "*.csv"), "csv", skip_bad=True)) == want


def test_gamma_curve_at_large_shapes():
    from brisa.operators.stats import _gamma_large, _gamma_series
    import numpy as np
    for shape in (1e2, 1e3, 1e4):
        x = shape * np.array([0.8, 0.95, 0.999, 1.0, 1.001, 1.04, 1.06, 1.3])
        assert np.allclose(_gamma_large(x, shape), _gamma_series(x, shape), atol=2e-6 if shape < 1e3 else 1e-8)
    for shape in (1e5, 1e6, 1e7):
        assert _gamma_large(np.array([shape]), shape)[0] == pytest.approx(0.5 + 1 / (3 * math.sqrt(2 * math.pi * shape)), abs=1e-8)


def test_modes_of_all_columns_in_one_pass(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("b", None, None), ("a", 2, None)], "x string, y int, z string")
    assert cleaning.modes(df, ["x", "y", "z"]) == {"x": "a", "y": 2, "z": None} and cleaning.modes(df, []) == {}


def test_units_of_an_hour_are_counted_in_a_fixed_number_of_tasks(spark):
    from datetime import datetime
    rows = [(u % 7, datetime(2024, 1, 1, u % 5), 1.0, "solar", "NE") for u in range(70)]
    fact = spark.createDataFrame(rows, "usina_id long, timestamp_utc timestamp_ntz, energia_mwh double, fonte string, regiao string")
    out = serving.national_hourly(fact)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["energia_mwh"], r["usinas"]) for r in out.collect()) == [(14.0, 7)] * 5
