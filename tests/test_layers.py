from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brisa.functions.text import core_name
from brisa.operators import star, validate
from brisa.plans import layers
from brisa.sources.writers import published
from tests import world


SMALL = "PQU|PQU SERRA GAUCHA|RS"


@pytest.fixture(scope="module")
def clean(spark):
    return {
        "events": layers.clean_events(world.maintenance(spark)).cache(),
        "daily": layers.clean_daily_climate(world.daily_climate(spark)).cache(),
        "registry": layers.clean_registry(world.registry(spark)).cache(),
        "hourly": layers.clean_hourly_climate(world.hourly_climate(spark)).cache(),
        "generation": layers.clean_generation(world.generation(spark)).cache(),
    }


@pytest.fixture(scope="module")
def curated(clean):
    return {k: v.cache() for k, v in layers.curate(
        clean["generation"], clean["registry"], clean["daily"], clean["events"]).items()}


def at(df, unit, hour):
    """Row of a unit at an hour since the start, in local time."""
    return df.filter((F.col("chave_unidade") == unit) & (F.col("data_hora_brasilia") == F.lit(world.START + timedelta(hours=hour)))).first()


def test_grid_and_flags(clean):
    df = clean["generation"]
    assert df.groupBy("chave_unidade").count().filter(f"count <> {world.HOURS}").count() == 0
    flags = {(r[0], r[1]): r[2] for r in df.filter("flag_qualidade <> 'original'").groupBy("chave_unidade", "flag_qualidade").count().collect()}
    assert flags == {("PITAB", "interpolado"): 2, ("PITAB", "negativo_zerado"): 1, ("CEGRL", "faltante"): 8}
    low, high = 16 * world.shape(32), 16 * world.shape(35)
    assert at(df, "PITAB", 34)["geracao_mwh"] == pytest.approx(low + (high - low) * 2 / 3, abs=1e-3)
    assert at(df, "PITAB", 71)["geracao_mwh"] == 0 and at(df, "CEGRL", 43)["geracao_mwh"] is None
    assert at(df, "CEGRL", 0)["data_hora_utc"] == datetime(2025, 3, 10, 3)


def test_the_last_row_of_a_file_stays(spark, clean, tmp_path):
    """No column says which row is newer: the one further down does, whatever its value."""
    wanted = {("PEAGU", 12): 9 * world.shape(12), ("PEAGU", 80): 9 * world.shape(80), ("TORIO", 5): 90 * world.shape(5)}
    from_file = str(tmp_path / "raw")
    raw = world.generation(spark)
    raw.coalesce(1).write.parquet(from_file)
    for df in (clean["generation"], layers.clean_generation(spark.read.parquet(from_file))):
        for (unit, hour), value in wanted.items():
            assert at(df, unit, hour)["geracao_mwh"] == pytest.approx(value, abs=1e-3), (unit, hour)
    files = str(tmp_path / "parts")         # the later file by name wins over the earlier one
    one = raw.filter("id_ons = 'PEAGU'").limit(1)
    one.withColumn("val_geracao", F.lit(5.0)).coalesce(1).write.parquet(files + "/x=2")
    one.withColumn("val_geracao", F.lit(8.0)).coalesce(1).write.parquet(files + "/x=1")
    both = layers.clean_generation(spark.read.parquet(files).drop("x"))
    assert [r["geracao_mwh"] for r in both.collect()] == [5.0]


def test_units(clean):
    df = clean["generation"]
    assert [r[0] for r in df.filter("chave_unidade = 'PEPED'").select("nome_usina").distinct().collect()] == ["CJ EOLICO PEDRA RACHADA"]
    kinds = {r["chave_unidade"]: (r["tipo_unidade"], r["fonte"]) for r in df.select("chave_unidade", "tipo_unidade", "fonte").distinct().collect()}
    assert kinds == {"PITAB": ("usina", "solar"), "CEGRL": ("conjunto", "eolica"), "PEPED": ("conjunto", "eolica"),
                     "PEAGU": ("conjunto", "solar"), SMALL: ("pequenas_usinas", "eolica"), "TORIO": ("usina", "termica")}


def test_registry(clean):
    rows = {r["ceg"]: r for r in clean["registry"].collect()}
    assert len(rows) == len(world.PLANTS) and not [c for c in clean["registry"].columns if "propri" in c]
    sun, abroad, planned = rows["UFV.RS.PI.037711-4.1"], rows["UFV.RS.GO.040404-6.1"], rows["EOL.CV.CE.031207-1.1"]
    assert (sun["potencia_outorgada_mw"], sun["garantia_fisica_mw"], sun["latitude"]) == (18.2505, 1.5, -8.25)
    assert (abroad["flag_coordenada"], abroad["latitude"], abroad["flag_data_operacao"]) == ("fora_do_brasil", None, "implausivel_pre_1990")
    assert (abroad["municipio"], abroad["id_subsistema"]) == (None, "SE")
    assert (planned["flag_data_operacao"], planned["data_entrada_operacao"], planned["flag_coordenada"]) == ("sentinela_1900", None, None)
    two = rows["EOL.CV.CE.031202-5.1"]
    assert (two["municipio"], two["uf_municipio"], two["municipio_normalizado"]) == ("Itarema", "CE", "itarema")


def test_climate(clean):
    site = lambda df, name: df.filter(F.col("local") == name)
    hours = {r["data_hora_utc"].hour: r for r in site(clean["hourly"], "acarau_ce").filter("day(data_hora_utc) = 10").collect()}
    assert [hours[h]["vento_50m_ms"] for h in (11, 12, 13)] == [22.0, 24.0, 26.0]       # three hours are filled
    assert all(hours[h]["medidas_faltantes"] == "vento_10m_ms" for h in range(3, 9)) and hours[9]["medidas_faltantes"] is None
    days = {r["data"].day: r for r in site(clean["daily"], "inocencio_pi").collect()}
    assert len(days) == 9 and days[13]["flag_qualidade"] == "interpolado"
    assert days[13]["irradiancia_kwh_m2_dia"] == pytest.approx((4.2 + 4.8) / 2)
    last = site(clean["daily"], "buique_pe").filter("data = '2025-03-18'").first()
    assert (last["irradiancia_kwh_m2_dia"], last["medidas_faltantes"]) == (None, "irradiancia_kwh_m2_dia")


def test_events(clean, spark):
    days = {r["ceg"]: r["tempo_dias"] for r in clean["events"].collect()}
    assert days["EOL.CV.CE.031201-7.1"] == round(7 * 365.25) and len(days) == 5
    for column, value, rule in (("tempo_anos", F.lit(-1.0), "tempo <= 0"), ("evento", F.lit(2), "evento fora"), ("data_evento", F.lit(date(2030, 1, 1)), "corte")):
        with pytest.raises(ValueError, match=rule):
            layers.clean_events(world.maintenance(spark).withColumn(column, value))


def test_dimension_and_bridge(curated):
    dim = {r["chave_unidade"]: r for r in curated["dim_usina"].collect()}
    assert sorted(dim) == ["CEGRL", "PEAGU", "PEPED", "PITAB", SMALL]              # solar and wind only
    links = {k: (r["metodo_vinculo"], r["qualidade_vinculo"], r["n_usinas_aneel"], r["potencia_mw"]) for k, r in dim.items()}
    assert links == {"PITAB": ("ceg", "exata", 1, 18.2505), "CEGRL": ("nome", "consistente", 3, 100.0), "PEPED": ("nome", "inconsistente", 1, None),
                     "PEAGU": ("sem_vinculo", "sem_vinculo", 0, None), SMALL: ("sem_vinculo", "sem_vinculo", 0, None)}
    wind = dim["CEGRL"]
    assert (wind["municipio"], wind["data_operacao"], wind["razao_pico_potencia"]) == ("Acaraú", date(2014, 11, 20), pytest.approx(0.56))
    assert (wind["lat"], wind["lon"]) == (pytest.approx(-3.6), pytest.approx(-40.3))
    assert dim["PEPED"]["potencia_aneel_vinculada_mw"] == 12.0
    bridge = {r["ceg_aneel"]: (r["usina_id"], r["nucleo_usado"]) for r in curated["ponte_usina_aneel"].collect()}
    a, b, c = dim["CEGRL"]["usina_id"], dim["PEPED"]["usina_id"], dim["PITAB"]["usina_id"]
    assert bridge == {"EOL.CV.CE.031201-7.1": (a, "gravata do leste"), "EOL.CV.CE.031202-5.1": (a, "gravata do leste"),
                      "EOL.CV.CE.031205-9.1": (a, "gravata do leste"), "EOL.CV.PE.029988-1.1": (b, "pedra rachada"), "UFV.RS.PI.037711-4.1": (c, None)}


def test_facts(curated):
    ids = {r["chave_unidade"]: r["usina_id"] for r in curated["dim_usina"].collect()}
    fact = curated["fato_geracao"]
    assert fact.count() == len(ids) * world.HOURS and fact.filter("energia_mwh is null").count() == 8
    sites = {r["usina_id"]: r["local_clima"] for r in curated["fato_clima"].select("usina_id", "local_clima").distinct().collect()}
    # the group without plants takes the point of its state, the one without either has none
    assert sites == {ids["PITAB"]: "inocencio_pi", ids["CEGRL"]: "acarau_ce", ids["PEPED"]: "buique_pe", ids["PEAGU"]: "buique_pe"}
    made = {r["usina_id"]: (r["n_usinas_consideradas"], r["evento_ocorreu"], r["data_primeiro_evento"], r["tempo_dias"])
            for r in curated["fato_manutencao"].collect()}
    first = date(2020, 6, 1)
    assert made == {ids["CEGRL"]: (2, True, first, (first - date(2014, 11, 20)).days),
                    ids["PITAB"]: (1, False, None, (world.CUT - date(2020, 9, 15)).days),
                    ids["PEPED"]: (1, False, None, (world.CUT - date(2018, 4, 30)).days)}


def test_ids_stay(clean, curated):
    ids = lambda df: {r["chave_unidade"]: r["usina_id"] for r in df.collect()}
    before = ids(curated["dim_usina"])
    again, _ = star.build_dimension(clean["generation"], clean["registry"], curated["dim_usina"])
    assert ids(again) == before
    known = curated["dim_usina"].filter("chave_unidade = 'PITAB'").withColumn("usina_id", F.lit(40).cast("long"))
    later, _ = star.build_dimension(clean["generation"], clean["registry"], known)
    later = ids(later)
    assert later.pop("PITAB") == 40 and sorted(later.values()) == [41, 42, 43, 44]


def test_publish(spark, curated, tmp_path):
    root = str(tmp_path / "star")
    layers.publish_star(curated, root)
    rows = lambda: {k: published(spark, root)[k].count() for k in ("dim_usina", "fato_geracao")}
    good = rows()
    assert good == {"dim_usina": 5, "fato_geracao": 5 * world.HOURS}
    twice = curated["fato_geracao"].unionByName(curated["fato_geracao"].filter("usina_id = 2"))
    with pytest.raises(ValueError, match="chave"):
        layers.publish_star({**curated, "fato_geracao": twice}, root)
    assert rows() == good


def links(spark, units, plants):
    """(unit, method, core) of each plant that gets a unit."""
    u = spark.createDataFrame([(k, code, name, kind, source, state) for k, name, kind, source, state, code in units],
                              "chave_unidade string, ceg_ons string, nome_normalizado string, tipo_unidade string, fonte string, id_estado string")
    p = spark.createDataFrame([(code, name, source, state, phase, mw, -9.5, -38.0, "Vila", date(2013, 2, 2)) for code, name, source, state, phase, mw in plants],
                              "ceg string, nome_normalizado string, fonte string, id_estado string, fase string, "
                              "potencia_outorgada_mw double, latitude double, longitude double, municipio string, data_entrada_operacao date")
    return {r["ceg_aneel"]: (r["chave_unidade"], r["metodo_vinculo"], r["nucleo_usado"]) for r in star.link_units(u, p).collect()}


def group(key, name, state="PB", source="eolica"):
    return key, name, "conjunto", source, state, None


def plant(code, name, state="PB", source="eolica", phase="Operação", mw=22.0):
    return code, name, source, state, phase, mw


def test_link_by_code_ignores_phase(spark):
    unit = ("K", "qualquer", "usina", "solar", "MG", "UFV.RS.MG.055555-2.01")
    assert links(spark, [unit], [plant("UFV.RS.MG.055555-2.1", "outro nome", "MG", "solar", "Construção")]) == {"UFV.RS.MG.055555-2.1": ("K", "ceg", None)}


def test_longer_names_link_first(spark):
    found = links(spark, [group("short", "conjunto eolico pico alto"), group("long", "complexo eolico pico alto oeste")],
                  [plant("p", "pico alto oeste iv"), plant("q", "pico alto leste iv")])
    assert found == {"p": ("long", "nome", "pico alto oeste"), "q": ("short", "nome", "pico alto")}
    same = [group("second", "cj eolico areia clara"), group("first", "cj eolico areia clara")]
    assert links(spark, same, [plant("p", "areia clara 9")]) == {"p": ("first", "nome", "areia clara")}
    assert links(spark, [group("K", "conjunto eolico areia clara 77")], [plant("p", "areia clara 9")]) == {"p": ("K", "nome", "areia clara")}


def test_what_does_not_link(spark):
    unit = [group("K", "conjunto eolico areia clara")]
    assert links(spark, [group("K", "conjunto eolico rio")], [plant("p", "ventos do rio 3")]) == {}        # a core of three letters
    assert links(spark, [group("K", "conjunto eolico areia")], [plant("p", "areial 3")]) == {}             # half a word
    for other in (plant("p", "areia clara 1", phase="Construção"), plant("p", "areia clara 1", mw=0.99), plant("p", "areia clara 1", state="AL"),
                  plant("p", "areia clara 1", source="solar")):
        assert links(spark, unit, [other]) == {}


def test_name_link_equals_one_by_one(spark):
    """Against the same choice made set by set."""
    import random
    rnd = random.Random(5)
    words = ["areia", "pico", "alto", "claro", "rio", "iv", "oeste"]
    sets = [(f"S{i:02d}", rnd.choice(["PB", "AL"]), "eolica",
             " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))) for i in range(30)]
    plants = [(f"p{i:03d}", rnd.choice(["PB", "AL"]), "eolica",
               " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5)))) for i in range(120)]
    want, used = {}, set()
    for key, uf, src, core in sorted(sets, key=lambda s: (-len(s[3]), s[0])):
        parts = core.split()
        for n in range(len(parts), 0, -1):
            piece = " ".join(parts[:n])
            if len(piece) < 4:
                break
            hit = [c for c, u, s, name in plants if u == uf and s == src and c not in used
                   and f" {piece} " in f" {name} "]
            if hit:
                want.update({c: (key, piece) for c in hit})
                used.update(hit)
                break
    s = spark.createDataFrame(sets, "chave_unidade string, id_estado string, fonte string, nucleo string")
    p = spark.createDataFrame(plants, "ceg string, id_estado string, fonte string, nome_normalizado string")
    got = {r["ceg_aneel"]: (r["chave_unidade"], r["nucleo_usado"]) for r in star.link_by_name(s, p).collect()}
    assert got == want


def test_core_names(spark):
    df = spark.createDataFrame([("complexo eolico serra branca 69 kv iii",), ("usina solar boa hora 5",)], "n string")
    assert [r[0] for r in df.select(core_name(F.col("n"))).collect()] == ["serra branca iii", "boa hora 5"]


def test_validation_reports_everything(curated):
    dim = curated["dim_usina"].withColumn("potencia_mw", F.lit(-1.0))
    fact = curated["fato_geracao"].withColumn("usina_id", F.col("usina_id") + 100).withColumn(
        "fonte", F.lit(None).cast("string"))
    with pytest.raises(ValueError) as error:
        validate.validate({"dim_usina": dim, "fato_geracao": fact})
    text = str(error.value)
    assert "faixa (potencia_mw)" in text and "orfao (usina_id)" in text and "nulos (fonte)" in text


def test_names_are_linked_once_for_all_plants_that_share_them(spark, monkeypatch):
    sets = [("k1", "BA", "eolica", "serra azul"), ("k2", "BA", "eolica", "serra azul norte"), ("k3", "RN", "eolica", "campo largo")]
    names = [("BA", "parque serra azul norte um"), ("BA", "parque serra azul dois"), ("RN", "usina campo largo"), ("RN", "usina morro")]
    rows = [(f"c{i:03d}", *names[i % 4]) for i in range(200)] + [("c900", *names[0]), ("c900", *names[1]), ("c901", "BA", None)]
    s = spark.createDataFrame(sets, "chave_unidade string, id_estado string, fonte string, nucleo string")
    p = spark.createDataFrame([(c, u, "eolica", n) for c, u, n in rows], "ceg string, id_estado string, fonte string, nome_normalizado string")
    sizes, cut = [], star.cut
    monkeypatch.setattr(star, "cut", lambda df: (lambda out: (sizes.append((out.columns, out.count())), out)[1])(cut(df)))
    got = sorted((r["ceg_aneel"], r["chave_unidade"]) for r in star.link_by_name(s, p).collect())
    assert max(n for columns, n in sizes if "trecho" in columns) < 20       # the rounds see names, not plants
    assert got == sorted([(f"c{i:03d}", ("k2", "k1", "k3")[i % 4]) for i in range(200) if i % 4 < 3] + [("c900", "k2")])
