import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brisa.operators import cleaning, forecast, profile, sites, stats


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    n = 800
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.choice(list("abc"), n), "h": rng.choice(["x", "y"], n),
                        "u": rng.normal(size=n).round(1), "v": rng.gamma(2, 3, n)})
    pdf["w"] = pdf["u"] * 2 + rng.normal(size=n)
    return pdf, spark.createDataFrame(pdf).cache()


def test_shape_and_correlation(frame):
    pdf, df = frame
    got = profile.corrected_shape(df, ["v"]).first()
    assert got["assimetria"] == pytest.approx(pdf["v"].skew()) and got["curtose"] == pytest.approx(pdf["v"].kurtosis())
    r = stats.spearman_pair(df, "u", "w").first()
    assert r["r"] == pytest.approx(pdf["u"].rank().corr(pdf["w"].rank()))
    vif = {x["feature"]: x["vif"] for x in stats.variance_inflation(df, ["u", "v", "w"]).collect()}
    x, y = np.c_[np.ones(len(pdf)), pdf["v"], pdf["w"]], pdf["u"]
    res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert vif["u"] == pytest.approx(y.var() / res.var(), rel=1e-3)


def test_rank_matrix_with_nulls_and_constants(spark):
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({"a": rng.integers(0, 9, n).astype(float), "b": rng.normal(size=n).round(1), "c": rng.gamma(2, 3, n),
                        "k": np.ones(n), "t": rng.choice(list("pqr"), n), "many": [f"x{i}" for i in range(n)]})
    pdf["d"] = pdf["a"] + pdf["b"]
    pdf.loc[rng.random(n) < 0.2, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.3, "c"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("z", F.lit(None).cast("double"))
    got = {(r["var_1"], r["var_2"]): r for r in stats.correlations(df, ["a", "b", "c", "d", "k", "z"], "spearman").collect()}
    want = pdf[["a", "b", "c", "d"]].corr(method="spearman")
    assert len(got) == 15
    for (x, y), r in got.items():
        if x in want and y in want:
            assert r["r"] == pytest.approx(want[x][y], abs=1e-12) and r["n"] == pdf[[x, y]].notna().all(axis=1).sum()
        else:
            assert r["r"] is None and r["n"] == (0 if y == "z" else pdf[x].notna().sum())
    assert [tuple(r) for r in stats.correlations(df.limit(0), ["a", "b"], "spearman").collect()] == [("a", "b", None, 0)]
    assert stats.correlations(df.select("t"), None, "spearman").count() == 0
    ranked = {r["feature"]: r for r in stats.rank_features(df, "d").collect()}
    assert ranked["many"]["tipo_relacao"] == "categorias demais" and ranked["k"]["forca"] is None
    assert ranked["b"]["forca"] == pytest.approx(abs(want["b"]["d"]))
    within = pdf.groupby("t")["d"].transform("mean")
    assert ranked["t"]["forca"] == pytest.approx(((within - pdf["d"].mean()) ** 2).sum() / ((pdf["d"] - pdf["d"].mean()) ** 2).sum())


def test_kruskal_chi_and_eta(frame):
    pdf, df = frame
    got = stats.compare_groups(df, "v", "g", "kruskal")
    ranks, n = pdf["v"].rank(), len(pdf)
    h = 12 / (n * (n + 1)) * sum(ranks[pdf["g"] == g].sum() ** 2 / (pdf["g"] == g).sum() for g in "abc") - 3 * (n + 1)
    assert got["estatistica"] == pytest.approx(h) and 0 <= got["p_valor"] <= 1 and got["regra"] == "forcado"
    assert stats.compare_groups(df, "u", "g")["regra"] == "dagostino"
    tab = pd.crosstab(pdf["g"], pdf["h"]).to_numpy()
    exp = tab.sum(1, keepdims=True) * tab.sum(0) / tab.sum()
    assert stats.chi_square(df, "g", "h").first()["chi2"] == pytest.approx(((tab - exp) ** 2 / exp).sum())


def test_unseen_cells_count(spark):
    df = spark.createDataFrame([("a", "x")] * 5 + [("b", "y")] * 7, "a string, b string")
    assert stats.chi_square(df, "a", "b").first()["chi2"] == pytest.approx(12.0)


def test_fisher(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] * 1 + [("b", "x")] * 1 + [("b", "y")] * 3, "a string, b string")
    got = stats.categorical_test(df, "a", "b")
    assert got["teste"] == "fisher_exato" and got["p_valor"] == pytest.approx(34 / 70)


def test_ks_and_normality(frame):
    pdf, df = frame
    got = stats.normality(df, "u")
    x = np.sort(pdf["u"])
    z = (x - x.mean()) / x.std(ddof=1)
    f = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    n = len(x)
    d = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
    assert got["ks"]["estatistica"] == pytest.approx(d, abs=1e-9)
    assert not stats.normality(df, "v")["normal"]
    fits = {r["distribuicao"]: r for r in stats.fit_distributions(df, "v").collect()}
    assert fits["gamma"]["p1"] == pytest.approx(2, abs=0.4) and fits["gamma"]["ks_stat"] < fits["uniform"]["ks_stat"]


def test_intervals_and_bootstrap(frame):
    pdf, df = frame
    mean = stats.interval(df, "v", "media")
    assert mean["ic_inferior"] < pdf["v"].mean() < mean["ic_superior"]
    boot = stats.bootstrap_interval(df, "v", ["id"], "media", 200)
    assert boot["estimativa"] == pytest.approx(pdf["v"].mean())
    assert boot["erro_padrao_boot"] == pytest.approx(pdf["v"].std() / math.sqrt(len(pdf)), rel=0.25)
    med = stats.interval(df, "v", "mediana", key=["id"], replicates=60)
    assert med["ic_inferior"] <= pdf["v"].median() <= med["ic_superior"]


def test_scale_and_outliers(frame):
    pdf, df = frame
    out = cleaning.fit_scale(df, ["u"], "robust").apply(df).agg(F.max("u")).first()[0]
    q = pdf["u"].quantile([0.25, 0.5, 0.75])
    assert out == pytest.approx((pdf["u"].max() - q[0.5]) / (q[0.75] - q[0.25]))
    assert cleaning.treat_outliers(df, ["v"]).count() < len(pdf)


def test_errors_by_hand(spark):
    rows = [("s", "f", "m", 1, y, p) for y, p in ((0.0, 5.0), (0.0, 5.0), (100.0, 110.0), (100.0, 90.0))]
    panel = spark.createDataFrame(rows, "serie string, fonte string, modelo string, janela int, y double, previsto double")
    r = forecast.error_metrics(panel).first()
    assert r["mape_pct"] == pytest.approx(10) and r["cobertura_pct"] == pytest.approx(50) and r["mae"] == pytest.approx(7.5)
    assert r["vies"] == pytest.approx(-2.5)


def test_no_leak(spark):
    df = spark.createDataFrame([(0,)], "x int").selectExpr(
        "explode(sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-03-01 00:00:00', interval 1 hour)) as data_hora").selectExpr(
        "'s' as serie", "'s' as fonte", "data_hora", "cast(unix_date(to_date(data_hora)) * 24 + hour(data_hora) as double) as energia_mwh")
    with pytest.raises(ValueError, match="leak"):
        forecast.build_features(df, 24, lags=(23,))
    out = forecast.build_features(df).orderBy("data_hora").toPandas()
    y = out["energia_mwh"]
    np.testing.assert_allclose(out["lag_168h"], y.shift(168))
    np.testing.assert_allclose(out["media_72h"], y.shift(24).rolling(72, min_periods=18).mean())
    np.testing.assert_allclose(out["desvio_24h"], y.shift(24).rolling(24, min_periods=6).std())


def test_sites_equal_one_by_one(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["solar", "eolica"]), rnd.choice(["BA", "RN", "CE"]), "NE", round(rnd.uniform(1, 60), 1), f"c{i:03d}",
             f"n{i}", rnd.uniform(-12, -8), rnd.uniform(-42, -38), rnd.choice(["Lapa", "Caetité"])) for i in range(120)]
    df = spark.createDataFrame(rows, "fonte string, id_estado string, id_subsistema string, potencia_mw double, ceg string, "
                               "usina_referencia string, latitude double, longitude double, municipio string")
    pdf = df.toPandas()

    total = pdf.groupby(["fonte", "id_estado"])["potencia_mw"].sum().sort_values(ascending=False)
    chosen = []
    p = {r.ceg: (math.radians(r.latitude), math.radians(r.longitude)) for r in pdf.itertuples()}

    def dist(x, y):
        (a1, o1), (a2, o2) = p[x], p[y]
        h = math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin((o2 - o1) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))
    for (src, uf), mw in total.items():
        if mw < 50:
            continue
        got = 0
        for r in pdf[(pdf.fonte == src) & (pdf.id_estado == uf)].sort_values(["potencia_mw", "ceg"], ascending=[False, True]).itertuples():
            if got < 3 and all(dist(r.ceg, c) >= 60 for c in chosen):
                chosen.append(r.ceg)
                got += 1
    out = sites.choose(df, per_group=3, min_group_mw=50.0, min_km=60.0).collect()
    assert sorted(r["ceg"] for r in out) == sorted(chosen)
    assert len({r["local"] for r in out}) >= 2


def test_sites_take_few_jobs_and_few_offers(spark, monkeypatch):
    """Many plants at few places, and groups that want more plants than a round offers."""
    rnd = random.Random(5)
    spots = [(rnd.uniform(-20, -4), rnd.uniform(-45, -36)) for _ in range(300)]
    rows = [(rnd.choice(["solar", "eolica"]), rnd.choice(["BA", "RN", "CE", "PI", "MA", "PB"]), "NE", round(rnd.uniform(1, 60), 1),
             f"c{i:04d}", f"n{i}", *spots[i % 300], "Lapa") for i in range(1500)]
    df = spark.createDataFrame(rows, "fonte string, id_estado string, id_subsistema string, potencia_mw double, ceg string, "
                               "usina_referencia string, latitude double, longitude double, municipio string").cache()
    calls, cut = [], sites.cut
    monkeypatch.setattr(sites, "cut", lambda x: (calls.append(1), cut(x))[1])
    whole = sites.choose(df, per_group=4, min_km=120.0).collect()
    assert len(calls) <= 3          # one round settles all groups
    monkeypatch.setattr(sites, "OFFERS", 24)
    monkeypatch.setattr(sites, "GROUPS", 5)
    parts = sites.choose(df, per_group=4, min_km=120.0).collect()
    chosen, place = [], {r[4]: (math.radians(r[6]), math.radians(r[7])) for r in rows}

    def far(x, y):
        (a1, o1), (a2, o2) = place[x], place[y]
        h = math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin((o2 - o1) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h)) >= 120
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    for key in sorted(groups, key=lambda k: (-sum(r[3] for r in groups[k]), k)):
        got = 0
        for r in sorted(groups[key], key=lambda r: (-r[3], r[4])):
            if got < 4 and all(far(r[4], c) for c in chosen):
                chosen.append(r[4])
                got += 1
    assert sorted(r["ceg"] for r in whole) == sorted(r["ceg"] for r in parts) == sorted(chosen)
