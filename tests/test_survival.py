import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brisa.operators import cox, recurrent as R, survival as S


@pytest.fixture(scope="module")
def cohort():
    """Two sources, ties, three covariates, late entry."""
    rng = np.random.default_rng(11)
    n = 400
    x = rng.normal(size=(n, 2))
    g = rng.choice(["eolica", "solar"], n)
    scale = np.where(g == "solar", 4.0, 7.0) * np.exp(-(0.5 * x[:, 0] - 0.3 * x[:, 1]))
    t = np.ceil(10 * scale * rng.weibull(1.4, n)) / 10
    c = np.ceil(10 * rng.uniform(1, 9, n)) / 10
    stop = np.minimum(t, c)
    start = np.floor(10 * stop * rng.uniform(0, 0.6, n)) / 10
    return pd.DataFrame({"id": np.arange(n) // 2, "fonte": g, "x1": x[:, 0], "x2": x[:, 1], "ini": start,
                         "tempo": stop, "evento": (t <= c).astype(int)})


def efron(df, cols, beta, strata=None, entry=None):
    """Log-likelihood, score, information and residual sums, one event time at a time."""
    ll, u, info = 0.0, np.zeros(len(cols)), np.zeros((len(cols),) * 2)
    groups = df.groupby(strata) if strata else [(None, df)]
    for _, g in groups:
        x, t, e = g[cols].to_numpy(), g["tempo"].to_numpy(), g["evento"].to_numpy()
        s = g[entry].to_numpy() if entry else np.full(len(g), -1.0)
        r = np.exp(x @ beta)
        for k in np.unique(t[e == 1]):
            risk, dead = (t >= k) & (s < k), (t == k) & (e == 1)
            d = dead.sum()
            ll += (x[dead] @ beta).sum()
            u += x[dead].sum(0)
            for i in range(d):
                w = r * risk - i / d * r * dead
                z = w.sum()
                m = (w[:, None] * x).sum(0) / z
                ll -= math.log(z)
                u -= m
                info += (w[:, None, None] * x[:, :, None] * x[:, None, :]).sum(0) / z - np.outer(m, m)
    return ll, u, info


def solve(df, cols, **kw):
    beta = np.zeros(len(cols))
    for _ in range(30):
        _, u, info = efron(df, cols, beta, **kw)
        beta = beta + np.linalg.solve(info, u)
    return beta, efron(df, cols, beta, **kw)


@pytest.mark.parametrize("strata,entry", [(None, None), ("fonte", None), ("fonte", "ini")])
def test_cox_equals_direct_sums(spark, cohort, strata, entry):
    beta, (ll, _, info) = solve(cohort, ["x1", "x2"], strata=strata, entry=entry)
    m = cox.fit(spark.createDataFrame(cohort), "tempo", "evento", ["x1", "x2"], strata=[strata] if strata else [],
                entry=entry, with_baseline=False)
    np.testing.assert_allclose(m.coef, beta, atol=1e-7)
    np.testing.assert_allclose(m.errors, np.sqrt(np.diag(np.linalg.inv(info))), rtol=1e-6)
    assert m.log_likelihood == pytest.approx(ll, abs=1e-6)


def test_clustered_errors(spark, cohort):
    """Sandwich from residuals written out row by row, ties taken as one jump."""
    df = cohort.copy()
    df["tempo"] = df["tempo"] + np.arange(len(df)) * 1e-7      # no ties: both tie rules agree
    beta, (_, _, info) = solve(df, ["x1", "x2"], entry="ini")
    x, t, s, e = df[["x1", "x2"]].to_numpy(), df["tempo"].to_numpy(), df["ini"].to_numpy(), df["evento"].to_numpy()
    r, res = np.exp(x @ beta), np.zeros((len(df), 2))
    for k in np.unique(t[e == 1]):
        risk = (t >= k) & (s < k)
        z = (r * risk).sum()
        m = ((r * risk)[:, None] * x).sum(0) / z
        dead = (t == k) & (e == 1)
        res += dead[:, None] * (x - m) - (risk * r * dead.sum() / z)[:, None] * (x - m)
    u = pd.DataFrame(res).groupby(df["id"]).sum().to_numpy()
    want = np.linalg.inv(info) @ (u.T @ u) @ np.linalg.inv(info)
    got = cox.fit(spark.createDataFrame(df), "tempo", "evento", ["x1", "x2"], entry="ini", cluster="id", with_baseline=False)
    np.testing.assert_allclose(got.variance, want, rtol=1e-4, atol=1e-9)


def test_proportionality_statistic(spark, cohort):
    df = cohort.copy()
    df["tempo"] = df["tempo"] + np.arange(len(df)) * 1e-7
    beta, (_, _, info) = solve(df, ["x1", "x2"])
    var = np.linalg.inv(info)
    x, t, e = df[["x1", "x2"]].to_numpy(), df["tempo"].to_numpy(), df["evento"].to_numpy()
    r, res, when = np.exp(x @ beta), [], []
    for k in np.sort(t[e == 1]):
        risk = t >= k
        m = ((r * risk)[:, None] * x).sum(0) / (r * risk).sum()
        res.append(x[t == k][0] - m)
        when.append(k)
    res, g = np.array(res), np.arange(1, len(when) + 1) - (len(when) + 1) / 2
    scaled = len(when) * res @ var
    want = (g[:, None] * scaled).sum(0) ** 2 / (len(when) * np.diag(var) * (g ** 2).sum())
    got = cox.proportionality_test(spark.createDataFrame(df), "tempo", "evento", ["x1", "x2"]).toPandas()
    np.testing.assert_allclose(got["estatistica"], want, rtol=1e-5)


def test_penalty_shrinks_to_zero(spark, cohort):
    df = spark.createDataFrame(cohort)
    some = cox.fit(df, "tempo", "evento", ["x1", "x2"], penalty=0.12, l1_ratio=1.0, with_baseline=False)
    assert abs(some.coef[0]) > abs(some.coef[1]) and abs(some.coef[0]) > 1e-3
    none = cox.fit(df, "tempo", "evento", ["x1", "x2"], penalty=10.0, l1_ratio=1.0, with_baseline=False)
    assert np.abs(none.coef).max() < 1e-9


def test_concordance_by_pairs(spark, cohort):
    df = cohort.assign(s=np.round(cohort["x1"], 1))
    t, e, s = df["tempo"].to_numpy(), df["evento"].to_numpy(), df["s"].to_numpy()
    c = d = tie = 0
    for i in np.flatnonzero(e):
        later = (t > t[i]) | ((t == t[i]) & (e == 0))
        c, d, tie = c + (later & (s[i] > s)).sum(), d + (later & (s[i] < s)).sum(), tie + (later & (s[i] == s)).sum()
    row = S.concordance(spark.createDataFrame(df), "tempo", "evento", "s").first()
    assert (row["concordantes"], row["discordantes"], row["empates"]) == (c, d, tie)


def test_parametric_fits_reach_the_top(spark, cohort):
    df = cohort[cohort["fonte"] == "solar"]
    fits = {r["modelo"]: r for r in S.parametric_fits(spark.createDataFrame(df), "tempo", "evento").collect()}
    t, e = df["tempo"].to_numpy(), df["evento"].to_numpy()

    def weibull(scale, shape):
        return (e * (math.log(shape) - shape * math.log(scale) + (shape - 1) * np.log(t)) - (t / scale) ** shape).sum()
    top = fits["weibull"]
    assert top["log_verossimilhanca"] == pytest.approx(weibull(top["p1"], top["p2"]), rel=1e-9)
    for a, b in ((1.01, 1), (0.99, 1), (1, 1.01), (1, 0.99)):
        assert weibull(top["p1"] * a, top["p2"] * b) < top["log_verossimilhanca"]
    assert fits["exponencial"]["p1"] == pytest.approx(t.sum() / e.sum())
    assert fits["weibull"]["aic"] < fits["exponencial"]["aic"]


def test_predictions(spark, cohort):
    df = spark.createDataFrame(cohort)
    m = cox.fit(df, "tempo", "evento", ["x1", "x2"], strata=["fonte"])
    probs = cox.conditional_survival(m, df.withColumn("usina_id", F.monotonically_increasing_id()), "usina_id", age=None,
                                     months=(6, 12, 24)).toPandas()
    assert ((probs["p_sem_manutencao_6m"] >= probs["p_sem_manutencao_12m"])
            & (probs["p_sem_manutencao_12m"] >= probs["p_sem_manutencao_24m"])).all()
    assert probs["p_sem_manutencao_24m"].between(0, 1).all() and (probs["metodo_extrapolacao"] == "cox").all()
    curve = cox.predict_survival(m, df, [2.0]).toPandas()
    both = probs.sort_values(["x1"])["p_sem_manutencao_24m"].to_numpy()
    base = m.baseline.toPandas()
    first = {g: np.interp(2.0, *b.sort_values("tempo")[["tempo", "risco_base"]].to_numpy().T) for g, b in base.groupby("fonte")}
    low = {g: b["risco_base"].iloc[b["tempo"].argmin()] for g, b in base.groupby("fonte")}
    curve = curve.sort_values("x1")
    want = np.exp(-(curve["fonte"].map(first) - curve["fonte"].map(low)) * np.exp(
        (curve[["x1", "x2"]].to_numpy() - m.means) @ m.coef))
    np.testing.assert_allclose(both, want, rtol=1e-6)
    limits = S.support_limits(df, "tempo", "evento", ["fonte"], 20)
    fits = cox.fit_weibull(df, "tempo", "evento", ["x1", "x2"], "fonte")
    old = df.withColumn("usina_id", F.monotonically_increasing_id()).withColumn("idade_anos", F.lit(50.0))
    far = cox.conditional_survival(m, old, "usina_id", months=(12,), weibull=fits, limits=limits).toPandas()
    assert (far["metodo_extrapolacao"] == "weibull").all() and (far["p_sem_manutencao_12m"] < 1).all()
    medians = cox.predict_median(m, df).toPandas()
    for _, r in medians.dropna().sample(10, random_state=1).iterrows():
        b = base[base["fonte"] == r["fonte"]].sort_values("tempo")
        need = math.log(2) / math.exp((r[["x1", "x2"]].to_numpy(dtype=float) - m.means) @ m.coef)
        assert r["tempo_mediano_anos"] == b.loc[b["risco_base"] >= need, "tempo"].iloc[0]


def test_mean_cumulative_by_hand(spark):
    panel = spark.createDataFrame([(1, "g", 0.0, 1.0, 1), (1, "g", 1.0, 3.0, 0), (2, "g", 0.0, 2.0, 1), (3, "g", 0.0, 4.0, 0)],
                                  "id_usina int, fonte string, t_inicio_anos double, t_fim_anos double, evento int")
    rows = R.mean_cumulative(panel).orderBy("tempo_anos").collect()
    assert [(r["tempo_anos"], r["em_risco"], round(r["mcf"], 9)) for r in rows] == [(1.0, 3, round(1 / 3, 9)), (2.0, 3, round(2 / 3, 9))]
    got = {r["t"]: r["esperados_0"] for r in R.expected_events(
        spark.createDataFrame([(0.0, "g"), (1.0, "g"), (9.0, "g")], "t double, fonte string"), R.mean_cumulative(panel), "t", [1.0]).collect()}
    assert got[0.0] == pytest.approx(0.0) and got[1.0] == pytest.approx(1 / 3) and got[9.0] == 0.0
    with pytest.raises(ValueError, match="intervalo"):
        R.add_strata(panel.withColumn("t_fim_anos", F.lit(0.0)).withColumn("episodio", F.lit(1)))


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.0, 1), (4.0, 1), (5.0, 0)], "t double, e int")
    rows = S.kaplan_meier(df, "t", "e").orderBy("tempo").collect()
    assert [(r["em_risco"], round(r["sobrevivencia"], 9)) for r in rows] == [(5, 0.8), (4, 0.6), (2, 0.3), (1, 0.3)]
    assert S.medians(S.kaplan_meier(df, "t", "e")).first()["mediana"] == 4.0


def test_count_regression(spark):
    """Coefficients and theta against a search on the written-out likelihood."""
    rng = np.random.default_rng(5)
    n = 600
    x, o = rng.normal(size=n), rng.uniform(0.5, 3, n)
    z = rng.gamma(1 / 0.6, 0.6, n)
    y = rng.poisson(o * np.exp(0.2 + 0.5 * x) * z)
    got = R.count_regression(spark.createDataFrame(pd.DataFrame({"y": y, "o": o, "x": x})), "y", "o", ["x"])

    def ll(theta, a, b):
        m = o * np.exp(a + b * x)
        up = sum(np.log(1 + theta * np.arange(k)).sum() for k in y)
        return up + (y * np.log(m) - (y + 1 / theta) * np.log(1 + theta * m)).sum()
    a, b, th = got["coef"]["const"], got["coef"]["x"], got["theta"]
    best = ll(th, a, b)
    for f in (0.98, 1.02):
        assert ll(th * f, a, b) < best and ll(th, a * f, b) < best and ll(th, a, b * f) < best
    assert 0.35 < th < 0.9 and got["lr_vs_poisson"] > 50 and got["ic_inferior"] < th < got["ic_superior"]
    same = R.posterior(spark.createDataFrame([(3, 1.0)], "eventos int, mu double"), 0.5).first()["frailty_posterior"]
    assert same == pytest.approx((2 + 3) / (2 + 1))


def test_split_and_preparation(spark):
    df = spark.createDataFrame([(5.0, 1, 2.0), (2.0, 1, 3.0)], "tempo double, evento int, x double")
    rows = {(r["t_inicio"], r["t_fim"], r["evento"], r["x_depois"]) for r in S.split_at(df, "tempo", "evento", 3.0, "x").collect()}
    assert rows == {(0.0, 3.0, 0, 0.0), (3.0, 5.0, 1, 2.0), (0.0, 2.0, 1, 0.0)}
    raw = spark.createDataFrame([(1.0, "sim"), (0.0, "sim"), (3.0, "não"), (2.0, "?"), (None, "sim")], "t double, e string")
    assert S.prepare(raw, "t", "e", event_map={"sim": 1, "não": 0}).count() == 2


def test_log_rank_of_many_groups(spark, monkeypatch):
    """Against the sums over event times written out, with ties, a group that leaves before the first event, and small blocks."""
    import numpy as np
    import pandas as pd
    from brisa.operators import survival
    monkeypatch.setattr(survival, "RANK_TIMES", 7)
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"t": rng.integers(3, 60, n).astype(float), "e": rng.integers(0, 2, n), "g": rng.choice([f"g{i:02d}" for i in range(30)], n)})
    pdf = pd.concat([pdf, pd.DataFrame({"t": [1.0, 2.0], "e": [0, 0], "g": ["zz", "zz"]})])
    names = sorted(pdf["g"].unique())
    o, e, v = np.zeros(31), np.zeros(31), np.zeros((31, 31))
    for t in sorted(pdf.loc[pdf["e"] == 1, "t"].unique()):
        r = np.array([((pdf["g"] == g) & (pdf["t"] >= t)).sum() for g in names], float)
        d = np.array([((pdf["g"] == g) & (pdf["t"] == t) & (pdf["e"] == 1)).sum() for g in names], float)
        p, dead, total = r / r.sum(), d.sum(), r.sum()
        o, e = o + d, e + dead * p
        v += (dead * (total - dead) / (total - 1) if total > 1 else 0) * (np.diag(p) - np.outer(p, p))
    groups, got_o, got_e, got_v = survival.log_rank_sums(spark.createDataFrame(pdf), "t", "e", "g")
    assert groups == names
    np.testing.assert_allclose(got_o, o)
    np.testing.assert_allclose(got_e, e)
    np.testing.assert_allclose(got_v, v, atol=1e-9)
    out = survival.log_rank(spark.createDataFrame(pdf), "t", "e", "g")
    z = (o - e)[:29]
    assert out["graus_liberdade"] == 29
    assert abs(out["estatistica"] - z @ np.linalg.solve(v[:29, :29], z)) < 1e-6
