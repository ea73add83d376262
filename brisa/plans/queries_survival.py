"""Time-to-event and repeated-event queries on line items and error events."""

from __future__ import annotations

from pyspark.sql import functions as F

from brisa.operators import cox, recurrent as R, survival as S
from brisa.plans import adapters as A
from brisa.plans.adapters import rounded, table
from brisa.plans.registry import query
from brisa.session import side_by_side

X = ["quantidade", "desconto", "imposto", "log_preco"]


@query("SV1", """WITH b AS (SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 7.0 AS tempo, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 0 END AS evento, o_orderpriority AS grupo
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT grupo, count(*) AS n, sum(evento)::BIGINT AS eventos, round(1 - avg(evento), 8) AS taxa_censura, round(sum(tempo), 4) AS semanas FROM b WHERE evento IS NOT NULL AND tempo > 0 GROUP BY 1""")
def prepared_durations(spark, sf):
    """Weeks from order to shipment; 'A' is no valid event and is left out."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    raw = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("o_orderdate", "l_shipdate", F.col("l_returnflag").alias("evento"), F.col("o_orderpriority").alias("grupo"))
    df = S.prepare(raw, "tempo", "evento", start="o_orderdate", end="l_shipdate", unit="semanas", event_map={"R": 1, "N": 0})
    out = S.censoring(df, "evento", ["grupo"]).join(df.groupBy("grupo").agg(F.sum("tempo").alias("semanas")), "grupo")
    return rounded(rounded(out, 8, "taxa_censura"), 4, "semanas")


_RISK = """t AS (SELECT {g}, tempo, count(*) AS n, sum({e})::BIGINT AS d FROM coorte GROUP BY ALL),
  r AS (SELECT *, sum(n) OVER (PARTITION BY {g} ORDER BY tempo DESC)::BIGINT AS em_risco FROM t)"""
_KM = f"""WITH {A.COHORT}, {_RISK.format(g='grupo', e='evento')}, k AS (SELECT *, sum(CASE WHEN em_risco > d THEN ln(1 - d::DOUBLE / em_risco) ELSE 0 END) OVER w AS l, sum((em_risco = d)::INTEGER) OVER w AS z,
  sum(CASE WHEN em_risco > d THEN d::DOUBLE / (em_risco::DOUBLE * (em_risco - d)) ELSE 0 END) OVER w AS v FROM r WINDOW w AS (PARTITION BY grupo ORDER BY tempo)),
  c AS (SELECT grupo, tempo, em_risco, d, n, v, CASE WHEN z > 0 THEN 0 ELSE exp(l) END AS s FROM k),
  km AS (SELECT *, CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) + 1.959963984540054 * sqrt(v) / abs(ln(s)))) ELSE s END AS lo,
  CASE WHEN s > 0 AND s < 1 THEN exp(-exp(ln(-ln(s)) - 1.959963984540054 * sqrt(v) / abs(ln(s)))) ELSE s END AS hi FROM c)"""


@query("SV2", f"""{_KM} SELECT grupo, tempo, em_risco, d AS eventos, n - d AS censuras, round(s, 7) AS sobrevivencia, round(lo, 7) AS ic_inferior, round(hi, 7) AS ic_superior FROM km""")
def kaplan_meier_curves(spark, sf):
    return rounded(S.kaplan_meier(A.cohort(spark, sf), "tempo", "evento", ["grupo"]), 7, "sobrevivencia", "ic_inferior", "ic_superior")


@query("SV2", f"""{_KM} SELECT grupo, min(CASE WHEN s <= 0.5 THEN tempo END) AS mediana, min(CASE WHEN lo <= 0.5 THEN tempo END) AS mediana_ic_inferior, min(CASE WHEN hi <= 0.5 THEN tempo END) AS mediana_ic_superior,
  sum(n)::BIGINT AS n, sum(d)::BIGINT AS eventos FROM km GROUP BY 1""")
def median_survival(spark, sf):
    return S.medians(S.kaplan_meier(A.cohort(spark, sf), "tempo", "evento", ["grupo"]), ["grupo"])


@query("SV3", f"""WITH {A.COHORT}, t AS (SELECT tempo, count(*) FILTER (WHERE fonte = 'F') AS n0, count(*) FILTER (WHERE fonte = 'O') AS n1, count(*) FILTER (WHERE fonte = 'F' AND evento = 1) AS d0,
  count(*) FILTER (WHERE fonte = 'O' AND evento = 1) AS d1 FROM coorte GROUP BY 1),
  r AS (SELECT *, sum(n0) OVER (ORDER BY tempo DESC)::DOUBLE AS r0, sum(n1) OVER (ORDER BY tempo DESC)::DOUBLE AS r1 FROM t),
  x AS (SELECT sum(d0) AS o, sum((d0 + d1) * r0 / (r0 + r1)) AS e, sum(CASE WHEN r0 + r1 > 1 THEN (d0 + d1) * (r0 + r1 - d0 - d1) / (r0 + r1 - 1) * r0 / (r0 + r1) * (1 - r0 / (r0 + r1)) ELSE 0 END) AS v FROM r WHERE d0 + d1 > 0)
  SELECT round(pow(o - e, 2) / v, 6) AS estatistica, o::BIGINT AS observado, round(e, 6) AS esperado FROM x""")
def log_rank_two_groups(spark, sf):
    got = S.log_rank(A.cohort(spark, sf), "tempo", "evento", "fonte")
    return spark.createDataFrame([(round(got["estatistica"], 6), int(got["observado"]["F"]), round(got["esperado"]["F"], 6))],
                                 "estatistica double, observado long, esperado double")


@query("SV3")
def log_rank_all_groups(spark, sf):
    got = S.log_rank(A.cohort(spark, sf), "tempo", "evento", "grupo")
    return spark.createDataFrame([(got["estatistica"], got["p_valor"], got["graus_liberdade"])], "estatistica double, p_valor double, gl int")


@query("SV4", f"""WITH {A.COHORT}, {_RISK.format(g='grupo', e='evento')} SELECT grupo, tempo, em_risco, d AS eventos,
  round(sum(coalesce(list_sum(list_transform(range(0, d), lambda i: 1.0::DOUBLE / (em_risco - i))), 0)) OVER (PARTITION BY grupo ORDER BY tempo), 7) AS risco_acumulado FROM r""")
def nelson_aalen_hazard(spark, sf):
    return rounded(S.nelson_aalen(A.cohort(spark, sf), "tempo", "evento", ["grupo"]), 7, "risco_acumulado")


@query("SV10", f"""WITH {A.COHORT}, {_RISK.format(g='grupo', e='evento')} SELECT grupo, coalesce(max(CASE WHEN em_risco >= 20 THEN tempo END), min(tempo)) AS limite FROM r WHERE d > 0 GROUP BY 1""")
def support_limits(spark, sf):
    return S.support_limits(A.cohort(spark, sf), "tempo", "evento", ["grupo"])


@query("SV18", f"""WITH {A.COHORT} SELECT l_orderkey, l_linenumber, 0.0::DOUBLE AS t_inicio, least(tempo, 300.0) AS t_fim, CASE WHEN tempo > 300 THEN 0 ELSE evento END AS evento, 0.0::DOUBLE AS depois, 0.0::DOUBLE AS quantidade_depois FROM coorte
  UNION ALL SELECT l_orderkey, l_linenumber, 300.0, tempo, evento, 1.0, quantidade FROM coorte WHERE tempo > 300""")
def follow_up_split(spark, sf):
    out = S.split_at(A.cohort(spark, sf).select("l_orderkey", "l_linenumber", "tempo", "evento", "quantidade"), "tempo", "evento", 300.0, "quantidade")
    return out.select("l_orderkey", "l_linenumber", "t_inicio", "t_fim", "evento", "depois", "quantidade_depois")


_CAUSE = f"""WITH {A.COHORT}, {_RISK.format(g='fonte', e='evento')}, k AS (SELECT fonte, tempo, em_risco, CASE WHEN coalesce(sum((em_risco = d)::INTEGER) OVER p, 0) > 0 THEN 0
    ELSE exp(coalesce(sum(CASE WHEN em_risco > d THEN ln(1 - d::DOUBLE / em_risco) ELSE 0 END) OVER p, 0)) END AS s FROM r WINDOW p AS (PARTITION BY fonte ORDER BY tempo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  p AS (SELECT fonte, causa, tempo, count(*) AS d FROM coorte WHERE causa IS NOT NULL GROUP BY ALL),
  ci AS (SELECT p.fonte, causa, p.tempo, sum(s * p.d / em_risco) OVER w AS aj, 1 - CASE WHEN sum((em_risco = p.d)::INTEGER) OVER w > 0 THEN 0
    ELSE exp(sum(CASE WHEN em_risco > p.d THEN ln(1 - p.d::DOUBLE / em_risco) ELSE 0 END) OVER w) END AS km
    FROM p JOIN k ON p.fonte = k.fonte AND p.tempo = k.tempo WINDOW w AS (PARTITION BY p.fonte, causa ORDER BY p.tempo))"""


@query("SV21", f"{_CAUSE} SELECT fonte, causa, tempo, round(aj, 7) AS aalen_johansen, round(km, 7) AS um_menos_km FROM ci")
def incidence_by_cause(spark, sf):
    return rounded(S.cause_incidence(A.cohort(spark, sf), "tempo", "causa", ["fonte"]), 7, "aalen_johansen", "um_menos_km")


@query("SV21 JN16 JN17", f"""{_CAUSE}, h AS (SELECT unnest([100.0, 400.0, 900.0])::DOUBLE AS anos), b AS (SELECT ci.*, anos, row_number() OVER (PARTITION BY fonte, causa, anos ORDER BY tempo DESC) AS i FROM ci, h WHERE tempo <= anos)
  SELECT fonte, causa, anos, round(km, 7) AS incidencia_1_menos_km FROM b WHERE i = 1""")
def incidence_at_horizons(spark, sf):
    curve = S.cause_incidence(A.cohort(spark, sf), "tempo", "causa", ["fonte"])
    out = S.incidence_at(curve, [100.0, 400.0, 900.0], ["fonte"])
    return rounded(out.select("fonte", "causa", "anos", "incidencia_1_menos_km"), 7, "incidencia_1_menos_km")


@query("SV14", f"""WITH {A.COHORT}, c AS (SELECT tempo, quantidade AS s, count(*) AS n, sum(evento) AS d FROM coorte GROUP BY ALL), t AS (SELECT DISTINCT tempo FROM c),
  a AS (SELECT s, tempo, sum(n) AS n, sum(d) AS d FROM c GROUP BY ALL),
  p AS (SELECT i.s > j.s AS maior, i.s = j.s AS igual, i.d::DOUBLE * (CASE WHEN j.tempo > i.tempo THEN j.n ELSE j.n - j.d END) AS w FROM a i JOIN a j ON j.tempo >= i.tempo WHERE i.d > 0),
  x AS (SELECT sum(CASE WHEN maior THEN w ELSE 0 END) AS c, sum(CASE WHEN NOT maior AND NOT igual THEN w ELSE 0 END) AS d, sum(CASE WHEN igual THEN w ELSE 0 END) AS e FROM p)
  SELECT c::BIGINT AS concordantes, d::BIGINT AS discordantes, e::BIGINT AS empates, round((c + e / 2) / (c + d + e), 10) AS c_index FROM x""")
def concordance_pairs(spark, sf):
    out = S.concordance(A.cohort(spark, sf), "tempo", "evento", "quantidade")
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("concordantes", "discordantes", "empates")}), 10, "c_index")


@query("SV8")
def parametric_fits(spark, sf):
    return S.parametric_fits(A.cohort(spark, sf), "tempo", "evento", by="fonte")


# ------------------------------------------------------------------------- Cox
@query("SV5 SV13")
def cox_with_source_as_covariate(spark, sf):
    df = A.cohort(spark, sf).withColumn("fonte_o", (F.col("fonte") == "O").cast("double"))
    return cox.fit(df, "tempo", "evento", [*X, "fonte_o"], with_baseline=False).table(spark)


@query("SV6 SV13 SV16")
def cox_stratified_against_known(spark, sf):
    model = cox.fit(A.cohort(spark, sf), "tempo", "evento", X, strata=["fonte"], with_baseline=False)
    return cox.compare_with_truth(model.table(spark), dict.fromkeys(X, 0.0))


@query("SV7")
def cox_penalised(spark, sf):
    got = cox.fit_penalised(A.cohort(spark, sf), "tempo", "evento", X, ["l_orderkey", "l_linenumber", "l_partkey"])
    return got["trajetoria"]


@query("SV14")
def cox_cross_validated(spark, sf):
    got = cox.cross_validated_concordance(A.cohort(spark, sf), "tempo", "evento", X, ["l_orderkey", "l_linenumber", "l_partkey"], strata=["fonte"])
    return spark.createDataFrame([(got["k"], got["cindex_medio"], got["cindex_desvio"])], "k int, cindex_medio double, cindex_desvio double")


@query("SV15 SV20")
def proportionality_tests(spark, sf):
    return cox.proportionality_test(A.cohort(spark, sf), "tempo", "evento", X, strata=["fonte"])


@query("SV20")
def effect_over_time(spark, sf):
    curve, _ = cox.effect_over_time(A.cohort(spark, sf), "tempo", "evento", X, "quantidade", strata=["fonte"])
    return curve


@query("SV19 SV18")
def effects_by_period(spark, sf):
    return cox.effects_by_period(A.cohort(spark, sf), "tempo", "evento", X, "quantidade", 300.0, strata=["fonte"])


def _units(spark, sf):
    c = A.cohort(spark, sf)
    return c.withColumn("usina_id", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).withColumn(
        "idade", F.least(F.col("tempo"), F.lit(1500.0)))


@query("SV9 SV11 SV12 SV23 SV24")
def survival_products(spark, sf):
    """Probability of no return in the next months for every line item, given its age."""
    df = _units(spark, sf)
    model = cox.fit(df, "tempo", "evento", X, strata=["fonte"])
    weibull = cox.fit_weibull(df, "tempo", "evento", X, "fonte")
    limits = S.support_limits(df, "tempo", "evento", ["fonte"], 2000)
    out = cox.product_table(model, df, "usina_id", age="idade", months=(600, 1200), weibull=weibull, limits=limits)
    return out.select("usina_id", "fonte", "risco_relativo", "tempo_mediano_anos", "p_sem_manutencao_600m", "p_sem_manutencao_1200m", "metodo_extrapolacao", "condicional_na_idade")


@query("SV17 SV11 WN11")
def calibration_by_risk_group(spark, sf):
    df = A.cohort(spark, sf)
    model = cox.fit(df, "tempo", "evento", X, strata=["fonte"])
    return cox.calibration(model, df, "tempo", "evento", (200.0, 600.0), 3)


@query("SV22")
def survivor_bias_bound(spark, sf):
    return cox.survivor_bias(A.cohort(spark, sf), "tempo", "evento", X, "fonte", F.col("tempo"), key=["l_orderkey", "l_linenumber", "l_partkey"], old=1800.0,
                             focus="quantidade", at=500.0)


# ------------------------------------------------------------------ recurrences
@query("RE1", f"WITH {A.PANEL} SELECT id_usina, fonte, episodio, evento, round(t_inicio_anos, 6) + 0.0 AS t_inicio_anos, round(t_fim_anos, 6) AS t_fim_anos, least(episodio, 6) AS estrato_episodio, fonte || '|' || least(episodio, 6) AS estrato FROM painel")
def episode_panel(spark, sf):
    out = R.add_strata(A.panel(spark, sf)).select("id_usina", "fonte", F.col("episodio").cast("long").alias("episodio"), "evento", "t_inicio_anos", "t_fim_anos",
                                                 F.col("estrato_episodio").cast("long").alias("estrato_episodio"), "estrato")
    out = out.withColumn("t_inicio_anos", F.round("t_inicio_anos", 6) + 0.0)
    return rounded(out, 6, "t_fim_anos")


_MCF = f"""WITH {A.PANEL}, u AS (SELECT fonte, id_usina, max(t_fim_anos) AS t FROM painel GROUP BY ALL), b AS (SELECT fonte, t, count(*) AS u, 0 AS d FROM u GROUP BY ALL UNION ALL
  SELECT fonte, t_fim_anos, 0, count(*) FROM painel WHERE evento = 1 GROUP BY ALL), s AS (SELECT fonte, t, sum(u) AS u, sum(d) AS d FROM b GROUP BY ALL),
  r AS (SELECT *, sum(u) OVER (PARTITION BY fonte ORDER BY t DESC) AS em_risco FROM s),
  mcf AS (SELECT fonte, t AS tempo_anos, em_risco::BIGINT AS em_risco, d::BIGINT AS eventos, sum(CASE WHEN em_risco > 0 THEN d::DOUBLE / em_risco ELSE 0 END) OVER (PARTITION BY fonte ORDER BY t) AS mcf FROM r WHERE d > 0)"""


@query("RE6", f"{_MCF} SELECT fonte, round(tempo_anos, 6) AS tempo_anos, em_risco, eventos, round(mcf, 7) AS mcf FROM mcf")
def mean_cumulative_function(spark, sf):
    out = R.mean_cumulative(A.panel(spark, sf)).withColumns({c: F.col(c).cast("long") for c in ("em_risco", "eventos")})
    return rounded(rounded(out, 6, "tempo_anos"), 7, "mcf")


@query("RE12 JN17", f"{_MCF}, h AS (SELECT unnest([1.0, 5.0, 10.0, 20.0])::DOUBLE AS anos) SELECT fonte, anos, round(coalesce(max(mcf) FILTER (WHERE tempo_anos <= anos), 0), 7) AS mcf FROM mcf, h GROUP BY 1, 2")
def mcf_at_horizons(spark, sf):
    return rounded(R.mcf_at(R.mean_cumulative(A.panel(spark, sf)), (1, 5, 10, 20)), 7, "mcf")


@query("RE12", f"""WITH {A.PANEL}, u AS (SELECT id_usina, sum(evento) AS e, count(*) AS n FROM painel GROUP BY 1)
  SELECT sum(n)::BIGINT AS episodios, count(*) AS usinas, sum(e)::BIGINT AS eventos, round(100 * avg((e >= 2)::INTEGER), 6) AS pct_com_dois_ou_mais FROM u""")
def panel_summary(spark, sf):
    return rounded(R.panel_summary(A.panel(spark, sf)), 6, "pct_com_dois_ou_mais")


@query("RE9 RE7 JN16", f"""{_MCF}, ex AS (SELECT id_usina, fonte, sum(evento)::BIGINT AS eventos, max(t_fim_anos) AS t FROM painel GROUP BY ALL),
  v AS (SELECT ex.*, (SELECT max(tempo_anos) FROM mcf WHERE mcf.fonte = ex.fonte AND tempo_anos <= t) AS t0, (SELECT min(tempo_anos) FROM mcf WHERE mcf.fonte = ex.fonte AND tempo_anos >= t) AS t1 FROM ex)
  SELECT v.id_usina, v.fonte, v.eventos, round(v.t, 6) AS observacao_anos, round(greatest(CASE WHEN t0 IS NULL THEN b.mcf WHEN t1 IS NULL OR t0 = t1 THEN a.mcf ELSE a.mcf + (b.mcf - a.mcf) * (v.t - t0) / (t1 - t0) END, 1e-6), 6) AS exposicao
  FROM v LEFT JOIN mcf a ON a.fonte = v.fonte AND a.tempo_anos = t0 LEFT JOIN mcf b ON b.fonte = v.fonte AND b.tempo_anos = t1""")
def exposure_per_unit(spark, sf):
    p = A.panel(spark, sf)
    out = R.exposure(p, R.mean_cumulative(p), [])
    return rounded(out.select("id_usina", "fonte", "eventos", "observacao_anos", "exposicao"), 6, "observacao_anos", "exposicao")


Z = ["log_potencia", "tipo_s"]


@query("RE2 RE3 RE4 SV16")
def recurrent_fits(spark, sf):
    """Andersen-Gill and both conditional models side by side."""
    p = R.add_strata(A.panel(spark, sf).cache())
    fits = {"andersen_gill": R.andersen_gill, "pwp_total": R.pwp_total, "pwp_gap": R.pwp_gap}
    models = side_by_side(spark, lambda name: fits[name](p, Z, with_baseline=False), list(fits))
    return R.compare_fits(dict(zip(fits, models)), spark)


@query("RE5")
def clustered_errors(spark, sf):
    return R.compare_errors(A.panel(spark, sf).cache(), Z)


@query("RE7 RE8")
def expected_events_per_unit(spark, sf):
    p = A.panel(spark, sf).cache()
    model = R.andersen_gill(p, Z, with_baseline=False)
    units = p.groupBy("id_usina").agg(F.min("fonte").alias("fonte"), F.max("t_inicio_anos").alias("idade_anos"), *[F.min(z).alias(z) for z in Z])
    return R.expected_per_unit(units, R.mean_cumulative(p), model, months=(24, 60, 120))


@query("RE10 RE11 RE13")
def unit_frailty(spark, sf):
    """Posterior effect of every unit and the most fragile ones first."""
    p = A.panel(spark, sf).cache()
    got = R.estimate_frailty(p, R.mean_cumulative(p), Z)
    return got["por_usina"].withColumn("theta", F.lit(got["theta"])).select(
        "id_usina", "eventos", "exposicao", "mu", "frailty_posterior", "theta").orderBy(F.desc("frailty_posterior"), "id_usina")


@query("RE13 ST3 WN7", f"""WITH {A.PANEL}, u AS (SELECT id_usina, sum(evento)::DOUBLE AS e, max(t_fim_anos) AS f FROM painel GROUP BY 1),
  r AS (SELECT rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS a, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 AS b, e, f FROM u)
  SELECT round(corr(e, f), 6) AS pearson, round(corr(a::DOUBLE, b::DOUBLE), 6) AS spearman FROM r""")
def events_against_follow_up(spark, sf):
    from brisa.operators.stats import pearson_pairs, spearman_pair
    u = A.panel(spark, sf).groupBy("id_usina").agg(F.sum(F.col("evento").cast("double")).alias("e"), F.max("t_fim_anos").alias("f")).cache()
    a = pearson_pairs(u, ["e", "f"]).select(F.round("r", 6).alias("pearson"), F.lit(1).alias("k"))
    b = spearman_pair(u, "e", "f").select(F.round("r", 6).alias("spearman"), F.lit(1).alias("k"))
    return a.join(b, "k").drop("k")




@query("SV8", f"""WITH {A.COHORT}, g AS (SELECT grupo, sum(tempo) AS t, sum(evento)::DOUBLE AS d FROM coorte GROUP BY 1)
  SELECT grupo, 'exponencial' AS modelo, round(t / d, 6) AS p1, round(t / d * ln(2), 6) AS mediana_prevista, round(2 + 2 * (d * ln(t / d) + d), 4) AS aic FROM g""")
def exponential_fits(spark, sf):
    out = S.parametric_fits(A.cohort(spark, sf), "tempo", "evento", ("exponencial",), by="grupo")
    return rounded(rounded(out.select("grupo", "modelo", "p1", "mediana_prevista", "aic"), 6, "p1", "mediana_prevista"), 4, "aic")


@query("SV23 FN25 FN26", f"""WITH {A.DIM} SELECT usina_id, round(date_diff('day', data_operacao, DATE '2026-01-01') / 365.25, 6) AS idade_anos, round(ln(potencia_mw) - ln(30), 6) AS log_potencia_mw_c,
  (regiao = 'ASIA')::INTEGER::DOUBLE AS subsistema_NE, (year(data_operacao) - 2018)::DOUBLE AS ano_entrada_c FROM dim WHERE potencia_mw IS NOT NULL""")
def units_ready_for_prediction(spark, sf):
    d = A.dim(spark, sf).withColumn("regiao", F.when(F.col("regiao") == "ASIA", "NE").otherwise("SE"))
    out = cox.units_for_prediction(d, "2026-01-01").select("usina_id", "idade_anos", "log_potencia_mw_c", "subsistema_NE", "ano_entrada_c")
    return rounded(out, 6, "idade_anos", "log_potencia_mw_c")


def _mcf_at(name, at):
    return f"""{name}0 AS (SELECT x.id_usina, max(m.tempo_anos) AS t FROM uni x JOIN mcf m ON m.fonte = x.fonte AND m.tempo_anos <= {at} GROUP BY 1),
  {name}1 AS (SELECT x.id_usina, min(m.tempo_anos) AS t FROM uni x JOIN mcf m ON m.fonte = x.fonte AND m.tempo_anos >= {at} GROUP BY 1),
  {name} AS (SELECT x.id_usina, CASE WHEN l.t IS NULL THEN h.mcf WHEN r.t IS NULL OR l.t = r.t THEN g.mcf ELSE g.mcf + (h.mcf - g.mcf) * ({at} - l.t) / (r.t - l.t) END AS v
    FROM uni x LEFT JOIN {name}0 l ON l.id_usina = x.id_usina LEFT JOIN {name}1 r ON r.id_usina = x.id_usina
    LEFT JOIN mcf g ON g.fonte = x.fonte AND g.tempo_anos = l.t LEFT JOIN mcf h ON h.fonte = x.fonte AND h.tempo_anos = r.t)"""


@query("RE7", f"""{_MCF}, uni AS (SELECT id_usina, fonte, max(t_inicio_anos) AS idade FROM painel GROUP BY ALL), {_mcf_at('i', 'x.idade')}, {_mcf_at('f', '(x.idade + 5)')}
  SELECT uni.id_usina, round(idade, 6) AS idade_anos, round(f.v - i.v, 6) + 0.0 AS esperados FROM uni JOIN i ON i.id_usina = uni.id_usina JOIN f ON f.id_usina = uni.id_usina""")
def expected_events_ahead(spark, sf):
    """Events a mean unit of the source has in the next five days of its life."""
    p = A.panel(spark, sf)
    units = p.groupBy("id_usina").agg(F.min("fonte").alias("fonte"), F.max("t_inicio_anos").alias("idade_anos"))
    out = R.expected_events(units, R.mean_cumulative(p), "idade_anos", [5.0])
    return out.select("id_usina", F.round("idade_anos", 6).alias("idade_anos"), (F.round("esperados_0", 6) + 0.0).alias("esperados"))


@query("RE11", f"WITH {A.PANEL} SELECT id_usina, sum(evento)::BIGINT AS eventos, round((4 + sum(evento)) / (4 + max(t_fim_anos) / 10), 7) AS frailty_posterior FROM painel GROUP BY 1")
def posterior_effect(spark, sf):
    """Posterior effect at theta 0.25 when one event per ten days is expected."""
    u = A.panel(spark, sf).groupBy("id_usina").agg(F.sum(F.col("evento").cast("long")).alias("eventos"), (F.max("t_fim_anos") / 10).alias("mu"))
    return rounded(R.posterior(u, 0.25).drop("mu"), 7, "frailty_posterior")
