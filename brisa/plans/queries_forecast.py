"""Series, features, folds, baselines, errors and forecasts on the hourly events."""

from __future__ import annotations

from pyspark.sql import functions as F

from brisa.operators import forecast as FC
from brisa.operators.cleaning import label_encode
from brisa.operators.serving import shares
from brisa.plans import adapters as A
from brisa.plans.adapters import rounded, table, text_time
from brisa.plans.registry import query

LOCAL = "(timestamp_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/Sao_Paulo')"
SERIES = f"""fonte_hora AS (SELECT event_type AS serie, date_trunc('hour', ts) AS timestamp_utc, sum(value) AS e FROM events GROUP BY ALL),
  local AS (SELECT serie, {LOCAL} AS data_hora, e FROM fonte_hora),
  flim AS (SELECT serie, min(data_hora) AS a, max(data_hora) AS z FROM local GROUP BY 1),
  fgrade AS (SELECT serie, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS data_hora FROM flim),
  series AS (SELECT g.serie, g.serie AS fonte, g.data_hora, e AS energia_mwh FROM fgrade g LEFT JOIN local l ON g.serie = l.serie AND g.data_hora = l.data_hora)"""


def _fact(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("fonte"), F.col("user_id").cast("long").alias("usina_id"), A.hour_of("ts").alias("timestamp_utc")).agg(
        F.sum("value").alias("energia_mwh"))


def _series(spark, sf):
    return FC.series_by_source(_fact(spark, sf))


@query("FC1 AG20 JN14", f"""WITH {SERIES}, {A.CLIMATE}, t AS (SELECT *, row_number() OVER (ORDER BY serie) - 1 AS k FROM (SELECT DISTINCT serie FROM series)),
  d AS (SELECT right(local, 1)::INTEGER % 5 AS k, data, avg(temperatura_c) AS temperatura_c FROM clima GROUP BY ALL)
  SELECT s.serie, CAST(data_hora AS VARCHAR) AS data_hora, round(energia_mwh, 4) AS energia_mwh, fonte, round(temperatura_c, 6) AS temperatura_c
  FROM series s JOIN t ON s.serie = t.serie LEFT JOIN d ON d.k = t.k AND data_hora::DATE = data""")
def series_per_source_with_climate(spark, sf):
    """Sources are event types in alphabetical order; a point belongs to the source
    of its last digit."""
    fact = _fact(spark, sf)
    dim = label_encode(fact.select("fonte").distinct(), "fonte", "usina_id")
    unit = F.pmod(F.substring("local", -1, 1).cast("int"), F.lit(5)).cast("long")
    climate = A.daily_climate(spark, sf).groupBy(unit.alias("usina_id"), "data").agg(F.avg("temperatura_c").alias("temperatura_c"))
    out = FC.series_by_source(fact, climate, dim, columns=["temperatura_c"])
    return rounded(rounded(text_time(out, "data_hora"), 4, "energia_mwh"), 6, "temperatura_c")


@query("FC2 WN4", f"""WITH {A.HOURLY}, t AS (SELECT usina_id FROM horas GROUP BY 1 ORDER BY sum(v) DESC, 1 LIMIT 5), l AS (SELECT usina_id, {LOCAL} AS h, v FROM horas JOIN t USING (usina_id)),
  m AS (SELECT usina_id, min(h) AS a, max(h) AS z FROM l GROUP BY 1), g AS (SELECT usina_id, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS h FROM m)
  SELECT 'usina_' || g.usina_id AS serie, CAST(g.h AS VARCHAR) AS data_hora, round(v, 4) AS energia_mwh, 'x' AS fonte FROM g LEFT JOIN l ON g.usina_id = l.usina_id AND g.h = l.h""")
def series_of_top_units(spark, sf):
    out = FC.series_by_unit(A.hourly(spark, sf).withColumn("fonte", F.lit("x")), top=5)
    return rounded(text_time(out.select("serie", "data_hora", "energia_mwh", "fonte"), "data_hora"), 4, "energia_mwh")


def _roll(w, h=24):
    frame = f"(PARTITION BY serie ORDER BY data_hora ROWS BETWEEN {h + w - 1} PRECEDING AND {h} PRECEDING)"
    enough = f"count(energia_mwh) OVER {frame} >= {max(2, w // 4)}"
    return (f"round(CASE WHEN {enough} THEN avg(energia_mwh) OVER {frame} END, 9) AS media_{w}h, "
            f"round(CASE WHEN {enough} THEN stddev_samp(energia_mwh) OVER {frame} END, 7) AS desvio_{w}h")


@query("FC3 FC4 WN1 WN2", f"""WITH {SERIES} SELECT serie, CAST(data_hora AS VARCHAR) AS data_hora, round(energia_mwh, 4) AS energia_mwh, hour(data_hora) AS data_hora_hora,
  (isodow(data_hora) >= 6)::INTEGER::BIGINT AS data_hora_fim_de_semana, {', '.join(f'round(lag(energia_mwh, {k}) OVER (PARTITION BY serie ORDER BY data_hora), 4) AS lag_{k}h' for k in (24, 25, 26, 48, 72, 168))},
  {', '.join(_roll(w) for w in (24, 72, 168))} FROM series""")
def feature_table(spark, sf):
    df = FC.build_features(_series(spark, sf))
    names = FC.feature_columns(df)
    df = df.select("serie", "data_hora", "energia_mwh", *[c for c in names if not c.endswith(("_sen", "_cos", "_mes", "_dia_semana"))])
    df = df.withColumns({c: F.col(c).cast("long") for c in ("data_hora_hora", "data_hora_fim_de_semana")})
    named = lambda start: [c for c in df.columns if c.startswith(start)]
    df = rounded(text_time(df, "data_hora"), 4, "energia_mwh", *named("lag_"))
    return rounded(rounded(df, 9, *named("media_")), 7, *named("desvio_"))


FOLDS = """dobras AS (SELECT serie, row_number() OVER (PARTITION BY serie ORDER BY c) AS janela, a + INTERVAL 1 HOUR * c AS inicio, a + INTERVAL 1 HOUR * (c + 23) AS fim, c AS horas_treino FROM (
  SELECT serie, min(data_hora) AS a, unnest(range(count(*) - 24 * 6, count(*) - 23, 24)) AS c FROM series GROUP BY 1) WHERE c >= 480)"""


def _folds(series):
    return FC.folds(series, 6, 24, 480)


@query("FC5", f"WITH {SERIES}, {FOLDS} SELECT serie, janela, CAST(inicio AS VARCHAR) AS inicio, CAST(fim AS VARCHAR) AS fim, horas_treino FROM dobras")
def rolling_origin_folds(spark, sf):
    return text_time(_folds(_series(spark, sf)), "inicio", "fim").withColumn("janela", F.col("janela").cast("long"))


PANEL = f"""{SERIES}, {FOLDS}, testes AS (SELECT s.*, janela, inicio FROM series s JOIN dobras d ON s.serie = d.serie AND data_hora BETWEEN inicio AND fim),
  tras AS (SELECT t.serie, t.janela, t.data_hora, max(CASE WHEN k.d = 1 THEN p.energia_mwh END) AS naive, avg(p.energia_mwh) AS media
    FROM testes t CROSS JOIN (SELECT unnest(range(1, 8)) AS d) k JOIN series p ON p.serie = t.serie AND p.data_hora = t.data_hora - INTERVAL 1 DAY * k.d AND p.data_hora < t.inicio GROUP BY ALL),
  largo AS (SELECT t.serie, t.fonte, t.janela, t.data_hora, t.energia_mwh AS y, naive, media FROM testes t LEFT JOIN tras b ON t.serie = b.serie AND t.janela = b.janela AND t.data_hora = b.data_hora),
  painel AS (SELECT serie, fonte, 'naive_sazonal' AS modelo, janela, data_hora, y, naive AS previsto FROM largo UNION ALL SELECT serie, fonte, 'media_movel_sazonal', janela, data_hora, y, media FROM largo)"""


@query("FC6 FC7 FC9", f"WITH {PANEL} SELECT serie, fonte, modelo, janela, CAST(data_hora AS VARCHAR) AS data_hora, round(y, 4) AS y, round(previsto, 5) AS previsto FROM painel")
def baseline_forecasts(spark, sf):
    s = _series(spark, sf)
    out = FC.seasonal_baselines(s, _folds(s)).withColumn("janela", F.col("janela").cast("long"))
    return rounded(rounded(text_time(out, "data_hora"), 4, "y"), 5, "previsto")


METRICS = f"""{PANEL}, ok AS (SELECT *, avg(y) OVER (PARTITION BY serie, modelo) AS m FROM painel WHERE y IS NOT NULL AND previsto IS NOT NULL),
  metricas AS (SELECT serie, fonte, modelo, count(DISTINCT janela) AS janelas, count(*) AS n, sqrt(avg(pow(y - previsto, 2))) AS rmse, avg(abs(y - previsto)) AS mae,
  100 * avg(CASE WHEN y > 0.05 * m THEN abs((y - previsto) / y) END) AS mape_pct, 100 * avg(CASE WHEN y > 0.05 * m THEN abs(y - previsto) / ((abs(y) + abs(previsto)) / 2) END) AS smape_pct,
  avg(y - previsto) AS vies, 100 * avg((y > 0.05 * m)::INTEGER) AS cobertura_pct, 100 * sqrt(avg(pow(y - previsto, 2))) / any_value(m) AS nrmse_pct FROM ok GROUP BY ALL)"""
_M = ("rmse", "mae", "mape_pct", "smape_pct", "vies", "cobertura_pct", "nrmse_pct")


def _panel(spark, sf):
    s = _series(spark, sf)
    return s, FC.seasonal_baselines(s, _folds(s))


@query("FC10 FC11", f"WITH {METRICS} SELECT serie, fonte, modelo, janelas, n, {', '.join(f'round({c}, 6) AS {c}' for c in _M)} FROM metricas")
def error_metrics(spark, sf):
    return rounded(FC.error_metrics(_panel(spark, sf)[1]), 6, *_M)


@query("FC12 FC13", f"""WITH {METRICS} SELECT m.serie, m.modelo, round((1 - m.rmse / b.rmse) * 100, 6) + 0.0 AS ganho_pct, m.rmse = (SELECT min(rmse) FROM metricas x WHERE x.serie = m.serie) AS melhor
  FROM metricas m JOIN metricas b ON b.serie = m.serie AND b.modelo = 'naive_sazonal'""")
def gain_and_best_model(spark, sf):
    m = FC.error_metrics(_panel(spark, sf)[1]).cache()      # one row per series and model
    best = FC.best_models(m).select("serie", "modelo", F.lit(True).alias("melhor"))
    out = FC.gain_over(m).join(best, ["serie", "modelo"], "left")
    return out.select("serie", "modelo", (F.round("ganho_pct", 6) + 0.0).alias("ganho_pct"), F.coalesce("melhor", F.lit(False)).alias("melhor"))


@query("FC17", f"""WITH {PANEL}, u AS (SELECT serie, max(janela) AS j FROM painel GROUP BY 1), ult AS (SELECT p.* FROM painel p JOIN u ON p.serie = u.serie AND p.janela = u.j),
  c AS (SELECT serie, min(data_hora) - INTERVAL 3 DAY AS s FROM ult GROUP BY 1)
  SELECT serie, modelo, CAST(data_hora AS VARCHAR) AS data_hora, round(previsto, 5) AS valor FROM ult
  UNION ALL SELECT x.serie, 'observado', CAST(data_hora AS VARCHAR), round(energia_mwh, 5) FROM series x JOIN c ON x.serie = c.serie AND data_hora >= s""")
def last_window_against_observed(spark, sf):
    s, panel = _panel(spark, sf)
    return rounded(text_time(FC.last_window_view(s, panel), "data_hora"), 5, "valor")


def _boosting():
    return FC.Boosting()


@query("FC8 FC9 FC18 FC11")
def boosting_backtest(spark, sf):
    """Boosted trees and both baselines on the same window, with fit seconds."""
    s = _series(spark, sf).cache()
    panel, times = FC.backtest(s, 6, 24, 480, _boosting())
    return FC.with_fit_time(FC.gain_over(FC.error_metrics(panel)), times)


@query("FC14 FC15 SNK5")
def next_day_per_unit(spark, sf):
    """Next-day forecast per source, kept and read back, dealt to units by their share."""
    import uuid

    from brisa.session import shared_folder
    from brisa.sources.models import load_model, save_model
    fact = _fact(spark, sf)
    s = FC.series_by_source(fact).cache()
    model = _boosting()
    model.fit(model.features(s))
    path = save_model(model.model, f"{shared_folder(spark)}/brisa-{uuid.uuid4().hex}", {"horizonte_h": model.horizon})
    model.model, _ = load_model(spark, path)
    return FC.unit_forecast(FC.next_day(s, model), shares(fact, 30))


@query("FC16 ML7")
def boosting_importance(spark, sf):
    s = _series(spark, sf)
    model = _boosting()
    features = model.features(s).cache()
    model.fit(features)
    return model.importance(features)
