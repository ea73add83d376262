"""Series, leak-free features, rolling-origin folds, baselines, boosting, errors."""

from __future__ import annotations

import time as clock
from collections.abc import Sequence
from copy import copy
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window as W, functions as F

from brisa.constants import (BACKTEST_WINDOWS, HORIZON_H, LAGS_H, LOCAL_ZONE, MAPE_FLOOR, MIN_TRAIN_H, ROLLING_H)
from brisa.functions.dates import calendar_features, utc_to_local
from brisa.operators import ordered
from brisa.operators.grid import complete_grid
from brisa.operators.serving import top_units
from brisa.session import cut

TARGET = "energia_mwh"
CLIMATE = ("irradiancia_kwh_m2", "vento_ms", "temperatura_c", "temperatura_max_c", "temperatura_min_c")
CALENDAR_PARTS = ("hora", "dia_semana", "mes", "fim_de_semana")


def _assemble(hourly: DataFrame, daily: DataFrame | None, zone: str, climate: Sequence[str]) -> DataFrame:
    """Complete local-time hourly grid per series with the climate of the day."""
    local = hourly.withColumn("data_hora", utc_to_local(F.col("data_hora"), zone))
    full = complete_grid(local, "serie", "data_hora", ["fonte"]).drop("criada")
    if daily is None:
        return full
    return (full.withColumn("__d", F.to_date("data_hora"))
            .join(daily.select("serie", F.col("data").alias("__d"), *climate), ["serie", "__d"], "left").drop("__d"))


def series_by_source(fact: DataFrame, climate: DataFrame | None = None, dim: DataFrame | None = None,
                     zone: str = LOCAL_ZONE, columns: Sequence[str] = CLIMATE) -> DataFrame:
    """One series per source: energy of all its units and the mean climate."""
    hourly = fact.groupBy(F.col("fonte").alias("serie"), F.col("fonte"), F.col("timestamp_utc").alias("data_hora")).agg(
        F.sum("energia_mwh").alias(TARGET))
    daily = None
    if climate is not None:
        daily = climate.join(dim.select("usina_id", F.col("fonte").alias("serie")), "usina_id").groupBy(
            "serie", "data").agg(*[F.avg(c).alias(c) for c in columns])
    return _assemble(hourly, daily, zone, columns)


def series_by_unit(fact: DataFrame, climate: DataFrame | None = None, units: Sequence[int] | None = None,
                   top: int = 3, zone: str = LOCAL_ZONE, columns: Sequence[str] = CLIMATE) -> DataFrame:
    """One series per unit: the named ones, or those with the most energy."""
    if units:
        rows = fact.filter(F.col("usina_id").isin(*units))
    else:
        rows = fact.join(F.broadcast(top_units(fact, top).select("usina_id")), "usina_id", "left_semi")
    name = F.concat(F.lit("usina_"), F.col("usina_id").cast("string"))
    hourly = rows.select(name.alias("serie"), "fonte", F.col("timestamp_utc").alias("data_hora"), TARGET)
    daily = None if climate is None else climate.select(name.alias("serie"), "data", *columns)
    return _assemble(hourly, daily, zone, columns)


def build_features(series: DataFrame, horizon: int = HORIZON_H, lags: Sequence[int] = LAGS_H,
                   windows: Sequence[int] = ROLLING_H, key: str = "serie", time: str = "data_hora",
                   target: str = TARGET) -> DataFrame:
    """Calendar, lags and shifted rolling statistics; none sees the horizon.

    One shuffle: each chunk of a series gets the rows behind it that its windows
    need, so a long series is spread over many tasks.
    """
    early = [k for k in lags if k < horizon]
    if early:
        raise ValueError(f"lags {early} are shorter than the horizon {horizon} and would leak")
    reach = max([*lags, *[horizon + w - 1 for w in windows]])
    halo = ordered.with_halo(calendar_features(series, time, CALENDAR_PARTS, cyclic=True), time, 3600, before=reach)
    place = W.partitionBy(key, "__chunk").orderBy("__i")
    new = {f"lag_{k}h": F.lag(target, k).over(place) for k in lags}
    for w in windows:
        frame = place.rowsBetween(-(horizon + w - 1), -horizon)
        enough = F.count(target).over(frame) >= max(2, w // 4)
        new[f"media_{w}h"] = F.when(enough, F.avg(target).over(frame))
        new[f"desvio_{w}h"] = F.when(enough, F.stddev_samp(target).over(frame))
    return ordered.drop_halo(halo.withColumns(new))


def feature_columns(df: DataFrame, target: str = TARGET, ids: Sequence[str] = ("serie", "fonte", "data_hora")) -> list[str]:
    return [c for c in df.columns if c != target and c not in ids]


# ----------------------------------------------------------------------- folds
def folds(series: DataFrame, n: int = BACKTEST_WINDOWS, horizon: int = HORIZON_H, min_train: int = MIN_TRAIN_H,
          key: str = "serie", time: str = "data_hora") -> DataFrame:
    """(series, janela, inicio, fim): test windows of a regular grid, oldest first.
    The training part of a window is everything before `inicio`."""
    spans = series.groupBy(key).agg(F.min(time).alias("__a"), F.max(time).alias("__z"),
                                    F.count(F.lit(1)).alias("__n"))
    last = F.col("__n") - horizon
    cuts = spans.withColumn("__corte", F.explode(F.sequence(
        (last - (n - 1) * horizon).cast("int"), last.cast("int"), F.lit(horizon)))).filter(
        F.col("__corte") >= min_train)
    number = F.row_number().over(W.partitionBy(key).orderBy("__corte"))     # n rows per series
    return cuts.select(key, number.alias("janela"),
                       F.timestamp_add("HOUR", F.col("__corte"), F.col("__a")).alias("inicio"),
                       F.timestamp_add("HOUR", F.col("__corte") + (horizon - 1), F.col("__a")).alias("fim"),
                       F.col("__corte").cast("long").alias("horas_treino"))


def test_rows(series: DataFrame, fold: DataFrame, key: str = "serie", time: str = "data_hora") -> DataFrame:
    """Rows of every test window. The rows are found by equality on the hours each
    window lists, not by comparing all rows with all windows."""
    hours = fold.select(key, "janela", "inicio", F.explode(
        F.sequence("inicio", "fim", F.expr("INTERVAL 1 HOUR"))).alias(time))
    return hours.join(series, [key, time])


def seasonal_baselines(series: DataFrame, fold: DataFrame, days: int = 7, key: str = "serie",
                       time: str = "data_hora", target: str = TARGET) -> DataFrame:
    """Forecasts of both baselines for every window in one plan: the value of the
    day before and the mean of the same hour over `days` days, from training only."""
    tests = test_rows(series, fold, key, time).select(key, "fonte", "janela", "inicio", time, F.col(target).alias("y"))
    back = tests.select(key, "janela", "inicio", time, F.explode(F.sequence(F.lit(1), F.lit(days))).alias("__d"))
    back = back.withColumn("__t", F.col(time) - F.make_dt_interval(days=F.col("__d")))
    back = back.filter(F.col("__t") < F.col("inicio"))
    past = series.select(key, F.col(time).alias("__t"), F.col(target).alias("__v"))
    got = back.join(past, [key, "__t"]).groupBy(key, "janela", time).agg(
        F.max(F.when(F.col("__d") == 1, F.col("__v"))).alias("naive_sazonal"),
        F.avg("__v").alias("media_movel_sazonal"))
    wide = tests.join(got, [key, "janela", time], "left")
    models = ("naive_sazonal", "media_movel_sazonal")
    pairs = F.array(*[F.struct(F.lit(m).alias("modelo"), F.col(m).alias("previsto")) for m in models])
    return wide.select(key, "fonte", "janela", time, "y", F.explode(pairs).alias("__p")).select(
        key, "fonte", F.col("__p.modelo").alias("modelo"), "janela", time, "y",
        F.col("__p.previsto").alias("previsto"))


# -------------------------------------------------------------------- boosting
#: Training rows that a task should hold at least: trees take hundreds of jobs, each as long as its tasks are many.
TASK_ROWS = 50_000


class Boosting:
    """Boosted trees over the features; nulls become the training mean plus a mark."""

    name = "gradient_boosting"

    def __init__(self, horizon: int = HORIZON_H, trees: int = 60, depth: int = 5, step: float = 0.1,
                 lags: Sequence[int] = LAGS_H, windows: Sequence[int] = ROLLING_H):
        self.horizon, self.trees, self.depth, self.step = horizon, trees, depth, step
        self.lags, self.windows = lags, windows
        self.model = None

    def features(self, series: DataFrame) -> DataFrame:
        return build_features(series, self.horizon, self.lags, self.windows)

    def fit(self, features: DataFrame) -> "Boosting":
        train = features.filter(F.col(TARGET).isNotNull())
        self.columns = feature_columns(features, ids=("serie", "fonte", "data_hora", "janela", "inicio", "fim"))
        row = train.agg(F.count(F.lit(1)).alias("__n"), *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in self.columns],
                        *[F.count(c).alias(f"n_{c}") for c in self.columns]).first()
        self.means = {c: row[f"m_{c}"] or 0.0 for c in self.columns}
        # one model serves all series: the mean of its series is what a row knows about it
        self.level = cut(train.groupBy("serie").agg(F.avg(TARGET).alias("__nivel")))
        self.overall = train.agg(F.avg(TARGET)).first()[0] or 0.0
        self.marked = [c for c in self.columns if row[f"n_{c}"] < row["__n"]]
        self.inputs = [*self.columns, *[f"{c}_nulo" for c in self.marked], "__nivel"]
        gbt = GBTRegressor(featuresCol="__x", labelCol=TARGET, predictionCol="previsto", maxIter=self.trees,
                           maxDepth=self.depth, stepSize=self.step, seed=42)
        tasks = max(-(-row["__n"] // TASK_ROWS), 1)
        vectors = self._vector(train).select("__x", TARGET).coalesce(tasks).cache()
        self.model = gbt.fit(vectors)
        vectors.unpersist()
        return self

    def _vector(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns({f"{c}_nulo": F.col(c).isNull().cast("double") for c in self.marked})
        filled = filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(self.means[c])) for c in self.columns})
        filled = filled.join(self.level, "serie", "left").fillna(self.overall, ["__nivel"])
        return VectorAssembler(inputCols=self.inputs, outputCol="__x").transform(filled)

    def predict(self, features: DataFrame) -> DataFrame:
        out = self.model.transform(self._vector(features).withColumn("__y", F.col(TARGET)))
        return out.withColumn("previsto", F.greatest("previsto", F.lit(0.0))).drop("__x", "__y", "__nivel")

    def importance(self, features: DataFrame, repeats: int = 5, key: Sequence[str] = ("serie", "data_hora")) -> DataFrame:
        """Rise of the squared error when one feature is dealt out again at random."""
        rows = features.filter(F.col(TARGET).isNotNull())
        error = F.avg(F.pow(F.col("previsto") - F.col(TARGET), 2))
        base = self.predict(rows).agg(error).first()[0]
        rise = dict.fromkeys(self.columns, 0.0)
        for r in range(repeats):
            # a copy of each row for every feature, which takes that one from the partner: one job deals out all
            mixed = with_partners(rows, self.columns, key, seed=r).withColumn(
                "__which", F.explode(F.sequence(F.lit(0), F.lit(len(self.columns) - 1))))
            mixed = mixed.withColumns({c: F.when(F.col("__which") == i, F.col(f"__partner.`{c}`")).otherwise(F.col(c))
                                       for i, c in enumerate(self.columns)}).drop("__partner")
            for found in self.predict(mixed).groupBy("__which").agg(error.alias("e")).collect():
                rise[self.columns[found["__which"]]] += (found["e"] - base) / repeats
        return features.sparkSession.createDataFrame(
            [(c, float(v)) for c, v in rise.items()], "feature string, importancia double").orderBy(F.desc("importancia"))


def with_partners(df: DataFrame, columns: Sequence[str], key: Sequence[str], seed: int = 0) -> DataFrame:
    """Pair every row with another one at random: rows stand in a ring in the order of a hash of the
    key, cut in parts, and each takes the next one. `__partner` holds the columns of the other row, so
    that one shuffle serves every column; each row is the partner of one row."""
    parts = min(64 * ordered.bucket_count(df), ordered.MAX_BUCKETS)
    place = ["__h", *dict.fromkeys(columns)]                # the key itself need not travel
    rows = df.withColumn("__h", F.xxhash64(F.lit(f"a{seed}"), *key)).withColumn("__k", F.pmod("__h", F.lit(parts)).cast("int"))
    # one row per part: the first row of the next part that has rows, after the last part that of the first
    low = rows.groupBy("__k").agg(F.min("__h").alias("__h"))
    heads = rows.join(F.broadcast(low), ["__k", "__h"]).groupBy("__k").agg(F.min(F.struct(*columns)).alias("__head"))
    ring, around = W.orderBy("__k"), W.orderBy("__k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select("__k", F.coalesce(F.lead("__head").over(ring), F.first("__head").over(around)).alias("__head"))
    inside = W.partitionBy("__k").orderBy(*place)
    paired = rows.withColumn("__next", F.lead(F.struct(*columns)).over(inside)).join(F.broadcast(heads), "__k")
    return paired.withColumn("__partner", F.coalesce("__next", "__head")).drop("__h", "__k", "__next", "__head")


def backtest(series: DataFrame, n: int = BACKTEST_WINDOWS, horizon: int = HORIZON_H, min_train: int = MIN_TRAIN_H,
             boosting: Boosting | None = None) -> tuple[DataFrame, DataFrame]:
    """(forecasts, seconds per fit): all models on the same windows, training strictly before the
    test. Trees are fitted once for each window, over all series; `falha` says why a fit failed, and
    its window has no forecast of that model then."""
    spark = series.sparkSession
    fold = folds(series, n, horizon, min_train)
    panel = seasonal_baselines(series, fold)
    times: list = []
    if boosting:
        features = boosting.features(series).cache()
        marked = features.drop("janela", "inicio", "fim").join(fold.select("serie", "janela", "inicio", "fim"), "serie")
        features.count()                    # written to the cache once, before the windows share it

        def one(w):
            own, start, model = marked.filter(F.col("janela") == w), clock.perf_counter(), copy(boosting)
            try:
                model.fit(own.filter(F.col("data_hora") < F.col("inicio")))
                test = own.filter(F.col("data_hora").between(F.col("inicio"), F.col("fim")))
                told, failed = cut(model.predict(test).select(
                    "serie", "fonte", F.lit(model.name).alias("modelo"), "janela", "data_hora", F.col(TARGET).alias("y"), "previsto")), None
            except Exception as error:      # one model must not end the comparison: the table says why
                told, failed = None, f"{type(error).__name__}: {error}"[:500]
            return model, told, (boosting.name, int(w), clock.perf_counter() - start, failed)
        windows = sorted(r[0] for r in fold.select("janela").distinct().collect())       # n at most
        with ThreadPool(max(min(len(windows), 6), 1)) as pool:      # windows side by side: their jobs are many and short
            got = pool.map(inheritable_thread_target(spark)(one), windows, chunksize=1)
        for model, told, row in got:
            panel = panel if told is None else panel.unionByName(told)
            boosting.__dict__.update(model.__dict__)                # left as the last window made it
            times.append(row)
    fits = spark.createDataFrame(times, "modelo string, janela int, segundos double, falha string")
    return panel, fold.select("serie", F.col("janela").cast("int").alias("janela")).join(F.broadcast(fits), "janela")


# ---------------------------------------------------------------------- errors
def error_metrics(panel: DataFrame, by: Sequence[str] = ("serie", "fonte", "modelo"),
                  floor: float = MAPE_FLOOR) -> DataFrame:
    """Errors per group. Percent errors use only observations above a floor, a
    share of the group mean; the mean is a first small aggregate."""
    by = list(by)
    rows = panel.filter(F.col("y").isNotNull() & F.col("previsto").isNotNull())
    means = rows.groupBy(*by).agg(F.avg("y").alias("__m"))
    e = F.col("y") - F.col("previsto")
    above = F.col("y") > F.lit(floor) * F.col("__m")
    half = (F.abs("y") + F.abs("previsto")) / 2
    out = rows.join(means, by).groupBy(*by).agg(
        F.count_distinct("janela").alias("janelas"), F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.when(above, F.abs(F.try_divide(e, F.col("y"))))) * 100).alias("mape_pct"),
        (F.avg(F.when(above, F.try_divide(F.abs(e), half))) * 100).alias("smape_pct"),
        F.avg(e).alias("vies"), (F.avg(above.cast("double")) * 100).alias("cobertura_pct"),
        F.max("__m").alias("__m"))
    return out.withColumn("nrmse_pct", F.try_divide("rmse", "__m") * 100).drop("__m")


def gain_over(metrics: DataFrame, baseline: str = "naive_sazonal") -> DataFrame:
    base = metrics.filter(F.col("modelo") == baseline).select("serie", F.col("rmse").alias("__b"))
    return metrics.join(base, "serie", "left").withColumn(
        "ganho_pct", (1 - F.try_divide("rmse", "__b")) * 100).drop("__b")


def best_models(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("serie").agg(F.min(F.struct("rmse", "modelo")).alias("__b")).select(
        "serie", F.col("__b.modelo").alias("modelo"), F.col("__b.rmse").alias("rmse"))


def with_fit_time(metrics: DataFrame, times: DataFrame) -> DataFrame:
    mean = times.groupBy("serie", "modelo").agg(F.round(F.avg("segundos"), 2).alias("seg_por_ajuste"))
    return metrics.join(mean, ["serie", "modelo"], "left")


def last_window_view(series: DataFrame, panel: DataFrame, context_days: int = 3, key: str = "serie",
                     time: str = "data_hora", target: str = TARGET) -> DataFrame:
    """Last window of every model and the observed hours from some days before."""
    top = panel.groupBy(key).agg(F.max("janela").alias("__w"))
    last = panel.join(top, key).filter(F.col("janela") == F.col("__w"))
    starts = last.groupBy(key).agg((F.min(time) - F.make_dt_interval(days=F.lit(context_days))).alias("__s"))
    seen = series.join(starts, key).filter(F.col(time) >= F.col("__s")).select(
        key, F.lit("observado").alias("modelo"), time, F.col(target).alias("valor"))
    return last.select(key, "modelo", time, F.col("previsto").alias("valor")).unionByName(seen)


# ----------------------------------------------------------------- next day
def future_hours(series: DataFrame, horizon: int = HORIZON_H, climate: Sequence[str] = (), key: str = "serie",
                 time: str = "data_hora", target: str = TARGET) -> DataFrame:
    """The next hours of every series; the climate of the last day is repeated."""
    ends = series.groupBy(key).agg(F.max(time).alias("__z"), F.max("fonte").alias("fonte"))
    ahead = ends.select(key, "fonte", "__z", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("__h")).withColumn(
        time, F.timestamp_add("HOUR", F.col("__h"), F.col("__z")))
    if climate:
        days = -(-horizon // 24)
        back = ahead.withColumn("__t", F.col(time) - F.make_dt_interval(days=F.lit(days)))
        past = series.select(key, F.col(time).alias("__t"), *climate)
        ahead = back.join(past, [key, "__t"], "left").drop("__t")
    return ahead.withColumn(target, F.lit(None).cast("double")).select(key, "fonte", time, target, *climate)


def next_day(series: DataFrame, model: Boosting, climate: Sequence[str] = ()) -> DataFrame:
    """Forecast of the hours after the last observed one."""
    future = future_hours(series, model.horizon, climate)
    both = series.select(*future.columns).withColumn("__f", F.lit(False)).unionByName(
        future.withColumn("__f", F.lit(True)))
    features = model.features(both).filter("__f").drop("__f")
    return model.predict(features).select("serie", "fonte", F.col("data_hora").alias("timestamp"),
                                          F.col("previsto").alias("energia_mwh_prevista"))


def unit_forecast(source_forecast: DataFrame, share: DataFrame) -> DataFrame:
    """Source forecast times the share of each unit in its source."""
    return source_forecast.join(share, "fonte").withColumn(
        "energia_mwh_prevista", F.col("energia_mwh_prevista") * F.col("participacao"))
