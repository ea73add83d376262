"""Time-to-event work: preparation, curves, tests, parametric fits, concordance.

Everything starts from counts per (group, time). Risk sets are sums over the
times that follow, made range by range (see `ordered`), so neither a large group
nor a time shared by many rows lands in one task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from brisa.constants import DAYS_PER_UNIT, MIN_AT_RISK
from brisa.functions.numeric import normal_cdf
from brisa.functions.special import sum_inverse
from brisa.operators import ordered
from brisa.operators.joins import curve_lookup, step_lookup
from brisa.session import Tails, table_in_shared_folder

Z95 = 1.959963984540054


def prepare(df: DataFrame, time: str, event: str, *, start: str | None = None, end: str | None = None,
            unit: str = "dias", event_map: Mapping | None = None) -> DataFrame:
    """Duration from dates, event as 0/1; rows without a valid event or with a
    time that is null or not above 0 are left out."""
    if start and end:
        df = df.withColumn(time, F.datediff(F.to_date(end), F.to_date(start)) / F.lit(DAYS_PER_UNIT[unit]))
    if event_map:
        code = None
        for value, flag in event_map.items():
            cond = F.col(event) == F.lit(value)
            code = F.when(cond, F.lit(flag)) if code is None else code.when(cond, F.lit(flag))
        df = df.withColumn(event, code)
    flag = F.col(event).try_cast("double") if dict(df.dtypes)[event] == "string" else F.col(event).cast("double")
    df = df.withColumn(event, flag).withColumn(time, F.col(time).cast("double"))
    return df.filter(F.col(event).isin(0.0, 1.0) & (F.col(time) > 0)).withColumn(event, F.col(event).cast("int"))


def censoring(df: DataFrame, event: str, by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(event).cast("long").alias("eventos"),
            (1 - F.avg(F.col(event).cast("double"))).alias("taxa_censura")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def counts(df: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, tempo, n, d): rows that end at a time and events among them."""
    keep = df.dropna(subset=[time, event, *by])
    return keep.groupBy(*by, F.col(time).cast("double").alias("tempo")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("d"))


def _risk(table: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """Rows at risk at each time. The counts are written once: the raw rows behind
    them are read a single time, whatever is built on the curve."""
    table = ordered.cut(table)
    points = ordered.cut_points(table, ["tempo"])["tempo"]
    return ordered.running_sums(table, by, "tempo", {"em_risco": "n"}, descending=True, points=points), points


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str] = (), z: float = Z95) -> DataFrame:
    """(by, tempo, em_risco, eventos, censuras, sobrevivencia, ic_inferior, ic_superior)."""
    return curve_of_counts(counts(df, time, event, by), by, z)


def curve_of_counts(table: DataFrame, by: Sequence[str] = (), z: float = Z95) -> DataFrame:
    """The same from rows that end and events per (by, tempo)."""
    table, points = _risk(table, by)
    n, d = F.col("em_risco").cast("double"), F.col("d").cast("double")
    table = table.withColumns({
        "__log": F.when(n > d, F.ln(1 - d / n)).otherwise(0.0), "__zero": (n == d).cast("int"),
        "__var": F.when(n > d, d / (n * (n - d))).otherwise(0.0)})
    run = ordered.running_sums(table, by, "tempo", {"__L": "__log", "__Z": "__zero", "__V": "__var"}, points=points)
    s = F.when(F.col("__Z") > 0, 0.0).otherwise(F.exp("__L"))
    # interval on the log(-log) scale
    inside = (F.col("sobrevivencia") > 0) & (F.col("sobrevivencia") < 1)
    v = F.ln(-F.ln("sobrevivencia"))
    half = F.lit(z) * F.sqrt("__V") / F.abs(F.ln("sobrevivencia"))
    return run.withColumn("sobrevivencia", s).select(
        *by, "tempo", "em_risco", F.col("d").alias("eventos"), (F.col("n") - F.col("d")).alias("censuras"),
        "sobrevivencia",
        F.when(inside, F.exp(-F.exp(v + half))).otherwise(F.col("sobrevivencia")).alias("ic_inferior"),
        F.when(inside, F.exp(-F.exp(v - half))).otherwise(F.col("sobrevivencia")).alias("ic_superior"))


def medians(curve: DataFrame, by: Sequence[str] = (), level: float = 0.5) -> DataFrame:
    """First time at which the curve, and each end of its interval, is at or below the level."""
    first = lambda c: F.min(F.when(F.col(c) <= level, F.col("tempo")))
    aggs = [first("sobrevivencia").alias("mediana"), first("ic_inferior").alias("mediana_ic_inferior"),
            first("ic_superior").alias("mediana_ic_superior"),
            F.sum(F.col("eventos") + F.col("censuras")).alias("n"), F.sum("eventos").alias("eventos")]
    return curve.groupBy(*by).agg(*aggs) if by else curve.agg(*aggs)


def nelson_aalen(df: DataFrame, time: str, event: str, by: Sequence[str] = (), smooth: bool = True) -> DataFrame:
    """(by, tempo, em_risco, eventos, risco_acumulado). With `smooth`, tied events
    leave the risk set one after the other."""
    table, points = _risk(counts(df, time, event, by), by)
    n, d = F.col("em_risco").cast("double"), F.col("d")
    step = sum_inverse(n, d) if smooth else d / n
    run = ordered.running_sums(table.withColumn("__h", step), by, "tempo", {"risco_acumulado": "__h"}, points=points)
    return run.select(*by, "tempo", "em_risco", F.col("d").alias("eventos"), "risco_acumulado")


#: Ranges of time of the log-rank sums, and event times that a task looks at in one go.
RANK_RANGES, RANK_TIMES = 64, 256


def log_rank_sums(df: DataFrame, time: str, event: str, group: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(groups, observed, expected, covariance) of the log-rank test.

    Counts per (time, group) are dealt by ranges of time and read from late to early. What enters a
    range is one count per range and group; inside, the shares at risk of a few hundred event times are
    a matrix, whose product with itself the range adds to the covariance. One job does for any number
    of groups; a task holds one block of times and groups x groups numbers.
    """
    keep = df.dropna(subset=[time, event, group])
    groups = sorted(r[0] for r in keep.select(group).distinct().collect())       # a row and column of the covariance each
    if len(groups) < 2:
        raise ValueError("the test needs two groups at least")
    spark, k = df.sparkSession, len(groups)
    names = spark.createDataFrame([(g, i) for i, g in enumerate(groups)], T.StructType([
        T.StructField("__name", df.schema[group].dataType), T.StructField("g", T.IntegerType())]))
    rows = keep.select(F.col(time).cast("double").alias("tempo"), F.col(event).alias("evento"), F.col(group).alias("__name"))
    cells = ordered.cut(rows.join(F.broadcast(names), "__name").groupBy("tempo", "g").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("evento") == 1).alias("d")))
    points = ordered.cut_points(cells, ["tempo"], RANK_RANGES)["tempo"]
    base = ordered.add_bucket(cells, "tempo", points, "b")
    later = np.zeros((len(points) + 2, k))
    for r in base.groupBy("b", "g").agg(F.sum("n").alias("n")).toLocalIterator():
        later[r["b"], r["g"]] = r["n"]
    later = later[::-1].cumsum(axis=0)[::-1][1:]                                 # those in the ranges after each
    entering = spark.sparkContext.broadcast(later)

    def add(batches):
        observed, expected, spread = np.zeros(k), np.zeros(k), np.zeros((k, k))
        risk, at, held = None, None, None

        def block(time_of, g, n, d, risk):
            """Adds event times that are whole; the units at risk at the last of them."""
            where = np.cumsum(np.concatenate([[0], time_of[1:] != time_of[:-1]])) if len(time_of) else time_of
            for first in range(0, int(where[-1]) + 1, RANK_TIMES):
                x = slice(*np.searchsorted(where, [first, first + RANK_TIMES]))
                m = int(where[x][-1]) - first + 1
                r = np.zeros((m, k))
                np.add.at(r, (where[x] - first, g[x]), n[x])
                r = risk + r.cumsum(axis=0)
                risk = r[-1]
                dead = np.bincount(where[x] - first, weights=d[x], minlength=m)
                r, dead = r[dead > 0], dead[dead > 0]
                total = r.sum(axis=1)
                scale = np.where(total > 1, dead * (total - dead) / np.maximum(total - 1, 1), 0.0)
                share = r / total[:, None]
                expected[:] += dead @ share
                spread[:] -= (share * scale[:, None]).T @ share
                spread[np.arange(k), np.arange(k)] += scale @ share
            return risk

        def columns(batch):
            return [np.asarray(batch.column(c)) for c in ("b", "tempo", "g", "n", "d")]

        for batch in batches:
            if not batch.num_rows:
                continue
            now = columns(batch)
            observed += np.bincount(now[2], weights=now[4], minlength=k)
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            # the last time may go on in the next batch
            open_ = int(np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[0])
            held = [x[open_:] for x in now]
            now = [x[:open_] for x in now]
            for b in np.unique(now[0])[::-1] if open_ else ():
                mine = now[0] == b
                risk = entering.value[b] if b != at else risk
                at, risk = b, block(*[x[mine] for x in now[1:]], risk)
        if held is not None:
            block(*held[1:], entering.value[held[0][0]] if held[0][0] != at else risk)
            i, j = np.triu_indices(k)
            own = np.arange(k)
            for x, y, v in ((own, np.full(k, -1), observed), (own, np.full(k, -2), expected), (i, j, spread[i, j])):
                for first in range(0, len(x), 100_000):
                    part = slice(first, first + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x[part], pa.int32()), pa.array(y[part], pa.int32()), pa.array(v[part])], ["i", "j", "v"])

    dealt = base.select("b", "tempo", "g", "n", "d").repartition("b").sortWithinPartitions(F.desc("b"), F.desc("tempo"))
    sums = dealt.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    observed, expected, spread = np.zeros(k), np.zeros(k), np.zeros((k, k))
    i, j, v = (sums[c].to_numpy() for c in ("i", "j", "v"))
    observed[i[j == -1]], expected[i[j == -2]] = v[j == -1], v[j == -2]
    spread[i[j >= 0], j[j >= 0]] = spread[j[j >= 0], i[j >= 0]] = v[j >= 0]
    return groups, observed, expected, spread


def log_rank(df: DataFrame, time: str, event: str, group: str) -> dict:
    """Chi-square test that the groups share one curve. Groups that no event finds at risk have no
    part in the statistic; with fewer than two others it is 0 and has no p."""
    groups, observed, expected, spread = log_rank_sums(df, time, event, group)
    z = observed - expected
    own = np.flatnonzero(spread.diagonal() > 0)[:-1]
    stat = float(z[own] @ np.linalg.solve(spread[np.ix_(own, own)], z[own])) if len(own) else 0.0
    return {"estatistica": stat, "p_valor": Tails(df.sparkSession).chi2_upper(stat, len(own)) if len(own) else float("nan"),
            "graus_liberdade": len(own), "observado": dict(zip(groups, observed.tolist())), "esperado": dict(zip(groups, expected.tolist()))}


def support_limits(df: DataFrame, time: str, event: str, by: Sequence[str], at_risk: int = MIN_AT_RISK) -> DataFrame:
    """(by, limite): last event time with enough units at risk, else the first event."""
    table, _ = _risk(counts(df, time, event, by), by)
    events = table.filter("d > 0")
    return events.groupBy(*by).agg(F.coalesce(
        F.max(F.when(F.col("em_risco") >= at_risk, F.col("tempo"))), F.min("tempo")).alias("limite"))


def split_at(df: DataFrame, time: str, event: str, at: float, covariate: str) -> DataFrame:
    """Follow-up in two intervals at a time, with the covariate of the second part."""
    late = F.col(time) > at
    first = F.struct(F.lit(0.0).alias("t_inicio"), F.least(F.col(time).cast("double"), F.lit(float(at))).alias("t_fim"),
                     F.when(late, 0).otherwise(F.col(event)).cast("int").alias("e"), F.lit(0.0).alias("depois"))
    second = F.struct(F.lit(float(at)).alias("t_inicio"), F.col(time).cast("double").alias("t_fim"),
                      F.col(event).cast("int").alias("e"), F.lit(1.0).alias("depois"))
    parts = F.when(late, F.array(first, second)).otherwise(F.array(first))
    out = df.withColumn("__p", F.explode(parts)).withColumn(event, F.col("__p.e"))
    return out.withColumns({c: F.col(f"__p.{c}") for c in ("t_inicio", "t_fim", "depois")}).drop("__p").withColumn(
        f"{covariate}_depois", F.col(covariate) * F.col("depois"))


def cause_incidence(df: DataFrame, time: str, cause: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, causa, tempo, aalen_johansen, um_menos_km) at every event time of a cause.

    `cause` is null for censored rows. The overall curve before each time weighs
    the events of a cause; treating other causes as censored overstates it.
    """
    by = list(by)
    rows = df.dropna(subset=[time, *by])
    both = rows.groupBy(*by, F.col(time).cast("double").alias("tempo")).agg(
        F.count(F.lit(1)).alias("n"), F.count(cause).alias("d"))
    table, points = _risk(both, by)
    n, d = F.col("em_risco").cast("double"), F.col("d").cast("double")
    table = table.withColumns({"__log": F.when(n > d, F.ln(1 - d / n)).otherwise(0.0), "__zero": (n == d).cast("int")})
    run = ordered.running_sums(table, by, "tempo", {"__L": "__log", "__Z": "__zero"}, points=points)
    before = F.when(F.col("__Z") - F.col("__zero") > 0, 0.0).otherwise(F.exp(F.col("__L") - F.col("__log")))
    overall = run.select(*by, "tempo", "em_risco", before.alias("__s"))
    per = rows.filter(F.col(cause).isNotNull()).groupBy(
        *by, F.col(cause).alias("causa"), F.col(time).cast("double").alias("tempo")).agg(F.count(F.lit(1)).alias("d"))
    joined = per.join(overall, [*by, "tempo"])
    nn, dd = F.col("em_risco").cast("double"), F.col("d").cast("double")
    joined = joined.withColumns({
        "__aj": F.col("__s") * dd / nn, "__kl": F.when(nn > dd, F.ln(1 - dd / nn)).otherwise(0.0),
        "__kz": (nn == dd).cast("int")})
    out = ordered.running_sums(joined, [*by, "causa"], "tempo", {"aalen_johansen": "__aj", "__K": "__kl", "__Y": "__kz"},
                               points=points)
    return out.select(*by, "causa", "tempo", "aalen_johansen",
                      (1 - F.when(F.col("__Y") > 0, 0.0).otherwise(F.exp("__K"))).alias("um_menos_km"))


def incidence_at(curve: DataFrame, horizons: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Incidence per cause at fixed times, and by how much 1 - KM overstates it."""
    keys = [*by, "causa"]
    curve = ordered.cut(curve)          # one row per event time, read by both look-ups
    asks = curve.select(*keys).distinct().withColumn("anos", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    out = curve_lookup(asks, curve, "anos", "tempo", "aalen_johansen", keys, "incidencia_aalen_johansen")
    out = step_lookup(out, curve, "anos", "tempo", "um_menos_km", keys, "incidencia_1_menos_km", before=0.0)
    return out.withColumn("superestimacao", F.col("incidencia_1_menos_km") - F.col("incidencia_aalen_johansen"))


# ------------------------------------------------------------------ parametric
def _log_likelihood(t: Column, n: Column, d: Column) -> Column:
    """Log-likelihood of rows (t, n ends, d events) at the columns `modelo`, `a`, `b`.
    a is the log scale and b the log shape; for lognormal the mean and log deviation.
    Parameters are data, so every round runs the same compiled code."""
    a, b, lt = F.col("a"), F.col("b"), F.ln(t)
    u = F.exp(b) * (lt - a)
    soft = F.when(u > 30, u).otherwise(F.ln(1 + F.exp(F.least(u, F.lit(30.0)))))
    z = (lt - a) / F.exp(b)
    tail = F.ln(F.greatest(normal_cdf(-z), F.lit(1e-300)))
    return (F.when(F.col("modelo") == "weibull", d * (b - lt + u) - n * F.exp(u))
            .when(F.col("modelo") == "loglogistico", d * (b - lt + u - soft) - n * soft)
            .otherwise(d * (-lt - b - 0.5 * math.log(2 * math.pi) - z * z / 2) + (n - d) * tail))


class _Search:
    """Newton steps of one fit, fed with likelihoods at nine neighbouring points."""

    H = 1e-3

    def __init__(self, model: str, start: tuple[float, float]):
        self.model, self.at, self.last, self.best = model, np.array(start, float), np.array(start, float), None
        self.step, self.done = np.zeros(2), False

    def grid(self) -> list[tuple[float, float]]:
        return [(self.at[0] + i * self.H, self.at[1] + j * self.H) for i in (-1, 0, 1) for j in (-1, 0, 1)]

    def feed(self, values: Sequence[float]) -> None:
        f, h = np.array(values, float).reshape(3, 3), self.H
        if self.best is not None and not f[1, 1] >= self.best - 1e-12 * abs(self.best):
            self.step = self.step / 2
            self.at, self.done = self.last + self.step, np.max(np.abs(self.step)) < 1e-8
            return
        self.best, self.last = f[1, 1], self.at.copy()
        g = np.array([f[2, 1] - f[0, 1], f[1, 2] - f[1, 0]]) / (2 * h)
        cross = (f[2, 2] - f[2, 0] - f[0, 2] + f[0, 0]) / 4
        hess = np.array([[f[2, 1] - 2 * f[1, 1] + f[0, 1], cross], [cross, f[1, 2] - 2 * f[1, 1] + f[1, 0]]]) / h ** 2
        eig = np.linalg.eigvalsh(hess)
        if eig.max() >= -1e-8 * max(abs(eig).max(), 1):
            hess = hess - np.eye(2) * (eig.max() + 0.1 * abs(eig).max() + 1e-6)
        self.step = np.clip(-np.linalg.solve(hess, g), -1, 1)
        self.done = np.max(np.abs(self.step)) < 1e-7
        self.at = self.at + self.step


def parametric_fits(df: DataFrame, time: str, event: str,
                    models: Sequence[str] = ("exponencial", "weibull", "lognormal", "loglogistico"),
                    by: str | None = None) -> DataFrame:
    """(by, modelo, aic, log_verossimilhanca, p1, p2, mediana_prevista, convergiu, delta_aic), best
    first. `convergiu` is false where the steps had not settled when the rounds ended.

    p1, p2 are scale and shape (weibull), scale (exponencial), mean and deviation
    of the log (lognormal), scale and shape (loglogistico). All open fits of all
    groups advance together: one job per round of steps.
    """
    spark, key = df.sparkSession, by or "grupo"
    table = counts(df if by else df.withColumn("grupo", F.lit("geral")), time, event, [key]).cache()
    t, n, d = F.col("tempo"), F.col("n").cast("double"), F.col("d").cast("double")
    base = {r[key]: r for r in table.groupBy(key).agg(
        F.sum("d").alias("d"), F.sum(n * t).alias("t"), F.sum("n").alias("n"), (F.sum(n * F.ln(t)) / F.sum(n)).alias("m"),
        (F.sum(n * F.pow(F.ln(t), 2)) / F.sum(n)).alias("q")).collect()}
    fits = {}
    schema = T.StructType([table.schema[key], *T.StructType.fromDDL("modelo string, j int, a double, b double").fields])
    for g, b in base.items():
        dev = max(math.sqrt(max(b["q"] - b["m"] ** 2, 0)), 1e-3)
        for m in models:
            if m != "exponencial":
                fits[g, m] = _Search(m, (b["m"], math.log(dev)) if m == "lognormal" else (math.log(b["t"] / b["d"]), 0.0))
    for _ in range(60):
        live = [(k, f) for k, f in fits.items() if not f.done]
        if not live:
            break
        grid = spark.createDataFrame([(g, m, j, float(x), float(y)) for (g, m), f in live for j, (x, y) in enumerate(f.grid())],
                                     schema)
        got = {(r[key], r["modelo"], r["j"]): r["l"] for r in table.join(F.broadcast(grid), key).groupBy(
            key, "modelo", "j").agg(F.sum(_log_likelihood(t, n, d)).alias("l")).collect()}
        for (g, m), f in live:
            f.feed([got[g, m, j] for j in range(9)])
    table.unpersist()
    out = []
    for g, b in base.items():
        for m in models:
            if m == "exponencial":
                mean = b["t"] / b["d"]
                ll, p1, p2, k, median = -b["d"] * math.log(mean) - b["d"], mean, None, 1, mean * math.log(2)
            else:
                (x, y), ll, k = fits[g, m].last, float(fits[g, m].best), 2
                p1, p2 = (float(x), math.exp(y)) if m == "lognormal" else (math.exp(x), math.exp(y))
                median = math.exp(x) * (math.log(2) ** (1 / math.exp(y)) if m == "weibull" else 1.0)
            settled = m == "exponencial" or bool(fits[g, m].done)
            out.append((str(g), m, 2 * k - 2 * ll, ll, p1, p2, median, settled))
    low: dict = {}
    for g, _, aic, *_ in out:
        low[g] = min(low.get(g, aic), aic)
    rows = sorted(((*r, r[2] - low[r[0]]) for r in out), key=lambda r: (r[0], r[2]))
    return spark.createDataFrame(rows, f"{key} string, modelo string, aic double, log_verossimilhanca double, "
                                 "p1 double, p2 double, mediana_prevista double, convergiu boolean, delta_aic double")


# ----------------------------------------------------------------- concordance
#: Rows that a range of times or scores should hold, and the most ranges of a group.
PAIR_ROWS, PAIR_RANGES = 250_000, 512


def concordance(df: DataFrame, time: str, event: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row (concordantes, discordantes, empates, c_index) over all comparable
    pairs, or one for each group; a higher score means an earlier event.

    Pairs are never listed. Times and scores of a group are cut in ranges of about equal size, and a
    value with many rows is a range of its own. Pairs that differ in both ranges come from counts per
    pair of ranges; those in one range of times, or in one of scores, are counted by the task that
    holds it. Rows are shuffled twice, whatever their number.
    """
    by, spark = list(by), df.sparkSession
    rows = table_in_shared_folder(df.dropna(subset=[time, event, score]).select(
        *by, F.col(time).cast("double").alias("__t"), F.col(score).cast("double").alias("__s"),
        F.col(event).cast("long").alias("__e")), "pares")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    largest = sizes.agg(F.max("__n")).first()[0] or 0
    n = min(max(-(-largest // PAIR_ROWS), 4), PAIR_RANGES)
    probs = [i / n for i in range(1, n)]
    found = rows.groupBy(*by).agg(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in ("__t", "__s")]).collect()
    found = [r for r in found if r["__t"]]
    points = [(_range_points(r["__t"]), _range_points(r["__s"])) for r in found]
    names = T.StructType([*[df.schema[c] for c in by], T.StructField("__g", T.IntegerType())])
    groups = spark.createDataFrame([(*[r[c] for c in by], i) for i, r in enumerate(found)], names)
    numbered = ordered.null_safe(rows, F.broadcast(groups), by) if by else rows.withColumn("__g", F.lit(0))

    def place(frames):
        for x in frames:
            t, s, g = x["__t"].to_numpy(), x["__s"].to_numpy(), x["__g"].to_numpy()
            out = {k: np.zeros(len(x), np.int32) for k in ("a", "b")} | {k: np.zeros(len(x), bool) for k in ("one_a", "one_b")}
            for i in np.unique(g):
                mine = g == i
                for k, value, (cuts, single) in (("a", t, points[i][0]), ("b", s, points[i][1])):
                    out[k][mine] = at = np.searchsorted(cuts, value[mine], side="right")
                    out[f"one_{k}"][mine] = single[at]
            yield x.assign(**out)

    schema = "__g int, __t double, __s double, __e long, a int, b int, one_a boolean, one_b boolean"
    placed = table_in_shared_folder(numbered.select("__g", "__t", "__s", "__e").mapInPandas(place, schema), "faixas")
    grid = placed.groupBy("__g", "a", "b", "one_a", "one_b").agg(F.count(F.lit(1)).alias("n"), F.sum("__e").alias("d"))
    sums = "__g int, c long, x long, e long"
    apart = grid.groupBy("__g").applyInPandas(_pairs_of_ranges, sums)
    # a score that is a range of its own is one row per time here; the pairs of one time with one score are in the grid
    alone = placed.filter("one_b AND NOT one_a").groupBy("__g", "a", "b", "__t", "__s").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__e").alias("d"))
    spread = placed.filter("NOT one_b").select("__g", "a", F.when(F.col("one_a"), F.col("b")).otherwise(F.lit(-1)).alias("b"),
                                               "__t", "__s", F.lit(1).cast("long").alias("n"), F.col("__e").alias("d"))
    one_time = spread.unionByName(alone.withColumn("b", F.lit(-1))).groupBy("__g", "a", "b").applyInPandas(
        lambda x: _pairs_inside(x, "__t", False), sums)
    one_score = placed.filter("NOT one_b").select("__g", "a", "b", "__s", F.lit(1).cast("long").alias("n"), F.col("__e").alias("d")).groupBy(
        "__g", "b").applyInPandas(lambda x: _pairs_inside(x, "a", True), sums)
    total = apart.unionByName(one_time).unionByName(one_score).groupBy("__g").agg(*[F.sum(k).alias(k) for k in "cxe"])
    got = {r["__g"]: (r["c"], r["x"], r["e"]) for r in total.collect()}        # three numbers for each group
    out = [(*[r[c] for c in by], *got[i]) for i, r in enumerate(found)] or ([] if by else [(None, None, None)])
    fields = [T.StructField(c, T.LongType()) for c in ("concordantes", "discordantes", "empates")]
    both = spark.createDataFrame(out, T.StructType([*[df.schema[c] for c in by], *fields]))
    pairs = F.col("concordantes") + F.col("discordantes") + F.col("empates")
    return both.withColumn("c_index", F.try_divide(F.col("concordantes") + F.col("empates") / 2, pairs))


def _range_points(values: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """(ends of ranges, which ranges hold a single value) from quantiles: one that comes twice is a value
    with many rows and gets its own range."""
    unique, times = np.unique(np.asarray(values, float), return_counts=True)
    points = np.unique(np.concatenate([unique, np.nextafter(unique[times > 1], np.inf)]))
    single = np.zeros(len(points) + 1, bool)
    single[1:-1] = points[1:] == np.nextafter(points[:-1], np.inf)
    return points, single


def _pair_sums(g, c, x, e):
    return pd.DataFrame({"__g": np.array([g], np.int32), "c": [int(c)], "x": [int(x)], "e": [int(e)]})


def _pairs_of_ranges(cells):
    """Pairs of rows in different ranges, and those of a range with one value, from counts per (a, b)."""
    a, b = cells["a"].to_numpy(), cells["b"].to_numpy()
    n, d = np.zeros((a.max() + 2, b.max() + 2), np.int64), np.zeros((a.max() + 2, b.max() + 2), np.int64)
    n[a, b], d[a, b] = cells["n"], cells["d"]
    one_a, one_b = np.zeros(len(n), bool), np.zeros(n.shape[1], bool)
    one_a[a], one_b[b] = cells["one_a"], cells["one_b"]
    later = n[::-1].cumsum(axis=0)[::-1] - n                         # rows of later ranges of time
    rival = later + np.where(one_a[:, None], n - d, 0)               # at one time, those without event
    below = rival.cumsum(axis=1) - rival
    above = rival.sum(axis=1, keepdims=True) - below - rival
    same = np.where(one_b, later + np.where(one_a[:, None], n - d, 0), 0)
    return _pair_sums(cells["__g"].iloc[0], (d * below).sum(), (d * above).sum(), (d * same).sum())


def _pairs_inside(rows, time: str, strict: bool):
    """Pairs among rows (time, score, n rows, d events). Two numbers of scores split at exactly one binary
    digit, so for each digit the pairs with equal higher digits are counted from sums over later times.
    With `strict` rows of equal time make no pair, else an event meets those that end without one."""
    rows = rows.sort_values(time, ascending=False, kind="stable")
    t, n, d = rows[time].to_numpy(), rows["n"].to_numpy(), rows["d"].to_numpy()
    rank = np.unique(rows["__s"].to_numpy(), return_inverse=True)[1].astype(np.int64)

    def meet(group, low, events):
        """Sum over `events` of the `low` rows of their group that they can be compared with."""
        order = np.argsort(group, kind="stable")
        g, u, w, leave, d_ = group[order], t[order], (n * low)[order], ((n if strict else d) * low)[order], (d * events)[order]
        new_group = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        new_run = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (u[1:] != u[:-1])]))
        until = np.concatenate([[0], w.cumsum()])
        ends = np.concatenate([new_run[1:], [len(g)]])
        start = new_group[np.searchsorted(new_group, new_run, side="right") - 1]
        rivals = until[ends] - until[start] - np.add.reduceat(leave, new_run)
        return int((np.add.reduceat(d_, new_run) * rivals).sum())

    every, all_ = np.ones(len(t), np.int64), np.zeros(len(t), np.int64)
    pairs, ties, up = meet(all_, every, every), meet(rank, every, every), 0
    for k in range(int(rank.max()).bit_length()):
        high = (rank >> k) & 1
        up += meet(rank >> (k + 1), 1 - high, high)
    return _pair_sums(rows["__g"].iloc[0], up, pairs - ties - up, ties)
