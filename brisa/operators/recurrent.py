"""Repeated events: counting-process fits, mean cumulative function, frailty."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from brisa.constants import HORIZON_MONTHS, MAX_EPISODE_STRATUM, MODEL_COVARIATES
from brisa.functions.numeric import model_covariates
from brisa.functions.quality import check_rows
from brisa.operators import ordered
from brisa.operators.cox import CoxModel, fit
from brisa.operators.joins import curve_lookup, step_lookup

ID, START, STOP, GAP, EVENT, EPISODE, SOURCE = (
    "id_usina", "t_inicio_anos", "t_fim_anos", "gap_anos", "evento", "episodio", "fonte")


def add_strata(panel: DataFrame, cap: int = MAX_EPISODE_STRATUM) -> DataFrame:
    """Episode stratum (late ones together) and source with episode; bad intervals stop."""
    check_rows(panel, {"intervalo vazio": F.col(STOP) <= F.col(START)})
    return panel.withColumn("estrato_episodio", F.least(F.col(EPISODE), F.lit(cap))).withColumn(
        "estrato", F.concat_ws("|", F.col(SOURCE), F.col("estrato_episodio").cast("string")))


def prepare(panel: DataFrame, cap: int = MAX_EPISODE_STRATUM) -> DataFrame:
    return add_strata(model_covariates(panel), cap)


def episodes(points: DataFrame, key: str, time: str, start: Column, end: Column,
             attributes: Sequence[str] = ()) -> DataFrame:
    """Counting-process panel from event times: intervals chain, the last one of
    each unit is censored. Positions come from counts per unit and time range."""
    rows = points.select(key, *attributes, F.col(time).cast("double").alias("t"), start.cast("double").alias("a"),
                         end.cast("double").alias("z")).distinct().filter((F.col("t") > F.col("a")) & (F.col("t") < F.col("z")))
    ends = points.groupBy(key, *attributes).agg(F.min(start.cast("double")).alias("a"), F.max(end.cast("double")).alias("z"))
    stops = rows.select(key, *attributes, "a", F.col("t").alias(STOP), F.lit(1).alias(EVENT)).unionByName(
        ends.select(key, *attributes, "a", F.col("z").alias(STOP), F.lit(0).alias(EVENT)))
    stops = ordered.cut(stops.withColumn("__one", F.lit(1)))
    points_at = ordered.cut_points(stops, [STOP])[STOP]
    numbered = ordered.running_sums(stops, [key], STOP, {EPISODE: "__one"}, points=points_at).drop("__one")
    before = numbered.select(key, (F.col(EPISODE) + 1).alias(EPISODE), F.col(STOP).alias("__prev"))
    out = numbered.join(before, [key, EPISODE], "left").withColumn(START, F.coalesce("__prev", "a")).drop("__prev")
    return out.withColumns({START: F.col(START) - F.col("a"), STOP: F.col(STOP) - F.col("a")}).withColumn(
        GAP, F.col(STOP) - F.col(START)).drop("a")


def andersen_gill(panel: DataFrame, covariates: Sequence[str] = MODEL_COVARIATES, clustered: bool = True,
                  **options) -> CoxModel:
    """Total time, a unit is always at risk; errors clustered by unit."""
    return fit(panel, STOP, EVENT, covariates, strata=[SOURCE], entry=START, cluster=ID if clustered else None, **options)


def pwp_total(panel: DataFrame, covariates: Sequence[str] = MODEL_COVARIATES, **options) -> CoxModel:
    return fit(panel, STOP, EVENT, covariates, strata=["estrato"], entry=START, cluster=ID, **options)


def pwp_gap(panel: DataFrame, covariates: Sequence[str] = MODEL_COVARIATES, **options) -> CoxModel:
    """The clock starts again after each event."""
    return fit(panel, GAP, EVENT, covariates, strata=["estrato"], cluster=ID, **options)


def compare_errors(panel: DataFrame, covariates: Sequence[str] = MODEL_COVARIATES) -> DataFrame:
    """Naive and clustered errors of the Andersen-Gill fit and their ratio."""
    model = andersen_gill(panel, covariates, with_baseline=False)
    naive, robust = np.sqrt(np.diag(model.naive_variance)), model.errors
    rows = [(c, float(a), float(b), float(b / a)) for c, a, b in zip(covariates, naive, robust)]
    return panel.sparkSession.createDataFrame(rows, "covariavel string, ingenuo double, agrupado double, razao double")


def compare_fits(fits: dict[str, CoxModel], spark) -> DataFrame:
    out = None
    for name, model in fits.items():
        part = model.table(spark).withColumn("modelo", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("covariavel", "modelo")


# ------------------------------------------------------------------------- MCF
def mean_cumulative(panel: DataFrame, by: Sequence[str] = (SOURCE,), key: str = ID, stop: str = STOP,
                    event: str = EVENT) -> DataFrame:
    """(by, tempo_anos, em_risco, eventos, mcf) at every event time."""
    by = list(by)
    ends = panel.groupBy(*by, key).agg(F.max(F.col(stop).cast("double")).alias("tempo_anos"))
    ends = ends.groupBy(*by, "tempo_anos").agg(F.count(F.lit(1)).alias("u"))
    hits = panel.filter(F.col(event) == 1).groupBy(*by, F.col(stop).cast("double").alias("tempo_anos")).agg(
        F.count(F.lit(1)).alias("d"))
    both = ends.withColumn("d", F.lit(0)).unionByName(hits.withColumn("u", F.lit(0))).groupBy(*by, "tempo_anos").agg(
        F.sum("u").alias("u"), F.sum("d").alias("d"))
    both = ordered.cut(both)
    points = ordered.cut_points(both, ["tempo_anos"])["tempo_anos"]
    risk = ordered.running_sums(both, by, "tempo_anos", {"em_risco": "u"}, descending=True, points=points)
    events = risk.filter("d > 0").withColumn("__m", F.when(F.col("em_risco") > 0, F.col("d") / F.col("em_risco")).otherwise(0.0))
    run = ordered.running_sums(events, by, "tempo_anos", {"mcf": "__m"}, points=points)
    return run.select(*by, "tempo_anos", "em_risco", F.col("d").alias("eventos"), "mcf")


def expected_events(rows: DataFrame, curve: DataFrame, age: str, years: Sequence[float], by: Sequence[str] = (SOURCE,),
                    prefix: str = "esperados") -> DataFrame:
    """MCF(age + years) - MCF(age) for each length as `prefix_i`; the curve clamps at
    both ends. Distinct (group, age) pairs are looked up once for all lengths."""
    spots = rows.select(*by, F.col(age).alias("__age")).distinct().withColumn(
        "__y", F.explode(F.array(F.lit(0.0), *[F.lit(float(y)) for y in years])))
    read = curve_lookup(spots.withColumn("__at", F.col("__age") + F.col("__y")), curve, "__at", "tempo_anos", "mcf", by, "__m")
    at = lambda y: F.max(F.when(F.col("__y") == float(y), F.col("__m")))
    wide = read.groupBy(*by, "__age").agg(*[(at(y) - at(0.0)).alias(f"{prefix}_{i}") for i, y in enumerate(years)])
    return ordered.null_safe(rows.withColumn("__age", F.col(age)), wide, [*by, "__age"], "left").drop("__age")


def expected_per_unit(units: DataFrame, curve: DataFrame, model: CoxModel, age: str = "idade_anos",
                      months: Sequence[int] = HORIZON_MONTHS) -> DataFrame:
    """Expected events of each unit at each horizon and its relative rate."""
    out = expected_events(units.withColumn("taxa_relativa", F.exp(model.score())), curve, age, [m / 12 for m in months], prefix="__e")
    return out.withColumns({f"manutencoes_esperadas_{m}m": F.round(F.col(f"__e_{i}") * F.col("taxa_relativa"), 3)
                            for i, m in enumerate(months)}).drop(*[f"__e_{i}" for i in range(len(months))])


def exposure(panel: DataFrame, curve: DataFrame, covariates: Sequence[str] = MODEL_COVARIATES,
             floor: float = 1e-6) -> DataFrame:
    """One row per unit: events, follow-up and the events a mean unit would have."""
    units = panel.groupBy(ID).agg(
        F.sum(F.col(EVENT).cast("long")).alias("eventos"), F.max(STOP).alias("observacao_anos"),
        F.min(SOURCE).alias(SOURCE), *[F.min_by(c, START).alias(c) for c in covariates])
    out = curve_lookup(units, curve, "observacao_anos", "tempo_anos", "mcf", [SOURCE], "exposicao")
    return out.withColumn("exposicao", F.greatest("exposicao", F.lit(floor)))


# --------------------------------------------------------------------- frailty
class CountModel:
    """Negative-binomial counts with offset; theta 0 is Poisson."""

    def __init__(self, df: DataFrame, count: str, exposed: str, covariates: Sequence[str]):
        self.names = ["const", *covariates]
        x = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]
        rows = df.dropna(subset=[count, exposed, *covariates])
        self.rows = rows.select(F.col(count).cast("double").alias("y"), F.ln(exposed).alias("o"),
                                *[v.alias(f"x{i}") for i, v in enumerate(x)]).persist(StorageLevel.MEMORY_AND_DISK)
        # units per distinct count: the sums over k < y depend on the count alone
        self.sizes = self.rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        total = self.rows.agg(F.sum("y").alias("y"), F.sum(F.exp("o")).alias("e")).first()
        self.start = float(np.log(max(total["y"], 1e-9) / total["e"]))

    def mean(self, beta: np.ndarray) -> Column:
        total = F.col("o")
        for i, b in enumerate(beta):
            total = total + F.col(f"x{i}") * F.lit(float(b))
        return F.exp(total)

    def beta_for(self, theta: float, beta: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Newton steps for the coefficients at a given theta."""
        p = len(self.names)
        beta = np.array([self.start] + [0.0] * (p - 1)) if beta is None else beta
        for _ in range(MAX_NEWTON):
            m = self.mean(beta)
            w = m / (1 + F.lit(theta) * m)
            g = (F.col("y") - m) / (1 + F.lit(theta) * m)
            row = self.rows.agg(*[F.sum(g * F.col(f"x{i}")).alias(f"g{i}") for i in range(p)],
                                *[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}")
                                  for i in range(p) for j in range(i, p)]).first()
            grad = np.array([row[f"g{i}"] for i in range(p)], float)
            hess = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
            move = np.clip(np.linalg.pinv(hess) @ grad, -2, 2)
            beta = beta + move
            if np.max(np.abs(move)) < 1e-9:
                break
        return beta, hess

    def likelihoods(self, beta: np.ndarray, thetas: Sequence[float]) -> list[float]:
        """Log-likelihood, up to the factorials, at many theta in one job each part."""
        m = self.mean(beta)
        parts = []
        for t in thetas:
            if t <= 0:
                parts.append(F.sum(F.col("y") * F.ln(m) - m))
            else:
                parts.append(F.sum(F.col("y") * F.ln(m) - (F.col("y") + 1 / t) * F.ln(1 + F.lit(float(t)) * m)))
        smooth = self.rows.agg(*[e.alias(f"l{k}") for k, e in enumerate(parts)]).first()
        rise = self.sizes.agg(*[F.sum(F.col("n") * F.aggregate(
            F.when(F.col("y") > 0, F.sequence(F.lit(0), F.col("y").cast("int") - 1)).otherwise(F.array().cast("array<int>")),
            F.lit(0.0), lambda acc, k: acc + F.ln(1 + F.lit(float(t)) * k))).alias(f"r{i}")
            for i, t in enumerate(thetas)]).first()
        return [float(smooth[f"l{i}"]) + float(rise[f"r{i}"] or 0.0) for i in range(len(thetas))]

    def close(self) -> None:
        self.rows.unpersist()
        self.sizes.unpersist()


MAX_NEWTON = 25


def count_regression(df: DataFrame, count: str, exposed: str, covariates: Sequence[str]) -> dict:
    """Poisson and negative-binomial counts: coefficients, theta with interval and
    likelihood ratio. A grid of theta comes first, so that a flat start does not
    end at a false zero."""
    model = CountModel(df, count, exposed, covariates)
    poisson, _ = model.beta_for(0.0)
    base = model.likelihoods(poisson, [0.0])[0]
    grid = [0.0, *np.logspace(-3, 1.5, 19)]
    beta = poisson
    scores = model.likelihoods(beta, grid)
    theta = grid[int(np.argmax(scores))]
    for _ in range(8):
        beta, hess = model.beta_for(theta, beta)
        lo, hi = theta / 3 if theta else 0.0, theta * 3 if theta else 1e-2
        for _ in range(6):                             # shrink a grid around the best theta
            steps = list(np.linspace(lo, hi, 13))
            vals = model.likelihoods(beta, steps)
            k = int(np.argmax(vals))
            lo, hi = steps[max(k - 1, 0)], steps[min(k + 1, 12)]
        new = steps[k]
        if abs(new - theta) < 1e-5 * max(theta, 1e-3):
            theta = new
            break
        theta = new
    best = max(vals)
    h = max(theta * 1e-2, 1e-5)
    a, b, c = model.likelihoods(beta, [max(theta - h, 0.0), theta, theta + h])
    curvature = -(a - 2 * b + c) / h ** 2
    error = float(np.sqrt(1 / curvature)) if curvature > 0 else float("nan")
    model.close()
    return {"theta": float(theta), "ic_inferior": float(theta - 1.959963984540054 * error),
            "ic_superior": float(theta + 1.959963984540054 * error), "lr_vs_poisson": float(2 * (best - base)),
            "poisson": dict(zip(model.names, poisson)), "coef": dict(zip(model.names, beta))}


def estimate_frailty(panel: DataFrame, curve: DataFrame, covariates: Sequence[str] = MODEL_COVARIATES) -> dict:
    """Variance of the unit effect and the posterior effect of every unit."""
    units = exposure(panel, curve, covariates)
    sources = sorted(r[0] for r in units.select(SOURCE).distinct().collect())      # a coefficient each
    units = units.withColumns({f"__s{i}": (F.col(SOURCE) == F.lit(s)).cast("double") for i, s in enumerate(sources[1:])})
    names = [*covariates, *[f"__s{i}" for i in range(len(sources) - 1)]]
    units = ordered.cut(units)
    found = count_regression(units, "eventos", "exposicao", names)
    mu = F.ln("exposicao")
    for name, b in found["coef"].items():
        mu = mu + (F.lit(float(b)) if name == "const" else F.col(name) * F.lit(float(b)))
    return {**found, "por_usina": posterior(units.withColumn("mu", F.exp(mu)), found["theta"]).drop(
        *[n for n in names if n.startswith("__s")])}


def posterior(units: DataFrame, theta: float) -> DataFrame:
    """(1/theta + events) / (1/theta + mean); 1 when theta is 0."""
    if theta <= 0:
        return units.withColumn("frailty_posterior", F.lit(1.0))
    k = F.lit(1 / theta)
    return units.withColumn("frailty_posterior", (k + F.col("eventos")) / (k + F.col("mu")))


def panel_summary(panel: DataFrame) -> DataFrame:
    """One row: episodes, units, events and the share of units with two or more."""
    units = panel.groupBy(ID).agg(F.sum(F.col(EVENT).cast("long")).alias("e"), F.count(F.lit(1)).alias("n"))
    return units.agg(F.sum("n").alias("episodios"), F.count(F.lit(1)).alias("usinas"), F.sum("e").alias("eventos"),
                     (100 * F.avg((F.col("e") >= 2).cast("double"))).alias("pct_com_dois_ou_mais"))


def mcf_at(curve: DataFrame, years: Sequence[float] = (1, 3, 5, 10), by: Sequence[str] = (SOURCE,)) -> DataFrame:
    curve = ordered.cut(curve)          # one row per event time
    asks = curve.select(*by).distinct().withColumn("anos", F.explode(F.array(*[F.lit(float(y)) for y in years])))
    return step_lookup(asks, curve, "anos", "tempo_anos", "mcf", by, "mcf", before=0.0)
