"""Proportional hazards on Spark sums: fit, penalty, tests, prediction.

A Newton step is one job. Rows give exp(x.b) sums per (stratum, time); risk sets
are sums over later times, made range by range; events give score and
information. Where times seldom repeat the rows are laid out by ranges once and a
step shuffles nothing. Only sums of the size of the covariates reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame, functions as F

from brisa.constants import HORIZON_MONTHS, MODEL_COVARIATES
from brisa.functions.numeric import hash_unit
from brisa.functions.special import sum_inverse, sum_inverse_square, sum_log
from brisa.functions.weights import pairs as _pairs, risk_weights
from brisa.operators import ordered
from brisa.operators.joins import curve_lookup, step_lookup
from brisa.operators.survival import Z95, concordance, kaplan_meier
from brisa.session import Tails, table_in_shared_folder

MAX_STEPS = 25
TOLERANCE = 1e-6


@dataclass
class CoxModel:
    covariates: list[str]
    strata: list[str]
    coef: np.ndarray
    variance: np.ndarray
    naive_variance: np.ndarray
    means: np.ndarray
    log_likelihood: float
    n: int
    events: int
    baseline: DataFrame              # strata, tempo, risco_base at the covariate means
    penalty: float = 0.0
    extra: dict = field(default_factory=dict)

    @property
    def errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.variance))

    def score(self) -> Column:
        """x.b around the training means."""
        total = F.lit(0.0)
        for c, b, m in zip(self.covariates, self.coef, self.means):
            total = total + (F.col(c).cast("double") - F.lit(float(m))) * F.lit(float(b))
        return total

    def table(self, spark) -> DataFrame:
        """Coefficients with hazard ratio, interval and p."""
        tails, rows = Tails(spark), []
        for c, b, e in zip(self.covariates, self.coef, self.errors):
            p = tails.normal_two_sided(b / e) if e > 0 else None
            rows.append((c, float(b), float(np.exp(b)), float(e), float(b - Z95 * e), float(b + Z95 * e),
                         float(np.exp(b - Z95 * e)), float(np.exp(b + Z95 * e)), p))
        return spark.createDataFrame(rows, "covariavel string, coef double, hazard_ratio double, erro_padrao double, "
                                     "ic_inferior double, ic_superior double, hr_inferior double, hr_superior double, "
                                     "p_valor double")


def _staged(df: DataFrame, time: str, event: str, covariates: Sequence[str], strata: Sequence[str] = (),
            entry: str | None = None, cluster: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The rows of a fit, (keep, strata, t, t0, id, e, c0..), written once: what lies before them, a join
    often, runs a single time however many passes follow."""
    columns = [time, event, *covariates, *strata, *([entry] if entry else []), *([cluster] if cluster else [])]
    return table_in_shared_folder(df.dropna(subset=columns).select(
        *keep, *strata, F.col(time).cast("double").alias("t"),
        *([F.col(entry).cast("double").alias("t0")] if entry else []),
        *([F.col(cluster).alias("id")] if cluster else []),
        F.col(event).cast("double").alias("e"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(covariates)]), "ajuste")


class _Data:
    """Staged rows ready for the steps: strata, stop, optional start, event, centred x."""

    def __init__(self, base: DataFrame, p: int, strata: Sequence[str], entry: str | None = None, cluster: str | None = None,
                 scale: bool = True):
        self.strata, self.p, self.entry, self.cluster = list(strata), p, entry, cluster
        stats = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e").cast("long")).alias("d"), *[
            e for i in range(p) for e in (F.avg(f"c{i}").alias(f"m{i}"), F.stddev_samp(f"c{i}").alias(f"s{i}"))]).first()
        self.n, self.events = stats["n"], stats["d"]
        self.means = np.array([stats[f"m{i}"] for i in range(self.p)])
        dev = np.array([stats[f"s{i}"] or 1.0 for i in range(self.p)])
        self.scale = dev if scale else np.ones(self.p)
        x = [((F.col(f"c{i}") - F.lit(float(m))) / F.lit(float(s))).alias(f"x{i}")
             for i, (m, s) in enumerate(zip(self.means, self.scale))]
        self.rows = base.select(*self.strata, "t", *(["t0"] if entry else []), *(["id"] if cluster else []), "e", *x)
        self.points = ordered.cut_points(self.rows, ["t"])["t"]
        self.laid: _Laid | None = None

    def scored(self, beta: np.ndarray) -> DataFrame:
        """Rows with x.b and exp(x.b). Coefficients come as a one-row table, not as
        literals, so that every step runs the same compiled code."""
        one = self.rows.sparkSession.createDataFrame([([float(b) for b in beta],)], "b array<double>")
        score = " + ".join(f"x{i} * b[{i}]" for i in range(self.p))
        return self.rows.join(F.broadcast(one)).withColumn("xb", F.expr(score)).withColumn("r", F.expr("exp(xb)")).drop("b")

    def per_time(self, beta: np.ndarray, second: bool = True) -> DataFrame:
        """(strata, t): event sums and sums over the risk set."""
        p, pairs = self.p, _pairs(self.p) if second else []
        rows = self.scored(beta)
        sums = {"s": "r", **{f"s_{i}": f"r * x{i}" for i in range(p)}, **{f"s_{i}_{j}": f"r * x{i} * x{j}" for i, j in pairs}}
        at_event = {"d": "e", "exb": "e * xb", "q": "e * r", **{f"ex_{i}": f"e * x{i}" for i in range(p)},
                    **{f"q_{i}": f"e * r * x{i}" for i in range(p)},
                    **{f"q_{i}_{j}": f"e * r * x{i} * x{j}" for i, j in pairs}}
        stops = rows.groupBy(*self.strata, "t").agg(*[F.expr(f"sum({v}) AS {k}") for k, v in {**sums, **at_event}.items()])
        if self.entry:
            starts = rows.groupBy(*self.strata, F.col("t0").alias("t")).agg(*[F.expr(f"sum(-{v}) AS {k}") for k, v in sums.items()])
            both = stops.unionByName(starts, allowMissingColumns=True)
            stops = both.groupBy(*self.strata, "t").agg(*[
                F.expr(f"coalesce(sum({k}), 0.0D) AS {k}") for k in [*sums, *at_event]])
        return ordered.running_sums(stops, self.strata, "t", {f"R{k}": k for k in sums}, descending=True,
                                    points=self.points)

    def step(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, score and information at beta, ties by Efron's rule."""
        if self.laid:
            return self.laid.step(beta)
        at, aggs = self.terms(beta)
        return self.read(at.agg(*aggs).first())

    def terms(self, beta) -> tuple[DataFrame, list[Column]]:
        """Rows of event times, and the sums over them that make a step."""
        p, pairs = self.p, _pairs(self.p)
        at = self.per_time(beta).filter("d > 0")
        d, s0, e0 = F.col("d"), F.col("Rs"), F.col("q")
        a = d * s0 / e0
        at = at.withColumns({"A0": d / e0 * sum_inverse(a, d), "L": d * F.ln(e0 / d) + sum_log(a, d),
                             "B0": F.pow(d / e0, 2) * sum_inverse_square(a, d)})
        at = at.withColumns({"A1": F.expr("(Rs * A0 - d) / q"), "B1": F.expr("(Rs * B0 - A0) / q")})
        at = at.withColumn("B2", F.expr("(Rs * B1 - A1) / q"))
        aggs = [F.expr("sum(exb - L) AS ll")]
        aggs += [F.expr(f"sum(ex_{i} - Rs_{i} * A0 + q_{i} * A1) AS u{i}") for i in range(p)]
        aggs += [F.expr(f"sum(Rs_{i}_{j} * A0 - q_{i}_{j} * A1 - Rs_{i} * Rs_{j} * B0 + (Rs_{i} * q_{j} + q_{i} * Rs_{j}) * B1 "
                        f"- q_{i} * q_{j} * B2) AS i{i}_{j}") for i, j in pairs]
        return at, aggs

    def read(self, row) -> tuple[float, np.ndarray, np.ndarray]:
        p = self.p
        u = np.array([row[f"u{i}"] for i in range(p)], float)
        info = np.array([[row[f"i{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
        return float(row["ll"]), u, info

    def baseline(self, beta: np.ndarray) -> DataFrame:
        """(strata, tempo, risco_base): cumulative hazard at every time seen."""
        at = self.per_time(beta, second=False).withColumn("__h", F.when(F.col("d") > 0, F.col("d") / F.col("Rs")).otherwise(0.0))
        run = ordered.running_sums(at, self.strata, "t", {"risco_base": "__h"}, points=self.points)
        return run.select(*self.strata, F.col("t").alias("tempo"), "risco_base")

    def cluster_meat(self, beta: np.ndarray) -> np.ndarray:
        """Sum over clusters of the squared sum of score residuals."""
        p = self.p
        if self.laid:
            return self.laid.meat(beta)
        at = self.per_time(beta, second=False)
        dh = F.when(F.col("d") > 0, F.col("d") / F.col("Rs")).otherwise(0.0)
        at = at.withColumn("dh", dh).withColumns({
            f"m{i}": F.when(F.col("d") > 0, F.col(f"Rs_{i}") / F.col("Rs")).otherwise(0.0) for i in range(p)})
        at = at.withColumns({f"dg{i}": F.col("dh") * F.col(f"m{i}") for i in range(p)})
        run = ordered.running_sums(at.select(*self.strata, "t", "dh", *[f"dg{i}" for i in range(p)], *[f"m{i}" for i in range(p)]),
                                   self.strata, "t", {"H": "dh", **{f"G{i}": f"dg{i}" for i in range(p)}}, points=self.points)
        run = run.select(*self.strata, "t", "H", *[f"G{i}" for i in range(p)], *[f"m{i}" for i in range(p)])
        rows = self.scored(beta)
        joined = ordered.null_safe(rows, run, [*self.strata, "t"])
        if self.entry:
            began = run.select(*self.strata, F.col("t").alias("t0"), F.col("H").alias("H0"),
                               *[F.col(f"G{i}").alias(f"G0{i}") for i in range(p)])
            joined = ordered.null_safe(joined, began, [*self.strata, "t0"], "left")
        def since(name: str, first: str) -> Column:
            return F.col(name) - F.coalesce(F.col(first), F.lit(0.0)) if self.entry else F.col(name)
        res = [(F.col("e") * (F.col(f"x{i}") - F.col(f"m{i}"))
                - F.col("r") * (F.col(f"x{i}") * since("H", "H0") - since(f"G{i}", f"G0{i}"))).alias(f"v{i}")
               for i in range(p)]
        units = joined.select("id", *res).groupBy("id").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(p)])
        row = units.agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"w{i}_{j}") for i, j in _pairs(p)]).first()
        return np.array([[row[f"w{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)


class _Laid:
    """Rows of a fit laid out once: entries (-1) and ends (+1) by stratum and range of time, a range whole
    in one task and sorted. A step reads them twice and shuffles nothing: sums per range, then the terms
    of each range with what lies after it. `of` gives None where a time has very many rows, so that sums
    per time do better, or where a range would be too large for a task."""

    ROWS_PER_TIME, MAX_RANGES, FEW_ROWS = 1000, 20_000, 250_000

    def __init__(self, marks: DataFrame, p: int, ranges: Sequence[tuple], cluster: bool):
        self.marks, self.p, self.cluster = marks, p, cluster
        strata: dict = {}
        for g, stratum, _ in ranges:                # ranges come in the order of time
            strata.setdefault(stratum, []).append(g)
        self.strata, self.n = list(strata.values()), len(ranges)

    @classmethod
    def of(cls, data: _Data) -> _Laid | None:
        first, times, n = data.rows.agg(F.min(F.when(F.col("e") > 0, F.col("t"))), F.approx_count_distinct(F.struct(*data.strata, "t")),
                                        F.count(F.lit(1))).first()
        if first is None or times * cls.ROWS_PER_TIME < n:
            return None
        x = [f"x{i}" for i in range(data.p)]
        keep = [*data.strata, *(["id"] if data.cluster else [])]
        marks = data.rows.select(*keep, F.col("t").alias("__t"), F.lit(1.0).alias("__s"), "e", *x)
        if data.entry:          # entries before the first event of all change no risk set
            marks = marks.unionByName(data.rows.filter(F.col("t0") >= first).select(
                *keep, F.col("t0").alias("__t"), F.lit(-1.0).alias("__s"), F.lit(0.0).alias("e"), *x))
        marks = ordered.add_bucket(marks, "__t", data.points, "__b")
        sizes = marks.groupBy(*data.strata, "__b").agg(F.count(F.lit(1)).alias("__n")).limit(cls.MAX_RANGES + 1).collect()
        parts = ordered.bucket_count(data.rows)
        fair = 4 * sum(r["__n"] for r in sizes) / parts
        if len(sizes) > cls.MAX_RANGES or max(r["__n"] for r in sizes) > max(fair, cls.FEW_ROWS):
            return None
        sizes.sort(key=lambda r: r["__b"])
        ranges = [(g, tuple(r[c] for c in data.strata), r["__b"]) for g, r in enumerate(sizes)]
        kinds = marks.schema
        names = data.rows.sparkSession.createDataFrame([(*k, b, g) for g, k, b in ranges], ", ".join(
            [*[f"`{c}` {kinds[c].dataType.simpleString()}" for c in data.strata], "__b int", "__g int"]))
        marks = ordered.null_safe(marks, F.broadcast(names), [*data.strata, "__b"]).select(
            "__g", "__t", "__s", "e", *x, *(["id"] if data.cluster else []))
        return cls(ordered.cut(marks.repartition(parts, "__g").sortWithinPartitions("__g", "__t")), data.p, ranges, bool(data.cluster))

    def _run(self, work, schema: str, kept: Sequence[str] = ()) -> DataFrame:
        """`work(g, t, s, e, x, the kept columns)` for each range, which gives lists of columns."""
        p, names = self.p, [*["__g", "__t", "__s", "e"], *[f"x{i}" for i in range(self.p)]]

        def run(batches):
            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            table = pa.Table.from_batches(batches)
            g, t, s, e, *x = (table.column(c).to_numpy() for c in names)
            x = np.array(x).reshape(p, len(g))
            ends = [*(np.flatnonzero(np.diff(g)) + 1), len(g)]
            for a, z in zip([0, *ends], ends):
                out = work(int(g[a]), t[a:z], s[a:z], e[a:z], x[:, a:z], table.slice(a, z - a))
                if out is not None:
                    yield from pa.table(out).to_batches()
        return self.marks.select(*names, *kept).mapInArrow(run, schema)

    def _after(self, beta: np.ndarray, second: bool) -> np.ndarray:
        """For each range what the later ranges of its stratum add to the sums over the risk set."""
        def sums(g, t, s, e, x, _):
            return {"g": [g], "v": [risk_weights(beta, s, x, second)[1].sum(axis=1)]}
        return self._others(self._run(sums, "g long, v array<double>"), last_first=True)

    def _others(self, per_range: DataFrame, last_first: bool) -> np.ndarray:
        rows = {r["g"]: np.array(r["v"]) for r in per_range.collect()}       # a row per range, MAX_RANGES at most
        out = np.zeros((self.n, len(next(iter(rows.values())))))
        for stratum in self.strata:
            total = np.zeros(out.shape[1])
            for g in reversed(stratum) if last_first else stratum:
                out[g], total = total, total + rows[g]
        return out

    def step(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p, pairs, after = self.p, _pairs(self.p), self._after(beta, True)

        def terms(g, t, s, e, x, _):
            xb, w = risk_weights(beta, s, x, True)
            at = np.flatnonzero(np.diff(t, prepend=np.nan) != 0)
            risk = np.cumsum(w[:, ::-1], axis=1)[:, ::-1][:, at] + after[g][:, None]
            d = np.add.reduceat(e, at)
            hit = np.flatnonzero(d > 0)
            if not len(hit):
                return None
            q = np.add.reduceat(e * w, at, axis=1)[:, hit]
            d, risk = d[hit].astype(int), risk[:, hit]
            which = np.repeat(np.arange(len(d)), d)                      # one column per event
            share = (np.arange(len(which)) - np.repeat(np.cumsum(d) - d, d)) / d[which]
            left = risk[:, which] - share * q[:, which]
            mean = left[1:] / left[0]
            ll = (e * xb).sum() - np.log(left[0]).sum()
            u = (e * x).sum(axis=1) - mean[:p].sum(axis=1)
            info = [mean[p + k].sum() - (mean[i] * mean[j]).sum() for k, (i, j) in enumerate(pairs)]
            return {"g": [g], "v": [np.array([ll, *u, *info])]}
        rows = self._run(terms, "g long, v array<double>").collect()          # a row per range
        total = np.sum([r["v"] for r in sorted(rows, key=lambda r: r["g"])], axis=0)
        info = np.zeros((p, p))
        for k, (i, j) in enumerate(pairs):
            info[i, j] = info[j, i] = total[1 + p + k]
        return float(total[0]), total[1:1 + p], info

    def meat(self, beta: np.ndarray) -> np.ndarray:
        p, after = self.p, self._after(beta, False)

        def hazard(g, t, s, e, x):
            """Per row: r, mean of the risk set at its time, hazard and hazard x mean of the range up to it."""
            _, w = risk_weights(beta, s, x, False)
            at = np.flatnonzero(np.diff(t, prepend=np.nan) != 0)
            risk = np.cumsum(w[:, ::-1], axis=1)[:, ::-1][:, at] + after[g][:, None]
            d = np.add.reduceat(e, at)
            mean = np.divide(risk[1:], risk[0], out=np.zeros((p, len(at))), where=d > 0)
            dh = np.divide(d, risk[0], out=np.zeros(len(at)), where=d > 0)
            run = np.cumsum(np.vstack([dh, dh * mean]), axis=1)
            place = np.repeat(np.arange(len(at)), np.diff([*at, len(t)]))
            return np.abs(w[0]), mean[:, place], run[:, place]

        def sums(g, t, s, e, x, _):
            return {"g": [g], "v": [hazard(g, t, s, e, x)[2][:, -1]]}
        before = self._others(self._run(sums, "g long, v array<double>"), last_first=False)

        def residuals(g, t, s, e, x, table):
            r, mean, run = hazard(g, t, s, e, x)
            run = run + before[g][:, None]
            v = e * (x - mean) - s * r * (x * run[0] - run[1:])
            return {"id": table.column("id").combine_chunks(), **{f"v{i}": v[i] for i in range(p)}}
        kind = self.marks.schema["id"].dataType.simpleString()
        rows = self._run(residuals, ", ".join([f"id {kind}", *[f"v{i} double" for i in range(p)]]), ["id"])
        units = rows.groupBy("id").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(p)])
        row = units.agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"w{i}_{j}") for i, j in _pairs(p)]).first()
        return np.array([[row[f"w{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)


def _penalty(beta: np.ndarray, weight: float, l1: float) -> float:
    return weight * float(l1 * np.abs(beta).sum() + 0.5 * (1 - l1) * (beta ** 2).sum())


def _model_step(beta, u, info, weight: float, l1: float) -> np.ndarray:
    """Maximum of the local quadratic with the penalty, one coordinate at a time."""
    if weight == 0:
        return beta + np.linalg.solve(info, u)
    out = beta.copy()
    for _ in range(500):
        before = out.copy()
        for k in range(len(out)):
            g = u[k] - info[k] @ (out - beta) + info[k, k] * out[k]
            out[k] = np.sign(g) * max(abs(g) - weight * l1, 0) / (info[k, k] + weight * (1 - l1))
        if np.max(np.abs(out - before)) < 1e-12:
            break
    return out


def fit(df: DataFrame, time: str, event: str, covariates: Sequence[str], *, strata: Sequence[str] = (),
        entry: str | None = None, cluster: str | None = None, penalty: float = 0.0, l1_ratio: float = 0.0,
        with_baseline: bool = True) -> CoxModel:
    """Cox fit with optional strata, late entry, clustered errors and penalty.

    The penalty is n x penalty x (l1 |b| + (1 - l1)/2 b^2) on covariates with
    deviation one.
    """
    base = _staged(df, time, event, covariates, strata, entry, cluster)
    data = _Data(base, len(covariates), strata, entry, cluster)
    data.laid = _Laid.of(data)
    return _fit(data, covariates, penalty, l1_ratio, with_baseline)


def _fit(data: _Data, covariates: Sequence[str], penalty: float = 0.0, l1_ratio: float = 0.0, with_baseline: bool = False) -> CoxModel:
    weight = penalty * data.n
    beta = np.zeros(data.p)
    ll, u, info = data.step(beta)
    value = ll - _penalty(beta, weight, l1_ratio)
    for _ in range(MAX_STEPS):
        target = _model_step(beta, u, info, weight, l1_ratio)
        move, shrink = target - beta, 1.0
        while True:
            trial = beta + shrink * move
            ll, u, info = data.step(trial)
            new = ll - _penalty(trial, weight, l1_ratio)
            if np.isfinite(new) and new >= value - 1e-10 * abs(value) or shrink < 1e-4:
                break
            shrink /= 2
        gained, beta, value = new - value, trial, new
        # steps converge quadratically: after a full step of 1e-6 the rest is below 1e-9
        if np.max(np.abs(shrink * move)) < TOLERANCE or abs(gained) < 1e-14 * abs(value):
            break
    hess = info + weight * (1 - l1_ratio) * np.eye(data.p)
    inverse = np.linalg.pinv(hess)
    unscale = np.outer(1 / data.scale, 1 / data.scale)
    variance = inverse
    if data.cluster:
        variance = inverse @ data.cluster_meat(beta) @ inverse
    base = data.baseline(beta) if with_baseline else None
    if base is not None:
        base = ordered.cut(base)
    return CoxModel(list(covariates), data.strata, beta / data.scale, variance * unscale, inverse * unscale,
                    data.means, ll, data.n, data.events, base, penalty)


# ------------------------------------------------------------------- penalised
def folds_by_hash(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 42, name: str = "dobra") -> DataFrame:
    """Fold number of each row from the hash of its key."""
    return df.withColumn(name, F.floor(hash_unit(*[F.col(c) for c in key], seed=seed) * k).cast("int"))


class _Path(_Data):
    """Staged rows for many models at once, each on the parts (`dobra`) it learns from. A row meets its
    models in a join on its part; sums are by model, and one job makes a step of all models that still
    move. `wanted` has (number, penalty, parts) of every model."""

    def __init__(self, base: DataFrame, p: int, strata: Sequence[str], entry: str | None, wanted: Sequence[tuple[int, float, set]]):
        self.strata, self.p, self.entry, self.cluster = ["__m", *strata], p, entry, None
        self.rows = base
        self.points = ordered.cut_points(self.rows, ["t"])["t"]
        found = {r["dobra"]: r for r in self.rows.groupBy("dobra").agg(F.count(F.lit(1)).alias("n"), *[
            e for i in range(self.p) for e in (F.avg(f"c{i}").alias(f"m{i}"), F.var_pop(f"c{i}").alias(f"v{i}"))]).collect()}
        self.models = {}                            # number: (penalty, parts, rows, means, deviations)
        for number, value, parts in wanted:
            mine = [r for f, r in found.items() if f in parts]
            n = np.array([r["n"] for r in mine], float)
            if n.sum() < 2:
                continue
            means = np.array([[r[f"m{i}"] for i in range(self.p)] for r in mine])
            within = np.array([[r[f"v{i}"] for i in range(self.p)] for r in mine])
            mean = n @ means / n.sum()
            dev = np.sqrt((n @ within + n @ (means - mean) ** 2) / (n.sum() - 1))
            self.models[number] = (float(value), parts, int(n.sum()), mean, np.where(dev > 0, dev, 1.0))
        self.folds = sorted(found)

    def table(self, betas: Mapping[int, np.ndarray], learning: bool) -> DataFrame:
        """(dobra, __m, b, mean, dev): the models that learn from a part, or those tested on it."""
        rows = [(f, m, beta.tolist(), self.models[m][3].tolist(), self.models[m][4].tolist())
                for m, beta in betas.items() for f in self.folds if (f in self.models[m][1]) == learning]
        return F.broadcast(self.rows.sparkSession.createDataFrame(rows, "dobra int, __m int, b array<double>, mean array<double>, dev array<double>"))

    def scored(self, betas: Mapping[int, np.ndarray], learning: bool = True) -> DataFrame:
        met = self.rows.join(self.table(betas, learning), "dobra").withColumns({f"x{i}": F.expr(f"(c{i} - mean[{i}]) / dev[{i}]") for i in range(self.p)})
        score = " + ".join(f"x{i} * b[{i}]" for i in range(self.p))
        return met.drop("mean", "dev").withColumn("xb", F.expr(score)).withColumn("r", F.expr("exp(xb)")).drop("b")

    def steps(self, betas: Mapping[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        at, aggs = self.terms(betas)
        return {r["__m"]: self.read(r) for r in at.groupBy("__m").agg(*aggs).collect()}

    def fit(self, l1: float) -> tuple[dict[int, np.ndarray], dict[int, bool]]:
        """Coefficients of all models on covariates with deviation one, and whether each has settled."""
        beta = {m: np.zeros(self.p) for m in self.models}
        weight = {m: model[0] * model[2] for m, model in self.models.items()}
        at = self.steps(beta)
        beta, done = {m: beta[m] for m in at}, {m: False for m in at}           # folds without events have no model
        value = {m: at[m][0] - _penalty(beta[m], weight[m], l1) for m in at}
        move = {m: _model_step(beta[m], *at[m][1:], weight[m], l1) - beta[m] for m in at}
        shrink, taken = dict.fromkeys(at, 1.0), dict.fromkeys(at, 0)
        active = set(at)
        while active:
            trial = {m: beta[m] + shrink[m] * move[m] for m in active}
            for m, (ll, u, info) in self.steps(trial).items():
                new = ll - _penalty(trial[m], weight[m], l1)
                if not (np.isfinite(new) and new >= value[m] - 1e-10 * abs(value[m]) or shrink[m] < 1e-4):
                    shrink[m] /= 2
                    continue
                size, gained = np.max(np.abs(shrink[m] * move[m])), new - value[m]
                beta[m], value[m], taken[m] = trial[m], new, taken[m] + 1
                done[m] = bool(size < TOLERANCE or abs(gained) < 1e-14 * abs(new))
                if done[m] or taken[m] >= MAX_STEPS:
                    active.discard(m)
                else:
                    move[m], shrink[m] = _model_step(beta[m], u, info, weight[m], l1) - beta[m], 1.0
        return beta, done


def cross_validated_path(df: DataFrame, time: str, event: str, covariates: Sequence[str], key: Sequence[str], *,
                         penalties: Sequence[float], l1_ratio: float = 0.0, k: int = 5, seed: int = 42,
                         strata: Sequence[str] = (), entry: str | None = None) -> DataFrame:
    """(penalizador, dobra, c_index, convergiu): C-index of every fold under the model of the others, for
    all penalties. All models are fitted side by side, one job a step, and judged in one pass."""
    base = _staged(folds_by_hash(df, key, k, seed), time, event, covariates, strata, entry, keep=["dobra"])
    return _judged_path(base, len(covariates), strata, entry, penalties, l1_ratio, k)


def _judged_path(base: DataFrame, p: int, strata: Sequence[str], entry: str | None, penalties: Sequence[float], l1_ratio: float,
                 k: int) -> DataFrame:
    seen = {r[0] for r in base.select("dobra").distinct().collect()}        # k at most
    wanted = [(f, value) for f in range(k) if f in seen for value in penalties]
    data = _Path(base, p, strata, entry, [(i, value, seen - {f}) for i, (f, value) in enumerate(wanted)])
    spark = base.sparkSession
    schema = "penalizador double, dobra int, c_index double, convergiu boolean"
    beta, done = data.fit(l1_ratio) if data.models else ({}, {})
    if not beta:
        return spark.createDataFrame([], schema)
    tested = data.scored(beta, learning=False).select("__m", "t", "e", "xb")
    found = concordance(tested, "t", "e", "xb", by=["__m"]).collect()       # a row for each model
    index = {r["__m"]: r["c_index"] for r in found}
    return spark.createDataFrame([(float(wanted[m][1]), wanted[m][0], index.get(m), done[m]) for m in beta], schema)


def cross_validated_concordance(df: DataFrame, time: str, event: str, covariates: Sequence[str], key: Sequence[str],
                                *, k: int = 5, seed: int = 42, penalty: float = 0.0, **options) -> dict:
    """C-index on rows the fit has not seen, per fold."""
    path = cross_validated_path(df, time, event, covariates, key, penalties=[penalty], k=k, seed=seed, **options)
    scores = [r["c_index"] for r in path.orderBy("dobra").collect()]
    return {"k": k, "cindex_medio": float(np.mean(scores)), "cindex_desvio": float(np.std(scores)), "scores": scores}


def fit_penalised(df: DataFrame, time: str, event: str, covariates: Sequence[str], key: Sequence[str], *,
                  penalties: Sequence[float] = tuple(np.logspace(-3, 1, 9)), l1_ratio: float = 1.0, k: int = 5,
                  seed: int = 42) -> dict:
    """Penalty with the best out-of-sample C-index, final fit and kept covariates."""
    base = _staged(folds_by_hash(df, key, k, seed), time, event, covariates, keep=["dobra"])
    path = _judged_path(base, len(covariates), (), None, penalties, l1_ratio, k)
    path = path.groupBy("penalizador").agg(F.avg("c_index").alias("cindex_cv"), F.stddev_pop("c_index").alias("cindex_std"),
                                           F.every("convergiu").alias("convergiu")).orderBy("penalizador")
    rows = path.collect()
    best = max(rows, key=lambda r: r["cindex_cv"])
    model = _fit(_Data(base, len(covariates), ()), covariates, best["penalizador"], l1_ratio, with_baseline=True)
    kept = [c for c, b in zip(covariates, model.coef) if abs(b) > 1e-6]
    return {"modelo": model, "melhor_penalizador": best["penalizador"], "cindex_cv": best["cindex_cv"], "selecionadas": kept,
            "trajetoria": df.sparkSession.createDataFrame(rows, path.schema)}


# ------------------------------------------------------------------- residuals
def proportionality_test(df: DataFrame, time: str, event: str, covariates: Sequence[str], *,
                         strata: Sequence[str] = ()) -> DataFrame:
    """Schoenfeld test per covariate against the rank of the event time."""
    spark = df.sparkSession
    data = _Data(_staged(df, time, event, covariates, strata), len(covariates), strata)
    model = _fit(data, covariates)
    beta = model.coef * data.scale
    at = _residual_sums(data, beta)
    per = at.groupBy("t").agg(F.sum("d").alias("d"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(data.p)])
    ranked = ordered.running_sums(per, [], "t", {"__ate": "d"}, points=data.points)
    ranked = ranked.withColumn("g", F.col("__ate") - (F.col("d") - 1) / 2)
    row = ranked.agg(F.sum("d").alias("d"), F.sum(F.col("d") * F.col("g")).alias("g"),
                     F.sum(F.col("d") * F.col("g") * F.col("g")).alias("gg"),
                     *[F.sum(f"w{i}").alias(f"w{i}") for i in range(data.p)],
                     *[F.sum(F.col("g") * F.col(f"w{i}")).alias(f"gw{i}") for i in range(data.p)]).first()
    n, mean = row["d"], row["g"] / row["d"]
    spread = row["gg"] - n * mean ** 2
    raw = np.array([row[f"gw{i}"] - mean * row[f"w{i}"] for i in range(data.p)]) * data.scale
    scaled = n * model.naive_variance @ raw
    tails, out = Tails(spark), []
    for i, c in enumerate(covariates):
        stat = float(scaled[i] ** 2 / (n * model.naive_variance[i, i] * spread))
        out.append((c, stat, tails.chi2_upper(stat, 1)))
    return spark.createDataFrame(out, "covariavel string, estatistica double, p_valor double")


def _residual_sums(data: _Data, beta: np.ndarray) -> DataFrame:
    """(strata, t, d, w0..): sum of x minus its risk-set mean over the events of a time."""
    at = data.per_time(beta, second=False).filter("d > 0")
    d, s0, e0 = F.col("d"), F.col("Rs"), F.col("q")
    at = at.withColumn("A0", d / e0 * sum_inverse(d * s0 / e0, d)).withColumn("A1", (s0 * F.col("A0") - d) / e0)
    return at.select(*data.strata, "t", "d", *[
        (F.col(f"ex_{i}") - F.col(f"Rs_{i}") * F.col("A0") + F.col(f"q_{i}") * F.col("A1")).alias(f"w{i}")
        for i in range(data.p)])


def effect_over_time(df: DataFrame, time: str, event: str, covariates: Sequence[str], covariate: str, *,
                     strata: Sequence[str] = (), bins: int = 20) -> tuple[DataFrame, dict]:
    """(bins of event order with mean scaled residual, single averaged effect)."""
    spark = df.sparkSession
    data = _Data(_staged(df, time, event, covariates, strata), len(covariates), strata)
    model = _fit(data, covariates)
    at = _residual_sums(data, model.coef * data.scale)
    k = list(covariates).index(covariate)
    weights = model.events * model.naive_variance[k] * data.scale
    mix = F.lit(0.0)
    for i, w in enumerate(weights):
        mix = mix + F.col(f"w{i}") * F.lit(float(w))
    per = at.groupBy("t").agg(F.sum("d").alias("d"), F.sum(mix).alias("r"))
    ranked = ordered.running_sums(per, [], "t", {"__ate": "d"}, points=data.points)
    middle = (F.col("__ate") - (F.col("d") + 1) / 2) / F.lit(float(model.events))
    out = ranked.groupBy(F.floor(middle * bins).cast("int").alias("faixa")).agg(
        F.sum(F.col("t") * F.col("d")).alias("__t"), F.sum("d").cast("long").alias("eventos"), F.sum("r").alias("__r"))
    curve = out.select("faixa", (F.col("__t") / F.col("eventos")).alias("tempo_medio"), "eventos",
                       (F.col("__r") / F.col("eventos") + F.lit(float(model.coef[k]))).alias("efeito"))
    tails = Tails(spark)
    return ordered.cut(curve), {"coef": float(model.coef[k]),
                                "p_valor": tails.normal_two_sided(model.coef[k] / model.errors[k])}


def effects_by_period(df: DataFrame, time: str, event: str, covariates: Sequence[str], covariate: str, at: float, *,
                      strata: Sequence[str] = (), truth: tuple[float, float] | None = None) -> DataFrame:
    """Effect before and after a time and their difference. `erro_padrao` comes from
    the covariance; `erro_padrao_aproximado` leaves the covariance out."""
    from brisa.operators.survival import split_at
    spark = df.sparkSession
    panel = split_at(df, time, event, at, covariate)
    inter = f"{covariate}_depois"
    model = fit(panel, "t_fim", event, [*covariates, inter], strata=strata, entry="t_inicio", with_baseline=False)
    i, j = list(covariates).index(covariate), len(covariates)
    before, delta = model.coef[i], model.coef[j]
    v = model.variance
    eb, ed = np.sqrt(v[i, i]), np.sqrt(v[j, j])
    joint = np.sqrt(max(v[i, i] + v[j, j] + 2 * v[i, j], 0))
    tails = Tails(spark)
    known = (truth[0], truth[1], truth[1] - truth[0]) if truth else (None, None, None)
    rows = []
    for name, b, e, approx, real, p in (
            (f"antes de {at:g}", before, eb, eb, known[0], tails.normal_two_sided(before / eb)),
            (f"depois de {at:g}", before + delta, joint, float(np.hypot(eb, ed)), known[1], None),
            ("diferença", delta, ed, ed, known[2], tails.normal_two_sided(delta / ed))):
        lo, hi = b - 1.96 * e, b + 1.96 * e
        rows.append((name, real, float(b), float(e), float(approx), float(lo), float(hi),
                     None if real is None else bool(lo <= real <= hi), p))
    return spark.createDataFrame(rows, "periodo string, beta_verdadeiro double, beta_estimado double, erro_padrao double, "
                                 "erro_padrao_aproximado double, ic_inferior double, ic_superior double, ic_cobre boolean, "
                                 "p_valor double")


def compare_with_truth(table: DataFrame, truth: Mapping[str, float]) -> DataFrame:
    """Estimated against known coefficients: error and whether the interval holds them."""
    known = table.sparkSession.createDataFrame([(k, float(v)) for k, v in truth.items()],
                                               "covariavel string, verdadeiro double")
    return table.join(F.broadcast(known), "covariavel", "left").withColumns({
        "erro": F.col("coef") - F.col("verdadeiro"),
        "dentro_do_ic": F.col("verdadeiro").between(F.col("ic_inferior"), F.col("ic_superior"))})


# ------------------------------------------------------------------ prediction
def predict_survival(model: CoxModel, rows: DataFrame, times: Sequence[float] | None = None,
                     at: str | None = None, name: str = "sobrevivencia") -> DataFrame:
    """S(t) of each row at given times, or at the time of a column; the baseline is
    read by interpolation and clamps at both ends."""
    scored = rows.withColumn("__xb", model.score())
    if at is None:
        scored = scored.withColumn("tempo", F.explode(F.array(*[F.lit(float(t)) for t in times])))
        at = "tempo"
    found = curve_lookup(scored, model.baseline, at, "tempo", "risco_base", model.strata, "__h0")
    return found.withColumn(name, F.exp(-F.col("__h0") * F.exp("__xb"))).drop("__h0", "__xb")


def predict_median(model: CoxModel, rows: DataFrame, name: str = "tempo_mediano_anos") -> DataFrame:
    """First time at which S is at or below one half; null when never reached."""
    inverse = model.baseline.groupBy(*model.strata, "risco_base").agg(F.min("tempo").alias("tempo"))
    # read the inverse curve backwards: the first hazard at or above the need
    flipped = inverse.withColumn("__neg", -F.col("risco_base"))
    asked = rows.withColumn("__need", -F.lit(float(np.log(2))) / F.exp(model.score()))
    return step_lookup(asked, flipped, "__need", "__neg", "tempo", model.strata, name).drop("__need")


def fit_weibull(df: DataFrame, time: str, event: str, covariates: Sequence[str], stratum: str) -> dict:
    """Weibull regression per source: {value: (coefficients, intercept, scale)}."""
    base = df.dropna(subset=[time, event, stratum, *covariates]).select(
        stratum, F.col(time).cast("double").alias("label"), F.col(event).cast("double").alias("censor"),
        *[F.col(c).cast("double").alias(c) for c in covariates])
    assembled = VectorAssembler(inputCols=list(covariates), outputCol="features").transform(base)
    out = {}
    for value in sorted(r[0] for r in base.select(stratum).distinct().collect()):
        m = AFTSurvivalRegression(censorCol="censor", maxIter=200, tol=1e-9).fit(
            assembled.filter(F.col(stratum) == F.lit(value)))
        out[value] = ([float(c) for c in m.coefficients], float(m.intercept), float(m.scale))
    return out


def weibull_survival(fits: Mapping, covariates: Sequence[str], stratum: str, at: Column) -> Column:
    """S(t) of a row by the Weibull regression of its source."""
    out = F.lit(None).cast("double")
    for value, (coef, intercept, scale) in fits.items():
        mu = F.lit(intercept)
        for c, b in zip(covariates, coef):
            mu = mu + F.col(c).cast("double") * F.lit(b)
        s = F.exp(-F.pow(at / F.exp(mu), F.lit(1 / scale)))
        out = F.when(F.col(stratum) == F.lit(value), s).otherwise(out)
    return out


def conditional_survival(model: CoxModel, rows: DataFrame, key: str, *, age: str | None = "idade_anos",
                         months: Sequence[int] = HORIZON_MONTHS, weibull: Mapping | None = None,
                         limits: DataFrame | None = None) -> DataFrame:
    """P(no event for m more months | age): Cox within the support of its source,
    Weibull beyond it, with the method used and the relative risk."""
    stratum = model.strata[0]
    base = rows.withColumn("__age", F.col(age).cast("double") if age else F.lit(0.0))
    if limits is not None:
        base = base.join(limits.select(stratum, F.col("limite").alias("__lim")), stratum, "left")
    else:
        base = base.withColumn("__lim", F.lit(None).cast("double"))
    base = base.withColumn("__out", F.coalesce(F.col("__age") > F.col("__lim"), F.lit(False)))
    out = base.withColumn("risco_relativo", F.exp(model.score()))
    for m in (0, *months):
        out = curve_lookup(out.withColumn("__at", F.col("__age") + F.lit(m) / 12), model.baseline, "__at", "tempo", "risco_base",
                           model.strata, f"__h{m}").drop("__at")
    changes = {}
    for m in months:
        cox = F.exp(-(F.col(f"__h{m}") - F.col("__h0")) * F.col("risco_relativo"))
        value = cox
        if weibull:
            start = weibull_survival(weibull, model.covariates, stratum, F.col("__age"))
            end = weibull_survival(weibull, model.covariates, stratum, F.col("__age") + m / 12)
            value = F.when(F.col("__out"), F.try_divide(end, start)).otherwise(cox)
        changes[f"p_sem_manutencao_{m}m"] = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    changes["metodo_extrapolacao"] = F.when(F.col("__out"), "weibull").otherwise("cox")
    changes["condicional_na_idade"] = F.lit(age is not None)
    return out.withColumns(changes).drop(*[c for c in ("__age", "__lim", "__out", "__h0", *[f"__h{m}" for m in months])])


def product_table(model: CoxModel, units: DataFrame, key: str = "usina_id", **options) -> DataFrame:
    """One row per unit: probabilities, relative risk, median time and method."""
    return predict_median(model, conditional_survival(model, units, key, **options))


def calibration(model: CoxModel, df: DataFrame, time: str, event: str, times: Sequence[float] = (1, 2, 3),
                groups: int = 3) -> DataFrame:
    """Mean predicted against Kaplan-Meier survival per equal-count risk group."""
    from brisa.functions.numeric import bin_of
    from brisa.operators.cleaning import bin_edges
    wanted = [time, event, *model.covariates]
    scored = table_in_shared_folder(df.dropna(subset=wanted).select(*dict.fromkeys([*wanted, *model.strata])), "calibra").withColumn(
        "__risk", F.exp(model.score()))
    edges = bin_edges(scored, "__risk", "quantil", groups)
    grouped = scored.withColumn("grupo_risco", bin_of(F.col("__risk"), edges, [f"g{i + 1}" for i in range(len(edges) - 1)]))
    # the hazard is read once per stratum and time; a row then takes its own strata's
    points = grouped.select(*model.strata).distinct().withColumn("tempo", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    read = curve_lookup(points, model.baseline, "tempo", "tempo", "risco_base", model.strata, "__h0")
    read = read.groupBy(*model.strata).agg(F.collect_list(F.struct("tempo", "__h0")).alias("__at"))
    met = ordered.null_safe(grouped.select(*model.strata, "grupo_risco", "__risk"), F.broadcast(ordered.cut(read)), model.strata)
    met = met.select("grupo_risco", "__risk", F.explode("__at").alias("__p")).select("grupo_risco", "__risk", "__p.*")
    predicted = met.groupBy("grupo_risco", "tempo").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.exp(-F.col("__h0") * F.col("__risk"))) / F.count(F.lit(1))).alias("previsto"))
    curve = ordered.cut(kaplan_meier(grouped, time, event, ["grupo_risco"]))
    seen = step_lookup(predicted.withColumnRenamed("tempo", "tempo_anos"), curve, "tempo_anos", "tempo", "sobrevivencia",
                       ["grupo_risco"], "observado_km", before=1.0)
    return seen.withColumn("erro", F.col("previsto") - F.col("observado_km"))


def poisson_terms(mean: float) -> int:
    """Terms of the Poisson law beyond which a draw of 52 bits cannot tell the rest apart."""
    k, p, rest = 0, math.exp(-mean), 1.0
    while rest > 2.0 ** -53:
        rest -= p
        k += 1
        p *= mean / k
        if p < 2.0 ** -60 and k > mean:
            break
    return k


def survivor_bias(df: DataFrame, time: str, event: str, covariates: Sequence[str], stratum: str, age: Column, *,
                  key: Sequence[str], old: float, fractions: Sequence[float] = (0.05, 0.10, 0.20, 0.50),
                  focus: str | None = None, at: float = 5.0, seed: int = 42) -> DataFrame:
    """How far estimates move when a share of the old cohort is added as early
    failures at the first quartile of its times (drawn with replacement: each old
    row gets a Poisson number of copies from the hash of its key)."""
    from brisa.operators.survival import counts, curve_of_counts, medians
    spark = df.sparkSession
    cohort = table_in_shared_folder(df.withColumn("__old", age >= old).select(
        *dict.fromkeys([*key, time, event, stratum, *covariates]), "__old"), "coorte")
    olds = cohort.filter("__old")
    early = ordered.quantile_values(olds, [time], [0.25])[time].get(0.25)
    if early is None:
        raise ValueError(f"no unit with an age of {old:g} or more")
    shares = (0.0, *fractions)                  # model 0 has the rows alone; part i holds what is added for share i
    extra = []
    for i, f in enumerate(shares):
        copies, total, p = F.lit(0), 0.0, np.exp(-f)
        for k in range(poisson_terms(f) if f else 0):           # Poisson(f) by its distribution function
            total += p
            copies = copies + (F.col("__u") > F.lit(float(total))).cast("int")
            p *= f / (k + 1)
        extra.append(F.array_repeat(F.lit(i), copies))
    columns = [stratum, *covariates]
    added = (olds.withColumn("__u", hash_unit(*[F.col(k) for k in key], seed=seed))
             .withColumn("dobra", F.explode(F.flatten(F.array(*extra))))
             .select("dobra", F.lit(float(early)).alias("t"), F.lit(1.0).alias("e"), *columns))
    own = cohort.select(F.lit(0).alias("dobra"), F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"), *columns)
    base = table_in_shared_folder(own.unionByName(added).select(
        "dobra", stratum, "t", "e", *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(covariates)]), "ajuste")
    sizes = {r["dobra"]: r["n"] for r in base.filter("dobra > 0").groupBy("dobra").agg(F.count(F.lit(1)).alias("n")).collect()}
    # counts of the rows are those of every share; what is added comes on top
    seen = counts(base, "t", "e", ["dobra", stratum])
    models = F.when(F.col("dobra") == 0, F.sequence(F.lit(0), F.lit(len(shares) - 1))).otherwise(F.array("dobra"))
    seen = seen.withColumn("__m", F.explode(models)).groupBy("__m", stratum, "tempo").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by = ["__m", stratum]
    curve = ordered.cut(curve_of_counts(seen, by))
    mids = {(r["__m"], r[stratum]): r for r in medians(curve, by).collect()}
    asks = curve.select(*by).distinct().withColumn("__at", F.lit(float(at)))
    s5 = {(r["__m"], r[stratum]): r["s"] for r in step_lookup(asks, curve, "__at", "tempo", "sobrevivencia", by, "s", before=1.0).collect()}
    whole = base.dropna(subset=[stratum, "t", "e", *[f"c{i}" for i in range(len(covariates))]])
    path = _Path(whole, len(covariates), [stratum], None, [(i, 0.0, {0, i}) for i in range(len(shares))])
    betas, _ = path.fit(0.0)
    which = list(covariates).index(focus or covariates[0])
    rows = [(float(shares[i]), int(sizes.get(i, 0)), int(path.models[i][2]), str(g), mids[i, g]["mediana"], s5[i, g],
             float(betas[i][which] / path.models[i][4][which])) for i, g in sorted(mids)]
    return spark.createDataFrame(rows, "fracao_perdida double, adicionadas long, n_total long, estrato string, "
                                 "mediana double, s_no_tempo double, beta double")


def units_for_prediction(dim: DataFrame, as_of: str) -> DataFrame:
    """Units with known power and start: age at a day and model covariates."""
    from brisa.functions.numeric import model_covariates
    from brisa.functions.quality import check_rows
    ready = dim.filter(F.col("potencia_mw").isNotNull() & F.col("data_operacao").isNotNull()).withColumn(
        "id_subsistema", F.col("regiao")).withColumn(
        "idade_anos", F.datediff(F.lit(as_of).cast("date"), "data_operacao") / 365.25)
    ready = model_covariates(ready, start="data_operacao")
    check_rows(ready, {f"{c} nula": F.col(c).isNull() for c in MODEL_COVARIATES})
    return ready
