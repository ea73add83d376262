"""Whitening of embeddings on components found by spectral divide and conquer.

The covariance of the distinct vectors is summed over the cluster; what reaches the driver is one
matrix of size times size numbers. There it is split: the orthogonal polar factor U of the matrix less a shift, from
QDWH (QR- and Cholesky-based dynamically weighted Halley steps), has eigenvalues 1 and -1, so (U + I) / 2
projects on all directions whose eigenvalue lies above the shift. Bases of the two invariant subspaces
cut the matrix in two, and each half is split again, down to single directions or equal eigenvalues.
The whitening matrix, size times the number of components, is broadcast and applied row by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from brisa.llm.common import staged

#: Entries become whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this have no whole number; rows with one are dropped like those with infinite ones.
LARGEST = float(1 << 61)
#: Sums of matrices from all tasks pass through this many groups for each row first.
FAN = 64
#: Eigenvalues below this share of the trace, per dimension, are rounding: nothing varies there.
NOTHING = 1e-14


# ---- spectral divide and conquer

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    m, eye = len(a), np.eye(len(a))
    x, low = a / np.linalg.norm(a), 1e-16                # low: no singular value of x is smaller
    for _ in range(30):
        s = low * low
        d = np.cbrt(4 * (1 - s) / (s * s))
        alpha = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - s) / (s * np.sqrt(1 + d))) / 2
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        if gamma > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, eye]))
            y = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:m] @ q[m:].T)
        else:
            lower = np.linalg.cholesky(eye + gamma * (x.T @ x))
            inner = np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
            y = beta / gamma * x + (alpha - beta / gamma) * inner
        y = (y + y.T) / 2
        step, x = np.linalg.norm(y - x), y
        low = min(1.0, low * (alpha + beta * s) / (1 + gamma * s))
        if step < 1e-5 and 1 - low < 1e-15:
            break
    return x


def halves(b: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """An orthonormal basis whose first columns span the directions of b above `shift`, their number,
    and how far b mixes the two sides."""
    m = len(b)
    above = (polar_factor(b - shift * np.eye(m)) + np.eye(m)) / 2
    r = int(round(np.trace(above)))
    if r in (0, m):
        return np.eye(m), r, np.inf
    q = rng.normal(size=(m, m))
    for _ in range(2):
        q, _ = np.linalg.qr(np.hstack([above @ q[:, :r], q[:, r:] - above @ q[:, r:]]))
    return q, r, float(np.linalg.norm(q[:, r:].T @ b @ q[:, :r]))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    size, rng = len(a), np.random.default_rng(1)
    scale, done = np.linalg.norm(a), []
    todo = [np.eye(size)]
    while todo:
        v = todo.pop()
        b = v.T @ a @ v
        b, m = (b + b.T) / 2, v.shape[1]
        centre = np.trace(b) / m
        if m == 1 or np.linalg.norm(b - centre * np.eye(m)) <= 4 * size * np.finfo(float).eps * scale:
            done.append(v)
            continue
        wide = np.linalg.norm(b - centre * np.eye(m)) / np.sqrt(m)
        best = None
        # a shift may hit an eigenvalue, which then belongs to neither side: others are tried
        for shift in (np.median(np.diag(b)), centre, *(centre + wide * t for t in (0.13, -0.13, 0.37, -0.37, 0.71, -0.71))):
            found = halves(b, float(shift), rng)
            if best is None or found[2] < best[2]:
                best = found
            if best[2] <= 64 * size * np.finfo(float).eps * scale:
                break
        q, r, _ = best
        todo += [v @ q[:, :r], v @ q[:, r:]]
    v = np.hstack(done)
    values = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


# ---- sums over the cluster

def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size)


def exact_sums(fit: DataFrame, size: int) -> list[int]:
    """The sum of every dimension, in halves of 32 bits that cannot overflow."""
    def work(batches):
        high, low = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), size)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(high), pa.array(low)], ["j", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = fit.select("x").mapInArrow(work, "j int, high long, low long").groupBy("j").agg(wide("high"), wide("low")).orderBy("j").collect()
    return [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


class Centred:
    """Rows less their mean, which is held as whole numbers and the fraction that is left."""

    def __init__(self, n: int, sums: list[int]):
        self.n, whole = n, [s // n for s in sums]
        self.whole, self.left = np.array(whole, np.int64), np.array([s - n * q for s, q in zip(sums, whole)], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.left / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n x - S)^2, exactly."""
        far = x - self.whole
        reach = (int(np.abs(far).max(initial=0)) + 1) * self.n
        if reach * reach * max(1, x.shape[1]) < 1 << 63:
            return ((far * self.n - self.left) ** 2).sum(axis=1)
        out = ((far.astype(object) * self.n - self.left.astype(object)) ** 2).sum(axis=1)
        if max(out) >= 1 << 63:
            raise OverflowError("a deviation of this many vectors does not fit a 64-bit number")
        return out.astype(np.int64)


def second_moments(fit: DataFrame, size: int, of) -> np.ndarray:
    """Sum over all rows of y y', where y is `of` the row and a last entry 1."""
    def work(batches):
        total = None
        for batch in batches:
            y = of(matrix(batch.column(0), size))
            y = np.hstack([y, np.ones((len(y), 1))])
            total = y.T @ y + (0 if total is None else total)
        if total is not None:
            k, slot = len(total), TaskContext.get().partitionId() % FAN
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([slot] * k, pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
                                             ["i", "slot", "values"])

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in table.column("values"))
        return pa.table([table.column("i").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["i", "values"])

    rows = fit.select("x").mapInArrow(work, "i int, slot int, values binary")
    rows = rows.groupBy("i", "slot").applyInArrow(summed, "i int, values binary").groupBy("i").applyInArrow(summed, "i int, values binary")
    return np.array([np.frombuffer(r["values"]) for r in rows.orderBy("i").collect()])


def covariance(moments: np.ndarray, n: int) -> np.ndarray:
    """From moments about a point near the mean; what the mean is still off is taken out."""
    mean = moments[-1, :-1] / n
    return moments[:-1, :-1] / n - np.outer(mean, mean)


# ---- the operator

def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < LARGEST), F.lit(False))), F.lit(False))


def whitened(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row of `vectors` and component, from 1 by falling variance: vec_id, component,
    n (distinct vectors fitted), deviation (exact sum over the dimensions of (n x - S)^2), whitened (x less
    the mean, on the component, at unit variance), explained (share of the variance) and identity_error
    (largest entry of the covariance of all whitened fitted vectors less the identity).

    x is floor(64 c) + 1000000 for every entry c. Each distinct x is fitted once, so repeated rows weigh
    nothing, but all of them are given. Rows are dropped whose vector is null, empty, holds null, non-finite
    or larger entries than whole numbers of 64 bits can, or is not of the size that most rows have (the smallest of
    these sizes). Directions in which nothing varies have no component: with fewer dimensions or
    distinct vectors there are fewer components, and none at all where all vectors are equal or the
    table is empty. Null and repeated ids stay as they are; other columns are not looked at."""
    spark = vectors.sparkSession
    vector = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("v")).filter(usable(F.col("v")) & (F.size("v") > 0))
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + OFFSET).alias("x"))
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = f"vec_id {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    size = common["size"]
    rows = rows.filter(F.size("x") == size)
    fit = staged(rows.select("x").distinct(), "distinct-vectors")
    n = fit.count()
    centred = Centred(n, exact_sums(fit, size))
    v = covariance(second_moments(fit, size, centred), n)
    values, directions = eigen(v)
    total = float(np.trace(v))
    k = int((values[:components] > size * NOTHING * total).sum())
    if k == 0:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(directions[:, :k] / np.sqrt(values[:k]))
    error = float(np.abs(covariance(second_moments(fit, size, lambda x: centred(x) @ shared.value), n) - np.eye(k)).max())

    def work(batches):
        for batch in batches:
            x = matrix(batch.column(1), size)
            flat = pa.array((centred(x) @ shared.value).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centred.deviations(x)), pa.FixedSizeListArray.from_arrays(flat, k).cast(pa.list_(pa.float64()))],
                                             ["vec_id", "deviation", "w"])

    each = rows.mapInArrow(work, f"vec_id {vectors.schema[id_col].dataType.simpleString()}, deviation long, w array<double>")
    share = F.array(*(F.lit(float(e) / total) for e in values[:k]))
    each = each.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
