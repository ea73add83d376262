import math

import numpy as np
import pytest

from brisa.llm import queries, whitening as op13

SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def rotated(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    [1.0], [3.0, 3.0], [2.0, 1.0], [5.0, 5.0, 5.0, 1.0, 1.0], [1.0, 0.0, 0.0, 0.0], [1e6, 1.0, 1e-3, 1e-6], list(range(1, 65)), [1.0] * 20 + [1.0 + 1e-9] * 20, [2.0 ** -k for k in range(40)], [-3.0, 0.0, 3.0]])
def test_eigenvectors(values):
    a = rotated(np.array(values))
    found, v = op13.eigen(a)
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-14 * np.abs(values).max() * len(values))
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-13
    assert np.abs(a @ v - v * found).max() < 1e-13 * len(values) * np.abs(values).max()


def test_polar_factor():
    a = rotated(np.array([5.0, 1e-9, -1e-6, -2.0]))
    u = op13.polar_factor(a)
    w, q = np.linalg.eigh(a)
    assert np.abs(u - (q * np.sign(w)) @ q.T).max() < 1e-6 and np.abs(u @ u - np.eye(4)).max() < 1e-13


def expected(rows, components=16):
    good = [(r[0], [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]]) for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    fit = [list(t) for t in {tuple(x) for _, x in good}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, v = np.linalg.eigh(z.T @ z / n)
    values, v = values[::-1], v[:, ::-1]
    out = {}
    for key, x in good:
        exact = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ v / np.sqrt(np.maximum(values, 1e-300))
        out[key] = (n, exact, w[:components])
    return out, values[:components] / values.sum()


def test_query_on_a_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 24)) * np.linspace(0.2, 3, 24)
    rows = [(i, [float(c) for c in e], i % 3, "x") for i, e in enumerate(base)]
    rows += [(1000 + i, rows[7][1], 1, "y") for i in range(200)]                        # one vector in very many rows
    rows += [(2000, None, 1, "x"), (2001, [], 1, "x"), (2002, [1.0, None] + [0.0] * 22, 1, "x"), (2003, [float("nan")] * 24, 1, "x"), (2004, [float("inf")] + [0.0] * 23, None, "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op13_whitening"](spark, str(tmp_path)).collect()
    want, share = expected(rows)
    assert len(got) == 16 * len(want) == 16 * 500
    sign = {}
    for r in got:
        n, exact, w = want[r.vec_id]
        k = r.component - 1
        sign.setdefault(k, 1 if r.whitened * w[k] > 0 else -1)
        assert (r.n, r.deviation) == (n, exact) == (300, exact)
        assert abs(r.whitened * sign[k] - w[k]) < 1e-8 and abs(r.explained / share[k] - 1) < 1e-9 and r.identity_error < 1e-9


def test_few_dimensions_and_few_vectors(spark):
    rows = [(1, [1.0, 2.0, 0.0]), (2, [1.0, 2.5, 0.0]), (3, [1.0, 9.0, 0.0]), (3, [1.0, 9.0, 0.0]), (None, [1.0, 2.0, 0.0]), (4, [1.0, 2.0])]
    out = op13.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (1, 1), (2, 1), (3, 1), (3, 1)] and all(abs(r.explained - 1) < 1e-12 for r in out)
    same = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert op13.whitened(same).count() == 0 and op13.whitened(same.limit(0)).count() == 0
    assert op13.whitened(same.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_exact_beyond_doubles(spark):
    centred = op13.Centred(3, [3 * 10 ** 12 + 1, 5])
    x = np.array([[10 ** 12 + 7 * 10 ** 7, 1]], np.int64)
    assert centred.deviations(x).tolist() == [(3 * int(x[0, 0]) - 3 * 10 ** 12 - 1) ** 2 + 4]
    with pytest.raises(OverflowError):
        centred.deviations(np.array([[10 ** 13, 1]], np.int64))
    huge = spark.createDataFrame([(1, [1e300]), (2, [1.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in op13.whitened(huge).collect()} == {2, 3}
