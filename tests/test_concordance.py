import numpy as np
import pytest

from brisa.operators import survival
from brisa.operators.survival import concordance


def brute(rows):
    c = x = e = 0
    for _, t, d, s in rows:
        for _, u, f, r in rows if d else ():
            if u > t or (u == t and not f):
                c, x, e = c + (s > r), x + (s < r), e + (s == r)
    return c, x, e


def rows_of(kind, n=400):
    rng = np.random.default_rng(5)
    t = {"continuous": rng.exponential(9, n), "heavy": np.where(rng.random(n) < 0.5, 3.0, rng.integers(1, 9, n) * 1.0)}[kind]
    s = {"continuous": rng.normal(size=n), "heavy": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n).round(1))}[kind]
    return [("ab"[i % 2], float(u), int(rng.random() < 0.6), float(v)) for i, (u, v) in enumerate(zip(t, s))]


@pytest.mark.parametrize("kind", ["continuous", "heavy"])
@pytest.mark.parametrize("size", [8, 30, 250_000])
def test_equals_all_pairs(spark, monkeypatch, kind, size):
    monkeypatch.setattr(survival, "PAIR_ROWS", size)
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, "g string, t double, e int, s double")
    got = {r["g"]: r for r in concordance(df, "t", "e", "s", by=["g"]).collect()}
    for g in "ab":
        want = brute([r for r in rows if r[0] == g])
        assert (got[g]["concordantes"], got[g]["discordantes"], got[g]["empates"]) == want
        assert got[g]["c_index"] == pytest.approx((want[0] + want[2] / 2) / sum(want), abs=1e-12)


def test_without_rows(spark):
    empty = spark.createDataFrame([], "g string, t double, e int, s double")
    assert [tuple(r) for r in concordance(empty, "t", "e", "s").collect()] == [(None, None, None, None)]
    assert concordance(empty, "t", "e", "s", by=["g"]).collect() == []


def test_rows_are_not_multiplied(spark, tmp_path):
    """What a task of the pair counts reads stays in proportion to the rows: no copy for each digit of a score."""
    from brisa.operators import ordered
    calls = []
    original, ordered.running_sums = ordered.running_sums, lambda *a, **k: calls.append(1) or original(*a, **k)
    try:
        concordance(spark.createDataFrame(rows_of("continuous"), "g string, t double, e int, s double"), "t", "e", "s").collect()
    finally:
        ordered.running_sums = original
    assert not calls
