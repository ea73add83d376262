from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brisa.functions import numeric
from brisa.operators import cleaning, grid, ordered, profile

T0 = datetime(2026, 7, 1)


def hours(spark, values, key="a", start=0):
    rows = [(key, T0 + timedelta(hours=start + i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "chave string, instante timestamp_ntz, medida double")


def filled(df, limit=3):
    out = grid.fill_short_gaps(df, "chave", "instante", ["medida"], limit).orderBy("chave", "instante").collect()
    return [r["medida"] for r in out], [r["interpolado"] for r in out], [r["faltante"] for r in out]


@pytest.mark.parametrize("gap,kept", [(1, True), (2, True), (3, True), (4, False), (5, False), (12, False), (48, False)])
def test_whole_gaps_only(spark, gap, kept):
    values = [10.0 * i for i in range(60)]
    holes = [None if 5 <= i < 5 + gap else v for i, v in enumerate(values)]
    got, marks, missing = filled(hours(spark, holes))
    if kept:
        assert got == pytest.approx(values) and sum(marks) == gap and not any(missing)
    else:
        assert got == holes and not any(marks) and sum(missing) == gap


def test_edges_and_neighbours(spark):
    a = hours(spark, [None, None, 1, None, 3, None], "a")
    b = hours(spark, [7, None, None, 10], "b", start=6)
    got, _, _ = filled(a.unionByName(b))
    assert got == [None, None, 1, 2, 3, None, 7, 8, 9, 10]


def test_gap_across_chunks(spark):
    """A gap on a chunk limit is filled like any other; compared with pandas."""
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.35 else float(rng.integers(0, 50)) for _ in range(2000)]
    got, _, _ = filled(hours(spark, values))
    s = pd.Series([np.nan if v is None else v for v in values])
    run = s.notna().cumsum()
    size = s.isna().groupby(run).transform("sum")
    want = s.where(~(s.isna() & (size <= 3)), s.interpolate(limit_area="inside"))
    np.testing.assert_allclose(np.array([np.nan if v is None else v for v in got]), want.to_numpy())


def test_grid_limits_are_per_series(spark):
    df = hours(spark, [1], "a").unionByName(hours(spark, [2], "a", 5)).unionByName(hours(spark, [3], "b", 2))
    df = df.withColumn("uf", F.when(F.col("medida") == 2, "BA"))
    out = grid.complete_grid(df, "chave", "instante", ["uf"]).orderBy("chave", "instante").collect()
    assert [(r["chave"], r["instante"].hour) for r in out] == [("a", h) for h in range(6)] + [("b", 2)]
    assert {r["uf"] for r in out if r["chave"] == "a"} == {"BA"} and sum(r["criada"] for r in out) == 4


def test_daily_grid_and_two_columns(spark):
    rows = [("x", (T0 + timedelta(days=d)).date(), v, w) for d, v, w in [(0, 1.0, 1.0), (2, 3.0, None), (3, 4.0, 4.0)]]
    df = spark.createDataFrame(rows, "local string, dia date, v double, w double")
    full = grid.complete_grid(df, "local", "dia", step="day")
    out = grid.fill_short_gaps(full, "local", "dia", ["v", "w"], 1, "day").orderBy("dia").collect()
    assert [r["v"] for r in out] == [1, 2, 3, 4] and [r["w"] for r in out] == [1, None, None, 4]
    assert [r["interpolado"] for r in out] == [False, True, False, False]


def test_fills_along_time(spark):
    rng = np.random.default_rng(4)
    values = [None if rng.random() < 0.9 else float(i) for i in range(3000)]
    df = hours(spark, values)
    s = pd.Series([np.nan if v is None else v for v in values])
    for backward, want in ((False, s.ffill()), (True, s.bfill())):
        out = cleaning.fill_along(df, ["chave"], "instante", ["medida"], backward=backward).orderBy("instante").toPandas()
        np.testing.assert_allclose(out["medida"].to_numpy(dtype=float), want.to_numpy())
    out = cleaning.interpolate_along(df, ["chave"], "instante", "medida").orderBy("instante").toPandas()
    np.testing.assert_allclose(out["medida"].to_numpy(dtype=float), s.interpolate(limit_direction="both").to_numpy())


def test_quantiles_and_running_sums(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 5000), "v": np.round(rng.exponential(5, 5000), 1)})
    pdf.loc[:1700, "v"] = 3.3                       # one value holds a third of the rows
    df = spark.createDataFrame(pdf)
    got = {(r["g"], r["p"]): r["valor"] for r in ordered.quantiles(df, ["v"], [0.0, 0.1, 0.5, 0.937, 1.0], ["g"]).collect()}
    for g in ("a", "b", None):
        mine = pdf.loc[pdf["g"].isna() if g is None else pdf["g"] == g, "v"]
        for p in (0.0, 0.1, 0.5, 0.937, 1.0):
            assert got[g, p] == pytest.approx(mine.quantile(p))
    table = df.groupBy("g", "v").count()
    run = ordered.running_sums(table, ["g"], "v", {"ate": "count"}, descending=True).toPandas()
    for g in ("a", "b"):
        for _, r in run[run["g"] == g].sample(20, random_state=0).iterrows():
            assert r["ate"] == ((pdf["g"] == g) & (pdf["v"] >= r["v"])).sum()
    ranks = ordered.average_ranks(df, "v").toPandas().set_index("v")["posto"]
    want = pdf["v"].rank()
    np.testing.assert_allclose(pdf["v"].map(ranks), want)


def test_many_points_use_the_same_ranges(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as v")
    points = [float(x) for x in range(5, 995, 7)]
    a = ordered.add_bucket(df, "v", points, "b").agg(F.sum("b"), F.max("b")).first()
    b = df.withColumn("b", ordered.bucket_of("v", points)).agg(F.sum("b"), F.max("b")).first()
    assert tuple(a) == tuple(b)


def test_ordered_keys_sort_like_doubles(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.standard_normal(2000) * 10.0 ** rng.integers(-300, 300, 2000),
                             [5e-324, -5e-324, 2.2250738585072014e-308, 1e-310, 1.7976931348623157e308, -1.7976931348623157e308,
                              float("inf"), float("-inf"), 0.0, -0.0, *[2.0 ** e for e in range(-1074, 1024, 7)],
                              *[np.nextafter(2.0 ** e, 0) for e in range(-1021, 1024, 7)]]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),)], "v double")
    rows = ordered.ordered_key(df, "v", "k").collect()
    bits = np.abs(values).view(np.int64)
    for r, v, b in zip(rows, values, bits):
        assert r["k"] == (-int(b) if v < 0 else int(b))
    assert rows[-1]["k"] > max(r["k"] for r in rows[:-1])


def test_quantiles_of_close_far_and_missing_values(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"near": 1e9 + rng.random(3000) * 1e-6, "far": rng.standard_normal(3000) * 10.0 ** rng.integers(-200, 200, 3000)})
    df = spark.createDataFrame(pdf).selectExpr("*", "cast(null as double) as none", "cast(1 as double) as one")
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    for at_once in (10 ** 6, 0):                    # by value after the first scan, or 16 bits at a time to the end
        monkeypatch.setattr(ordered, "SETTLED_AT_ONCE", at_once)
        got = ordered.quantile_values(df, ["near", "far", "none", "one"], probs)
        for c in ("near", "far"):
            np.testing.assert_allclose([got[c][p] for p in probs], pdf[c].quantile(probs), rtol=1e-14)
        assert set(got["none"].values()) == {None} and set(got["one"].values()) == {1.0}
    assert ordered.quantile_values(df.filter("false"), ["near"], [0.5]) == {"near": {0.5: None}}


def test_row_numbers(spark):
    df = spark.range(5000).selectExpr("pmod(hash(id), 97) as a", "id", "map('x', id) as m")
    got = ordered.row_numbers(df, ["a", "id"], "n", start=10).toPandas().sort_values("n")
    assert got["n"].tolist() == list(range(10, 5010))
    assert got[["a", "id"]].values.tolist() == sorted(got[["a", "id"]].values.tolist())
    assert ordered.row_numbers(df.filter("false"), ["id"], "n").count() == 0


def test_numeric_operators_without_values(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", None, None)], "k string, v double, w double")
    assert profile.histogram(df, "v").count() == 0 and profile.histogram(df, "w").first()["n"] == 1
    summary = {r["coluna"]: r for r in profile.numeric_summary(df, ["v", "w"]).collect()}
    assert summary["v"]["n"] == 0 and summary["v"]["p50"] is None and summary["v"]["nulos"] == 2 and summary["w"]["p50"] == 1.0
    for method in ("iqr", "zscore", "quantil"):
        assert cleaning.treat_outliers(df, ["v", "w"], method).count() == 2
        assert [r["w"] for r in cleaning.treat_outliers(df, ["v", "w"], method, "limitar").orderBy("k").collect()] == [1.0, None]
    for method in ("standard", "minmax", "robust", "log", "log1p"):
        assert {r["v"] for r in cleaning.fit_scale(df, ["v", "w"], method).apply(df).collect()} == {None}
    for method in ("quantil", "largura"):
        edges = cleaning.bin_edges(df, "v", method)
        assert edges == [] and df.select(numeric.bin_of(F.col("v"), edges).alias("b")).first()["b"] is None
    assert profile.column_profile(df, "v")["outliers_iqr"] == 0


def test_no_frame_runs_to_the_end_of_a_series(spark):
    """Such a frame is read again for every row: its cost grows with the square of a chunk."""

    df = spark.createDataFrame([("a", i, float(i) if i % 7 == 0 else None) for i in range(40)], "k string, i int, v double")
    near = ordered.neighbours(df, ["k"], "i", ["v"], F.floor(F.col("i") / 10))
    plan = near._jdf.queryExecution().analyzed().toString()
    assert "unboundedfollowing" not in plan
    got = {r["i"]: (r["__before_v"], r["__after_v"]) for r in near.collect()}
    assert got == {i: (float(i // 7 * 7), float(-(-i // 7) * 7) if i <= 35 else None) for i in range(40)}


def test_gap_numbers_across_chunks(spark):
    """Gaps over one and several chunks, at both ends, and a time with two rows, against plain counting."""
    rows = []
    for key, known, last in (("a", {5, 700, 719, 720, 3000, 3001}, 3100), ("b", set(), 800), ("c", {0, 1439, 1440, 2159}, 2160)):
        rows += [(key, T0 + timedelta(hours=i), 1.0 if i in known else None) for i in range(last)]
    rows += [("a", T0 + timedelta(hours=700), None), ("a", T0 + timedelta(hours=720), 2.0)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")
    got = sorted((r["k"], r["t"], r["v"] or 0.0, r["sequencia"], r["tamanho_gap"]) for r in grid.gap_groups(df, "k", "t", "v").collect())
    times = {k: sorted({t for x, t, v in rows if x == k and v is not None}) for k in "abc"}
    number = [(k, t, v, sum(x <= t for x in times[k])) for k, t, v in rows]
    size = {}
    for k, t, v, s in number:
        size[k, s] = size.get((k, s), 0) + (v is None)
    assert got == sorted((k, t, v or 0.0, s, size[k, s] if v is None else 0) for k, t, v, s in number)


def test_rows_of_a_category_stay_in_their_tasks(spark, monkeypatch):
    rows = [(i, None if i % 50 == 0 else "a" if i % 3 else f"x{i}", float(i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, c string, y double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = [cleaning.frequency_encode(df, "c"), cleaning.target_encode(df, "c", "y")]
        assert all("BroadcastHashJoin" in x._jdf.queryExecution().executedPlan().toString() for x in few)
        monkeypatch.setattr(cleaning, "FEW_CATEGORIES", 5)
        many = [cleaning.frequency_encode(df, "c"), cleaning.target_encode(df, "c", "y")]
        pdf = pd.DataFrame(rows, columns=["i", "c", "y"])
        share, mean = pdf["c"].map(pdf["c"].value_counts(normalize=True)), pdf["c"].map(pdf.groupby("c")["y"].mean())
        for freq, target in (few, many):
            np.testing.assert_allclose(freq.orderBy("i").toPandas()["c"], share)
            np.testing.assert_allclose(target.orderBy("i").toPandas()["c"].astype(float), mean)
            assert freq.columns == target.columns == df.columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
