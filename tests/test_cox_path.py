import numpy as np
import pytest
from pyspark.sql import functions as F

from brisa.operators import cox
from brisa.operators.survival import concordance
from brisa.plans import queries_survival

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 2)) * [1, 5]
    t = np.ceil(rng.exponential(20 * np.exp(-0.8 * x[:, 0] - 0.05 * x[:, 1])))
    rows = [(i, float(a), float(b), float(d), int(rng.random() < 0.7), "uv"[i % 2]) for i, ((a, b), d) in enumerate(zip(x, t))]
    return spark.createDataFrame(rows, "id int, a double, b double, t double, e int, g string")


def test_path_equals_single_fits(cohort):
    penalties = [0.0, 0.05, 0.6]
    got = {(r["penalizador"], r["dobra"]): r for r in cox.cross_validated_path(
        cohort, "t", "e", ["a", "b"], ["id"], penalties=penalties, l1_ratio=1.0, k=3, strata=["g"]).collect()}
    parts = cox.folds_by_hash(cohort, ["id"], 3)
    assert len(got) == 9 and all(r["convergiu"] for r in got.values())
    for value, fold in [(0.0, 0), (0.05, 1), (0.6, 2)]:
        model = cox.fit(parts.filter(F.col("dobra") != fold), "t", "e", ["a", "b"], strata=["g"], penalty=value, l1_ratio=1.0, with_baseline=False)
        test = parts.filter(F.col("dobra") == fold).withColumn("s", model.score())
        assert got[value, fold]["c_index"] == pytest.approx(concordance(test, "t", "e", "s").first()["c_index"], abs=1e-9)


def test_concordance_by_group(cohort):
    got = {r["g"]: r["c_index"] for r in concordance(cohort, "t", "e", "a", by=["g"]).collect()}
    for g in "uv":
        assert got[g] == pytest.approx(concordance(cohort.filter(F.col("g") == g), "t", "e", "a").first()["c_index"], abs=1e-12)


def test_registered_query_ends(spark):
    rows = queries_survival.cox_penalised(spark, SF).collect()
    assert len(rows) == 9 and all(0 < r["cindex_cv"] < 1 and r["convergiu"] for r in rows)


def counted(df):
    """`df` behind a step that counts the rows it is asked for."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def same(frames):
        for x in frames:
            seen.add(len(x))
            yield x
    return df.mapInPandas(same, df.schema), seen


@pytest.mark.parametrize("work", [
    lambda df: cox.fit(df, "t", "e", ["a", "b"], strata=["g"], with_baseline=False),
    lambda df: cox.fit_penalised(df, "t", "e", ["a", "b"], ["id"], penalties=[0.0, 0.6], k=3)["trajetoria"].collect(),
    lambda df: cox.proportionality_test(df, "t", "e", ["a", "b"], strata=["g"]).collect(),
    lambda df: cox.effect_over_time(df, "t", "e", ["a", "b"], "a", strata=["g"])[0].collect(),
    lambda df: cox.survivor_bias(df, "t", "e", ["a", "b"], "g", F.col("t"), key=["id"], old=10.0, fractions=(0.5,), at=5.0).collect()])
def test_input_is_read_once(cohort, work):
    df, seen = counted(cohort)
    work(df)
    assert seen.value == 160


def test_bias_bound_equals_single_fits(cohort):
    got = cox.survivor_bias(cohort, "t", "e", ["a", "b"], "g", F.col("t"), key=["id"], old=10.0, fractions=(0.5,), at=5.0).collect()
    assert [(r["fracao_perdida"], r["estrato"]) for r in got] == [(0.0, "u"), (0.0, "v"), (0.5, "u"), (0.5, "v")]
    model = cox.fit(cohort, "t", "e", ["a", "b"], strata=["g"], with_baseline=False)
    assert all(r["beta"] == pytest.approx(model.coef[0], abs=1e-7) for r in got[:2])
    assert got[0]["n_total"] == 160 and got[2]["n_total"] == 160 + got[2]["adicionadas"] and got[2]["adicionadas"] > 0


def test_small_curve_equals_the_scan(spark, monkeypatch):
    from brisa.operators import joins
    curve = spark.createDataFrame([(g, float(t), float(t * t)) for g in (None, "u") for t in range(1, 9)], "g string, t double, v double")
    asks = spark.createDataFrame([(g, x) for g in (None, "u", "w") for x in (None, 0.5, 1.0, 2.25, 8.0, 9.0, float("nan"))], "g string, x double")

    def both():
        return [sorted((tuple(map(str, r)) for r in f.collect())) for f in (
            joins.curve_lookup(asks, curve, "x", "t", "v", ["g"]), joins.step_lookup(asks, curve, "x", "t", "v", ["g"], before=-1.0))]
    small = both()
    monkeypatch.setattr(joins, "SMALL_CURVE", 3)
    assert small == both()


def test_small_curve_moves_no_rows(spark):
    from brisa.operators import joins
    curve = spark.createDataFrame([(float(t), float(t * t)) for t in range(1, 9)], "t double, v double")
    out = joins.curve_lookup(spark.range(10).select(F.col("id").cast("double").alias("x")), curve, "x", "t", "v")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
