import pytest
from pyspark.sql import functions as F

from brisa.functions.numeric import hash_unit
from brisa.operators import stats


def test_draws_are_hashed_once_on_all_cores(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(40)], "k int, x double").coalesce(1)
    got = stats._draws(df, "x", ["k"], 6, 42)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    want = df.filter("x IS NOT NULL").select(F.col("x").alias("v"), "k", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("replica")).select(
        "v", "replica", hash_unit(F.col("k"), F.col("replica"), seed=42).alias("u"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    copies = got.withColumn("w", stats.poisson_copies(F.col("u")))
    assert copies._jdf.queryExecution().optimizedPlan().toString().count("md5") == 1


def test_median_of_resamples(spark):
    df = spark.createDataFrame([(i, float(i * i % 17)) for i in range(30)], "k int, x double")
    got = {r["replica"]: r["valor"] for r in stats.bootstrap_median(df, "x", ["k"], 4).collect()}
    drawn = stats._draws(df, "x", ["k"], 4, 42).withColumn("w", stats.poisson_copies(F.col("u"))).collect()
    for replica, value in got.items():
        values = sorted(r["v"] for r in drawn if r["replica"] == replica for _ in range(r["w"]))
        n = len(values)
        assert value == pytest.approx((values[(n - 1) // 2] + values[n // 2]) / 2)
