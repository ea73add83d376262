from brisa.operators.forecast import with_partners


def test_partners_are_a_ring(spark):
    df = spark.createDataFrame([(i, float(i % 6)) for i in range(700)], "k long, a double").repartition(5)
    rows = with_partners(df, ["k", "a"], ["k"], seed=3).collect()
    follows = {r["k"]: r["__partner"]["k"] for r in rows}
    assert len(rows) == 700 and sorted(follows.values()) == list(range(700))
    at, seen = 0, set()
    while at not in seen:
        seen.add(at)
        at = follows[at]
    assert len(seen) == 700
