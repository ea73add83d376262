import numpy as np

from brisa.operators import cox


def rows(spark, n=1500):
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        start, x, z = 0.0, float(rng.normal()), float(i % 3 == 0)
        for k in range(1 + i % 3):
            # whole tenths for a part of the rows, so that times tie inside and across strata
            stop = start + float(np.round(rng.exponential(np.exp(-0.4 * x + 0.3 * z)), 1 if i % 2 else 6)) + 0.1
            out.append((i, f"s{i % 2}|{k}", start, stop, int(rng.random() < 0.7), x, z))
            start = stop
    return spark.createDataFrame(out, "id long, estrato string, a double, t double, e int, x double, z double").cache()


def both(df, monkeypatch, **options):
    steps, laid = [], cox.fit(df, "t", "e", ["x", "z"], **options)
    monkeypatch.setattr(cox._Laid, "of", classmethod(lambda cls, data: None))
    per_time = cox._Data.per_time
    monkeypatch.setattr(cox._Data, "per_time", lambda self, *a, **k: (steps.append(1), per_time(self, *a, **k))[1])
    plain = cox.fit(df, "t", "e", ["x", "z"], **options)
    assert steps
    return laid, plain


def same(a, b):
    assert np.allclose(a.coef, b.coef, atol=1e-9) and abs(a.log_likelihood - b.log_likelihood) < 1e-7
    assert np.allclose(a.naive_variance, b.naive_variance, rtol=1e-8) and np.allclose(a.variance, b.variance, rtol=1e-8)


def test_laid_rows_fit_as_sums_per_time_do(spark, monkeypatch):
    df = rows(spark)
    same(*both(df, monkeypatch, strata=["estrato"], entry="a", cluster="id", with_baseline=False))


def test_laid_rows_without_entry_and_strata(spark, monkeypatch):
    same(*both(rows(spark, 500), monkeypatch, cluster="id", with_baseline=False))


def test_steps_and_errors_shuffle_no_rows(spark, monkeypatch):
    def never(*a, **k):
        raise AssertionError("a step went back to sums per time")
    monkeypatch.setattr(cox._Data, "per_time", never)
    model = cox.fit(rows(spark, 300), "t", "e", ["x", "z"], strata=["estrato"], entry="a", cluster="id", with_baseline=False)
    assert np.isfinite(model.errors).all()


def test_one_time_for_most_rows_is_left_to_sums_per_time(spark, monkeypatch):
    monkeypatch.setattr(cox._Laid, "FEW_ROWS", 100)
    df = spark.createDataFrame([(1.0 + (i / 3000 if i < 300 else 0.5), int(i % 2), float(i % 5)) for i in range(4000)], "t double, e int, x double")
    assert cox._Laid.of(cox._Data(cox._staged(df, "t", "e", ["x"]), 1, ())) is None
