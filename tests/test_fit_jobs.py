import threading
from datetime import datetime, timedelta

from pyspark.ml.regression import LinearRegression

from brisa.operators import forecast as FC, ml


def hours(spark, n=600):
    start = datetime(2024, 1, 1)
    rows = [(s, "f", start + timedelta(hours=h), float((h % 24) * (i + 1) + h % 7)) for i, s in enumerate("ab") for h in range(n)]
    return spark.createDataFrame(rows, "serie string, fonte string, data_hora timestamp_ntz, energia_mwh double")


def test_backtest_fits_windows_side_by_side(spark, monkeypatch):
    seen, fit = [], FC.Boosting.fit
    monkeypatch.setattr(FC.Boosting, "fit", lambda self, f: (seen.append(threading.get_ident()), fit(self, f))[1])
    model = FC.Boosting(trees=2, depth=2)
    panel, times = FC.backtest(hours(spark), 2, 24, 480, model)
    assert len(seen) == 2 and threading.get_ident() not in seen
    assert all(r["falha"] is None for r in times.collect()) and times.count() == 4
    got = panel.filter("modelo = 'gradient_boosting'").groupBy("serie", "janela").count().collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(s, w, 24) for s in "ab" for w in (1, 2)]
    assert model.model is not None


def test_importance_deals_out_all_features_in_one_pass(spark, monkeypatch):
    model = FC.Boosting(trees=2, depth=2)
    features = model.features(hours(spark)).cache()
    model.fit(features)
    calls, predict = [], FC.Boosting.predict
    monkeypatch.setattr(FC.Boosting, "predict", lambda self, f: (calls.append(1), predict(self, f))[1])
    got = {r["feature"]: r["importancia"] for r in model.importance(features, repeats=2).collect()}
    assert len(calls) == 3 and set(got) == set(model.columns) and max(got.values()) > 0


def test_comparison_does_not_score_training_rows(spark, monkeypatch):
    df = ml.vectorise(spark.createDataFrame([(i, float(i % 9), 2.0 * (i % 9) + i % 2) for i in range(90)], "k int, x double, label double"), ["x"])
    sizes, score = [], ml.score
    monkeypatch.setattr(ml, "score", lambda p, kind: (sizes.append(p.count()), score(p, kind))[1])
    got = ml.compare_models(df, ["k"], "regressao", {"reta": LinearRegression(), "base": ml._Constant("regressao")}, k=3)
    assert sorted(sizes[:3]) == sorted(sizes[3:]) and sum(sizes) == 180
    assert [r["modelo"] for r in got.collect()] == ["reta", "base"]


def test_equal_rows_are_clustered_once(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    points = [(0.0, 0.0)] * 40 + [(0.0, 1.0)] * 25 + [(9.0, 0.0)] * 30 + [(9.0, 2.0)] * 5 + [(50.0, 50.0)]
    df = spark.createDataFrame(points, "x double, y double")
    sizes, centres, fit = [], {}, KMeans.fit

    def watched(self, data):
        model = fit(self, data)
        sizes.append(data.count())
        centres[self.getK()] = [tuple(c) for c in model.clusterCenters()]
        return model
    monkeypatch.setattr(KMeans, "fit", watched)
    got = {r["k"]: r for r in ml.cluster_report(df, ["x", "y"], 2, 3, scale=False).collect()}
    assert sizes == [5, 5]

    def far(p, q):
        return (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
    for k in (2, 3):
        near = [min(range(k), key=lambda c: far(p, centres[k][c])) for p in points]
        total = 0.0
        for i, p in enumerate(points):
            mean = {c: [far(p, q) for j, q in enumerate(points) if near[j] == c and j != i] for c in set(near)}
            own = mean.pop(near[i])
            if own:
                a, b = sum(own) / len(own), min(sum(d) / len(d) for d in mean.values())
                total += (b - a) / max(a, b)
        assert abs(got[k]["inercia"] - sum(far(p, centres[k][c]) for p, c in zip(points, near))) < 1e-6
        assert abs(got[k]["silhouette"] - total / len(points)) < 1e-9


def test_learning_curve_counts_rows_while_scoring(spark, monkeypatch):
    df = ml.vectorise(spark.createDataFrame([(i, float(i % 9), 2.0 * (i % 9) + i % 2) for i in range(300)], "k int, x double, label double"), ["x"])
    calls, report = [], ml.regression_report
    monkeypatch.setattr(ml, "regression_report", lambda p: (calls.append(1), report(p))[1])
    frame = type(df)
    count = frame.count
    monkeypatch.setattr(frame, "count", lambda self: (calls.append("count"), count(self))[1])
    rows = ml.learning_curve(df, ["k"], LinearRegression(), "regressao", points=2, k=3).collect()
    assert "count" not in calls and len(calls) == 12 and rows[-1]["n_amostras"] == 200
