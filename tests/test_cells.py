import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor

from brisa.operators import cells, ml

X = ["a", "b", "c"]


def table(spark, n=4000):
    rows = [(i, float(i * 7 % 6), float(i * 13 % 5), float(i * 11 % 4), 10.0 * (i * 7 % 6) + 3.0 * (i * 13 % 5) + (i * 37 % 101) / 50) for i in range(n)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, label double")


def test_forest_learns_from_equal_rows_once_and_like_the_rows(spark, monkeypatch):
    df, sizes, fit = table(spark), [], RandomForestRegressor.fit
    plain = fit(RandomForestRegressor(numTrees=30, maxDepth=5, seed=1), cells.vectorise(cells.flat_rows(df, X), X))
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, d: (sizes.append(d.count()), fit(self, d))[1])
    got = cells.fit_forest(df, X, "regressao", trees=30, seed=1)
    assert len(sizes) == 30 and max(sizes) <= 120
    assert np.allclose(got.featureImportances.toArray(), plain.featureImportances.toArray(), atol=0.06)
    said = [m.transform(cells.vectorise(df, X)).agg({"prediction": "avg"}).first()[0] for m in (got, plain)]
    assert abs(said[0] - said[1]) < 0.3


def test_every_row_is_drawn_for_itself(spark):
    flat = cells.flat_rows(table(spark), X)
    drawn = cells.bagged(flat, cells.cells_of(flat, X, "regressao"), X, "regressao", 40, 5)
    copies = np.array([r[1] for r in drawn.groupBy("arvore").agg({"peso": "sum"}).collect()])
    assert len(copies) == 40 and abs(copies.mean() - 4000) < 50
    # rows drawn one by one: the total of a tree varies like a Poisson number, not like 33 copies of a cell
    assert 35 < copies.std() < 100


def test_few_equal_rows_go_to_the_forest_as_they_are(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), i * 2.0) for i in range(60)], "a double, b double, label double")
    assert cells.cells_of(cells.flat_rows(df, ["a", "b"]), ["a", "b"], "regressao") is None
    model = cells.fit_forest(df, ["a", "b"], "regressao", trees=3)
    assert model.getNumTrees == 3 and ml.importances(model, ["a", "b"])[0][0] == "a"


def test_classes_and_selection(spark):
    df = table(spark).withColumn("label", (ml.F.col("a") > 2).cast("double"))
    model = cells.fit_forest(df, X, "classificacao", trees=5)
    assert isinstance(model, cells.Forest) and ml.score(model.transform(cells.vectorise(df, X)), "classificacao") > 0.99
    loss = {r[0]: r[1] for r in ml.permutation_importances(model, df, X, ["k"], "classificacao", 1).collect()}
    assert loss["a"] > 0.3 and abs(loss["c"]) < 0.01
    for method in ("kbest", "rfe", "modelo"):
        assert ml.select_features(table(spark), X, "label", method, 2) in (["a", "b"], ["b", "a"])


def test_equal_mixed_rows_are_predicted_once(spark):
    df, seen = table(spark), []
    model = cells.fit_forest(df, X, "regressao", trees=5)
    transform = model.transform
    model.transform = lambda d: (seen.append(d.count()), transform(d))[1]
    loss = {r[0]: r[1] for r in ml.permutation_importances(model, df, X, ["k"], "regressao", 2).collect()}
    assert len(seen) == 3 and seen[0] <= 120 and max(seen) <= 360
    rmse = -ml.score(transform(cells.vectorise(df, X)), "regressao")
    assert abs(ml._mixed_scores(model, df.selectExpr("-1 AS __which", *X, "label"), X, "regressao")[-1] + rmse) < 1e-9
    assert loss["a"] > loss["b"] > abs(loss["c"])


def compared(spark, df, kind, models, monkeypatch, seen=None):
    """Scores by model, and those of the same models that see every row."""
    def told(models):
        return {r["modelo"]: (r["score_medio"], r["score_std"], r["falha"]) for r in ml.compare_models(df, ["k"], kind, models, k=3).collect()}
    for made in {type(m) for m in models.values() if hasattr(m, "copy")} if seen is not None else ():
        def watched(self, d, fit=made.fit, made=made):
            seen.setdefault(made.__name__, []).append(d.count())
            return fit(self, d)
        monkeypatch.setattr(made, "fit", watched)
    got = told(models)
    monkeypatch.undo()
    monkeypatch.setattr(cells, "fold_cells", lambda *a: None)
    return got, told(models)


def test_numbers_are_compared_on_cells_and_score_like_the_rows(spark, monkeypatch):
    df, seen = cells.vectorise(table(spark), X), {}
    models = {"base": ml._Constant("regressao"), "reta": LinearRegression(), "ridge": LinearRegression(regParam=5.0, elasticNetParam=0.0),
              "lasso": LinearRegression(regParam=5.0, elasticNetParam=1.0), "arvore": DecisionTreeRegressor(seed=1),
              "boosting": GBTRegressor(maxIter=3, seed=1), "floresta": RandomForestRegressor(numTrees=8, featureSubsetStrategy="all", seed=1)}
    got, rows = compared(spark, df, "regressao", models, monkeypatch, seen)
    assert set(seen) == {"LinearRegression", "DecisionTreeRegressor", "GBTRegressor", "RandomForestRegressor"}
    assert max(max(s) for s in seen.values()) <= 2 * 3 * 120 and len(seen["RandomForestRegressor"]) == 3 * 8
    for name in ("base", "reta", "ridge", "lasso", "arvore", "boosting"):
        assert np.allclose(got[name][:2], rows[name][:2], rtol=1e-6, atol=1e-6), name
    assert abs(got["floresta"][0] - rows["floresta"][0]) < 0.2 and all(v[2] is None for v in (*got.values(), *rows.values()))


def test_classes_are_compared_on_cells_and_score_like_the_rows(spark, monkeypatch):
    df = table(spark).withColumn("label", (ml.F.col("label") + 17 * (ml.F.col("k") % 5 == 0).cast("int") > 35).cast("int"))
    df, seen = cells.vectorise(df, X), {}
    models = {"base": ml._Constant("classificacao"), "logistica": LogisticRegression(maxIter=50), "arvore": DecisionTreeClassifier(seed=1),
              "floresta": RandomForestClassifier(numTrees=8, featureSubsetStrategy="all", seed=1)}
    got, rows = compared(spark, df, "classificacao", models, monkeypatch, seen)
    assert max(max(s) for s in seen.values()) <= 2 * 3 * 120 and len(seen["RandomForestClassifier"]) == 3 * 8
    for name in ("base", "logistica", "arvore"):
        assert np.allclose(got[name][:2], rows[name][:2], atol=1e-6), name
    assert abs(got["floresta"][0] - rows["floresta"][0]) < 0.03


def test_models_that_count_rows_see_rows(spark, monkeypatch):
    df, seen = cells.vectorise(table(spark), X), {}
    models = {"dez": DecisionTreeRegressor(minInstancesPerNode=10, seed=1), "huber": LinearRegression(loss="huber", maxIter=5)}
    got, rows = compared(spark, df, "regressao", models, monkeypatch, seen)
    assert min(min(s) for s in seen.values()) > 2000
    assert all(np.allclose(got[m][:2], rows[m][:2]) for m in models)


def test_a_label_that_is_missing_is_still_a_failure(spark, monkeypatch):
    df = cells.vectorise(table(spark).withColumn("label", ml.F.when(ml.F.col("k") != 7, ml.F.col("label"))), X)
    got, rows = compared(spark, df, "regressao", {"reta": LinearRegression(), "base": ml._Constant("regressao")}, monkeypatch)
    assert got["reta"][2] and rows["reta"][2] and got["base"] == rows["base"]


def test_rows_of_a_fold_draw_for_themselves(spark):
    df = ml.with_folds(cells.vectorise(table(spark), X), ["k"], 3)
    for kind, label in (("regressao", "label"), ("classificacao", "a")):
        equal = cells.fold_cells(df.withColumn("label", ml.F.col(label)), kind, 3)
        group = [*equal.columns, *(["label"] if kind == "classificacao" else [])]
        numbered = cells.table_in_shared_folder(cells.ordered.row_numbers(equal.flat.select(*group).distinct(), group, "cela", start=0), "celulas")
        drawn = equal._drawn(numbered, 120, 40, 5).groupBy("arvore").agg({"peso": "sum", "soma": "sum"}).collect()
        copies = np.array([r["sum(peso)"] for r in drawn])
        assert len(copies) == 40 and abs(copies.mean() - 4000) < 50 and 35 < copies.std() < 100
        mean = df.agg({label: "avg"}).first()[0]
        assert abs(np.mean([r["sum(soma)"] / r["sum(peso)"] for r in drawn]) / mean - 1) < 0.02
        equal.unpersist()
