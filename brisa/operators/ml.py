"""Table learning on MLlib: split, prepare, compare, tune, explain, cluster, reduce."""

from __future__ import annotations

import time as clock
from collections.abc import Mapping, Sequence
from copy import copy
from itertools import product

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (PCA, Imputer, MinMaxScaler, OneHotEncoder, RobustScaler, StandardScaler, StringIndexer,
                                UnivariateFeatureSelector, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from brisa.functions.numeric import hash_unit
from brisa.operators import cells, ordered
from brisa.operators.cleaning import categories, fit_scale, modes, numeric_columns
from brisa.operators.forecast import with_partners
from brisa.session import cut, side_by_side, table_in_shared_folder


# ----------------------------------------------------------------------- split
def split(df: DataFrame, target: str, key: Sequence[str], test_share: float = 0.2, exclude: Sequence[str] = (),
          stratify: bool | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the hash of a key, the share held within each class when the
    target has few classes. The draw that closes the share is an exact quantile."""
    kind = dict(df.dtypes)[target]
    if stratify is None:
        stratify = kind not in ("float", "double") and categories(df, target, 20) is not None
    draw = df.drop(*exclude).withColumn("__u", hash_unit(*[F.col(k) for k in key], seed=seed))
    by = [target] if stratify else []
    limit = ordered.quantiles_wide(draw, "__u", {"__lim": test_share}, by)
    marked = ordered.null_safe(draw, limit, by, "inner")
    mark = F.col("__u") < F.col("__lim")
    return (marked.filter(~mark).drop("__u", "__lim"), marked.filter(mark).drop("__u", "__lim"))


def preprocessing(df: DataFrame, numbers: Sequence[str] | None = None, texts: Sequence[str] | None = None, *,
                  imputation: str = "median", scale: str | None = "standard", max_categories: int = 20,
                  output: str = "features") -> Pipeline:
    """Impute, scale and one-hot as one MLlib pipeline, fitted on training rows only.
    Text columns with more categories are left out."""
    numbers = list(numbers if numbers is not None else numeric_columns(df))
    texts = [c for c in (texts if texts is not None else [n for n, t in df.dtypes if t == "string"])
             if categories(df, c, max_categories) is not None]
    stages, parts = [], []
    if numbers:
        filled = [f"{c}__i" for c in numbers]
        stages += [Imputer(inputCols=numbers, outputCols=filled, strategy=imputation),
                   VectorAssembler(inputCols=filled, outputCol="__num")]
        last = "__num"
        if scale:
            scaler = {"standard": StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True, withStd=True),
                      "minmax": MinMaxScaler(inputCol="__num", outputCol="__scaled"),
                      "robust": RobustScaler(inputCol="__num", outputCol="__scaled", withCentering=True)}[scale]
            stages.append(scaler)
            last = "__scaled"
        parts.append(last)
    if texts:
        index, hot = [f"{c}__x" for c in texts], [f"{c}__h" for c in texts]
        stages += [StringIndexer(inputCols=texts, outputCols=index, handleInvalid="keep"),
                   OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)]
        parts += hot
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol=output)])


def fill_text_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value in place of null text, before the pipeline."""
    return df.fillna({c: v for c, v in modes(df, columns).items() if v is not None})


def vectorise(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    rows = df.dropna(subset=list(columns))
    cast = rows.withColumns({f"__{c}": F.col(c).cast("double") for c in columns})
    return VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol=output).transform(cast).drop(
        *[f"__{c}" for c in columns])


# --------------------------------------------------------------------- reports
def confusion(predictions: DataFrame, label: str = "label", predicted: str = "prediction", rows: str | None = None) -> DataFrame:
    """Rows per pair of classes; `rows` says how many a row stands for."""
    return predictions.groupBy(F.col(label).cast("double").alias("real"), F.col(predicted).cast("double").alias("previsto")).agg(
        (F.sum(F.col(rows).cast("long")) if rows else F.count(F.lit(1))).alias("n"))


def classification_report(predictions: DataFrame, label: str = "label", predicted: str = "prediction", rows: str | None = None) -> DataFrame:
    """One row: accuracy and class-weighted precision, recall and F1 from the confusion table."""
    pairs = cut(confusion(predictions, label, predicted, rows))     # a row per pair of classes; predictions are made once
    real = pairs.groupBy(F.col("real").alias("c")).agg(
        F.sum("n").alias("suporte"), F.sum(F.when(F.col("real") == F.col("previsto"), F.col("n")).otherwise(0)).alias("certos"))
    said = pairs.groupBy(F.col("previsto").alias("c")).agg(F.sum("n").alias("ditos"))
    per = real.join(said, "c", "left").withColumns({
        "precisao": F.coalesce(F.try_divide("certos", "ditos"), F.lit(0.0)), "recall": F.col("certos") / F.col("suporte")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precisao") * F.col("recall"), F.col("precisao") + F.col("recall")), F.lit(0.0))
    w = lambda c: F.sum(c * F.col("suporte")) / F.sum("suporte")
    return per.agg((F.sum("certos") / F.sum("suporte")).alias("accuracy"), w(F.col("precisao")).alias("precision_w"),
                   w(F.col("recall")).alias("recall_w"), w(f1).alias("f1_w"), F.sum("suporte").alias("n"))


def roc_auc(predictions: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve from the ranks of the score."""
    cells = predictions.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    run = ordered.running_sums(cells, [], "s", {"ate": "n"})
    rank = F.col("ate") - F.col("n") + (F.col("n") + 1) / 2
    sums = run.agg(F.sum(F.col("p") * rank).alias("r"), F.sum("p").alias("a"), F.sum("n").alias("t"))
    a, b = F.col("a").cast("double"), (F.col("t") - F.col("a")).cast("double")
    return sums.select(F.try_divide(F.col("r") - a * (a + 1) / 2, a * b).alias("roc_auc"))


def regression_report(predictions: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row: RMSE, MAE, R2 and MAPE over rows that are not zero."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(predicted).cast("double")
    return predictions.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        (100 * F.avg(F.when(F.abs(y) > 1e-9, F.abs(e / y)))).alias("mape_pct"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ comparison
class _Constant:
    """Floor for a comparison: the same answer for every row."""

    def __init__(self, kind: str):
        self.kind = kind

    def fit(self, df: DataFrame, rows: str | None = None):
        if self.kind == "classificacao":
            count = (F.sum(rows) if rows else F.count(F.lit(1))).alias("count")
            top = df.groupBy("label").agg(count).orderBy(F.desc("count"), "label").limit(1).collect()
            self.value = float(top[0]["label"])
        else:
            self.value = ordered.quantile_values(df, ["label"], [0.5])["label"][0.5]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.value))


def default_models(kind: str, seed: int = 42, trees: int = 50) -> dict:
    if kind == "classificacao":
        return {"Dummy (baseline)": _Constant(kind), "Regressão Logística": LogisticRegression(maxIter=100),
                "Árvore de Decisão": DecisionTreeClassifier(seed=seed),
                "Random Forest": RandomForestClassifier(numTrees=trees, seed=seed),
                "Gradient Boosting": GBTClassifier(maxIter=20, seed=seed)}
    return {"Dummy (baseline)": _Constant(kind), "Regressão Linear": LinearRegression(),
            "Ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0),
            "Lasso": LinearRegression(regParam=1.0, elasticNetParam=1.0),
            "Random Forest": RandomForestRegressor(numTrees=trees, seed=seed),
            "Gradient Boosting": GBTRegressor(maxIter=20, seed=seed)}


def score_and_rows(predictions: DataFrame, kind: str, rows: str | None = None) -> tuple[float, int]:
    """Weighted F1 for classes, minus RMSE for numbers, larger is better; and the rows it is taken over.
    `rows` says how many a row stands for."""
    if rows and kind == "classificacao":
        row = classification_report(predictions, rows=rows).first()
        return float(row["f1_w"]), row["n"]
    if rows:
        miss = F.pow(F.col("label") - F.col("prediction"), 2)
        row = predictions.agg((F.sum(F.col(rows) * miss) / F.sum(rows)).alias("mse"), F.sum(rows).alias("n")).first()
        return -float(np.sqrt(row["mse"])), round(row["n"])
    if kind == "classificacao":
        row = classification_report(predictions).first()
        return float(row["f1_w"]), row["n"]
    row = regression_report(predictions).first()
    return -float(row["rmse"]), row["n"]


def score(predictions: DataFrame, kind: str, rows: str | None = None) -> float:
    return score_and_rows(predictions, kind, rows)[0]


def own_copy(model):
    """Copy for one fit. A plain copy of an MLlib estimator shares its object in the JVM, which is given
    up with the first copy that goes out of use."""
    return model.copy() if hasattr(model, "copy") else copy(model)


def cross_validate(df: DataFrame, model, kind: str, k: int = 5, fold: str = "dobra",
                   with_train: bool = True) -> tuple[list[float], list[float], float]:
    """(test scores, training scores, mean seconds per fit) over a fold column. Folds are fitted side by
    side, which the seconds include; without `with_train` the training rows are not scored."""
    def one(i):
        train, test = df.filter(F.col(fold) != i), df.filter(F.col(fold) == i)
        start, own = clock.perf_counter(), own_copy(model)
        fitted = own.fit(train)
        seconds = clock.perf_counter() - start
        return score(fitted.transform(test), kind), score(fitted.transform(train), kind) if with_train else None, seconds
    got = side_by_side(df.sparkSession, one, range(k))
    return [t for t, _, _ in got], [t for _, t, _ in got if t is not None], sum(x for _, _, x in got) / k


def _validate_cells(equal: cells.FoldCells, model, kind: str, k: int) -> tuple[list[float], float] | None:
    """(test scores, mean seconds per fit) of a model that learns from distinct rows with their number as
    weight; None if it has to see the rows themselves."""
    start = clock.perf_counter()
    if isinstance(model, _Constant) and kind == "regressao":
        fitted = [own_copy(model) for _ in range(k)]
        for one, median in zip(fitted, equal.medians()):
            one.value = median
    elif isinstance(model, cells.FORESTS) and model.getOrDefault("bootstrap"):
        fitted = equal.forests(model)
        if fitted is None:
            return None
    else:
        def fit(i):
            begun = clock.perf_counter()
            if isinstance(model, _Constant):
                return own_copy(model).fit(equal.split(i)[0], "n"), clock.perf_counter() - begun
            return model.copy({model.getParam("weightCol"): "n"}).fit(equal.split(i)[0]), clock.perf_counter() - begun
        both = side_by_side(equal.cells.sparkSession, fit, range(k), k)
        fitted, start = [f for f, _ in both], clock.perf_counter() - sum(s for _, s in both)
    seconds = (clock.perf_counter() - start) / k
    return side_by_side(equal.cells.sparkSession, lambda i: score(fitted[i].transform(equal.split(i)[1]), kind, "n"), range(k), k), seconds


def with_folds(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("dobra", F.floor(hash_unit(*[F.col(c) for c in key], seed=seed) * k).cast("int"))


def compare_models(df: DataFrame, key: Sequence[str], kind: str, models: Mapping | None = None, k: int = 5,
                   seed: int = 42) -> DataFrame:
    """(modelo, score_medio, score_std, tempo_fit_s, falha) on the same folds, best first.
    `df` has `features` and `label`. Where enough rows are equal, models learn from distinct rows with
    their number as weight, forests from what every row draws for itself; others see the rows."""
    data = with_folds(df, key, k, seed)
    equal = cells.fold_cells(data, kind, k)
    rows = []
    for name, model in (models or default_models(kind, seed)).items():
        try:
            got = None
            if equal is not None and (isinstance(model, _Constant) or cells.learns_from_cells(model, kind)):
                got = _validate_cells(equal, model, kind, k)
            if got is None:
                tests, _, seconds = cross_validate(data.cache(), model, kind, k, with_train=False)
            else:
                tests, seconds = got
        except Exception as error:          # one model must not end the comparison: its row says why
            rows.append((name, None, None, None, f"{type(error).__name__}: {error}"[:500]))
            continue
        rows.append((name, float(np.mean(tests)), float(np.std(tests)), float(seconds), None))
    data.unpersist()
    if equal is not None:
        equal.unpersist()
    rows.sort(key=lambda r: (r[1] is None, -(r[1] or 0.0)))
    return df.sparkSession.createDataFrame(rows, "modelo string, score_medio double, score_std double, tempo_fit_s double, falha string")


def search(df: DataFrame, key: Sequence[str], model, grid: Mapping[str, Sequence], kind: str, method: str = "grid",
           n_iter: int = 10, k: int = 3, seed: int = 42) -> dict:
    """Best parameters over a grid, or over a random part of it."""
    names = list(grid)
    choices = [dict(zip(names, v)) for v in product(*grid.values())]
    if method != "grid" and len(choices) > n_iter:
        order = np.random.default_rng(seed).permutation(len(choices))[:n_iter]
        choices = [choices[i] for i in order]
    data = with_folds(df, key, k, seed).cache()
    rows = []
    for params in choices:
        tests, _, _ = cross_validate(data, model.copy({model.getParam(n): v for n, v in params.items()}), kind, k, with_train=False)
        rows.append((params, float(np.mean(tests))))
    data.unpersist()
    best, value = max(rows, key=lambda r: r[1])
    fitted = model.copy({model.getParam(n): v for n, v in best.items()}).fit(df)
    return {"melhores_parametros": best, "melhor_score": value, "modelo": fitted, "tentativas": rows}


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Native importances or absolute coefficients, largest first."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        values = np.abs(model.coefficients.toArray())
    else:
        raise ValueError("the model has no importances of its own; use permutation")
    return sorted(zip(names, map(float, values)), key=lambda r: -r[1])


def permutation_importances(model, df: DataFrame, columns: Sequence[str], key: Sequence[str], kind: str,
                            repeats: int = 3) -> DataFrame:
    """Loss of score when one column is dealt out again to other rows. One pass deals out every column;
    rows that have become equal are scored once."""
    columns = list(columns)
    rows = df.dropna(subset=columns)
    flat = rows.select(*dict.fromkeys(key), *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(columns)],
                       F.col("label").cast("double").alias("__y"))
    flat = table_in_shared_folder(flat, "linhas")
    named, features = [f"__{i}" for i in range(len(columns))], [f"__v{i}" for i in range(len(columns))]
    base = _mixed_scores(model, flat.select(F.lit(-1).alias("__which"), *[F.col(c).alias(v) for c, v in zip(named, features)],
                                            F.col("__y").alias("label")), columns, kind)[-1]
    loss = dict.fromkeys(columns, 0.0)
    for r in range(repeats):
        paired = with_partners(flat, named, key, seed=r).withColumn("__which", F.explode(F.array(*[F.lit(i) for i in range(len(columns))])))
        mixed = paired.select("__which", F.col("__y").alias("label"), *[
            F.when(F.col("__which") == i, F.col(f"__partner.`{c}`")).otherwise(F.col(c)).alias(v)
            for i, (c, v) in enumerate(zip(named, features))])
        for i, value in _mixed_scores(model, mixed, columns, kind).items():
            loss[columns[i]] += (base - value) / repeats
    rows = sorted(((c, float(v)) for c, v in loss.items()), key=lambda r: -r[1])
    return df.sparkSession.createDataFrame(rows, "feature string, importancia double")


def _mixed_scores(model, mixed: DataFrame, columns: Sequence[str], kind: str) -> dict[int, float]:
    """Score per `__which`. Equal rows are predicted together: squared errors are those of their mean
    label and what the labels differ from it, classes count their rows."""
    places = [c for c in mixed.columns if c != "label"]
    if kind == "classificacao":
        cell = cut(mixed.groupBy(*places, "label").agg(F.count(F.lit(1)).alias("__n")))
    else:
        cell = mixed.groupBy(*places).agg(F.count(F.lit(1)).alias("__n"), F.avg("label").alias("label"),
                                          F.var_pop("label").alias("__v"))
    told = model.transform(VectorAssembler(inputCols=[c for c in places if c != "__which"], outputCol="features").transform(cell))
    if kind == "classificacao":
        told = cut(told.select("__which", "label", "prediction", "__n"))
        which = [r[0] for r in told.select("__which").distinct().collect()]         # a number per column
        return {w: float(classification_report(told.filter(F.col("__which") == w), rows="__n").first()["f1_w"]) for w in which}
    miss = F.sum(F.col("__n") * (F.pow(F.col("label") - F.col("prediction"), 2) + F.col("__v")))
    return {r["__which"]: -float(r["e"]) for r in told.groupBy("__which").agg(F.sqrt(miss / F.sum("__n")).alias("e")).collect()}


def learning_curve(df: DataFrame, key: Sequence[str], model, kind: str, points: int = 5, k: int = 3,
                   seed: int = 42) -> DataFrame:
    """Scores on nested samples of growing size and the gap of training to test."""
    data = with_folds(df, key, k, seed).withColumn("__u", hash_unit(*[F.col(c) for c in key], seed=f"s{seed}")).cache()
    rows = []
    for share in np.linspace(0.1, 1.0, points):
        def one(i):
            part = data.filter((F.col("dobra") != i) & (F.col("__u") < float(share)))
            fitted = own_copy(model).fit(part)
            own, n = score_and_rows(fitted.transform(part), kind)
            return own, score(fitted.transform(data.filter(F.col("dobra") == i)), kind), n
        got = side_by_side(df.sparkSession, one, range(k))
        trains, tests, n = [g[0] for g in got], [g[1] for g in got], sum(g[2] for g in got) / k
        rows.append((int(n), float(np.mean(trains)), float(np.mean(tests)), float(np.std(tests)),
                     float(np.mean(trains) - np.mean(tests))))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "n_amostras long, score_treino double, score_validacao double, "
                                           "std_validacao double, gap double")


# ---------------------------------------------------------- clusters, selection
def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = df.dropna(subset=list(columns))
    return fit_scale(rows, columns, "standard").apply(rows)


def silhouette(clustered: DataFrame, weight: str) -> float:
    """Mean squared-distance silhouette of the rows that `weight` counts, of which each has its copies as
    neighbours. MLlib's own weighted figure leaves a row's copies out of its cluster."""
    x = clustered.select(F.col("prediction").alias("c"), vector_to_array("features").alias("x"), F.col(weight).alias("n"))
    size = len(x.first()["x"])
    x = x.withColumn("q", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    sums = x.groupBy("c").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("q"), *[
        F.sum(F.col("n") * F.col("x")[i]).alias(f"x{i}") for i in range(size)]).collect()      # one row per cluster
    if len(sums) < 2:
        raise ValueError("a silhouette needs two clusters")

    def mean_distance(r):
        dot = sum((F.col("x")[i] * F.lit(r[f"x{i}"] / r["n"]) for i in range(size)), F.lit(0.0))
        return F.greatest(F.col("q") + F.lit(r["q"] / r["n"]) - 2 * dot, F.lit(0.0))
    value = F.lit(0.0)
    for r in sums:
        other = F.least(*[mean_distance(o) for o in sums if o["c"] != r["c"]], F.lit(float("inf")))
        own = mean_distance(r) * F.lit(r["n"] / (r["n"] - 1) if r["n"] > 1 else 0.0)
        s = F.when(own < other, 1 - own / other).when(own > other, other / own - 1).otherwise(0.0)
        value = F.when(F.col("c") == r["c"], s if r["n"] > 1 else F.lit(0.0)).otherwise(value)
    return float(x.agg(F.sum(F.col("n") * value) / F.sum("n")).first()[0])


def cluster_report(df: DataFrame, columns: Sequence[str], k_min: int = 2, k_max: int = 10, scale: bool = True,
                   seed: int = 42) -> DataFrame:
    """(k, inercia, silhouette): squared-distance silhouette of k-means per k."""
    rows = standardise(df, columns) if scale else df
    # equal rows are one row with their number as weight
    same = rows.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    data = vectorise(cut(same), columns).select("features", F.col("__n").alias("peso")).cache()

    def one(k):
        model = KMeans(k=k, seed=seed, featuresCol="features", weightCol="peso").fit(data)
        return k, float(model.summary.trainingCost), silhouette(model.transform(data), "peso")
    out = side_by_side(df.sparkSession, one, range(k_min, k_max + 1))
    data.unpersist()
    return df.sparkSession.createDataFrame(out, "k int, inercia double, silhouette double")


def select_features(df: DataFrame, columns: Sequence[str], label: str, method: str = "kbest", k: int = 10,
                    kind: str = "regressao", seed: int = 42) -> list[str]:
    """Best k columns: univariate F, backward elimination, or forest importance. Nothing but the columns
    and the label is read; linear fits and trees learn from distinct rows where enough rows are equal."""
    columns, k = list(columns), min(k, len(columns))
    flat = cells.flat_rows(df, columns, label)
    if method == "kbest":
        model = UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="__o", selectionMode="numTopFeatures")
        model.setFeatureType("continuous").setLabelType("continuous" if kind == "regressao" else "categorical")
        model.setSelectionThreshold(k)
        chosen = [columns[i] for i in model.fit(cells.vectorise(flat, columns)).selectedFeatures]
        return [c for c in columns if c in chosen]
    if method == "rfe":
        chosen, scale = columns, fit_scale(flat, columns, "standard")
        same = cells.cells_of(flat, columns, kind)
        scaled = scale.apply(flat.withColumn("n", F.lit(1.0)) if same is None else same).cache()
        while len(chosen) > k:
            est = LinearRegression(weightCol="n") if kind == "regressao" else LogisticRegression(maxIter=100, weightCol="n")
            fitted = est.fit(vectorise(scaled, chosen))
            weakest = min(zip(chosen, np.abs(fitted.coefficients.toArray())), key=lambda r: r[1])[0]
            chosen = [c for c in chosen if c != weakest]
        scaled.unpersist()
        return chosen
    return [c for c, _ in importances(cells.fit_forest(flat, columns, kind, seed=seed), columns)[:k]]


def principal_components(df: DataFrame, columns: Sequence[str], components: int | float = 0.95,
                         scale: bool = True) -> tuple[DataFrame, list[float]]:
    """(rows with PC1..PCn, cumulative explained variance); a share picks the count."""
    rows = standardise(df, columns) if scale else df
    data = vectorise(rows, columns)
    model = PCA(k=len(columns), inputCol="features", outputCol="__pc").fit(data)
    total = np.cumsum(model.explainedVariance.toArray())
    n = components if isinstance(components, int) else int(np.searchsorted(total, components - 1e-12) + 1)
    n = min(n, len(columns))
    parts = model.transform(data).withColumn("__a", vector_to_array("__pc"))
    return (parts.withColumns({f"PC{i + 1}": F.col("__a")[i] for i in range(n)}).drop("features", "__pc", "__a"),
            [float(v) for v in total[:n]])


def binary_auc(predictions: DataFrame, label: str = "label") -> float:
    return float(BinaryClassificationEvaluator(labelCol=label).evaluate(predictions))
