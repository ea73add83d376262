"""Table learning on the driver tables."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from brisa.operators import cells, ml as M
from brisa.plans.adapters import rounded, table
from brisa.plans.registry import query

COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
KEY = ["l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("devolvida", (F.col("l_returnflag") == "R").cast("int"))


def _features(spark, sf, label):
    rows = M.vectorise(_lines(spark, sf), COLS).withColumn("label", F.col(label).cast("double"))
    return rows.select(*dict.fromkeys([*KEY, *COLS]), "features", "label")      # what fits keep in memory


_U = "('0x' || substr(md5(concat_ws('|', '42', o_orderkey::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0"


@query("ML1", f"""WITH u AS (SELECT o_orderkey, o_orderstatus, {_U} AS u FROM orders), q AS (SELECT o_orderstatus, quantile_cont(u, 0.2) AS q FROM u GROUP BY 1)
  SELECT o_orderkey, o_orderstatus, u < q AS teste FROM u JOIN q USING (o_orderstatus)""")
def stratified_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    train, test = M.split(o, "o_orderstatus", ["o_orderkey"], 0.2, exclude=["o_totalprice"])
    return train.withColumn("teste", F.lit(False)).unionByName(test.withColumn("teste", F.lit(True)))


@query("ML2")
def preprocessing_output(spark, sf):
    """Imputed, scaled and one-hot features of every customer."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("saldo"),
                                            F.col("c_nationkey").cast("double").alias("nacao"), "c_mktsegment", "c_name")
    model = M.preprocessing(c, ["saldo", "nacao"], ["c_mktsegment", "c_name"]).fit(c)
    from pyspark.ml.functions import vector_to_array
    return model.transform(c).select("c_custkey", vector_to_array("features").alias("features"))


_PRED = "p AS (SELECT (l_returnflag = 'R')::INTEGER::DOUBLE AS label, (l_quantity > 30)::INTEGER::DOUBLE AS prediction, l_quantity AS s FROM lineitem)"


def _predictions(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("double").alias("label"), (F.col("l_quantity") > 30).cast("double").alias("prediction"),
                     F.col("l_quantity").alias("s"))


@query("ML3", f"""WITH {_PRED}, c AS (SELECT c, count(*) FILTER (WHERE label = c) AS sup, count(*) FILTER (WHERE prediction = c) AS dit, count(*) FILTER (WHERE label = c AND prediction = c) AS cer FROM p, (SELECT unnest([0.0, 1.0]) AS c) GROUP BY 1)
  SELECT round(sum(cer) / sum(sup), 8) AS accuracy, round(sum(cer / dit * sup) / sum(sup), 8) AS precision_w, round(sum(cer / sup * sup) / sum(sup), 8) AS recall_w,
  round(sum(2 * (cer / dit) * (cer / sup) / (cer / dit + cer / sup) * sup) / sum(sup), 8) AS f1_w, sum(sup)::BIGINT AS n FROM c""")
def classification_report(spark, sf):
    return rounded(M.classification_report(_predictions(spark, sf)), 8, "accuracy", "precision_w", "recall_w", "f1_w")


@query("ML3", f"WITH {_PRED} SELECT label AS real, prediction AS previsto, count(*) AS n FROM p GROUP BY ALL")
def confusion_table(spark, sf):
    return M.confusion(_predictions(spark, sf))


@query("ML3", f"""WITH {_PRED}, r AS (SELECT label, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0)::DOUBLE AS r FROM p)
  SELECT round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 10) AS roc_auc FROM r""")
def area_under_curve(spark, sf):
    return rounded(M.roc_auc(_predictions(spark, sf), "label", "s"), 10, "roc_auc")


@query("ML4", """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS f FROM lineitem)
  SELECT round(sqrt(avg(pow(y - f, 2))), 5) AS rmse, round(avg(abs(y - f)), 5) AS mae, round(1 - avg(pow(y - f, 2)) / var_pop(y), 8) AS r2, round(100 * avg(abs((y - f) / y)), 6) AS mape_pct, count(*) AS n FROM p""")
def regression_report(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction"))
    return rounded(rounded(rounded(M.regression_report(p), 5, "rmse", "mae"), 8, "r2"), 6, "mape_pct")


@query("ML5")
def compared_regressors(spark, sf):
    return M.compare_models(_features(spark, sf, "l_extendedprice"), KEY, "regressao")


@query("ML5")
def compared_classifiers(spark, sf):
    return M.compare_models(_features(spark, sf, "devolvida"), KEY, "classificacao")


@query("ML6")
def searched_parameters(spark, sf):
    got = M.search(_features(spark, sf, "l_extendedprice"), KEY, LinearRegression(maxIter=20), {"regParam": [0.0, 100.0], "elasticNetParam": [0.0, 1.0]},
                   "regressao", "grid")
    return spark.createDataFrame([(str(p), s) for p, s in got["tentativas"]], "parametros string, score double")


@query("ML7")
def forest_importances(spark, sf):
    data = _features(spark, sf, "l_extendedprice")
    forest = cells.fit_forest(data, COLS, "regressao", trees=50, depth=5, seed=42)
    native = spark.createDataFrame(M.importances(forest, COLS), "feature string, nativa double")
    dealt = M.permutation_importances(forest, data, COLS, KEY, "regressao", repeats=3)
    return native.join(dealt, "feature")


@query("ML8")
def cluster_counts(spark, sf):
    return M.cluster_report(_lines(spark, sf), ["l_quantity", "l_discount"], 2, 4)


@query("ML9")
def learning_curve(spark, sf):
    return M.learning_curve(_features(spark, sf, "l_extendedprice"), KEY, LinearRegression(maxIter=10), "regressao")


@query("ML10")
def selected_features(spark, sf):
    li = _lines(spark, sf)
    rows = [(m, ",".join(M.select_features(li, COLS, "l_extendedprice", m, 2))) for m in ("kbest", "rfe", "modelo")]
    return spark.createDataFrame(rows, "metodo string, colunas string")


@query("ML11")
def principal_components(spark, sf):
    out, share = M.principal_components(_lines(spark, sf), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], 0.7)
    return out.select(*KEY, *[c for c in out.columns if c.startswith("PC")], F.lit(share[-1]).alias("variancia"))


