"""Profiles and statistics on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brisa.operators import profile as P, stats as T
from brisa.plans.adapters import rounded, table
from brisa.plans.registry import query

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _quality_sql(tab, columns):
    parts = []
    for c, kind in columns:
        parts.append(f"""SELECT '{c}' AS coluna, '{kind}' AS tipo, count(*) - count({c}) AS nulos, round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS pct_nulos,
  count(DISTINCT {c}) AS unicos, round(100 * (SELECT max(n) FROM (SELECT count({c}) AS n FROM {tab} GROUP BY {c}))::DOUBLE / count({c}), 1) AS pct_top_valor,
  concat_ws(' | ', CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constante' WHEN (SELECT max(n) FROM (SELECT count({c}) AS n FROM {tab} GROUP BY {c}))::DOUBLE / count({c}) > 0.95 THEN 'quase_constante' END,
  CASE WHEN count(DISTINCT {c}) = count({c}) AND count(DISTINCT {c}) > 1 THEN 'possivel_id' END, CASE WHEN '{kind}' = 'string' AND count(DISTINCT {c}) > 50 THEN 'alta_cardinalidade' END,
  CASE WHEN (count(*) - count({c})) / count(*) > 0.5 THEN 'muitos_nulos' END) AS flags FROM {tab}""")
    return " UNION ALL ".join(parts)


_ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string")]


@query("ST1", _quality_sql("orders", _ORDERS))
def quality_report(spark, sf):
    return P.quality_report(table(spark, sf, "orders"), [c for c, _ in _ORDERS]).drop("exemplo")


@query("ST1", "WITH d AS (SELECT text, lang, source FROM documents) SELECT count(*) AS linhas, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicadas FROM d")
def repeated_rows(spark, sf):
    return P.duplicate_rows(table(spark, sf, "documents").select("text", "lang", "source"))


def _summary_sql():
    parts = []
    for c in COLS:
        parts.append(f"""SELECT '{c}' AS coluna, count({c}) AS n, round(avg({c}), 6) AS media, round(stddev_samp({c}), 6) AS desvio, round(skewness({c}), 5) + 0.0 AS assimetria, round(kurtosis({c}), 5) + 0.0 AS curtose,
  min({c}) AS min, max({c}) AS max, {', '.join(f'round(quantile_cont({c}, {p}), 6) AS p{round(100 * p):02d}' for p in (0.05, 0.25, 0.5, 0.75, 0.95))}, round(stddev_samp({c}) / avg({c}), 6) AS cv, 0::BIGINT AS nulos, 0.0::DOUBLE AS pct_nulos FROM lineitem""")
    return " UNION ALL ".join(parts)


@query("ST2", _summary_sql())
def numeric_summary(spark, sf):
    df = P.numeric_summary(table(spark, sf, "lineitem"), COLS)
    df = rounded(df, 6, "media", "desvio", "cv", *[c for c in df.columns if c.startswith("p") and c[1:].isdigit()])
    return df.withColumns({c: F.round(c, 5) + 0.0 for c in ("assimetria", "curtose")})


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS var_1, '{b}' AS var_2, round(corr({a}, {b}), 8) + 0.0 AS r, count(*) AS n FROM lineitem"
                            for i, a in enumerate(COLS) for b in COLS[i + 1:])


@query("ST3", _PAIRS)
def pearson_correlations(spark, sf):
    out = T.pearson_pairs(table(spark, sf, "lineitem"), COLS)
    return out.withColumn("r", F.round("r", 8) + 0.0)


@query("ST3", """WITH r AS (SELECT (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0)::DOUBLE AS a, (rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0)::DOUBLE AS b FROM lineitem)
  SELECT 'l_quantity' AS var_1, 'l_extendedprice' AS var_2, round(corr(a, b), 8) AS r, count(*) AS n FROM r""")
def spearman_correlation(spark, sf):
    return rounded(T.spearman_pair(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), 8, "r")


@query("ST3", f"WITH p AS ({_PAIRS}) SELECT CASE WHEN var_1 = 'l_tax' THEN var_2 ELSE var_1 END AS variavel, r, n FROM p WHERE 'l_tax' IN (var_1, var_2)")
def correlation_against_target(spark, sf):
    out = T.against_target(T.strong_pairs(T.pearson_pairs(table(spark, sf, "lineitem"), COLS), 0.0), "l_tax")
    return out.withColumn("r", F.round("r", 8) + 0.0)


@query("ST4")
def correlation_tests(spark, sf):
    return T.correlation_tests(table(spark, sf, "lineitem"), COLS)


@query("ST5")
def normality_tests(spark, sf):
    rows = []
    for c in ("o_totalprice",):
        r = T.normality(table(spark, sf, "orders"), c)
        rows.append((c, r["n"], r["dagostino"]["estatistica"], r["dagostino"]["p_valor"], r["ks"]["estatistica"], r["ks"]["p_valor"], r["normal"]))
    return spark.createDataFrame(rows, "coluna string, n long, dagostino double, p_dagostino double, ks double, p_ks double, normal boolean")


@query("ST6", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 6) AS media, round(stddev_samp(l_extendedprice), 6) AS desvio, round(quantile_cont(l_extendedprice, 0.5), 6) AS mediana FROM lineitem GROUP BY 1")
def group_summaries(spark, sf):
    return rounded(T.group_summary(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"), 6, "media", "desvio", "mediana")


@query("ST6", """WITH r AS (SELECT l_returnflag AS g, (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0)::DOUBLE AS p FROM lineitem), s AS (SELECT g, count(*)::DOUBLE AS n, sum(p) AS r FROM r GROUP BY 1),
  t AS (SELECT sum(c::DOUBLE * c * c - c) AS t FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity)), h AS (SELECT sum(n) AS n, sum(r * r / n) AS q FROM s),
  k AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS k FROM h, t)
  SELECT round(k, 6) AS estatistica, round(exp(-k / 2), 8) AS p_valor FROM k""")
def kruskal_wallis(spark, sf):
    got = T.compare_groups(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "kruskal")
    return spark.createDataFrame([(round(got["estatistica"], 6), round(got["p_valor"], 8))], "estatistica double, p_valor double")


@query("ST6", """WITH r AS (SELECT l_linestatus AS g, (rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0)::DOUBLE AS p FROM lineitem)
  SELECT sum(p) - count(*)::DOUBLE * (count(*) + 1) / 2 AS estatistica FROM r WHERE g = 'F'""")
def mann_whitney(spark, sf):
    got = T.compare_groups(table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus", "mannwhitney")
    return spark.createDataFrame([(got["estatistica"],)], "estatistica double")


@query("ST6", """WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM g WHERE g = 'F'), b AS (SELECT * FROM g WHERE g = 'O'),
  k AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), z AS (SELECT avg(l_extendedprice) AS w, count(*) AS t FROM lineitem)
  SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) + 0.0 AS welch, (SELECT round((sum(n * pow(m - w, 2)) / 2) / (sum((n - 1) * v) / (any_value(t) - 3)), 5) FROM k, z) AS anova FROM a, b""")
def welch_and_anova(spark, sf):
    li = table(spark, sf, "lineitem")
    t = T.compare_groups(li, "l_extendedprice", "l_linestatus", "t")
    f = T.compare_groups(li, "l_extendedprice", "l_returnflag", "anova")
    return spark.createDataFrame([(round(t["estatistica"], 5) + 0.0, round(f["estatistica"], 5))], "welch double, anova double")


_CHI = """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY a)::DOUBLE * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM c)"""


@query("ST7", f"{_CHI} SELECT a AS l_returnflag, b AS l_linestatus, n, round(e, 6) AS esperado FROM e")
def category_crosstab(spark, sf):
    return rounded(T.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"), 6, "esperado")


@query("ST7", f"{_CHI} SELECT round(sum(pow(n - e, 2) / e), 6) AS chi2, sum(n)::BIGINT AS n, 3 AS linhas, 2 AS colunas, round(sqrt(sum(pow(n - e, 2) / e) / sum(n)), 8) AS cramers_v FROM e")
def chi_square_of_categories(spark, sf):
    out = T.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    out = rounded(rounded(out, 6, "chi2"), 8, "cramers_v")
    return out.withColumns({c: F.col(c).cast("int") for c in ("linhas", "colunas")})


@query("ST7")
def categorical_tests(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("grande", F.col("l_quantity") > 25)
    rows = []
    for a, b in (("l_returnflag", "l_linestatus"), ("grande", "l_linestatus")):
        r = T.categorical_test(li, a, b)
        rows.append((a, b, r["teste"], r["chi2"], r["p_valor"], r["cramers_v"]))
    return spark.createDataFrame(rows, "a string, b string, teste string, chi2 double, p_valor double, cramers_v double")


@query("ST8", """WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders) SELECT 'o_totalprice' AS coluna, count(*) AS n, round(avg(o_totalprice), 6) AS media, round(any_value(q[2]), 6) AS mediana, min(o_totalprice) AS menor,
  max(o_totalprice) AS maior, count(*) FILTER (WHERE o_totalprice < q[1] - 1.5 * (q[3] - q[1]) OR o_totalprice > q[3] + 1.5 * (q[3] - q[1])) AS outliers FROM orders, q""")
def one_numeric_column(spark, sf):
    r = P.column_profile(table(spark, sf, "orders"), "o_totalprice")
    return spark.createDataFrame([(r["coluna"], r["n"], round(r["media"], 6), round(r["mediana"], 6), r["min"], r["max"], r["outliers_iqr"])],
                                 "coluna string, n long, media double, mediana double, menor double, maior double, outliers long")


@query("ST8", "WITH c AS (SELECT p_name AS valor, count(*) AS n FROM part GROUP BY 1) SELECT valor, n FROM c WHERE n < 0.014 * (SELECT sum(n) FROM c)")
def rare_categories(spark, sf):
    return P.rare_categories(table(spark, sf, "part"), "p_name", 0.014)


def _rank(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE AS {c}"


_RANKS = f"r AS (SELECT {', '.join(_rank(c) for c in [*COLS, 'l_linenumber'])} FROM lineitem)"


@query("ST3", f"WITH {_RANKS} " + " UNION ALL ".join(f"SELECT '{a}' AS var_1, '{b}' AS var_2, round(corr({a}, {b}), 8) + 0.0 AS r, count(*) AS n FROM r"
                                                     for i, a in enumerate(COLS) for b in COLS[i + 1:]))
def spearman_matrix(spark, sf):
    out = T.correlations(table(spark, sf, "lineitem"), COLS, "spearman")
    return out.withColumn("r", F.round("r", 8) + 0.0)


_ETA = "SELECT '{c}', 'cat x num', 'eta2', round(sum(n * pow(m - w, 2)) / (sum(n * pow(m - w, 2)) + sum(n * v)), 8) FROM (SELECT count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY {c}), (SELECT avg(l_extendedprice) AS w FROM lineitem)"


@query("ST9", f"WITH {_RANKS} " + " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, 'num x num' AS tipo_relacao, '|spearman|' AS medida, round(abs(corr({c}, l_extendedprice)), 8) AS forca FROM r" for c in (*COLS, "l_linenumber") if c != "l_extendedprice"]
    + [_ETA.format(c=c) for c in ("l_returnflag", "l_linestatus")]))
def feature_ranking(spark, sf):
    li = table(spark, sf, "lineitem").select(*COLS, "l_returnflag", "l_linestatus", "l_linenumber")
    return rounded(T.rank_features(li, "l_extendedprice"), 8, "forca")


@query("ST9", """WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1), w AS (SELECT avg(l_quantity) AS w FROM lineitem)
  SELECT round(sum(n * pow(m - w, 2)) / (sum(n * pow(m - w, 2)) + sum(n * v)), 10) AS eta2 FROM g, w""")
def share_between_groups(spark, sf):
    return rounded(T.eta_squared(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"), 10, "eta2")


@query("ST10")
def confidence_intervals(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("devolvida", (F.col("l_returnflag") == "R").cast("int"))
    c = table(spark, sf, "customer")
    got = [("media", T.interval(li, "l_extendedprice", "media")), ("proporcao", T.interval(li, "devolvida", "proporcao")),
           ("mediana", T.interval(c, "c_acctbal", "mediana", key=["c_custkey"]))]
    return spark.createDataFrame([(k, r["estimativa"], r["ic_inferior"], r["ic_superior"], r["n"]) for k, r in got],
                                 "tipo string, estimativa double, ic_inferior double, ic_superior double, n long")


_COPIES = "(SELECT c_custkey, r AS replica, c_acctbal AS v, list_sum(list_transform([{p}], lambda x: (u >= x)::INTEGER)) AS w FROM (SELECT *, ('0x' || substr(md5('42|' || c_custkey || '|' || r), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM customer, (SELECT unnest(range(1, 51)) AS r)))".format(
    p=", ".join(f"{x!r}::DOUBLE" for x in T.POISSON_ONE))


@query("ST11", f"SELECT replica::INTEGER AS replica, sum(w)::BIGINT AS n, round(sum(w * v), 4) AS soma, round(sum(w * v * v), 0) AS soma2 FROM {_COPIES} GROUP BY 1")
def bootstrap_sums(spark, sf):
    out = T.bootstrap(table(spark, sf, "customer"), "c_acctbal", ["c_custkey"], 50)
    return rounded(rounded(out, 4, "soma"), 0, "soma2")


@query("ST11")
def bootstrap_interval_of_cv(spark, sf):
    r = T.bootstrap_interval(table(spark, sf, "customer"), "c_acctbal", ["c_custkey"], "cv")
    return spark.createDataFrame([(r["estimativa"], r["ic_inferior"], r["ic_superior"], r["erro_padrao_boot"])],
                                 "estimativa double, ic_inferior double, ic_superior double, erro_padrao double")


@query("ST12", """SELECT l_linestatus, count(*) AS n, sum((l_returnflag = 'R')::INTEGER)::BIGINT AS conversoes, round(avg((l_returnflag = 'R')::INTEGER), 8) AS taxa FROM lineitem GROUP BY 1""")
def ab_rates(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("devolvida", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(T.ab_rates(li, "l_linestatus", "devolvida"), 8, "taxa")


@query("ST12", """WITH g AS (SELECT l_linestatus AS g, count(*)::DOUBLE AS n, sum((l_returnflag = 'R')::INTEGER)::DOUBLE AS c FROM lineitem GROUP BY 1), a AS (SELECT n AS na, c AS ca FROM g WHERE g = 'F'), b AS (SELECT n AS nb, c AS cb FROM g WHERE g = 'O')
  SELECT round(100 * (cb / nb - ca / na) / (ca / na), 6) + 0.0 AS lift, round((cb / nb - ca / na) / sqrt((ca + cb) / (na + nb) * (1 - (ca + cb) / (na + nb)) * (1 / na + 1 / nb)), 6) + 0.0 AS z FROM a, b""")
def ab_test(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("devolvida", (F.col("l_returnflag") == "R").cast("int"))
    r = T.ab_test(li, "l_linestatus", "devolvida", "F", "O")
    return spark.createDataFrame([(round(r["lift_relativo_pct"], 6) + 0.0, round(r["z"], 6) + 0.0)], "lift double, z double")


@query("ST13")
def variance_inflation(spark, sf):
    return T.variance_inflation(table(spark, sf, "lineitem"), COLS)


@query("ST14")
def distribution_fits(spark, sf):
    return T.fit_distributions(table(spark, sf, "orders"), "o_totalprice")


_SORTED = "s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem), k AS (SELECT v, i, n, (n * 0.1)::BIGINT AS k FROM s)"


@query("ST15", f"""WITH {_SORTED}, q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem), m AS (SELECT quantile_cont(abs(l_extendedprice - q[2]), 0.5) AS mad FROM lineitem, q),
  c AS (SELECT max(v) FILTER (WHERE i = k + 1) AS lo, max(v) FILTER (WHERE i = n - k) AS hi FROM k)
  SELECT round(avg(v), 5) AS media, round(any_value(q[2]), 5) AS mediana, round(stddev_samp(v), 5) AS desvio_padrao, round(any_value(mad) * 1.482602218505602, 5) AS mad_escalado,
  round(avg(v) FILTER (WHERE i > k AND i <= n - k), 5) AS media_aparada, round(avg(CASE WHEN i <= k THEN lo WHEN i > n - k THEN hi ELSE v END), 5) AS media_winsorizada, round(any_value(q[3] - q[1]), 5) AS iqr FROM k, q, m, c""")
def robust_statistics(spark, sf):
    out = T.robust(table(spark, sf, "lineitem"), "l_extendedprice")
    return rounded(out, 5, *out.columns)


@query("ST16", " UNION ALL ".join(f"SELECT '{c}' AS coluna, count(*) FILTER (WHERE {e} IS NULL) AS nulos, round(100.0 * count(*) FILTER (WHERE {e} IS NULL) / count(*), 6)::DOUBLE AS pct FROM customer"
                                  for c, e in (("saldo", "CASE WHEN c_acctbal > 0 THEN c_acctbal END"), ("c_name", "c_name"))))
def null_shares(spark, sf):
    c = table(spark, sf, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("saldo"), "c_name")
    return rounded(P.null_shares(c), 6, "pct")


@query("ST17", """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.5) AS q FROM lineitem)
  SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29)::BIGINT AS faixa, round(any_value(lo + least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29) * ((hi - lo) / 30)), 4) AS inicio,
  round(any_value(lo + (least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29) + 1) * ((hi - lo) / 30)), 4) AS fim, count(*) AS n, round(any_value(m), 4) AS media, round(any_value(q), 4) AS mediana FROM lineitem, b GROUP BY 1""")
def price_histogram(spark, sf):
    return rounded(P.histogram(table(spark, sf, "lineitem"), "l_extendedprice"), 4, "inicio", "fim", "media", "mediana")


@query("ST18", """WITH t AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4), q AS (SELECT p_type, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS mediana, quantile_cont(p_retailprice, 0.75) AS q3,
  min(p_retailprice) AS min, max(p_retailprice) AS max, count(*) AS n FROM part WHERE p_type IN (SELECT p_type FROM t) GROUP BY 1)
  SELECT p_type, round(q1, 6) AS q1, round(mediana, 6) AS mediana, round(q3, 6) AS q3, min, max, n, round(greatest(min, q1 - 1.5 * (q3 - q1)), 6) AS limite_inferior, round(least(max, q3 + 1.5 * (q3 - q1)), 6) AS limite_superior FROM q""")
def box_data(spark, sf):
    return rounded(P.box_table(table(spark, sf, "part"), "p_type", "p_retailprice", 4), 6, "q1", "mediana", "q3", "limite_inferior", "limite_superior")


@query("ST19", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS inclinacao, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercepto, round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) AS n FROM lineitem GROUP BY 1")
def trend_lines(spark, sf):
    out = P.trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(rounded(rounded(out, 6, "inclinacao"), 4, "intercepto"), 8, "r")


@query("ST20", """WITH q AS (SELECT quantile_cont(o_totalprice, list_transform(range(1, 100), lambda i: i / 100.0)) AS q FROM orders)
  SELECT round(i / 100.0, 2)::DOUBLE AS p, round(q[i], 4) AS observado FROM q, (SELECT unnest(range(1, 100)) AS i)""")
def normal_quantile_pairs(spark, sf):
    """Observed quantiles; the quantile of the normal curve beside each is left out here."""
    out = P.normal_quantile_pairs(table(spark, sf, "orders"), "o_totalprice")
    return rounded(rounded(out.select("p", "observado"), 4, "observado"), 2, "p")


@query("ST20", "SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr(md5('42|' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0 < 0.2")
def seeded_sample(spark, sf):
    return P.hash_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.2)



@query("ST13", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
  SELECT 'l_quantity' AS feature, round((1 - c * c) / det, 8) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 8) FROM d UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 8) FROM d""")
def variance_inflation_of_three(spark, sf):
    return rounded(T.variance_inflation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 8, "vif")


@query("ST10", """WITH p AS (SELECT avg((l_returnflag = 'R')::INTEGER) AS p, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM lineitem)
  SELECT round(p, 8) AS estimativa, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 8) AS ic_inferior,
  round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 8) AS ic_superior FROM p""")
def proportion_interval(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("devolvida", (F.col("l_returnflag") == "R").cast("int"))
    r = T.interval(li, "devolvida", "proporcao")
    return spark.createDataFrame([tuple(round(r[k], 8) for k in ("estimativa", "ic_inferior", "ic_superior"))],
                                 "estimativa double, ic_inferior double, ic_superior double")
