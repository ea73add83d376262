"""Correlation, tests and intervals from distributed sums; only tails on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from brisa.functions.numeric import hash_unit, normal_cdf
from brisa.operators import ordered
from brisa.operators.cleaning import is_numeric, numeric_columns
from brisa.operators.profile import corrected_shape
from brisa.session import Tails, table_in_shared_folder


# ----------------------------------------------------------------- correlation
def pearson_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(var_1, var_2, r, n) of every pair over the rows that have both: one pass."""
    columns = list(columns or numeric_columns(df))
    aggs, cells = [], []
    for i, (a, b) in enumerate(combinations(columns, 2)):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.corr(F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))).alias(f"r{i}"),
                 F.count_if(both).alias(f"n{i}")]
        cells.append(F.struct(F.lit(a).alias("var_1"), F.lit(b).alias("var_2"), F.col(f"r{i}").alias("r"),
                              F.col(f"n{i}").alias("n")))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def spearman_pairs(df: DataFrame, columns: Sequence[str] | None = None,
                   pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(var_1, var_2, r, n): correlation of average ranks of every pair, over the rows that have both.

    Equal rows are counted once and numbered. All columns are ranked together in long form; a column
    with nulls gives the others one more rank, among the rows where it has a value. Ranks meet again
    by row and one aggregate sums all pairs, so jobs grow neither with columns nor with pairs.
    """
    pairs = list(pairs if pairs is not None else combinations(columns or numeric_columns(df), 2))
    schema = "var_1 string, var_2 string, r double, n long"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    at = {c: i for i, c in enumerate(dict.fromkeys(c for pair in pairs for c in pair))}
    values = [F.col(c).cast("double") for c in at]
    cells = ordered.cut(df.select(*[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(values)])
                        .groupBy(*[f"v{i}" for i in at.values()]).agg(F.count(F.lit(1)).alias("w"))
                        .withColumn("__id", F.monotonically_increasing_id()))
    known = [F.col(f"v{i}").isNotNull() for i in at.values()]
    sizes = cells.agg(F.count(F.lit(1)).alias("cells"), *[F.count(f"v{i}").alias(f"v{i}") for i in at.values()], *[
        F.sum(F.when(known[at[a]] & known[at[b]], F.col("w"))).alias(f"n{k}") for k, (a, b) in enumerate(pairs)]).first()
    # rank 0 is among all values of a column, rank i + 1 among those in rows where column i has one
    among = {i: i + 1 if sizes[f"v{i}"] < sizes["cells"] else 0 for i in at.values()}
    marks = [i for i in at.values() if among[i]]
    long = (cells.select("__id", "w", *[known[i].alias(f"h{i + 1}") for i in marks], F.explode(F.array(*[
        F.struct(F.lit(i).alias("coluna"), F.col(f"v{i}").alias("valor")) for i in at.values()])).alias("x"))
        .select("__id", "w", *[f"h{i + 1}" for i in marks], "x.*").filter(F.col("valor").isNotNull()))
    per = long.groupBy("coluna", "valor").agg(
        F.count(F.lit(1)).alias("__rows"), F.sum("w").alias("n0"),
        *[F.sum(F.when(F.col(f"h{i + 1}"), F.col("w")).otherwise(0)).alias(f"n{i + 1}") for i in marks])
    kinds = [0, *[i + 1 for i in marks]]
    ranks = ordered.cut(ordered.running_sums(per, ["coluna"], "valor", {f"__a{k}": f"n{k}" for k in kinds}).select(
        "coluna", "valor", "__rows", *[(F.col(f"__a{k}") - (F.col(f"n{k}") - 1) / 2).alias(f"p{k}") for k in kinds]))
    ranked = ordered.attach_by_value(long.select("__id", "w", "coluna", "valor"), ranks, ["coluna", "valor"], "__rows",
                                     sum(sizes[f"v{i}"] for i in at.values()))
    wanted = {(at[a], among[at[b]]) for a, b in pairs} | {(at[b], among[at[a]]) for a, b in pairs}
    rows = ranked.groupBy("__id").agg(F.max("w").alias("w"), *[
        F.max(F.when(F.col("coluna") == i, F.col(f"p{k}"))).alias(f"r{i}_{k}") for i, k in sorted(wanted)])
    aggs, out = [], []
    for k, (a, b) in enumerate(pairs):
        n = sizes[f"n{k}"] or 0
        x, y = (F.col(f"r{at[c]}_{among[at[d]]}") - (n + 1) / 2 for c, d in ((a, b), (b, a)))
        both = x.isNotNull() & y.isNotNull()
        aggs += [F.sum(F.when(both, F.col("w") * u * v)).alias(f"{name}{k}") for name, u, v in (("xy", x, y), ("xx", x, x), ("yy", y, y))]
        out.append(F.struct(F.lit(a).alias("var_1"), F.lit(b).alias("var_2"), F.try_divide(
            F.col(f"xy{k}"), F.sqrt(f"xx{k}") * F.sqrt(f"yy{k}")).alias("r"), F.lit(n).cast("long").alias("n")))
    return rows.agg(*aggs).select(F.explode(F.array(*out)).alias("x")).select("x.*")


def spearman_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """(var_1, var_2, r, n): correlation of average ranks of one pair."""
    return spearman_pairs(df, pairs=[(a, b)])


def weighted_correlation(df: DataFrame, a: str, b: str, w: str) -> DataFrame:
    """One row (r, n) from sums around the means."""
    x, y, k = F.col(a), F.col(b), F.col(w)
    means = df.agg((F.sum(k * x) / F.sum(k)).alias("__ma"), (F.sum(k * y) / F.sum(k)).alias("__mb"))
    dx, dy = x - F.col("__ma"), y - F.col("__mb")
    return df.join(F.broadcast(means)).agg(
        F.try_divide(F.sum(k * dx * dy), F.sqrt(F.sum(k * dx * dx)) * F.sqrt(F.sum(k * dy * dy))).alias("r"),
        F.sum(k).cast("long").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    columns = list(columns or numeric_columns(df))
    if method == "pearson":
        return pearson_pairs(df, columns)
    return spearman_pairs(df, columns)


def strong_pairs(pairs: DataFrame, limit: float = 0.7) -> DataFrame:
    return pairs.filter(F.abs("r") >= limit).orderBy(F.desc(F.abs("r")), "var_1", "var_2")


def against_target(pairs: DataFrame, target: str) -> DataFrame:
    """Correlation of every variable with the target, strongest first."""
    other = F.when(F.col("var_1") == target, F.col("var_2")).otherwise(F.col("var_1"))
    return (pairs.filter((F.col("var_1") == target) | (F.col("var_2") == target))
            .select(other.alias("variavel"), "r", "n").orderBy(F.desc(F.abs("r")), "variavel"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    index = {c: i for i, c in enumerate(columns)}
    out = np.eye(len(columns))
    for r in pearson_pairs(df, columns).collect():
        out[index[r["var_1"]], index[r["var_2"]]] = out[index[r["var_2"]], index[r["var_1"]]] = r["r"]
    return out


def correlation_tests(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson",
                      correct: bool = True, alpha: float = 0.05) -> DataFrame:
    """Every pair with p-value, adjusted for the number of pairs."""
    tails, rows = Tails(df.sparkSession), []
    for r in correlations(df, columns, method).collect():
        if r["n"] >= 3 and r["r"] is not None:
            rest = max(1 - r["r"] ** 2, 1e-300)
            rows.append((r["var_1"], r["var_2"], r["r"], tails.t_two_sided(r["r"] * math.sqrt((r["n"] - 2) / rest), r["n"] - 2), r["n"]))
    m = len(rows) if correct else 1
    done = [(*r, min(r[3] * m, 1.0), min(r[3] * m, 1.0) < alpha) for r in sorted(rows, key=lambda r: -abs(r[2]))]
    return df.sparkSession.createDataFrame(done, "var_1 string, var_2 string, r double, p_valor double, n long, "
                                           "p_ajustado double, significativo boolean")


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Diagonal of the inverse correlation matrix of the complete rows."""
    matrix = correlation_matrix(df.dropna(subset=list(columns)), columns)
    try:
        values = np.diag(np.linalg.inv(matrix))
    except np.linalg.LinAlgError:
        values = [float("inf")] * len(columns)
    rows = sorted(((c, float(v)) for c, v in zip(columns, values)), key=lambda r: -r[1])
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


# ------------------------------------------------------------------- normality
def ks_distance(df: DataFrame, column: str, cdf: Column) -> DataFrame:
    """Largest distance of the observed steps to a curve given as an expression of
    `valor`: (d, n)."""
    table = (df.select(F.col(column).cast("double").alias("valor")).dropna()
             .groupBy("valor").agg(F.count(F.lit(1)).alias("n")))
    table = ordered.cut(table)
    run = ordered.running_sums(table, [], "valor", {"__ate": "n"})
    total = table.agg(F.sum("n").alias("__t"))
    f, up = F.col("__f"), F.col("__ate") / F.col("__t")
    down = (F.col("__ate") - F.col("n")) / F.col("__t")
    return run.join(F.broadcast(total)).withColumn("__f", cdf).agg(
        F.max(F.greatest(F.abs(up - f), F.abs(f - down))).alias("d"), F.max("__t").alias("n"))


def ks_p_value(d: float, n: int) -> float:
    """Tail of the limit distribution."""
    x = d * math.sqrt(n)
    if x < 0.2:
        return 1.0
    return float(min(max(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)), 0.0), 1.0))


def normality(df: DataFrame, column: str, alpha: float = 0.05) -> dict:
    """D'Agostino and Kolmogorov-Smirnov; normal when both keep the hypothesis."""
    row = corrected_shape(df, [column]).first()
    n = row["n"]
    if n < 8:
        raise ValueError(f"sample too small for a normality test: {n}")
    raw = df.agg(F.skewness(F.col(column).cast("double")).alias("s"), F.kurtosis(F.col(column).cast("double")).alias("k")).first()
    k2 = _skew_z(raw["s"], n) ** 2 + _kurtosis_z(raw["k"], n) ** 2
    p1 = Tails(df.sparkSession).chi2_upper(k2, 2)
    ks = ks_distance(df, column, normal_cdf((F.col("valor") - F.lit(row["media"])) / F.lit(row["desvio"]))).first()
    p2 = ks_p_value(ks["d"], n)
    return {"n": n, "dagostino": {"estatistica": k2, "p_valor": p1}, "ks": {"estatistica": ks["d"], "p_valor": p2},
            "assimetria": row["assimetria"], "curtose": row["curtose"], "normal": p1 > alpha and p2 > alpha}


def _skew_z(skew: float, n: int) -> float:
    """D'Agostino (1970): the skewness of n normal values, scaled by its standard error, follows a
    Johnson curve whose shape comes from its fourth moment."""
    scaled = skew / math.sqrt(6.0 * (n - 2) / ((n + 1) * (n + 3)))
    moment4 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    square = math.sqrt(2 * moment4 - 2) - 1
    return math.asinh(scaled * math.sqrt((square - 1) / 2)) / math.sqrt(math.log(square) / 2)


def _kurtosis_z(excess: float, n: int) -> float:
    """Anscombe and Glynn (1983): the kurtosis of n normal values follows about an inverse
    chi-square law with as many degrees of freedom as its third moment asks for."""
    mean = 3.0 * (n - 1) / (n + 1)
    deviation = math.sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 3) * (n + 5))) / (n + 1)
    skew = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    freedom = 6 + 8 / skew * (2 / skew + math.sqrt(1 + 4 / skew ** 2))
    ratio = (1 - 2 / freedom) / (1 + (excess + 3 - mean) / deviation * math.sqrt(2 / (freedom - 4)))
    spread = 2 / (9 * freedom)
    return (1 - spread - math.copysign(abs(ratio) ** (1 / 3), ratio)) / math.sqrt(spread)


# ---------------------------------------------------------------------- groups
def group_summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """(grupo, n, media, desvio, mediana) of each group."""
    rows = df.dropna(subset=[value, group])
    sums = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("media"),
                                   F.stddev_samp(value).alias("desvio"))
    return sums.join(ordered.quantiles_wide(rows, value, {"mediana": 0.5}, [group]), group)


def rank_sums(df: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """((grupo, n, soma_postos), one row with n and the tie term)."""
    rows = df.dropna(subset=[value, group])
    cells = ordered.cut(rows.groupBy(F.col(group).alias("grupo"), F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("w")))
    per = cells.groupBy("v").agg(F.sum("w").alias("n"))
    ranks = ordered.running_sums(per, [], "v", {"__ate": "n"}).withColumn(
        "posto", F.col("__ate") - F.col("n") + (F.col("n") + 1) / 2)
    sums = cells.join(ranks.select("v", "posto"), "v").groupBy("grupo").agg(
        F.sum("w").cast("long").alias("n"), F.sum(F.col("w") * F.col("posto")).alias("soma_postos"))
    t = F.col("n").cast("double")
    return sums, per.agg(F.sum("n").alias("n"), F.sum(t * t * t - t).alias("empates"))


def compare_groups(df: DataFrame, value: str, group: str, test: str | None = None, alpha: float = 0.05) -> dict:
    """Welch t, ANOVA, Mann-Whitney or Kruskal-Wallis with an effect size. Without a
    forced test, D'Agostino on every group decides (`regra` says so)."""
    spark = df.sparkSession
    tails = Tails(spark)
    info = {r[group]: r for r in group_summary(df, value, group).collect()}
    names = sorted(info)
    k = len(names)
    if k < 2:
        raise ValueError("at least two groups are needed")
    rule = "forcado" if test else "dagostino"
    if test is None:
        shapes = df.dropna(subset=[value, group]).groupBy(group).agg(
            F.skewness(value).alias("s"), F.kurtosis(value).alias("c"), F.count(F.lit(1)).alias("n")).collect()
        normal = all(r["n"] >= 8 and tails.chi2_upper(_skew_z(r["s"], r["n"]) ** 2 + _kurtosis_z(r["c"], r["n"]) ** 2, 2) > alpha
                     for r in shapes)
        test = ("t" if normal else "mannwhitney") if k == 2 else ("anova" if normal else "kruskal")
    n = np.array([info[g]["n"] for g in names], float)
    mean = np.array([info[g]["media"] for g in names], float)
    var = np.array([info[g]["desvio"] or 0.0 for g in names], float) ** 2
    if test == "t":
        se = var[0] / n[0] + var[1] / n[1]
        stat = (mean[0] - mean[1]) / math.sqrt(se)
        dof = se ** 2 / ((var[0] / n[0]) ** 2 / (n[0] - 1) + (var[1] / n[1]) ** 2 / (n[1] - 1))
        p, effect = tails.t_two_sided(stat, dof), ("cohen_d", (mean[0] - mean[1]) / math.sqrt((var[0] + var[1]) / 2))
    elif test == "anova":
        grand = (n * mean).sum() / n.sum()
        between, within = (n * (mean - grand) ** 2).sum(), ((n - 1) * var).sum()
        stat = (between / (k - 1)) / (within / (n.sum() - k))
        p, effect = tails.f_upper(stat, k - 1, n.sum() - k), ("eta2", between / (between + within))
    else:
        sums, ties = rank_sums(df, value, group)
        got, tie = {r["grupo"]: r for r in sums.collect()}, ties.first()
        total, t = float(tie["n"]), tie["empates"]
        r = np.array([got[g]["soma_postos"] for g in names], float)
        if test == "mannwhitney":
            stat = r[0] - n[0] * (n[0] + 1) / 2
            mu = n[0] * n[1] / 2
            sd = math.sqrt(n[0] * n[1] / 12 * (total + 1 - t / (total * (total - 1))))
            p = min(2 * tails.normal_cdf(-(max(stat, n[0] * n[1] - stat) - mu - 0.5) / sd), 1.0)
            effect = ("rank_biserial", 1 - 2 * stat / (n[0] * n[1]))
        else:
            h = 12 / (total * (total + 1)) * (r ** 2 / n).sum() - 3 * (total + 1)
            stat = h / (1 - t / (total ** 3 - total))
            p, effect = tails.chi2_upper(stat, k - 1), ("epsilon2", (stat - k + 1) / (total - k))
    return {"teste": test, "regra": rule, "estatistica": float(stat), "p_valor": float(p), "significativo": p < alpha,
            "tamanho_efeito": (effect[0], float(effect[1])),
            "grupos": {g: {"n": info[g]["n"], "media": info[g]["media"], "mediana": info[g]["mediana"]} for g in names}}


# --------------------------------------------------------------- categories
def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, esperado) of every pair of values seen on either side."""
    cells = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    ra = cells.groupBy(a).agg(F.sum("n").alias("__a"))
    rb = cells.groupBy(b).agg(F.sum("n").alias("__b"))
    total = cells.agg(F.sum("n").alias("__t"))
    return cells.join(ra, a).join(rb, b).join(F.broadcast(total)).select(
        a, b, "n", (F.col("__a") * F.col("__b") / F.col("__t")).alias("esperado"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (chi2, n, linhas, colunas, cramers_v). Cells never seen add their
    expected count, which is the total minus the expected counts of seen cells."""
    seen = crosstab(df, a, b)
    out = seen.agg(
        F.sum(F.pow(F.col("n") - F.col("esperado"), 2) / F.col("esperado")).alias("__c"),
        F.sum("n").alias("n"), F.sum("esperado").alias("__e"),
        F.count_distinct(a).alias("linhas"), F.count_distinct(b).alias("colunas"))
    chi2 = F.col("__c") + (F.col("n") - F.col("__e"))
    return out.withColumn("chi2", chi2).withColumn("cramers_v", F.sqrt(F.try_divide(
        F.col("chi2"), F.col("n") * (F.least("linhas", "colunas") - 1)))).select("chi2", "n", "linhas", "colunas", "cramers_v")


def categorical_test(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> dict:
    """Chi-square (with Yates' correction on 2x2), or Fisher for a small 2x2 table."""
    tails = Tails(df.sparkSession)
    row = chi_square(df, a, b).first()
    dof = (row["linhas"] - 1) * (row["colunas"] - 1)
    chi2, test = row["chi2"], "qui_quadrado"
    if (row["linhas"], row["colunas"]) == (2, 2):
        cells = {(r[0], r[1]): r["n"] for r in crosstab(df, a, b).collect()}
        xs, ys = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
        t = np.array([[cells.get((x, y), 0) for y in ys] for x in xs], float)
        exp = t.sum(1, keepdims=True) @ t.sum(0, keepdims=True) / t.sum()
        diff = np.abs(t - exp)
        chi2 = float(((diff - np.minimum(0.5, diff)) ** 2 / exp).sum())
        p = tails.chi2_upper(chi2, dof)
        if (exp >= 5).mean() < 0.8:
            test, dist = "fisher_exato", tails.hypergeometric(int(t.sum()), int(t[0].sum()), int(t[:, 0].sum()))
            here = dist.probability(int(t[0, 0]))
            lo, hi = max(0, int(t[0].sum() + t[:, 0].sum() - t.sum())), int(min(t[0].sum(), t[:, 0].sum()))
            p = float(min(sum(q for q in (dist.probability(i) for i in range(lo, hi + 1)) if q <= here * (1 + 1e-7)), 1.0))
    else:
        p = tails.chi2_upper(chi2, dof) if dof else float("nan")
    small = min(row["linhas"], row["colunas"]) - 1
    return {"teste": test, "chi2": float(chi2), "p_valor": p, "significativo": p < alpha, "graus_liberdade": dof,
            "cramers_v": math.sqrt(chi2 / (row["n"] * small)) if small else float("nan")}


def eta_squared(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: share of the variance of `value` between groups."""
    return eta_squared_pairs(df, [(value, group)]).select("eta2")


def eta_squared_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(par, eta2): share of the variance of a value between groups for every (value, group), numbered from 0.
    All pairs go through one aggregate in long form; groups are told apart by their text."""
    cells = [F.struct(F.lit(i).alias("par"), F.col(v).cast("double").alias("v"), F.col(g).cast("string").alias("g"))
             for i, (v, g) in enumerate(pairs)]
    per = (df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").filter("v is not null and not isnan(v) and g is not null")
           .groupBy("par", "g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")))
    whole = per.groupBy("par").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("__g"))   # one row a pair
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("__g"), 2))
    names = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("par"))
    return names.join(per.join(F.broadcast(whole), "par").groupBy("par").agg(
        F.try_divide(between, between + F.sum(F.col("n") * F.col("s"))).alias("eta2")), "par", "left")


def rank_features(df: DataFrame, target: str, columns: Sequence[str] | None = None, max_categories: int = 50) -> DataFrame:
    """(feature, tipo_relacao, medida, forca) of every column against a target, strongest first. Columns
    with too many categories and those without a measure stay, with a null, at the end."""
    columns = [c for c in (columns or df.columns) if c != target]
    sizes = df.agg(*[F.count_distinct(c).alias(c) for c in [target, *columns]]).first()
    number = is_numeric(df, target) and sizes[target] > 20
    spark, parts = df.sparkSession, []
    many = [c for c in columns if not is_numeric(df, c) and sizes[c] > max_categories]
    numbers = [c for c in columns if is_numeric(df, c)]
    texts = [c for c in columns if c not in numbers and c not in many]
    if number and numbers:
        parts.append(spearman_pairs(df, pairs=[(c, target) for c in numbers]).select(
            F.col("var_1").alias("feature"), F.lit("num x num").alias("tipo_relacao"), F.lit("|spearman|").alias("medida"),
            F.abs("r").alias("forca")))
    groups = [(target, c) for c in texts] if number else [(c, target) for c in numbers]
    if groups:
        name = F.element_at(F.array(*[F.lit(c) for c in (texts if number else numbers)]), F.col("par") + 1)
        parts.append(eta_squared_pairs(df, groups).select(
            name.alias("feature"), F.lit("cat x num" if number else "num x cat").alias("tipo_relacao"), F.lit("eta2").alias("medida"),
            F.col("eta2").alias("forca")))
    parts += [chi_square(df, c, target).select(F.lit(c).alias("feature"), F.lit("cat x cat").alias("tipo_relacao"),
                                               F.lit("cramers_v").alias("medida"), F.col("cramers_v").alias("forca"))
              for c in (texts if not number else [])]
    parts.append(spark.createDataFrame([(c, "categorias demais", None, None) for c in many],
                                       "feature string, tipo_relacao string, medida string, forca double"))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc_nulls_last("forca"), "feature")


# -------------------------------------------------------------------- intervals
def interval(df: DataFrame, column: str, kind: str = "media", level: float = 0.95, key: Sequence[str] | None = None,
             replicates: int = 200, seed: int = 42) -> dict:
    """Mean (t), proportion of 0/1 (Wilson) or median (bootstrap)."""
    tails, tail = Tails(df.sparkSession), (1 - level) / 2
    c = F.col(column).cast("double")
    row = df.agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s"),
                 F.count_if(~c.isin(0.0, 1.0)).alias("bad")).first()
    n, m = row["n"], row["m"]
    if kind == "media":
        half = tails.t_quantile(1 - tail, n - 1) * row["s"] / math.sqrt(n)
        centre, lo, hi = m, m - half, m + half
    elif kind == "proporcao":
        if row["bad"]:
            raise ValueError("a proportion needs values 0 and 1 only")
        z = tails.normal_quantile(1 - tail)
        denom = 1 + z * z / n
        mid, half = (m + z * z / (2 * n)) / denom, z * math.sqrt(m * (1 - m) / n + z * z / (4 * n * n)) / denom
        centre, lo, hi = m, mid - half, mid + half
    else:
        boot = bootstrap_median(df, column, key, replicates, seed)
        centre = ordered.quantile_values(df, [column], [0.5])[column][0.5]
        q = ordered.quantile_values(boot, ["valor"], [tail, 1 - tail])["valor"]
        lo, hi = q[tail], q[1 - tail]
    return {"estimativa": centre, "ic_inferior": lo, "ic_superior": hi, "nivel": level, "n": n}


# Distribution function of the Poisson law with mean 1, from 0 copies on to where the rest of the
# probability is below the 2^-52 that a draw can tell apart.
POISSON_ONE = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(19))


def poisson_copies(u: Column) -> Column:
    """Number of copies of a row in a resample, from a uniform draw."""
    out = F.lit(0)
    for p in POISSON_ONE:
        out = out + (u >= F.lit(p)).cast("int")
    return out


def _draws(df: DataFrame, column: str, key: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(v, replica, u): the draw of every row in every resample. Rows are dealt to all cores first, as a small
    file in one task is much work here; a draw is hashed once and then is a value, however often it is compared."""
    v = F.col(column).cast("double")
    rows = df.filter(v.isNotNull()).select(*key, v.alias("v")).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *key)
    draw = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.struct(
        r.alias("replica"), hash_unit(*[F.col(k) for k in key], r, seed=seed).alias("u")))
    return rows.select("v", F.inline(draw))


def bootstrap(df: DataFrame, column: str, key: Sequence[str], replicates: int = 200, seed: int = 42) -> DataFrame:
    """(replica, n, soma, soma2): weighted sums of every resample.

    A row enters a resample with a Poisson(1) number of copies drawn from the hash
    of its key. Sums close inside each task, so what is shuffled is one row per
    resample and task, whatever the size of the data.
    """
    rows, w = _draws(df, column, key, replicates, seed), poisson_copies(F.col("u"))
    return rows.withColumn("w", w).groupBy("replica").agg(
        F.sum("w").cast("long").alias("n"), F.sum(F.col("w") * F.col("v")).alias("soma"),
        F.sum(F.col("w") * F.col("v") * F.col("v")).alias("soma2"))


# weighted statistics of a resample, as expressions of its sums
STATISTICS = {
    "media": lambda: F.col("soma") / F.col("n"),
    "soma": lambda: F.col("soma"),
    "desvio": lambda: F.sqrt((F.col("soma2") - F.col("soma") * F.col("soma") / F.col("n")) / (F.col("n") - 1)),
    "cv": lambda: F.sqrt((F.col("soma2") - F.col("soma") * F.col("soma") / F.col("n")) / (F.col("n") - 1)) / (F.col("soma") / F.col("n")),
}


def bootstrap_interval(df: DataFrame, column: str, key: Sequence[str], statistic: str | Column = "media",
                       replicates: int = 200, level: float = 0.95, seed: int = 42) -> dict:
    """Percentile interval of a statistic: a name, or an expression of n, soma, soma2."""
    expression = STATISTICS[statistic]() if isinstance(statistic, str) else statistic
    values = bootstrap(df, column, key, replicates, seed).select(expression.alias("valor"))
    v = F.col(column).cast("double")
    whole = df.agg(F.count(v).alias("n"), F.sum(v).alias("soma"), F.sum(v * v).alias("soma2")).select(
        expression.alias("valor")).first()["valor"]
    got = np.array([r["valor"] for r in values.collect()])       # one number per resample
    lo, hi = np.percentile(got, [100 * (1 - level) / 2, 100 * (1 + level) / 2])
    return {"estimativa": whole, "ic_inferior": float(lo), "ic_superior": float(hi),
            "erro_padrao_boot": float(got.std(ddof=1)), "nivel": level, "n_reamostras": replicates}


def bootstrap_median(df: DataFrame, column: str, key: Sequence[str], replicates: int = 200, seed: int = 42) -> DataFrame:
    """(replica, valor): weighted median of every resample. The resamples are drawn and written once."""
    w = _draws(df, column, key, replicates, seed).withColumn("w", poisson_copies(F.col("u"))).filter(F.col("u") >= POISSON_ONE[0])
    drawn = table_in_shared_folder(w.select("replica", "v", "w"), "reamostras")
    return ordered.quantiles_wide(drawn, "v", {"valor": 0.5}, ["replica"], weight="w")


def ab_test(df: DataFrame, variant: str, converted: str, a, b, alpha: float = 0.05) -> dict:
    """Rates of two variants from a table of 0/1 outcomes: lift, z, p, interval, power."""
    tails = Tails(df.sparkSession)
    got = {r[variant]: r for r in df.groupBy(variant).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(converted).cast("long")).alias("c")).collect()}
    na, nb, ca, cb = got[a]["n"], got[b]["n"], got[a]["c"], got[b]["c"]
    pa, pb, pool = ca / na, cb / nb, (ca + cb) / (na + nb)
    se = math.sqrt(pool * (1 - pool) * (1 / na + 1 / nb))
    z = (pb - pa) / se if se else float("nan")
    p = tails.normal_two_sided(z) if se else float("nan")
    own = math.sqrt(pa * (1 - pa) / na + pb * (1 - pb) / nb)
    crit, diff = tails.normal_quantile(1 - alpha / 2), pb - pa
    return {"taxa_a": pa, "taxa_b": pb, "diferenca_abs": diff, "lift_relativo_pct": 100 * diff / pa if pa else float("nan"),
            "z": z, "p_valor": p, "significativo": p < alpha, "ic_diferenca": (diff - crit * own, diff + crit * own),
            "poder_observado": tails.normal_cdf(abs(diff) / own - crit) if own else float("nan")}


def ab_rates(df: DataFrame, variant: str, converted: str) -> DataFrame:
    return df.groupBy(variant).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(converted).cast("long")).alias("conversoes"),
                                   F.avg(F.col(converted).cast("double")).alias("taxa"))


# ----------------------------------------------------------------- distributions
# First coefficients of the uniform expansion of the incomplete gamma function
# (Temme 1979) in powers of eta, for shape^0 and shape^-1.
TEMME_0 = (-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -139 / 777600)
TEMME_1 = (-1 / 540, -1 / 288, 1 / 378, -77 / 77760)
LARGE_SHAPE = 1e4


def _gamma_large(x: np.ndarray, shape: float) -> np.ndarray:
    """Lower incomplete gamma function for large shapes: a normal law in eta and a correction."""
    mu = x / shape - 1
    eta = np.sign(mu) * np.sqrt(2 * np.maximum(mu - np.log1p(np.maximum(mu, -1 + 1e-300)), 0))
    near = np.abs(mu) < 0.05
    safe = np.where(near, 1.0, mu)
    far = np.where(near, 1.0, eta)
    c0 = np.where(near, np.polynomial.polynomial.polyval(eta, TEMME_0), 1 / safe - 1 / far)
    c1 = np.where(near, np.polynomial.polynomial.polyval(eta, TEMME_1), 1 / far ** 3 - 1 / safe ** 3 - 1 / safe ** 2 - 1 / (12 * safe))
    bell = np.exp(-shape * eta * eta / 2) / math.sqrt(2 * math.pi * shape)
    normal = np.array([0.5 * math.erfc(-e * math.sqrt(shape / 2)) for e in eta])
    return np.clip(normal - bell * (c0 + c1 / shape), 0, 1)


def _gamma_series(x: np.ndarray, shape: float) -> np.ndarray:
    """The same by its power series below shape + 1 and its continued fraction above, each until
    nothing changes any more."""
    front = np.exp(shape * np.log(x) - x - math.lgamma(shape))
    below = x < shape + 1
    out = np.empty_like(x)
    v = x[below]
    term = total = np.full_like(v, 1 / shape)
    k = 0
    while len(v) and np.any(term > total * 1e-17):
        k += 1
        term = term * v / (shape + k)
        total = total + term
    out[below] = front[below] * total
    v = x[~below]
    b = v + 1 - shape
    c, d = np.full_like(v, 1e300), 1 / b
    h, change, i = d.copy(), np.full_like(v, 2.0), 0
    while len(v) and np.any(np.abs(change - 1) > 1e-15):
        i += 1
        a = -i * (i - shape)
        b = b + 2
        d = 1 / (a * d + b)
        c = b + a / c
        change = c * d
        h = h * change
    out[~below] = 1 - front[~below] * h
    return out


def gamma_cdf(shape: float, scale: float):
    """Regularised lower incomplete gamma function of `valor / scale`, in Arrow batches."""
    @F.pandas_udf("double")
    def cdf(v: pd.Series) -> pd.Series:
        x = np.maximum(v.to_numpy(dtype=float) / scale, 0.0)
        out = np.where(np.isnan(x), np.nan, 0.0)
        inside = x > 0
        with np.errstate(all="ignore"):
            out[inside] = (_gamma_large if shape > LARGE_SHAPE else _gamma_series)(x[inside], shape)
        return pd.Series(out)
    return cdf


def fit_distributions(df: DataFrame, column: str, candidates: Sequence[str] = (
        "norm", "lognorm", "expon", "gamma", "weibull_min", "uniform")) -> DataFrame:
    """Maximum-likelihood fits ranked by Kolmogorov-Smirnov p-value. Positive
    families start at 0 and use the positive rows only."""
    spark, v = df.sparkSession, F.col(column).cast("double")
    logs = F.when(v > 0, F.ln(v))
    s = df.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"),
               F.avg(F.when(v > 0, v)).alias("pm"), F.avg(logs).alias("lm"), F.stddev_pop(logs).alias("ls"),
               F.count(logs).alias("pn")).first()
    x, rows = F.col("valor"), []
    for name in candidates:
        if name in ("lognorm", "gamma", "weibull_min") and not s["pn"]:
            continue
        if name == "norm":
            params, cdf = (s["m"], s["s"]), normal_cdf((x - s["m"]) / s["s"])
        elif name == "lognorm":
            params, cdf = (s["lm"], s["ls"]), F.when(x <= 0, 0.0).otherwise(normal_cdf((F.ln(x) - s["lm"]) / s["ls"]))
        elif name == "expon":
            params, cdf = (s["lo"], s["m"] - s["lo"]), 1 - F.exp(-(x - s["lo"]) / (s["m"] - s["lo"]))
        elif name == "uniform":
            params, cdf = (s["lo"], s["hi"] - s["lo"]), (x - s["lo"]) / (s["hi"] - s["lo"])
        elif name == "gamma":
            params = _fit_gamma(s["pm"], s["lm"])
            cdf = gamma_cdf(*params)(x)
        elif name == "weibull_min":
            params = _fit_weibull(df, column, s["lm"], s["ls"])
            cdf = F.when(x <= 0, 0.0).otherwise(1 - F.exp(-F.pow(x / params[1], F.lit(params[0]))))
        else:
            raise ValueError(f"unknown distribution {name}")
        data = df.filter(v > 0) if name in ("lognorm", "gamma", "weibull_min") else df
        row = ks_distance(data, column, cdf).first()
        rows.append((name, float(params[0]), float(params[1]), float(row["d"]), ks_p_value(row["d"], row["n"])))
    rows.sort(key=lambda r: (-r[4], r[3]))
    return spark.createDataFrame(rows, "distribuicao string, p1 double, p2 double, ks_stat double, p_valor double")


def _psi(x: float) -> tuple[float, float]:
    a = b = 0.0
    while x < 10:
        a, b, x = a - 1 / x, b + 1 / x ** 2, x + 1
    i2 = 1 / (x * x)
    return (a + math.log(x) - 0.5 / x - i2 * (1 / 12 - i2 * (1 / 120 - i2 / 252)),
            b + 1 / x + i2 / 2 + i2 / x * (1 / 6 - i2 * (1 / 30 - i2 / 42)))


def _fit_gamma(mean: float, log_mean: float) -> tuple[float, float]:
    gap = max(math.log(mean) - log_mean, 1e-12)
    k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(50):
        psi, psi1 = _psi(k)
        new = k - (math.log(k) - psi - gap) / (1 / k - psi1)
        if abs(new - k) < 1e-12 * k:
            break
        k = max(new, k / 10)
    return k, mean / k


def _fit_weibull(df: DataFrame, column: str, log_mean: float, log_dev: float) -> tuple[float, float]:
    """Shape by Newton steps, each from three sums; scale in closed form."""
    v = F.col(column).cast("double")
    rows = df.filter(v > 0).select((F.ln(v) - F.lit(log_mean)).alias("l"))
    k = math.pi / (math.sqrt(6) * max(log_dev, 1e-6))
    for _ in range(40):
        w = F.exp(F.lit(k) * F.col("l"))
        r = rows.agg(F.sum(w).alias("a"), F.sum(w * F.col("l")).alias("b"), F.sum(w * F.col("l") * F.col("l")).alias("c"),
                     F.avg(w).alias("m")).first()
        g = r["b"] / r["a"] - 1 / k
        slope = r["c"] / r["a"] - (r["b"] / r["a"]) ** 2 + 1 / k ** 2
        new = max(k - g / slope, k / 5)
        if abs(new - k) < 1e-10 * k:
            k = new
            break
        k = new
    mean = rows.agg(F.avg(F.exp(F.lit(k) * F.col("l"))).alias("m")).first()["m"]
    return k, math.exp(log_mean) * mean ** (1 / k)


# ----------------------------------------------------------------------- robust
def robust(df: DataFrame, column: str, trim: float = 0.1) -> DataFrame:
    """One row: mean, median, deviation, scaled MAD, trimmed and winsorised mean, IQR."""
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    q = ordered.quantile_values(rows, ["v"], [0.25, 0.5, 0.75])["v"]
    away = rows.select(F.abs(F.col("v") - F.lit(q[0.5])).alias("a"))
    mad = ordered.quantile_values(away, ["a"], [0.5])["a"][0.5]
    # counts per value in order tell how many copies of a value each cut keeps
    table = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    n = rows.count()
    k = int(trim * n)
    run = ordered.running_sums(table, [], "v", {"ate": "n"})
    kept = F.greatest(F.least(F.col("ate"), F.lit(n - k)) - F.greatest(F.col("ate") - F.col("n"), F.lit(k)), F.lit(0))
    low = F.min(F.when(F.col("ate") > k, F.col("v")))
    high = F.max(F.when(F.col("ate") - F.col("n") < n - k, F.col("v")))
    cuts = run.agg((F.sum(kept * F.col("v")) / F.lit(n - 2 * k)).alias("media_aparada"),
                   low.alias("__lo"), high.alias("__hi"), F.sum(kept * F.col("v")).alias("__s"))
    base = rows.agg(F.avg("v").alias("media"), F.stddev_samp("v").alias("desvio_padrao"))
    return base.join(F.broadcast(cuts)).select(
        "media", F.lit(q[0.5]).alias("mediana"), "desvio_padrao", F.lit(mad * MAD_SCALE).alias("mad_escalado"), "media_aparada",
        ((F.col("__s") + F.lit(k) * (F.col("__lo") + F.col("__hi"))) / F.lit(n)).alias("media_winsorizada"),
        F.lit(q[0.75] - q[0.25]).alias("iqr"))


# Fixed value: 1 / quantile 0.75 of the normal curve.
MAD_SCALE = 1.482602218505602
