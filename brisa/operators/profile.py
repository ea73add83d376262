"""Profiles of columns: quality, summaries, histograms, boxes, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from brisa.operators import ordered
from brisa.operators.cleaning import is_numeric, numeric_columns



def corrected_shape(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, coluna, n, media, desvio, assimetria, curtose) with the bias correction."""
    long = ordered.unpivot(df, columns, by)
    out = long.groupBy(*by, "coluna").agg(
        F.count("valor").alias("n"), F.avg("valor").alias("media"), F.stddev_samp("valor").alias("desvio"),
        F.skewness("valor").alias("__g1"), F.kurtosis("valor").alias("__g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("__g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("__g2") + 6))
    return out.withColumns({"assimetria": skew, "curtose": kurt}).drop("__g1", "__g2")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(coluna, valor, n) of every distinct non-null value, as text, in one shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).cast("string").alias("valor")) for c in columns])
    return (df.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("valor").isNotNull())
            .groupBy("coluna", "valor").agg(F.count(F.lit(1)).alias("n")))


def quality_report(df: DataFrame, columns: Sequence[str] | None = None, high_cardinality: int = 50) -> DataFrame:
    """Per column: type, nulls, distinct values, share of the top value, examples, flags."""
    columns = list(columns or [n for n, t in df.dtypes if not t.startswith(("array", "map", "struct"))])
    types = dict(df.dtypes)
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    per = value_counts(df, columns).groupBy("coluna").agg(
        F.count(F.lit(1)).alias("unicos"), F.max("n").alias("__top"), F.sum("n").alias("__ok"))
    first = df.agg(*[F.min(F.col(c).cast("string")).alias(c) for c in columns])
    names = df.sparkSession.createDataFrame(
        [(c, types[c], i) for i, c in enumerate(columns)], "coluna string, tipo string, ordem int")
    example = first.select(F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).alias("exemplo"))
                                               for c in columns])).alias("x")).select("x.*")
    full = (F.broadcast(names).join(per, "coluna", "left").join(example, "coluna", "left")
            .join(F.broadcast(total)).withColumns({
                "unicos": F.coalesce("unicos", F.lit(0)), "__ok": F.coalesce("__ok", F.lit(0))}))
    nulls = F.col("__n") - F.col("__ok")
    share = F.try_divide(F.col("__top"), F.col("__ok"))
    flags = F.concat_ws(
        " | ",
        F.when(F.col("unicos") <= 1, "constante").when(share > 0.95, "quase_constante"),
        F.when((F.col("unicos") == F.col("__ok")) & (F.col("unicos") > 1), "possivel_id"),
        F.when((F.col("tipo") == "string") & (F.col("unicos") > high_cardinality), "alta_cardinalidade"),
        F.when(F.try_divide(nulls, F.col("__n")) > 0.5, "muitos_nulos"))
    return full.select(
        "coluna", "tipo", nulls.alias("nulos"),
        F.coalesce(F.round(F.try_divide(100.0 * nulls, F.col("__n")), 2), F.lit(0.0)).alias("pct_nulos"), "unicos",
        F.round(100 * share, 1).alias("pct_top_valor"), "exemplo", flags.alias("flags"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows and rows that repeat an earlier one."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("linhas"), F.sum(F.col("n") - 1).alias("duplicadas"))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None,
                    percentiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Count, mean, deviation, extremes, exact percentiles, skew, kurtosis, CV, nulls. A column without
    values has a row with a count of 0."""
    columns = list(columns or numeric_columns(df))
    shape = corrected_shape(df, columns)
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    ends = ordered.unpivot(df, columns).groupBy("coluna").agg(F.min("valor").alias("min"), F.max("valor").alias("max"))
    q = ordered.quantiles(df, columns, percentiles).groupBy("coluna").agg(*[
        F.max(F.when(F.col("p") == float(p), F.col("valor"))).alias(f"p{round(100 * p):02d}") for p in percentiles])
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "coluna string")
    out = (F.broadcast(names).join(shape, "coluna", "left").join(ends, "coluna", "left").join(q, "coluna", "left")
           .join(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0))))
    return out.withColumns({"cv": F.try_divide("desvio", "media"), "nulos": F.col("__n") - F.col("n"),
                            "pct_nulos": 100.0 * (F.col("__n") - F.col("n")) / F.col("__n")}).drop("__n")


def null_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(coluna, nulos, pct) in one pass."""
    columns = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).alias("nulos"),
                               F.try_divide(100.0 * F.col(c), F.col("__n")).alias("pct")) for c in columns])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(faixa, inicio, fim, n) of equal-width bins with the mean and median of the column; no bin without values."""
    lo, hi, mean = df.agg(F.min(column).cast("double"), F.max(column).cast("double"), F.avg(column)).first()
    median = ordered.quantile_values(df, [column], [0.5])[column].get(0.5)
    width = (hi - lo) / bins or 1.0 if lo is not None else None
    start, step = F.lit(lo).cast("double"), F.lit(width).cast("double")
    place = F.least(F.floor((F.col(column).cast("double") - start) / step), F.lit(bins - 1)).cast("long")
    counts = df.filter(F.col(column).isNotNull()).groupBy(place.alias("faixa")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("faixa", (start + F.col("faixa") * step).alias("inicio"),
                         (start + (F.col("faixa") + 1) * step).alias("fim"), "n",
                         F.lit(mean).cast("double").alias("media"), F.lit(median).cast("double").alias("mediana"))


def box_table(df: DataFrame, group: str, column: str, n: int = 10) -> DataFrame:
    """Quartiles, extremes and whiskers of the n most frequent groups."""
    top = (df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
           .orderBy(F.desc("__n"), group).limit(n).select(group))
    kept = df.join(F.broadcast(top), group, "left_semi")
    q = ordered.quantiles_wide(kept, column, {"q1": 0.25, "mediana": 0.5, "q3": 0.75}, [group])
    ends = kept.groupBy(group).agg(F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"),
                                   F.count(column).alias("n"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return q.join(ends, group).withColumns({"limite_inferior": F.greatest(F.col("min"), F.col("q1") - reach),
                                            "limite_superior": F.least(F.col("max"), F.col("q3") + reach)})


def trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and correlation of two columns."""
    rows = df.dropna(subset=[x, y])
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    aggs = [F.regr_slope(b, a).alias("inclinacao"), F.regr_intercept(b, a).alias("intercepto"),
            F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def column_profile(df: DataFrame, column: str, top: int = 10, rare: float = 0.01) -> dict:
    """One numeric or categorical column: location, spread, outliers, or categories."""
    base = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).isNull()).alias("nulos")).first()
    out = {"coluna": column, "n": base["n"], "nulos": base["nulos"]}
    if is_numeric(df, column):
        s = numeric_summary(df, [column], (0.25, 0.5, 0.75)).first()
        outside = 0
        if s["n"]:
            reach = 1.5 * (s["p75"] - s["p25"])
            outside = df.agg(F.count_if((F.col(column) < s["p25"] - reach) | (F.col(column) > s["p75"] + reach))).first()[0]
        return out | {"tipo": "numerica", "media": s["media"], "mediana": s["p50"], "desvio": s["desvio"],
                      "min": s["min"], "max": s["max"], "assimetria": s["assimetria"], "outliers_iqr": outside}
    counts = value_counts(df, [column]).cache()
    total = base["n"] - base["nulos"]
    kinds = counts.agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") < rare * total).alias("r")).first()
    best = counts.orderBy(F.desc("n"), "valor").limit(top).collect()
    counts.unpersist()
    return out | {"tipo": "categorica", "cardinalidade": kinds["k"], "n_raras": kinds["r"],
                  "top": {r["valor"]: r["n"] for r in best}}


def rare_categories(df: DataFrame, column: str, share: float = 0.01) -> DataFrame:
    """Values that hold less than a share of the non-null rows."""
    counts = value_counts(df, [column])
    total = counts.agg(F.sum("n").alias("__t"))
    return counts.join(F.broadcast(total)).filter(F.col("n") < F.lit(share) * F.col("__t")).select("valor", "n")


def normal_quantile_pairs(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """(p, teorico, observado): exact quantiles against those of the normal curve."""
    from brisa.session import Tails
    tails = Tails(df.sparkSession)
    probs = [i / (points + 1) for i in range(1, points + 1)]
    grid = df.sparkSession.createDataFrame([(float(p), tails.normal_quantile(p)) for p in probs], "p double, teorico double")
    return ordered.quantiles(df, [column], probs).select("p", F.col("valor").alias("observado")).join(F.broadcast(grid), "p")


def hash_sample(df: DataFrame, key: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """Rows whose key draws below a share; the same rows on every run."""
    from brisa.functions.numeric import hash_unit
    return df.filter(hash_unit(*[F.col(k) for k in key], seed=seed) < share)


