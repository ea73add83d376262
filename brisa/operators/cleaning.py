"""Duplicates, nulls, outliers, encodings, scales and class balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brisa.functions.numeric import hash_unit
from brisa.functions.quality import check_rows  # noqa: F401  (part of the cleaning API)
from brisa.operators import ordered
from brisa.session import cut
from brisa.sources.readers import POSITION, with_position


# ------------------------------------------------------------------ duplicates
def deduplicate(df: DataFrame, key: Sequence[str], order: Sequence[str] | None = None,
                keep: str = "last") -> DataFrame:
    """One row per key: the first or last, or none of the repeated ones.

    `order` columns decide, and then the place of the row: file, and row in the file. Without
    `order` it is that place alone, so `df` should come straight from its source. An aggregate with
    map-side combine, so a key that repeats a billion times leaves each map task as one row.
    """
    if keep not in ("first", "last", "none"):
        raise ValueError("keep is first, last or none")
    columns, key = df.columns, list(key)
    rest = [c for c in columns if c not in key]
    placed = df if set(POSITION) <= set(columns) else with_position(df)
    row = F.struct(*[f"`{c}`" for c in rest]) if rest else F.lit(1)
    rank = F.struct(*(order or []), *POSITION)
    pick = F.min_by(row, rank) if keep == "first" else F.max_by(row, rank)
    out = placed.groupBy(*key).agg(pick.alias("__row"), F.count(F.lit(1)).alias("__n"))
    if keep == "none":
        out = out.filter("__n = 1")
    return out.select(*[F.col(c) if c in key else F.col(f"__row.`{c}`").alias(c) for c in columns])


def duplicate_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(linhas, chaves, removidas) of a de-duplication by key."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("linhas"), F.count(F.lit(1)).alias("chaves"),
                      F.sum(F.col("n") - 1).alias("removidas"))


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Return `df`, or stop when a key repeats."""
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    worst = repeated.agg(F.count(F.lit(1)).alias("chaves"), F.sum("n").alias("linhas")).first()
    if worst["chaves"]:
        raise ValueError(f"{worst['linhas']} rows share {worst['chaves']} keys of {list(key)}")
    return df


# ----------------------------------------------------------------------- nulls
def modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """Most frequent value per column, the smallest when tied; null for a column without values.
    All columns in one pass: counts per (column, value), then the best of each column."""
    if not columns:
        return {}
    names = [f"v{j}" for j in range(len(columns))]
    types = dict(df.dtypes)
    cells = [F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("c"), *[
        (F.col(c) if i == j else F.lit(None).cast(types[d])).alias(names[j]) for j, d in enumerate(columns)])) for i, c in enumerate(columns)]
    long = df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
    counts = long.groupBy("c", *names).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("c").agg(F.min_by(F.struct(*names), F.struct(-F.col("n"), *names)).alias("t")).collect()
    best = {r["c"]: r["t"][f"v{r['c']}"] for r in top}
    return {c: best.get(j) for j, c in enumerate(columns)}


def is_numeric(df: DataFrame, column: str) -> bool:
    kind = dict(df.dtypes)[column]
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def null_indicator(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_era_nulo": F.col(c).isNull() for c in columns})


def fill_nulls(df: DataFrame, strategy: str, columns: Sequence[str] | None = None,
               constant=0) -> DataFrame:
    """Fill with 'media', 'mediana', 'moda' or 'constante'; the values come from
    one small aggregate, the fill is an expression."""
    columns = list(columns or df.columns)
    if strategy in ("media", "mediana"):
        columns = [c for c in columns if is_numeric(df, c)]
    if strategy == "media":
        row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        values = {c: row[c] for c in columns}
    elif strategy == "mediana":
        values = {c: q.get(0.5) for c, q in ordered.quantile_values(df, columns, [0.5]).items()}
    elif strategy == "moda":
        values = modes(df, columns)
    elif strategy == "constante":
        values = {c: constant for c in columns}
    else:
        raise ValueError(f"unknown strategy {strategy}")
    types = dict(df.dtypes)
    keep_type = strategy in ("moda", "constante")
    return df.withColumns({
        c: F.coalesce(F.col(c) if keep_type else F.col(c).cast("double"),
                      F.lit(v).cast(types[c]) if keep_type else F.lit(v))
        for c, v in values.items() if v is not None})


def fill_along(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str],
               step_seconds: int = 3600, *, backward: bool = False, length: int = 720) -> DataFrame:
    """Forward or backward fill in time order; series are split in time chunks."""
    chunk = F.floor(ordered.time_index(time, step_seconds) / length)
    return ordered.carry(df, keys, time, columns, chunk, backward=backward)


def interpolate_along(df: DataFrame, keys: Sequence[str], time: str, column: str,
                      step_seconds: int = 3600, length: int = 720) -> DataFrame:
    """Linear fill of every gap on a regular grid; ends take the nearest value."""
    i = ordered.time_index(time, step_seconds)
    known = F.when(F.col(column).isNotNull(), F.struct(i.alias("i"), F.col(column).alias("v")))
    base = df.withColumn("__i", i).withColumn("__v", known)
    base = ordered.neighbours(base, keys, time, ["__v"], F.floor(F.col("__i") / length))
    p, n = F.col("__before___v"), F.col("__after___v")
    line = p["v"] + (n["v"] - p["v"]) * (F.col("__i") - p["i"]) / (n["i"] - p["i"])
    value = (F.when(F.col(column).isNotNull(), F.col(column))
             .when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).otherwise(line))
    return base.withColumn(column, value).drop("__i", "__v", "__before___v", "__after___v")


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def drop_null_columns(df: DataFrame, share: float = 0.5) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("__all"), *[F.count(c).alias(c) for c in df.columns]).first()
    total = max(row["__all"], 1)
    return df.drop(*[c for c in df.columns if 1 - row[c] / total > share])


def group_mean_fill(df: DataFrame, column: str, groups: Sequence[str], marker: str | None = None) -> DataFrame:
    """Fill with the mean of the group, else the overall mean; `marker` says where.

    Group means are a small aggregate joined back, not a window over the group.
    """
    means = df.groupBy(*groups).agg(F.avg(column).alias("__g"))
    overall = df.agg(F.avg(column).alias("__all"))
    joined = ordered.null_safe(df, means, groups, "left").join(F.broadcast(overall))
    filled = joined.withColumn(marker or f"{column}_imputado", F.col(column).isNull())
    return filled.withColumn(column, F.coalesce(column, "__g", "__all")).drop("__g", "__all")


# -------------------------------------------------------------------- outliers
def outlier_limits(df: DataFrame, columns: Sequence[str], method: str = "iqr", *, factor: float = 1.5,
                   z: float = 3.0, quantiles: tuple[float, float] = (0.01, 0.99)) -> dict:
    """{column: (low, high)} from exact quartiles, deviation or quantiles; (None, None) where they have no value."""
    if method == "zscore":
        row = df.agg(*[e for c in columns for e in (F.avg(c).alias(f"m_{c}"),
                                                    F.stddev_samp(c).alias(f"s_{c}"))]).first()
        return {c: (None, None) if row[f"s_{c}"] is None else
                (row[f"m_{c}"] - z * row[f"s_{c}"], row[f"m_{c}"] + z * row[f"s_{c}"]) for c in columns}
    probs = {"iqr": (0.25, 0.75), "quantil": quantiles}[method]
    found = ordered.quantile_values(df, columns, probs)
    out = {}
    for c in columns:
        lo, hi = (found[c][float(p)] for p in probs)
        reach = factor * (hi - lo) if method == "iqr" and lo is not None else 0.0
        out[c] = (None, None) if lo is None else (lo - reach, hi + reach)
    return out


def treat_outliers(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr",
                   action: str = "remover", **options) -> DataFrame:
    """'remover' drops rows, 'limitar' clips, 'marcar' adds `_outlier`; nulls are kept, and a column
    without limits (no value, or one value and a deviation) has no outlier."""
    columns = list(columns or numeric_columns(df))
    limits = outlier_limits(df, columns, method, **options)
    if action == "limitar":
        return df.withColumns({
            c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi)))
            for c, (lo, hi) in limits.items() if lo is not None})
    outside = F.lit(False)
    for c, (lo, hi) in limits.items():
        if lo is not None:
            outside = outside | F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))
    return df.withColumn("_outlier", outside) if action == "marcar" else df.filter(~outside)


# ------------------------------------------------------------------- encodings
def categories(df: DataFrame, column: str, limit: int) -> list | None:
    """Sorted distinct values, or None when there are more than `limit`."""
    values = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct()
              .limit(limit + 1).collect()]
    return None if len(values) > limit else sorted(values)


def one_hot(df: DataFrame, columns: Sequence[str], max_categories: int = 20,
            drop_first: bool = False) -> DataFrame:
    """0/1 columns `column_value`; columns with more categories stay as they are."""
    for c in columns:
        values = categories(df, c, max_categories)
        if values is None:
            continue
        df = df.withColumns({
            f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
            for v in (values[1:] if drop_first else values)}).drop(c)
    return df


def label_encode(df: DataFrame, column: str, target: str | None = None) -> DataFrame:
    """Position of the value in alphabetical order, from 0; null stays null."""
    target = target or column
    table = ordered.row_numbers(df.select(F.col(column).alias("__v")).filter("__v is not null").distinct(),
                                ["__v"], "__code", start=0)
    joined = df.join(table, df[column] == F.col("__v"), "left")
    return joined.withColumn(target, F.col("__code").cast("long")).drop("__v", "__code")


def ordinal_encode(df: DataFrame, order: Mapping[str, Sequence]) -> DataFrame:
    changes = {}
    for c, values in order.items():
        code = None
        for i, v in enumerate(values):
            code = F.when(F.col(c) == F.lit(v), i) if code is None else code.when(F.col(c) == F.lit(v), i)
        changes[c] = code
    return df.withColumns(changes)


#: Categories up to which their table travels to the tasks.
FEW_CATEGORIES = 10_000


def _by_category(df: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Add `__s` of the category of each row; `table` has one row per category: __v, __s and its rows, __n.
    Rows of a category are never brought together in one task: few categories travel, of many the heavy ones."""
    table = cut(table.filter("__v is not null"))
    if table.limit(FEW_CATEGORIES + 1).count() <= FEW_CATEGORIES:
        return df.join(F.broadcast(table.select("__v", "__s")), df[column] == F.col("__v"), "left").drop("__v")
    total = table.agg(F.sum("__n")).first()[0]
    known = ordered.attach_by_value(df.withColumn("__v", F.col(column)), table, "__v", "__n", total)
    return known.select(*df.columns, "__s").unionByName(
        df.filter(F.col(column).isNull()).withColumn("__s", F.lit(None).cast(table.schema["__s"].dataType)))


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    """Replace a value by its share among the non-null rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"))
    shares = counts.join(F.broadcast(total)).select("__v", "__n", (F.col("__n") / F.col("__t")).alias("__s"))
    return _by_category(df, shares, column).withColumn(column, F.col("__s")).drop("__s")


def target_encode(df: DataFrame, column: str, target: str) -> DataFrame:
    means = df.groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"), F.avg(target).alias("__s"))
    return _by_category(df, means, column).withColumn(column, F.col("__s")).drop("__s")


# ---------------------------------------------------------------------- scales
@dataclass(frozen=True)
class Scale:
    """Fitted scale: (value - centre) / width per column, or a logarithm."""
    method: str
    centre: Mapping[str, float]
    width: Mapping[str, float]
    log1p: frozenset = frozenset()

    def expression(self, column: str) -> Column:
        c = F.col(column).cast("double")
        if self.method in ("log", "log1p"):
            return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0)))) if column in self.log1p else F.ln(c)
        return (c - F.lit(self.centre[column]).cast("double")) / F.lit(self.width[column])

    def apply(self, df: DataFrame) -> DataFrame:
        columns = self.centre if self.centre else self.log1p
        return df.withColumns({c: self.expression(c) for c in columns})


def fit_scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> Scale:
    """Parameters of 'standard' (population deviation), 'minmax', 'robust', 'log', 'log1p'; a column without values stays null."""
    columns = list(columns)
    if method == "log1p":
        return Scale(method, dict.fromkeys(columns, 0.0), dict.fromkeys(columns, 1.0), frozenset(columns))
    row = df.agg(*[e for c in columns for e in (
        F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"),
        F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))]).first()
    if method == "log":
        return Scale(method, dict.fromkeys(columns, 0.0), dict.fromkeys(columns, 1.0),
                     frozenset(c for c in columns if row[f"lo_{c}"] is not None and row[f"lo_{c}"] <= 0))
    if method == "standard":
        centre, width = {c: row[f"m_{c}"] for c in columns}, {c: row[f"s_{c}"] for c in columns}
    elif method == "minmax":
        centre = {c: row[f"lo_{c}"] for c in columns}
        width = {c: None if centre[c] is None else row[f"hi_{c}"] - row[f"lo_{c}"] for c in columns}
    elif method == "robust":
        q = ordered.quantile_values(df, columns, [0.25, 0.5, 0.75])
        centre = {c: q[c][0.5] for c in columns}
        width = {c: None if centre[c] is None else q[c][0.75] - q[c][0.25] for c in columns}
    else:
        raise ValueError(f"unknown scale {method}")
    return Scale(method, centre, {c: w or 1.0 for c, w in width.items()})


def bin_edges(df: DataFrame, column: str, method: str = "quantil", n: int = 4) -> list[float]:
    """Edges of bins with equal counts (repeated edges merged) or equal width; none without values."""
    if method == "quantil":
        probs = [i / n for i in range(n + 1)]
        found = ordered.quantile_values(df, [column], probs)[column]
        return sorted(set(found.values()) - {None})
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if lo is None:
        return []
    edges = [lo + (hi - lo) * i / n for i in range(n + 1)]
    edges[0] -= (hi - lo) * 0.001
    return edges


# --------------------------------------------------------------------- balance
def balance(df: DataFrame, label: str, key: Sequence[str], method: str = "oversample",
            seed: int = 42) -> DataFrame:
    """Bring every class to the size of the largest (or smallest) class.

    Each row gets a draw from the hash of its key. Over-sampling copies every
    row floor(target/n) times and once more for the rows with the lowest draws;
    under-sampling keeps the lowest draws. The limit of the draws per class is
    an exact order statistic, so no class is sorted in one task.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    target = max(counts.values()) if method == "oversample" else min(counts.values())
    draw = df.withColumn("__u", hash_unit(*[F.col(k) for k in key], seed=seed))
    copies, extra = None, {}
    for value, n in counts.items():
        extra[value] = (target // n, target % n) if method == "oversample" else (0, target)
    limits = _kth_values(draw, label, {v: k for v, (_, k) in extra.items() if k})
    for value, (times, k) in extra.items():
        more = (F.col("__u") <= F.lit(limits[value])).cast("int") if k else F.lit(0)
        this = F.lit(times) + more
        cond = F.col(label).eqNullSafe(F.lit(value))
        copies = F.when(cond, this) if copies is None else copies.when(cond, this)
    return (draw.withColumn("__c", copies).filter("__c > 0")
            .withColumn("copia", F.explode(F.sequence(F.lit(1), F.col("__c"))))
            .drop("__u", "__c"))


def _kth_values(df: DataFrame, label: str, wanted: Mapping) -> dict:
    """k-th smallest draw of each class (k from 1), found range by range."""
    points = ordered.cut_points(df, ["__u"])["__u"]
    base = ordered.add_bucket(df.select(label, "__u"), "__u", points, "__b")
    sizes = base.groupBy(label, "__b").count().collect()   # classes x ranges numbers
    out = {}
    for value, k in wanted.items():
        seen = 0
        for b, n in sorted((r["__b"], r["count"]) for r in sizes if r[label] == value):
            if seen + n >= k:
                inside = base.filter(F.col(label).eqNullSafe(F.lit(value)) & (F.col("__b") == b))
                ranked = inside.withColumn("__r", F.row_number().over(
                    W.partitionBy("__b").orderBy("__u")))
                out[value] = ranked.filter(F.col("__r") == k - seen).first()["__u"]
                break
            seen += n
    return out
