"""Ordered work that no single task has to carry alone.

A window over one key puts every row of that key in one task. Here the order is
first split in ranges (buckets of values, chunks of time); each range is sorted
on its own, and what a range owes to the ranges before it comes from a small
table with one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brisa.session import cut, table_in_shared_folder

MAX_BUCKETS = 4096
INLINE_POINTS = 64


def bucket_count(df: DataFrame) -> int:
    """As many ranges as the session uses shuffle partitions, within a fixed bound."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(wanted, MAX_BUCKETS))


def cut_points(df: DataFrame, columns: Sequence[str], n: int | None = None) -> dict[str, list[float]]:
    """Values that split the rows of each column in about equal ranges: one pass,
    at most `n` numbers per column come back."""
    n = n or bucket_count(df)
    probs = [i / n for i in range(1, n)]
    row = df.agg(*[
        F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(f"p{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: sorted({p for p in (row[i] or []) if p == p}) for i, c in enumerate(columns)}


def bucket_of(column: str, points: Sequence[float]) -> Column:
    """Range number of a value: a balanced tree of comparisons inside codegen."""
    def node(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return (f"CASE WHEN CAST(`{column}` AS DOUBLE) < {float(points[mid])!r}D "
                f"THEN {node(lo, mid)} ELSE {node(mid + 1, hi)} END")
    return F.expr(node(0, len(points)))


def add_bucket(df: DataFrame, column: str, points: Sequence[float], name: str) -> DataFrame:
    """Add the range number: inline comparisons for few ranges, the binary search
    of Bucketizer for many."""
    if len(points) <= INLINE_POINTS:
        return df.withColumn(name, bucket_of(column, points))
    splits = [-float("inf"), *points, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(
        df).withColumn(name, F.col(name).cast("int"))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right copies of the keys are dropped."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c)
                           for c in right.columns])
    cond = None
    for k in keys:
        term = left[k].eqNullSafe(other[f"__r_{k}"])
        cond = term if cond is None else cond & term
    return left.join(other, cond, how).drop(*[f"__r_{k}" for k in keys])


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: dict[str, str],
    *,
    descending: bool = False,
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Running sums in the order of a numeric column inside each group.

    `df` has one row per (by, order). Each output `name` is the sum of
    `sums[name]` over the rows up to and including this one. Without `points`
    the table, already small after its aggregate, is written once, so that the
    raw data behind it is read a single time.
    """
    by = list(by)
    if points is None:
        df = cut(df)
        points = cut_points(df, [order])[order]
    base = add_bucket(df, order, points, "__b")
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = (W.partitionBy(*by, "__b").orderBy(direction(order))
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    before = (W.partitionBy(*by).orderBy(direction("__b"))
              .rowsBetween(W.unboundedPreceding, -1))
    totals = base.groupBy(*by, "__b").agg(*[F.expr(f"sum(`{source}`) AS `__t_{name}`") for name, source in sums.items()])
    # one row per non-empty range of a group: at most MAX_BUCKETS rows per group
    offsets = totals.select(*by, "__b", *[
        F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__o_{name}")
        for name in sums])
    local = base.select(*base.columns, *[
        F.sum(source).over(inside).alias(f"__l_{name}") for name, source in sums.items()])
    joined = null_safe(local, offsets, [*by, "__b"])
    return joined.select(*df.columns, *[F.expr(f"`__l_{name}` + `__o_{name}` AS `{name}`") for name in sums])


def unpivot(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Long form (by[, peso], coluna, valor) of numeric columns, nulls left out."""
    cells = [F.struct(F.lit(c).alias("coluna"), F.col(c).cast("double").alias("valor")) for c in columns]
    keep = [*by, *([F.col(weight).alias("peso")] if weight else [])]
    long = df.select(*keep, F.explode(F.array(*cells)).alias("__c"))
    return long.select(*by, *(["peso"] if weight else []), "__c.*").filter(F.col("valor").isNotNull())


def ordered_key(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add a long that sorts like the doubles of `column`: exponent and mantissa as in their bits,
    with the sign of the value. Both zeros are 0; NaN is above infinity, as in Spark's own order."""
    size = F.abs(column)
    # log2 may be off by one beside a power of two, which the scaled value shows; that of 0 is null
    guess = F.coalesce(F.floor(F.log2(size)), F.lit(-1022))
    step = df.withColumn("__e", F.greatest(F.least(guess, F.lit(1023)), F.lit(-1022)))
    step = step.withColumn("__m", size * F.pow(F.lit(2.0), -F.col("__e")))
    low = (F.col("__m") < 1) & (F.col("__e") > -1022)
    exponent = F.col("__e") + F.when(F.col("__m") >= 2, 1).when(low, -1).otherwise(0)
    mantissa = F.col("__m") * F.when(F.col("__m") >= 2, 0.5).when(low, 2.0).otherwise(1.0)
    bits = (exponent + 1022) * F.lit(2 ** 52) + (mantissa * F.lit(2.0 ** 52)).cast("long")
    key = (F.when(F.isnan(column), 0x7FF8 << 48).when(size == float("inf"), F.signum(column).cast("long") * (0x7FF0 << 48))
           .otherwise(F.when(F.col(column) < 0, -bits).otherwise(bits)))
    return step.withColumn(name, key).drop("__e", "__m")


#: Bits of the key that are still open after each scan, and the rows up to which all of them are settled at once.
OPEN_BITS = (48, 32, 16, 0)
SETTLED_AT_ONCE = 1_000_000


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation: (by, coluna, p, valor, n).

    Radix selection on the ordered keys of the values, all columns and positions together: each scan
    counts by 16 more bits, in cells that hold a wanted position, so that only counts are shuffled
    and four scans do at most. It ends sooner where each wanted cell has a single value; cells with
    few rows are counted by value. Columns and groups without values have no row.
    """
    by = list(by)
    group = [*by, "coluna"]
    long = unpivot(df, columns, by, weight=weight)
    long = ordered_key(long.filter("peso > 0") if weight else long.withColumn("peso", F.lit(1)), "valor", "__key")
    wanted, last = None, 64
    while wanted is None or last:
        if wanted is None:
            shift, mother, rows = OPEN_BITS[0], [], long
        else:
            inside, is_open = wanted.agg(F.sum("n_cela"), F.max(F.col("menor") < F.col("maior"))).first()
            if not is_open:
                break
            shift, mother = 0 if inside <= SETTLED_AT_ONCE else OPEN_BITS[OPEN_BITS.index(last) + 1], ["mae"]
            rows = null_safe(long.withColumn("mae", F.shiftright("__key", last)),
                             wanted.select(*group, F.col("cela").alias("mae")).distinct(), [*group, "mae"])
        key = [*group, *mother]
        upto = W.partitionBy(*key).orderBy("cela").rowsBetween(W.unboundedPreceding, W.currentRow)
        cells = (rows.groupBy(*key, F.shiftright("__key", shift).alias("cela"))
                 .agg(F.sum("peso").cast("long").alias("n_cela"), F.min("valor").alias("menor"), F.max("valor").alias("maior"))
                 .withColumn("ate", F.sum("n_cela").over(upto)))
        if wanted is None:
            found = (cells.withColumn("n", F.sum("n_cela").over(W.partitionBy(*group)))
                     .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
                     .withColumn("pos", (F.col("n") - 1) * F.col("p"))
                     .withColumn("lado", F.explode(F.array(F.lit(0), F.lit(1))))
                     .withColumn("k", F.least(F.floor("pos") + F.col("lado"), F.col("n") - 1))
                     .withColumn("frac", F.col("pos") - F.floor("pos")))
        else:
            places = wanted.select(*group, F.col("cela").alias("mae"), "n", "p", "lado", "k", "frac")
            found = null_safe(cells, places, key)
        before = F.col("ate") - F.col("n_cela")
        wanted = table_in_shared_folder(
            found.filter((F.col("k") < F.col("ate")) & (F.col("k") >= before)).select(
                *group, "cela", "n_cela", "menor", "maior", "n", "p", "lado", (F.col("k") - before).alias("k"), "frac"), "quantis")
        last = shift
    ends = wanted.groupBy(*group, "p").agg(
        F.max(F.when(F.col("lado") == 0, F.col("menor"))).alias("baixo"),
        F.max(F.when(F.col("lado") == 1, F.col("menor"))).alias("alto"),
        F.max("frac").alias("frac"), F.max("n").alias("n"))
    between = F.when(F.col("baixo") == F.col("alto"), F.col("baixo")).otherwise(
        F.col("baixo") + (F.col("alto") - F.col("baixo")) * F.col("frac"))
    return ends.select(*group, "p", between.alias("valor"), "n")


def quantiles_wide(df: DataFrame, column: str, probs: dict[str, float],
                   by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per group, one named column per quantile of a single column."""
    long = quantiles(df, [column], list(dict.fromkeys(probs.values())), by, weight)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("valor"))).alias(name)
            for name, p in probs.items()]
    return long.groupBy(*by).agg(*aggs) if by else long.agg(*aggs)


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict:
    """{column: {p: value}} on the driver: len(columns) x len(probs) numbers, None where a column has no value."""
    out: dict = {c: {float(p): None for p in probs} for c in columns}
    for r in quantiles(df, columns, probs).collect():
        out[r["coluna"]][r["p"]] = r["valor"]
    return out


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, posto): mean position of each distinct value, from 1."""
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")))
    return (running_sums(counts, by, value, {"__ate": "n"})
            .withColumn("posto", F.col("__ate") - F.col("n") + (F.col("n") + 1) / 2)
            .drop("__ate"))


HEAVY_PARTS = 1000


def attach_by_value(df: DataFrame, table: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Join a table with one row per value of `key` to the rows of `df`.

    `rows` in `table` says how many rows of `df` hold the value. Values that
    hold more than 1/1000 of all rows, of which there are less than 1000, are
    broadcast; the others go through a shuffle in which no key is heavy.
    """
    limit = max(total // HEAVY_PARTS, 1)
    heavy = F.broadcast(table.filter(F.col(rows) > limit))
    light = table.filter(F.col(rows) <= limit)
    first = df.join(heavy, key)
    second = df.join(F.broadcast(table.filter(F.col(rows) > limit).select(key)), key, "left_anti").join(light, key)
    return first.unionByName(second)


def row_numbers(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Number the rows of a whole table in an order that has no ties.

    Rows are dealt by ranges of the order, sorted and written once with their partition and their
    place in it; what lies before a partition comes from the row counts, one number per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    base = (table_in_shared_folder(ranged, "numeros")
            .withColumn("__b", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND(F.lit(2 ** 33 - 1))))
    sizes = sorted(tuple(r) for r in base.groupBy("__b").agg(F.count(F.lit(1))).collect())   # at most one per shuffle partition
    rows, before = [], start
    for b, n in sizes:
        rows.append((b, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "__b long, __o long")
    return (base.join(F.broadcast(offsets), "__b").withColumn(name, F.col("__place") + F.col("__o"))
            .select(*df.columns, name))


# ------------------------------------------------------------------ time chunks
def time_index(time: Column | str, step_seconds: int) -> Column:
    """Number of whole steps since 1970 of a wall-clock time or date."""
    column = F.col(time) if isinstance(time, str) else time
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                               column.cast("timestamp_ntz"))
    return F.floor(seconds / F.lit(step_seconds)).cast("long")


def with_halo(df: DataFrame, time: str, step_seconds: int, *, before: int = 0, after: int = 0,
              length: int = 720) -> DataFrame:
    """Copy each row to its chunk of `length` steps and to the chunks that need it
    as context: `before` steps back and `after` steps ahead. Columns `__chunk`
    and `__home` are added; keep `__chunk = __home` after the window."""
    i = time_index(time, step_seconds)
    with_index = df.withColumn("__i", i)
    home = F.floor(F.col("__i") / length).cast("long")
    first = F.floor((F.col("__i") - after) / length).cast("long")
    last = F.floor((F.col("__i") + before) / length).cast("long")
    return (with_index.withColumn("__home", home)
            .withColumn("__chunk", F.explode(F.sequence(first, last))))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(F.col("__chunk") == F.col("__home")).drop("__chunk", "__home", "__i")


def neighbours(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], chunk: Column, *,
               before: bool = True, after: bool = True, following: bool = False) -> DataFrame:
    """Known values around each row of a key: `__before_c` at or before it,
    `__after_c` at or after it and, on request, `__following`, the time of the
    next row.

    Rows are sorted per (key, chunk). What reaches into a chunk from the others
    comes from a table with one row per chunk, joined back once for all columns.
    """
    keys, columns = list(keys), list(columns)
    base = df.withColumn("__k", chunk)
    inside = W.partitionBy(*keys, "__k").orderBy(time)
    # both sides run from an end of the chunk: a frame up to the last row is read again for every row
    past = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    future = W.partitionBy(*keys, "__k").orderBy(F.col(time).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    chunks = W.partitionBy(*keys).orderBy("__k")
    earlier = chunks.rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc("__k")).rowsBetween(W.unboundedPreceding, -1)
    sums, enter, local, out = [], [], [], []
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col(time))
        if before:
            sums.append(F.max_by(F.col(c), at).alias(f"__last_{c}"))
            enter.append(F.last(f"__last_{c}", ignorenulls=True).over(earlier).alias(f"__eb_{c}"))
            local.append(F.last(c, ignorenulls=True).over(past).alias(f"__lb_{c}"))
            out.append(F.coalesce(f"__lb_{c}", f"__eb_{c}").alias(f"__before_{c}"))
        if after:
            sums.append(F.min_by(F.col(c), at).alias(f"__first_{c}"))
            enter.append(F.last(f"__first_{c}", ignorenulls=True).over(later).alias(f"__ea_{c}"))
            local.append(F.last(c, ignorenulls=True).over(future).alias(f"__la_{c}"))
            out.append(F.coalesce(f"__la_{c}", f"__ea_{c}").alias(f"__after_{c}"))
    if following:
        sums.append(F.min(time).alias("__start"))
        enter.append(F.lead("__start").over(chunks).alias("__ef"))
        local.append(F.lead(time).over(inside).alias("__lf"))
        out.append(F.coalesce("__lf", "__ef").alias("__following"))
    entering = base.groupBy(*keys, "__k").agg(*sums).select(*keys, "__k", *enter)
    joined = null_safe(base.select(*base.columns, *local), entering, [*keys, "__k"], "left")
    return joined.select(*df.columns, *out)


def carry(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str],
          chunk: Column, *, backward: bool = False) -> DataFrame:
    """Fill nulls with the last value before (or the next one after) in each key."""
    side = "after" if backward else "before"
    near = neighbours(df, keys, time, columns, chunk, before=not backward, after=backward)
    return near.select(*[F.col(f"__{side}_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
