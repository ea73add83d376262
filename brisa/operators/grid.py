"""Complete hourly or daily grids, short gaps, canonical names and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from brisa.operators import ordered

STEP_SECONDS = {"hour": 3600, "day": 86400}
CHUNK = {"hour": 720, "day": 366}


def complete_grid(df: DataFrame, key: str, time: str, fixed: Sequence[str] = (),
                  step: str = "hour") -> DataFrame:
    """One row per step from the first to the last point of each series.

    Each row stretches to the step before the next row of its series, so the grid
    needs no join with a calendar. New rows take the fixed columns from the row
    before; other columns stay null. Nulls in fixed columns are filled forward,
    then backward. `criada` marks new rows. Times lie on the step.
    """
    span, length = STEP_SECONDS[step], CHUNK[step]
    rows = df.withColumn("__i", ordered.time_index(time, span))
    near = ordered.neighbours(rows, [key], "__i", fixed, F.floor(F.col("__i") / length), following=True)
    gap = F.greatest(F.coalesce(F.col("__following") - F.col("__i"), F.lit(1)), F.lit(1))
    wide = near.withColumn("__s", F.explode(F.sequence(F.lit(0), (gap - 1).cast("int"))))
    moved = (F.date_add(F.col(time), F.col("__s")) if dict(df.dtypes)[time] == "date"
             else F.timestamp_add(step.upper(), F.col("__s"), F.col(time)))
    own = F.col("__s") == 0

    def value(c: str) -> Column:
        if c == time:
            return F.when(own, F.col(c)).otherwise(moved)
        if c in fixed:
            return F.coalesce(f"__before_{c}", f"__after_{c}")
        return F.col(c) if c == key else F.when(own, F.col(c))
    return wide.select(*[value(c).alias(c) for c in df.columns], (~own).alias("criada"))


def fill_short_gaps(df: DataFrame, key: str, time: str, columns: Sequence[str], max_gap: int,
                    step: str = "hour", suffix: str = "") -> DataFrame:
    """Linear fill of whole gaps of at most `max_gap` steps on a regular grid.

    A gap is longer than `max_gap` exactly when no known value lies within that
    reach, so each chunk of time only needs `max_gap` rows of its neighbours.
    Adds `interpolado` and `faltante`.
    """
    span = STEP_SECONDS[step]
    halo = ordered.with_halo(df, time, span, before=max_gap, after=max_gap, length=CHUNK[step])
    place = W.partitionBy(key, "__chunk").orderBy("__i")
    steps = range(1, max_gap + 1)
    halo = halo.select("*", *[f(c, j).over(place).alias(f"__{side}{j}_{c}") for c in columns for j in steps
                              for f, side in ((F.lag, "p"), (F.lead, "n"))])
    values, filled, helpers = {}, F.lit(False), []
    for c in columns:
        near = {}
        for side in "pn":
            names = [f"__{side}{j}_{c}" for j in steps]
            helpers += names
            far = None                       # distance to the nearest known value on this side
            for j, name in reversed(list(zip(steps, names))):
                far = F.when(F.col(name).isNotNull(), F.lit(j)).otherwise(far)
            near[side] = (F.coalesce(*names), far)
        (before, p), (after, n) = near["p"], near["n"]
        short = F.col(c).isNull() & (p + n - 1 <= max_gap)
        values[c] = F.when(short, before + (after - before) * p / (p + n)).otherwise(F.col(c))
        filled = filled | F.coalesce(short, F.lit(False))
    out = ordered.drop_halo(halo.withColumn(f"interpolado{suffix}", filled).withColumns(values))
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return out.withColumn(f"faltante{suffix}", missing).drop(*helpers)


def gap_groups(df: DataFrame, key: str, time: str, column: str, step: str = "hour") -> DataFrame:
    """Number of the gap and its size on null rows of a regular grid.

    The number of a gap is the running count of known times before it, counted inside a chunk of time;
    what lies before a chunk, and the parts of a gap beyond it, come from one row per chunk.
    """
    length, null = CHUNK[step], F.col(column).isNull().cast("long")
    base = df.withColumn("__i", ordered.time_index(time, STEP_SECONDS[step]))
    base = base.withColumn("__k", F.floor(F.col("__i") / length))
    place = W.partitionBy(key, "__k").orderBy("__i")
    # a time with several rows counts once
    base = base.withColumn("__new", F.when(F.coalesce(F.lag("__i").over(place) != F.col("__i"), F.lit(True)), F.max(
        F.col(column).isNotNull().cast("long")).over(W.partitionBy(key, "__k", "__i"))).otherwise(F.lit(0)))
    base = base.withColumn("__l", F.sum("__new").over(place))       # rows of one time together
    base = base.withColumn("__n", F.sum(null).over(W.partitionBy(key, "__k", "__l")))
    first = F.when(F.col("__l") == 0, F.struct("__l", "__n"))
    chunks = base.groupBy(key, "__k").agg(F.sum("__new").alias("__t"), F.max(first)["__n"].alias("__head"), F.max(
        F.struct("__l", "__n"))["__n"].alias("__tail"))
    before = W.partitionBy(key).orderBy("__k").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("__o", F.coalesce(F.sum("__t").over(before), F.lit(0)))
    # a gap has the tail of one chunk, chunks without a known time and the head of another
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("__o").alias("seq"), F.coalesce("__head", F.lit(0)).alias("n")),
                   F.struct(F.lit(1).alias("side"), (F.col("__o") + F.col("__t")).alias("seq"),
                            F.when(F.col("__t") > 0, F.col("__tail")).otherwise(F.lit(0)).alias("n")))
    sums = chunks.withColumn("__e", F.explode(ends)).withColumn("__z", F.sum("__e.n").over(W.partitionBy(key, "__e.seq")))
    sizes = sums.groupBy(key, "__k").agg(F.first("__o").alias("__o"), F.first("__t").alias("__t"), F.max(
        F.when(F.col("__e.side") == 0, F.col("__z"))).alias("__zh"), F.max(F.when(F.col("__e.side") == 1, F.col("__z"))).alias("__zt"))
    size = F.when(F.col("__l") == 0, F.col("__zh")).when(F.col("__l") == F.col("__t"), F.col("__zt")).otherwise(F.col("__n"))
    joined = ordered.null_safe(base, sizes, [key, "__k"])
    return joined.select(*df.columns, (F.col("__l") + F.col("__o")).alias("sequencia"),
                         F.when(F.col(column).isNull(), size).otherwise(F.lit(0)).alias("tamanho_gap"))


def canonical_name(df: DataFrame, key: str, name: str, time: str) -> tuple[DataFrame, DataFrame]:
    """(latest non-null name per unit, report of units with more than one name)."""
    known = df.filter(F.col(name).isNotNull())
    latest = known.groupBy(key).agg(F.max_by(name, F.struct(F.col(time), F.col(name))).alias("nome_canonico"))
    names = known.select(key, name).distinct()
    report = (names.groupBy(key).agg(F.count(F.lit(1)).alias("n_nomes"),
                                     F.array_sort(F.collect_set(name)).alias("nomes"))
              .filter("n_nomes > 1"))
    return latest, report


RESAMPLE = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def resample(df: DataFrame, time: str, value: str, freq: str, aggregate: Column,
             moving: int | None = None, name: str = "valor", by: Sequence[str] = ()) -> DataFrame:
    """One row per period from first to last, in each group of `by`, with an aggregate and, on request,
    the trailing mean of the last `moving` known periods in reach."""
    unit, by = RESAMPLE[freq], list(by)
    seen = (df.filter(F.col(time).isNotNull() & F.col(value).isNotNull())
            .groupBy(*by, F.to_date(F.date_trunc(unit, F.col(time))).alias("periodo"))
            .agg(aggregate.alias(name)))
    step = {"D": "1 DAY", "W": "7 DAY", "M": "1 MONTH", "Q": "3 MONTH", "Y": "1 YEAR"}[freq]
    periods = (seen.groupBy(*by).agg(F.min("periodo").alias("a"), F.max("periodo").alias("z"))
               .select(*by, F.explode(F.sequence("a", "z", F.expr(f"INTERVAL {step}"))).alias("periodo")))
    out = ordered.null_safe(periods, seen, [*by, "periodo"], "left") if by else periods.join(seen, "periodo", "left")
    if moving:
        # one row per calendar period of a group: days of history at most
        frame = W.partitionBy(*by).orderBy("periodo").rowsBetween(-(moving - 1), 0)
        out = out.withColumn("media_movel", F.avg(name).over(frame))
    return out
