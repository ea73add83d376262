"""Dated snapshots and monthly loads as partitioned Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from brisa.session import table_in_shared_folder
from brisa.sources.readers import path_exists

DAY = "data_coleta"
MONTH = "ano_mes"
BATCH = "lote"


def _listed(spark: SparkSession, root: str, column: str) -> list[str]:
    if not path_exists(spark, root):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Days with a snapshot, oldest first, from the partition folders."""
    return _listed(spark, root, DAY)


def snapshot_day(df: DataFrame, column: str) -> date | None:
    """Day of a snapshot: the largest date in the data, not the clock."""
    return df.agg(F.max(F.try_to_timestamp(F.col(column).cast("string")).cast("date"))).first()[0]


def archive(df: DataFrame, root: str, day: date | str, replace: bool = False) -> bool:
    """Write the snapshot of a day once; a day already there stays as it is."""
    if not replace and str(day) in snapshots(df.sparkSession, root):
        return False
    (df.withColumn(DAY, F.lit(str(day)).cast("date")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy(DAY).parquet(root))
    return True


def archive_by_content(df: DataFrame, root: str, column: str) -> bool:
    day = snapshot_day(df, column)
    if day is None:
        raise ValueError(f"no date in {column}")
    return archive(df, root, day)


def locate(spark: SparkSession, root: str, day: date | str | None = None) -> DataFrame:
    """Newest snapshot, or the one of a day; only its partition is read."""
    known = snapshots(spark, root)
    wanted = str(day) if day else (known[-1] if known else None)
    if wanted is None or wanted not in known:
        raise FileNotFoundError(f"no snapshot {wanted or ''} under {root}; archive the source first")
    return spark.read.parquet(root).filter(F.col(DAY) == F.lit(wanted).cast("date"))


def load_months(df: DataFrame, root: str, time: str) -> list[str]:
    """Rewrite only the months that `df` holds; other months stay untouched."""
    dated = df.withColumn(MONTH, F.date_format(time, "yyyy-MM"))
    (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy(MONTH).parquet(root))
    return _listed(df.sparkSession, root, MONTH)


def add_to_months(df: DataFrame, root: str, time: str, key: Sequence[str] | None = None) -> list[str]:
    """Add rows to the months that `df` holds. With a `key`, a new row takes the place of the old one
    with the same key, and of several new ones one stays, always the same. Without, equal rows
    are counted: a month has each as often as the old or the new rows have it, whichever is more, so that adding
    the same rows again changes nothing. The touched months are put together in the shared folder
    first and then replaced; `append_batch` adds rows without that."""
    spark = df.sparkSession
    dated = df.withColumn(MONTH, F.date_format(time, "yyyy-MM"))
    times = "__times"
    if key:
        named, row = [*key, MONTH], F.struct(*[c for c in dated.columns])
        dated = dated.groupBy(*named).agg(F.max_by(row, F.xxhash64(*dated.columns)).alias("__row")).select("__row.*")
    else:
        named = dated.columns
        dated = dated.groupBy(*named).agg(F.count("*").alias(times))
    new = table_in_shared_folder(dated, "month-rows")
    months = new.select(MONTH).distinct()
    if path_exists(spark, root):
        old = read_months(spark, root).withColumn(MONTH, F.col(MONTH).cast("string"))
        old = old.join(F.broadcast(months), MONTH, "left_semi")         # one short text for each month
        if key:
            same = [old[c].eqNullSafe(new[c]) for c in named]
            both = new.unionByName(old.join(new.select(*named), reduce(and_, same), "left_anti"), allowMissingColumns=True)
        else:
            held = old.groupBy(*old.columns).agg(F.count("*").alias(times))
            both = new.unionByName(held, allowMissingColumns=True)
            both = both.groupBy(*[c for c in both.columns if c != times]).agg(F.max(times).alias(times))
        new = table_in_shared_folder(both, "months")
    if not key:
        new = new.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(times)
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy(MONTH).parquet(root))
    return _listed(spark, root, MONTH)


def _batch_name(batch: int, compacted: bool = False) -> str:
    return f"{'c' if compacted else 'b'}{batch:012d}"


def append_batch(df: DataFrame, root: str, time: str, batch: int) -> None:
    """Add the rows of a numbered batch to their months, in files of their own: no month is read or
    rewritten, and equal rows stay. The folders are the log: a batch that runs again replaces just
    its own files, and one that a compaction has taken in changes nothing."""
    dated = df.withColumn(MONTH, F.date_format(time, "yyyy-MM")).withColumn(BATCH, F.lit(_batch_name(batch)))
    done = F.broadcast(_compacted(df.sparkSession, root))
    dated = dated.join(done.select(F.col(MONTH).alias("__m"), F.col("ate").alias("__ate")), F.col(MONTH).eqNullSafe(F.col("__m")), "left")
    dated = dated.filter(F.coalesce(F.col("__ate") < batch, F.lit(True))).drop("__m", "__ate")
    (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy(MONTH, BATCH).parquet(root))


def _compacted(spark: SparkSession, root: str) -> DataFrame:
    """(ano_mes, ate): the last batch that each compacted month holds; a row for each month."""
    rows = []
    for month in _listed(spark, root, MONTH):
        names = [n for n in _listed(spark, f"{root}/{MONTH}={month}", BATCH) if n.startswith("c")]
        if names:
            rows.append((None if month == "__HIVE_DEFAULT_PARTITION__" else month, int(max(names)[1:])))
    return spark.createDataFrame(rows, f"{MONTH} string, ate long")


def read_batches(spark: SparkSession, root: str, key: Sequence[str] | None = None) -> DataFrame:
    """All rows that `append_batch` has added, with their month and batch. With a `key`, the row of the
    last batch that has it; of several rows of a batch one stays, always the same."""
    month = F.col(MONTH).cast("string")
    df = spark.read.option("basePath", root).parquet(root).withColumn(MONTH, month)
    df = df.join(F.broadcast(_compacted(spark, root).withColumnRenamed(MONTH, "__m")), month.eqNullSafe(F.col("__m")), "left")
    # what a compaction has taken in is read from it, not from the files of the batches
    number = F.substring(BATCH, 2, 12).cast("long")
    df = df.filter(F.col("ate").isNull() | (number > F.col("ate")) | (F.col(BATCH).startswith("c") & (number == F.col("ate")))).drop("__m", "ate")
    if not key:
        return df
    newest = F.struct(F.substring(BATCH, 2, 12), F.xxhash64(*df.columns))
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), newest).alias("__row")).select("__row.*")


def compact_months(spark: SparkSession, root: str, months: Sequence[str]) -> None:
    """Put the batches of each of these months into one set of files, named by the last of them. The files of
    the batches are no longer read; a reader sees either them or the compacted ones."""
    for m in months:
        names = _listed(spark, f"{root}/{MONTH}={m}", BATCH)
        last = max((int(n[1:]) for n in names if n.startswith("c")), default=-1)
        later = [int(n[1:]) for n in names if int(n[1:]) > last]
        if later and (last >= 0 or len(later) > 1):
            rows = read_batches(spark, root).filter(F.col(MONTH) == m).drop(MONTH, BATCH)
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{MONTH}={m}/{BATCH}={_batch_name(max(later), True)}")


def read_months(spark: SparkSession, root: str, first: str | None = None, last: str | None = None) -> DataFrame:
    df = spark.read.option("basePath", root).parquet(root)
    month = F.col(MONTH).cast("string")
    if first:
        df = df.filter(month >= first)
    if last:
        df = df.filter(month <= last)
    return df
