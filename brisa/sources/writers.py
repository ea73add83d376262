"""Saving tables by format and publishing a set of tables all at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from brisa.sources.readers import path_exists


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite",
         partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), **options) -> str:
    """Write csv, json, parquet or orc. Sorting inside the files gives min/max
    statistics that skip row groups."""
    if kind == "csv":
        options = {"header": "true", **options}
    if kind == "parquet":
        options = {"compression": "zstd", **options}
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)
    return path


POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(tables: Mapping[str, DataFrame], root: str,
            check: Callable[[Mapping[str, DataFrame]], None] | None = None,
            run: str | None = None) -> str:
    """Write every table aside, check what was written, then move one pointer.

    Readers follow the pointer, so they see the old set or the new one and never
    a part. A failed check leaves the pointer where it was.
    """
    spark = next(iter(tables.values())).sparkSession
    run = run or uuid.uuid4().hex
    for name, df in tables.items():
        save(df, f"{root}/{run}/{name}", mode="errorifexists")
    written = {name: spark.read.parquet(f"{root}/{run}/{name}") for name in tables}
    if check:
        check(written)
    body = json.dumps({"run": run, "tables": sorted(tables)})
    temp, fs = _fs(spark, f"{root}/{run}/{POINTER}")
    out = fs.create(temp, True)
    out.write(bytearray(body.encode()))
    out.close()
    target, _ = _fs(spark, f"{root}/{POINTER}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    array = spark.sparkContext._gateway.new_array(options, 1)
    array[0] = options.OVERWRITE
    context.rename(fs.makeQualified(temp), fs.makeQualified(target), array)
    return run


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the set the pointer names."""
    if not path_exists(spark, f"{root}/{POINTER}"):
        raise FileNotFoundError(f"nothing published under {root}")
    info = json.loads("".join(r[0] for r in spark.read.text(f"{root}/{POINTER}").collect()))
    return {name: spark.read.parquet(f"{root}/{info['run']}/{name}") for name in info["tables"]}
