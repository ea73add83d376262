"""What several operators of this package share: reading a table, writing an intermediate
table to the shared folder, sides small enough to broadcast, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from brisa.session import shared_folder

#: A side of a join with at most this many narrow rows (a few longs each) is broadcast.
#: Beyond it the same join runs as a shuffle join that adaptive execution can split.
BROADCAST_ROWS = 1_000_000


#: Bytes of the batches that go to Python workers, unless the session has a bound of its own: texts
#: are long, and a batch is held by the JVM and by the worker at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set the bound of batches in a session that has none."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_BYTES))


def release() -> None:
    """Give memory that a worker no longer uses back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # a function of glibc
    if trim:
        trim(0)


_remembered: list[Callable[[], object]] = []


def remembers(clear: Callable[[], object]) -> None:
    """Name the function that drops what an operator remembers in a worker from task to task."""
    if clear not in _remembered:
        _remembered.append(clear)


def forget() -> None:
    """Drop what other operators remember in this worker, which takes up another operator now."""
    for clear in _remembered:
        clear()


def given_back(work: Callable) -> Callable:
    """`work` on the batches of a task, before which other operators' memories are dropped and after
    which what it held is given back."""
    def run(batches):
        forget()
        try:
            yield from work(batches)
        finally:
            release()
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the folder of spark.checkpoint.dir and go on from the files, so
    that a lost executor costs one read and that rows used twice are made once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, values: str | None = None) -> DataFrame:
    """`df` with a broadcast hint if it has at most `limit` rows. It should be a staged table
    of narrow rows: the count is then read from file footers. If rows hold an array of any
    length in the column `values`, its elements are counted with them."""
    rows = df.agg(F.count("*") + F.coalesce(F.sum(F.size(values)), F.lit(0))).first()[0] if values else df.count()
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between longs: (node, component), where the
    component is its smallest node. Only nodes that have an edge to another are returned.

    Large-star and small-star steps alternate until every edge points at the smallest node of
    its component. Each step takes a minimum per node, which is combined before the shuffle, and
    joins it back, so that a node with very many edges is never gathered in one place."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = staged(e, "edges")
    before = None
    while True:
        # large star: every neighbour above u moves to the smallest neighbour of u
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.distinct()
        # small star: what lies below u moves to the smallest of them, and so does u
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = staged(down.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component")))


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Whole groups of a stream of batches sorted by integer columns `keys`; no more than the
    group that goes on and the batch at hand are held."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool):
        t = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([np.asarray(t.column(k).combine_chunks()) for k in keys])
        ends = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), *([len(t)] if last else [])]
        held[:] = t.slice(ends[-1] if ends else 0).to_batches()
        for first, end in zip([0, *ends], ends):
            yield t.slice(first, end - first)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield from cut(False)
    if held:
        yield from cut(True)
