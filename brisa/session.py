"""Spark session, checkpoint folder and tail probabilities of the JVM."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "brisa", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs here expect."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints, taken from the session. A folder of this machine
    is made only when the session itself is local."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="brisa-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the files, so that a lost
    executor costs one read and not the whole chain of rounds."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table_in_shared_folder(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write `df` as Parquet to the shared folder and go on from the files: a table that is read
    column by column, where a checkpoint keeps whole rows. `by` are columns of a folder each."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, partitionBy=list(by) or None)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, work, items: Sequence, at_once: int = 4) -> list:
    """Results of independent fits, a few at a time, so that the short jobs of one fill the cores another leaves."""
    with ThreadPool(min(at_once, len(items)) or 1) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)


class Tails:
    """Tail probabilities for numbers already aggregated on the cluster."""

    def __init__(self, spark: SparkSession):
        self._d = spark._jvm.org.apache.commons.math3.distribution

    def normal_two_sided(self, z: float) -> float:
        return float(2 * self._d.NormalDistribution(0.0, 1.0).cumulativeProbability(-abs(z)))

    def normal_cdf(self, z: float) -> float:
        return float(self._d.NormalDistribution(0.0, 1.0).cumulativeProbability(float(z)))

    def normal_quantile(self, p: float) -> float:
        return float(self._d.NormalDistribution(0.0, 1.0).inverseCumulativeProbability(float(p)))

    def t_two_sided(self, t: float, dof: float) -> float:
        return float(2 * self._d.TDistribution(float(dof)).cumulativeProbability(-abs(float(t))))

    def t_quantile(self, p: float, dof: float) -> float:
        return float(self._d.TDistribution(float(dof)).inverseCumulativeProbability(float(p)))

    def chi2_upper(self, x: float, dof: float) -> float:
        return float(1 - self._d.ChiSquaredDistribution(float(dof)).cumulativeProbability(max(float(x), 0.0)))

    def f_upper(self, x: float, d1: float, d2: float) -> float:
        return float(1 - self._d.FDistribution(float(d1), float(d2)).cumulativeProbability(max(float(x), 0.0)))

    def hypergeometric(self, population: int, successes: int, draws: int):
        return self._d.HypergeometricDistribution(int(population), int(successes), int(draws))
