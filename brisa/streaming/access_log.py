"""Access-log counts on a stream and monthly loads by micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from brisa.constants import LATENCY_BUCKETS_MS
from brisa.operators.serving import access_counts
from brisa.sources.snapshots import add_to_months


def running_counts(log: DataFrame) -> DataFrame:
    """Totals since the start by method, route and status: state has one row per
    combination, so it does not grow with the traffic."""
    return access_counts(log)


def windowed_counts(log: DataFrame, time: str = "instante", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts per window; the watermark lets closed windows leave the state."""
    return (log.withWatermark(time, late).groupBy(F.window(time, window).alias("janela"), "metodo", "rota", "status")
            .agg(F.count(F.lit(1)).alias("requisicoes"), F.sum("latencia_ms").alias("latencia_soma_ms"),
                 *[F.count_if(F.col("latencia_ms") <= b).alias(f"ate_{b}_ms") for b in LATENCY_BUCKETS_MS]))


def start_counts(log: DataFrame, checkpoint: str, name: str = "contagens") -> StreamingQuery:
    return (running_counts(log).writeStream.outputMode("complete").format("memory").queryName(name)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def start_monthly_load(stream: DataFrame, root: str, time: str, checkpoint: str, key: Sequence[str] | None = None) -> StreamingQuery:
    """Each batch adds its rows to their months; rows of earlier batches stay, and a batch that
    runs again after a failure changes nothing. Rows with the same `key` replace each other."""
    return (stream.writeStream.foreachBatch(lambda df, _: add_to_months(df, root, time, key) and None)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
