"""Keeping fitted models together with what is known about them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def save_model(model, path: str, metadata: Mapping | None = None) -> str:
    """Write a fitted MLlib model and a one-row metadata table beside it."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/modelo")
    row = {"classe": f"{type(model).__module__}.{type(model).__name__}", "spark": spark.version,
           "salvo_em": datetime.now(timezone.utc).isoformat(timespec="seconds"),
           "metadados": json.dumps(dict(metadata or {}), default=str)}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(f"{path}/metadados")
    return path


def load_model(spark: SparkSession, path: str):
    """(model, metadata) written by `save_model`."""
    info = spark.read.json(f"{path}/metadados").first().asDict()
    info["metadados"] = json.loads(info["metadados"])
    if info["classe"].endswith("PipelineModel"):
        return PipelineModel.load(f"{path}/modelo"), info
    module, name = info["classe"].rsplit(".", 1)
    cls = getattr(__import__(module, fromlist=[name]), name)
    return cls.load(f"{path}/modelo"), info
