"""Trained weights as a small Parquet table: one row per layer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from tonearm.sources.preferences import path_exists

_SCHEMA = "layer string, shape array<int>, weights array<double>"


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in sorted(weights.items())]
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray] | None:
    """The weights, or None when nothing was saved there."""
    if not path_exists(spark, path):
        return None
    rows = spark.read.schema(_SCHEMA).parquet(path).collect()
    return {r.layer: np.array(r.weights).reshape(r.shape) for r in rows}
