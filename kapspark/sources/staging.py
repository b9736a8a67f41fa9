"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in a fresh folder under the session's
    checkpoint directory and read it back: lineage ends there, and later
    reads are columnar and see the same rows."""
    base = df.sparkSession.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("this needs spark.checkpoint.dir (a folder that driver and executors share)")
    path = f"{base.rstrip('/')}/kapspark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
