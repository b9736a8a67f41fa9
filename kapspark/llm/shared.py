"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BUCKET_CHARS = 16_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that has none (as in tests) gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("this needs spark.checkpoint.dir (a folder that driver and executors share)")
        root = tempfile.mkdtemp(prefix="kapspark-llm-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Cuts the lineage and fixes the rows: whatever is read from the result is the
    same in every later job, also after executors were lost.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_count(docs: DataFrame, text_col: str, least: int, bucket_chars: int = BUCKET_CHARS) -> int:
    """Buckets for the words of all texts: one for each `bucket_chars` characters, `least` at least.

    So what one bucket gets stays about the same however large the table is."""
    chars = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")).cast("long"))).first()[0] or 0
    return max(least, -(-chars // bucket_chars))


def utf8_bytes(text: Column) -> Column:
    """Bytes of the UTF-8 text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, UPPER, UPPER.lower())
