"""Tax-rules table: normalisation of a rules DataFrame (security / country rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kapspark.sources.dims import local_table

RULES_DDL = (
    "kind string, key string, source_country string, tax_treatment string, "
    "max_creditable_rate string, instrument string, fund_type string"
)


def normalize_rules(df: DataFrame) -> DataFrame:
    """Upper-case keys and countries, lower-case instrument and fund type,
    default the instrument to ``share``; the rate is parsed leniently
    (numeric text is accepted, anything else becomes NULL and an issue)."""
    cols = set(df.columns)

    def opt(name: str):
        return F.col(name) if name in cols else F.lit(None)

    rate = opt("max_creditable_rate")
    return df.select(
        F.lower(F.trim(F.col("kind").cast("string"))).alias("kind"),
        F.upper(F.col("key").cast("string")).alias("key"),
        F.upper(opt("source_country").cast("string")).alias("source_country"),
        opt("tax_treatment").cast("string").alias("tax_treatment"),
        rate.cast("string").try_cast("double").alias("max_creditable_rate"),
        rate.cast("string").alias("rate_text"),
        F.lower(F.coalesce(opt("instrument").cast("string"), F.lit("share"))).alias("instrument"),
        F.lower(opt("fund_type").cast("string")).alias("fund_type"),
    )


def rules_from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Rules from plain records (e.g. a parsed config): ``kind`` plus fields.

    Missing fields become NULL; the rate is kept as text until ``normalize_rules``.
    """
    fields = ("kind", "key", "source_country", "tax_treatment", "max_creditable_rate", "instrument", "fund_type")
    rows = [
        tuple(None if r.get(f) is None else str(r.get(f)) for f in fields)
        for r in records
    ]
    return local_table(spark, rows, RULES_DDL)


def empty_rules(spark: SparkSession) -> DataFrame:
    return normalize_rules(local_table(spark, [], RULES_DDL))
