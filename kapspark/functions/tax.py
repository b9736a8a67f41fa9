"""Rule keys, rule structs and the built-in default rule as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kapspark import constants as K

RULE_DDL = (
    "struct<source_country:string,tax_treatment:string,max_creditable_rate:double,"
    "instrument:string,fund_type:string>"
)


def isin_key(isin: Column) -> Column:
    """Lookup key for rules: upper-cased ISIN, NULL becomes the empty string."""
    return F.upper(F.coalesce(isin.cast("string"), F.lit("")))


def rule_struct(
    source_country: Column,
    tax_treatment: Column,
    max_creditable_rate: Column,
    instrument: Column,
    fund_type: Column,
) -> Column:
    return F.struct(
        source_country.cast("string").alias("source_country"),
        tax_treatment.cast("string").alias("tax_treatment"),
        max_creditable_rate.cast("double").alias("max_creditable_rate"),
        instrument.cast("string").alias("instrument"),
        fund_type.cast("string").alias("fund_type"),
    )


def default_rule(key: Column) -> Column:
    """Built-in rule for a key without a configured rule.

    Two letters: ``DE`` is domestic with nothing creditable, any other pair is
    foreign with the default creditable rate. Anything else (digits, one
    letter, empty) has no rule.
    """
    prefix = F.upper(F.substring(key, 1, 2))
    domestic = rule_struct(
        F.lit(K.DOMESTIC_COUNTRY), F.lit("domestic"), F.lit(0.0), F.lit("share"), F.lit(None)
    )
    foreign = rule_struct(
        prefix, F.lit("foreign"), F.lit(K.DEFAULT_FOREIGN_CREDIT_RATE), F.lit("share"), F.lit(None)
    )
    return (
        F.when(prefix == K.DOMESTIC_COUNTRY, domestic)
        .when(prefix.rlike(r"^\p{L}{2}$"), foreign)
        .otherwise(F.lit(None).cast(RULE_DDL))
    )
