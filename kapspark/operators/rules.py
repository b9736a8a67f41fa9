"""Rule resolution: exact ISIN, then two-letter prefix, then built-in default.

The winner is chosen as one whole struct, never field by field, so a NULL
``fund_type`` in an exact rule is not filled from the prefix rule.

Country rules have two-letter keys, so there are few of them whatever the size of the
rules table: they become one map, read once by a scalar subquery, and bookings are never
shuffled by two letters. Security rules are joined by ISIN; bookings without one, or
without need of a rule, get a spread key of their own, so a shuffled join does not
gather them in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kapspark import config as C
from kapspark.config import TaxConfig
from kapspark.functions import default_rule, isin_key, rule_struct

PREFIX_LENGTH = 2
# Bookings that look no rule up are dealt into so many parts, by a hash of their first columns.
KEYLESS_PARTS = 4096
KEYLESS_COLUMNS = 9


def _rule_of(rules: DataFrame) -> F.Column:
    return rule_struct(
        F.col("source_country"),
        F.col("tax_treatment"),
        F.col("max_creditable_rate"),
        F.col("instrument"),
        F.col("fund_type"),
    )


def resolve_rules(
    df: DataFrame,
    rules: DataFrame,
    cfg: TaxConfig,
    isin_col: str = C.ISIN,
    only: F.Column | None = None,
) -> DataFrame:
    """Add ``rule`` (struct or NULL) and ``rule_origin`` (security / country /
    default / rejected / NULL) to every row of ``df``.

    ``rules`` are normalised and judged (``sources.rules.normalize_rules``
    plus ``operators.issues.judged_rules``, or ``valid_rules``). A key whose
    rule was rejected gets no rule at all, never a less specific one or the
    default. Spark picks the joins by the size of the rule sets. Rows failing
    ``only`` get no rule and skip the lookups (their key is NULL).
    """
    if "rejected" not in rules.columns:
        rules = rules.withColumn("rejected", F.lit(False))
    security = rules.where(F.col("kind") == "security").select(
        F.col("key").alias("_rk_sec"), _rule_of(rules).alias("_rule_sec"), F.col("rejected").alias("_rej_sec")
    )
    prefix = F.struct(_rule_of(rules).alias("rule"), F.col("rejected"))
    by_prefix = (
        rules.where((F.col("kind") == "country") & (F.length("key") == PREFIX_LENGTH))
        .agg(F.map_from_entries(F.collect_set(F.struct(F.col("key"), prefix))).alias("by_prefix"))
        .scalar()
    )
    key = isin_key(F.col(isin_col))
    if only is not None:
        key = F.when(only, key)
    hashed = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")][:KEYLESS_COLUMNS]
    keyless = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*hashed), F.lit(KEYLESS_PARTS)).cast("string"))
    out = (
        df.withColumn("_rkey", key)
        .withColumn("_rjoin", F.coalesce(F.nullif(F.col("_rkey"), F.lit("")), keyless))
        .join(security, F.col("_rjoin") == F.col("_rk_sec"), "left")
        .withColumn("_cty", F.try_element_at(by_prefix, F.substring(F.col("_rkey"), 1, PREFIX_LENGTH)))
        .withColumns({"_rule_cty": F.col("_cty.rule"), "_rej_cty": F.col("_cty.rejected")})
    )
    dflt = default_rule(F.col("_rkey"))
    empty = F.col("_rkey").isNull() | (F.col("_rkey") == "")
    rejected = F.coalesce(F.col("_rej_sec"), F.col("_rej_cty"), F.lit(False))
    rule = F.when(empty | rejected, F.lit(None)).otherwise(F.coalesce(F.col("_rule_sec"), F.col("_rule_cty"), dflt))
    origin = (
        F.when(empty, F.lit(None))
        .when(rejected, F.lit("rejected"))
        .when(F.col("_rule_sec").isNotNull(), F.lit("security"))
        .when(F.col("_rule_cty").isNotNull(), F.lit("country"))
        .when(dflt.isNotNull(), F.lit("default"))
    )
    return out.withColumns({"rule": rule, "rule_origin": origin}).drop(
        "_rkey", "_rjoin", "_rk_sec", "_rule_sec", "_rej_sec", "_cty", "_rule_cty", "_rej_cty"
    )
