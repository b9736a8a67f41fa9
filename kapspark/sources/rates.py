"""Daily rate tables: normalisation and rate payloads in bulk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kapspark import constants as K

RATES_DAILY_DDL = "rate_date date, currency string, rate double"


def _typed(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("rate_date").cast("date").alias("rate_date"),
        F.upper(F.col("currency").cast("string")).alias("currency"),
        F.col("rate").cast("double").alias("rate"),
    ).where(F.col("rate_date").isNotNull() & F.col("currency").isNotNull() & F.col("rate").isNotNull())


def normalize_daily_rates(df: DataFrame) -> DataFrame:
    """(rate_date, currency, rate) typed, one rate per (date, currency). Of
    contradicting rates the largest counts (``rate_conflicts`` lists them); a
    rate that is not positive stays and makes its bookings ``missing``."""
    return _typed(df).groupBy("rate_date", "currency").agg(F.max("rate").alias("rate"))


def rate_conflicts(rates_daily: DataFrame | None, rates_yearly: DataFrame) -> DataFrame:
    """(period, currency, issue, n_rates): contradicting rates for one day or
    year (``conflicting_rate``) and rates that are not positive (``bad_rate``)."""
    yearly = rates_yearly.select(
        F.col("year").cast("int").cast("string").alias("period"),
        F.upper("currency").alias("currency"),
        F.col("rate").cast("double").alias("rate"),
    )
    rates = yearly if rates_daily is None else yearly.unionByName(
        _typed(rates_daily).withColumn("period", F.col("rate_date").cast("string")).drop("rate_date")
    )
    per_key = rates.groupBy("period", "currency").agg(
        F.count_distinct("rate").alias("n_rates"), F.min("rate").alias("lowest")
    )
    named = F.array(
        F.when(F.col("n_rates") > 1, F.lit("conflicting_rate")), F.when(F.col("lowest") <= 0, F.lit("bad_rate"))
    )
    return (
        per_key.select("period", "currency", F.explode(named).alias("issue"), "n_rates").where(F.col("issue").isNotNull())
    )


def rates_from_payloads(
    payloads: DataFrame,
    currencies: Sequence[str] = K.PAYLOAD_CURRENCIES,
    date_col: str = "requested_date",
    body_col: str = "body",
) -> DataFrame:
    """Flatten JSON rate payloads into (rate_date, currency, rate).

    ``rates`` is either a flat currency map or nested under the requested
    date. Requested currencies found are rounded half-even to 4 places, EUR
    is added as 1.0, and a payload without any usable rate yields nothing.
    Rows are keyed by the requested date, not the payload's own date.
    Garbage bodies parse to NULL and drop out.
    """
    req = F.col(date_col).cast("date")
    rates_text = F.get_json_object(F.col(body_col), "$.rates")
    flat = F.from_json(rates_text, "map<string,double>")
    nested = F.from_json(rates_text, "map<string,map<string,double>>")
    day = F.coalesce(F.try_element_at(nested, F.date_format(req, "yyyy-MM-dd")), flat)
    wanted = F.array(*[F.lit(c) for c in currencies])
    picked = F.filter(
        F.transform(wanted, lambda c: F.struct(c.alias("currency"), F.try_element_at(F.col("_day"), c).alias("rate"))),
        lambda s: s["rate"].isNotNull(),
    )
    eur = F.array(F.struct(F.lit("EUR").alias("currency"), F.lit(1.0).alias("rate")))
    no_eur = F.when(~F.exists(picked, lambda s: s["currency"] == "EUR"), eur).otherwise(
        F.array().cast("array<struct<currency:string,rate:double>>")
    )
    usable = F.exists(picked, lambda s: s["currency"] != "EUR")
    # no filter on the parsed body: Spark would move it below a DISTINCT or an aggregate that the
    # payloads come from and parse a body for each row there; an array of NULL gives no row either
    exploded = payloads.select(req.alias("rate_date"), day.alias("_day")).select(
        "rate_date", F.explode(F.when(usable, F.array_union(picked, no_eur))).alias("r")
    )
    return exploded.select(
        "rate_date",
        F.col("r.currency").alias("currency"),
        F.bround(F.col("r.rate"), 4).alias("rate"),
    )
