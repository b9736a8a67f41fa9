"""FX conversion to EUR (daily rate, yearly fallback) and gross-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kapspark import config as C
from kapspark.config import TaxConfig
from kapspark.sources.rates import normalize_daily_rates


def yearly_lookup(rates_yearly: DataFrame) -> DataFrame:
    """One row per year: (fx_year, fx_year_rates map<currency, rate>).

    Of rates that repeat a year and currency the largest counts; they are
    listed by ``sources.rates.rate_conflicts``.
    """
    entry = F.struct(F.upper(F.col("currency")).alias("k"), F.col("rate").cast("double").alias("v"))
    per_year = (
        rates_yearly.where(F.col("year").isNotNull() & F.col("currency").isNotNull() & F.col("rate").isNotNull())
        .groupBy(F.col("year").cast("int").alias("fx_year"))
        .agg(F.collect_set(entry).alias("all"))
    )
    largest = F.filter("all", lambda e: ~F.exists("all", lambda o: (o["k"] == e["k"]) & (o["v"] > e["v"])))
    return per_year.select("fx_year", F.map_from_entries(largest).alias("fx_year_rates"))


def fx_convert(
    ledger: DataFrame,
    rates_daily: DataFrame | None,
    rates_yearly: DataFrame,
    cfg: TaxConfig,
) -> DataFrame:
    """Add ``tax_year``, ``fx_rate``, ``fx_source``, ``net_eur`` (and ``tax_eur``).

    Rate choice per booking: EUR -> 1; the daily rate of the booking's date;
    else the yearly rate of its year; a currency missing from a known year
    -> 1 (``assumed_1``); an unknown year, or a rate that is not positive
    -> NULL (``missing``, an issue). Both rate tables are reduced to one row
    per key and left-joined, so they never multiply bookings; Spark picks the
    join by their size. ``cfg.offline`` or ``rates_daily=None`` uses the
    yearly table only.
    """
    has_tax = C.TAX in ledger.columns if cfg.has_tax_column is None else cfg.has_tax_column
    df = ledger.withColumn(C.TAX_YEAR, F.year(C.TS).cast("bigint"))
    if rates_daily is not None and not cfg.offline:
        daily = normalize_daily_rates(rates_daily).select(
            F.col("rate_date").alias("_fx_date"),
            F.col("currency").alias("_fx_cur"),
            F.col("rate").alias("_fx_daily"),
        )
        df = df.join(
            daily,
            (F.to_date(F.col(C.TS)) == F.col("_fx_date")) & (F.col(C.CURRENCY) == F.col("_fx_cur")),
            "left",
        ).drop("_fx_date", "_fx_cur")
    else:
        df = df.withColumn("_fx_daily", F.lit(None).cast("double"))
    df = df.join(yearly_lookup(rates_yearly), F.col(C.TAX_YEAR) == F.col("fx_year"), "left")
    # Staged projections: each step references the previous step's columns,
    # so no CASE is copied into the next expression (small generated code).
    df = df.withColumn("_fx_yearly", F.try_element_at(F.col("fx_year_rates"), F.col(C.CURRENCY)))
    source = (
        F.when(F.col(C.CURRENCY) == "EUR", F.lit("eur"))
        .when(F.col("_fx_daily") <= 0, F.lit("missing"))
        .when(F.col("_fx_daily").isNotNull(), F.lit("daily"))
        .when(F.col("fx_year_rates").isNull() | (F.col("_fx_yearly") <= 0), F.lit("missing"))
        .when(F.col("_fx_yearly").isNotNull(), F.lit("yearly"))
        .otherwise(F.lit("assumed_1"))
    )
    rate = (
        F.when(F.col(C.CURRENCY) == "EUR", F.lit(1.0))
        .when(F.col("_fx_daily") <= 0, F.lit(None).cast("double"))
        .when(F.col("_fx_daily").isNotNull(), F.col("_fx_daily"))
        .when(F.col("fx_year_rates").isNull() | (F.col("_fx_yearly") <= 0), F.lit(None).cast("double"))
        .when(F.col("_fx_yearly").isNotNull(), F.col("_fx_yearly"))
        .otherwise(F.lit(1.0))
    )
    df = df.withColumns({"fx_source": source, "fx_rate": rate})
    cols = {"net_eur": F.col(C.NET) / F.col("fx_rate")}
    if has_tax:
        cols["tax_eur"] = F.col(C.TAX) / F.col("fx_rate")
    return df.withColumns(cols).drop("_fx_daily", "_fx_yearly", "fx_year", "fx_year_rates")


def gross_up(df: DataFrame, has_tax: bool) -> DataFrame:
    """``gross_eur = net_eur + |tax_eur|`` (tax 0 when absent)."""
    if has_tax:
        return df.withColumn("gross_eur", F.col("net_eur") + F.coalesce(F.abs(F.col("tax_eur")), F.lit(0.0)))
    return df.withColumn("gross_eur", F.col("net_eur"))


def rates_for_dates(
    dates: DataFrame,
    currencies: tuple[str, ...],
    rates_daily: DataFrame | None,
    rates_yearly: DataFrame,
    cfg: TaxConfig,
) -> DataFrame:
    """Every listed currency's rate for each date: (rate_date, currency,
    fx_rate, fx_source), with the same rate choice as ``fx_convert``."""
    grid = (
        dates.select(F.col("rate_date").cast("date").alias("rate_date"))
        .distinct()
        .select("rate_date", F.explode(F.array(*[F.lit(c) for c in currencies])).alias("currency"))
    )
    probe = grid.select(
        F.lit(0).alias(C.ACCOUNT),
        F.col("rate_date").cast("timestamp_ntz").alias(C.TS),
        F.col("currency").alias(C.CURRENCY),
        F.lit(1.0).alias(C.NET),
    )
    out = fx_convert(probe, rates_daily, rates_yearly, cfg.with_(has_tax_column=False))
    return out.select(F.to_date(C.TS).alias("rate_date"), C.CURRENCY, "fx_rate", "fx_source")
