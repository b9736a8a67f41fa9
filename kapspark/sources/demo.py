"""A brokerage ledger derived from the driver's TPC-H-like tables.

The driver's tables hold no bookings, so every query in the catalog runs on
this derivation (one booking per ``lineitem`` row plus one opening buy per
``part`` row). Only integer arithmetic decides the kind of a row, so the same
derivation in another engine yields the same ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kapspark.config import QUANTITY_TYPE, TaxConfig
from kapspark.sources.dims import local_table

# --- fixed values for the derivation ---------------------------------------
ISIN_PREFIXES = ["DE", "CH", "US", "FR", "IE", "GB", "LU", "XS", "12", "JP"]
CURRENCIES = ["EUR", "USD", "CHF"]
# code 0-9 -> booking type
TYPES_BY_CODE = [
    "Kauf", "Kauf", "Kauf", "Kauf",
    "Verkauf", "Verkauf",
    "Dividende", "Dividende",
    "Zinsen auf Einlagen",
    "Quellensteuer",
]
FUND_TYPES_BY_DECADE = ["equity", "mixed", "real_estate", "other", None]
OPENING_TS = "2018-12-31 00:00:00"
RATES_FROM = "2018-12-31"
RATES_TO = "2025-12-31"
SHIFT_YEARS = 24
SECURITIES = 400
ACCOUNT_WIDTH = 8

# Same-timestamp bookings are ordered by these after buys-first.
DEMO_TIEBREAK = ("order_key", "line_no", "supp_key", "quantity", "net", "tax", "currency")
DEMO_CONFIG = TaxConfig(on_issue="flag", tiebreak=DEMO_TIEBREAK)


def _isin(sec_no: Column) -> Column:
    prefix = F.element_at(F.array(*[F.lit(p) for p in ISIN_PREFIXES]), (sec_no % 10 + 1).cast("int"))
    return F.concat(prefix, F.lpad(sec_no.cast("string"), 10, "0"))


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def demo_ledger(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """Canonical ledger (plus ``sec_no``, ``code`` and order keys). With
    ``faults`` some bookings are broken, see ``with_faults``.

    The driver's files hold one row group each, which a scan cannot split;
    the pruned rows are dealt out once by order line so that this derivation
    runs in parallel. A ledger of one's own is read as it is stored.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_shipdate"
    ).repartition("l_orderkey", "l_linenumber")
    code = (F.col("l_orderkey") + 3 * F.col("l_linenumber") + F.col("l_suppkey")) % 10
    sec_no = F.col("l_partkey") % SECURITIES
    price = F.col("l_extendedprice")
    type_ = _pick(TYPES_BY_CODE, F.col("code"))
    net = (
        F.when(F.col("type") == "Kauf", -price)
        .when(F.col("type") == "Verkauf", price)
        .when(F.col("type") == "Quellensteuer", -(price / F.lit(100.0)))
        .otherwise(price / F.lit(100.0))
    )
    fee = F.when(
        F.col("code").isin(6, 7, 8), -(price / F.lit(100.0)) * F.col("l_tax") * F.lit(4)
    ).otherwise(F.lit(0.0))
    bookings = (
        li.withColumn("code", code)
        .withColumn("type", type_)
        .select(
            F.floor(F.col("l_partkey") / ACCOUNT_WIDTH).cast("bigint").alias("account_id"),
            (F.col("l_shipdate").cast("timestamp_ntz") + F.make_ym_interval(F.lit(SHIFT_YEARS), F.lit(0))).alias("ts"),
            F.col("type"),
            _isin(sec_no).alias("isin"),
            F.concat(F.lit("Security "), sec_no.cast("string")).alias("name"),
            _pick(CURRENCIES, F.col("l_suppkey") % 3).alias("currency"),
            F.col("l_quantity").cast(QUANTITY_TYPE).alias("quantity"),
            net.alias("net"),
            fee.alias("tax"),
            sec_no.cast("int").alias("sec_no"),
            F.col("code").cast("int").alias("code"),
            F.col("l_orderkey").cast("bigint").alias("order_key"),
            F.col("l_linenumber").cast("int").alias("line_no"),
            F.col("l_suppkey").cast("bigint").alias("supp_key"),
        )
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice")
    p_sec = F.col("p_partkey") % SECURITIES
    opening = part.select(
        F.floor(F.col("p_partkey") / ACCOUNT_WIDTH).cast("bigint").alias("account_id"),
        F.to_timestamp_ntz(F.lit(OPENING_TS)).alias("ts"),
        F.lit("Kauf").alias("type"),
        _isin(p_sec).alias("isin"),
        F.concat(F.lit("Security "), p_sec.cast("string")).alias("name"),
        F.lit("EUR").alias("currency"),
        F.lit(100).cast(QUANTITY_TYPE).alias("quantity"),
        (-F.col("p_retailprice") * F.lit(100)).alias("net"),
        F.lit(0.0).alias("tax"),
        p_sec.cast("int").alias("sec_no"),
        F.lit(0).alias("code"),
        F.lit(-1).cast("bigint").alias("order_key"),
        F.lit(0).alias("line_no"),
        F.lit(0).cast("bigint").alias("supp_key"),
    )
    ledger = bookings.unionByName(opening)
    return with_faults(ledger) if faults else ledger


# Which bookings are broken, and how: order_key modulo FAULT_EVERY.
FAULT_EVERY = 97
FAULTS = {
    "missing_account": 1,
    "missing_amount": 2,
    "missing_currency": 3,
    "missing_type": 4,
    "bad_date": 5,
    "unknown_currency": 6,
    "trade_missing_isin": 7,
    "trade_missing_quantity": 8,
    "trade_bad_quantity": 9,
    "year_without_rate": 10,
}


def with_faults(ledger: DataFrame) -> DataFrame:
    """Break the bookings whose order key leaves a remainder of FAULTS."""
    left = F.col("order_key") % FAULT_EVERY

    def broken(column: str, fault: str, value: Column) -> Column:
        return F.when(left == FAULTS[fault], value).otherwise(F.col(column))

    kept = dict(ledger.dtypes)
    nulls = {c: F.lit(None).cast(kept[c]) for c in ("account_id", "net", "currency", "type", "ts", "isin", "quantity")}
    return ledger.withColumn("_left", left).select(
        broken("account_id", "missing_account", nulls["account_id"]).alias("account_id"),
        F.when(left == FAULTS["bad_date"], nulls["ts"])
        .when(left == FAULTS["year_without_rate"], F.col("ts") - F.make_ym_interval(F.lit(30), F.lit(0)))
        .otherwise(F.col("ts"))
        .alias("ts"),
        broken("type", "missing_type", nulls["type"]).alias("type"),
        broken("isin", "trade_missing_isin", nulls["isin"]).alias("isin"),
        "name",
        F.when(left == FAULTS["missing_currency"], nulls["currency"])
        .when(left == FAULTS["unknown_currency"], F.lit("GBP"))
        .otherwise(F.col("currency"))
        .alias("currency"),
        F.when(left == FAULTS["trade_missing_quantity"], nulls["quantity"])
        .when(left == FAULTS["trade_bad_quantity"], (-F.col("quantity")).cast(QUANTITY_TYPE))
        .otherwise(F.col("quantity"))
        .alias("quantity"),
        broken("net", "missing_amount", nulls["net"]).alias("net"),
        *[c for c in ledger.columns if c not in ("account_id", "ts", "type", "isin", "name", "currency", "quantity", "net")],
    )


def demo_rates_daily(spark: SparkSession) -> DataFrame:
    """(rate_date, currency, rate) for USD and CHF; from 2020 on the days of
    month divisible by 5 are missing so that the yearly fallback is used."""
    days = spark.range(1).select(
        F.explode(
            F.sequence(F.to_date(F.lit(RATES_FROM)), F.to_date(F.lit(RATES_TO)), F.expr("INTERVAL 1 DAY"))
        ).alias("rate_date")
    ).where((F.year("rate_date") < 2020) | (F.dayofmonth("rate_date") % 5 != 0))
    doy = F.dayofyear("rate_date")
    usd = days.select("rate_date", F.lit("USD").alias("currency"), ((F.lit(1050) + doy % 40) / F.lit(1000.0)).alias("rate"))
    chf = days.select("rate_date", F.lit("CHF").alias("currency"), ((F.lit(930) + doy % 30) / F.lit(1000.0)).alias("rate"))
    return usd.unionByName(chf)


def demo_rules(spark: SparkSession) -> DataFrame:
    """Rules table: three country rules, one security override, 40 funds."""
    country = local_table(
        spark,
        [
            ("country", "CH", "CH", "foreign", 0.15, "share", None),
            ("country", "FR", "FR", "foreign", 0.128, "share", None),
            ("country", "GB", "GB", "foreign", 0.0, "share", None),
            ("security", "CH0000000001", "US", "foreign", 0.10, "share", None),
        ],
        "kind string, key string, source_country string, tax_treatment string, "
        "max_creditable_rate double, instrument string, fund_type string",
    )
    sec = F.col("id")
    funds = spark.range(SECURITIES).where(sec % 10 == 4).select(
        F.lit("security").alias("kind"),
        _isin(sec).alias("key"),
        F.lit("IE").alias("source_country"),
        F.lit("foreign").alias("tax_treatment"),
        F.lit(0.0).alias("max_creditable_rate"),
        F.lit("fund").alias("instrument"),
        _pick(FUND_TYPES_BY_DECADE, F.floor(sec / 10) % 5).alias("fund_type"),
    )
    return country.unionByName(funds)


def faulty_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rules table with one row per part, some of them broken by the part
    key modulo 13; keys repeat as soon as there are more than 300 parts."""
    key = F.col("p_partkey")
    left = key % 13
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return part.select(
        F.when(left == 1, F.lit("share")).otherwise(F.lit("security")).alias("kind"),
        F.when(left == 2, F.lit("")).otherwise(_isin(key % 300)).alias("key"),
        F.when(left == 3, F.lit(None)).otherwise(F.lit("US")).cast("string").alias("source_country"),
        F.when(left == 4, F.lit("exempt")).when(left == 5, F.lit("domestic")).otherwise(F.lit("foreign")).alias("tax_treatment"),
        F.when(left == 6, F.lit("1.5")).when(left == 7, F.lit("a lot")).otherwise(F.lit("0.15")).alias("max_creditable_rate"),
        F.when(left == 8, F.lit("bond")).when(left == 9, F.lit("fund")).otherwise(F.lit("share")).alias("instrument"),
        F.when(left == 9, F.lit("exotic")).when(left == 10, F.lit("equity")).otherwise(F.lit(None)).cast("string").alias("fund_type"),
    )
