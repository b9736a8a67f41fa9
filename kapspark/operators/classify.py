"""Category split, withholding-tax classification, dividend forms, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kapspark import config as C
from kapspark import constants as K
from kapspark.config import TaxConfig
from kapspark.functions import isin_key, money_sum

# Summary figure -> per-row column.
SUMMARY_FIGURES = {
    "credit": "credit_eur",
    "excess": "excess_eur",
    "domestic": "domestic_eur",
    "kest": "kest_eur",
    "soli": "soli_eur",
    "unclassified": "unclassified_eur",
    "swiss_refundable": "swiss_refundable_eur",
}


SCOPE_OF_CATEGORY = {"dividend": "dividend", "interest": "interest", "withholding_tax": "standalone"}


def categories(cfg: TaxConfig) -> Column:
    """Array of the categories a row's type belongs to (lists may overlap).

    Built from the configured type lists as literals: no join, and a type in
    two lists puts its row in both categories.
    """
    by_cat: dict[str, list[str]] = {}
    for t, cat in cfg.type_map_rows():
        by_cat.setdefault(cat, []).append(t)
    members = [F.when(F.col(C.TYPE).isin(*types), F.lit(cat)) for cat, types in by_cat.items()]
    return F.filter(F.array(*members), lambda x: x.isNotNull())


def income_types(cfg: TaxConfig) -> list[str]:
    """The types that belong to any income scope."""
    return sorted({t for t, category in cfg.type_map_rows() if category in SCOPE_OF_CATEGORY})


def categorize(df: DataFrame, spark: SparkSession, cfg: TaxConfig) -> DataFrame:
    """One row per (booking, category); rows of no configured type drop out."""
    return df.withColumn("category", F.explode(categories(cfg)))


def income_scopes(df: DataFrame, cfg: TaxConfig) -> DataFrame:
    """Every booking once per income scope it belongs to; bookings of no
    income type are kept once with ``scope`` NULL (they still mark the
    account-year as present)."""
    income = {c: s for c, s in SCOPE_OF_CATEGORY.items()}
    scopes = F.filter(
        F.transform(
            categories(cfg),
            lambda c: F.when(c == "dividend", F.lit(income["dividend"]))
            .when(c == "interest", F.lit(income["interest"]))
            .when(c == "withholding_tax", F.lit(income["withholding_tax"])),
        ),
        lambda x: x.isNotNull(),
    )
    return df.withColumn("scope", F.explode_outer(scopes))


def classify_income(df: DataFrame, has_tax: bool) -> DataFrame:
    """Tax split for every income row (needs ``scope`` and ``rule``).

    Dividends and interest classify the tax embedded in the booking (without
    a tax column there is nothing to classify: treatment and country stay
    NULL, amounts 0); separate tax bookings classify their own net amount.
    Non-income rows (``scope`` NULL) get NULLs. Built as staged projections
    that reference earlier columns, so the generated code stays small.
    """
    zero = F.lit(0.0)
    scope, rule = F.col("scope"), F.col("rule")
    standalone = scope == "standalone"
    embedded = scope.isin("dividend", "interest")
    income = scope.isNotNull()
    raw = F.when(standalone, F.abs(F.coalesce(F.col("net_eur"), zero)))
    if has_tax:
        raw = raw.when(embedded, F.abs(F.coalesce(F.col("tax_eur"), zero)))
    else:
        raw = raw.when(embedded, zero)
    df = df.withColumn("raw_tax_eur", raw)
    r = F.col("raw_tax_eur")
    treatment = F.when(
        standalone,
        F.when(r == 0, F.lit("none"))
        .when(rule["tax_treatment"] == "domestic", F.lit("domestic"))
        .when(rule["tax_treatment"] == "foreign", F.lit("foreign_without_gross_income"))
        .otherwise(F.lit("unclassified")),
    )
    if has_tax:
        treatment = treatment.when(
            embedded,
            F.when(r == 0, F.lit("none"))
            .when(rule.isNull(), F.lit("unclassified"))
            .when(rule["tax_treatment"] == "domestic", F.lit("domestic"))
            .otherwise(F.lit("foreign")),
        )
    country = F.when(standalone, rule["source_country"])
    if has_tax:
        country = country.when(embedded, rule["source_country"])
    df = df.withColumns({"treatment": treatment, "source_country": country})
    t = F.col("treatment")
    gross_income = F.abs(F.coalesce(F.col("net_eur"), zero)) + r
    df = df.withColumns(
        {
            "credit_eur": F.when(t == "foreign", F.least(r, gross_income * rule["max_creditable_rate"]))
            .when(income, zero),
            "domestic_eur": F.when(t == "domestic", r).when(income, zero),
            "unclassified_eur": F.when(t.isin("unclassified", "foreign_without_gross_income"), r).when(income, zero),
        }
    )
    df = df.withColumns(
        {
            "excess_eur": F.when(t == "foreign", r - F.col("credit_eur")).when(income, zero),
            "kest_eur": F.col("domestic_eur") / F.lit(K.KEST_WITH_SOLI_FACTOR),
        }
    )
    return df.withColumns(
        {
            "soli_eur": F.col("domestic_eur") - F.col("kest_eur"),
            "swiss_refundable_eur": F.when(
                (t == "foreign") & (F.col("source_country") == K.SWISS_COUNTRY), F.col("excess_eur")
            ).when(income, zero),
        }
    )


def classify_embedded(income: DataFrame, has_tax: bool = True) -> DataFrame:
    """Classify tax embedded in income rows (needs ``rule``, ``net_eur``,
    ``tax_eur``): the dividend / interest branch of ``classify_income``."""
    had_scope = "scope" in income.columns
    out = classify_income(income if had_scope else income.withColumn("scope", F.lit("dividend")), has_tax)
    return out if had_scope else out.drop("scope")


def classify_standalone(bookings: DataFrame) -> DataFrame:
    """Classify separate tax bookings (the tax is the booking's net amount)."""
    out = classify_income(bookings.withColumn("scope", F.lit("standalone")), has_tax=False)
    return out.drop("scope")


def tag_dividend_forms(dividends: DataFrame) -> DataFrame:
    """``form`` and ``fund_type`` per dividend row (needs ``rule``).

    Funds go to KAP-INV with their fund type; other rows go to KAP, domestic
    when the source country (rule, else the ISIN's first two characters) is
    DE, foreign otherwise (an empty ISIN included).
    """
    rule = F.col("rule")
    is_fund = rule.isNotNull() & (rule["instrument"] == "fund")
    country = F.when(rule.isNotNull(), rule["source_country"]).otherwise(F.substring(isin_key(F.col(C.ISIN)), 1, 2))
    form = (
        F.when(is_fund, F.lit(K.FUND_FORM))
        .when(country == K.DOMESTIC_COUNTRY, F.lit(K.DOMESTIC_SHARE_FORM))
        .otherwise(F.lit(K.FOREIGN_SHARE_FORM))
    )
    is_div = F.col("scope") == "dividend" if "scope" in dividends.columns else F.lit(True)
    return dividends.withColumns(
        {
            "form": F.when(is_div, form),
            "fund_type": F.when(is_div & is_fund, rule["fund_type"]).cast("string"),
        }
    )


def tax_summary(classified: DataFrame, keys: tuple[str, ...] = (C.ACCOUNT, C.TAX_YEAR)) -> DataFrame:
    """Sums per (keys, scope) and per keys over all scopes, in one aggregate.

    ``scope`` is ``total`` on the combined rows (told apart by ``grouping``,
    not by NULL). Figures are exact decimal sums.
    """
    aggs = [money_sum(F.col(col)).alias(name) for name, col in SUMMARY_FIGURES.items()]
    aggs.append(F.count(F.lit(1)).alias("n_rows"))
    sets = [tuple(keys) + ("scope",), tuple(keys)]
    out = classified.groupingSets(sets, *keys, "scope").agg(*aggs, F.grouping("scope").alias("_g"))
    return out.withColumn("scope", F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col("scope"))).drop("_g")


def credit_by_country(classified: DataFrame, keys: tuple[str, ...] = (C.ACCOUNT, C.TAX_YEAR)) -> DataFrame:
    """Creditable foreign tax per source country, per scope and combined.

    A country is listed iff it has a taxed foreign row (standalone foreign
    bookings list their country with zero credit).
    """
    rows = classified.where(F.col("treatment").isin("foreign", "foreign_without_gross_income"))
    sets = [tuple(keys) + ("scope", "source_country"), tuple(keys) + ("source_country",)]
    out = rows.groupingSets(sets, *keys, "scope", "source_country").agg(
        money_sum(F.col("credit_eur")).alias("credit"), F.grouping("scope").alias("_g")
    )
    return out.withColumn("scope", F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col("scope"))).drop("_g")
