"""Report relations: per account-year totals, form lines, fund breakdown,
report positions, display amounts and the detail export frame.

All figures per account-year come out of ONE aggregate over a union of
narrow fact rows (presence, classified income, sales), so each fact table is
pre-aggregated map-side and shuffled once on (account_id, tax_year) instead
of being joined figure by figure.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kapspark import config as C
from kapspark import constants as K
from kapspark.config import MONEY_SUM_TYPE
from kapspark.functions import display_amount, money_sum, nonzero_sum
from kapspark.sources.dims import fund_exemptions

KEYS = (C.ACCOUNT, C.TAX_YEAR)


def _zero() -> Column:
    return F.lit(0).cast("decimal(38,10)")


_FIGURE_COLS = ("credit_eur", "excess_eur", "domestic_eur", "kest_eur", "soli_eur", "unclassified_eur",
                "swiss_refundable_eur")


FOREIGN_TREATMENTS = ("foreign", "foreign_without_gross_income")


def _facts(
    rows: DataFrame, sales: DataFrame, extra: Mapping[str, Column] | None = None, present: DataFrame | None = None
) -> DataFrame:
    """Narrow fact rows: every booking of the year(s) (``kind`` = its income
    scope, or ``row``) and every realised sale (``kind`` = ``sale``).
    ``taxed_abroad`` rows carry the country whose credit they belong to.
    ``extra``: more text columns of the bookings. ``present``: the account-years with
    bookings, once each; ``rows`` then need no bookings of no income type."""
    nul_d = F.lit(None).cast("double")
    abroad = F.coalesce(F.col("treatment").isin(*FOREIGN_TREATMENTS), F.lit(False))
    income = rows.select(
        *KEYS,
        F.coalesce(F.col("scope"), F.lit("row")).alias("kind"),
        F.col("gross_eur"),
        F.col("form"),
        *[F.col(c) for c in _FIGURE_COLS],
        nul_d.alias("result_eur"),
        abroad.alias("taxed_abroad"),
        F.when(abroad, F.col("source_country")).alias("country"),
        *[c.cast("string").alias(name) for name, c in (extra or {}).items()],
    )
    sold = sales.select(
        *KEYS,
        F.lit("sale").alias("kind"),
        nul_d.alias("gross_eur"),
        F.lit(None).cast("string").alias("form"),
        *[nul_d.alias(c) for c in _FIGURE_COLS],
        F.col("result_eur"),
        F.lit(False).alias("taxed_abroad"),
        F.lit(None).cast("string").alias("country"),
        *[F.lit(None).cast("string").alias(name) for name in extra or {}],
    )
    facts = income.unionByName(sold)
    if present is None:
        return facts
    marks = present.select(*KEYS, F.lit("row").alias("kind"), F.lit(False).alias("taxed_abroad"))
    return facts.unionByName(marks, allowMissingColumns=True)


def account_year_totals(
    rows: DataFrame, sales: DataFrame, has_tax: bool, countries: bool = False, present: DataFrame | None = None
) -> DataFrame:
    """One row per account-year with every figure (exact decimals, zeros
    where nothing contributes).

    ``rows``: every booking of the year(s) with ``scope`` (NULL for bookings
    of no income type), ``gross_eur``, ``form`` and the tax split; they also
    define which account-years exist. ``sales``: realised sales of the
    year(s) (flagged ones have a NULL result and drop out of the sums).
    ``countries``: also an array of (country, credit), one entry for each
    country with taxed foreign rows; the rows are then summed per country
    first, in the same pass. ``present``: the distinct account-years; ``rows``
    may then be the income bookings alone, so most bookings are neither
    classified nor summed.
    """
    kind, form, res = F.col("kind"), F.col("form"), F.col("result_eur")
    dividend, sale, cls = kind == "dividend", kind == "sale", kind.isin("dividend", "interest", "standalone")
    sums = {
        "domestic_share_dividends": F.when(dividend & (form == K.DOMESTIC_SHARE_FORM), F.col("gross_eur")),
        "foreign_share_dividends": F.when(dividend & (form == K.FOREIGN_SHARE_FORM), F.col("gross_eur")),
        "fund_dividends": F.when(dividend & (form == K.FUND_FORM), F.col("gross_eur")),
        "interest": F.when(kind == "interest", F.col("gross_eur")),
        **{
            name: F.when(cls, F.col(f"{name}_eur"))
            for name in ("credit", "excess", "domestic", "kest", "soli", "unclassified", "swiss_refundable")
        },
        "dividend_credit": F.when(dividend, F.col("credit_eur")),
        "interest_credit": F.when(kind == "interest", F.col("credit_eur")),
        "stock_result": F.when(sale, res),
        "stock_gains": F.when(sale & (res > 0), res),
        "stock_losses": F.when(sale & (res < 0), res),
    }
    counts = {
        "n_sales": sale & res.isNotNull(),
        "n_flagged_sales": sale & res.isNull(),
        "n_standalone": kind == "standalone",
    }
    by = (*KEYS, "taxed_abroad", "country") if countries else KEYS
    out = (
        _facts(rows, sales, present=present)
        .select(*by, *[c.alias(name) for name, c in (sums | counts).items()])
        .groupBy(*by)
        .agg(
            *[F.coalesce(nonzero_sum(name, MONEY_SUM_TYPE), _zero()).alias(name) for name in sums],
            *[F.count_if(name).alias(name) for name in counts],
        )
    )
    if countries:
        entry = F.struct(F.col("country"), F.col("credit"))
        # a few rows per account-year: gathered as they are, then summed in one place
        out = out.repartition(*KEYS).groupBy(*KEYS).agg(
            *[_exact_sum(name).alias(name) for name in sums],
            *[F.sum(name).alias(name) for name in counts],
            F.collect_list(F.when(F.col("taxed_abroad"), entry)).alias("countries"),
        )
    return out.withColumn(
        "foreign_capital_income", F.col("foreign_share_dividends") + F.col("interest")
    ).withColumn("has_tax_info", F.lit(has_tax) | (F.col("n_standalone") > 0))


# --- every report table from one stored aggregate ----------------------------
_FACT_SUMS = ("gross_eur", *_FIGURE_COLS, "result_eur")


def account_facts(rows: DataFrame, sales: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """The finest sums that any report table needs: one row for each account-year, kind of
    booking, form, fund type and country taxed abroad. A handful of rows per account-year,
    however many bookings it has; arguments as in ``account_year_totals``."""
    fund = F.when((F.col("scope") == "dividend") & (F.col("form") == K.FUND_FORM), F.coalesce("fund_type", F.lit("other")))
    res = F.col("result_eur")
    signed = {"gains_eur": F.when(res > 0, res), "losses_eur": F.when(res < 0, res)}
    return (
        _facts(rows, sales, {"fund": fund}, present)
        .withColumns(signed)
        .groupBy(*KEYS, "kind", "form", "fund", "taxed_abroad", "country")
        .agg(
            # zero where all amounts are zero, NULL where there are none
            *[
                F.when(F.count(c) > 0, F.coalesce(nonzero_sum(c, MONEY_SUM_TYPE), _zero())).alias(c)
                for c in (*_FACT_SUMS, *signed)
            ],
            F.count(F.lit(1)).alias("n"),
            F.count("result_eur").alias("n_results"),
        )
    )


def _exact_sum(name: str) -> Column:
    return F.coalesce(nonzero_sum(name).cast("decimal(38,10)"), _zero())


def totals_of(facts: DataFrame, has_tax: bool) -> DataFrame:
    """``account_year_totals`` with its ``countries``, from ``account_facts``."""
    kind, form = F.col("kind"), F.col("form")
    dividend, sale, cls = kind == "dividend", kind == "sale", kind.isin("dividend", "interest", "standalone")
    by_kind = {
        "domestic_share_dividends": F.when(dividend & (form == K.DOMESTIC_SHARE_FORM), F.col("gross_eur")),
        "foreign_share_dividends": F.when(dividend & (form == K.FOREIGN_SHARE_FORM), F.col("gross_eur")),
        "fund_dividends": F.when(dividend & (form == K.FUND_FORM), F.col("gross_eur")),
        "interest": F.when(kind == "interest", F.col("gross_eur")),
        **{c.removesuffix("_eur"): F.when(cls, F.col(c)) for c in _FIGURE_COLS},
        "dividend_credit": F.when(dividend, F.col("credit_eur")),
        "interest_credit": F.when(kind == "interest", F.col("credit_eur")),
        "stock_result": F.when(sale, F.col("result_eur")),
        "stock_gains": F.when(sale, F.col("gains_eur")),
        "stock_losses": F.when(sale, F.col("losses_eur")),
    }
    n = F.col("n")
    counts = {
        "n_sales": F.when(sale, F.col("n_results")),
        "n_flagged_sales": F.when(sale, n - F.col("n_results")),
        "n_standalone": F.when(kind == "standalone", n),
    }
    by = (*KEYS, "taxed_abroad", "country")
    per_country = facts.select(*by, *[c.alias(name) for name, c in (by_kind | counts).items()]).groupBy(*by).agg(
        *[_exact_sum(name).alias(name) for name in by_kind],
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts],
    )
    entry = F.struct(F.col("country"), F.col("credit"))
    out = per_country.repartition(*KEYS).groupBy(*KEYS).agg(
        *[_exact_sum(name).alias(name) for name in by_kind],
        *[F.sum(name).alias(name) for name in counts],
        F.collect_list(F.when(F.col("taxed_abroad"), entry)).alias("countries"),
    )
    foreign = F.col("foreign_share_dividends") + F.col("interest")
    return out.withColumn("foreign_capital_income", foreign).withColumn(
        "has_tax_info", F.lit(has_tax) | (F.col("n_standalone") > 0)
    )


def credit_by_country_of(facts: DataFrame) -> DataFrame:
    """``credit_by_country`` from ``account_facts``."""
    sets = [(*KEYS, "kind", "country"), (*KEYS, "country")]
    out = facts.where("taxed_abroad").groupingSets(sets, *KEYS, "kind", "country").agg(
        F.sum("credit_eur").cast("decimal(38,10)").alias("credit"), F.grouping("kind").alias("_g")
    )
    scope = F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col("kind"))
    return out.select(*KEYS, scope.alias("scope"), F.col("country").alias("source_country"), "credit")


def fund_breakdown_of(spark: SparkSession, facts: DataFrame) -> DataFrame:
    """``fund_breakdown`` from ``account_facts``."""
    funds = facts.where(F.col("fund").isNotNull()).groupBy(*KEYS, F.col("fund").alias("fund_type"))
    return _with_exemptions(spark, funds.agg(F.sum("gross_eur").cast("decimal(38,10)").alias("gross_total")))


def form_lines(totals: DataFrame) -> DataFrame:
    """(account_id, tax_year, line_order, form, line, label, amount): the 8
    form lines per account-year, plus the refund line when it is positive."""
    entries = [
        F.struct(
            F.lit(i).alias("line_order"),
            F.lit(form).alias("form"),
            F.lit(line).alias("line"),
            F.lit(label).alias("label"),
            F.col(fig).cast("decimal(38,10)").alias("amount"),
        )
        for i, (form, line, label, fig) in enumerate(K.FORM_LINES + (K.REFUND_LINE,))
    ]
    refund_order = len(K.FORM_LINES)
    return (
        totals.select(*KEYS, F.inline(F.array(*entries)))
        .where((F.col("line_order") != refund_order) | (F.col("amount") > 0))
    )


def fund_breakdown(spark: SparkSession, dividends: DataFrame) -> DataFrame:
    """Fund dividends per account-year and fund type (NULL -> other) with the
    partial-exemption rate (unknown -> 0) and the taxable remainder."""
    funds = dividends.where(F.col("form") == K.FUND_FORM)
    totals = funds.groupBy(*KEYS, F.coalesce(F.col("fund_type"), F.lit("other")).alias("fund_type")).agg(
        money_sum(F.col("gross_eur")).alias("gross_total")
    )
    return _with_exemptions(spark, totals)


def _with_exemptions(spark: SparkSession, totals: DataFrame) -> DataFrame:
    ex = fund_exemptions(spark)  # four rows
    out = totals.join(F.broadcast(ex), "fund_type", "left")
    rate = F.coalesce(F.col("exemption_rate"), F.lit(0.0))
    # a rate has four places, so the product keeps all ten places of the sum
    kept = F.lit(1).cast("decimal(5,4)") - rate.cast("decimal(5,4)")
    return out.select(
        *KEYS,
        "fund_type",
        F.coalesce(F.col("fund_label"), F.concat(F.lit("Fonds (Typ: "), F.col("fund_type"), F.lit(")"))).alias(
            "fund_label"
        ),
        rate.alias("exemption_rate"),
        F.format_string("%.0f%%", F.bround(rate * 100, 0)).alias("exemption_pct"),
        F.col("gross_total"),
        (F.col("gross_total").cast("decimal(30,10)") * kept.cast("decimal(5,4)")).cast("decimal(38,10)").alias("taxable"),
    )


# --- fixed values: report position labels -----------------------------------
POSITION_LABELS: dict[str, str] = {
    "1.kap18": "Anlage KAP (Zeile 18 - Inländische Kapitalerträge, deutsche Aktien)",
    "1.kap19_dividends": "Anlage KAP (Zeile 19 - Ausländische Kapitalerträge, ausländische Aktien)",
    "1.kapinv4": "Anlage KAP-INV (Zeile 4 - Investmentfonds-/ETF-Ausschüttungen)",
    "2.kap19_interest": "Anlage KAP (Zeile 19 - Ausländische Zinsen)",
    "3.kap41": "Anlage KAP (Zeile 41 - Anrechenbare ausländische Steuern)",
    "3.dividend_credit": "Davon Quellensteuer auf Dividenden",
    "3.interest_credit": "Davon Quellensteuer auf Zinsen",
    "3.excess": "Nicht anrechenbarer ausländischer Steuerüberhang",
    "3.swiss_refundable": "Davon Schweizer Verrechnungssteuer, separat rückforderbar",
    "4.kest": "Zeile 37 - Kapitalertragsteuer",
    "4.soli": "Zeile 38 - Solidaritätszuschlag",
    "4.domestic": "Summe deutsche Kapitalertragsteuer einschließlich Soli",
    "4.unclassified": "Nicht in Zeile 41 (fehlende ISIN-Regel oder Bruttobetrag)",
    "5.stock_result": "Realisierte Gewinne/Verluste aus Aktienverkäufen",
    "5.no_sales": "Anlage KAP: Keine Eintragung für Aktienverkäufe (keine Verkaufstransaktionen).",
    "5.stock_gains": "Davon Aktiengewinne (separates Formularfeld)",
    "5.stock_losses": "Davon Aktienverluste (separates Formularfeld)",
}

# position -> (figure, condition kind): "always", "tax" (only with tax info),
# "tax_nonzero", "nonzero", "no_sales", "sales_nonzero"
_POSITIONS = (
    ("1.kap18", "domestic_share_dividends", "always"),
    ("1.kap19_dividends", "foreign_share_dividends", "always"),
    ("1.kapinv4", "fund_dividends", "always"),
    ("2.kap19_interest", "interest", "always"),
    ("3.kap41", "credit", "tax"),
    ("3.dividend_credit", "dividend_credit", "tax"),
    ("3.interest_credit", "interest_credit", "tax"),
    ("3.excess", "excess", "tax_nonzero"),
    ("3.swiss_refundable", "swiss_refundable", "tax_nonzero"),
    ("4.kest", "kest", "tax"),
    ("4.soli", "soli", "tax"),
    ("4.domestic", "domestic", "tax"),
    ("4.unclassified", "unclassified", "tax_nonzero"),
    ("5.stock_result", "stock_result", "always"),
    ("5.no_sales", None, "no_sales"),
    ("5.stock_gains", "stock_gains", "sales_nonzero"),
    ("5.stock_losses", "stock_losses", "sales_nonzero"),
)


def report_positions(totals: DataFrame) -> DataFrame:
    """(account_id, tax_year, position, label, amount): the report's nested
    positions with the same visibility rules (tax block only with tax info,
    excess / refund / unclassified only when non-zero, gains and losses only
    with sales), plus one ``3.country.XX`` row per source country. ``totals``
    come with their ``countries``."""
    entries = []
    for pos, fig, cond in _POSITIONS:
        amount = F.col(fig).cast("decimal(38,10)") if fig else F.lit(None).cast("decimal(38,10)")
        show = {
            "always": F.lit(True),
            "tax": F.col("has_tax_info"),
            "tax_nonzero": F.col("has_tax_info") & (amount != 0),
            "no_sales": F.col("n_sales") == 0,
            "sales_nonzero": (F.col("n_sales") > 0) & (amount != 0),
        }[cond]
        entries.append(
            F.struct(
                F.lit(pos).alias("position"),
                F.lit(POSITION_LABELS[pos]).alias("label"),
                amount.alias("amount"),
                show.alias("show"),
            )
        )
    abroad = F.transform(
        "countries",
        lambda c: F.struct(
            F.concat(F.lit("3.country."), F.coalesce(c["country"], F.lit(""))).alias("position"),
            F.coalesce(c["country"], F.lit("")).alias("label"),
            c["credit"].cast("decimal(38,10)").alias("amount"),
            F.lit(True).alias("show"),
        ),
    )
    return totals.select(*KEYS, F.inline(F.concat(F.array(*entries), abroad))).where(F.col("show")).drop("show")


def display_amounts(df: DataFrame, amount_col: str = "amount", whole_euros: bool = False) -> DataFrame:
    """Add ``display`` (half-even to cents or whole euros) and ``display_text``."""
    shown = display_amount(F.col(amount_col), whole_euros)
    text = (
        F.format_string("%.0f EUR", shown) if whole_euros else F.format_string("%.2f EUR", shown)
    )
    return df.withColumn("display", shown).withColumn("display_text", text)


def detail_frame(classified: DataFrame, sales: DataFrame) -> DataFrame:
    """Diagonal union of income and sales with a ``category``; missing columns
    are NULL. Income is one pass: dividends and interest are told apart by a
    CASE. Separate tax bookings are not part of it."""
    scope = F.col("scope")
    income = classified.where(scope.isin("dividend", "interest")).withColumn(
        "category",
        F.when(scope == "dividend", F.lit(K.DETAIL_CATEGORY_DIVIDEND)).otherwise(F.lit(K.DETAIL_CATEGORY_INTEREST)),
    )
    return income.unionByName(sales.withColumn("category", F.lit(K.DETAIL_CATEGORY_SALE)), allowMissingColumns=True)


# --- fixed values: detail section titles ------------------------------------
SECTION_TITLES: dict[str, str] = {
    "dividend": "Details Dividenden",
    "interest": "Details Zinsen",
    "standalone": "Details separate Quellensteuer-Buchungen",
    "sale": "Details Aktienverkäufe",
}


def section_totals(classified: DataFrame, sales: DataFrame) -> DataFrame:
    """(account_id, tax_year, section, title, n_rows, total) for the detail
    sections: the sum is the gross amount for dividends and interest, the
    net EUR amount for separate tax bookings and the result for sales
    (uncosted sales count as rows but add nothing). Empty sections have no row."""
    income = classified.select(
        *KEYS,
        F.col("scope").alias("section"),
        F.when(F.col("scope") == "standalone", F.col("net_eur")).otherwise(F.col("gross_eur")).alias("amount"),
    )
    sold = sales.select(*KEYS, F.lit("sale").alias("section"), F.col("result_eur").alias("amount"))
    titles = F.create_map(*[x for k, v in SECTION_TITLES.items() for x in (F.lit(k), F.lit(v))])
    return (
        income.unionByName(sold)
        .groupBy(*KEYS, "section")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(money_sum(F.col("amount")), _zero()).alias("total"))
        .withColumn("title", F.element_at(titles, F.col("section")))
    )


# --- fixed values: columns of the detail sections, in their order -----------
INCOME_SECTION_COLUMNS = (
    C.TS, C.NAME, C.NET, C.CURRENCY, "net_eur", "gross_eur", C.TAX, "tax_eur", "form", "source_country", "treatment",
    "credit_eur", "excess_eur", "kest_eur", "soli_eur", "unclassified_eur",
)
SALE_SECTION_COLUMNS = (C.TS, C.ISIN, C.QUANTITY, "proceeds_eur", "cost_eur", "result_eur")


def section_rows(classified: DataFrame, sales: DataFrame, section: str) -> DataFrame:
    """The rows of one detail section (a key of SECTION_TITLES) with the
    account-year and the section's columns, as far as the ledger has them."""
    if section == "sale":
        rows, wanted = sales, SALE_SECTION_COLUMNS
    else:
        rows, wanted = classified.where(F.col("scope") == section), INCOME_SECTION_COLUMNS
    return rows.select(*KEYS, *[c for c in wanted if c in rows.columns])
