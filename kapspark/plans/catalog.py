"""Named queries over the derived ledger (see ``sources.demo``).

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame with plain
column types (bigint / double / string / date). Money is summed exactly as
decimals and shown rounded half-up to 4 places, so an independent SQL
engine computing the same figures yields the same values.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kapspark import config as C
from kapspark.config import TaxConfig
from kapspark.functions import money_sum, round4
from kapspark.operators import fifo
from kapspark.operators.issues import judged_rules, rules_issues
from kapspark.operators.rules import resolve_rules
from kapspark.plans.tax_run import TaxResult, calculate
from kapspark.sources.demo import DEMO_CONFIG, demo_ledger, demo_rates_daily, demo_rules, faulty_rules
from kapspark.sources.rules import normalize_rules
from kapspark.sources.staging import stage

Query = Callable[[SparkSession, str], DataFrame]


def demo_dims(spark: SparkSession, cfg: TaxConfig = DEMO_CONFIG) -> tuple[DataFrame, DataFrame]:
    """(daily rates, judged rules) of the demo."""
    return demo_rates_daily(spark), judged_rules(normalize_rules(demo_rules(spark)), cfg)


def run(spark: SparkSession, sf_dir: str, cfg: TaxConfig = DEMO_CONFIG, faults: bool = False) -> TaxResult:
    """The full computation over the derived ledger of ``sf_dir``."""
    rates, rules = demo_dims(spark, cfg)
    return calculate(spark, demo_ledger(spark, sf_dir, faults), rates, rules, cfg, rules_validated=True)


def r4sum(c: Column) -> Column:
    return F.round(money_sum(c), 4).cast("double")


def _r4dec(c: Column) -> Column:
    """Round an exact decimal figure to 4 places -> double."""
    return F.round(c, 4).cast("double")


def _ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- queries ----------------------------------------------------------------


def q_fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    return r.ledger_fx.groupBy(C.ACCOUNT, C.TAX_YEAR, "fx_source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        r4sum(F.col("net_eur")).alias("sum_net_eur"),
        r4sum(F.col("tax_eur")).alias("sum_tax_eur"),
        r4sum(F.col("gross_eur")).alias("sum_gross_eur"),
    )


def q_gross_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    return r.classified.groupBy(C.ACCOUNT, C.TAX_YEAR, "scope").agg(
        F.count(F.lit(1)).alias("n_rows"),
        r4sum(F.col("net_eur")).alias("sum_net_eur"),
        r4sum(F.col("gross_eur")).alias("sum_gross_eur"),
    )


def q_rule_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    isins = demo_ledger(spark, sf_dir).select(C.ISIN).distinct()
    resolved = resolve_rules(isins, demo_dims(spark)[1], DEMO_CONFIG)
    return resolved.select(
        C.ISIN,
        F.col("rule.source_country").alias("source_country"),
        F.col("rule.tax_treatment").alias("tax_treatment"),
        F.col("rule.max_creditable_rate").alias("max_creditable_rate"),
        F.col("rule.instrument").alias("instrument"),
        F.col("rule.fund_type").alias("fund_type"),
        F.col("rule_origin"),
    )


_CLASS_SUMS = ("raw_tax_eur", "credit_eur", "excess_eur", "domestic_eur", "kest_eur", "soli_eur",
               "unclassified_eur", "swiss_refundable_eur")


def _classified_groups(df: DataFrame) -> DataFrame:
    return df.groupBy(C.ACCOUNT, C.TAX_YEAR, "scope", "source_country", "treatment").agg(
        F.count(F.lit(1)).alias("n_rows"),
        r4sum(F.col("gross_eur")).alias("sum_gross_eur"),
        *[r4sum(F.col(c)).alias(f"sum_{c}") for c in _CLASS_SUMS],
    )


def q_classify_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    return _classified_groups(r.classified.where(F.col("scope").isin("dividend", "interest")))


def q_classify_standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    return _classified_groups(r.standalone)


def q_tax_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    figs = ("credit", "excess", "domestic", "kest", "soli", "unclassified", "swiss_refundable")
    return r.summary.select(
        C.ACCOUNT, C.TAX_YEAR, "scope", "n_rows", *[_r4dec(F.col(f)).alias(f) for f in figs]
    )


def q_credit_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    return r.by_country.select(C.ACCOUNT, C.TAX_YEAR, "scope", "source_country", _r4dec(F.col("credit")).alias("credit"))


def q_dividend_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    return r.dividends.groupBy(C.ACCOUNT, C.TAX_YEAR, "form", "fund_type").agg(
        F.count(F.lit(1)).alias("n_rows"), r4sum(F.col("gross_eur")).alias("sum_gross_eur")
    )


def q_fund_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    return r.fund_breakdown.select(
        C.ACCOUNT,
        C.TAX_YEAR,
        "fund_type",
        "fund_label",
        "exemption_rate",
        _r4dec(F.col("gross_total")).alias("gross_total"),
        _r4dec(F.col("taxable")).alias("taxable"),
    )


def _sales_out(sales: DataFrame) -> DataFrame:
    return sales.select(
        C.ACCOUNT,
        C.ISIN,
        _ts_text(F.col(C.TS)).alias("sale_ts"),
        C.TAX_YEAR,
        F.col("order_key"),
        F.col("line_no").cast("bigint").alias("line_no"),
        F.col("supp_key"),
        F.col(C.QUANTITY).cast("double").alias("quantity"),
        round4(F.col("proceeds_eur")).alias("proceeds_eur"),
        round4(F.col("cost_eur")).alias("cost_eur"),
        round4(F.col("result_eur")).alias("result_eur"),
        F.col("shortfall").cast("bigint").alias("shortfall"),
        F.col("missing_qty").cast("double").alias("missing_qty"),
    )


def _sales_with(spark: SparkSession, sf_dir: str, cfg: TaxConfig) -> DataFrame:
    return run(spark, sf_dir, cfg).sales_all_years


def q_fifo_realized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sales_out(_sales_with(spark, sf_dir, DEMO_CONFIG))


def q_fifo_realized_as_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sales_out(_sales_with(spark, sf_dir, DEMO_CONFIG.with_(cost_mode="as_observed")))


def q_fifo_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIFO over the ledger stored in buckets by (account, ISIN): no exchange below its windows."""
    from kapspark.sources.ledger import buckets_for, write_bucketed

    name, ledger = f"ledger_{uuid.uuid4().hex}", demo_ledger(spark, sf_dir)
    stored = write_bucketed(ledger, name, scratch_dir(spark), buckets_for(ledger))
    rates, rules = demo_dims(spark)
    return _sales_out(calculate(spark, stored, rates, rules, DEMO_CONFIG, rules_validated=True).sales_all_years)


def q_fifo_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (account, ISIN) with a shortfall: how many sales lack inventory,
    the first such sale and the largest missing quantity."""
    cfg = DEMO_CONFIG
    r = run(spark, sf_dir, cfg)
    pos = fifo.trade_positions(r.ledger_fx, cfg, ledger=r.ledger)
    short = pos.where(F.col("short_row"))
    order = F.struct(F.col(C.TS), *[F.col(c) for c in cfg.tiebreak])
    return short.groupBy(C.ACCOUNT, C.ISIN).agg(
        F.count(F.lit(1)).alias("n_short_sales"),
        _ts_text(F.min_by(F.col(C.TS), order)).alias("first_short_ts"),
        F.min_by(F.col("missing_qty"), order).cast("double").alias("first_missing_qty"),
        F.max("missing_qty").cast("double").alias("max_missing_qty"),
    )


def q_stock_result_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    return r.totals.select(
        C.ACCOUNT,
        C.TAX_YEAR,
        _r4dec(F.col("stock_result")).alias("stock_result"),
        _r4dec(F.col("stock_gains")).alias("stock_gains"),
        _r4dec(F.col("stock_losses")).alias("stock_losses"),
        "n_sales",
        "n_flagged_sales",
        (F.col("n_sales") > 0).cast("bigint").alias("has_sales"),
    )


def _lines_out(lines: DataFrame) -> DataFrame:
    return lines.select(
        C.ACCOUNT,
        C.TAX_YEAR,
        F.col("line_order").cast("bigint").alias("line_order"),
        "form",
        "line",
        "label",
        _r4dec(F.col("amount")).alias("amount"),
    )


def q_form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_out(run(spark, sf_dir).form_lines)


def q_form_lines_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default policy: accounts with any issue are left out."""
    return _lines_out(run(spark, sf_dir, DEMO_CONFIG.with_(on_issue="quarantine")).form_lines)


def q_form_lines_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One requested year (FIFO still sees all years)."""
    return _lines_out(run(spark, sf_dir, DEMO_CONFIG.with_(tax_year=2021)).form_lines)


def q_report_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    return r.positions.select(C.ACCOUNT, C.TAX_YEAR, "position", "label", _r4dec(F.col("amount")).alias("amount"))


def q_detail_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    return r.sections.select(C.ACCOUNT, C.TAX_YEAR, "section", "title", "n_rows", _r4dec(F.col("total")).alias("total"))


def _display_out(lines: DataFrame) -> DataFrame:
    return lines.select(
        C.ACCOUNT,
        C.TAX_YEAR,
        F.col("line_order").cast("bigint").alias("line_order"),
        F.col("display").alias("display"),
        F.col("display_text"),
    )


def q_display_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _display_out(run(spark, sf_dir).display_lines)


def q_display_whole_euros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _display_out(run(spark, sf_dir, DEMO_CONFIG.with_(round_amount=True)).display_lines)


def q_detail_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    d = r.details()
    return d.select(
        "category",
        C.ACCOUNT,
        C.TAX_YEAR,
        _ts_text(F.col(C.TS)).alias("ts"),
        C.ISIN,
        C.TYPE,
        C.CURRENCY,
        F.col("order_key"),
        F.col("line_no").cast("bigint").alias("line_no"),
        F.col("supp_key"),
        round4(F.col("net")).alias("net"),
        round4(F.col("net_eur")).alias("net_eur"),
        round4(F.col("tax_eur")).alias("tax_eur"),
        round4(F.col("gross_eur")).alias("gross_eur"),
        "form",
        "fund_type",
        "source_country",
        "treatment",
        round4(F.col("credit_eur")).alias("credit_eur"),
        round4(F.col("excess_eur")).alias("excess_eur"),
        round4(F.col("kest_eur")).alias("kest_eur"),
        round4(F.col("soli_eur")).alias("soli_eur"),
        round4(F.col("unclassified_eur")).alias("unclassified_eur"),
        F.col(C.QUANTITY).cast("double").alias("quantity"),
        round4(F.col("proceeds_eur")).alias("proceeds_eur"),
        round4(F.col("cost_eur")).alias("cost_eur"),
        round4(F.col("result_eur")).alias("result_eur"),
    )


def q_ledger_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every data check finds something: the ledger is broken on purpose."""
    r = run(spark, sf_dir, faults=True)
    return r.issues.select(C.ACCOUNT, "issue", F.col("n").cast("bigint").alias("n"))


def q_rules_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules_issues(normalize_rules(faulty_rules(spark, sf_dir)))
    return found.groupBy("kind", "key", "issue").agg(F.count(F.lit(1)).alias("n_rules"))


def q_tax_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run(spark, sf_dir)
    return r.tax_years.select(
        C.ACCOUNT,
        F.col("n_years").cast("bigint").alias("n_years"),
        F.col("min_year").cast("bigint").alias("min_year"),
        F.col("max_year").cast("bigint").alias("max_year"),
        F.array_join(F.col("years").cast("array<string>"), ",").alias("years"),
        F.col("multi_year").cast("bigint").alias("multi_year"),
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` (shared storage on a cluster).
    Only a local session that has none (as in tests) gets a fresh one."""
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("this needs spark.checkpoint.dir (a folder that driver and executors share)")
        base = tempfile.mkdtemp(prefix="kapspark-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the checkpoint directory."""
    return os.path.join(ensure_checkpoint_dir(spark), f"kapspark-{uuid.uuid4().hex}")


def _export(ledger: DataFrame) -> dict[str, Column]:
    """The columns of a ledger export (German header), all text."""
    return {
        "Datum": F.date_format(C.TS, "dd-MM-yyyy HH:mm:ss"),
        "Auftrag #": F.col("order_key").cast("string"),
        "Transaktionen": F.col(C.TYPE),
        "Name": F.col(C.NAME),
        "ISIN": F.col(C.ISIN),
        "Anzahl": F.col(C.QUANTITY).cast("string"),
        "Kosten": F.regexp_replace(F.col(C.TAX).cast("string"), r"\.", ","),
        "Nettobetrag": F.col(C.NET).cast("string"),
        "Währung": F.col(C.CURRENCY),
        "Konto": F.col(C.ACCOUNT).cast("string"),
    }


def _write_export(ledger: DataFrame, header: list[str], path: str) -> None:
    columns = _export(ledger)
    rows = ledger.select(*[columns.get(c, F.lit("-")).alias(c) for c in header])
    rows.write.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").csv(path)


def _scan_figures(back: DataFrame) -> DataFrame:
    return back.groupBy(
        F.col(C.ACCOUNT).cast("bigint").alias(C.ACCOUNT), F.year(C.TS).cast("bigint").alias(C.TAX_YEAR)
    ).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(C.TS).isNull()).alias("n_bad_ts"),
        r4sum(F.col(C.NET)).alias("sum_net"),
        r4sum(F.col(C.TAX)).alias("sum_tax"),
        F.sum(F.col(C.QUANTITY)).cast("double").alias("sum_quantity"),
        F.count_distinct(C.ISIN).alias("n_isins"),
    )


def q_ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the derived ledger as a ledger export (``;``, latin1, German
    header, one file set) and read it back through the CSV scan."""
    from kapspark.sources.ledger import read_ledger_csv

    out = scratch_dir(spark)
    ledger = demo_ledger(spark, sf_dir)
    _write_export(ledger, list(_export(ledger)), out)
    return _scan_figures(read_ledger_csv(spark, out, account_id="Konto"))


def q_ledger_scan_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three exports side by side: one in the usual order, one with its columns the other
    way round and one more, one without the tax column. Each is read by its own header."""
    from kapspark.sources.ledger import read_ledger_csv

    out = scratch_dir(spark)
    ledger = demo_ledger(spark, sf_dir)
    usual = list(_export(ledger))
    headers = [usual, [*reversed(usual), "Depot"], [c for c in usual if c != "Kosten"]]
    for k, header in enumerate(headers):
        _write_export(ledger.where(F.col(C.ACCOUNT) % len(headers) == k), header, f"{out}/export{k}")
    paths = [f"{out}/export{k}" for k in range(len(headers))]
    return _scan_figures(read_ledger_csv(spark, paths, account_id="Konto"))


def _malformed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as exports with two headers; by the order key modulo 89 rows have a field too many
    or lack some. Read back."""
    from kapspark.sources.ledger import read_ledger_csv

    out = scratch_dir(spark)
    ledger = demo_ledger(spark, sf_dir)
    usual = ["Konto", *[c for c in _export(ledger) if c != "Konto"]]
    headers = [usual, ["Konto", *reversed(usual[1:])]]
    left = F.col("order_key") % 89
    for k, header in enumerate(headers):
        rows = ledger.where(F.col(C.ACCOUNT) % len(headers) == k)
        fields = F.array(*[F.coalesce(_export(ledger)[c], F.lit("")) for c in header])
        text = F.when(left == 1, F.array_join(F.concat(fields, F.array(F.lit("zu viel"))), ";"))
        text = text.when(left == 2, F.array_join(F.slice(fields, 1, 4), ";")).otherwise(F.array_join(fields, ";"))
        # one column that holds the whole line, so that nothing is quoted
        lines = rows.select(text.alias(";".join(header)))
        writer = lines.write.option("header", True).option("encoding", "ISO-8859-1").option("sep", "\u0001")
        writer.option("quote", "\u0000").option("escape", "\u0000").csv(f"{out}/export{k}")
    back = read_ledger_csv(spark, [f"{out}/export{k}" for k in range(len(headers))], account_id="Konto")
    return back.withColumn(C.ACCOUNT, F.col(C.ACCOUNT).cast("bigint"))


def q_ledger_scan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of exports with malformed rows: these are counted and judged no further."""
    rates, rules = demo_dims(spark)
    r = calculate(spark, _malformed_export(spark, sf_dir), rates, rules, DEMO_CONFIG.with_(tiebreak=None), rules_validated=True)
    return r.ledger_issues.select(C.ACCOUNT, "issue", F.col("n").cast("bigint").alias("n"))


def q_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three bookings behind every issue of every account of the broken ledger."""
    return run(spark, sf_dir, faults=True).bad_rows(k=3).select(
        C.ACCOUNT,
        "issue",
        F.col("nth").cast("bigint").alias("nth"),
        _ts_text(F.col(C.TS)).alias("ts"),
        C.TYPE,
        C.ISIN,
        C.CURRENCY,
        round4(F.col(C.NET)).alias("net"),
        "order_key",
        F.col("line_no").cast("bigint").alias("line_no"),
        "supp_key",
    )


def q_report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the report tables of two years one after the other and read all four tables back.
    FIFO sees all years for either of them: it runs once, and both read its stored result."""
    from kapspark.sources.sinks import write_reports

    ensure_checkpoint_dir(spark)
    out = scratch_dir(spark)
    result = run(spark, sf_dir, DEMO_CONFIG.with_(checkpoint_sales=True))
    for year in (2021, 2022):
        write_reports(result.for_year(year), out)
    tables = {
        "form_lines": ("line", F.col("line"), "amount"),
        "credit_by_country": ("country", F.concat_ws(":", "scope", F.coalesce("source_country", F.lit(""))), "credit"),
        "fund_breakdown": ("fund", F.col("fund_type"), "taxable"),
        "report_positions": ("position", F.col("position"), "amount"),
    }
    back = None
    for name, (kind, item, amount) in tables.items():
        rows = spark.read.parquet(f"{out}/{name}").select(
            F.col(C.ACCOUNT),
            F.col(C.TAX_YEAR).cast("bigint").alias(C.TAX_YEAR),
            F.lit(kind).alias("kind"),
            item.alias("item"),
            _r4dec(F.col(amount)).alias("amount"),
        )
        back = rows if back is None else back.unionByName(rows)
    return back


def _lots_out(lots: DataFrame) -> DataFrame:
    return lots.select(
        C.ACCOUNT,
        C.ISIN,
        _ts_text(F.col(C.TS)).alias("buy_ts"),
        "order_key",
        F.col("line_no").cast("bigint").alias("line_no"),
        "supp_key",
        F.col("lot_qty").cast("double").alias("lot_qty"),
        F.col("remaining").cast("double").alias("remaining"),
        round4(F.col("open_cost_eur")).alias("open_cost_eur"),
        F.col("shortfall").cast("bigint").alias("shortfall"),
    )


def q_open_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lots_out(run(spark, sf_dir).open_lots)


def q_open_lots_as_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lots_out(run(spark, sf_dir, DEMO_CONFIG.with_(cost_mode="as_observed")).open_lots)


def q_fifo_from_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales from 2022 on, matched from the stored lots of the end of 2021 without the bookings before."""
    rates, rules = demo_dims(spark)
    ledger, cut = demo_ledger(spark, sf_dir), F.year(C.TS) <= 2021
    ensure_checkpoint_dir(spark)
    before = calculate(spark, ledger.where(cut), rates, rules, DEMO_CONFIG, rules_validated=True)
    lots = stage(before.open_lots, "lots")
    after = calculate(spark, ledger.where(~cut), rates, rules, DEMO_CONFIG, rules_validated=True, lots=lots)
    # what a key that lacked pieces before lacks now depends on what it lacked then
    return _sales_out(after.sales_all_years).drop("missing_qty")


def q_detail_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the detail export as CSV and add up what is read back."""
    from kapspark import constants as K
    from kapspark.sources.sinks import write_details

    out = scratch_dir(spark)
    details = run(spark, sf_dir).details()
    write_details(details, out)
    back = spark.read.option("sep", K.DEFAULT_SEPARATOR).option("header", True).csv(out)
    return back.groupBy(
        "category", F.col(C.ACCOUNT).cast("bigint").alias(C.ACCOUNT), F.col(C.TAX_YEAR).cast("bigint").alias(C.TAX_YEAR)
    ).agg(
        F.count(F.lit(1)).alias("n_rows"),
        r4sum(F.col("gross_eur").cast("double")).alias("sum_gross_eur"),
        r4sum(F.col("result_eur").cast("double")).alias("sum_result_eur"),
    )


def q_rate_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate payloads for every ship date, flat on even days and nested under
    the date on odd ones, flattened to daily rates."""
    from kapspark.sources.rates import rates_from_payloads

    day = F.col("requested_date")
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").cast("date").alias("requested_date")).distinct()
    part = (F.dayofyear(day) * 7 % 400) * 100 + 37
    rates = F.format_string('{"USD": 1.%06d, "CHF": 0.9%05d, "JPY": 160.5}', part + 50_000, part)
    nested = F.format_string('{"%s": %s}', F.date_format(day, "yyyy-MM-dd"), rates)
    body = F.format_string('{"date": "2001-01-01", "rates": %s}', F.when(F.dayofmonth(day) % 2 == 0, rates).otherwise(nested))
    return rates_from_payloads(days.withColumn("body", body))


QUERIES: dict[str, Query] = {
    "fx_convert": q_fx_convert,
    "gross_income": q_gross_income,
    "rule_resolution": q_rule_resolution,
    "classify_embedded": q_classify_embedded,
    "classify_standalone": q_classify_standalone,
    "tax_summary": q_tax_summary,
    "credit_by_country": q_credit_by_country,
    "dividend_forms": q_dividend_forms,
    "fund_breakdown": q_fund_breakdown,
    "fifo_realized": q_fifo_realized,
    "fifo_realized_as_observed": q_fifo_realized_as_observed,
    "fifo_bucketed": q_fifo_bucketed,
    "fifo_shortfall": q_fifo_shortfall,
    "stock_result_split": q_stock_result_split,
    "form_lines": q_form_lines,
    "form_lines_quarantine": q_form_lines_quarantine,
    "form_lines_of_year": q_form_lines_of_year,
    "report_positions": q_report_positions,
    "detail_sections": q_detail_sections,
    "display_amounts": q_display_amounts,
    "display_whole_euros": q_display_whole_euros,
    "detail_export": q_detail_export,
    "ledger_issues": q_ledger_issues,
    "rules_issues": q_rules_issues,
    "tax_years": q_tax_years,
    "ledger_scan": q_ledger_scan,
    "ledger_scan_mixed": q_ledger_scan_mixed,
    "ledger_scan_issues": q_ledger_scan_issues,
    "bad_rows": q_bad_rows,
    "open_lots": q_open_lots,
    "open_lots_as_observed": q_open_lots_as_observed,
    "fifo_from_lots": q_fifo_from_lots,
    "report_sink": q_report_sink,
    "detail_sink": q_detail_sink,
    "rate_payloads": q_rate_payloads,
}
