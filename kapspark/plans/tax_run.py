"""Wiring: ledger + rates + rules -> every result as a lazy DataFrame.

Planning triggers only bounded jobs: the hot-key count of FIFO, the optional
parquet materialisation of the converted ledger and the FIFO result, and for
``on_issue="error"`` the counts per kind of issue.
Two independent exchange families come out of it: trades by
(account_id, isin) for FIFO and income by (account_id, tax_year) for the
figures. Quarantine removes accounts from aggregated results after the
aggregate; only row-level outputs meet the list of accounts row by row.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kapspark import config as C
from kapspark.config import TaxConfig
from kapspark.operators import classify as CL
from kapspark.operators import fifo, issues, report
from kapspark.operators.fx import fx_convert, gross_up
from kapspark.operators.rules import resolve_rules
from kapspark.sources.dims import yearly_rates
from kapspark.sources.rates import rate_conflicts
from kapspark.sources.rules import empty_rules
from kapspark.sources.staging import stage


class TaxResult:
    """Lazy frames of one computation (every account-year at once).

    Each output is planned on first access only, so a caller that needs the
    form lines does not pay for building the detail export's plan.
    """

    def __init__(self, spark, ledger, rates_daily, rules, cfg, rates_yearly, rules_validated=False, lots=None) -> None:
        self.spark = spark
        self.cfg = cfg
        self.has_tax = C.TAX in ledger.columns if cfg.has_tax_column is None else cfg.has_tax_column
        if not self.has_tax and C.TAX in ledger.columns:
            ledger = ledger.drop(C.TAX)
        # malformed rows of a scan are issues; no figure sees them
        self._ledger_all = ledger
        self.ledger = ledger.where(F.col(C.MALFORMED).isNull()).drop(C.MALFORMED) if C.MALFORMED in ledger.columns else ledger
        self._rates_daily = rates_daily
        self._rules = empty_rules(spark) if rules is None else rules
        self._yearly = yearly_rates(spark) if rates_yearly is None else rates_yearly
        self._rules_validated = rules_validated
        self._lots = lots
        # issue -> number of rows, as far as they were counted while tables were stored
        self._found: dict[str, int] = {}

    def for_year(self, year: int) -> "TaxResult":
        """The same computation with ``year`` requested. FIFO sees all years whichever is
        requested, so its result is handed on: with ``cfg.checkpoint_sales`` it is stored once
        for all years."""
        cfg = self.cfg.with_(tax_year=year)
        args = (self._rates_daily, self._rules, cfg, self._yearly, self._rules_validated, self._lots)
        res = TaxResult(self.spark, self._ledger_all, *args)
        res.__dict__["_sales_all"] = self._sales_all
        if cfg.checkpoint_ledger:
            res.__dict__["_fx_all"] = self._fx_all
        res._found = dict(self._found)
        return res.check() if cfg.on_issue == "error" else res

    @cached_property
    def bad_accounts(self) -> DataFrame | None:
        """Accounts to quarantine (None under the other policies). Found once:
        with a checkpoint directory the list is written there."""
        bad = issues.enforce(self.issues, self.cfg) if self.cfg.on_issue == "quarantine" else None
        if bad is None or not self.spark.sparkContext.getCheckpointDir():
            return bad
        return stage(bad, "bad_accounts")

    def _keep(self, df: DataFrame) -> DataFrame:
        """Quarantine: drop the offending accounts (NULL is an account too)."""
        if self.bad_accounts is None:
            return df
        bad = self.bad_accounts.select(F.col(C.ACCOUNT).alias("_bad_account"))
        return df.join(bad, F.col(C.ACCOUNT).eqNullSafe(F.col("_bad_account")), "left_anti")

    def check(self) -> "TaxResult":
        """Apply the ``error`` policy now (raises on any issue).

        Where the converted ledger and the FIFO result are stored, their rows are checked while
        they are written: a ledger without issues is read once for check and outputs together.
        Only when something was found another pass names the accounts.
        """
        if self.cfg.checkpoint_ledger and self.cfg.checkpoint_sales:
            self._fx_all, self._sales_all  # stored, and checked on the way
            of_years = self.cfg.tax_year is not None or self.cfg.single_year_rule
            if not any(self._found.values()) and self._rules_judged and not of_years:
                return self
        issues.enforce(self.issues, self.cfg)
        return self

    @property
    def _rules_judged(self) -> bool:
        """Whether no rule is rejected: a judged table says so, an unjudged one raises under ``error``."""
        if self._rules_validated:
            return True
        return self.rules_ok is not None and self.cfg.on_issue == "error"

    def _stored(self, df: DataFrame, checks, name: str) -> DataFrame:
        stored, found = issues.stage_checked(df, checks, name)
        self._found.update(found)
        return stored

    @cached_property
    def rules_ok(self) -> DataFrame:
        if self._rules_validated:
            return self._rules
        return issues.judged_rules(self._rules, self.cfg)

    @cached_property
    def rules_issues(self) -> DataFrame:
        """(kind, key, issue) of the rules table."""
        return issues.rules_issues(self._rules)

    @cached_property
    def rate_conflicts(self) -> DataFrame:
        """(period, currency, issue, n_rates) of the rate tables."""
        return rate_conflicts(self._rates_daily, self._yearly)

    @cached_property
    def _fx_all(self) -> DataFrame:
        df = gross_up(fx_convert(self._ledger_all, self._rates_daily, self._yearly, self.cfg), self.has_tax)
        return self._stored(df, issues.ledger_checks(df, self.cfg), "ledger_fx") if self.cfg.checkpoint_ledger else df

    @cached_property
    def ledger_fx(self) -> DataFrame:
        df = self._fx_all
        return df.where(F.col(C.MALFORMED).isNull()).drop(C.MALFORMED) if C.MALFORMED in df.columns else df

    @cached_property
    def in_year(self) -> DataFrame:
        if self.cfg.tax_year is None:
            return self.ledger_fx
        return self.ledger_fx.where(F.col(C.TAX_YEAR) == self.cfg.tax_year)

    @cached_property
    def rows(self) -> DataFrame:
        """One pass over the year's bookings: scope, rule, tax split, form."""
        return self._classify(self.in_year)

    def _classify(self, bookings: DataFrame) -> DataFrame:
        rows = CL.income_scopes(bookings, self.cfg)
        rows = resolve_rules(rows, self.rules_ok, self.cfg, only=F.col("scope").isNotNull())
        return CL.tag_dividend_forms(CL.classify_income(rows, self.has_tax))

    @cached_property
    def _income(self) -> DataFrame:
        """Income rows of all accounts: aggregates read these and drop
        quarantined accounts from their result. Picked by type before anything
        else, so trades are neither shuffled nor classified here."""
        income = self.in_year.where(F.col(C.TYPE).isin(*CL.income_types(self.cfg)))
        return self._classify(income).where(F.col("scope").isNotNull())

    @cached_property
    def _present(self) -> DataFrame:
        """The account-years that have bookings of any type."""
        return self.in_year.select(*report.KEYS).distinct()

    @cached_property
    def classified(self) -> DataFrame:
        return self._keep(self._income)

    @cached_property
    def dividends(self) -> DataFrame:
        return self.classified.where(F.col("scope") == "dividend")

    @cached_property
    def interest(self) -> DataFrame:
        return self.classified.where(F.col("scope") == "interest")

    @cached_property
    def standalone(self) -> DataFrame:
        return self.classified.where(F.col("scope") == "standalone")

    @cached_property
    def summary(self) -> DataFrame:
        return self._keep(CL.tax_summary(self._income))

    @cached_property
    def by_country(self) -> DataFrame:
        return self._keep(CL.credit_by_country(self._income))

    @cached_property
    def _sales_all(self) -> DataFrame:
        sales = fifo.realized_sales(self.ledger_fx, self.cfg, ledger=self.ledger, lots=self._lots)
        if self.cfg.checkpoint_sales:
            return self._stored(sales, issues.fifo_checks(), "sales")
        if self.cfg.on_issue == "quarantine" and self.spark.sparkContext.getCheckpointDir():
            # the list of accounts and the outputs read the same FIFO result
            return stage(sales, "sales")
        return sales

    @cached_property
    def sales_all_years(self) -> DataFrame:
        return self._keep(self._sales_all)

    @cached_property
    def open_lots(self) -> DataFrame:
        """What is left of every lot after all sales; the ``lots`` of a later run."""
        return fifo.open_lots(self.ledger_fx, self.cfg, ledger=self.ledger, lots=self._lots)

    def _of_year(self, sales: DataFrame) -> DataFrame:
        return sales if self.cfg.tax_year is None else sales.where(F.col(C.TAX_YEAR) == self.cfg.tax_year)

    @cached_property
    def sales(self) -> DataFrame:
        return self._of_year(self.sales_all_years)

    @cached_property
    def totals(self) -> DataFrame:
        sales = self._of_year(self._sales_all)
        return self._keep(report.account_year_totals(self._income, sales, self.has_tax, present=self._present))

    @cached_property
    def form_lines(self) -> DataFrame:
        return report.form_lines(self.totals)

    @cached_property
    def fund_breakdown(self) -> DataFrame:
        return self._keep(report.fund_breakdown(self.spark, self._income.where(F.col("scope") == "dividend")))

    @cached_property
    def positions(self) -> DataFrame:
        sales = self._of_year(self._sales_all)
        totals = report.account_year_totals(self._income, sales, self.has_tax, countries=True, present=self._present)
        return report.report_positions(self._keep(totals))

    def reports(self) -> tuple[dict[str, DataFrame], list[int]]:
        """Form lines, credit by country, fund breakdown and report positions, and the years
        they cover. All come from one aggregate (``report.account_facts``); with a checkpoint
        directory it is stored, so income is read once and FIFO runs once for all tables."""
        shared = bool(self.spark.sparkContext.getCheckpointDir())
        facts = report.account_facts(self._income, self._of_year(self._sales_all), self._present)
        facts = self._keep(stage(facts, "report_facts") if shared else facts)
        totals = report.totals_of(facts, self.has_tax)
        tables = {
            "form_lines": report.form_lines(totals),
            "credit_by_country": report.credit_by_country_of(facts),
            "fund_breakdown": report.fund_breakdown_of(self.spark, facts),
            "report_positions": report.report_positions(totals),
        }
        years = facts.select(C.TAX_YEAR).distinct().collect()  # a few
        return tables, sorted(r[0] for r in years if r[0] is not None)

    @cached_property
    def sections(self) -> DataFrame:
        return self._keep(report.section_totals(self._income, self._of_year(self._sales_all)))

    def section(self, name: str) -> DataFrame:
        """The rows of one detail section with its columns."""
        return report.section_rows(self.classified, self.sales, name)

    @cached_property
    def display_lines(self) -> DataFrame:
        """Form lines with their amounts as shown (``cfg.round_amount``)."""
        return report.display_amounts(self.form_lines, whole_euros=self.cfg.round_amount)

    @cached_property
    def unknown_currencies(self) -> DataFrame:
        return issues.unknown_currencies(self.ledger)

    @cached_property
    def tax_years(self) -> DataFrame:
        return issues.tax_years(self.ledger_fx if self.cfg.checkpoint_ledger else self.ledger, self.cfg)

    @cached_property
    def ledger_issues(self) -> DataFrame:
        """(account_id, issue, n) of the bookings themselves."""
        return issues.ledger_issues(self._fx_all, self.cfg)

    def bad_rows(self, k: int = 5) -> DataFrame:
        """The first ``k`` bookings behind every (account_id, issue) of ``ledger_issues``."""
        rows, cfg = fifo.with_total_order(self._fx_all, self.cfg)
        return issues.bad_rows(rows, cfg, fifo.booking_order(cfg), k).drop(fifo.TIE)

    @cached_property
    def issues(self) -> DataFrame:
        out = self.ledger_issues.unionByName(issues.fifo_issues(self._sales_all))
        if not self._rules_validated:
            out = out.unionByName(issues.rejected_rule_issues(self._income))
        if self.cfg.tax_year is not None or self.cfg.single_year_rule:
            out = out.unionByName(issues.tax_year_issues(self.tax_years, self.cfg))
        return out

    def details(self) -> DataFrame:
        return report.detail_frame(self.classified, self.sales)


def calculate(
    spark: SparkSession,
    ledger: DataFrame,
    rates_daily: DataFrame | None,
    rules: DataFrame | None,
    cfg: TaxConfig = TaxConfig(),
    rates_yearly: DataFrame | None = None,
    rules_validated: bool = False,
    lots: DataFrame | None = None,
) -> TaxResult:
    """Compute every figure for every (account_id, tax_year) of ``ledger``.

    ``ledger`` is canonical (``sources.ledger`` or ``sources.demo``);
    ``rules`` normalised (``sources.rules.normalize_rules``); ``rates_daily``
    is (rate_date, currency, rate) or None for the yearly table only.
    Outputs are planned lazily; with ``on_issue="error"`` the issue check
    runs here and raises on any issue, naming all kinds with their counts.
    ``rules_validated=True`` skips rule validation (rules that passed
    through ``operators.issues.judged_rules`` before). ``lots``: the
    ``open_lots`` of a run over all earlier bookings; ``ledger`` then has the
    later ones only.
    """
    res = TaxResult(spark, ledger, rates_daily, rules, cfg, rates_yearly, rules_validated, lots)
    if cfg.on_issue == "error":
        res.check()
    return res
