"""Validation as data: ledger issues, rule issues, tax years, issue policies.

Nothing here stops at the first bad row. Every check is a predicate that is
counted per account (or per rule) in one aggregate; the policy decides what
happens next (``error``: raise and name every kind of issue with its counts;
``quarantine``: drop the offending accounts from every output; ``flag``: keep
everything and report).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kapspark import config as C
from kapspark import constants as K
from kapspark.config import TaxConfig
from kapspark.sources.staging import stage


class LedgerIssuesError(ValueError):
    """Raised by the ``error`` policy; ``samples`` holds one row per kind of issue."""

    def __init__(self, message: str, samples: list) -> None:
        super().__init__(message)
        self.samples = samples


def _long(df: DataFrame, keys: list[str], named: dict[str, Column]) -> DataFrame:
    """Count each named predicate per keys, then unpivot to (keys, issue, n)
    keeping only non-zero counts."""
    agg = df.groupBy(*keys).agg(*[F.count_if(pred).alias(name) for name, pred in named.items()])
    stacked = agg.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(name).alias("issue"), F.col(name).alias("n")) for name in named])
        ).alias("_i"),
    )
    return stacked.select(*keys, "_i.issue", "_i.n").where(F.col("n") > 0)


def ledger_checks(ledger_fx: DataFrame, cfg: TaxConfig) -> dict[str, Column]:
    """Name of each issue of a booking -> its predicate.

    Missing account / amount / currency / type, unparsable date, amount or tax, a
    currency outside the known list, a booking whose year has no rate, and trade rows
    without ISIN or quantity or with quantity <= 0. Of a malformed row (``malformed_text``)
    nothing else is said: its fields may stand in the wrong columns.
    """
    cols = set(ledger_fx.columns)
    is_trade = F.col(C.TYPE).isin(*cfg.purchase_types, *cfg.sale_types)
    checks: dict[str, Column] = {
        "missing_account": F.col(C.ACCOUNT).isNull(),
        "missing_amount": F.col(C.NET).isNull(),
        "missing_currency": F.col(C.CURRENCY).isNull(),
        "missing_type": F.col(C.TYPE).isNull(),
        "bad_date": F.col(C.TS).isNull(),
        "unknown_currency": F.col(C.CURRENCY).isNotNull() & ~F.col(C.CURRENCY).isin(*K.KNOWN_CURRENCIES),
        "fx_rate_missing": F.col("fx_source") == "missing",
        "trade_missing_isin": is_trade & F.col(C.ISIN).isNull(),
        "trade_missing_quantity": is_trade & F.col(C.QUANTITY).isNull(),
        "trade_bad_quantity": is_trade & (F.col(C.QUANTITY) <= 0),
    }
    if "tax_text" in cols and C.TAX in cols:
        checks["bad_tax_amount"] = F.col("tax_text").isNotNull() & F.col(C.TAX).isNull()
    if "net_text" in cols:
        checks["bad_amount"] = F.col("net_text").isNotNull() & F.col(C.NET).isNull()
        checks["missing_amount"] = F.col("net_text").isNull() & F.col(C.NET).isNull()
    if C.MALFORMED in cols:
        well = F.col(C.MALFORMED).isNull()
        checks = {name: well & pred for name, pred in checks.items()} | {"malformed_row": ~well}
    return checks


def ledger_issues(ledger_fx: DataFrame, cfg: TaxConfig) -> DataFrame:
    """(account_id, issue, n): data problems per account, see ``ledger_checks``."""
    return _long(ledger_fx, [C.ACCOUNT], ledger_checks(ledger_fx, cfg))


def bad_rows(ledger_fx: DataFrame, cfg: TaxConfig, order: Sequence[Column], k: int = 5) -> DataFrame:
    """The first ``k`` offending bookings of every (account_id, issue): ``issue``, ``nth``
    and all columns of the booking, the scan's texts included.

    ``order`` ranks bookings of one group and should be total. Spark limits each
    task's rows per group before the shuffle, so a group sends at most k rows a task.
    """
    checks = ledger_checks(ledger_fx, cfg)
    named = F.array(*[F.when(F.coalesce(pred, F.lit(False)), F.lit(name)) for name, pred in checks.items()])
    found = ledger_fx.withColumn("_found", F.filter(named, lambda x: x.isNotNull())).where(F.size("_found") > 0)
    rows = found.withColumn("issue", F.explode("_found")).drop("_found")
    of_group = Window.partitionBy(C.ACCOUNT, "issue").orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(of_group)).where(F.col("nth") <= k)


def unknown_currencies(ledger: DataFrame) -> DataFrame:
    """(account_id, currency, n): the distinct currencies outside the known
    list per account (the list is three literals, so no join is needed)."""
    unknown = F.col(C.CURRENCY).isNotNull() & ~F.col(C.CURRENCY).isin(*K.KNOWN_CURRENCIES)
    return ledger.where(unknown).groupBy(C.ACCOUNT, C.CURRENCY).agg(F.count(F.lit(1)).alias("n"))


def fifo_checks() -> dict[str, Column]:
    """Name of each issue of a realised sale -> its predicate."""
    return {
        "fifo_shortfall": F.col("shortfall") & F.col("missing_qty").isNotNull(),
        "fifo_key_shortfall": F.col("shortfall"),
        "fifo_invalid_key": F.col("invalid"),
    }


def fifo_issues(sales: DataFrame) -> DataFrame:
    """(account_id, issue, n): sales left uncosted by a shortfall or bad trade."""
    return _long(sales, [C.ACCOUNT], fifo_checks())


def stage_checked(df: DataFrame, checks: Mapping[str, Column], name: str) -> tuple[DataFrame, dict[str, int]]:
    """Store ``df`` (see ``sources.staging``) and count each check's rows in the same pass."""
    counted = Observation(name)
    metrics = [F.count_if(F.coalesce(pred, F.lit(False))).alias(issue) for issue, pred in checks.items()]
    stored = stage(df.observe(counted, *metrics), name)
    return stored, counted.get


def tax_years(ledger: DataFrame, cfg: TaxConfig) -> DataFrame:
    """Per account: the distinct booking years and the single-year rule.

    ``multi_year`` marks an account that would need an explicit year;
    ``requested_present`` tells whether ``cfg.tax_year`` occurs at all.
    """
    yrs = ledger.select(C.ACCOUNT, F.year(C.TS).alias("y")).where(F.col("y").isNotNull())
    out = yrs.groupBy(C.ACCOUNT).agg(
        F.count_distinct("y").alias("n_years"),
        F.min("y").alias("min_year"),
        F.max("y").alias("max_year"),
        F.sort_array(F.collect_set("y")).alias("years"),
    )
    requested = (
        F.array_contains(F.col("years"), F.lit(cfg.tax_year)) if cfg.tax_year is not None else F.lit(None).cast("boolean")
    )
    return out.withColumn("multi_year", F.col("n_years") > 1).withColumn("requested_present", requested)


def tax_year_issues(years: DataFrame, cfg: TaxConfig) -> DataFrame:
    """(account_id, issue, n) for the year rules: a requested year absent,
    or several years without a requested one."""
    if cfg.tax_year is not None:
        bad = years.where(~F.col("requested_present")).select(C.ACCOUNT, F.lit("tax_year_absent").alias("issue"))
    else:
        bad = years.where(F.col("multi_year")).select(C.ACCOUNT, F.lit("multiple_years").alias("issue"))
    return bad.withColumn("n", F.lit(1).cast("bigint"))


def _rule_checks() -> dict[str, Column]:
    treat = F.col("tax_treatment")
    rate = F.col("max_creditable_rate")
    return {
        "bad_kind": ~F.coalesce(F.col("kind").isin("security", "country"), F.lit(False)),
        "missing_key": F.col("key").isNull() | (F.col("key") == ""),
        "missing_field": F.col("source_country").isNull() | treat.isNull() | F.col("rate_text").isNull(),
        "bad_rate_type": F.col("rate_text").isNotNull() & rate.isNull(),
        "bad_treatment": treat.isNotNull() & ~treat.isin(*K.VALID_TREATMENTS),
        "rate_out_of_range": rate.isNotNull() & ((rate < 0) | (rate > 1)),
        "domestic_with_credit": (treat == "domestic") & rate.isNotNull() & (rate != 0),
        "bad_instrument": ~F.col("instrument").isin(*K.VALID_INSTRUMENTS),
        "bad_fund_type": F.col("fund_type").isNotNull() & ~F.col("fund_type").isin(*K.VALID_FUND_TYPES),
        "fund_type_without_fund": F.col("fund_type").isNotNull() & (F.col("instrument") != "fund"),
        "bad_prefix": (F.col("kind") == "country") & ~F.coalesce(F.col("key").rlike(r"^\p{L}{2}$"), F.lit(False)),
    }


def _with_faults(rules: DataFrame) -> DataFrame:
    """Rules with the names of their own faults (``faults``), the number of
    rules of their key (``n_key``) and their place among them (``nth``): one
    exchange by key."""
    named = F.array(*[F.when(F.coalesce(pred, F.lit(False)), F.lit(name)) for name, pred in _rule_checks().items()])
    of_key = Window.partitionBy("kind", "key")
    return rules.withColumn("faults", F.filter(named, lambda x: x.isNotNull())).withColumns(
        {
            "n_key": F.count(F.lit(1)).over(of_key),
            "n_faults": F.sum(F.size("faults")).over(of_key),
            "nth": F.row_number().over(of_key.orderBy("rate_text", "source_country", "tax_treatment")),
        }
    )


def rules_issues(rules: DataFrame) -> DataFrame:
    """(kind, key, issue) for a normalised rules table; empty when valid."""
    repeated = (F.col("n_key") > 1) & (F.col("nth") == 1)
    extra = F.when(repeated, F.array(F.lit("duplicate_key"))).otherwise(F.array().cast("array<string>"))
    return _with_faults(rules).select("kind", "key", F.explode(F.concat("faults", extra)).alias("issue"))


def _raise_on(issues: DataFrame, per: str, what: str) -> None:
    """Raise when there are issues: all kinds of them, each with its counts.

    The aggregate has one row per kind of issue, however many rows there are.
    """
    kinds = issues.groupBy("issue").agg(F.count_distinct(per).alias(f"n_{per}"), F.count(F.lit(1)).alias("n_rows"))
    found = kinds.orderBy("issue").collect()
    if found:
        raise LedgerIssuesError(f"{what}: {[tuple(r) for r in found]}", found)


def judged_rules(rules: DataFrame, cfg: TaxConfig) -> DataFrame:
    """Valid rules (``rejected`` false) and one row for each key of a rejected
    rule (``rejected`` true, no values). The ``error`` policy raises instead."""
    if cfg.on_issue == "error":
        _raise_on(rules_issues(rules), "key", "invalid tax rules")
    judged = _with_faults(rules).withColumn("rejected", (F.col("n_key") > 1) | (F.col("n_faults") > 0))
    return (
        judged.where(F.col("nth") == 1)
        .select(
            "kind",
            "key",
            *[F.when(~F.col("rejected"), F.col(c)).alias(c) for c in rules.columns if c not in ("kind", "key")],
            "rejected",
        )
    )


def valid_rules(rules: DataFrame, cfg: TaxConfig) -> DataFrame:
    """Rules without any issue."""
    return judged_rules(rules, cfg).where(~F.col("rejected")).drop("rejected")


def rejected_rule_issues(rows: DataFrame) -> DataFrame:
    """(account_id, issue, n): income bookings whose rule was rejected."""
    return _long(rows, [C.ACCOUNT], {"rule_rejected": F.col("rule_origin") == "rejected"})


def enforce(issues: DataFrame, cfg: TaxConfig) -> DataFrame | None:
    """Apply the policy. Returns the accounts to quarantine (or None).

    ``error`` raises when any issue exists, naming all kinds with their counts.
    """
    if cfg.on_issue == "error":
        _raise_on(issues, C.ACCOUNT, "ledger issues")
        return None
    if cfg.on_issue == "quarantine":
        return issues.select(C.ACCOUNT).distinct()
    return None
