from __future__ import annotations

from kapspark.config import TaxConfig
from kapspark.plans.tax_run import calculate
from kapspark.sources.rules import normalize_rules, rules_from_records

OFFLINE = TaxConfig(offline=True, on_issue="flag")


def rules_df(spark, *records):
    return normalize_rules(rules_from_records(spark, list(records)))


def security(isin, country, treatment, rate, instrument=None, fund_type=None):
    return {"kind": "security", "key": isin, "source_country": country, "tax_treatment": treatment,
            "max_creditable_rate": rate, "instrument": instrument, "fund_type": fund_type}


def country(prefix, country_, treatment, rate):
    return {"kind": "country", "key": prefix, "source_country": country_, "tax_treatment": treatment,
            "max_creditable_rate": rate}


def run(spark, ledger, rules=None, cfg=OFFLINE, rates_daily=None):
    return calculate(spark, ledger, rates_daily, rules, cfg)


def totals_of(res, year):
    rows = res.totals.where(f"tax_year = {year}").collect()
    assert len(rows) == 1, rows
    return {k: (float(v) if v is not None and not isinstance(v, (bool, str)) else v)
            for k, v in rows[0].asDict().items()}


def positions_of(res, year):
    return {r["position"]: (None if r["amount"] is None else float(r["amount"]))
            for r in res.positions.where(f"tax_year = {year}").collect()}


def display(x):
    from decimal import ROUND_HALF_EVEN, Decimal
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN))
