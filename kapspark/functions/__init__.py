"""Column expressions shared by the operators (all built-in, codegen-friendly)."""

from kapspark.functions.amounts import (
    display_amount,
    money_sum,
    nonzero_sum,
    normalize_amount,
    round4,
    to_money,
)
from kapspark.functions.dates import parse_ledger_ts
from kapspark.functions.tax import default_rule, isin_key, rule_struct

__all__ = [
    "default_rule",
    "display_amount",
    "isin_key",
    "money_sum",
    "nonzero_sum",
    "normalize_amount",
    "parse_ledger_ts",
    "round4",
    "rule_struct",
    "to_money",
]
