"""Money columns: parsing, order-independent sums and display rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kapspark.config import MONEY_SUM_TYPE


def normalize_amount(c: Column) -> Column:
    """Text amount -> double: decimal comma becomes a point, a lone ``-`` is 0.

    Anything else that does not parse gives NULL (reported as an issue by
    ``operators.issues``), never an exception. The sign of ``-15,00`` is
    kept (the amount and the tax column use the same rule).
    """
    text = F.regexp_replace(F.replace(c.cast("string"), F.lit(","), F.lit(".")), r"^-$", "0")
    return text.try_cast("double")


def to_money(c: Column) -> Column:
    """Exact decimal image of a double amount, used before summing."""
    return c.cast(MONEY_SUM_TYPE)


def money_sum(c: Column) -> Column:
    """Sum that does not depend on row order (decimal accumulation)."""
    return F.sum(to_money(c))


def nonzero_sum(name: str, kind: str | None = None) -> Column:
    """Sum of the named column over the rows where it is not zero, NULL without such rows;
    ``kind`` is the type to sum as. A decimal sum writes its buffer anew for every row that it
    sees, so a wide aggregate costs by what rows add, not by rows times figures."""
    value = f"cast(`{name}` as {kind})" if kind else f"`{name}`"
    return F.expr(f"sum({value}) FILTER (WHERE `{name}` <> 0)")


def round4(c: Column) -> Column:
    """Round a money value half-up to 4 places on its decimal image -> double."""
    return F.round(to_money(c), 4).cast("double")


def display_amount(c: Column, whole_euros: bool = False) -> Column:
    """Display copy: half-even to cents, or to whole euros."""
    return F.bround(c.cast("decimal(38,10)"), 0 if whole_euros else 2).cast("double")
