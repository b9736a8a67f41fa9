"""Run configuration: booking-type lists, policies and tuning knobs.

The library works on one canonical ledger schema (see ``LEDGER_COLUMNS``);
input names are mapped onto it once, at the scan (``sources.ledger``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from kapspark import constants as K

# Canonical ledger columns. ``tax`` is optional (the input may not have it);
# ``tiebreak`` columns order bookings that share a timestamp.
ACCOUNT = "account_id"
TS = "ts"
TYPE = "type"
ISIN = "isin"
NAME = "name"
CURRENCY = "currency"
QUANTITY = "quantity"
NET = "net"
TAX = "tax"
TAX_YEAR = "tax_year"
# Text of a row that its file's header does not fit (only from a CSV scan).
MALFORMED = "malformed_text"

LEDGER_COLUMNS: tuple[str, ...] = (ACCOUNT, TS, TYPE, ISIN, NAME, CURRENCY, QUANTITY, NET, TAX)

QUANTITY_TYPE = "decimal(20,8)"
MONEY_SUM_TYPE = "decimal(28,10)"

ON_ISSUE = ("error", "quarantine", "flag")
COST_MODES = ("pro_rata", "as_observed")


@dataclass(frozen=True)
class TaxConfig:
    """Everything that steers one computation over a ledger table.

    ``tax_year=None`` computes every account-year; an int keeps only that
    year in the income branch (FIFO always sees all years).
    """

    dividend_types: tuple[str, ...] = K.DEFAULT_DIVIDEND_TYPES
    interest_types: tuple[str, ...] = K.DEFAULT_INTEREST_TYPES
    withholding_tax_types: tuple[str, ...] = K.DEFAULT_WITHHOLDING_TAX_TYPES
    purchase_types: tuple[str, ...] = K.DEFAULT_PURCHASE_TYPES
    sale_types: tuple[str, ...] = K.DEFAULT_SALE_TYPES
    tax_year: int | None = None
    # None: decide from the ledger schema (is there a ``tax`` column?).
    has_tax_column: bool | None = None
    on_issue: str = "quarantine"
    cost_mode: str = "pro_rata"
    # Ignore daily rates and use the yearly table only.
    offline: bool = False
    # Display rounding to whole euros instead of cents.
    round_amount: bool = False
    # Columns that order bookings with the same timestamp (after buys-first).
    # None: ``order_no`` where the ledger has it, then a hash of all other
    # columns, so the order never depends on the order of the input.
    tiebreak: tuple[str, ...] | None = None
    # FIFO skew handling: a (account, isin) key with more trade rows than
    # this is matched in chunks of about ``fifo_chunk_rows`` rows (the results
    # are the same either way). None turns the detection (one aggregate over
    # the trades) off.
    fifo_hot_key_rows: int | None = 5_000_000
    fifo_chunk_rows: int = 1_000_000
    # Write the FX-converted ledger once as a parquet table under
    # ``spark.checkpoint.dir`` (cuts lineage; every output then reads it,
    # pruned, instead of re-scanning the ledger). Worth it for many outputs.
    checkpoint_ledger: bool = False
    # Same for the FIFO result (one row per sale), which totals, positions,
    # details and issues all read.
    checkpoint_sales: bool = False
    # Without a requested tax year every year is a key. With this set, an
    # account with bookings in more than one year is reported as an issue
    # (the single-file tool refuses such input without a requested year).
    single_year_rule: bool = False

    def __post_init__(self) -> None:
        if self.on_issue not in ON_ISSUE:
            raise ValueError(f"on_issue must be one of {ON_ISSUE}, got {self.on_issue!r}")
        if self.cost_mode not in COST_MODES:
            raise ValueError(f"cost_mode must be one of {COST_MODES}, got {self.cost_mode!r}")

    def with_(self, **changes) -> "TaxConfig":
        return replace(self, **changes)

    def type_map_rows(self) -> list[tuple[str, str]]:
        """(type, category) pairs; a type may sit in several categories."""
        rows: list[tuple[str, str]] = []
        for category, types in (
            ("dividend", self.dividend_types),
            ("interest", self.interest_types),
            ("withholding_tax", self.withholding_tax_types),
            ("purchase", self.purchase_types),
            ("sale", self.sale_types),
        ):
            rows.extend((t, category) for t in dict.fromkeys(types))
        return rows
