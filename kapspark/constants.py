"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is a plain statement of a value: rates, type names,
form labels and line numbers. No logic lives here.
"""

from __future__ import annotations

# --- fixed values: yearly fallback rates (foreign units per 1 EUR) ---------
YEARLY_FALLBACK_RATES: dict[int, dict[str, float]] = {
    2025: {"USD": 1.05, "CHF": 0.93, "EUR": 1.00},
    2024: {"USD": 1.0825, "CHF": 0.9525, "EUR": 1.00},
    2023: {"USD": 1.0812, "CHF": 0.9718, "EUR": 1.00},
    2022: {"USD": 1.0534, "CHF": 1.0048, "EUR": 1.00},
    2021: {"USD": 1.1829, "CHF": 1.0811, "EUR": 1.00},
    2020: {"USD": 1.1421, "CHF": 1.0706, "EUR": 1.00},
}
# Currencies accepted by validation: the keys of the 2025 row.
KNOWN_CURRENCIES: tuple[str, ...] = ("USD", "CHF", "EUR")
# Currencies requested from a daily rate payload.
PAYLOAD_CURRENCIES: tuple[str, ...] = ("USD", "CHF", "EUR")

# --- fixed values: default booking types per category ----------------------
DEFAULT_DIVIDEND_TYPES: tuple[str, ...] = ("Dividende",)
DEFAULT_INTEREST_TYPES: tuple[str, ...] = ("Zinsen auf Einlagen",)
DEFAULT_WITHHOLDING_TAX_TYPES: tuple[str, ...] = ("Steuerrückbehalt", "Quellensteuer", "Withholding Tax")
DEFAULT_PURCHASE_TYPES: tuple[str, ...] = ("Kauf",)
DEFAULT_SALE_TYPES: tuple[str, ...] = ("Verkauf",)

# --- fixed values: default input column names (ledger export header) -------
DEFAULT_INPUT_COLUMNS: dict[str, str] = {
    "ts": "Datum",
    "order_no": "Auftrag #",
    "type": "Transaktionen",
    "symbol": "Symbol",
    "name": "Name",
    "isin": "ISIN",
    "quantity": "Anzahl",
    "unit_price": "Stückpreis",
    "tax": "Kosten",
    "accrued_interest": "Aufgelaufene Zinsen",
    "net": "Nettobetrag",
    "balance": "Saldo",
    "currency": "Währung",
}
DEFAULT_TIMESTAMP_FORMAT = "dd-MM-yyyy HH:mm:ss"
DEFAULT_SEPARATOR = ";"
DEFAULT_ENCODING = "ISO-8859-1"

# --- fixed values: German tax constants ------------------------------------
# Capital gains tax plus 5.5 % solidarity surcharge: raw = kest * 1.055.
KEST_WITH_SOLI_FACTOR = 1.055
# Default creditable share for a foreign two-letter ISIN prefix without a rule.
DEFAULT_FOREIGN_CREDIT_RATE = 0.15
DOMESTIC_COUNTRY = "DE"
SWISS_COUNTRY = "CH"

# Partial exemption (Teilfreistellung) by fund type; unknown types get 0.
FUND_EXEMPTION_RATES: dict[str, float] = {
    "equity": 0.30,
    "mixed": 0.15,
    "real_estate": 0.60,
    "other": 0.00,
}
FUND_TYPE_LABELS: dict[str, str] = {
    "equity": "Aktienfonds (≥51% Aktien)",
    "mixed": "Mischfonds (≥25% Aktien)",
    "real_estate": "Immobilienfonds (≥51% Immobilien)",
    "other": "Sonstige Fonds",
}
VALID_TREATMENTS: tuple[str, ...] = ("domestic", "foreign")
VALID_INSTRUMENTS: tuple[str, ...] = ("fund", "share")
VALID_FUND_TYPES: tuple[str, ...] = ("equity", "mixed", "real_estate", "other")

# --- fixed values: dividend forms -----------------------------------------
FUND_FORM = "Anlage KAP-INV"
DOMESTIC_SHARE_FORM = "Anlage KAP inländisch"
FOREIGN_SHARE_FORM = "Anlage KAP ausländisch"

# --- fixed values: form lines (form, line, label, figure) ------------------
# The figure names refer to columns of the per account-year totals.
FORM_LINES: tuple[tuple[str, str, str, str], ...] = (
    ("Anlage KAP", "18", "Inländische Kapitalerträge", "domestic_share_dividends"),
    ("Anlage KAP", "19", "Ausländische Kapitalerträge", "foreign_capital_income"),
    ("Anlage KAP", "37", "Kapitalertragsteuer", "kest"),
    ("Anlage KAP", "38", "Solidaritätszuschlag", "soli"),
    ("Anlage KAP", "41", "Anrechenbare ausl. Quellensteuer", "credit"),
    ("Anlage KAP", "20", "Aktiengewinne", "stock_gains"),
    ("Anlage KAP", "23", "Aktienverluste", "stock_losses"),
    ("Anlage KAP-INV", "4", "Investmentfonds-Ausschüttungen", "fund_dividends"),
)
# Shown only when positive.
REFUND_LINE: tuple[str, str, str, str] = (
    "eF85 (ESTV)",
    "—",
    "CH-Verrechnungssteuer Rückforderung",
    "swiss_refundable",
)

# --- fixed values: detail export categories --------------------------------
DETAIL_CATEGORY_DIVIDEND = "Dividende"
DETAIL_CATEGORY_INTEREST = "Zinsen"
DETAIL_CATEGORY_SALE = "Aktienverkauf"
