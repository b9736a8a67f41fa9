"""Reference goldens, end to end: ledger export text -> CSV scan -> figures."""

from __future__ import annotations

import pytest

from helpers import OFFLINE, country, display, positions_of, rules_df, run, security, totals_of

# The columns of a ledger export, and the golden figures in the asserts below.
HEADER = "Datum;Auftrag #;Transaktionen;Symbol;Name;ISIN;Anzahl;Stückpreis;Kosten;Aufgelaufene Zinsen;Nettobetrag;Saldo;Währung\n"
NARROW = "Datum;Transaktionen;Name;ISIN;Nettobetrag;Kosten;Währung\n"


def line(day, kind, net, currency, isin="", qty="1.0"):
    """One row of a full export; what no figure depends on is filler."""
    return f"{day} 10:20:30;A-{day[:2]};{kind};;;{isin};{qty};;0.00;;{net};;{currency}\n"


US_RULE = security("US0000000309", "US", "foreign", "0.15")
DE_RULE = security("DE0000000208", "DE", "domestic", "0.0")


def test_dividends_and_interest_yearly_rates(spark, csv_ledger):
    led = csv_ledger(
        HEADER
        + line("19-03-2025", "Dividende", "100.00", "USD", isin="LU0000000077")
        + line("20-06-2025", "Dividende", "46.96", "USD", isin="LU0000000077")
        + line("01-01-2025", "Zinsen auf Einlagen", "0.88", "CHF")
        + line("01-01-2025", "Zinsen auf Einlagen", "0.73", "USD")
    )
    t = totals_of(run(spark, led), 2025)
    assert display(t["foreign_share_dividends"]) == 139.96
    assert display(t["interest"]) == 1.64


def test_daily_mode_offline_uses_yearly_fallback(spark, csv_ledger):
    led = csv_ledger(
        HEADER
        + line("15-06-2024", "Dividende", "100.00", "USD", isin="LU0000000077")
    )
    res = run(spark, led)
    t = totals_of(res, 2024)
    assert display(t["foreign_share_dividends"]) == 92.38
    pos = positions_of(res, 2024)
    assert "5.no_sales" in pos and "5.stock_gains" not in pos


def test_multiple_years_are_reported_per_account(spark, csv_ledger):
    led = csv_ledger(
        HEADER
        + line("31-12-2025", "Dividende", "12.50", "USD", isin="LU0000000077")
        + line("31-12-2024", "Dividende", "12.50", "USD", isin="LU0000000077")
    )
    res = run(spark, led)
    y = res.tax_years.collect()[0]
    assert y["multi_year"] and y["years"] == [2024, 2025]
    # every year is computed as its own key
    assert sorted(r["tax_year"] for r in res.totals.collect()) == [2024, 2025]
    # the single-year rule, when asked for, reports the account
    res1 = run(spark, led, cfg=OFFLINE.with_(single_year_rule=True))
    assert {r["issue"] for r in res1.issues.collect()} == {"multiple_years"}
    # a requested year that does not occur is an issue
    res2 = run(spark, led, cfg=OFFLINE.with_(tax_year=2023))
    assert {r["issue"] for r in res2.issues.collect()} == {"tax_year_absent"}


def test_missing_required_column_is_reported(spark, csv_ledger):
    from kapspark.sources.ledger import MissingColumnsError

    # the export without its last column
    text = "".join(x.rsplit(";", 1)[0] + "\n" for x in (HEADER, line("19-03-2025", "Dividende", "12.50", "USD")))
    with pytest.raises(MissingColumnsError, match="Währung"):
        csv_ledger(text)


def test_withholding_tax_is_converted_credited_and_grossed_up(spark, csv_ledger):
    led = csv_ledger(NARROW + "14-11-2025 10:20:30;Dividende;Own Inc;US0000000309;85.00;-15.00;USD\n")
    res = run(spark, led, rules_df(spark, US_RULE))
    t = totals_of(res, 2025)
    assert display(t["credit"]) == 14.29
    assert display(t["dividend_credit"]) == 14.29
    assert display(t["foreign_share_dividends"]) == 95.24
    pos = positions_of(res, 2025)
    assert pos["4.kest"] == 0.0 and pos["4.soli"] == 0.0


def test_domestic_dividend_gross_and_german_tax(spark, csv_ledger):
    led = csv_ledger(NARROW + "14-11-2025 10:20:30;Dividende;Own AG;DE0000000208;73.625;-26.375;EUR\n")
    res = run(spark, led, rules_df(spark, DE_RULE))
    t = totals_of(res, 2025)
    assert display(t["domestic_share_dividends"]) == 100.00
    assert display(t["kest"]) == 25.00
    assert display(t["soli"]) == 1.38
    assert display(t["credit"]) == 0.00


def test_fund_distribution_goes_to_kap_inv(spark, csv_ledger):
    led = csv_ledger(NARROW + "14-11-2025 10:20:30;Dividende;Own Fund;IE0000000410;100.00;0.00;EUR\n")
    res = run(spark, led, rules_df(spark, security("IE0000000410", "IE", "foreign", "0.0", "fund")))
    t = totals_of(res, 2025)
    assert t["fund_dividends"] == 100.0 and t["foreign_share_dividends"] == 0.0
    fb = res.fund_breakdown.collect()
    assert [(r["fund_type"], float(r["gross_total"]), r["exemption_rate"], r["exemption_pct"]) for r in fb] == [
        ("other", 100.0, 0.0, "0%")
    ]


def test_line_19_sums_foreign_dividends_and_interest(spark, csv_ledger):
    led = csv_ledger(
        NARROW
        + "14-11-2025 10:20:30;Dividende;Own SA;CH0000000511;40.00;0.00;EUR\n"
        + "12-05-2025 10:20:30;Zinsen auf Einlagen;;;10.00;0.00;EUR\n"
    )
    res = run(spark, led, rules_df(spark, security("CH0000000511", "CH", "foreign", "0.15")))
    t = totals_of(res, 2025)
    assert t["foreign_share_dividends"] == 40.0 and t["interest"] == 10.0
    lines = {r["line"]: float(r["amount"]) for r in res.form_lines.collect()}
    assert lines["19"] == 50.0


def test_standalone_withholding_tax_stays_unclassified(spark, csv_ledger):
    led = csv_ledger(
        "Datum;Transaktionen;Name;ISIN;Nettobetrag;Währung\n"
        "14-11-2025 10:20:30;Dividende;Own Inc;US0000000309;85.00;USD\n"
        "14-11-2025 10:20:30;Withholding Tax;Own Inc;US0000000309;-15.00;USD\n"
    )
    res = run(spark, led, rules_df(spark, US_RULE))
    assert not res.has_tax
    t = totals_of(res, 2025)
    assert display(t["credit"]) == 0.00
    assert display(t["unclassified"]) == 14.29
    pos = positions_of(res, 2025)
    assert display(pos["4.unclassified"]) == 14.29
    # the country is listed with zero credit
    assert [(r["source_country"], float(r["credit"])) for r in res.by_country.where("scope = 'total'").collect()] == [
        ("US", 0.0)
    ]


def test_fifo_cost_basis(spark, csv_ledger):
    led = csv_ledger(
        HEADER
        + line("01-01-2025", "Kauf", "-200.00", "EUR", isin="DE0000000456", qty="2.0")
        + line("01-02-2025", "Kauf", "-300.00", "EUR", isin="DE0000000456", qty="2.0")
        + line("01-03-2025", "Verkauf", "600.00", "EUR", isin="DE0000000456", qty="3.0")
    )
    res = run(spark, led)
    t = totals_of(res, 2025)
    assert t["stock_result"] == 250.0 and t["stock_gains"] == 250.0
    pos = positions_of(res, 2025)
    assert pos["5.stock_gains"] == 250.0 and "5.no_sales" not in pos


def test_fifo_uses_prior_year_lots(spark, csv_ledger):
    led = csv_ledger(
        HEADER
        + line("01-01-2024", "Kauf", "-100.00", "EUR", isin="DE0000000456")
        + line("01-03-2025", "Verkauf", "150.00", "EUR", isin="DE0000000456")
    )
    res = run(spark, led, cfg=OFFLINE.with_(tax_year=2025))
    t = totals_of(res, 2025)
    assert t["stock_result"] == 50.0
    assert [r["tax_year"] for r in res.sales.collect()] == [2025]


def test_swiss_excess_is_refundable_and_gets_a_form_line(spark, csv_ledger):
    led = csv_ledger(NARROW + "14-11-2025 10:20:30;Dividende;Own SA;CH0000000511;65.00;-35.00;EUR\n")
    res = run(spark, led, rules_df(spark, country("CH", "CH", "foreign", "0.15")))
    t = totals_of(res, 2025)
    assert t["credit"] == 15.0 and t["excess"] == 20.0 and t["swiss_refundable"] == 20.0
    lines = {r["form"]: float(r["amount"]) for r in res.form_lines.collect()}
    assert lines["eF85 (ESTV)"] == 20.0


def test_text_amounts_keep_their_sign(spark, csv_ledger):
    led = csv_ledger(
        NARROW
        + "14-11-2025 10:20:30;Dividende;X;DE0000000001;10,50;-;EUR\n"
        + "13-11-2025 10:20:30;Dividende;X;DE0000000001;-1,5;-0,5;EUR\n"
    )
    nets = sorted(float(r["net"]) for r in led.collect())
    assert nets == [-1.5, 10.5]
    taxes = sorted(float(r["tax"]) for r in led.collect())
    assert taxes == [-0.5, 0.0]


def test_bad_dates_and_unknown_currencies_are_issues(spark, csv_ledger):
    led = csv_ledger(
        NARROW
        + "31-02-2025 10:20:30;Dividende;X;DE0000000001;10.00;0.00;EUR\n"
        + "03-02-2025 10:20:30;Dividende;X;GB0000000001;10.00;0.00;GBP\n"
    )
    res = run(spark, led)
    got = {(r["issue"], r["n"]) for r in res.issues.collect()}
    assert ("bad_date", 1) in got and ("unknown_currency", 1) in got
    # the unknown currency is converted 1:1 and says so
    srcs = {r["currency"]: r["fx_source"] for r in res.ledger_fx.collect()}
    assert srcs["GBP"] == "assumed_1"
    assert [(r["currency"], r["n"]) for r in res.unknown_currencies.collect()] == [("GBP", 1)]


def test_quarantine_drops_offending_accounts_only(spark, csv_ledger):
    good = csv_ledger(NARROW + "14-11-2025 10:20:30;Dividende;X;DE0000000001;10.00;0.00;EUR\n", account="good")
    bad = csv_ledger(NARROW + "03-02-2025 10:20:30;Dividende;X;GB0000000001;10.00;0.00;GBP\n", account="bad")
    res = run(spark, good.unionByName(bad), cfg=OFFLINE.with_(on_issue="quarantine"))
    assert {r["account_id"] for r in res.form_lines.collect()} == {"good"}


def test_error_policy_raises(spark, csv_ledger):
    from kapspark.operators.issues import LedgerIssuesError

    led = csv_ledger(NARROW + "03-02-2025 10:20:30;Dividende;X;GB0000000001;10.00;0.00;GBP\n")
    with pytest.raises(LedgerIssuesError, match="unknown_currency"):
        run(spark, led, cfg=OFFLINE.with_(on_issue="error"))


def test_checkpointed_ledger_gives_the_same_lines(spark, csv_ledger):
    led = csv_ledger(
        NARROW
        + "14-11-2025 10:20:30;Dividende;Own SA;CH0000000511;40.00;-10.00;EUR\n"
        + "12-05-2025 10:20:30;Zinsen auf Einlagen;;;10.00;0.00;EUR\n"
    )
    a = {(r["line"], float(r["amount"])) for r in run(spark, led).form_lines.collect()}
    b = {(r["line"], float(r["amount"])) for r in run(spark, led, cfg=OFFLINE.with_(checkpoint_ledger=True)).form_lines.collect()}
    assert a == b


def test_renamed_tax_column_is_mapped(spark, csv_ledger):
    led = csv_ledger(
        "Datum;Transaktionen;Name;ISIN;Nettobetrag;Quellensteuer;Währung\n"
        "14-11-2025 10:20:30;Dividende;Own Inc;US0000000309;85.00;-15.00;USD\n",
        columns={"tax": "Quellensteuer"},
    )
    res = run(spark, led, rules_df(spark, US_RULE))
    t = totals_of(res, 2025)
    assert display(t["credit"]) == 14.29 and display(t["foreign_share_dividends"]) == 95.24


def test_partial_exemption_rates_per_fund_type(spark, csv_ledger):
    rows = "".join(
        f"14-11-2025 10:20:30;Dividende;F;IE000000000{i};100.00;0.00;EUR\n" for i in range(5)
    )
    led = csv_ledger(NARROW + rows)
    rules = rules_df(
        spark,
        *[
            security(f"IE000000000{i}", "IE", "foreign", "0.0", "fund", ft)
            for i, ft in enumerate(["equity", "mixed", "real_estate", "other", None])
        ],
    )
    fb = {r["fund_type"]: (float(r["gross_total"]), r["exemption_pct"], float(r["taxable"]))
          for r in run(spark, led, rules).fund_breakdown.collect()}
    assert fb == {
        "equity": (100.0, "30%", 70.0),
        "mixed": (100.0, "15%", 85.0),
        "real_estate": (100.0, "60%", 40.0),
        "other": (200.0, "0%", 200.0),
    }


def test_whole_euro_display_is_half_even(spark):
    from kapspark.operators.report import display_amounts

    df = spark.createDataFrame(
        [(0.5,), (1.5,), (2.675,), (-0.125,), (14.285714,)], "amount double"
    ).selectExpr("cast(amount as decimal(38,10)) as amount")
    euros = [r["display_text"] for r in display_amounts(df, whole_euros=True).collect()]
    cents = [r["display_text"] for r in display_amounts(df).collect()]
    # as Python's round(): 0.5 -> 0, 1.5 -> 2, -0.125 -> 0
    assert euros == ["0 EUR", "2 EUR", "3 EUR", "0 EUR", "14 EUR"]
    assert cents == ["0.50 EUR", "1.50 EUR", "2.68 EUR", "-0.12 EUR", "14.29 EUR"]


def test_overlapping_type_lists(spark, csv_ledger):
    led = csv_ledger(
        "Datum;Transaktionen;Name;ISIN;Anzahl;Nettobetrag;Kosten;Währung\n"
        "14-11-2025 10:20:30;Ertrag;X;DE0000000001;1;10.00;0;EUR\n"
        "01-01-2025 09:00:00;Tausch;Y;DE0000000002;2;-200.00;0;EUR\n"
        "01-03-2025 09:00:00;Verkauf;Y;DE0000000002;1;150.00;0;EUR\n"
    )
    cfg = OFFLINE.with_(
        dividend_types=("Dividende", "Ertrag"),
        interest_types=("Zinsen auf Einlagen", "Ertrag"),
        purchase_types=("Kauf", "Tausch"),
        sale_types=("Verkauf", "Tausch"),
    )
    res = run(spark, led, cfg=cfg)
    t = totals_of(res, 2025)
    # a type in two income lists counts in both; a type in both trade lists is a buy
    assert t["domestic_share_dividends"] == 10.0 and t["interest"] == 10.0
    assert t["stock_result"] == 50.0


def test_quarantine_drops_an_account_with_a_fifo_shortfall(spark, csv_ledger):
    short = csv_ledger(
        HEADER + line("01-03-2025", "Verkauf", "150.00", "EUR", isin="DE0000000456"),
        account="short",
    )
    fine = csv_ledger(
        HEADER
        + line("01-01-2024", "Kauf", "-100.00", "EUR", isin="DE0000000456")
        + line("01-03-2025", "Verkauf", "150.00", "EUR", isin="DE0000000456"),
        account="fine",
    )
    res = run(spark, short.unionByName(fine), cfg=OFFLINE.with_(on_issue="quarantine"))
    assert {r["account_id"] for r in res.form_lines.collect()} == {"fine"}
    assert {r["account_id"] for r in res.sales.collect()} == {"fine"}
    assert ("short", "fifo_shortfall") in {(r["account_id"], r["issue"]) for r in res.issues.collect()}
