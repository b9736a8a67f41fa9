"""The ``error`` policy while tables are stored: one pass over the ledger checks it and serves the outputs."""

from __future__ import annotations

import pytest
from helpers import OFFLINE, country, rules_df

from kapspark.operators import issues
from kapspark.plans.tax_run import calculate

HEADER = "Datum;Auftrag #;Transaktionen;Name;ISIN;Anzahl;Nettobetrag;Kosten;Währung"
GOOD = """01-02-2021 10:00:00;1;Kauf;S;CH0012032048;10;-1000,00;0,00;EUR
01-03-2021 10:00:00;2;Verkauf;S;CH0012032048;4;600,00;0,00;EUR
01-05-2021 10:00:00;4;Dividende;S;CH0012032048;0;65,00;-35,00;EUR"""
STORED = OFFLINE.with_(on_issue="error", checkpoint_ledger=True, checkpoint_sales=True)


def test_a_sound_ledger_is_read_once(spark, csv_ledger, monkeypatch):
    def second_pass(*_):
        raise AssertionError("the ledger is read again for the check")

    monkeypatch.setattr(issues, "ledger_issues", second_pass)
    rules = rules_df(spark, country("CH", "CH", "foreign", 0.15))
    res = calculate(spark, csv_ledger(f"{HEADER}\n{GOOD}"), None, rules, STORED)
    files = [*res.form_lines.inputFiles(), *res.positions.inputFiles(), *res.details().inputFiles()]
    assert files and not any("transactions.csv" in f for f in files)
    assert res._found and not any(res._found.values())
    amounts = {r["line"]: float(r["amount"]) for r in res.form_lines.collect()}
    assert amounts["19"] == 100.0 and amounts["41"] == 15.0 and amounts["20"] == 200.0


@pytest.mark.parametrize(
    "bad, issue",
    [
        ("01-06-2021 10:00:00;5;Dividende;S;CH0012032048;0;elf;0,00;EUR", "bad_amount"),
        ("01-06-2021 10:00:00;5;Verkauf;S;CH0012032048;99;1,00;0,00;EUR", "fifo_shortfall"),
        ("01-06-2021 10:00:00;5;Dividende;S;CH0012032048;0;1,00;0,00;EUR;zu viel", "malformed_row"),
    ],
)
def test_every_kind_of_issue_still_raises(spark, csv_ledger, bad, issue):
    with pytest.raises(issues.LedgerIssuesError, match=issue):
        calculate(spark, csv_ledger(f"{HEADER}\n{GOOD}\n{bad}"), None, None, STORED)


def test_rejected_rules_raise(spark, csv_ledger):
    rules = rules_df(spark, country("CH", "CH", "domestic", 0.15))
    with pytest.raises(issues.LedgerIssuesError, match="domestic_with_credit"):
        calculate(spark, csv_ledger(f"{HEADER}\n{GOOD}"), None, rules, STORED)


def test_an_absent_year_raises(spark, csv_ledger):
    with pytest.raises(issues.LedgerIssuesError, match="tax_year_absent"):
        calculate(spark, csv_ledger(f"{HEADER}\n{GOOD}"), None, None, STORED.with_(tax_year=2020))
