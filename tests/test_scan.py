"""Ledger scans: files with different headers, malformed rows, samples of bad rows."""

from __future__ import annotations

import pytest
from helpers import OFFLINE, run, totals_of

from kapspark.plans.tax_run import calculate
from kapspark.sources.ledger import MissingColumnsError, files_by_header, read_ledger_csv

USUAL = "Datum;Transaktionen;Name;ISIN;Nettobetrag;Kosten;Währung"
DIVIDEND = {"Datum": "15-06-2024 12:00:00", "Transaktionen": "Dividende", "Name": "N", "ISIN": "CH0012032048",
            "Nettobetrag": "65,00", "Kosten": "-35,00", "Währung": "EUR"}


def line(header, **changes):
    return ";".join({**DIVIDEND, **changes}.get(c, "x") for c in header.split(";"))


def write(folder, name, header, *lines):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_bytes("\n".join([header, *lines, ""]).encode("latin1"))
    return str(folder / name)


def figures(spark, ledger):
    rows = run(spark, ledger).totals.orderBy("account_id").collect()
    return {r["account_id"]: (float(r["foreign_share_dividends"]), float(r["credit"]), float(r["interest"])) for r in rows}


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    mixed = "Kosten;Währung;Nettobetrag;Depot;ISIN;Datum;Transaktionen;Name"
    short = "Nettobetrag;Währung;Datum;Transaktionen;ISIN"
    files = [
        write(tmp_path / "in", "a.csv", USUAL, line(USUAL)),
        write(tmp_path / "in", "b [1]+c.csv", mixed, line(mixed, Nettobetrag="10,00", Kosten="-1,00")),
        write(tmp_path / "in", "c.csv", short, line(short, Nettobetrag="7,50", Transaktionen="Zinsen auf Einlagen")),
        write(tmp_path / "in", "d.csv", mixed, line(mixed, Nettobetrag="20,00", Kosten="-")),
    ]
    (tmp_path / "in" / "e.csv").write_bytes(b"")  # an empty file has no rows
    folder = str(tmp_path / "in")
    groups = files_by_header(spark, folder)
    assert sorted(map(len, groups.values())) == [1, 1, 2]
    together = figures(spark, read_ledger_csv(spark, folder))
    assert set(together) == {"a", "b [1]+c", "c", "d"}
    alone = {}
    for f in files:
        from_one = read_ledger_csv(spark, f.replace("[", "\\[").replace("]", "\\]"))
        alone |= figures(spark, from_one)
    assert together == alone
    assert together["b [1]+c"][0] == pytest.approx(11.0) and together["c"][2] == 7.5
    # a list of files, and a column that only some files have
    led = read_ledger_csv(spark, [str(tmp_path / "in" / n) for n in ("a.csv", "d.csv")])
    assert {(r["account_id"], r["Depot"]) for r in led.collect()} == {("a", None), ("d", "x")}


def test_folders_by_account_keep_their_partition_column(spark, tmp_path):
    other = ";".join(reversed(USUAL.split(";")))
    write(tmp_path / "in" / "konto=7", "x.csv", USUAL, line(USUAL))
    write(tmp_path / "in" / "konto=8", "x.csv", other, line(other, Nettobetrag="1,00"))
    led = read_ledger_csv(spark, str(tmp_path / "in"), account_id="konto")
    assert {(r["account_id"], r["net"]) for r in led.collect()} == {(7, 65.0), (8, 1.0)}


def test_a_file_without_a_needed_column_is_named(spark, tmp_path):
    write(tmp_path / "in", "a.csv", USUAL, line(USUAL))
    write(tmp_path / "in", "bad.csv", "Datum;Transaktionen;Nettobetrag", "x;y;z")
    with pytest.raises(MissingColumnsError, match=r"Währung.*1 files.*bad\.csv"):
        read_ledger_csv(spark, str(tmp_path / "in"))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_bytes(b"")
    with pytest.raises(MissingColumnsError, match="no header"):
        read_ledger_csv(spark, str(tmp_path / "none"))


def test_one_header_for_all_refuses_another(spark, tmp_path):
    write(tmp_path / "same", "a.csv", USUAL, line(USUAL))
    write(tmp_path / "same", "b.csv", USUAL, line(USUAL))
    assert read_ledger_csv(spark, str(tmp_path / "same"), mixed_headers=False).count() == 2
    other = ";".join(reversed(USUAL.split(";")))
    write(tmp_path / "same", "c.csv", other, line(other))
    with pytest.raises(Exception, match="(?i)header"):
        read_ledger_csv(spark, str(tmp_path / "same"), mixed_headers=False).collect()


def malformed(csv_ledger):
    lines = [line(USUAL), line(USUAL) + ";zu viel", "15-06-2024 12:00:00;Dividende;N", line(USUAL, Nettobetrag="elf")]
    return csv_ledger("\n".join([USUAL, *lines, "", line(USUAL, Nettobetrag="", Datum="31-02-2024 00:00:00")]))


def test_malformed_rows_are_an_issue_and_no_figure(spark, csv_ledger):
    res = run(spark, malformed(csv_ledger))
    found = {r["issue"]: r["n"] for r in res.issues.collect()}
    assert found == {"malformed_row": 2, "bad_amount": 1, "missing_amount": 1, "bad_date": 1}
    assert totals_of(res, 2024)["foreign_share_dividends"] == 100.0  # one row is whole and dated
    assert "malformed_text" not in res.ledger_fx.columns
    with pytest.raises(ValueError, match="malformed_row"):
        calculate(spark, malformed(csv_ledger), None, None, OFFLINE.with_(on_issue="error"))
    assert run(spark, malformed(csv_ledger), cfg=OFFLINE.with_(on_issue="quarantine")).totals.count() == 0


def test_bad_rows_show_the_text_of_the_first_ones(spark, csv_ledger):
    res = run(spark, malformed(csv_ledger))
    rows = {(r["issue"], r["nth"]): r for r in res.bad_rows(k=1).collect()}
    assert set(rows) == {(i, 1) for i in ("malformed_row", "bad_amount", "missing_amount", "bad_date")}
    assert rows["malformed_row", 1]["malformed_text"] in (line(USUAL) + ";zu viel", "15-06-2024 12:00:00;Dividende;N")
    assert rows["bad_amount", 1]["net_text"] == "elf"
    assert rows["bad_date", 1]["ts_text"] == "31-02-2024 00:00:00"
    assert res.bad_rows(k=5).where("issue = 'malformed_row'").count() == 2


def test_bad_rows_are_limited_before_the_shuffle(spark, csv_ledger):
    plan = run(spark, malformed(csv_ledger)).bad_rows(k=2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
