"""Sinks by year: years stay beside each other, and all report tables come from one pass."""

from __future__ import annotations

from pathlib import Path

import pytest
from helpers import OFFLINE, rules_df, run, security

from kapspark.sources.sinks import write_details, write_reports

HEADER = "Datum;Auftrag #;Transaktionen;Name;ISIN;Anzahl;Nettobetrag;Kosten;Währung"
ROWS = """01-02-2021 10:00:00;1;Kauf;S;CH0012032048;10;-1000,00;0,00;EUR
01-03-2021 10:00:00;2;Verkauf;S;CH0012032048;4;600,00;0,00;EUR
01-04-2021 10:00:00;3;Dividende;F;IE00B3RBWM25;0;100,00;0,00;EUR
01-05-2021 10:00:00;4;Dividende;S;CH0012032048;0;65,00;-35,00;EUR
01-05-2021 10:00:00;5;Withholding Tax;S;FR0000121014;0;-5,00;0,00;EUR
01-03-2022 10:00:00;6;Verkauf;S;CH0012032048;6;300,00;0,00;EUR
01-04-2022 10:00:00;7;Zinsen auf Einlagen;Z;;0;20,00;-2,00;EUR
01-04-2022 10:00:00;8;Dividende;F;IE00B3RBWM25;0;30,00;0,00;EUR"""


@pytest.fixture()
def result(spark, csv_ledger):
    def make(text=ROWS, **changes):
        rules = rules_df(spark, security("IE00B3RBWM25", "IE", "foreign", 0.0, "fund", "equity"))
        return run(spark, csv_ledger(f"{HEADER}\n{text}"), rules, OFFLINE.with_(**changes))

    return make


TABLES = {"form_lines": "form_lines", "credit_by_country": "by_country", "fund_breakdown": "fund_breakdown", "report_positions": "positions"}


def rows_of(df):
    columns = sorted(c for c in df.columns)
    as_text = df.selectExpr(*[f"cast(`{c}` as string) as `{c}`" for c in columns])
    return sorted(map(tuple, as_text.collect()), key=repr)


@pytest.mark.parametrize("policy", ["flag", "quarantine"])
def test_tables_from_one_aggregate_equal_the_single_outputs(result, policy):
    res = result(on_issue=policy)
    tables, years = res.reports()
    assert years == [2021, 2022]
    single = result(on_issue=policy)
    for name, attribute in TABLES.items():
        want = getattr(single, attribute)
        got = tables[name].selectExpr(*[f"cast(`{c}` as {t}) as `{c}`" for c, t in want.dtypes])
        assert rows_of(got) == rows_of(want), name
        assert got.count() > 0


def test_report_tables_read_the_stored_aggregate_only(spark, result):
    res = result()
    tables, _ = res.reports()
    for name, df in tables.items():
        assert df.inputFiles() and all("report_facts" in f for f in df.inputFiles()), name
    from kapspark.operators import report

    facts = report.account_facts(res.rows, res._sales_all)._jdf.queryExecution().executedPlan().toString()
    assert facts.count("FileScan csv") == 2  # one income scan, one FIFO scan


def test_years_are_replaced_one_by_one(spark, result, tmp_path):
    out = str(tmp_path / "reports")
    for year in (2021, 2022):
        write_reports(result(tax_year=year), out)
    both = {t: rows_of(spark.read.parquet(f"{out}/{t}")) for t in TABLES}
    write_reports(result(), str(tmp_path / "once"))
    assert both == {t: rows_of(spark.read.parquet(f"{tmp_path}/once/{t}")) for t in TABLES}
    # 2021 again, corrected: without fund dividends and foreign tax; 2022 stays
    corrected = "\n".join(r for r in ROWS.splitlines() if r.split(";")[1] not in ("3", "4", "5"))
    write_reports(result(corrected, tax_year=2021), out)
    for t in TABLES:
        table = spark.read.parquet(f"{out}/{t}")
        old = spark.read.parquet(f"{tmp_path}/once/{t}")
        assert rows_of(table.where("tax_year = 2022")) == rows_of(old.where("tax_year = 2022"))
    assert spark.read.parquet(f"{out}/fund_breakdown").where("tax_year = 2021").count() == 0
    assert spark.read.parquet(f"{out}/credit_by_country").where("tax_year = 2021").count() == 0
    assert spark.read.parquet(f"{out}/form_lines").where("tax_year = 2021").count() > 0


def test_details_by_year(spark, result, tmp_path):
    out = str(tmp_path / "details")
    read = lambda: spark.read.option("header", True).option("sep", ";").csv(out)
    for year in (2021, 2022):
        write_details(result(tax_year=year).details(), out)
    assert {(r["tax_year"], r["n"]) for r in read().groupBy("tax_year").count().withColumnRenamed("count", "n").collect()} == {
        (2021, 3),
        (2022, 3),
    }
    nothing = result(tax_year=2021).details().where("false")
    write_details(nothing, out, years=[2021])
    assert {r["tax_year"] for r in read().select("tax_year").distinct().collect()} == {2022}


def test_files_follow_the_data_not_the_tasks(spark, result, tmp_path):
    out = tmp_path / "many"
    write_details(result().details().repartition(40), str(out), fmt="parquet")
    for year in (2021, 2022):
        assert len(list(Path(out, f"tax_year={year}").glob("*.parquet"))) == 1


def test_totals_of_income_and_present_years_equal_those_of_all_bookings(result):
    from kapspark.operators import report

    text = f"{ROWS}\n01-04-2023 10:00:00;9;Kauf;S;CH0012032048;1;-10,00;0,00;EUR\n01-05-2024 10:00:00;10;Dividende;S;CH0012032048;0;0,00;0,00;EUR"
    res = result(text)
    assert res.rows.where("scope is null").count() > 0 and res._income.where("scope is null").count() == 0
    assert res._present.count() == 4
    for countries in (False, True):
        want = report.account_year_totals(res.rows, res._sales_all, True, countries)
        got = report.account_year_totals(res._income, res._sales_all, True, countries, present=res._present)
        assert rows_of(got) == rows_of(want) and got.count() == 4
    want = report.totals_of(report.account_facts(res.rows, res._sales_all), True)
    got = report.totals_of(report.account_facts(res._income, res._sales_all, res._present), True)
    assert rows_of(got) == rows_of(want) and got.count() == 4


def test_sums_skip_zeros_only(spark):
    from kapspark.functions import nonzero_sum

    rows = spark.sql("select * from values (1, 0.1D), (1, 0D), (1, -0.3D), (2, 0D), (3, null) as t(k, x)")
    got = {r["k"]: r["s"] for r in rows.groupBy("k").agg(nonzero_sum("x", "decimal(28,10)").alias("s")).collect()}
    assert {k: v if v is None else float(v) for k, v in got.items()} == {1: -0.2, 2: None, 3: None}


def test_quarantine_runs_fifo_once(result):
    lines = result(on_issue="quarantine").form_lines
    assert any("/sales/" in f for f in lines.inputFiles())
    assert "cum_buy" not in lines._jdf.queryExecution().executedPlan().toString()
    assert lines.count() > 0


def test_years_of_one_result_share_the_stored_fifo_result(result):
    whole = result(checkpoint_sales=True)
    for year in (2021, 2022):
        of_year, single = whole.for_year(year), result(tax_year=year)
        assert of_year._sales_all is whole._sales_all and any("/sales/" in f for f in of_year.sales.inputFiles())
        got, want = of_year.reports(), single.reports()
        assert got[1] == want[1] == [year]
        assert all(rows_of(got[0][name]) == rows_of(want[0][name]) for name in TABLES)
