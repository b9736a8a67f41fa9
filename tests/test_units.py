"""Unit checks: rule resolution and validation, classification, rates, payloads, sinks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import OFFLINE, country, rules_df, security
from kapspark.operators import classify as CL
from kapspark.operators.fx import fx_convert, rates_for_dates
from kapspark.operators.issues import rules_issues, valid_rules
from kapspark.operators.rules import resolve_rules
from kapspark.sources.dims import yearly_rates
from kapspark.sources.rates import rates_from_payloads


def _resolve(spark, rules, isins):
    df = spark.createDataFrame([(i,) for i in isins], "isin string")
    out = resolve_rules(df, rules, OFFLINE).collect()
    return {r["isin"]: (None if r["rule"] is None else tuple(r["rule"])) for r in out}


def test_rule_precedence_and_defaults(spark):
    rules = rules_df(
        spark, country("CH", "CH", "foreign", "0.15"), security("CH0000000512", "US", "foreign", "0.10")
    )
    got = _resolve(spark, rules, ["CH0000000000", "CH0000000512", "ch0000000512", "DE0000000208",
                                  "US0378331005", "XS1234567890", "12345", "A", None, ""])
    assert got["CH0000000000"] == ("CH", "foreign", 0.15, "share", None)
    assert got["CH0000000512"] == ("US", "foreign", 0.10, "share", None)
    assert got["ch0000000512"] == ("US", "foreign", 0.10, "share", None)
    assert got["DE0000000208"] == ("DE", "domestic", 0.0, "share", None)
    assert got["US0378331005"] == ("US", "foreign", 0.15, "share", None)
    assert got["XS1234567890"] == ("XS", "foreign", 0.15, "share", None)
    assert got["12345"] is None and got["A"] is None and got[None] is None and got[""] is None


def test_exact_rule_wins_as_a_whole_struct(spark):
    rules = rules_df(
        spark,
        {"kind": "country", "key": "IE", "source_country": "IE", "tax_treatment": "foreign",
         "max_creditable_rate": "0.15"},
        security("IE0000000410", "IE", "foreign", "0.0", "fund"),
    )
    got = _resolve(spark, rules, ["IE0000000410"])
    assert got["IE0000000410"] == ("IE", "foreign", 0.0, "fund", None)


def test_rule_validation(spark):
    rules = rules_df(
        spark,
        security("DE0000000208", "DE", "domestic", "0.15"),
        country("CHE", "CH", "foreign", "0.15"),
        security("IE0000000410", "IE", "foreign", "0.0", "bond"),
        security("IE0000000411", "IE", "foreign", "0.0", "share", "equity"),
        security("US0000000001", "US", "foreign", "true"),
        security("US0000000002", "US", "foreign", "1.5"),
        security("FR0000000001", "FR", "foreign", "0.128"),
        security("FR0000000001", "FR", "foreign", "0.1"),
        security("GB0000000001", "GB", "foreign", "0.0"),
    )
    issues = {(r["key"], r["issue"]) for r in rules_issues(rules).collect()}
    assert ("DE0000000208", "domestic_with_credit") in issues
    assert ("CHE", "bad_prefix") in issues
    assert ("IE0000000410", "bad_instrument") in issues
    assert ("IE0000000411", "fund_type_without_fund") in issues
    assert ("US0000000001", "bad_rate_type") in issues
    assert ("US0000000002", "rate_out_of_range") in issues
    assert ("FR0000000001", "duplicate_key") in issues
    assert {r["key"] for r in valid_rules(rules, OFFLINE).collect()} == {"GB0000000001"}
    from kapspark.operators.issues import LedgerIssuesError

    with pytest.raises(LedgerIssuesError):
        valid_rules(rules, OFFLINE.with_(on_issue="error"))


def test_embedded_classification_goldens(spark):
    rules = rules_df(
        spark, security("CH0000000512", "CH", "foreign", "0.15"), security("DE0000000208", "DE", "domestic", "0.0")
    )
    df = spark.createDataFrame(
        # fixed golden amounts
        [("CH0000000512", 65.0, -35.0), ("DE0000000208", 73.625, -26.375), ("12345", 85.0, -15.0)],
        "isin string, net_eur double, tax_eur double",
    ).withColumn("scope", F.lit("dividend"))
    out = CL.classify_income(resolve_rules(df, rules, OFFLINE), has_tax=True)
    s = out.agg(*[F.sum(c).alias(c) for c in ("credit_eur", "excess_eur", "domestic_eur", "kest_eur", "soli_eur",
                                              "unclassified_eur", "swiss_refundable_eur")]).collect()[0]
    assert s["credit_eur"] == 15.0 and s["excess_eur"] == 20.0
    assert s["domestic_eur"] == 26.375 and s["kest_eur"] == 25.0 and s["soli_eur"] == pytest.approx(1.375)
    assert s["unclassified_eur"] == 15.0 and s["swiss_refundable_eur"] == 20.0
    assert [r["source_country"] for r in out.collect()] == ["CH", "DE", None]


def test_dividend_forms(spark):
    rules = rules_df(
        spark,
        security("IE0000000410", "IE", "foreign", "0.0", "fund"),
        security("DE0000000208", "DE", "domestic", "0.0"),
        security("CH0000000511", "CH", "foreign", "0.15"),
    )
    isins = ["IE0000000410", "DE0000000208", "CH0000000511", "FR0000000613", None]
    df = spark.createDataFrame([(i,) for i in isins], "isin string").withColumn("scope", F.lit("dividend"))
    out = CL.tag_dividend_forms(resolve_rules(df, rules, OFFLINE)).collect()
    assert [r["form"] for r in out] == [
        "Anlage KAP-INV", "Anlage KAP inländisch", "Anlage KAP ausländisch", "Anlage KAP ausländisch",
        "Anlage KAP ausländisch",
    ]


def _rate(spark, day, cur, daily=None, cfg=OFFLINE):
    led = spark.createDataFrame([(1, day, cur, 1.0)], "account_id int, ts timestamp_ntz, currency string, net double")
    return fx_convert(led, daily, yearly_rates(spark), cfg).select("fx_rate", "fx_source").collect()[0]


def test_rate_choice(spark):
    assert tuple(_rate(spark, dt.datetime(2020, 1, 1), "USD")) == (1.1421, "yearly")
    assert tuple(_rate(spark, dt.datetime(2024, 6, 15), "USD")) == (1.0825, "yearly")
    assert tuple(_rate(spark, dt.datetime(2024, 1, 15), "EUR")) == (1.0, "eur")
    daily = spark.createDataFrame(
        [(dt.date(2024, 6, 15), "USD", 1.09), (dt.date(2024, 6, 15), "CHF", 0.94)], "rate_date date, currency string, rate double"
    )
    online = OFFLINE.with_(offline=False)
    assert tuple(_rate(spark, dt.datetime(2024, 6, 15, 9), "USD", daily, online)) == (1.09, "daily")
    assert tuple(_rate(spark, dt.datetime(2024, 6, 15, 9), "USD", daily, OFFLINE)) == (1.0825, "yearly")
    assert _rate(spark, dt.datetime(2019, 6, 15), "USD")["fx_source"] == "missing"
    assert tuple(_rate(spark, dt.datetime(2024, 6, 15), "GBP")) == (1.0, "assumed_1")
    dates = spark.createDataFrame([(dt.date(2024, 6, 15),)], "rate_date date")
    got = {r["currency"]: r["fx_rate"] for r in rates_for_dates(dates, ("USD", "CHF", "EUR"), daily, yearly_rates(spark), online).collect()}
    assert got == {"USD": 1.09, "CHF": 0.94, "EUR": 1.0}


def test_rate_payloads(spark):
    rows = [
        (dt.date(2025, 1, 15), '{"amount":1.0,"base":"EUR","date":"2025-01-15","rates":{"CHF":0.9394,"USD":1.03}}'),
        (dt.date(2025, 1, 16), '{"rates":{"2025-01-16":{"CHF":0.93945,"USD":1.0312345}}}'),
        (dt.date(2025, 1, 17), '{"rates":{}}'),
        (dt.date(2025, 1, 18), '{"rates":{"GBP":0.8}}'),
        (dt.date(2025, 1, 19), "not json"),
        (dt.date(2025, 1, 20), '{"date":"2025-01-17","rates":{"USD":1.04}}'),
    ]
    payloads = spark.createDataFrame(rows, "requested_date date, body string")
    got = {(str(r["rate_date"]), r["currency"]): r["rate"] for r in rates_from_payloads(payloads).collect()}
    assert got == {
        ("2025-01-15", "EUR"): 1.0, ("2025-01-15", "USD"): 1.03, ("2025-01-15", "CHF"): 0.9394,
        ("2025-01-16", "EUR"): 1.0, ("2025-01-16", "USD"): 1.0312, ("2025-01-16", "CHF"): 0.9394,
        ("2025-01-20", "EUR"): 1.0, ("2025-01-20", "USD"): 1.04,
    }


def test_rate_payloads_are_parsed_after_the_distinct_below_them(spark):
    days = spark.range(1000).selectExpr("date_add(date'2025-01-01', cast(id % 2 as int)) as requested_date").distinct()
    body = F.format_string('{"rates": {"USD": 1.0%d}}', F.dayofmonth("requested_date"))
    rates = rates_from_payloads(days.withColumn("body", body))
    plan = rates._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate"):]
    assert "from_json" in plan and "from_json" not in below and "get_json_object" not in below, plan
    got = sorted((r["currency"], r["rate"]) for r in rates.collect())
    assert got == [("EUR", 1.0), ("EUR", 1.0), ("USD", 1.01), ("USD", 1.02)]


def test_sinks_round_trip(spark, csv_ledger, tmp_path):
    from kapspark.plans.tax_run import calculate
    from kapspark.sources.sinks import write_details, write_reports

    led = csv_ledger(
        "Datum;Transaktionen;Name;ISIN;Anzahl;Nettobetrag;Kosten;Währung\n"
        "31-12-2025 15:57:09;Dividende;X;CH0000000511;1;65.00;-35.00;EUR\n"
        "01-01-2025 09:00:00;Kauf;Y;DE0000000001;2;-200.00;0;EUR\n"
        "01-03-2025 09:00:00;Verkauf;Y;DE0000000001;1;150.00;0;EUR\n"
    )
    res = calculate(spark, led, None, None, OFFLINE)
    write_details(res.details(), str(tmp_path / "details"))
    back = spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "details"))
    assert sorted(r["category"] for r in back.collect()) == ["Aktienverkauf", "Dividende"]
    write_reports(res, str(tmp_path / "reports"))
    lines = spark.read.parquet(str(tmp_path / "reports" / "form_lines"))
    assert lines.count() == 9  # 8 lines + the Swiss refund line


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert {"account_id", "tax_year", "form", "line", "label", "amount"} <= set(df.columns)


def test_folder_of_exports_gives_one_account_per_file(spark, tmp_path):
    from kapspark.plans.tax_run import calculate
    from kapspark.sources.ledger import read_ledger_csv

    folder = tmp_path / "exports"
    folder.mkdir()
    header = "Datum;Transaktionen;Name;ISIN;Nettobetrag;Kosten;Währung\n"
    (folder / "anna.csv").write_bytes(
        (header + "31-12-2025 15:57:09;Dividende;SAP;DE0000000208;73.625;-26.375;EUR\n").encode("latin1")
    )
    (folder / "ben.csv").write_bytes(
        (header + '30-06-2024 15:57:09;Zinsen auf Einlagen;"Konto; Zinsen";;10,00;-;EUR\n').encode("latin1")
    )
    led = read_ledger_csv(spark, str(folder))
    assert sorted((r["account_id"], r["name"]) for r in led.collect()) == [("anna", "SAP"), ("ben", "Konto; Zinsen")]
    res = calculate(spark, led, None, None, OFFLINE)
    got = {(r["account_id"], r["tax_year"], r["line"]): float(r["amount"]) for r in res.form_lines.collect()}
    assert got[("anna", 2025, "18")] == 100.0 and got[("ben", 2024, "19")] == 10.0


def test_checkpoint_dir_is_taken_from_the_session(spark):
    from kapspark.plans.catalog import ensure_checkpoint_dir, scratch_dir

    configured = spark.sparkContext.getCheckpointDir()
    assert configured
    assert ensure_checkpoint_dir(spark) == configured
    assert scratch_dir(spark).startswith(configured)
    assert spark.sparkContext.getCheckpointDir() == configured


def test_repeated_and_bad_rates_never_multiply_bookings(spark):
    from kapspark.sources.rates import rate_conflicts

    online = OFFLINE.with_(offline=False)
    ddl = "rate_date date, currency string, rate double"
    twice = spark.createDataFrame(
        [(dt.date(2024, 6, 15), "USD", 1.09), (dt.date(2024, 6, 15), "usd", 1.08), (dt.date(2024, 6, 16), "USD", 0.0)], ddl
    )
    yearly = yearly_rates(spark).unionByName(
        spark.createDataFrame([(2024, "USD", 1.5), (2023, "USD", -1.0), (2023, "CHF", 0.0)], "year int, currency string, rate double")
    )
    led = spark.createDataFrame(
        [(1, dt.datetime(2024, 6, 15, 8), "USD", 1.0), (2, dt.datetime(2024, 6, 16, 8), "USD", 1.0),
         (3, dt.datetime(2024, 7, 1), "USD", 1.0)],
        "account_id int, ts timestamp_ntz, currency string, net double",
    )
    got = {r["account_id"]: (r["fx_rate"], r["fx_source"]) for r in fx_convert(led, twice, yearly, online).collect()}
    assert got == {1: (1.09, "daily"), 2: (None, "missing"), 3: (1.5, "yearly")}
    named = {(r["period"], r["currency"], r["issue"]) for r in rate_conflicts(twice, yearly).collect()}
    assert named == {
        ("2024-06-15", "USD", "conflicting_rate"), ("2024-06-16", "USD", "bad_rate"), ("2024", "USD", "conflicting_rate"),
        ("2023", "USD", "conflicting_rate"), ("2023", "USD", "bad_rate"), ("2023", "CHF", "conflicting_rate"),
        ("2023", "CHF", "bad_rate"),
    }


def test_error_policy_names_every_kind_of_issue(spark):
    from kapspark.operators.issues import LedgerIssuesError, enforce

    many = spark.createDataFrame([(i, f"kind_{i % 30:02d}", 1) for i in range(300)], "account_id int, issue string, n int")
    with pytest.raises(LedgerIssuesError) as raised:
        enforce(many, OFFLINE.with_(on_issue="error"))
    assert [r["issue"] for r in raised.value.samples] == [f"kind_{i:02d}" for i in range(30)]
    assert {r["n_account_id"] for r in raised.value.samples} == {10}


def test_a_rejected_rule_never_falls_back(spark):
    rules = rules_df(
        spark,
        security("US0000000309", "US", "foreign", "1.5"),
        {"kind": "country", "key": "US", "source_country": "US", "tax_treatment": "foreign", "max_creditable_rate": "0.1"},
        {"kind": "country", "key": "FR", "source_country": "FR", "tax_treatment": "unknown", "max_creditable_rate": "0.1"},
        security("FR0000000613", "FR", "foreign", "0.128"),
    )
    from kapspark.operators.issues import judged_rules

    isins = ["US0000000309", "US0000000310", "FR0000000613", "FR0000000614"]
    df = spark.createDataFrame([(i,) for i in isins], "isin string")
    out = resolve_rules(df, judged_rules(rules, OFFLINE), OFFLINE).collect()
    assert {r["isin"]: (r["rule_origin"], r["rule"] is None) for r in out} == {
        "US0000000309": ("rejected", True),
        "US0000000310": ("country", False),
        "FR0000000613": ("security", False),
        "FR0000000614": ("rejected", True),
    }


def test_bookings_of_a_rejected_rule_are_issues_and_null_accounts_are_quarantined(spark):
    from helpers import run

    led = spark.createDataFrame(
        [(1, dt.datetime(2025, 5, 5), "Dividende", "US0000000309", None, "EUR", None, 10.0, 0.0),
         (2, dt.datetime(2025, 5, 5), "Dividende", "DE0000000208", None, "EUR", None, 10.0, 0.0),
         (None, dt.datetime(2025, 5, 5), "Dividende", "DE0000000208", None, "EUR", None, 10.0, 0.0)],
        "account_id int, ts timestamp_ntz, type string, isin string, name string, currency string, "
        "quantity decimal(20,8), net double, tax double",
    )
    rules = rules_df(spark, security("US0000000309", "US", "foreign", "1.5"))
    cfg = OFFLINE.with_(on_issue="quarantine", tiebreak=None)
    res = run(spark, led, rules, cfg)
    assert {(r["account_id"], r["issue"]) for r in res.issues.collect()} == {(1, "rule_rejected"), (None, "missing_account")}
    assert {r["issue"] for r in res.rules_issues.collect()} == {"rate_out_of_range"}
    assert {r["account_id"] for r in res.form_lines.collect()} == {2}
    assert [r["account_id"] for r in res.section("dividend").collect()] == [2]
    assert res.section("dividend").columns[:6] == ["account_id", "tax_year", "ts", "name", "net", "currency"]


def test_taxable_part_of_a_fund_keeps_all_places(spark):
    from kapspark.operators.report import fund_breakdown

    df = spark.createDataFrame([(1, 2025, "Anlage KAP-INV", "equity", 3.3333333333)],
                               "account_id int, tax_year int, form string, fund_type string, gross_eur double")
    assert str(fund_breakdown(spark, df).collect()[0]["taxable"]) == "2.3333333333"
