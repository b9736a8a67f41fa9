"""Physical-plan properties: dimensions broadcast, no Python, pruned scans.

Spark itself decides to broadcast the dimensions here: they are small.
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kapspark.plans import catalog
from kapspark.sources.demo import DEMO_CONFIG

SMALL = "/root/testdata/sf0.001"
CFG = DEMO_CONFIG.with_(checkpoint_ledger=False, checkpoint_sales=False)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _frames(spark):
    r = catalog.run(spark, SMALL, CFG)
    return {
        "form_lines": r.form_lines,
        "positions": r.positions,
        "fx": r.ledger_fx.groupBy("account_id", "fx_source").agg(F.sum("net_eur")),
        "sales": r.sales_all_years,
        "details": r.details(),
    }


@pytest.mark.parametrize("name", ["form_lines", "positions", "fx", "sales", "details"])
def test_dimension_joins_are_broadcast_and_no_python(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(_frames(spark)[name])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan, plan
    assert "BroadcastHashJoin" in plan
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(_frames(spark)["fx"])
    scan = [line for line in plan.splitlines() if "lineitem" in line and "ReadSchema" in line][0]
    assert "l_quantity" not in scan and "l_returnflag" not in scan and "l_discount" not in scan


def test_quarantined_aggregates_shuffle_no_rows_by_account(spark):
    """A short list of accounts is broadcast; a long one meets the result of
    the aggregate, not its rows."""
    r = catalog.run(spark, SMALL, CFG.with_(on_issue="quarantine"))
    flagged = catalog.run(spark, SMALL, CFG)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    by_account = "Exchange hashpartitioning(account_id"
    try:
        for name in ("summary", "fund_breakdown"):
            assert _plan(getattr(r, name)).count(by_account) == _plan(getattr(flagged, name)).count(by_account), name
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name in ("summary", "fund_breakdown"):
            tree = r.__class__.__dict__[name].func(r)._jdf.queryExecution().optimizedPlan().toString()
            assert tree.index("LeftAnti") < tree.index("Aggregate"), tree
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _many_rules(spark, n):
    key = F.concat(F.lit("ZZ"), F.lpad(F.col("id").cast("string"), 10, "0"))
    texts = {"kind": F.lit("security"), "key": key, "source_country": F.lit("ZZ"), "tax_treatment": F.lit("foreign"),
             "max_creditable_rate": F.lit(0.1), "instrument": F.lit("share"), "fund_type": F.lit(None).cast("string")}
    big = spark.range(n).select(*[c.alias(name) for name, c in texts.items()])
    return catalog.demo_dims(spark, CFG)[1].drop("rejected").select(*texts).unionByName(big)


def test_a_large_rules_table_never_shuffles_by_prefix(spark):
    """Security rules above the broadcast limit: one exchange by ISIN with spread keys, none by two letters."""
    from kapspark.operators.rules import resolve_rules
    from kapspark.sources.demo import demo_ledger

    ledger = demo_ledger(spark, SMALL).limit(2000).withColumn("isin", F.when(F.col("code") != 9, F.col("isin")))
    few = resolve_rules(ledger, _many_rules(spark, 0), CFG)
    many = resolve_rules(ledger, _many_rules(spark, 50_000), CFG)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(many)
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        assert "hashpartitioning(substring" not in plan and "hashpartitioning(_rkey" not in plan
        assert "hashpartitioning(_rjoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
        columns = ("order_key", "line_no", "supp_key", "isin", "rule", "rule_origin")
        rows = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
        assert rows(many) == rows(few)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    keyless = many.where("isin is null").select("rule_origin").distinct().collect()
    assert [r[0] for r in keyless] == [None]


def test_fifo_over_a_bucketed_ledger_has_no_exchange(spark):
    sales = catalog.q_fifo_bucketed(spark, SMALL)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(sales.select("*"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange hashpartitioning(account_id" not in plan and "Exchange rangepartitioning" not in plan, plan
    assert plan.count("Window") >= 2 and "Bucketed: true" in plan
    plain = catalog.q_fifo_realized(spark, SMALL)
    assert sorted(map(repr, sales.collect())) == sorted(map(repr, plain.collect()))


def test_buckets_follow_the_size_of_the_ledger(spark, monkeypatch):
    from kapspark.sources import ledger

    monkeypatch.setattr(ledger, "BUCKET_ROWS", 100)
    assert ledger.buckets_for(spark.range(10)) == 16
    assert ledger.buckets_for(spark.range(2001)) == 21
    found = ledger.buckets_for(catalog.demo_ledger(spark, SMALL))
    assert found > 16 and f"{found} out of {found}" in _plan(catalog.q_fifo_bucketed(spark, SMALL))


def test_trades_are_dropped_from_the_income_branch_before_they_are_shuffled(spark):
    plan = catalog.run(spark, SMALL).classified._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "Filter" in below[:below.index("Relation")], plan
