"""Open lots, and FIFO that goes on from them instead of the whole history."""

from __future__ import annotations

import random
from collections import deque
from decimal import Decimal

import pytest
from helpers import OFFLINE
from pyspark.sql import functions as F

from kapspark.operators import fifo
from kapspark.plans.tax_run import calculate

SCHEMA = "account_id string, ts timestamp_ntz, type string, isin string, name string, currency string, quantity decimal(20,8), net double, order_no string"
KEYS = [("A", "DE01"), ("A", "US01"), ("B", "DE01"), (None, "CH01")]


def history(seed, n=140, short=False):
    """Bookings of 2019 to 2023 with tied timestamps; enough pieces for every sale unless ``short``."""
    rnd = random.Random(seed)
    rows, held = [], dict.fromkeys(KEYS, 0)
    for k in range(n):
        key = rnd.choice(KEYS)
        year = 2019 + k * 5 // n
        ts = f"{year}-{1 + (k * 60 // n) % 12:02d}-{rnd.randint(1, 2):02d} 10:00:00"
        rows.append([ts, key, k])
    rows.sort(key=lambda r: (r[0], r[2]))
    out = []
    for ts, (account, isin), k in rows:
        key = (account, isin)
        sale = rnd.random() < 0.45 and (held[key] > 0 or short)
        quantity = rnd.randint(1, max(1, held[key] + (1 if short else 0))) if sale else rnd.randint(1, 12)
        held[key] += -quantity if sale else quantity
        net = round(rnd.uniform(10, 999), 2) * (1 if sale else -1)
        out.append((account, ts, "Verkauf" if sale else "Kauf", isin, "N", "EUR", Decimal(quantity), net, f"{k:05d}"))
    return out


def ledger_of(spark, rows):
    text = [(a, t, ty, i, n, c, q, x, o) for a, t, ty, i, n, c, q, x, o in rows]
    df = spark.createDataFrame(text, SCHEMA.replace("timestamp_ntz", "string"))
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def result(spark, rows, cfg, lots=None):
    return calculate(spark, ledger_of(spark, rows), None, None, cfg, lots=lots)


def plain_lots(rows, cost_mode):
    """A row loop over the bookings, buys first within a timestamp."""
    held = {}
    for a, ts, ty, i, *_, q, net, o in sorted(rows, key=lambda r: (r[1], r[2] != "Kauf", r[8])):
        lots = held.setdefault((a, i), deque())
        if ty == "Kauf":
            lots.append([o, q, q, -net])
            continue
        while q:
            used = min(q, lots[0][2])
            lots[0][2] -= used
            q -= used
            if not lots[0][2]:
                lots.popleft()
    out = {}
    for key, lots in held.items():
        for o, bought, left, cost in lots:
            out[(*key, o)] = (left, cost * float(left) / float(bought) if cost_mode == "pro_rata" else cost)
    return out


CHUNKED = {"fifo_hot_key_rows": 20, "fifo_chunk_rows": 9}


@pytest.mark.parametrize("cost_mode, knobs", [("pro_rata", CHUNKED), ("as_observed", {})], ids=["chunked", "one task a key"])
def test_open_lots_against_a_row_loop(spark, cost_mode, knobs):
    rows = history(1)
    lots = result(spark, rows, OFFLINE.with_(cost_mode=cost_mode, **knobs)).open_lots.collect()
    got = {(r["account_id"], r["isin"], r["order_no"]): (r["remaining"], r["open_cost_eur"]) for r in lots}
    want = plain_lots(rows, cost_mode)
    assert set(got) == set(want) and len(lots) == len(got)
    for key, (left, cost) in want.items():
        assert got[key][0] == left and got[key][1] == pytest.approx(cost, rel=1e-12)
    partly = [r for r in lots if r["remaining"] != r["lot_qty"]]
    assert partly  # a lot that is used in part is there


def sales_of(df, since=None):
    columns = ("account_id", "isin", "ts", "quantity", "proceeds_eur", "cost_eur", "result_eur", "shortfall", "invalid", "order_no")
    rows = (df if since is None else df.where(F.col("tax_year") >= since)).select(*columns).collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(
    "cost_mode, short, knobs",
    [("pro_rata", False, CHUNKED), ("as_observed", False, {}), ("pro_rata", True, {})],
    ids=["chunked", "as observed", "short"],
)
def test_year_by_year_equals_one_run(spark, cost_mode, short, knobs):
    """To the last digit. A key that is short stays flagged from then on."""
    cfg = OFFLINE.with_(cost_mode=cost_mode, **knobs)
    rows = history(7, short=short)
    whole = result(spark, rows, cfg).sales_all_years
    lots, last = None, None
    for years in ((2019, 2020), (2021,), (2022, 2023)):
        part = [r for r in rows if int(r[1][:4]) in years]
        last = result(spark, part, cfg, lots)
        lots = spark.createDataFrame(last.open_lots.collect(), last.open_lots.schema)  # stored, read back
    assert sales_of(last.sales_all_years) == sales_of(whole, since=2022)
    once = result(spark, rows, cfg).open_lots
    columns = ("account_id", "isin", "order_no", "lot_qty", "remaining", "open_cost_eur", "shortfall", "invalid")
    as_rows = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    if not short:
        assert as_rows(lots) == as_rows(once)


def test_invalid_keys_stay_invalid(spark):
    bad = ("A", "2020-01-01 00:00:00", "Kauf", "DE01", "N", "EUR", None, -5.0, "1")
    good = ("A", "2020-01-02 00:00:00", "Kauf", "DE01", "N", "EUR", Decimal(5), -5.0, "2")
    sale = ("A", "2021-01-01 00:00:00", "Verkauf", "DE01", "N", "EUR", Decimal(1), 9.0, "3")
    first = result(spark, [bad, good], OFFLINE).open_lots
    assert {(r["remaining"], r["invalid"]) for r in first.collect()} == {(None, True)}
    sold = result(spark, [sale], OFFLINE, first).sales_all_years.collect()
    assert [(r["cost_eur"], r["invalid"]) for r in sold] == [(None, True)]


def test_open_lots_take_one_exchange(spark):
    df = ledger_of(spark, history(2, n=20)).withColumn("net_eur", F.col("net")).withColumn("tax_year", F.year("ts"))
    plan = fifo.open_lots(df, OFFLINE.with_(tiebreak=("order_no",), fifo_hot_key_rows=None))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lots_without_the_order_columns_are_refused(spark):
    lots = result(spark, history(3, n=10), OFFLINE).open_lots.drop("order_no")
    with pytest.raises(ValueError, match="tiebreak columns"):
        result(spark, history(3, n=10), OFFLINE, lots).sales_all_years
