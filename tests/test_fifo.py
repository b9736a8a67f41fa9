"""FIFO against a sequential oracle, both cost modes, simple and chunked paths."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kapspark.config import TaxConfig
from kapspark.operators import fifo

CFG = TaxConfig(on_issue="flag", tiebreak=("seq",))
SCHEMA = "account_id bigint, isin string, ts timestamp_ntz, tax_year int, type string, quantity decimal(20,8), net_eur double, seq bigint"


def sequential(rows, cost_mode):
    """Textbook FIFO with a lot deque per key (the behaviour to reproduce)."""
    out, lots, short = {}, {}, set()
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], 0 if r[4] == "Kauf" else 1, r[7])):
        key, qty, eur = (r[0], r[1]), Decimal(r[5]), r[6]
        q = lots.setdefault(key, [])
        if r[4] == "Kauf":
            q.append([qty, -eur, qty])
            continue
        need, cost = qty, 0.0
        while need > 0 and q:
            lot = q[0]
            take = min(need, lot[0])
            base = lot[2] if cost_mode == "pro_rata" else lot[0]
            cost += lot[1] * float(take) / float(base)
            lot[0] -= take
            need -= take
            if lot[0] == 0:
                q.pop(0)
        if need > 0:
            short.add(key)
        out[(key, r[7])] = cost
    return {k: (None if k[0] in short else v) for k, v in out.items()}


def random_ledger(seed, keys=6, n=60):
    rnd = random.Random(seed)
    rows, seq = [], 0
    import datetime as dt

    for k in range(keys):
        acct, isin = k // 2, f"XX{k:010d}"
        held = Decimal(0)
        for i in range(n):
            seq += 1
            ts = dt.datetime(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 2000))
            ts = ts.replace(hour=0) if rnd.random() < 0.3 else ts
            buy = held <= 0 or rnd.random() < 0.55
            qty = Decimal(rnd.choice([1, 2, 3, 5, 7, 10])) / (Decimal(4) if rnd.random() < 0.2 else 1)
            eur = round(rnd.uniform(10, 500) * float(qty), 2)
            rows.append((acct, isin, ts, ts.year, "Kauf" if buy else "Verkauf", qty, -eur if buy else eur, seq))
            held += qty if buy else -qty
    return rows


def run_fifo(spark, rows, cfg):
    df = spark.createDataFrame(rows, SCHEMA)
    out = fifo.realized_sales(df, cfg).collect()
    return {((r["account_id"], r["isin"]), r["seq"]): r["cost_eur"] for r in out}


@pytest.mark.parametrize("mode", ["pro_rata", "as_observed"])
@pytest.mark.parametrize("hot", [None, 5])
def test_against_sequential_oracle(spark, mode, hot):
    rows = random_ledger(7)
    cfg = CFG.with_(cost_mode=mode, fifo_hot_key_rows=hot, fifo_chunk_rows=7)
    got = run_fifo(spark, rows, cfg)
    want = sequential(rows, mode)
    assert set(got) == set(want)
    for k, v in want.items():
        if v is None:
            assert got[k] is None, k
        else:
            assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-6), k


def test_partly_used_lot_cost_modes(spark):
    import datetime as dt

    d = dt.datetime(2025, 1, 1)
    rows = [
        (1, "DE0000000001", d, 2025, "Kauf", Decimal(2), -200.0, 1),
        (1, "DE0000000001", d.replace(month=2), 2025, "Verkauf", Decimal(1), 150.0, 2),
        (1, "DE0000000001", d.replace(month=3), 2025, "Verkauf", Decimal(1), 150.0, 3),
    ]
    pro = run_fifo(spark, rows, CFG)
    obs = run_fifo(spark, rows, CFG.with_(cost_mode="as_observed"))
    key = (1, "DE0000000001")
    assert (pro[(key, 2)], pro[(key, 3)]) == (100.0, 100.0)
    assert (obs[(key, 2)], obs[(key, 3)]) == (100.0, 200.0)


def test_shortfall_flags_the_key(spark):
    import datetime as dt

    d = dt.datetime(2025, 1, 1)
    rows = [
        (1, "A", d, 2025, "Verkauf", Decimal(1), 10.0, 1),
        (1, "A", d.replace(month=2), 2025, "Kauf", Decimal(1), -5.0, 2),
        (1, "B", d, 2025, "Kauf", Decimal(1), -5.0, 3),
        (1, "B", d.replace(month=2), 2025, "Verkauf", Decimal(1), 10.0, 4),
    ]
    out = {r["isin"]: r for r in fifo.realized_sales(spark.createDataFrame(rows, SCHEMA), CFG).collect()}
    assert out["A"]["shortfall"] and out["A"]["cost_eur"] is None and float(out["A"]["missing_qty"]) == 1.0
    assert not out["B"]["shortfall"] and out["B"]["result_eur"] == 5.0


def test_row_order_and_partitioning_do_not_matter(spark):
    rows = random_ledger(11, keys=4, n=40)
    a = run_fifo(spark, rows, CFG)
    df = spark.createDataFrame(list(reversed(rows)), SCHEMA).repartition(7, F.rand(3))
    b = {((r["account_id"], r["isin"]), r["seq"]): r["cost_eur"] for r in fifo.realized_sales(df, CFG).collect()}
    assert a == b


def test_simple_plan_has_one_exchange(spark):
    df = spark.createDataFrame(random_ledger(3, keys=2, n=10), SCHEMA)
    plan = fifo.match_simple(fifo.trades_of(df, CFG), CFG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_positions_agree_between_simple_and_chunked(spark):
    rows = random_ledger(5, keys=3, n=50)
    df = spark.createDataFrame(rows, SCHEMA)
    cols = ["account_id", "isin", "seq", "cum_buy", "cum_sell", "short_row", "missing_qty", "key_short"]
    a = {tuple(r) for r in fifo.trade_positions(df, CFG.with_(fifo_hot_key_rows=None)).select(*cols).collect()}
    b = {tuple(r) for r in fifo.trade_positions(df, CFG.with_(fifo_hot_key_rows=5, fifo_chunk_rows=6)).select(*cols).collect()}
    assert a == b and len(a) == 150


def test_skewed_key_from_the_driver_tables(spark):
    """A third of the derived ledger's trades in one key: chunked == simple."""
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
    from skew_check import skewed_ledger

    from kapspark.operators.fx import fx_convert
    from kapspark.plans.catalog import demo_dims
    from kapspark.sources.demo import DEMO_CONFIG
    from kapspark.sources.dims import yearly_rates

    led = skewed_ledger(spark, "/root/testdata/sf0.001")
    led_fx = fx_convert(led, demo_dims(spark)[0], yearly_rates(spark), DEMO_CONFIG)
    cols = ["account_id", "isin", "order_key", "line_no", "supp_key", "cost_eur", "shortfall"]

    def run(cfg):
        return {
            tuple(r)
            for r in fifo.realized_sales(led_fx, cfg, ledger=led)
            .withColumn("cost_eur", F.round(F.col("cost_eur").cast("decimal(28,10)"), 4))
            .select(*cols)
            .collect()
        }

    simple = run(DEMO_CONFIG.with_(fifo_hot_key_rows=None))
    chunked = run(DEMO_CONFIG.with_(fifo_hot_key_rows=200, fifo_chunk_rows=100))
    assert simple == chunked
    assert sum(1 for r in chunked if r[1] == "DE0000000000") > 300


DAY_ORDERS = "account_id bigint, isin string, ts timestamp_ntz, tax_year int, type string, quantity decimal(20,8), net_eur double, order_no string"


def _chunk_sizes(spark, rows, cfg):
    df, cfg = fifo.with_total_order(spark.createDataFrame(rows, SCHEMA), cfg)
    trades = fifo.trades_of(df, cfg)
    time_chunks = fifo._chunked(trades, fifo._order(cfg), len(rows), cfg, "tchunk")
    pos = fifo.positions_chunked(trades, len(rows), cfg)
    pos = pos.withColumn("p", F.when(F.col("side") == 0, F.col("cum_buy")).otherwise(F.col("cum_sell")))
    places = fifo._chunked(pos, [F.col("p"), F.col("side").desc()], len(rows), cfg, "pchunk")
    return [[r["count"] for r in t.groupBy(c).count().collect()] for t, c in ((time_chunks, "tchunk"), (places, "pchunk"))]


@pytest.mark.parametrize("case", ["large lot", "two timestamps"])
def test_chunks_of_a_hot_key_stay_small(spark, case):
    import datetime as dt

    rnd = random.Random(5)
    start = dt.datetime(2020, 1, 1)
    rows = [(1, "X", start, 2020, "Kauf", Decimal(10**9 if case == "large lot" else 50_000), -1e9, 0)]
    for i in range(1, 4001):
        ts = start + (dt.timedelta(hours=i) if case == "large lot" else dt.timedelta(days=i % 2))
        buy = rnd.random() < 0.4
        rows.append((1, "X", ts, 2020, "Kauf" if buy else "Verkauf", Decimal(rnd.randint(1, 9)), -5.0 if buy else 5.0, i))
    cfg = CFG.with_(fifo_hot_key_rows=100, fifo_chunk_rows=500)
    for sizes in _chunk_sizes(spark, rows, cfg):
        assert sum(sizes) == 4001 and max(sizes) <= 1500 and len(sizes) >= 6, sizes
    simple = run_fifo(spark, rows, cfg.with_(fifo_hot_key_rows=None))
    assert run_fifo(spark, rows, cfg) == pytest.approx(simple, rel=1e-9)


def test_tied_buys_cost_the_same_in_any_input_order(spark):
    import datetime as dt

    d = dt.datetime(2025, 1, 1)
    rows = [
        (1, "A", d, 2025, "Kauf", Decimal(1), -10.0, None),
        (1, "A", d, 2025, "Kauf", Decimal(1), -30.0, None),
        (1, "A", d.replace(month=2), 2025, "Verkauf", Decimal(1), 50.0, None),
    ]
    default = TaxConfig(on_issue="flag")

    def cost(order, parts, cfg=default):
        df = spark.createDataFrame(order, DAY_ORDERS).repartition(parts)
        return [r["cost_eur"] for r in fifo.realized_sales(df, cfg).collect()]

    costs = {cost(o, p)[0] for o in (rows, rows[::-1], [rows[1], rows[0], rows[2]]) for p in (1, 3)}
    assert len(costs) == 1
    # an order number decides before anything else
    named = [(*r[:-1], n) for r, n in zip(rows, ("2", "1", "3"))]
    assert cost(named, 2) == [30.0]
    with pytest.raises(ValueError, match="absent_column"):
        cost(rows, 1, TaxConfig(on_issue="flag", tiebreak=("absent_column",)))


def test_trades_without_key_or_quantity_are_flagged_and_kept(spark):
    import datetime as dt

    d = dt.datetime(2025, 1, 1)
    rows = [
        (1, None, d, 2025, "Verkauf", Decimal(1), 5.0, 1),
        (1, "B", d, 2025, "Kauf", Decimal(3), -9.0, 2),
        (1, "B", d, 2025, "Verkauf", None, 5.0, 3),
        (1, "B", d, 2025, "Verkauf", None, 5.0, 4),
        (None, "C", d, 2025, "Verkauf", Decimal(-1), 5.0, 5),
    ]
    for hot in (None, 0):
        got = fifo.realized_sales(
            spark.createDataFrame(rows, SCHEMA), CFG.with_(fifo_hot_key_rows=hot, fifo_chunk_rows=2)
        ).collect()
        assert sorted(r["seq"] for r in got) == [1, 3, 4, 5]
        assert all(r["invalid"] and r["cost_eur"] is None for r in got)
