"""Skew check: a third of the derived ledger in ONE (account, isin) key.

Rows of the derived ledger with ``l_partkey % 3 == 0`` are moved into a
single key (account 0, one ISIN) that gets a large opening buy, so the key
has no shortfall. FIFO runs once with hot-key chunking off (the whole key in
one task) and once with it on, and every sale's cost must agree.

    python tools/skew_check.py [sf_dir] [hot_threshold] [chunk_rows]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from kapspark.operators import fifo  # noqa: E402
from kapspark.operators.fx import fx_convert  # noqa: E402
from kapspark.plans.catalog import demo_dims  # noqa: E402
from kapspark.session import local_session  # noqa: E402
from kapspark.sources.demo import DEMO_CONFIG, demo_ledger  # noqa: E402
from kapspark.sources.dims import yearly_rates  # noqa: E402


def skewed_ledger(spark, sf_dir):
    led = demo_ledger(spark, sf_dir)
    hot = (F.col("sec_no") % 3 == 0) & F.col("type").isin("Kauf", "Verkauf") & (F.col("order_key") >= 0)
    moved = led.withColumn("account_id", F.when(hot, F.lit(0).cast("bigint")).otherwise(F.col("account_id"))).withColumn(
        "isin", F.when(hot, F.lit("DE0000000000")).otherwise(F.col("isin"))
    )
    opening = spark.range(1).select(
        F.lit(0).cast("bigint").alias("account_id"),
        F.to_timestamp_ntz(F.lit("2018-12-30 00:00:00")).alias("ts"),
        F.lit("Kauf").alias("type"),
        F.lit("DE0000000000").alias("isin"),
        F.lit("Hot").alias("name"),
        F.lit("EUR").alias("currency"),
        F.lit(10**9).cast("decimal(20,8)").alias("quantity"),
        F.lit(-1.0e9).alias("net"),
        F.lit(0.0).alias("tax"),
        F.lit(0).alias("sec_no"),
        F.lit(0).alias("code"),
        F.lit(-2).cast("bigint").alias("order_key"),
        F.lit(0).alias("line_no"),
        F.lit(0).cast("bigint").alias("supp_key"),
    )
    return moved.unionByName(opening)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    hot_rows = int(sys.argv[2]) if len(sys.argv) > 2 else 2_000
    chunk_rows = int(sys.argv[3]) if len(sys.argv) > 3 else 1_000
    spark = local_session()
    led = skewed_ledger(spark, sf_dir)
    led_fx = fx_convert(led, demo_dims(spark)[0], yearly_rates(spark), DEMO_CONFIG)
    n_hot = led.where((F.col("account_id") == 0) & (F.col("isin") == "DE0000000000")).count()
    print(f"hot key rows: {n_hot} of {led.count()}", flush=True)
    out = {}
    for label, cfg in (
        ("simple", DEMO_CONFIG.with_(fifo_hot_key_rows=None)),
        ("chunked", DEMO_CONFIG.with_(fifo_hot_key_rows=hot_rows, fifo_chunk_rows=chunk_rows)),
    ):
        t0 = time.time()
        sales = fifo.realized_sales(led_fx, cfg, ledger=led).select(
            "account_id", "isin", "order_key", "line_no", "supp_key",
            F.round(F.col("cost_eur").cast("decimal(28,10)"), 4).alias("cost"), "shortfall",
        )
        out[label] = {tuple(r) for r in sales.collect()}
        print(f"{label}: {len(out[label])} sales in {time.time() - t0:.1f}s", flush=True)
    hot_sales = [r for r in out["chunked"] if r[0] == 0 and r[1] == "DE0000000000"]
    print("identical:", out["simple"] == out["chunked"], "| hot-key sales:", len(hot_sales),
          "| hot key flagged:", any(r[6] for r in hot_sales))
    spark.stop()


if __name__ == "__main__":
    main()
