"""Benchmark the headline queries on the derived ledger.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is planned and fully executed into Spark's ``noop`` sink (no
collect to the driver) on its own work: nothing is kept between queries. The
time includes planning. An untimed warm-up pass of the same queries on a
smaller scale factor (sf0.01, else sf0.001) comes first, so the numbers are
steady-state throughput rather than JIT compilation of freshly generated code.
Prints one JSON line; ``detail`` has exchanges, MB shuffled and MB spilled.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kapspark.plans.catalog import QUERIES  # noqa: E402
from kapspark.session import local_session  # noqa: E402

HEADLINE = (
    "form_lines",
    "fifo_realized",
    "tax_summary",
    "fx_convert",
    "classify_embedded",
    "report_positions",
    "detail_export",
)
# Untimed warm-up data: a smaller scale factor than the measured one.
WARMUP_DIRS = ("/root/testdata/sf0.01", "/root/testdata/sf0.001")


def _sf_of(path: str) -> str:
    name = Path(path).name
    return name[2:] if name.startswith("sf") else name


def _execute(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def _moved(log_dir: str, spans: dict[str, tuple[float, float]]) -> dict[str, dict[str, float]]:
    """MB shuffled and spilled per query, from the event log's task metrics."""
    out = {name: {"shuffle_mb": 0.0, "spill_mb": 0.0} for name in spans}
    for path in Path(log_dir).rglob("*"):
        for line in path.open() if path.is_file() else ():
            if '"SparkListenerTaskEnd"' not in line:
                continue
            event = json.loads(line)
            at = event["Task Info"]["Launch Time"] / 1000
            metrics = event.get("Task Metrics") or {}
            for name, (began, ended) in spans.items():
                if began <= at <= ended:
                    written = metrics.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                    out[name]["shuffle_mb"] += written / 1e6
                    out[name]["spill_mb"] += metrics.get("Disk Bytes Spilled", 0) / 1e6
    return {name: {k: round(v, 2) for k, v in figures.items()} for name, figures in out.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus if cpus.isdigit() else "8"))
    log_dir = tempfile.mkdtemp(prefix="kapspark-bench-")
    spark = local_session(cores=cpus, shuffle_partitions=parts, event_log=log_dir)
    warm = next((d for d in WARMUP_DIRS if Path(d).exists() and Path(d).resolve() != Path(sf_dir).resolve()), None)
    if warm:  # JIT warm-up of the generated code, untimed
        for name in HEADLINE:
            _execute(QUERIES[name](spark, warm))
    times: dict[str, float] = {}
    spans: dict[str, tuple[float, float]] = {}
    detail: dict[str, dict[str, float]] = {}
    for name in HEADLINE:
        began, t0 = time.time(), time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        _execute(df)
        times[name] = round(time.perf_counter() - t0, 3)
        spans[name] = (began, time.time())
        detail[name] = {"exchanges": _exchanges(df)}
    spark.stop()
    for name, moved in _moved(log_dir, spans).items():
        detail[name] |= moved
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": _sf_of(sf_dir),
                "cpus": cpus,
                "detail": detail,
            }
        )
    )


if __name__ == "__main__":
    main()
