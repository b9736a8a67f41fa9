"""Sinks: detail export and the per-year report tables, written by executors.

Everything is partitioned by ``tax_year``, so one folder holds every account's rows of a
year; nothing passes through the driver. A write replaces the years that it covers and
leaves all others in place. Rows are gathered by year first, and Spark splits a large
year by its size, so the number of files follows the data, not tasks times years.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kapspark import config as C
from kapspark import constants as K


def _flat(df: DataFrame) -> DataFrame:
    """Drop nested columns (the resolved rule struct) that CSV cannot hold."""
    keep = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def _write_by_year(
    df: DataFrame, path: str, fmt: str, mode: str, options: dict[str, object], years: Iterable[int] | None
) -> None:
    """Write ``df`` by tax year; ``overwrite`` replaces single years.

    ``years``: what the write covers beside the years of its rows. Such a year's old rows
    go away even where the new result has none for it.
    """
    rows = df.hint("rebalance", C.TAX_YEAR)
    if mode != "overwrite":
        rows.write.mode(mode).options(**options).partitionBy(C.TAX_YEAR).format(fmt).save(path)
        return
    if years:
        left = set(years) - {r[0] for r in df.select(C.TAX_YEAR).distinct().collect()}  # a few years
        none = df.where(F.lit(False)).drop(C.TAX_YEAR).coalesce(1)
        for year in sorted(left):
            none.write.mode("overwrite").options(**options).format(fmt).save(f"{path}/{C.TAX_YEAR}={year}")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options)
    writer.partitionBy(C.TAX_YEAR).format(fmt).save(path)


def write_details(
    details: DataFrame,
    path: str,
    fmt: str = "csv",
    sep: str = K.DEFAULT_SEPARATOR,
    mode: str = "overwrite",
    years: Iterable[int] | None = None,
) -> None:
    """Dividends, interest and sales with their ``category`` (the diagonal
    union of ``TaxResult.details()``); CSV uses the ledger's separator.

    ``overwrite`` replaces the years of the rows and of ``years``; other years stay."""
    options = {"sep": sep, "header": True} if fmt == "csv" else {}
    _write_by_year(_flat(details), path, fmt, mode, options, years)


def write_reports(result, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Form lines, credit by country, fund breakdown and report positions as
    one table each under ``path`` (partitioned by tax year), from one pass over
    the bookings (``TaxResult.reports``). ``overwrite`` replaces the years of
    the result; other years stay."""
    tables, years = result.reports()
    for name, df in tables.items():
        _write_by_year(df, f"{path}/{name}", fmt, mode, {}, years)
