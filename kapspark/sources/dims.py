"""Small dimension tables built from the fixed values (all bounded in size)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kapspark import constants as K


def local_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A small table as a local relation: Spark knows its size and broadcasts
    it by its own rules (a frame from a Python list has no known size)."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [[] for _ in arrow]
    return spark.createDataFrame(
        pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema
    )


def yearly_rates(spark: SparkSession) -> DataFrame:
    """(year, currency, rate): the yearly fallback, 6 years x 3 currencies."""
    rows = [
        (year, currency, float(rate))
        for year, by_currency in sorted(K.YEARLY_FALLBACK_RATES.items())
        for currency, rate in by_currency.items()
    ]
    return local_table(spark, rows, "year int, currency string, rate double")


def fund_exemptions(spark: SparkSession) -> DataFrame:
    rows = [(k, float(v), K.FUND_TYPE_LABELS[k]) for k, v in K.FUND_EXEMPTION_RATES.items()]
    return local_table(spark, rows, "fund_type string, exemption_rate double, fund_label string")
