"""Filters of a bounded size that are broadcast to keep rows out of a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ROW = 16
MIN_FILTER_BITS = 1 << 16
MAX_FILTER_BITS = 1 << 28  # 32 MB


def filter_bits(rows: int, limit: int = MAX_FILTER_BITS) -> int:
    """A power of two: about BITS_PER_ROW bits for each row, up to the limit."""
    wanted = max(MIN_FILTER_BITS, rows * BITS_PER_ROW)
    return min(limit, 1 << (wanted - 1).bit_length())


def membership(keys: DataFrame, *columns: str, limit: int = MAX_FILTER_BITS) -> Callable[..., Column]:
    """test(*columns): true wherever the values occur in `keys`, and rarely elsewhere.

    The filter has at most `limit` bits however many keys there are: with more keys
    more rows pass the test by chance, and none that should is lost. Null matches null.
    """
    bits = filter_bits(keys.count(), limit)

    def place(*values: str | Column) -> Column:
        return F.pmod(F.xxhash64(*values), F.lit(bits))

    own = place(*columns) + 1  # buckets and places count from 1
    chunks = keys.groupBy(F.bitmap_bucket_number(own).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("set")
    )
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for row in chunks.toLocalIterator():
        start = (row.b - 1) * len(row.set)
        packed[start : start + len(row.set)] = np.frombuffer(row.set, dtype=np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def is_set(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda *values: is_set(place(*values))
