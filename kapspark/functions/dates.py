"""Booking timestamps: zone-free parsing into TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ``dd-MM-yyyy HH:mm:ss``; one- or two-digit fields are accepted.
_TS_PATTERN = r"^\s*(\d{1,2})-(\d{1,2})-(\d{4}) (\d{1,2}):(\d{1,2}):(\d{1,2})\s*$"


def parse_ledger_ts(c: Column) -> Column:
    """Parse ``31-12-2025 15:57:09`` into TIMESTAMP_NTZ; invalid dates -> NULL.

    Built from the parts with ``try_make_timestamp_ntz`` so that neither the
    session time zone nor DST gaps can move a booking into another day or year.
    """
    s = c.cast("string")
    part = lambda i: F.regexp_extract(s, _TS_PATTERN, i).try_cast("int")
    return F.when(
        s.rlike(_TS_PATTERN),
        F.try_make_timestamp_ntz(part(3), part(2), part(1), part(4), part(5), part(6)),
    )
