"""Sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts form one atomic group that never leaves its shard. Groups are put in
one global order, the smallest feasible shard capacity is found by binary search
with a greedy check (fill a shard until the next group does not fit, then open
another), and the order is cut there. So no other contiguous partition of that
order has a smaller largest shard. Sizes are near equal (law ``bytes``).

A group larger than an even share fixes the capacity on its own, and a greedy fill
up to it would leave shards empty. Such groups (fewer than the number of shards)
come first in the order and take a shard each; the search then runs over the rest
with the shards left, again until no group exceeds the even share of what is left.

Scale: the order is a hash order (SHA-256 of the text), cut into a fixed number of
ranges. Running sums are windows inside a range plus the bounded list of range
totals, so nothing passes through one task. The rows of one group are numbered in
pieces by a hash of the id; a group with a third of all rows is spread over
``PIECES`` of them. The driver's search sees a bounded summary: the first and last
group border in each of ``CELLS`` equal cells of the byte axis. A cell's unknown
inside gives an optimistic and a pessimistic greedy fill, hence bounds on the
capacity and on every cut; the cells are laid anew over those ranges alone until
few enough borders are left to list them all, and the answer is exact.

Only DataFrame functions run on the executors.

Defined cases: null text has size 16 and equals the empty text; null ids and
repeated rows are rows like any others; an empty table gives an empty result; with
fewer groups than shards the last shards stay empty.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged, utf8_bytes

ROW_OVERHEAD = 16
RANGES = 4096  # three hexadecimal digits of the key
PIECES = 256
CELLS = 20_000
EXACT_BORDERS = 50_000


def _greedy(start: int, end: int, capacity: int, shards: int, floor) -> list[int] | None:
    """Cuts of a greedy fill, or None if `shards` shards do not reach `end`.

    floor(x): the last border at or below x, as far as it is known.
    """
    cuts, at = [], start
    for _ in range(shards):
        if at + capacity >= end:
            return cuts
        reached = floor(at + capacity)
        if reached <= at:
            return None
        cuts.append(reached)
        at = reached
    return None


def _smallest(low: int, high: int, feasible) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def _bounded(exact: list[int], cells: dict[tuple[int, int], tuple[int, int]], spans: list[tuple[int, int, int]]):
    """(pessimistic, optimistic) floor functions from what is known about borders."""
    starts = [a for a, _, _ in spans]

    def locate(x: int) -> tuple[int, int, int] | None:
        k = bisect.bisect_right(starts, x) - 1
        return spans[k] if k >= 0 and x < spans[k][1] else None

    def known(x: int) -> int:
        k = bisect.bisect_right(exact, x) - 1
        return exact[k] if k >= 0 else -1

    def pessimistic(x: int) -> int:
        return known(x)

    def optimistic(x: int) -> int:
        span = locate(x)
        if span is None:
            return known(x)
        found = cells.get((span[0], (x - span[0]) // span[2]))
        if found is None or x < found[0]:  # the cell has no border at or below x
            return known(x)
        return min(x, found[1])

    return pessimistic, optimistic


def _search(borders: DataFrame, start: int, end: int, largest: int, shards: int, cells: int, listed: int) -> list[int]:
    """Smallest capacity's greedy cuts over the sorted `border` column within (start, end]."""
    low = max(largest, -(-(end - start) // shards))
    high = low + largest
    spans = [(start, end + 1, max(1, -(-(end + 1 - start) // cells)))]
    while True:
        which = None
        inside = None
        for a, b, _ in spans:
            hit = (F.col("border") >= a) & (F.col("border") < b)
            inside = hit if inside is None else inside | hit
        for a, b, width in spans:
            name = F.struct(F.lit(a).alias("a"), F.floor((F.col("border") - a) / width).cast("long").alias("c"))
            which = F.when((F.col("border") >= a) & (F.col("border") < b), name) if which is None else which.when(
                (F.col("border") >= a) & (F.col("border") < b), name
            )
        rows = (
            borders.filter(inside)
            .groupBy(which.alias("w"))
            .agg(F.min("border").alias("low"), F.max("border").alias("high"), F.count(F.lit(1)).alias("n"))
            .collect()  # at most `cells` rows (a few per span more)
        )
        count = sum(r.n for r in rows)
        if count <= listed:
            exact = sorted({r.border for r in borders.filter(inside).select("border").collect()} | {start, end})
            floor = lambda x: exact[bisect.bisect_right(exact, x) - 1]
            best = _smallest(low, high, lambda c: _greedy(start, end, c, shards, floor) is not None)
            return _greedy(start, end, best, shards, floor)
        known = sorted({r.low for r in rows} | {r.high for r in rows} | {start, end})
        found = {(r.w.a, r.w.c): (r.low, r.high) for r in rows}
        pessimistic, optimistic = _bounded(known, found, spans)
        new_high = _smallest(low, high, lambda c: _greedy(start, end, c, shards, pessimistic) is not None)
        new_low = _smallest(low, new_high, lambda c: _greedy(start, end, c, shards, optimistic) is not None)
        low, high = new_low, new_high
        # the k-th cut of the answer lies between these two fills
        firsts = _fill(start, end, low, shards, pessimistic)
        lasts = _fill(start, end, high, shards, optimistic)
        ranges = sorted((a, b + 1) for a, b in zip(firsts, lasts) if a <= b)
        merged: list[list[int]] = []
        for a, b in ranges:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        each = max(1, cells // max(1, len(merged)))
        spans = [(a, b, max(1, -(-(b - a) // each))) for a, b in merged]


def _fill(start: int, end: int, capacity: int, shards: int, floor) -> list[int]:
    """The first shards-1 cut positions of a greedy fill, each at most `end`."""
    cuts, at = [], start
    for _ in range(shards - 1):
        at = end if at + capacity >= end else max(at, floor(at + capacity))
        cuts.append(at)
    return cuts


def _pieces(rows: DataFrame, pieces: int) -> DataFrame:
    """One row for each (group, piece) with its global order and running sums before it."""
    return (
        rows.groupBy("key", "piece")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        .withColumn("range", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    )


def shard(
    df: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    pieces: int = PIECES,
    cells: int = CELLS,
    listed: int = EXACT_BORDERS,
) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard for every row of `df`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(
        df.select(
            F.col(id_col).alias("id"),
            (utf8_bytes(text) + ROW_OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).alias("key"),
            F.pmod(F.xxhash64(F.col(id_col)), F.lit(pieces)).cast("int").alias("piece"),
        ),
        "shard-rows",
    )
    parts = staged(_pieces(rows, pieces), "shard-pieces")
    groups = parts.groupBy("range", "key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    large, rest_bytes, rest_shards = _large_groups(groups, shards)
    taken = len(large)
    is_large = F.col("key").isin([k for k, _ in large]) if large else F.lit(False)

    # running sums: inside a range by window, before it from the bounded table of range totals
    small = parts.filter(~is_large)
    ranges = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        small.groupBy("range")
        .agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        .select(
            "range",
            F.coalesce(F.sum("n").over(ranges), F.lit(0)).alias("rows_earlier"),
            F.coalesce(F.sum("bytes").over(ranges), F.lit(0)).alias("bytes_earlier"),
        )
    )
    earlier = Window.partitionBy("range").orderBy("key", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = staged(
        small.withColumn("rows_inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("bytes_inside", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)))
        .withColumn("border", F.min("bytes_inside").over(Window.partitionBy("range", "key")))
        .join(F.broadcast(offsets), "range")  # at most RANGES rows
        .select(
            "key",
            "piece",
            (F.col("rows_inside") + F.col("rows_earlier")).alias("rows_before"),
            (F.col("bytes_inside") + F.col("bytes_earlier")).alias("bytes_before"),
            (F.col("border") + F.col("bytes_earlier")).alias("border"),
        ),
        "shard-placed",
    )
    borders = placed.filter(F.col("border") == F.col("bytes_before")).select("border", "rows_before")
    cuts: list[int] = []
    if rest_bytes and rest_shards > 1:
        largest = groups.filter(~is_large).agg(F.max("bytes")).first()[0]
        cuts = _search(borders.select("border"), 0, rest_bytes, largest, rest_shards, cells, listed)
    at_cut = {r.border: r.rows_before for r in borders.filter(F.col("border").isin(cuts)).collect()} if cuts else {}
    first_rows = [0, *(at_cut[c] for c in cuts)]
    cut_array = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    shard_no = F.size(F.filter(cut_array, lambda c: c <= F.col("border")))
    spread = placed.withColumn("shard", shard_no).select(
        "key",
        "piece",
        (F.col("shard") + taken).cast("int").alias("shard"),
        (F.col("rows_before") - _lookup(first_rows, "shard")).alias("slots_before"),
    )
    if large:
        order = F.create_map(*[x for i, (k, _) in enumerate(large) for x in (F.lit(k), F.lit(i))])
        in_group = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        spread = spread.unionByName(
            parts.filter(is_large).select(
                "key",
                "piece",
                order[F.col("key")].cast("int").alias("shard"),
                F.coalesce(F.sum("n").over(in_group), F.lit(0)).alias("slots_before"),
            )
        )
    within = Window.partitionBy("key", "piece").orderBy("id")
    return (
        rows.withColumn("slot", F.row_number().over(within))
        .join(spread.hint("shuffle_merge"), ["key", "piece"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("slot") - 1 + F.col("slots_before")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _lookup(values: Sequence[int], column: str) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])[F.col(column)]


def _large_groups(groups: DataFrame, shards: int) -> tuple[list[tuple[str, int]], int, int]:
    """Groups beyond an even share, largest first; bytes and shards left for the others.

    At most `shards` groups can exceed an even share of the whole, and each one taken
    out lowers the share of the rest, so the largest `shards` groups are all it takes.
    """
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    top = groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()
    large: list[tuple[str, int]] = []
    for r in top:
        left = shards - len(large)
        if left <= 1 or r.bytes * left <= total:
            break
        large.append((r.key, r.bytes))
        total -= r.bytes
    return large, int(total), shards - len(large)
