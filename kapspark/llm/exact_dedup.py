"""Exact deduplication by a two-pass Bloom filter.

Texts are equal when they are identical after lower-casing A-Z only; null counts
as the empty text. Pass one sets, for each row, the bits of its SHA-256 in a
filter that tells bits set once from bits set more often. Every task sends its
bits as sorted offsets per segment, and a segment's offsets are merged in one
small group. Pass two tests each row: a row with a bit that only it has set is
certainly unique and passes straight through. The others, the possibly repeated
rows, are written to the shared folder; only they are grouped and joined, by the
full SHA-256, so a false positive costs a shuffled row and never a wrong result.

The filter that is broadcast has at most ``max_filter_bits`` bits (32 MB by
default). Beyond its capacity more rows count as possibly repeated; the result
stays the same. A group of copies of any size is counted with map-side partial
sums and joined through a skew join that Spark splits.

Defined cases: null or empty texts are one group; of rows that repeat doc_id and
text one row stays (all count in ``group_size``); a null doc_id sorts below all
others; an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import MAX_FILTER_BITS, filter_bits
from .shared import staged

PROBES = 4
SEGMENT_BITS = 1 << 16
RESULT_COLUMNS = ("keep_id", "group_size", "kept", "text_sha256")


def digests(texts: pa.Array, fold_case: bool = True) -> list[bytes]:
    """SHA-256 of each text, if wanted after lower-casing A-Z (bytes.lower() does just that)."""
    raw = texts.cast(pa.large_binary()).to_pylist()
    if fold_case:
        return [hashlib.sha256((b or b"").lower()).digest() for b in raw]
    return [hashlib.sha256(b or b"").digest() for b in raw]


def probe_bits(hashes: Sequence[bytes], bits: int) -> np.ndarray:
    """Positions (rows x PROBES) in a filter of `bits` bits, a power of two."""
    words = np.frombuffer(b"".join(h[:16] for h in hashes), dtype="<u8").reshape(-1, 2)
    step = words[:, 1:] | np.uint64(1)
    return (words[:, :1] + step * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def _bit_segments(bits: int, fold_case: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # a row's own equal positions count once
            own = np.sort(probe_bits(digests(batch.column(0), fold_case), bits), axis=1)
            fresh = np.ones(own.shape, dtype=bool)
            fresh[:, 1:] = own[:, 1:] != own[:, :-1]
            spots, counts = np.unique(own[fresh], return_counts=True)
            segments = (spots // SEGMENT_BITS).astype(np.int64)
            offsets = (spots % SEGMENT_BITS).astype("<u2")
            edges = np.flatnonzero(np.diff(segments)) + 1
            starts = np.concatenate([[0], edges])
            ends = np.concatenate([edges, [len(segments)]])
            once, more = [], []
            for a, b in zip(starts, ends):
                repeated = counts[a:b] > 1
                once.append(offsets[a:b].tobytes())
                more.append(offsets[a:b][repeated].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(segments[starts]), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
                names=["segment", "seen", "repeated"],
            )

    return run


def _merge_segment(pdf):
    import pandas as pd

    seen = np.frombuffer(b"".join(pdf["seen"]), dtype="<u2")
    times = np.bincount(seen, minlength=SEGMENT_BITS)
    times[np.frombuffer(b"".join(pdf["repeated"]), dtype="<u2")] += 1
    packed = np.packbits(times > 1, bitorder="little").tobytes()
    return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "repeated": [packed]})


def repeated_bits(df: DataFrame, text_col: str, bits: int, fold_case: bool = True) -> np.ndarray:
    """Pass one: the packed filter of bits that at least two rows set (bits / 8 bytes)."""
    parts = (
        df.select(text_col)
        .mapInArrow(_bit_segments(bits, fold_case), "segment long, seen binary, repeated binary")
        .groupBy("segment")
        .applyInPandas(_merge_segment, "segment long, repeated binary")
    )
    packed = np.zeros(bits // 8, dtype=np.uint8)
    size = SEGMENT_BITS // 8
    for row in parts.toLocalIterator():
        packed[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.repeated, dtype=np.uint8)
    return packed


def _flag_rows(keep: Sequence[str], text_col: str, bits: int, packed, fold_case: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = packed.value
        base = TaskContext.get().partitionId() << 33
        done = 0
        for batch in batches:
            n = batch.num_rows
            hashes = digests(batch.column(text_col), fold_case)
            spots = probe_bits(hashes, bits) if n else np.zeros((0, PROBES), dtype=np.uint64)
            hit = (filled[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    pa.array([h.hex() for h in hashes], pa.string()),
                    pa.array(np.arange(base + done, base + done + n)),
                    pa.array(hit.all(axis=1)),
                ],
                names=[*keep, "__sha", "__row", "__maybe"],
            )
            done += n

    return run


def flag_repeated(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str],
    fold_case: bool = True,
    max_filter_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """`keep` columns, __sha (hex), __row (a number of its own) and __maybe (false: certainly unique)."""
    bits = filter_bits(df.count(), max_filter_bits)
    packed = df.sparkSession.sparkContext.broadcast(repeated_bits(df, text_col, bits, fold_case))
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [
            T.StructField("__sha", T.StringType()),
            T.StructField("__row", T.LongType()),
            T.StructField("__maybe", T.BooleanType()),
        ]
    )
    source = df.select(*dict.fromkeys([*keep, text_col]))  # a text that is kept is sent once
    return source.mapInArrow(_flag_rows(keep, text_col, bits, packed, fold_case), schema)


def deduplicate(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_cols: Sequence[str] | None = None,
    max_filter_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """Every row of `df` with `keep_cols` (default: all) and its group's verdict.

    Adds keep_id (the largest id of the group), group_size, kept and text_sha256;
    columns of `df` with these names are left out.
    """
    keep = [c for c in (df.columns if keep_cols is None else keep_cols) if c not in RESULT_COLUMNS]
    if id_col not in keep:
        keep = [id_col, *keep]
    flagged = flag_repeated(df, text_col, keep, True, max_filter_bits)
    alone = flagged.filter(~F.col("__maybe")).select(
        *keep,
        F.col(id_col).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )
    maybe = staged(flagged.filter("__maybe").drop("__maybe"), "exact-candidates")
    # stored, so that both sides of the join are plain exchanges and Spark can split a hot group
    groups = staged(
        maybe.groupBy("__sha").agg(
            F.max(F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row"))).alias("__best"),
            F.count(F.lit(1)).alias("__n"),
        ),
        "exact-groups",
    )
    settled = maybe.join(groups.hint("shuffle_merge"), "__sha").select(
        *keep,
        F.col("__best.id").alias("keep_id"),
        F.col("__n").alias("group_size"),
        (F.col("__row") == F.col("__best.row")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )
    return alone.unionByName(settled)
