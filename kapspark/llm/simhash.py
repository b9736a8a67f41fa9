"""Near duplicates by SimHash and covering locality-sensitive hashing.

Fingerprint: words are runs without white space of the text after lower-casing
A-Z; each run of `shingle` words (all of them in a shorter text), joined by one
space, is hashed by XXH64 (seed 42). Bit b is set when more than half of the
hashes, repeats included, have it. A text without words has fingerprint zero.

Links: two fingerprints within `radius` bits. Every bit position gets a vector
of radius+1 bits; each non-zero vector v gives a mask of the positions whose
vector has an odd product with v. At most `radius` differing positions span less
than the whole space, so some v is orthogonal to all of them: under that mask the
two fingerprints agree. So every pair within the radius shares a bucket in one of
2^(radius+1)-1 tables, and no pair is missed. Distinct fingerprints only enter the
tables, once each, however many documents share them.

A bucket that holds more than ``BUCKET_ROWS`` fingerprints is split again by the
same construction over the bits that its mask left free (about 32, then 16, then
8), so after at most three levels a bucket holds at most 2^8 fingerprints whatever
the data, and no pair within the radius is lost. Within a bucket the verified
links leave as a spanning forest, never as all pairs.

Defined cases: null text is the empty text; documents without words share
fingerprint zero and link like any others; a null id is never the smallest id of
a component that has another; repeated rows give repeated result rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import membership
from .components import components
from .shared import staged

BITS = 64
SHINGLE_WORDS = 4
RADIUS = 4
BUCKET_ROWS = 256
FOREST_ROWS = 256
LEVELS = 3
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
CHUNK_HASHES = 1 << 20
# row k: the bits, lowest first, of byte value k
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    words = WORDS.findall(text.lower())
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:z], 42) for a, z in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist())]


def majority(hashes: np.ndarray, owner: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Fingerprint of each owner 0..len(count)-1 from its hashes; `count` is their number."""
    out = np.zeros(len(count), dtype=np.uint64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        seen = np.bincount(owner * 256 + octets[:, k], minlength=256 * len(count)).reshape(-1, 256)
        ones = seen @ BYTE_BITS
        for b in range(8):
            out |= (2 * ones[:, b] > count).astype(np.uint64) << np.uint64(8 * k + b)
    return out


def fingerprints(texts: Sequence[bytes | None], shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprints (uint64) of UTF-8 texts; long lists go in bounded chunks of hashes."""
    out = np.zeros(len(texts), dtype=np.uint64)
    held: list[int] = []
    counts: list[int] = []
    first = 0

    def flush(end: int) -> None:
        count = np.array(counts, dtype=np.int64)
        owner = np.repeat(np.arange(len(count)), count)
        out[first:end] = majority(np.array(held, dtype=np.uint64), owner, count)

    for i, text in enumerate(texts):
        found = shingle_hashes(text or b"", shingle)
        held.extend(found)
        counts.append(len(found))
        if len(held) >= CHUNK_HASHES or len(counts) >= 4096:
            flush(i + 1)
            held, counts, first = [], [], i + 1
    if counts:
        flush(len(texts))
    return out


def fingerprint(df: DataFrame, text_col: str, keep: Sequence[str], shingle: int = SHINGLE_WORDS) -> DataFrame:
    """`keep` columns and `fp` (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").cast(pa.large_binary()).to_pylist()
            fp = pa.array(fingerprints(texts, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fp], names=[*keep, "fp"])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("fp", T.LongType())])
    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def covering_masks(positions: Sequence[int], radius: int) -> list[int]:
    """Masks over `positions` of which one is clear of any `radius` of them."""
    size = (1 << (radius + 1)) - 1
    # from the upper half on, so that few positions also lie evenly in the masks
    vectors = {p: 1 + (size // 2 + i) % size for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vectors[p] & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _free(mask: int) -> list[int]:
    return [p for p in range(BITS) if not mask >> p & 1]


def _masks_below(masks: list[int], radius: int) -> list[list[int]]:
    return [[m | extra for extra in covering_masks(_free(m), radius)] for m in masks]


def _mask_array(masks: Sequence[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def _forest(radius: int):
    """Verified links of each bucket, as (fp, smallest fp of its part of the bucket)."""

    def parts(members: np.ndarray) -> np.ndarray:
        label = np.arange(len(members))
        while True:  # minimum over neighbours until stable; members are sorted
            low = label.copy()
            for start in range(0, len(members), FOREST_ROWS):
                rows = members[start : start + FOREST_ROWS, None]
                near = np.bitwise_count(rows ^ members[None, :]) <= radius
                low[start : start + FOREST_ROWS] = np.where(near, label[None, :], len(members)).min(axis=1)
            if (low == label).all():
                return label
            label = low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for members in batch.column(0).to_pylist():
                fps = np.sort(np.array(members, dtype=np.int64))
                root = parts(fps.view(np.uint64))
                linked = root != np.arange(len(fps))
                left.append(fps[linked])
                right.append(fps[root[linked]])
            pair = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["a", "b"])

    return run


def links(distinct_fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within `radius`; input: distinct `fp`."""
    masks = covering_masks(range(BITS), radius)
    entries = distinct_fps.select(
        "fp", F.posexplode(_mask_array(masks)).alias("t", "m")
    ).select("t", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
    found = []
    for level in range(1, LEVELS + 1):
        buckets = (
            entries.groupBy("t", "key")
            .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
            .filter("n > 1")
        )
        buckets = staged(buckets, f"buckets-{level}")
        found.append(
            buckets.filter((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
        )
        limit = bucket_rows if level < LEVELS else 1 << BITS  # the last level is bounded by its free bits
        shared_by = buckets.filter("n > 2").select("t", "key", "n")
        members = entries.join(shared_by.hint("shuffle_merge"), ["t", "key"])
        found.append(
            members.filter(F.col("n") <= F.lit(min(limit, (1 << 63) - 1)))
            .groupBy("t", "key")
            .agg(F.collect_list("fp").alias("fps"))
            .select("fps")
            .mapInArrow(_forest(radius), "a long, b long")
        )
        if level == LEVELS or not buckets.filter(F.col("n") > limit).limit(1).count():
            break
        below = _masks_below(masks, radius)
        width = len(below[0])
        per_table = F.array(*[_mask_array(group) for group in below])
        entries = staged(
            members.filter(F.col("n") > limit)
            .select("fp", "t", F.posexplode(per_table[F.col("t")]).alias("s", "m"))
            .select((F.col("t") * width + F.col("s")).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp"),
            f"entries-{level + 1}",
        )
        masks = [m for group in below for m in group]
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    bucket_rows: int = BUCKET_ROWS,
    keep_cols: Sequence[str] | None = None,
) -> DataFrame:
    """`keep_cols` (default: the id), `fp` and `component_id`: the smallest id reachable by links."""
    keep = [id_col, *(c for c in keep_cols or () if c not in (id_col, "fp", "component_id"))]
    docs = staged(fingerprint(df, text_col, keep, shingle), "fingerprints")
    owners = staged(docs.groupBy("fp").agg(F.min(id_col).alias("own")), "distinct-fingerprints")
    roots = components(links(owners.select("fp"), radius, bucket_rows), "a", "b")
    labelled = owners.join(roots.withColumnRenamed("node", "fp").hint("shuffle_merge"), "fp", "left").select(
        "fp", "own", F.coalesce("root", "fp").alias("root")
    )
    smallest = staged(labelled.groupBy("root").agg(F.min("own").alias("component_id")), "smallest-ids")
    classes = staged(
        labelled.join(smallest.hint("shuffle_merge"), "root").select("fp", "component_id"), "classes"
    )
    return docs.join(classes.hint("shuffle_merge"), "fp").select(*keep, "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """The rows of `df` whose id is the smallest of their component.

    Only ids and fingerprints are grouped; of the rows themselves only those that
    a bounded filter calls doubtful move, to meet the list of those that go. Rows that share the id and the text stay or go
    together; of rows that share the id but not the text the one with the
    smallest text hash stays.
    """
    named = df.withColumn("__text_hash", F.xxhash64(F.col(text_col)))
    found = near_duplicates(named, id_col, text_col, shingle, radius, keep_cols=["__text_hash"])
    # null ids last
    name = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("__text_hash").alias("h"))
    firsts = staged(found.groupBy("component_id").agg(F.min(name).alias("first")), "firsts")
    go = staged(
        found.join(firsts.hint("shuffle_merge"), found["component_id"].eqNullSafe(firsts["component_id"]))
        .filter(~name.eqNullSafe(F.col("first")))
        .select(F.col(id_col).alias("__go_id"), F.col("__text_hash").alias("__go_hash"))
        .distinct(),
        "near-duplicates",
    )
    # rows that certainly stay pass straight through; the others meet the list
    may_go = membership(go, "__go_id", "__go_hash")(F.col(id_col), F.col("__text_hash"))
    doubted = named.filter(may_go)
    same = doubted[id_col].eqNullSafe(go["__go_id"]) & (doubted["__text_hash"] == go["__go_hash"])
    return named.filter(~may_go).unionByName(doubted.join(go, same, "left_anti")).drop("__text_hash")
