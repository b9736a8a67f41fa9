"""How corpus filters interact: an audit over a sparse document-term matrix.

Words are dictionary-encoded for the whole corpus and the documents become a sparse
matrix (documents by words, entries are counts) in CSR shards. The sums of its rows
are the documents' word counts, the entries of a row its distinct words: these decide
filters A (too few words) and B (too few different words). The other flags are taken
from the text: C (too many capitals), D (forbidden signs), E (text of a smaller id).
The flags are added up by part, flag set and label; every order of the filters and
every step is then derived from these sums, not from the documents.

Scale. A task cuts its texts into blocks (about ``BLOCK_CHARS`` characters, whole
texts only); a block is one shard, one row of a table, with columns numbered by its
own word list. The list is dealt by a hash of the word into buckets whose number
follows the number of characters, so a bucket has about as many words at every size.
A bucket orders its distinct words: the word of rank r in bucket b has the number
r * buckets + b, for all blocks. The numbers return to the blocks and replace the
shard's own ones. A frequent word takes one entry for each block. Texts are not
shuffled; a block sends its word list once and its shard once.

Defined cases: null text is the empty text (no words: A fails, B does not); a null
part is the empty string; rows that repeat id and text are rows like others, and none
of them has a smaller id than its copy, so E fails for neither; a null id is no smaller
id and has none, and meets no label; of several label rows of an id any 1 counts; an
empty table gives an empty result; other columns are left out. A text of any length
is in one block.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import staged

FILTERS = "ABCDE"
BLOCK_CHARS = 6_000_000
BLOCK_ROWS = 50_000
BUCKET_CHARS = 16_000_000
# Odd factors for the bytes of a word by their place.
FACTORS = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
SIGNS = b"#$%&*|"
MIN_WORDS = 200
FACTS = ("chars", "capitals", "sign", "digest")

PART = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("numbers", T.BinaryType()),
        T.StructField("sizes", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
    ]
)
MATRIX = [T.StructField(c, T.BinaryType()) for c in ("row_ends", "columns", "counts")]


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zlib.compress(values.astype(kind).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=kind)


def _byte_set(members: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(members, dtype=np.uint8))


def word_table(raw: Sequence[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order (runs without a blank and 0x09 to 0x0D), and the number of words of each."""
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    octets = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    inside = ~_byte_set(b" \t\n\x0b\x0c\r")[octets]
    heads = inside.copy()
    heads[1:] &= ~inside[:-1]
    data = octets[inside]
    offsets = np.append(np.flatnonzero(heads[inside]), len(data)).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )
    begun = np.searchsorted(np.flatnonzero(heads), np.concatenate([[0], np.cumsum(sizes)]))
    return words, np.diff(begun)


def text_facts(raw: bytes) -> dict:
    """Code points, A to Z among them, whether a forbidden sign occurs, and the content's digest."""
    octets = np.frombuffer(raw, dtype=np.uint8)
    return {
        "chars": int(((octets & 0xC0) != 0x80).sum()),
        "capitals": int(((octets >= 65) & (octets <= 90)).sum()),
        "sign": any(s in raw for s in SIGNS),
        "digest": hashlib.sha256(raw).digest(),
    }


def csr(texts: Sequence[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, row ends, columns, counts) of the texts' matrix; columns ascend within a row."""
    words, per_text = word_table(texts)
    coded = words.dictionary_encode()
    width = max(1, len(coded.dictionary))
    kind = np.int32 if len(texts) * width < 1 << 31 else np.int64
    row = np.repeat(np.arange(len(texts), dtype=kind), per_text)
    cells, counts = np.unique(row * kind(width) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    ends = np.cumsum(np.bincount(cells // width, minlength=len(texts)))
    return coded.dictionary, ends, cells % width, counts


def _raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a large_binary array."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    offsets, data = _raw(words)
    sizes = np.diff(offsets)
    data = data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    mixed = np.add.reduceat(data * FACTORS[place % len(FACTORS)], offsets[:-1] - offsets[0]) ^ sizes.astype(np.uint64)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _parts(words: pa.Array, buckets: int) -> list[dict]:
    """The words by bucket, each bucket's packed with their numbers."""
    bucket = (word_hashes(words) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    offsets, data = _raw(words.take(pa.array(order)))
    sizes = np.diff(offsets)
    used, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    return [
        {
            "bucket": b,
            "numbers": _pack(order[i:j], "<u4"),
            "sizes": _pack(sizes[i:j], "<u4"),
            "words": zlib.compress(data[offsets[i] : offsets[j]].tobytes(), 1),
        }
        for b, i, j in zip(used.tolist(), starts.tolist(), ends.tolist())
    ]


def _rows_type(keep: Sequence[T.StructField]) -> T.StructType:
    kinds = (T.LongType(), T.LongType(), T.BooleanType(), T.BinaryType())
    return T.StructType([*keep, *(T.StructField(f"__{f}", k) for f, k in zip(FACTS, kinds))])


def _blocks(keep: Sequence[T.StructField], text_col: str, buckets: int, block_chars: int):
    """One row for each block: its documents' kept columns and facts, its matrix and its word list by bucket."""
    names = [f.name for f in keep]
    rows_type, part_type = to_arrow_type(_rows_type(keep)), pa.list_(to_arrow_type(PART))

    def block(number: int, columns: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        words, ends, cols, counts = csr(texts)
        facts = [text_facts(t) for t in texts]
        values = [*columns, *(pa.array([f[c] for f in facts], rows_type.field(f"__{c}").type) for c in FACTS)]
        rows = pa.StructArray.from_arrays(values, fields=list(rows_type))
        steps = np.diff(cols, prepend=0)  # columns ascend within a row: small steps pack well
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), rows),
                pa.array([_pack(ends, "<i8")], pa.binary()),
                pa.array([_pack(steps, "<i4")], pa.binary()),
                pa.array([_pack(counts, "<i4")], pa.binary()),
                pa.array([_parts(words, buckets)], part_type),
            ],
            names=["block", "rows", "row_ends", "columns", "counts", "parts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[bytes] = []
        slices: list[list[pa.Array]] = [[] for _ in names]
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            columns = [
                pa.concat_arrays(parts).cast(rows_type.field(i).type) for i, parts in enumerate(slices)
            ]
            out = block(number, columns, held)
            number, size = number + 1, 0
            held.clear()
            for parts in slices:
                parts.clear()
            return out

        for batch in batches:
            texts = batch.column(text_col)
            first = 0
            for i in range(batch.num_rows):
                text = (texts[i].as_py() or "").encode("utf-8")
                held.append(text)
                size += len(text)
                if size >= block_chars or len(held) >= BLOCK_ROWS:
                    for parts, c in zip(slices, names):
                        parts.append(batch.column(c).slice(first, i + 1 - first))
                    first = i + 1
                    yield close()
            if first < batch.num_rows:
                for parts, c in zip(slices, names):
                    parts.append(batch.column(c).slice(first))
        if held:
            yield close()

    return run


def _number_words(buckets: int):
    """(block, numbers, ids): the corpus-wide numbers of each block's words of a bucket.

    One more row, without a block, has the bucket's own words by rank.
    """

    def run(parts: pa.Table) -> pa.Table:
        bucket = parts.column("bucket")[0].as_py()
        sizes = [_unpack(b, "<u4") for b in parts.column("sizes").to_pylist()]
        data = b"".join(map(zlib.decompress, parts.column("words").to_pylist()))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        words = pa.Array.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
        )
        coded = words.dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        by_code = np.empty(len(order), dtype=np.int64)
        by_code[order] = np.arange(len(order))
        ids = by_code[coded.indices.to_numpy(zero_copy_only=False)] * buckets + bucket
        ends = np.cumsum([len(s) for s in sizes])
        packed = [_pack(p, "<i8") for p in np.split(ids, ends[:-1])]
        return pa.table(
            {
                "block": pa.concat_arrays([*parts.column("block").chunks, pa.array([None], pa.int64())]),
                "bucket": pa.array(np.full(len(sizes) + 1, bucket, dtype=np.int32)),
                "numbers": pa.array([*parts.column("numbers").to_pylist(), None], pa.binary()),
                "ids": pa.array([*packed, None], pa.binary()),
                "words": pa.array([*[None] * len(sizes), coded.dictionary.take(pa.array(order)).to_pylist()], pa.list_(pa.binary())),
            }
        )

    return run


def _globalise(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """The block's shard with corpus-wide column numbers, ascending within each row."""
    if not blocks.num_rows:
        return blocks.drop_columns([c for c in blocks.column_names if c not in ("block", "rows", "row_ends", "columns", "counts")])
    numbers = [_unpack(b, "<u4") for b in found.column("numbers").to_pylist()]
    ids = np.zeros(sum(map(len, numbers)), dtype=np.int64)
    for own, packed in zip(numbers, found.column("ids").to_pylist()):
        ids[own] = _unpack(packed, "<i8")
    ends = _unpack(blocks.column("row_ends")[0].as_py(), "<i8")
    columns = ids[np.cumsum(_unpack(blocks.column("columns")[0].as_py(), "<i4"), dtype=np.int64)]
    counts = _unpack(blocks.column("counts")[0].as_py(), "<i4")
    place = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    span = max(1, int(ids.max(initial=0)) + 1)
    order = np.argsort(place * span + columns) if len(ends) * span < 1 << 62 else np.lexsort((columns, place))
    return pa.table(
        {
            "block": blocks.column("block"),
            "rows": blocks.column("rows"),
            "row_ends": blocks.column("row_ends"),
            "columns": pa.array([columns[order].tobytes()], pa.binary()),
            "counts": pa.array([counts[order].tobytes()], pa.binary()),
        }
    )


@dataclass(frozen=True)
class TermMatrix:
    """`shards`: block, rows (kept columns and facts), row_ends (packed), columns (int64), counts (int32);
    `numbered`: corpus-wide numbers by block, and the words of each bucket."""

    shards: DataFrame
    numbered: DataFrame
    buckets: int

    def dictionary(self) -> DataFrame:
        """(word_id, word) of every distinct word of the corpus."""
        listed = self.numbered.filter("block is null").select("bucket", F.posexplode("words").alias("rank", "word"))
        return listed.select(
            (F.col("rank").cast("long") * self.buckets + F.col("bucket")).alias("word_id"),
            F.col("word").cast("string").alias("word"),
        )


def term_matrix(
    docs: DataFrame,
    keep_cols: Sequence[str],
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    bucket_chars: int = BUCKET_CHARS,
) -> TermMatrix:
    """The sparse document-term matrix of `docs` in CSR shards."""
    chars = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")).cast("long"))).first()[0] or 0
    buckets = max(8, -(-chars // bucket_chars))
    keep = [docs.schema[c] for c in keep_cols]
    row_field = T.StructField("rows", T.ArrayType(_rows_type(keep)))
    schema = T.StructType([T.StructField("block", T.LongType()), row_field, *MATRIX, T.StructField("parts", T.ArrayType(PART))])
    sent = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep_cols, text_col])])
    blocks = staged(sent.mapInArrow(_blocks(keep, text_col, buckets, block_chars), schema), "matrix-blocks")
    numbered = staged(
        blocks.select("block", F.inline("parts"))
        .groupBy("bucket")
        .applyInArrow(_number_words(buckets), "block long, bucket int, numbers binary, ids binary, words array<binary>"),
        "matrix-words",
    )
    shards = (
        blocks.drop("parts")
        .groupBy("block")
        .cogroup(numbered.filter("block is not null").select(F.col("block").alias("of"), "numbers", "ids").groupBy("of"))
        .applyInArrow(_globalise, T.StructType([T.StructField("block", T.LongType()), row_field, *MATRIX]))
    )
    return TermMatrix(shards, numbered, buckets)


def _row_counts(keep: Sequence[T.StructField]):
    """A row for each document of a shard with the sum (n_words) and the entries (n_distinct) of its matrix row."""
    names = [*(f.name for f in keep), *(f"__{f}" for f in FACTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends = _unpack(batch.column("row_ends")[i].as_py(), "<i8")
                counts = np.frombuffer(batch.column("counts")[i].as_py(), dtype="<i4").astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(counts)])
                starts = np.concatenate([[0], ends[:-1]])
                rows = batch.column("rows").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [*rows.flatten(), pa.array(sums[ends] - sums[starts]), pa.array(ends - starts)],
                    names=[*names, "n_words", "n_distinct"],
                )

    return run


def document_flags(
    docs: DataFrame,
    keep_cols: Sequence[str] = ("source",),
    id_col: str = "doc_id",
    text_col: str = "text",
    **limits: int,
) -> DataFrame:
    """`id_col`, `keep_cols`, n_words, n_distinct and `failed`: a bit for each failing filter (A: 1 ... E: 16)."""
    kept = list(dict.fromkeys([id_col, *keep_cols]))
    matrix = term_matrix(docs, kept, text_col, **limits)
    keep = [docs.schema[c] for c in kept]
    schema = T.StructType(
        [*_rows_type(keep), T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())]
    )
    rows = staged(matrix.shards.mapInArrow(_row_counts(keep), schema), "matrix-rows")
    # texts that stand under several ids, stored so that Spark can split the join of a large group
    repeated = staged(
        rows.groupBy(F.col("__digest").alias("digest"))
        .agg(F.min(id_col).alias("first"), F.max(id_col).alias("last"))
        .filter("first < last")
        .select("digest", "first"),
        "repeated-texts",
    )
    met = rows.join(repeated.hint("shuffle_merge"), F.col("__digest") == F.col("digest"), "left")
    fails = {
        "A": F.col("n_words") < MIN_WORDS,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("__capitals") > 2 * F.col("__chars"),
        "D": F.col("__sign"),
        "E": F.coalesce(F.col(f"`{id_col}`") > F.col("first"), F.lit(False)),
    }
    failed = sum((F.when(fails[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    return met.select(*[F.col(f"`{c}`") for c in kept], "n_words", "n_distinct", failed.alias("failed"))


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) for every order and step."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def audit(
    docs: DataFrame,
    labels: DataFrame,
    part_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    good_col: str = "quality",
    toxic_col: str = "toxic",
    **limits: int,
) -> DataFrame:
    """What each filter removes in each order and step, by part (see the module's text)."""
    flags = document_flags(docs, [part_col], id_col, text_col, **limits).select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), "failed"
    )
    marked = staged(
        labels.groupBy(F.col(f"`{id_col}`").alias("label_id"))
        .agg(F.max(F.col(good_col) == 1).alias("good"), F.max(F.col(toxic_col) == 1).alias("toxic"))
        .filter("good or toxic"),
        "labels",
    )
    met = staged(flags, "flags").join(marked.hint("shuffle_merge"), F.col("id") == F.col("label_id"), "left")
    cells = (
        met.groupBy("part", "failed")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
        .groupBy("part")  # 32 cells at most
        .agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    )
    places = F.array(
        *[
            F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before"))
            for o, s, b, p in _orders()
        ]
    )
    bit, before = F.col("bit"), F.col("before")

    def total(field: str, chosen) -> Column:
        hit = F.filter("cells", chosen)
        return F.aggregate(hit, F.lit(0).cast("long"), lambda s, c: s + c[field])

    def removed(c: Column) -> Column:
        return (c["failed"].bitwiseAND(bit) != 0) & (c["failed"].bitwiseAND(before) == 0)

    steps = cells.select("part", "cells", F.inline(places)).select(
        "part",
        "filter_order",
        "step",
        "bit",
        total("n", lambda c: c["failed"].bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda c: (c["failed"].bitwiseAND(bit) != 0) & (c["failed"].bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda c: c["failed"] == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        "cells",
    )
    # over all orders a filter removes a document once for each order in which it comes before
    # the document's other failing filters: orders / number of failing filters
    orders = len(_orders()) // len(FILTERS)
    shapley = F.aggregate(
        F.filter("cells", lambda c: c["failed"].bitwiseAND(bit) != 0),
        F.lit(0).cast("long"),
        lambda s, c: s + c["n"] * (F.lit(orders) / F.bit_count(c["failed"])).cast("long"),
    )
    return steps.withColumn("shapley", shapley).drop("cells", "bit")
