"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Pre-tokens repeat: in running text a few hundred thousand distinct ones make up
many millions. So each block of documents (about ``BLOCK_CHARS`` characters, whole
documents only) is split into pre-tokens, and these are gathered per distinct word
with their positions before anything is shuffled. The block's words are dealt by a
hash of the word into buckets; a bucket gets the words of all blocks, encodes each
distinct word once and sends the ids back to the blocks, where they are put in the
places of the words. Decoding joins the table of token bytes (as long as the
vocabulary) to the ids in vectorised form.

A frequent word takes one entry per block, not one per occurrence, so no word makes
a bucket heavy. Texts are not shuffled: a block sends its words once, and its
sequence of word numbers once. Both plans read the input and must see the same
rows in a block; a block's key holds a digest of its content, so rows that come in
another order in the second reading raise an error instead of mixing blocks.

Splitting works on arrays of character classes for many texts at once. The classes
are asked from tiktoken itself, so letters, numbers and white space are exactly
those of its own pattern.

Defined cases: null text counts as empty and has no ids; repeated rows and null ids
give a row each; a text of any length is one block at most and is held by one task;
an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import bucket_count

BLOCK_CHARS = 5_000_000
CHUNK_CHARS = 500_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (base64 bytes and the id on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def class_table() -> np.ndarray:
    """Character class of each code point, as tiktoken's pattern engine sees it."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    text = "".join(map(chr, points))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        matches = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = matches.decode(matches.encode_ordinary(text))
        table[np.frombuffer(found.encode("utf-32-le"), dtype="<u4")] = kind
    return table


def split_points(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which code points begin a pre-token.

    points: code points of texts put end to end; first: marks each text's first one.
    Runs of one class are pre-tokens; a blank goes with the run that follows it; white
    space before a run keeps its last character apart; 's 't 're 've 'm 'll 'd are cut
    off an apostrophe that nothing else has claimed.
    """
    n = len(points)
    kind = classes[points]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    begins = run.copy()
    # a run after white space: the last white space character leaves the run before it
    after_space = run & ~space
    after_space[0] = False
    after_space[1:] &= space[:-1] & ~first[1:]
    at = np.flatnonzero(after_space)
    begins[at - 1] = True
    blank = at[points[at - 1] == 0x20]
    begins[blank] = False  # the blank and the run are one pre-token
    # contractions
    mark = np.flatnonzero((points == 0x27) & run)
    mark = mark[mark + 1 < n]
    joined = np.zeros(len(mark), dtype=bool)
    has_before = mark > 0
    joined[has_before] = (points[mark[has_before] - 1] == 0x20) & ~first[mark[has_before]]
    mark = mark[~joined]
    mark = mark[~first[mark + 1]]
    one = points[mark + 1]
    two = np.where((mark + 2 < n), points[np.minimum(mark + 2, n - 1)], 0)
    two = np.where((mark + 2 < n) & ~first[np.minimum(mark + 2, n - 1)], two, 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | (
        (one == ord("l")) & (two == ord("l"))
    )
    for marks, size in ((mark[short], 2), (mark[long & ~short], 3)):
        begins[marks + 1] = False
        rest = marks + size
        rest = rest[rest < n]
        rest = rest[(kind[rest] == LETTER) & ~first[rest]]
        begins[rest] = True
    return begins


def split_texts(texts: list[str], classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of all texts as one binary array, and the number of them in each text."""
    joined = "".join(texts)
    if not joined:
        return pa.array([], pa.large_binary()), np.zeros(len(texts), dtype=np.int64)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    heads = np.cumsum(lengths) - lengths
    first = np.zeros(len(points), dtype=bool)
    first[heads[lengths > 0]] = True
    begins = split_points(points, first, classes)
    raw = joined.encode("utf-8")
    octets = np.frombuffer(raw, dtype=np.uint8)
    char_at = np.flatnonzero((octets & 0xC0) != 0x80)
    offsets = np.append(char_at[begins], len(raw)).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]
    )
    so_far = np.concatenate([[0], np.cumsum(begins)])
    return words, so_far[heads + lengths] - so_far[heads]


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, count: int) -> np.ndarray:
    planes = pa.decompress(blob, decompressed_size=4 * count, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, count).T).view("<u4").ravel()


class Block:
    """Distinct words of some documents, most frequent first, and where they stand."""

    def __init__(self, words: pa.ChunkedArray, buckets: int):
        coded = words.dictionary_encode().unify_dictionaries()
        if coded.num_chunks:
            found = coded.chunk(0).dictionary
            numbers = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
        else:
            found, numbers = pa.array([], pa.large_binary()), np.zeros(0, dtype=np.int64)
        order = np.argsort(-np.bincount(numbers, minlength=len(found)), kind="stable")
        rank = np.empty(len(found), dtype=np.int64)
        rank[order] = np.arange(len(found))
        self.sequence = rank[numbers] if len(numbers) else numbers
        self.words = found.take(pa.array(order))
        self.bucket = np.fromiter(
            (zlib.crc32(w) % buckets for w in self.words.to_pylist()), dtype=np.int64, count=len(order)
        )


def blocks(batches: Iterator[pa.RecordBatch], classes: np.ndarray, buckets: int, block_chars: int):
    """(key, document ids, pre-tokens per document, Block) for each block of a partition."""
    part, number = TaskContext.get().partitionId(), 0
    ids: list = []
    counts: list[np.ndarray] = []
    words: list[pa.Array] = []
    held = 0
    texts: list[str] = []
    chars = 0

    def split() -> None:
        nonlocal texts, chars
        if texts:
            found, per_text = split_texts(texts, classes)
            words.append(found)
            counts.append(per_text)
        texts, chars = [], 0

    def close():
        nonlocal ids, counts, words, held, number
        split()
        block = Block(pa.chunked_array(words, pa.large_binary()), buckets)
        per_document = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
        digest = hashlib.blake2b(repr(ids).encode(), digest_size=8)
        digest.update(per_document.tobytes())
        digest.update(block.sequence.tobytes())
        key = f"{part}-{number}-{digest.hexdigest()}"
        out = key, ids, per_document, block
        pa.default_memory_pool().release_unused()
        ids, counts, words, held, number = [], [], [], 0, number + 1
        return out

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if ids and held + len(text) > block_chars:
                yield close()
            ids.append(key)
            texts.append(text)
            held += len(text)
            chars += len(text)
            if chars >= CHUNK_CHARS:
                split()
    if ids:
        yield close()


def _words_of_blocks(classes, buckets: int, block_chars: int):
    """A row for each bucket of each block: the block's distinct words that fall into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _, block in blocks(batches, classes.value, buckets, block_chars):
            words = block.words.take(pa.array(np.argsort(block.bucket, kind="stable")))
            lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
            sizes = np.bincount(block.bucket, minlength=buckets)
            used = np.flatnonzero(sizes)
            ends = np.cumsum(sizes)[used]
            starts = ends - sizes[used]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used.astype(np.int32)),
                    pa.array([key] * len(used), pa.string()),
                    pa.array(sizes[used].astype(np.int32)),
                    pa.array([pack(lengths[x:y]) for x, y in zip(starts, ends)], pa.binary()),
                    pa.array([b"".join(words[x:y].to_pylist()) for x, y in zip(starts, ends)], pa.binary()),
                ],
                names=["bucket", "block", "n", "lengths", "words"],
            )

    return run


def _sequences_of_blocks(classes, buckets: int, block_chars: int, id_type: pa.DataType):
    """A row for each block: its documents and the numbers of their words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, per_document, block in blocks(batches, classes.value, buckets, block_chars):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key], pa.string()),
                    pa.array([ids], pa.list_(id_type)),
                    pa.array([pack(per_document)], pa.binary()),
                    pa.array([len(block.sequence)], pa.int64()),
                    pa.array([pack(block.sequence)], pa.binary()),
                    pa.array([len(block.bucket)], pa.int64()),
                    pa.array([pack(block.bucket)], pa.binary()),
                ],
                names=["block", "ids", "counts", "n", "sequence", "n_words", "buckets"],
            )

    return run


def _encode_bucket(ranks, pattern: str):
    """Ids of a bucket's words: each distinct word of all blocks is encoded once."""
    held: list = []

    def run(table: pa.Table) -> pa.Table:
        import tiktoken

        if not held:
            held.append(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}))
        sizes = table.column("n").to_pylist()
        lengths = np.concatenate([unpack(b, n) for b, n in zip(table.column("lengths").to_pylist(), sizes)])
        data = b"".join(table.column("words").to_pylist())
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        words = pa.Array.from_buffers(
            pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
        )
        coded = words.dictionary_encode()
        encode = held[0].encode_ordinary
        encoded = [encode(w.decode("utf-8")) for w in coded.dictionary.to_pylist()]
        ids = pa.array(encoded, pa.large_list(pa.uint32())).take(coded.indices)
        per_word = np.diff(ids.offsets.to_numpy())
        flat = ids.values.to_numpy()
        ends = np.cumsum(sizes)
        last = np.cumsum(per_word)[ends - 1]
        totals = np.diff(np.concatenate([[0], last]))
        return pa.table(
            {
                "block": table.column("block"),
                "bucket": table.column("bucket"),
                "n": table.column("n"),
                "sizes": pa.array([pack(per_word[e - n : e]) for e, n in zip(ends, sizes)], pa.binary()),
                "n_ids": pa.array(totals, pa.int64()),
                "word_ids": pa.array([pack(flat[z - t : z]) for z, t in zip(last, totals)], pa.binary()),
            }
        )

    return run


def ragged_take(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]] for all i, put end to end."""
    total = int(sizes.sum())
    if not total:
        return values[:0]
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return values[np.arange(total) + shift]


def _reassemble(id_col: str, id_type: pa.DataType, finish):
    """Put the ids in the places of the words, document by document.

    finish(ids): the result columns made of the documents' lists of ids.
    """

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        if block.num_rows != 1:
            raise RuntimeError("a block's rows differ between two readings of the input: store it as a table first")
        row = block.to_pylist()[0]
        documents = row["ids"]
        per_document = unpack(row["counts"], len(documents)).astype(np.int64)
        sequence = unpack(row["sequence"], row["n"])
        bucket = unpack(row["buckets"], row["n_words"])
        order = np.argsort(bucket, kind="stable")
        parts = sorted(found.to_pylist(), key=lambda r: r["bucket"])
        if sum(r["n"] for r in parts) != len(order):
            raise RuntimeError("a block's words differ between two readings of the input: store it as a table first")
        empty = np.zeros(0, dtype=np.uint32)
        sizes = np.concatenate([empty, *(unpack(r["sizes"], r["n"]) for r in parts)]).astype(np.int64)
        values = np.concatenate([empty, *(unpack(r["word_ids"], r["n_ids"]) for r in parts)])
        size_of = np.empty(len(order), dtype=np.int64)
        start_of = np.empty(len(order), dtype=np.int64)
        size_of[order] = sizes
        start_of[order] = np.cumsum(sizes) - sizes
        word_sizes = size_of[sequence]
        ids = ragged_take(start_of[sequence], word_sizes, values)
        reached = np.concatenate([[0], np.cumsum(word_sizes)])
        offsets = reached[np.concatenate([[0], np.cumsum(per_document)])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
        out = pa.table({id_col: pa.array(documents, id_type), **finish(lists)})
        pa.default_memory_pool().release_unused()
        return out

    return run


def _encoded(df, ranks_path, pattern, id_col, text_col, buckets, block_chars, finish, result: str) -> DataFrame:
    spark = df.sparkSession
    if not buckets:
        buckets = bucket_count(df, text_col, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))  # as long as the vocabulary
    classes = spark.sparkContext.broadcast(class_table())  # one byte for each code point
    id_type = to_arrow_type(df.schema[id_col].dataType)
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col), F.col(text_col))
    words = texts.mapInArrow(
        _words_of_blocks(classes, buckets, block_chars),
        "bucket int, block string, n int, lengths binary, words binary",
    )
    found = words.groupBy("bucket").applyInArrow(
        _encode_bucket(ranks, pattern),
        "block string, bucket int, n int, sizes binary, n_ids bigint, word_ids binary",
    )
    sequences = texts.mapInArrow(
        _sequences_of_blocks(classes, buckets, block_chars, id_type),
        f"block string, ids array<{kind}>, counts binary, n bigint, sequence binary, n_words bigint, buckets binary",
    )
    return (
        sequences.groupBy("block")
        .cogroup(found.groupBy("block"))
        .applyInArrow(_reassemble(id_col, id_type, finish), f"{id_col} {kind}, {result}")
    )


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id_col, ids array<int>) for every row of `df`."""

    def finish(lists: pa.ListArray) -> dict[str, pa.Array]:
        return {"ids": lists}

    return _encoded(df, ranks_path, pattern, id_col, text_col, buckets, block_chars, finish, "ids array<int>")


def token_table(ranks: dict[bytes, int]) -> pa.Array:
    """Token bytes by id; ids that are free have none (null)."""
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.large_binary())


def decode_ids(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    """Bytes of each list of ids: token bytes joined by id, in order."""
    lists = ids.cast(pa.large_list(pa.int32()))
    flat = lists.flatten()
    gathered = tokens.take(flat)
    if gathered.null_count:
        raise ValueError("an id is not in the vocabulary")
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(gathered).to_numpy(zero_copy_only=False), dtype=np.int64)])
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
    data = b"".join(gathered.to_pylist()) if gathered.offset else gathered.buffers()[2]
    out = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), data])
    return pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.large_binary())) if lists.null_count else out


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """`df` with `ids_col` replaced by `bytes_col`, the text in UTF-8 (null for null)."""
    tokens = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    keep = [c for c in df.columns if c not in (ids_col, bytes_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(tokens.value)
        for batch in batches:
            for part in _bounded(batch, ids_col):
                text = decode_ids(part.column(ids_col), table).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), text], names=[*keep, bytes_col])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(bytes_col, T.BinaryType())])
    return df.select(*keep, ids_col).mapInArrow(run, schema)


def _bounded(batch: pa.RecordBatch, ids_col: str, most: int = 20_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of some twenty million ids, or one row."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def round_trip(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): digests of the ids, and of the bytes they decode to.

    The digests are taken where the ids come together, so the lists themselves
    need not leave the task.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    held: list[pa.Array] = []

    def finish(lists: pa.ListArray) -> dict[str, pa.Array]:
        if not held:
            held.append(token_table(vocabulary.value))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        ends = (np.cumsum(sizes) * 4).tolist()
        ids_sha = [hashlib.sha256(flat[e - 4 * n : e]).hexdigest() for e, n in zip(ends, sizes.tolist())]
        text_sha = [hashlib.sha256(b.as_buffer()).hexdigest() for b in decode_ids(lists, held[0])]
        return {
            "n_tokens": pa.array(sizes),
            "ids_sha256": pa.array(ids_sha, pa.string()),
            "decoded_sha256": pa.array(text_sha, pa.string()),
        }

    return _encoded(
        df, ranks_path, pattern, id_col, text_col, None, block_chars, finish,
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
