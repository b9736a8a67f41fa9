"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two language models, one for each class, give the probability of every byte of a
word after up to ``HISTORY`` bytes before it (the word's beginning included, words
lower-cased). Each discounts its own counts absolutely and backs off to one shared
lower-order model, built from the continuation counts of both classes together, so
an expression that either class has hardly seen is judged alike by both and says
little. The log-likelihood ratio of a word is the sum over its bytes; a document's
evidence is normalised by its length: the mean over its words, the largest mean
over a run of ``WINDOW`` words, and the largest ratio of one word. A logistic curve
turns this into a score. It is fitted on labelled rows judged by models that have not
counted them, at most ``FIT_ROWS`` of fold 3 by hash order; the models that score count
these too, so every labelled row that is not held out is counted.

Tasks add up their n-grams, Spark adds up the tasks, the lower orders are joins and
aggregations. An n-gram of at most seven bytes is its own 64-bit key, so nothing is
lost to hash collisions. Scoring keeps every n-gram and context, however many there
are. The most frequent contexts, each with all its n-grams, are broadcast as a table of
at most ``TABLE_ENTRIES`` entries (16 bytes each); a text whose bytes all have their
context there is scored where it is. If the table holds all contexts of the model, that
is every text. The others give the same scores by a join: texts are cut into blocks (about ``BLOCK_CHARS`` characters, whole texts only),
which are stored as the block's distinct words and the numbers of these in order. Words
that the table cannot tell are dealt by a hash into buckets; a bucket has the words of all blocks, and its distinct
n-grams meet the contexts in a join. A word's ratio is the sum over its bytes; ratios
return to the blocks and go to the places of the words. A frequent word takes one
entry per block, a frequent n-gram one per bucket. Texts are not shuffled, only their
word numbers (and the columns that are kept). The size of the table decides which way
a text takes and never its score.

Defined cases: null text is the empty text; a text without words has evidence zero
and gets the score that the curve gives to it; repeated rows give repeated result
rows; labels that are null or neither 0 nor 1 are not used, and of contradicting labels of an id 1
counts; of the rows of an id the one with the smallest evidence fits the curve; if the training rows lack one of the classes, every score is the share of
the toxic class (0 without labels); a null id is never held out or used to learn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .bloom import membership
from .shared import bucket_count, staged

HISTORY = 5
DISCOUNT = 0.75
WINDOW = 24
BLOCK_CHARS = 4_000_000
TABLE_ENTRIES = 1 << 21
FIT_ROWS = 20_000
CHUNK_BYTES = 1 << 20
FLUSH_GRAMS = 1 << 20
SLICE_ROWS = 512
THRESHOLD = 0.3
BOUNDARY = 0x20
FEATURES = ("mean", "window", "word", "length")


def word_bytes() -> np.ndarray:
    """Bytes that belong to words: ASCII letters and digits, and all of UTF-8 beyond ASCII."""
    return np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def gram_keys(texts: Sequence[str], history: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all word bytes of the texts, and where words and texts begin.

    (keys, context keys, first byte of a word: bool, number of word bytes per text).
    A key holds the byte in its lowest eight bits and the bytes before it above, the
    nearest lowest, up to the word's beginning, which is a blank.
    """
    return byte_keys([t.lower().encode("utf-8") for t in texts], history)


def byte_keys(raw: Sequence[bytes], history: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gram_keys of texts that are lower-case UTF-8 already."""
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    octets = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    inside = word_bytes()[octets]
    at = np.flatnonzero(inside)
    place = np.arange(len(octets))
    outer = np.maximum.accumulate(np.where(inside, -1, place))
    depth = at - outer[at]  # 1 for the first byte of a word; 0-based text start has outer -1
    padded = np.concatenate([np.full(history + 1, BOUNDARY, np.uint8), np.where(inside, octets, BOUNDARY).astype(np.uint8)])
    context = np.zeros(len(at), dtype=np.int64)
    for k in range(history, 0, -1):
        back = padded[at + history + 1 - k].astype(np.int64)
        context = (context << 8) | np.where(k <= depth, back, 0)
    keys = (context << 8) | octets[at]
    ends = np.cumsum(sizes)
    counted = np.concatenate([[0], np.cumsum(inside)])
    return keys, context, depth == 1, counted[ends] - counted[ends - sizes]


def split_words(texts: Sequence[str]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order (lower-case UTF-8), and the number of words of each text."""
    raw = [t.lower().encode("utf-8") for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    octets = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    inside = word_bytes()[octets]
    heads = inside & ~np.concatenate([[False], inside[:-1]])
    data = octets[inside]
    offsets = np.append(np.flatnonzero(heads[inside]), len(data)).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )
    ends = np.cumsum(sizes)
    counted = np.concatenate([[0], np.cumsum(heads)])
    return words, counted[ends] - counted[ends - sizes]


def _chunks(texts: Sequence[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count_grams(history: int, parts: int):
    """(key, part, n): n-grams of texts by their part (0 to `parts` - 1), added up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(parts)]

        def merged(part: int) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held[part]])
            counts = np.concatenate([c for _, c in held[part]])
            found, which = np.unique(keys, return_inverse=True)
            return found, np.bincount(which, weights=counts).astype(np.int64)

        def out(part: int, keys, counts) -> pa.RecordBatch:
            own = pa.array(np.full(len(keys), part, dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.array(keys), own, pa.array(counts)], names=["key", "part", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                texts, part_of = (rows.column(c).to_pylist() for c in (0, 1))
                for part in range(parts):
                    for chunk in _chunks([t for t, p in zip(texts, part_of) if p == part]):
                        keys = gram_keys(chunk, history)[0]
                        held[part].append(np.unique(keys, return_counts=True))
                        if sum(len(k) for k, _ in held[part]) > FLUSH_GRAMS:
                            held[part] = [merged(part)]
                            if len(held[part][0][0]) > FLUSH_GRAMS // 2:
                                yield out(part, *held[part].pop())
        for part in range(parts):
            if held[part]:
                yield out(part, *merged(part))

    return run


def _shorter(key: Column, history: int) -> Column:
    """The key without its oldest byte of history."""
    length = _length(key, history)
    cut = F.lit(0).cast("long")
    for m in range(history, 0, -1):
        cut = F.when(length == m, key.bitwiseAND(F.lit((1 << 8 * m) - 1).cast("long"))).otherwise(cut)
    return cut


def _length(key: Column, history: int) -> Column:
    """Bytes of history in a key."""
    length = F.lit(0)
    for m in range(1, history + 1):
        length = F.when(key >= F.lit(1 << 8 * m).cast("long"), F.lit(m)).otherwise(length)
    return length


def _context(key: Column) -> Column:
    return F.shiftright(key, 8)


def shared_backoff(grams: DataFrame, history: int, discount: float = DISCOUNT) -> DataFrame:
    """(key, shared): Kneser-Ney probabilities from the continuation counts of all classes.

    Level m has the n-grams with m bytes of history. A count there is the number of
    different bytes that precede the n-gram; n-grams at the beginning of a word have
    no longer history and enter their level with one.
    """
    types = grams.select("key", _length(F.col("key"), history).alias("m"))
    levels: dict[int, DataFrame] = {}
    above: DataFrame | None = types.filter(F.col("m") == history).select("key")
    for m in range(history - 1, -1, -1):
        longer = above.select(_shorter(F.col("key"), history).alias("key"))
        own = types.filter(F.col("m") == m).select("key")
        levels[m] = staged(
            longer.unionByName(own).groupBy("key").agg(F.count(F.lit(1)).alias("c")), f"continuations-{m}"
        )
        above = levels[m].select("key")
    probabilities: DataFrame | None = None
    result: DataFrame | None = None
    for m in range(history):
        level = levels[m]
        contexts = level.groupBy(_context(F.col("key")).alias("h")).agg(
            F.sum("c").alias("total"), F.count(F.lit(1)).alias("types")
        )
        joined = level.withColumn("h", _context(F.col("key"))).join(contexts.hint("shuffle_hash"), "h")
        if probabilities is None:
            lower = joined.withColumn("lower", F.lit(1.0 / 256))
        else:
            short = probabilities.select(F.col("key").alias("short"), F.col("shared").alias("lower"))
            lower = joined.withColumn("short", _shorter(F.col("key"), history)).join(short.hint("shuffle_hash"), "short")
        value = (F.greatest(F.col("c") - discount, F.lit(0.0)) + discount * F.col("types") * F.col("lower")) / F.col("total")
        probabilities = staged(lower.select("key", value.alias("shared")), f"shared-{m}")
        result = probabilities if result is None else result.unionByName(probabilities)
    return result


def log_ratios(grams: DataFrame, history: int, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """(key, ratio) of seen n-grams, and (key, ratio, n) of contexts for the bytes not seen there; n: their bytes.

    grams: key, c0, c1 (counts in ordinary and toxic texts).
    """
    contexts = staged(
        grams.groupBy(_context(F.col("key")).alias("h")).agg(
            F.sum("c0").alias("n0"),
            F.sum("c1").alias("n1"),
            F.count_if(F.col("c0") > 0).alias("t0"),
            F.count_if(F.col("c1") > 0).alias("t1"),
        ),
        "contexts",
    )
    shared = shared_backoff(grams, history, discount).withColumnRenamed("key", "short")
    joined = (
        grams.withColumn("h", _context(F.col("key")))
        .withColumn("short", _shorter(F.col("key"), history))
        .join(contexts.hint("shuffle_hash"), "h")
        .join(shared.hint("shuffle_hash"), "short", "left")
        .withColumn("shared", F.coalesce("shared", F.lit(1.0 / 256)))
    )

    def probability(c: str, n: str, t: str) -> Column:
        own = (F.greatest(F.col(c) - discount, F.lit(0.0)) + discount * F.col(t) * F.col("shared")) / F.col(n)
        return F.when(F.col(n) > 0, own).otherwise(F.col("shared"))

    ratio = F.log(probability("c1", "n1", "t1")) - F.log(probability("c0", "n0", "t0"))
    seen = joined.select("key", ratio.alias("ratio"))

    def backoff(n: str, t: str) -> Column:
        return F.when(F.col(n) > 0, discount * F.col(t) / F.col(n)).otherwise(F.lit(1.0))

    unseen = contexts.select(
        F.col("h").alias("key"),
        (F.log(backoff("n1", "t1")) - F.log(backoff("n0", "t0"))).alias("ratio"),
        (F.col("n0") + F.col("n1")).alias("n"),
    )
    return seen, unseen


def context_ratios(seen: DataFrame, unseen: DataFrame) -> DataFrame:
    """(h, n, found): each context with the ratios of its bytes, -1 for those not seen there; see log_ratios.

    Without a column `n` in `unseen` all contexts count as equally frequent."""
    octet = F.col("key").bitwiseAND(F.lit(255).cast("long")).cast("int")
    often = F.col("n").cast("long") if "n" in unseen.columns else F.lit(1).cast("long")
    # a context has 257 entries at most
    return (
        seen.select(_context(F.col("key")).alias("h"), octet.alias("b"), "ratio", F.lit(1).cast("long").alias("n"))
        .unionByName(unseen.select(F.col("key").alias("h"), F.lit(-1).alias("b"), "ratio", often.alias("n")))
        .groupBy("h")
        .agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("b", "ratio"))).alias("found"))
    )


class RatioTable(NamedTuple):
    """Ratios of the n-grams of some contexts (sorted keys), and of other bytes after these contexts."""

    keys: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    complete: bool  # no other context has a ratio

    def of_words(self, words: Sequence[bytes], history: int) -> np.ndarray:
        """The ratio of each word; not a number if a byte's context is not in the table."""

        def among(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            return at, known[at] == wanted

        out = [np.zeros(0)]
        for chunk in _chunks(words):
            keys, contexts, heads, _ = byte_keys(chunk, history)
            value = np.full(len(keys), 0.0 if self.complete else np.nan)
            if len(self.contexts):
                at, hit = among(self.contexts, contexts)
                value[hit] = self.backoff[at[hit]]
            if len(self.keys):
                at, hit = among(self.keys, keys)
                value[hit] = self.ratios[at[hit]]
            out.append(np.add.reduceat(value, np.flatnonzero(heads)))
        return np.concatenate(out)


def ratio_table(contexts: DataFrame, entries: int) -> RatioTable:
    """The most frequent of `contexts` (see context_ratios), as many as `entries` entries hold.

    Frequencies are told apart by eighths of a power of two, so the list of sizes that picks
    them has at most 512 rows; contexts of one step are taken together or not at all."""
    step = F.floor(F.log2(F.greatest("n", F.lit(1))) * 8).cast("int")
    sizes = contexts.groupBy(step.alias("step")).agg(F.sum(F.size("found") + 1).alias("entries")).collect()
    least, held = None, 0
    for row in sorted(sizes, key=lambda r: -r["step"]):
        if held + row["entries"] > entries:
            break
        least, held = row["step"], held + row["entries"]
    complete = held == sum(r["entries"] for r in sizes)
    if least is None:
        none = np.zeros(0, dtype=np.int64)
        return RatioTable(none, np.zeros(0), none, np.zeros(0), complete)
    taken = contexts.filter(step >= least)
    # a context without a ratio for bytes not seen counts zero for them
    rest = taken.select(F.col("h").alias("key"), F.coalesce(F.try_element_at("found", F.lit(-1)), F.lit(0.0)).alias("ratio"))
    seen = taken.select("h", F.explode("found").alias("b", "ratio")).filter("b >= 0")
    seen = seen.select(F.shiftleft("h", 8).bitwiseOR(F.col("b").cast("long")).alias("key"), "ratio")

    def columns(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = part.toArrow()  # at most `entries` rows
        keys = found.column("key").to_numpy()
        order = np.argsort(keys)
        return keys[order], found.column("ratio").to_numpy()[order]

    return RatioTable(*columns(seen), *columns(rest), complete)


def _number_type(words: int) -> str:
    """Type of the word numbers of a block with so many distinct words."""
    return "<u2" if words <= 1 << 16 else "<u4"


PART = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("numbers", T.BinaryType()),
        T.StructField("sizes", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
    ]
)


def _pack(values: np.ndarray, kind: str = "<u4") -> bytes:
    return zlib.compress(values.astype(kind).tobytes(), 1)


def _unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=kind)


def _parts(words: list[bytes], numbers: np.ndarray, buckets: int) -> list[dict]:
    """The words by bucket, each bucket's packed with their numbers."""
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), dtype=np.int64, count=len(words))
    order = np.argsort(bucket, kind="stable")
    used, starts = np.unique(bucket[order], return_index=True)
    out = []
    for b, at in zip(used.tolist(), np.split(order, starts[1:])):
        own = [words[i] for i in at.tolist()]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        out.append({"bucket": b, "numbers": _pack(numbers[at]), "sizes": _pack(sizes), "words": zlib.compress(b"".join(own), 1)})
    return out


def _blocks(keep: Sequence[str], text_col: str, history: int, window: int, table, buckets: int, block_chars: int):
    """Rows with their evidence by the table. Texts that it cannot tell (open ones) have their block and word
    numbers instead; the first one of a block has the ratios of the block's words, and the words without one."""
    part_type = pa.list_(to_arrow_type(PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33

        def block(batch: pa.RecordBatch, start: int, texts: list[str]) -> pa.RecordBatch:
            known: dict[bytes, int] = {}
            numbers, per_text = [], []
            for chunk in _chunks(texts):
                words, counts = split_words(chunk)
                coded = words.dictionary_encode()
                own = [known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()]
                numbers.append(np.array(own, dtype=np.uint32)[coded.indices.to_numpy(zero_copy_only=False)])
                per_text.append(counts)
            rows = np.split(np.concatenate(numbers), np.cumsum(np.concatenate(per_text))[:-1])
            ratios = table.value.of_words(list(known), history)
            found = np.array([evidence(ratios[r], window) for r in rows], dtype=float).reshape(-1, len(FEATURES))
            is_open = np.isnan(found[:, 0])
            blocks = pa.array(np.full(len(texts), number, dtype=np.int64), mask=~is_open)
            sequences, told, parts = ([None] * len(texts) for _ in range(3))
            if is_open.any():
                at = np.flatnonzero(is_open)
                used, renumbered = np.unique(np.concatenate([rows[i] for i in at]), return_inverse=True)
                kind, listed = _number_type(len(used)), list(known)
                for i, own in zip(at, np.split(renumbered, np.cumsum([len(rows[i]) for i in at])[:-1])):
                    sequences[i] = _pack(own, kind)
                lacking = np.flatnonzero(np.isnan(ratios[used]))
                told[at[0]] = _pack(ratios[used], "<f8")
                parts[at[0]] = _parts([listed[w] for w in used[lacking]], lacking, buckets)
            own = batch.slice(start, len(texts))
            return pa.RecordBatch.from_arrays(
                [
                    *(own.column(c) for c in keep),
                    *(pa.array(np.ascontiguousarray(c), mask=is_open) for c in found.T),
                    blocks,
                    pa.array(sequences, pa.binary()),
                    pa.array(told, pa.binary()),
                    pa.array(parts, part_type),
                ],
                names=[*keep, *(f"__{f}" for f in FEATURES), "__block", "__numbers", "__told", "__parts"],
            )

        for batch in batches:
            held, size, first = [], 0, 0
            for start in range(0, batch.num_rows, SLICE_ROWS):  # few texts are unpacked at a time
                for text in batch.slice(start, SLICE_ROWS).column(text_col).to_pylist():
                    held.append(text or "")
                    size += len(held[-1])
                    if size >= block_chars:
                        yield block(batch, first, held)
                        number, first = number + 1, first + len(held)
                        held, size = [], 0
            if held:
                yield block(batch, first, held)
                number += 1

    return run


def _words_of(parts: pa.Table) -> pa.DictionaryArray:
    """Words of a bucket's parts in order, with each distinct word once in the dictionary."""
    sizes = [_unpack(b) for b in parts.column("sizes").to_pylist()]
    data = b"".join(map(zlib.decompress, parts.column("words").to_pylist()))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
    )
    return words.dictionary_encode()


def _bucket_keys(history: int):
    """(bucket, key): the distinct n-grams of a bucket's words."""

    def run(parts: pa.Table) -> pa.Table:
        found = [np.unique(byte_keys(c, history)[0]) for c in _chunks(_words_of(parts).dictionary.to_pylist())]
        keys = np.unique(np.concatenate(found))
        bucket = np.full(len(keys), parts.column("bucket")[0].as_py(), dtype=np.int32)
        return pa.table({"bucket": pa.array(bucket), "key": pa.array(keys)})

    return run


def _bucket_ratios(history: int):
    """(block, numbers, ratios): each block's words of a bucket, with their ratios."""

    def run(parts: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("key").to_numpy())
        known, value = found.column("key").to_numpy()[order], found.column("ratio").to_numpy()[order]
        coded = _words_of(parts)
        ratios = [np.zeros(0)]
        for chunk in _chunks(coded.dictionary.to_pylist()):
            keys, _, heads, _ = byte_keys(chunk, history)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                own = np.where(known[at] == keys, value[at], 0.0)
            else:
                own = np.zeros(len(keys))
            ratios.append(np.add.reduceat(own, np.flatnonzero(heads)))
        all_words = np.concatenate(ratios)[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum([len(_unpack(n)) for n in parts.column("numbers").to_pylist()])
        packed = [_pack(r, "<f8") for r in np.split(all_words, ends[:-1])]
        return pa.table(
            {"block": parts.column("block"), "numbers": parts.column("numbers"), "ratios": pa.array(packed, pa.binary())}
        )

    return run


def gram_ratios(grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """(bucket, key, ratio) of those `grams` (bucket, key) whose context is among `contexts` (see context_ratios)."""
    octet = F.col("key").bitwiseAND(F.lit(255).cast("long")).cast("int")
    ratio = F.coalesce(F.try_element_at("found", octet), F.try_element_at("found", F.lit(-1)), F.lit(0.0))
    return (
        grams.withColumn("h", _context(F.col("key")))
        .join(contexts.select("h", "found").hint("shuffle_merge"), "h")
        .select("bucket", "key", ratio.alias("ratio"))
    )


def evidence(words: np.ndarray, window: int) -> tuple[float, ...]:
    """FEATURES of a text from the ratios of its words in order."""
    if not len(words):
        return (0.0,) * len(FEATURES)
    reached = np.concatenate([[0.0], np.cumsum(words)])
    size = min(window, len(words))
    most = (reached[size:] - reached[:-size]).max() / size
    return float(words.mean()), float(most), float(words.max()), float(np.log1p(len(words)))


def _reassemble(keep: Sequence[str], window: int):
    """Put the ratios in the places of the words and take each text's evidence."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        ratios = _unpack(next(t for t in texts.column("__told").to_pylist() if t is not None), "<f8").copy()
        for own, packed in zip(found.column("numbers").to_pylist(), found.column("ratios").to_pylist()):
            ratios[_unpack(own)] = _unpack(packed, "<f8")
        kind = _number_type(len(ratios))
        rows = [evidence(ratios[_unpack(n, kind)], window) for n in texts.column("__numbers").to_pylist()]
        columns = np.array(rows, dtype=float).reshape(-1, len(FEATURES)).T
        return pa.table(
            {c: texts.column(c) for c in keep}
            | {f"__{f}": pa.array(np.ascontiguousarray(c)) for f, c in zip(FEATURES, columns)}
        )

    return run


def features(
    rows: DataFrame,
    keep: Sequence[str],
    text_col: str,
    ratios: tuple[DataFrame, DataFrame],
    history: int,
    window: int,
    block_chars: int = BLOCK_CHARS,
    table_entries: int = TABLE_ENTRIES,
) -> DataFrame:
    """`keep` columns and the FEATURES of each row; ratios: see log_ratios."""
    contexts = staged(context_ratios(*ratios), "contexts")
    return features_by(rows, keep, text_col, contexts, history, window, block_chars, table_entries)


def features_by(
    rows: DataFrame,
    keep: Sequence[str],
    text_col: str,
    contexts: DataFrame,
    history: int,
    window: int,
    block_chars: int = BLOCK_CHARS,
    table_entries: int = TABLE_ENTRIES,
) -> DataFrame:
    """features() by stored contexts (see context_ratios)."""
    spark = rows.sparkSession
    table = ratio_table(contexts, table_entries)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = least if table.complete else bucket_count(rows, text_col, least)
    shared = spark.sparkContext.broadcast(table)  # 16 bytes for each of at most `table_entries` entries
    kept = [rows.schema[c] for c in keep]
    told = [T.StructField(f"__{f}", T.DoubleType()) for f in FEATURES]
    schema = T.StructType(
        [
            *kept,
            *told,
            T.StructField("__block", T.LongType()),
            T.StructField("__numbers", T.BinaryType()),
            T.StructField("__told", T.BinaryType()),
            T.StructField("__parts", T.ArrayType(PART)),
        ]
    )
    out = T.StructType([*kept, *told])
    sent = rows.select(*dict.fromkeys([*keep, text_col]))  # a text that is kept is sent once
    cut = sent.mapInArrow(_blocks(keep, text_col, history, window, shared, buckets, block_chars), schema)
    if table.complete:  # then no text is open
        return cut.select(*out.names)
    blocks = staged(cut, "blocks")
    closed = blocks.filter(F.col("__block").isNull()).select(*out.names)
    parts = blocks.filter(F.col("__parts").isNotNull()).select(F.col("__block").alias("block"), F.inline("__parts"))
    grams = parts.select("bucket", "sizes", "words").groupBy("bucket").applyInArrow(
        _bucket_keys(history), "bucket int, key long"
    )
    found = (
        parts.groupBy("bucket")
        .cogroup(gram_ratios(grams, contexts).select(F.col("bucket").alias("of"), "key", "ratio").groupBy("of"))
        .applyInArrow(_bucket_ratios(history), "block long, numbers binary, ratios binary")
    )
    joined = (
        blocks.filter(F.col("__block").isNotNull())
        .select(*keep, "__block", "__numbers", "__told")
        .groupBy("__block")
        .cogroup(found.groupBy("block"))
        .applyInArrow(_reassemble(keep, window), out)
    )
    return closed.unionByName(joined)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method with a ridge penalty on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = np.diag([1e-6, *[penalty] * x.shape[1]])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return weights, float(w[0] - weights @ mean)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out, the others are counted, rows of 3 fit the curve."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4).cast("int")


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    keep_cols: Sequence[str] | None = None,
    history: int = HISTORY,
    window: int = WINDOW,
    fit_rows: int = FIT_ROWS,
    threshold: float = THRESHOLD,
    training: DataFrame | None = None,
) -> DataFrame:
    """`keep_cols` (default: the id), held_out, score and predicted for every row of `docs`.

    `training`: the documents whose labels are learnt (default: `docs`).
    """
    known = (
        labels.filter(F.col(label_col).cast("int").isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(label_col).cast("int").alias("__toxic"))
        .filter(fold("__id") != 2)
    )
    known = staged(known, "labels")
    texts = (docs if training is None else training).select(
        F.col(id_col).alias("__id"), F.col(text_col).alias("__text")
    )
    chosen = staged(known.filter(fold("__id") == 3).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows), "fit-rows")
    fits = F.broadcast(chosen.select(F.col("__id").alias("__fit")))  # at most `fit_rows` ids
    part = (F.col("__toxic") + F.when(F.col("__fit").isNotNull(), 2).otherwise(0)).alias("__part")
    learnt = known.join(fits, F.col("__id") == F.col("__fit"), "left").select("__id", part)
    # only texts that may have a label are shuffled to meet it
    counted = texts.filter(fold("__id") != 2).filter(membership(known, "__id")("__id")).join(learnt, "__id")

    def times(*parts: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part").isin(*parts), F.col("n"))), F.lit(0))

    grams = staged(
        counted.select("__text", "__part")
        .mapInArrow(_count_grams(history, 4), "key long, part int, n long")
        .groupBy("key")
        .agg(times(0, 2).alias("c0"), times(1, 3).alias("c1"), times(0).alias("u0"), times(1).alias("u1")),
        "grams",
    )
    # the rows that fit the curve are judged by models that have not counted them
    others = grams.filter("u0 + u1 > 0").select("key", F.col("u0").alias("c0"), F.col("u1").alias("c1"))
    fit_contexts = staged(context_ratios(*log_ratios(others, history)), "fit-ratios")
    fitted = texts.join(F.broadcast(chosen.select("__id")), "__id", "left_semi")
    judged = features_by(fitted, ["__id"], "__text", fit_contexts, history, window)
    one = F.min(F.struct(*(f"__{f}" for f in FEATURES))).alias("one")
    judged = judged.join(F.broadcast(chosen), "__id").groupBy("__id", "__toxic").agg(one)
    sample = judged.select("__toxic", "one.*").toArrow()  # at most `fit_rows` rows
    y = sample.column("__toxic").to_numpy().astype(float)
    x = np.column_stack([sample.column(f"__{f}").to_numpy() for f in FEATURES])
    if len(y) and 0 < y.sum() < len(y):
        weights, bias = fit_logistic(x, y)
        value = F.lit(float(bias))
        for name, w in zip(FEATURES, weights):
            value = value + F.lit(float(w)) * F.col(f"__{name}")
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(value, F.lit(700.0)), F.lit(-700.0))))
    else:
        chance = F.lit(float(y.mean()) if len(y) else 0.0)
    contexts = staged(context_ratios(*log_ratios(grams.select("key", "c0", "c1"), history)), "ratios")
    keep = [id_col, *(c for c in keep_cols or () if c not in (id_col, "held_out", "score", "predicted"))]
    return features_by(docs, keep, text_col, contexts, history, window).select(
        *keep,
        F.coalesce(fold(id_col) == 2, F.lit(False)).alias("held_out"),
        chance.alias("score"),
        (chance >= threshold).cast("int").alias("predicted"),
    )
