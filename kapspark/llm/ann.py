"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors of length one are rotated by learned rotations (iterative quantisation,
fitted on at most ``FIT_ROWS`` vectors by hash order) and cut to their signs, one bit for
each dimension and rotation. A code is split into substrings of ``SUB_BITS`` bits. If two
codes differ in at most r bits, the pigeonhole principle says that one of the m substrings
differs in at most r // m bits: so the codes that pass in some substring hold every code
within radius r. Which values of a substring lie within r // m of a query's is a table of
256 entries, and every row of a cell is looked up in it: there is no stored index by value.
With a radius that keeps the neighbours of vectors without much structure nearly all rows
pass, so there the search is in effect a scan of all codes. What passes is checked for the
radius by the whole codes and ranked by the cosine of the original vectors in double precision.

The radius comes from the fit: ``TARGET`` of the true nearest neighbours in the sample lie
within it. In the whole table neighbours are nearer than in the sample, so the share found
there is higher. A query with fewer than k neighbours inside the radius is asked again
with the radius of the whole code, so it gets k whenever there are k candidates.

Rows are dealt by a hash of the id into blocks of about ``ROW_BLOCK``, queries into blocks
of about ``QUERY_BLOCK``. A cell of the grid holds one block of each;
nothing is broadcast but the rotations, and a cell's size is fixed. A cell returns k rows
for each query, and two levels of windows merge them.

Defined cases: rows with a null id, and vectors that are null, zero, of a length other than
the usual one or with null or non-finite components, take no part, neither as queries nor
as candidates; rows that repeat an id count once, with the smallest of its vectors; equal
scores go by the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

NEIGHBOURS = 5
ROTATIONS = 2
SUB_BITS = 8
FIT_ROWS = 8192
FIT_QUERIES = 512
FIT_STEPS = 30
TARGET = 0.98
ROW_BLOCK = 2048
QUERY_BLOCK = 1024
OUTPUT = "query_id long, vec_id long, score double, cell_row int"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>): rows that take part, one for each id."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(finite & some)
    rows = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("v"))
    return staged(rows, "vectors")


def usual_length(rows: DataFrame) -> int | None:
    """The most frequent length of the vectors (the smaller one of equals)."""
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sizes.n if sizes else None


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_rotation(x: np.ndarray, seed: int, steps: int = FIT_STEPS) -> np.ndarray:
    """A rotation after which signs lose little (iterative quantisation, all dimensions kept)."""
    d = x.shape[1]
    _, _, axes = np.linalg.svd(x.T @ x)
    turned = x @ axes.T
    start, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    for _ in range(steps):
        signs = np.where(turned @ start >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(turned.T @ signs)
        start = left @ right
    return axes.T @ start


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Substrings of the codes: rows x m, one byte each."""
    bits = np.concatenate([x @ r >= 0 for r in rotations], axis=1)
    spare = -bits.shape[1] % SUB_BITS
    if spare:
        bits = np.concatenate([bits, np.zeros((len(bits), spare), dtype=bool)], axis=1)
    return np.packbits(bits, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of one code to many."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def fit(sample: np.ndarray, k: int = NEIGHBOURS, rotations: int = ROTATIONS, target: float = TARGET) -> tuple[np.ndarray, int]:
    """Rotations, and the radius that holds `target` of the sample's k nearest neighbours."""
    x = unit(sample)
    learnt = np.stack([learn_rotation(x, seed) for seed in range(rotations)])
    code = codes(x, learnt)
    found = []
    for i in range(min(FIT_QUERIES, len(x))):
        near = x @ x[i]
        near[i] = -2
        best = np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]
        found.append(hamming(code[best], code[i]))
    distances = np.concatenate(found) if found else np.zeros(0)
    width = code.shape[1] * SUB_BITS
    return learnt, int(np.quantile(distances, target, method="higher")) if len(distances) else width


# near[t][a, b]: bytes a and b differ in at most t bits
BYTE_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def probe(index: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """Rows within `radius` of the query's code: pigeonhole probing, then the whole code.

    index: m x rows, the bucket of each row in each of the m indexes.
    """
    reach = radius // len(index)
    buckets = BYTE_DISTANCE <= reach
    hit = np.zeros(index.shape[1], dtype=bool)
    for values, own in zip(index, query):
        hit |= buckets[own][values]
    rows = np.flatnonzero(hit)
    return rows[hamming(index[:, rows].T, query) <= radius]


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal vectors get equal bits."""
    q = query / np.abs(query).max()
    r = rows / np.abs(rows).max(axis=1, keepdims=True)
    dots = (r * q).sum(axis=1)
    return dots / (np.sqrt((q * q).sum()) * np.sqrt((r * r).sum(axis=1)))


def _vectors(table: pa.Table, id_col: str, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column(id_col).to_numpy()
    flat = table.column(vec_col).combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return ids, flat.flatten().to_numpy().reshape(len(ids), -1)


def _search_cell(learnt, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rotations = learnt.value
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and rows.num_rows:
            q_ids, q = _vectors(queries, "q_id", "q_v")
            ids, x = _vectors(rows, "id", "v")
            order = np.argsort(ids)  # equal scores then stand in the order of their ids
            ids, x = ids[order], x[order]
            index = np.ascontiguousarray(codes(unit(x), rotations).T)
            q_codes = codes(unit(q), rotations)
            radii = queries.column("q_radius").to_numpy()
            for i in range(len(q_ids)):
                near = probe(index, q_codes[i], int(radii[i]))
                near = near[ids[near] != q_ids[i]]
                scores = cosine(q[i], x[near]) if len(near) else np.zeros(0)
                best = np.argsort(-scores, kind="stable")[:k]
                out.append((np.full(len(best), q_ids[i]), ids[near[best]], scores[best]))
        parts = [np.concatenate(c) if out else np.zeros(0) for c in zip(*out)] if out else [np.zeros(0)] * 3
        number = rows.column("cell_row")[0].as_py() if rows.num_rows else 0
        return pa.table(
            {
                "query_id": pa.array(parts[0].astype(np.int64)),
                "vec_id": pa.array(parts[1].astype(np.int64)),
                "score": pa.array(parts[2].astype(np.float64)),
                "cell_row": pa.array(np.full(len(parts[0]), number, dtype=np.int32)),
            }
        )

    return run


def _top(found: DataFrame, k: int, *within: str) -> DataFrame:
    order = Window.partitionBy("query_id", *within).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(rows: DataFrame, queries: DataFrame, row_blocks: int, query_blocks: int, learnt, k: int) -> DataFrame:
    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cell_rows = rows.select("id", "v", block(row_blocks).alias("cell_row"), all_of(query_blocks).alias("cell_query"))
    # names of their own: both sides come from one table
    cell_queries = queries.select(
        F.col("id").alias("q_id"),
        F.col("v").alias("q_v"),
        F.col("radius").alias("q_radius"),
        block(query_blocks).alias("cell_query"),
        all_of(row_blocks).alias("cell_row"),
    )
    found = (
        cell_queries.groupBy("cell_row", "cell_query")
        .cogroup(cell_rows.groupBy("cell_row", "cell_query"))
        .applyInArrow(_search_cell(learnt, k), OUTPUT)
    )
    groups = math.isqrt(row_blocks) + 1
    first = _top(found.withColumn("part", F.col("cell_row") % groups), k, "part")
    return _top(first, k).select("query_id", "rank", "vec_id", "score")


def nearest(
    df: DataFrame,
    query: Column,
    k: int = NEIGHBOURS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    rotations: int = ROTATIONS,
    fit_rows: int = FIT_ROWS,
    target: float = TARGET,
    row_block: int = ROW_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score for the rows of `df` whose `id` fulfils `query`.

    `query` is a condition on the column ``id``.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    length = usual_length(rows)
    rows = rows.filter(F.size("v") == (length or 0))
    queries = rows.filter(query)
    total, asked = rows.count(), queries.count()
    if not total or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").toArrow().column("v")
    flat = pa.chunked_array(sample.chunks).combine_chunks()
    flat = flat.flatten().to_numpy().reshape(-1, length)
    learnt, radius = fit(flat, k, rotations, target)
    shared = spark.sparkContext.broadcast(learnt)  # rotations x length x length
    row_blocks, query_blocks = -(-total // row_block), -(-asked // query_block)
    bits = -(-rotations * length // SUB_BITS) * SUB_BITS
    first = staged(
        _search(rows, queries.withColumn("radius", F.lit(radius)), row_blocks, query_blocks, shared, k), "neighbours"
    )
    # queries that still lack neighbours look through the whole radius
    enough = first.groupBy("query_id").count().filter(F.col("count") >= min(k, total - 1)).select(F.col("query_id").alias("id"))
    short = staged(queries.join(enough.hint("shuffle_merge"), "id", "left_anti").withColumn("radius", F.lit(bits)), "short")
    missing = short.count()
    if not missing or total == 1:
        return first
    again = _search(rows, short, row_blocks, -(-missing // query_block), shared, k)
    done = first.join(short.select(F.col("id").alias("query_id")).hint("shuffle_merge"), "query_id", "left_anti")
    return done.unionByName(again)
