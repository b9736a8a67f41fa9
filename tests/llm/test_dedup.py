"""Exact dedup, SimHash, components and the Bloom filter against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kapspark.llm import exact_dedup, simhash
from kapspark.llm.components import components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(t):
    return (t or "").translate(str.maketrans(UPPER, UPPER.lower()))


def test_exact_dedup_on_edge_cases(docs_of):
    rows = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "ÄÖ"), (6, "äö"), (7, "x" * 200_000)]
    rows += [(8, "twin"), (8, "twin"), (None, "twin"), (9, "same  text")]
    out = exact_dedup.deduplicate(docs_of(rows, extra=True)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(ascii_lower(t).encode()).hexdigest()].append(i)
    assert len(out) == len(rows)
    for r in out:
        members = groups[r["text_sha256"]]
        assert r["keep_id"] == max((m for m in members if m is not None), default=None)
        assert r["group_size"] == len(members)
    # one row of each group stays, repeated rows included
    assert sorted((r["text_sha256"] for r in out if r["kept"])) == sorted(groups)
    assert {r["doc_id"] for r in out if r["kept"]} == {2, 4, 5, 6, 7, 8, 9}


def test_exact_dedup_of_an_empty_table(docs_of, spark):
    empty = docs_of([(1, "a")]).filter("doc_id < 0")
    assert exact_dedup.deduplicate(empty).collect() == []


def test_a_full_filter_costs_rows_not_results(docs_of):
    rnd = random.Random(3)
    rows = [(i, f"text {rnd.randint(0, 900)}") for i in range(1500)]
    small = exact_dedup.deduplicate(docs_of(rows), max_filter_bits=1 << 16).collect()
    flagged = exact_dedup.flag_repeated(docs_of(rows), "text", ["doc_id"]).collect()
    times = defaultdict(int)
    for _, t in rows:
        times[t] += 1
    want = {i for i, t in rows if i == max(j for j, u in rows if u == t)}
    assert {r["doc_id"] for r in small if r["kept"]} == want
    # no repeated row is ever called unique, and few unique ones are called repeated
    by_id = dict(rows)
    assert all(r["__maybe"] for r in flagged if times[by_id[r["doc_id"]]] > 1)
    alone = [r["__maybe"] for r in flagged if times[by_id[r["doc_id"]]] == 1]
    assert sum(alone) <= 0.05 * len(alone)


def brute_fingerprint(text, words=4):
    parts = [w for w in ascii_lower(text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0bé c", max_size=60), max_size=5))
def test_fingerprints_against_brute_force(texts):
    got = simhash.fingerprints([t.encode() for t in texts])
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in texts]


def test_spark_hashes_shingles_alike(spark):
    words = ["a b c d", "é è", "", "x" * 100]
    df = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w) h")
    assert [r["h"] & (2**64 - 1) for r in df.collect()] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_one_mask_covers_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(range(64), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rnd = random.Random(radius)
    for _ in range(3000):
        bits = rnd.sample(range(64), rnd.randint(0, radius))
        diff = sum(1 << b for b in bits)
        assert any(not m & diff for m in masks)


def brute_components(values, radius):
    arr = np.array(values, dtype=np.uint64)
    label = list(range(len(arr)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1 :]) <= radius):
            a, b = root(i), root(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(arr))]


@pytest.mark.parametrize("bucket_rows", [3, 256])
def test_links_against_brute_force_with_crowded_buckets(spark, bucket_rows):
    rnd = random.Random(9)
    values = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 4, 60])):
            values.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))))
    chain = rnd.getrandbits(64)
    for b in range(0, 40, 4):  # a chain: each link within the radius, the ends far apart
        chain ^= 0b1111 << b
        values.add(chain)
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = components(simhash.links(df, 4, bucket_rows), "a", "b").collect()
    root = {r["node"]: r["root"] for r in got}
    want = brute_components(values, 4)
    groups, wanted = defaultdict(set), defaultdict(set)
    for v, w in zip(signed, want):
        groups[root.get(v, v)].add(v)
        wanted[w].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
    assert all(min(g) == r for r, g in groups.items())


def test_near_duplicates_end_to_end(docs_of):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200", "other")
    rows = [(10, base), (4, near), (7, base.upper()), (1, "quite another text than those"), (3, None), (2, ""), (None, base), (5, " \n ")]
    rows += [(1, "quite another text than those"), (20, "y " * 50_000)]
    out = simhash.near_duplicates(docs_of(rows, extra=True)).collect()
    assert len(out) == len(rows)
    found = {(r["doc_id"], r["component_id"]) for r in out}
    want_fp = {i: brute_fingerprint(t) for i, t in rows if i}
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in out if r["doc_id"]} == want_fp
    linked = bin(want_fp[10] ^ want_fp[4]).count("1") <= 4
    low = 4 if linked else 7
    assert (10, low) in found and (7, low) in found and (None, low) in found
    assert {(2, 2), (3, 2), (5, 2)} <= found
    kept = simhash.keep_one(docs_of(rows, extra=True))
    assert "shard" in kept.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == {r["component_id"] for r in out}
    assert simhash.near_duplicates(docs_of(rows).filter("doc_id < 0")).collect() == []


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(203, 201), (201, 202), (202, 203)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 201: 201, 202: 201, 203: 201}


def test_buckets_of_the_last_level_are_small():
    masks = simhash.covering_masks(range(simhash.BITS), simhash.RADIUS)
    for _ in range(simhash.LEVELS - 1):
        masks = [m for group in simhash._masks_below(masks, simhash.RADIUS) for m in group]
    assert max(simhash.BITS - m.bit_count() for m in masks) <= 8
