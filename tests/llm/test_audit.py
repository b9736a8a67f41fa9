"""The document-term matrix and the filter audit against plain counting."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kapspark.llm import filter_audit
from kapspark.llm.filter_audit import _unpack, audit, csr, document_flags, term_matrix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain_fails(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = WORDS.findall(t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        out.append({f for f, bad in fails.items() if bad})
    return out


def plain_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out = defaultdict(Counter)
    parts = {s or "" for *_, s in rows}
    for order in itertools.permutations("ABCDE"):
        for step in range(1, 6):
            for p in parts:
                out[p, "".join(order), step] = Counter()
    by_filter = Counter()
    for (i, _, source), fails in zip(rows, plain_fails(rows)):
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                cell = out[source or "", "".join(order), step]
                if f in fails:
                    cell["redundant" if gone else "removed"] += 1
                    cell["unique_fails"] += fails == {f}
                    if not gone:
                        by_filter[source or "", f] += 1
                        cell["good_lost"] += i in good
                        cell["toxic_lost"] += i in toxic
                    gone = True
                cell["kept"] += not gone
    for (p, order, step), cell in out.items():
        cell["shapley"] = by_filter[p, order[step - 1]]
    return {k: tuple(c[x] for x in COLUMNS) for k, c in out.items()}


def texts(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["word", "Other", "é", "x" * 50, "a\x0bb", "$5", "CAPS", "𝄞", "nbsp word"] + [f"w{k}" for k in range(300)]
    out = []
    for _ in range(n):
        some = rnd.sample(vocabulary, rnd.choice([3, 40, 300]))
        sep = rnd.choice([" ", "\n", "  ", "\t"])
        out.append(sep.join(rnd.choice(some) for _ in range(rnd.choice([0, 1, 150, 199, 200, 260]))))
    return out


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as part", "1 as failed")


@pytest.mark.parametrize("limits", [{}, {"block_chars": 900, "bucket_chars": 2000}])
def test_audit_against_plain_counting(spark, docs_of, limits):
    rnd = random.Random(5)
    rows = [(i, t, rnd.choice(["s1", "s2", None])) for i, t in enumerate(texts(60, 1))]
    rows += [(100 + i, rows[i % 9][1], "s2") for i in range(20)]
    rows += [(7, rows[7][1], "s1"), (None, rows[3][1], "s1"), (200, None, "s3"), (201, "", None), (202, "Z " * 30_000, "s3")]
    labels = [(rnd.choice([*range(60), 110, None]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(90)]
    docs = docs_of([(i, t, "en", s) for i, t, s in rows], extra=True).selectExpr("*", "'y' as part", "2 as failed", "3 as n_words")
    out = audit(docs, label_table(spark, labels), **limits).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in out}
    assert len(out) == len(got)
    assert got == plain_audit(rows, labels)


def test_the_matrix_holds_every_word_under_one_number(spark, docs_of):
    rows = list(enumerate(texts(40, 2))) + [(100, None), (101, "one")]
    matrix = term_matrix(docs_of(rows), ["doc_id"], block_chars=2000, bucket_chars=1500)
    listed = matrix.dictionary().collect()
    word_of = {r["word_id"]: r["word"] for r in listed}
    assert len(word_of) == len(listed) == len(set(word_of.values()))
    want = {i: Counter(WORDS.findall(t or "")) for i, t in rows}
    assert set(word_of.values()) == {w for c in want.values() for w in c}
    shards = matrix.shards.collect()
    assert len(shards) > 3  # words meet across shards
    got = {}
    for s in shards:
        ends = _unpack(s["row_ends"], "<i8")
        columns, counts = np.frombuffer(s["columns"], "<i8"), np.frombuffer(s["counts"], "<i4")
        for r, a, b in zip(s["rows"], [0, *ends[:-1]], ends):
            assert list(columns[a:b]) == sorted(columns[a:b])
            got[r["doc_id"]] = Counter({word_of[c]: int(n) for c, n in zip(columns[a:b], counts[a:b])})
    assert got == want


def test_flags_and_counts_of_documents(spark, docs_of):
    rows = [(i, t, "s") for i, t in enumerate(texts(30, 3))] + [(50, "a b a", None), (51, "a b a", "s")]
    out = {r["doc_id"]: r for r in document_flags(docs_of([(i, t, "en", s) for i, t, s in rows]), block_chars=3000).collect()}
    for (i, t, _), fails in zip(rows, plain_fails(rows)):
        words = WORDS.findall(t)
        assert (out[i]["n_words"], out[i]["n_distinct"]) == (len(words), len(set(words)))
        assert {f for k, f in enumerate("ABCDE") if out[i]["failed"] >> k & 1} == fails


def test_a_number_does_not_depend_on_the_blocks(spark, docs_of):
    rows = list(enumerate(texts(25, 4)))
    a = {tuple(r) for r in term_matrix(docs_of(rows), ["doc_id"], block_chars=500).dictionary().collect()}
    b = {tuple(r) for r in term_matrix(docs_of(rows).repartition(3), ["doc_id"]).dictionary().collect()}
    assert a == b


def test_an_empty_table(spark, docs_of):
    empty = docs_of([(1, "a")]).filter("doc_id < 0")
    assert audit(empty, label_table(spark, [(1, 1, 1)])).collect() == []
    one = audit(docs_of([(1, None)]), label_table(spark, [(1, 1, 1)]).filter("doc_id < 0")).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {"src1"}


def test_matrix_of_texts_without_words():
    words, ends, columns, counts = csr([b"", b" \n", b"a a b"])
    assert (words.to_pylist(), list(ends), list(columns), list(counts)) == ([b"a", b"b"], [0, 0, 2], [0, 1], [2, 1])
    assert [len(x) for x in csr([b""])] == [0, 1, 0, 0]


def test_a_hash_depends_on_the_word_alone():
    words = [b"a", b"b", b"ab", b"ba", b"a" * 64, b"a" * 65, b"a" * 500, "é".encode()] + [f"w{k}".encode() for k in range(5000)]
    one = filter_audit.word_hashes(pa.array(words, pa.large_binary()))
    other = filter_audit.word_hashes(pa.array([b"x", *reversed(words)], pa.large_binary()).slice(1))
    assert list(one) == list(other)[::-1] and len(set(one.tolist())) == len(words)
    spread = np.bincount((one % np.uint64(8)).astype(int), minlength=8)
    assert spread.min() > len(words) / 8 * 0.8


def test_facts_of_a_text():
    assert filter_audit.text_facts("É A\n".encode())["chars"] == 4
