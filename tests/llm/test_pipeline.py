"""The pipeline stage by stage, and the registry of queries."""

from __future__ import annotations

import random
import re
import struct
import subprocess
import sys
from hashlib import sha256
from pathlib import Path

import corpus_pipeline
import pytest
import tiktoken
from test_dedup import ascii_lower, brute_fingerprint

from kapspark.llm import queries, toxicity
from kapspark.llm.bpe import load_ranks

REPO = Path(__file__).resolve().parents[2]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture()
def sf_dir(spark, tmp_path, docs_of):
    rnd = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        words = ["".join(rnd.choice(["ba", "ko", "mi", "re", "tu", "sa"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(30, 80))]
        if i % 3 == 0:
            for k in range(0, len(words), 9):
                words[k] = "vexor" + rnd.choice(["ba", "ko"])
        rows.append((i, " ".join(words), rnd.choice(["en", "de"]), f"src{i % 20}"))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(1000 + i, rows[1][1].upper(), "en", "src0") for i in range(30)]  # copies
    long = " ".join(f"ba{'ko' * (k % 7)}mi{k}" for k in range(900))
    rows += [(2000 + i, long.replace(f"mi{i + 100}", "other"), "en", "src0") for i in range(8)]  # near copies
    rows += [(3000, None, None, None), (3001, "", "en", "src1"), (1, rows[1][1], rows[1][2], rows[1][3])]
    docs_of(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.shared.staged(stage(spark, docs, sf_dir), name)
        left[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == COLUMNS
    clean = {r["doc_id"] for r in left["toxicity"]}
    toxic = {i for i in range(240) if i % 3 == 0}
    assert len(toxic & clean) <= 2 and len(clean & set(range(240)) - toxic) >= 158
    assert {3000, 3001} <= clean and 1029 in clean
    exact = [r["doc_id"] for r in left["exact_dedup"]]
    assert len(exact) == len(set(exact)) and 1029 in exact and not {1, *range(1000, 1029)} & set(exact)
    assert {3001} == {3000, 3001} & set(exact)
    near = [r["doc_id"] for r in left["simhash"]]
    assert [i for i in near if 2000 <= i < 2008] == [2000] and set(near) <= set(exact)
    assert len(set(exact) - set(near)) < 12
    words = lambda rows: sum(len(re.findall(r"\S+", r["text"] or "")) for r in rows)
    target = queries.MIX.share * words(left["simhash"])
    assert 0.7 * target <= words(left["mixing"]) <= target
    assert sorted(r["doc_id"] for r in left["bpe"]) == sorted(r["doc_id"] for r in left["mixing"])


def row_key(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr)


def plain_exact(rows):
    """Of equal texts (A-Z as a-z) the row with the largest id."""
    best = {}
    for r in rows:
        t = ascii_lower(r["text"])
        if t not in best or (r["doc_id"] is not None and (best[t]["doc_id"] is None or r["doc_id"] > best[t]["doc_id"])):
            best[t] = r
    return list(best.values())


def plain_near(rows):
    """Of fingerprints linked within four bits, over any number of links, the row with the smallest id."""
    prints = [brute_fingerprint(r["text"] or "") for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    best = {}
    for r, group in zip(rows, label):
        if group not in best or r["doc_id"] < best[group]["doc_id"]:
            best[group] = r
    return list(best.values())


def plain_mixture(rows):
    """The registered query's SQL over the given rows: a row for each epoch that takes it."""
    import duckdb
    import pyarrow as pa

    documents = pa.Table.from_pylist([r.asDict() for r in rows], schema=pa.schema([(c, t) for c, t in zip(COLUMNS, (pa.int64(), *[pa.string()] * 3, pa.int64()))]))
    db = duckdb.connect()
    db.register("documents", documents)
    by_id = {r["doc_id"]: r for r in rows}
    return [by_id[i] for (i,) in db.sql(f"SELECT doc_id FROM ({queries.mixing_sql(queries.MIX)})").fetchall()]


def plain_tokens(rows):
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for r in rows:
        ids = coder.encode_ordinary(r["text"] or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        out.append((r["doc_id"], len(ids), sha256(packed).hexdigest(), sha256((r["text"] or "").encode()).hexdigest()))
    return sorted(out)


def test_the_pipeline_row_by_row(spark, sf_dir):
    """Every stage on what its plain predecessor kept; of toxicity the model's own decisions are taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, labels, keep_cols=COLUMNS).collect()
    rows = [r for r in scored if not r["predicted"]]
    assert len(scored) == docs.count() and 0 < len(rows) < len(scored)
    spark_docs = docs
    plain = {"toxicity": lambda _: rows, "exact_dedup": plain_exact, "simhash": plain_near, "mixing": plain_mixture}
    kept = scored
    for name, stage in corpus_pipeline.STAGES[:-1]:
        spark_docs = corpus_pipeline.shared.staged(stage(spark, spark_docs, sf_dir), name)
        kept = plain[name](kept)
        assert row_key(spark_docs.collect()) == row_key(kept), name
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect())) == plain_tokens(kept)


def test_the_pipeline_of_an_empty_table(spark, sf_dir, tmp_path, docs_of):
    empty = tmp_path / "empty"
    docs_of([(1, "a")]).filter("doc_id < 0").write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_the_pipeline_with_clashing_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ("kept", "key", "id", "fp", "n", "size", "score", "predicted", "epoch", "shard", "block", "toxic", "node", "tokens")
    extra = docs.selectExpr("*", *[f"'x' as {c}" for c in names])
    extra.write.parquet(str(tmp_path / "extra" / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "extra" / "labels.parquet"))
    rows = lambda d: sorted(map(tuple, corpus_pipeline.run(spark, str(d)).collect()))
    assert rows(tmp_path / "extra") == rows(sf_dir)


def test_every_operator_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_the_entry_works_without_this_subpackage(tmp_path):
    code = (
        "import re, sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('kapspark.llm'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'form_lines' in q and 'pipeline' not in q and not any(re.match('op[0-9]', n) for n in q)\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
