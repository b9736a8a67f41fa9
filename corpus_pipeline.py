"""A corpus pipeline: toxic documents go, copies go, the mixture is set, texts become tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
result as Parquet in the shared folder and hands the stored table to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from kapspark.llm import bpe, exact_dedup, mixing, queries, shared, simhash, toxicity
from kapspark.llm.bloom import membership

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    A score depends on the text alone, so only ids and text hashes go with the scores;
    rows that are certainly not on the list of rejected ones pass straight through.

    Null texts count as empty and are judged like others; a null id is a row without a label;
    repeated rows go or stay together; without labels of both classes all have one score; an
    empty table gives none. Columns beyond the five of documents are left out.
    """
    named = docs.withColumn("__text_hash", F.xxhash64("text"))
    scored = toxicity.score(named, shared.table(spark, sf_dir, "labels"), keep_cols=["__text_hash"])
    go = scored.filter("predicted = 1").select(F.col("doc_id").alias("__go_id"), F.col("__text_hash").alias("__go_hash"))
    go = shared.staged(go.distinct(), "rejected")
    may_go = membership(go, "__go_id", "__go_hash")("doc_id", "__text_hash")
    doubted = named.filter(may_go)
    same = doubted["doc_id"].eqNullSafe(go["__go_id"]) & (doubted["__text_hash"] == go["__go_hash"])
    return named.filter(~may_go).unionByName(doubted.join(go, same, "left_anti")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to A-Z and a-z) the document with the largest id stays.

    Null and empty texts are one group; of repeated rows one stays; an empty table gives none.
    """
    return exact_dedup.deduplicate(docs).filter("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints the one with the smallest id stays.

    Texts without words have the fingerprint zero and are linked like others; a row without an
    id stays only where no linked row has one; an empty table gives none.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights; a document stands there once for each epoch that takes it.

    Null languages and sources are leaves of their own ("unknown"); a document without words costs
    nothing and follows its leaf's order; an empty table gives none.
    """
    return mixing.mix_sources(docs, queries.MIX).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes for each row.

    Null texts have no tokens; repeated rows give a row each; an empty table gives none.
    """
    return bpe.round_trip(docs, queries.RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", exact),
    ("simhash", near),
    ("mixing", mixture),
    ("bpe", tokens),
]

# Learned scores, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.staged(stage(spark, docs, sf_dir), name)
    return docs
