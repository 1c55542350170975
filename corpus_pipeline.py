"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlq.llm import mixing, near_join, packing, quality_rules, secrets
from crawlq.llm.common import documents, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rejected = quality_rules.quality_rules(docs).where("NOT kept").select("doc_id", "text_key").distinct()
    return _without(docs, rejected)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    leads = near_join.jaccard_join(docs).where("lead").select("doc_id", "text_key").distinct()
    d, k = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit("")))).alias("d"), leads.alias("k")
    kept = d.join(k, F.expr("d.doc_id <=> k.doc_id AND d.__key = k.text_key"), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text replaced."""
    clean = secrets.redacted(docs, secrets.secrets(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by their calibrated probabilities."""
    drawn = mixing.mixed(docs).where("NOT sampled").select("doc_id", "text_key").distinct()
    return _without(docs, drawn)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.packed_documents(docs)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose id and text are not in `gone`."""
    d, g = docs.alias("d"), gone.alias("g")
    same = F.expr("d.doc_id <=> g.doc_id AND xxhash64(coalesce(d.text, '')) = g.text_key")
    return d.join(g, same, "left_anti").select(*COLUMNS)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", distinct),
    ("secret scans", redact),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: No SQL: digests of 64 bits and token ids have no counterpart there; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
