"""The registered queries of the text operators: each reads whole tables and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlq.llm import (
    centroids,
    decontamination,
    fingerprints,
    license_scan,
    mixing,
    near_join,
    packing,
    quality_classifier,
    quality_rules,
    ranked_search,
    secrets,
    substring_dedup,
    tokens,
)
from crawlq.llm.common import documents
from crawlq.llm.oracles import ORACLES  # noqa: F401

QUERIES = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


@register
def op1_quality_classifier(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.quality_scores(documents(spark, sf_dir), labels)


@register
def op2_best_fit_packing(spark, sf_dir):
    return packing.packed_documents(documents(spark, sf_dir))


@register
def op3_substring_dedup(spark, sf_dir):
    found = substring_dedup.repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op4_ngram_jaccard_join(spark, sf_dir):
    return near_join.jaccard_join(documents(spark, sf_dir)).select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


@register
def op5_fingerprints(spark, sf_dir):
    return fingerprints.edit_likeness(documents(spark, sf_dir))


@register
def op6_token_counts(spark, sf_dir):
    return tokens.token_counts(documents(spark, sf_dir))


@register
def op7_secret_scan(spark, sf_dir):
    found = secrets.secrets(documents(spark, sf_dir))
    line = lambda spans: f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(strong, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in secrets.STRONG],
        F.expr(f"sha2({line('strong')}, 256)").alias("base_sha256"),
        F.expr(line("spans")).alias("spans"),
    )


@register
def op8_quality_rules(spark, sf_dir):
    judged = quality_rules.quality_rules(documents(spark, sf_dir))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@register
def op9_license_scan(spark, sf_dir):
    return license_scan.license_scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@register
def op10_mixing(spark, sf_dir):
    return mixing.mixed(documents(spark, sf_dir)).select(
        "doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled", "gap"
    )


def _benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@register
def op11_ranked_search(spark, sf_dir):
    return ranked_search.ranked_search(documents(spark, sf_dir), _benchmark(spark, sf_dir))


@register
def op12_decontamination(spark, sf_dir):
    return decontamination.decontamination(documents(spark, sf_dir), _benchmark(spark, sf_dir)).drop("n_near_items")


@register
def op13_centroid_clustering(spark, sf_dir):
    return centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
