"""Content-addressed archive of captured fetches.

An archive grows by runs. Each run adds the bodies that no run before it stored, and a reference for every part of every fetch; it counts once its
manifest stands in `manifests`, which is the last thing it writes. What a broken run left is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlq.sources import files

REFS = "url string, part string, sha1 string, run int"
BLOBS = "sha1 string, body string, prefix string"


def _items(fetches: DataFrame) -> DataFrame:
    """`(url, part, body)` for the content, headers and meta of each fetch."""
    parts = [F.struct(F.lit("content").alias("part"), F.coalesce("html", F.lit("")).alias("body"))]
    if "headers" in fetches.columns:
        # Keys in order, so that equal headers give equal text and one blob.
        ordered = F.map_from_entries(F.sort_array(F.map_entries("headers")))
        parts.append(F.struct(F.lit("header").alias("part"), F.to_json(ordered).alias("body")))
    if "meta" in fetches.columns:
        parts.append(F.struct(F.lit("meta").alias("part"), F.to_json("meta").alias("body")))
    return fetches.select("url", F.inline(F.array(*parts))).where(F.col("body").isNotNull())


def archive_refs(fetches: DataFrame) -> DataFrame:
    """`(url, part, sha1)`: which body each URL points at."""
    return _items(fetches).select("url", "part", F.sha1(F.col("body").cast("binary")).alias("sha1"))


def archive_blobs(fetches: DataFrame) -> DataFrame:
    """`(sha1, body)`, one row per distinct body.

    Equal bodies collapse before the shuffle, by hash and without sorting them, so a page copied everywhere
    moves once per task. The key decides the body, so distinct pairs are distinct keys.
    """
    keyed = _items(fetches).select(F.sha1(F.col("body").cast("binary")).alias("sha1"), "body")
    return keyed.distinct()


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(run, folder) of every finished run, in order."""
    found = []
    for name in files.names(spark, f"{path}/manifests"):
        if name.endswith(".json"):
            number, folder = name.removesuffix(".json").split("-", 1)
            found.append((int(number), folder))
    return sorted(found)


def write_archive(fetches: DataFrame, path: str) -> int:
    """Add fetches to the archive at `path`, which may be new; returns the number of the run.

    Bodies that are there already are found by key, on thin rows, and not written again. New ones are laid out in folders by the first two digits of
    their key; those of a folder come together before the write, so a folder gets one file a run, or a few where it is large. The last
    step publishes the manifest. A run that breaks off before leaves the archive as it was; of two runs at one time that want the same
    number at most one stays, the others raise and can be repeated.
    """
    spark = fetches.sparkSession
    done = _manifests(spark, path)
    run, folder = (done[-1][0] + 1 if done else 0), uuid.uuid4().hex
    archive_refs(fetches).write.parquet(f"{path}/refs/{folder}")
    blobs = archive_blobs(fetches)
    if done:
        blobs = blobs.join(_blobs(spark, path, done).select("sha1"), "sha1", "left_anti")
    blobs = blobs.withColumn("prefix", F.substring("sha1", 1, 2))
    blobs.hint("rebalance", "prefix").write.partitionBy("prefix").parquet(f"{path}/blobs/{folder}")
    files.publish(spark, f"{path}/manifests/{run:08d}-{folder}.json", json.dumps({"run": run, "folder": folder}))
    if len([n for n, _ in _manifests(spark, path) if n == run]) > 1:
        files.remove(spark, f"{path}/manifests/{run:08d}-{folder}.json")
        raise FileExistsError(f"run {run} of {path}")
    return run


def _blobs(spark: SparkSession, path: str, runs: list[tuple[int, str]]) -> DataFrame:
    """The bodies of runs; keys that two runs stored at one time appear twice, with equal bodies."""
    rows = [spark.read.schema(BLOBS).parquet(f"{path}/blobs/{folder}").select("sha1", "body", F.lit(run).alias("run")) for run, folder in runs]
    return _together(spark, rows, "sha1 string, body string, run int")


def _together(spark: SparkSession, rows: list[DataFrame], schema: str) -> DataFrame:
    whole = spark.createDataFrame([], schema)
    for one in rows:
        whole = whole.unionByName(one)
    return whole


def archive_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`(url, part, sha1, run)` of all references and `(sha1, body, run)` of all stored bodies, of finished runs."""
    runs = _manifests(spark, path)
    refs = [spark.read.schema("url string, part string, sha1 string").parquet(f"{path}/refs/{folder}").withColumn("run", F.lit(run)) for run, folder in runs]
    return _together(spark, refs, REFS), _blobs(spark, path, runs)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """`(url, part, body)` as the newest run that holds each part of a URL left it."""
    refs, blobs = archive_runs(spark, path)
    newest = refs.groupBy("url", "part").agg(F.max(F.struct("run", "sha1")).alias("r")).select("url", "part", "r.sha1")
    return newest.join(blobs.groupBy("sha1").agg(F.any_value("body").alias("body")), "sha1").select("url", "part", "body")
