"""Sources: pages, host lines and TLD lists."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlq.functions.text import strip
from crawlq.sources import files as storage

#: Parts of a scan of page files that one task reads at most.
PARTS_PER_TASK = 32


def read_pages(spark: SparkSession, path: str, fmt: str = "html", **options: str) -> DataFrame:
    """Pages as `(page_id, url, html)`.

    `html` reads one file per page (the file path is its URL, the id a 64-bit hash of it, so give
    billions of files ids of their own); any other format is a table that has the three columns.
    `options` go to Spark's reader.
    """
    if fmt != "html":
        return spark.read.options(**options).format(fmt).load(path).select("page_id", "url", "html")
    with storage.listing_by_cores(spark):
        files = spark.read.options(**options).text(path, wholetext=True)
    pages = files.select(
        F.xxhash64(F.col("_metadata.file_path")).alias("page_id"),
        F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("html"),
    )
    # Spark counts the opening of a small file as megabytes, which makes a task of a few pages; parts are put together where each core has several tasks.
    parts, least = pages.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism
    return pages.coalesce(max(least, math.ceil(parts / PARTS_PER_TASK))) if parts > least else pages


def write_pages(pages: DataFrame, folder: str) -> None:
    """Write `(page_id, html)` below a new folder, every row as a file that ends with a line end and has `page_id=<id>` in its path."""
    if storage.local_path(pages.sparkSession, folder) is None:
        pages.write.partitionBy("page_id").option("maxRecordsPerFile", 1).text(folder)
        return
    # The id of no page is named as Spark names it.
    name = F.concat(F.lit("page_id="), F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    body = F.concat(F.coalesce("html", F.lit("")), F.lit("\n")).cast("binary")
    storage.write_local(pages.select(name.alias("name"), body.alias("body")), folder)


def host_lines(lines: DataFrame) -> DataFrame:
    """`value` lines as `(host)`, whitespace stripped."""
    return lines.select(F.expr(strip("value")).alias("host"))


def read_hosts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One host per line, as a batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    return host_lines(reader.text(path))


def tld_lines(lines: DataFrame) -> DataFrame:
    """`value` lines as distinct lower-case `(tld)`; blank lines and `#` lines are skipped."""
    tld = lines.select(F.expr(f"lower({strip('value')})").alias("tld"))
    return tld.where((F.col("tld") != "") & ~F.col("tld").startswith("#")).distinct()


def read_tlds(spark: SparkSession, path: str) -> DataFrame:
    """A top-level-domain list; a missing file raises."""
    return tld_lines(spark.read.text(path))


def tld_check(hosts: DataFrame, tlds: DataFrame, known: bool = True) -> DataFrame:
    """Hosts whose last label is (not) in the list.

    No broadcast hint: the planner broadcasts the list when its measured size allows
    it and otherwise splits a hot label as a skewed join.
    """
    keyed = hosts.withColumn("tld", F.lower(F.substring_index("host", ".", -1)))
    return keyed.join(tlds, "tld", "left_semi" if known else "left_anti").select("host", "tld")
