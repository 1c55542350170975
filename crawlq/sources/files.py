"""Folders and small files on whatever storage Spark reads: listing, publishing, deleting."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Files that `write_local` puts in one folder: many, so that there are few folders, and not so many that one task lists most of them.
PER_FOLDER = 1_000


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, where = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


@contextmanager
def listing_by_cores(spark: SparkSession):
    """Inside, Spark lists many folders in a few tasks per core; its own way is a task per folder, up to 10,000."""
    usual = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(usual), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, usual)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not be there yet, all of it at once: a reader sees nothing or the whole."""
    fs, where = _path(spark, path)
    _, draft = _path(spark, f"{path}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(where) or not fs.rename(draft, where):
        fs.delete(draft, False)
        raise FileExistsError(path)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system knows it; none on any other storage."""
    fs, where = _path(spark, path)
    return fs.makeQualified(where).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def write_local(rows: DataFrame, folder: str) -> None:
    """Write each row of `(name string, body binary)` as a file of its own in folders below `folder`, on a local or mounted file system.

    Spark's writer starts a process for every folder, file and checksum file there; Python starts none. Names may repeat: each gets a
    number. Tasks write drafts, which readers skip; those of tasks that counted are published at the end, so no row is lost or doubled when a task is repeated.
    """
    spark, most = rows.sparkSession, PER_FOLDER
    top = local_path(spark, folder)
    drafts = f"{top}/_drafts"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, folders, n = TaskContext.get(), [], 0
        for batch in batches:
            for name, body in zip(*batch.columns, strict=True):
                if n % most == 0:
                    folders.append(f"{drafts}/{task.partitionId():05d}-{n // most:05d}-{task.taskAttemptId()}")
                    os.makedirs(folders[-1])
                with open(f"{folders[-1]}/{name.as_py()}-{n:07d}.txt", "xb") as file:
                    file.write(body.as_py())
                n += 1
        yield pa.RecordBatch.from_pydict({"folder": pa.array(folders, pa.string())})

    fs, where = _path(spark, folder)
    fs.mkdirs(where)
    for row in rows.mapInArrow(run, "folder string").collect():
        _, draft = _path(spark, f"file://{row.folder}")
        _, final = _path(spark, f"file://{top}/{os.path.basename(row.folder)}")
        if not fs.rename(draft, final):
            raise OSError(f"cannot publish {row.folder}")
    remove(spark, f"file://{drafts}")


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)
