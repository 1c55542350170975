"""Streaming forms of the host scores and the fetch state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlq.operators.domains import dga_scores
from crawlq.operators.fetches import fetch_meta
from crawlq.sources import files


def dga_scores_stream(hosts: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Score host lines as they arrive and append them to parquet at `out`; no state."""
    writer = dga_scores(hosts).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: So many runs of one size are folded into one of the next.
FOLD = 8


def fetch_meta_stream(writes: DataFrame, out: str, checkpoint: str, available_now: bool = False, fold: int = FOLD) -> StreamingQuery:
    """Keep the state of every URL while writes arrive.

    Each micro-batch stores the URLs it changed as a run of one batch. Once `fold` runs of one size follow each other they are
    merged to one run with the newest row per URL, and so on: there are never more than `fold` runs of a size, a row is written
    again only once per size, and `read_fetch_meta` reads a number of runs that grows with the logarithm of the batches.
    A write counts however late it comes, so there is no watermark: state is never dropped.
    """
    writer = fetch_meta(writes).writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: store_changes(batch, batch_id, out, fold))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _runs(spark: SparkSession, out: str) -> list[tuple[int, int]]:
    """(first batch, last batch) of the finished runs that count, in order: those inside a merged run are left over from its making."""
    found = []
    for name in files.names(spark, out):
        if name.startswith("run-") and files.exists(spark, f"{out}/{name}/_SUCCESS"):
            found.append(tuple(map(int, name.split("-")[1:])))
    return [r for r in sorted(found) if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found)]


def _folder(out: str, first: int, last: int) -> str:
    return f"{out}/run-{first:012d}-{last:012d}"


def _newest(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("url", "batch")]
    newest = rows.groupBy("url").agg(F.max_by(F.struct(*columns, "batch"), "batch").alias("s"))
    return newest.select("url", "s.*")


def store_changes(batch: DataFrame, batch_id: int, out: str, fold: int = FOLD) -> None:
    """Store the changed rows of a micro-batch and merge runs that are due.

    A batch that comes again replaces its own run, or is left out where a merge has taken it up: it brings the same rows. A merge that broke
    off is done again, and what it replaced is deleted only after it is whole.
    """
    spark = batch.sparkSession
    if any(first <= batch_id <= last and first < last for first, last in _runs(spark, out)):
        return
    rows = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
    # One file for what changed in one batch, unless that is much; the stateful plan has a file per state partition.
    rows.hint("rebalance").write.mode("overwrite").parquet(_folder(out, batch_id, batch_id))
    schema, span = rows.schema, 1
    while True:
        runs = _runs(spark, out)
        due = [r for r in runs if r[1] - r[0] + 1 == span]
        if len(due) < fold or due[fold - 1][1] - due[0][0] + 1 != span * fold:
            break
        due = due[:fold]
        paths = [_folder(out, *r) for r in due]
        _newest(spark.read.schema(schema).parquet(*paths)).write.mode("overwrite").parquet(_folder(out, due[0][0], due[-1][1]))
        for path in paths:
            files.remove(spark, path)
        span *= fold


def read_fetch_meta(spark: SparkSession, out: str) -> DataFrame:
    """The current state per URL from the runs `fetch_meta_stream` wrote."""
    return _newest(spark.read.parquet(*[_folder(out, *r) for r in _runs(spark, out)])).drop("batch")
