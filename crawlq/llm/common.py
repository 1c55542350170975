"""What the text operators share: reading columns safely, words as SQL text, sizes, materialised tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlq.functions.text import literal
from crawlq.runtime import scratch_folder

#: The characters that separate words: blank, tab, newline, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under the operator's own names, so that further columns cannot clash.

    `only(docs, doc_id="id", text="body")` renames; a null text becomes empty.
    """
    picked = []
    for name, column in columns.items():
        value = df[column]
        picked.append((F.coalesce(value.cast("string"), F.lit("")) if name == "text" else value).alias(name))
    return df.select(*picked)


def words(text: str) -> str:
    """SQL text for the array of words of `text`: runs of anything but SPACES."""
    trimmed = f"btrim({text}, {literal(SPACES)})"
    return f"CASE WHEN {trimmed} = '' THEN array() ELSE split({trimmed}, {literal('[' + SPACES + ']+')}) END"


def row_key(text: str = "text") -> Column:
    """Tells texts under one id apart; equal rows share it."""
    return F.xxhash64(text)


def text_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column, from one scan that returns a single row."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def parts_for(total: int, per_part: int, least: int = 1) -> int:
    """How many parts keep each of them near `per_part`."""
    return max(least, math.ceil(total / per_part))


#: A key counts as hot when it holds more than this fraction of the rows, so there are never more than HOT of them.
HOT = 1_000


def hot_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """The values of `keys` that more than one in HOT of all rows hold, at least two, with their number `copies`: HOT rows at most."""
    total = rows.count()
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > max(1, total / HOT))


def hot_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of `rows` with a table that holds each key once, where a single key may stand in a third of the rows.

    The table's rows of hot keys, HOT at most, are broadcast, so rows that hold them stay where they are; the others meet in a shuffle,
    none of them in large groups. `rows` is read three times and should be a thin written table. Null keys join nothing.
    """
    hot = stored(hot_keys(rows.where(F.col(key).isNotNull()), key).select(key))
    few = stored(table.join(F.broadcast(hot), key, "left_semi"))
    usual = rows.join(F.broadcast(hot), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(few), key).unionByName(usual)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` as Parquet to the shared checkpoint storage and read it back.

    Cuts lineage like a checkpoint, in compressed columns, and survives lost executors.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
