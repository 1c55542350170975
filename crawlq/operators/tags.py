"""Pages as tag tables: one row per token, hidden ranges, visible tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlq.functions import html as H
from crawlq.functions.text import once


def page_tags(pages: DataFrame) -> DataFrame:
    """Rows `(page_id, pos, kind, tag, raw)`; the tokens of a page add up to the page."""
    return H.explode_tags(H.with_tags(pages).drop("url"), "tags")


def write_tags(pages: DataFrame, path: str) -> None:
    """Tokenise the pages once and keep `tags` instead of `html`, a row per page.

    Every job on pages takes what `read_tags` gives in their place and cuts no page itself. Pages stay where they are, so nothing is
    shuffled; a job reads the nested columns of tags that it needs.
    """
    H.with_tags(pages).write.parquet(path)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """The pages of `write_tags`, with `tags`."""
    return spark.read.parquet(path)


def tag_counts(pages: DataFrame) -> DataFrame:
    """Tokens per kind and tag over all pages, and how many pages have them."""
    # Names as one string each: distinct strings are found by hashing, distinct structs by comparing all.
    tagged = once(H.with_tags(pages).select("tags"), {"__names": "transform(tags, t -> concat(t.kind, ' ', t.tag))"})
    marked = """concat(transform(__names, x -> named_struct('name', x, 'n', 1, 'pages', 0)),
        transform(array_distinct(__names), x -> named_struct('name', x, 'n', 0, 'pages', 1)))"""
    rows = tagged.select(F.expr(f"explode_outer({marked})").alias("t")).where("t IS NOT NULL").select("t.*")
    counts = rows.groupBy("name").agg(F.sum("n").alias("n"), F.sum("pages").alias("n_pages"))
    kind, tag = F.substring_index("name", " ", 1), F.expr("substring(name, instr(name, ' ') + 1)")
    return counts.select(kind.alias("kind"), tag.alias("tag"), "n", "n_pages")


def hidden_ranges(pages: DataFrame) -> DataFrame:
    """Rows `(page_id, lo, hi)`: token ranges of the outermost hidden elements of each page."""
    spans = H.with_hidden_spans(H.with_tags(pages))
    rows = spans.select("page_id", F.size("tags").alias("n"), F.explode_outer("hidden_spans").alias("s"))
    rows = rows.where(F.col("s").isNotNull())
    return rows.select(
        "page_id", F.col("s.lo").alias("lo"), F.least(F.col("s.hi"), F.col("n") - F.lit(1)).alias("hi")
    )


def visible_tags(pages: DataFrame, *names: str) -> DataFrame:
    """Rows `(page_id, pos, kind, tag, raw)` of the visible elements with these names."""
    return H.select_tags(H.with_tags(pages).drop("url"), *names, visible=True)


def attr_items(tags: DataFrame, name: str, accept_empty: bool = True) -> DataFrame:
    """`(page_id, pos, item)`: attribute `name` of the given tag rows, raw value, in order.

    Emptiness is tested on the trimmed value; tags without the attribute give no row.
    """
    rows = once(tags, {"item": H.attr("raw", name)})
    keep = F.col("item").isNotNull() if accept_empty else F.col("item").rlike(r"\S")
    base = [c for c in ("base_url",) if c in tags.columns]
    return rows.where(keep).select("page_id", *base, "pos", "item")
