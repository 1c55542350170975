"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of an edge; root is the smallest node of the component.

    Rounds alternate between hanging the larger neighbours of each node and the smaller ones on the smallest; they are few, as
    the depth of what is left halves each time. Each round is written out. Loops and repeated edges do no harm.
    """
    down = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    down = stored(down)
    before = None
    while True:
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(low, both["a"] == low["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        joined = large.join(least, large["a"] == least["n"])
        small = joined.select(F.expr("inline(array(struct(a AS x, m AS y), struct(b AS x, m AS y)))"))
        down = stored(small.where("x <> y").distinct().select(F.col("x").alias("a"), F.col("y").alias("b")))
        after = tuple(down.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if after == before:
            break
        before = after
    # Stable: every edge joins a node with its root.
    roots = down.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return down.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
