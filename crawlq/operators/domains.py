"""Scores for random-looking host names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.functions.text import once

# The vowels (lower case only) and the guard against division by zero.
VOWELS = "aeiou"
TINY = 1e-307


def _count(chars: str) -> str:
    return f"(length(__body) - length(translate(__body, '{chars}', '')))"


def dga_scores(hosts: DataFrame, host: str = "host") -> DataFrame:
    """The table with `ratio_nonvowel` and `ratio_total` of all labels but the last.

    Narrow and stateless, so it runs the same on a stream of host lines.
    """
    labels = f"split({host}, '[.]')"
    hosts = once(hosts, {"__body": f"array_join(slice({labels}, 1, size({labels}) - 1), '')"})
    vowels, dashes = _count(VOWELS), _count("-")
    return hosts.withColumns(
        {
            "ratio_nonvowel": F.expr(f"{vowels} / (CAST(length(__body) - {vowels} - {dashes} AS DOUBLE) + {TINY}D)"),
            "ratio_total": F.expr(f"{vowels} / (CAST(length(__body) - {dashes} AS DOUBLE) + {TINY}D)"),
        }
    ).drop("__body")


def dga_site_summary(hosts: DataFrame, threshold: float, host: str = "host") -> DataFrame:
    """Per suffix (last label): distinct hosts, how many score below the threshold, mean score."""
    scored = dga_scores(hosts.select(F.col(host).alias("host")).distinct())
    return scored.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(
        F.count(F.lit(1)).alias("n_hosts"),
        F.count_if(F.col("ratio_total") < threshold).alias("n_suspect"),
        F.avg("ratio_total").alias("avg_ratio_total"),
    )


def dga_lowest(hosts: DataFrame, n: int, host: str = "host") -> DataFrame:
    """The `n` distinct hosts with the lowest vowel ratio (a top-k report)."""
    scored = dga_scores(hosts.select(F.col(host).alias("host")).distinct())
    return scored.orderBy("ratio_total", "host").limit(n)
