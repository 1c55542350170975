"""Quality rules with thresholds that follow the data.

Each document gets a few counts. Instead of fixed cutoffs, every language and source has its own
thresholds, read from quantile sketches. A sketch is a histogram over 1,001 integer bins per
feature: two of them merge by adding counts, its size does not depend on the number of rows, and its
quantiles are exact to one bin. Many features are 0 in most documents, so a threshold comes from how often a feature occurs in a group at all and
from the quantiles of the documents where it does. Thresholds of a (language, source) with few documents lean on those of
the merged sketch of the language, and these on those of everything.

Everything is DataFrame and SQL functions. The only shuffles carry bin counts, combined before they
are moved, so a source with a third of all rows is 5,005 rows per task like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlq.functions.text import literal, once
from crawlq.llm.common import SPACES, only, stored, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Bin of each feature, 0 to 1000, growing with the feature; and how far above the median of the documents that have it the fence
#: stands at least, or above 0 where none has it. `length` maps a mean word length m to m / (m + 8).
FEATURES = {
    "symbols": ("CASE WHEN word_chars = 0 THEN 0 ELSE 1000 * n_symbols DIV word_chars END", 60),
    "dup_lines": ("CASE WHEN n_lines = 0 THEN 0 ELSE 1000 * n_dup_lines DIV n_lines END", 350),
    "repeats": ("CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_repeat_words DIV n_words END", 250),
    "runs": ("CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_run_words DIV n_words END", 300),
    "length": ("CASE WHEN n_words = 0 THEN 0 ELSE 1000 * word_chars DIV (word_chars + 8 * n_words) END", 150),
}
SPREAD = 6
#: Documents that a merged sketch counts for beside the group's own.
PRIOR = 50


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: doc_id, lang, source, text_key, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_run_words (equal to the word before), n_repeat_words, base_failed.

    A null or empty text has no words and fails the base rules. A text with fewer than eight words
    has no window. Repeated rows stay repeated.
    """
    df = only(docs, doc_id=doc_id, text=text, lang=lang, source=source).withColumn("text_key", F.xxhash64("text"))
    lines = f"filter(split(text, {literal(chr(10))}), line -> btrim(line, {literal(SPACES)}) <> '')"
    df = once(df, {"__words": words("text"), "__lines": lines})
    df = once(
        df,
        {
            "n_words": "CAST(size(__words) AS BIGINT)",
            "word_chars": f"CAST(length(translate(text, {literal(SPACES)}, '')) AS BIGINT)",
            "n_symbols": f"CAST(length(text) - length(translate(text, {literal(SYMBOLS)}, '')) AS BIGINT)",
            "n_lines": "CAST(size(__lines) AS BIGINT)",
            "n_dup_lines": "CAST(size(__lines) - size(array_distinct(__lines)) AS BIGINT)",
            "n_run_words": "CAST(size(filter(__words, (w, i) -> i > 0 AND w = __words[i - 1])) AS BIGINT)",
            "__windows": f"""CASE WHEN size(__words) < {WINDOW} THEN array()
                ELSE transform(sequence(1, size(__words) - {WINDOW - 1}), i -> xxhash64(slice(__words, i, {WINDOW}))) END""",
        },
    ).drop("text", "__words", "__lines")
    # Most texts repeat no window; only the others are sorted to find where the repeats stand.
    df = once(
        df,
        {
            "__sorted": """CASE WHEN size(array_distinct(__windows)) = size(__windows) THEN array()
                ELSE array_sort(transform(__windows, (h, i) -> struct(h, i))) END"""
        },
    ).drop("__windows")
    df = once(
        df,
        {
            "__at": """CASE WHEN size(__sorted) = 0 THEN array() ELSE array_sort(transform(
                filter(sequence(0, size(__sorted) - 1), j ->
                  (j > 0 AND __sorted[j - 1].h = __sorted[j].h)
                  OR (j < size(__sorted) - 1 AND __sorted[j + 1].h = __sorted[j].h)),
                j -> __sorted[j].i)) END"""
        },
    ).drop("__sorted")
    df = df.withColumn(
        "n_repeat_words",
        F.expr(f"""aggregate(__at, struct(0 AS until, CAST(0 AS BIGINT) AS n),
            (s, i) -> struct(i + {WINDOW} AS until, s.n + i + {WINDOW} - greatest(i, s.until) AS n), s -> s.n)"""),
    ).drop("__at")
    return df.withColumn(
        "base_failed",
        F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    )


def sketches(counted: DataFrame) -> DataFrame:
    """The mergeable sketch of every (lang, source): lang, source, feature, bin, n. Nulls are values of their own."""
    bins = ", ".join(f"struct({literal(name)} AS feature, CAST({bin_of} AS INT) AS bin)" for name, (bin_of, _) in FEATURES.items())
    rows = counted.select("lang", "source", F.expr(f"inline(array({bins}))"))
    return rows.groupBy("lang", "source", "feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches merged over everything but `keys`."""
    return sketch.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per `keys`: n_docs and the largest bin that passes for each feature.

    Among the documents that have the feature at all, the fence stands SPREAD times the distance from their lower decile to their median above the
    median, and the feature's slack above that; it uses only the lower half of those values. Between that and the slack alone, which is the fence where
    nobody has the feature, it stands by the square of the share of documents that have it. So a habit of a whole source raises its fence, and what a
    few documents do hardly moves it. Whole numbers throughout.
    """
    group = Window.partitionBy(*keys, "feature")
    ordered = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.withColumn("upto", F.sum("n").over(ordered)).withColumn("total", F.sum("n").over(group))
    ranked = ranked.withColumn("none", F.sum(F.when(F.col("bin") == 0, F.col("n")).otherwise(F.lit(0))).over(group))
    quantile = lambda q: F.min(F.when(F.expr(f"bin > 0 AND (upto - none) * 100 >= (total - none) * {q}"), F.col("bin")))
    per_feature = ranked.groupBy(*keys, "feature").agg(
        F.max("total").alias("n_docs"), F.max("none").alias("none"), quantile(50).alias("median"), quantile(10).alias("low")
    )
    slack = "CASE feature " + " ".join(f"WHEN {literal(k)} THEN {s}" for k, (_, s) in FEATURES.items()) + " END"
    above = f"coalesce(least(1000, median + {SPREAD} * (median - low) + {slack}) - {slack}, 0)"
    fence = F.expr(f"{slack} + ({above} * (n_docs - none) DIV n_docs) * (n_docs - none) DIV n_docs")
    return per_feature.groupBy(*keys).agg(
        F.max("n_docs").alias("n_docs"),
        *[F.max(F.when(F.col("feature") == name, fence)).alias(f"fence_{name}") for name in FEATURES],
    )


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row of fences per (lang, source) that occurs, its own and those of the language by their documents and `prior`; the language's likewise with all documents'."""
    own = fences(sketch, "lang", "source").alias("own")
    by_lang = fences(merged(sketch, "lang"), "lang").alias("l")
    every = fences(merged(sketch).withColumn("one", F.lit(1)), "one").alias("e")
    joined = own.join(by_lang, F.expr("own.lang <=> l.lang"), "left").withColumn("__one", F.lit(1))
    joined = joined.join(every, F.expr("__one = e.one"), "left")

    def blended(name: str):
        of_lang = f"((l.n_docs * l.{name} + {prior} * e.{name}) DIV (l.n_docs + {prior}))"
        return F.expr(f"(own.n_docs * own.{name} + {prior} * {of_lang}) DIV (own.n_docs + {prior})").alias(name)

    return joined.select(F.col("own.lang").alias("lang"), F.col("own.source").alias("source"), F.col("own.n_docs").alias("n_docs"), *[blended(f"fence_{f}") for f in FEATURES])


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Counts with the verdict `kept`, by a join with the thresholds of the document's language and source."""
    passes = " AND ".join(f"({bin_of}) <= fence_{name}" for name, (bin_of, _) in FEATURES.items())
    c, t = counted.alias("c"), limits.alias("t")
    joined = c.join(t, F.expr("c.lang <=> t.lang AND c.source <=> t.source"), "left")
    return joined.select("c.*", F.expr(f"NOT base_failed AND coalesce({passes}, true)").alias("kept"))


def quality_rules(docs: DataFrame, prior: int = PRIOR, **columns: str) -> DataFrame:
    """doc_id, lang, source, text_key, the counts, base_failed and kept, one row per input row.

    The counts are stored once, since the sketches and the verdicts both read them. An empty table gives no
    rows; a null language or source is a group of its own.
    """
    counted = stored(counts(docs, **columns))
    return judged(counted, thresholds(sketches(counted), prior))
