"""License scan by votes on diagonals.

Templates are short license notices. Every rolling k-gram of a document's words is hashed and joined with
the template positions of that hash. A hit at document word p and template word q votes for the
diagonal p - q, the place where the whole template would start. Diagonals next to each other are
merged, since one inserted or missing word moves the rest of a notice by one, and the votes of a
merged diagonal are verified: they must cover most of the template within a span of about its length, and hold every k-gram with a
number in it, since notices of two versions differ in nothing else.

Templates shorter than k are phrases; they are hashed whole and a hit is the phrase.

Everything is DataFrame and SQL functions. A template table of at most MAX_POSITIONS k-grams, which is counted, is broadcast: the k-grams
of the documents are filtered where they are made, and only votes are shuffled, summed per document, template and
diagonal before they move. With more templates the same k-grams meet theirs in a plain join, and the rest is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlq.functions.text import literal, once
from crawlq.llm.common import only

K = 4
#: Diagonals at most this far apart belong together.
DRIFT = 3
#: Share of a template's k-grams that a span must hold for its label to count.
LEAST_COVER = 0.6
#: Most k-grams of all templates together that are broadcast: some megabytes. Above, the join is left to the planner.
MAX_POSITIONS = 200_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: ASCII other than digits and lower-case letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that always count, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices looked for beside the phrases: (label, text).
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-line", "Licensed under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words(text: str) -> str:
    """SQL text: lower-case words of `text`."""
    lowered = f"translate({text}, {literal(UPPER)}, {literal(UPPER.lower())})"
    return f"filter(split({lowered}, {literal(BREAKS)}), w -> w <> '')"


def grams(words_column: str, k: int | str) -> str:
    """SQL text: hashes of all rolling k-grams, in order."""
    return f"""CASE WHEN size({words_column}) < {k} THEN CAST(array() AS array<bigint>)
        ELSE transform(sequence(1, size({words_column}) - {k} + 1), i -> xxhash64(slice({words_column}, i, {k}))) END"""


def template_table(spark: SparkSession, templates, phrases) -> DataFrame:
    """template, label, phrase (boolean), words."""
    rows = [(i, label, phrase, text) for i, (text, label, phrase) in enumerate(
        [(t, l, True) for t, l in phrases] + [(t, l, False) for l, t in templates]
    )]
    return spark.createDataFrame(rows, "template int, label string, phrase boolean, text string").select(
        "template", "label", "phrase", F.expr(words("text")).alias("words")
    )


def template_positions(table: DataFrame, k: int = K) -> DataFrame:
    """template, label, phrase, size, n_grams, k, gram, at, gram_words: one row per k-gram of a template; short ones are one gram."""
    own_k = table.where("size(words) > 0").withColumn("k", F.expr(f"CASE WHEN phrase OR size(words) < {k} THEN size(words) ELSE {k} END"))
    own_k = own_k.withColumn("grams", F.expr(grams("words", "k")))
    return own_k.select(
        "template", "label", "phrase", "k", F.expr("size(words)").alias("size"), F.expr("size(grams)").alias("n_grams"), "words",
        F.posexplode("grams").alias("at", "gram"),
    ).withColumn("gram_words", F.expr("slice(words, at + 1, k)")).drop("words").withColumn(
        "numbered", F.expr("exists(gram_words, w -> w RLIKE '[0-9]')")
    )


def license_scan(docs: DataFrame, templates=NOTICES, phrases=PHRASES, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct (doc_id, text), repeated as often as it comes in: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    A null or empty text has no words, no places and score 0. A phrase counts at every place
    it stands, overlapping ones included. `score` is the best cover of any template, 1 for a phrase. The number of
    templates decides how they are joined, not what is found.
    """
    spark = docs.sparkSession
    positions = template_positions(template_table(spark, templates, phrases), k)
    few = positions.count() <= MAX_POSITIONS
    longest = F.expr("array_max(transform(gram_words, w -> struct(length(w) AS n, w AS w))).w")
    # Grams with a number that each template has.
    positions = positions.join(positions.groupBy("template").agg(F.count_if("numbered").alias("needed")), "template")
    # At most k lengths and those of the phrases; with few templates, also the words they look for.
    sought = F.collect_set(longest) if few else F.array().cast("array<string>")
    lengths = {r["k"]: r["needed"] for r in positions.groupBy("k").agg(sought.alias("needed")).collect()}

    df = only(docs, doc_id=doc_id, text=text).withColumn("text_key", F.xxhash64("text"))
    df = once(df, {"words": words("text")})
    # A hit needs the longest word of its gram, so documents without any of these words have none.
    each = []
    for n, needed in sorted(lengths.items()):
        rolled = grams("words", n)
        if few:
            rolled = f"CASE WHEN arrays_overlap(words, array({', '.join(literal(w) for w in sorted(needed))})) THEN {rolled} ELSE CAST(array() AS array<bigint>) END"
        each.append(f"transform({rolled}, (g, i) -> struct({n} AS k, i AS p, g AS gram))")
    rolling = df.select("doc_id", "text_key", "words", F.expr(f"inline(concat({', '.join(each) or 'CAST(array() AS array<struct<k:int,p:int,gram:bigint>>)'}))"))
    t = positions.select("template", "label", "phrase", "size", "n_grams", "needed", F.col("k").alias("tk"), F.col("gram").alias("tgram"), "at", "gram_words", "numbered")
    if few:
        hits = rolling.join(F.broadcast(t), F.expr("gram = tgram AND k = tk")).where("slice(words, p + 1, k) = gram_words")
    else:
        # Rows that move carry the words of their gram, not those of the document.
        thin = rolling.select("doc_id", "text_key", "k", "p", "gram", F.expr("slice(words, p + 1, k)").alias("own"))
        hits = thin.join(t, F.expr("gram = tgram AND k = tk AND own = gram_words"))
    votes = hits.groupBy("doc_id", "text_key", "template", "label", "phrase", "size", "n_grams", "needed", F.expr("p - at").alias("diagonal")).agg(
        F.count_distinct("at").alias("votes"), F.collect_set(F.when(F.col("numbered"), F.col("at"))).alias("numbers"), F.min("p").alias("first"), F.max(F.expr("p + k - 1")).alias("last")
    )
    # Repeated rows vote again for the same places: distinct template positions keep the votes right.
    near = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    starts = votes.withColumn(
        "opens", F.expr("phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > DRIFT, F.lit(True))
    )
    placed = starts.withColumn("place", F.sum(F.col("opens").cast("int")).over(near))
    spans = placed.groupBy("doc_id", "text_key", "template", "label", "phrase", "size", "n_grams", "needed", "place").agg(
        F.sum("votes").alias("votes"), F.expr("size(array_distinct(flatten(collect_list(numbers))))").alias("numbers"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    spans = spans.withColumn("cover", F.expr("least(1D, votes / n_grams) * least(1D, size / (last - first + 1))"))
    spans = spans.where(f"phrase OR (cover >= {LEAST_COVER} AND last - first + 1 <= 2 * size AND numbers >= needed)")
    found = spans.groupBy("doc_id", "text_key").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first"))).cast("bigint").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base"),
        F.array_sort(F.collect_set("label")).alias("all"),
        F.max("cover").alias("score"),
    )
    thin = df.select("doc_id", "text_key", F.expr("CAST(size(words) AS BIGINT)").alias("n_words"))
    d, f = thin.alias("d"), found.alias("f")
    return d.join(f, F.expr("d.doc_id <=> f.doc_id AND d.text_key = f.text_key"), "left").select(
        "d.doc_id",
        "d.text_key",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("all", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
