"""Benchmark passages in documents, through a positional inverted index.

Texts are cut into words once and written. A window is a run of consecutive item words; it stands at a place exactly (a phrase), or nearly (a
proximity match, as an edit leaves it): NEAR_PERCENT of its words stand at most SLOP words from where they are due, each in a place of its own or not.

Of 10 words 8 must be near, so of any 3 words one is, and of any 4 words two are. The words of a window are ordered from the rarest in the corpus
to the most frequent, and the index holds the postings (row, pos, term) of the first 4 (in general: as many as any match must have two of).
Their offset-adjusted lists are intersected: where two of them stand as far apart as the window has them, up to 2 * SLOP, its other words are
looked up in the text around, once for all starts that come into question. So nothing that reaches the percentage is left out, and frequent words, which are most of a text, need no postings.

Everything is DataFrame and SQL functions. Lists of a document meet in its row, so neither a very frequent word nor a passage that a third
of the documents hold meets in one task. Sides are broadcast only where the planner finds their stored size small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlq.functions.text import literal, once
from crawlq.llm.common import only, stored

WORDS = 10
#: How far from its place a word may stand in a proximity match, and the percentage of a window's words that must.
SLOP = 5
NEAR_PERCENT = 80

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: ASCII other than digits and lower-case letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> str:
    """SQL text: the words of `text`, A-Z lowered."""
    lowered = f"translate({text}, {literal(UPPER)}, {literal(UPPER.lower())})"
    return f"filter(split({lowered}, {literal(BREAKS)}), w -> w <> '')"


def item_windows(items: DataFrame, k: int = WORDS, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(wid, words) of the distinct windows, and (wid, item_id) of the items that hold each. An item shorter than `k` is one window, one without words none."""
    rows = once(only(items, item_id=item_id, text=text), {"w": words("text")}).where("size(w) > 0")
    each = rows.select("item_id", F.expr(f"explode(transform(sequence(1, greatest(1, size(w) - {k - 1})), i -> slice(w, i, {k}))) AS words"))
    each = stored(each.distinct())
    distinct = stored(each.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return distinct, stored(each.join(distinct, "words").select("wid", "item_id"))


def word_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_words, w: the words of every input row. What is written is what all later steps read, so the row numbers stay whatever is lost."""
    rows = only(docs, doc_id=doc_id, text=text).withColumn("row", F.monotonically_increasing_id())
    rows = once(rows, {"w": words("text")})
    return stored(rows.select("row", "doc_id", F.expr("CAST(size(w) AS BIGINT)").alias("n_words"), "w"), compression="zstd")


def ordered_windows(windows: DataFrame, rows: DataFrame, near_percent: int = NEAR_PERCENT) -> DataFrame:
    """wid, words, firsts, k, must, hits, lead: of the windows that can be near anywhere.

    `firsts` says for each word where it stands first in the window, from 1. `must` words have to be near. `lead` holds (off, term) of the rarest
    words, so many that each match has `hits` of them: two, or one where one word is enough. Words that no document has come first and are left out of it.
    """
    each = windows.select("wid", "words", F.posexplode("words").alias("off", "term"))
    terms = stored(each.select("term").distinct())
    frequency = rows.select(F.explode("w").alias("term")).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    needs = F.array_sort(F.collect_list(F.struct("cf", "off", "term")))
    known = each.join(frequency, "term").groupBy("wid", "words").agg(needs.alias("needs")).withColumn("k", F.size("words"))
    known = known.withColumn("must", F.expr(f"CAST(greatest(1, ceil(k * {near_percent} / 100)) AS INT)")).where("size(needs) >= must")
    known = known.withColumn("hits", F.expr("least(2, must)")).withColumn("firsts", F.expr("transform(words, x -> array_position(words, x))"))
    # Of k - must + hits words at most k - must are missing.
    lead = "transform(slice(needs, 1, size(needs) - must + hits), x -> struct(x.off AS off, x.term AS term))"
    return stored(known.select("wid", "words", "firsts", "k", "must", "hits", F.expr(lead).alias("lead")))


def positional_index(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """row, pos, key: every place of the words in `terms` (term, distinct); positions from 0. The key is a hash of the word, short to move."""
    return rows.select("row", F.posexplode("w").alias("pos", "term")).join(terms, "term", "left_semi").select("row", "pos", F.hash("term").alias("key"))


def _meetings(order: DataFrame) -> DataFrame:
    """wid, key1, o1, key2, o2: two leading words of a window, either way round; where one is enough, each with itself."""
    ends = order.select("wid", "hits", F.col("lead").alias("others"), F.inline("lead")).select("wid", "hits", F.col("off").alias("o1"), F.hash("term").alias("key1"), F.inline("others"))
    return stored(ends.where("o1 <> off OR hits = 1").select("wid", "key1", "o1", F.hash("term").alias("key2"), F.col("off").alias("o2")))


def asked_starts(met: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """row, wid, lo, hi: the starts from `lo` to `hi` at which two leading words of a window are both near.

    The pairs of words of one exact match ask for the same starts, which are listed once.
    """
    asked = met.join(pairs, ["key1", "key2"]).where(f"abs(gap - (o2 - o1)) <= {2 * slop}")
    lo, hi = f"greatest(pos - o1, pos + gap - o2) - {slop}", f"least(pos - o1, pos + gap - o2) + {slop}"
    return asked.select("row", "wid", F.expr(lo).alias("lo"), F.expr(hi).alias("hi")).distinct()


def matches(windows: DataFrame, rows: DataFrame, slop: int = SLOP, near_percent: int = NEAR_PERCENT) -> DataFrame:
    """wid, row, start, k, n_exact, n_near: every place where a window stands (n_exact = k), or nearly does.

    `start` is where the window begins, maybe before the text. Near means that `near_percent` of its words stand at most `slop` words from their
    places. Of neighbouring starts that are near, the one with most words exactly in place is listed (then with most near, then the first), and
    every exact one. A window of one word has only exact places.
    """
    order = ordered_windows(windows, rows, near_percent)
    pairs = _meetings(order)
    index = positional_index(rows, stored(order.select(F.explode("lead.term").alias("term")).distinct()))
    # What stands after a posting as far as two words of a window can be apart, itself included. Words of one key are told apart in the text.
    reach = (order.agg(F.max("k")).first()[0] or 1) - 1 + 2 * slop
    ahead = Window.partitionBy("row").orderBy("pos").rangeBetween(0, reach)
    met = index.withColumn("next", F.collect_list(F.struct("pos", "key")).over(ahead))
    met = met.select("row", "pos", F.col("key").alias("key1"), F.inline("next").alias("pos2", "key2")).withColumn("gap", F.col("pos2") - F.col("pos")).drop("pos2")
    gaps = stored(pairs.select(F.col("key1").alias("g1"), F.col("key2").alias("g2"), F.expr("o2 - o1").alias("due")).distinct())
    met = stored(met.join(gaps, F.expr(f"key1 = g1 AND key2 = g2 AND abs(gap - due) <= {2 * slop}"), "left_semi"))
    # The windows of each, then the text around: nothing that has a text is moved after that.
    asked = asked_starts(met, pairs, slop).join(order.select("wid", "words", "firsts", "k", "must"), "wid")
    # A text moves as one string, less than half the size of its words as an array; no word has a blank.
    texts = rows.select("row", F.array_join("w", " ").alias("moved")).repartition("row")
    may = asked.join(once(texts, {"w": "split(moved, ' ')"}).drop("moved"), "row").withColumn("base", F.expr(f"greatest(0, lo - {slop})"))
    may = once(may, {"around": f"slice(w, base + 1, hi + k + {slop} - base)"}).drop("w")
    may = may.where("size(filter(words, x -> array_contains(around, x))) >= must")
    # The text is compared once for all starts: for each word of the window, the starts that its places in the text are due for.
    may = once(may, {"places": "filter(transform(around, (x, i) -> struct(array_position(words, x) AS nth, base + i AS pos)), x -> x.nth > 0)"}).drop("words", "around")
    due = f"filter(places, x -> x.nth = nth AND x.pos - o BETWEEN lo - {slop} AND hi + {slop})"
    may = once(may, {"due": f"transform(firsts, (nth, o) -> transform({due}, x -> x.pos - o))"}).drop("places", "firsts")
    may = may.where("size(filter(due, d -> size(d) > 0)) >= must")
    tried = may.withColumn("start", F.explode(F.expr("sequence(lo, hi)")))
    tried = once(tried, {"n_near": f"size(filter(due, d -> exists(d, s -> abs(s - start) <= {slop})))"}).where("n_near >= must")
    tried = once(tried, {"n_exact": "size(filter(due, d -> array_contains(d, start)))"}).where("k > 1 OR n_exact = k")
    found = tried.select("wid", "row", F.col("start").cast("int").alias("start"), "k", "n_exact", "n_near").distinct()
    # Runs of neighbouring starts.
    along = Window.partitionBy("wid", "row").orderBy("start")
    found = found.withColumn("run", F.col("start") - F.row_number().over(along))
    best = Window.partitionBy("wid", "row", "run").orderBy(F.desc("n_exact"), F.desc("n_near"), "start")
    return found.withColumn("place", F.row_number().over(best)).where("place = 1 OR n_exact = k").drop("run", "place")


def passages(docs: DataFrame, items: DataFrame, k: int = WORDS, slop: int = SLOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """row, doc_id, item_id, kind (phrase or proximity), start, size, n_exact, n_near: every match of every item."""
    windows, held, rows = _prepared(docs, items, k, doc_id, text, item_id, item_text)
    found = matches(windows, rows, slop).join(held, "wid")
    ids = rows.select("row", "doc_id")
    kind = F.expr("CASE WHEN n_exact = k THEN 'phrase' ELSE 'proximity' END").alias("kind")
    return found.join(ids, "row").select("row", "doc_id", "item_id", kind, "start", F.col("k").alias("size"), "n_exact", "n_near")


def _prepared(docs, items, k, doc_id, text, item_id, item_text):
    windows, held = item_windows(items, k, item_id, item_text)
    return windows, held, word_rows(docs, doc_id, text)


def decontamination(docs: DataFrame, items: DataFrame, k: int = WORDS, slop: int = SLOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    A word inside an exact occurrence of a window is hit. `n_near_items` are items with proximity matches and no exact one. Null and empty texts
    have no words; an item without words is in no document; a null item id is written as `null`. Repeated rows are
    judged each for itself, repeated items once. Without documents there are no rows, without items nothing is hit.
    """
    windows, held, texts = _prepared(docs, items, k, doc_id, text, item_id, item_text)
    found = stored(matches(windows, texts, slop))
    spans = found.where("n_exact = k").select("row", "start", F.expr("start + k AS stop")).distinct()
    # One row's spans: as many as the text has places at most.
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    hit = F.expr("""aggregate(spans, struct(0 AS until, CAST(0 AS BIGINT) AS n),
        (s, x) -> struct(greatest(s.until, x.stop) AS until, s.n + greatest(0, x.stop - greatest(x.start, s.until)) AS n), s -> s.n)""")
    hits = per_row.select("row", hit.alias("n_hit"))
    named = found.join(held, "wid").groupBy("row", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")).agg(F.max(F.expr("n_exact = k")).alias("exact"))
    names = named.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_if(~F.col("exact")).alias("n_near_items"))
    rows = texts.select("row", "doc_id", "n_words")
    joined = rows.join(hits, "row", "left").join(names, "row", "left")
    none = F.coalesce("items", F.array().cast("array<string>"))
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.size(none).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(none, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        F.coalesce("n_near_items", zero).alias("n_near_items"),
    )
