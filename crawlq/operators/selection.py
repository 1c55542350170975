"""k-th element selection and priced item combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlq.runtime import stored

#: Groups with at most this many values left are sorted; larger ones are narrowed once more.
SORTED_AT_ONCE = 10_000
#: Ranges per group and round for values that are numbers.
BINS = 4096


def kth_smallest(df: DataFrame, value: str, k: int, by: str | None = None, sorted_at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """The `k`-th smallest value, 1-based, duplicates counted: `(by, kth)` or `(kth)`.

    Groups with fewer than `k` values are left out; without groups a `k` beyond the table raises.
    NULL values are not counted; a NULL group is a group. Any type that can be ordered will do.

    Numbers, dates and texts are narrowed in rounds, which move counts only: a round cuts what is left of a group into ordered ranges (equal
    widths for numbers, the first character in which its texts differ), counts them, and keeps the range that holds rank `k`. A range of equal values, or of
    few, ends it. Whole texts are compared inside the last range alone. Other types go by sampled ranges.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    # Without groups all values are one; a literal would be folded away, and joins on it with it.
    key = F.col(value).isNull().cast("int") if by is None else F.col(by)
    rows = df.select(key.alias("g"), F.col(value).alias("v")).where(F.col("v").isNotNull())
    kind = df.schema[value].dataType
    if isinstance(kind, T.StringType):
        found, none = _kth_text(rows, k, sorted_at_once)
    elif isinstance(kind, (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.FractionalType)) and _is_finite(rows, kind):
        found, none = _kth_number(rows, k, kind, sorted_at_once)
    else:
        found, none = _kth_by_ranges(rows, k)
    if by is not None:
        return found.select(F.col("g").alias(by), F.col("v").alias("kth"))
    if none:
        raise ValueError(f"k={k} is greater than the number of values")
    return found.select(F.col("v").alias("kth"))


def _is_finite(rows: DataFrame, kind: T.DataType) -> bool:
    """No NaN and no infinity, between which there are no widths."""
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return True
    least, most = rows.agg(F.min("v"), F.max("v")).first()
    return least is None or (least > float("-inf") and most < float("inf"))


def _ranked(counts: DataFrame, order: str) -> DataFrame:
    """Of `(g, …, n, rest)` counts in order, the row of each group that holds rank `rest`, with the rank inside it."""
    upto = F.sum("n").over(Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = counts.withColumn("upto", upto).where("upto >= rest AND upto - n < rest")
    return held.withColumn("rest", F.expr("rest - (upto - n)")).drop("upto")


def _sorted_out(left: DataFrame) -> DataFrame:
    """`(g, v)` at rank `rest` of small groups of `(g, v, rest)` rows."""
    place = F.row_number().over(Window.partitionBy("g").orderBy("v"))
    return left.withColumn("place", place).where("place = rest").select("g", "v")


def _kth_number(rows: DataFrame, k: int, kind: T.DataType, sorted_at_once: int) -> tuple[DataFrame, bool]:
    """By ranges of equal width; each range knows its own least and largest value, so the next round fits it."""
    ends = [F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")]
    spots = stored(rows.groupBy("g").agg(*ends).where(F.col("n") >= k).withColumn("rest", F.lit(k).cast("bigint")))
    none = spots.isEmpty()
    number = {T.DateType: "unix_date({0})", T.TimestampType: "unix_micros({0})", T.TimestampNTZType: "unix_micros(CAST({0} AS TIMESTAMP))"}.get(type(kind), "{0}")
    # Halves keep the span of the largest numbers finite.
    number = f"(CAST({number} AS DOUBLE) / 2)"
    place = f"({number.format('v')} - {number.format('lo')}) / ({number.format('hi')} - {number.format('lo')})"
    done = []
    while True:
        done.append(spots.where("lo = hi").select("g", F.col("lo").alias("v")))
        # Values that no width can part are counted before they are sorted, so copies of them do not matter.
        small = spots.where(f"lo <> hi AND (n <= {sorted_at_once} OR {number.format('lo')} = {number.format('hi')})")
        counts = _inside(rows, small).groupBy("g", "v", "rest").agg(F.count(F.lit(1)).alias("n"))
        done.append(_ranked(counts, "v").select("g", "v"))
        wide = spots.where(f"lo <> hi AND n > {sorted_at_once} AND {number.format('lo')} <> {number.format('hi')}")
        if wide.isEmpty():
            return reduce(DataFrame.unionByName, done), none
        binned = _inside(rows, wide).withColumn("bin", F.expr(f"CAST(least({BINS - 1}, floor({BINS} * ({place}))) AS INT)"))
        spots = stored(_ranked(binned.groupBy("g", "bin", "rest").agg(*ends), "bin").drop("bin"))


def _inside(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """The rows between `lo` and `hi` of their group."""
    r, s = rows.alias("r"), spots.alias("s")
    return r.join(s, F.expr("r.g <=> s.g AND r.v >= s.lo AND r.v <= s.hi")).select("r.g", "r.v", "lo", "hi", "rest")


def _kth_text(rows: DataFrame, k: int, sorted_at_once: int) -> tuple[DataFrame, bool]:
    """By the first character in which the texts of a group differ: never more keys than there are characters."""
    left = rows.withColumn("rest", F.lit(k).cast("bigint"))
    first, none, done = True, False, []
    while True:
        ends = left.groupBy("g", "rest").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= rest")
        # How many characters the least and the largest have in common, and with them all others.
        same = "CAST(array_position(transform(arrays_zip(split(lo, ''), split(hi, '')), x -> NOT (x['0'] <=> x['1'])), true) AS INT) - 1"
        ends = stored(ends.select("g", "rest", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only"), F.expr(same).alias("common")))
        none = none or (first and ends.isEmpty())
        first = False
        done.append(ends.where("only IS NOT NULL").select("g", F.col("only").alias("v")))
        small = ends.where(f"only IS NULL AND n <= {sorted_at_once}").select("g")
        l, s = left.alias("l"), small.alias("s")
        done.append(_sorted_out(l.join(s, F.expr("l.g <=> s.g"), "left_semi")))
        wide = ends.where(f"only IS NULL AND n > {sorted_at_once}")
        if wide.isEmpty():
            return reduce(DataFrame.unionByName, done), none
        w = wide.select("g", "common").alias("w")
        keyed = l.join(w, F.expr("l.g <=> w.g")).select("l.g", "v", "rest", F.expr("substring(v, common + 1, 1)").alias("c"))
        spot = stored(_ranked(keyed.groupBy("g", "c", "rest").agg(F.count(F.lit(1)).alias("n")), "c").withColumnsRenamed({"rest": "inner", "c": "at"}))
        a, b = keyed.alias("a"), spot.alias("b")
        left = stored(a.join(b, F.expr("a.g <=> b.g AND a.c = b.at")).select("a.g", "v", F.col("inner").alias("rest")))


def _kth_by_ranges(rows: DataFrame, k: int) -> tuple[DataFrame, bool]:
    """Equal values are counted and dealt to sampled ranges of (group, value); only the range that holds the rank is walked."""
    counts = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    ranges = stored(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    sums = ranges.groupBy("g", "part").agg(F.sum("n").alias("n")).withColumn("rest", F.lit(k).cast("bigint"))
    spot = _ranked(sums, "part").select("g", "part", "rest")
    r, p = ranges.alias("r"), spot.alias("p")
    held = r.join(p, F.expr("r.g <=> p.g AND r.part = p.part")).select("r.g", "v", "n", "rest")
    return _ranked(held, "v").select("g", "v"), spot.isEmpty()


#: Groups of up to this many free items have all their sets built in the row, larger ones of up to twice that as two halves.
IN_ROW = 10


def price_band_combos(
    items: DataFrame,
    chosen: DataFrame,
    excluded: DataFrame,
    lo: float,
    hi: float,
    by: str,
    max_k: int | None = None,
    split_rows: int = 10_000,
    ordered: bool = False,
    in_row: int = IN_ROW,
) -> DataFrame:
    """Unordered item sets of every size (or of up to `max_k`) whose price, with the chosen items, lies strictly between `lo` and `hi`.

    `items(by, item, price)`, where `item` identifies an item inside its group and can be ordered;
    `chosen` and `excluded` list items by `item` (and `by`, when they differ per group).
    Returns `(by, size, prices, total)`; size 0 is the chosen items alone. `ordered` sorts by
    total, which computes the sets twice (range partitioning samples them first), so a sink
    that needs no order should not ask for it.

    Groups whose prices cannot reach the band at all are left out first. Of the others:

    * a group of up to `in_row` free items is one row, and its sets are built and tested there;
    * one of up to twice that is two halves; the sets of a half go to bins of their total as wide as the band, so a set of one half meets
      only the sets of the other in the two bins that could complete it;
    * in a larger group every size is an equi-join of the sets one smaller with the group's items plus an order test, built once, until a size
      has no sets. Sets are dropped which no cheaper item could bring below `hi`, or which all that may still be added leaves at `lo` or
      below. The sets of a group with more than `split_rows` items are spread over one part per `split_rows` items, each with its own copy
      of the group's items.

    How many sets there are is the question's own: a group of n cheap items has up to 2^n of them.
    """

    def keys(listed: DataFrame) -> list[str]:
        return [by, "item"] if by in listed.columns else ["item"]

    start = F.coalesce(F.sum(F.expr("CASE WHEN taken THEN price END")), F.lit(0)).cast("double")
    marked = items.join(chosen.select(*keys(chosen), F.lit(True).alias("taken")).distinct(), keys(chosen), "left")
    barred = excluded.select(*keys(excluded), F.lit(True).alias("barred")).distinct()
    marked = marked.join(barred, keys(excluded), "left")
    free = F.expr("taken IS NULL AND barred IS NULL")
    price = F.expr("CAST(CASE WHEN taken IS NULL AND barred IS NULL THEN price END AS DOUBLE)")
    groups = marked.groupBy(F.col(by).alias("g")).agg(
        start.alias("start"),
        F.count_if(free).alias("n"),
        F.coalesce(F.sum(F.least(price, F.lit(0.0))), F.lit(0.0)).alias("fall"),
        F.coalesce(F.sum(F.greatest(price, F.lit(0.0))), F.lit(0.0)).alias("rise"),
        F.coalesce(F.least(F.min(price), F.lit(0.0)), F.lit(0.0)).alias("slack"),
        F.coalesce(F.greatest(F.max(price), F.lit(0.0)), F.lit(0.0)).alias("top"),
    )
    # Rounding may differ by the order of a sum; the exact test comes at the end.
    spare = 1e-9 * (abs(lo) + abs(hi) + 1)
    groups = stored(groups.where((F.col("start") + F.col("rise") > lo - spare) & (F.col("start") + F.col("fall") < hi + spare)))
    kept = marked.where(free).select(F.col(by).alias("g"), "item", F.col("price").cast("double").alias("price")).join(groups, "g")
    band = (lo, hi, max_k)
    parts = [groups.where("n = 0").select("g", F.array().cast("array<double>").alias("prices"), F.col("start").alias("total"))]
    packed = kept.where(F.col("n") <= 2 * in_row).groupBy("g", "start", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "price"))), lambda x: x["price"]).alias("free"))
    parts.append(_subsets(packed.where(F.col("n") <= in_row), "free", max_k).select("g", "prices", "total"))
    sizes = groups.agg(F.max("n")).first()[0] or 0
    if sizes > in_row:
        parts.append(_halves(stored(packed.where(F.col("n") > in_row)), band))
    if sizes > 2 * in_row:
        parts += _levels(kept.where(F.col("n") > 2 * in_row), groups.where(F.col("n") > 2 * in_row), band, split_rows)
    sets = reduce(DataFrame.unionByName, parts)
    sets = sets.where((F.col("total") > lo) & (F.col("total") < hi))
    sets = sets.select(
        F.col("g").alias(by), F.size("prices").alias("size"), F.sort_array("prices").alias("prices"), F.round("total", 2).alias("total")
    )
    return sets.orderBy("total", by) if ordered else sets


def _subsets(rows: DataFrame, prices: str, max_k: int | None, start: str = "start") -> DataFrame:
    """Every subset of the short array `prices` as a row: `prices` becomes the subset, `total` its sum on top of `start`, in order."""
    masks = rows.select("*", F.expr(f"explode(sequence(CAST(0 AS BIGINT), shiftleft(CAST(1 AS BIGINT), size({prices})) - 1))").alias("mask"))
    if max_k is not None:
        masks = masks.where(f"bit_count(mask) <= {max_k}")
    picked = F.expr(f"filter({prices}, (p, i) -> (shiftright(mask, i) & 1) = 1)")
    sets = masks.withColumn("__picked", picked).drop("mask")
    return sets.withColumns({prices: F.col("__picked"), "total": F.expr(f"aggregate(__picked, {start}, (s, p) -> s + p)")}).withColumnRenamed(prices, "prices").drop("__picked")


def _halves(rows: DataFrame, band: tuple) -> DataFrame:
    """Sets of middling groups: the sets of the first half meet those of the second over bins of totals."""
    lo, hi, max_k = band
    width = max(hi - lo, 1e-6)
    cut = "CAST(n DIV 2 AS INT)"
    first = _subsets(rows.select("g", "start", F.expr(f"slice(free, 1, {cut})").alias("half")), "half", max_k).select("g", "prices", "total")
    second = _subsets(rows.select("g", F.lit(0.0).alias("start"), F.expr(f"slice(free, {cut} + 1, n)").alias("half")), "half", max_k)
    second = second.select("g", F.col("prices").alias("others"), F.col("total").alias("rest"))
    # rest lies strictly between lo - total and hi - total: two bins of the band's width, and one to spare for rounding.
    bin_of = lambda x: f"CAST(floor(({x}) / {width}D) AS BIGINT)"
    first = first.withColumn("bin", F.expr(f"explode(sequence({bin_of(f'{lo}D - total')} - 1, {bin_of(f'{hi}D - total')} + 1))"))
    joined = first.join(second.withColumn("bin", F.expr(bin_of("rest"))), ["g", "bin"])
    # Summed once more in order, so that a total does not depend on where the group was cut.
    joined = joined.withColumn("total", F.expr("aggregate(others, total, (s, p) -> s + p)"))
    if max_k is not None:
        joined = joined.where(F.size("prices") + F.size("others") <= max_k)
    return joined.select("g", F.concat("prices", "others").alias("prices"), "total")


def _levels(free: DataFrame, groups: DataFrame, band: tuple, split_rows: int) -> list[DataFrame]:
    """Sets of large groups, size by size."""
    lo, hi, max_k = band
    free = stored(free.withColumn("parts", F.ceil(F.col("n") / split_rows).cast("int")))
    pool = free.select(
        F.col("g").alias("pool_g"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("pool_part"),
        F.col("item").alias("next_item"),
        F.col("price").alias("next_price"),
    )
    levels = [groups.select("g", F.array().cast("array<double>").alias("prices"), F.col("start").alias("total"))]

    def hopeful(total: Column, gain: Column, size: int) -> Column:
        """Can the set, or one that it grows to, end inside the band: `gain` is what positive prices could still add."""
        left = F.col("n") - size if max_k is None else F.lit(max_k - size)
        return (total + F.col("slack") * left < hi) & (total + F.least(gain, F.col("top") * left) > lo - 1e-9 * (abs(lo) + abs(hi) + 1))

    state = ["g", "slack", "top", "parts", "n", "last", "prices", "total", "gain"]
    gain = F.col("rise") - F.greatest(F.col("price"), F.lit(0.0))
    level = free.select("g", "slack", "top", "parts", "n", F.col("item").alias("last"), F.array("price").alias("prices"), (F.col("start") + F.col("price")).alias("total"), gain.alias("gain"))
    level = level.where(hopeful(F.col("total"), F.col("gain"), 1))
    size = 1
    while max_k is None or size <= max_k:
        if size > 1:
            part = F.pmod(F.xxhash64("last"), F.col("parts")).cast("int")
            total = F.col("total") + F.col("next_price")
            gain = F.col("gain") - F.greatest(F.col("next_price"), F.lit(0.0))
            same = (F.col("g") == F.col("pool_g")) & (F.col("part") == F.col("pool_part"))
            level = level.withColumn("part", part).join(pool, same & (F.col("next_item") > F.col("last")) & hopeful(total, gain, size))
            grown = {"last": F.col("next_item"), "prices": F.array_append("prices", F.col("next_price")), "total": total, "gain": gain}
            level = stored(level.select(*[grown.get(c, F.col(c)).alias(c) for c in state]))
            if level.isEmpty():
                break
        levels.append(level.select("g", "prices", "total"))
        size += 1
    return levels
