"""How alike two pages are: item overlap of given pairs, icons, and the best targets of a page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlq.functions import html as H
from crawlq.functions import urls as U
from crawlq.operators import extracts as X
from crawlq.runtime import scratch_folder, stored

Feature = Callable[[DataFrame], DataFrame]

# Comparison modes, the default icon, the ratio when both sides are empty.
FULL = "full"
PATH_NO_QUERY = "path_no_query"
NO_FILENAME = "no_filename"
FILENAME = "filename"
REDUCED = "reduced"
DEFAULT_ICON = "favicon.ico"
BOTH_EMPTY = -1000.0

_SCHEMED = f"{U.url_part('base_url', 'scheme')} <> ''"


def _tagged(pages: DataFrame) -> DataFrame:
    return X.with_base_url(H.with_tags(pages))


def page_items(pages: DataFrame, feature: Feature, compare: str = FULL) -> DataFrame:
    """`(page_id, item, cnt)`: the comparison keys of a feature.

    `full` keeps items as they are, with their multiplicity; the other modes are sets
    (`cnt` is 1) of resolved directories, resolved URLs without file name, or file names.
    """
    if compare not in (FULL, PATH_NO_QUERY, NO_FILENAME, FILENAME):
        raise ValueError(f"unknown comparison mode {compare!r}")
    if compare == FULL:
        return feature(H.with_tags(pages)).groupBy("page_id", "item").agg(F.count(F.lit(1)).alias("cnt"))
    if compare == FILENAME:
        keys = feature(H.with_tags(pages)).withColumn("item", F.expr(U.file_name("item")))
    else:
        rows = U.with_resolved(feature(_tagged(pages)), "base_url", "item", "__full")
        rows = U.with_reduced(rows, "__full", "__reduced")
        cut = U.path_structure if compare == PATH_NO_QUERY else U.without_filename
        keys = rows.withColumn("item", F.expr(cut("__reduced")))
    return keys.select("page_id", "item").distinct().withColumn("cnt", F.lit(1).cast("bigint"))


def page_schemes(pages: DataFrame) -> DataFrame:
    """`(page_id, schemed)`: does the base URL of the page have a scheme."""
    return _tagged(pages).select("page_id", F.expr(_SCHEMED).alias("schemed"))


def _ratio(common: Column, len_a: Column, len_b: Column) -> Column:
    smaller = F.greatest(F.lit(1), F.least(len_a, len_b))
    return F.when((len_a == 0) & (len_b == 0), F.lit(BOTH_EMPTY)).otherwise(common / smaller)


def _lengths(items: DataFrame, key: str, name: str) -> DataFrame:
    return items.groupBy(F.col("page_id").alias(key)).agg(F.sum("cnt").alias(name))


def _common_counts(pairs: DataFrame, items_a: DataFrame, items_b: DataFrame) -> DataFrame:
    """`(a_id, b_id, common_count)` of the pairs that share an item; repeats on the left count."""
    left = items_a.select(F.col("page_id").alias("a_id"), "item", "cnt")
    right = items_b.select(F.col("page_id").alias("b_id"), "item")
    shared = pairs.select("a_id", "b_id").distinct().join(left, "a_id").join(right, ["b_id", "item"])
    return shared.groupBy("a_id", "b_id").agg(F.sum("cnt").alias("common_count"))


def pair_similarity(
    pairs: DataFrame, items_a: DataFrame, items_b: DataFrame | None = None, schemes: DataFrame | None = None
) -> DataFrame:
    """Overlap of every pair: `(a_id, b_id, common_ratio_of_min, common_count, len_a, len_b, status)`.

    The ratio is not symmetric and may exceed 1 when items repeat. With `schemes`, a pair where
    only one base URL has a scheme gets NULL metrics and the status `scheme_mismatch`.
    """
    items_b = items_a if items_b is None else items_b
    out = pairs.join(_lengths(items_a, "a_id", "len_a"), "a_id", "left")
    out = out.join(_lengths(items_b, "b_id", "len_b"), "b_id", "left")
    out = out.join(_common_counts(pairs, items_a, items_b), ["a_id", "b_id"], "left")
    zero = F.lit(0).cast("bigint")
    out = out.withColumns({c: F.coalesce(F.col(c), zero) for c in ("len_a", "len_b", "common_count")})
    ok = F.lit(True)
    if schemes is not None:
        for side in ("a", "b"):
            flag = schemes.select(F.col("page_id").alias(f"{side}_id"), F.col("schemed").alias(f"schemed_{side}"))
            out = out.join(flag, f"{side}_id", "left")
        ok = F.col("schemed_a").eqNullSafe(F.col("schemed_b"))
    ratio = _ratio(F.col("common_count"), F.col("len_a"), F.col("len_b"))
    return out.select(
        "a_id",
        "b_id",
        F.when(ok, ratio).alias("common_ratio_of_min"),
        *[F.when(ok, F.col(c)).alias(c) for c in ("common_count", "len_a", "len_b")],
        F.when(ok, "ok").otherwise("scheme_mismatch").alias("status"),
    )


#: What the stored item table can hold: the items of a page as SQL text over its tags, and how they are compared.
FEATURES = {
    "title_text": (X.title_word_array, FULL),
    "stylesheet": (lambda: X.link_array("stylesheet"), PATH_NO_QUERY),
    "script": (X.script_array, PATH_NO_QUERY),
    "img": (X.img_array, NO_FILENAME),
    "div_style": (X.div_style_array, FULL),
    "icon": (lambda: X.link_array("shortcuticon"), REDUCED),
}
PAGE = ""
DEFAULT = "default_icon"


def item_table(pages: DataFrame, *features: str, parts: int | None = None) -> DataFrame:
    """`(page_id, feature, item, cnt)`: the comparison keys of several features, from one pass over the pages.

    Each page also has a row of the feature `PAGE`, whose item is `1` where its base URL has a scheme and `0` where not, so that pages
    without items are known; with icons it has one of the feature `default_icon`. Style keys are joined by `;`.
    """
    for feature in features:
        if feature not in FEATURES:
            raise ValueError(f"unknown feature {feature!r}")
    tagged = _tagged(pages)
    if "title_text" in features:
        tagged = X.with_titles(tagged)
    row = lambda feature, base, item: f"named_struct('feature', '{feature}', 'base', {base}, 'item', {item})"
    found = [f"array({row(PAGE, 'base_url', f"CASE WHEN {_SCHEMED} THEN '1' ELSE '0' END")})"]
    found += [f"transform({FEATURES[f][0]()}, x -> {row(f, 'base_url', 'x')})" for f in features]
    if "icon" in features:
        found.append(f"array({row(DEFAULT, U.site('url'), f"'{DEFAULT_ICON}'")})")
    rows = tagged.select("page_id", F.expr(f"inline(concat({', '.join(found)}))"))
    modes = {f: FEATURES[f][1] for f in features} | ({DEFAULT: REDUCED} if "icon" in features else {})
    linked = [f for f, mode in modes.items() if mode != FULL]
    if linked:
        # Only links are resolved; all else has none to resolve.
        rows = rows.withColumn("__link", F.expr(f"CASE WHEN feature IN ({', '.join(f"'{f}'" for f in linked)}) THEN item END"))
        rows = U.with_reduced(U.with_resolved(rows, "base", "__link", "__full"), "__full", "__reduced")
        cuts = {PATH_NO_QUERY: U.path_structure("__reduced"), NO_FILENAME: U.without_filename("__reduced"), REDUCED: "__reduced"}
        keys = " ".join(f"WHEN feature = '{f}' THEN {cuts[modes[f]]}" for f in linked)
        rows = rows.withColumn("item", F.expr(f"CASE {keys} ELSE item END"))
    many = f"CASE WHEN feature IN ({', '.join(f"'{f}'" for f in [*linked, PAGE])}) THEN CAST(1 AS BIGINT) ELSE count(1) END"
    # Dealt by page alone, the rows need no other exchange to be counted, nor to be written in buckets by page.
    rows = rows if parts is None else rows.repartition(parts, "page_id")
    return rows.groupBy("page_id", "feature", "item").agg(F.expr(many).alias("cnt"))


def stored_items(pages: DataFrame, *features: str, buckets: int | None = None, name: str | None = None) -> DataFrame:
    """The item table, written once on the shared checkpoint storage in buckets by page and read back.

    The one exchange deals by page; what reads the table by page joins and counts without another. `name` keeps it in the catalog.
    """
    spark = pages.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_folder(spark)
    table = name or f"page_items_{folder.rsplit('-', 1)[1]}"
    item_table(pages, *features, parts=n).write.bucketBy(n, "page_id").sortBy("page_id").option("path", folder).saveAsTable(table)
    return spark.table(table)


def feature_items(items: DataFrame, feature: str) -> DataFrame:
    return items.where(F.col("feature") == feature).select("page_id", "item", "cnt")


def feature_similarity(pairs: DataFrame, items: DataFrame, feature: str) -> DataFrame:
    """`pair_similarity` of one feature of an item table."""
    schemes = feature_items(items, PAGE).select("page_id", (F.col("item") == "1").alias("schemed"))
    return pair_similarity(pairs, feature_items(items, feature), schemes=schemes)


def sim_title_text(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    return feature_similarity(pairs, stored_items(pages, "title_text"), "title_text")


def sim_stylesheet(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    return feature_similarity(pairs, stored_items(pages, "stylesheet"), "stylesheet")


def sim_script(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    return feature_similarity(pairs, stored_items(pages, "script"), "script")


def sim_img(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    return feature_similarity(pairs, stored_items(pages, "img"), "img")


def sim_div_style(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    return feature_similarity(pairs, stored_items(pages, "div_style"), "div_style")


def page_icons(items: DataFrame) -> DataFrame:
    """Per page of an item table: reduced icon URLs (sorted set), the reduced default icon, whether the base has a scheme."""
    of = lambda feature: F.when(F.col("feature") == feature, F.col("item"))
    return items.where(F.col("feature").isin(PAGE, "icon", DEFAULT)).groupBy("page_id").agg(
        F.sort_array(F.collect_set(of("icon"))).alias("icons"),
        F.max(of(DEFAULT)).alias("default_icon"),
        (F.max(of(PAGE)) == "1").alias("schemed"),
    )


def same_icon(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """`icon_similarity` of pages."""
    return icon_similarity(pairs, stored_items(pages, "icon"))


def icon_similarity(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Do two pages share an icon, without and with the default icon for a page that names none.

    `(a_id, b_id, same, same_with_default, n_a, n_b, icons_a, icons_b, status)`.
    """
    profile = page_icons(items)
    out = pairs
    for side in ("a", "b"):
        out = out.join(
            profile.select(
                F.col("page_id").alias(f"{side}_id"),
                F.col("icons").alias(f"icons_{side}"),
                F.col("default_icon").alias(f"default_{side}"),
                F.col("schemed").alias(f"schemed_{side}"),
            ),
            f"{side}_id",
        )
    filled = [
        F.when(F.size(f"icons_{s}") == 0, F.array(f"default_{s}")).otherwise(F.col(f"icons_{s}")) for s in "ab"
    ]
    same = F.arrays_overlap("icons_a", "icons_b")
    ok = F.col("schemed_a") == F.col("schemed_b")
    metrics = {
        "same": same,
        "same_with_default": same | F.arrays_overlap(*filled),
        "n_a": F.size("icons_a").cast("bigint"),
        "n_b": F.size("icons_b").cast("bigint"),
        "icons_a": F.col("icons_a"),
        "icons_b": F.col("icons_b"),
    }
    return out.select(
        "a_id",
        "b_id",
        *[F.when(ok, value).alias(name) for name, value in metrics.items()],
        F.when(ok, "ok").otherwise("scheme_mismatch").alias("status"),
    )


def best_targets(
    suspects: DataFrame,
    targets: DataFrame,
    feature: Feature,
    k: int,
    compare: str = FULL,
    seed_postings: int = 1000,
) -> DataFrame:
    """The `k` target pages each suspect page looks most like (see `best_target_items`).

    The items are written out: they are read several times, and the pages should be parsed once.
    """
    items_a = stored(page_items(suspects, feature, compare))
    items_b = items_a if targets is suspects else stored(page_items(targets, feature, compare))
    return best_target_items(items_a, items_b, k, seed_postings)


def _classes(items: DataFrame, numbers: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """`(id, class)` of the pages, and `(class, len, items, first)`: pages with the same items and length are one class.

    Classes and items are numbers: they stand in every candidate. Items without a number are left out after `len` is summed;
    the others are listed as often as `cnt` says on side `a`, once on side `b`. They are a page's own, so bounded by it.
    """
    name = f"class_{side}"
    listed = "array_repeat(number, CAST(cnt AS INT))" if side == "a" else "array(number)"
    numbered = items.join(numbers, "item", "left").withColumn("listed", F.expr(f"CASE WHEN number IS NOT NULL THEN {listed} END"))
    pages = numbered.groupBy(F.col("page_id").alias("id")).agg(F.sum("cnt").alias("len"), F.sort_array(F.flatten(F.collect_list("listed"))).alias("items"))
    pages = stored(pages.withColumn("same", F.sha2(F.to_json(F.struct("items", "len")), 256)))
    classes = pages.groupBy("same").agg(F.any_value("len").alias(f"len_{side}"), F.any_value("items").alias(f"items_{side}"), F.min("id").alias(f"first_{side}"))
    classes = stored(classes.withColumn(name, F.monotonically_increasing_id()))
    return stored(pages.join(classes.select("same", name), "same").select("id", name)), classes.drop("same")


def _first(df: DataFrame, by: str, k: int, *order: Column | str) -> DataFrame:
    """The first `k` rows of every `by`; the limit is applied before the shuffle too."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k).drop("place")


def best_target_items(items_a: DataFrame, items_b: DataFrame, k: int, seed_postings: int = 1000, split_rows: int = 10_000) -> DataFrame:
    """`(a_id, b_id, common_count, len_a, len_b, common_ratio_of_min, rank)` for the top `k`, ties by `b_id`.

    Only targets that share an item are listed, never the page itself. The result is exact:

    * pages with the same items and length form a class; of a target class only the `k + 1` smallest ids can reach a top `k`;
    * the items of a suspect are ordered by how many target classes hold them. A first set of candidates comes from its rare items, up
      to `seed_postings` postings, and from the `k + 1` first classes of each length in the posting of every item. The place `k + 1`
      among them is a threshold that its best targets must reach;
    * a target that shares none of the items before the r-th has at most the counts from the r-th on in common. Only where that
      over the smaller length reaches the threshold is the posting of the r-th item read. For the last item nothing is left to
      read: who shares that alone and is not among the first of its length is beaten by those who are.

    Postings of an item in more than `split_rows` classes are dealt to several parts, each with its own copy of the askers.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    numbers = stored(items_b.select("item").where("item IS NOT NULL").distinct().withColumn("number", F.monotonically_increasing_id()))
    member_a, class_a = _classes(items_a, numbers, "a")
    member_b, class_b = _classes(items_b, numbers, "b")
    postings = stored(class_b.select("class_b", "len_b", "first_b", F.explode("items_b").alias("item")))
    frequency = postings.groupBy("item").agg(F.count(F.lit(1)).alias("df"))

    # Per suspect class and item: how many postings up to it, and what may still be shared from it on.
    asked = class_a.select("class_a", "len_a", F.explode("items_a").alias("item")).groupBy("class_a", "len_a", "item").agg(F.count(F.lit(1)).alias("cnt")).join(frequency, "item")
    rising = Window.partitionBy("class_a").orderBy("df", "item")
    asked = asked.withColumns(
        {
            "upto": F.sum("df").over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "open": F.sum("cnt").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "is_last": F.lead("item").over(rising).isNull(),
        }
    )
    asked = stored(asked)

    by_length = F.row_number().over(Window.partitionBy("item", "len_b").orderBy("first_b"))
    heads = postings.withColumn("place", by_length).where(F.col("place") <= k + 1).select("item", "class_b")
    seeds = asked.where(F.col("upto") <= seed_postings).select("class_a", "item").join(postings.select("item", "class_b"), "item")
    seeds = seeds.select("class_a", "class_b").unionByName(asked.select("class_a", "item").join(heads, "item").select("class_a", "class_b"))
    seeds = stored(_scored(seeds.distinct(), class_a, class_b))
    # With fewer classes than that, anything may be among the best.
    reached = _first(seeds, "class_a", k + 1, F.desc("ratio"), "first_b").groupBy("class_a").agg(F.count(F.lit(1)).alias("n"), F.min("ratio").alias("least"))
    threshold = reached.select("class_a", F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(0.0)).alias("least"))

    more = asked.where((F.col("upto") > seed_postings) & ~F.col("is_last")).join(threshold, "class_a", "left")
    hopeful = "open >= coalesce(least, 0D) * greatest(1, least({0}))"
    # Whatever the target's length, it is at least 1.
    more = more.where(hopeful.format("1, len_a")).withColumn("parts", F.ceil(F.col("df") / split_rows).cast("int"))
    more = more.withColumnRenamed("least", "must").select("class_a", "item", "len_a", "open", "must", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = postings.join(frequency, "item").select("item", "class_b", "len_b", F.expr(f"CAST(pmod(xxhash64(class_b), CAST(ceil(df / {split_rows}) AS INT)) AS INT)").alias("part"))
    reach = "open >= coalesce(must, 0D) * greatest(1, least(len_a, len_b))"
    others = more.join(dealt, ["item", "part"]).where(reach).select("class_a", "class_b").distinct()
    others = others.join(seeds.select("class_a", "class_b"), ["class_a", "class_b"], "left_anti")
    scored = seeds.unionByName(_scored(others, class_a, class_b))

    # Every class brings its smallest id at least, so the best k + 1 classes by ratio and that id suffice.
    scored = _first(scored, "class_a", k + 1, F.desc("ratio"), "first_b")
    leaders = _first(member_b.select("class_b", F.col("id").alias("b_id")), "class_b", k + 1, "b_id")
    led = _first(scored.join(leaders, "class_b"), "class_a", k + 1, F.desc("ratio"), "b_id")
    pairs = member_a.select(F.col("id").alias("a_id"), "class_a").join(led, "class_a").where(F.col("a_id") != F.col("b_id"))
    best = Window.partitionBy("a_id").orderBy(F.desc("ratio"), "b_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("a_id", "b_id", "common_count", "len_a", "len_b", F.col("ratio").alias("common_ratio_of_min"), "rank")


def _scored(pairs: DataFrame, class_a: DataFrame, class_b: DataFrame) -> DataFrame:
    """Candidate pairs of classes with what they have in common."""
    common = "CAST(size(filter(items_a, e -> array_contains(items_b, e))) AS BIGINT)"
    rows = pairs.join(class_a.drop("first_a"), "class_a").join(class_b, "class_b").withColumn("common_count", F.expr(common))
    ratio = _ratio(F.col("common_count"), F.col("len_a"), F.col("len_b"))
    return rows.select("class_a", "class_b", "first_b", "len_a", "len_b", "common_count", ratio.alias("ratio"))
