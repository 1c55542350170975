"""Every registered query: a name and a function of the session and the data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlq.functions.urls import url_part
from crawlq.operators import domains, extracts, fetches, forms, selection, similarity, tags, urls
from crawlq.plans import inputs as I
from crawlq.runtime import scratch_folder
from crawlq.sources import archive, daily, readers
from crawlq.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAILY_END, DAILY_DAYS = "1995-01-31", 31
MISSING_END, MISSING_DAYS = "2001-12-31", 200
DGA_THRESHOLD = 0.3
BAND = (60_000.0, 120_000.0)


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and arrays as text, so that results compare across engines."""
    columns = []
    for field in df.schema:
        if isinstance(field.dataType, T.ArrayType):
            columns.append(I.joined(field.name))
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            columns.append(F.col(field.name).cast("bigint").alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(columns)


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _plain(fn(spark, sf_dir))
        return fn

    return register


def on_pages(name: str, job: Callable[[DataFrame], DataFrame]) -> None:
    query(name)(lambda spark, sf_dir: job(I.pages(spark, sf_dir)))


def on_urls(name: str, job: Callable[[DataFrame], DataFrame]) -> None:
    query(name)(lambda spark, sf_dir: job(I.derived(spark, sf_dir, I.CRAWL_URLS)))


def on_pairs(name: str, job: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    query(name)(lambda spark, sf_dir: job(I.derived(spark, sf_dir, I.PAGE_PAIRS), I.pair_pages(spark, sf_dir)))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = I.table(spark, sf_dir, "pages")
    return page.select(F.expr(url_part("url", "hostname")).alias("host")).distinct()


# Sources and sinks
@query("tld_known")
def _(spark, sf_dir):
    return readers.tld_check(_hosts(spark, sf_dir), readers.tld_lines(I.tld_table(spark)))


@query("tld_unknown")
def _(spark, sf_dir):
    return readers.tld_check(_hosts(spark, sf_dir), readers.tld_lines(I.tld_table(spark)), known=False)


def _archived(spark, sf_dir):
    headers = fetches.header_maps(I.derived(spark, sf_dir, I.HEADER_LINES))
    return I.table(spark, sf_dir, "pages").select("url", "html").join(headers, "url", "left")


query("archive_refs")(lambda spark, sf_dir: archive.archive_refs(_archived(spark, sf_dir)))
query("archive_blobs")(lambda spark, sf_dir: archive.archive_blobs(_archived(spark, sf_dir)))


def _with_meta(spark, sf_dir):
    """Pages as fetches with a small state of their own."""
    meta = F.expr("named_struct('http_code', 200 + page_id % 3, 'finish_download', page_id % 4 <> 0)").alias("meta")
    return I.table(spark, sf_dir, "pages").select("page_id", "url", "html", meta)


query("archive_meta_refs")(lambda spark, sf_dir: archive.archive_refs(_with_meta(spark, sf_dir)).where("part = 'meta'"))


def _grown_archive(spark, sf_dir):
    """Two runs: even pages, then all pages, of which every fifth has changed."""
    folder = scratch_folder(spark)
    pages = _with_meta(spark, sf_dir)
    archive.write_archive(pages.where("page_id % 2 = 0"), folder)
    archive.write_archive(pages.withColumn("html", F.expr("CASE WHEN page_id % 5 = 0 THEN concat(html, '<!-- again -->') ELSE html END")), folder)
    return folder


@query("archive_runs")
def _(spark, sf_dir):
    refs, blobs = archive.archive_runs(spark, _grown_archive(spark, sf_dir))
    counted = refs.groupBy("run").agg(F.count(F.lit(1)).alias("n_refs"))
    return counted.join(blobs.groupBy("run").agg(F.count(F.lit(1)).alias("n_blobs"), F.sum(F.length("body")).alias("n_chars")), "run")


@query("archive_read")
def _(spark, sf_dir):
    held = archive.read_archive(spark, _grown_archive(spark, sf_dir))
    return held.select("url", "part", F.md5("body").alias("body_md5"))


@query("read_page_files")
def _(spark, sf_dir):
    folder = scratch_folder(spark)
    pages = I.table(spark, sf_dir, "pages").select("page_id", "html")
    # The time goes to files, not to bytes, so they are dealt evenly to several tasks per core.
    pages = pages.repartition(max(pages.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism))
    readers.write_pages(pages, folder)
    held = readers.read_pages(spark, folder, recursiveFileLookup="true")  # the folders' names are not columns, nothing is inferred from them
    return held.select(F.regexp_extract("url", "page_id=([0-9]+)", 1).cast("bigint").alias("page_id"), F.md5("html").alias("html_md5"))


@query("read_host_lines")
def _(spark, sf_dir):
    folder = scratch_folder(spark)
    _hosts(spark, sf_dir).select(F.concat(F.lit("  "), "host", F.lit(" ")).alias("value")).write.text(folder)
    return domains.dga_scores(readers.read_hosts(spark, folder))


@query("daily_files")
def _(spark, sf_dir):
    day = F.to_date("o_orderdate")
    spans = I.table(spark, sf_dir, "orders").agg(
        F.max(day).alias("end_date"), (F.datediff(F.max(day), F.min(day)) + 1).alias("n")
    )
    return daily.daily_files(spans, I.FILE_TEMPLATE)


def _orders(job) -> Query:
    return lambda spark, sf_dir: job(I.table(spark, sf_dir, "orders"), "o_orderdate", DAILY_END, DAILY_DAYS)


query("daily_gapfill")(_orders(daily.daily_gapfill))


@query("daily_missing")
def _(spark, sf_dir):
    # The last days lie beyond the last order.
    return daily.daily_missing(I.table(spark, sf_dir, "orders"), "o_orderdate", MISSING_END, MISSING_DAYS)



# URL jobs
on_urls("url_parts", urls.url_parts)
on_urls("url_query_params", urls.url_query_params)
on_urls("ext_counts", urls.ext_counts)
on_urls("url_tokens", lambda u: urls.url_tokens(u, is_normalize=True, is_prefix_value=True))
on_urls("url_tokens_raw", urls.url_tokens)
on_urls("url_token_counts", urls.url_token_counts)
on_urls("url_status", urls.url_status)
on_urls("path_depth_stats", urls.path_depth_stats)
on_urls("dedup_urls", lambda u: urls.dedup_urls(u, does_trim=True))
on_urls("dedup_urls_frag", lambda u: urls.dedup_urls(u, keep_frag=True))
on_urls("site_rollup", urls.site_rollup)


@query("host_kind_counts")
def _(spark, sf_dir):
    crawled = I.derived(spark, sf_dir, I.CRAWL_URLS)
    return urls.host_kind_counts(crawled.select(F.expr(url_part("url", "hostname")).alias("host")))


@query("match_urls")
def _(spark, sf_dir):
    crawled = I.derived(spark, sf_dir, I.CRAWL_URLS)
    return urls.match_urls(crawled, I.table(spark, sf_dir, "pages").select("url"), does_trim=True)


query("resolve_links")(lambda spark, sf_dir: urls.resolve_links(I.derived(spark, sf_dir, I.CRAWL_LINKS)))

# Page tables and extracts
on_pages("page_tags", tags.page_tags)
on_pages("tag_counts", tags.tag_counts)
on_pages("hidden_ranges", tags.hidden_ranges)


def on_stored_tags(name: str, job: Callable[[DataFrame], DataFrame]) -> None:
    """A job on pages that are tokenised, written and read back first."""

    @query(name)
    def _(spark, sf_dir):
        folder = f"{scratch_folder(spark)}/tags"
        tags.write_tags(I.pages(spark, sf_dir), folder)
        return job(tags.read_tags(spark, folder))


on_stored_tags("stored_tag_counts", tags.tag_counts)
on_stored_tags("stored_visible_tags", lambda p: tags.visible_tags(p, "a", "input", "img"))
on_pages("visible_tags", lambda p: tags.visible_tags(p, "a", "input", "img"))
on_pages("href_items", extracts.href_items)
on_pages("titles", extracts.titles)
on_pages("shortcut_icons", extracts.shortcut_icons)
on_pages("stylesheets", extracts.stylesheets)
on_pages("script_srcs", extracts.script_srcs)
on_pages("div_style_keys", extracts.div_style_keys)
on_pages("visible_text", extracts.visible_text)
on_pages("page_words", extracts.page_words)
on_pages("title_words", extracts.title_words)
on_pages("word_counts", lambda p: extracts.word_counts(extracts.page_words(p)))
on_pages("a_hrefs", extracts.a_hrefs)
on_pages("a_hrefs_with_img", extracts.a_hrefs_with_img)
on_pages("img_srcs", lambda p: extracts.img_srcs(p, is_visible=True))
on_pages("all_img_srcs", extracts.img_srcs)
on_pages("titles_case_sensitive", lambda p: extracts.titles(p, case_sensitive=True))
on_pages("base_tag_url", lambda p: extracts.base_url(p, base_tag_only=True))
on_pages("img_file_names", lambda p: similarity.page_items(p, extracts.img_srcs, similarity.FILENAME))
on_pages("form_actions", extracts.form_actions)
on_pages("form_flags", extracts.form_flags)
on_pages("visible_inputs", lambda p: extracts.visible_inputs(p, exclude_types=("hidden", "submit")))
on_pages("textareas", extracts.textareas)
on_pages("markup_items", extracts.markup_items)
on_pages("meta_refresh", extracts.meta_refresh)
on_pages("base_url", extracts.base_url)
on_pages("charset_counts", extracts.charset_counts)
on_pages("page_flags", lambda p: extracts.page_flags(p).drop("url"))
on_pages("site_flag_counts", extracts.site_flag_counts)
on_pages("write_unescape_forms", extracts.write_unescape_forms)


@query("visible_text_len")
def _(spark, sf_dir):
    shown = extracts.visible_text(I.pages(spark, sf_dir))
    return shown.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("item")).alias("n_chars")
    )


@query("document_word_counts")
def _(spark, sf_dir):
    documents = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))
    return extracts.word_counts(extracts.page_words(documents))


# Page pairs
on_pairs("sim_title_text", similarity.sim_title_text)
on_pairs("sim_stylesheet", similarity.sim_stylesheet)
on_pairs("sim_script", similarity.sim_script)
on_pairs("sim_img", similarity.sim_img)
on_pairs("sim_div_style", similarity.sim_div_style)
on_pairs("same_icon", similarity.same_icon)


@query("best_targets_title")
def _(spark, sf_dir):
    page = I.pages(spark, sf_dir)
    return similarity.best_targets(page, page, extracts.title_words, k=3, seed_postings=50)


# Forms
on_pages("page_form_counts", lambda p: forms.page_form_counts(p).drop("url"))
on_pages("classify_forms", lambda p: forms.classify_forms(p).drop("url"))
on_pages("site_form_counts", forms.site_form_counts)
on_pages("form_controls", forms.form_controls)
on_pages("four_in_a_row", forms.four_in_a_row)
on_pages("card_and_code_pairs", forms.card_and_code_pairs)
on_pages("card_form_flags", forms.card_form_flags)
on_pages("card_form_reason", forms.card_form_reason)


# Fetches
@query("page_redirects")
def _(spark, sf_dir):
    page = I.pages(spark, sf_dir)
    return fetches.page_redirects(page).select("page_id", "redirect_url")


@query("page_redirects_pattern")
def _(spark, sf_dir):
    page = I.pages(spark, sf_dir)
    return fetches.page_redirects(page, by_tags=False).select("page_id", "redirect_url")


query("redirect_chains")(lambda spark, sf_dir: fetches.redirect_chains(I.derived(spark, sf_dir, I.FETCHES)))
query("distinct_roots")(lambda spark, sf_dir: fetches.distinct_roots(I.derived(spark, sf_dir, I.FETCHES)))
query("fetch_meta")(lambda spark, sf_dir: fetches.fetch_meta(I.derived(spark, sf_dir, I.URL_CHANGES)))
query("parse_headers")(lambda spark, sf_dir: fetches.parse_headers(I.derived(spark, sf_dir, I.HEADER_LINES)))


@query("fetch_state")
def _(spark, sf_dir):
    captured = I.derived(spark, sf_dir, I.FETCHES)
    return fetches.fetch_meta(fetches.meta_writes(captured, fetches.redirect_chains(captured)))


@query("final_content")
def _(spark, sf_dir):
    captured = I.derived(spark, sf_dir, I.FETCHES)
    meta = fetches.redirect_chains(captured).select(F.col("root").alias("url"), F.col("path").alias("redirect_url_list"))
    good = captured.where("error IS NULL")
    content = good.select(F.col("final_url").alias("url"), F.col("html").alias("body"), "fetched_at")
    return fetches.final_content(captured, meta, content)


# Domains
query("dga_scores")(lambda spark, sf_dir: domains.dga_scores(_hosts(spark, sf_dir)))


@query("dga_site_summary")
def _(spark, sf_dir):
    summary = domains.dga_site_summary(_hosts(spark, sf_dir), DGA_THRESHOLD)
    # Sums of fractions depend on their order in the last digits.
    return summary.withColumn("avg_ratio_total", F.round("avg_ratio_total", 9))


query("dga_lowest")(lambda spark, sf_dir: domains.dga_lowest(_hosts(spark, sf_dir), 20))


# Selection
@query("kth_smallest_grouped")
def _(spark, sf_dir):
    return selection.kth_smallest(I.table(spark, sf_dir, "lineitem"), "l_extendedprice", 5000, by="l_returnflag")


@query("kth_smallest_ties")
def _(spark, sf_dir):
    return selection.kth_smallest(I.table(spark, sf_dir, "lineitem"), "l_quantity", 900, by="l_linestatus")


@query("kth_smallest_narrowed")
def _(spark, sf_dir):
    return selection.kth_smallest(I.table(spark, sf_dir, "lineitem"), "l_extendedprice", 700, by="l_returnflag")


@query("kth_smallest_text")
def _(spark, sf_dir):
    return selection.kth_smallest(I.table(spark, sf_dir, "documents"), "text", 20, by="lang")


@query("kth_smallest_wide")
def _(spark, sf_dir):
    wide = I.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("decimal(38,0)").alias("wide"))
    return selection.kth_smallest(wide, "wide", 3000).select(F.col("kth").cast("string").alias("kth"))


@query("kth_smallest_global")
def _(spark, sf_dir):
    return selection.kth_smallest(I.table(spark, sf_dir, "lineitem"), "l_extendedprice", 1234)


@query("price_band_combos")
def _(spark, sf_dir):
    items = I.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("item"),
        F.col("l_extendedprice").alias("price"),
    )
    chosen = items.where("l_orderkey % 5 = 0 AND item.l_linenumber = 1").select("l_orderkey", "item")
    excluded = items.where("l_orderkey % 7 < 2 AND item.l_linenumber = 2").select("l_orderkey", "item")
    sets = selection.price_band_combos(items, chosen, excluded, *BAND, by="l_orderkey")
    prices = F.array_join(F.col("prices").cast("array<decimal(18,2)>").cast("array<string>"), "|")
    return sets.select("l_orderkey", "size", prices.alias("prices"), "total")


# Streams
@query("stream_dga_scores")
def _(spark, sf_dir):
    hosts = I.stream(spark, sf_dir, "pages").select("page_id", F.expr(url_part("url", "hostname")).alias("host"))
    folder = scratch_folder(spark)
    jobs.dga_scores_stream(hosts, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_fetch_meta")
def _(spark, sf_dir):
    writes = spark.sql(I.URL_CHANGES, events=I.stream(spark, sf_dir, "events"))
    folder = scratch_folder(spark)
    jobs.fetch_meta_stream(writes, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return jobs.read_fetch_meta(spark, f"{folder}/out")
