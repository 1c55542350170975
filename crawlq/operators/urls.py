"""URL jobs: profiling, tokens, reduction, matching and site rollups.

Input: a table with `url_id` (its row key) and a URL column. Everything per URL is a
narrow projection; only the counts and the matches shuffle, after a map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.functions import urls as U
from crawlq.functions.text import literal, once, strip


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """The table with scheme, netloc, hostname, port, path, params, query and fragment added."""
    return U.with_url_parts(df, url)


def host_kind_counts(hosts: DataFrame, host: str = "host") -> DataFrame:
    """Hosts per kind: `ipv4`, `ipv6`, `name`."""
    return hosts.groupBy(F.expr(U.host_kind(host)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _with_query(df: DataFrame, url: str) -> DataFrame:
    """Add `__params`: one `struct<k,v>` per key in first-seen order, with the value seen last."""
    df = once(df, {"__pairs": U.query_pairs(U.url_part(url, "query"))})
    keys = "array_distinct(transform(__pairs, p -> p.k))"
    return once(df, {"__params": f"transform({keys}, k -> element_at(filter(__pairs, p -> p.k = k), -1))"})


def url_query_params(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows `(url_id, k, v)`: split on `&` and the first `=`, last duplicate wins, no decoding."""
    rows = _with_query(df, url).select("url_id", F.explode_outer("__params").alias("p"))
    return rows.where("p IS NOT NULL").select("url_id", "p.k", "p.v")


def ext_counts(df: DataFrame, url: str = "url") -> DataFrame:
    """URLs per file extension (`''` for none)."""
    ext = F.expr(U.file_extension(U.url_part(url, "path")))
    return df.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def _host_tokens(host: str, is_normalize: bool, is_prefix_value: bool) -> str:
    text = U.zero_digits(host) if is_normalize else host
    tokens = f"filter(transform(split({text}, '[.]'), t -> {strip('t')}), t -> t <> '')"
    if is_prefix_value:
        tokens = f"transform({tokens}, t -> left(t, {U.PREFIX_LENGTH}))"
    whole = f"CASE WHEN {U.host_kind(host)} <> 'name' THEN array({host}) ELSE {tokens} END"
    return f"coalesce({whole}, CAST(array() AS ARRAY<STRING>))"


def _path_tokens(path: str, append_file_extension: bool) -> str:
    """`/seg/` for the inner segments, then the bare last segment and its raw extension."""
    segments = f"split({path}, '/')"
    inner = f"slice({segments}, 2, greatest(size({segments}) - 2, 0))"
    inner = f"transform(filter({inner}, t -> {strip('t')} <> ''), t -> concat('/', {strip('t')}, '/'))"
    last = f"substring_index({path}, '/', -1)"
    tail = f"array({last})"
    if append_file_extension:
        extension = f"regexp_extract({last}, {literal(r'(?s).([.][^.]*)$')}, 1)"
        tail = f"CASE WHEN {extension} <> '' THEN array({last}, {extension}) ELSE {tail} END"
    return f"CASE WHEN {last} = '' THEN {inner} ELSE concat({inner}, {tail}) END"


def _with_tokens(
    df: DataFrame, url: str, is_normalize: bool, is_prefix_value: bool, append_file_extension: bool, in_order: bool = True
) -> DataFrame:
    """Rows `(url_id, kind, ord, token)`, or `(url_id, kind, token, first)` with equal tokens of a URL side by side and the first of them marked."""
    zero = U.zero_digits if is_normalize else (lambda text: text)
    cut = (lambda text: f"left({text}, {U.PREFIX_LENGTH})") if is_prefix_value else (lambda text: text)
    path = zero(U.url_part(url, "path"))
    rooted = f"CASE WHEN startswith({path}, '/') THEN {path} ELSE concat('/', {path}) END"
    df = once(_with_query(df, url), {"__path": rooted, "__host": U.url_part(url, "hostname")})
    lists = {
        "host": _host_tokens("__host", is_normalize, is_prefix_value),
        "path": _path_tokens("__path", append_file_extension),
        "query_key": f"transform(__params, p -> {zero('p.k')})",
        "query_value": f"transform(__params, p -> {cut(zero('p.v'))})",
    }
    df = once(df, {f"__{kind}_tokens": tokens if in_order else f"array_sort({tokens})" for kind, tokens in lists.items()})
    place = lambda kind: "'ord', i, 'token', t" if in_order else f"'token', t, 'first', i = 0 OR get(__{kind}_tokens, i - 1) <> t"
    tagged = [f"transform(__{kind}_tokens, (t, i) -> named_struct('kind', '{kind}', {place(kind)}))" for kind in lists]
    rows = df.select("url_id", F.expr(f"explode_outer(concat({', '.join(tagged)}))").alias("t"))
    return rows.where("t IS NOT NULL").select("url_id", "t.*")


def url_tokens(
    df: DataFrame,
    url: str = "url",
    is_normalize: bool = False,
    is_prefix_value: bool = False,
    append_file_extension: bool = True,
) -> DataFrame:
    """Rows `(url_id, kind, ord, token)` of host, path, query keys and query values.

    Normalising turns digits into `0`; the prefix form keeps eight characters of host
    tokens and query values. A URL without a host gives no host rows (see `url_status`).
    """
    return _with_tokens(df, url, is_normalize, is_prefix_value, append_file_extension)


def url_status(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows `(url_id, status)`: `ok`, or `no_host` where host tokens are undefined."""
    status = f"CASE WHEN {U.url_part(url, 'hostname')} IS NULL THEN 'no_host' ELSE 'ok' END"
    return df.select("url_id", F.expr(status).alias("status"))


def url_token_counts(
    df: DataFrame, url: str = "url", is_normalize: bool = False, is_prefix_value: bool = False
) -> DataFrame:
    """Per kind and token: occurrences and number of URLs.

    The first occurrence inside each URL is marked before the rows leave it, so the URL count
    is a plain sum with a map-side combine and a token found in every URL costs no hot task.
    """
    rows = _with_tokens(df, url, is_normalize, is_prefix_value, True, in_order=False)
    return rows.groupBy("kind", "token").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("first")).alias("n_urls")
    )


def path_depth_stats(df: DataFrame, url: str = "url") -> DataFrame:
    """Depth of paths per host: number of URLs, mean and maximum."""
    rows = once(df, {"host": U.host_or_empty(url), "level": U.path_level(U.url_part(url, "path"))})
    return rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.avg("level").alias("avg_level"), F.max("level").alias("max_level")
    )


def dedup_urls(df: DataFrame, url: str = "url", does_trim: bool = False, keep_frag: bool = False) -> DataFrame:
    """One row per reduced URL: a representative and the number of URLs behind it."""
    reduced = U.with_reduced(df, url, "reduced", does_trim, keep_frag)
    return reduced.groupBy("reduced").agg(F.min(url).alias("url"), F.count(F.lit(1)).alias("n"))


def match_urls(
    left: DataFrame, right: DataFrame, url: str = "url", does_trim: bool = False, keep_frag: bool = False
) -> DataFrame:
    """Left URLs with the right URLs of the same reduced form: `matched`, a representative, how many.

    The right side is collapsed to one row per key first, so a key shared by many
    URLs on both sides adds one row per left URL, never a product.
    """
    keys = dedup_urls(right, url, does_trim, keep_frag).select(
        "reduced", F.col("url").alias("target_url"), F.col("n").alias("n_targets")
    )
    reduced = U.with_reduced(left, url, "reduced", does_trim, keep_frag)
    joined = reduced.join(keys, "reduced", "left")
    return joined.select(
        "url_id",
        F.col(url).alias("url"),
        F.col("n_targets").isNotNull().alias("matched"),
        "target_url",
        F.coalesce("n_targets", F.lit(0)).cast("bigint").alias("n_targets"),
    )


def site_rollup(df: DataFrame, url: str = "url") -> DataFrame:
    """Per site (`scheme://netloc/`): pages, distinct directories, share of URLs with a scheme."""
    rows = U.with_reduced(df, url, "__reduced").select(
        F.expr(U.site(url)).alias("site"),
        F.expr(U.path_structure("__reduced")).alias("directory"),
        F.expr(f"CAST({U.url_part(url, 'scheme')} <> '' AS INT)").alias("schemed"),
    )
    # First level keyed by site and directory: a site with a third of all URLs spreads over its directories.
    by_directory = rows.groupBy("site", "directory").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("schemed").alias("schemed")
    )
    return by_directory.groupBy("site").agg(
        F.sum("pages").alias("pages"),
        F.count(F.lit(1)).alias("n_directories"),
        (F.sum("schemed") / F.sum("pages")).alias("scheme_share"),
    )


def resolve_links(df: DataFrame, base: str = "base", link: str = "link") -> DataFrame:
    """The table with `resolved`: the link resolved on the base URL of its row."""
    return U.with_resolved(df, base, link, "resolved")
