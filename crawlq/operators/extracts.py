"""Per-page extracts: links, texts, icons, scripts, inputs, flags.

Rows come out as `(page_id, pos, item)` in document order with duplicates kept. All of them
are narrow: one scan of the pages, no shuffle, until a job counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.functions import html as H
from crawlq.functions import text as T
from crawlq.functions import urls as U
from crawlq.functions.text import literal
from crawlq.operators.tags import attr_items

# The page patterns.
HREF = r"""<\s*[^>]+\s+href\s*=\s*['"]([^'"]*)['"]"""
HTML_TAG = r"<\s*html(\s+[^>]*)?>"
CHARSET = (
    r"""(?i)<meta\s+[^<]*content\s*=['"][^'"]*charset\s*=([-_0-9a-zA-Z]+)\s*[^'"]*['"][^<]*>"""
)
UNESCAPE_CALL = r"document.write\s*\(\s*unescape\s*\(([^)]+)"
REFRESH_URL = r"(?d)(?:URL|url)\s*=\s*(.*)"
IMAGE_INPUT = r"""<\s*input\s+[^>]*type\s*=\s*['"]image['"][^>]*>"""
SELECT_TAG = r"<\s*select\s*[^>]+>"
OPTION_TAG = r"<\s*option\s*[^>]+>"
DEFAULT_CHARSET = "utf-8"


def _explode_texts(df: DataFrame, items: str, *keep: str) -> DataFrame:
    rows = df.select(*keep, F.expr(f"posexplode_outer({items})").alias("pos", "item"))
    return rows.where("item IS NOT NULL")


def href_items(pages: DataFrame) -> DataFrame:
    """The last quoted `href` of every tag, from the lower-cased page."""
    return _explode_texts(pages, f"regexp_extract_all({T.compact_lower()}, {literal(HREF)}, 1)", "page_id")


def with_titles(tagged: DataFrame) -> DataFrame:
    """Add `titles`: texts of title elements that hold one text and nothing else."""
    text, end = "try_element_at(tags, i + 2)", "try_element_at(tags, i + 3)"
    found = f"""transform(tags, (t, i) -> CASE WHEN t.kind = 'open' AND t.tag = 'title' AND {text}.kind = 'text'
        AND {end}.kind = 'close' AND {end}.tag = 'title' THEN {T.unescape(f'{text}.raw')} END)"""
    return T.once(tagged, {"titles": f"filter({found}, x -> x IS NOT NULL)"})


def titles(pages: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """All title texts, lower-cased unless asked otherwise."""
    rows = _explode_texts(with_titles(H.with_tags(pages)), "titles", "page_id")
    return rows if case_sensitive else rows.withColumn("item", F.lower("item"))


# The same extracts as arrays over `tags`, SQL text, for jobs that take several from one pass over a page.
def _attr_array(tags: str, name: str) -> str:
    """Attribute `name` of an array of tags, where it is not blank."""
    return f"filter(transform({tags}, t -> {H.attr('t.raw', name)}), x -> x RLIKE {literal(r'\S')})"


def _rel_is(raw: str, rel: str) -> str:
    return f"lower(regexp_replace({H.attr(raw, 'rel')}, {literal(r'\s+')}, '')) = '{rel}'"


def _script_counts(raw: str) -> str:
    return f"coalesce(lower({H.attr(raw, 'type')}), 'text/javascript') = 'text/javascript'"


def _style_names(raw: str) -> str:
    name = T.strip("lower(substring_index(s, ':', 1))")
    names = f"transform(split(coalesce({H.attr(raw, 'style')}, ''), ';'), s -> {name})"
    return f"sort_array(array_distinct(filter({names}, n -> n <> '')))"


def title_word_array() -> str:
    """Over the `titles` of `with_titles`."""
    return T.words("lower(array_join(titles, ' '))")


def link_array(rel: str) -> str:
    return _attr_array(f"filter({H.tags_named('link')}, t -> {_rel_is('t.raw', rel)})", "href")


def script_array() -> str:
    return _attr_array(f"filter({H.tags_named('script')}, t -> {_script_counts('t.raw')})", "src")


def img_array() -> str:
    return _attr_array(H.tags_named("img"), "src")


def div_style_array(threshold: int = 3) -> str:
    """Style keys joined by `;`, which no name holds."""
    divs = f"filter({H.tags_named('div')}, t -> contains(lower(t.raw), 'style'))"
    return f"transform(filter(transform({divs}, t -> {_style_names('t.raw')}), x -> size(x) >= {threshold}), x -> array_join(x, ';'))"


def _links(pages: DataFrame, rel: str) -> DataFrame:
    tags = H.select_tags(H.with_tags(pages), "link").where(_rel_is("raw", rel))
    return attr_items(tags, "href", accept_empty=False)


def shortcut_icons(pages: DataFrame) -> DataFrame:
    """`href` of `link` tags whose `rel` words are exactly `shortcut icon`."""
    return _links(pages, "shortcuticon")


def stylesheets(pages: DataFrame) -> DataFrame:
    """`href` of `link` tags whose `rel` is exactly `stylesheet`."""
    return _links(pages, "stylesheet")


def script_srcs(pages: DataFrame) -> DataFrame:
    """`src` of scripts without a type or of type `text/javascript`."""
    tags = H.select_tags(H.with_tags(pages), "script").where(_script_counts("raw"))
    return attr_items(tags, "src", accept_empty=False)


def div_style_keys(pages: DataFrame, threshold: int = 3) -> DataFrame:
    """Per `div`: sorted distinct style property names, kept when there are at least `threshold`."""
    tags = H.select_tags(H.with_tags(pages), "div").where("contains(lower(raw), 'style')")
    return T.once(tags, {"item": _style_names("raw")}).where(F.size("item") >= threshold).select("page_id", "pos", "item")


def visible_text(pages: DataFrame) -> DataFrame:
    """Visible text pieces, trimmed, empty ones dropped."""
    texts = f"filter(tags, t -> t.kind = 'text' AND t.raw RLIKE {literal(r'\S')})"
    rows = H.explode_tags(H.with_hidden_spans(H.with_tags(pages)), H.outside(texts))
    return T.once(rows.select("page_id", "pos", "raw"), {"item": H.plain("raw")}).drop("raw").where("item <> ''")


def page_words(pages: DataFrame) -> DataFrame:
    """Letter-digit runs of the lower-cased page, tags included, without the stop words."""
    kept = f"filter({T.words(T.compact_lower())}, w -> w NOT IN ({T.literals(T.STOP_WORDS)}))"
    return _explode_texts(pages, kept, "page_id")


def title_words(pages: DataFrame) -> DataFrame:
    """Letter-digit runs of all lower-cased titles of a page, stop words kept."""
    words = T.words("lower(array_join(titles, ' '))")
    return _explode_texts(with_titles(H.with_tags(pages)), words, "page_id")


def word_counts(words: DataFrame) -> DataFrame:
    """Occurrences per word."""
    return words.groupBy(F.col("item").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def _visible_anchors(pages: DataFrame) -> DataFrame:
    """Visible `a` tags with `has_img`: an image follows before the next `a` starts or ends."""
    line = H.tags_named("a", "img", kinds=("open", "close"))
    tagged = T.once(H.with_hidden_spans(H.with_tags(pages)), {"__line": line})
    marked = """transform(__line, (t, i) -> named_struct('pos', t.pos, 'kind', t.kind, 'tag', t.tag, 'raw', t.raw,
        'has_img', coalesce(try_element_at(__line, i + 2).tag = 'img', false)))"""
    return H.explode_tags(tagged, H.shown(f"filter({marked}, t -> t.tag = 'a' AND t.kind = 'open')"))


def a_hrefs(pages: DataFrame) -> DataFrame:
    """`href` of visible `a` tags, empty ones kept."""
    return attr_items(_visible_anchors(pages), "href")


def a_hrefs_with_img(pages: DataFrame) -> DataFrame:
    """Non-empty `href` of visible `a` tags around an image."""
    return attr_items(_visible_anchors(pages).where("has_img"), "href", accept_empty=False)


def img_srcs(pages: DataFrame, is_visible: bool = False) -> DataFrame:
    """Non-empty `src` of images, of all or only of the visible ones."""
    return attr_items(H.select_tags(H.with_tags(pages), "img", visible=is_visible), "src", accept_empty=False)


def form_actions(pages: DataFrame) -> DataFrame:
    """Non-empty `action` of forms; visibility is not looked at."""
    return attr_items(H.select_tags(H.with_tags(pages), "form"), "action", accept_empty=False)


def form_flags(pages: DataFrame) -> DataFrame:
    """Per page: has a form, has a form with an `action` attribute (even an empty one)."""
    tagged = T.once(H.with_tags(pages), {"__forms": H.tags_named("form", kinds=("open",))})
    return tagged.select(
        "page_id",
        F.expr("size(__forms) > 0").alias("has_form"),
        F.expr(f"exists(__forms, t -> {H.attr('t.raw', 'action')} IS NOT NULL)").alias("has_form_action"),
    )


def input_type(raw: str) -> str:
    return f"coalesce(lower({H.attr(raw, 'type')}), 'text')"


def visible_inputs(
    pages: DataFrame, types: tuple[str, ...] | None = None, exclude_types: tuple[str, ...] | None = None
) -> DataFrame:
    """Visible inputs `(page_id, pos, type, name)`; a missing type is `text`."""
    for given in (types, exclude_types):
        if given is not None and not isinstance(given, tuple):
            raise TypeError(f"input types must be a tuple, not {type(given).__name__}")
    tags = H.select_tags(H.with_tags(pages), "input", visible=True)
    rows = tags.select(
        "page_id", "pos", F.expr(input_type("raw")).alias("type"), F.expr(H.attr("raw", "name")).alias("name")
    )
    if types is not None:
        rows = rows.where(F.col("type").isin(*types))
    if exclude_types is not None:
        rows = rows.where(~F.col("type").isin(*exclude_types))
    return rows


def textareas(pages: DataFrame) -> DataFrame:
    """Visible text areas `(page_id, pos, name)`."""
    tags = H.select_tags(H.with_tags(pages), "textarea", visible=True)
    return tags.select("page_id", "pos", F.expr(H.attr("raw", "name")).alias("name"))


def markup_items(pages: DataFrame) -> DataFrame:
    """`(page_id, what, pos, item)` of image inputs, selects and options, by pattern, visible or not."""
    page = T.once(pages, {"__line": T.compact_lower()}).drop("html")
    found = [
        f"""transform(regexp_extract_all(__line, {literal(pattern)}, 0),
            (x, i) -> named_struct('what', '{what}', 'pos', i, 'item', x))"""
        for what, pattern in (("image_input", IMAGE_INPUT), ("select", SELECT_TAG), ("option", OPTION_TAG))
    ]
    rows = page.select("page_id", F.expr(f"explode_outer(concat({', '.join(found)}))").alias("m"))
    return rows.where("m IS NOT NULL").select("page_id", "m.*")


def refresh_tags() -> str:
    """The refresh `meta` tags that come before the body."""
    equiv = f"lower({T.strip(f"coalesce({H.attr('t.raw', 'http-equiv')}, '')")})"
    metas = f"filter({H.tags_named('meta', kinds=('open',))}, t -> {equiv} = 'refresh')"
    return f"filter({metas}, t -> t.pos < coalesce({H.first_pos('body')}, {2**31 - 1}))"


def refresh_url(raw: str) -> str:
    """What follows the first `url=` of a refresh tag; quotes stay. NULL without one."""
    content = f"coalesce({H.attr(raw, 'content')}, '')"
    pattern = literal(REFRESH_URL)
    return f"CASE WHEN {content} RLIKE {pattern} THEN regexp_extract({content}, {pattern}, 1) END"


def meta_refresh(pages: DataFrame) -> DataFrame:
    """Targets of refresh tags before the body, as written."""
    rows = H.explode_tags(H.with_tags(pages), refresh_tags())
    rows = T.once(rows.select("page_id", "pos", "raw"), {"item": refresh_url("raw")}).drop("raw")
    return rows.where("item IS NOT NULL")


def with_base_url(tagged: DataFrame, base_tag_only: bool = False) -> DataFrame:
    """Add `base_url`: the first `base` tag's `href` resolved on the page URL, else the page URL."""
    if "base_url" in tagged.columns:
        return tagged
    first = f"try_element_at({H.tags_named('base', kinds=('open',))}, 1).raw"
    tagged = T.once(tagged, {"__base": first})
    tagged = T.once(tagged, {"__href": f"coalesce({H.attr('__base', 'href')}, '')"})
    tagged = U.with_resolved(tagged, "url", "__href", "__resolved")
    own = "CAST(NULL AS STRING)" if base_tag_only else "url"
    found = f"CASE WHEN __base IS NULL THEN {own} ELSE __resolved END"
    return tagged.withColumns({"base_url": F.expr(found)}).drop("__base", "__href", "__resolved")


def base_url(pages: DataFrame, base_tag_only: bool = False) -> DataFrame:
    """Per page: its base URL."""
    return with_base_url(H.with_tags(pages), base_tag_only).select("page_id", "base_url")


def charset(pages: DataFrame) -> DataFrame:
    """Per page: the charset of a `meta … content` tag, lower-cased, `utf-8` without one."""
    found = f"nullif(lower(regexp_extract(coalesce(html, ''), {literal(CHARSET)}, 1)), '')"
    return T.once(pages.select("page_id", "html"), {"charset": f"coalesce({found}, '{DEFAULT_CHARSET}')"}).drop("html")


def charset_counts(pages: DataFrame) -> DataFrame:
    """Pages per charset."""
    return charset(pages).groupBy("charset").agg(F.count(F.lit(1)).alias("n"))


def page_flags(pages: DataFrame, keyword: str = "login") -> DataFrame:
    """Per page: an html tag, `search`, `subscri`, and a keyword anywhere in the lower-cased page."""
    page = T.once(pages, {"__line": T.compact_lower()})
    line = F.col("__line")
    return page.select(
        "page_id",
        "url",
        line.rlike(HTML_TAG).alias("has_html"),
        line.contains("search").alias("has_search"),
        line.contains("subscri").alias("has_subscri"),
        line.contains(keyword).alias("has_keyword"),
    )


def site_flag_counts(pages: DataFrame, keyword: str = "login") -> DataFrame:
    """Pages with each flag per host."""
    return page_flags(pages, keyword).groupBy(F.expr(U.host_or_empty("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        *[F.count_if(f).alias(f"n_{f[4:]}") for f in ("has_html", "has_search", "has_subscri", "has_keyword")],
    )


def write_unescape_forms(pages: DataFrame) -> DataFrame:
    """Per page: do the `document.write(unescape(…` arguments decode to a form with an input."""
    calls = f"regexp_extract_all({T.compact_lower()}, {literal(UNESCAPE_CALL)}, 1)"
    page = T.once(pages.select("page_id", "html"), {"__raw": f"array_join({calls}, ' ')"}).drop("html")
    # The decode loop only runs for the pages that have such a call.
    page = T.once(page, {"__text": f"CASE WHEN __raw <> '' THEN {T.percent_decode_fully('__raw')} END"})
    hit = "coalesce(contains(__text, '<form') AND contains(__text, '<input'), false)"
    return page.select("page_id", F.expr(hit).alias("writes_form"))
