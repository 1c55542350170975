"""Page markup as arrays of tag structs, built once per page row.

A page is one cell, so everything that only needs that page stays inside its row:
no shuffle, no window. Rows are exploded when a job needs them as rows.
The helpers take and return Spark SQL expression text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.functions.text import literal, literals, once, strip, unescape

# Script, style and comment bodies stay whole; every character lands in exactly one token.
TOKEN = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|</?[a-z][^>]*>|<![^>]*>|[^<]+|<"
)

# Elements without content, elements that hide what they hold, and
# elements that only hide their direct text.
VOID_TAGS = (
    "br", "img", "input", "meta", "link", "hr", "base", "col", "area", "embed", "source", "track", "wbr", "param",
)
HIDING_TAGS = ("style", "script", "head", "title", "meta", "noscript")
TEXT_HIDING_TAGS = ("select", "option")
NEVER_HIDING_TAGS = ("body", "html")
# An open one of these ends at the next one, whether it was closed or not.
SELF_ENDING_TAGS = ("p", "option")

# Page columns that ride along when tags become rows.
CARRIED = ("page_id", "url", "base_url")

DISPLAY_NONE = r"display\s*:\s*[^;]*none"

# One attribute with its optional value. No repeated group, so a tag with any number of words is safe to scan.
ATTRIBUTE = r"""\s([^\s=>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)"""


def attr(raw: str, name: str) -> str:
    """Value of the first attribute `name` of a tag: `''` when bare, NULL when absent."""
    key = f"lower({strip("substring_index(a, '=', 1)")})"
    value = strip("substr(a, length(substring_index(a, '=', 1)) + 2)")
    unquoted = f"""CASE WHEN {value} RLIKE {literal("^[\"']")} THEN substr({value}, 2, length({value}) - 2)
        ELSE {value} END"""
    named = f"filter(regexp_extract_all({raw}, {literal(ATTRIBUTE)}, 1), a -> {key} = '{name}')"
    return f"""CASE WHEN contains(lower({raw}), '{name}')
        THEN try_element_at(transform({named}, a -> {unescape(unquoted)}), 1) END"""


def hides(tag: str, raw: str) -> str:
    """Does this opening tag hide what it holds."""
    lowered = f"lower({raw})"
    by_aria = f"contains({lowered}, 'aria-hidden') AND lower({attr(raw, 'aria-hidden')}) = 'true'"
    by_style = f"""contains({lowered}, 'display') AND contains({lowered}, 'none')
        AND lower({attr(raw, 'style')}) RLIKE {literal(DISPLAY_NONE)}"""
    return f"""CASE WHEN {tag} IN ({literals(HIDING_TAGS + TEXT_HIDING_TAGS)}) THEN true
        WHEN {tag} IN ({literals(NEVER_HIDING_TAGS)}) THEN false
        ELSE coalesce({by_aria}, false) OR coalesce({by_style}, false) END"""


def with_tags(pages: DataFrame) -> DataFrame:
    """Replace `html` by `tags`: `array<struct<pos,kind,tag,raw>>`, one entry per token.

    A table that already has `tags` comes back as it is, so a caller can tokenise once
    (and persist or write the result) and run many extracts on it.
    """
    if "tags" in pages.columns:
        return pages
    name = literal(r"^</?([a-zA-Z][^\s/>]*)")
    kind = f"""CASE WHEN NOT startswith(x, '<') OR x = '<' THEN 'text'
        WHEN startswith(x, '<!--') AND endswith(x, '-->') THEN 'comment'
        WHEN startswith(x, '<!') THEN 'decl'
        WHEN startswith(x, '</') THEN 'close'
        WHEN x RLIKE {literal(r"(?i)^<script\b")} AND x RLIKE {literal(r"(?i)</script\s*>$")} THEN 'script'
        WHEN x RLIKE {literal(r"(?i)^<style\b")} AND x RLIKE {literal(r"(?i)</style\s*>$")} THEN 'style'
        ELSE 'open' END"""
    tokens = f"regexp_extract_all(coalesce(html, ''), {literal(TOKEN)}, 0)"
    tags = f"""transform({tokens}, (x, i) -> named_struct('pos', i, 'kind', {kind},
        'tag', CASE WHEN startswith(x, '<') THEN lower(regexp_extract(x, {name}, 1)) ELSE '' END, 'raw', x))"""
    return once(pages, {"tags": tags}).drop("html")


# The open hidden element ends just before this tag (an implied end) …
_ENDS_BEFORE = f"""(s.name <> '' AND (
    (s.name IN ({literals(SELF_ENDING_TAGS)}) AND t.kind = 'open' AND t.tag = s.name)
    OR (s.name = 'head' AND t.kind = 'open' AND t.tag = 'body')
    OR (s.name = 'li' AND s.depth = 1
      AND ((t.kind = 'open' AND t.tag = 'li') OR (t.kind = 'close' AND t.tag IN ('ul', 'ol'))))))"""
# … or with it (its own end tag).
_ENDS_HERE = "(s.name <> '' AND t.kind = 'close' AND t.tag = s.name AND s.depth = 1)"
_STARTS = f"((s.name = '' OR {_ENDS_BEFORE}) AND t.hides)"
_NESTS = "(t.tag = s.name AND s.name <> 'li') OR (s.name = 'li' AND t.tag IN ('ul', 'ol'))"
_ENDS = f"({_ENDS_BEFORE} OR {_ENDS_HERE})"
_ENDED = f"array(named_struct('lo', s.lo, 'hi', CASE WHEN {_ENDS_BEFORE} THEN t.pos - 1 ELSE t.pos END))"
# Appending copies an array, so spans gather in a short one that joins the long one now and then.
SPANS_HELD = 512
_SPAN_STEP = f"""named_struct(
    'name', CASE WHEN {_STARTS} THEN t.tag WHEN {_ENDS_BEFORE} OR {_ENDS_HERE} THEN '' ELSE s.name END,
    'depth', CASE WHEN {_STARTS} THEN 1
      WHEN {_NESTS} THEN s.depth + CASE WHEN t.kind = 'open' THEN 1 ELSE -1 END ELSE s.depth END,
    'lo', CASE WHEN {_STARTS} THEN t.pos ELSE s.lo END,
    'spans', CASE WHEN {_ENDS} THEN CASE WHEN size(s.spans) < {SPANS_HELD} THEN concat(s.spans, {_ENDED}) ELSE {_ENDED} END
      ELSE s.spans END,
    'full', CASE WHEN {_ENDS} AND size(s.spans) >= {SPANS_HELD} THEN concat(s.full, s.spans) ELSE s.full END)"""


def with_hidden_spans(tagged: DataFrame) -> DataFrame:
    """Add `hidden_spans`, the outermost hidden elements as `array<struct<lo,hi>>` of token positions, and `hidden_flags`.

    One pass over the page's tags follows the hidden element that is open at the moment;
    what lies inside it cannot outlast it. An element left open runs to the end of the page.
    """
    if "hidden_spans" in tagged.columns:
        return tagged
    paired = f"filter(tags, t -> t.kind IN ('open', 'close') AND t.tag NOT IN ({literals(VOID_TAGS)}))"
    slim = f"""transform({paired}, t -> named_struct('pos', t.pos, 'kind', t.kind, 'tag', t.tag,
        'hides', t.kind = 'open' AND {hides('t.tag', 't.raw')}))"""
    none = "CAST(array() AS ARRAY<STRUCT<lo: INT, hi: INT>>)"
    start = f"named_struct('name', '', 'depth', 0, 'lo', 0, 'spans', {none}, 'full', {none})"
    finish = f"""concat(s.full, s.spans, CASE WHEN s.name <> '' THEN array(named_struct('lo', s.lo, 'hi', {2**31 - 1})) ELSE {none} END)"""
    tagged = once(tagged, {"hidden_spans": f"aggregate({slim}, {start}, (s, t) -> {_SPAN_STEP}, s -> {finish})"})
    # One flag per token up to the last hidden one: spans are in order and apart, so they fill in by runs.
    flags = """flatten(transform(hidden_spans, (r, i) -> concat(
        array_repeat(false, r.lo - CASE WHEN i = 0 THEN 0 ELSE hidden_spans[i - 1].hi + 1 END),
        array_repeat(true, least(r.hi, size(tags) - 1) - r.lo + 1))))"""
    return once(tagged, {"hidden_flags": flags})


def outside(tokens: str) -> str:
    """The tokens that lie in none of the hidden spans."""
    return f"filter({tokens}, t -> NOT coalesce(try_element_at(hidden_flags, t.pos + 1), false))"


def shown(tokens: str) -> str:
    """The element tokens that neither hide themselves nor lie in a hidden span."""
    return f"filter({outside(tokens)}, t -> NOT ({hides('t.tag', 't.raw')}))"


def tags_named(*names: str, kinds: tuple[str, ...] = ("open", "script", "style")) -> str:
    return f"filter(tags, t -> t.tag IN ({literals(names)}) AND t.kind IN ({literals(kinds)}))"


def select_tags(tagged: DataFrame, *names: str, visible: bool = False) -> DataFrame:
    """Rows `(page_id, pos, kind, tag, raw)` of the opening tags with these names, all or only visible ones.

    The choice happens inside the array, before anything is exploded.
    """
    if visible:
        tagged = with_hidden_spans(tagged)
    wanted = tags_named(*names)
    return explode_tags(tagged, shown(wanted) if visible else wanted)


def explode_tags(tagged: DataFrame, array: str) -> DataFrame:
    keep = [c for c in CARRIED if c in tagged.columns]
    # Outer explode plus a test on its output: a plain explode makes the optimiser add a
    # size test below it, which evaluates the array a second time.
    rows = tagged.select(*keep, F.expr(f"explode_outer({array})").alias("__t"))
    return rows.where("__t IS NOT NULL").select(*keep, "__t.*")


def first_pos(name: str) -> str:
    """Position of the first opening tag `name`, or NULL."""
    return f"try_element_at({tags_named(name, kinds=('open',))}, 1).pos"


def plain(text: str) -> str:
    return strip(unescape(text))
