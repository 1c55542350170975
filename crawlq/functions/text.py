"""Text helpers shared by the page and URL jobs.

The helpers take and return Spark SQL expression text; `F.expr` turns it into a column.
One parsed text costs one call to the JVM, where a column built function by function costs hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words the page vocabulary leaves out.
STOP_WORDS = (
    "div", "span", "input", "form", "link", "script", "meta", "style", "img", "h1",
    "h2", "h3", "p", "br", "class", "id", "tr", "td", "label", "a",
)

WORD = "[0-9a-zA-Z]+"
WHITESPACE = " \t\n\r\x0b\x0c"


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values) -> str:
    return ", ".join(literal(v) for v in values)


def once(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimiser copies a projected expression into filters, join keys and lambdas above it, so a
    page regex could run many times per row. It never copies through a generator, and a
    one-element `inline` is the cheapest one. Filters on other columns still move below it.
    """
    values = [(F.expr(v) if isinstance(v, str) else v).alias(name) for name, v in columns.items()]
    added = F.inline(F.array(F.struct(*values)))
    return df.select(*[c for c in df.columns if c not in columns], added)


def strip(text: str) -> str:
    """Drop leading and trailing whitespace of every kind (`trim` only drops blanks)."""
    return f"btrim({text}, {literal(WHITESPACE)})"


def strip_chars(text: str, chars: str) -> str:
    return f"btrim({text}, {literal(chars)})"


def compact_lower(html: str = "html") -> str:
    """The page as one lower-case line: newlines are removed, not replaced."""
    return f"lower(replace(coalesce({html}, ''), {literal(chr(10))}, ''))"


def words(text: str) -> str:
    """All runs of ASCII letters and digits, in order, duplicates kept."""
    return f"regexp_extract_all({text}, {literal(WORD)}, 0)"


def unescape(text: str) -> str:
    """Decode the five basic character references; `&amp;` goes last so nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = f"replace({text}, {literal(name)}, {literal(char)})"
    return text


def percent_decode_once(text: str) -> str:
    """One round of percent-decoding that leaves `+` and malformed escapes as they are."""
    malformed = literal("%(?![0-9a-fA-F]{2})")
    return f"url_decode(regexp_replace(replace({text}, '+', '%2B'), {malformed}, '%25'))"


def percent_decode_fully(text: str) -> str:
    """Percent-decode until nothing changes.

    Each round that changes something shortens the text by two characters or more,
    so half the length bounds the rounds; once stable the remaining rounds are no-ops.
    """
    return f"""aggregate(sequence(0, CAST(floor(length({text}) / 2) AS INT)),
        named_struct('t', {text}, 'done', false),
        (s, i) -> CASE WHEN s.done THEN s
          ELSE transform(array({percent_decode_once('s.t')}), x -> named_struct('t', x, 'done', x <=> s.t))[0] END,
        s -> s.t)"""
