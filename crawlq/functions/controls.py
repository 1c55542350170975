"""Form controls of a page as an array, from two markup patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlq.functions.text import literal, once, strip, strip_chars

# Control patterns (hidden inputs are dropped afterwards).
INPUT_CONTROL = r"""<input[^>]+type=['"][^>"']+['"][^>]+>"""
SELECT_CONTROL = r"<select[^>]+>"
HIDDEN_TYPE = r"""type=['"]hidden"""
ATTRIBUTE = r"""\w+ *= *["'][^"']+["']"""
LABEL = r"<\W*(\w+)\W"
NAMES = ("type", "name", "id", "size", "maxlength", "autocomplete", "readonly")


def _number(text: str) -> str:
    """A decimal number, 0 when the attribute is missing, NULL when it is not a number."""
    return f"CASE WHEN {text} IS NULL THEN 0 ELSE try_cast({text} AS INT) END"


def with_controls(pages: DataFrame) -> DataFrame:
    """Replace `html` by `controls`: visible inputs with a quoted type first, then all selects.

    Names and values are case-sensitive; only quoted non-empty attributes count, the last one wins.
    """
    found = lambda pattern: f"regexp_extract_all(coalesce(html, ''), {literal(pattern)}, 0)"
    inputs = f"filter({found(INPUT_CONTROL)}, m -> NOT (m RLIKE {literal(HIDDEN_TYPE)}))"
    key = strip("substring_index(p, '=', 1)")
    value = strip(strip_chars(strip("substr(p, length(substring_index(p, '=', 1)) + 2)"), "\"'"))
    split = f"""transform(concat({inputs}, {found(SELECT_CONTROL)}), m -> named_struct(
        'label', regexp_extract(m, {literal(LABEL)}, 1),
        'pairs', transform(regexp_extract_all(m, {literal(ATTRIBUTE)}, 0), p -> named_struct('k', {key}, 'v', {value}))))"""
    fields = ", ".join(f"'{n}', try_element_at(filter(c.pairs, p -> p.k = '{n}'), -1).v" for n in NAMES)
    named = f"transform({split}, (c, i) -> named_struct('pos', i, 'label', c.label, {fields}))"
    same = ", ".join(f"'{n}', c.{n}" for n in ("pos", "label", *NAMES))
    numbered = f"""transform({named}, c -> named_struct({same},
        'n_size', {_number('c.size')}, 'n_maxlength', {_number('c.maxlength')}))"""
    return once(pages, {"controls": numbered}).drop("html")
