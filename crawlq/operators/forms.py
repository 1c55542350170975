"""Form classification: sign-in, card and e-mail forms.

Every rule looks at one page, so the rules run over arrays inside the page row: the whole
job is one scan without a shuffle, and a page with no matching control costs two regexes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.functions import html as H
from crawlq.functions import text as T
from crawlq.functions import urls as U
from crawlq.functions.controls import NAMES, with_controls
from crawlq.functions.text import literal
from crawlq.operators.extracts import IMAGE_INPUT, OPTION_TAG, SELECT_TAG, input_type

# The reasons a page counts as a card form.
REASON_MAXLENGTH = "4 continuous vsinputs with equal maxlength"
REASON_SIZE = "4 continuous vsinputs with equal size"
REASON_PAIR = "long text with short text in acceptable distance"
REASON_KEYWORD = "require creditcard input form"
PAIR_DISTANCE = 4


def page_form_counts(pages: DataFrame) -> DataFrame:
    """One row per page: visible inputs by type, and image inputs, selects and options by pattern."""
    page = T.once(pages, {"__line": T.compact_lower()})
    counts = {
        name: f"CAST(regexp_count(__line, {literal(pattern)}) AS BIGINT)"
        for name, pattern in (("n_image", IMAGE_INPUT), ("n_select", SELECT_TAG), ("n_option", OPTION_TAG))
    }
    page = T.once(page, counts | {"has_mail": "contains(__line, 'mail')"}).drop("__line")
    inputs = H.tags_named("input", kinds=("open",))
    types = f"transform({H.shown(inputs)}, t -> {input_type('t.raw')})"
    tagged = T.once(H.with_hidden_spans(H.with_tags(page)), {"__types": types})
    by_type = [
        F.expr(f"CAST(size(filter(__types, x -> x = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
        for kind in ("text", "password", "submit", "email")
    ]
    return tagged.select("page_id", "url", *by_type, *counts, "has_mail")


def classify_forms(pages: DataFrame) -> DataFrame:
    """Per page: potential card form, single sign-in form, e-mail form."""
    needed = "CASE WHEN n_select >= 2 AND n_option >= 17 THEN 2 ELSE 4 END"
    return page_form_counts(pages).select(
        "page_id",
        "url",
        F.expr(f"n_submit > 0 AND n_text + n_password >= {needed}").alias("is_card_form"),
        F.expr("n_text = 1 AND (n_submit = 1 OR n_image = 1)").alias("is_signin_form"),
        F.expr("n_text + n_email = 1 AND has_mail").alias("is_email_form"),
    )


def site_form_counts(pages: DataFrame) -> DataFrame:
    """Pages of each form class per host."""
    return classify_forms(pages).groupBy(F.expr(U.host_or_empty("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("is_card_form").alias("n_card"),
        F.count_if("is_signin_form").alias("n_signin"),
        F.count_if("is_email_form").alias("n_email"),
    )


def form_controls(pages: DataFrame) -> DataFrame:
    """Rows `(page_id, pos, label, type, name, id, size, maxlength, autocomplete, readonly)`."""
    rows = with_controls(pages).select("page_id", F.explode_outer("controls").alias("c"))
    return rows.where("c IS NOT NULL").select("page_id", "c.pos", "c.label", *[f"c.{n}" for n in NAMES])


# Runs of four neighbouring text or password controls with the shape of a card number.
# A length that is not a number counts as 0; `pos` is the last control.
_RUNS = "transform(filter(controls, c -> c.pos >= 3), c -> slice(controls, c.pos - 2, 4))"
_SHAPED = """filter({runs}, w -> forall(w, c -> coalesce(c.type IN ('text', 'password'), false)) AND (
    (w[0].type = 'text' AND w[3].type = 'text') OR (w[1].type = 'password' AND w[2].type = 'password')))"""
_WINDOWS = f"""transform({_SHAPED.format(runs=_RUNS)}, w -> named_struct(
    'pos', w[3].pos,
    'types', transform(w, c -> c.type),
    'maxlengths', transform(w, c -> coalesce(c.n_maxlength, 0)),
    'sizes', transform(w, c -> coalesce(c.n_size, 0))))"""

# A long (card number) and a short (code) control at most four controls apart.
_SIZED = """(lower(coalesce(c.autocomplete, '')) = 'off' AND c.n_size IS NOT NULL AND c.n_maxlength IS NOT NULL
    AND (c.n_size BETWEEN {lo} AND {hi} OR c.n_maxlength BETWEEN {lo} AND {hi}))"""
_LONGS = f"filter(controls, c -> {_SIZED.format(lo=16, hi=20)})"
_SHORTS = f"filter(slice(controls, l.pos + 1, {PAIR_DISTANCE + 1}), c -> {_SIZED.format(lo=3, hi=4)})"
_PAIRS = f"""flatten(transform({_LONGS}, l -> transform({_SHORTS},
    c -> named_struct('long_pos', l.pos, 'short_pos', c.pos))))"""


def _mentions(which: str, word: str) -> str:
    """Does the name or id of such a control contain the word."""
    named = f"(contains(lower(coalesce(c.name, '')), '{word}') OR contains(lower(coalesce(c.id, '')), '{word}'))"
    return f"exists(controls, c -> {which} AND {named})"


_SELECT = "c.label = 'select'"
_TEXT_INPUT = "c.label = 'input' AND coalesce(c.type = 'text', false)"
_EDITABLE = f"{_TEXT_INPUT} AND c.readonly IS NULL"
_HAS_EXPIRY = f"""(({_mentions(_SELECT, 'month')} AND {_mentions(_SELECT, 'year')})
    OR {_mentions(_TEXT_INPUT, 'date')})"""
_ASKS_FOR_CARD = f"({_mentions(_EDITABLE, 'credit')} AND {_mentions(_EDITABLE, 'card')})"


def four_in_a_row(pages: DataFrame) -> DataFrame:
    """Rows `(page_id, pos, types, maxlengths, sizes)` of the four-control runs."""
    rows = with_controls(pages).select("page_id", F.expr(f"explode_outer({_WINDOWS})").alias("w"))
    return rows.where("w IS NOT NULL").select("page_id", "w.*")


def card_and_code_pairs(pages: DataFrame) -> DataFrame:
    """Rows `(page_id, long_pos, short_pos)`."""
    rows = with_controls(pages).select("page_id", F.expr(f"explode_outer({_PAIRS})").alias("p"))
    return rows.where("p IS NOT NULL").select("page_id", "p.*")


def card_form_flags(pages: DataFrame) -> DataFrame:
    """Per page: an expiry date is asked for; the words for a credit card appear in text inputs."""
    return with_controls(pages).select(
        "page_id", F.expr(_HAS_EXPIRY).alias("has_expiry"), F.expr(_ASKS_FOR_CARD).alias("asks_for_card")
    )


def card_form_reason(pages: DataFrame) -> DataFrame:
    """Per page: why it counts as a card form, or NULL.

    Without an expiry date nothing else is looked at. Then the first run of four with equal
    lengths or sizes decides, then a number-and-code pair, then the keywords.
    """
    verdicts = f"""transform({_WINDOWS}, w -> CASE WHEN w.maxlengths = array(4, 4, 4, 4) THEN '{REASON_MAXLENGTH}'
        WHEN w.sizes = array(4, 4, 4, 4) THEN '{REASON_SIZE}' END)"""
    reason = f"""CASE WHEN {_HAS_EXPIRY} THEN coalesce(
        try_element_at(filter({verdicts}, v -> v IS NOT NULL), 1),
        CASE WHEN size({_PAIRS}) > 0 THEN '{REASON_PAIR}' END,
        CASE WHEN {_ASKS_FOR_CARD} THEN '{REASON_KEYWORD}' END) END"""
    return T.once(with_controls(pages), {"reason": reason}).select("page_id", "reason")
