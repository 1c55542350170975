"""Pages of a megabyte: the work per page follows its length."""

import time

import pytest

from crawlq.operators import extracts, tags

MANY_NAMES = "".join(f"<t{i}>x</t{i}>" for i in range(40_000))
MANY_SPANS = '<div hidden style="display:none">a</div><p>b</p>' * 20_000
DEEP_ESCAPE = f'<script>document.write(unescape("{"%2525253Cform%2525253E" * 40_000}"))</script>'


def seconds(job, page, html):
    table = page(html)
    start = time.perf_counter()
    rows = job(table).collect()
    return rows, time.perf_counter() - start


@pytest.mark.parametrize(
    "job, html, least",
    [(tags.tag_counts, MANY_NAMES, 80_000), (extracts.visible_text, MANY_SPANS, 20_000), (extracts.write_unescape_forms, DEEP_ESCAPE, 1)],
    ids=["names", "spans", "escape"],
)
def test_a_megabyte(page, job, html, least):
    job(page(html[: len(html) // 50])).collect()  # compiles
    rows, took = seconds(job, page, html)
    assert len(rows) >= least
    # Work with the square of the length takes minutes here.
    assert took < 120


def test_decoding_goes_on_until_it_is_stable(page):
    nested = "<"
    for _ in range(9):
        nested = nested.replace("%", "%25").replace("<", "%3C")
    html = f'<script>document.write(unescape("{nested}form{nested}input"))</script>'
    assert extracts.write_unescape_forms(page(html)).first().writes_form
