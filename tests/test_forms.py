import itertools

import pytest

from crawlq.operators import forms
from crawlq.plans import inputs


@pytest.fixture(scope="module")
def px(spark):
    return inputs.pages(spark, "/root/testdata/sf0.001")


REASONS = {
    1: forms.REASON_MAXLENGTH,
    2: forms.REASON_PAIR,
    7: forms.REASON_KEYWORD,
}


def test_golden_reasons(px):
    for row in forms.card_form_reason(px).collect():
        assert row.reason == REASONS.get(row.page_id % 8)


def test_golden_classes(px):
    for row in forms.classify_forms(px).collect():
        kind = row.page_id % 8
        assert row.is_card_form == (kind == 1) and row.is_signin_form == (kind == 0)
        if kind == 5:
            assert row.is_email_form


def test_golden_counts(px):
    row = forms.page_form_counts(px.where("page_id = 1")).first()
    assert (row.n_text, row.n_password, row.n_submit, row.n_select, row.n_option) == (2, 2, 1, 2, 2)


def test_control_traps(page):
    html = """<input type="text"><input type="text"/><input type="text" data-type="x" />
      <input type='hidden' name="n"/><select><select name="s"><input type='text' size="4px" size='9' readonly/>"""
    rows = forms.form_controls(page(html)).orderBy("pos").collect()
    assert [(r.label, r.type, r.name, r.size, r.readonly) for r in rows] == [
        ("input", "text", None, None, None),
        ("input", "x", None, None, None),
        ("input", "text", None, "9", None),
        ("select", None, "s", None, None),
    ]


def _inputs(*kinds, **more):
    extra = " ".join(f'{k}="{v}"' for k, v in more.items())
    return "".join(f'<input type="{k}" {extra} />' for k in kinds)


def test_only_the_first_window(page):
    rows = forms.four_in_a_row(page(_inputs("text", "password", "password", "text", "text"))).collect()
    assert [r.pos for r in rows] == [3]


def test_other_controls_break_a_run(page):
    assert forms.four_in_a_row(page(_inputs("text", "text", "submit", "text", "text"))).count() == 0


def test_equal_sizes(page):
    html = _inputs("text", "text", "text", "text", size=4) + '<input type="text" name="date" />'
    assert forms.card_form_reason(page(html)).first().reason == forms.REASON_SIZE


def test_no_expiry_no_reason(page):
    assert forms.card_form_reason(page(_inputs("text", "text", "text", "text", size=4))).first().reason is None


def test_readonly_is_not_asked(page):
    html = '<input type="text" name="credit" readonly="1"/><input type="text" id="card"/><input type="text" id="date" />'
    assert forms.card_form_reason(page(html)).first().reason is None


def test_pairs_match_brute_force(page):
    lengths = [3, 16, 99, 4, 17, 3, 99, 99, 20, 99, 99, 99, 4, 99, 3]
    html = "".join(f'<input type="text" autocomplete="OFF" maxlength="{n}" />' for n in lengths)
    html += '<input type="text" autocomplete="off" size="x" maxlength="4"/>'
    want = {
        (i, j)
        for i, j in itertools.product(range(len(lengths)), repeat=2)
        if 16 <= lengths[i] <= 20 and 3 <= lengths[j] <= 4 and i <= j <= i + 4
    }
    assert {(r.long_pos, r.short_pos) for r in forms.card_and_code_pairs(page(html)).collect()} == want


def test_one_scan_without_shuffle(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    df = forms.card_form_reason(pages).where("reason IS NOT NULL")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all(coalesce(html") == 2
