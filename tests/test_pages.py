import pytest
from pyspark.sql import functions as F

from crawlq.functions import text as T
from crawlq.operators import extracts, tags
from crawlq.plans import inputs


@pytest.fixture(scope="module")
def px(spark):
    return inputs.pages(spark, "/root/testdata/sf0.001")


def test_tokens_add_up(px):
    total = px.select(F.sum(F.length("html"))).first()[0]
    assert tags.page_tags(px).select(F.sum(F.length("raw"))).first()[0] == total


@pytest.mark.parametrize(
    "html, want",
    [
        ("<div style='display : block none'>a</div>b", ["b"]),
        ("<div aria-hidden=TRUE>a<div>b</div>c</div>d", ["d"]),
        ("<div aria-hidden='true'>a", []),
        ("<p style='display:none'>a<p>b", ["b"]),
        ("<ul><li style='display:none'>a<ul><li>n</li></ul><li>b</ul>c", ["b", "c"]),
        ("<ul><li style='display:none'>a</ul>c", ["c"]),
        ("<div aria-hidden='true'><span style='display:none'>a</div>b", ["b"]),
        ("<body style='display:none'>a</body>", ["a"]),
        ("<head><title>t</title><body>a", ["a"]),
        ("<select><option>x</option></select>a<noscript>n</noscript><!-- c -->", ["a"]),
        ("<script>var t='</p>';</script><style>p{}</style>a &amp; b", ["a & b"]),
        ("<div hidden class='x' style='visibility:hidden'>a</div>", ["a"]),
        ("<title>x</title> \n <b>  a\t</b>", ["a"]),
        (None, []),
    ],
)
def test_visible_text(page, items, html, want):
    assert items(extracts.visible_text(page(html))) == want


def test_attributes(page, items):
    html = """<a href=x/y>1</a><a title=" href='no'" href = 'b' href="c">2</a><a HREF="&lt;&amp;lt;">3</a>
      <a href>4</a><a href="">5</a><a data-href="no">6</a><a href=" d ">7</a>"""
    assert items(extracts.a_hrefs(page(html))) == ["x/y", "b", "<&lt;", "", "", " d "]


def test_a_tag_of_many_words(page, items):
    html = f"<a {'word=x y ' * 30000} href=z>1</a><div {'style ' * 30000} aria-hidden=true>2</div>{'<b ' * 500}"
    assert items(extracts.a_hrefs(page(html))) == ["z"]
    assert items(extracts.visible_text(page(html)))[0] == "1"


def test_images_inside_links(page, items):
    html = "<a href='1'><b><img src=i></b></a><a href='2'>t<a href='3'><img></a><img><a href=''><img></a>"
    assert items(extracts.a_hrefs_with_img(page(html))) == ["1", "3"]


def test_golden_pages(px, items):
    hidden = items(extracts.a_hrefs(px.where("page_id % 8 = 3")))
    assert "/trap" not in hidden and "/seen" in hidden
    assert set(items(extracts.a_hrefs_with_img(px))) == {"/seen"}
    assert [tuple(i) for i in items(extracts.div_style_keys(px.where("page_id = 4")))] == [("color", "left", "top")]
    shown = items(extracts.visible_text(px.where("page_id = 4")))
    assert "styled" in shown and "gone" not in shown
    assert items(extracts.shortcut_icons(px.where("page_id = 6"))) == ["/fav6.ico"]
    assert items(extracts.meta_refresh(px.where("page_id = 7"))) == ["/next/8"]
    assert extracts.base_url(px.where("page_id = 2")).first().base_url == "https://cdn.example.org/a/"
    flags = extracts.form_flags(px.where("page_id = 5")).first()
    assert flags.has_form and flags.has_form_action and items(extracts.form_actions(px.where("page_id = 5"))) == []
    assert extracts.charset(px.where("page_id = 5")).first().charset == "iso-8859-1"
    assert extracts.write_unescape_forms(px.where("page_id = 6")).first().writes_form


def test_links_and_scripts(page, items):
    html = """<link rel="Shortcut  Icon" href="a"><link rel=icon href=b><link rel="alternate stylesheet" href=c>
      <link rel=STYLESHEET href=d><link rel=stylesheet href=" "><script src=e></script>
      <script type="Text/JavaScript" src=f>x</script><script type=module src=g></script>"""
    df = page(html)
    assert items(extracts.shortcut_icons(df)) == ["a"]
    assert items(extracts.stylesheets(df)) == ["d"]
    assert items(extracts.script_srcs(df)) == ["e", "f"]


def test_titles(page, items):
    html = "<title>One &amp; Two</title><title></title><title>a<b>c</b></title><script>'<title>no</title>'</script>"
    assert items(extracts.titles(page(html), case_sensitive=True)) == ["One & Two"]
    assert items(extracts.title_words(page(html))) == ["one", "two"]


def test_href_takes_the_last_one_of_a_tag(page, items):
    assert items(extracts.href_items(page("<a href='1' HREF='A'>\n<b x href=\"\">"))) == ["a", ""]


def test_words_skip_stop_words(page, items):
    assert items(extracts.page_words(page("<div>A-1 span\nx</div>"))) == ["1", "spanx"]


def test_inputs(page):
    html = "<input><input type=HIDDEN name=h><input type='email'><div style='display:none'><input type=text></div>"
    got = lambda *a: sorted(r.type for r in extracts.visible_inputs(page(html), *a).collect())
    assert got() == ["email", "hidden", "text"]
    assert got(("text", "hidden"), ("hidden",)) == ["text"]
    with pytest.raises(TypeError):
        extracts.visible_inputs(page(html), "text")


def test_bare_select_is_no_match(page):
    rows = extracts.markup_items(page('<select><select name="a">')).collect()
    assert [(r.what, r.item) for r in rows] == [("select", '<select name="a">')]


def test_refresh_only_before_the_body(page, items):
    html = """<meta http-equiv=" Refresh " content="0;URL='x' y"><meta http-equiv=refresh content="1; Url=no">
      <body><meta http-equiv=refresh content="0;url=late">"""
    assert items(extracts.meta_refresh(page(html))) == ["'x' y"]


def test_base_url(page):
    df = page("<base href='/b/'><base href='/c/'>", "no base", "<base>")
    got = [r.base_url for r in extracts.base_url(df).orderBy("page_id").collect()]
    assert got == ["http://h.example/b/", "http://h.example/d/p.html", "http://h.example/d/p.html"]
    assert extracts.base_url(df, base_tag_only=True).where("page_id = 1").first().base_url is None


@pytest.mark.parametrize(
    "text, want",
    [("a%2Bb+%zz%", "a+b+%zz%"), ("%25252525", "%"), ("%%33C", "<"), ("%25%32%35%33C", "<"), ("", "")],
)
def test_percent_decoding_runs_to_the_end(spark, text, want):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(F.expr(T.percent_decode_fully("v"))).first()[0] == want


def test_extracts_do_not_shuffle(px):
    for job in (extracts.visible_text, extracts.a_hrefs_with_img, extracts.titles, tags.hidden_ranges):
        plan = job(px)._jdf.queryExecution().executedPlan().toString()
        # The small test table is spread round-robin once; nothing else moves, and the tokeniser runs once.
        assert "Exchange hashpartitioning" not in plan
        assert plan.count("<!--.*?-->") == 1


def test_flags(page):
    row = extracts.page_flags(page("<HTML lang=x>Sub\nscribe <b>Login</b>", "<html5>"), "login").orderBy("page_id").collect()
    assert (row[0].has_html, row[0].has_search, row[0].has_subscri, row[0].has_keyword) == (True, False, True, True)
    assert not row[1].has_html


def test_stored_tags_are_not_cut_again(spark, page, tmp_path):
    tags.write_tags(page("<title>A</title><a href='/x'>b</a>", None), f"{tmp_path}/tags")
    held = tags.read_tags(spark, f"{tmp_path}/tags")
    counts = tags.tag_counts(held)
    assert "regexp" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sum(r.n for r in counts.collect()) == 6
    assert [r.item for r in extracts.titles(held).collect()] == ["a"] and [r.item for r in extracts.a_hrefs(held).collect()] == ["/x"]
    assert held.count() == 2
