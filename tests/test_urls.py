import pytest
from pyspark.sql import functions as F

from crawlq.functions import urls as U
from crawlq.operators import urls

FULL = "http://u:p@www.Example.com:8080/a/b.php?x=1&x=2#f"


def _urls(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "url_id int, url string")


def _eval(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(F.expr(expression)).first()[0]


def test_full_url(spark):
    parts = urls.url_parts(_urls(spark, FULL)).first()
    assert (parts.scheme, parts.netloc, parts.hostname, parts.port) == ("http", "u:p@www.Example.com:8080", "www.example.com", 8080)
    assert (parts.path, parts.params, parts.query, parts.fragment) == ("/a/b.php", "", "x=1&x=2", "f")
    assert _eval(spark, U.reduced("v"), FULL) == "www.example.com/a/b.php?x=1&x=2"
    assert _eval(spark, U.reduced("v", keep_frag=True), FULL) == "www.example.com/a/b.php?x=1&x=2#f"
    assert _eval(spark, U.reduced("v", does_trim=True), FULL) == "example.com/a/b.php"
    assert _eval(spark, U.path_structure(U.reduced("v")), FULL) == "/a/"
    assert _eval(spark, U.site("v"), FULL) == "http://u:p@www.Example.com:8080/"
    assert _eval(spark, U.path_level(U.url_part("v", "path")), FULL) == 1.5
    assert [(r.k, r.v) for r in urls.url_query_params(_urls(spark, FULL)).collect()] == [("x", "2")]
    tokens = [(r.kind, r.token) for r in urls.url_tokens(_urls(spark, FULL)).collect()]
    assert tokens == [
        ("host", "www"), ("host", "example"), ("host", "com"), ("path", "/a/"), ("path", "b.php"), ("path", ".php"),
        ("query_key", "x"), ("query_value", "2"),
    ]


@pytest.mark.parametrize(
    "url, scheme, hostname, port, path, params",
    [
        ("host:80", "", None, None, "host:80", ""),
        ("http:80", "http", None, None, "80", ""),
        ("HTTP://A.B/x;y/z;p=1?q;r", "http", "a.b", None, "/x;y/z", "p=1"),
        ("mailto:a;b@c", "mailto", None, None, "a;b@c", ""),
        ("//h_x.example:99999/ a", "", "h_x.example", None, "/ a", ""),
        ("http://[2001:DB8::1]:443/x", "http", "2001:db8::1", 443, "/x", ""),
        (None, "", None, None, "", ""),
    ],
)
def test_odd_urls(spark, url, scheme, hostname, port, path, params):
    got = urls.url_parts(_urls(spark, url)).first()
    assert (got.scheme, got.hostname, got.port, got.path, got.params) == (scheme, hostname, port, path, params)


def test_normalised_tokens(spark):
    rows = urls.url_tokens(_urls(spark, "http://h1/a2/song.mp3"), is_normalize=True).collect()
    assert [r.token for r in rows] == ["h0", "/a0/", "song.mp0", ".mp0"]


def test_prefix_and_ip_tokens(spark):
    df = _urls(spark, "http://averylonghost.b/?k=123456789", "http://10.0.0.1/")
    rows = urls.url_tokens(df, is_normalize=True, is_prefix_value=True).orderBy("url_id", "kind", "ord").collect()
    assert [r.token for r in rows] == ["averylon", "b", "k", "00000000", "10.0.0.1"]


@pytest.mark.parametrize("path, ext", [("/a.b/c", ""), ("/x.jpegxx", ""), (".php", ""), ("/x.PHP", ".php")])
def test_extension(spark, path, ext):
    assert _eval(spark, U.file_extension("v"), path) == ext


def test_long_extension_stays_a_token(spark):
    assert [r.token for r in urls.url_tokens(_urls(spark, "/x.jpegxx")).collect()] == ["x.jpegxx", ".jpegxx"]


@pytest.mark.parametrize("path, level", [("", -0.5), ("/a/b/", 2.0)])
def test_level(spark, path, level):
    assert _eval(spark, U.path_level("v"), path) == level


@pytest.mark.parametrize(
    "link, want",
    [
        ("c", "http://h/a/c"), ("../c", "http://h/c"), ("", "http://h/a/b"), ("?q", "http://h/a/b?q"),
        ("//k/z", "http://k/z"), ("#", "http://h/a/b#"), ("/x/../y", "http://h/x/../y"), (".", "http://h/a/"),
        ("..", "http://h/"), ("../../c", "http://h/../c"), ("javascript:void(0)", "javascript:void(0)"),
        ("http:c", "http://h/a/c"), (" c;p?q#f ", "http://h/a/c;p?q#f"),
    ],
)
def test_resolve(spark, link, want):
    df = spark.createDataFrame([("http://h/a/b", link)], "base string, link string")
    assert urls.resolve_links(df).first().resolved == want


@pytest.mark.parametrize(
    "host, kind",
    [
        ("1.2.3.4", "ipv4"), ("1.2.3.4:80", "ipv4"), ("::1", "ipv6"), ("[::1]:80", "ipv6"), ("1.2.3", "name"), ("", "name"),
        ("01.2.3.4", "name"), ("1:2:3:4:5:6:7:8", "ipv6"), ("1:2:3:4:5:6:7::", "ipv6"), ("1::2:3:4:5:6:7:8", "name"),
        ("::ffff:1.2.3.4", "ipv6"), ("fe80::1%eth0", "name"), (None, "name"),
    ],
)
def test_host_kind(spark, host, kind):
    assert _eval(spark, U.host_kind("v"), host) == kind


def test_match_does_not_multiply(spark):
    left = _urls(spark, "http://www.a.com/x?1", "https://a.com/x", "http://b.com/")
    right = _urls(spark, "http://a.com/x", "http://a.com:80/x", "http://c.com/")
    got = {r.url_id: (r.matched, r.n_targets) for r in urls.match_urls(left, right, does_trim=True).collect()}
    assert got == {0: (True, 2), 1: (True, 2), 2: (False, 0)}


def test_no_host_is_a_status(spark):
    rows = urls.url_status(_urls(spark, "http://a/", "/x", None)).orderBy("url_id").collect()
    assert [r.status for r in rows] == ["ok", "no_host", "no_host"]


def test_filter_on_a_part_reads_one_column(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = urls.url_parts(pages).where("hostname = 'x'").select("scheme")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan and "Exchange" not in plan
